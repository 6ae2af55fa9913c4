"""Set operations on hit lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    flags = membership({"a": a, "b": b})
    return flags.filter(F.col("in_a") != F.col("in_b")).select(*a.columns)


def membership(sets: dict[str, DataFrame]) -> DataFrame:
    """One row per distinct element with a flag per set; one shuffle in all."""
    cols = next(iter(sets.values())).columns
    tagged = reduce(
        DataFrame.unionByName, [d.select(*cols, F.lit(name).alias("_set")) for name, d in sets.items()]
    )
    return tagged.groupBy(*cols).agg(*[F.max(F.col("_set") == n).alias(f"in_{n}") for n in sets])


def venn_counts(sets: dict[str, DataFrame]) -> DataFrame:
    flags = [f"in_{n}" for n in sets]
    return membership(sets).groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


def remove_overlap(pairs: DataFrame, known: DataFrame, keys) -> DataFrame:
    return pairs.join(known, list(keys), "left_anti")
