"""Exact grouped quantiles (linear interpolation) for groups of any size.

Equal values are counted first; an ordered scan gives every distinct value the
ranks it covers, and the wanted ranks are picked from those. No task holds a
whole group. Values of a bounded kind, such as 16-bit intensities, may use
Spark's exact aggregate, which keeps one count per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.ordered import scan


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: Sequence[float], out: str = "q", bounded: bool = False, counted: bool = False) -> DataFrame:
    """One row per group with ``out`` = array of quantiles; nulls are ignored,
    and a group without values has none.

    ``bounded`` is for values of which only a small, fixed number are distinct;
    with ``counted`` too, equal ones are counted first, for few and large groups.
    """
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("_v"))
    if bounded and counted:
        counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
        return counts.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, probs)), F.col("_c")).alias(out))
    if bounded:
        return rows.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, probs))).alias(out))
    counts = rows.groupBy(*keys, "_v").agg(F.count("_v").alias("_c"))
    run = scan(counts, keys, [F.col("_v")], {"_upto": ("sum", F.col("_c")), "_n": ("total", F.col("_c"))})
    last, n = F.col("_upto"), F.col("_n")
    first = last - F.col("_c")
    picks = []
    for p in probs:
        at = (n - 1) * F.lit(float(p))

        def hit(rank: Column) -> Column:
            return F.max(F.when((first <= rank) & (rank < last), F.col("_v")))

        lo, hi = hit(F.floor(at)), hit(F.ceil(at))
        picks.append(lo + (hi - lo) * F.max(at - F.floor(at)))
    return run.groupBy(*keys).agg(F.when(F.max(n) > 0, F.array(*picks)).alias(out))
