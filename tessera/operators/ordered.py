"""Ordered scans that stay balanced when one group holds most of the rows.

A plain window sorts a whole group in one task. Here the rows are range
partitioned along the order axis and written once; each range is a block. The
window runs per (group, block), and one header row per (group, block) carries
the state across the cuts, so no join is needed. The number of blocks is that
of the range exchange: the session's shuffle partitions, merged by size by
adaptive execution. Rows that tie on the first order column are split by the
others, and rows of different groups with equal order values by their keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.session import cut_lineage

BLOCK = "_block"


def blocked(df: DataFrame, order: Sequence[Column], n_blocks: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` cut into ranges along ``order`` (ascending, nulls first) and
    written once. Several scans along the axis, or against it, may share it.
    Rows of many groups with one order value are split by their ``keys``; the
    ranges of each group are in order all the same."""
    axis = [*order, *map(F.col, keys)]
    spread = df.repartitionByRange(n_blocks, *axis) if n_blocks else df.repartitionByRange(*axis)
    return cut_lineage(spread.withColumn(BLOCK, F.spark_partition_id()))


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False, large: bool = False) -> DataFrame:
    """Join the columns of ``right`` to ``left``. Plain equality keeps a
    partitioning by the keys in use; rows whose keys may be null need
    ``null_safe``. Without keys ``right`` must be a single row of totals, which
    is asserted. ``large`` says that both sides grow with the rows: neither is
    sent to the driver, whatever the estimate (an explode does not raise it)."""
    if not keys:
        totals = right.agg(F.count(F.lit(1)).alias("_rows"), F.first(F.struct(*right.columns)).alias("_total"))
        one = F.when(F.col("_rows") > 1, F.raise_error(F.lit("expected a single row of totals")).cast(totals.schema["_total"].dataType)).otherwise(F.col("_total"))
        return left.crossJoin(F.broadcast(totals.select(one.alias("_total")).select("_total.*")))
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    renamed = renamed.hint("merge") if large else renamed
    if null_safe:
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    else:
        same = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, same), how).drop(*[f"_k_{k}" for k in keys])


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    outputs: dict[str, tuple],
    n_blocks: int | None = None,
) -> DataFrame:
    """Add running columns over ``order`` (ascending, nulls first) per ``keys``.

    ``outputs`` maps a new column to ``(kind, value)`` with kind one of
    ``count`` (1-based position), ``sum``, ``min``, ``max``, ``last`` (latest
    non-null value), ``lag`` (previous row's value) and ``total`` (the sum of the
    whole group, without a sort of its own); a third member
    ``"back"`` runs from the other end. Everything asked for comes from one
    pass. A frame from ``blocked`` along the same order keeps its blocks.
    """
    keys, shared = list(keys), BLOCK in df.columns
    body = df if shared else blocked(df, order, n_blocks, keys)
    spec = {name: (out[0], out[1], len(out) > 2 and out[2] == "back") for name, out in outputs.items()}
    places = [f"_o{n}" for n in range(len(order))]
    forward = [F.col(p).asc_nulls_first() for p in places]
    backward = [F.col(p).desc_nulls_last() for p in places]
    given = {f"_v_{name}": (F.lit(1).cast("long") if kind == "count" else value) for name, (kind, value, _) in spec.items()}
    body = body.withColumns(given | dict(zip(places, order)))
    place = F.struct(*places)

    # what a block adds to the state, and the state that reaches each block
    adds, carried = [], []
    across = W.partitionBy(*keys)
    for name, (kind, _, back) in spec.items():
        value = F.col(f"_v_{name}")
        pick = F.min_by if back else F.max_by
        before = across.orderBy(F.col(BLOCK).desc() if back else F.col(BLOCK)).rowsBetween(W.unboundedPreceding, -1)
        if kind in ("count", "sum"):
            adds.append(F.sum(value).alias(name))
            carried.append(F.sum(name).over(before))
        elif kind in ("min", "max"):
            adds.append(getattr(F, kind)(value).alias(name))
            carried.append(getattr(F, kind)(name).over(before))
        elif kind == "last":
            adds.append(pick(value, F.when(value.isNotNull(), place)).alias(name))
            carried.append(F.last(name, ignorenulls=True).over(before))
        elif kind == "total":
            adds.append(F.sum(value).alias(name))
            carried.append(F.sum(name).over(across))
        elif kind == "lag":
            adds.append(pick(value, place).alias(name))
            carried.append(F.last(name).over(before))
        else:
            raise ValueError(f"unknown scan kind: {kind}")
    states = body.groupBy(*keys, BLOCK).agg(*adds)
    headers = states.select(
        *keys, BLOCK, *[c.cast(body.schema[f"_v_{n}"].dataType).alias(f"_v_{n}") for n, c in zip(spec, carried)], F.lit(True).alias("_head")
    )
    both = body.withColumn("_head", F.lit(False)).unionByName(headers, allowMissingColumns=True)

    first = F.col("_head").desc()
    running = {}
    for name, (kind, _, back) in spec.items():
        value = F.col(f"_v_{name}")
        local = W.partitionBy(*keys, BLOCK).orderBy(first, *(backward if back else forward))
        upto = local.rowsBetween(W.unboundedPreceding, 0)
        if kind in ("count", "sum"):
            running[name] = F.sum(value).over(upto)
        elif kind in ("min", "max"):
            running[name] = getattr(F, kind)(value).over(upto)
        elif kind == "last":
            running[name] = F.last(value, ignorenulls=True).over(upto)
        elif kind == "total":
            running[name] = F.first(value).over(upto)  # that of the header
        else:
            running[name] = F.lag(value, 1).over(local)
    kept = [c for c in df.columns if c not in outputs]
    ran = both.select(*kept, *([] if shared else [BLOCK]), "_head", *[c.alias(n) for n, c in running.items()])
    return ran.filter(~F.col("_head")).select(*kept, *outputs)
