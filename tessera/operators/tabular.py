"""Tabular kit: casts, reductions, histograms, reshaping, ranks and fills."""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators import ordered
from tessera.operators.cells import first_per_key
from tessera.operators.quantiles import quantiles


# --- projections ---------------------------------------------------------

def cast_columns(df: DataFrame, ints=(), floats=(), strings=()) -> DataFrame:
    """Strict casts: under ANSI rules a value that does not fit raises."""
    kinds = {**dict.fromkeys(ints, "bigint"), **dict.fromkeys(floats, "double"), **dict.fromkeys(strings, "string")}
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def replace_columns(df: DataFrame, **functions: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c, f in functions.items()})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark aggregates NaN as a value; missing measurements must be null."""
    floats = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(operator.or_, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(operator.and_, conditions)


def gate(df: DataFrame, expression: str, **bound) -> DataFrame:
    """Filter by an expression; ``@name`` is replaced by a bound value and
    chained comparisons (``100 < i < 1380``) are split into two."""
    def literal(m):
        v = bound[m.group(1)]
        if isinstance(v, (list, tuple, set)):
            return "(" + ", ".join(repr(x) for x in sorted(v)) + ")"
        return repr(v)

    text = re.sub(r"@(\w+)", literal, expression)
    text = re.sub(r"(?<![<>=!])==", "=", text)
    text = re.sub(r"(\w+)\s*=\s*(\([^()]*,[^()]*\))", r"\1 IN \2", text)
    text = re.sub(r"\s&\s", " AND ", text)
    text = re.sub(r"\s\|\s", " OR ", text)
    text = re.sub(
        r"([\w.+-]+)\s*(<=?|>=?)\s*([A-Za-z_]\w*)\s*(<=?|>=?)\s*([\w.+-]+)", r"(\1 \2 \3 AND \3 \4 \5)", text
    )
    return df.filter(F.expr(text))


def format_template(df: DataFrame, template: str, out: str) -> DataFrame:
    """Fill ``{column}`` places; every column is cast to string."""
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    cols = [F.col(p[1:-1]).cast("string") if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in parts]
    return df.withColumn(out, F.concat(*cols))


def expand_separated(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    """One row per trimmed entry of a delimited column."""
    entries = F.transform(F.split(F.col(col), re.escape(sep)), F.trim)
    return df.withColumn(col, F.explode(entries))


def columns_like(df: DataFrame, prefix="", suffix="", contains="", pattern=None) -> list[str]:
    return [
        c for c in df.columns
        if c.startswith(prefix) and c.endswith(suffix) and contains in c and (not pattern or re.search(pattern, c))
    ]


def category_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """Codes of the sorted distinct values from 0; null is -1."""
    kinds = df.select(col).filter(F.col(col).isNotNull()).distinct()
    codes = ordered.scan(kinds, [], [F.col(col)], {"_code": ("count", None)})
    codes = codes.select(F.col(col).alias("_v"), (F.col("_code") - 1).alias(out))
    return df.join(codes, df[col] == codes["_v"], "left").drop("_v").withColumn(out, F.coalesce(out, F.lit(-1).cast("bigint")))


def reindex(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """One row per row of ``index`` (a key and its place), with nulls where
    ``df`` has no such key; keys that the index lacks go."""
    return index.join(df, key, "left")


def matching_terms(df: DataFrame, col: str, alternatives: Sequence[str]) -> DataFrame:
    """Rows whose term matches one of the patterns."""
    return df.filter(F.col(col).rlike("|".join(f"(?:{a})" for a in alternatives)))


def log_ratio(a: Column, b: Column) -> Column:
    """log2(a / b); 0 gives minus infinity and 0/0 NaN, as floating point has it."""
    x = a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    return F.when((a == 0) & (b == 0), F.lit(float("nan"))).when(b == 0, F.lit(float("inf"))).when(x == 0, F.lit(float("-inf"))).otherwise(F.log2(x))


def add_suffix(df: DataFrame, suffix: str, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keys})


def first_seen_codes(df: DataFrame, col: str, order: Column, out: str) -> DataFrame:
    """Integer codes in order of first appearance. Codes cover distinct values only."""
    firsts = df.groupBy(col).agg(F.min(order).alias("_first"))
    codes = ordered.scan(firsts, [], [F.col("_first"), F.col(col)], {"_code": ("count", None)})
    codes = codes.select(F.col(col).alias("_v"), (F.col("_code") - 1).alias(out))
    return df.join(codes, df[col].eqNullSafe(codes["_v"])).drop("_v")


# --- reductions ----------------------------------------------------------

def _sem(c: Column) -> Column:
    return F.stddev_samp(c) / F.sqrt(F.count(c))


REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "sem": _sem,
    "size": lambda c: F.count(F.lit(1)),
    "count": lambda c: F.count(F.lit(1)),  # group size, nulls included
    "count_nonnull": F.count,
    "sum": F.sum,
    "sum_int": lambda c: F.sum(c).cast("bigint"),
}


def reduce_groups(
    df: DataFrame, keys: Sequence[str], value: str, *names: str, order: Sequence[Column] = (), **named
) -> DataFrame:
    """Named reductions of one column; also ``median``, ``first``, ``second``
    (by ``order``), and any function Column -> aggregate Column."""
    wanted = {**{n: n for n in names}, **named}
    col = F.col(value)
    aggs = [
        (f(col) if callable(f) else REDUCTIONS[f](col)).alias(name)
        for name, f in wanted.items()
        if callable(f) or f not in ("median", "first", "second")
    ]
    place = F.struct(*[o.alias(f"o{n}") for n, o in enumerate(order)]) if order else None
    aggs += [F.min_by(col, place).alias(n) for n, f in wanted.items() if f == "first"]
    result = df.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("_size")]))
    for n, f in wanted.items():
        if f == "median":
            extra = quantiles(df, keys, col, [0.5], "_m").select(*keys, F.col("_m")[0].alias(n))
        elif f == "second":
            ranked = ordered.scan(df, keys, order, {"_at": ("count", None)})
            extra = ranked.filter(F.col("_at") == 2).select(*keys, col.alias(n))
        else:
            continue
        result = ordered.attach(result, extra, keys, "left", null_safe=True)
    return result.select(*keys, *wanted)


def histogram(
    df: DataFrame,
    index: Sequence[str],
    column: str,
    edges: Sequence[float],
    cumulative: bool = False,
    normalize: bool = False,
    wrap: bool = False,
) -> DataFrame:
    """Counts per group and left bin edge, zero-filled over all edges.

    A value belongs to the last edge that is not above it. Values below the
    first edge are dropped, or counted in the last bin with ``wrap``.
    """
    name = {(0, 0): "count", (0, 1): "fraction", (1, 0): "csum", (1, 1): "csum_fraction"}[int(cumulative), int(normalize)]
    bins = [float(e) for e in edges]
    value = F.col(column)
    place = reduce(operator.add, [(value >= e).cast("int") for e in bins]) - 1
    if wrap:
        place = F.when(place < 0, len(bins) - 1).otherwise(place)
    counted = (
        df.select(*index, place.alias("_p")).filter(F.col("_p") >= 0)
        .groupBy(*index, "_p").agg(F.count(F.lit(1)).alias("_n"))
    )
    # at most len(bins) entries per group from here on
    slots = F.array(*[F.coalesce(F.sum(F.when(F.col("_p") == n, F.col("_n"))), F.lit(0)) for n in range(len(bins))])
    grouped = counted.groupBy(*index).agg(slots.alias("_s"), F.sum("_n").alias("_t"))
    s = F.col("_s")
    if cumulative:
        s = F.transform(F.sequence(F.lit(1), F.size(s)), lambda k: F.aggregate(
            F.slice(F.col("_s"), 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x))
    if normalize:
        s = F.transform(s, lambda x: x / F.col("_t"))
    edge = F.array(*map(F.lit, bins))
    return grouped.select(*index, F.posexplode(s).alias("_k", name)).select(
        *index, edge[F.col("_k")].alias("bin"), name
    )


# --- reshaping -----------------------------------------------------------

def pivot_statistics(
    df: DataFrame, index: str, names: str, groups: str, values: Sequence[str], count: str,
    name_list: Sequence[str], group_list: Sequence[str],
) -> DataFrame:
    """Wide table ``value_name_group`` (means) plus ``cells_group`` counts."""
    cells = [
        F.avg(F.when((F.col(names) == n) & (F.col(groups) == g), F.col(v))).alias(f"{v}_{n}_{g}")
        for v in values for n in name_list for g in group_list
    ]
    sizes = [F.avg(F.when(F.col(groups) == g, F.col(count))).alias(f"cells_{g}") for g in group_list]
    return df.groupBy(index).agg(*cells, *sizes)


def scale_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns to mean 0 and population deviation 1, from one pass of moments."""
    moments = df.agg(*[a for c in cols for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in cols}
    return ordered.attach(df, moments, []).withColumns(scaled).select(*df.columns)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def column_group_mean(df: DataFrame, key: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Row-wise mean over groups of columns, nulls skipped."""
    def mean(cols):
        total = reduce(operator.add, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
        known = reduce(operator.add, [F.col(c).isNotNull().cast("int") for c in cols])
        return total / F.nullif(known, F.lit(0))

    return df.select(key, *[mean(cols).alias(g) for g, cols in groups.items()])


# --- ranks, fills and series --------------------------------------------

def rank_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1-based running position in each group."""
    return ordered.scan(df, keys, order, {out: ("count", None)})


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    filled = ordered.scan(df, keys, order, {f"_f_{c}": ("last", F.col(c)) for c in cols})
    return filled.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])


def interpolate(df: DataFrame, keys: Sequence[str], order: Sequence[Column], col: str) -> DataFrame:
    """Linear in row position between known values; trailing gaps repeat the
    last value, leading gaps stay null. The order columns are numbers without
    gaps (nulls) and unique per group."""
    placed = ordered.scan(ordered.blocked(df, order, keys=keys), keys, order, {"_at": ("count", None)})
    known = F.when(F.col(col).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(col).alias("v")))
    placed = placed.withColumn("_known", known)
    both = ordered.scan(placed, keys, order, {"_prev": ("last", F.col("_known")), "_next": ("last", F.col("_known"), "back")})
    p, n = F.col("_prev"), F.col("_next")
    slope = (n["v"] - p["v"]) / F.nullif(n["at"] - p["at"], F.lit(0))
    value = F.coalesce(F.col(col), p["v"] + slope * (F.col("_at") - p["at"]), p["v"])
    return both.withColumn(col, value).drop("_at", "_known", "_prev", "_next", ordered.BLOCK)


def displacement(df: DataFrame, keys: Sequence[str], order: Sequence[Column], x: str, y: str, out: str) -> DataFrame:
    moved = ordered.scan(df, keys, order, {"_px": ("lag", F.col(x)), "_py": ("lag", F.col(y))})
    dx, dy = F.col(x) - F.col("_px"), F.col(y) - F.col("_py")
    return moved.withColumn(out, F.sqrt(dx * dx + dy * dy)).drop("_px", "_py")


def zscore(df: DataFrame, keys: Sequence[str], value: str, out: str, ddof: int = 1) -> DataFrame:
    """(x - mean) / sd per group, with the moments aggregated before the join."""
    sd = F.stddev_samp if ddof else F.stddev_pop
    moments = df.groupBy(*keys).agg(F.avg(value).alias("_m"), sd(value).alias("_s"))
    joined = ordered.attach(df, moments, keys, null_safe=True)
    return joined.withColumn(out, (F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


# --- order and samples ---------------------------------------------------

def natural_key(col: Column) -> Column:
    """Sort key that orders ``a2`` before ``a10``: text part, then number."""
    digits = F.regexp_extract(col, r"(\d+)", 1)
    return F.struct(
        F.regexp_extract(col, r"^(\D*)", 1).alias("text"),
        F.when(digits != "", digits.cast("decimal(38,0)")).alias("number"),
        col.alias("whole"),
    )


def hash_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Uniform sample of n rows, the same for the same keys and seed: those of
    the least hashes. A threshold a little above the wanted share cuts the rows
    first, so that only about n are ranked, in ranges."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")
    total = df.count()
    share = min(1.0, (n + 8 * math.sqrt(n) + 16) / max(total, 1))
    low = df.withColumn("_h", hashed)
    few = low.filter(F.col("_h") <= int(share * (1 << 60)))
    if share < 1 and few.count() < n:  # next to never
        few = low
    ranked = ordered.scan(few, [], [F.col("_h"), *map(F.col, keys)], {"_at": ("count", None)})
    return ranked.filter(F.col("_at") <= n).drop("_h", "_at")


def custom_order(col: Column, values: Sequence) -> Column:
    """Place in ``values`` from 1; null for values that are not listed."""
    return F.nullif(F.array_position(F.array(*map(F.lit, values)), col), F.lit(0).cast("bigint"))


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_per_key(df, keys, order)


def drop_small_groups(df: DataFrame, keys: Sequence[str], at_least: int) -> DataFrame:
    big = df.groupBy(*keys).count().filter(F.col("count") >= at_least)
    return df.join(big, list(keys), "left_semi")


def apply_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], fn, schema) -> DataFrame:
    """Cogroup by key for group-bounded work; keys absent on one side are left out."""
    shared = left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")
    a, b = (d.join(shared, list(keys), "left_semi") for d in (left, right))
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(fn, schema)
