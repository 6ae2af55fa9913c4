"""Screen statistics: tests, combination, adjustment and distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.special import chi2_tail_even, hypergeometric_tail, student_t_two_sided
from tessera.operators import ordered
from tessera.operators.ordered import attach, scan
from tessera.operators.quantiles import quantiles
from tessera.session import cut_lineage


def _moments(df: DataFrame, keys: Sequence[str], value: str, tag: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias(f"n{tag}"), F.avg(value).alias(f"mean{tag}"), F.var_samp(value).alias(f"var{tag}")
    )


def t_test(n1, m1, v1, n2, m2, v2) -> tuple[Column, Column]:
    """Pooled two-sample statistic and degrees of freedom from moments; null
    when a side has fewer than two values or nothing varies."""
    df = n1 + n2 - 2
    pooled = (F.coalesce(v1, F.lit(0.0)) * (n1 - 1) + F.coalesce(v2, F.lit(0.0)) * (n2 - 1)) / F.nullif(df, F.lit(0))
    spread = F.nullif(F.sqrt(pooled * (F.lit(1.0) / n1 + F.lit(1.0) / n2)), F.lit(0.0))
    return (m1 - m2) / spread, df


def t_test_to_control(
    df: DataFrame, group: str, value: str, control: Column, keys: Sequence[str] = (), min_n: int = 2
) -> DataFrame:
    """Every group against the control rows: ``statistic``, ``dof``, ``pval``."""
    keys = list(keys)
    groups = _moments(df, [*keys, group], value, "1")
    ctrl = _moments(df.filter(control), keys, value, "2")
    both = attach(groups, ctrl, keys, "left", null_safe=True)
    t, dof = t_test(*[F.col(c) for c in ("n1", "mean1", "var1", "n2", "mean2", "var2")])
    enough = (F.col("n1") >= min_n) & (F.col("n2") >= min_n)
    out = both.select(
        *keys, group, F.col("n1").alias("count"), F.col("mean1").alias("mean"),
        F.when(enough, t).alias("statistic"), dof.alias("dof"),
    )
    return out.withColumn("pval", student_t_two_sided("statistic", F.col("dof").cast("double")))


def adjust_pvalues(df: DataFrame, p: str, keys: Sequence[str] = (), bh: str | None = None, holm_sidak: str | None = None) -> DataFrame:
    """Benjamini-Hochberg and/or Holm-Sidak adjusted p-values per family.

    Works on the distinct p-values with their counts, so ties are cheap and
    the scans stay balanced; null and NaN p-values are not counted and get null.
    """
    keys, v = list(keys), F.col(p)
    tied = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_c"))
    tied = scan(ordered.blocked(tied, [v], keys=keys), keys, [v], {"_upto": ("sum", F.col("_c")), "_down": ("sum", F.col("_c"), "back")})
    # of _m values, _upto are at or below this one and _down at or above
    step_up = v * (F.col("_upto") + F.col("_down") - F.col("_c")) / F.col("_upto")
    step_down = F.when(v >= 1, F.lit(1.0)).otherwise(-F.expm1(F.col("_down") * F.log1p(-v)))
    wanted = {}
    if bh:
        wanted[bh] = ("min", step_up, "back")
    if holm_sidak:
        wanted[holm_sidak] = ("max", step_down)
    ran = scan(tied, keys, [v], wanted)
    return attach(df, ran.select(*keys, p, *[F.least(F.col(c), F.lit(1.0)).alias(c) for c in wanted]), [*keys, p], "left", null_safe=bool(keys))


def fisher_combine(df: DataFrame, group: str, p: str) -> DataFrame:
    """-2 sum(ln p) per group and its chi-square tail; p = 0 gives infinity."""
    known = F.nanvl(F.col(p).cast("double"), F.lit(None).cast("double"))
    log_p = F.when(known > 0, F.ln(F.when(known > 0, known))).when(known == 0, float("-inf"))
    # a guide without a p-value leaves its gene undefined
    complete = F.count(known) == F.count(F.lit(1))
    chi = F.when(complete, F.lit(-2.0) * F.sum(log_p))
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_sg"), chi.alias("fisher_combined_chi"))
    return g.withColumn("pval", chi2_tail_even(F.col("fisher_combined_chi"), F.col("n_sg")))


def auto_range(df: DataFrame, feature: str, tails: float = 0.005) -> tuple[float, float]:
    """The central range of a feature; two numbers for the driver."""
    clean = df.select(F.nanvl(F.col(feature), F.lit(None)).alias("v"))
    low, high = quantiles(clean, [], F.col("v"), [tails, 1 - tails]).first()["q"]
    return low, high


def _bin(value: Column, low: float, high: float, nbins: int) -> Column:
    """Equal-width bin number; the upper edge closes the last bin, null outside."""
    at = F.floor((value - low) / (high - low) * nbins).cast("int")
    return F.when((value >= low) & (value <= high), F.least(at, F.lit(nbins - 1)))


def _cdf_sums(counts: DataFrame, keys, nbins):
    """The trapezoid parts of a binned CDF from (_bin, _n). The sum over bins of
    the CDF is the sum over values of (nbins - bin), so no per-bin table is needed."""
    b, n = F.col("_bin"), F.sum("_n")
    return counts.groupBy(*keys).agg(
        (F.coalesce(F.sum((F.lit(nbins) - b) * F.col("_n")), F.lit(0)) / n).alias("area"),
        (F.sum(F.when(F.coalesce(b, F.lit(-1)) == 0, F.col("_n")).otherwise(0)) / n).alias("head"),
        (F.coalesce(F.sum(F.when(b.isNotNull(), F.col("_n"))), F.lit(0)) / n).alias("tail"),
    )


def _areas(counts: DataFrame, keys, feature: str, control: Column, nbins: int) -> DataFrame:
    groups = _cdf_sums(counts, keys, nbins)
    ctrl = _cdf_sums(counts.filter(control), [], nbins).withColumnsRenamed({"area": "c_area", "head": "c_head", "tail": "c_tail"})
    area = F.col("c_area") - F.col("area")
    ends = (F.col("c_head") - F.col("head")) + (F.col("c_tail") - F.col("tail"))
    return attach(groups, ctrl, []).select(*keys, ((area - ends / 2) / nbins).alias(feature))


def delta_auc(
    df: DataFrame, keys: Sequence[str], feature: str, control: Column, low: float, high: float, nbins: int = 50
) -> DataFrame:
    """Area between the control rows' CDF and each group's CDF on ``nbins`` bins.

    Values outside the range only count in the denominator.
    """
    counts = df.withColumns({"_bin": _bin(F.col(feature), low, high, nbins), "_control": control}).groupBy(*keys, "_bin", "_control").agg(
        F.count(F.lit(1)).alias("_n"))
    return _areas(cut_lineage(counts), keys, feature, F.col("_control"), nbins)


def stars(adjusted: Column, raw: Column, alpha: float) -> Column:
    """One star by the adjusted value, more by the raw one, as published."""
    return (
        F.when(raw < 1e-4, "****").when(raw < 1e-3, "***").when(raw < 1e-2, "**")
        .when(adjusted < alpha, "*").otherwise("")
    )


def gene_statistics(
    cells: DataFrame,
    feature: str,
    control_guides: Sequence[str],
    control_gene: str = "nontargeting",
    alpha: float = 0.05,
    nbins: int = 50,
    value_range: tuple[float, float] | None = None,
    genes: Sequence[str] | None = None,
    gate: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Per-guide CDF areas and per-gene significance of a screen feature.

    ``cells`` has gene, sgRNA (``<gene>_<n>``), rep and the feature. Each
    guide's replicate areas are tested against the control gene's, guides are
    combined per gene and the genes adjusted together. The control curve uses
    every cell of the control guides. Cells are counted once per (gene, guide,
    rep, bin); range, curve and areas come from these counts.
    """
    if genes is not None:
        cells = cells.filter(F.col("gene").isin(*genes))
    if gate is not None:
        cells = cells.filter(gate)
    low, high = value_range or auto_range(cells, feature)
    counts = cut_lineage(cells.withColumn("_bin", _bin(F.col(feature), low, high, nbins)).groupBy("gene", "sgRNA", "rep", "_bin").agg(
        F.count(F.lit(1)).alias("_n")))
    aucs = _areas(counts, ["gene", "sgRNA", "rep"], feature, F.col("sgRNA").isin(*control_guides), nbins)
    aucs = aucs.withColumn("sgRNA_num", F.concat(F.lit("sg"), F.split("sgRNA", "_")[1]))
    tested = t_test_to_control(aucs, "sgRNA", feature, F.col("gene") == control_gene, min_n=1)
    tested = tested.withColumn("gene", F.split("sgRNA", "_")[0])
    stats = adjust_pvalues(fisher_combine(tested, "gene", "pval"), "pval", bh="fdr_bh_adj_p")
    stats = stats.withColumns({
        "significant": F.col("fdr_bh_adj_p") <= alpha,
        "pval_text": stars(F.col("fdr_bh_adj_p"), F.col("pval"), alpha),
    })
    return aucs, stats


def wasserstein_to_control(df: DataFrame, group: str, value: str, control: Column) -> DataFrame:
    """First Wasserstein distance of every group to the control rows.

    The control's CDF and its running integral are looked up at the group's
    own values and at the group's own levels, so the work is linear in the
    rows of both sides instead of (groups x control rows).
    """
    v = F.col(value).cast("double")
    rows = df.select(group, v.alias("v")).filter(F.col("v").isNotNull())
    ctrl = df.filter(control).select(v.alias("v")).filter(F.col("v").isNotNull())

    # control: distinct value, rows up to it, integral of the CDF up to it
    c = ctrl.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    size = c.agg(F.sum("n").alias("nc"), F.max("v").alias("vmax"))
    c = scan(ordered.blocked(c, [F.col("v")]), [], [F.col("v")], {"upto": ("sum", F.col("n")), "pv": ("lag", F.col("v"))})
    c = attach(c, size, [])
    before = (F.col("upto") - F.col("n")) / F.col("nc")
    step = F.coalesce(before * (F.col("v") - F.col("pv")), F.lit(0.0))
    c = scan(c.withColumn("step", step), [], [F.col("v")], {"area": ("sum", F.col("step"))})
    c = cut_lineage(c.select("v", "upto", "nc", "vmax", "area"))

    # groups: distinct value, rows up to it, the next value
    g = rows.groupBy(group, "v").agg(F.count(F.lit(1)).alias("n"))
    g = scan(g, [group], [F.col("v")], {
        "k": ("sum", F.col("n")), "above": ("sum", F.col("n"), "back"), "next": ("lag", F.col("v"), "back")})
    g = attach(g.withColumn("m", F.col("k") + F.col("above") - F.col("n")).drop("above"), size, [])

    # integral of the control CDF at the group's values
    knot = F.struct(F.col("v").alias("at"), (F.col("upto") / F.col("nc")).alias("f"), F.col("area").alias("area"))
    here = _lookup(g, c.select(F.col("v").alias("_x"), knot.alias("_knot")), "v", "knot", True)
    area_at = lambda col: F.coalesce(F.col("knot.area") + F.col("knot.f") * (F.col(col) - F.col("knot.at")), F.lit(0.0))
    here = here.withColumn("area_v", area_at("v")).drop("knot")
    # the next value's integral is the next row's own one
    here = cut_lineage(scan(here, [group], [F.col("v")], {"area_next": ("lag", F.col("area_v"), "back")}))
    # where the control CDF first reaches the level k/m
    here = here.withColumn("level", F.expr(
        "cast((cast(k AS decimal(19, 0)) * cast(nc AS decimal(19, 0)) + m - 1) div m AS bigint)"))
    cross = c.select(F.col("upto").alias("_x"), F.struct(F.col("v").alias("at"), F.col("area").alias("area")).alias("_knot"))
    here = _lookup(here, cross, "level", "cross", False)

    level = F.col("k") / F.col("m")
    s = F.greatest(F.col("v"), F.least(F.col("next"), F.col("cross.at")))
    area_s = F.when(F.col("cross.at") <= F.col("v"), F.col("area_v")).when(
        F.col("cross.at") >= F.col("next"), F.col("area_next")).otherwise(F.col("cross.area"))
    inner = level * (s - F.col("v")) - (area_s - F.col("area_v")) + (F.col("area_next") - area_s) - level * (F.col("next") - s)
    head = F.when(F.col("k") == F.col("n"), F.col("area_v"))
    tail = F.when(F.col("next").isNull() & (F.col("vmax") > F.col("v")),
                  (F.col("vmax") - F.col("v")) - (F.col("area_max") - F.col("area_v")))
    here = attach(here, c.agg(F.max("area").alias("area_max")), [])
    zero = F.lit(0.0)
    total = F.coalesce(inner, zero) + F.coalesce(head, zero) + F.coalesce(tail, zero)
    return here.groupBy(group).agg(F.sum(total).alias("distance"))


def _lookup(df: DataFrame, knots: DataFrame, at: str, out: str, backward: bool) -> DataFrame:
    """The knot at or before (or at or after) each row's ``at``, by one ordered
    scan over the union of rows and knots."""
    rows = df.select(F.col(at).cast("double").alias("_x"), F.lit(1 if backward else 0).alias("_side"), F.struct(*df.columns).alias("_row"))
    marks = knots.select(F.col("_x").cast("double").alias("_x"), F.lit(0 if backward else 1).alias("_side"), "_knot")
    both = rows.unionByName(marks, allowMissingColumns=True)
    last = ("last", F.col("_knot")) if backward else ("last", F.col("_knot"), "back")
    found = scan(both, [], [F.col("_x"), F.col("_side")], {out: last}).filter(F.col("_row").isNotNull())
    return found.select(*[F.col("_row")[c].alias(c) for c in df.columns], out)


def pearson(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation, p-value, regression line; pairs with a null are dropped."""
    clean = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
    )
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(F.lit(1.0) - F.col("r") * F.col("r"), F.lit(0.0)))
    return g.withColumn("pval", student_t_two_sided(t, (F.col("n") - 2).cast("double")))


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with the share of rows at or below them."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    run = scan(c, keys, [F.col(value)], {"_u": ("sum", F.col("_n")), "_d": ("sum", F.col("_n"), "back")})
    return run.select(*keys, value, (F.col("_u") / (F.col("_u") + F.col("_d") - F.col("_n"))).alias("ecdf"))


def lower_envelope(df: DataFrame, group: str, value: str, low: float, high: float, points: int) -> DataFrame:
    """(x, envelope): the least of all groups' distribution curves, each
    interpolated between its steps, on an even grid. Left of a group's values
    its curve is 0, right of them 1."""
    steps = ecdf(df, [group], value).select(group, F.col(value).cast("double").alias("x"), F.col("ecdf").alias("y"))
    start = steps.groupBy(group).agg(F.min("x").alias("x")).withColumn("y", F.lit(0.0))
    # the curve rises from 0 at its first value
    grid = df.select(group).distinct().withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        group, (F.lit(low) + F.col("_g") * ((high - low) / (points - 1))).alias("x"), F.lit(None).cast("double").alias("y"))
    both = start.unionByName(steps).unionByName(grid).withColumn("_m", F.when(F.col("y").isNotNull(), F.struct("x", "y")))
    asked = F.col("y").isNull().cast("int")
    height = F.coalesce("y", F.lit(0.0))
    both = ordered.blocked(both, [F.col("x")], keys=[group])
    both = scan(both, [group], [F.col("x"), asked, height], {"_lo": ("last", F.col("_m"))})
    both = scan(both, [group], [F.col("x"), 1 - asked, height], {"_hi": ("last", F.col("_m"), "back")})
    share = (F.col("x") - F.col("_lo.x")) / F.nullif(F.col("_hi.x") - F.col("_lo.x"), F.lit(0.0))
    y = F.when(F.col("_lo").isNull(), 0.0).when(F.col("_hi").isNull(), 1.0).otherwise(
        F.col("_lo.y") + (F.col("_hi.y") - F.col("_lo.y")) * F.coalesce(share, F.lit(0.0)))
    return both.filter("y IS NULL").groupBy("x").agg(F.min(y).alias("envelope"))


def over_representation(
    hits: DataFrame, sets: DataFrame, universe: DataFrame, gene: str, term: str, library: Sequence[str] = ()
) -> DataFrame:
    """Overlap of a hit list with each gene set, its hypergeometric tail and BH."""
    library = list(library)
    space = universe.select(gene).distinct()
    members = sets.select(*library, term, gene).distinct().join(space, gene, "left_semi")
    marked = hits.select(gene).distinct().join(space, gene, "left_semi").withColumn("_hit", F.lit(1))
    totals = space.join(marked, gene, "left").agg(F.count(F.lit(1)).alias("universe"), F.count("_hit").alias("n_hits"))
    per = members.join(marked, gene, "left").groupBy(*library, term).agg(
        F.count(F.lit(1)).alias("n_set"), F.count("_hit").alias("overlap"))
    per = attach(per.filter(F.col("overlap") > 0), totals, [])
    per = per.withColumn("pval", hypergeometric_tail("overlap", "n_set", "n_hits", "universe"))
    return adjust_pvalues(per, "pval", library, bh="fdr_bh_adj_p")
