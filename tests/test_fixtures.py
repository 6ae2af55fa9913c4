"""Small inputs with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import bases as B, paths, plates, sequences as Q
from tessera.functions.special import student_t_two_sided
from tessera.operators import cells, design, reads, statistics as S, tabular as T, tracking


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"x{n}") for n, c in enumerate(cols)]).first()


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_quality_and_phred(spark):
    got = one(spark, *[B.quality(arr(*v)) for v in ([10, 200, 30, 5], [100, 100, 0, 0], [0, 0, 0, 0], [-50, 3, 2, 1], [-50, -60, -70, -1])])
    assert np.allclose(list(got), [0.694212, 0, 0, 0.277294, 0], atol=1e-6)
    assert list(one(spark, *[B.phred(F.lit(q)) for q in (0.0, 0.34, 0.85, 1.0)])) == ["!", ",", ";", "?"]


def test_base_call_takes_first_maximum(spark):
    assert one(spark, B.call_barcode(F.array(arr(5, 9, 1, 0), arr(3, 3, 0, 0)), "ACGT"))[0] == "CA"


def test_crosstalk_fit(spark):
    x = [[100, 10, 5, 5], [90, 12, 4, 6], [10, 80, 6, 4], [12, 100, 8, 6], [4, 5, 60, 6], [6, 5, 70, 8], [3, 4, 5, 50], [5, 6, 5, 70]]
    df = spark.createDataFrame([("A1", 0, n, [list(map(float, v))]) for n, v in enumerate(x)], "well string, site int, read int, signal array<array<double>>")
    fit = reads.fit_crosstalk(df, 4)
    w = np.array(fit.first()["unmix"])
    want = [[1.2450, -.1425, -.0778, -.0646], [-.1397, 1.2838, -.0782, -.0912], [-.0449, -.0889, 1.2822, -.0965], [-.0605, -.0524, -.1262, 1.2522]]
    assert np.allclose(w, want, atol=1e-4)
    y = reads.correct_crosstalk(df, fit).orderBy("read").collect()
    assert [r["signal"][0] for r in y] == [[122, -1, 0, 0], [109, 1, 0, 0], [0, 100, 0, 0], [0, 125, 0, 0], [0, 0, 75, 0], [0, 0, 88, 0], [0, 0, 1, 61], [0, 0, -1, 86]]


def test_crosstalk_without_a_class_keeps_the_signal(spark):
    df = spark.createDataFrame([("A1", 0, 0, [[9.0, 1.0]]), ("A1", 0, 1, [[8.0, 2.0]])], "well string, site int, read int, signal array<array<double>>")
    row = reads.correct_crosstalk(df, reads.fit_crosstalk(df, 2)).filter("read = 0").first()
    assert row["signal"] == [[9.0, 1.0]] and not row["corrected"]


def test_incomplete_reads_raise(spark):
    b = spark.createDataFrame([("A1", 0, 0, 1, 0, 0, 1, "A", 5), ("A1", 0, 0, 1, 0, 0, 1, "C", 5)],
                              "well string, site int, read int, cell int, i int, j int, cycle int, channel string, intensity int")
    with pytest.raises(Exception, match="every channel"):
        reads.pack_bases(b, "ACGT", 1).collect()


def test_top_two(spark):
    rows = [("A1", 0, n, c, b) for n, (c, b) in enumerate([(1, "AAA"), (1, "AAA"), (1, "CCC"), (2, "GGG")])]
    df = spark.createDataFrame(rows + rows[:1], "well string, site int, read int, cell int, barcode string")
    got = {r["cell"]: (r["cell_barcode_0"], r["cell_barcode_count_0"], r["cell_barcode_1"], r["cell_barcode_count_1"], r["barcode_count"]) for r in cells.top_barcodes(df).collect()}
    assert got == {1: ("AAA", 2, "CCC", 1, 3), 2: ("GGG", 1, None, None, 1)}


def test_plates(spark):
    def at(well, tile, spacing, mag, shape):
        return tuple(one(spark, *plates.plate_coordinate(F.lit(well), F.lit(tile), spacing, mag, shape)))

    assert at("A1", 0, "6w", "10X", (3, 3)) == (-1280, -1280)
    assert at("B2", 5, "6w", "10X", (3, 3)) == (39120, 40400)
    assert at("A1", 107, "96w", "20X", (15, 15)) == (0, -3200)
    assert [r[0] for r in spark.range(9).select(plates.remap_snake(F.col("id"), (3, 3))).collect()] == list("012543678")


def test_adjustments(spark):
    df = spark.createDataFrame([(.01,), (.04,), (.03,), (.5,)], "p double")
    got = {r["p"]: (r["bh"], r["hs"]) for r in S.adjust_pvalues(df, "p", bh="bh", holm_sidak="hs").collect()}
    assert np.allclose(got[.01], (.04, .03940399)) and np.allclose(got[.5], (.5, .5))
    assert np.allclose(got[.04], (.0533333, .087327), atol=1e-6) and np.allclose(got[.03], (.0533333, .087327), atol=1e-6)


def test_fisher_and_wasserstein(spark):
    p = spark.createDataFrame([("g", .04), ("g", .2), ("z", 0.0)], "g string, p double")
    got = {r["g"]: r for r in S.fisher_combine(p, "g", "p").collect()}
    assert abs(got["g"]["fisher_combined_chi"] - 9.656627) < 1e-5 and abs(got["g"]["pval"] - .0466265) < 1e-6
    assert math.isinf(got["z"]["fisher_combined_chi"]) and got["z"]["pval"] == 0
    v = spark.createDataFrame([("a", x) for x in (0., 1., 3.)] + [("c", x) for x in (5., 6., 8.)], "g string, v double")
    d = {r["g"]: r["distance"] for r in S.wasserstein_to_control(v, "g", "v", F.col("g") == "c").collect()}
    assert abs(d["a"] - 5) < 1e-12 and d["c"] == 0


def test_wasserstein_against_sorted_values(spark):
    rng = np.random.default_rng(3)
    data = {g: rng.integers(0, 40, n).astype(float) for g, n in (("c", 31), ("a", 17), ("b", 50), ("d", 1))}
    df = spark.createDataFrame([(g, float(x)) for g, v in data.items() for x in v], "g string, v double")
    got = {r["g"]: r["distance"] for r in S.wasserstein_to_control(df, "g", "v", F.col("g") == "c").collect()}
    for g, v in data.items():
        at = np.unique(np.concatenate([v, data["c"]]))
        f = lambda s: np.searchsorted(np.sort(s), at[:-1], "right") / len(s)
        assert abs(got[g] - (np.abs(f(v) - f(data["c"])) * np.diff(at)).sum()) < 1e-9


def test_t_tail(spark):
    # table values of the two-sided 5 % and 1 % points
    got = one(spark, *[student_t_two_sided(F.lit(t), F.lit(float(n))) for t, n in ((12.7062, 1), (2.2281, 10), (2.7500, 30), (1.9600, 1e7), (0.0, 5))])
    assert np.allclose(list(got), [.05, .05, .01, .05, 1.0], atol=2e-5)


def test_histogram_wrap(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (-1, 0, 5, 9, 10, 25)], "g string, v double")
    get = lambda **k: [r[2] for r in T.histogram(df, ["g"], "v", [0, 5, 10], **k).orderBy("bin").collect()]
    assert get() == [1, 2, 2] and get(wrap=True) == [1, 2, 3] and get(cumulative=True) == [1, 3, 5]
    assert get(cumulative=True, normalize=True)[-1] == 1.0


def test_delta_auc_counts_outside_values(spark):
    df = spark.createDataFrame([("a", x) for x in (0., .1, .5, 1., 2., -3.)] + [("n", x) for x in (.1, .6)], "g string, v double")
    got = {r["g"]: r["v"] for r in S.delta_auc(df, ["g"], "v", F.col("g") == "n", 0, 1, 4).collect()}
    ctrl, a = np.array([.5, .5, 1, 1]), np.cumsum([2, 0, 1, 1]) / 6
    assert abs(got["a"] - np.trapezoid(ctrl - a) / 4) < 1e-12 and abs(got["n"]) < 1e-12


def test_sequences_and_design(spark):
    assert list(one(spark, Q.reverse_complement(F.lit("AACGT")), Q.reverse_complement(F.lit("aUn")))) == ["ACGTT", "nAt"]
    with pytest.raises(Exception, match="not a DNA"):
        one(spark, Q.reverse_complement(F.lit("AXC")))
    df = spark.createDataFrame([("AAAAACGT",), ("CGTCTCAA",), ("ACGTACGT",)], "sgRNA string")
    assert [r[0] for r in design.filter_guides(df).collect()] == ["ACGTACGT"]
    with pytest.raises(ValueError, match="multiple prefix"):
        design.validate_design(spark.createDataFrame([("x", 3, 1), ("x", 4, 1)], "group string, prefix_length int, edit_distance int"))
    guides = spark.createDataFrame([(1, "ACGT")], "gene_id int, sgRNA string")
    with pytest.raises(ValueError, match="missing"):
        design.validate_genes(spark.createDataFrame([("p", 2)], "subpool string, gene_id int"), guides)
    with pytest.raises(ValueError, match="duplicate"):
        design.validate_genes(spark.createDataFrame([("p", 1), ("p", 1)], "subpool string, gene_id int"), guides)
    with pytest.raises(NotImplementedError):
        design.select_guides(guides, 3, 2)


def test_oligos_round_trip(spark):
    primers = spark.createDataFrame([(0, "ACGTTGCA", "GGATTACC"), (1, "TTGGCCAA", "CATGCATT")], "dialout int, fwd string, rev string")
    guides = spark.createDataFrame([("ACCTGATTGC", 1), ("GGTTAACCTA", 0)], "sgRNA string, dialout int")
    parsed = design.parse_oligos(design.build_oligos(guides, primers), primers)
    assert design.validate_oligos(parsed).count() == 2
    with pytest.raises(ValueError):
        design.validate_oligos(parsed.withColumn("dialout", F.lit(7)))


def test_file_names(spark):
    name = "example_data/input/10X_c1-SBS-1/10X_c1-SBS-1_A1_Tile-107.max.tif"
    got = one(spark, paths.parse_filename(F.lit(name)))[0].asDict()
    assert {k: v for k, v in got.items() if v is not None} == {
        "subdir": "example_data/input/10X_c1-SBS-1", "mag": "10X", "cycle": "c1-SBS-1", "well": "A1", "tile": "107", "tag": "max", "ext": "tif", "file": name}
    with pytest.raises(Exception, match="failed to parse"):
        one(spark, paths.parse_filename(F.lit("nothing here")))
    built = one(spark, paths.name_file(subdir="example_data/input/10X_c1-SBS-1", mag="10X", cycle="c1-SBS-1", well="A1", tile="107", site="3", tag="max", ext="tif"))[0]
    assert built == name


def test_gate_expressions(spark):
    df = spark.range(10).select(F.col("id").alias("i"), (F.col("id") * 2).alias("j"))
    assert T.gate(df, "2 < i < 6 & j >= @low", low=8).count() == 2
    assert T.gate(df, "i == @keep", keep=[1, 4]).count() == 2


def test_timestamps_and_baseline(spark):
    df = spark.range(729).select((F.floor(F.col("id") / 728)).alias("frame"), F.lit("w").alias("well"), (F.col("id") % 728).alias("site"))
    got = {(r["frame"], r["site"]): r["timestamp"] for r in tracking.add_timestamps(df).collect()}
    assert np.allclose([got[0, 0], got[0, 1], got[0, 727], got[1, 0]], [.05, .0505494505, .4494505495, .45])
    t = np.linspace(2, 9, 12)
    y = .3 + .01 * t - .002 * t ** 2 + .1 * np.sin(t)
    course = spark.createDataFrame([("n", float(a), float(b)) for a, b in zip(t, y)] + [("g", float(t[3]), .9)], "gene string, timestamp double, c double")
    rows = tracking.add_baseline(course, "c", F.col("gene") == "n").filter("gene = 'n'").orderBy("timestamp").collect()
    assert np.allclose([r["splined"] for r in rows], np.polyval(np.polyfit(t, y, 3), t))
