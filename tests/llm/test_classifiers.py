"""Toxicity and quality: exact parts against brute force, whole models on held-out rows."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_crf, toxicity_knn
from tests.oracle import DATA


def auc(rows):
    good = [s for s, y in rows if y == 1]
    bad = [s for s, y in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_block_max_search_is_exact():
    rng = random.Random(2)
    vectors = []
    for _ in range(400):
        v = {rng.randrange(30): rng.choice([0.5, 1.0, rng.random()]) for _ in range(rng.randint(0, 5))}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors.append({t: x / norm for t, x in v.items()})
    ids = rng.sample(range(10_000), 400)
    index = toxicity_knn.BlockMaxIndex(ids, vectors, [i % 2 for i in ids], block=8)
    by_id = dict(zip(ids, vectors))
    for q in vectors[:80]:
        want = sorted((-round(sum(w * by_id[i].get(t, 0) for t, w in sorted(q.items())), 12), i) for i in ids)
        want = [(-s, i) for s, i in want if s < 0][:7]
        got = [(s, index.ids[at]) for s, at in index.search(q, 7)]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


def test_steps_rise():
    ends, levels = toxicity_knn._monotone([(0.1, 0), (0.2, 1), (0.3, 0), (0.3, 1), (0.9, 1)])
    assert levels == sorted(levels) and ends == sorted(ends) and levels[-1] == 1


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        toxic, junk = i % 9 == 0, i % 7 == 0
        words = [rng.choice("alpha beta gamma delta omega sigma".split()) for _ in range(rng.randint(3, 60))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Nastyword,", "vilething"])
        lines = [" ".join(words[a:a + 8]) for a in range(0, len(words), 8)]
        if junk:
            lines = ["$$$ ".join(x.split()) + " ###" for x in lines]
        rows.append((i, "\n".join(lines), "s", 0.5, i))
        if i % 2 == 0 or toxic:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(700, None, "s", 0.1, 1), (701, "", None, 0.2, 2), (None, "vilething", "s", 0.3, 3), (3, rows[3][1], "s", 0.5, 4), (702, "nastyword " * 50_000, "s", 0.4, 5)]
    labels += [(0, 1, None), (2, None, 0), (None, 1, 1), (4, 1, 0), (4, 1, 0)]
    schema = "doc_id long, text string, source string, score double, label int"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_found(spark, corpus):
    docs, labels = corpus
    model, table = toxicity_knn.fit(docs.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r["r"] for r in table.withColumn("r", toxicity_knn.score(model, F.col("terms"), spark)).collect()}
    assert all((got[i]["score"] >= 0.5) == (i % 9 == 0) for i in range(600))
    assert got[None]["score"] >= 0.5 and got[702]["score"] >= 0.5 and got[700]["score"] == got[701]["score"] < 0.1
    assert all(e["label"] == 1 for e in got[702]["evidence"])


def test_toxicity_stage(spark, corpus):
    docs, labels = corpus
    kept = toxicity_knn.clean(docs, labels)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted([i for i in range(600) if i % 9] + [3, 700, 701])
    assert toxicity_knn.clean(docs.limit(0), labels).count() == 0
    assert toxicity_knn.clean(docs, labels.limit(0)).count() == docs.count()


@pytest.mark.parametrize("module,label,fold,left_out", [(toxicity_knn, "toxic", 5, 0), (line_crf, "quality", 4, 2)])
def test_held_out_rows(spark, module, label, fold, left_out):
    folder = f"{DATA}/sf0.1" if label == "toxic" else f"{DATA}/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = module.query(spark, folder)
    assert out.select(F.min("score") >= 0, F.max("score") <= 1).first() == (True, True)
    rows = out.filter("held_out").join(labels, "doc_id").select("score", label, "predicted").collect()
    import zlib
    ids = {r["doc_id"]: r["held_out"] for r in out.select("doc_id", "held_out").limit(200).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % fold == left_out) for i, h in ids.items())
    assert auc([(r["score"], r[label]) for r in rows]) > 0.93
    assert sum(r["predicted"] == r[label] for r in rows) / len(rows) > 0.93


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 4, 2, 5])
    u, links = rng.normal(size=sizes.sum()) * 2, rng.normal(size=(2, 2))
    p, z, pairs = line_crf.marginals(u, sizes, links)
    at = 0
    for d, n in enumerate(sizes):
        own, total, good, trans = u[at:at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = math.exp(sum(own[t] * y[t] for t in range(n)) + sum(links[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                trans[a, b] += w
        assert np.allclose(p[at:at + n], good / total) and np.isclose(z[d], math.log(total)) and np.allclose(pairs[d], trans / total)
        at += n


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    sizes, labels = np.array([3, 1, 4]), np.array([1, 0, 0])
    x = rng.random((8, line_crf.WIDTH)).astype(np.float32)
    theta = rng.normal(size=3 * line_crf.WIDTH + 4) * 0.1
    _, grad = line_crf.loss(x, sizes, labels, theta)
    for n in [0, 7, line_crf.WIDTH + 3, 2 * line_crf.WIDTH + 5, *range(3 * line_crf.WIDTH, 3 * line_crf.WIDTH + 4)]:
        step = np.zeros_like(theta)
        step[n] = 1e-3
        slope = (line_crf.loss(x, sizes, labels, theta + step)[0] - line_crf.loss(x, sizes, labels, theta - step)[0]) / 2e-3
        assert abs(slope - grad[n]) < 2e-3


def test_features_of_slices_add_up(monkeypatch):
    text = "Ab 1,2\n\nÄé ### x x x\n" * 40 + "z" * 500
    whole, lengths = line_crf.line_features(text)
    monkeypatch.setattr(line_crf, "_SLICE", 7)
    cut, cut_lengths = line_crf.line_features(text)
    assert np.array_equal(whole, cut) and np.array_equal(lengths, cut_lengths) and lengths.tolist() == [len(x) for x in text.split("\n")]


def test_quality_of_odd_rows(spark, corpus):
    docs, labels = corpus
    theta = line_crf.fit(docs.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r["q"] for r in docs.withColumn("q", line_crf.score(theta)).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 7 != 0) for i in range(600)]) > 0.98
    assert got[700] == got[701] and 0 <= got[700] <= 1
    assert line_crf.fit(docs.select("doc_id", "text"), labels.limit(0)) == 0.5
    assert line_crf.fit(docs.limit(0).select("doc_id", "text"), labels) == 0.5
    assert docs.limit(0).withColumn("q", line_crf.score(theta)).count() == 0


def test_many_line_breaks_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    theta = rng.normal(0, 0.3, 3 * line_crf.WIDTH + 4)
    text = "\n" * (1 << 18) + "some words.\n" * 5
    tracemalloc.start()
    lines = sum(len(x) for x, _ in line_crf.line_windows(text))  # all features at once would take 160 MB
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lines == (1 << 18) + 6 and peak < 30 << 20
    # windows do not change what a text scores
    short = "\n".join(["One line here.", "", "!!!", "One line here."] * 3000)
    whole, length = line_crf.line_features(short)
    assert len(whole) == 12_000 and whole[4000:, 13].max() == 1
    p, _, _ = line_crf.marginals(line_crf.unary(whole, np.array([12_000]), theta[:-4].reshape(3, -1)), np.array([12_000]), theta[-4:].reshape(2, 2))
    assert abs(line_crf.quality(theta, [short])[0] - (p * (length + 1)).sum() / (length + 1).sum()) < 1e-5


def test_calibration_keeps_equal_votes_together():
    # most clean examples vote 0, a few vote 1 like all toxic ones
    votes = [(0.0, 0)] * 100 + [(1.0, 0)] * 3 + [(1.0, 1)] * 20
    ends, levels = toxicity_knn._monotone(votes)
    assert ends == [0.0, 1.0] and levels == [0.0, 20 / 23]
    rng = random.Random(9)
    votes = [(v, int(rng.random() < v)) for v in (round(rng.random(), 1) for _ in range(2000))]
    ends, levels = toxicity_knn._monotone(votes)
    assert levels == sorted(levels) and ends == sorted(ends) and len(ends) > 5
    total = {}
    for v, y in votes:
        at = next(n for n, e in enumerate(ends) if v <= e)
        total.setdefault(at, []).append(y)
    assert all(abs(sum(ys) / len(ys) - levels[at]) < 1e-12 for at, ys in total.items())
