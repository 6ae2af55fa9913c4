"""Near copies by five-word shingles against all pairs."""

import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import shingle_join


def slow_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_groups(texts, least=0.8):
    sets, parent = [slow_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 10 * least * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    out = [None, "", "One two", "one  TWO", "one two three", "a b c d e", "a b c d e f"]
    for _ in range(40):  # copies with ever more edits, and chains of them
        base = [word() for _ in range(rng.randint(20, 200))]
        out.append(" ".join(base))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
            base = rng.choice([base, copy])
    for n in (6, 14, 60):  # a common passage in texts that are, or are not, alike
        out += [" ".join(passage + [word() for _ in range(n)]) for _ in range(30)]
    return out


@pytest.mark.parametrize("partners, often", [(1, 10**9), (3, 3), (256, 4)])
def test_groups_equal_all_pairs(spark, texts, partners, often, monkeypatch):
    monkeypatch.setattr(shingle_join, "OFTEN", often)  # the order has no influence
    monkeypatch.setattr(shingle_join, "PARTNERS", partners)
    rows = shingle_join.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = slow_groups(texts)
    assert len(set(want)) < len(want) - 60
    assert {r["id"]: r["component_id"] for r in rows} == dict(enumerate(want))


def test_stage_drops_copies_of_similarity_08(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.near(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(slow_groups(texts)))
    assert corpus_pipeline.near(spark, docs.limit(0), "").count() == 0


def test_copies_very_long_texts_and_further_columns(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    texts = ["a b c d e f g"] * 500 + [long, long.replace(" w4 ", " x ", 1), long[:400_000], None, "", None]
    rows = [(i, t, 1, 2, "x", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s int, pos int, h string, doc int")
    found = {r["id"]: r["component_id"] for r in shingle_join.groups(df).collect()}
    assert found == {i: 0 for i in range(500)} | {500: 500, 501: 500, 502: 502, 503: 503, 504: 503, 505: 503}


def test_links_of_fingerprints_and_of_sets_make_one_component(spark, monkeypatch):
    """a and b are linked by their fingerprints only, b and c by their sets only."""
    from tessera.llm import simhash_mih

    words = [f"w{n}" for n in range(400)]
    a, b, c = " ".join(words), " ".join(f"x{n}" for n in range(200)), " ".join(f"x{n}" for n in range(190))
    marks = {a: 0b1, b: 0b10, c: 1 << 40 | 1 << 41 | 1 << 42, "alone": -1}
    monkeypatch.setattr(simhash_mih, "fingerprints", lambda docs, text, doc_id, shingle: docs.select(
        F.col(doc_id).alias("id"), F.create_map(*[F.lit(x) for kv in marks.items() for x in kv])[F.col(text)].alias("fp")))
    rows = [(1, a), (2, b), (3, c), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in shingle_join.keep_one(docs).collect()) == [0, 1]
    monkeypatch.undo()
    assert sorted((r["doc_id"] or 0) for r in shingle_join.keep_one(docs).collect()) == [0, 1, 2]


def test_a_pair_meets_once(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(shingle_join, "saved", lambda df, name, plain=shingle_join.saved: kept.setdefault(name, plain(df, name)))
    common = " ".join(f"w{n}" for n in range(300))
    rows = [(k, common + "".join(f" x{k}y{n}" for n in range(150))) for k in range(2)]
    got = shingle_join.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["id"], r["component_id"]) for r in got.collect()} == {(0, 0), (1, 1)}
    assert kept["shingle-places"].count() > 2 and kept["shingle-mixed"].count() == 0  # the least document has met the other
