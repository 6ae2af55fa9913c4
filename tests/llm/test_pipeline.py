"""The stages on a small corpus with odd rows."""

import hashlib

import corpus_pipeline
from tessera.llm import queries
from tests.llm.test_dedup import fold
from tests.oracle import DATA


def test_all_queries_are_registered():
    assert set(queries.QUERIES) == {"pipeline"} | {k for k in queries.QUERIES if k.startswith("op")} and len(queries.QUERIES) == 14
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    more = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "srcx", 0), (None, "one two", "en", "srcx", 7), (9003, "one  two", "en", "srcx", 8)], docs.schema)
    rows = docs.unionByName(more)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    counts = [rows.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.saved(stage(spark, rows, f"{DATA}/sf0.001"), "test-stage")
        assert rows.columns == docs.columns
        counts.append(rows.count())
        if name == "exact_dedup":
            texts = [fold(r["text"]) for r in rows.collect()]
            assert len(texts) == len(set(texts))
    assert counts[0] >= counts[1] > counts[2] >= counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, rows, f"{DATA}/sf0.001").collect()
    want = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows.collect())
    assert sorted(r["decoded_sha256"] for r in last) == want


def test_run(spark):
    out = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
