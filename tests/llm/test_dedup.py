"""Exact and near deduplication against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, simhash_mih
from tessera.llm.common import shared_folder
from tests.oracle import DATA, compare, connect

ODD = [
    (1, "a b", "x", 1), (2, "a  b", "y", 2), (None, "a\tb", "z", 3), (2, "a  b", "y", 2), (3, None, None, 4), (4, "", "q", 5), (4, "c", "q", 6),
    (9, "c" * 300_000, "q", 7), (8, "c" * 300_000, "q", 8), (10, "A b", "q", 9), (11, "a b", "q", 9),
]
SCHEMA = "doc_id long, text string, digest string, kept int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def fold(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def want_groups(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(fold(text), []).append(doc_id)
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1)), lambda c: F.unhex(F.lit("00"))])
def test_exact_groups_even_if_digests_collide(spark, odd, digest):
    rows = exact_dedup.deduplicate(odd, digest=digest).collect()
    groups = want_groups(ODD)
    assert len(rows) == len(ODD)
    want = sorted((str(i), str(min(x for x in g if x is not None)), len(g)) for g in groups.values() for i in g)
    assert sorted((str(r["id"]), str(r["keep_id"]), r["group_size"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(groups)


def test_exact_stage_keeps_columns(spark, odd):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"], fold(r["text"])) for r in kept.collect()) == sorted((min(x for x in g if x is not None), t) for t, g in want_groups(ODD).items())


def test_exact_of_nothing(spark, odd):
    assert exact_dedup.deduplicate(odd.limit(0)).count() == 0
    assert exact_dedup.keep_first(odd.limit(0)).count() == 0


def test_state_remembers_earlier_batches(spark):
    state = exact_dedup.DedupState(spark, shared_folder(spark, "test-state"))
    for part in ([(5, "x y"), (6, "z")], [(4, "x  y")], [(7, "x\ny"), (1, "z")]):
        state.absorb(exact_dedup.key_rows(spark.createDataFrame(part, "doc_id long, text string")))
    assert sorted((r["keep_id"], r["group_size"]) for r in state.groups().collect()) == [(1, 2), (4, 3)]


def test_no_hit_is_lost_by_the_bitmap(spark):
    texts = spark.range(3000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    hits = texts.filter("id % 7 = 0").select("digest")
    passed = {r["id"] for r in exact_dedup._maybe_hit(texts, hits).select("id").collect()}
    assert set(range(0, 3000, 7)) <= passed and len(passed) < 500


def test_exact_query_agrees_with_sql(spark):
    folder = f"{DATA}/sf0.001"
    assert compare(spark, connect(folder), folder, "op1", exact_dedup.query, exact_dedup.SQL) == ""


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        least.setdefault(find(i), []).append(ids[i])
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_fingerprints_and_components(spark, odd):
    rows = simhash_mih.groups(odd).collect()
    fps = [slow_fingerprint(t) for _, t, *_ in ODD]
    want = sorted(zip(map(str, (r[0] for r in ODD)), fps, slow_components(fps, [r[0] for r in ODD])))
    assert sorted((str(r["id"]), r["fp"] % 2**64, r["component_id"]) for r in rows) == want


@pytest.mark.parametrize("bucket", [1, 4, 64])
def test_crowded_buckets_lose_no_link(spark, bucket):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12)
    fps = set()
    for c in centres:
        for _ in range(40):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {int(centres[0]) ^ (1 << 63), int(centres[1]) ^ 3}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash_mih.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges.collect():
        a, b = find(e["src"] % 2**64), find(e["dst"] % 2**64)
        parent[max(a, b)] = min(a, b)
    assert [find(x) for x in fps] == slow_components(fps, fps)


def test_near_stage(spark, odd):
    kept = simhash_mih.keep_one(odd)
    assert kept.columns == odd.columns
    fps = [slow_fingerprint(t) for _, t, *_ in ODD]
    assert kept.count() == len(set(slow_components(fps, list(range(len(ODD))))))
    assert simhash_mih.keep_one(odd.limit(0)).count() == 0 and simhash_mih.groups(odd.limit(0)).count() == 0


def test_digest_of_normalised_text(spark):
    got = exact_dedup.query(spark, f"{DATA}/sf0.001").first()
    text = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").filter(F.col("doc_id") == got["doc_id"]).first()["text"]
    assert got["text_sha256"] == hashlib.sha256(fold(text).encode()).hexdigest()
