"""Personal data and WARC archives."""

import base64
import gzip
import hashlib
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii_bootstrap, warc_index
from tessera.llm.common import shared_folder
from tests.oracle import DATA


def slow_spans(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if n % 2 == 0 else x * 2 - 9 * (x > 4) for n, x in enumerate(reversed(d))) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(a, pii_bootstrap.KINDS[k], b) for a, k, b in sorted(found)]


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(0)
    for _ in range(40_000):
        t = "".join(rng.choice("ab@.@1 23-+() .0é5") for _ in range(rng.randint(0, 34)))
        assert pii_bootstrap.base_spans(t) == slow_spans(t), t


def test_base_spans_take_linear_time():
    began = time.time()
    for part in ("a", "1", "a.", "1.", "+1(", "a@", "@a", "0" * 50 + ".", "1-"):
        pii_bootstrap.base_spans(part * (400_000 // len(part)))
    assert time.time() - began < 20


def test_query_equals_the_plain_rules(spark):
    folder = f"{DATA}/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in pii_bootstrap.query(spark, folder).collect():
        want = slow_spans(texts[r["doc_id"]])
        names = [f"{k}:{a}:{b}" for a, k, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest() and set(names) <= set(filter(None, r["spans"].split(",")))
        assert [r[f"n_{k}"] for k in pii_bootstrap.KINDS] == [sum(w[1] == k for w in want) for k in pii_bootstrap.KINDS]


def test_context_discovers_unseen_identifiers(spark):
    rows = [(i, f"Some text {i} please Write me: user{i}@mail.example.com or wait", "x") for i in range(100, 130)]
    rows += [(20, "please write me: hidden9(at)example soon", "x"), (21, "and please write me: hidden9(at)example soon", "x")]
    rows += [(30 + i, f"the old gate {1000 + i}.20 was shut at the old gate again", "x") for i in range(9)]  # no context of seeds
    rows += [(50, None, "x"), (51, "", "x"), (None, "please write me: other77(at)example soon", "x"), (20, rows[30][1], "x")]
    got = pii_bootstrap.detect(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    added = sorted((str(r["id"]), r["spans"]) for r in got if r["n_added"])
    assert added == sorted([("20", "email:17:35"), ("20", "email:17:35"), ("21", "email:21:39"), ("None", "email:17:35")])
    assert all(r["spans"] == "" for r in got if r["id"] and 30 <= r["id"] < 100)


def test_loose_contexts_add_nothing(spark):
    rows = [(i, f"well of the user{i}@mail.example.com and of the day{i}23 and of the plain words") for i in range(12)]
    got = pii_bootstrap.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.agg(F.sum("n_added")).first()[0] == 0
    assert pii_bootstrap.detect(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def found(spark, texts):
    got = pii_bootstrap.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("n_added > 0").collect()
    return {r["id"]: [s for s in r["spans"].split(",") if s] for r in got}


def test_scores_settle(spark):
    texts = [f"thing{i}x was here so write to user{i}@mail.example.com" for i in range(10)] + [f"and so write to hidden{i}(at)example" for i in range(5)]
    assert set(found(spark, texts)) == set(range(10, 15))  # trust 0.881 after three rounds, 10 / 11 in the end


def test_new_instances_induce_patterns(spark):
    texts = [f"well you may write to user{i}@mail.example.com" for i in range(30)]
    texts += [f"well you may write to secret{i}(at)example" for i in range(2)] + ["then you may write to secret2(at)example"]
    texts += [f"contact desk holds secret{i % 3}(at)example" for i in range(30)] + ["contact desk holds other7(at)example"]
    assert set(found(spark, texts)) == set(range(30, 64))


def test_slots_span_numbers_written_with_spaces(spark):
    texts = [f"please call me at +49 30 {1000000 + i} today friend" for i in range(20)] + ["please call me at 030 55 12 7 today friend"]
    assert found(spark, texts) == {20: ["phone:18:29"]}


PAGES = [
    (1, "http://a\nb", "x", 0), (2, None, "x", 0), (2, "u", "x", 0), (None, "q", "x", 0), (5, "e", None, 0), (6, "e", "", 0), (7, "z", "ü\r\n\r\nWARC/1.1\r\n" * 9000, 0),
    (None, None, None, 0),
]


@pytest.mark.parametrize("least", [0, 1])
def test_archives_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, offset int")
    index = warc_index.write(pages, shared_folder(spark, "test-warc"), least_bytes=least, file_bytes=2000)
    rows = warc_index.read(index).collect()
    assert len(rows) == len(PAGES)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for i, u, t, _ in PAGES:
        last = max((p for p, _, h, _ in PAGES if (h or "") == (t or "") and p is not None), default=None)
        want.append((str(i), len((t or "").encode()), digest(t), last))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in rows) == sorted(w[:3] for w in want)
    for t in {p[2] or "" for p in PAGES}:
        group = [r for r in rows if r["payload_digest"] == digest(t)]
        responses = [r for r in group if r["record_type"] == "response"]
        if len(t.encode()) >= least:
            assert len(responses) == 1 and all(r["refers_to"] == responses[0]["page_id"] for r in group if r["record_type"] == "revisit")
        else:
            assert len(responses) == len(group)
        assert all(r["html"] == t and r["refers_to"] is None for r in responses)


def test_index_gives_byte_ranges(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * i) for i in range(40)], "page_id long, url string, html string")
    index = warc_index.write(pages, shared_folder(spark, "test-warc")).collect()
    for r in index[::7]:
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            got = warc_index.parse(gzip.decompress(f.read(r["length"])))
        assert got["payload"].decode() == f"page {r['page_id']} " * r["page_id"] and got["headers"]["WARC-Target-URI"] == r["url"]
    for file in {r["file"] for r in index}:
        own = sorted((r["offset"], r["length"]) for r in index if r["file"] == file)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) == os.path.getsize(file)


def test_selected_records_only(spark):
    pages = spark.createDataFrame([(i, None, f"{i}") for i in range(30)], "page_id long, url string, html string")
    index = warc_index.write(pages, shared_folder(spark, "test-warc"))
    some = warc_index.read(index.filter("page_id % 10 = 3"), gap_bytes=0)
    assert sorted((r["page_id"], r["html"]) for r in some.collect()) == [(3, "3"), (13, "13"), (23, "23")]
    assert warc_index.read(index.limit(0)).count() == 0
    assert warc_index.write(pages.limit(0), shared_folder(spark, "test-warc")).count() == 0
