"""Toxicity from the nearest labelled examples.

Terms are lower-case words, their beginnings of four to seven letters, and
"at least n times" for each of these. Those that go with the label (chi-squared, counted by Spark over the examples)
form the vocabulary; document frequencies of these terms are counted over all
documents. A document is its TF-IDF vector, and its neighbours are the labelled
examples of highest cosine, found exactly with a block-max inverted index: each
block of examples has, per term, its greatest weight; blocks are visited by
falling bound until none can still enter the top k. Votes weighted by
similarity are calibrated on the examples themselves, each left out in turn.

Bounds, all parameters: ``EXAMPLES`` labelled rows (chosen by a hash of their
identifier) and ``VOCABULARY`` terms. So the index that is broadcast is bounded
too, whatever the corpus. Everything else covers all documents.

Defined cases: a null text counts as empty; documents without a vocabulary
term (empty ones too) score the rate of such examples; without any labels every
score is 0; equal similarities go to the smaller identifier; several labels of
one document count as toxic if one is; repeated rows are scored alike.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.llm.common import crc_mod, documents, labelled, saved, text_batches, whole, worker_cache

EXAMPLES = 20_000
VOCABULARY = 4_096
NEIGHBOURS = 16
CHI_SQUARED = 36.0
THRESHOLD = 0.5
_BLOCK = 64
_BEGINNINGS = (4, 5, 6, 7)
_AT_LEAST = (2, 3)
_LETTERS = re.compile(r"[^\W\d_]+")
_REMEMBERED = 500_000


def word_terms(word: str) -> set[str]:
    return {word, *(f"^{word[:n]}" for n in _BEGINNINGS)}


def repeats(term: str, count: int) -> list[str]:
    """The terms that say how often ``term`` occurs at least."""
    return [f"{term}#{n}" for n in _AT_LEAST if count >= n]


class Scanner(dict):
    """Maps a word to the numbers of its vocabulary terms; bounded memory."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary
        # a term counts if it, or one of its repeats, is in the vocabulary
        self.known = {t: n for n, t in enumerate(sorted({t.split("#")[0] for t in vocabulary}))}
        self.more = {}
        for t, n in self.known.items():
            self.more[n] = [(k, v) for k, u in ((1, t), *((k, f"{t}#{k}") for k in _AT_LEAST)) if (v := vocabulary.get(u)) is not None]

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = tuple(sorted(self.known[t] for t in word_terms(word) if t in self.known))
        return found

    def terms(self, text: str) -> list[int]:
        """Vocabulary numbers, plain terms as often as they occur, "at least" terms once."""
        counts = Counter(t for found in map(self.__getitem__, _LETTERS.findall(text.lower())) if found for t in found)
        return [v for t, n in counts.items() for least, v in self.more[t] if n >= least for _ in range(n if least == 1 else 1)]


class BlockMaxIndex:
    """Exact top-k by cosine over bounded examples. Examples with like weighty
    terms stand next to each other, which keeps the bounds of blocks tight."""

    def __init__(self, ids: list[int], vectors: list[dict[int, float]], labels: list[int], block: int = _BLOCK):
        def weighty(n: int):
            return [t for t, _ in sorted(vectors[n].items(), key=lambda e: (-e[1], e[0]))[:4]], ids[n]

        order = sorted(range(len(ids)), key=weighty)
        self.ids, self.labels, self.block = np.array([ids[n] for n in order], np.int64), [labels[n] for n in order], block
        self.blocks = -(-len(order) // block)
        lists: dict[int, list[tuple[int, float]]] = {}
        for at, n in enumerate(order):
            for t, w in vectors[n].items():
                lists.setdefault(t, []).append((at, w))
        self.postings = {}
        for t, entries in lists.items():
            at, w = np.array([e[0] for e in entries]), np.array([e[1] for e in entries])
            own, first = np.unique(at // block, return_index=True)
            self.postings[t] = (at, w, at // block, own, np.maximum.reduceat(w, first))

    def search(self, vector: dict[int, float], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """(similarity, position) of the k nearest with a similarity above 0."""
        lists = [(q, self.postings[t]) for t, q in sorted(vector.items()) if t in self.postings]
        if not lists:
            return []
        bound = np.zeros(self.blocks)
        for q, p in lists:
            bound[p[3]] += q * p[4]

        def scores(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Positions and similarities within the blocks that are alive."""
            at, value = [], []
            for q, (where, w, own, _, _) in lists:
                mask = alive[own]
                at.append(where[mask])
                value.append(q * w[mask])
            sums = np.bincount(np.concatenate(at), np.concatenate(value))
            found = np.nonzero(sums)[0]
            found = found[found != skip]
            return found, np.round(sums[found], 12)

        alive = bound > 0
        if self.blocks > 2:
            best = np.zeros(self.blocks, bool)
            best[np.argpartition(-bound, 1)[:2]] = True
            _, first = scores(best & alive)
            if len(first) >= k:  # no block below the k-th best of these can enter
                alive &= bound >= np.partition(first, len(first) - k)[len(first) - k] - 1e-11
        found, sums = scores(alive)
        if len(found) > k:
            enough = sums >= np.partition(sums, len(sums) - k)[len(sums) - k]
            found, sums = found[enough], sums[enough]
        top = np.lexsort((self.ids[found], -sums))[:k]
        return list(zip(sums[top].tolist(), found[top].tolist()))


class Model:
    """Vocabulary, document frequencies, index and calibration."""

    def __init__(self, vocabulary: dict[str, int], idf: dict[int, float], examples: list[tuple[int, list[int], int]], empty: tuple[int, int], k: int):
        self.vocabulary, self.idf, self.k = vocabulary, idf, k
        self.index = BlockMaxIndex([e[0] for e in examples], [self.vector(e[1]) for e in examples], [e[2] for e in examples])
        positive, all_empty = empty
        self.rate = positive / all_empty if all_empty else (sum(e[2] for e in examples) / len(examples) if examples else 0.0)
        by_id = {e[0]: e for e in examples}
        votes = [(self._vote(self.index.search(self.vector(by_id[i][1]), k, skip=at)), self.index.labels[at]) for at, i in enumerate(self.index.ids.tolist())]
        self.steps = _monotone([v for v in votes if v[0] is not None])

    def vector(self, terms: list[int]) -> dict[int, float]:
        w = {t: (1 + math.log(n)) * self.idf.get(t, 0.0) for t, n in Counter(terms).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}

    def _vote(self, near: list[tuple[float, int]]) -> float | None:
        total = sum(s for s, _ in near)
        return sum(s for s, at in near if self.index.labels[at]) / total if total else None

    def score(self, terms: list[int]) -> tuple[float, list[tuple[int, float, int]]]:
        """Calibrated score and the neighbours as (doc_id, similarity, label)."""
        near = self.index.search(self.vector(terms), self.k)
        vote = self._vote(near)
        evidence = [(int(self.index.ids[at]), s, self.index.labels[at]) for s, at in near]
        if vote is None:
            return self.rate, evidence
        ends, levels = self.steps
        base = levels[min(int(np.searchsorted(ends, vote)), len(levels) - 1)] if levels else vote
        return min(1.0, max(0.0, 0.999 * base + 0.001 * vote)), evidence  # the vote still orders equal levels


def _monotone(votes: list[tuple[float, int]]) -> tuple[list[float], list[float]]:
    """Rising steps (upper ends, levels) of the label's rate over the vote, by pooling of neighbours."""
    pools: list[list[float]] = []
    for vote, same in itertools.groupby(sorted(votes), key=lambda v: v[0]):  # equal votes are one pool from the start
        labels = [label for _, label in same]
        pools.append([sum(labels), len(labels), vote])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, n, end = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + n, end]
    return [p[2] for p in pools], [p[0] / p[1] for p in pools]


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per term and label, combined per batch."""
    for rows in batches:
        counts: Counter = Counter()
        for text, label in zip(rows["text"], rows["label"]):
            own: Counter = Counter()
            for word, n in Counter(_LETTERS.findall(text.lower())).items():
                for t in word_terms(word):
                    own[t] += n
            counts.update((t, label) for t in own)
            counts.update((r, label) for t, n in own.items() if n > 1 for r in repeats(t, n))
        yield pd.DataFrame([(t, label, n) for (t, label), n in counts.items()], columns=["term", "label", "n"])


def choose_terms(examples: DataFrame, limit: int = VOCABULARY, least: float = CHI_SQUARED) -> dict[str, int]:
    """Terms that go with label 1, by chi-squared."""
    totals = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    if not positive or not negative:
        return {}
    counts = examples.select("text", "label").mapInPandas(_frequencies, "term string, label int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(positive + negative)
    c, d = positive - a, negative - b
    chi = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * positive * negative)
    best = counts.filter(a * d > b * c).withColumn("chi", chi).filter(F.col("chi") >= least).orderBy(F.col("chi").desc(), "term").limit(limit)
    return {r["term"]: i for i, r in enumerate(best.select("term").collect())}


def features(docs: DataFrame, vocabulary: dict[str, int], text: str = "text"):
    """A column with the vocabulary terms of the whole text, repeats included."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = shared.value
        scanner = worker_cache(("toxicity", hash(frozenset(words.items()))), lambda: Scanner(words))
        for texts in batches:
            yield texts.map(scanner.terms)

    return terms(whole(text))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 5, limit: int = EXAMPLES, k: int = NEIGHBOURS) -> tuple[Model, DataFrame]:
    """The model, and the features (all columns of ``docs`` but the text, terms) of all documents."""
    text_batches(docs.sparkSession)
    examples = labelled(docs, labels, label, crc_mod("doc_id", fold) == 0, limit)
    vocabulary = choose_terms(examples)
    table = saved(docs.withColumn("terms", features(docs, vocabulary)).drop("text"), "toxicity-terms")
    n = table.count()
    df = {r["t"]: r["n"] for r in table.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1e-9 for t in vocabulary.values()}
    own = saved(examples.withColumn("terms", features(examples, vocabulary)).drop("text"), "toxicity-examples")
    with_terms = [(r["id"], list(r["terms"]), r["label"]) for r in own.filter("size(terms) > 0").collect()]  # at most ``limit``
    empty = own.filter("size(terms) = 0").agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    return Model(vocabulary, idf, with_terms, (empty[0], empty[1]), k), table


_RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType()),
    ]))),
])


def score(model: Model, terms, spark: SparkSession):
    """A column (score, evidence) from a column of terms."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(_RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for lists in batches:
            rows = []
            for terms in lists:
                key = tuple(sorted(terms))
                if key not in known:
                    if len(known) >= _REMEMBERED // 10:
                        known.clear()
                    known[key] = shared.value.score(list(key))
                value, near = known[key]
                rows.append((value, [{"doc_id": int(i), "similarity": s, "label": int(y)} for i, s, y in near[:3]]))
            yield pd.DataFrame(rows, columns=["score", "evidence"])

    return scored(terms)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns only."""
    model, _ = fit(docs.select("doc_id", "text"), labels)
    rows = docs.withColumn("__score", score(model, features(docs, model.vocabulary), docs.sparkSession)["score"])
    return rows.filter(F.col("__score") < threshold).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model, table = fit(documents(spark, sf_dir).select("doc_id", "text"), labels)
    out = table.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), score(model, F.col("terms"), spark).alias("r"))
    return out.select(
        "doc_id", "held_out", F.col("r.score").alias("score"), (F.col("r.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("r.evidence").alias("evidence")
    )
