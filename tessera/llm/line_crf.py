"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its score comes from features of the line and of
the lines before and after it: shares of character kinds, repetition, word
lengths. Transitions tie neighbouring lines. Forward-backward gives each
line's marginal; the document's quality is their mean, weighted by length.

Training takes at most ``EXAMPLES`` labelled documents (a parameter; chosen by
a hash of their identifier, equal texts once); each of their lines carries the
document's label. Features are computed once and written; each step of the
optimiser is one Spark job that adds up loss and gradient over them, and only
these sums reach the driver. Scoring reads every whole text.

Defined cases: a null text counts as empty and is one empty line; lines of any
length are read in slices, and the features of many lines in windows, of which
three numbers per line stay; further columns are ignored; without labels of both kinds the score
is the labels' mean (0.5 without any); several labels of one document count as
good if one is; repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.llm.common import crc_mod, documents, labelled, saved, text_batches, whole, worker_cache

EXAMPLES = 4_000
STEPS = 60
THRESHOLD = 0.7
_RIDGE = 1e-3
_SLICE = 1 << 20
#: Lines whose features are in memory at a time.
_LINES = 4096
_CELLS = 2_000_000
_PUNCTUATION = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
_LOWER, _UPPER, _DIGIT, _SPACE, _OTHER, _FOREIGN, _BREAK = range(7)
_KINDS = 7 + len(_PUNCTUATION)


def _kinds() -> np.ndarray:
    table = np.full(0x251, _OTHER, np.int64)
    for code in range(0x250):
        c = chr(code)
        if c == "\n":
            table[code] = _BREAK
        elif c in _PUNCTUATION:
            table[code] = 7 + _PUNCTUATION.index(c)
        elif c.isspace():
            table[code] = _SPACE
        elif c.isdigit():
            table[code] = _DIGIT
        elif c.isalpha():
            table[code] = _UPPER if c.isupper() else _LOWER
    table[0x250] = _FOREIGN
    return table


_TABLE = _kinds()
WIDTH = 14 + _KINDS


def _window(lines: list[str], seen: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of some lines; ``seen`` knows the lines before them."""
    text = "\n".join(lines)
    counts = np.zeros((len(lines), _KINDS))
    at = 0
    for start in range(0, len(text), _SLICE):
        codes = np.frombuffer(text[start:start + _SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = _TABLE[np.minimum(codes, 0x250)]
        own = np.cumsum(kinds == _BREAK)
        last = int(own[-1])
        counts[at:at + last + 1] += np.bincount(own * _KINDS + kinds, minlength=(last + 1) * _KINDS).reshape(-1, _KINDS)
        at += last
    counts[:, _BREAK] = 0
    length = counts.sum(axis=1)
    share = counts / np.maximum(length, 1)[:, None]
    letters = share[:, _LOWER] + share[:, _UPPER] + share[:, _FOREIGN]
    marks = share[:, 7:].sum(axis=1)
    words = np.zeros((len(lines), 4))
    for n, line in enumerate(lines):
        found = line.split()
        if found:
            k = len(found)
            words[n, 0] = k
            words[n, 1] = sum(map(eq, found, found[1:])) / k
            words[n, 2] = len(set(found)) / k
        h = hash(line)
        words[n, 3] = h in seen and bool(found)
        seen.add(h)
    count = words[:, 0]
    out = np.empty((len(lines), WIDTH), np.float32)
    out[:, :14] = np.column_stack([
        np.ones(len(lines)), count == 0, np.log1p(length) / 10, np.log1p(count) / 8, np.minimum(1, length / np.maximum(count, 1) / 20), letters,
        share[:, _UPPER] / np.maximum(letters, 1e-9), marks, marks > 0.1, marks > 0.25, words[:, 1], words[:, 1] > 0.3, words[:, 2], words[:, 3],
    ])
    out[:, 14:] = np.sqrt(share)
    return out, length


def line_windows(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines x WIDTH features between 0 and about 1, lengths in characters),
    for at most ``_LINES`` lines at a time."""
    lines, seen = text.split("\n"), set()
    for at in range(0, len(lines), _LINES):
        yield _window(lines[at:at + _LINES], seen)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows together, for training examples."""
    x, length = zip(*line_windows(text))
    return np.concatenate(x), np.concatenate(length)


def _neighbours(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the lines of documents in a row, the rows before and after; the row past the end stands for none."""
    n = int(sizes.sum())
    before, after = np.arange(n) - 1, np.arange(n) + 1
    ends = np.cumsum(sizes)
    before[ends - sizes], after[ends - 1] = n, n
    return before, after


def unary(x: np.ndarray, sizes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Score of "good" over "bad" per line, from the line and its neighbours."""
    return from_parts(x @ w.T.astype(np.float32), sizes)


def from_parts(parts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same from every line's three shares: own, for the line behind, for the line before."""
    parts = np.vstack([parts, np.zeros((1, 3), np.float32)]).astype(np.float64)
    before, after = _neighbours(sizes)
    return parts[:-1, 0] + parts[before, 1] + parts[after, 2]


def marginals(scores: np.ndarray, sizes: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many documents: P(good) per line, log partition
    per document, expected transitions (documents x 2 x 2)."""
    p, z, pairs = np.empty(len(scores)), np.empty(len(sizes)), np.zeros((len(sizes), 2, 2))
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):  # documents of like length together, in bounded memory
        top = int(sizes[order[at]])
        some = order[at:at + max(1, _CELLS // max(1, top))]
        at += len(some)
        long, n = sizes[some], len(some)
        u = np.zeros((top, n, 2))
        for j, d in enumerate(some):
            u[:long[j], j, 1] = scores[starts[d]:starts[d] + long[j]]
        live = [int(k) for k in np.searchsorted(-long, -np.arange(top), side="left")]  # documents longer than t
        a, b = np.empty((top, n, 2)), np.zeros((top, n, 2))
        a[0] = u[0]
        for t in range(1, top):
            k = live[t]
            a[t, :k, 0] = np.logaddexp(a[t - 1, :k, 0] + links[0, 0], a[t - 1, :k, 1] + links[1, 0])
            a[t, :k, 1] = np.logaddexp(a[t - 1, :k, 0] + links[0, 1], a[t - 1, :k, 1] + links[1, 1]) + u[t, :k, 1]
        last = a[long - 1, np.arange(n)]
        z[some] = np.logaddexp(last[:, 0], last[:, 1])
        for t in range(top - 2, -1, -1):
            k = live[t + 1]
            to = b[t + 1, :k] + u[t + 1, :k]
            b[t, :k, 0] = np.logaddexp(links[0, 0] + to[:, 0], links[0, 1] + to[:, 1])
            b[t, :k, 1] = np.logaddexp(links[1, 0] + to[:, 0], links[1, 1] + to[:, 1])
            joint = a[t, :k, :, None] + links[None] + to[:, None, :] - z[some[:k], None, None]
            pairs[some[:k]] += np.exp(joint)
        good = 1 / (1 + np.exp(np.clip((a[:, :, 0] + b[:, :, 0]) - (a[:, :, 1] + b[:, :, 1]), -700, 700)))
        for j, d in enumerate(some):
            p[starts[d]:starts[d] + long[j]] = good[:long[j], j]
    return p, z, pairs


def loss(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log likelihood per line, summed over documents, and its gradient."""
    w, links = theta[:3 * WIDTH].reshape(3, WIDTH), theta[3 * WIDTH:].reshape(2, 2)
    scores = unary(x, sizes, w)
    p, z, pairs = marginals(scores, sizes, links)
    weight = 1.0 / sizes
    each = np.repeat(np.arange(len(sizes)), sizes)
    gold = np.bincount(each, scores, len(sizes)) * labels + (sizes - 1) * links[labels, labels]
    d = (p - labels[each]) * weight[each]
    before, after = _neighbours(sizes)
    rows = np.vstack([x, np.zeros((1, WIDTH), np.float32)])
    grad = np.stack([d @ x, d @ rows[before], d @ rows[after]]).ravel()
    trans = (pairs * weight[:, None, None]).sum(axis=0)
    for y in (0, 1):
        trans[y, y] -= ((sizes - 1) * weight * (labels == y)).sum()
    return float(((z - gold) * weight).sum()), np.concatenate([grad, trans.ravel()])


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for text, label in zip(rows["text"], rows["label"]):
            x, _ = line_features(text)
            out.append((label, len(x), x.tobytes()))
        yield pd.DataFrame(out, columns=["label", "lines", "x"])


def _sums(theta: np.ndarray):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value, grad, n = 0.0, np.zeros_like(theta), 0
        for rows in batches:
            if len(rows):
                x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows["x"]])
                v, g = loss(x, rows["lines"].to_numpy(), rows["label"].to_numpy(), theta)
                value, grad, n = value + v, grad + g, n + len(rows)
        yield pd.DataFrame({"value": [value], "grad": [grad.tobytes()], "n": [n]})

    return sums


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out=None, limit: int = EXAMPLES, steps: int = STEPS) -> np.ndarray | float:
    """Parameters by L-BFGS, or a constant score if the labels do not differ."""
    text_batches(docs.sparkSession)
    held_out = F.lit(False) if held_out is None else held_out
    rows = labelled(docs, labels, label, held_out, limit)
    data = saved(rows.select("text", F.col("label").cast("int").alias("label")).mapInPandas(_examples, "label int, lines long, x binary"), "crf-features")
    total = data.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean")).first()
    if not total["n"] or total["mean"] in (0.0, 1.0):
        return 0.5 if total["mean"] is None else float(total["mean"])

    def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
        parts = data.mapInPandas(_sums(theta), "value double, grad binary, n long").collect()  # one row per task
        value = math.fsum(r["value"] for r in parts) / total["n"]
        grad = np.sum([np.frombuffer(r["grad"]) for r in sorted(parts, key=lambda r: (r["value"], r["n"]))], axis=0) / total["n"]
        return value + _RIDGE * float(theta @ theta) / 2, grad + _RIDGE * theta

    return minimised(objective, np.zeros(3 * WIDTH + 4), steps)


def minimised(objective, theta: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    value, grad = objective(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        size = 1.0 if past else min(1.0, 1.0 / (np.abs(grad).sum() + 1e-12))
        for _ in range(12):
            new = theta - size * q
            new_value, new_grad = objective(new)
            if new_value <= value - 1e-4 * size * (grad @ q):
                break
            size /= 2
        else:
            return theta
        if (new - theta) @ (new_grad - grad) > 1e-12:
            past = [*past, (new - theta, new_grad - grad)][-memory:]
        gain, theta, value, grad = value - new_value, new, new_value, new_grad
        if gain < 1e-5 * abs(value):
            break
    return theta


def quality(theta: np.ndarray, texts: list[str]) -> list[float]:
    """Length-weighted mean marginal of "good" per text."""
    w, links = theta[:3 * WIDTH].reshape(3, WIDTH), theta[3 * WIDTH:].reshape(2, 2)
    scores, sizes, lengths = [], [], []
    for text in texts:
        parts, length = zip(*((x @ w.T.astype(np.float32), n) for x, n in line_windows(text)))
        parts, length = np.concatenate(parts), np.concatenate(length)
        scores.append(from_parts(parts, np.array([len(parts)])))
        sizes.append(len(parts))
        lengths.append(length + 1)
    if not texts:
        return []
    sizes = np.array(sizes)
    p, _, _ = marginals(np.concatenate(scores), sizes, links)
    each, weight = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(lengths)
    return (np.bincount(each, p * weight, len(sizes)) / np.bincount(each, weight, len(sizes))).clip(0, 1).tolist()


def score(theta: np.ndarray | float, text: str = "text"):
    """A column with the quality of the whole text."""
    if isinstance(theta, float):
        return F.lit(theta)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_cache("line_crf", object)
        for texts in batches:
            yield pd.Series(quality(theta, texts.tolist()), dtype="float64")

    return scored(whole(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc_mod("doc_id", 4) == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    theta = fit(docs, labels, "quality", held_out)
    out = docs.select("doc_id", held_out.alias("held_out"), score(theta).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
