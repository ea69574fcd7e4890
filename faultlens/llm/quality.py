"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every whole text (1 good, 0 bad, -1 abstains). Their votes are counted per pattern
over all documents (at most 3^8 patterns); expectation-maximisation over the counts estimates each labeller's accuracy on
good and on bad texts and the share of good ones. The posteriors label a bounded sample (``MAX_TRAIN`` documents, the
first by a hash) that trains a linear scorer over hashed word shapes and layout features; it scores every text.
No given labels are used.

Defined results: null or empty texts are voted bad by the length labeller and scored like any text; repeated rows are
scored once each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import stored, strings

LABELLERS = ("length", "symbols", "capitals", "line_repeats", "word_variety", "sentences", "word_length", "tables")
MAX_TRAIN = 20_000
HASH_BITS = 16
THRESHOLD = 0.5

_WORD = re.compile(r"\S+")
_SYMBOLS = set("#$%&*|{}<>=\\^~`@")


def _three(value: float, bad, good) -> int:
    """1 if ``good(value)``, 0 if ``bad(value)``, else -1."""
    return 0 if bad(value) else 1 if good(value) else -1


def votes(text: str) -> list[int]:
    """One vote of each labeller, in the order of ``LABELLERS``."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] + [-1] * (len(LABELLERS) - 1)
    chars = Counter(text)
    letters = sum(k for c, k in chars.items() if c.isalpha()) or 1
    capitals = sum(k for c, k in chars.items() if c.isupper()) / letters
    symbols = sum(chars[s] for s in _SYMBOLS) / n
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    repeats = 1 - len(set(lines)) / len(lines)
    top = Counter(words).most_common(1)[0][1] / n
    variety = len(set(words)) / n
    ends = sum(x[-1] in ".!?:;\"')" for x in lines) / len(lines)
    mean = sum(map(len, words)) / n
    bars = sum("|" in x or "\t" in x for x in lines) / len(lines)
    return [
        _three(n, lambda v: v < 20, lambda v: v >= 60),
        _three(symbols, lambda v: v > 0.15, lambda v: v < 0.03),
        _three(capitals, lambda v: v > 0.3, lambda v: v < 0.12),
        _three(repeats, lambda v: v > 0.3, lambda v: v < 0.1 and len(lines) > 2),
        _three(max(top, 0.3 - variety), lambda v: v > 0.2 and n > 10, lambda v: v < 0.1 and n > 40),
        _three(ends, lambda v: v < 0.3, lambda v: v > 0.7),
        _three(mean, lambda v: v < 2.5 or v > 12, lambda v: 3.5 <= v <= 8.5),
        _three(bars, lambda v: v > 0.3, lambda v: v < 0.05),
    ]


def features(text: str) -> dict[int, float]:
    """Hashed layout features: word shapes and last characters, with values that sum to about one."""
    words = text.split()
    shapes = Counter()
    for w, c in Counter(words).items():
        shape = ("A" if w.isupper() else "Aa" if w[:1].isupper() else "a" if w.isalpha() else "-") + str(min(len(w), 14) // 2)
        end = w[-1] if not w[-1].isalnum() else "w"
        shapes["s" + shape] += c
        shapes["e" + end + str(len(w) - len(w.rstrip(w[-1])))[:1]] += c
        if c * 10 > len(words) > 10:
            shapes["r" + str(c * 10 // len(words))] += len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n, mask = max(1, len(words)), (1 << HASH_BITS) - 1
    out: dict[int, float] = {}
    for k, c in shapes.items():
        i = zlib.crc32(k.encode()) & mask
        out[i] = out.get(i, 0.0) + c / n
    for k in (f"n{min(16, len(words)).bit_length() if len(words) < 16 else len(words).bit_length()}",
              f"l{int(10 * (1 - len(set(lines)) / max(1, len(lines))))}", f"L{min(12, len(lines)).bit_length()}"):
        i = zlib.crc32(k.encode()) & mask
        out[i] = out.get(i, 0.0) + 1.0
    return out


def vote_table(docs: DataFrame) -> DataFrame:
    """``doc_id, pattern`` (the votes as digits 0, 1, 2, 2 for an abstention) of every document."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def run(batches):
        for b in batches:
            pats = ["".join(str(v % 3) for v in votes(t)) for t in strings(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pats, pa.string())], ["doc_id", "pattern"])

    return src.mapInArrow(run, "doc_id long, pattern string")


def em(patterns: dict[str, int], rounds: int = 60) -> tuple[float, np.ndarray, dict[str, float]]:
    """Share of good texts, labellers' rates (2 x L: P(vote 1 | bad), P(vote 1 | good)) and the posterior of each pattern."""
    keys = sorted(patterns)
    if not keys:
        return 0.5, np.full((2, len(LABELLERS)), 0.5), {}
    v = np.array([[int(c) for c in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    yes, no = v == 1, v == 0
    # a bad text trips few labellers, so both classes start near 1
    pi, rate = 0.8, np.array([[0.75] * v.shape[1], [0.97] * v.shape[1]])
    q = np.full(len(keys), pi)
    for _ in range(rounds):
        log = [yes @ np.log(r) + no @ np.log(1 - r) for r in rate]
        z = math.log(pi / (1 - pi)) + log[1] - log[0]
        q = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        pi = float(np.clip((n * q).sum() / n.sum(), 0.02, 0.98))
        for c, own in ((0, n * (1 - q)), (1, n * q)):   # priors keep a labeller better than chance at the start
            rate[c] = (own @ yes + (1.0 if c == 0 else 9.0)) / (own @ (yes | no) + 10.0)
        rate = np.clip(rate, 0.01, 0.99)
    return pi, rate, dict(zip(keys, q.tolist()))


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """Logistic regression on soft labels (Adam, full batch)."""
    own = [np.frombuffer(x, "<i4") for x in pdf["index"]]
    vals = np.concatenate([np.frombuffer(x, "<f4") for x in pdf["value"]]).astype(float)
    rows, cols = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
    used, cols = np.unique(cols, return_inverse=True)
    y, n = pdf["target"].to_numpy(float), len(own)
    w, b = np.zeros(len(used)), 0.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, 401):
        z = np.bincount(rows, weights=w[cols] * vals, minlength=n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gw = np.bincount(cols, weights=g[rows] * vals, minlength=len(used)) + 1e-5 * w
        gb = g.sum()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        f1, f2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        w -= 0.1 * (mw / f1) / (np.sqrt(vw / f2) + 1e-8)
        b -= 0.1 * (mb / f1) / (math.sqrt(vb / f2) + 1e-8)
    return pd.DataFrame({"feature": np.append(used, -1).astype("int64"), "weight": np.append(w, b)})


def fit(docs: DataFrame, table: DataFrame) -> tuple[dict[int, float], dict[str, float]]:
    """Scorer weights (at most 2^16 + 1, feature -1 the bias) and the posterior of each vote pattern."""
    counts = {r["pattern"]: r["count"] for r in table.groupBy("pattern").count().collect()}
    posterior = em(counts)[2]
    if not posterior:
        return {-1: 0.0}, {}
    picked = table.orderBy(F.xxhash64("doc_id"), "doc_id", "pattern").limit(MAX_TRAIN).dropDuplicates(["doc_id"])
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches):
        for b in batches:
            fs = [features(t) for t in strings(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(fs), pa.int32()), b.column("doc_id"),
                 pa.array([posterior[p] for p in b.column("pattern").to_pylist()], pa.float64()),
                 pa.array([np.fromiter(f, "<i4", len(f)).tobytes() for f in fs], pa.binary()),
                 pa.array([np.fromiter(f.values(), "<f4", len(f)).tobytes() for f in fs], pa.binary())],
                ["all", "doc_id", "target", "index", "value"])

    sample = src.mapInArrow(run, "all int, doc_id long, target double, index binary, value binary").dropDuplicates(["doc_id"])
    rows = sample.groupBy("all").applyInPandas(_train, "feature long, weight double").collect()
    return {r["feature"]: r["weight"] for r in rows} or {-1: 0.0}, posterior


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id, votes, posterior, score, keep`` of every document."""
    table = stored(vote_table(docs), "votes")
    model, posterior = fit(docs, table)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def run(batches):
        bias = model.get(-1, 0.0)
        for b in batches:
            pats, post, scores = [], [], []
            for t in strings(b, "text"):
                p = "".join(str(v % 3) for v in votes(t))
                z = bias + math.fsum(model.get(i, 0.0) * v for i, v in features(t).items())
                pats.append(p), post.append(posterior.get(p, 0.5))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(pats, pa.string()), pa.array(post, pa.float64()), pa.array(scores, pa.float64()),
                 pa.array([s >= THRESHOLD for s in scores], pa.bool_())], ["doc_id", "votes", "posterior", "score", "keep"])

    return src.mapInArrow(run, "doc_id long, votes string, posterior double, score double, keep boolean")
