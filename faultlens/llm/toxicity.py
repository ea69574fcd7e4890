"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and unlabelled text (U: documents whatever their label says) train bagged
numpy classifiers with the risk  prior * R_P+ + max(0, R_U- - prior * R_P-), the class prior being the
labelled share of toxic rows. Features are hashed words and padded character 4-grams that are over-
represented in P; a document's score is the sigmoid of the bags' mean logit. Only the fit is bounded
(``MAX_POSITIVE`` and ``MAX_UNLABELLED`` rows, the first by a hash); scoring covers every whole text.

Defined results: null or empty texts get the score of a text without features; without usable labels the
prior is ``DEFAULT_PRIOR`` and every score equals it; a doc_id labelled twice counts as toxic if any row
says so; null labels are skipped; repeated documents are scored once each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import give_back, slices, strings

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 24_000
BAGS = 4
FEATURES = 4_096          # kept by each bag
HASH_BITS = 20
CACHE = 100_000           # words a scoring task remembers with their features
LONG = 40                 # longer words are scored whole, but not remembered
DEFAULT_PRIOR = 0.1
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def word_features(w: str) -> list[int]:
    """Hashed features of one lower-cased word: the word and its padded character 4-grams."""
    mask, pad = (1 << HASH_BITS) - 1, f"^{w}$"
    grams = {pad[i:i + 4] for i in range(max(1, len(pad) - 3))}
    return [zlib.crc32(("w" + w).encode()) & mask] + [zlib.crc32(("g" + g).encode()) & mask for g in grams]


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _cells(features: pd.Series):
    """Row and feature numbers of some documents at a time."""
    for at in range(0, len(features), 256):
        lists = [np.frombuffer(x, "<i4") for x in features.iloc[at:at + 256]]
        yield at + np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)


def _train(pdf: pd.DataFrame, prior: float) -> pd.DataFrame:
    """One bag: choose features, then descend the non-negative risk (Adam, full batch)."""
    empty = pd.DataFrame({"feature": pd.Series([], dtype="int64"), "weight": pd.Series([], dtype="float64")})
    pos = pdf["positive"].to_numpy(bool)
    unl = pdf["unlabelled"].to_numpy(bool)
    if not pos.any() or not unl.any():
        return empty
    size, n = 1 << HASH_BITS, len(pdf)
    in_p, in_u = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for rows, cols in _cells(pdf["features"]):
        in_p += np.bincount(cols[pos[rows]], minlength=size)
        in_u += np.bincount(cols[unl[rows]], minlength=size)
    seen = np.flatnonzero(in_p >= 2)
    p, u = in_p[seen] / pos.sum(), in_u[seen] / unl.sum()
    neg = np.maximum(u - prior * p, 0) / (1 - prior)
    lift = np.log((p + 0.5 / pos.sum()) / (neg + 0.5 / unl.sum()))
    gain = np.where(lift > math.log(3), p * lift, 0)
    best = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    kept = seen[best[gain[best] > 0]]
    if not len(kept):
        return empty
    index = np.full(size, -1, np.int32)
    index[kept] = np.arange(len(kept))
    held = [(rows[on], index[cols[on]]) for rows, cols in _cells(pdf["features"]) for on in [index[cols] >= 0]]
    r, c = (np.concatenate(x) for x in zip(*held))
    w, b = np.zeros(len(kept)), math.log(prior / (1 - prior))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    wp, wu = pos / pos.sum(), unl / unl.sum()
    for step in range(1, 301):
        z = np.bincount(r, weights=w[c], minlength=n) + b
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        soft = np.logaddexp(0, z)
        negative = (wu * soft).sum() - prior * (wp * soft).sum()
        if negative >= 0:
            g = prior * wp * (s - 1) + wu * s - prior * wp * s
        else:                       # the negative risk is over-fitted: push it back up
            g = -(wu * s - prior * wp * s)
        gw = np.bincount(c, weights=g[r], minlength=len(kept)) + 1e-4 * w
        gb = g.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= 0.05 * (mw / fix1) / (np.sqrt(vw / fix2) + 1e-8)
        b -= 0.05 * (mb / fix1) / (math.sqrt(vb / fix2) + 1e-8)
    return pd.DataFrame({"feature": np.append(kept, -1), "weight": np.append(w, b)})


def fit(docs: DataFrame, labels: DataFrame) -> dict[int, float]:
    """Feature weights (feature -1: the bias), at most ``BAGS * FEATURES`` of them."""
    known = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("positive")))
    share = known.agg(F.avg(F.col("positive").cast("double"))).first()[0]
    prior = min(max(DEFAULT_PRIOR if share is None else share, 0.001), 0.9)
    order = F.xxhash64("doc_id")
    picked = (known.where("positive").orderBy(order, "doc_id").limit(MAX_POSITIVE)
              .select("doc_id", F.lit(True).alias("positive"), F.lit(False).alias("unlabelled"))
              .union(known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(MAX_UNLABELLED)
                     .select("doc_id", F.lit(False), F.lit(True)))
              .groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled")))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sample = text.join(F.broadcast(picked), "doc_id")     # at most 30,000 rows of ids and flags

    def featurise(batches):
        for b in slices(batches):
            feats = []
            for t in strings(b, "text"):
                own = {f for w in set(_WORD.findall(t.lower())) for f in word_features(w)}
                feats.append(np.fromiter(own, "<i4", len(own)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("positive"), b.column("unlabelled"), pa.array(feats, pa.binary())],
                ["doc_id", "positive", "unlabelled", "features"])

    rows = (sample.mapInArrow(featurise, "doc_id long, positive boolean, unlabelled boolean, features binary")
            .dropDuplicates(["doc_id"]).withColumn("bag", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(BAGS))))
    bags = rows.groupBy("bag").applyInPandas(lambda pdf: _train(pdf, prior), "feature long, weight double")
    trained = bags.collect()                              # at most BAGS * (FEATURES + 1) rows
    n = sum(r["feature"] == -1 for r in trained)
    if not n:
        return {-1: math.log(prior / (1 - prior))}
    model: dict[int, float] = {}
    for r in trained:
        model[r["feature"]] = model.get(r["feature"], 0.0) + r["weight"] / n
    return model


def score(docs: DataFrame, model: dict[int, float], keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` (``doc_id`` if not given) and the score of the whole text."""
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).schema.add(name, "double")
    src = docs.select(*keep, F.col("text").alias("_text_"))

    def run(batches):
        known: dict[str, tuple] = {}
        bias = model.get(-1, 0.0)
        for b in slices(batches):
            out = []
            for t in strings(b, "_text_"):
                seen: set[int] = set()
                for w in set(_WORD.findall(t.lower())):
                    f = known.get(w)
                    if f is None:
                        f = tuple(x for x in word_features(w) if x in model)
                        if len(w) <= LONG:
                            known[w] = f
                    if f:
                        seen.update(f)
                z = bias + math.fsum(model[x] for x in seen)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                if len(known) > CACHE:
                    known.clear()
            cols = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(out, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], name])
        known.clear()
        give_back()

    return src.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
