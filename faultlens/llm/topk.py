"""Exact top-k search by inner product over norm-sorted vectors.

Components become floor(256 * x). Vectors are ranged by descending length into stripes (a written table, so a
lost executor rereads it). Every query first meets the first stripe, the longest vectors, which gives a lower bound on
its k-th score. A query then visits only stripes whose longest vector can reach that bound (Cauchy-Schwarz);
there, vectors go by descending length, rotated by the right singular vectors of the whole table (from the d x d
Gram matrix), and the first ``HEAD`` rotated dimensions plus the lengths of the two remainders bound the inner
product. What passes is scored exactly in integers.

Stripes descend by length, so those a query visits are the first ones: how many is found by binary search in the list
of the stripes' longest lengths, and only these are laid out. Queries are grouped ``QUERY_LOT`` at a time, so a task
holds one stripe and one lot of queries. All rows of the candidates are searched; nothing is sampled.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors are
padded with zeros; rows that repeat id and vector count once; a query never meets rows of its own id; ties go to
the smaller vec_id; a query without candidates has no rows; an empty table gives an empty table; extra columns
are ignored. Components are held as long, the largest and smallest long where they go beyond; scores are ranked as exact
integers of any size up to 38 digits, and given as long, cut to its range where they go beyond.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import fresh, stored

K = 5
STRIPE = 4096
QUERY_LOT = 512
HEAD = 16
CHUNK = 512
COLUMNS = ["query_id", "qkey", "vec_id", "score"]
MOST = 10 ** 38 - 1      # of a decimal(38, 0)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` (array of long) and ``norm``, usable rows only, repeated rows once."""
    v = F.col(vec_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(fine).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v")).dropDuplicates(["vec_id", "v"])
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _matrix(vs, d: int) -> np.ndarray:
    out = np.zeros((len(vs), d))
    for i, v in enumerate(vs):
        out[i, :len(v)] = v
    return out


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of all rows, strongest first; Spark sums the Gram matrix, d * d numbers."""
    def gram(batches):
        total = np.zeros((d, d))
        for pdf in batches:
            m = _matrix(pdf["v"], d)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(d * d), "g": total.ravel()})

    cells = rows.select("v").mapInPandas(gram, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
    g = np.zeros(d * d)
    for r in cells:
        g[r["i"]] = r["g"]
    return np.linalg.eigh(g.reshape(d, d))[1][:, ::-1].copy()


def search(q: pd.DataFrame, c: pd.DataFrame, turn: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one stripe ``c`` for each query of ``q`` that reach its bound ``least``."""
    d = len(turn)
    c = c.sort_values(["norm", "vec_id"], ascending=[False, True])
    cv, qv = _matrix(c["v"], d), _matrix(q["v"], d)
    ci, qi = c["vec_id"].to_numpy(), q["vec_id"].to_numpy()
    cr, qr = cv @ turn, qv @ turn
    h = min(HEAD, d)
    c_norm, q_norm = c["norm"].to_numpy(), q["norm"].to_numpy()
    c_rest = np.sqrt((cr[:, h:] ** 2).sum(1))
    q_rest = np.sqrt((qr[:, h:] ** 2).sum(1))
    exact_floats = np.abs(cv).max(initial=0) * np.abs(qv).max(initial=0) * d < 2.0 ** 52
    ints_c, ints_q = (None, None) if exact_floats else ([np.asarray(v).tolist() for v in c["v"]], [np.asarray(v).tolist() for v in q["v"]])
    least = np.array([-np.inf if x is None or x != x else float(x) for x in q["least"]])
    best: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]   # (-score, vec_id), k at most
    top = np.empty((0, 3), np.int64)                                  # the same as rows (query, -score, vec_id), in order
    slack = 1e-6 * (1 + q_norm * c_norm.max(initial=0))               # rounding of the rotated floats
    for s in range(0, len(c), CHUNK):
        e = min(s + CHUNK, len(c))
        alive = np.flatnonzero(q_norm * c_norm[s] + slack >= least)    # the chunk's longest vector
        if not len(alive):
            break
        bound = qr[alive, :h] @ cr[s:e, :h].T + np.outer(q_rest[alive], c_rest[s:e]) + slack[alive, None]
        may = bound >= least[alive, None]
        if exact_floats:
            own = alive[may.any(1)]
            cols = np.flatnonzero(may.any(0)) + s
            score = qv[own] @ cv[cols].T                              # whole numbers
            hit, col = np.nonzero((score >= least[own, None]) & (ci[cols][None, :] != qi[own, None]))
            if not len(hit):
                continue
            new = np.stack([own[hit], -score[hit, col].astype(np.int64), ci[cols[col]]], 1)
            top = np.concatenate([top, new])
            top = top[np.lexsort((top[:, 2], top[:, 1], top[:, 0]))]
            first = np.searchsorted(top[:, 0], top[:, 0])
            top = top[np.arange(len(top)) - first < k]
            who, at, many = np.unique(top[:, 0], return_index=True, return_counts=True)
            full = many == k
            least[who[full]] = np.maximum(least[who[full]], -top[at[full] + k - 1, 1])
            continue
        pass_q, pass_c = np.nonzero(may)
        for a in np.unique(pass_q).tolist():
            i = int(alive[a])
            js = pass_c[pass_q == a] + s
            js = js[ci[js] != qi[i]]
            got = [sum(x * y for x, y in zip(ints_c[j], ints_q[i])) for j in js]
            best[i] = sorted(best[i] + [(-g, int(v)) for g, v in zip(got, ci[js].tolist())])[:k]
            if len(best[i]) == k:
                least[i] = max(least[i], float(-best[i][-1][0]))
    for i, g, v in top.tolist():
        best[i].append((g, v))
    rows = [(int(qi[i]), int(q["qkey"].iloc[i]), v, Decimal(max(-MOST, min(MOST, -g)))) for i, own in enumerate(best) for g, v in own]
    return pd.DataFrame(rows, columns=COLUMNS)


def topk(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
         stripe: int = STRIPE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for each row of ``vectors`` with ``is_query``
    (an expression over ``vec_id``)."""
    schema = "query_id long, qkey long, vec_id long, score decimal(38,0)"
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, id_col, vec_col), "vectors")
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(rows, d)
    n_stripes = max(1, -(-n // stripe))
    ranged = rows.repartitionByRange(n_stripes, F.desc("norm"), F.asc("vec_id")).withColumn("stripe", F.spark_partition_id())
    ranged = stored(ranged, "stripes")
    # one number per stripe, first stripe first; ranges may leave the first ones empty
    longest = sorted((r["stripe"], r["longest"]) for r in ranged.groupBy("stripe").agg(F.max("norm").alias("longest")).collect())
    numbers, lengths = np.array([s for s, _ in longest]), np.array([x for _, x in longest])
    n_query = max(1, n // 50)
    query = rows.where(is_query).select("vec_id", "v", "norm", F.xxhash64("v").alias("qkey"))
    query = query.withColumn("lot", F.pmod(F.xxhash64("vec_id", "qkey"), F.lit(max(1, -(-n_query // QUERY_LOT)))))

    def meet(visits: DataFrame) -> DataFrame:
        """``visits``: queries with the stripe to search and the score to reach."""
        wanted = visits.select("lot", "stripe").distinct()
        cands = ranged.join(wanted, "stripe")
        return fresh(visits).groupBy("lot", "stripe").cogroup(fresh(cands).groupBy("lot", "stripe")).applyInPandas(
            lambda q, c: search(q, c, turn, k) if len(q) and len(c) else pd.DataFrame([], columns=COLUMNS), schema)

    first = int(numbers[0])
    seeds = stored(meet(query.select("*", F.lit(first).alias("stripe"), F.lit(None).cast("double").alias("least"))), "seeds")
    reached = seeds.groupBy(F.col("query_id").alias("vec_id"), "qkey").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("least"))

    def stripes(batches):
        """Adds the stripes after the first whose longest vector can reach the query's bound: a prefix of them."""
        for pdf in batches:
            least, norm = pdf["least"].to_numpy(float), pdf["norm"].to_numpy(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                needed = (least - 1e-6) / (norm * (1 + 1e-9))
            needed[np.isnan(least) | (norm == 0) & (least <= 1e-6)] = -np.inf
            last = np.searchsorted(-lengths, -needed, side="right")
            pdf["stripe"] = [numbers[1:n].tolist() for n in last.tolist()]
            yield pdf

    visits = query.join(reached, ["vec_id", "qkey"], "left").select("vec_id", "v", "norm", "qkey", "lot", "least")
    later = visits.mapInPandas(stripes, "vec_id long, v array<long>, norm double, qkey long, lot long, least double, stripe array<int>")
    later = later.withColumn("stripe", F.explode("stripe"))
    found = seeds.union(meet(later))
    w = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id",
                    F.least(F.greatest("score", F.lit(-2 ** 63).cast("decimal(38,0)")), F.lit(2 ** 63 - 1).cast("decimal(38,0)")).cast("long").alias("score")))
