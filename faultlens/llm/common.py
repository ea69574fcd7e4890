"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.session import ensure_checkpoint_dir

FOREST_NODES = 200_000   # nodes a task's spanning forest holds at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back (cuts the lineage)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new ids, so that two frames of one origin can be co-grouped."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def small_side(df: DataFrame, rows: int, row_bytes: int, bound: int = 64 << 20) -> DataFrame:
    """Broadcast ``df`` only if its counted size is within ``bound`` bytes; else Spark shuffles the join."""
    return F.broadcast(df) if rows * row_bytes <= bound else df


def strings(batch, name: str) -> list[str]:
    """A string column of an Arrow batch as Python strings, null as the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def give_back() -> None:
    """Hand freed memory back to the system: Spark keeps a Python worker for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # there with glibc alone
    if trim is not None:
        trim(0)


def slices(batches, rows: int = 1024):
    """The Arrow batches in smaller ones, so that a task holds few texts as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    give_back()


def by_size(batches, rows: int, chars: int = 8 << 20):
    """Slices of at most ``rows`` rows, fewer where texts are very long."""
    for batch in slices(batches, rows):
        start, held = 0, 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
            if held and held + n > chars:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def forest(edges: DataFrame) -> DataFrame:
    """A spanning forest of each task's edges ``a, b``, as edges from a tree's smallest node to the others.

    Nodes that stand alone stay as self loops. A task lets go of its trees at ``FOREST_NODES`` nodes, so memory is
    bounded; connectivity over all tasks is kept.
    """
    def trees(up: dict) -> pa.RecordBatch:
        roots = []
        for x in up:
            r = x
            while up[r] != r:
                r = up[r]
            up[x] = r
            roots.append(r)
        a, b = np.array(roots, np.int64), np.fromiter(up, np.int64, len(up))
        lone = ~np.isin(b, a[a != b])
        keep = (a != b) | lone
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    def run(batches):
        up: dict[int, int] = {}
        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x_up, y_up = up.setdefault(x, x), up.setdefault(y, y)
                while x_up != x:
                    up[x] = x_up = up[x_up]
                    x, x_up = x_up, up[x_up]
                while y_up != y:
                    up[y] = y_up = up[y_up]
                    y, y_up = y_up, up[y_up]
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) >= FOREST_NODES:
                yield trees(up)
                up.clear()
        if up:
            yield trees(up)
        up.clear()
        give_back()

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def connected(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, comp)``, ``comp`` the smallest node.

    Alternating large-star and small-star steps, each over the spanning forests of the tasks that read the edges, so
    that long chains take few rounds. Every step is one grouped minimum (partial aggregation, so a hub is summed
    map-side) and one equi-join; each round's edges are written to the shared checkpoint folder. Nodes without edges do
    not appear. Null ends are dropped, self loops kept as nodes. An empty table gives an empty table.
    """
    first = stored(forest(edges.where("a IS NOT NULL AND b IS NOT NULL")), name)
    cur, before = first.where("a < b"), None
    while True:
        cur = forest(cur)
        # large star: hang every larger neighbour of a node on the node's smallest neighbour (or itself)
        low = cur.union(cur.selectExpr("b", "a")).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = fresh(cur).join(fresh(low), "a").select("m", "b")
        # small star: hang a node and its smaller neighbours on the smallest of them
        least = up.groupBy("b").agg(F.min("m").alias("a"))
        cur = stored(least.select("a", "b").union(
            up.join(least, "b").where("m > a").select("a", "m")).distinct(), name)
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    nodes = first.selectExpr("a AS node").union(first.selectExpr("b AS node")).distinct()
    return nodes.join(cur.selectExpr("b AS node", "a AS comp"), "node", "left").selectExpr(
        "node", "coalesce(comp, node) AS comp")


class Remembered(dict):
    """The latest entries of a Python worker, in two generations: an entry met again moves to the young one, and
    :meth:`age` drops the old one whole when the young one is full. Look up with ``[]``."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def knows(self, key) -> bool:
        return key in self or key in self.old

    def age(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
