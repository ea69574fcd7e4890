"""Closed time-range filter over many intervals at once.

A record joins every interval with ``lo <= ts <= hi`` (both ends inclusive).
Instead of a nested-loop join, intervals are exploded to the fixed-size time
buckets they touch and joined on the bucket (an equi-join), with the exact
range as a residual predicate. Each record carries exactly one bucket, so the
large side is never multiplied.

Broadcast only when the exploded interval side is proven small (its rows and
bytes are counted); beyond that bound the join is a shuffled sort-merge join on
the bucket, where AQE skew handling splits a hot bucket.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.numeric import floor_div
from faultlens.functions.time import NS_PER_DAY, NS_PER_HOUR

# What we are willing to broadcast of the exploded intervals.
MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 128 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in a broadcast: texts by their length, 8 for other values."""
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t == "string" else F.lit(8) for c, t in df.dtypes), F.lit(0)).cast("long")


def bounded_broadcast(df: DataFrame, n: int, size: int, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a frame counted to be small in rows and bytes; past either bound ask for a merge join."""
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df.hint("merge")


def _bucket(c: Column, bucket_ns: int) -> Column:
    return floor_div(c, bucket_ns)


def interval_join(records: DataFrame, intervals: DataFrame, *, ts: str = "timestamp_ns",
                  lo: str = "start_timestamp", hi: str = "end_timestamp",
                  bucket_ns: int = NS_PER_HOUR, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                  keep_bounds: bool = False) -> DataFrame:
    """Inner join ``records`` x ``intervals`` on ``lo <= records[ts] <= hi``.

    Output: every record column plus every interval column (the bounds only
    when ``keep_bounds``). A record in k overlapping intervals appears k times.
    """
    iv = intervals.where(F.col(lo) <= F.col(hi))
    iv = iv.withColumn("_bk", F.explode(F.sequence(_bucket(F.col(lo), bucket_ns),
                                                    _bucket(F.col(hi), bucket_ns))))
    iv = iv.withColumnRenamed(lo, "_lo").withColumnRenamed(hi, "_hi")
    # one small job on the interval side: its size (broadcast bound) and overall range
    st = iv.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(iv)).alias("size"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).first()
    iv = bounded_broadcast(iv, st["n"], st["size"] or 0, max_broadcast_rows)
    rec = records.where(F.col(ts).isNotNull())
    if st["n"] == 0:
        rec = rec.where(F.lit(False))
    else:
        # literal range: reaches the Parquet scan (row-group pruning) when ``ts`` is a stored column
        rec = rec.where(F.col(ts).between(F.lit(st["lo"]), F.lit(st["hi"])))
    rec = rec.withColumn("_bk", _bucket(F.col(ts), bucket_ns))
    out = rec.join(iv, on="_bk", how="inner").where(F.col(ts).between(F.col("_lo"), F.col("_hi")))
    out = out.drop("_bk")
    if keep_bounds:
        return out.withColumnRenamed("_lo", lo).withColumnRenamed("_hi", hi)
    return out.drop("_lo", "_hi")


def subtract_intervals(windows: DataFrame, holes: DataFrame, *, lo: str = "lo", hi: str = "hi", hole_lo: str = "start_timestamp",
                       hole_hi: str = "end_timestamp", own: str | None = "uuid", bucket_ns: int = NS_PER_DAY) -> DataFrame:
    """The parts of every closed window ``[lo, hi]`` that no closed hole covers, as rows of the windows' columns.

    Both sides are exploded to the buckets they touch and joined on the bucket, so only windows and holes that are near
    meet. A window's holes are then swept in order: a part lies before each hole that starts past the end of all earlier
    ones. ``own``: a hole of the same owner as the window is none. Repeated windows count once; an empty window has no part.
    """
    cols = windows.columns
    w = windows.where(F.col(lo) <= F.col(hi)).distinct()

    def near(df, a, b):
        return df.withColumn("_bk", F.explode(F.sequence(_bucket(F.col(a), bucket_ns), _bucket(F.col(b), bucket_ns))))
    h = holes.where(F.col(hole_lo) <= F.col(hole_hi)).select(
        F.col(hole_lo).alias("_from"), F.col(hole_hi).alias("_to"), *([F.col(own).alias("_own")] if own else []))
    met = near(w, lo, hi).join(near(h, "_from", "_to"), "_bk").where((F.col("_from") <= F.col(hi)) & (F.col("_to") >= F.col(lo)))
    if own:
        met = met.where(~F.col("_own").eqNullSafe(F.col(own)))
    met = met.select(*cols, "_from", "_to").distinct()
    after = F.col(hi) + 1       # a last hole behind the window
    swept = met.unionByName(w.select(*cols, after.alias("_from"), after.alias("_to")))
    earlier = Window.partitionBy(*cols).orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.col(lo), F.coalesce(F.max("_to").over(earlier) + 1, F.col(lo)))
    parts = swept.withColumns({"_start": start, "_stop": F.col("_from") - 1}).where("_start <= _stop")
    return parts.select(*[F.col({lo: "_start", hi: "_stop"}.get(c, c)).alias(c) for c in cols])


_HELD: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Keep an intermediate of a lazy plan in memory and on disk until :func:`release`; recomputed where an executor
    that held blocks is lost. Unlike :func:`cut`, the plan goes on to the scan."""
    _HELD.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _HELD[-1]


def release() -> None:
    """Give back all intermediates held so far; call it when the results that read them are written."""
    while _HELD:
        _HELD.pop().unpersist()


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Materialise a shared intermediate as a Parquet table in the shared
    checkpoint folder and continue from it.

    Later plans start from a shallow file scan (with real size statistics for
    join planning) instead of re-analysing - and, after an executor loss,
    re-running - the whole lineage. The folder is read from
    ``spark.checkpoint.dir`` (set by the cluster; only tests set their own).
    """
    import uuid

    from faultlens.session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.parquet(path)
