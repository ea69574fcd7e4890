"""Sinks (K1-K8). JSON / CSV text only at the edge; everything upstream is
DataFrames. Writers partition by incident so each incident's evidence is its
own file set and an incident batch can be re-run idempotently."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _replacing(df: DataFrame, *keys: str):
    """A writer that replaces the folders of the keys it writes and leaves all others."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)


def write_csv_by_incident(df: DataFrame, path: str, order: list, drop: tuple = ()) -> None:
    """K1 / K2 / K3: header CSV, one folder per uuid, rows in ``order`` inside it (``-column``: descending);
    ``drop``: columns only used to sort. Earlier incidents stay; an incident that is run again replaces its own folder."""
    by = [F.desc(c[1:]) if isinstance(c, str) and c.startswith("-") else c for c in order]
    rows = df.repartition("uuid").sortWithinPartitions("uuid", *by).drop(*drop)
    _replacing(rows, "uuid").option("header", True).option("escape", '"').csv(path)


#: An incident's log rows, most frequent first.
LOG_ORDER = ["-occurrence_count", "pod_name", "node_name", "message"]
# Columns of the trace and status reports, in order.
TRACE_COLUMNS = ("node_name", "service_name", "parent_pod", "child_pod", "operation_name", "normal_avg_duration",
                 "anomaly_avg_duration", "anomaly_count")
STATUS_COLUMNS = ("node_name", "service_name", "parent_pod", "child_pod", "operation_name", "status_code", "status_message",
                  "occurrence_count")


def write_trace_csv(topk: DataFrame, path: str) -> None:
    """K2: the eight columns of the report, by rank; the count column holds the display text."""
    rows = topk.withColumn("anomaly_count", F.col("anomaly_count_text")).select("uuid", *TRACE_COLUMNS, "rank")
    write_csv_by_incident(rows, path, ["rank"], drop=("rank",))


def write_status_csv(status: DataFrame, path: str) -> None:
    """K3: as K2 for failing status combinations."""
    rows = status.withColumn("occurrence_count", F.col("occurrence_text")).select("uuid", *STATUS_COLUMNS, "rank")
    write_csv_by_incident(rows, path, ["rank"], drop=("rank",))


def write_json_lines(df: DataFrame, path: str) -> None:
    """K4 / K5: JSON lines, a folder per incident (``incident=<uuid>``); a replay replaces, never doubles."""
    rows = df.withColumn("incident", F.col("uuid")).repartition("incident")
    _replacing(rows, "incident").option("ignoreNullFields", False).json(path)


def write_table_by_incident(df: DataFrame, path: str) -> None:
    """Parquet, a folder per incident that a replay replaces."""
    _replacing(df, "uuid").parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list | None = None, mode: str = "overwrite") -> None:
    """K6 / K7: Parquet tables (spans for training, training windows)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_or_fit(spark: SparkSession, path: str, fit: Callable[[], DataFrame]) -> DataFrame:
    """K8: read the model table if present, else fit, write, and read back.

    Reading back cuts the lineage to the (costly) fit, and the written table
    is what later runs load.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:   # only a missing or never finished table is fitted anew
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        fit().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


# ------------------------------------------------------------- keyed tables (K6-K8)
def fingerprint(config: dict) -> str:
    """A short name of a configuration: the same values, in any order, give the same name."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Parquet under ``path``, dealt by hash of ``keys`` into ``buckets`` files and sorted by them."""
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(
        f"faultlens_{fingerprint({'path': path})}")


def read_bucketed(spark: SparkSession, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The table of :func:`write_bucketed`; grouping or joining by its keys needs no shuffle.

    A session that did not write it registers it by its place first.
    """
    name = f"faultlens_{fingerprint({'path': path})}"
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS "
                  f"LOCATION '{path}'")
    return spark.table(name)


def _published(spark: SparkSession, base: str) -> str | None:
    try:
        last = spark.read.parquet(f"{base}/published").orderBy(F.desc("at"), "run").first()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return last["run"] if last else None


def keyed_table(spark: SparkSession, root: str, config: dict, build: Callable[[], DataFrame],
                keys: Sequence[str] = (), buckets: int = 0) -> DataFrame:
    """K6-K8: the table that ``config`` stands for, built where it is not published yet.

    Every configuration has a folder of its own, so another seed or window never meets an older model. A build is
    written to a run's folder and published by one row once it is whole; a run that was cut off is never read.
    With ``buckets`` the table is dealt by ``keys``.
    """
    base = f"{root}/{fingerprint({**config, 'keys': list(keys), 'buckets': buckets})}"
    run = _published(spark, base)
    if run is None:
        run = uuid.uuid4().hex
        if buckets:
            write_bucketed(build(), f"{base}/run-{run}", keys, buckets)
        else:
            build().write.parquet(f"{base}/run-{run}")
        row = spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("at"), F.lit(json.dumps(config, sort_keys=True, default=str)).alias("config"))
        row.write.mode("append").parquet(f"{base}/published")
    path = f"{base}/run-{run}"
    return read_bucketed(spark, path, keys, buckets) if buckets else spark.read.parquet(path)
