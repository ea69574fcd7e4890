"""Readers for the raw telemetry layout.

Layout (per day)::

    {root}/{date}/log-parquet/*{hour}*
    {root}/{date}/trace-parquet/*{hour}*
    {root}/{date}/metric-parquet/apm/service/<x>_<service>_<y>.parquet
    {root}/{date}/metric-parquet/apm/pod/<x>_<pod>_<y>.parquet
    {root}/{date}/metric-parquet/infra/infra_tidb/infra_tidb_<metric>_{date}.parquet
    {root}/{date}/metric-parquet/other/infra_pd_<metric>_{date}.parquet  (and infra_tikv_)
    {root}/{date}/metric-parquet/infra/infra_node/infra_node_<metric>_{date}.parquet
    {root}/{date}/metric-parquet/infra/infra_pod/infra_pod_<metric>_{date}.parquet

A named file may also be a folder of that name, or of ``key=name``, as Spark writes them.

Files are chosen by a join: the listed files with the hours in their names against the hours that the windows touch. One
distributed job reads the footers of the chosen files (the *census*); files of one column layout are one Parquet scan
with the schema's types, so the number of jobs and scans does not grow with the number of files. Numeric columns of any
type are cast. A file whose footer cannot be read raises, or (training) goes to a quarantine table.
Metric sources are normalised to one tall table (schema METRIC_POINTS) so one pass of statistics serves every source.
"""

from __future__ import annotations

import io
import re
import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.numeric import floor_div
from faultlens.functions.time import NS_PER_DAY, NS_PER_HOUR, ns_to_ntz
from faultlens.operators.metrics import DB_METRICS, NODE_METRICS, POD_METRICS, SERVICE_METRICS
from faultlens.sources import schemas

# Where each database service's metric files live, and their name prefix.
DB_DIRS = {"tidb-tidb": ("infra/infra_tidb", "infra_tidb"),
           "tidb-pd": ("other", "infra_pd"),
           "tidb-tikv": ("other", "infra_tikv")}
# Fixed value: the node file map also carries this metric, which is not analysed.
NODE_EXTRA_METRICS = ("node_filesystem_size_bytes",)
HOUR_TOKEN = r"(\d{4}-\d{2}-\d{2}_\d{2})"


# ------------------------------------------------------------------------ S1
def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incident CSV (header, UTF-8) -> uuid, seq (file row order),
    start_timestamp, end_timestamp (ns), start_time_hour, date."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    cols = set(raw.columns)
    start = F.col("start_timestamp").cast("long")
    df = raw.select(
        F.col("uuid").cast("string").alias("uuid"), start.alias("start_timestamp"), F.col("end_timestamp").cast("long").alias("end_timestamp"),
        (F.col("start_time_hour") if "start_time_hour" in cols else F.date_format(ns_to_ntz(start), "yyyy-MM-dd_HH")).alias("start_time_hour"),
        (F.col("date") if "date" in cols else F.date_format(ns_to_ntz(start), "yyyy-MM-dd")).alias("date"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))
    # consecutive row numbers: a block's rows follow those of the blocks before it (one row per block in the window)
    blocks = df.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return df.join(blocks, ["_file", "_block"]).select(
        "uuid", (F.col("_id") - F.col("_first") + F.col("_before")).alias("seq"), "start_timestamp", "end_timestamp", "start_time_hour", "date")


# ----------------------------------------------------------- files and footers
def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``path`` of every data file under the folders that ``pattern`` matches; none is an empty table."""
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    except AnalysisException as e:      # the listing alone: a file that vanishes later is an error
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string")
    return listed.select("path")


def _footer(path: str, content: bytes | None):
    """The Parquet metadata of a file, by its content where it is given."""
    import pyarrow.parquet as pq
    from pyarrow import fs
    if content is not None:
        return pq.read_metadata(io.BytesIO(content))
    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    else:
        system, name = fs.FileSystem.from_uri(path)
    return pq.read_metadata(system.open_input_file(name))


_CENSUS = "path string, layout string, n_rows long, error string, unreached boolean"


def census(files: DataFrame, schema: T.StructType) -> DataFrame:
    """``path, layout, n_rows, error`` of every file, from its footer.

    ``layout`` names the stored type of each numeric column of ``schema`` that differs from it. Tasks read footers
    directly; files in a store that only Spark opens are read through it in a second job.
    """
    wanted = {f.name: f.dataType.simpleString() for f in schema if isinstance(f.dataType, T.NumericType)}
    cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need not have the package
    names = {pa.int8(): "tinyint", pa.int16(): "smallint", pa.int32(): "int", pa.int64(): "bigint", pa.float32(): "float",
             pa.float64(): "double", pa.uint8(): "smallint", pa.uint16(): "int", pa.uint32(): "bigint", pa.uint64(): "decimal(20,0)"}

    def kind(t) -> str | None:
        return f"decimal({t.precision},{t.scale})" if pa.types.is_decimal(t) else names.get(t)

    def look(path: str, content: bytes | None) -> tuple:
        try:
            meta = _footer(path, content)
        except pa.ArrowInvalid as e:            # no Parquet file, or a scheme that is not known here
            unknown = content is None and not path.startswith("file:") and "scheme" in str(e)
            return path, None, None, f"{type(e).__name__}: {e}"[:500], unknown
        except Exception as e:
            return path, None, None, f"{type(e).__name__}: {e}"[:500], content is None and not path.startswith("file:")
        own = {f.name: kind(f.type) for f in meta.schema.to_arrow_schema() if f.name in wanted}
        return path, ",".join(f"{c} {own[c]}" for c in wanted if own.get(c) not in (None, wanted[c])), meta.num_rows, None, False

    def run(batches):
        for b in batches:
            contents = b.column("content").to_pylist() if "content" in b.schema.names else [None] * b.num_rows
            found = [look(p, c) for p, c in zip(b.column("path").to_pylist(), contents)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), (
                pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()))], ["path", "layout", "n_rows", "error", "unreached"]) \
                if found else pa.RecordBatch.from_pylist([], pa.schema([("path", pa.string()), ("layout", pa.string()), (
                    "n_rows", pa.int64()), ("error", pa.string()), ("unreached", pa.bool_())]))

    spark = files.sparkSession
    done = files.select("path").mapInArrow(run, _CENSUS).collect()      # a short row per chosen file, as the scan's own list
    far = [r.path for r in done if r.unreached]
    if far:
        content = spark.read.format("binaryFile").load(far).select("path", "content")
        done = [r for r in done if not r.unreached] + content.mapInArrow(run, _CENSUS).collect()
    return spark.createDataFrame([tuple(r)[:4] for r in done], "path string, layout string, n_rows long, error string")


def _scan(spark: SparkSession, schema: T.StructType, rows: list, lineage: bool, skip_corrupt: bool = False,
          more: dict[str, Column] | None = None) -> DataFrame:
    """The files of census rows: one scan per layout, numeric columns cast to the schema's types."""
    layouts: dict[str, list[str]] = {}
    for r in rows:
        layouts.setdefault(r.layout or "", []).append(r.path)
    more = {**({"source_file": F.col("_metadata.file_name")} if lineage else {}), **(more or {})}
    out = None
    for layout, files in sorted(layouts.items()):
        stored = dict(c.split(" ", 1) for c in re.split(r",(?![0-9])", layout)) if layout else {}
        own = T.StructType([T.StructField(f.name, T._parse_datatype_string(stored[f.name]) if f.name in stored else f.dataType) for f in schema])
        df = spark.read.schema(own).option("ignoreCorruptFiles", skip_corrupt).parquet(*sorted(files))
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], *[c.alias(n) for n, c in more.items()])
        out = df if out is None else out.unionByName(df)
    if out is None:
        out = spark.createDataFrame([], T.StructType(schema.fields + [T.StructField(n, T.StringType()) for n in more]))
    return out


def _readable(rows: list) -> list:
    bad = [r for r in rows if r.error is not None]
    if bad:
        raise ValueError(f"{len(bad)} of {len(rows)} files cannot be read, the first is {bad[0].path}: {bad[0].error}")
    return rows


# ---------------------------------------------------------------- S2 - S5
def _hour_of(token: Column) -> Column:
    """Hours since the epoch of a ``YYYY-MM-DD_HH`` token, as the token's own zone counts them; null if it is none."""
    day = F.unix_date(F.substring(token, 1, 10).try_cast("date"))
    return (day * 24 + F.substring(token, 12, 2).try_cast("int")).cast("long")


def name_offsets(incidents: DataFrame) -> DataFrame:
    """``uuid, name_offset``: hours that file names run ahead of UTC, from each incident's ``start_time_hour``."""
    named = _hour_of(F.col("start_time_hour")) - floor_div(F.col("start_timestamp"), NS_PER_HOUR)
    return incidents.select("uuid", F.coalesce(named, F.lit(0)).cast("long").alias("name_offset"))


def _offset_windows(windows: DataFrame, lo: str, hi: str, incidents: DataFrame | None) -> DataFrame:
    """``lo, hi`` in hours of the names' zone."""
    if incidents is None and {"start_time_hour", "start_timestamp"} <= set(windows.columns):
        incidents = windows
    w = windows.select(*(["uuid"] if incidents is not None else []), floor_div(F.col(lo), NS_PER_HOUR).alias("_lo"), floor_div(F.col(hi), NS_PER_HOUR).alias("_hi"))
    off = F.lit(0).cast("long")
    if incidents is not None:
        w, off = w.join(name_offsets(incidents), "uuid", "left"), F.coalesce(F.col("name_offset"), F.lit(0))
    return w.where("_lo <= _hi").select((F.col("_lo") + off).alias("_lo"), (F.col("_hi") + off).alias("_hi"))


def hour_catalogue(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """``path, hour`` of every hourly file of ``kind`` (``log`` | ``trace``) whose name, or folder's name, has an hour."""
    files = list_files(spark, f"{root}/*/{kind}-parquet")
    token = F.regexp_extract(F.element_at(F.split("path", f"/{kind}-parquet/"), -1), HOUR_TOKEN, 1)
    return files.select("path", _hour_of(token).alias("hour")).where("hour IS NOT NULL")


def files_of_windows(catalogue: DataFrame, windows: DataFrame, lo: str = "start_timestamp", hi: str = "end_timestamp",
                     incidents: DataFrame | None = None) -> DataFrame:
    """The catalogue's files of every hour that a window overlaps (B2: not only the first)."""
    hours = _offset_windows(windows, lo, hi, incidents).select(F.explode(F.sequence("_lo", "_hi")).alias("hour")).distinct()
    return catalogue.join(hours, "hour", "left_semi")


def window_hours(incidents: DataFrame, lo: str = "start_timestamp", hi: str = "end_timestamp",
                 names_of: DataFrame | None = None) -> list[str]:
    """Hour tokens (``YYYY-MM-DD_HH``) every window overlaps, in the zone of the names."""
    h = _offset_windows(incidents, lo, hi, names_of).select(F.explode(F.sequence("_lo", "_hi")).alias("h")).distinct()
    return sorted(r[0] for r in h.select(F.date_format(ns_to_ntz(F.col("h") * NS_PER_HOUR), "yyyy-MM-dd_HH")).collect())


def window_dates(incidents: DataFrame, lo: str = "start_timestamp", hi: str = "end_timestamp",
                 names_of: DataFrame | None = None) -> list[str]:
    """Dates every window overlaps (B14: periods crossing midnight read both days), in the zone of the names."""
    w = _offset_windows(incidents, lo, hi, names_of)
    d = w.select(F.explode(F.sequence(floor_div(F.col("_lo"), 24), floor_div(F.col("_hi"), 24))).alias("d")).distinct()
    return sorted(r[0] for r in d.select(F.date_format(ns_to_ntz(F.col("d") * NS_PER_DAY), "yyyy-MM-dd")).collect())


def read_hourly(spark: SparkSession, root: str, kind: str, hours: Sequence[str],
                schema: T.StructType, lineage: bool = False) -> DataFrame:
    """Every hourly file of ``kind`` whose name carries one of ``hours``; ``lineage`` adds ``source_file``."""
    wanted = spark.createDataFrame([(h,) for h in sorted(set(hours))], "token string").select(_hour_of(F.col("token")).alias("hour"))
    files = hour_catalogue(spark, root, kind).join(wanted, "hour", "left_semi")
    return _scan(spark, schema, _readable(census(files, schema).collect()), lineage)


def _read_windows(spark, root, kind, schema, windows, lo, hi, lineage, incidents) -> DataFrame:
    files = files_of_windows(hour_catalogue(spark, root, kind), windows, lo, hi, incidents)
    return _scan(spark, schema, _readable(census(files, schema).collect()), lineage)


def read_logs(spark: SparkSession, root: str, incidents: DataFrame, lineage: bool = False) -> DataFrame:
    """The log files of the hours that the incidents touch; ``start_time_hour`` tells the zone of the names."""
    return _read_windows(spark, root, "log", schemas.LOGS, incidents, "start_timestamp", "end_timestamp", lineage, None)


def read_spans(spark: SparkSession, root: str, windows: DataFrame, lo: str = "start_timestamp",
               hi: str = "end_timestamp", lineage: bool = False, incidents: DataFrame | None = None) -> DataFrame:
    """S3: as :func:`read_logs`, for spans and any windows by uuid (``incidents``: where their names' zone is told)."""
    return _read_windows(spark, root, "trace", schemas.SPANS, windows, lo, hi, lineage, incidents)


def read_training_spans(spark: SparkSession, root: str, windows: DataFrame, lo: str = "lo", hi: str = "hi",
                        incidents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """S4 + S5: the merged spans of the training windows with ``source_file``, and the files' table
    ``path, source_file, n_rows, error``; files without a readable footer are left out of the merge, not fatal."""
    files = census(files_of_windows(hour_catalogue(spark, root, "trace"), windows, lo, hi, incidents), schemas.SPANS)
    rows = files.collect()
    merged = _scan(spark, schemas.SPANS, [r for r in rows if r.error is None], True, skip_corrupt=True)
    name = F.element_at(F.split("path", "/"), -1)
    return merged, files.select("path", name.alias("source_file"), "n_rows", "error")


def merge_report(merged: DataFrame, files: DataFrame) -> DataFrame:
    """Per file ``source_file, n_rows, n_read, content, status, error``: ``merged``, ``unreadable`` (no footer) or
    ``broken`` (fewer rows than its footer says). ``content`` is a checksum of the rows read, so all pages are read."""
    own = [c for c in merged.columns if c != "source_file"]
    read = merged.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_read"), F.bit_xor(F.xxhash64(*own)).alias("content"))
    known = files.groupBy("source_file").agg(F.sum("n_rows").alias("n_rows"), F.first("error", ignorenulls=True).alias("error"))
    n_read = F.coalesce("n_read", F.lit(0))
    status = F.when(F.col("error").isNotNull(), "unreadable").when(n_read < F.col("n_rows"), "broken").otherwise("merged")
    return known.join(read, "source_file", "left").select("source_file", "n_rows", n_read.alias("n_read"), "content", status.alias("status"), "error")


# --------------------------------------------------------------- S6 - S11
def _name_token(file_name):
    """Entity from a file name: 2nd ``_`` token, else the stem."""
    stem = F.regexp_replace(file_name, r"\.parquet$", "")
    return F.when(F.instr(file_name, "_") > 0, F.split(stem, "_").getItem(1)).otherwise(stem)


def _wide_schema(keys: Sequence[str], metrics: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(k, T.StringType()) for k in keys] + [T.StructField("timestamp_ns", T.LongType())]
                        + [T.StructField(m, T.DoubleType()) for m in metrics])


def _tall(df: DataFrame, metrics: Sequence[str], source: str, **entity: Column) -> DataFrame:
    """Wide -> tall with the METRIC_POINTS columns."""
    keys = {k: entity.get(k, F.lit(None).cast("string")) for k in ("service", "pod", "node")}
    base = df.select(F.lit(source).alias("source"), *[c.alias(k) for k, c in keys.items()], "timestamp_ns", *metrics)
    return base.unpivot(["source", *keys, "timestamp_ns"], list(metrics), "metric", "value")


def _named(df: DataFrame, prefix: str, metrics: Sequence[str], source: str, **entity: Column) -> DataFrame:
    """Files named ``<prefix>_<metric>_<date>.parquet`` each carry one value column named after the metric."""
    m = F.regexp_extract(F.col("_name"), rf"^{prefix}_(.*)_\d{{4}}-\d{{2}}-\d{{2}}\.parquet$", 1)
    value = F.element_at(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*metrics)), m)
    keys = {k: entity.get(k, F.lit(None).cast("string")) for k in ("service", "pod", "node")}
    return df.where(m.isin(*metrics)).select(F.lit(source).alias("source"), *[c.alias(k) for k, c in keys.items()], "timestamp_ns",
                                             m.alias("metric"), value.alias("value"))


def date_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """``path, date`` of every metric file: the date of its day's folder, else the one in its own name."""
    day = F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})/metric-parquet/", 1)
    own = F.regexp_extract("path", r"_(\d{4}-\d{2}-\d{2})\.parquet", 1)
    return list_files(spark, f"{root}/*/metric-parquet").select("path", F.when(day != "", day).otherwise(own).alias("date"))


def read_metric_points(spark: SparkSession, root: str, dates: Sequence[str],
                       node_whitelist: Sequence[str] | None = None,
                       pod_whitelist: Sequence[str] | None = None) -> DataFrame:
    """Every metric source of the given dates as one tall table (one listing, one census for all sources)."""
    if not dates:
        return spark.createDataFrame([], schemas.METRIC_POINTS)
    node_metrics = (*NODE_METRICS, *NODE_EXTRA_METRICS)
    sources = {       # kind: (folder, file prefix, key columns, metrics)
        "service": ("apm/service", "", [], SERVICE_METRICS), "pod": ("apm/pod", "", [], SERVICE_METRICS),
        "node": ("infra/infra_node", "infra_node_", ["kubernetes_node"], node_metrics),
        "infra_pod": ("infra/infra_pod", "infra_pod_", ["instance", "pod"], POD_METRICS),
        **{s: (sub, f"{prefix}_", [], DB_METRICS[s]) for s, (sub, prefix) in DB_DIRS.items()}}
    every = _wide_schema([], sorted({m for *_, metrics in sources.values() for m in metrics}))
    wanted = spark.createDataFrame([(d,) for d in sorted(set(dates))], "date string")
    rows = census(date_catalogue(spark, root).join(wanted, "date", "left_semi"), every).collect()
    below = r"/metric-parquet/{}/(?:[^/=]+=)?({}[^/]*)"

    def scan(kind: str) -> DataFrame:
        sub, prefix, keys, metrics = sources[kind]
        own = [r for r in rows if re.search(below.format(sub, prefix), r.path)]
        name = F.regexp_extract(F.col("_metadata.file_path"), below.format(sub, prefix), 1)
        return _scan(spark, _wide_schema(keys, metrics), _readable(own), False, more={"_name": name})

    nodes, pods = scan("node"), scan("infra_pod")
    if node_whitelist is not None:
        nodes = nodes.where(F.col("kubernetes_node").isin(*node_whitelist))
    if pod_whitelist is not None:
        pods = pods.where(F.col("pod").isin(*pod_whitelist))
    name = _name_token(F.col("_name"))
    parts = [_tall(scan("service"), SERVICE_METRICS, "service", service=name), _tall(scan("pod"), SERVICE_METRICS, "pod", pod=name),
             _named(nodes, "infra_node", NODE_METRICS, "node", node=F.col("kubernetes_node")),
             _named(pods, "infra_pod", POD_METRICS, "infra_pod", pod=F.col("pod"), node=F.col("instance"))]
    parts += [_named(scan(s), prefix, DB_METRICS[s], "tidb", service=F.lit(s)) for s, (_, prefix) in DB_DIRS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*schemas.METRIC_POINTS.fieldNames())
