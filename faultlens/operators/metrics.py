"""Metric evidence: incident periods (W2), period-tagged samples (J1 + A4),
trimmed statistics per period (A2), normal-vs-fault pairing (J8) with the
mean-ratio gate (F8), node / pod / database / service drill-down
(A10-A13, R1, J4), wide->tall normalisation (S11, F4) and the nested JSON
evidence (K4).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions.numeric import round_half_up

from faultlens.functions.time import NS_PER_DAY, NS_PER_MIN
from faultlens.operators.interval import bounded_broadcast, interval_join, subtract_intervals
from faultlens.operators.stats import DECIMALS, STAT_COLUMNS, trimmed_describe

# Fixed values from the reference workload.
NORMAL_GAP_NS = 10 * NS_PER_MIN        # normal period starts 10 min after a fault ends
RATIO_EPSILON = 1e-9
RATIO_BAND = (0.95, 1.05)              # a mean ratio inside the band is "no change"

# Metric catalogue per source.
SERVICE_METRICS = ("client_error_ratio", "error_ratio", "request", "response", "rrt",
                   "server_error_ratio", "timeout")
NODE_METRICS = ("node_cpu_usage_rate", "node_disk_read_bytes_total", "node_disk_read_time_seconds_total",
                "node_disk_write_time_seconds_total", "node_disk_written_bytes_total",
                "node_filesystem_free_bytes", "node_filesystem_usage_rate", "node_memory_MemAvailable_bytes",
                "node_memory_MemTotal_bytes", "node_memory_usage_rate", "node_network_receive_bytes_total",
                "node_network_receive_packets_total", "node_network_transmit_bytes_total",
                "node_network_transmit_packets_total", "node_sockstat_TCP_inuse")
POD_METRICS = ("pod_cpu_usage", "pod_fs_reads_bytes", "pod_fs_writes_bytes", "pod_memory_working_set_bytes",
               "pod_network_receive_bytes", "pod_network_receive_packets", "pod_network_transmit_bytes",
               "pod_network_transmit_packets", "pod_processes")
DB_METRICS = {
    "tidb-tidb": ("failed_query_ops", "duration_99th", "connection_count", "server_is_up", "cpu_usage",
                  "memory_usage"),
    "tidb-pd": ("store_up_count", "store_down_count", "store_unhealth_count", "storage_used_ratio", "cpu_usage",
                "memory_usage"),
    "tidb-tikv": ("cpu_usage", "memory_usage", "server_is_up", "available_size", "raft_propose_wait",
                  "raft_apply_wait", "rocksdb_write_stall"),
}


# ------------------------------------------------------------------------- W2
def with_neighbours(incidents: DataFrame) -> DataFrame:
    """Adds ``prev_end`` and ``next_start``, of the neighbours in row order. Parts of the result keep their periods, so
    incidents can be processed in any portions."""
    prev = incidents.select((F.col("seq") + 1).alias("seq"), F.col("end_timestamp").alias("prev_end"))
    nxt = incidents.select((F.col("seq") - 1).alias("seq"), F.col("start_timestamp").alias("next_start"))
    return incidents.join(prev, "seq", "left").join(nxt, "seq", "left")


def incident_periods(incidents: DataFrame, gap_ns: int = NORMAL_GAP_NS, *, exclude_faults: bool = False) -> DataFrame:
    """Per incident the fault period and up to two normal periods.

    normal/before = [prev_end + gap, start], normal/after = [end + gap, next_start],
    where prev/next follow incident row order (``seq``). A period whose start
    is after its end stays in the table but selects no samples.
    ``exclude_faults`` (B12): normal periods without the faults of other incidents, in as many rows as are left.
    Output: uuid, period, part, lo, hi.
    """
    j = incidents if {"prev_end", "next_start"} <= set(incidents.columns) else with_neighbours(incidents)
    row = lambda period, part, lo, hi: F.struct(F.lit(period).alias("period"), F.lit(part).alias("part"),
                                                lo.alias("lo"), hi.alias("hi"))
    rows = F.array(
        row("fault", "fault", F.col("start_timestamp"), F.col("end_timestamp")),
        F.when(F.col("prev_end").isNotNull(),
               row("normal", "before", F.col("prev_end") + F.lit(gap_ns), F.col("start_timestamp"))),
        F.when(F.col("next_start").isNotNull(),
               row("normal", "after", F.col("end_timestamp") + F.lit(gap_ns), F.col("next_start"))),
    )
    out = j.select("uuid", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("p"))
    out = out.select("uuid", "p.period", "p.part", "p.lo", "p.hi")
    if not exclude_faults:
        return out
    return out.where("period = 'fault'").unionByName(subtract_intervals(out.where("period = 'normal'"), incidents))


def period_samples(points: DataFrame, periods: DataFrame, *, bucket_ns: int = NS_PER_DAY) -> DataFrame:
    """J1 + A4: tag samples with (uuid, period); normal parts concatenate."""
    return interval_join(points, periods.select("uuid", "period", "lo", "hi"), lo="lo", hi="hi",
                         bucket_ns=bucket_ns)


# ------------------------------------------------------------------------- J8
def compare_periods(samples: DataFrame, keys: Sequence[str], *, gate: bool = True,
                    decimals: int = DECIMALS, keep_raw_ratio: bool = False) -> DataFrame:
    """A2 per (uuid, keys, period) then J8 side by side, ratio, F8 gate.

    Output: uuid, keys..., normal_<stat>..., fault_<stat>..., mean_ratio, status
    where status is ``shifted`` / ``no_baseline`` / ``no_fault_data``. With
    ``gate`` rows whose mean ratio is inside [0.95, 1.05] are dropped; a
    missing ratio is kept (and flagged).
    """
    keys = ["uuid", *keys]
    st = trimmed_describe(samples, [*keys, "period"], decimals=None)
    aggs = []
    for period in ("normal", "fault"):
        for c in STAT_COLUMNS:
            aggs.append(F.max(F.when(F.col("period") == period, F.col(c))).alias(f"{period}_{c}"))
    w = st.groupBy(*keys).agg(*aggs)
    ratio = F.try_divide(F.col("fault_mean") + F.lit(RATIO_EPSILON), F.col("normal_mean") + F.lit(RATIO_EPSILON))
    w = w.withColumn("mean_ratio", ratio)
    if gate:
        w = w.where(_passes_gate())
    out = []
    for c in w.columns:
        col = F.col(c)
        if c.endswith("_count"):
            out.append(col.cast("long").alias(c))
        elif c in keys or c.endswith("non_zero_ratio"):
            out.append(col)
        else:
            out.append(round_half_up(col, decimals).alias(c))
    extra = [F.col("mean_ratio").alias("_raw_ratio")] if keep_raw_ratio else []
    return w.select(*out, _status(gate).alias("status"), *extra)


def _passes_gate():
    lo, hi = RATIO_BAND
    return F.col("mean_ratio").isNull() | ~F.col("mean_ratio").between(lo, hi)


def _status(gated: bool):
    return (F.when(F.col("normal_count").isNull(), F.lit("no_baseline"))
            .when(F.col("fault_count").isNull(), F.lit("no_fault_data"))
            .otherwise(F.lit("shifted" if gated else "compared")))


def apply_gate(compared: DataFrame) -> DataFrame:
    """F8 on an ungated comparison made with ``keep_raw_ratio`` (the gate
    reads the unrounded ratio, exactly as the inline gate does)."""
    lo, hi = RATIO_BAND
    r = F.col("_raw_ratio")
    return compared.where(r.isNull() | ~r.between(lo, hi)).withColumn("status", _status(True))


def whitelist(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """keep rows whose ``column`` is in a given list (semi join, broadcast while the list is small)."""
    dim = df.sparkSession.createDataFrame([(a,) for a in allowed], f"{column} string")
    small = bounded_broadcast(dim, len(allowed), sum(16 + 4 * len(a) for a in allowed))
    return df.join(small, column, "left_semi")


# ---------------------------------------------------------------- A10 / A11
def node_shift_samples(samples: DataFrame, nodes: Sequence[str] | None = None) -> DataFrame:
    """A10 on period-tagged samples: per (uuid, node, metric) normal vs fault, gated."""
    p = samples.where(F.col("node").isNotNull())
    if nodes is not None:
        p = whitelist(p, "node", nodes)
    return compare_periods(p.select("uuid", "period", "node", "metric", "value"), ["node", "metric"])


def pod_shift_samples(samples: DataFrame, pods: Sequence[str] | None = None) -> DataFrame:
    """A11 on period-tagged samples: per (uuid, instance, pod, metric), null keys dropped, gated."""
    p = samples.where(F.col("node").isNotNull() & F.col("pod").isNotNull())
    if pods is not None:
        p = whitelist(p, "pod", pods)
    p = p.select("uuid", "period", F.col("node").alias("instance"), "pod", "metric", "value")
    return compare_periods(p, ["instance", "pod", "metric"])


def db_stats_samples(samples: DataFrame) -> DataFrame:
    """A12 on period-tagged samples: per (uuid, service, metric), no gate."""
    p = samples.where(F.col("service").isNotNull()).select("uuid", "period", "service", "metric", "value")
    return compare_periods(p, ["service", "metric"], gate=False)


def node_shift(points: DataFrame, periods: DataFrame, nodes: Sequence[str] | None = None,
               *, bucket_ns: int = NS_PER_DAY) -> DataFrame:
    """A10 (filters the whitelist before the interval join)."""
    if nodes is not None:
        points = whitelist(points.where(F.col("node").isNotNull()), "node", nodes)
    return node_shift_samples(period_samples(points, periods, bucket_ns=bucket_ns))


def pod_shift(points: DataFrame, periods: DataFrame, pods: Sequence[str] | None = None,
              *, bucket_ns: int = NS_PER_DAY) -> DataFrame:
    """A11 (filters the whitelist before the interval join)."""
    if pods is not None:
        points = whitelist(points.where(F.col("pod").isNotNull()), "pod", pods)
    return pod_shift_samples(period_samples(points, periods, bucket_ns=bucket_ns))


def db_stats(points: DataFrame, periods: DataFrame, *, bucket_ns: int = NS_PER_DAY) -> DataFrame:
    """A12"""
    return db_stats_samples(period_samples(points, periods, bucket_ns=bucket_ns))


# ----------------------------------------------------------------------- A13
def pods_of_services(services: DataFrame, pods: DataFrame) -> DataFrame:
    """J4 as an equi-join: a pod belongs to every service that prefixes its name.

    The pod side is exploded to its name prefixes (bounded by the name
    length), so ``startswith`` becomes a hash join on the prefix.
    Input: services(uuid, service, ...), pods(uuid, pod); output adds ``pod``.
    """
    pre = pods.select("uuid", "pod", F.explode(F.sequence(F.lit(1), F.length("pod"))).alias("_k"))
    pre = pre.select("uuid", "pod", F.substring(F.col("pod"), F.lit(1), F.col("_k")).alias("service"))
    return services.join(pre, ["uuid", "service"])


def service_drilldown_samples(service_samples: DataFrame, pod_samples: DataFrame) -> DataFrame:
    """A13 + R1 on period-tagged samples: service stats -> abnormal
    (uuid, service, metric) by the F8 gate -> the same comparison for the
    pods of those services on those metrics only.

    service_samples: (uuid, period, service, metric, value)
    pod_samples:     (uuid, period, pod, metric, value)
    Output: uuid, service, pod, metric, normal_*, fault_*, mean_ratio, status.
    """
    svc = compare_periods(service_samples.select("uuid", "period", "service", "metric", "value"),
                          ["service", "metric"])
    abnormal = svc.select("uuid", "service", "metric")
    ps = pod_samples.select("uuid", "period", "pod", "metric", "value")
    pods = ps.select("uuid", "pod").distinct()
    allowed = pods_of_services(abnormal, pods).select("uuid", "service", "pod", "metric")
    ps = ps.join(allowed, ["uuid", "pod", "metric"])
    return compare_periods(ps, ["service", "pod", "metric"], gate=False)


def service_drilldown(service_points: DataFrame, pod_points: DataFrame, periods: DataFrame,
                      *, bucket_ns: int = NS_PER_DAY) -> DataFrame:
    """A13 from raw points (service|pod, metric, timestamp_ns, value): one join with the periods and one statistics pass
    over services and pods together, then the drill-down on the statistics."""
    def tagged(points: DataFrame, source: str) -> DataFrame:
        return points.select(F.lit(source).alias("source"), F.col(source).alias("e1"), F.lit("").alias("e2"), "metric", "timestamp_ns", "value")
    both = tagged(service_points, "service").unionByName(tagged(pod_points, "pod"))
    return service_view(compare_all_sources(period_samples(both, periods, bucket_ns=bucket_ns)))


# ---------------------------------------------------------------- S11 / F4
def unpivot_metrics(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """S11 + F4: wide frame -> (ids..., metric, value); null / NaN values dropped."""
    present = [m for m in metrics if m in wide.columns]
    t = wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in present]).unpivot(
        list(ids), present, "metric", "value")
    return t.where(F.col("value").isNotNull() & ~F.isnan("value"))


# ------------------------------------------------------------------------ K4
# Statistic names as they appear in the JSON evidence.
JSON_STAT_NAMES = {"p25": "25%", "p50": "50%", "p75": "75%", "p95": "95%", "p99": "99%"}


def _stats_struct(prefix: str) -> F.Column:
    return F.struct(*[F.col(f"{prefix}_{c}").alias(JSON_STAT_NAMES.get(c, c)) for c in STAT_COLUMNS])


def _sorted_map(key: str, value: F.Column) -> F.Column:
    """Map of a group's rows, by key (the values may hold maps, which have no order)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))),
                           lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    return F.map_from_entries(entries)


# Sections of the JSON evidence, in order, and the keys each is nested by.
JSON_SECTIONS = {"service": ("service", "pod"), "tidb": ("service", "metric"), "node": ("node", "metric"), "pod": ("instance", "pod", "metric")}


def evidence_json(service: DataFrame, db: DataFrame, node: DataFrame, pod: DataFrame) -> DataFrame:
    """K4: one JSON document per incident: {service, tidb, node, pod}.

    service: service -> pod -> {normal_stats: {metric: stats}, fault_stats: {metric: stats}}
    tidb:    service -> metric -> {normal_stats, fault_stats}
    node:    node -> metric -> {normal_stats, fault_stats}
    pod:     node -> pod -> metric -> {normal_stats, fault_stats}
    All four keys are there, a section without rows as ``{}``; a missing statistic is null; keys are in order.
    Built with map aggregation per incident (bounded by entities x metrics).
    """
    leaf = F.struct(_stats_struct("normal").alias("normal_stats"), _stats_struct("fault").alias("fault_stats"))

    def nest(df: DataFrame, levels: Sequence[str], value: F.Column, name: str) -> DataFrame:
        cur = df.select("uuid", *levels, value.alias("_v"))
        for i in range(len(levels) - 1, -1, -1):
            cur = cur.groupBy("uuid", *levels[:i]).agg(_sorted_map(levels[i], F.col("_v")).alias("_v"))
        return cur.withColumnRenamed("_v", name)

    per_pod = service.groupBy("uuid", "service", "pod").agg(
        _sorted_map("metric", _stats_struct("normal")).alias("normal_stats"), _sorted_map("metric", _stats_struct("fault")).alias("fault_stats"))
    parts = [nest(per_pod, JSON_SECTIONS["service"], F.struct("normal_stats", "fault_stats"), "service"),
             nest(db, JSON_SECTIONS["tidb"], leaf, "tidb"), nest(node, JSON_SECTIONS["node"], leaf, "node"), nest(pod, JSON_SECTIONS["pod"], leaf, "pod")]
    doc = (service.select("uuid").union(db.select("uuid")).union(node.select("uuid")).union(pod.select("uuid")).distinct())
    for part in parts:
        doc = doc.join(part, "uuid", "left")
    texts = [F.coalesce(F.to_json(name, {"ignoreNullFields": "false"}), F.lit("{}")) for name in JSON_SECTIONS]
    pieces = [x for name, text in zip(JSON_SECTIONS, texts) for x in (F.lit(f',"{name}":'), text)]
    pieces[0] = F.lit('{"service":')
    return doc.select("uuid", F.concat(*pieces, F.lit("}")).alias("metric_json"))


def parse_evidence_json(documents: DataFrame) -> DataFrame:
    """K4 read back: one row per (uuid, section, e1, e2, metric, period) with the statistics under their own names."""
    stats = "struct<" + ",".join(f"`{JSON_STAT_NAMES.get(c, c)}`:{'bigint' if c == 'count' else 'double'}" for c in STAT_COLUMNS) + ">"
    leaf = f"struct<normal_stats:{stats},fault_stats:{stats}>"
    by_metric = f"map<string,{leaf}>"
    schema = (f"service map<string,map<string,struct<normal_stats:map<string,{stats}>,fault_stats:map<string,{stats}>>>>, "
              f"tidb map<string,{by_metric}>, node map<string,{by_metric}>, pod map<string,map<string,{by_metric}>>")
    d = documents.select("uuid", F.from_json("metric_json", schema).alias("d")).select("uuid", "d.*")

    def periods(df: DataFrame, section: str, e1: str, e2) -> DataFrame:
        rows = df.select("uuid", F.lit(section).alias("section"), F.col(e1).alias("e1"), e2.alias("e2"), "metric", F.explode(F.array(
            F.struct(F.lit("normal").alias("period"), F.col("v.normal_stats").alias("s")),
            F.struct(F.lit("fault").alias("period"), F.col("v.fault_stats").alias("s")))).alias("p"))
        return rows.select("uuid", "section", "e1", "e2", "metric", "p.period",
                           *[F.col("p.s")[JSON_STAT_NAMES.get(c, c)].alias(c) for c in STAT_COLUMNS])

    def open_map(df: DataFrame, column, key: str) -> DataFrame:
        return df.select("*", F.explode(column).alias(key, "_n")).drop("v").withColumnRenamed("_n", "v")

    none = F.lit("")
    base = d.select("uuid", *JSON_SECTIONS)
    tidb = open_map(open_map(base, "tidb", "e"), "v", "metric")
    node = open_map(open_map(base, "node", "e"), "v", "metric")
    pod = open_map(open_map(open_map(base, "pod", "e"), "v", "f"), "v", "metric")
    svc = open_map(open_map(base, "service", "e"), "v", "f")
    svc_rows = None
    for period in ("normal", "fault"):
        one = svc.select("uuid", "e", "f", F.explode(f"v.{period}_stats").alias("metric", "s")).select(
            "uuid", F.lit("service").alias("section"), F.col("e").alias("e1"), F.col("f").alias("e2"), "metric", F.lit(period).alias("period"),
            *[F.col("s")[JSON_STAT_NAMES.get(c, c)].alias(c) for c in STAT_COLUMNS])
        svc_rows = one if svc_rows is None else svc_rows.unionByName(one)
    return (periods(tidb, "tidb", "e", none).unionByName(periods(node, "node", "e", none))
            .unionByName(periods(pod, "pod", "e", F.col("f"))).unionByName(svc_rows))


# ------------------------------------------------------- one pass, all sources
# Entity key columns of each metric source (second key optional).
SOURCE_KEYS = {"node": ("node", None), "infra_pod": ("instance", "pod"), "tidb": ("service", None),
               "service": ("service", None), "pod": ("pod", None)}


def compare_all_sources(tagged: DataFrame) -> DataFrame:
    """One A2 + J8 pass over every source: ``tagged`` has (uuid, period,
    source, e1, e2, metric, value); result keyed (uuid, source, e1, e2,
    metric), ungated. The per-source views below gate and rename."""
    return compare_periods(tagged, ["source", "e1", "e2", "metric"], gate=False, keep_raw_ratio=True)


def _view(all_stats: DataFrame, source: str) -> DataFrame:
    k1, k2 = SOURCE_KEYS[source]
    keys = [F.col("e1").alias(k1)] + ([F.col("e2").alias(k2)] if k2 else [])
    rest = [c for c in all_stats.columns if c not in ("uuid", "source", "e1", "e2")]
    return all_stats.where(F.col("source") == source).select("uuid", *keys, *rest)


def node_view(all_stats: DataFrame) -> DataFrame:
    return apply_gate(_view(all_stats, "node")).drop("_raw_ratio")


def pod_view(all_stats: DataFrame) -> DataFrame:
    return apply_gate(_view(all_stats, "infra_pod")).drop("_raw_ratio")


def db_view(all_stats: DataFrame) -> DataFrame:
    return _view(all_stats, "tidb").drop("_raw_ratio")


def service_view(all_stats: DataFrame) -> DataFrame:
    """A13 from the one-pass statistics: abnormal (uuid, service, metric) ->
    the pods of those services on those metrics."""
    abnormal = apply_gate(_view(all_stats, "service")).select("uuid", "service", "metric")
    pods = _view(all_stats, "pod").drop("_raw_ratio")
    allowed = pods_of_services(abnormal, pods.select("uuid", "pod").distinct()).select("uuid", "service", "pod", "metric")
    out = pods.join(allowed, ["uuid", "pod", "metric"])
    cols = [c for c in out.columns if c not in ("uuid", "service", "pod", "metric")]
    return out.select("uuid", "service", "pod", "metric", *cols)


def tag_by_source(samples: DataFrame, node_whitelist: Sequence[str] | None = None,
                  pod_whitelist: Sequence[str] | None = None) -> DataFrame:
    """Raw-layout samples (METRIC_POINTS + uuid, period) -> (uuid, period,
    source, e1, e2, metric, value) with each source's entity keys (F5
    whitelists applied to node / infra_pod)."""
    src = F.col("source")
    e1 = (F.when(src.isin("node", "infra_pod"), F.col("node")).when(src.isin("tidb", "service"), F.col("service"))
          .when(src == "pod", F.col("pod")))
    e2 = F.when(src == "infra_pod", F.col("pod")).otherwise(F.lit(""))
    t = samples.select("uuid", "period", "source", e1.alias("e1"), e2.alias("e2"), "metric", "value")
    t = t.where(F.col("e1").isNotNull() & F.col("e2").isNotNull())
    if node_whitelist is not None:
        t = t.where((src != "node") | F.col("e1").isin(*node_whitelist))
    if pod_whitelist is not None:
        t = t.where((src != "infra_pod") | F.col("e2").isin(*pod_whitelist))
    return t
