"""Views built from the driver tables, identically in Spark and in DuckDB SQL.

The reference reads incident CSVs plus hourly log / trace Parquet and metric
Parquet. The test tables are a generic star schema plus an ``events``
stream, so each telemetry view is *derived* from ``events`` (its work grows
with the table). Each Spark builder has a SQL twin below it; the oracle
queries are written on top of the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.numeric import floor_div
from faultlens.functions.time import NS_PER_DAY, NS_PER_HOUR, epoch_ns, local_time
from faultlens.operators.interval import cut
from faultlens.operators.metrics import DB_METRICS, NODE_METRICS, POD_METRICS, SERVICE_METRICS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# ---------------------------------------------------------------- fixed values
# Services derived from event_id, pods from (service, user_id), nodes from user_id.
SERVICES = ("frontend", "cartservice", "redis", "checkoutservice")
POD_PREFIX = {"redis": "redis-cart"}
PODS_PER_SERVICE = 3
NODES = ("node-01", "node-02", "node-03")
# Texts appended to error events (chosen by event_id % 7 % 4).
ERROR_TEXTS = (
    "failed to get cart: code = Unavailable",
    "rpc error: code = DeadlineExceeded desc = context deadline exceeded",
    "java.lang.NullPointerException at ad_service.get_ads(line 42)",
    "connection refused while dialing redis-cart:6379",
)
# Text appended to every 11th purchase event (an error keyword on a non-error type).
RETRY_TEXT = "payment retry after TimeoutException"
ERROR_STATUS_CODE = "13"
# Incident layout: first fault 2 days after the first event's day, one every
# 3 days, each 24 hours long, as long as it ends before the last event.
INCIDENT_FIRST_DAY = 2
INCIDENT_EVERY_DAYS = 3
INCIDENT_LENGTH_NS = 24 * NS_PER_HOUR
# Parameters scaled to the sparse test stream (defaults are 30 s / 10 min / 40 min).
FIXTURE_WINDOW_NS = NS_PER_HOUR
FIXTURE_GAP_NS = 2 * NS_PER_HOUR
FIXTURE_AFTER_NS = 24 * NS_PER_HOUR
FIXTURE_LONG_AFTER_NS = 5 * NS_PER_DAY      # reaches over the next fault
# Whitelists used by the fixture node / pod queries.
NODE_WHITELIST = ("node-01", "node-02")
POD_WHITELIST = tuple(
    f"{POD_PREFIX.get(s, s)}-{k}" for s in SERVICES for k in range(PODS_PER_SERVICE)
    if (s, k) != ("checkoutservice", 2))


def component_services() -> tuple[str, ...]:
    """Services of the component list, as pods are named after them."""
    return tuple(POD_PREFIX.get(s, s) for s in SERVICES)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ dimensions
def _service(event_id):
    idx = (event_id / 2).cast("long") % len(SERVICES)
    return F.element_at(F.array(*[F.lit(s) for s in SERVICES]), (idx + 1).cast("int"))


def _pod(service, user_id):
    prefix = service
    for s, p in POD_PREFIX.items():
        prefix = F.when(service == s, F.lit(p)).otherwise(prefix)
    return F.concat(prefix, F.lit("-"), (user_id % PODS_PER_SERVICE).cast("string"))


def _node(user_id):
    return F.concat(F.lit("node-0"), (F.lit(1) + user_id % len(NODES)).cast("string"))


def _dims(events: DataFrame) -> DataFrame:
    e = events
    svc = _service(F.col("event_id"))
    return e.select(
        "event_id", "user_id", "event_type", "value", "props",
        epoch_ns(F.col("ts"), e.schema["ts"].dataType).alias("timestamp_ns"),
        svc.alias("service"),
    ).select("*", _pod(F.col("service"), F.col("user_id")).alias("pod"),
             _node(F.col("user_id")).alias("node"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


DIMS_SQL = f"""
SELECT event_id, user_id, event_type, value, props,
       epoch_us(ts) * 1000 AS timestamp_ns,
       {_sql_list(SERVICES)}[((event_id // 2) % {len(SERVICES)}) + 1] AS service
FROM events
"""

DIMS2_SQL = f"""
SELECT d.*,
       CASE {' '.join(f"WHEN service = '{s}' THEN '{p}'" for s, p in POD_PREFIX.items())} ELSE service END
         || '-' || CAST(user_id % {PODS_PER_SERVICE} AS VARCHAR) AS pod,
       'node-0' || CAST(1 + user_id % {len(NODES)} AS VARCHAR) AS node
FROM ({DIMS_SQL}) d
"""


# ------------------------------------------------------------------- incidents
def incidents_from_events(events: DataFrame) -> DataFrame:
    """Fault windows laid over the event stream's time range (S1 stand-in).

    Columns: uuid, seq (row order), start_timestamp, end_timestamp (ns,
    inclusive), start_time_hour, date.
    """
    ns = epoch_ns(F.col("ts"), events.schema["ts"].dataType)
    b = events.agg(F.min(ns).alias("t_min"), F.max(ns).alias("t_max"))
    day = F.lit(NS_PER_DAY)
    t0 = floor_div(F.col("t_min"), NS_PER_DAY) * day
    first = t0 + F.lit(INCIDENT_FIRST_DAY * NS_PER_DAY)
    every = F.lit(INCIDENT_EVERY_DAYS * NS_PER_DAY)
    n = F.floor((F.col("t_max") - first - F.lit(INCIDENT_LENGTH_NS)) / every).cast("long") + 1
    seqs = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    i = b.select(first.alias("first"), F.explode(seqs).alias("seq"))
    start = F.col("first") + F.col("seq") * every
    out = i.select(
        F.concat(F.lit("case-"), F.col("seq").cast("string")).alias("uuid"),
        F.col("seq"),
        start.alias("start_timestamp"),
        (start + F.lit(INCIDENT_LENGTH_NS)).alias("end_timestamp"),
    )
    lt = local_time(F.col("start_timestamp"), 0)
    # tiny and read by several joins (each interval join sizes it): materialise once
    return cut(out.select("*", F.date_format(lt, "yyyy-MM-dd_HH").alias("start_time_hour"),
                            F.date_format(lt, "yyyy-MM-dd").alias("date")))


def overlapping_faults(incidents: DataFrame) -> DataFrame:
    """The incidents with neighbours swapped in row order, so that normal periods span other faults."""
    return incidents.withColumn("seq", F.col("seq") + 1 - 2 * (F.col("seq") % 2))


OVERLAPPING_SQL = "SELECT uuid, seq + 1 - 2 * (seq % 2) AS seq, start_timestamp, end_timestamp FROM incidents"


INCIDENTS_SQL = f"""
SELECT 'case-' || CAST(seq AS VARCHAR) AS uuid, seq,
       first + seq * {INCIDENT_EVERY_DAYS * NS_PER_DAY} AS start_timestamp,
       first + seq * {INCIDENT_EVERY_DAYS * NS_PER_DAY} + {INCIDENT_LENGTH_NS} AS end_timestamp,
       strftime(make_timestamp((first + seq * {INCIDENT_EVERY_DAYS * NS_PER_DAY}) // 1000), '%Y-%m-%d_%H') AS start_time_hour,
       strftime(make_timestamp((first + seq * {INCIDENT_EVERY_DAYS * NS_PER_DAY}) // 1000), '%Y-%m-%d') AS date
FROM (
  SELECT first, unnest(range(0, CAST(floor((t_max - first - {INCIDENT_LENGTH_NS}) / {INCIDENT_EVERY_DAYS * NS_PER_DAY}) AS BIGINT) + 1)) AS seq
  FROM (SELECT CAST(floor(min(epoch_us(ts)) * 1000 / {NS_PER_DAY}) AS BIGINT) * {NS_PER_DAY} + {INCIDENT_FIRST_DAY * NS_PER_DAY} AS first,
               max(epoch_us(ts)) * 1000 AS t_max FROM events) b
) s
"""


# ------------------------------------------------------------------------ logs
def logs_from_events(events: DataFrame) -> DataFrame:
    """Log records (schema LOGS) derived from events."""
    d = _dims(events)
    texts = F.array(*[F.lit(t) for t in ERROR_TEXTS])
    extra = (F.when(F.col("event_type") == "error",
                    F.element_at(texts, ((F.col("event_id") % 7) % 4 + 1).cast("int")))
             .when((F.col("event_type") == "purchase") & (F.col("event_id") % 11 == 0), F.lit(RETRY_TEXT)))
    msg = F.concat_ws(" ", F.col("event_type"), F.concat(F.lit("user="), F.col("user_id").cast("string")),
                      F.concat(F.lit("k="), F.col("props")), extra)
    return d.select(
        "timestamp_ns",
        F.date_format(local_time(F.col("timestamp_ns")), "yyyy-MM-dd HH:mm:ss").alias("time_beijing"),
        F.col("pod").alias("k8_pod"),
        F.col("node").alias("k8_node_name"),
        msg.alias("message"),
    )


LOGS_SQL = f"""
SELECT timestamp_ns,
       strftime(make_timestamp(timestamp_ns // 1000 + CAST(8 * 3600 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS time_beijing,
       pod AS k8_pod, node AS k8_node_name,
       concat_ws(' ', event_type, 'user=' || CAST(user_id AS VARCHAR), 'k=' || props,
                 CASE WHEN event_type = 'error' THEN {_sql_list(ERROR_TEXTS)}[(event_id % 7) % 4 + 1]
                      WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN '{RETRY_TEXT}' END) AS message
FROM ({DIMS2_SQL}) d
"""


# ----------------------------------------------------------------------- spans
def spans_from_events(events: DataFrame) -> DataFrame:
    """Nested spans (schema SPANS) derived from events.

    spanID = event_id; duration = value as integer microseconds; parent = event_id - 1 (none when event_id % 8 = 0, two
    references - hence no parent - when event_id % 8 = 4);
    status.code 13 for errors else 0 (a trailing duplicate code '2' when
    event_id % 17 = 0); status.message = props (missing when event_id % 13 = 0).
    """
    d = _dims(events)
    eid = F.col("event_id")
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    pod_key = F.when(F.col("user_id") % 5 == 0, F.lit("podName")).otherwise(F.lit("name"))
    node_key = F.when(F.col("user_id") % 7 == 0, F.lit("nodeName")).otherwise(F.lit("node_name"))
    process = F.struct(
        F.col("service").alias("serviceName"),
        F.array(F.struct(F.lit("ip").alias("key"), F.lit("10.0.0.1").alias("value")),
                F.struct(pod_key.alias("key"), F.col("pod").alias("value")),
                F.struct(node_key.alias("key"), F.col("node").alias("value"))).alias("tags"),
    )
    ref = lambda k: F.struct((eid - k).cast("string").alias("spanID"))
    references = (F.when(eid % 8 == 0, F.array().cast("array<struct<spanID:string>>"))
                  .when(eid % 8 == 4, F.array(ref(1), ref(2)))
                  .otherwise(F.array(ref(1))))
    code = F.when(F.col("event_type") == "error", F.lit(ERROR_STATUS_CODE)).otherwise(F.lit("0"))
    tags = F.array(tag("span.kind", F.lit("server")), tag("status.code", code))
    tags = F.when(eid % 13 == 0, tags).otherwise(F.concat(tags, F.array(tag("status.message", F.col("props")))))
    tags = F.when(eid % 17 == 0, F.concat(tags, F.array(tag("status.code", F.lit("2"))))).otherwise(tags)
    op = F.when(F.col("event_type").isin("view", "click"), F.lit("read")).otherwise(F.lit("write"))
    return d.select(
        "timestamp_ns",
        eid.cast("string").alias("spanID"),
        op.alias("operationName"),
        F.floor(F.col("value") * 1000 + 0.5).cast("long").alias("duration"),
        process.alias("process"),
        references.alias("references"),
        tags.alias("tags"),
    )


SPANS_FLAT_SQL = f"""
SELECT timestamp_ns, CAST(event_id AS VARCHAR) AS spanID,
       CASE WHEN event_id % 8 = 0 OR event_id % 8 = 4 THEN NULL ELSE CAST(event_id - 1 AS VARCHAR) END AS parent_spanID,
       pod AS child_pod, service AS service_name, node AS node_name,
       CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'write' END AS operationName,
       CAST(floor(value * 1000 + 0.5) AS BIGINT) AS duration,
       CASE WHEN event_id % 17 = 0 THEN '2' WHEN event_type = 'error' THEN '{ERROR_STATUS_CODE}' ELSE '0' END AS status_code,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE props END AS status_message,
       event_id % 13 <> 0 AS has_status_message
FROM ({DIMS2_SQL}) d
"""


# ----------------------------------------------------------------- call chains
def spans_from_conversations(conv: DataFrame) -> DataFrame:
    """Nested spans from conversations: (conv_id, turn) is a span, (conv_id,
    turn - 1) its parent, the role its service; pod = role-{conv_id % 3},
    node = node-0{1 + conv_id % 3}; the turn orders spans in time."""
    sid = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    pod = F.concat(F.col("role"), F.lit("-"), (F.col("conv_id") % 3).cast("string"))
    node = F.concat(F.lit("node-0"), (F.lit(1) + F.col("conv_id") % 3).cast("string"))
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    refs = F.when(F.col("turn") > 0, F.array(F.struct(sid(F.col("turn") - 1).alias("spanID")))).otherwise(
        F.array().cast("array<struct<spanID:string>>"))
    return conv.select(
        F.col("turn").cast("long").alias("timestamp_ns"), sid(F.col("turn")).alias("spanID"),
        F.lit("reply").alias("operationName"), F.octet_length("text").cast("long").alias("duration"),
        F.struct(F.col("role").alias("serviceName"),
                 F.array(tag("name", pod), tag("node_name", node)).alias("tags")).alias("process"),
        refs.alias("references"), F.array().cast("array<struct<key:string,value:string>>").alias("tags"))


def conversation_window(conv: DataFrame) -> DataFrame:
    """One window covering every turn (scope ``conversations``)."""
    return conv.agg(F.lit("conversations").alias("uuid"), F.min("turn").cast("long").alias("start_timestamp"),
                    F.max("turn").cast("long").alias("end_timestamp"))


CONV_SPANS_SQL = """
SELECT CAST(turn AS BIGINT) AS timestamp_ns, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS spanID,
       CASE WHEN turn > 0 THEN CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR) END AS parent_spanID,
       role || '-' || CAST(conv_id % 3 AS VARCHAR) AS child_pod, role AS service_name
FROM conversations
"""


# --------------------------------------------------------------------- metrics
def metric_points_from_events(events: DataFrame) -> DataFrame:
    """Tall metric samples: one row per event, metric = event type, value in
    integer hundredths (sums are exact in any order, so engines agree to the
    last bit). Every 97th value is null (exercises the null drop).
    """
    d = _dims(events)
    v = F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("double")).otherwise(
        F.floor(F.col("value") * 100 + 0.5).cast("double"))
    return d.select("service", "pod", "node", F.col("event_type").alias("metric"),
                    "timestamp_ns", v.alias("value"))


def tag_sources(samples: DataFrame, sources=("node", "infra_pod", "tidb", "service", "pod")) -> DataFrame:
    """Fan each fixture sample out to the five metric sources it stands for:
    node (node), infra_pod (node, pod), tidb (service), service (service),
    pod (pod); the node and infra_pod sources keep only whitelisted entities."""
    e = lambda src, a, b: F.struct(F.lit(src).alias("source"), a.alias("e1"), b.alias("e2"))
    none = F.lit("")
    keys = {"node": (F.col("node"), none), "infra_pod": (F.col("node"), F.col("pod")),
            "tidb": (F.col("service"), none), "service": (F.col("service"), none), "pod": (F.col("pod"), none)}
    t = samples.select("uuid", "period", "metric", "value", F.explode(F.array(
        *[e(src, *keys[src]) for src in sources])).alias("t")).select("uuid", "period", "t.*", "metric", "value")
    return t.where(F.col("e1").isNotNull() & F.col("e2").isNotNull()
                   & ((F.col("source") != "node") | F.col("e1").isin(*NODE_WHITELIST))
                   & ((F.col("source") != "infra_pod") | F.col("e2").isin(*POD_WHITELIST)))


METRIC_POINTS_SQL = f"""
SELECT service, pod, node, event_type AS metric, timestamp_ns,
       CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(floor(value * 100 + 0.5) AS DOUBLE) END AS value
FROM ({DIMS2_SQL}) d
"""

# --------------------------------------------------------------------- answers
def answers_from_documents(docs: DataFrame) -> DataFrame:
    """``uuid, answer_text``: a diagnosis text per document, of a kind by doc_id: whole, cut off, nested, none, several
    objects, a missing field, wrong types, steps that are no objects. The document's whole text is the reason."""
    text = F.col("text")
    comp = F.concat(F.lit("pod-"), F.col("doc_id").cast("string")).alias("component")
    step = lambda n, obs: F.struct(F.lit(n).alias("step"), F.lit("Check").alias("action"), obs.alias("observation"))
    full = F.to_json(F.struct(comp, F.lit("other").alias("uuid"), text.alias("reason"), F.array(step(1, F.col("lang")), step(2, text)).alias("reasoning_trace")))
    nested = F.to_json(F.struct(F.struct(F.struct(F.lit("}{").alias("b")).alias("a")).alias("detail"), comp, text.alias("reason"),
                                F.array(step(1, F.lit("a { b \" c"))).alias("reasoning_trace")))
    mixed = F.concat(F.lit('{"reasoning_trace": [7, '), F.to_json(step(1, text)), F.lit(', "x", {"step": 2}, null], "component": "c"}'))
    kinds = [F.concat(F.lit("Done.\n```json\n"), full, F.lit("\n```\nAPPROVE")), F.concat(F.lit("cut: "), F.substring(full, F.lit(1), F.length(full) - 1)),
             F.concat(nested, F.lit(" \"quoted")), F.concat(F.lit("no result "), F.translate(text, "{}", "()")),
             F.concat(F.lit("say \" first {not json} then "), full, F.lit(" or {\"x\": 1} {")), F.to_json(F.struct(text.alias("reason"))),
             F.lit('{"component": 5, "reason": {"a": 1}, "reasoning_trace": "none"}'), mixed]
    k = F.col("doc_id") % len(kinds)
    answer = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        answer = F.when(k == i, kind).otherwise(answer)
    return docs.select(F.col("doc_id").cast("string").alias("uuid"), answer.alias("answer_text"))


_W20 = "array_to_string(string_split({}, ' ')[1:20], ' ')"
ANSWERS_SQL = f"""
SELECT CAST(doc_id AS VARCHAR) AS uuid, CASE k WHEN 0 THEN 'pod-' || doc_id WHEN 2 THEN 'pod-' || doc_id WHEN 4 THEN 'pod-' || doc_id
         WHEN 7 THEN 'c' ELSE '' END AS component,
       CASE WHEN k IN (0, 2, 4, 5) THEN coalesce({_W20.format('text')}, '') ELSE '' END AS reason,
       CAST(CASE k WHEN 0 THEN 2 WHEN 4 THEN 2 WHEN 2 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS INTEGER) AS n_steps,
       CASE WHEN k IN (0, 4) THEN concat_ws(':', '1', 'Check', lang) || '|' || concat_ws(':', '2', 'Check', {_W20.format('text')})
         WHEN k = 2 THEN '1:Check:a {{ b " c' WHEN k = 7 THEN concat_ws(':', '1', 'Check', {_W20.format('text')}) || '|2' ELSE '' END AS steps_text
FROM (SELECT *, doc_id % 8 AS k FROM documents) d
"""


# -------------------------------------------------------------------- raw layout
# Metric catalogues in the order that event_id % n counts through.
DB_METRIC_LIST = tuple((s, m) for s, ms in DB_METRICS.items() for m in ms)
DB_PREFIXES = {"tidb-tidb": "infra_tidb", "tidb-pd": "infra_pd", "tidb-tikv": "infra_tikv"}


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def write_raw_logs(events: DataFrame, root: str, kind: str = "log") -> None:
    """Hourly files of log records or spans (``kind`` ``trace``), named by local hour. Spans of even hours hold their
    duration as bigint, of odd hours as double."""
    rows = logs_from_events(events) if kind == "log" else spans_from_events(events)
    hour = F.date_format(local_time(F.col("timestamp_ns")), "yyyy-MM-dd_HH")
    rows = rows.withColumn("hour", hour).repartition("hour")
    if kind == "log":
        rows.write.partitionBy("hour").parquet(f"{root}/all/log-parquet")
        return
    even = floor_div(F.col("timestamp_ns"), NS_PER_HOUR) % 2 == 0
    rows.where(even).write.partitionBy("hour").parquet(f"{root}/all/trace-parquet")
    rows.where(~even).withColumn("duration", F.col("duration").cast("double")).write.mode("append").partitionBy("hour").parquet(
        f"{root}/all/trace-parquet")


def write_raw_metrics(events: DataFrame, root: str) -> None:
    """Every metric source, one folder per (metric or entity, local date); values as double, decimal, bigint or int."""
    d = _dims(events)
    eid = F.col("event_id")
    v = F.when(eid % 97 != 0, F.floor(F.col("value") * 100 + 0.5).cast("double"))
    day = F.date_format(local_time(F.col("timestamp_ns")), "yyyy-MM-dd")
    d = d.select("event_id", "service", "pod", "node", "timestamp_ns", v.alias("v"), day.alias("date"))

    def write(rows: DataFrame, sub: str, name, value_columns, keys, cast: str) -> None:
        file = F.concat(name, F.lit("_"), F.col("date"), F.lit(".parquet"))
        rows.select(file.alias("file"), "timestamp_ns", *keys, *[c.cast(cast).alias(n) for n, c in value_columns.items()]
                    ).repartition("file").write.mode("append").partitionBy("file").parquet(f"{root}/all/metric-parquet/{sub}")

    wide = {m: F.when(eid % len(SERVICE_METRICS) == k, F.col("v")) for k, m in enumerate(SERVICE_METRICS)}
    write(d, "apm/service", F.concat(F.lit("svc_"), F.col("service")), wide, [], "double")
    write(d, "apm/pod", F.concat(F.lit("pod_"), F.col("pod")), wide, [], "decimal(18,2)")
    for sub, prefix, keys, metrics, cast in (
            ("infra/infra_node", "infra_node", [F.col("node").alias("kubernetes_node")], NODE_METRICS, "double"),
            ("infra/infra_pod", "infra_pod", [F.col("node").alias("instance"), "pod"], POD_METRICS, "bigint")):
        cols = {m: F.when(eid % len(metrics) == k, F.col("v")) for k, m in enumerate(metrics)}
        write(d, sub, F.concat(F.lit(f"{prefix}_"), _pick(metrics, eid)), cols, keys, cast)
    names = sorted({m for _, m in DB_METRIC_LIST})
    for sub, services, cast in (("infra/infra_tidb", ("tidb-tidb",), "int"), ("other", ("tidb-pd", "tidb-tikv"), "bigint")):
        own = _pick([s for s, _ in DB_METRIC_LIST], eid)
        metric = _pick([m for _, m in DB_METRIC_LIST], eid)
        prefix = F.element_at(F.create_map(*[F.lit(x) for kv in DB_PREFIXES.items() for x in kv]), own)
        cols = {m: F.when(metric == m, F.col("v")) for m in names}
        write(d.where(own.isin(*services)), sub, F.concat(prefix, F.lit("_"), metric), cols, [], cast)


_RAW_V = "CASE WHEN event_id % 97 <> 0 THEN CAST(floor(value * 100 + 0.5) AS DOUBLE) END"
RAW_METRICS_SQL = f"""
SELECT * FROM (
  SELECT 'service' AS source, service, CAST(NULL AS VARCHAR) AS pod, CAST(NULL AS VARCHAR) AS node,
         {_sql_list(SERVICE_METRICS)}[event_id % {len(SERVICE_METRICS)} + 1] AS metric, timestamp_ns, {_RAW_V} AS value FROM ({DIMS2_SQL}) a
  UNION ALL SELECT 'pod', NULL, pod, NULL, {_sql_list(SERVICE_METRICS)}[event_id % {len(SERVICE_METRICS)} + 1], timestamp_ns, {_RAW_V} FROM ({DIMS2_SQL}) a
  UNION ALL SELECT 'node', NULL, NULL, node, {_sql_list(NODE_METRICS)}[event_id % {len(NODE_METRICS)} + 1], timestamp_ns, {_RAW_V} FROM ({DIMS2_SQL}) a
  UNION ALL SELECT 'infra_pod', NULL, pod, node, {_sql_list(POD_METRICS)}[event_id % {len(POD_METRICS)} + 1], timestamp_ns, {_RAW_V} FROM ({DIMS2_SQL}) a
  UNION ALL SELECT 'tidb', {_sql_list([s for s, _ in DB_METRIC_LIST])}[event_id % {len(DB_METRIC_LIST)} + 1], NULL, NULL,
    {_sql_list([m for _, m in DB_METRIC_LIST])}[event_id % {len(DB_METRIC_LIST)} + 1], timestamp_ns, {_RAW_V} FROM ({DIMS2_SQL}) a
) m WHERE value IS NOT NULL
"""


def local_names(incidents: DataFrame) -> DataFrame:
    """The incidents with hour and date as the raw layout's local names have them."""
    lt = local_time(F.col("start_timestamp"))
    return incidents.withColumns({"start_time_hour": F.date_format(lt, "yyyy-MM-dd_HH"), "date": F.date_format(lt, "yyyy-MM-dd")})


# Wide metric frame from lineitem: entity = supplier, sample time = ship date.
WIDE_METRIC_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def wide_metrics_from_lineitem(lineitem: DataFrame) -> DataFrame:
    ts = epoch_ns(F.col("l_shipdate"), lineitem.schema["l_shipdate"].dataType)
    return lineitem.select(F.col("l_suppkey").cast("string").alias("entity"), ts.alias("timestamp_ns"),
                           *WIDE_METRIC_COLUMNS)


WIDE_METRICS_SQL = f"""
SELECT CAST(l_suppkey AS VARCHAR) AS entity, epoch_us(l_shipdate) * 1000 AS timestamp_ns,
       {', '.join(WIDE_METRIC_COLUMNS)}
FROM lineitem
"""


def views_sql() -> str:
    """``WITH`` prefix that defines every fixture view for an oracle query."""
    return (f"WITH incidents AS ({INCIDENTS_SQL}),\n"
            f"logs AS ({LOGS_SQL}),\n"
            f"spans AS ({SPANS_FLAT_SQL}),\n"
            f"metric_points AS ({METRIC_POINTS_SQL}),\n"
            f"wide_metrics AS ({WIDE_METRICS_SQL})\n")
