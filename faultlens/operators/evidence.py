"""Incident-level evidence and attribution.

R2 + J9  evidence bundle: one row per incident with a CSV section per
         non-empty modality (logs, traces, metrics) and the modality list.
R3 + R4  fault-level attribution: node / service / pod decided by rules over
         the affected pods, restricted to known components.
R6 X12 X13  result records: JSON answer text -> parsed record.

Evidence is kept as rows (``evidence_lines``); the bundle joins an incident's
rows to one text per section for those who read the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.functions.text import balanced_objects, extract_json_object, first_words

# Modality names in the evidence text, their order and separator.
MODALITY_NAMES = ("日志数据", "链路追踪数据", "系统指标数据")   # logs, traces, metrics
MODALITY_SEPARATOR = "、"
# Fault levels in priority order.
LEVELS = ("node", "service", "pod")
REASON_WORDS = 20

LOG_SECTION_COLUMNS = ("node_name", "service_name", "pod_name", "message", "occurrence_count")
TRACE_SECTION_COLUMNS = ("node_name", "service_name", "parent_pod", "child_pod", "operation_name",
                         "normal_avg_duration", "anomaly_avg_duration", "anomaly_count_text")
STATUS_SECTION_COLUMNS = ("node_name", "service_name", "parent_pod", "child_pod", "operation_name",
                          "status_code", "status_message", "occurrence_text")
METRIC_SECTION_COLUMNS = ("source", "entity", "metric", "normal_mean", "fault_mean", "mean_ratio")


# --------------------------------------------------------------------- CSV
def csv_field(c: Column, fmt_double: bool = False) -> Column:
    """One CSV field: doubles as %.6f, null as empty, quoted when needed."""
    s = F.when(c.isNotNull(), F.format_string("%.6f", c)) if fmt_double else c.cast("string")
    s = F.coalesce(s, F.lit(""))
    needs = s.contains(",") | s.contains('"') | s.contains("\n") | s.contains("\r")
    return F.when(needs, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_line(df: DataFrame, columns: Sequence[str]) -> Column:
    dtypes = dict(df.dtypes)
    return F.concat_ws(",", *[csv_field(F.col(c), dtypes[c] == "double") for c in columns])


def section_rows(df: DataFrame, columns: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``uuid, section, position, line``: a modality's lines, the header at position 0. Positions follow ``order``."""
    at = F.row_number().over(Window.partitionBy("uuid").orderBy(*order))
    lines = df.select("uuid", F.lit(name).alias("section"), at.alias("position"), csv_line(df, columns).alias("line"))
    heads = df.select("uuid").distinct().select("uuid", F.lit(name).alias("section"), F.lit(0).alias("position"), F.lit(",".join(columns)).alias("line"))
    return heads.unionByName(lines)


def metric_shift_rows(node: DataFrame, pod: DataFrame, service: DataFrame, db: DataFrame | None = None) -> DataFrame:
    """Shifted metrics of every source, and all database metrics (they have no gate), in one frame
    (source, entity, metric, means, ratio)."""
    def pick(df, source, entity):
        return df.select("uuid", F.lit(source).alias("source"), entity.alias("entity"), "metric",
                         F.col("normal_mean"), F.col("fault_mean"), F.col("mean_ratio"))
    out = (pick(node, "node", F.col("node"))
           .unionByName(pick(pod, "pod", F.concat_ws("/", "instance", "pod")))
           .unionByName(pick(service, "service", F.concat_ws("/", "service", "pod"))))
    return out if db is None else out.unionByName(pick(db, "tidb", F.col("service")))


# ---------------------------------------------------------------------- R2
def evidence_lines(log_rollup: DataFrame, trace_topk: DataFrame, status: DataFrame, metric_rows: DataFrame) -> DataFrame:
    """R2 as rows: ``uuid, section, position, line`` of every modality. No incident's evidence is one value, so a huge
    one stays many rows; :func:`evidence_bundle` joins them to texts for those who read the whole."""
    parts = [section_rows(log_rollup, LOG_SECTION_COLUMNS, [F.desc("occurrence_count"), F.col("pod_name"), F.col("node_name"), F.col("message")], "log"),
             section_rows(trace_topk, TRACE_SECTION_COLUMNS, [F.col("rank")], "trace"),
             section_rows(status, STATUS_SECTION_COLUMNS, [F.col("rank")], "status"),
             section_rows(metric_rows, METRIC_SECTION_COLUMNS, [F.col("source"), F.col("entity"), F.col("metric")], "metric")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evidence_bundle(log_rollup: DataFrame, trace_topk: DataFrame, status: DataFrame,
                    metric_rows: DataFrame) -> DataFrame:
    """R2 + J9: one row per incident with the non-empty sections (one grouping over the evidence's rows)."""
    lines = evidence_lines(log_rollup, trace_topk, status, metric_rows)
    section = F.col("section")

    def text(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(section == name, F.struct("position", "line"))))
        joined = F.array_join(F.transform(rows, lambda x: x["line"]), "\n")
        return F.when(F.count_if(section == name) > 0, joined)

    def count(name: str) -> Column:
        return F.count_if((section == name) & (F.col("position") > 0)).cast("long")

    b = lines.groupBy("uuid").agg(*[text(n).alias(f"_{n}") for n in ("log", "trace", "status", "metric")],
                                  *[count(n).alias(f"n_{n}_rows") for n in ("log", "trace", "status", "metric")])
    trace_text = F.concat_ws("\n", F.col("_trace"), F.col("_status"))
    has = [F.col("n_log_rows") > 0, (F.col("n_trace_rows") + F.col("n_status_rows")) > 0, F.col("n_metric_rows") > 0]
    modalities = F.concat_ws(MODALITY_SEPARATOR, *[F.when(h, F.lit(n)) for h, n in zip(has, MODALITY_NAMES)])
    return b.select("uuid", modalities.alias("modalities"), "n_log_rows", "n_trace_rows", "n_status_rows", "n_metric_rows",
                    F.col("_log").alias("log_section"), F.when(trace_text != "", trace_text).alias("trace_section"),
                    F.col("_metric").alias("metric_section"))


# ---------------------------------------------------------------------- R3
def service_of_pod(pod: Column) -> Column:
    """Component service of a pod: the name without its trailing ``-<n>``."""
    return F.regexp_replace(pod, r"-[0-9]+$", "")


def affected_pods(log_rollup: DataFrame, status: DataFrame, pod_shift: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Evidence rows (uuid, pod, node, source) from logs, failing calls, shifted pod metrics and anomalous call edges.

    ``status``: all counted combinations (``status_counts``), not the report's top rows; ``edges``: all anomalous ones
    (uuid, child_pod, node_name)."""
    a = log_rollup.select("uuid", F.col("pod_name").alias("pod"), F.col("node_name").alias("node"),
                          F.lit("log").alias("source"))
    b = status.where(F.col("child_pod") != "N/A").select(
        "uuid", F.col("child_pod").alias("pod"),
        F.when(F.col("node_name") != "N/A", F.col("node_name")).alias("node"), F.lit("trace").alias("source"))
    c = pod_shift.where(F.col("status") == "shifted").select(
        "uuid", "pod", F.col("instance").alias("node"), F.lit("metric").alias("source"))
    out = a.unionByName(b).unionByName(c)
    if edges is not None:
        out = out.unionByName(edges.select("uuid", F.col("child_pod").alias("pod"), F.col("node_name").alias("node"), F.lit("edge").alias("source")))
    return out.where(F.col("pod").isNotNull())


def fault_level(evidence: DataFrame, node_shift: DataFrame, components: DataFrame) -> DataFrame:
    """R3 + R4: one (level, component) per incident.

    node:    the node's own metrics shifted AND pods of >= 2 services on it are affected;
    service: >= 2 pods of one service are affected;
    pod:     the only affected pod of its service.
    Priority node > service > pod, then score, then name. Metrics with a
    missing period never count (only ``shifted`` rows do).
    """
    ev = evidence.withColumn("service", service_of_pod(F.col("pod")))
    shifted_nodes = node_shift.where(F.col("status") == "shifted").select("uuid", "node").distinct()
    node_c = (ev.where(F.col("node").isNotNull()).groupBy("uuid", "node")
              .agg(F.countDistinct("service").alias("score"))
              .where(F.col("score") >= 2)
              .join(shifted_nodes, ["uuid", "node"], "left_semi")
              .select("uuid", F.lit("node").alias("level"), F.col("node").alias("component"), "score"))
    per_pod = ev.groupBy("uuid", "service", "pod").agg(F.count(F.lit(1)).alias("n_evidence"))
    per_svc = per_pod.groupBy("uuid", "service").agg(
        F.count(F.lit(1)).alias("n_pods"), F.max_by("pod", F.struct("n_evidence", "pod")).alias("pod"),
        F.max("n_evidence").alias("n_evidence"))
    svc_c = per_svc.where(F.col("n_pods") >= 2).select(
        "uuid", F.lit("service").alias("level"), F.col("service").alias("component"), F.col("n_pods").alias("score"))
    pod_c = per_svc.where(F.col("n_pods") == 1).select(
        "uuid", F.lit("pod").alias("level"), F.col("pod").alias("component"), F.col("n_evidence").alias("score"))
    cand = node_c.unionByName(svc_c).unionByName(pod_c)
    cand = cand.join(components.select("level", "component"), ["level", "component"], "left_semi")
    prio = F.when(F.col("level") == "node", 1).when(F.col("level") == "service", 2).otherwise(3)
    w = Window.partitionBy("uuid").orderBy(prio, F.desc("score"), "component")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == 1)
            .select("uuid", "level", "component", F.col("score").cast("long").alias("score")))


def component_list(spark: SparkSession, nodes: Sequence[str] = (), services: Sequence[str] = (), pods: Sequence[str] = ()) -> DataFrame:
    """R4 dimension from given names: ``level, component``."""
    rows = [("node", n) for n in nodes] + [("service", n) for n in services] + [("pod", n) for n in pods]
    return spark.createDataFrame(rows, "level string, component string").distinct()


def components_from(points: DataFrame) -> DataFrame:
    """R4 dimension where no list is given: every node, service and pod seen in the telemetry (one pass)."""
    own = F.array(*[F.struct(F.lit(level).alias("level"), c.alias("component")) for level, c in (
        ("node", F.col("node")), ("service", service_of_pod(F.col("pod"))), ("pod", F.col("pod")))])
    return points.select("node", "pod").distinct().select(F.explode(own).alias("c")).select("c.level", "c.component").where(
        F.col("component").isNotNull()).distinct()


# ---------------------------------------------------------------------- R6
def result_records(attribution: DataFrame, evidence: DataFrame) -> DataFrame:
    """Final record per incident (component, uuid, reason, reasoning_trace)
    as JSON answer text, the way a diagnosis step would return it."""
    src = (evidence.withColumn("service", service_of_pod(F.col("pod")))
           .groupBy("uuid", "source").agg(F.countDistinct("pod").alias("n_pods")))
    steps = src.groupBy("uuid").agg(F.array_sort(F.collect_list(F.struct("source", "n_pods"))).alias("s"))
    r = attribution.join(steps, "uuid", "left")
    trace = F.transform(F.coalesce(F.col("s"), F.array().cast("array<struct<source:string,n_pods:bigint>>")),
                        lambda x, i: F.struct((i + 1).cast("int").alias("step"),
                                              F.concat(F.initcap(x["source"]), F.lit("Check(all)")).alias("action"),
                                              F.concat(x["n_pods"].cast("string"), F.lit(" pods affected in "),
                                                       x["source"], F.lit(" evidence")).alias("observation")))
    reason = F.concat(F.col("level"), F.lit(" level fault at "), F.col("component"), F.lit(" with score "),
                      F.col("score").cast("string"))
    rec = F.struct(F.col("component"), F.col("uuid"), reason.alias("reason"), trace.alias("reasoning_trace"))
    text = F.concat(F.lit("Diagnosis finished.\n```json\n"), F.to_json(rec), F.lit("\n```\nAPPROVE"))
    return r.select("uuid", text.alias("answer_text"))


def parse_results(answers: DataFrame, text: str = "answer_text") -> DataFrame:
    """X12 + X13: the answer's JSON object, each field by itself, reason and observations cut to 20 words.

    The object is the text from the first to the last brace; where that is no JSON, the first balanced ``{...}`` that
    parses as an object (:func:`balanced_objects`). A field that is missing or of another type takes its default
    (empty text, empty list) without spoiling the others; steps that are no objects are left out. No object at all
    gives all defaults. The incident's own uuid stands, whatever the answer says.
    """
    def is_object(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

    whole = answers.select(F.col("uuid").alias("_uuid"), F.col(text).alias("_t"), F.try_parse_json(extract_json_object(F.col(text))).alias("_w"))
    parts = F.filter(F.transform(balanced_objects(F.col("_t")), lambda t: F.try_parse_json(t)), is_object)
    p = whole.select("_uuid", F.when(is_object(F.col("_w")), F.col("_w")).otherwise(F.get(parts, F.lit(0))).alias("_o"))

    def string(v: Column, path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))

    steps = F.coalesce(F.try_variant_get(F.col("_o"), "$.reasoning_trace", "array<variant>"), F.array().cast("array<variant>"))
    steps = F.filter(steps, is_object)
    steps = F.transform(steps, lambda v: F.struct(
        F.try_variant_get(v, "$.step", "int").alias("step"), string(v, "$.action").alias("action"),
        first_words(string(v, "$.observation"), REASON_WORDS).alias("observation")))
    return p.select(F.coalesce(string(F.col("_o"), "$.component"), F.lit("")).alias("component"), F.col("_uuid").alias("uuid"),
                    first_words(F.coalesce(string(F.col("_o"), "$.reason"), F.lit("")), REASON_WORDS).alias("reason"),
                    steps.alias("reasoning_trace"))
