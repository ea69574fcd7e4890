"""Log evidence: time + error filter (J1 F1 F2 F3), masking (D3), roll-up per pod (A1 X1 W4) over the templates that
``operators/templates.py`` mines (D1 D2), and the reduction report (A14) from the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from faultlens.functions.text import apply_masks, error_predicate, service_from_pod
from faultlens.functions.time import NS_PER_HOUR
from faultlens.operators.interval import cut, hold, interval_join
from faultlens.operators.templates import (DEPTH, SIM_TH, match_templates, merged, mine_templates,  # noqa: F401
                                           token_lists, tokenize, with_clusters)

# Columns the log path keeps, in order.
LOG_COLUMNS = ("time_beijing", "k8_pod", "message", "k8_node_name")
# Output column order of the log evidence.
ROLLUP_COLUMNS = ("node_name", "service_name", "pod_name", "message", "occurrence_count")

# Masking rules of our own (the reference ships its rule list disabled).
DEFAULT_MASK_RULES = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "UID"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "EMAIL"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "IP"),
    (r"0x[0-9a-fA-F]+", "HEX"),
    (r"[0-9]+", "NUM"),
)


def tolerant_select(df: DataFrame, columns: Sequence[str] | None, keep: Sequence[str] = ()) -> DataFrame | None:
    """keep the requested columns that exist (after ``keep``); ``None`` when none do."""
    if columns is None:
        return df
    valid = [c for c in columns if c in df.columns and c not in keep]
    if not valid:
        return None
    return df.select(*keep, *valid)


def error_logs(logs: DataFrame, incidents: DataFrame, *, bucket_ns: int = NS_PER_HOUR) -> DataFrame:
    """J1 + F1 + F2 + F3: error lines inside each incident's window."""
    w = interval_join(logs, incidents.select("uuid", "start_timestamp", "end_timestamp"),
                      bucket_ns=bucket_ns)
    w = w.where(error_predicate(F.col("message")))
    return tolerant_select(w, LOG_COLUMNS, keep=("uuid", "timestamp_ns"))


def mask_messages(df: DataFrame, column: str = "message", rules=DEFAULT_MASK_RULES) -> DataFrame:
    """D3: ordered regex masking (off in the default pipeline)."""
    return df.withColumn(column, apply_masks(F.col(column), rules))


def _error_lists(w: DataFrame, mask_rules) -> DataFrame:
    """One row per (incident, pod, node, token list) with its count and first line; rows that are no error, if any are
    there, only count, one row per incident. The aggregation combines map-side."""
    text = F.col("message")
    if mask_rules:
        text = apply_masks(text, mask_rules)
    err = F.col("is_error")
    t = tokenize(w, text=text)
    cols = {c: F.when(err, F.col(c)) for c in ("k8_pod", "k8_node_name", "list_id", "bucket_key", "token_text")}
    t = t.withColumns({**cols, "first": F.when(err, F.struct("timestamp_ns", "message"))})
    return t.groupBy("uuid", "is_error", "k8_pod", "k8_node_name", "list_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.min("bucket_key").alias("bucket_key"), F.min("token_text").alias("token_text"))


def _rollup(per: DataFrame, sim_th: float, depth: int) -> DataFrame:
    """D1 D2 A1 X1 from the counted token lists (a stored table)."""
    lists = with_clusters(token_lists(per, ["uuid"], F.col("n")), ["uuid"], sim_th=sim_th, depth=depth)
    # a null pod or node drops out of the group-by (A1), after it has taken part in the mining
    m = per.where(F.col("k8_pod").isNotNull() & F.col("k8_node_name").isNotNull())
    m = m.join(lists.select("uuid", "list_id", F.col("bucket_key").alias("_b"), F.col("cluster").alias("_l")), ["uuid", "list_id"])
    tpl = merged(lists, ["uuid"]).select("uuid", F.col("bucket_key").alias("_b"), F.col("cluster").alias("_l"), F.md5("template").alias("_template"))
    m = m.join(tpl, ["uuid", "_b", "_l"])
    out = m.groupBy("uuid", "k8_pod", "k8_node_name", "_template").agg(F.sum("n").alias("occurrence_count"), F.min("first").alias("first"))
    return out.select("uuid", F.col("k8_node_name").alias("node_name"), service_from_pod(F.col("k8_pod")).alias("service_name"),
                      F.col("k8_pod").alias("pod_name"), F.col("first")["message"].alias("message"),
                      F.col("occurrence_count").cast("long").alias("occurrence_count"))


def log_error_rollup(logs: DataFrame, incidents: DataFrame, *, bucket_ns: int = NS_PER_HOUR, mask_rules=None,
                     sim_th: float = SIM_TH, depth: int = DEPTH) -> DataFrame:
    """Flagship log evidence per incident.

    Output: uuid, node_name, service_name, pod_name, message (first error line of the group by (timestamp, text)),
    occurrence_count. :func:`by_count` puts each incident's rows in the report's order. The counted token lists are held
    until ``interval.release()``.
    """
    w = error_logs(logs, incidents, bucket_ns=bucket_ns).withColumn("is_error", F.lit(True))
    return _rollup(hold(_error_lists(w, mask_rules)), sim_th, depth)


def by_count(rollup: DataFrame) -> DataFrame:
    """Each incident's rows together, most frequent first (one shuffle by incident, no global sort)."""
    return rollup.repartition("uuid").sortWithinPartitions("uuid", F.desc("occurrence_count"), "pod_name", "node_name", "message")


def rollup_with_report(logs: DataFrame, incidents: DataFrame, *, bucket_ns: int = NS_PER_HOUR, mask_rules=None,
                       sim_th: float = SIM_TH, depth: int = DEPTH, totals: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """The roll-up, and A14: per incident, rows in the window, error rows, rolled-up rows.

    Both come from one pass over the logs: rows that are no error are counted in the roll-up's own aggregation.
    ``totals``: an observation that gets the pass's overall counts (``window_rows``, ``error_rows``).
    """
    w = interval_join(logs, incidents.select("uuid", "start_timestamp", "end_timestamp"), bucket_ns=bucket_ns)
    w = tolerant_select(w, LOG_COLUMNS, keep=("uuid", "timestamp_ns")).withColumn("is_error", error_predicate(F.col("message")))
    if totals is not None:
        w = w.observe(totals, F.count(F.lit(1)).alias("window_rows"), F.count_if("is_error").alias("error_rows"))
    per = cut(_error_lists(w, mask_rules))
    rollup = _rollup(per.where("is_error"), sim_th, depth)
    counts = per.groupBy("uuid").agg(F.sum("n").alias("n_window_rows"),
                                     F.sum(F.when(F.col("is_error"), F.col("n")).otherwise(0)).cast("long").alias("n_error_rows"))
    rolled = rollup.groupBy("uuid").agg(F.count(F.lit(1)).alias("n_rollup_rows"))
    report = counts.join(rolled, "uuid", "left").select(
        "uuid", "n_window_rows", "n_error_rows", F.coalesce(F.col("n_rollup_rows"), F.lit(0)).cast("long").alias("n_rollup_rows"))
    return rollup, report
