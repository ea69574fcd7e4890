"""Trace evidence.

T1   span enrichment: pod / service / node from process tags, parent span id,
     parent pod and service by a self-join scoped to the incident (J2, J3).
T10  failing status combinations per incident, top 20.
W1   anchored fixed buckets per (incident, edge) with mean duration.
T2   post-fault normal windows of sampled incidents (J7) -> training windows.
A5   per-edge baseline of window means.
T6   per-edge 1-D isolation forest, stored as anomalous value intervals.
T7   native scoring: window mean inside an anomalous interval of its edge.
T9   per (incident, edge) anomaly roll-up + normal mean, top 20 (A7 J6 W6).
A8   distinct pods / services / nodes of the top list.
A9   frame profile; R5 call-graph edges.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.numeric import floor_div, round_half_up

from faultlens.functions import spans as X
from faultlens.functions.time import NS_PER_MIN, NS_PER_SEC, NS_PER_HOUR, local_time
from faultlens.operators.interval import cut, interval_join, subtract_intervals
from faultlens.operators.stats import order_statistics

# Fixed values from the reference workload.
WINDOW_NS = 30 * NS_PER_SEC          # bucket length
NORMAL_AFTER_NS = 40 * NS_PER_MIN    # post-fault window used as normal data
SAMPLE_SIZE = 50
SEED = 42
N_TREES = 100
CONTAMINATION = 0.01
MAX_SUBSAMPLE = 256
TOP_N = 20
PARENTLESS = 1024                    # keys over which spans without a parent are spread
ANOMALY_TYPE = "Duration"
# Fixed value: display text put before a count ("occurrences:").
COUNT_TEXT_PREFIX = "出现次数:"

EDGE = ("parent_pod", "child_pod", "node_name", "operationName")
STATUS_KEYS = ("node_name", "service_name", "parent_pod", "child_pod", "operation_name",
               "status_code", "status_message")


# ------------------------------------------------------------------------- T1
def span_fields(spans: DataFrame, *more: str) -> DataFrame:
    """The span's own fields from its process tags and references."""
    return spans.select(
        *more, "timestamp_ns", "spanID",
        X.parent_span_id(F.col("references")).alias("parent_spanID"),
        X.pod_of(F.col("process")).alias("child_pod"),
        X.service_of(F.col("process")).alias("service_name"),
        X.node_of(F.col("process")).alias("node_name"),
        "operationName", "duration", "tags")


def parent_table(fields: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Pod and service by span id inside each scope; of a repeated id the latest span counts."""
    return (fields.where(F.col("spanID").isNotNull()).groupBy(*scope, "spanID")
            .agg(F.max_by(F.struct(F.col("child_pod").alias("parent_pod"), F.col("service_name").alias("parent_service")),
                          F.struct("timestamp_ns", "child_pod", "service_name")).alias("p"))
            .select(*scope, F.col("spanID").alias("parent_spanID"), "p.parent_pod", "p.parent_service"))


def with_parents(fields: DataFrame, parents: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Left join on the parent's span id. Spans without a parent match nothing; they are spread over
    ``PARENTLESS`` keys, so they do not meet in one task."""
    none = F.col("parent_spanID").isNull()
    w = fields.withColumn("_part", F.when(none, F.pmod(F.xxhash64("spanID", "timestamp_ns"), F.lit(PARENTLESS))).otherwise(-1))
    w = w.withColumn("_parent", F.coalesce("parent_spanID", F.lit("")))
    p = parents.withColumnRenamed("parent_spanID", "_parent").withColumn("_part", F.lit(-1).cast("long"))
    return w.join(p, [*scope, "_parent", "_part"], "left").drop("_parent", "_part")


def enrich_spans(spans: DataFrame, windows: DataFrame, *, lo: str = "start_timestamp", hi: str = "end_timestamp",
                 bucket_ns: int = NS_PER_HOUR, parent_scope: str = "window") -> DataFrame:
    """T1 over the spans inside each window (J1), keyed by ``uuid``.

    ``parent_scope``: ``window`` (detection) looks parents up among the spans of the same window, so a span whose
    parent lies outside has no parent pod; ``all`` (training, B10) among all of ``spans``. The window's spans are
    stored once, so the raw spans are scanned once (``all``: twice).
    """
    w = cut(span_fields(interval_join(spans, windows.select("uuid", lo, hi), lo=lo, hi=hi, bucket_ns=bucket_ns), "uuid"))
    if parent_scope == "all":
        return with_parents(w, parent_table(span_fields(spans)))
    if parent_scope != "window":
        raise ValueError(f"parent_scope is window or all, not {parent_scope!r}")
    return with_parents(w, parent_table(w, ["uuid"]), ["uuid"])


ENRICHED_COLUMNS = ("uuid", "timestamp_ns", "parent_spanID", "spanID", "parent_pod", "child_pod",
                    "parent_service", "service_name", "node_name", "operationName", "duration")


# ------------------------------------------------------------------------ T10
def status_counts(enriched: DataFrame) -> DataFrame:
    """Every failing status combination per incident, counted."""
    tags = F.col("tags")
    s = enriched.where(X.has_status_tag(tags))
    s = s.where(X.has_tag(tags, X.STATUS_CODE_KEY) & X.has_tag(tags, X.STATUS_MESSAGE_KEY))
    s = s.select(
        "uuid",
        X.na(F.col("node_name")).alias("node_name"),
        X.na(X.renamed_service(F.col("service_name"))).alias("service_name"),
        X.na(F.col("parent_pod")).alias("parent_pod"),
        X.na(F.col("child_pod")).alias("child_pod"),
        X.na(F.col("operationName")).alias("operation_name"),
        X.last_tag_value(tags, X.STATUS_CODE_KEY).alias("status_code"),
        X.last_tag_value(tags, X.STATUS_MESSAGE_KEY).alias("status_message"),
    ).where(~F.col("status_code").eqNullSafe(F.lit(X.OK_STATUS_CODE)))
    return s.groupBy("uuid", *STATUS_KEYS).agg(F.count(F.lit(1)).alias("occurrence_count"))


def status_combinations(enriched: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """The report, the ``top_n`` most frequent combinations of each incident."""
    return top_per_incident(status_counts(enriched), "occurrence_count", STATUS_KEYS, top_n).withColumn(
        "occurrence_text", F.concat(F.lit(COUNT_TEXT_PREFIX), F.col("occurrence_count").cast("string")))


def top_per_incident(df: DataFrame, count_col: str, tie_keys: Sequence[str], n: int) -> DataFrame:
    """Top ``n`` rows per uuid by count desc, ties broken by keys.

    ``row_number() <= n`` lets Spark insert a per-partition group limit
    before the shuffle.
    """
    w = Window.partitionBy("uuid").orderBy(F.desc(count_col), *[F.asc_nulls_first(k) for k in tie_keys])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# ------------------------------------------------------------------------- W1
def anchored_windows(enriched: DataFrame, keys: Sequence[str] = ("uuid", *EDGE),
                     window_ns: int = WINDOW_NS) -> DataFrame:
    """Non-overlapping buckets anchored at each group's first timestamp.

    Bucket k covers [lo + k*w, lo + (k+1)*w] (both ends inclusive: a span on
    a boundary counts in both neighbours); buckets exist while their start is
    before the group's last timestamp, so a single-timestamp group has none.
    Group bounds come from a (map-side combined) aggregation joined back.
    Output: keys, window_start, mean_duration, n_spans, first_service.
    """
    keys = list(keys)
    s = enriched
    for k in keys:
        s = s.where(F.col(k).isNotNull())
    b = s.groupBy(*keys).agg(F.min("timestamp_ns").alias("_lo"), F.max("timestamp_ns").alias("_hi"),
                             F.min_by("service_name", F.struct("timestamp_ns", "service_name")).alias("first_service"))
    b = b.where(F.col("_lo") < F.col("_hi"))
    j = s.join(b, keys)
    off = F.col("timestamp_ns") - F.col("_lo")
    ix = floor_div(off, window_ns)
    on_edge = (off % F.lit(window_ns) == 0) & (ix > 0)
    j = j.withColumn("_ix", F.explode(F.when(on_edge, F.array(ix - 1, ix)).otherwise(F.array(ix))))
    start = F.col("_lo") + F.col("_ix") * F.lit(window_ns)
    j = j.withColumn("window_start", start).where(F.col("window_start") < F.col("_hi"))
    return (j.groupBy(*keys, "window_start")
             .agg(F.avg("duration").alias("mean_duration"), F.count(F.lit(1)).alias("n_spans"),
                  F.max("first_service").alias("first_service")))


# ------------------------------------------------------------------- T2 / A5
def sample_incidents(incidents: DataFrame, n: int = SAMPLE_SIZE, seed: int = SEED) -> DataFrame:
    """Deterministic sample of ``n`` incidents (all when fewer).

    Ordered by md5(uuid:seed) — a stable hash both Spark and SQL engines share.
    """
    key = F.md5(F.concat(F.col("uuid"), F.lit(f":{seed}")))
    return incidents.withColumn("_h", key).orderBy("_h", "uuid").limit(n).drop("_h")


def normal_windows(incidents: DataFrame, after_ns: int = NORMAL_AFTER_NS, faults: DataFrame | None = None) -> DataFrame:
    """J7 bounds: [end, end + after] per sampled incident; with ``faults`` (B12) less the other incidents' faults."""
    w = incidents.select("uuid", F.col("end_timestamp").alias("lo"), (F.col("end_timestamp") + F.lit(after_ns)).alias("hi"))
    return w if faults is None else subtract_intervals(w, faults)


def training_spans(spans: DataFrame, sampled: DataFrame, *, after_ns: int = NORMAL_AFTER_NS, bucket_ns: int = NS_PER_HOUR,
                   parent_scope: str = "window", faults: DataFrame | None = None) -> DataFrame:
    """The enriched spans of the normal windows, edge complete (null keys drop out of the grouping)."""
    e = enrich_spans(spans, normal_windows(sampled, after_ns, faults), lo="lo", hi="hi", bucket_ns=bucket_ns, parent_scope=parent_scope)
    return e.dropna(subset=list(EDGE))


def training_windows(spans: DataFrame, sampled: DataFrame, *, after_ns: int = NORMAL_AFTER_NS,
                     window_ns: int = WINDOW_NS, bucket_ns: int = NS_PER_HOUR, parent_scope: str = "window",
                     faults: DataFrame | None = None) -> DataFrame:
    """T2 + T4: W1 window means of the normal spans, keyed (uuid, edge)."""
    return anchored_windows(training_spans(spans, sampled, after_ns=after_ns, bucket_ns=bucket_ns, parent_scope=parent_scope,
                                           faults=faults), window_ns=window_ns)


def edge_baseline(train_windows: DataFrame) -> DataFrame:
    """A5: per edge mean, std (population), median, min, max, count, p99 of window means (an edge of any size)."""
    g = order_statistics(train_windows, EDGE, "mean_duration", ((0.5, "median"), (0.99, "p99")), trim=False)
    return g.select(*EDGE, "mean", F.sqrt(F.col("ss") / F.col("count")).alias("std"), "median", "min", "max", "count", "p99")


# ------------------------------------------------------------------------- T6
def _c(n):
    """Average path length of an unsuccessful search in a BST of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _forest_leaves(x: np.ndarray, rng: np.random.Generator, n_trees: int, psi: int, max_depth: int):
    """Grow ``n_trees`` 1-D isolation trees level by level.

    In one dimension every node holds a contiguous run of its tree's sorted
    subsample, so a whole level of all trees splits with one vectorised
    binary search inside each run. Returns (cuts, leaves) with leaves as arrays
    (tree, lo_exclusive, hi_inclusive, path_length).
    """
    n = len(x)
    if psi < n:
        idx = np.argsort(rng.random((n_trees, n)), axis=1)[:, :psi]
        v = np.sort(x[idx], axis=1)
    else:
        v = np.tile(np.sort(x), (n_trees, 1))
    tree = np.arange(n_trees)
    a = np.zeros(n_trees, dtype=np.int64)
    b = np.full(n_trees, psi, dtype=np.int64)
    lo = np.full(n_trees, -np.inf)
    hi = np.full(n_trees, np.inf)
    cuts, leaves = [], []
    for depth in range(max_depth + 1):
        if len(tree) == 0:
            break
        m = b - a
        vmin = v[tree, a]
        vmax = v[tree, b - 1]
        leaf = (depth >= max_depth) | (m <= 1) | (vmin == vmax)
        if leaf.any():
            leaves.append((tree[leaf], lo[leaf], hi[leaf], depth + _c(m[leaf])))
        keep = ~leaf
        tree, a, b, lo, hi, vmin, vmax = (arr[keep] for arr in (tree, a, b, lo, hi, vmin, vmax))
        # a cut below the largest value leaves both sides non-empty, however close the values are
        t = np.minimum(vmin + rng.random(len(tree)) * (vmax - vmin), np.nextafter(vmax, -np.inf))
        cuts.append(t)
        k, top = a.copy(), b.copy()      # first place in the tree's own run with a value above the cut
        while (k < top).any():
            mid = (k + top) // 2
            above = v[tree, np.minimum(mid, psi - 1)] > t
            top, k = np.where(above & (k < top), mid, top), np.where(~above & (k < top), mid + 1, k)
        tree = np.concatenate([tree, tree])
        a, b = np.concatenate([a, k]), np.concatenate([k, b])
        lo, hi = np.concatenate([lo, t]), np.concatenate([t, hi])
    cat = lambda i: np.concatenate([l[i] for l in leaves])
    return (np.concatenate(cuts) if cuts else np.array([])), (cat(0), cat(1), cat(2), cat(3))


def _mean_path_length(leaves, n_trees: int, xs: np.ndarray) -> np.ndarray:
    tree, _, hi, h = leaves
    order = np.lexsort((hi, tree))
    tree, hi, h = tree[order], hi[order], h[order]
    starts = np.searchsorted(tree, np.arange(n_trees), side="left")
    ends = np.searchsorted(tree, np.arange(n_trees), side="right")
    total = np.zeros(len(xs))
    for i in range(n_trees):
        his = hi[starts[i]:ends[i]]
        # leaves of a tree tile the line as (lo, hi]: x sits in the first leaf with hi >= x
        total += h[starts[i]:ends[i]][np.searchsorted(his, xs, side="left")]
    return total / n_trees


def isolation_intervals(values: np.ndarray, seed: int, n_trees: int = N_TREES,
                        contamination: float = CONTAMINATION, max_subsample: int = MAX_SUBSAMPLE):
    """Fit a 1-D isolation forest and return its anomalous value intervals.

    Same model as the reference detector (subsample min(256, n) without
    replacement, random uniform splits, depth limit ceil(log2 psi), path
    length + c(leaf size), threshold at the ``contamination`` percentile of
    the training scores). The score is piecewise constant between split
    thresholds, so the model is fully described by the merged intervals
    (lo, hi] where the score is below that threshold.
    """
    x = np.asarray(values, dtype=float)
    x = x[~np.isnan(x)]
    if len(x) == 0:
        return []
    rng = np.random.default_rng(seed)
    psi = min(max_subsample, len(x))
    max_depth = int(np.ceil(np.log2(max(psi, 2))))
    cuts, leaves = _forest_leaves(x, rng, n_trees, psi, max_depth)
    norm = float(_c([psi])[0]) or 1.0

    def score(xs):  # higher is more normal, as score_samples
        return -(2.0 ** (-_mean_path_length(leaves, n_trees, xs) / norm))

    offset = np.percentile(score(x), 100.0 * contamination)
    edges = np.unique(cuts)
    # representative point of each piece: (-inf, e0], (e0, e1], ..., (ek, inf)
    reps = np.concatenate([edges, [edges[-1] + 1.0]]) if len(edges) else np.array([x[0]])
    bad = score(reps) < offset
    lows = np.concatenate([[-np.inf], edges])
    highs = np.concatenate([edges, [np.inf]])
    out, cur = [], None
    for lo, hi, b in zip(lows, highs, bad):
        if b:
            cur = [cur[0], hi] if cur is not None else [lo, hi]
        elif cur is not None:
            out.append(tuple(cur))
            cur = None
    if cur is not None:
        out.append(tuple(cur))
    return [(None if np.isinf(lo) else float(lo), None if np.isinf(hi) else float(hi)) for lo, hi in out]


MODEL_SCHEMA = "parent_pod string, child_pod string, node_name string, operationName string, lo double, hi double"


def fit_detectors(train_windows: DataFrame, *, seed: int = SEED, n_trees: int = N_TREES,
                  contamination: float = CONTAMINATION) -> DataFrame:
    """One isolation forest per edge, kept as anomalous intervals.

    Runs as ``groupBy(edge).applyInPandas``; a group holds the window means
    of one edge over the sampled incidents only (bounded by sample size x
    buckets per normal window, e.g. 50 x 80 = 4,000 values). Each edge seeds
    its own generator from a hash of the edge and the seed, never from
    partition order.
    """
    # ship this module's code with the function (executors need not have the package)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keyed = train_windows.select(*EDGE, "mean_duration",
                                 F.xxhash64(*EDGE, F.lit(seed)).alias("_seed"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["_seed"].iloc[0]) & 0x7FFFFFFF
        iv = isolation_intervals(pdf["mean_duration"].to_numpy(), s, n_trees, contamination)
        head = pdf.iloc[0]
        return pd.DataFrame([{**{k: head[k] for k in EDGE}, "lo": lo, "hi": hi} for lo, hi in iv],
                            columns=[*EDGE, "lo", "hi"])

    return keyed.groupBy(*EDGE).applyInPandas(fit, MODEL_SCHEMA)


# ------------------------------------------------------------------------- T7
def score_windows(windows: DataFrame, model: DataFrame) -> DataFrame:
    """T7 + T8: windows whose mean falls in an anomalous interval of its edge.

    Pure native join (edge equi-key + range residual); edges without a model
    are skipped (J5).
    """
    x = F.col("mean_duration")
    hit = windows.join(model, list(EDGE)).where(
        (F.col("lo").isNull() | (x > F.col("lo"))) & (F.col("hi").isNull() | (x <= F.col("hi"))))
    return hit.select("uuid", *EDGE, "window_start", "mean_duration", "first_service").dropDuplicates(
        ["uuid", *EDGE, "window_start"]).withColumn("anomaly_type", F.lit(ANOMALY_TYPE))


def deviation_intervals(baseline: DataFrame, below: float = 3.0, above: float = 1.5) -> DataFrame:
    """A model table without a forest: values up to ``below`` deviations under the edge's mean, or more than ``above``
    over it, are anomalous."""
    at = lambda k: round_half_up(F.col("mean") + F.lit(k) * F.col("std"), 6)
    null = F.lit(None).cast("double")
    sides = F.array(F.struct(null.alias("lo"), at(-below).alias("hi")), F.struct(at(above).alias("lo"), null.alias("hi")))
    return baseline.select(*EDGE, F.explode(sides).alias("_i")).select(*EDGE, "_i.lo", "_i.hi")


def flag_by_baseline(windows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Deterministic stand-in flag: window mean above the edge's baseline p99."""
    return (windows.join(baseline.select(*EDGE, "p99"), list(EDGE))
            .where(F.col("mean_duration") > F.col("p99"))
            .select("uuid", *EDGE, "window_start", "mean_duration", "first_service")
            .withColumn("anomaly_type", F.lit(ANOMALY_TYPE)))


# ------------------------------------------------------------------------- T9
def anomaly_topk(events: DataFrame, baseline: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """A7 + J6 + W6: per (uuid, edge) mean anomalous duration and count, the
    baseline mean (0 when absent), top ``top_n`` per incident by count."""
    g = events.groupBy("uuid", *EDGE).agg(
        F.avg("mean_duration").alias("anomaly_avg_duration"),
        F.count(F.lit(1)).alias("anomaly_count"),
        F.min_by("first_service", "window_start").alias("service_name"))
    g = g.where(F.col("anomaly_avg_duration").isNotNull())  # no valid duration -> skipped
    g = g.join(baseline.select(*EDGE, F.col("mean").alias("normal_avg_duration")), list(EDGE), "left")
    g = g.withColumn("normal_avg_duration", F.coalesce(F.col("normal_avg_duration"), F.lit(0.0)))
    g = top_per_incident(g, "anomaly_count", list(EDGE), top_n)
    return g.select(
        "uuid", "node_name", "service_name", "parent_pod", "child_pod",
        F.col("operationName").alias("operation_name"),
        round_half_up("normal_avg_duration", 6).alias("normal_avg_duration"),
        round_half_up("anomaly_avg_duration", 6).alias("anomaly_avg_duration"),
        "anomaly_count", "rank",
        F.concat(F.lit(COUNT_TEXT_PREFIX), F.col("anomaly_count").cast("string")).alias("anomaly_count_text"))


def anomalous_edges(events: DataFrame) -> DataFrame:
    """Every edge with an anomalous window, per incident (the report keeps the top ones only)."""
    return events.select("uuid", "child_pod", "node_name").distinct()


def anomaly_event_rows(events: DataFrame) -> DataFrame:
    """T8 display rows: window start (ns and local time), edge (also as one text, X8), type, mean."""
    return events.select("uuid", F.col("window_start").alias("timestamp"),
                         local_time(F.col("window_start")).alias("timestamp_readable"),
                         "parent_pod", "child_pod", F.col("operationName").alias("operation_name"),
                         "anomaly_type", F.col("mean_duration").alias("duration"),
                         F.col("first_service").alias("service_name"), "node_name",
                         X.edge_name(*[F.col(k) for k in EDGE]).alias("edge"))


# ------------------------------------------------------------------------- A8
def dimension_lists(topk: DataFrame) -> DataFrame:
    """Sorted distinct pods (child and parent), services, nodes per incident."""
    def joined(c):
        return F.array_join(F.array_sort(F.collect_set(c)), ",")
    return topk.groupBy("uuid").agg(
        F.array_join(F.array_sort(F.array_union(F.collect_set("child_pod"), F.collect_set("parent_pod"))), ",")
        .alias("pod_names"),
        joined("service_name").alias("service_names"),
        joined("node_name").alias("node_names"))


# ------------------------------------------------------------------ A9 / R5
def frame_profile(enriched: DataFrame) -> DataFrame:
    """Per incident row count, distinct pods / services / nodes / spans, time range."""
    return enriched.groupBy("uuid").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("child_pod").alias("n_pods"),
        F.countDistinct("service_name").alias("n_services"),
        F.countDistinct("node_name").alias("n_nodes"),
        F.countDistinct("spanID").alias("n_spans"),
        F.min("timestamp_ns").alias("min_ts"),
        F.max("timestamp_ns").alias("max_ts"))


def call_graph(enriched: DataFrame) -> DataFrame:
    """Caller -> callee service edges with call and self-loop counts."""
    e = enriched.where(F.col("parent_service").isNotNull() & F.col("service_name").isNotNull())
    return e.groupBy("uuid", "parent_service", "service_name").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum(F.when(F.col("parent_pod") == F.col("child_pod"), 1).otherwise(0)).cast("long").alias("n_self_loop"),
        F.countDistinct("parent_pod", "child_pod").alias("n_pod_pairs"))
