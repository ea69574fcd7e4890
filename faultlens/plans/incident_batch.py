"""The evidence job for a batch of incidents over raw telemetry.

One call processes every incident in ``incidents`` through the same plan:

    logs    -> error roll-up per pod (K1)
    spans   -> status combinations (K3), anomaly top-k (K2) via the per-edge
               model table (fit once from post-fault windows of sampled
               incidents, K8)
    metrics -> node / pod / service / database comparisons, JSON (K4)
    all     -> evidence bundle, fault-level attribution, result records (K5)

Intermediates that several outputs consume are written once as tables under
``work_dir`` (shared storage on a cluster) and read back, which also cuts
lineage: a lost executor never forces a recompute from the raw scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.time import NS_PER_HOUR
from faultlens.operators import evidence as E
from faultlens.operators import logs as L
from faultlens.operators import metrics as M
from faultlens.operators import sinks as K
from faultlens.operators import traces as T


@dataclass
class BatchConfig:
    window_ns: int = T.WINDOW_NS
    normal_after_ns: int = T.NORMAL_AFTER_NS
    normal_gap_ns: int = M.NORMAL_GAP_NS
    sample_size: int = T.SAMPLE_SIZE
    seed: int = T.SEED
    log_bucket_ns: int = NS_PER_HOUR
    span_bucket_ns: int = NS_PER_HOUR
    node_whitelist: tuple | None = None
    pod_whitelist: tuple | None = None
    top_n: int = T.TOP_N
    n_trees: int = T.N_TREES
    contamination: float = T.CONTAMINATION
    edge_buckets: int = 64               # files of the training tables, dealt by edge
    parent_scope: str = "all"            # of training spans: parents among all merged spans
    exclude_faults: bool = False         # B12: normal windows and periods without other incidents' faults
    components: DataFrame | None = None  # R4: (level, component); all that the telemetry names by default


def _stage(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_incident_batch(spark: SparkSession, incidents: DataFrame, logs: DataFrame, spans: DataFrame,
                       metric_points: DataFrame, out_dir: str, work_dir: str,
                       cfg: BatchConfig | None = None, model_path: str | None = None,
                       training_spans: DataFrame | None = None) -> dict[str, DataFrame]:
    cfg = cfg or BatchConfig()
    incidents = _stage(spark, incidents, f"{work_dir}/incidents")

    # logs
    rolled, report = L.rollup_with_report(logs, incidents, bucket_ns=cfg.log_bucket_ns)
    log_rollup = _stage(spark, rolled, f"{work_dir}/log_rollup")

    # traces: detection frame once, used by status and windows
    enriched = _stage(spark, T.enrich_spans(spans, incidents, bucket_ns=cfg.span_bucket_ns).select(
        *T.ENRICHED_COLUMNS, "tags"), f"{work_dir}/enriched_spans")
    status = T.status_combinations(enriched, cfg.top_n)
    windows = T.anchored_windows(enriched, window_ns=cfg.window_ns)

    # training tables and model, each by the configuration it depends on (K6 K7 K8)
    faults = incidents if cfg.exclude_faults else None
    model_path = model_path or f"{work_dir}/model"
    of_spans = {"seed": cfg.seed, "sample": cfg.sample_size, "after_ns": cfg.normal_after_ns, "parents": cfg.parent_scope,
                "exclude_faults": cfg.exclude_faults}
    of_windows = {**of_spans, "window_ns": cfg.window_ns}
    of_model = {**of_windows, "trees": cfg.n_trees, "contamination": cfg.contamination}

    def training() -> DataFrame:
        sampled = T.sample_incidents(incidents, cfg.sample_size, cfg.seed)
        return T.training_spans(training_spans if training_spans is not None else spans, sampled, after_ns=cfg.normal_after_ns,
                                bucket_ns=cfg.span_bucket_ns, parent_scope=cfg.parent_scope, faults=faults).select(*T.ENRICHED_COLUMNS)

    def keyed(name: str, config: dict, build, buckets: int = 0) -> DataFrame:
        return K.keyed_table(spark, f"{model_path}/{name}", config, build, T.EDGE, buckets)

    train_spans = keyed("train_spans", of_spans, training, cfg.edge_buckets)
    train_windows = keyed("train_windows", of_windows, lambda: T.anchored_windows(train_spans, window_ns=cfg.window_ns), cfg.edge_buckets)
    baseline = keyed("baseline", of_windows, lambda: T.edge_baseline(train_windows))
    model = keyed("detectors", of_model, lambda: T.fit_detectors(train_windows, seed=cfg.seed, n_trees=cfg.n_trees,
                                                                 contamination=cfg.contamination))
    events = T.score_windows(windows, model)
    topk = _stage(spark, T.anomaly_topk(events, baseline, cfg.top_n), f"{work_dir}/trace_topk")

    # metrics: one period-tagged sample table feeds every source
    periods = M.incident_periods(incidents, cfg.normal_gap_ns, exclude_faults=cfg.exclude_faults)
    samples = M.tag_by_source(M.period_samples(metric_points, periods), cfg.node_whitelist, cfg.pod_whitelist)
    stats = _stage(spark, M.compare_all_sources(samples), f"{work_dir}/metric_stats")   # one pass, all sources
    node, pod, svc, db = M.node_view(stats), M.pod_view(stats), M.service_view(stats), M.db_view(stats)
    metric_json = M.evidence_json(svc, db, node, pod)

    bundle = E.evidence_bundle(log_rollup, topk, status, E.metric_shift_rows(node, pod, svc, db))
    evidence = _stage(spark, E.affected_pods(log_rollup, T.status_counts(enriched), pod, T.anomalous_edges(events)), f"{work_dir}/affected")
    components = cfg.components if cfg.components is not None else E.components_from(
        metric_points.where("source in ('node', 'infra_pod', 'pod')"))
    attribution = E.fault_level(evidence, node, components)
    results = E.parse_results(E.result_records(attribution, evidence))

    K.write_csv_by_incident(log_rollup, f"{out_dir}/logs", K.LOG_ORDER)
    K.write_trace_csv(topk, f"{out_dir}/traces")
    K.write_status_csv(status, f"{out_dir}/status")
    K.write_json_lines(metric_json, f"{out_dir}/metrics")
    K.write_table_by_incident(bundle, f"{out_dir}/bundle")
    K.write_json_lines(results, f"{out_dir}/results")
    return {"log_rollup": log_rollup, "trace_topk": topk, "status": status, "metric_json": metric_json,
            "bundle": bundle, "attribution": attribution, "results": results, "log_report": report}
