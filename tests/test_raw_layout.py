"""Readers (S1-S11), the batch job and the incident stream over a small raw
layout written from the sf0.001 driver tables."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultlens.functions.time import NS_PER_HOUR
from faultlens.plans.incident_batch import BatchConfig, run_incident_batch
from faultlens.sources import fixtures as FX
from faultlens.sources import readers as R
from faultlens.sources import schemas
from faultlens.streaming.incidents import run_incident_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def layout(spark):
    root = tempfile.mkdtemp(prefix="faultlens-raw-", dir="/tmp")
    ev = FX.load(spark, SF, "events")
    inc = FX.incidents_from_events(ev).limit(3)
    inc.drop("seq").coalesce(1).write.option("header", True).csv(f"{root}/input")
    hour = F.date_format(F.timestamp_add("MICROSECOND", (F.col("timestamp_ns") / 1000).cast("long"),
                                         F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")), "yyyy-MM-dd_HH")
    FX.logs_from_events(ev).withColumn("hour", hour).write.partitionBy("hour").parquet(f"{root}/data/all/log-parquet")
    FX.spans_from_events(ev).withColumn("hour", hour).write.partitionBy("hour").parquet(f"{root}/data/all/trace-parquet")
    # metric files: one per (source, metric, date), value column named after the metric
    pts = FX.metric_points_from_events(ev).toPandas()
    pts["date"] = pd.to_datetime(pts.timestamp_ns, unit="ns").dt.strftime("%Y-%m-%d")
    for date, g in pts.groupby("date"):
        mp = f"{root}/data/{date}/metric-parquet"
        for sub in ("apm/service", "apm/pod", "infra/infra_node", "infra/infra_pod", "infra/infra_tidb"):
            os.makedirs(f"{mp}/{sub}", exist_ok=True)
        for svc, s in g.groupby("service"):
            s[["timestamp_ns", "value"]].rename(columns={"value": "request"}).to_parquet(
                f"{mp}/apm/service/svc_{svc}_{date}.parquet")
        for pod, s in g.groupby("pod"):
            s[["timestamp_ns", "value"]].rename(columns={"value": "rrt"}).to_parquet(
                f"{mp}/apm/pod/pod_{pod}_{date}.parquet")
        g.rename(columns={"node": "kubernetes_node", "value": "node_cpu_usage_rate"})[
            ["kubernetes_node", "timestamp_ns", "node_cpu_usage_rate"]].to_parquet(
            f"{mp}/infra/infra_node/infra_node_node_cpu_usage_rate_{date}.parquet")
        g.rename(columns={"node": "instance", "value": "pod_cpu_usage"})[
            ["instance", "pod", "timestamp_ns", "pod_cpu_usage"]].to_parquet(
            f"{mp}/infra/infra_pod/infra_pod_pod_cpu_usage_{date}.parquet")
        g[["timestamp_ns", "value"]].rename(columns={"value": "cpu_usage"}).to_parquet(
            f"{mp}/infra/infra_tidb/infra_tidb_cpu_usage_{date}.parquet")
    return root


def test_readers(spark, layout):
    inc = R.read_incidents(spark, f"{layout}/input")
    rows = inc.orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 2] and rows[0].uuid == "case-0"
    hours = R.window_hours(inc)
    assert len(hours) == 3 * 25
    logs = R.read_logs(spark, f"{layout}/data", inc, lineage=True)
    assert logs.where(F.col("source_file").isNull()).count() == 0
    lo, hi = rows[0].start_timestamp, rows[2].end_timestamp
    ev_logs = FX.logs_from_events(FX.load(spark, SF, "events"))
    # every log row of the touched hours is read, nothing else
    exp = ev_logs.where(F.floor(F.col("timestamp_ns") / NS_PER_HOUR).isin(
        [r[0] for r in inc.select(F.explode(F.sequence(F.floor(F.col("start_timestamp") / NS_PER_HOUR),
                                                      F.floor(F.col("end_timestamp") / NS_PER_HOUR)))).collect()]))
    assert logs.count() == exp.count() > 0
    spans = R.read_spans(spark, f"{layout}/data", inc)
    assert spans.count() == logs.count()
    assert R.read_hourly(spark, f"{layout}/data", "log", ["1999-01-01_00"], schemas.LOGS).count() == 0
    pts = R.read_metric_points(spark, f"{layout}/data", R.window_dates(inc))
    by = {r.source: r["count"] for r in pts.groupBy("source").count().collect()}
    assert set(by) == {"service", "pod", "node", "infra_pod", "tidb"}
    assert len(set(by.values())) == 1  # each source carries every sample of those dates


def test_batch_job_and_stream(spark, layout):
    data = f"{layout}/data"
    inc = R.read_incidents(spark, f"{layout}/input")
    hours_after = inc.select("uuid", "seq", "start_timestamp",
                             (F.col("end_timestamp") + 24 * NS_PER_HOUR).alias("end_timestamp"))
    logs = R.read_logs(spark, data, inc)
    spans = R.read_spans(spark, data, hours_after)
    pts = R.read_metric_points(spark, data, R.window_dates(inc.select(
        (F.col("start_timestamp") - 4 * 24 * NS_PER_HOUR).alias("start_timestamp"),
        (F.col("end_timestamp") + 4 * 24 * NS_PER_HOUR).alias("end_timestamp"))))
    out, work = tempfile.mkdtemp(prefix="fl-out-", dir="/tmp"), tempfile.mkdtemp(prefix="fl-work-", dir="/tmp")
    cfg = BatchConfig(window_ns=FX.FIXTURE_WINDOW_NS, normal_after_ns=FX.FIXTURE_AFTER_NS,
                      normal_gap_ns=FX.FIXTURE_GAP_NS)
    res = run_incident_batch(spark, inc, logs, spans, pts, out, work, cfg)
    assert res["bundle"].count() == 3
    assert res["results"].count() == 3
    assert spark.read.json(f"{out}/results").count() == 3
    assert os.path.isdir(f"{work}/model/detectors")

    seen = []

    def process(batch, batch_id):
        seen.append(batch.count())

    q = run_incident_stream(spark, f"{layout}/input", process, name=f"t{os.getpid()}")
    q.awaitTermination(120)
    assert sum(seen) == 3


def test_time_range_reaches_parquet_scan(spark, layout, capsys):
    """On stored ``timestamp_ns`` the interval join's range is a pushed filter,
    the scan reads only the needed columns, and the join is an equi-join."""
    from faultlens.operators.logs import log_error_rollup
    inc = R.read_incidents(spark, f"{layout}/input")
    df = log_error_rollup(R.read_logs(spark, f"{layout}/data", inc), inc)
    capsys.readouterr()
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(timestamp_ns," in plan and "LessThanOrEqual(timestamp_ns," in plan
    assert "ReadSchema: struct<timestamp_ns:bigint,k8_pod:string,k8_node_name:string,message:string>" in plan
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
