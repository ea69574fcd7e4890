"""Readers that take any numeric type, sinks that keep earlier incidents, forest on close values, uncapped attribution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.operators import evidence as E
from faultlens.operators import sinks as K
from faultlens.operators import traces as T
from faultlens.sources import readers as R


@pytest.mark.parametrize("values", [[0] * 5 + [1e9] * 3 + [1e9 + 3e-7], [1.0, np.nextafter(1.0, 2)] * 20, [-1e300, 1e300, 0.0], [5.0]])
def test_forest_on_close_and_far_values(values):
    got = T.isolation_intervals(np.array(values), seed=1)
    ends = [(-np.inf if lo is None else lo, np.inf if hi is None else hi) for lo, hi in got]
    assert ends == sorted(ends) and all(a[1] <= b[0] for a, b in zip(ends, ends[1:])) and all(lo < hi for lo, hi in ends)


def test_sinks_keep_earlier_incidents_and_replay(spark, tmp_path):
    def batch(u, counts):
        return spark.createDataFrame([(u, c, f"m{c}") for c in counts], "uuid string, occurrence_count long, message string")
    path = str(tmp_path / "logs")
    for u, counts in (("u1", [9, 1, 10]), ("u2", [2]), ("u1", [9, 1, 10])):
        K.write_csv_by_incident(batch(u, counts), path, [F.desc("occurrence_count")])
        K.write_json_lines(batch(u, counts), str(tmp_path / "json"))
        K.write_table_by_incident(batch(u, counts), str(tmp_path / "tab"))
    part = next((tmp_path / "logs" / "uuid=u1").glob("part-*.csv"))
    assert part.read_text().splitlines() == ["occurrence_count,message", "10,m10", "9,m9", "1,m1"]
    assert spark.read.json(str(tmp_path / "json")).count() == 4 and spark.read.parquet(str(tmp_path / "tab")).count() == 4


def test_model_table_is_only_fitted_when_missing(spark, tmp_path):
    path = str(tmp_path / "model")
    assert K.load_or_fit(spark, path, lambda: spark.range(3)).count() == 3
    assert K.load_or_fit(spark, path, lambda: spark.range(9)).count() == 3


def test_metric_files_of_any_numeric_type(spark, tmp_path):
    base = tmp_path / "2025-06-01" / "metric-parquet"
    ns = 1748736000000000000
    for sub, name, metric in (("infra/infra_tidb", "infra_tidb", "server_is_up"),):
        for kind in ("long", "double", "int", "float"):
            spark.createDataFrame([(ns, 7)], f"timestamp_ns long, {metric} long").selectExpr("timestamp_ns", f"cast({metric} as {kind}) {metric}").coalesce(1).write.parquet(
                str(base / sub / kind))
            part = next((base / sub / kind).glob("part-*.parquet"))
            part.rename(base / sub / f"{name}_{metric}_2025-06-0{1 + ['long', 'double', 'int', 'float'].index(kind)}.parquet")
    got = R.read_metric_points(spark, str(tmp_path), ["2025-06-01"]).collect()
    assert [r.value for r in got] == [7.0] * 4


def test_span_duration_of_any_type_and_broken_file(spark, tmp_path):
    from faultlens.sources import schemas
    day = tmp_path / "2025-06-01" / "trace-parquet"
    for k, kind in enumerate(("double", "bigint")):
        spark.sql(f"SELECT 't' AS traceID, 's{k}' AS spanID, cast(5 as {kind}) AS duration").coalesce(1).write.parquet(str(day / f"w{k}"))
        next((day / f"w{k}").glob("part-*.parquet")).rename(day / f"trace_2025-06-01_0{k}-00.parquet")
    got = R.read_hourly(spark, str(tmp_path), "trace", ["2025-06-01_00", "2025-06-01_01"], schemas.SPANS).collect()
    assert sorted(r.duration for r in got) == [5, 5]
    (day / "trace_2025-06-01_02-00.parquet").write_bytes(b"PAR1 broken")
    with pytest.raises(Exception):
        R.read_hourly(spark, str(tmp_path), "trace", ["2025-06-01_02"], schemas.SPANS).collect()


def test_pod_beyond_the_report_counts_as_affected(spark):
    counts = spark.createDataFrame([("u", f"svc-{i}", "N/A", 100 - i) for i in range(30)], "uuid string, child_pod string, node_name string, occurrence_count long")
    none = spark.createDataFrame([], "uuid string, pod_name string, node_name string")
    shift = spark.createDataFrame([], "uuid string, status string, pod string, instance string")
    assert E.affected_pods(none, counts, shift).select("pod").distinct().count() == 30


def test_results_keep_the_incidents_uuid(spark):
    a = spark.createDataFrame([("mine", '{"component": "c", "uuid": "foreign", "reason": "r", "reasoning_trace": []}')], "uuid string, answer_text string")
    assert E.parse_results(a).first().uuid == "mine"
