"""File catalogue (S2-S4), footer census (S2-S10), quarantine (S5), incident numbering."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from faultlens.functions.time import NS_PER_HOUR
from faultlens.operators.metrics import DB_METRICS
from faultlens.sources import readers as R
from faultlens.sources import schemas

NS = 1748736000000000000        # 2025-06-01 00:00 UTC


def log_file(root, name, hour, kind="log", n=2, duration=None):
    folder = root / "2025-06-01" / f"{kind}-parquet"
    os.makedirs(folder, exist_ok=True)
    cols = {"timestamp_ns": [NS + hour * NS_PER_HOUR + k for k in range(n)]}
    cols |= {"message": [name] * n} if kind == "log" else {"spanID": [f"{name}{k}" for k in range(n)]}
    if duration:
        cols["duration"] = pa.array([7] * n, duration)
    pq.write_table(pa.table(cols), folder / name)
    return folder / name


def incidents(spark, *rows):
    return spark.createDataFrame([(f"u{k}", NS + a * NS_PER_HOUR, NS + b * NS_PER_HOUR, hour) for k, (a, b, hour) in enumerate(rows)],
                                 "uuid string, start_timestamp long, end_timestamp long, start_time_hour string")


def test_names_in_local_time(spark, tmp_path):
    """Names run eight hours ahead of the timestamps; the CSV's own hour tells so, for every hour of the window (B2)."""
    for h in range(0, 16):
        log_file(tmp_path, f"log_2025-06-01_{h + 8:02d}-00-00.parquet", h)
    inc = incidents(spark, (1, 3, "2025-06-01_09"))
    got = R.read_logs(spark, str(tmp_path), inc)
    assert {r.timestamp_ns // NS_PER_HOUR - NS // NS_PER_HOUR for r in got.collect()} == {1, 2, 3}
    plain = R.read_logs(spark, str(tmp_path), inc.drop("start_time_hour"))       # names taken as UTC: hours 9 to 11 are not there
    assert {r.message for r in plain.collect()} == set()
    windows = inc.selectExpr("uuid", "end_timestamp AS lo", f"end_timestamp + {NS_PER_HOUR} AS hi")
    assert R.window_hours(windows, "lo", "hi", inc) == ["2025-06-01_11", "2025-06-01_12"]
    assert R.window_dates(incidents(spark, (15, 17, "2025-06-01_23"))) == ["2025-06-01", "2025-06-02"]


def test_incident_without_a_readable_hour_counts_as_utc(spark, tmp_path):
    log_file(tmp_path, "x_2025-06-01_02.parquet", 2)
    assert R.read_logs(spark, str(tmp_path), incidents(spark, (2, 2, "soon"), (2, 2, None))).count() == 2


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()

    def jobs(files):
        root = tmp_path / str(files)
        for k in range(files):
            log_file(root, f"t{k}_2025-06-01_00.parquet", 0, "trace", duration=[pa.int64(), pa.float64(), pa.int32()][k % 3])
        spark.sparkContext.setJobGroup(f"files{files}", "")
        df = R.read_spans(spark, str(root), incidents(spark, (0, 1, "2025-06-01_00")))
        n = len(tracker.getJobIdsForGroup(f"files{files}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert df.count() == 2 * files and {r.duration for r in df.collect()} == {7}
        return n
    assert jobs(3) == jobs(30) < 12


def test_unreadable_file_raises_or_goes_to_quarantine(spark, tmp_path):
    log_file(tmp_path, "a_2025-06-01_00.parquet", 0, "trace", 5)
    bad = tmp_path / "2025-06-01" / "trace-parquet" / "b_2025-06-01_00.parquet"
    bad.write_bytes(b"PAR1 broken")
    cut = log_file(tmp_path, "c_2025-06-01_00.parquet", 0, "trace", 9)
    inc = incidents(spark, (0, 1, "2025-06-01_00"))
    with pytest.raises(ValueError, match="b_2025-06-01_00"):
        R.read_spans(spark, str(tmp_path), inc)
    merged, files = R.read_training_spans(spark, str(tmp_path), inc, "start_timestamp", "end_timestamp", inc)
    data = bytearray(cut.read_bytes())      # the footer is whole, the pages are not
    data[4:40] = b"\xff" * 36
    cut.write_bytes(bytes(data))
    report = {r.source_file[0]: (r.n_rows, r.n_read, r.status) for r in R.merge_report(merged, files).collect()}
    assert report == {"a": (5, 5, "merged"), "b": (None, 0, "unreadable"), "c": (9, 0, "broken")}
    assert files.where("error IS NOT NULL").count() == 1


def test_file_that_vanishes_is_an_error_and_no_folder_is_empty(spark, tmp_path):
    inc = incidents(spark, (0, 1, "2025-06-01_00"))
    assert R.read_logs(spark, str(tmp_path / "none"), inc).count() == 0
    path = log_file(tmp_path, "a_2025-06-01_00.parquet", 0)
    df = R.read_logs(spark, str(tmp_path), inc)
    path.unlink()
    with pytest.raises(Exception):
        df.collect()


def test_pd_and_tikv_metrics_of_any_type(spark, tmp_path):
    types = [pa.int64(), pa.float64(), pa.int32(), pa.float32(), pa.decimal128(12, 2), pa.uint16()]
    want = set()
    for service, (sub, prefix) in R.DB_DIRS.items():
        folder = tmp_path / "2025-06-01" / "metric-parquet" / sub
        os.makedirs(folder, exist_ok=True)
        for k, metric in enumerate(DB_METRICS[service]):
            pq.write_table(pa.table({"timestamp_ns": [NS], metric: pa.array([k + 1], pa.int32()).cast(types[k % 6])}),
                           folder / f"{prefix}_{metric}_2025-06-01.parquet")
            want.add((service, metric, float(k + 1)))
    got = R.read_metric_points(spark, str(tmp_path), ["2025-06-01"]).collect()
    assert {(r.service, r.metric, r.value) for r in got} == want and len(got) == len(want) == 19
    assert R.read_metric_points(spark, str(tmp_path), ["2025-06-02"]).count() == 0


def test_census_reads_through_spark_what_tasks_cannot_open(spark, tmp_path, monkeypatch):
    path = log_file(tmp_path, "t_2025-06-01_00.parquet", 0, "trace", 3, pa.float64())
    real = R._footer
    monkeypatch.setattr(R, "_footer", lambda p, c: real(p, c) if c is not None else (_ for _ in ()).throw(OSError("no such store")))
    files = spark.createDataFrame([(f"store://{path}",)], "path string")
    import unittest.mock as mock
    with mock.patch.object(type(spark.read), "load", lambda self, p: spark.createDataFrame([(p[0], path.read_bytes())], "path string, content binary")):
        rows = R.census(files, schemas.SPANS).collect()
    assert [(r.n_rows, r.layout, r.error) for r in rows] == [(3, "duration double", None)]


def test_incident_rows_are_numbered_in_file_order(spark, tmp_path):
    for name, ids in (("b.csv", range(100, 103)), ("a.csv", range(4))):
        (tmp_path / name).write_text("uuid,start_timestamp,end_timestamp\n" + "".join(f"u{i},{NS + i},{NS + i + 9}\n" for i in ids))
    rows = R.read_incidents(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.uuid) for r in rows] == list(enumerate(["u0", "u1", "u2", "u3", "u100", "u101", "u102"]))
    assert rows[0].start_time_hour == "2025-06-01_00" and rows[0].date == "2025-06-01"
    assert schemas.LOGS["timestamp_ns"].dataType == schemas.SPANS["timestamp_ns"].dataType
