"""B12 interval subtraction, parent scope (B10), bucketed training tables (K6 K7), keyed model store (K8)."""

import random

import pytest
from pyspark.sql import functions as F

from faultlens.operators import sinks as K
from faultlens.operators import traces as T
from faultlens.operators.interval import subtract_intervals
from faultlens.sources import schemas


def points(spans):
    return {x for lo, hi in spans for x in range(lo, hi + 1)}


@pytest.mark.parametrize("seed", range(4))
def test_subtraction_point_by_point(spark, seed):
    rng = random.Random(seed)
    span = lambda n: (lambda a: (a, a + rng.randint(-3, n)))(rng.randint(-40, 80))
    windows = [(f"u{rng.randint(0, 4)}", *span(60)) for _ in range(25)]
    holes = [(f"u{rng.randint(0, 4)}", *span(12)) for _ in range(20)]
    w = spark.createDataFrame(windows, "uuid string, lo long, hi long")
    h = spark.createDataFrame(holes, "uuid string, start_timestamp long, end_timestamp long")
    got = subtract_intervals(w.withColumn("id", F.concat_ws(":", "uuid", "lo", "hi")), h, bucket_ns=7).collect()
    for u, lo, hi in set(windows):
        parts = sorted((r.lo, r.hi) for r in got if r.id == f"{u}:{lo}:{hi}")
        assert points(parts) == points([(lo, hi)]) - points([(a, b) for o, a, b in holes if o != u])
        assert all(a[1] + 1 < b[0] for a, b in zip(parts, parts[1:]))


def spans_of(spark):
    tag = lambda k, v: {"key": k, "value": v}
    proc = lambda pod: {"serviceName": pod.split("-")[0], "tags": [tag("name", pod), tag("node_name", "n")]}
    rows = [(1, "A", "op", 5, proc("a-0"), [], [])] + [(20 + k, f"B{k}", "op", 5 + k, proc("b-0"), [{"spanID": "A"}], []) for k in range(5)]
    rows += [(30 + k, None if k % 2 else f"C{k}", "op", 1, proc("c-0"), None if k % 2 else [], []) for k in range(6)]
    return spark.createDataFrame(rows, schemas.SPANS)


def test_parents_of_all_merged_spans(spark):
    w = spark.createDataFrame([("u", 20, 40)], "uuid string, start_timestamp long, end_timestamp long")
    near = T.enrich_spans(spans_of(spark), w, bucket_ns=8)
    far = T.enrich_spans(spans_of(spark), w, bucket_ns=8, parent_scope="all")
    assert near.where("parent_pod IS NOT NULL").count() == 0 and near.count() == far.count() == 11
    assert {(r.parent_pod, r.parent_service, r.n) for r in far.groupBy("parent_pod", "parent_service").agg(F.count("*").alias("n")).collect()} == {
        ("a-0", "a", 5), (None, None, 6)}
    with pytest.raises(ValueError):
        T.enrich_spans(spans_of(spark), w, parent_scope="day")


def test_fit_reads_bucketed_windows_without_a_shuffle(spark, tmp_path):
    rows = [("u", f"p{k % 5}", f"c{k % 7}", "n", "op", float(k % 11)) for k in range(400)]
    df = spark.createDataFrame(rows, "uuid string, parent_pod string, child_pod string, node_name string, operationName string, mean_duration double")
    path = str(tmp_path / "windows")
    K.write_bucketed(df, path, T.EDGE, 4)
    t = K.read_bucketed(spark, path, T.EDGE, 4)
    assert "Exchange" not in T.fit_detectors(t)._jdf.queryExecution().executedPlan().toString()
    same = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert same(T.fit_detectors(t)) == same(T.fit_detectors(df)) and t.count() == 400
    # a session that did not write it
    name = f"faultlens_{K.fingerprint({'path': path})}"
    spark.sql(f"DROP TABLE {name}")
    assert K.read_bucketed(spark, path, T.EDGE, 4).count() == 400
    assert "Exchange" not in T.fit_detectors(K.read_bucketed(spark, path, T.EDGE, 4))._jdf.queryExecution().executedPlan().toString()


def test_model_of_another_configuration_is_another_model(spark, tmp_path):
    root, built = str(tmp_path / "detectors"), []

    def build(n):
        def run():
            built.append(n)
            return spark.range(n)
        return run
    assert K.keyed_table(spark, root, {"seed": 1, "window": 30}, build(3)).count() == 3
    assert K.keyed_table(spark, root, {"window": 30, "seed": 1}, build(9)).count() == 3       # known
    assert K.keyed_table(spark, root, {"seed": 2, "window": 30}, build(4)).count() == 4       # another seed
    assert K.keyed_table(spark, root, {"seed": 1, "window": 30}, build(5), ["id"], 2).count() == 5
    assert built == [3, 4, 5]


def test_half_written_model_is_not_read(spark, tmp_path):
    root = str(tmp_path / "m")

    def broken():
        return spark.range(0, 4, 1, 2).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("id"))
    with pytest.raises(Exception):
        K.keyed_table(spark, root, {"seed": 1}, broken)
    assert K.keyed_table(spark, root, {"seed": 1}, lambda: spark.range(7)).count() == 7
