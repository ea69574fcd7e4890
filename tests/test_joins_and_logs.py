"""J1 interval join boundaries, J2 parent lookup, D1 templates, A1 roll-up,
X1 service names, J4 prefix join."""

from pyspark.sql import functions as F

from faultlens.functions.text import service_from_pod, template_bucket_key, template_tokens
from faultlens.operators.interval import interval_join
from faultlens.operators.logs import log_error_rollup, mine_templates
from faultlens.operators.metrics import incident_periods, pods_of_services
from faultlens.operators.traces import enrich_spans
from faultlens.sources import schemas


def test_interval_join_inclusive_and_overlapping(spark):
    rec = spark.createDataFrame([(t,) for t in (0, 9, 10, 11, 25, 30, 31)], "timestamp_ns long")
    iv = spark.createDataFrame([("a", 10, 30), ("b", 25, 31), ("empty", 40, 20)],
                               "uuid string, start_timestamp long, end_timestamp long")
    got = sorted((r.uuid, r.timestamp_ns) for r in interval_join(rec, iv, bucket_ns=7).collect())
    assert got == [("a", 10), ("a", 11), ("a", 25), ("a", 30), ("b", 25), ("b", 30), ("b", 31)]


def test_service_from_pod(spark):
    df = spark.createDataFrame([("redis-cart-0",), ("frontend-1",), ("-x",), (None,)], "p string")
    assert [r[0] for r in df.select(service_from_pod(F.col("p"))).collect()] == ["redis", "frontend", "-x", None]


def test_template_tokens_and_buckets(spark):
    df = spark.createDataFrame([("  a_b|c:d=e,f  g\tz ",), ("",), ("one",), ("x1 y 2z",)], "m string")
    rows = df.select(template_tokens(F.col("m")).alias("t")).select("t", template_bucket_key(F.col("t")).alias("k")).collect()
    assert rows[0].t == ["a", "b", "c", "d", "e", "f", "g", "z"]
    assert rows[0].k == "8 a b c d e f g"
    assert rows[1].t == [] and rows[2].k == "1 "
    assert rows[3].k == "3 <*> y"


def test_mine_templates_merges_positions(spark):
    msgs = ["user 1 logged in from a", "user 22 logged in from b", "disk full", "disk empty", "solo line here"]
    df = spark.createDataFrame([(m,) for m in msgs], "message string")
    got = {r.template: r.cluster_size for r in mine_templates(df).collect()}
    assert got["user <*> logged in from <*>"] == 2
    assert got["disk <*>"] == 2
    assert got["solo line here"] == 1


def test_log_rollup_counts_and_first_message(spark):
    logs = spark.createDataFrame([
        (1, "t", "cart-0", "n1", "ERROR id=1 failed"),
        (2, "t", "cart-0", "n1", "ERROR id=2 failed"),
        (3, "t", None, "n1", "error id=3 failed"),      # null pod: used for mining, dropped in roll-up
        (4, "t", "cart-0", "n1", "all good"),           # not an error
        (5, "t", "cart-1", "n2", None),                 # null message: not an error
        (99, "t", "cart-0", "n1", "ERROR id=9 failed"),  # outside the window
    ], schemas.LOGS)
    inc = spark.createDataFrame([("u", 1, 10)], "uuid string, start_timestamp long, end_timestamp long")
    out = log_error_rollup(logs, inc, bucket_ns=4).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.pod_name, r.service_name, r.occurrence_count, r.message) == ("cart-0", "cart", 2, "ERROR id=1 failed")


def test_parent_lookup_scoped_and_latest_wins(spark):
    tag = lambda k, v: {"key": k, "value": v}
    proc = lambda pod: {"serviceName": pod.split("-")[0], "tags": [tag("name", pod), tag("node_name", "n")]}
    spans = spark.createDataFrame([
        (1, "A", "op", 5, proc("a-0"), [], []),
        (2, "A", "op", 5, proc("a-1"), [], []),                                  # duplicate id: later wins
        (3, "B", "op", 5, proc("b-0"), [{"spanID": "A"}], []),
        (4, "C", "op", 5, proc("c-0"), [{"spanID": "A"}, {"spanID": "B"}], []),  # two refs: no parent
        (50, "D", "op", 5, proc("d-0"), [{"spanID": "B"}], []),                  # other window
    ], schemas.SPANS)
    inc = spark.createDataFrame([("u", 0, 10), ("v", 40, 60)], "uuid string, start_timestamp long, end_timestamp long")
    e = {r.spanID: r for r in enrich_spans(spans, inc, bucket_ns=16).collect()}
    assert e["B"].parent_pod == "a-1" and e["B"].parent_service == "a"
    assert e["C"].parent_spanID is None and e["C"].parent_pod is None
    assert e["D"].parent_spanID == "B" and e["D"].parent_pod is None


def test_pods_of_services_prefix(spark):
    svc = spark.createDataFrame([("u", "cart", "m"), ("u", "redis", "m")], "uuid string, service string, metric string")
    pods = spark.createDataFrame([("u", "cartservice-0"), ("u", "redis-cart-0"), ("u", "frontend-0")],
                                 "uuid string, pod string")
    got = sorted((r.service, r.pod) for r in pods_of_services(svc, pods).collect())
    assert got == [("cart", "cartservice-0"), ("redis", "redis-cart-0")]


def test_incident_periods(spark):
    inc = spark.createDataFrame([("a", 0, 100, 200), ("b", 1, 400, 500), ("c", 2, 505, 600)],
                                "uuid string, seq long, start_timestamp long, end_timestamp long")
    got = sorted((r.uuid, r.part, r.lo, r.hi) for r in incident_periods(inc, gap_ns=10).collect())
    assert got == [("a", "after", 210, 400), ("a", "fault", 100, 200),
                   ("b", "after", 510, 505), ("b", "before", 210, 400), ("b", "fault", 400, 500),
                   ("c", "before", 510, 505), ("c", "fault", 505, 600)]


def test_one_pass_views_equal_individual_comparisons(spark):
    from faultlens.operators import metrics as M
    from faultlens.sources import fixtures as FX
    ev = FX.load(spark, "/root/testdata/sf0.001", "events")
    samples = M.period_samples(FX.metric_points_from_events(ev), M.incident_periods(FX.incidents_from_events(ev),
                                                                                   FX.FIXTURE_GAP_NS))
    stats = M.compare_all_sources(FX.tag_sources(samples))

    def rows(df):
        return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)

    assert rows(M.node_view(stats)) == rows(M.node_shift_samples(samples, FX.NODE_WHITELIST))
    assert rows(M.pod_view(stats)) == rows(M.pod_shift_samples(samples, FX.POD_WHITELIST))
    assert rows(M.db_view(stats)) == rows(M.db_stats_samples(samples))
    assert rows(M.service_view(stats)) == rows(M.service_drilldown_samples(samples, samples))


def test_nanoseconds_near_a_bucket_border_are_exact(spark):
    """Neighbours of an hour's border, which a double cannot tell apart."""
    from faultlens.functions.numeric import floor_div
    from faultlens.functions.time import NS_PER_HOUR, ns_to_ntz
    border = 473_000 * NS_PER_HOUR
    times = [border + d for d in (-200, -1, 0, 1, 999, 1000, NS_PER_HOUR - 1)] + [-1, -NS_PER_HOUR, -NS_PER_HOUR - 1]
    rec = spark.createDataFrame([(t,) for t in times], "timestamp_ns long")
    assert [r[0] for r in rec.select(floor_div(F.col("timestamp_ns"), NS_PER_HOUR)).collect()] == [t // NS_PER_HOUR for t in times]
    iv = spark.createDataFrame([("u", border - 5, border - 1), ("v", border, border)], "uuid string, start_timestamp long, end_timestamp long")
    assert sorted((r.uuid, r.timestamp_ns) for r in interval_join(rec, iv).collect()) == [("u", border - 1), ("v", border)]
    micros = rec.select(F.unix_micros(ns_to_ntz(F.col("timestamp_ns")).cast("timestamp"))).collect()
    assert [r[0] for r in micros] == [t // 1000 for t in times]


def test_merge_join_fallback_gives_the_same_rows(spark):
    import random
    rng = random.Random(3)
    times = [rng.randint(0, 500) for _ in range(300)]
    spans = [(f"u{k}", a, a + rng.randint(-2, 60)) for k, a in enumerate(rng.randint(0, 480) for _ in range(20))]
    rec = spark.createDataFrame([(t,) for t in times], "timestamp_ns long")
    iv = spark.createDataFrame(spans, "uuid string, start_timestamp long, end_timestamp long")
    want = sorted((u, t) for u, a, b in spans for t in times if a <= t <= b)
    for most in (0, 10 ** 6):
        out = interval_join(rec, iv, bucket_ns=1000 if most else 13, max_broadcast_rows=most)
        assert ("SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()) == (most == 0)
        assert sorted((r.uuid, r.timestamp_ns) for r in out.collect()) == want


def test_gate_edges_and_zero_baseline(spark):
    """F8: exactly 0.95 and 1.05 are no change; a zero baseline is compared through the epsilon, no baseline is kept."""
    from faultlens.operators import metrics as M
    rows = [("a", 1.0, 0.95), ("b", 1.0, 1.05), ("c", 1.0, 0.9499), ("d", 1.0, 1.0501), ("e", 0.0, 0.0), ("f", 0.0, 1.0), ("g", None, 1.0), ("h", 1.0, None)]
    samples = [(m, "normal", n) for m, n, _ in rows] + [(m, "fault", f) for m, _, f in rows]
    df = spark.createDataFrame([("u", p, m, v) for m, p, v in samples], "uuid string, period string, metric string, value double")
    got = {r.metric: r.status for r in M.compare_periods(df, ["metric"]).collect()}
    def ratio(n, f):
        return (f + 1e-9) / (n + 1e-9)
    want = {m: "no_baseline" if n is None else "no_fault_data" if f is None else "shifted" for m, n, f in rows
            if n is None or f is None or not 0.95 <= ratio(n, f) <= 1.05}
    assert got == want and {"c", "d", "f", "g", "h"} <= set(got) and "e" not in got


def test_no_incidents_give_empty_evidence(spark):
    logs = spark.createDataFrame([(1, "t", "cart-0", "n1", "error")], schemas.LOGS)
    none = spark.createDataFrame([], "uuid string, seq long, start_timestamp long, end_timestamp long")
    assert log_error_rollup(logs, none).collect() == [] and incident_periods(none).collect() == []
