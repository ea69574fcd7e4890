"""W1 anchored buckets vs a literal loop; J2 parent lookup; T10 status rules;
isolation-forest intervals on planted anomalies."""

import numpy as np
import pandas as pd

from faultlens.operators.traces import anchored_windows, isolation_intervals, status_combinations


def literal_windows(ts, dur, win):
    """Restatement of the reference's loop from its description."""
    df = pd.DataFrame({"ts": ts, "d": dur})
    lo, hi = df.ts.min(), df.ts.max()
    out, i = [], lo
    while i < hi:
        sel = df[(df.ts >= i) & (df.ts <= i + win)]
        if len(sel):
            out.append((int(i), float(sel.d.mean())))
        i += win
    return out


def test_anchored_windows_match_loop(spark):
    rng = np.random.default_rng(3)
    rows, expect = [], {}
    win = 30
    for g in range(25):
        n = int(rng.integers(1, 40))
        ts = rng.integers(0, 400, n)
        if g % 5 == 0:  # force boundary hits
            ts = np.concatenate([ts, [ts.min() + win, ts.min() + 2 * win]])
        dur = rng.integers(1, 100, len(ts))
        for t, d in zip(ts, dur):
            rows.append((f"g{g}", "p", "c", "n", "op", int(t), int(d), "svc"))
        expect[f"g{g}"] = literal_windows(ts, dur, win)
    df = spark.createDataFrame(rows, "uuid string, parent_pod string, child_pod string, node_name string, "
                                     "operationName string, timestamp_ns long, duration long, service_name string")
    got = {}
    for r in anchored_windows(df, window_ns=win).collect():
        got.setdefault(r["uuid"], []).append((r["window_start"], r["mean_duration"]))
    for g, exp in expect.items():
        assert sorted(got.get(g, [])) == [(a, b) for a, b in sorted(exp)] or \
            all(abs(x[1] - y[1]) < 1e-9 and x[0] == y[0] for x, y in zip(sorted(got.get(g, [])), sorted(exp)))
        assert len(got.get(g, [])) == len(exp)


def test_single_timestamp_group_has_no_window(spark):
    df = spark.createDataFrame([("u", "p", "c", "n", "op", 5, 1, "s"), ("u", "p", "c", "n", "op", 5, 3, "s")],
                               "uuid string, parent_pod string, child_pod string, node_name string, "
                               "operationName string, timestamp_ns long, duration long, service_name string")
    assert anchored_windows(df, window_ns=30).count() == 0


def test_status_rules(spark):
    tags = "array<struct<key:string,value:string>>"
    rows = [
        # code 13 + message -> counted; redis renamed; null parent -> N/A
        ("u", None, "redis-cart-0", "redis", "n1", "get", [("status.code", "13"), ("status.message", "boom")]),
        ("u", None, "redis-cart-0", "redis", "n1", "get", [("status.code", "13"), ("status.message", "boom")]),
        # code 0 -> dropped
        ("u", "a", "b", "svc", "n1", "get", [("status.code", "0"), ("status.message", "ok")]),
        # no message -> dropped
        ("u", "a", "b", "svc", "n1", "get", [("status.code", "2")]),
        # duplicate key -> last wins ('0' -> dropped)
        ("u", "a", "b", "svc", "n1", "get", [("status.code", "5"), ("status.message", "x"), ("status.code", "0")]),
    ]
    df = spark.createDataFrame(rows, f"uuid string, parent_pod string, child_pod string, service_name string, "
                                     f"node_name string, operationName string, tags {tags}")
    out = status_combinations(df).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["service_name"], r["parent_pod"], r["status_code"], r["occurrence_count"]) == ("redis-cart", "N/A", "13", 2)
    assert r["occurrence_text"].endswith("2")


def test_isolation_intervals_flag_planted():
    rng = np.random.default_rng(11)
    clean = rng.normal(100.0, 5.0, 400)
    iv = isolation_intervals(clean, 42)

    def flagged(v):
        return any((lo is None or v > lo) and (hi is None or v <= hi) for lo, hi in iv)

    assert flagged(2000.0) and flagged(-500.0)
    assert not flagged(100.0)
    share = np.mean([flagged(v) for v in clean])
    assert share <= 0.03
    # deterministic for a seed
    assert iv == isolation_intervals(clean, 42)
