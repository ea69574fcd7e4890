"""Leader clusters against a sequential miner, tight and loose routes, matching."""

import hashlib
import math
import random

import pytest

from faultlens.operators import templates as TP


def lists_of(messages, depth):
    """Distinct token lists by route, each with its id."""
    out = {}
    for m in messages:
        tokens = tuple(t for t in m.split(" ") if t)
        lead = tokens[:max(0, min(TP.prefix_length(depth), len(tokens) - 1))]
        route = (len(tokens), tuple("<*>" if any(c.isdigit() for c in t) else t for t in lead))
        out.setdefault(route, {})[hashlib.md5(" ".join(tokens).encode()).hexdigest()] = tokens
    return out


def sequential(messages, sim_th, depth):
    """One list after another in the order of the ids: leaders first, then the most similar leader; merged by position."""
    found = []
    for (n, lead), lists in lists_of(messages, depth).items():
        literal = sum(t != "<*>" for t in lead)
        need = max(1, math.ceil(sim_th * n))
        shared = lambda a, b: sum(x == y for x, y in zip(a, b))
        if literal >= sim_th * n:
            members = {"": list(lists.values())}
        else:
            leaders = {}
            for i in sorted(lists):
                if not any(shared(lists[i], t) >= need for t in leaders.values()):
                    leaders[i] = lists[i]
            members = {}
            for i, t in lists.items():
                best = i if i in leaders else min(leaders, key=lambda k: (-shared(leaders[k], t), k))
                members.setdefault(best, []).append(t)
        for own in members.values():
            found.append((" ".join(c[0] if len(set(c)) == 1 else "<*>" for c in zip(*own)), sorted(" ".join(t) for t in own)))
    return sorted(found)


@pytest.mark.parametrize("seed,sim_th,depth", [(1, 0.01, 10), (2, 0.01, 3), (3, 0.4, 3), (4, 0.5, 10), (5, 0.7, 4), (6, 1.0, 3)])
def test_equals_a_sequential_miner(spark, seed, sim_th, depth):
    rng = random.Random(seed)
    words = ["1", "2", "30", "4x", "a", "b", "c", "d9"]
    messages = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(220)]
    df = spark.createDataFrame([(m,) for m in messages], "message string").repartition(5)
    templates, lists = TP.mine_templates(df, sim_th=sim_th, depth=depth, with_lists=True)
    want = sequential(messages, sim_th, depth)
    template = {(r.bucket_key, r.cluster): r.template for r in templates.collect()}
    text = {hashlib.md5(m.encode()).hexdigest(): m for m in messages}
    got = {}
    for r in lists.collect():
        got.setdefault((r.bucket_key, r.cluster), []).append(text[r.list_id])
    assert sorted((template[k], sorted(v)) for k, v in got.items()) == want
    of = {m: t for t, own in want for m in own}
    assert all(r.template == of[r.message] for r in TP.match_templates(TP.tokenize(df, depth=depth), templates, lists).collect())
    assert sum(r.cluster_size for r in templates.collect()) == len(messages)


def test_messages_without_a_common_word_stay_apart(spark):
    messages = ["NullPointerException", "TimeoutException", "ConnectionFailed", "NullPointerException", "12 left", "13 right", "12 right"]
    got = {r.template: r.cluster_size for r in TP.mine_templates(spark.createDataFrame([(m,) for m in messages], "message string")).collect()}
    assert got["NullPointerException"] == 2 and got["TimeoutException"] == got["ConnectionFailed"] == 1
    assert "<*>" not in got and sum(got.values()) == 7


def test_outcome_does_not_depend_on_order_or_partitions(spark):
    rng = random.Random(9)
    messages = [f"{rng.randint(0, 9)} {rng.randint(0, 30)} {rng.choice('abcdef')}" for _ in range(400)]
    outs = []
    for parts in (1, 7):
        rng.shuffle(messages)
        df = spark.createDataFrame([(m,) for m in messages], "message string").repartition(parts)
        outs.append(sorted((r.template, r.cluster, r.cluster_size) for r in TP.mine_templates(df).collect()))
    assert outs[0] == outs[1]


def test_scopes_are_mined_apart_and_odd_messages(spark):
    rows = [("u", "7 x"), ("v", "8 x"), ("u", None), ("u", ""), ("v", "   "), ("u", "1 2 " * 3000)]
    df = spark.createDataFrame(rows, "uuid string, message string")
    got = sorted((r.uuid, r.template[:5], r.cluster_size) for r in TP.mine_templates(df, scope=["uuid"]).collect())
    assert got == [("u", "", 2), ("u", "1 2 1", 1), ("u", "7 x", 1), ("v", "", 1), ("v", "8 x", 1)]
    assert TP.mine_templates(df.where("false")).collect() == []


def test_report_rides_on_the_rollups_scan(spark):
    from pyspark.sql import Observation
    from faultlens.operators.logs import rollup_with_report
    from faultlens.sources import schemas
    logs = spark.createDataFrame([(k, "t", "cart-0", "n1", m) for k, m in enumerate(
        ["ERROR id=1 failed", "ok", None, "ERROR id=2 failed", "fine", "exception x"])], schemas.LOGS)
    inc = spark.createDataFrame([("u", 0, 4), ("v", 4, 9), ("w", 50, 60)], "uuid string, start_timestamp long, end_timestamp long")
    total = Observation("rows")
    rollup, report = rollup_with_report(logs, inc, bucket_ns=3, totals=total)
    assert sorted(tuple(r) for r in report.collect()) == [("u", 5, 2, 1), ("v", 2, 1, 1)]
    assert total.get == {"window_rows": 7, "error_rows": 3}
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "message" not in plan.split("Scan")[-1] or "LocalTableScan" not in plan      # the logs are not read again
    assert rollup.count() == 2
