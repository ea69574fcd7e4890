"""Tolerant parse of answers; K4 document shape; R2 rows and text."""

import json

import pytest

from faultlens.operators import evidence as E
from faultlens.operators import metrics as M
from faultlens.operators.stats import STAT_COLUMNS


def parse(spark, *texts):
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "uuid string, answer_text string")
    return {int(r.uuid): r for r in E.parse_results(df).collect()}


def test_whole_nested_broken_and_missing_objects(spark):
    long = " ".join(f"w{k}" for k in range(30))
    good = {"component": "p", "uuid": "foreign", "reason": long, "reasoning_trace": [{"step": 1, "action": "a", "observation": long}]}
    got = parse(spark, json.dumps(good), "x {bad} " + json.dumps(good) + ' {"y": 2}', json.dumps(good)[:-1], None, "", "no object", "{", "}{",
                json.dumps({"detail": {"a": {"b": "}{\\\""}}, "component": "deep"}), '{"component": 3, "reason": null, "reasoning_trace": {"step": 1}}',
                '{"reasoning_trace": [1, {"step": 2}, null, {"action": 5, "observation": "o"}], "component": "c"}', "[" + json.dumps(good) + "]")
    words = " ".join(long.split()[:20])
    for k in (0, 1, 11):
        assert (got[k].component, got[k].uuid, got[k].reason) == ("p", str(k), words)
        assert [tuple(s) for s in got[k].reasoning_trace] == [(1, "a", words)]
    assert got[2].component == "" and got[2].reasoning_trace == []          # cut off: only the step's own object is whole
    for k in (3, 4, 5, 6, 7, 9):
        assert (got[k].component, got[k].reason, got[k].reasoning_trace) == ("", "", [])
    assert got[8].component == "deep"
    assert [tuple(s) for s in got[10].reasoning_trace] == [(2, None, None), (None, None, "o")]


def test_long_answer_with_many_braces(spark):
    text = "{ " * 300 + "z" * 20_000 + json.dumps({"component": "late", "reason": 'quote " and { brace'})
    r = parse(spark, text)[0]
    assert (r.component, r.reason) == ("late", 'quote " and { brace')


def stats(spark, keys, rows):
    """Compared statistics: a value or nothing for every statistic of both periods."""
    cols = [f"{p}_{c}" for p in ("normal", "fault") for c in STAT_COLUMNS]
    schema = ", ".join([f"{k} string" for k in ("uuid", *keys)] + [f"{c} {'long' if c.endswith('_count') else 'double'}" for c in cols])
    return spark.createDataFrame([(*r[:-1], *[None if r[-1] is None or c.endswith("std") else int(r[-1]) if c.endswith("_count") else float(r[-1])
                                              for c in cols]) for r in rows], schema)


def test_metric_document_has_four_keys_nulls_and_order(spark):
    db = stats(spark, ["service", "metric"], [("u", "tidb-tidb", m, 1) for m in ("z", "a", "m")] + [("w", "tidb-pd", "q", None)])
    none = lambda *keys: stats(spark, keys, [])
    pod = stats(spark, ["instance", "pod", "metric"], [("v", "n", "p", "m", 2)])
    docs = M.evidence_json(none("service", "pod", "metric"), db, none("node", "metric"), pod)
    found = {r.uuid: json.loads(r.metric_json) for r in docs.collect()}
    assert [list(d) for d in found.values()] == [["service", "tidb", "node", "pod"]] * 3
    assert list(found["u"]["tidb"]["tidb-tidb"]) == ["a", "m", "z"] and found["u"]["pod"] == {}
    leaf = found["u"]["tidb"]["tidb-tidb"]["a"]
    assert leaf["normal_stats"]["std"] is None and leaf["fault_stats"]["50%"] == 1.0
    assert set(found["w"]["tidb"]["tidb-pd"]["q"]["normal_stats"].values()) == {None}
    assert found["v"]["pod"]["n"]["p"]["m"]["normal_stats"]["count"] == 2
    rows = M.parse_evidence_json(docs).where("section = 'pod'").collect()
    assert [(r.e1, r.e2, r.metric, r.period, r["count"], r.std) for r in sorted(rows, key=lambda r: r.period)] == [
        ("n", "p", "m", "fault", 2, None), ("n", "p", "m", "normal", 2, None)]


@pytest.mark.parametrize("level,pods,shifted,want", [
    ("node", [("svc-a-0", "n1"), ("svc-b-0", "n1")], ["n1"], ("node", "n1")),
    ("service", [("svc-a-0", "n1"), ("svc-a-1", "n2")], [], ("service", "svc-a")),
    ("pod", [("svc-a-0", "n1")], [], ("pod", "svc-a-0")),
    ("unknown", [("other-0", "n9")], [], None)])
def test_fault_level_by_a_given_list(spark, level, pods, shifted, want):
    ev = spark.createDataFrame([("u", p, n, "edge") for p, n in pods], "uuid string, pod string, node string, source string")
    node = spark.createDataFrame([("u", n, "shifted") for n in shifted], "uuid string, node string, status string")
    comp = E.component_list(spark, ["n1"], ["svc-a", "svc-b"], ["svc-a-0", "svc-a-1", "svc-b-0"])
    got = [(r.level, r.component) for r in E.fault_level(ev, node, comp).collect()]
    assert got == ([want] if want else [])
