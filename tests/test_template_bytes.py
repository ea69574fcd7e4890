"""Bytes that mining moves: texts hashed, not sorted; one shuffle of them to their clusters; hot clusters in parts."""

import random

from pyspark.sql import functions as F

from faultlens.operators import templates as TP
from faultlens.operators.interval import cut


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_keys_and_shuffled_once_to_their_clusters(spark):
    df = spark.createDataFrame([(f"disk {k % 7} of host {k} is full",) for k in range(60)], "message string")
    lists = TP.token_lists(TP.tokenize(df))
    assert not any(t.startswith("array") for _, t in lists.dtypes)
    assert "SortAggregate" not in plan_of(lists) and plan_of(lists).count("Exchange hashpartitioning") == 1
    merged = TP.merged(TP.with_clusters(cut(lists)))
    assert plan_of(merged).count("Exchange hashpartitioning") == 1
    assert "pos" not in plan_of(merged)                        # tokens are not exploded
    assert [tuple(r) for r in merged.select("template", "cluster_size").collect()] == [("disk <*> of host <*> is full", 60)]


def test_hot_clusters_are_merged_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice("uv"), f"host {rng.choice(['a', 'a', '<*>'])} lost disk {k % 9} at rack r{k % 2} port {rng.choice('xy')} since {k % 40}")
            for k in range(300)]
    rows += [("u", f"{k} {k % 3} {rng.choice('pqr')}") for k in range(60)] + [("u", ""), ("v", None), ("v", "alone in its route")]
    df = spark.createDataFrame(rows, "uuid string, message string").repartition(3)

    def mined():
        out, lists = TP.mine_templates(df, scope=["uuid"], with_lists=True)
        matched = TP.match_templates(TP.tokenize(df), out, lists, scope=["uuid"])
        return sorted(map(tuple, out.collect())), sorted((r.uuid, r.message or "", r.template) for r in matched.collect())

    whole = mined()
    for size in (1, 150, 600):
        monkeypatch.setattr(TP, "PART_BYTES", size)
        assert mined() == whole
    assert sum(r[-1] for r in whole[0]) == len(rows) == len(whole[1])
    assert any("lost disk <*> at rack <*> port <*> since <*>" in r[3] for r in whole[0])


def test_a_hot_cluster_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(TP, "PART_BYTES", 400)
    df = spark.range(200).select(F.concat(F.lit("the disk of the small host is full "), F.col("id")).alias("message"))
    merged = TP.merged(TP.with_clusters(cut(TP.token_lists(TP.tokenize(df)))))
    assert "_part" in plan_of(merged)
    assert [tuple(r)[2:] for r in merged.collect()] == [("the disk of the small host is full <*>", 200)]
