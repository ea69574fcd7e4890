"""Merkle manifest: the query and odd tables against a plain recursion over all rows."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from faultlens.llm import merkle
from faultlens.llm.queries import QUERIES
from tests.llm.test_llm import SF

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    out = []
    for k in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[k]
        if v is not None and k == "n_chars":
            v += add
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*out)


def tree(nodes):
    """All levels, and per leaf the siblings as (on the left?, node) or (None, None) where it stands alone."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[k:k + 2]) for k in range(0, len(below), 2)])
    ways = []
    for j in range(len(nodes)):
        way = []
        for level in levels[:-1]:
            way.append((j % 2 == 1, level[j ^ 1]) if (j ^ 1) < len(level) else (None, None))
            j //= 2
        ways.append(way)
    return levels[-1][0], ways


def expected(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    done = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        done[lang] = own, *tree([leaf(r) for r in own])
    root, tops = tree([done[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, tops):
        own, subroot, ways = done[lang]
        for r, way in zip(own, ways):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r, 1 if bad else 0)
            for left, other in way + top:
                node = h(node) if other is None else h(other, node) if left else h(node, other)
            out.append((r["doc_id"], leaf(r), subroot, root, h(*[x for _, x in way + top if x]), node, node == root))
    return sorted(out, key=repr)


def got(df):
    proof = F.sha2(F.array_join("siblings", "").cast("binary"), 256).alias("proof_sha256")
    return sorted((tuple(r) for r in df.withColumn("proof_sha256", proof).select(*COLUMNS).collect()), key=repr)


def test_query(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    result = QUERIES["op12_merkle"](spark, SF)
    found = sorted((tuple(r) for r in result.select(*COLUMNS).collect()), key=repr)
    assert found == expected(rows)
    assert {v for *_, v in found} == {True, False}


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, tree string, idx string"


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], 1, "t", "i") for r in rows], SCHEMA)


def row(doc_id, lang, text="x", n_chars=1, source="s"):
    return {"doc_id": doc_id, "source": source, "lang": lang, "n_chars": n_chars, "text": text}


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_small_runs_nulls_ties_and_clashing_names(spark, bits):
    rows = [row(k, "en", f"text {k}") for k in range(41)] + [row(k, "d\u00e9", None, None) for k in range(8)]
    rows += [row(7, None), row(None, "en", "no id"), row(None, None, None, None, None), row(3, "en", "another text"), row(5, "fr"), row(0, "", "")]
    rows += [row(12, "zz", "copy")] * 9 + [row(14, "zz", "\u65e5" * 5000, 2 ** 63 - 1)]
    assert got(merkle.manifest(frame(spark, rows), bits)) == expected(rows)


def test_one_row_and_no_row(spark):
    assert got(merkle.manifest(frame(spark, [row(7, "en")]))) == expected([row(7, "en")])
    assert merkle.manifest(frame(spark, [row(7, "en")]).where("false")).collect() == []


def test_many_languages(spark):
    rows = [row(k, f"l{k}", f"t{k}") for k in range(37)]
    assert got(merkle.manifest(frame(spark, rows), 2)) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 9, 16, 17, 33])
def test_partition_fetches_only_what_it_lacks(spark, n):
    """The nodes of a run's request: one per level above it that has a partner, none inside the run."""
    bits = 2
    rows = spark.range(n).selectExpr("'t' AS tree", "id AS idx", f"cast({n} as long) AS n", "sha2(cast(id as string), 256) AS node")
    nodes = merkle.upper_nodes(rows, "t", bits)
    runs = rows.selectExpr("tree", "n", "shiftright(idx, 2) AS run").distinct()
    found = {r.run: list(r.path) for r in merkle.fetched(runs, nodes, bits).collect()}
    levels = [[h(str(k)) for k in range(n)]]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    for run in range((n + 3) // 4):
        want = [levels[k][(run >> (k - bits)) ^ 1] for k in range(bits, len(levels) - 1) if (run >> (k - bits)) ^ 1 < len(levels[k])]
        assert found.get(run, []) == want
