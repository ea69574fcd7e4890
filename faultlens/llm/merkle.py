"""Merkle manifest of a table with a proof for every row, by one multiproof per leaf partition.

A row's leaf is the hash of its fields; the leaves of one language, by doc_id, are the leaves of its tree, and the trees'
roots, by language, those of the manifest's tree. Nodes are joined two by two, a last node without partner alone.

Scale: the rows' hashes are ranged by (lang, doc_id) and numbered by range, with no sort in one task; the text never
leaves the scan. A leaf partition is an aligned run of ``2 ** BITS`` leaves, so it holds a whole subtree. Trees are built
``BITS`` levels at a time, each step a grouping by run. For the proofs a partition names the nodes that its leaves need
and that its own leaves do not give (the least union: one per level above it, whatever the number of leaves), fetches
them once by an equi-join, derives all shared inner nodes from its leaves, and expands every single proof by itself.
Nodes near a root are wanted by many partitions: they are laid out once per run of ``2 ** BITS`` partitions, so no join
key has more rows than that.

Defined results: null fields are hashed as ``-``; rows without a lang form the first tree, rows without a doc_id come
first in theirs; rows of one doc_id are ordered by leaf, and repeated rows, whose leaves are equal, hold one place each;
a lone leaf is its tree's root, a lone tree's root is the root; an empty table gives an empty table; columns other than
the five hashed ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import fresh, stored

BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def tree_of(lang: Column) -> Column:
    """The tree of a language; sorts as the languages do, null first, then bytewise."""
    return F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), lang.cast("string")))


def leaf_of(values: list[Column]) -> Column:
    """Lower-case hex sha256 of the fields, each with its UTF-8 length in front."""
    return F.sha2(F.concat(*map(_field, values)).cast("binary"), 256)


def tampered_where(doc_id: Column) -> Column:
    """Rows whose unsigned crc32 of the decimal doc_id is divisible by 7; never a null one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, leaf, seen, tie``: ``seen`` is the leaf as it is found later, after tampering."""
    src = docs.select(*FIELDS)
    cols = {c: F.col(c) for c in FIELDS}
    more = {**cols, "n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}     # no overflow
    own = leaf_of(list(cols.values()))
    return src.select(tree_of(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("leaf"),
                      F.when(tampered_where(F.col("doc_id")), leaf_of(list(more.values()))).otherwise(own).alias("seen"),
                      F.monotonically_increasing_id().alias("tie"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``idx``, a row's place in its tree by ``order``, and ``n``, the tree's rows.

    The rows are ranged and sorted, and a range's rows of a tree start where the earlier ranges' rows of it end.
    """
    ranged = df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33).alias("_part")
    runs = rows.groupBy("tree", part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
                       F.sum("_rows").over(Window.partitionBy("tree")).alias("n"))
    joined = rows.withColumn("_part", part).join(runs, ["tree", "_part"])
    return joined.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _levels(nodes: list[str], up: int) -> list[list[str]]:
    """The nodes of a run and of the ``up`` levels above them."""
    out = [nodes]
    for _ in range(up):
        below = out[-1]
        out.append([digest(*below[k:k + 2]) for k in range(0, len(below), 2)])
    return out


def height(n: int) -> int:
    return (n - 1).bit_length()


def _right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def _height(n: Column) -> Column:
    """As :func:`height`: the binary digits of ``n - 1``."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def upper_nodes(rows: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """``tree, n, level, idx, node`` of every level from ``bits`` on (and of every root) over ``rows(tree, idx, n, node)``."""
    def climb(inner: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("idx")
            tree, n, level = pdf["tree"].iloc[0], int(pdf["n"].iloc[0]), int(pdf["level"].iloc[0])
            at = int(pdf["idx"].iloc[0])
            levels = _levels(pdf["node"].tolist(), min(bits, height(n) - level))
            out = [(tree, n, level + k, (at >> k) + j, x) for k, nodes in enumerate(levels)
                   if k and (inner or k == len(levels) - 1) for j, x in enumerate(nodes)]
            return pd.DataFrame(out, columns=["tree", "n", "level", "idx", "node"])
        return run

    schema = "tree string, n long, level int, idx long, node string"
    now = rows.select("tree", "n", F.lit(0).alias("level"), "idx", "node")
    tops = now.where("n = 1")                     # a lone leaf is the root
    most = rows.agg(F.max("n")).first()[0] or 0
    made = None
    for level in range(0, height(most), bits):
        step = now.where((F.col("level") == level) & (F.col("idx") >= 0)).withColumn("_run", F.shiftright("idx", bits))
        step = step.where(_height(F.col("n")) > level)
        now = stored(step.groupBy("tree", "_run").applyInPandas(climb(level > 0), schema), f"{name}-{level}")
        made = now if made is None else made.union(now)
        now = now.where(F.col("level") == level + bits)
    return tops if made is None else tops.union(made)


def roots(nodes: DataFrame) -> DataFrame:
    """``tree, n, root``"""
    return nodes.where(F.col("level") == _height(F.col("n"))).select("tree", "n", F.col("node").alias("root"))


def fetched(runs: DataFrame, nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """``tree, run, path``: for every run of leaves (``runs(tree, n, run)``) the nodes that its own leaves do not give.

    One node per level from ``bits`` up to the root, where there is a partner, in this order.
    """
    level = F.col("level")
    high = _height(F.col("n"))
    partner = _right(F.col("run"), level - bits).bitwiseXOR(F.lit(1).cast("long"))
    last = _right(F.col("n") - 1, level)
    wanted = runs.where(high > bits).withColumn("level", F.explode(F.sequence(F.lit(bits), high - 1)))
    wanted = wanted.withColumn("idx", partner).where(F.col("idx") <= last).select(
        "tree", "run", "level", "idx", F.shiftright("run", bits).alias("shard"))
    # a node serves the runs under its partner: once for each 2 ** bits of them
    served = F.col("idx").bitwiseXOR(F.lit(1).cast("long"))
    first = F.shiftright(_left(served, level - bits), bits)
    final = F.least(F.shiftright(_left(served + 1, level - bits) - 1, bits), F.shiftright(F.col("n") - 1, 2 * bits))
    laid = nodes.where((level >= bits) & (level < high)).withColumn("_first", first).withColumn("_final", final)
    laid = laid.where("_first <= _final").select("tree", "level", "idx", "node", F.explode(F.sequence("_first", "_final")).alias("shard"))
    got = wanted.join(laid, ["tree", "level", "idx", "shard"])
    return got.groupBy("tree", "run").agg(F.sort_array(F.collect_list(F.struct("level", "node"))).alias("_p")).select(
        "tree", "run", F.col("_p.node").alias("path"))


def _siblings(levels: list[list[str]], j: int, path: list[str]) -> list[str]:
    """The partners of a run's leaf ``j`` on the way up, then those of the run."""
    own = []
    for nodes in levels[:-1]:
        if j ^ 1 < len(nodes):
            own.append(nodes[j ^ 1])
        j >>= 1
    return own + path


def fold(node: str, idx: int, n: int, siblings) -> str:
    """The root that a leaf at ``idx`` of ``n`` and its siblings (an iterator) give."""
    while n > 1:
        if idx ^ 1 < n:
            other = next(siblings)
            node = digest(other, node) if idx & 1 else digest(node, other)
        else:
            node = digest(node)
        idx, n = idx >> 1, (n + 1) >> 1
    return node


def proofs(rows: DataFrame, nodes: DataFrame, above: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, leaf, subroot, siblings, folded`` for ``rows(tree, doc_id, leaf, seen, idx, n)``.

    ``above(tree, n, root, place, trees, upper)``: where a tree's root hangs in the tree over it, and its siblings there.
    """
    keyed = rows.withColumn("run", F.shiftright("idx", bits))
    runs = keyed.groupBy("tree", "n", "run").agg(F.count(F.lit(1)).alias("_n")).select("tree", "n", "run")
    # a tree's own row is laid out once for each 2 ** bits of its runs
    wide = above.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, 2 * bits)))).drop("n")
    need = runs.withColumn("shard", F.shiftright("run", bits)).join(wide, ["tree", "shard"])
    need = need.join(fetched(runs, nodes, bits), ["tree", "run"], "left").select("tree", "run", "path", "root", "place", "trees", "upper")

    def expand(own: pd.DataFrame, need: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        n, got = int(own["n"].iloc[0]), need.iloc[0]
        path = list(got["path"]) if got["path"] is not None else []
        upper, place, trees = list(got["upper"]), int(got["place"]), int(got["trees"])
        levels = _levels(own["leaf"].tolist(), min(bits, height(n)))
        siblings = [_siblings(levels, j, path) + upper for j in range(len(own))]
        folded = []
        for idx, seen, others in zip(own["idx"].tolist(), own["seen"].tolist(), siblings):
            others = iter(others)
            folded.append(fold(fold(seen, idx, n, others), place, trees, others))
        return own[["doc_id", "leaf"]].assign(subroot=got["root"], siblings=siblings, folded=folded)

    schema = "doc_id long, leaf string, subroot string, siblings array<string>, folded string"
    parts = keyed.select("tree", "doc_id", "leaf", "seen", "idx", "n", "run")
    return parts.groupBy("tree", "run").cogroup(fresh(need).groupBy("tree", "run")).applyInPandas(expand, schema)


def manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, leaf, subroot, root, siblings, folded_root, verified`` of every row."""
    rows = numbered(stored(leaves(docs), "leaves"), ["doc_id", "leaf", "tie"], "ordered")
    rows = stored(rows.select("tree", "doc_id", "leaf", "seen", "idx", "n"), "numbered")
    nodes = upper_nodes(rows.withColumnRenamed("leaf", "node"), "nodes", bits)
    # the tree over the trees, by the same steps
    trees = roots(nodes).select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("leaf"), F.col("n").alias("rows"))
    trees = stored(numbered(stored(trees, "roots"), ["lang"], "languages"), "places")
    over = upper_nodes(trees.withColumnRenamed("leaf", "node"), "over", bits)
    top = roots(over).first()
    itself = trees.select("tree", "n").distinct().withColumns({"root": F.lit(""), "place": F.lit(0).cast("long"), "trees": F.lit(1).cast("long"),
                                                               "upper": F.array().cast("array<string>")})
    hung = proofs(trees.select("tree", F.col("idx").alias("doc_id"), "leaf", F.col("leaf").alias("seen"), "idx", "n"), over, itself, bits)
    above = trees.join(hung.select(F.col("doc_id").alias("idx"), F.col("siblings").alias("upper")), "idx").select(
        F.col("lang").alias("tree"), F.col("rows").alias("n"), F.col("leaf").alias("root"), F.col("idx").alias("place"),
        F.col("n").alias("trees"), "upper")
    done = proofs(rows, nodes, stored(above, "above"), bits)
    root = F.lit(top["root"] if top else None).cast("string")
    return done.select("doc_id", "leaf", "subroot", root.alias("root"), "siblings", F.col("folded").alias("folded_root"),
                       (F.col("folded") == root).alias("verified"))
