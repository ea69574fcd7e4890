"""Template mining (D1), matching (D2): routes, leader clusters inside a route, position-wise merge.

A message's tokens give its route: token count and leading tokens, digit-bearing ones wildcarded. Messages belong to
one cluster when they share at least ``sim_th`` of their positions. The literal leading tokens of a route are shared by
all its messages, so a route with enough of them is one cluster by itself (nearly all are). The distinct token lists of
the other, *loose* routes are clustered by leaders: in the order of their ids (a hash, so in no order of the data) a list
that is similar to no earlier leader leads a cluster; every other list joins the leader with which it shares most
positions, the first of equals. The outcome depends on the set of lists alone, not on their order or partitioning.

The leaders are found in parallel rounds instead of one after another. Similar lists differ in at most ``n - m``
positions (``m``: positions to share), so of ``n - m + 1`` blocks of positions one is equal; a list that is the least of
the undecided ones under all its block keys can have no earlier similar one and leads. Lists similar to a new leader are
decided too, and the next round goes on with the rest. Each round is two grouped aggregations and an equi-join on block
keys; no route sits in one task and no pairs of members are formed.

Token lists travel as their joined text (tokens hold no space), which is about a third of the array's bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.text import TEMPLATE_WILDCARD, template_bucket_key, template_tokens
from faultlens.operators.interval import cut

# Template-miner settings in force.
SIM_TH = 0.01
DEPTH = 10               # levels of the route: its top two and the token count leave seven leading tokens

PART_BYTES = 16 << 20    # texts of a cluster that are merged in one row; larger clusters are merged in parts


def prefix_length(depth: int = DEPTH) -> int:
    """Leading tokens that take part in the route."""
    return max(0, depth - 3)


def tokenize(messages: DataFrame, message: str = "message", *, depth: int = DEPTH, text: Column | None = None) -> DataFrame:
    """Adds ``token_text`` (the tokens joined by spaces), the route ``bucket_key`` and ``list_id``, which stands for the
    token list in every key."""
    t = messages.withColumn("_tokens", template_tokens(F.col(message) if text is None else text))
    t = t.withColumns({"token_text": F.array_join("_tokens", " "), "bucket_key": template_bucket_key(F.col("_tokens"), prefix_length(depth))})
    return t.withColumn("list_id", F.md5("token_text")).drop("_tokens")


def _tokens(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def _size(bucket_key: Column) -> Column:
    """The token count, which a route begins with."""
    return F.substring_index(bucket_key, " ", 1).cast("int")


def token_lists(tokenized: DataFrame, scope: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """``(scope..., bucket_key, token_text, n, list_id)``: the distinct token lists with their numbers of messages.

    The text is a key, not a value, of the aggregation: it hashes its rows without sorting them.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return tokenized.groupBy(*scope, "bucket_key", "token_text").agg(n.alias("n")).withColumn("list_id", F.md5("token_text"))


def _shared_by_route(text: Column, n: Column, depth: int) -> Column:
    """Literal leading tokens: positions that all messages of the route share."""
    lead = F.slice(F.split(F.substring_index(text, " ", prefix_length(depth)), " "), F.lit(1),
                   F.greatest(F.lit(0), F.least(F.lit(prefix_length(depth)), n - 1)))
    return F.size(F.filter(lead, lambda t: ~t.rlike("[0-9]")))


def is_loose(text: Column, n: Column, sim_th: float = SIM_TH, depth: int = DEPTH) -> Column:
    """Of the joined tokens and their number."""
    return _shared_by_route(text, n, depth) < F.lit(sim_th) * n


def _needed(tokens: Column, sim_th: float) -> Column:
    """Positions to share."""
    return F.greatest(F.lit(1), F.ceil(F.lit(sim_th) * F.size(tokens))).cast("int")


def _block_keys(tokens: Column, sim_th: float, more: Sequence[str]) -> Column:
    """One key per block of positions; lists that share enough positions have one in common."""
    n = F.size(tokens)
    blocks = F.greatest(F.lit(1), n - _needed(tokens, sim_th) + 1)
    at = lambda i: F.floor(i * n / blocks).cast("int")
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.xxhash64(
        *more, i, F.array_join(F.slice(tokens, at(i) + 1, at(i + 1) - at(i)), " ")))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _pairs(lists: DataFrame, leaders: DataFrame, scope: list[str]) -> DataFrame:
    """``(scope..., list_id, leader, shared)`` of lists and leaders with a block key in common that are similar."""
    own = [*scope, "list_id"]
    keyed = lists.select(*own, F.explode("keys").alias("_k"))
    led = leaders.select(*scope, F.col("list_id").alias("leader"), F.explode("keys").alias("_k"))
    met = keyed.join(led, [*scope, "_k"]).select(*own, "leader").distinct()
    full = met.join(lists.select(*own, "bucket_key", "tokens", "needed"), own).join(
        leaders.select(*scope, F.col("list_id").alias("leader"), F.col("tokens").alias("_t"), F.col("bucket_key").alias("_b")), [*scope, "leader"])
    return full.withColumn("shared", _shared(F.col("tokens"), F.col("_t"))).where(
        (F.col("bucket_key") == F.col("_b")) & (F.col("shared") >= F.col("needed"))).select(*own, "leader", "shared")


def leader_clusters(lists: DataFrame, scope: Sequence[str] = (), sim_th: float = SIM_TH) -> DataFrame:
    """``(scope..., list_id, cluster)`` of token lists of loose routes; a cluster is named by its leader.

    Every round's undecided lists are a table, so a lost executor costs one round. The number of rounds grows with the
    logarithm of the lists where one shared position is enough, else with the leaders that share a block.
    """
    scope = list(scope)
    own = [*scope, "list_id"]
    lists = cut(lists.select(*own, "bucket_key", "tokens", _needed(F.col("tokens"), sim_th).alias("needed"),
                             _block_keys(F.col("tokens"), sim_th, [*scope, "bucket_key"]).alias("keys")))
    left, leaders = lists, lists.limit(0)
    while not left.isEmpty():
        keyed = left.select(*own, F.explode("keys").alias("_k"))
        least = keyed.groupBy(*scope, "_k").agg(F.min("list_id").alias("_least"))
        first = keyed.join(least, [*scope, "_k"]).groupBy(*own).agg(F.bool_and(F.col("list_id") == F.col("_least")).alias("_first"))
        new = cut(left.join(first.where("_first").select(*own), own, "left_semi"))
        leaders = leaders.union(new)
        rest = left.join(new.select(*own), own, "left_anti")
        left = cut(rest.join(_pairs(rest, new, scope).select(*own).distinct(), own, "left_anti"))
    others = lists.join(leaders.select(*own), own, "left_anti")
    best = _pairs(others, leaders, scope).groupBy(*own).agg(F.min(F.struct((-F.col("shared")).alias("s"), "leader")).alias("_b"))
    return leaders.select(*own, F.col("list_id").alias("cluster")).union(best.select(*own, F.col("_b.leader").alias("cluster")))


def with_clusters(lists: DataFrame, scope: Sequence[str] = (), *, sim_th: float = SIM_TH, depth: int = DEPTH) -> DataFrame:
    """Adds ``cluster`` to token lists (a stored table): '' in a tight route, a one-token list by itself, else its leader."""
    scope = list(scope)
    n = _size(F.col("bucket_key"))
    is_own = is_loose(F.col("token_text"), n, sim_th, depth)
    several = is_own & (n > 1)
    simple = F.when(is_own, F.col("list_id")).otherwise(F.lit(""))
    loose = lists.where(several)
    if loose.isEmpty():
        return lists.withColumn("cluster", simple)
    named = leader_clusters(loose.withColumn("tokens", _tokens(F.col("token_text"))), scope, sim_th)
    return lists.where(~several).withColumn("cluster", simple).unionByName(loose.join(named, [*scope, "list_id"]))


def _merged_text(texts: Column) -> Column:
    """The template of a cluster's texts; merging merged texts again gives the same."""
    keep = lambda x, y: F.when(x == y, x).otherwise(F.lit(TEMPLATE_WILDCARD))
    fold = F.aggregate(F.slice(texts, F.lit(2), F.size(texts)), F.split(texts[0], " "),
                       lambda a, t: F.zip_with(a, F.split(t, " "), keep))
    return F.when(F.size(texts) == 1, texts[0]).otherwise(F.array_join(fold, " "))


def merged(lists: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """``(scope..., bucket_key, cluster, template, cluster_size)`` of clustered lists.

    A template keeps a token where all lists of its cluster agree. The lists' texts are shuffled once, to their
    cluster. Clusters of more than ``PART_BYTES`` of text are merged in parts, and the parts' templates per position, so
    a hot cluster never sits in one task. Such clusters are counted first, under a hash of their key.
    """
    key = [*scope, "bucket_key", "cluster"]
    keyed = lists.select(*key, "token_text", "n", F.xxhash64(*key).alias("_c"))
    parts = F.ceil(F.sum(F.octet_length("token_text")) / F.lit(PART_BYTES)).alias("_parts")
    hot = cut(keyed.groupBy("_c").agg(parts).where("_parts > 1"))       # at most a row per PART_BYTES of all texts
    whole = lambda df, *more: df.groupBy(*key, *more).agg(
        _merged_text(F.collect_list("token_text")).alias("template"), F.sum("n").cast("long").alias("cluster_size"))
    if hot.isEmpty():
        return whole(keyed)
    small = whole(keyed.join(F.broadcast(hot), "_c", "left_anti"))
    part = F.pmod(F.xxhash64("token_text"), F.col("_parts")).alias("_part")
    some = whole(keyed.join(F.broadcast(hot), "_c").select(*key, "token_text", "n", part), "_part")
    p = some.select(*key, F.posexplode(_tokens(F.col("template"))).alias("pos", "tok"))
    a = p.groupBy(*key, "pos").agg(F.min("tok").alias("lo"), F.max("tok").alias("hi"))
    tok = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(TEMPLATE_WILDCARD))
    text = a.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", tok.alias("tok")))),
                                                        lambda x: x["tok"]), " ").alias("template"))
    sums = some.groupBy(*key).agg(F.sum("cluster_size").alias("cluster_size"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in key]
    return small.unionByName(text.alias("t").join(sums.alias("s"), same).select(*[f"t.{c}" for c in key], "template", "cluster_size"))


def mine_templates(messages: DataFrame, *, scope: Sequence[str] = (), message: str = "message", sim_th: float = SIM_TH,
                   depth: int = DEPTH, with_lists: bool = False):
    """D1 over a message column (or a tokenised frame): ``(scope..., bucket_key, cluster, template, cluster_size)``.

    ``with_lists``: also the clustered lists ``(scope..., list_id, bucket_key, cluster)``, which D2 matches by.
    """
    t = messages if "list_id" in messages.columns else tokenize(messages, message, depth=depth)
    lists = with_clusters(cut(token_lists(t, scope), "zstd"), scope, sim_th=sim_th, depth=depth)
    out = merged(lists, scope)
    return (out, lists.select(*scope, "list_id", "bucket_key", "cluster")) if with_lists else out


def match_templates(messages: DataFrame, templates: DataFrame, lists: DataFrame, *, scope: Sequence[str] = (),
                    message: str = "message") -> DataFrame:
    """The template of each message's cluster (null for a token list that was not mined)."""
    m = messages if "list_id" in messages.columns else tokenize(messages, message)
    named = lists.join(templates.select(*scope, "bucket_key", "cluster", "template"), [*scope, "bucket_key", "cluster"])
    out = m.join(named.select(*scope, "list_id", "template"), [*scope, "list_id"], "left")
    return out.drop("bucket_key", "token_text", "list_id")
