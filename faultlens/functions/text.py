"""Text helpers: error predicate (F2), service-from-pod (X1), template
tokens (D1 tokenisation), masking (D3), JSON extraction (X12), word
truncation (X13). All built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that mark an error log line (matched case-insensitively).
ERROR_KEYWORDS = ("error", "failed", "exception")

# Template-miner settings in force.
TEMPLATE_DELIMITERS = "_|:=,"          # each replaced by a space before splitting
TEMPLATE_PREFIX_DEPTH = 7              # leading tokens that route a message to its cluster
TEMPLATE_WILDCARD = "<*>"

# Whitespace as Python's str.split() understands it, written so that Java
# regex and RE2 read it the same way.
WHITESPACE_CLASS = (r"[\t\n\x0B\f\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
                    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def error_predicate(msg: Column, keywords=ERROR_KEYWORDS) -> Column:
    """any keyword, case-insensitive; a null message is not an error."""
    low = F.lower(msg)
    cond = None
    for k in keywords:
        c = F.contains(low, F.lit(k))
        cond = c if cond is None else (cond | c)
    return F.coalesce(cond, F.lit(False))


def service_from_pod(pod: Column) -> Column:
    """Leading ``[A-Za-z0-9]+`` run of the pod name; no match -> the pod name."""
    s = F.regexp_extract(pod, r"^([a-zA-Z0-9]+)", 1)
    return F.when(pod.isNull(), F.lit(None)).when(s == "", pod).otherwise(s)


def template_tokens(msg: Column, delimiters: str = TEMPLATE_DELIMITERS) -> Column:
    """Tokenise like the template miner: delimiters -> space, split on whitespace."""
    cls = "[" + "".join("\\" + ch if ch in "|^]\\-" else ch for ch in delimiters) + "]"
    spaced = F.regexp_replace(F.coalesce(msg, F.lit("")), cls, " ")
    return F.filter(F.split(spaced, WHITESPACE_CLASS), lambda t: t != "")


def template_bucket_key(tokens: Column, depth: int = TEMPLATE_PREFIX_DEPTH) -> Column:
    """Cluster routing key: token count + first min(depth, n-1) tokens, with
    digit-bearing tokens replaced by the wildcard."""
    n = F.size(tokens)
    k = F.greatest(F.lit(0), F.least(F.lit(depth), n - 1))
    # tokens never hold spaces, so a run of non-spaces with a digit is exactly one token
    prefix = F.regexp_replace(F.array_join(F.slice(tokens, 1, k), " "), "[^ ]*[0-9][^ ]*", TEMPLATE_WILDCARD)
    return F.concat(n.cast("string"), F.lit(" "), prefix)


def apply_masks(text: Column, rules) -> Column:
    """D3: ordered fold of ``regexp_replace(pattern -> <:NAME:>)``."""
    out = text
    for pattern, name in rules:
        out = F.regexp_replace(out, pattern, f"<:{name}:>")
    return out


def extract_json_object(text: Column) -> Column:
    """Greedy ``{...}`` across lines; no match -> null."""
    s = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(s == "", F.lit(None)).otherwise(s)


def balanced_objects(text: Column) -> Column:
    """Every balanced ``{...}`` of a text, the ones that start first in front; braces inside JSON strings are text.

    One fold over the characters keeps the open braces' places, so any depth is met and an unclosed brace hides nothing
    behind it. Strings are told only inside a brace, so quotes in the prose around do not matter.
    """
    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    ints, spans = F.array().cast("array<int>"), F.array().cast("array<struct<s:int,e:int>>")
    zero = F.struct(F.lit(0).alias("i"), ints.alias("open"), F.lit(False).alias("q"), F.lit(False).alias("esc"), spans.alias("found"))

    def step(a, c):
        inside = F.size(a["open"]) > 0
        code = inside & ~a["q"]
        closes = code & (c == "}")
        opens = (c == "{") & ~a["q"]
        last = F.element_at(a["open"], -1)
        return F.struct(
            (a["i"] + 1).alias("i"),
            F.when(opens, F.concat(a["open"], F.array(a["i"] + 1)))
            .when(closes, F.slice(a["open"], F.lit(1), F.size(a["open"]) - 1)).otherwise(a["open"]).alias("open"),
            (inside & F.when(a["q"], ~((c == '"') & ~a["esc"])).otherwise(c == '"')).alias("q"),
            (a["q"] & (c == "\\") & ~a["esc"]).alias("esc"),
            F.when(closes, F.concat(a["found"], F.array(F.struct(last.alias("s"), (a["i"] + 1).alias("e"))))).otherwise(a["found"]).alias("found"))

    done = F.aggregate(chars, zero, step, lambda a: F.array_sort(a["found"]))
    return F.transform(done, lambda x: F.substring(text, x["s"], x["e"] - x["s"] + 1))


def first_words(text: Column, n: int = 20) -> Column:
    """Keep the first ``n`` space-separated words."""
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")
