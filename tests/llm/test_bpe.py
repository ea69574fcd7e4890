"""BPE encoding and decoding against the library and against merging by rank."""

from __future__ import annotations

import hashlib
import random

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from faultlens.llm import bpe
from faultlens.llm.queries import QUERIES
from tests.llm.test_llm import ODD, SF

ODD_TEXTS = [t for _, t in ODD] + [
    "<|startoftext|><|endoftext|>x<|endoftext|", "it's IT'S 'sum ''s don't", "ΑΣ Σ σς İstanbul ẞ ﬁ é é", "a\x00b \x1c \x85 \xa0x y　z",
    "٣ Ⅷ ½ 日本語テキスト 한국어", "\U0001F600\U0001F468‍\U0001F469 ́x x́", "tabs\tand\r\nlines\x0b\x0c", "a" * 3000 + "b" * 200, "é" * 500, "   ", "!?!" * 400]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(bpe.default_tokenizer())


def expected(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def digest(ids, text):
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_library(spark, tok):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = sorted(tuple(r) for r in QUERIES["op13_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == sorted((d["doc_id"], *digest(*expected(tok, d["text"]))) for d in docs)


def test_odd_texts_repeated_rows_and_clashing_columns(spark, tok):
    rows = [(k if k % 5 else None, t, "x", 1) for k, t in enumerate(ODD_TEXTS)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = sorted(((r.doc_id, list(r.ids), r.text) for r in bpe.encode(df, decoded=True).collect()), key=repr)
    assert got == sorted(((d, *expected(tok, t)) for d, t, *_ in rows), key=repr)
    apart = bpe.decode(bpe.encode(df)).collect()
    assert sorted((r.text for r in apart)) == sorted(t for _, _, t in got)
    assert bpe.encode(df.where("false"), decoded=True).collect() == []


def test_decode_leaves_out_special_and_unknown_ids(spark, tok):
    lists = [[49407, 1, 2, 49406], [49406], [], None, [5, 10 ** 6, -4, 7]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df, skip_special_tokens=True).collect()}
    assert got == {0: tok.decode([1, 2]), 1: "", 2: "", 3: "", 4: tok.decode([5, 7])}


def by_rank(word, rank):
    """Plain BPE: the pair of lowest rank is merged, leftmost first, until none is left."""
    parts = list(word)
    while True:
        best = min(((rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        pair, out, k = tuple(parts[best[1]:best[1] + 2]), [], 0
        while k < len(parts):
            if tuple(parts[k:k + 2]) == pair:
                out.append("".join(pair))
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out


@pytest.mark.parametrize("seed", range(30))
def test_backtracking_equals_merging_by_rank(seed):
    """Random merge tables, so that longest matches are often wrong and many places are given up."""
    rng = random.Random(seed)
    letters = "abc"[:rng.randint(1, 3)]
    tokens, rank = list(letters), {}
    for _ in range(60):
        pair = (rng.choice(tokens), rng.choice(tokens))
        grown = {**rank, pair: len(rank)}
        if "".join(pair) not in tokens and by_rank("".join(pair), grown) == ["".join(pair)]:   # as in a trained table
            rank = grown
            tokens.append("".join(pair))
    own = bpe.Merges({t: k for k, t in enumerate(tokens)}, list(rank))
    for _ in range(300):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 25)))
        assert [own.text[t] for t in own.encode(word)] == by_rank(word, rank)


def test_every_token_of_the_vocabulary_is_reached(tok):
    own = bpe.codec(bpe.default_tokenizer()).merges
    for k in range(own.base, len(own.text)):
        assert own.encode(own.text[k]) == [k] and not own._stands(own.left[k], own.right[k])
