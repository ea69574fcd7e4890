"""Cross-tokenizer alignment against whole-text tokenisation, a byte-by-byte alignment and plain counting."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from faultlens.llm import align
from faultlens.llm.queries import QUERIES
from tests.llm.test_bpe import ODD_TEXTS
from tests.llm.test_llm import SF

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_OWN = {}


def own():
    if not _OWN:
        _OWN["x"] = align.Aligner(*align.default_tokenizers())
    return _OWN["x"]


def whole(text):
    """Group text, token counts and links of a text tokenised as a whole, by the owner of each byte."""
    if not text:
        return None
    x, want = own(), (" " + text).encode()
    a, b = x.a.encode(" " + text, add_special_tokens=False).ids, x.b.encode(text)
    left, right = [x.a_bytes[i] for i in a], [x.b_bytes[i] for i in b]
    if b"".join(left) != want or b"".join(right) != want:
        return None
    of_a = [k for k, t in enumerate(left) for _ in t]
    of_b = [k for k, t in enumerate(right) for _ in t]
    links = sorted(set(zip(of_a, of_b)))
    ends = set(np.cumsum([len(t) for t in left]).tolist()) & set(np.cumsum([len(t) for t in right]).tolist())
    cuts = [0, *sorted(ends)]
    groups = [(sorted(set(of_a[s:e])), sorted(set(of_b[s:e]))) for s, e in zip(cuts, cuts[1:])]
    text = ";".join(",".join(str(a[k]) for k in g) + "|" + ",".join(str(b[k]) for k in h) for g, h in groups)
    return text, len(a), len(b), len(groups), [(a[i], b[j]) for i, j in links]


def expected(rows):
    found = [(d, whole(t)) for d, t in rows]
    count = Counter(p for _, w in found if w for p in set(w[4]))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for d, w in found:
        if w is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            text, n_a, n_b, n_groups, links = w
            out.append((d, n_a, n_b, n_groups, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                        hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert got(QUERIES["op11_alignment"](spark, SF)) == expected(rows)


SPACES = ["a  b", "a\n b", "a \n b", " lead", "trail ", "  ", "x\u00a0 y", "x \u00a0y", "\u2581 z\u2581", "one \t two", "end\n", "a\x1c b", "<s> </s> <unk> <0x41>"]


@pytest.mark.parametrize("links,rows", [(align.CHUNK_LINKS, align.CHUNK_ROWS), (40, align.CHUNK_ROWS), (10 ** 6, 3)])
def test_odd_texts_repeated_rows_small_chunks(spark, monkeypatch, links, rows):
    monkeypatch.setattr(align, "CHUNK_LINKS", links)
    texts = ODD_TEXTS + SPACES + ["the cat and the dog"] * 7 + ["the the the the the"] * 3
    data = [(k if k % 6 else None, t) for k, t in enumerate(texts)] + [(1, texts[3])] * 2
    df = spark.createDataFrame([(d, t, 1, "c", "g") for d, t in data], "doc_id long, text string, a int, chunk string, groups string")
    if rows == 3:       # chunks that end by documents
        data = data[-12:]
        df = spark.createDataFrame([(d, t) for d, t in data], "doc_id long, text string").coalesce(1)
    assert got(align.alignment(df)) == expected(data)
    assert align.alignment(df.where("false")).collect() == []


def test_groups_are_given_as_text(spark):
    text = "Backtracking tokenisers, aligned: na\u00efve caf\u00e9s"
    row = align.alignment(spark.createDataFrame([(1, text)], "doc_id long, text string"), groups=True).first()
    assert row.groups == whole(text)[0]


def test_planes_and_bitmaps():
    """Multiplicities come back from the planes, sparse and dense; their OR and weighted popcounts count."""
    rng = np.random.default_rng(5)
    links = {(7, 9): {int(p): int(m) for p, m in zip(rng.choice(60_000, 9000, False), rng.integers(1, 9, 9000))},
             (7, 10): {5: 1}, (50_000, 31_999): {0: 3, 65_535: 4}}
    codes = np.array([a << 31 | b << 16 | p for (a, b), at in links.items() for p, m in at.items() for _ in range(m)], np.int64)
    rng.shuffle(codes)
    found = {}
    for batch in align.postings(codes, 3):
        for r in batch.to_pylist():
            at = Counter()
            for d, plane in enumerate(r["planes"]):
                for p in align.places(plane).tolist():
                    at[p] += 1 << d
                assert align.popcount(plane) == len(align.places(plane))
            found[r["a"], r["b"]] = dict(at)
    assert found == links


def test_measured_counts(spark):
    rng = np.random.default_rng(6)
    links = {(1, k): {int(p): int(m) for p, m in zip(rng.choice(65_536, n, False), rng.integers(1, 6, n))} for k, n in enumerate((1, 40, 5000, 20_000))}
    codes = np.array([a << 31 | b << 16 | p for (a, b), at in links.items() for p, m in at.items() for _ in range(m)], np.int64)
    posts = spark.createDataFrame(pa.Table.from_batches(align.postings(codes, 0)).select(["chunk", "a", "b", "planes"]))
    got = {(r.a, r.b): (r.docs, r.links) for r in align.measured(posts).collect()}
    assert got == {k: (len(v), sum(v.values())) for k, v in links.items()}


class Counted:
    """Tokenizer A, counting the strings it is given."""

    def __init__(self, a):
        self.a, self.strings = a, 0

    def encode_batch_fast(self, texts, **options):
        self.strings += len(texts)
        return self.a.encode_batch_fast(texts, **options)


def same_as_whole(x, texts):
    for t, (n_a, n_b, n_groups, groups, links) in zip(texts, x.texts(texts), strict=True):
        want = whole(t)
        if want is None:
            assert (n_a, n_b, n_groups, groups, links) == (0, 0, 0, None, b"")
        else:
            pairs = [(c >> 31, c >> 16 & 0x7FFF) for c in np.frombuffer(links, "<i8").tolist()]
            assert (groups.decode(), n_a, n_b, n_groups, sorted(pairs)) == (want[0], *want[1:4], sorted(want[4]))


def test_new_parts_are_tokenised_together():
    """New words go to A many at a time, and give what the whole texts give."""
    x = align.Aligner(*align.default_tokenizers())
    x.a = Counted(x.a)
    texts = [" ".join(f"{w}{k}x{n}" for n in range(300)) for k, w in enumerate(("na\u00efve", "Word", "don't,", "\u4e2d\u6587"))]
    same_as_whole(x, texts)
    assert x.a.strings <= 4 * 300 // 16
    again = x.a.strings
    same_as_whole(x, texts[::-1])
    assert x.a.strings == again


@pytest.mark.parametrize("parts", [4, 40])
def test_parts_forgotten_and_met_again(monkeypatch, parts):
    """A small memory, odd ends, words that a tokenizer does not give back beside others, words too long to keep."""
    monkeypatch.setattr(align, "PARTS", parts)
    x = align.Aligner(*align.default_tokenizers())
    texts = [*ODD_TEXTS, *SPACES, "a word \u2581 b", "the long " + "ab" * 200 + " word", "x\t y", "y \u3000z", "", None, "the word a b " * 3]
    rng = np.random.default_rng(7)
    for _ in range(12):
        same_as_whole(x, [texts[k] for k in rng.integers(0, len(texts), 9)])
    assert not any(len(p) > align.LONG_PART for p in x.number)
