"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised words may differ by ``budget(m)`` = m // 6 word edits. It is split into budget + 1
pieces, of which one must stand unchanged in any text within the budget. One automaton finds all exact piece
hits in a text; around each hit the whole item is verified with Myers' bit-parallel distance over words.
The benchmark is dealt by hash to slices of bounded size, each with its own pass over the documents, so no
task ever holds more than a slice and every item is tried at any benchmark size; the driver collects a slice at a time.

Defined results: words are runs of letters, digits and underscores, lower-cased; in scripts written without spaces
(Chinese, Japanese, Thai, Lao, Khmer, Burmese) each character is a word of its own; null or empty texts match nothing;
items of up to 5 words must stand unchanged (budget 0), items without a word match nothing; a repeated item is matched under each
id once; of equally near places the first is reported; an empty table on either side gives an empty result; other
columns are ignored by :func:`matches` and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import slices as small_batches, strings

MIN_WORDS = 1
SLICE_CHARS = 8 << 20

# scripts without spaces between words, with their marks
_UNSPACED = ("\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u17dd\u3005-\u3007\u3021-\u3029"
             "\u3031-\u3035\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
             "\U00020000-\U0003ffff")
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]")
_BUILT: dict = {}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def budget(m: int) -> int:
    return m // 6


def piece_bounds(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 even pieces of m words."""
    return [(i * m // (k + 1), (i + 1) * m // (k + 1)) for i in range(k + 1)]


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Smallest word edit distance of ``pattern`` to any stretch of ``text`` and the end of the first such stretch."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full         # a stretch may start anywhere: no carry into the lowest row
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _automaton(items: list[tuple[int, list[str]]]):
    import ahocorasick
    machine, where = ahocorasick.Automaton(), {}
    for n, (_, words) in enumerate(items):
        for a, b in piece_bounds(len(words), budget(len(words))):
            where.setdefault(" " + " ".join(words[a:b]) + " ", []).append((n, a))
    for text, places in where.items():
        machine.add_word(text, (len(text), places))
    machine.make_automaton()
    return machine


def find(text: str, items: list, machine) -> list[tuple[int, int, int, int, int]]:
    """(item_id, distance, budget, start word, end word) of every item within its budget, nearest place each."""
    words = words_of(text)
    spaced = " " + " ".join(words) + " "
    tried: set[tuple[int, int]] = set()
    starts = None
    best: dict[int, tuple[int, int, int]] = {}
    for last, (size, places) in machine.iter(spaced):
        if starts is None:
            starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        at = int(np.searchsorted(starts, last - size + 1))
        for n, offset in places:
            if (n, at - offset) in tried:
                continue
            tried.add((n, at - offset))
            item_id, own = items[n]
            m, k = len(own), budget(len(own))
            if n in best and best[n][0] == 0 and best[n][1] <= at - offset:
                continue
            lo = max(0, at - offset - k)
            d, end = myers(own, words[lo:at - offset + m + k])
            if d <= k:
                back = myers(own[::-1], words[lo:lo + end][::-1])[1]
                hit = (d, lo + end - back, lo + end)
                if n not in best or hit < best[n]:
                    best[n] = hit
    return sorted((items[n][0], d, budget(len(items[n][1])), s, e) for n, (d, s, e) in best.items())


def slices(benchmark: DataFrame, slice_chars: int = SLICE_CHARS) -> Iterator[list[tuple[int, list[str]]]]:
    """The benchmark's items as lists of bounded size, one at a time."""
    src = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = src.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // slice_chars))
    for k in range(n):
        rows = src.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        own = sorted({(r["item_id"] if r["item_id"] is not None else -1, tuple(words_of(r["text"]))) for r in rows})
        del rows
        own = [(i, list(w)) for i, w in own if len(w) >= MIN_WORDS]
        yield own
        own.clear()             # the broadcast has its own copy


def _shared(spark, items):
    """A function that gives the items and their automaton, built once in each Python worker."""
    sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex   # at most SLICE_CHARS of text

    def get():
        if _BUILT.get("key") != key:
            _BUILT.update(key=key, items=sent.value, machine=_automaton(sent.value))
        return _BUILT["items"], _BUILT["machine"]

    return get


def matches(docs: DataFrame, benchmark: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, budget, start_word, end_word`` of every item that a document holds."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    names = ["doc_id", "item_id", "distance", "budget", "start_word", "end_word"]
    out = None
    for items in slices(benchmark, slice_chars):
        get = _shared(docs.sparkSession, items)

        def run(batches, get=get, any_item=bool(items)):
            for b in small_batches(batches):
                rows = []
                if any_item:
                    items, machine = get()
                    for d, t in zip(b.column("doc_id").to_pylist(), strings(b, "text")):
                        rows += [(d, *hit) for hit in find(t, items, machine)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names)

        part = src.mapInArrow(run, ", ".join(f"{n} long" for n in names))
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item; no join and no shuffle."""
    for items in slices(benchmark, slice_chars):
        if not items:
            continue
        get = _shared(docs.sparkSession, items)

        def run(batches, get=get):
            for b in small_batches(batches):
                items, machine = get()
                clean = [not find(t, items, machine) for t in strings(b, "text")]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
