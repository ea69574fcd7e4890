"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Documents are tokenised (a public tokenizer whose file is a parameter), an end id is appended, and only
documents longer than a sequence are cut. A piece of full length is a sequence by itself; the others, which are
counted, are dealt by hash to groups of about ``GROUP`` pieces;
inside a group, pieces are placed longest first, each into the open bin whose change makes the sum of
squared counts of open bins per residual gap smallest. A new bin is opened only where none fits.
A group is a few thousand (id, length) rows however long the documents are, so no task ever sees the corpus; each
group leaves about one part-filled bin in over a thousand.

Ids are those of the plain tokenizer file: the strings of its special tokens in a text are their ids.

Defined results: a null or empty text is one piece holding the end id alone; equal lengths are placed in
the order (doc_id, piece, ids_crc32); repeated rows are packed once each; an empty table gives an empty
table; columns other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.llm.common import by_size, stored, strings

SEQUENCE = 2048
GROUP = 4096
CACHE = 300_000          # runs and words in each of a Python worker's two generations of known ones
LOTS = 16                # strings tokenised at a time
ROWS = 1024              # texts split at a time, of at most about
CHARS = 1 << 20          # as many bytes
LONG_WORD = 64           # longer ones are tokenised, not remembered

SPACE, LETTER, DIGIT, SIGN, HARD = range(5)
# The steps before the merges for which :func:`_runs` finds the runs by itself.
_STEPS = {"normalizer": {"type": "Sequence", "normalizers": [
              {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
          "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
              {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
               "behavior": "Removed", "invert": True},
              {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_STATE: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class _Recent:
    """The latest entries, in two generations: what is met again moves to the young one, the old one is dropped whole."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {"": b""}, {}

    def __contains__(self, key) -> bool:
        return key in self.young or key in self.old

    def __getitem__(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.young[key] = self.old[key]
        return value

    def age(self) -> None:
        if len(self.young) > self.size:
            self.young, self.old = {"": b""}, self.young


def _byte_letters() -> np.ndarray:
    """The letter that stands for each byte in a byte-level vocabulary, spaces left as they are."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in same]
    letters = np.arange(256, dtype="<u4")
    letters[rest] = 256 + np.arange(len(rest))
    letters[32] = 32
    return letters


def _classes(own_runs: bool) -> np.ndarray:
    """The class of each byte. Bytes beyond ASCII, control signs and ``<`` (special tokens) make a word hard."""
    of = np.full(256, HARD, np.uint8)
    of[[32, 10]] = SPACE
    if own_runs:
        of[33:127] = SIGN
        of[48:58] = DIGIT
        of[65:91] = of[97:123] = LETTER
        of[ord("<")] = HARD
    return of


_BYTE_LETTERS = _byte_letters()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_C3 = np.arange(256, dtype=np.uint8)      # second byte of U+00C0 to U+00FF
_LOWER_C3[0x80:0x9F] += 32


def _tokenizer(path: str) -> dict:
    if _STATE.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers
        tok = Tokenizer.from_file(path)
        suffix, ends = getattr(tok.model, "end_of_word_suffix", None), None
        if suffix:
            ends = np.zeros(tok.get_vocab_size(), bool)
            ends[[i for t, i in tok.get_vocab(False).items() if t.endswith(suffix)]] = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        own_runs = (bool(suffix) and all(spec[k] == v for k, v in _STEPS.items())
                    and all("<" in t["content"] and not set(t["content"]) & {" ", "\n"} for t in spec["added_tokens"]))
        merges = None
        if own_runs:                        # the merges alone, for runs that are lower case and split already
            merges = Tokenizer(tok.model)
            merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        _STATE.update(path=path, tok=tok, ends=ends, merges=merges, ids=_Recent(CACHE), classes=_classes(own_runs))
    return _STATE


def _lots(words: list[str]):
    """The words in lists of about 20,000 characters, ``LOTS`` lists at a time."""
    lots, lot, size = [], [], 0
    for w in words:
        lot.append(w)
        size += len(w) + 1
        if size > 20_000:
            lots.append(lot)
            lot, size = [], 0
            if len(lots) == LOTS:
                yield lots
                lots = []
    if lot:
        lots.append(lot)
    if lots:
        yield lots


def _learn(words: list[str], ids: dict) -> None:
    """Tokenise ``words`` in long joined strings and file the ids of each under the word.

    This tokenizer drops white space and its splits never span it, so a word has the same ids wherever it
    stands between spaces.
    """
    tok = _STATE["tok"]
    for part in _lots(words):
        for own, enc in zip(part, tok.encode_batch([" ".join(x) for x in part], add_special_tokens=False)):
            values = np.asarray(enc.ids, dtype="<u4")
            at = np.fromiter((x[0] for x in enc.offsets), np.int64, len(values))
            ends = np.cumsum(np.fromiter((len(w) + 1 for w in own), np.int64, len(own)))
            _cut(own, values, np.searchsorted(at, ends), ids)


def _learn_letters(words: list[str], ids: dict, plain: bool = False) -> None:
    """As :func:`_learn`, for words of letters alone: the tokenizer never splits those before its merges, so each has
    one id with the mark of a word's end, its last, and no offsets are needed. Plain ones go straight to the merges."""
    tok, marked = _STATE["merges" if plain else "tok"], _STATE["ends"]
    for part in _lots(words):
        texts = [" ".join(x) for x in part]
        if plain:
            texts = [t if t.isascii() else _BYTE_LETTERS[np.frombuffer(t.encode(), np.uint8)].tobytes().decode("utf-32-le")
                     for t in texts]
        for own, enc in zip(part, tok.encode_batch_fast(texts, add_special_tokens=False)):
            values = np.asarray(enc.ids, dtype="<u4")
            cuts = np.flatnonzero(marked[values]) + 1
            if len(cuts) == len(own):
                _cut(own, values, cuts, ids)
            else:                       # a letter outside the vocabulary
                _learn(own, ids)


def _cut(words: list[str], values: np.ndarray, cuts: np.ndarray, ids: dict) -> None:
    raw, start = values.tobytes(), 0
    for w, stop in zip(words, (4 * cuts).tolist()):
        ids[w] = raw[start:stop]
        start = stop


def _file(words: list[str]) -> None:
    """File the ids of new ``words``: plain runs, and hard words by way of their runs where they are letters and then
    ASCII punctuation: the tokenizer's own split falls between the two."""
    known = _STATE["ids"]
    merges = _STATE["merges"] is not None
    plain, parts, rest, letters, other = {}, [], [], {}, {}
    for w in words:
        if merges and _PLAIN(w):
            plain[w] = None
            continue
        a = "" if len(w) > LONG_WORD or "\u03a3" in w else w if w.isalpha() else w.rstrip(punctuation)   # capital sigma has two lower cases
        low = a.lower()
        if not (a.isalpha() and low.isalpha()):     # other signs inside, or a lower case with a combining mark
            rest.append(w)
            continue
        b = w[len(a):]
        parts.append((w, low, b))
        if low not in known:
            (plain if merges and is_normalized("NFC", low) else letters)[low] = None
        if b not in known:
            other[b] = None
    if plain:
        _learn_letters(list(plain), known.young, plain=True)
    if letters:
        (_learn if _STATE["ends"] is None else _learn_letters)(list(letters), known.young)
    if other:
        _learn(list(other), known.young)
    for w, a, b in parts:
        known.young[w] = known[a] + known[b]
    if rest:
        _learn(rest, known.young)


def _runs(raw: bytes) -> tuple[pa.StringArray, np.ndarray]:
    """The runs of ``raw``, which ends with a line, and where they start.

    Runs are the tokenizer's own, in lower case: letters, single digits, other signs, of ASCII and U+00C0 to U+00FF.
    Words with anything else inside, or with an apostrophe that may begin a contraction, are hard and stay whole.
    """
    a = np.frombuffer(raw, np.uint8)
    of, low = _STATE["classes"][a], _LOWER[a]
    if _STATE["merges"] is not None:
        at = np.flatnonzero(a == 0xC3)
        at = at[(a[at + 1] != 0x97) & (a[at + 1] != 0xB7)]      # the signs of multiplication and division
        of[at] = of[at + 1] = LETTER
        low[at + 1] = _LOWER_C3[a[at + 1]]
        at = np.flatnonzero(a == ord("'"))
        of[at[np.isin(low[at + 1], np.frombuffer(b"stmdrvl", np.uint8))]] = HARD
    hard = np.flatnonzero(of == HARD)
    if len(hard):
        spaces = np.flatnonzero(of == SPACE)
        word = np.searchsorted(spaces, hard)
        word = word[np.diff(word, prepend=-1) > 0]
        begin = np.where(word > 0, spaces[word - 1] + 1, 0)
        size = spaces[word] - begin
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        of[at], low[at] = HARD, a[at]
    inside = of != SPACE
    first = np.ones(len(a) + 1, bool)
    np.not_equal(of[1:], of[:-1], out=first[1:-1])
    first[:-1] |= of == DIGIT
    starts = np.flatnonzero(first[:-1] & inside)
    stops = np.flatnonzero(first[1:] & inside) + 1
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=offsets[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[inside])), starts


def _ids(raw: bytes, ends: np.ndarray) -> list[bytes]:
    """The ids of the texts that lie in ``raw`` up to ``ends``."""
    known = _STATE["ids"]
    known.age()
    runs, starts = _runs(raw)
    coded = runs.dictionary_encode()
    own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    young, old = known.young, known.old
    values = list(map(young.get, own))
    new = []
    for k, v in enumerate(values):
        if v is None:
            w = own[k]
            v = old.get(w)
            if v is None:
                new.append(k)
            else:
                values[k] = young[w] = v
    if new:
        _file([own[k] for k in new])
    for k in new:
        w = own[k]
        values[k] = young.pop(w) if len(w) > LONG_WORD else young[w]
    flat = np.frombuffer(b"".join(values), "<u4")
    size = np.fromiter(map(len, values), np.int64, len(values)) // 4
    index = coded.indices.to_numpy()
    n = size[index]
    upto = np.concatenate([[0], np.cumsum(n)])
    place = np.repeat((np.cumsum(size) - size)[index] - upto[:-1], n)
    place += np.arange(len(place))
    data = flat[place].tobytes()
    cuts = [0, *(4 * upto[np.searchsorted(starts, ends)]).tolist()]
    return [data[i:j] for i, j in zip(cuts, cuts[1:])]


def _parts(texts: list[str]):
    """``k, bytes`` of every text, long ones in parts: white space never lies inside a run."""
    for k, text in enumerate(texts):
        raw, at = text.encode(), 0
        while len(raw) - at > CHARS:
            stop = max(raw.rfind(b" ", at, at + CHARS), raw.rfind(b"\n", at, at + CHARS))
            if stop < 0:
                stop = min((x for x in (raw.find(b" ", at), raw.find(b"\n", at)) if x >= 0), default=len(raw))
            yield k, raw[at:stop]
            at = stop + 1
        yield k, raw[at:]


def encode(texts: list[str], path: str, end_id: int = 0) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of every text, ``end_id`` last.

    The runs of about a MB of texts are found and numbered by vectorised passes; only distinct ones are looked up, and
    only new ones tokenised.
    """
    _tokenizer(path)
    tail = np.array([end_id], "<u4").tobytes()
    out: list[list[bytes]] = [[] for _ in texts]
    lot, size = [], 0

    def done() -> None:
        ends = np.cumsum([len(x) + 1 for _, x in lot]) - 1
        for (k, _), ids in zip(lot, _ids(b"".join(x + b"\n" for _, x in lot), ends)):
            out[k].append(ids)

    for k, raw in _parts(texts):
        if lot and size + len(raw) > CHARS:
            done()
            lot, size = [], 0
        lot.append((k, raw))
        size += len(raw) + 1
    if lot:
        done()
    return [b"".join(x) + tail for x in out]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
           sequence: int = SEQUENCE, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` binary) of every piece."""
    path = tokenizer or default_tokenizer()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches):
        return map(cut_rows, by_size(batches, ROWS, CHARS))

    def cut_rows(b):
        doc, no, start, length, crc, ids = [], [], [], [], [], []
        for d, raw in zip(b.column("doc_id").to_pylist(), encode(strings(b, "text"), path, end_id)):
            n = len(raw) // 4
            for p, s in enumerate(range(0, n, sequence)):
                own = raw[4 * s:4 * (s + sequence)]
                doc.append(d), no.append(p), start.append(s), length.append(len(own) // 4)
                crc.append(zlib.crc32(own))
                if with_ids:
                    ids.append(own)
        cols = [pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            cols.append(pa.array(ids, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
                          + (", ids binary" if with_ids else ""))


def place(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order by the sum-of-squares rule."""
    count = np.zeros(sequence + 1, np.int64)          # open bins by gap
    waiting: list[list[int]] = [[] for _ in range(sequence + 1)]
    bins, offsets, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        gap = sequence
        if s < sequence:
            had = count[s:sequence]
            fits = np.flatnonzero(had)
            if len(fits):
                # filling a gap g to g - s changes the sum by 2 (N[g-s] - N[g] + 1); a bin that becomes full only leaves
                change = 2 * (count[fits] - had[fits] + 1)
                if fits[0] == 0:
                    change[0] = 1 - 2 * had[0]
                gap = s + int(fits[change.argmin()])
        if gap == sequence:
            b, opened = opened, opened + 1
        else:
            b = waiting[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = b, sequence - gap
        if gap > s:
            count[gap - s] += 1
            waiting[gap - s].append(b)
    return bins, offsets


def pack(parts: DataFrame, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (a stored table); full pieces have negative sequence ids."""
    full = parts.where(F.col("length") >= sequence).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = parts.where(F.col("length") < sequence)
    groups = max(1, -(-short.count() // group))
    keyed = short.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = place(pdf["length"].to_numpy(), sequence)
        g = int(pdf["_g"].iloc[0])
        return pdf.drop(columns="_g").assign(sequence_id=bins + (g << 32), offset=offsets)

    schema = T.StructType(parts.schema.fields).add("sequence_id", "long").add("offset", "long")
    return keyed.groupBy("_g").applyInPandas(solve, schema).union(full)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Tokenise, cut and pack whole documents (options as in :func:`pieces`)."""
    sequence = options.get("sequence", SEQUENCE)
    return pack(stored(pieces(docs, **options), "pieces"), sequence)
