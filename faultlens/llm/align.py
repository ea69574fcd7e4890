"""Cross-tokenizer alignment of texts with corpus-wide scores of token pairs, from inverted pair bitmaps.

A text is tokenised by A (byte-level BPE) and by B (pieces); where tokens of both end at one byte, a group ends; every A
and B token whose byte ranges overlap are linked. For each pair of ids (a, b) an inverted list holds the documents that
have it linked, as compressed bitmaps: per chunk of documents, one bitmap for each binary digit of the number of links
(multiplicity planes), kept as sorted 16-bit places or, from ``DENSE`` places on, as a bit set. The OR of a pair's planes
is its documents, whose popcounts add up over the chunks; the planes' popcounts, weighted, are its links. The postings
then carry each pair's score back: a chunk's postings, joined with the pair scores, are summed per document.

Both tokenizers end a token at a single space between two other non-space characters (A splits there before merging,
no piece of B goes on past a space), so such parts of a text are tokenised, aligned and linked by themselves, new ones
many at a time, and remembered while they are frequent. Texts are never cut: a part without such spaces is aligned whole.

Scale: one pass writes document rows and postings; a chunk ends at ``CHUNK_ROWS`` documents or ``CHUNK_LINKS`` links, so
no task holds more, and a very common pair has one posting a chunk, not one a document. Scores are grouped sums over
postings; for their return a posting's key goes to its pair's score and back, its bitmaps only to its chunk.

Defined results: a text that is null, empty, or not given back by the bytes of its A or B tokens has no tokens (zeros,
empty digest) and takes part in no count; repeated rows, whatever their ids, are documents of their own; an empty table
gives an empty table; columns other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import fresh, give_back, slices, stored, strings

CHUNK_ROWS = 1 << 16     # places of a bitmap
CHUNK_LINKS = 6_000_000
DENSE = 4096             # places from which a bit set is smaller
DENSE_BYTES = CHUNK_ROWS // 8
PARTS = 150_000          # text parts that a worker goes on remembering; it clears them when it knows twice as many
LONG_PART = 64           # longer ones are not remembered
JOINED = 64              # new parts that A reads at a time
ROWS = 256               # texts at a time
BATCH = 50_000           # postings to a batch

# A space between two characters that no tokenizer takes for white space. Python's \s holds all of theirs.
_BORDER = re.compile(r"(?<=\S) (?=\S)")
_STATE: dict = {}


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Numbered(dict):
    """Numbers of text parts, given as they are looked up with ``[]``; ``new`` notes those not seen before. A part with
    white space at an end has a number only with a space in front (such a key comes of no plain part); without, it
    raises ``odd``."""

    def __init__(self, parts=()):
        super().__init__(zip(parts, range(len(parts))))
        self.next, self.new, self.odd = len(parts), [], False

    def __missing__(self, part: str) -> int:
        if not part or part[0] != " " and part != part.strip():
            self.odd = True
            return -1
        self[part] = number = self.next
        self.next = number + 1
        self.new.append(part)
        return number


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the parts seen lately."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        from faultlens.llm.bpe import _byte_letters
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True       # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: b for b, c in _byte_letters().items()}
        self.a_bytes = {i: bytes(byte[c] for c in t) for t, i in self.a.get_vocab(False).items()}
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_size[list(self.a_bytes)] = [len(t) for t in self.a_bytes.values()]
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        shown = np.array([x for i in range(max(len(self.a_size), len(self.b_size))) for x in (f"{i},", f"{i}|", f"{i},", f"{i};", f"{i}")], "S8")
        self.shown, self.shown_size = shown.view("<i8"), np.char.str_len(shown)
        self.number = Numbered()
        self.groups: list[bytes] = []             # of every number: its groups as text,
        self.links: list[bytes] = []              # every overlapping pair of tokens as a little-endian 64-bit code,
        self.counts = np.zeros((3, 0), np.int64)  # its tokens of A and B and its groups,
        self.fine = np.zeros(0, bool)             # whether both tokenizers give its bytes back,
        self.seen = np.zeros(0, np.int64)         # and its occurrences of late

    def _given_back(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether the tokens of both give the bytes of a part back."""
        return np.array([b"".join(map(self.a_bytes.__getitem__, x)) == t and b"".join(map(self.b_bytes.__getitem__, y)) == t
                         for x, y, t in zip(a, b, raw)], bool)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, lot: list[str], plain: bool) -> None:
        """Tokenise and align new parts, laid end to end. A reads plain ones ``JOINED`` at a time, with the spaces that
        part them in a text; should its tokens not end at those, or bytes not come back, each part is taken by itself."""
        spaced = [" " + p for p in lot] if plain else lot
        raw = list(map(str.encode, spaced))
        right = self.b.encode(lot if plain else [p[1:] for p in lot], num_threads=1)      # B puts the space in front itself
        left = self._encoded(["".join(spaced[k:k + JOINED]) for k in range(0, len(lot), JOINED)] if plain else spaced)
        number = np.fromiter(map(self.number.__getitem__, lot), np.int64, len(lot))
        border = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        a, b = list(chain.from_iterable(left)), list(chain.from_iterable(right))
        if (b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(raw) == b"".join(map(self.b_bytes.__getitem__, b))
                and self._align(number, border, np.array(a, np.int64), np.array(b, np.int64))):
            return
        left = self._encoded(spaced) if plain else left
        good = np.flatnonzero(self._given_back(raw, left, right))
        if len(good):
            border = np.cumsum(np.fromiter((len(raw[k]) for k in good), np.int64, len(good)))
            self._align(number[good], border, *[np.array([i for k in good for i in ids[k]], np.int64) for ids in (left, right)])

    def _align(self, number: np.ndarray, border: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
        """Note groups, links and counts of parts that end at ``border``; false if a token goes on past one."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends_a, ends_b = np.zeros((2, int(border[-1]) + 1), bool)         # per byte
        ends_a[a_end], ends_b[b_end] = True, True
        both = ends_a & ends_b
        if not both[border].all():
            return False
        upto_a, upto_b, upto = (np.cumsum(x, dtype=np.int32) for x in (ends_a, ends_b, both))
        ends = np.flatnonzero(ends_a | ends_b)            # each piece between ends is one link
        links = (a[upto_a[ends] - ends_a[ends]] << 31 | b[upto_b[ends] - ends_b[ends]] << 16).astype("<i8").tobytes()
        # the text: a group's A ids, then its B ids, each with what follows it
        common = np.flatnonzero(both)
        last_a, last_b = both[a_end], both[b_end]
        kind_b = 2 + last_b
        kind_b[upto_b[border] - 1] = 4
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], upto_b[common]])[upto[a_end] - last_a]] = a * 5 + last_a
        order[np.arange(len(b)) + upto_a[common][upto[b_end] - last_b]] = b * 5 + kind_b
        text = self.shown[order].tobytes().translate(None, b"\0")
        text_end = np.cumsum(self.shown_size[order])[upto_a[border] + upto_b[border] - 1].tolist()
        # ends up to a border: those of A and those of B, the common ones once
        link_end = (8 * (upto_a[border].astype(np.int64) + upto_b[border] - upto[border])).tolist()
        for row, x in zip(self.counts, (upto_a, upto_b, upto)):
            row[number] = np.diff(x[border], prepend=0)
        self.fine[number] = True
        t, k = 0, 0
        for n, t_end, k_end in zip(number.tolist(), text_end, link_end):
            self.groups[n], self.links[n] = text[t:t_end], links[k:k_end]
            t, k = t_end, k_end
        return True

    def _age(self) -> None:
        """When full, forget the parts met once; of the others the most frequent ``PARTS`` stay."""
        if self.number.next <= 2 * PARTS:
            return
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > PARTS:
            keep = np.sort(keep[np.argpartition(-self.seen[keep], PARTS)[:PARTS]])
        part = [None] * self.number.next
        for p, n in self.number.items():
            part[n] = p
        keep = np.array([n for n in keep.tolist() if part[n] is not None], np.int64)      # long ones have left
        self.number = Numbered([part[n] for n in keep.tolist()])
        self.groups, self.links = [self.groups[n] for n in keep.tolist()], [self.links[n] for n in keep.tolist()]
        self.counts, self.fine, self.seen = self.counts[:, keep], self.fine[keep], self.seen[keep] // 2

    def texts(self, texts: list[str]):
        """``n_a, n_b, n_groups, groups, links`` of every text in order; ``groups`` is None where there are no tokens.

        To be read to its end, where the long parts are forgotten.
        """
        self._age()
        number, split = self.number, []
        look = number.__getitem__
        for t in texts:
            found = []
            if t and "  " not in t and " \n" not in t and "\n " not in t:
                found = list(map(look, t.split(" ")))
            if number.odd or t and not found:             # some space is no border
                number.odd = False
                found = [look(p if p == p.strip() else " " + p) for p in _BORDER.split(t)]
            split.append(found)
        new, number.new = number.new, []
        self.groups += [b""] * len(new)
        self.links += [b""] * len(new)
        self.counts = np.concatenate([self.counts, np.zeros((3, len(new)), np.int64)], axis=1)
        self.fine, self.seen = (np.concatenate([x, np.zeros(len(new), x.dtype)]) for x in (self.fine, self.seen))
        for plain in (True, False):
            some = [p for p in new if (p[0] != " ") == plain]
            for k in range(0, len(some), 4096):
                self.learn(some[k:k + 4096], plain)
        sizes = np.array([len(x) for x in split], np.int64)
        flat = np.fromiter(chain.from_iterable(split), np.int64, int(sizes.sum()))
        self.seen += np.bincount(flat, minlength=len(self.seen))
        there = sizes > 0
        start = (np.cumsum(sizes) - sizes)[there]
        n = np.zeros((3, len(texts)), np.int64)
        if len(start):
            fine = np.logical_and.reduceat(self.fine[flat], start)
            n[:, there] = [np.add.reduceat(x[flat], start) * fine for x in self.counts]
            there[there] = fine
        for own, has, n_a, n_b, n_groups in zip(split, there.tolist(), *n.tolist()):
            yield (n_a, n_b, n_groups, b";".join([self.groups[k] for k in own]), b"".join([self.links[k] for k in own])) if has else (0, 0, 0, None, b"")
        for part in new:
            if len(part) > LONG_PART:
                k = number.pop(part)
                self.groups[k], self.links[k] = b"", b""


def aligner(paths: tuple[str, str]) -> Aligner:
    """The worker's aligner, built once."""
    if _STATE.get("paths") != paths:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        _STATE.update(paths=paths, aligner=Aligner(*paths))
    return _STATE["aligner"]


ROW = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
       "chunk long, place int, a int, b int, planes array<binary>")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("chunk", pa.int64()),
                    ("place", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("planes", pa.list_(pa.binary()))])


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def bitmap(places: np.ndarray) -> bytes:
    """Sorted places, compressed."""
    if len(places) < DENSE:
        return places.astype("<u2").tobytes()
    bits = np.zeros(CHUNK_ROWS, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def places(data: bytes) -> np.ndarray:
    """The sorted places of a bitmap."""
    if len(data) < DENSE_BYTES:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def popcount(data: bytes) -> int:
    return len(data) // 2 if len(data) < DENSE_BYTES else int(np.bitwise_count(np.frombuffer(data, np.uint8)).sum())


def postings(codes: np.ndarray, chunk: int):
    """Batches of postings from the link codes (pair, then place) of a chunk."""
    codes.sort()
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    many = np.diff(first, append=len(codes))              # links of a pair in a document
    codes = codes[first]
    pair, place = codes >> 16, codes & 0xFFFF
    start = np.flatnonzero(np.diff(pair, prepend=-1))
    for k in range(0, len(start), BATCH):
        begin = start[k:k + BATCH]
        stop = start[k + len(begin)] if k + len(begin) < len(start) else len(pair)
        yield _postings(pair[begin], begin - begin[0], place[begin[0]:stop], many[begin[0]:stop], chunk)


def _postings(pair, begin, place, many, chunk) -> pa.RecordBatch:
    rows = len(pair)
    row = np.repeat(np.arange(rows), np.diff(begin, append=len(place)))
    digits = np.zeros(rows, np.int64)                     # planes of a row
    np.maximum.at(digits, row, np.frexp(many.astype(float))[1])
    first = np.concatenate([[0], np.cumsum(digits)])
    entry, held = [], []
    for d in range(int(digits.max())):
        on = (many >> d) & 1 == 1
        entry.append(first[row[on]] + d)
        held.append(place[on])
    entry, held = np.concatenate(entry), np.concatenate(held)
    order = np.argsort(entry, kind="stable")
    held, sizes = held[order], np.bincount(entry, minlength=first[-1])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if sizes.max() < DENSE:
        values = pa.Array.from_buffers(pa.binary(), int(first[-1]), [None, pa.py_buffer((2 * ends).astype(np.int32)),
                                                                     pa.py_buffer(held.astype("<u2").tobytes())])
    else:
        values = pa.array([bitmap(held[s:e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
    planes = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)
    return _batch(rows, chunk=pa.array(np.full(rows, chunk)), a=pa.array((pair >> 15).astype(np.int32)),
                  b=pa.array((pair & 0x7FFF).astype(np.int32)), planes=planes)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None,
            groups: bool = False) -> DataFrame:
    """Document rows (``doc_id .. place``) and postings (``chunk, a, b, planes``) in one table.

    ``groups``: with the text of the groups (``a1,a2|b1;a3|b2,b3``), of which the digest is always given.
    """
    paths = tokenizers or default_tokenizers()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        own, base, number = aligner(paths), TaskContext.get().partitionId() << 24, 0
        place, held, codes = 0, 0, []
        for batch in slices(batches, ROWS):
            out: dict[str, list] = {n: [] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "chunk", "place")}
            found = own.texts(strings(batch, "text"))
            for doc, (n_a, n_b, n_groups, text, links) in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                links = np.frombuffer(links, "<i8")
                if held and (held + len(links) > CHUNK_LINKS or place == CHUNK_ROWS):
                    yield from postings(np.concatenate(codes), base + number)
                    place, held, codes, number = 0, 0, [], number + 1
                if len(links):
                    codes.append(links + place)
                    held += len(links)
                for name, value in (("doc_id", doc), ("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", len(links)),
                                    ("groups_sha256", "" if text is None else hashlib.sha256(text).hexdigest()),
                                    ("groups", (text or b"").decode() if groups else None), ("chunk", base + number), ("place", place)):
                    out[name].append(value)
                place += 1
                if place == CHUNK_ROWS and not held:
                    place, number = 0, number + 1
            yield _batch(len(out["doc_id"]), **{n: pa.array(v, _ARROW.field(n).type) for n, v in out.items()})
        if held:
            yield from postings(np.concatenate(codes), base + number)
        give_back()

    return src.mapInArrow(run, ROW)


def _lists(batch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row of every plane, its digit, and the planes, of a batch with a column ``planes``."""
    column = batch.column("planes")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets).astype(np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(ends))
    digit = np.arange(ends[0], ends[-1]) - ends[:-1][row]
    values = column.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    return row, digit, values


def _flat(values: pa.Array, which: np.ndarray, row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the chosen sparse planes, end to end, and the row of each."""
    flat = np.frombuffer(b"".join(values.filter(pa.array(which)).to_pylist()), "<u2").astype(np.int64)
    return flat, np.repeat(row[which], size[which] // 2)


def measured(posts: DataFrame) -> DataFrame:
    """``a, b, docs, links`` of every posting: the popcount of its planes' OR, and their weighted popcounts."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row, digit, values = _lists(batch)
            size = np.asarray(pc.binary_length(values)).astype(np.int64)
            count = size // 2
            for k in np.flatnonzero(size >= DENSE_BYTES).tolist():
                count[k] = popcount(values[k].as_py())
            links = np.zeros(batch.num_rows, np.int64)
            np.add.at(links, row, count << digit)
            docs = np.zeros(batch.num_rows, np.int64)
            np.add.at(docs, row, count)                   # right where there is one plane
            planes = np.bincount(row, minlength=batch.num_rows)
            dense = np.bincount(row, size >= DENSE_BYTES, batch.num_rows) > 0
            several = (planes > 1) & ~dense               # the others: OR of the planes
            flat, own = _flat(values, several[row], row, size)
            docs[several] = np.bincount(np.unique(own << 16 | flat) >> 16, minlength=batch.num_rows)[several]
            for r in np.flatnonzero((planes > 1) & dense).tolist():
                docs[r] = len(np.unique(np.concatenate([places(values[k].as_py()) for k in np.flatnonzero(row == r).tolist()])))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(docs), pa.array(links)], ["a", "b", "docs", "links"])

    return posts.select("a", "b", "planes").mapInArrow(run, "a int, b int, docs long, links long")


def pair_scores(posts: DataFrame) -> DataFrame:
    """``a, b, docs, links, best``: corpus-wide counts of every linked pair; best: no pair of its A id is in more documents."""
    pairs = stored(measured(posts).groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")), "pairs")
    top = pairs.groupBy("a").agg(F.max("docs").alias("_top"))
    return pairs.join(top, "a").select("a", "b", "docs", "links", (F.col("docs") == F.col("_top")).alias("best"))


def returned(posts: DataFrame, scores: DataFrame) -> DataFrame:
    """``chunk, place, n_best, count_sum``: the scores summed over every document's links, through the postings.

    Only a posting's key goes to its pair's score and back; its bitmaps go once, to its chunk.
    """
    keys = posts.select("a", "b", "chunk").join(scores.select("a", "b", "docs", "best"), ["a", "b"])

    def total(own: pa.Table, scored: pa.Table) -> pa.Table:
        best, sums = np.zeros(CHUNK_ROWS, np.int64), np.zeros(CHUNK_ROWS, np.int64)
        there = np.zeros(CHUNK_ROWS, bool)
        pair = lambda t: np.asarray(t.column("a")).astype(np.int64) << 15 | np.asarray(t.column("b"))
        known = pair(scored)
        order = np.argsort(known)
        docs, is_best = np.asarray(scored.column("docs"))[order], np.asarray(scored.column("best").cast(pa.int8()))[order]
        known = known[order]
        for batch in own.to_batches():
            if not batch.num_rows:
                continue
            row, digit, values = _lists(batch)
            row = np.searchsorted(known, pair(batch))[row]
            size = np.asarray(pc.binary_length(values)).astype(np.int64)
            sparse = size < DENSE_BYTES
            flat, of = _flat(values, sparse, row, size)
            many = np.repeat(1 << digit[sparse], size[sparse] // 2)
            np.add.at(best, flat, many * is_best[of])
            np.add.at(sums, flat, many * docs[of])
            there[flat] = True
            for k in np.flatnonzero(~sparse).tolist():
                at = places(values[k].as_py())
                best[at] += int(is_best[row[k]]) << int(digit[k])
                sums[at] += int(docs[row[k]]) << int(digit[k])
                there[at] = True
        at = np.flatnonzero(there)
        return pa.table({"chunk": pa.array(np.full(len(at), own.column("chunk")[0].as_py())), "place": pa.array(at.astype(np.int32)),
                         "n_best": pa.array(best[at]), "count_sum": pa.array(sums[at])})

    own = fresh(posts.select("chunk", "a", "b", "planes")).groupBy("chunk")
    return own.cogroup(fresh(keys.select("chunk", "a", "b", "docs", "best")).groupBy("chunk")).applyInArrow(
        total, "chunk long, place int, n_best long, count_sum long")


def alignment(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (options as in :func:`aligned`)."""
    rows = stored(aligned(docs, **options), "aligned")
    posts = rows.where("a IS NOT NULL")
    sums = returned(posts, pair_scores(posts))
    out = rows.where("a IS NULL").join(sums, ["chunk", "place"], "left")
    zero = F.lit(0).cast("long")
    extra = ["groups"] if options.get("groups") else []
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                      F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", *extra)
