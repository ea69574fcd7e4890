"""Exact BPE encoding by backtracking over longest matches, and decoding by an offset table.

The vocabulary's tokens are the patterns of an Aho-Corasick automaton, which gives the longest token at every place of a
word in one pass. From the left, the longest token is taken that leaves a reachable end and may follow the token before
it; where none does, the last token gives way to its next shorter prefix. Which token may follow which is looked up in a
pair table, filled by undoing the merges on both sides of the border, latest first: the pair stands if no earlier merge
would have crossed the border. Every prefix of a word has one valid encoding, so a place given up is never tried again,
and the work is linear in the word. The result is that of applying all merges by rank.

The library's own normalizer and split are used as they are (they are no part of the merges), for words outside ASCII
by calling them. Words between spaces are encoded once per Python worker while they are remembered; this vocabulary
drops white space, so a word has the same ids wherever it stands.

Decoding: the tokens' texts lie end to end in one buffer, an offset table gives each id's range; a batch of id lists is
one vectorised gather. A tokenizer without decoder puts one space between tokens.

Defined results: a null or empty text has no ids and decodes to the empty text; special strings inside a text are their
special ids, as in the library; repeated rows are encoded once each; an empty table gives an empty table; columns other
than the two named ones are ignored, whatever their names. Texts are never cut; long words are encoded, not remembered.
"""

from __future__ import annotations

import json
import re
from unicodedata import is_normalized

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import Remembered, by_size, slices, strings

END = "\n"               # stands for the end-of-word mark; no letter of the byte alphabet
WORDS = 150_000          # words in each of a worker's two generations
PIECES = 150_000         # letter runs and the like
PAIRS = 1_000_000        # entries of the pair table; beyond, it is filled anew
LONG_WORD = 64           # longer ones are not remembered
ROWS = 256               # texts at a time
GATHER = 1 << 18         # ids decoded at a time

# The split of word_bpe_49k.json, for lower-case ASCII; and the words most are, for which it is plain.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_RUN = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)").fullmatch
_STATE: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class Merges:
    """Tokens in order of age (letters, then merges by rank) and which of them may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        def own(token: str) -> str:
            return token[:-len(suffix)] + END if suffix and token.endswith(suffix) else token
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = [a + b if not suffix else a.removesuffix(suffix) + b for a, b in pairs]
        if len(set(made)) < len(made):
            raise ValueError("a token with two merges has no age")
        taken = set(made)
        letters = [t for t in vocab if t not in taken and len(own(t).removesuffix(END)) == 1]
        self.base = len(letters)
        names = letters + made
        age = {t: k for k, t in enumerate(names)}
        self.text = [own(t) for t in names]
        self.ids = np.array([vocab[t] for t in names], "<u4")
        self.left, self.right = list(range(self.base)), list(range(self.base))
        self.joined: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(pairs):
            x, y = age[a], age[b]
            self.left.append(x), self.right.append(y)
            self.joined.setdefault((x, y), self.base + k)
        self.length = [len(t) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.text):
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()
        by_text = {t: k for k, t in enumerate(self.text)}
        self.shorter = [next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1) for t in self.text]
        self.pairs: dict[int, bool] = {}        # x << 32 | y: may y follow x?

    def _learn(self, x: int, y: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[x << 32 | y] = self._stands(x, y)
        return known

    def _stands(self, x: int, y: int) -> bool:
        """No merge crosses the border while the two tokens are made. Merges of one rank run from the left."""
        before = len(self.text)
        while True:
            across = self.joined.get((x, y))
            if across is not None and across < before:
                return False
            if max(x, y) < self.base:
                return True
            if x > y:
                before, x = x, self.right[x]
            else:
                before, y = y + 1, self.left[y]

    def encode(self, word: str) -> list[int]:
        """Tokens (by age) of a word in the byte alphabet, its end mark included."""
        size, length, shorter, known = len(word), self.length, self.shorter, self.pairs.get
        longest = [-1] * (size + 1)
        for last, token in self.automaton.iter(word):
            longest[last + 1 - length[token]] = token       # later matches from one start are longer
        out: list[int] = []
        given_up: set[int] = set()
        at, before, token = 0, -1, longest[0]
        while at < size:
            if token < 0:
                if before < 0:
                    raise ValueError(f"no tokens make {word!r}")
                given_up.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
                before = out[-1] if out else -1
                continue
            end = at + length[token]
            if end not in given_up:
                stands = before < 0 or known(before << 32 | token)
                if stands is None:
                    stands = self._learn(before, token)
                if stands:
                    out.append(token)
                    at, before, token = end, token, longest[end]
                    continue
            token = shorter[token]
        return out


class Codec:
    """Encoder and decoder of one tokenizer file (BPE over bytes, with or without a mark at a word's end)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") is not None or model.get("ignore_merges"):
            raise ValueError(f"{path}: a BPE model without decoder is expected")
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.end = END if model.get("end_of_word_suffix") else ""
        tok = Tokenizer.from_file(path)
        self.normalize, self.split = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.runs_are_plain = not any(re.fullmatch(r"[^\W\d_]*[!-/:-@\[-`{-~]*", t) for t in added)
        self.letters = _byte_letters()
        self.words, self.pieces = Remembered(WORDS), Remembered(PIECES)
        self._offsets({**model["vocab"], **added}, {t["id"] for t in spec["added_tokens"] if t["special"]})

    # ---- encoding
    def _piece(self, piece: str) -> bytes:
        pieces = self.pieces
        ids = pieces.get(piece) or pieces.old.get(piece)
        if ids is None:
            ids = self.merges.ids[self.merges.encode(piece + self.end)].tobytes()
        if len(piece) <= LONG_WORD:
            pieces[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        """Ids of a text without spaces and special strings."""
        if text.isascii():
            pieces = _ASCII.findall(text.lower())
            if not text.isprintable():
                pieces = [p if p.isprintable() else "".join(self.letters[ord(c)] for c in p) for p in pieces]
        else:
            pieces = [p for p, _ in self.split(self.normalize(text))]
        return b"".join(map(self._piece, pieces))

    def _word(self, word: str) -> bytes:
        run = _RUN(word)
        if run and self.runs_are_plain:            # letters, then ASCII punctuation: the split falls between the two
            letters, rest = run.groups()
            low = letters.lower()
            if not low.isascii():
                if "\u03a3" in letters or not low.isalpha() or not is_normalized("NFC", letters):
                    return self._plain(word)
                low = low.encode().decode("latin-1").translate(self.letters)
            return self._piece(low) + self._piece(rest) if rest else self._piece(low)
        if self.find_special is None or not self.find_special.search(word):
            return self._plain(word)
        return b"".join(self.special[p] if p in self.special else self._plain(p) for p in self.find_special.split(word) if p)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        known, out = self.words, []
        for k in range(0, len(texts), ROWS):
            known.age(), self.pieces.age()
            split = [t.replace("\n", " ").split(" ") for t in texts[k:k + ROWS]]
            long, old = [], known.old
            for w in set().union(*split):
                if w in known:
                    continue
                known[w] = old[w] if w in old else self._word(w)
                if len(w) > LONG_WORD:
                    long.append(w)
            out += [b"".join(map(known.__getitem__, words)) for words in split]
            for w in long:
                del known[w]
        return out

    # ---- decoding
    def _offsets(self, vocab: dict[str, int], special: set[int]) -> None:
        top = max(vocab.values()) + 1
        texts = [b""] * top
        self.there = np.zeros(top, bool)
        for t, i in vocab.items():
            texts[i] = t.encode() + b" "          # the space that follows a token
            self.there[i] = True
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.is_special = np.isin(np.arange(top), list(special))

    def decode(self, flat: np.ndarray, ends: np.ndarray, skip_special: bool = False) -> tuple[bytes, np.ndarray]:
        """The texts of the id lists ``flat[ends[i - 1]:ends[i]]``, end to end, and their byte ends."""
        flat = flat.astype(np.int64)
        keep = (flat >= 0) & (flat < len(self.there))
        keep[keep] = self.there[flat[keep]] & ~(skip_special & self.is_special[flat[keep]])
        if not keep.all():
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            flat = flat[keep]
        begin, size = self.offset[flat], self.offset[flat + 1] - self.offset[flat]
        filled = ends[np.diff(ends, prepend=0) > 0]
        size[filled - 1] -= 1                     # nothing follows a text's last token
        upto = np.concatenate([[0], np.cumsum(size)])
        parts = []
        for k in range(0, len(flat), GATHER):
            n = size[k:k + GATHER]
            place = np.repeat(begin[k:k + GATHER] - (upto[k:k + len(n)] - upto[k]), n)
            place += np.arange(len(place))
            parts.append(self.buffer[place].tobytes())
        return b"".join(parts), upto[ends]


def codec(path: str) -> Codec:
    """The worker's codec of a file, built once."""
    if _STATE.get("path") != path:
        _STATE.update(path=path, codec=Codec(path))
    return _STATE["codec"]


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _texts(own: Codec, lists: pa.ListArray, skip_special: bool) -> pa.Array:
    ends = np.asarray(lists.offsets)
    data, upto = own.decode(np.asarray(lists.values)[ends[0]:ends[-1]], ends[1:].astype(np.int64) - ends[0], skip_special)
    at = np.concatenate([[0], upto]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(upto), pa.py_buffer(at), pa.py_buffer(data)).cast(pa.string())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
           decoded: bool = False, skip_special_tokens: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row; with ``decoded`` also ``text``, the ids decoded again in the same pass."""
    path = tokenizer or default_tokenizer()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        own = codec(path)
        for b in by_size(batches, ROWS):
            lists = _lists(own.encode(strings(b, "text")))
            columns = {"doc_id": b.column("doc_id"), "ids": lists}
            if decoded:
                columns["text"] = _texts(own, lists, skip_special_tokens)
            yield pa.RecordBatch.from_pydict(columns)

    return src.mapInArrow(run, "doc_id long, ids array<int>" + (", text string" if decoded else ""))


def decode(rows: DataFrame, ids: str = "ids", tokenizer: str | None = None, skip_special_tokens: bool = False) -> DataFrame:
    """``doc_id, text``: every row's ids decoded; null ids decode to the empty text, unknown ids are left out."""
    path = tokenizer or default_tokenizer()
    src = rows.select("doc_id", F.coalesce(F.transform(F.col(ids), lambda x: F.coalesce(x.cast("int"), F.lit(-1))),
                                           F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        own = codec(path)
        for b in slices(batches, ROWS):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": _texts(own, b.column("ids"), skip_special_tokens)})

    return src.mapInArrow(run, "doc_id long, text string")


def ids_text(ids: str = "ids") -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
