"""License scan by ordered signature rules.

Every whole text is lower-cased (A-Z) and cut into words; hundreds of signature rules (license families x
phrase forms, each a regex over the words joined by spaces) run only where a keyword of their name and one
of their form stand among the words. Overlaps are settled by priority: rules are tried in order, and a
detection whose words lie inside the interval of one that was kept earlier is suppressed. Base phrases are
reported wherever their words stand consecutively, whatever the rules say.

Defined results: null or empty texts have no words, no labels, null places and score 0; equal priorities are
settled by earlier start, then label; repeated rows are scanned once each; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import strings

# fixed values: base phrases and their labels
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
        ("mit license", "mit")]

# license families: label, names as words (regex), keywords: every name holds one of them as a whole word
FAMILIES = [
    ("agpl", r"gnu affero general public license|affero gpl|(?:gnu )?agpl(?: ?v?[0-9]+(?: [0-9]+)?)?", "affero agpl"),
    ("lgpl", r"gnu (?:lesser|library) general public license|(?:gnu )?lgpl(?: ?v?[0-9]+(?: [0-9]+)?)?", "lesser library lgpl"),
    ("gpl", r"gnu general public license|(?:gnu )?gpl(?: ?v?[0-9]+(?: [0-9]+)?)?", "gnu gpl"),
    ("gfdl", r"gnu free documentation license|gfdl", "gnu gfdl"),
    ("apache", r"apache(?: software)? license|apache 2 0|asl 2 0", "apache asl"),
    ("mit", r"mit license|expat license|mit", "mit expat"),
    ("x11", r"x11 license|mit x11", "x11"),
    ("bsd", r"(?:(?:[0-9] clause|new|simplified|modified|original) )?bsd(?: license)?", "bsd"),
    ("isc", r"isc license|internet systems consortium license", "isc consortium"),
    ("mpl", r"mozilla public license|mpl 2 0|mpl 1 1", "mozilla mpl"),
    ("epl", r"eclipse public license|epl 2 0", "eclipse epl"),
    ("cddl", r"common development and distribution license|cddl", "distribution cddl"),
    ("cpl", r"common public license|cpl 1 0", "common cpl"),
    ("eupl", r"european union public licen[cs]e|eupl", "european eupl"),
    ("artistic", r"artistic license|artistic 2 0", "artistic"),
    ("boost", r"boost software license|bsl 1 0", "boost bsl"),
    ("zlib", r"zlib license|zlib libpng license", "zlib"),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"do what the fuck you want to public license|wtfpl", "fuck wtfpl"),
    ("cc0", r"cc0(?: 1 0)?|creative commons zero", "cc0 commons"),
    ("cc-by-nc-sa", r"cc by nc sa(?: [0-9] [0-9])?|creative commons attribution noncommercial sharealike", "cc commons"),
    ("cc-by-nc-nd", r"cc by nc nd(?: [0-9] [0-9])?|creative commons attribution noncommercial noderiv[a-z]*", "cc commons"),
    ("cc-by-nc", r"cc by nc(?: [0-9] [0-9])?|creative commons attribution (?:non commercial|noncommercial)", "cc commons"),
    ("cc-by-nd", r"cc by nd(?: [0-9] [0-9])?|creative commons attribution noderiv[a-z]*", "cc commons"),
    ("cc-by-sa", r"cc by sa(?: [0-9] [0-9])?|creative commons attribution share ?alike", "cc commons"),
    ("cc-by", r"cc by(?: [0-9] [0-9])?|creative commons attribution", "cc commons"),
    ("odbl", r"open database license|odbl", "database odbl"),
    ("ofl", r"sil open font license|ofl 1 1", "sil ofl"),
    ("osl", r"open software license|osl 3 0", "software osl"),
    ("afl", r"academic free license|afl 3 0", "academic afl"),
    ("python", r"python software foundation license|psf license", "python psf"),
    ("ruby", r"ruby license", "ruby"),
    ("php", r"php license", "php"),
    ("perl", r"same terms as perl itself", "perl"),
    ("postgresql", r"postgresql license", "postgresql"),
    ("openssl", r"openssl license", "openssl"),
    ("curl", r"curl license", "curl"),
    ("ms-pl", r"microsoft public license|ms pl", "microsoft ms"),
    ("ms-rl", r"microsoft reciprocal license|ms rl", "microsoft ms"),
    ("ncsa", r"university of illinois ncsa open source license|ncsa license", "ncsa"),
    ("upl", r"universal permissive license", "permissive"),
    ("bsl", r"business source license|busl 1 1", "business busl"),
    ("sspl", r"server side public license|sspl", "server sspl"),
    ("elastic", r"elastic license", "elastic"),
    ("proprietary", r"proprietary (?:license|and confidential)", "proprietary"),
    ("public-domain", r"public domain", "domain"),
]

# phrase forms around a name, most telling first: regex, weight, keywords (as above; v: a word of v and a number)
FORMS = [
    (r"spdx license identifier (?:{n})", 0.99, "spdx"),
    (r"(?:re)?licensed under (?:the )?(?:terms of )?(?:the )?(?:{n})", 0.97, "licensed relicensed"),
    (r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:{n})", 0.95,
     "released distributed published available provided"),
    (r"subject to (?:the )?(?:terms of )?(?:the )?(?:{n})", 0.9, "subject"),
    (r"under (?:the )?terms (?:and conditions )?of (?:the )?(?:{n})", 0.9, "terms"),
    (r"(?:{n}) (?:as published by|version [0-9]+|v[0-9]+|licen[cs]e)", 0.85, "published version v license licence"),
    (r"(?:copy of|see|read) (?:the )?(?:{n})", 0.7, "copy see read"),
]
# rules that name no family
GENERIC = [
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 0.4, "copyright"),
    ("all-rights-reserved", r"all rights reserved", 0.5, "reserved"),
    ("permissive-grant", r"permission is hereby granted free of charge to any person", 0.9, "hereby"),
    ("redistribution", r"redistribution and use in source and binary forms", 0.9, "redistribution"),
    ("no-warranty", r"without warrant(?:y|ies) (?:or conditions )?of any kind", 0.4, "warranty warranties"),
]

_VERSION = re.compile(rb" v[0-9]")
_GLUED = re.compile(rb"(?<![^ ])(a?l?gpl)v?[0-9]+(?![^ ])")       # a name and its version as one word count as the name
_TO_WORDS = bytes(b if (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20 for b in range(256))


def rules() -> list[tuple[int, str, re.Pattern, float, frozenset, frozenset]]:
    """All rules as (priority, label, regex over spaced words with one space before, weight, keywords, more keywords), first
    priority first. A rule can only match where a word of each of its keyword sets stands."""
    out = [(label, form.format(n=names), weight, keys, more)
           for form, weight, more in FORMS for label, names, keys in FAMILIES]
    out += [(label, pat, weight, keys, keys) for label, pat, weight, keys in GENERIC]
    return [(k, label, re.compile(b" (?:" + pat.encode() + b")(?![^ ])"), weight,
             frozenset(keys.encode().split()), frozenset(more.encode().split()))
            for k, (label, pat, weight, keys, more) in enumerate(out)]


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8."""
    return text.encode().lower().translate(_TO_WORDS).split()


def gate(table) -> frozenset:
    """Words without any of which (names with a version in one word aside) no rule of ``table`` matches: its first
    keyword sets."""
    return frozenset().union(*(keys for *_, keys, _ in table))


def scan(spaced: bytes, table, words=None) -> list[tuple[int, int, str, float]]:
    """Detections (start, end, label, weight) kept after priority and containment; places in ``spaced``.

    ``words``: the text's words; without them every rule is tried, keywords or not.
    """
    text = b" " + spaced
    if words is not None:
        have = set(words)
        if _VERSION.search(text):
            have.add(b"v")
        have.update(_GLUED.findall(text))
        table = [r for r in table if not have.isdisjoint(r[4]) and not have.isdisjoint(r[5])]
    kept: list[tuple[int, int, str, float]] = []      # by start
    longest = 0
    for _, label, pattern, weight, *_ in table:
        for m in pattern.finditer(text):
            s, e = m.start(), m.end() - 1             # the match begins with the space put before
            k = bisect.bisect_right(kept, s, key=lambda x: x[0]) - 1
            while k >= 0 and kept[k][0] + longest >= e and kept[k][1] < e:
                k -= 1
            if k < 0 or kept[k][1] < e:
                bisect.insort(kept, (s, e, label, weight))
                longest = max(longest, e - s)
    return kept


def base_places(spaced: bytes) -> list[tuple[int, str]]:
    """Start and label of each place where the words of a base phrase stand consecutively."""
    out = []
    for phrase, label in BASE:
        p, n = phrase.encode(), len(phrase)
        k = spaced.find(p)
        while k >= 0:
            if spaced[k - 1:k] in (b"", b" ") and spaced[k + n:k + n + 1] in (b"", b" "):
                out.append((k, label))
            k = spaced.find(p, k + 1)
    return out


def license_scan(docs: DataFrame, with_spans: bool = False) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` (and ``spans``: label:first:end
    in words) of every document."""
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double" + (", spans string" if with_spans else ""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def run(batches):
        table = rules()
        keywords = gate(table)
        for b in batches:
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), strings(b, "text")):
                words = words_of(t)
                spaced, base, hits = b"", [], []
                if not keywords.isdisjoint(words) or any(b"gpl" in w and _GLUED.match(w) for w in words):
                    spaced = b" ".join(words)         # base phrases hold keywords, too
                    base = base_places(spaced)
                    hits = scan(spaced, table, words)
                places, base_labels = [k for k, _ in base], {label for _, label in base}
                at: dict[int, int] = {}
                if places or hits:                    # character places to word numbers, in one pass
                    done = n = 0
                    for c in sorted({*places, *(x for s, e, *_ in hits for x in (s, e))}):
                        n += spaced.count(b" ", done, c)
                        done, at[c] = c, n
                miss = 1.0
                for *_, weight in hits:
                    miss *= 1 - weight
                score = max(1 - miss, 0.9 if places else 0.0)
                row = [d, len(words), len(places), at[min(places)] if places else None,
                       at[max(places)] if places else None, ",".join(sorted(base_labels)),
                       ",".join(sorted(base_labels | {x[2] for x in hits})), score]
                if with_spans:
                    row.append(",".join(f"{label}:{at[s]}:{at[e] + 1}" for s, e, label, _ in sorted(hits)))
                rows.append(row)
            cols = list(zip(*rows)) if rows else [()] * (9 if with_spans else 8)
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()] + [pa.string()] * with_spans
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             [x.split()[0] for x in schema.split(", ")])

    return src.mapInArrow(run, schema)
