"""The training-data operators against brute force, on the smallest tables and on odd rows."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from faultlens.llm import chat, common, decontam, html, jaccard, licenses, packing, pii, quality, topk, toxicity
from faultlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (6, "x" * 50_000), (7, "lorem ipsum " * 30_000),
    (8, "mail a@b.c_d@e.f 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +1 (559) 555-3893 + 5"), (9, "é ß 日本 \U0001F600 a.b@c.d"),
    (9, "a second row of doc nine with the same id"), (None, "a row without an id, ip 10.0.0.1"), (10, "MIT License\ncc-by GNU General Public License"),
    (10, "MIT License\ncc-by GNU General Public License"), (11, "<|endoftext|> it's   odd space é"),
]


def read(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents with extra columns whose names clash with results and helpers."""
    rows = [(d, t, "a", 1.5, 7, "z") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, length double, sid int, spans string")


@pytest.fixture(scope="module")
def both(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs, [(r["doc_id"], r["text"]) for r in read("documents")], odd


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- packing

def tokens(text):
    from tokenizers import Tokenizer
    if "t" not in _TOK:
        _TOK["t"] = Tokenizer.from_file(packing.default_tokenizer())
    return _TOK["t"].encode(text or "", add_special_tokens=False).ids + [0]


_TOK: dict = {}


def test_packing(spark, both):
    docs, plain, odd = both
    for df, source in ((docs, plain), (odd.select("doc_id", "text", "length"), ODD)):
        got = packing.pack_documents(df, with_ids=True).collect()
        want = []
        for d, t in source:
            ids = tokens(t)
            for p, s in enumerate(range(0, len(ids), 2048)):
                own = np.array(ids[s:s + 2048], "<u4").tobytes()
                want.append((d, p, s, len(own) // 4, zlib.crc32(own), own))
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
        seqs: dict = {}
        for r in got:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in seqs.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= 2048
        total = sum(r.length for r in got)
        assert len(seqs) <= 1.02 * -(-total // 2048) + 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_ids_of_unusual_words():
    """Letters of many scripts, capitals whose lower case has a mark, other numerals: ids as of the whole text."""
    rng = random.Random(2)
    stock = [chr(c) for c in range(0x21, 0x2FFF) if chr(c).isprintable()] + list("\u0130\u03a3\u03c3\u03c2\u00df'!.st\u2162\u00b2\U00020BB7")
    texts = [" ".join("".join(rng.choices(stock[-14:] if rng.random() < 0.5 else stock, k=rng.randint(1, 9))) for _ in range(40)) for _ in range(300)]
    texts += ["\u0130' I\u0307! \u0130\u0130", "it's 'st don't", "a\nb\r\nc\td", "x" * 70 + "!"]
    got = packing.encode(texts, packing.default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokens(t) for t in texts]


def test_packing_runs_of_a_lot(monkeypatch):
    """Runs are found for a whole lot, and each distinct one is tokenised once, however its word is written."""
    path = packing.default_tokenizer()
    monkeypatch.setattr(packing, "_STATE", {})
    packing._tokenizer(path)
    runs, starts = packing._runs("The END, x42 \u00c9t\u00c9\n'quoted' it's a<b \u0416\u00c9! 7\u00d78\n".encode())
    assert runs.to_pylist() == ["the", "end", ",", "x", "4", "2", "\u00e9t\u00e9", "'", "quoted", "'", "it's", "a<b",
                                "\u0416\u00c9!", "7\u00d78"]
    assert starts.tolist() == [0, 4, 7, 9, 10, 11, 13, 19, 20, 26, 28, 33, 37, 43]
    seen: list = []
    cut = packing._cut
    monkeypatch.setattr(packing, "_cut", lambda words, *rest: (seen.extend(words), cut(words, *rest)))
    texts = ["Wording wording, (WORDING)", "wording-WORDING; Wording9"] * 3
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode(texts, path)] == [tokens(t) for t in texts]
    assert sorted(seen) == sorted(["wording", ",", "(", ")", "-", ";", "9"])


def test_packing_lots_and_parts_of_texts(monkeypatch):
    """Lots of many texts, texts in parts and generations of a few known runs give the ids of whole texts."""
    monkeypatch.setattr(packing, "_STATE", {})
    monkeypatch.setattr(packing, "CHARS", 40)
    monkeypatch.setattr(packing, "CACHE", 5)
    rng = random.Random(4)
    stock = list("abSTl'.,<|>09-\u00e9\u00c9\u00d7\u00f7\u00df\u0301\u0416\t\r\x00\u00a0") + [" ", "\n"] * 4 + ["<|endoftext|>", "it's", "'LL"]
    texts = ["".join(rng.choices(stock, k=rng.choice([0, 1, 5, 30, 300]))) for _ in range(400)] + ["z" * 100, "y" * 90 + " \n" + "x'" * 50, " " * 200]
    got = packing.encode(texts, packing.default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokens(t) for t in texts]


def test_packing_rule_by_hand():
    rng = random.Random(3)
    items = sorted((rng.randint(1, 40) for _ in range(300)), reverse=True)
    bins, offs = packing.place(np.array(items), 40)
    gaps: dict[int, int] = {}
    for s, b, o in zip(items, bins.tolist(), offs.tolist()):
        open_gaps = {g for g in gaps.values() if s <= g < 40}
        if open_gaps and s < 40:
            def after(g):
                count: dict[int, int] = {}
                for x in [*gaps.values()]:
                    if 0 < x < 40:
                        count[x] = count.get(x, 0) + 1
                count[g] -= 1
                if g - s:
                    count[g - s] = count.get(g - s, 0) + 1
                return sum(c * c for c in count.values())
            assert b in gaps and after(gaps[b]) == min(map(after, open_gaps))
        else:
            assert b not in gaps
        assert o == 40 - gaps.get(b, 40)
        gaps[b] = gaps.get(b, 40) - s


# ---- personal data

def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    text = text or ""
    for k, m in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for x in re.finditer(m, text):
            d = re.sub("[^0-9]", "", x.group())
            if k == 1 and any(int(p) > 255 for p in x.group().split(".")):
                continue
            if k == 2 and not (14 <= len(d) <= 19 and luhn(d)) or k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((x.start(), k, x.end()))
    return sorted(out)


def test_pii_base(spark, both):
    docs, plain, odd = both
    names = ("email", "ip", "card", "phone")
    many = " ".join(f"u{i}@h{i}.org" for i in range(3000))
    tricky = [(1, many), (2, "a@b.c.d..e@f.g -1-2 3@x.y"), (3, "1.2.3.4.5.6.7.8.9 0001.002.255.256 255.255.255.0255"), (4, "++1 23456789 0+12345678901"),
              (5, "4242424242424242-4242 4242 4242 4242424242424242 4242-4242-4242-4242"), (6, "é😀é 1.1.1.1 x@y.z")]
    rng = random.Random(5)
    tricky += [(100 + i, "".join(rng.choice("ab1.4@+- ()é9_%") for _ in range(400))) for i in range(150)]
    for df, source in ((docs, plain), (odd, ODD), (spark.createDataFrame(tricky, "doc_id long, text string"), tricky)):
        got = pii.pii_digest(df).collect()
        want = []
        for d, t in source:
            s = base_spans(t)
            joined = ",".join(f"{names[k]}:{a}:{e}" for a, k, e in s)
            want.append((d, *[sum(x[1] == k for x in s) for k in range(4)], hashlib.sha256(joined.encode()).hexdigest()))
        assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert pii.pii_digest(empty(spark)).count() == 0


def test_pii_added_kinds_and_plan(spark, capsys):
    rows = [(i, f"login password=ab12cd34ef{i:04d} then mail to bob{i}@mail.example.com from 10.0.0.{i % 250}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_digest(df).collect()}
    assert all("secret:6:29" in s for s in got.values())
    capsys.readouterr()
    pii.find_pii(df).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_iban_and_long_secrets(spark):
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19",
             "FR1420041010050500013M02606", "FR14 2004 1010 0505 0001 3M02 606", "NL91ABNA0417164300", "IT60X0542811101000000123456",
             "CH9300762011623852957", "PT50000201231234567890154", "NO9386011117947", "ES91 2100 0418 4502 0005 1332", "BE68539007547034"]
    rng = random.Random(8)
    key = "".join(rng.choices("abcdefABCDEF0123456789_", k=606))
    rows = [(i, f"pay to bank account {x} AND 2024 then") for i, x in enumerate(ibans)] + [(50, f"login token={key}. end")]
    rows += [(100 + i, f"user token=ab12cd34ef{i:04d} now") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.mask_pii(df).collect()}
    assert all(got[i] == "pay to bank account [IBAN] AND 2024 then" for i in range(len(ibans))), got
    assert got[50] == "login [SECRET]. end"
    right = spark.createDataFrame([(x,) for x in [*ibans, "DE89370400440532013001", "GB29NWBK60161331926891"]], "m string")
    assert [r[0] for r in right.select(F.expr(pii._mod97("m"))).collect()] == [True] * len(ibans) + [False] * 2


def test_pii_mask(spark, odd):
    df = spark.createDataFrame([(1, "mail a@b.cd now", 15, "k"), (2, None, None, None), (3, "é 4111 1111 1111 1111 +1 (559) 555-3893", 40, "k")],
                               "doc_id long, text string, n_chars long, pii string")
    got = {r.doc_id: (r.text, r.n_chars, r.pii) for r in pii.mask_pii(df).collect()}
    assert got[1] == ("mail [EMAIL] now", 16, "k") and got[2] == (None, None, None)
    assert got[3][0] == "é [CARD] [PHONE]"
    assert pii.mask_pii(odd).columns == odd.columns


# ---- top k

def test_topk(spark):
    rng = np.random.default_rng(2)
    for rows in ([(r["vec_id"], r["embedding"]) for r in read("embeddings")],
                 [(i, (rng.normal(size=9) * rng.choice([0.1, 1, 5])).tolist()) for i in range(700)]
                 + [(1000 + i, [1.0] * 9) for i in range(60)] + [(50, [0.5] * 4), (2000, None), (2050, [float("nan")] * 9), (2001, [1.0, None]),
                                                                 (2100, []), (2150, [1.0] * 9), (2150, [1.0] * 9), (2002, [float("inf")])]):
        df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
        for stripe in (4096, 64):
            got = rows_of(topk.topk(df, F.col("vec_id") % 50 == 0, stripe=stripe), "query_id", "rank", "vec_id", "score")
            good = {(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v in rows
                    if v is not None and all(x is not None and np.isfinite(x) for x in v)}
            want = []
            for i, v in good:
                if i % 50 == 0:
                    scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:5]
                    want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
            assert got == sorted(want, key=repr)
    # components beyond what floats and longs hold exactly: ranked by whole numbers, scores cut to a long
    big = [(i, [float(2 ** 39 + i), float(rng.integers(-9, 9)), 0.25]) for i in range(90)] + [(100, [1e30, -1e300, 3.0]), (101, [-1e30, 1.0, 2.0])]
    got = rows_of(topk.topk(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, stripe=16), "query_id", "rank", "vec_id", "score")
    hold = lambda x: int(max(-2 ** 63, min(2 ** 63 - 1, math.floor(256 * x))))
    good = {i: [hold(x) for x in v] for i, v in big}
    cut = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    want = []
    for i in (0, 50, 100):
        scored = sorted((-sum(a * b for a, b in zip(good[i], w)), j) for j, w in good.items() if j != i)[:5]
        want += [(i, k + 1, j, cut(-s)) for k, (s, j) in enumerate(scored)]
    assert got == sorted(want, key=repr)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.topk(none, F.col("vec_id") % 50 == 0).count() == 0


# ---- html

def test_html_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    for r in read("pages"):
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        import html as h
        want = " ".join(h.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", body))).split())
        assert got[r["page_id"]].text == want and got[r["page_id"]].n_chars == len(want) and got[r["page_id"]].url == r["url"]


def test_html_templates_and_odd_pages(spark):
    box = "<div class=x1><p>Follow us everywhere</p></div>"
    rows = [(i, "http://h.org/a", f"<body>{box}<div><p>Story {i} &amp; more<p>  two\n lines {i}</div></body>", 1) for i in range(30)]
    rows += [(100 + i, "http://k.org/a", f"<body><article><p>Quoted passage</p><p>Own {i}</p></article>{box}</body>", 1) for i in range(30)]
    rows += [(200 + i, "http://c.org/a", "<body><div><p>A copied page</p></div></body>", 1) for i in range(30)]
    rows += [(300, None, None, 1), (301, "", "", 1), (302, "x", "plain &lt;b&gt; text <p>open <b>bold", 1), (303, "y", "<article><script>if (a < b) '</p>'</script>A&nbsp;b<br>c<!-- no --></article><p>out", 1),
             (304, "z", "<main><h1>T</h1><div class='comments'><p>me too</p></div><aside>x</aside><form><input></form>y</main>", 1),
             (305, "q", "<a title=\"x > y\">in</a> <a title='open>rest", 1), (306, "n", "<div>" * 3000 + "deep", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"Story {i} & more two lines {i}" for i in range(30))
    assert all(got[100 + i] == f"Quoted passage Own {i}" for i in range(30))
    assert all(got[200 + i] == "A copied page" for i in range(30))
    assert got[300] == got[301] == "" and got[302] == "plain <b> text open bold" and got[303] == "A b c"
    assert got[304] == "T y" and got[305].startswith("in") and got[306] == "deep"
    assert html.extract(df.limit(0)).count() == 0


def test_html_counts_decide_outside_the_article(spark):
    row = "<div class=x1><p>Follow us everywhere</p></div>"
    page = f"<body>{row}<article><p>Own {{0}}</p>{row}</article><p>Correction {{0}}</p><footer>f {{0}}</footer></body>"
    rows = [(i, "http://o.org/a", page.format(i)) for i in range(30)] + [(100 + i, "http://few.org/a", page.format(i)) for i in range(3)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own {i} Correction {i}" for i in range(30))
    assert all(got[100 + i] == f"Own {i} Correction {i}" for i in range(3))


def test_html_text_does_not_depend_on_the_number_of_pages(spark):
    page = "<body><div class=x1><p>Follow us</p></div><article><p>Own {0}</p></article><p>Correction {0}</p></body>"
    rows = [(100 * n + i, f"http://h{n}.org/a", page.format(i)) for n in (1, 2, 9, 10, 19, 20, 40) for i in range(n)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in (2, 9, 10, 19, 20, 40):
        assert all(got[100 * n + i] == f"Own {i} Correction {i}" for i in range(n))
    assert got[100] == "Own 0"          # one page shows nothing to compare


def test_html_templates_brute_force(spark):
    """Recurring subtrees by plain counting over all pages of a host, copies of a page once."""
    rng = random.Random(4)
    boxes = [f"<div class=b{k}><p>box {k}</p></div>" for k in range(8)]
    rows = []
    for host in range(6):
        for i in range(rng.choice([1, 3, 8, 15, 25])):
            own = rng.choice([i, i, 0])
            rows.append((host * 100 + i, f"http://h{host}/", "".join(rng.sample(boxes, rng.randint(0, 4))) + f"<article><p>text {own}</p></article>"))
    pages = {}
    for _, url, h in rows:
        pages.setdefault(url, set()).add((h[h.index("<article>"):], h))
    want = {}
    for pid, url, h in rows:
        texts = {a for a, _ in pages[url]}
        keep = []
        for k in re.findall(r"box (\d)", h):
            n = len({a for a, x in pages[url] if f"box {k}<" in x})
            if n < min(html.MIN_PAGES, max(2, -(-len(texts) // 2))):
                keep += [f"box {k}"] * (len(texts) > 1)
        want[pid] = " ".join([*keep, re.search(r"text \d+", h).group()])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want


def test_html_names_are_whole(spark):
    bodies = {
        1: ("<article><h2 id='related'>Related work</h2><h2 id='related-work'>More</h2><section id='social-policy'>Policy</section>"
            "<p class='notice-period'>Period</p><p id=notice>Notice</p></article>", "Related work More Policy Period Notice"),
        2: ("<div class='content has-sidebar'><article><p>Text</p></article></div>", "Text"),
        3: ("<div class='page sidebar'><main><p>Text</p></main></div><div class=sidebar>x</div>", "Text"),
        4: ("<form><article>Text<div class='comments'><article>me too</article></div></article><nav>n</nav></form>", "Text"),
        5: ("<article>Text<p class='big Promo'>buy</p></article><aside><article>teaser</article></aside>", "Text"),
    }
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in bodies.items()], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == {i: t for i, (_, t) in bodies.items()}


# ---- toxicity

def test_toxicity_held_out(spark, odd):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in read("labels", sf)}
    ids = [d for d in labels if zlib.crc32(str(d).encode()) % 4 == 2 and d in got]
    assert all(got[d].held_out for d in ids) and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    # the given labels hold flips: texts without a toxic word labelled 1, and a few the other way
    tp = sum(labels[d] and got[d].predicted for d in ids)
    assert tp >= 0.65 * sum(labels[d] for d in ids)
    assert tp >= 0.93 * sum(got[d].predicted for d in ids)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_toxicity_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(1, 0, 1), (4, 0, 1), (4, 1, 0), (5, 1, 0), (6, 1, None), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for lab in (none, labels):
        got = toxicity.toxicity(odd, lab).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty(spark), labels).count() == 0


def test_toxicity_inside_long_words(spark):
    rows = [(i, f"plain text {i % 7} " + ("vilewort" if i % 4 == 0 else "harmless")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    glue = "_".join(f"w{k}" for k in range(30))
    more = spark.createDataFrame([(1, f"{glue}_vilewort_{glue}"), (2, f"{glue}_harmless_{glue}"), (3, f"{glue}_{glue}")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(more, model).collect()}
    assert got[1] > got[3] >= got[2]
    word = "\u4e00\u4e8c\u4e09" * 30 + "\u6bd2\u8bdd\u8bed\u53e5" + "\u4e00\u4e8c\u4e09" * 30
    assert zlib.crc32("g\u6bd2\u8bdd\u8bed\u53e5".encode()) & (1 << toxicity.HASH_BITS) - 1 in toxicity.word_features(word)


# ---- decontamination

def edit(a, b):
    row = list(range(len(b) + 1))
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_and_pigeonhole(spark):
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 70))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        assert decontam.myers(a, b)[0] == edit(a, b)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(5, 40)))) for i in range(30)] + [(90, "a b"), (91, None), (92, "")]
    texts = []
    for i in range(60):
        it = rng.choice(items[:30])[1].split()
        for _ in range(rng.randint(0, len(it) // 4)):
            at = rng.randrange(len(it))
            it[at:at + 1] = rng.choice([[], ["zz"], [it[at], "zz"]])
        texts.append((i, " ".join(rng.choices(words, k=rng.randint(0, 30)) + it + rng.choices(words, k=rng.randint(0, 30)))))
    texts += [(200, None), (201, "")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in texts], "doc_id long, text string, distance int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in texts:
        for i, own in items:
            w = decontam.words_of(own or "")
            if len(w) >= decontam.MIN_WORDS and (e := edit(w, decontam.words_of(t or ""))) <= len(w) // 6:
                want.append((d, i, e))
    for size in (1 << 23, 1000):
        assert rows_of(decontam.matches(docs, bench, size), "doc_id", "item_id", "distance") == sorted(want, key=repr)
    clean = decontam.drop_contaminated(docs, bench, 1000)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in texts} - {w[0] for w in want}
    assert decontam.matches(docs, bench.limit(0)).count() == 0 and decontam.matches(docs.limit(0), bench).count() == 0


def test_decontamination_short_and_unspaced_items(spark):
    zh = "\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u4e2a\u57ce\u5e02\u5b83\u6709\u591a\u5c11\u4eba\u53e3\uff0c\u9762\u79ef\u662f\u591a\u5c11\u5e73\u65b9\u516c\u91cc"
    ja = "\u65e5\u672c\u3067\u4e00\u756a\u9ad8\u3044\u5c71\u306f\u4f55\u3067\u3059\u304b"
    th = "\u0e01\u0e23\u0e38\u0e07\u0e40\u0e17\u0e1e\u0e2d\u0e22\u0e39\u0e48\u0e17\u0e35\u0e48\u0e44\u0e2b\u0e19"
    items = [(1, zh), (2, ja), (3, th), (4, "capital of France"), (5, "?!"), (6, "Zyx")]
    near = zh[:10] + "\u5927" + zh[11:]
    texts = [(1, f"\u524d\u8a00{zh}\u540e"), (2, near), (3, f"x {ja}\u3002"), (4, th + th), (5, "the Capital, of france!"), (6, "capital of a France"),
             (7, "\u4e2d\u56fd\u7684\u5c71"), (8, "xzyx zyxx"), (9, "zyx")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 23, 20):
        got = rows_of(decontam.matches(docs, bench, size), "doc_id", "item_id", "distance")
        assert got == [(1, 1, 0), (2, 1, 1), (3, 2, 0), (4, 3, 0), (5, 4, 0), (9, 6, 0)]
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == {6, 7, 8}
    assert decontam.words_of("Don't \u00e9t\u00e9_1 \ud55c\uad6d\uc5b4 x2") == re.findall(r"\w+", "don't \u00e9t\u00e9_1 \ud55c\uad6d\uc5b4 x2")


# ---- n-gram Jaccard join

def true_components(rows):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    index: dict = {}
    for i, s in enumerate(sets):
        for t in s:
            index.setdefault(t, []).append(i)
    for i, s in enumerate(sets):
        both: dict = {}
        for t in s:
            for j in index[t]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        for j, c in both.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c) and rows[i][0] is not None and rows[j][0] is not None:
                up[root(i)] = root(j)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted([(d, len(sets[i]), low[root(i)] if d is not None else None) for i, (d, _) in enumerate(rows)], key=repr)


def near_copies(rng, n, bases, edits, size=60):
    words = [f"w{i}" for i in range(500)]
    stock = [[rng.choice(words) for _ in range(size)] for _ in range(bases)]
    out = []
    for i in range(n):
        w = list(rng.choice(stock))
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            w[at:at + 1] = rng.choice([[], [rng.choice(words)], [w[at], rng.choice(words)]])
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("block, frequent, min_count", [(1 << 18, 65_536, 48), (2000, 65_536, 5), (2000, 0, 5)])
def test_jaccard(spark, both, monkeypatch, block, frequent, min_count):
    docs, plain, odd = both
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "MIN_COUNT", min_count)
    made = near_copies(random.Random(4), 400, 6, 5) + [(1000 + i, "passage " * 3 + " ".join(f"s{k}" for k in range(40)) + f" own{i} tail{i} x{i}")
                                                       for i in range(120)]
    made += [(2000 + i, "short one") for i in range(5)]
    for rows in (made, plain, [x for x in ODD]):
        df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, comp int")
        assert rows_of(jaccard.components(df), "doc_id", "n_shingles", "component_id") == true_components(rows)


def test_jaccard_sends_sets_only_to_blocks_they_can_link_in(spark, monkeypatch):
    """Texts that share a passage form one group of many blocks; only the copies among them are sent to other blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 600)
    monkeypatch.setattr(jaccard, "FREQUENT", 0)
    monkeypatch.setattr(jaccard, "MEET_TOKENS", 1300, raising=False)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    sent, fresh = [], jaccard.fresh
    monkeypatch.setattr(jaccard, "fresh", lambda df: sent.append(df.count()) or fresh(df))
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(i, passage + " " + " ".join(f"w{i}_{k}" for k in range(40))) for i in range(150)]
    rows += [(200 + i, t + f" end{i}") for i, t in rows[:10]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.components(df), "doc_id", "n_shingles", "component_id") == true_components(rows)
    assert 0 < sum(sent) < 4 * len(rows)


def test_jaccard_sends_blocks_together(spark, monkeypatch):
    """Loose copies of one text qualify for every block; a task meets many sets with many blocks, so each is sent few times."""
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 600)
    monkeypatch.setattr(jaccard, "FREQUENT", 0)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    sent, fresh = [], jaccard.fresh
    monkeypatch.setattr(jaccard, "fresh", lambda df: sent.append(df.count()) or fresh(df))
    rng, base, rows = random.Random(5), [f"b{k}" for k in range(80)], []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(80), 2):
            words[at] = f"own{i}_{at}"
        rows.append((i, " ".join(words)))
    rows += [(500 + i, t + " end") for i, t in rows[:20]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.components(df), "doc_id", "n_shingles", "component_id") == true_components(rows)
    assert 0 < sum(sent) < 4 * len(rows)


@pytest.mark.parametrize("nodes", [1, 20, 200_000])
def test_connected(spark, monkeypatch, nodes):
    """Chains, stars, rings, lone and null ends against a walk over the graph, whatever the forests hold at a time."""
    monkeypatch.setattr(common, "FOREST_NODES", nodes)
    rng = random.Random(nodes)
    name = rng.sample(range(-10 ** 12, 10 ** 12), 3000)
    edges = [(i, i + 1) for i in range(300)] + [(400, i) for i in range(401, 700)] + [(700 + i, 700 + (i + 1) % 50) for i in range(50)]
    edges += [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(450)] + [(2500, 2500)] + [(5, 4)] * 20
    rng.shuffle(edges)
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, seen = [], set()
    for x in near:
        if x in seen:
            continue
        own, todo = {x}, [x]
        while todo:
            new = near[todo.pop()] - own
            own |= new
            todo += new
        seen |= own
        want += [(name[y], min(name[z] for z in own)) for y in own]
    rows = [(name[a], name[b]) for a, b in edges] + [(None, 3), (3, None), (None, None)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    assert rows_of(common.connected(df, "t"), "node", "comp") == sorted(want, key=repr)
    assert common.connected(df.limit(0), "t").count() == 0


def test_jaccard_stage_and_empty(spark, odd):
    assert jaccard.components(empty(spark)).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    comp = {d: c for d, _, c in true_components(ODD)}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, _ in ODD if d is None or comp[d] == d), key=repr)


def test_jaccard_stage_decides_per_row(spark):
    own = ["alpha beta gamma delta epsilon zeta " + " ".join(f"{c}{k}" for k in range(30)) for c in "abcdef"]
    rows = [(1, own[0], 0), (2, own[0], 0), (2, own[1], 0), (3, own[2], 0), (3, own[2].upper(), 0), (3, own[2] + " end", 0), (7, own[3], 0)]
    rows += [(None, own[3], k) for k in range(20)] + [(None, own[4] + " x" * (k % 2), k) for k in range(40)] + [(None, own[5], 3)]
    rows += [(None, None, 1), (None, " ", 1), (None, " ", 1), (None, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sid int").repartition(5)
    kept = jaccard.one_of_each(df)
    assert kept.dtypes == df.dtypes
    kept = [tuple(r) for r in kept.collect()]
    assert sorted((d, t) for d, t, _ in kept if d not in (None, 3)) == sorted([(1, own[0]), (2, own[1]), (7, own[3])])
    assert len([1 for d, *_ in kept if d == 3]) == 1
    bare = [r for r in kept if r[0] is None]
    assert sorted((t[:60] for _, t, _ in bare if t and t.strip())) == sorted(x[:60] for x in own[4:])
    assert len(bare) == 6 and set(kept) <= set(rows)
    alone = df.where("doc_id IS NOT NULL")
    assert len(jaccard.one_of_each(alone).collect()) == 4


# ---- licenses

def license_truth(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    hits = [(i, lab) for p, lab in licenses.BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    at = sorted(i for i, _ in hits)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in hits}))


def test_licenses(spark, both):
    docs, plain, odd = both
    more = [(1, "cc by cc by-nc, CC-BY; mit LICENSE mit licenses Kmit licenseK mit license"), (2, "apache license gnu general public license apache"),
            (3, "mit license " * 4000)]
    for df, source in ((docs, plain), (odd, ODD), (spark.createDataFrame(more, "doc_id long, text string"), more)):
        got = rows_of(licenses.license_scan(df), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
        assert got == sorted([(d, *license_truth(t)) for d, t in source], key=repr)
        for r in licenses.license_scan(df).collect():
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert licenses.license_scan(empty(spark)).count() == 0


def license_names(pattern):
    """One text for each alternative of a family's names."""
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    for x in parts:
        x = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)\?", "", x)
        x = re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", x)
        yield x.replace("[0-9]", "2").replace("[cs]", "c").replace("[a-z]*", "").replace(" ?", "")


def test_license_keywords_drop_no_detection(spark):
    table, forms = licenses.rules(), [
        "spdx license identifier {n}", "licensed under {n}", "relicensed under the {n}", "released under {n}", "subject to the {n}",
        "distributed under the terms of the {n}", "published under {n}", "available under the {n}", "provided under {n}",
        "under the terms of the {n}", "under terms and conditions of {n}", "{n} as published by us", "{n} version 2", "{n} v2",
        "{n} licence", "{n} license", "copy of the {n}", "see {n}", "read the {n}"]
    for label, names, _ in licenses.FAMILIES:
        for n in license_names(names):
            for f in forms:
                words = licenses.words_of(f.format(n=n))
                hits = licenses.scan(b" ".join(words), table, words)
                assert hits and hits == licenses.scan(b" ".join(words), table), (label, n, f)
                assert not licenses.gate(table).isdisjoint(words)
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        words = licenses.words_of(row["text"] or "")
        spaced = b" ".join(words)
        assert licenses.scan(spaced, table, words) == licenses.scan(spaced, table)
        if licenses.gate(table).isdisjoint(words):
            assert not licenses.scan(spaced, table) and not licenses.base_places(spaced)


def test_license_versions_in_one_word(spark):
    rows = [(1, "licensed under GPLv3"), (2, "Licensed under the GPLv2 or later"), (3, "released under LGPLv2.1"), (4, "see AGPLv3"), (5, "under the terms of GNU GPLv3"),
            (6, "GPL3 licence"), (7, "licensed under xgplv3"), (8, "licensed under gplv"), (9, "licensed under GPL v2.0"), (10, "licensed under LGPL-2.1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_scan(df).collect()}
    assert got == {1: "gpl", 2: "gpl", 3: "lgpl", 4: "agpl", 5: "gpl", 6: "gpl", 7: "", 8: "", 9: "gpl", 10: "lgpl"}
    table = licenses.rules()
    for _, t in rows:
        words = licenses.words_of(t)
        assert licenses.scan(b" ".join(words), table, words) == licenses.scan(b" ".join(words), table)


def test_license_containment_brute_force():
    table = licenses.rules()
    text = "see mit license version 2 see gnu gpl v2 licensed under the gnu gpl licence copy of gpl v2 under the terms of mit license " * 20
    spaced = b" ".join(licenses.words_of(text))
    found = [(m.start(), m.end() - 1, r[1], r[3]) for r in table for m in r[2].finditer(b" " + spaced)]
    kept = []
    for x in found:
        if not any(a <= x[0] and x[1] <= b for a, b, *_ in kept):
            kept.append(x)
    assert licenses.scan(spaced, table) == sorted(kept)


def test_license_rules_priority_and_containment():
    table = licenses.rules()
    assert len(table) >= 300 and [r[0] for r in table] == list(range(len(table)))
    spaced = b" ".join(licenses.words_of("This is licensed under the GNU Lesser General Public License, version 3."))
    kept = licenses.scan(spaced, table)
    assert kept[0][2] == "lgpl" and all(not (a[0] <= b[0] and b[1] <= a[1]) for i, a in enumerate(kept) for b in kept[i + 1:])
    assert [x[2] for x in licenses.scan(b"licensed under cc by nc 4 0", table)][0] == "cc-by-nc"


# ---- quality

def test_quality_against_labels(spark, odd):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r.score for r in QUERIES["op9_quality"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in read("labels", sf) if r["doc_id"] in got}
    good, bad = sorted(got[d] for d in labels if labels[d]), [got[d] for d in labels if not labels[d]]
    auc = sum(len(good) - bisect.bisect_right(good, b) + 0.5 * (bisect.bisect_right(good, b) - bisect.bisect_left(good, b)) for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert len(quality.quality(odd).collect()) == len(ODD)
    assert quality.quality(empty(spark)).count() == 0


def test_quality_em_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.7
    acc = [0.95, 0.9, 0.8, 0.7, 0.85, 0.6, 0.9, 0.75]
    v = np.array([np.where(rng.random(len(y)) < a, y, ~y).astype(int) for a in acc]).T
    v[rng.random(v.shape) < 0.3] = 2
    pats: dict = {}
    for row in v:
        k = "".join(map(str, row))
        pats[k] = pats.get(k, 0) + 1
    pi, rate, _ = quality.em(pats)
    assert abs(pi - 0.7) < 0.03 and np.abs(rate[1] - acc).max() < 0.04


# ---- chat

def test_chat_query(spark):
    got = {r.conv_id: r for r in QUERIES["op10_chat"](spark, SF).collect()}
    conv: dict = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in sorted(read("conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        conv.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(got) == set(conv)
    for c, turns in conv.items():
        flat = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), hashlib.sha256(flat.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= len(flat)


def test_chat_query_reads_loss_under_the_mask(spark, monkeypatch):
    """Other spans give other loss columns, and nothing else changes."""
    want = {r.conv_id: r for r in QUERIES["op10_chat"](spark, SF).collect()}
    plain = chat.format_log
    monkeypatch.setattr(chat, "format_log", lambda e: plain(e).withColumn("loss_spans", F.expr("slice(loss_spans, 1, 1)")))
    got = {r.conv_id: r for r in QUERIES["op10_chat"](spark, SF).collect()}
    assert {c for c in want if got[c].loss_chars != want[c].loss_chars} == {
        c for c, n in conv_turns().items() if n > 1}
    assert all(got[c].turns_sha256 == want[c].turns_sha256 for c in want)


def conv_turns():
    """Conversations -> assistant turns behind the first that hold text, plus one."""
    out: dict = {-1: 1}
    for r in sorted(read("conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        if r["role"] == "assistant":
            out[r["conv_id"]] = out[r["conv_id"]] + bool(r["text"]) if r["conv_id"] in out else 1
    return out


def test_chat_under_mask_pieces(spark):
    rows = []
    for n in (0, 1, 2, 3, 9, 10, 101):
        text, spans, want = "", [], ""
        for k in range(n):
            body = f"\u00e9{k}&lt;|&amp;lt;" * (k % 4)
            text += f"<{k}>"
            spans.append((len(text), len(body)))
            text += body + "&amp;"
            want += f"\u00e9{k}<|&lt;" * (k % 4)
        rows.append((n, text, spans, want))
    df = spark.createDataFrame(rows, "n int, formatted string, loss_spans array<struct<start:int,length:int>>, want string")
    assert all(r.got == r.want for r in df.withColumn("got", chat.under_mask()).collect())


def test_chat_fold(spark, capsys):
    ev = [(1, 1, "a", "delta", "user", "Hel"), (1, 2, "a", "delta", "user", "lo"), (1, 3, "b", "delta", "assistant", "bad"),
          (1, 4, "b", "regenerate", "assistant", None), (1, 6, "b", "delta", "assistant", "&lt;| <|im_end|> \n"), (1, 5, "b", None, "assistant", "x&amp;"),
          (1, 7, "a", "edit", "user", "Hi"), (1, 8, "a", "delta", "user", "!"), (1, 9, "c", "delta", "user", "gone"), (1, 10, "c", "delete", "user", None),
          (2, None, None, "delta", None, "no ids"), (None, 1, "q", "delta", "us\ner<|", "t"), (3, 1, "z", "delta", "assistant", "")]
    df = spark.createDataFrame([(*e, "x") for e in ev], "conv_id long, seq long, message_id string, kind string, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.format_log(df).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "Hi!"), ("assistant", "x&amp;&lt;| <|im_end|> \n")]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "no ids")]
    assert [(t.role, t.text) for t in got[None].turns] == [("us\ner<|", "t")]
    for r in got.values():
        under = ["".join(r.formatted[s.start:s.start + s.length]).replace("&lt;|", "<|").replace("&amp;", "&") for s in r.loss_spans]
        assert under == [t.text for t in r.turns if t.role == "assistant"]
    assert chat.format_log(df.limit(0)).count() == 0
    capsys.readouterr()
    chat.format_log(df).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


# ---- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "decontamination", "pii", "packing"]
    source = {r["doc_id"]: r["text"] for r in read("documents")}
    cur = docs
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r.text for r in cur.collect()}
        nxt = stage(spark, cur, SF)
        assert nxt.columns == docs.columns and nxt.dtypes == docs.dtypes
        after = {r.doc_id: r.text for r in nxt.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            score = {r.doc_id: r.predicted for r in QUERIES["op5_toxicity"](spark, SF).collect()}
            assert set(after) == {d for d in before if not score[d]}
        if name == "ngram_jaccard":
            assert set(after) == {d for d, _, c in true_components(list(before.items())) if c == d}
        if name == "decontamination":
            bench = [decontam.words_of(r["text"]) for r in read("benchmark")]
            leaked = {d for d, t in before.items() if any(edit(w, decontam.words_of(t)) <= len(w) // 6 for w in bench if set(w) & set(t.lower().split()))} \
                if len(before) * len(bench) < 2000 else {r.doc_id for r in decontam.matches(cur, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - leaked
        if name == "pii":
            assert set(after) == set(before) and all(not base_spans(t) for t in after.values())
            assert all(after[d] == source[d] for d in after if not base_spans(source[d]) and "=" not in source[d] and "token" not in source[d])
        cur = spark.createDataFrame(nxt.collect(), nxt.schema)
    final = cp.STAGES[-1][1](spark, cur, SF).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in cur.collect()}


def test_entry_registers_everything():
    import __spark_entry__ as e
    assert set(QUERIES) <= set(e.queries())
