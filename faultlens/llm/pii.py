"""Personal data by weak supervision, in DataFrame functions only.

Regexes propose candidate spans; four labelers vote on each (format regex, gazetteer, context words, shape;
1 for, 0 against, -1 abstains). The votes are counted per kind and pattern, a table bounded by
kinds x 3^4 x feature buckets. Expectation-maximisation over the pattern counts (one SQL fold) estimates each
labeler's reliability per kind, and its posteriors train the final span classifier, naive Bayes over bucketed
span features. Base kinds (email, ip, card, phone) that pass their checks always stay; the classifier decides
the added kinds (secret, ssn, iban, name).

Places are code points, end exclusive. They come from the lengths of the matches and of the text between
them (``regexp_extract_all`` beside ``split`` with one pattern), summed in blocks, so a text with very many
matches costs no quadratic work. Patterns are written so that each text position is tried once.

Defined results: null or empty texts have no spans; overlapping spans of different kinds are all reported;
ties in start follow the order of ``KINDS``; repeated rows are scanned once each; an empty table gives an empty
table; extra columns are ignored by :func:`find_pii` and kept by :func:`mask_pii`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# kind -> pattern with the same leftmost matches as its plain form: possessive runs, and a start that is the
# end of the last match or has no run character before it
_MAIL = "A-Za-z0-9._%+-"
# length of an IBAN -> countries (ISO 13616)
_IBAN = {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
         22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR",
         27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}


def _iban() -> str:
    """Groups of four and a shorter last one: first as long as the country has it, so that a word behind isn't taken in,
    else of any length from 15."""
    exact = [f"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f"\\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
             for n, c in _IBAN.items()]
    groups = r"(?:\x20?[A-Z0-9]{4})"
    other = rf"[A-Z]{{2}}[0-9]{{2}}(?:{groups}{{3,7}}(?:\x20?[A-Z0-9]{{1,3}})?|{groups}{{2}}\x20?[A-Z0-9]{{3}})"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{'|'.join(exact)})(?![A-Za-z0-9])|{other}(?![A-Za-z0-9]))"


KINDS = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)\x20{0,3}[=:]\x20{0,3}\x22?[A-Za-z0-9_+/=-]{8,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": _iban(),
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\.?\x20[A-Z][a-z]{1,30}(?![a-z])",
}
BASE = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
# a character class that every match of the kind holds, as a cheap gate
_GATE = {"email": "@", "ip": ".", "phone": "+"}
# gazetteers and context words, tried in the span and in the code points before it
GAZETTEER = {
    "email": "example|mail|gmail|yahoo|outlook|hotmail|proton", "ip": "^(?:10|127|192\\.168|172)\\.",
    "card": "^(?:4|5[1-5]|34|37|6011)", "phone": "^\\+(?:1|33|34|44|49)(?![0-9]{12})",
    "secret": "(?i)password|token|secret|key", "ssn": "^(?!000|666|9)[0-9]{3}",
    "iban": "^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT)", "name": "Mr|Mrs|Ms|Dr|Prof|Herr|Frau",
}
CONTEXT = {
    "email": "mail|contact|write|address", "ip": "ip|host|server|address", "card": "card|visa|credit|pay",
    "phone": "phone|call|tel|mobile|fax", "secret": "login|user|config|set|export", "ssn": "ssn|social|security",
    "iban": "iban|account|bank|konto", "name": "by|from|dear|contact|signed",
}
AGAINST = r"(?i)(?:version|fig|figure|table|page|chapter|isbn|section)\W*$"
RUN = 64        # spans folded at a time in masking
BLOCK = 1024    # code points in a block that masking cuts from
WINDOW = 24
ITERATIONS = 25
_SUM = "(x, y) -> x + y"


def _spans(text: str, kind: str) -> str:
    """SQL: array of (s, e, m, ctx) of the pattern's leftmost non-overlapping matches in column ``text``."""
    pat = "r'" + KINDS[kind] + "'"
    body = f"""
      transform(array(named_struct('m', regexp_extract_all({text}, {pat}, 0), 'g', split({text}, {pat}, -1))), z ->
        transform(array(zip_with(z.m, slice(z.g, 1, size(z.m)), (p, q) -> length(p) + length(q))), c ->
          if(size(z.m) = 0, array(), transform(
            flatten(transform(sequence(0, (greatest(size(z.m), 1) - 1) div 128), k ->
              transform(array(aggregate(slice(c, 1, k * 128), 0, {_SUM})), base ->
                transform(sequence(1, least(128, size(c) - k * 128)), i ->
                  base + aggregate(slice(c, k * 128 + 1, i), 0, {_SUM})))[0])),
            (e, i) -> named_struct('s', e - length(z.m[i]), 'e', e, 'm', z.m[i], 'ctx', right(z.g[i], {WINDOW}))))
        )[0])[0]"""
    empty = "cast(array() as array<struct<s:int,e:int,m:string,ctx:string>>)"
    gate = _GATE.get(kind)
    test = f"contains({text}, '{gate}')" if gate else f"{text} rlike '[0-9]'" if kind in ("card", "ssn", "iban") else "true"
    if kind == "ip":
        test += f" and {text} rlike '[0-9]\\\\.[0-9]'"
    return f"if({test}, {body}, {empty})"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _valid(kind: str, m: str) -> str:
    """SQL: does a match pass the checks of its kind?"""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return f"{m} rlike r'^{part}(?:[.]{part}){{3}}$'"
    if kind == "card":
        d = _digits(m)
        luhn = (f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + "
                f"transform(array(cast(substring({d}, length({d}) - i + 1, 1) as int) * if(i % 2 = 0, 2, 1)), v -> if(v > 9, v - 9, v))[0]) % 10 = 0")
        return f"if(length({m}) between 14 and 37 and length({d}) between 14 and 19, {luhn}, false)"
    if kind == "phone":
        return f"length({_digits(m)}) between 10 and 15"
    return "true"


def candidates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``cands``: all candidate spans that pass their kind's checks."""
    src = docs.select(*(keep or ["doc_id"]), F.coalesce(F.col("text"), F.lit("")).alias("_text_"))
    src = src.select("*", *[F.expr(_spans("_text_", k)).alias(f"_{k}_") for k in KINDS])
    parts = [f"transform(filter(_{k}_, x -> {_valid(k, 'x.m')}), x -> named_struct('s', x.s, 'o', {ORDER[k]}, 'e', x.e, "
             f"'kind', '{k}', 'm', x.m, 'ctx', x.ctx))" for k in KINDS]
    return src.select(*[c for c in src.columns if c not in {f"_{k}_" for k in KINDS}],
                      F.expr(f"array_sort(concat({', '.join(parts)}))").alias("cands"))


def _case(kind: str, table: dict[str, str], col: str, other: str) -> str:
    return "case " + " ".join(f"when {kind} = '{k}' then {col} rlike r'(?i){v}'" for k, v in table.items()) + f" else {other} end"


def _mod97(m: str) -> str:
    """SQL: does an IBAN's remainder by 97 fit?"""
    value = "instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substring(t, i, 1)) - 1"
    return (f"transform(transform(array(replace({m}, ' ', '')), t -> concat(substring(t, 5), substring(t, 1, 4))), t -> "
            f"aggregate(sequence(1, length(t)), 0, (a, i) -> (a * if(substring(t, i, 1) >= 'A', 100, 10) + {value}) % 97))[0] = 1")


def _votes(x: str) -> str:
    """SQL: the four labelers' votes on struct ``x``."""
    strict = (f"case when {x}.kind = 'secret' then {x}.m rlike '[0-9]' when {x}.kind = 'name' then {x}.m rlike r'\\. ' "
              f"when {x}.kind = 'iban' then length(replace({x}.m, ' ', '')) between 15 and 34 else true end")
    shape = (f"case when {x}.kind = 'secret' then {x}.m rlike r'[=:].*[0-9].*[A-Za-z]|[=:].*[A-Za-z].*[0-9]' "
             f"when {x}.kind = 'ssn' then not {x}.m rlike '-0000$' when {x}.kind = 'iban' then {_mod97(f'{x}.m')} else true end")
    return (f"array(if({strict}, 1, 0), if({_case(f'{x}.kind', GAZETTEER, f'{x}.m', 'false')}, 1, -1), "
            f"case when {x}.ctx rlike r'{AGAINST}' then 0 when {_case(f'{x}.kind', CONTEXT, f'{x}.ctx', 'false')} then 1 else -1 end, "
            f"if({shape}, 1, 0))")


def _features(x: str) -> str:
    """SQL: bucketed span features of struct ``x`` (each a small int)."""
    return (f"array(least(length({x}.m) div 4, 15), cast(round(4 * length(regexp_replace({x}.m, '[^0-9]', '')) / length({x}.m)) as int), "
            f"if({x}.m rlike '[A-Z]', 1, 0) + if({x}.m rlike '[a-z]', 2, 0), if({x}.ctx rlike r'[\\w]$', 1, 0) + "
            f"case when {x}.kind = 'iban' then if({_mod97(f'{x}.m')}, 2, 0) else 0 end)")


def _em_sql() -> str:
    """SQL over ``pats`` (array of (v, f, n)): state (pi, a, b) after ``ITERATIONS`` rounds. a[j], b[j]: chance that
    labeler j says 1 for a true and for a false span."""
    like = lambda p, w, start: (f"aggregate(sequence(0, 3), {start}, (l, j) -> l * case when {p}.v[j] < 0 then 1D "  # noqa: E731
                                f"when {p}.v[j] = 1 then s.{w}[j] else 1D - s.{w}[j] end)")
    post = f"transform(array(named_struct('t', {like('p', 'a', 's.pi')}, 'u', {like('p', 'b', '1D - s.pi')})), r -> r.t / (r.t + r.u))[0]"
    rate = lambda q: (f"transform(sequence(0, 3), j -> (aggregate(w, {q[1]}, (t, p) -> t + if(p.v[j] = 1, p.n * {q[0]}, 0D))) / "  # noqa: E731
                      f"(aggregate(w, 2D, (t, p) -> t + if(p.v[j] >= 0, p.n * {q[0]}, 0D))))")
    step = (f"transform(array(transform(pats, p -> named_struct('v', p.v, 'n', p.n, 'q', {post}))), w -> named_struct("
            f"'pi', least(0.999D, greatest(0.001D, aggregate(w, 0D, (t, p) -> t + p.n * p.q) / aggregate(w, 1e-9D, (t, p) -> t + p.n))), "
            f"'a', {rate(('p.q', '1.6D'))}, 'b', {rate(('(1D - p.q)', '0.4D'))}))[0]")
    init = "named_struct('pi', 0.7D, 'a', array(0.8D, 0.8D, 0.8D, 0.8D), 'b', array(0.2D, 0.2D, 0.2D, 0.2D))"
    return f"aggregate(sequence(1, {ITERATIONS}), {init}, (s, i) -> {step})"


def fit(docs: DataFrame) -> DataFrame:
    """Classifier table ``kind, feature, value, weight`` (feature -1: the prior's log odds)."""
    x = candidates(docs).select(F.explode("cands").alias("x"))
    pats = (x.select("x.kind", F.expr(_votes("x")).alias("v"), F.expr(_features("x")).alias("f"))
            .groupBy("kind", "v", "f").agg(F.count(F.lit(1)).cast("double").alias("n")))
    # a row per kind; its array is bounded by votes x features
    em = (pats.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("v", "f", "n"))).alias("pats"))
          .withColumn("s", F.expr(_em_sql())))
    like = lambda w, start: (f"aggregate(sequence(0, 3), {start}, (l, j) -> l * case when p.v[j] < 0 then 1D when p.v[j] = 1 "  # noqa: E731
                             f"then s.{w}[j] else 1D - s.{w}[j] end)")
    scored = em.select("kind", "s", F.explode("pats").alias("p")).select(
        "kind", "p.f", "p.n", F.expr(f"{like('a', 's.pi')} / ({like('a', 's.pi')} + {like('b', '1D - s.pi')})").alias("q"))
    feats = (scored.select("kind", "n", "q", F.posexplode("f").alias("feature", "value"))
             .union(scored.select("kind", "n", "q", F.lit(-1), F.lit(0))))
    per = feats.groupBy("kind", "feature", "value").agg(F.sum(F.col("n") * F.col("q")).alias("t"),
                                                        F.sum(F.col("n") * (1 - F.col("q"))).alias("u"))
    total = scored.groupBy("kind").agg(F.sum(F.col("n") * F.col("q")).alias("tt"), F.sum(F.col("n") * (1 - F.col("q"))).alias("uu"))
    return per.join(total, "kind").select(
        "kind", "feature", "value",
        F.when(F.col("feature") == -1, F.log((F.col("t") + 1) / (F.col("u") + 1)))
        .otherwise(F.log((F.col("t") + 1) / (F.col("tt") + 16)) - F.log((F.col("u") + 1) / (F.col("uu") + 16))).alias("weight"))


def _model_column(model: DataFrame) -> Column:
    """The weights as one literal map; bounded by kinds x features x buckets (at most 8 x 31)."""
    rows = model.collect()
    flat = [F.lit(v) for r in rows for v in (f"{r['kind']}:{r['feature']}:{r['value']}", float(r["weight"]))]
    return F.create_map(*flat) if flat else F.expr("cast(map() as map<string,double>)")


def find_pii(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``pii``: array of (s, o, e, kind, m) by start, then kind."""
    weights = _model_column(fit(docs))
    c = candidates(docs, keep).withColumn("_w_", weights)
    base = ", ".join(f"'{k}'" for k in BASE)
    score = (f"coalesce(element_at(_w_, concat(x.kind, ':-1:0')), 0D) + aggregate(transform({_features('x')}, (v, i) -> "
             f"coalesce(element_at(_w_, concat(x.kind, ':', i, ':', v)), 0D)), 0D, (a, b) -> a + b)")
    kept = f"filter(cands, x -> x.kind in ({base}) or {score} >= 0)"
    return c.withColumn("pii", F.expr(f"transform({kept}, x -> named_struct('s', x.s, 'o', x.o, 'e', x.e, 'kind', x.kind, 'm', x.m))")
                        ).drop("_w_", "cands", "_text_")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document."""
    f = find_pii(docs)
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))

    def count(kind):
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return f.select("doc_id", *[count(k) for k in BASE],
                    F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by ``[KIND]`` (overlapping spans become one, named by the first);
    ``n_chars``, where present, follows the new text; null texts stay null."""
    cols = docs.columns
    f = find_pii(docs, keep=[F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row_")
                             , F.col("text").alias("text")])
    # the end of all spans before each one, by runs of spans: no fold copies a long array
    ends = F.expr(f"""flatten(transform(
        transform(sequence(0, greatest(0, (size(pii) - 1) div {RUN})), c -> struct(slice(pii, c * {RUN} + 1, {RUN}) as own,
            coalesce(array_max(slice(_tops_, 1, c)), 0) as before)),
        r -> aggregate(r.own, named_struct('m', r.before, 'r', cast(array() as array<int>)),
            (a, x) -> named_struct('m', greatest(a.m, x.e), 'r', concat(a.r, array(a.m))), a -> a.r)))""")
    f = f.withColumn("_tops_", F.expr(f"transform(sequence(0, greatest(0, (size(pii) - 1) div {RUN})), c -> "
                                      f"array_max(transform(slice(pii, c * {RUN} + 1, {RUN}), x -> x.e)))"))
    f = f.withColumn("_ends_", ends).withColumn("_blocks_", F.expr(f"if(size(pii) = 0, array(), regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0))"))

    def piece(a: str, b: str) -> str:
        """Code points a to b, read from their blocks alone."""
        return (f"if({b} <= {a}, '', substring(array_join(slice(_blocks_, {a} div {BLOCK} + 1, ({b} - 1) div {BLOCK} - {a} div {BLOCK} + 1), ''), "
                f"{a} % {BLOCK} + 1, {b} - {a}))")
    new = F.expr(f"""if(size(pii) = 0, text, concat(array_join(transform(pii, (x, i) -> if(x.s < _ends_[i], '',
        concat({piece('_ends_[i]', 'x.s')}, '[', upper(x.kind), ']'))), ''), {piece('array_max(_tops_)', 'length(text)')}))""")
    f = f.withColumn("_new_", new)
    out = [F.col("_new_").alias(c) if c == "text" else F.length("_new_").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
           else F.col(f"_row_.`{c}`").alias(c) for c in cols]
    return f.select(*out)
