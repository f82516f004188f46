"""Personal data: patterns propose spans, checksums confirm them, context adjusts their score. Native expressions only.

Offsets count code points. Base kinds are matched leftmost without overlap within a kind and kept when
their check holds (address parts up to 255, Luhn, digit counts). The other kinds, bank account numbers
(length by country, mod 97) and social numbers, are kept when pattern, checksum and nearby words together score enough.

Context is what stands within CONTEXT characters before and after a span, as far as the next matches of its kind.

Defined cases: null counts as empty and gives no span; long runs of one character are matched in linear
time, and time grows in proportion to the number of matches (but for sums over at most three levels of BLOCK
values); equal or overlapping spans of different kinds are all reported, and merged for redaction, under the
name of the first; input columns that clash with results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Guards let a match start only where its run starts or where the last match ended, which changes no
#: leftmost match but keeps long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an account number by country code, in the registry and in wider use.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A whole number, single spaces allowed. Matches take its first four characters, so that a wrong candidate hides none that starts in it.
IBAN_WHOLE = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
IBAN = f"(?<![A-Za-z0-9])(?={IBAN_WHOLE})[A-Z]{{2}}[0-9]{{2}}"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Words within CONTEXT characters of a span that raise its score.
CONTEXT = 40
#: Values summed at once on each of the levels of a running total; characters of a text's chunks.
BLOCK = 64
CHUNK, CHUNKS = 1024, 64
NEARBY = {
    "email": r"(?i)e-?mail|contact|correo|kontakt|write to",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|credit|tarjeta|carte|karte|pay",
    "phone": r"(?i)phone|tel|call|mobile|fax|whats",
    "iban": r"(?i)iban|bank|account|konto|cuenta|compte",
    "social": r"(?i)ssn|social|security|tax",
}
#: Score of a pattern with its checksum, before context adds CONTEXT_SCORE.
PATTERN_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "social": 0.4}
CONTEXT_SCORE = 0.2
#: Spans of kinds beyond the base ones need so much.
MIN_SCORE = 0.6
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "social")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.reverse(F.transform(F.filter(F.split(number, ""), lambda c: c != ""), lambda c: F.ascii(c) - 48))
    weigh = lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.transform(d, weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, letters as 10 to 35 and its first four characters last, leaves 1 modulo 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.filter(F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), ""), lambda c: c != "")
    step = lambda a, c: F.when(c < "A", a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(turned, F.lit(0), step) == 1


def _phone(x: Column) -> Column:
    return F.length(digits(x)).between(10, 15)


def _ip(x: Column) -> Column:
    number = lambda p: F.concat(F.lit("0"), F.left(F.ltrim(p, F.lit("0")), F.lit(4))).cast("int")  # noqa: E731  four digits tell
    return F.forall(F.split(x, r"\."), lambda p: number(p) <= 255)


#: Kind: pattern, what a text must contain for it, check of a match.
RULES: dict[str, tuple[str, Callable[[Column], Column], Callable[[Column], Column]]] = {
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    "ip": (IP, lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")), _ip),
    "card": (CARD, lambda t: F.rlike(t, F.lit(r"[0-9][\x20-]?[0-9]")), lambda m: luhn(digits(m))),
    "phone": (PHONE, lambda t: F.contains(t, F.lit("+")), _phone),
    "iban": (IBAN, lambda t: F.rlike(t, F.lit("[A-Z]{2}[0-9]{2}")), mod97),
    "social": (SOCIAL, lambda t: F.rlike(t, F.lit("[0-9]{3}-[0-9]{2}-")), lambda m: F.lit(True)),
}
#: Kinds whose pattern matches the start of a span only: the whole span, and the most characters to read for it.
WHOLE = {"iban": (IBAN_WHOLE, 2 * max(IBAN_LENGTHS))}
SPAN = "struct<start:int,rank:int,kind:string,end:int,score:double>"


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once."""
    return F.transform(F.array(value), of)[0]


def _levels(values: Column, fold: Callable[[Column], Column]) -> Column:
    """struct(a, b, c): the values, and folds of every BLOCK of them, twice."""
    up = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda i: fold(F.slice(a, i * BLOCK + 1, F.lit(BLOCK))))
    none = lambda a: F.slice(a, F.lit(1), F.lit(0))
    over = lambda a: F.when(F.size(a) > 0, up(a)).otherwise(none(a))
    return _let(values, lambda a: _let(over(a), lambda b: F.struct(a.alias("a"), b.alias("b"), over(b).alias("c"))))


def _before(levels: Column, i: Column, fold: Callable[[Column], Column]) -> Column:
    """array of the folds of the values before place i, level by level: at most BLOCK values of each of the lower two are read."""
    part = lambda a, start, end: fold(F.slice(a, start + 1, end - start))
    wide, block = F.floor(i / (BLOCK * BLOCK)).cast("int"), F.floor(i / BLOCK).cast("int")
    return F.array(part(levels["c"], F.lit(0), wide), part(levels["b"], wide * BLOCK, block), part(levels["a"], block * BLOCK, i))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def _max(a: Column) -> Column:
    return F.coalesce(F.array_max(a), F.lit(0))


def spans_of(text: Column, kind: str) -> Column:
    """array<SPAN> of one kind: running lengths of the matches and of the text between them give the offsets."""
    pattern, hint, check = RULES[kind]
    rank = KINDS.index(kind)
    least = 0.0 if kind in BASE else MIN_SCORE

    def of(got: Column) -> Column:
        between, found = got["between"], got["found"]
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))

        def spans(levels: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                start = _sum(_before(levels, i, _sum)) + F.length(F.get(between, i))
                near = F.concat(F.right(F.get(between, i), F.lit(CONTEXT)), F.lit(" "), F.left(F.get(between, i + 1), F.lit(CONTEXT)))
                if kind in WHOLE:  # what follows the match, from as many gaps and matches as the longest span may cover
                    whole, most = WHOLE[kind]
                    rest = F.zip_with(F.slice(between, i + 2, F.lit(most // 4)), F.slice(found, i + 2, F.lit(most // 4)), lambda g, x: F.concat(F.left(g, F.lit(most)), F.coalesce(x, F.lit(""))))
                    m = F.regexp_extract(F.concat(m, F.left(F.array_join(rest, ""), F.lit(most))), f"^{whole}", 0)
                score = F.lit(PATTERN_SCORE[kind]) + F.when(F.rlike(near, F.lit(NEARBY[kind])), CONTEXT_SCORE).otherwise(0.0)
                return F.struct(
                    start.alias("start"),
                    F.lit(rank).alias("rank"),
                    F.lit(kind).alias("kind"),
                    (start + F.length(m)).alias("end"),
                    F.when(check(m), score).otherwise(-1.0).alias("score"),
                )

            return F.filter(F.transform(found, span), lambda s: s["score"] >= least)

        return _let(_levels(steps, _sum), spans)

    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))
    return F.when(hint(text), _let(parts, of)).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with all spans of a text, by start, then kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("_text", whole)
    for kind in KINDS:
        step = step.withColumn(f"_{kind}", spans_of(F.col("_text"), kind))
    return step.withColumn(spans, F.array_sort(F.concat(*(F.col(f"_{k}") for k in KINDS)))).drop("_text", *(f"_{k}" for k in KINDS))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def merged(spans: Column) -> Column:
    """array<struct<start,end,kind>>: ordered spans without overlap; of those that overlap one remains, from the first start to the last end."""

    def of(spans: Column, levels: Column) -> Column:
        ends = lambda i: _max(_before(levels, i, _max))  # noqa: E731  the last end of the spans before place i
        first = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), i.alias("i"))), lambda s: s["start"] >= ends(s["i"]))
        last = lambda heads: F.transform(
            heads, lambda h, j: F.struct(h["start"].alias("start"), ends(F.coalesce(F.get(heads, j + 1)["i"], F.size(spans))).alias("end"), h["kind"].alias("kind"))
        )
        return _let(first, last)

    # each value is named once, so that no later filter or projection multiplies the work
    return _let(spans, lambda held: _let(_levels(F.transform(held, lambda s: s["end"]), _max), lambda levels: of(held, levels)))


def _chunks(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def redacted(text: Column, merged: Column) -> Column:
    """The text with each span replaced by its kind in brackets. Cut from chunks, so that no piece is sought from the text's start."""

    def of(text: Column, merged: Column, chunks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            a, b = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
            tail = F.concat(
                F.substring(F.get(chunks, a), start - a * CHUNK + 1, F.lit(CHUNK)),
                F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""),
                F.substring(F.coalesce(F.get(chunks, b), F.lit("")), F.lit(1), end - b * CHUNK),
            )
            return F.when(end <= start, "").when(a == b, F.substring(F.get(chunks, a), start - a * CHUNK + 1, end - start)).otherwise(tail)

        mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        parts = F.transform(merged, lambda s, i: F.concat(piece(F.coalesce(F.get(merged, i - 1)["end"], F.lit(0)), s["start"]), mark(s)))
        return F.concat(F.array_join(parts, ""), piece(F.coalesce(F.try_element_at(merged, F.lit(-1))["end"], F.lit(0)), F.length(text)))

    chunks = lambda t: F.flatten(F.transform(_chunks(t, CHUNK * CHUNKS), lambda c: _chunks(c, CHUNK)))
    held = F.struct(text.alias("text"), merged.alias("merged"))
    cut = lambda h: _let(chunks(h["text"]), lambda c: of(h["text"], h["merged"], c))
    return _let(held, lambda h: F.when(F.size(h["merged"]) == 0, h["text"]).otherwise(cut(h)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; a null text stays null."""
    return with_spans(docs, text, "_spans").withColumn(text, redacted(F.col(text), merged(F.col("_spans")))).select(*docs.columns)
