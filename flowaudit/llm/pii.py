"""Operator 2: personal data by patterns, checksums and context, in DataFrame operations only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_or_empty

_MAIL = "[A-Za-z0-9._%+-]"
#: Patterns that propose spans; look-behinds only keep a search from starting inside a run again.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A cheap sign without which a pattern cannot match.
SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
#: Lower-case words before a span that speak for its kind.
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|address|host|server", "card": "card|visa|credit|payment|amex",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank|konto|compte|cuenta", "ssn": "ssn|social|security",
}
REACH = 40
#: Score of a confirmed span, what context adds, and what a span needs. A number of the ssn form has no checksum, so it needs context.
CONFIRMED = {"email": 0.8, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
CONTEXT_ADDS, NEEDED = 0.2, 0.5
CHUNK = 64
BLOCK = 4096

SPAN_TYPE = "array<struct<start:int,end:int,kind:string,score:double>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    """Sum over digits from the right, every second doubled, is a multiple of ten."""
    d = F.transform(F.split(F.reverse(_digits(c)), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(c: Column) -> Column:
    """The first four characters to the end, letters as 10 to 35; the number leaves 1 modulo 97."""
    s = F.replace(c, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")

    def step(a, x):
        v = F.ascii(x)
        return F.when(x == "", a).when(v >= 65, (a * 100 + v - 55) % 97).otherwise((a * 10 + v - 48) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(p, -3, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(12, 19) & _luhn(m)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(m)
    return F.lit(True)


def _let(value: Column, then) -> Column:
    """Name a value inside an expression, so it is computed once and not for each element of a lambda."""
    return F.get(F.transform(F.array(value), then), 0)


def _fold_before(steps: Column, op, start: int = 0) -> Column:
    """For each element the fold (sums, maxima) of those before it: first of the chunks before, then of the rest of its own chunk."""
    def fold(xs, first=None):
        return F.aggregate(xs, F.lit(start) if first is None else first, op)

    def chunks(s):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / CHUNK).cast("int")), lambda k: F.slice(s, k * CHUNK + 1, CHUNK))

    def inner(whole, before):
        return F.flatten(F.zip_with(whole, before, lambda part, b: F.transform(part, lambda x, i: fold(F.slice(part, F.lit(1), i), b))))

    def outer(whole):
        return _let(F.transform(whole, lambda part: fold(part)), lambda sums: inner(whole, F.transform(sums, lambda x, i: fold(F.slice(sums, F.lit(1), i)))))

    return _let(steps, lambda s: _let(chunks(s), outer))


def _add(a: Column, x: Column) -> Column:
    return a + x


def _sign(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit(SIGN[kind])) if SIGN[kind] else F.lit(True)


def _confirms(kind: str):
    return lambda m: _confirmed(kind, m)


def _step(kind: str):
    """A gap and the match behind it: lengths, the gap's last code points, the match and whether it is confirmed."""
    return lambda g, m: F.struct(F.length(g).alias("gap"), _end_of(g).alias("tail"), F.coalesce(F.length(m), F.lit(0)).alias("len"), m.alias("m"),
                                 (m.isNotNull() & _confirmed(kind, m)).alias("ok"))


def _scores(kind: str):
    """A match as a span with its score; the words of its context stand within REACH before it."""
    def scored(x):
        near = lower_ascii(x["before"]).rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"),
                        (F.lit(CONFIRMED[kind]) + F.when(near, CONTEXT_ADDS).otherwise(0.0)).alias("score"))
    return scored


def _end_of(c: Column) -> Column:
    return F.substring(c, -REACH, REACH)


def _placed(at: Column) -> Column:
    """Matches with their places and the REACH code points before them, in time linear in the matches.

    The code points before a match are the ends of the gaps and matches before it. A match has
    two code points at least, so half of REACH matches hold enough.
    """
    def placed(a):
        def one(x, i):
            first = F.greatest(i - REACH // 2, F.lit(0))
            past = F.array_join(F.transform(F.slice(a, first + 1, i - first), lambda y: F.concat(y["tail"], _end_of(y["m"]))), "")
            return F.struct(x["gap"].alias("gap"), x["len"].alias("len"), x["m"].alias("m"), _end_of(F.concat(past, x["tail"])).alias("before"))
        seen = F.transform(a, lambda x, i: F.when(x["ok"], one(x, i)))
        begins = F.zip_with(seen, _fold_before(F.transform(a, lambda x: x["gap"] + x["len"]), _add), lambda x, b: F.struct(
            (b + x["gap"]).alias("start"), (b + x["gap"] + x["len"]).alias("end"), x["m"].alias("m"), x["before"].alias("before")))
        return F.filter(begins, lambda x: x["m"].isNotNull())
    return _let(at, placed)


def find_personal_data(rows: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row, spans): each row as a struct with its personal data, sorted by start and kind.

    General: the project's tables hold addresses in columns, not in prose, so any table with an
    id and a text will do. Patterns propose spans, leftmost and without overlap within a kind;
    Luhn, modulo 97, ranges and digit counts confirm them; what fails is dropped and not tried
    again. A confirmed span has a score, and a word of its kind's context within 40 characters
    before it adds to that; spans under 0.5 go, which drops social security numbers without
    context. Kinds email, ip, card and phone depend on no context.

    Positions are code points, the end exclusive: the text is split at a pattern, and lengths of
    gaps and matches are summed. A null or empty text has no spans. Every row comes out once,
    with null ids and repeats.
    """
    d = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), text_or_empty(text_col).alias("_text"))
    empty = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        d = d.withColumn(f"_hit_{kind}", F.when(_sign(kind, F.col("_text")), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(empty))
    out = []
    for kind, pattern in PATTERNS.items():
        hits = F.col(f"_hit_{kind}")
        # the split runs only where something in the hits is confirmed
        sound = F.exists(hits, _confirms(kind))
        d = d.withColumn(f"_at_{kind}", F.when(sound, F.zip_with(F.split("_text", pattern, -1), hits, _step(kind))))
        good = F.transform(_placed(F.col(f"_at_{kind}")), _scores(kind))
        out.append(F.coalesce(F.filter(good, lambda s: s["score"] >= NEEDED).cast(SPAN_TYPE), F.array().cast(SPAN_TYPE)))
    order = list(PATTERNS)

    def before(a, b):
        rank = lambda s: F.array_position(F.array(*map(F.lit, order)), s["kind"])
        by = [(a["start"], b["start"]), (rank(a), rank(b))]
        c = F.lit(0)
        for x, y in reversed(by):
            c = F.when(x < y, -1).when(x > y, 1).otherwise(c)
        return c

    d = d.withColumn("_spans", F.concat(*out))
    return d.select("row", F.when(F.size("_spans") > 1, F.array_sort("_spans", before)).otherwise(F.col("_spans")).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(rows: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """The rows with each span of personal data replaced by its kind in brackets.

    Spans that overlap are replaced together, under the kind of the first. A null text stays null.
    """
    found = find_personal_data(rows, id_col, text_col)
    text = F.col(f"row.`{text_col}`")

    def piece(blocks, a, b):
        """Code points a to b, from blocks of the text, so that the text is not read from its start for each span."""
        return F.when(b <= a, "").otherwise(F.array_join(F.transform(
            F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")),
            lambda k: F.substring(F.get(blocks, k), F.greatest(a - k * BLOCK, F.lit(0)) + 1, F.least(b, (k + 1) * BLOCK) - F.greatest(a, k * BLOCK))), ""))

    def joined(blocks, reach):
        """A span that starts at or behind all ends before it opens a new bracket; the others belong to the last one."""
        return F.array_join(F.zip_with("spans", reach, lambda s, r: F.when(
            s["start"] >= r, F.concat(piece(blocks, r, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")), "")

    ends = F.transform("spans", lambda s: s["end"])
    clean = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: F.concat(
        _let(_fold_before(ends, lambda x, y: F.greatest(x, y)), lambda reach: joined(blocks, reach)), piece(blocks, F.array_max(ends), F.length(text))))
    clean = F.when(F.size("spans") > 0, clean).otherwise(text)
    return found.select(*[(clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in rows.columns])
