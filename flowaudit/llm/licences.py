"""Operator 9: licence scans with Aho-Corasick and a shunting-yard parser."""
from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches

#: Phrases of the base scan and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice phrases the method adds: label and how far the phrase alone convinces.
NOTICES = {
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "permission to use copy modify and or distribute this software": ("isc", 0.9),
    "licensed under the apache license version 2 0": ("apache", 0.95),
    "under the terms of the gnu general public license": ("gpl", 0.95),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "boost software license": ("bsl", 0.8),
    "creative commons attribution": ("cc-by", 0.8),
    "bsd license": ("bsd", 0.7),
}
BASE_WEIGHT, TAG_WEIGHT = 0.7, 0.98
TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.I)
PARTS = re.compile(r"[()]|[A-Za-z0-9.+:-]+|\S")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_WORD_BYTES = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def family(licence: str) -> str:
    """The label of an identifier: its name without version and suffixes."""
    s = licence.lower().rstrip("+")
    if s.startswith("cc-by"):
        return "cc-by"
    return re.split(r"-v?\d|-(?:only|or-later|clause)", s)[0]


def evaluate(expression: str, choices: bool = True) -> frozenset:
    """A licence expression as its choices, each the set of labels that hold together.

    The choices can be as many as two to the power of the brackets, so `choices=False` gives
    the labels of all choices at once instead.

    Shunting-yard: operands go to the output, and/or/with and brackets through a stack; `with`
    binds tightest and `or` least. `or` unites choices, `and` combines each with each, `with`
    keeps the licence and drops the exception's name. The longest well-formed beginning of the
    text counts, so words after the expression end it. Nothing well-formed: no choice.
    """
    tokens, depth = [], 0
    for part in PARTS.finditer(expression):                  # stops at the first word that does not belong
        t, word = part[0], part[0].lower()
        operand_next = not tokens or tokens[-1] in ("(", "or", "and", "with")
        if t in ")" or word in PRECEDENCE:
            if operand_next or (t == ")" and not depth):
                break
            tokens.append(word)
            depth -= t == ")"
        elif operand_next and (t == "(" or re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.+:-]*", t)):
            tokens.append(t)
            depth += t == "("
        else:
            break
    while tokens and (tokens[-1] in ("(", "or", "and", "with")):
        depth -= tokens.pop() == "("
    tokens += [")"] * depth
    values: list[frozenset[frozenset[str]]] = []
    stack: list[str] = []

    def apply() -> None:
        op, b, a = stack.pop(), values.pop(), values.pop()
        values.append(a if op == "with" else frozenset(x | y for x in a for y in b) if op == "and" and choices else a | b)

    for t in tokens:
        if t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                apply()
            stack.pop()
        elif t in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[t]:
                apply()
            stack.append(t)
        else:
            labels = frozenset([family(t)])
            values.append(frozenset([labels]) if choices else labels)
    while stack:
        apply()
    return values[0] if values else frozenset()


def scan(text: str) -> dict:
    """The findings of one text; see `scan_licences`."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    joined = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
    starts, base, labels, doubt, tagged = [], set(), set(), 1.0, False
    at = spaces = 0                                          # spaces before `at`, moved from place to place
    for end, phrase in automaton().iter(joined):
        if phrase == TAG:
            tagged = True
        if phrase in BASE:
            to = end - len(phrase)
            spaces += joined.count(" ", at, to) - joined.count(" ", to, at)
            at = to
            starts.append(spaces - 1)
            base.add(BASE[phrase])
            doubt *= 1 - BASE_WEIGHT
        if phrase in NOTICES:
            label, weight = NOTICES[phrase]
            labels.add(label)
            doubt *= 1 - weight
    if tagged:
        for m in TAG_TEXT.finditer(text):
            named = evaluate(m[1], choices=False)
            labels |= named
            doubt *= 1 - TAG_WEIGHT * bool(named)
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": 1 - doubt}


def scan_licences(rows: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """Licences named in each whole text: (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score).

    General: the project's tables hold no notices, so any table with an id and a text will do.
    One Aho-Corasick pass over the lower-cased words finds the base phrases, longer notices and
    identifier tags. The expression behind a tag is parsed by shunting-yard; the labels of all
    its choices count. Base counts and positions come from the base phrases alone. The score is
    one less the product of the doubts that the findings leave: 0 without any, below 1 always.

    Null and empty texts have no words, no labels, null positions and score 0. Repeated rows and
    null ids come out each. Other columns are not read.
    """
    sql, arrow = id_type(rows, id_col)
    types = pa.schema([("i", arrow), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                       ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def find(i, t):
        found = [scan(x or "") for x in t]
        return {"i": i, **{n: [f[n] for f in found] for n in types.names[1:]}}

    d = rows.select(F.col(id_col).cast(sql).alias("i"), F.col(text_col).cast("string").alias("t"))
    schema = f"i {sql}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return map_batches(d, find, schema, types).withColumnRenamed("i", id_col)
