"""Operator 11: phrase collocation mining with direct-address tiles."""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
#: A phrase goes if a longer one holds it and has this share (in 100) of its places.
INSIDE = 80
#: Tiles on a side of the plane of two ranks that are counted dense.
DENSE = 2
#: Tasks that share a dense tile, and buckets of a frequency when it is ranked.
SALTS = 16
#: Bits of a word's rank in a code; the rank of what precedes it takes the others.
WORD_BITS = 31
#: All signs that part pieces become full stops, which stand alone.
_SIGNS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


class Sizes(NamedTuple):
    """Words (and gaps between pieces) of a pack; ranks on a side of a tile; words for each part of the sparse tiles; cells that wait for their sum in a task."""
    pack: int = 1 << 21
    tile: int = 1024
    part: int = 1 << 22
    waiting: int = 1 << 20


def _squeezed(a: np.ndarray) -> bytes:
    """Numbers from -1 up, shortened; `_spread` undoes it."""
    kind = "<i4" if a.max(initial=0) < 1 << 31 else "<i8"
    raw = a.astype(kind).tobytes()
    return kind.encode() + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _spread(b: bytes | pa.Buffer) -> np.ndarray:
    b = memoryview(b)
    size = int.from_bytes(b[3:11], "little")
    return np.frombuffer(pa.decompress(pa.py_buffer(b[11:]), size, "zstd"), bytes(b[:3]).decode()).astype(np.int64)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[:len(codes)])
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _parts(codes: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The part of each sparse code: a hash of it, after the dense tiles."""
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (DENSE * DENSE + (h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def pack_words(sizes: Sizes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts become packs of numbered words; -1 stands between pieces."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        schema = pa.schema([("pack", pa.int64()), ("grp", pa.string()), ("at", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])
        task, made = TaskContext.get().partitionId(), 0
        waiting: dict[str, list[np.ndarray]] = defaultdict(list)
        numbers: dict[str, dict[bytes, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for g, arrays in waiting.items():
                at = np.concatenate(arrays)
                words = list(numbers[g])
                words.remove(b".")
                counts = np.bincount(at[at >= 0], minlength=len(words))
                yield pa.RecordBatch.from_pydict({"pack": [task << 32 | made], "grp": [g], "at": [_squeezed(at)], "words": [words], "counts": [counts]}, schema=schema)
                made += 1
            waiting.clear()
            numbers.clear()

        size = 0
        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if g not in numbers:
                    d = numbers[g] = defaultdict()
                    d.default_factory = lambda d=d: len(d) - 1          # the gap comes first, so words count from 0
                    d[b"."] = -1
                words = t.lower().translate(_SIGNS).replace(b".", b" . ").split()
                words.append(b".")
                waiting[g].append(np.fromiter(map(numbers[g].__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= sizes.pack:
                    yield from flush()
                    size = 0
        yield from flush()
    return pack


def ranked(df: DataFrame, key: str) -> DataFrame:
    """Add id: 0 for the largest f of a group, ties by a hash bucket and the key.

    Only the distinct frequencies of a group (fewer than the square root of twice its words)
    are one window; rows of one frequency are cut into buckets.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    cells = df.groupBy("grp", "f", "_b").agg(F.count(F.lit(1)).alias("_c"))
    here = Window.partitionBy("grp", "f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("grp").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)
    tops = cells.groupBy("grp", "f").agg(F.sum("_c").alias("_c")).select("grp", "f", F.coalesce(F.sum("_c").over(over), F.lit(0)).alias("_over"))
    cells = cells.select("grp", "f", "_b", F.coalesce(F.sum("_c").over(here), F.lit(0)).alias("_here")).join(tops, ["grp", "f"])
    row = F.row_number().over(Window.partitionBy("grp", "f", "_b").orderBy(key))
    return df.withColumn("_r", row).join(cells, ["grp", "f", "_b"]).withColumn("id", F.col("_over") + F.col("_here") + F.col("_r") - 1) \
        .drop("_b", "_r", "_over", "_here")


def _steps(last: np.ndarray, base: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a frequent phrase is followed by a frequent word, and the code of the two."""
    m = max(0, len(base) - ahead)
    at = np.flatnonzero((last[:m] >= 0) & (base[ahead:] >= 0))
    return at, last[at] << WORD_BITS | base[at + ahead]


def _pair_counts(codes: np.ndarray, parts: int, side: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, sorted codes, counts): dense tiles by bincount, the others as sorted coordinates."""
    left, right = codes >> WORD_BITS, codes & ((1 << WORD_BITS) - 1)
    front = (left < DENSE * side) & (right < DENSE * side)
    a, b = left[front], right[front]
    tile = a // side * DENSE + b // side
    for k in np.unique(tile).tolist():
        here = tile == k
        cells = np.bincount(a[here] % side * side + b[here] % side, minlength=side * side)
        full = np.flatnonzero(cells)
        yield k, (full // side + k // DENSE * side) << WORD_BITS | (full % side + k % DENSE * side), cells[full]
    codes, counts = _summed(codes[~front], np.ones(len(codes) - len(a), np.int64))
    part = _parts(codes, parts)
    order = np.argsort(part, kind="stable")
    part, codes, counts = part[order], codes[order], counts[order]
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[:len(part)]), len(part))
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(part[i]), codes[i:j], counts[i:j]


_SENT = "grp string, part int, salt int, pack bigint, kind int, codes binary, more binary"
_SENT_ARROW = pa.schema([("grp", pa.string()), ("part", pa.int32()), ("salt", pa.int32()), ("pack", pa.int64()), ("kind", pa.int32()),
                         ("codes", pa.binary()), ("more", pa.binary())])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time, binary columns as views of the batch."""
    for i in range(batch.num_rows):
        yield {n: v.as_buffer() if pa.types.is_binary(v.type) and v.is_valid else v.as_py() for n, v in zip(batch.schema.names, (c[i] for c in batch.columns))}


def _gaps(sorted_codes: np.ndarray) -> bytes:
    return np.diff(sorted_codes, prepend=np.int64(0)).astype("<i8").tobytes()


def _codes(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, "<i8"))


def _sender(ahead: int, side: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each pack sends its distinct codes to the parts that own them; tasks share the dense tiles."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                base = _spread(r["base"])
                last = base if ahead == 1 else _spread(r["last"])
                out = [(r["grp"], p, r["pack"] % SALTS if p < DENSE * DENSE else 0, r["pack"], 1, _gaps(c), n.astype("<i8").tobytes())
                       for p, c, n in _pair_counts(_steps(last, base, ahead)[1], r["parts"], side)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SENT_ARROW.types)], schema=_SENT_ARROW)
    return send


def _tally(by: tuple[str, ...], least: int, dense_least: int, sizes: Sizes, numbered: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum what stands together in sorted rows, in bounded memory; only counts from `least` on come out, as rows if `numbered`."""
    side = sizes.tile

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cells, codes, counts, size = None, None, [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            part = key[1]
            if cells is not None:
                full = np.flatnonzero(cells)
                c = (full // side + part // DENSE * side) << WORD_BITS | (full % side + part % DENSE * side)
                n = cells[full]
            else:
                c, n = _summed(np.concatenate(codes), np.concatenate(counts))
            keep = n >= (least if cells is None else dense_least)
            if numbered:
                m = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * m, pa.string()), pa.array(np.full(m, part), pa.int32()), pa.array(c[keep]), pa.array(n[keep])],
                                                 names=["grp", "part", "code", "f"])
            elif keep.any():
                row = (key[0], part, 0, 0, 1, _gaps(c[keep]), n[keep].astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SENT_ARROW.types)], schema=_SENT_ARROW)

        for batch in batches:
            for r in _rows(batch):
                if (k := tuple(r[c] for c in by)) != key:
                    yield from done()
                    key, codes, counts, size = k, [], [], 0
                    cells = np.zeros(side * side, np.int64) if r["part"] < DENSE * DENSE else None
                c, n = _codes(r["codes"]), np.frombuffer(r["more"], "<i8").copy()
                if cells is not None:
                    cells[(c >> WORD_BITS) % side * side + (c & ((1 << WORD_BITS) - 1)) % side] += n
                    continue
                codes.append(c)
                counts.append(n)
                size += len(c)
                if size >= sizes.waiting:
                    c, n = _summed(np.concatenate(codes), np.concatenate(counts))
                    codes, counts, size = [c], [n], len(c) // 2
        yield from done()
    return tally


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part, the ranked codes come first (kind 0), then what the packs sent: (pack, codes, ids) of the ranked ones."""
    schema = pa.schema([("to", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary())])
    key, known, ids = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for r in _rows(batch):
            if (k := (r["grp"], r["part"], r["salt"])) != key:
                key, known, ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
            if r["kind"] == 0:
                known, ids = _codes(r["codes"]), np.frombuffer(r["more"], "<i8").copy()
                continue
            c = _codes(r["codes"])
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, c), len(known) - 1)
            hit = known[at] == c
            if hit.any():
                yield pa.RecordBatch.from_pydict({"to": [r["pack"]], "codes": [_gaps(c[hit])], "ids": [_squeezed(ids[at[hit]])]}, schema=schema)


_PACKED = pa.schema([("pack", pa.int64()), ("grp", pa.string()), ("parts", pa.int32()), ("base", pa.binary()), ("last", pa.binary())])
_PACKED_SQL = "pack bigint, grp string, parts int, base binary, last binary"


def _rank_words(packs: pa.Table, ids: pa.Table) -> pa.Table:
    """A pack's own word numbers become ranks; words that are not frequent become gaps."""
    if not packs.num_rows or not ids.num_rows:
        return _PACKED.empty_table()
    at = _spread(packs["at"][0].as_py())
    rank = np.full(int(at.max(initial=0)) + 2, -1, np.int64)         # the last one is that of the gap, -1
    rank[ids["pos"].to_numpy()] = ids["id"].to_numpy()
    return pa.Table.from_pydict({"pack": packs["pack"], "grp": packs["grp"], "parts": ids["parts"].slice(0, 1),
                                 "base": [_squeezed(rank[at])], "last": [b""]}, schema=_PACKED)


def _rank_phrases(ahead: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def rank(packs: pa.Table, answers: pa.Table) -> pa.Table:
        """The rank of the phrase that starts at each word; packs without a frequent one go."""
        if not packs.num_rows or not answers.num_rows:
            return _PACKED.empty_table()
        r = packs.to_pylist()[0]
        base = _spread(r["base"])
        last = base if ahead == 1 else _spread(r["last"])
        codes = np.concatenate([_codes(b) for b in answers["codes"].to_pylist()])
        ids = np.concatenate([_spread(b) for b in answers["ids"].to_pylist()])
        order = np.argsort(codes)
        codes, ids = codes[order], ids[order]
        at, found = _steps(last, base, ahead)
        k = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
        out = np.full(len(base), -1, np.int64)
        out[at] = np.where(codes[k] == found, ids[k], -1)
        return pa.Table.from_pydict({"pack": [r["pack"]], "grp": [r["grp"]], "parts": [r["parts"]], "base": [r["base"]], "last": [_squeezed(out)]}, schema=_PACKED)
    return rank


def _together(part: pa.Table) -> pa.Table:
    """The ranked codes of a part as one row for each task that asks it."""
    order = np.argsort(part["code"].to_numpy())
    p = part["part"][0].as_py()
    salts = SALTS if p < DENSE * DENSE else 1
    row = {"grp": part["grp"][0].as_py(), "part": p, "pack": -1, "kind": 0, "codes": _gaps(part["code"].to_numpy()[order]),
           "more": part["id"].to_numpy()[order].astype("<i8").tobytes()}
    return pa.Table.from_pydict({f.name: list(range(salts)) if f.name == "salt" else [row[f.name]] * salts for f in _SENT_ARROW}, schema=_SENT_ARROW)


def frequent_phrases(rows: DataFrame, seq_col: str = "sequence", group_col: str = "traffic_type", min_count: int = MIN_COUNT,
                     max_words: int = MAX_WORDS, sizes: Sizes = Sizes()) -> tuple[DataFrame, DataFrame]:
    """(grp, m, phrase, f) of phrases of 1 to max_words words met min_count times or more, and (grp, n)."""
    given = rows.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("grp"),
                        F.coalesce(F.col(seq_col).cast("string").cast("binary"), F.lit(b"")).alias("t"))
    packs = checkpoint(given.mapInArrow(pack_words(sizes), "pack bigint, grp string, at binary, words array<binary>, counts array<bigint>"))
    met = packs.select("pack", "grp", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w"))
    words = checkpoint(met.groupBy("grp", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")))
    total = words.groupBy("grp").agg(F.sum("f").alias("n"))
    words = checkpoint(ranked(words.filter(F.col("f") >= min_count), "word"))
    parts = total.select("grp", F.ceil(F.col("n") / sizes.part).cast("int").alias("parts"))
    ids = met.select("pack", "grp", "pos", F.col("w.words").alias("word")).join(words.select("grp", "word", "id"), ["grp", "word"]) \
        .join(parts, "grp").select(F.col("pack").alias("to"), "pos", "id", "parts")
    packed = checkpoint(packs.select("pack", "grp", "at").groupBy("pack").cogroup(ids.groupBy("to")).applyInArrow(_rank_words, _PACKED_SQL))
    out = words.select("grp", F.lit(1).alias("m"), F.col("word").cast("string").alias("phrase"), "f", "id")
    names = words.select("grp", F.col("id").alias("right"), F.col("word").cast("string").alias("word"))
    levels, before = [out], out
    for m in range(2, max_words + 1):
        sent = packed.mapInArrow(_sender(m - 1, sizes.tile), _SENT)
        dealt = ["grp", "part", "salt"]
        some = sent.repartition(*dealt).sortWithinPartitions(*dealt).mapInArrow(_tally(("grp", "part", "salt"), min_count, 1, sizes), _SENT)
        found = some.repartition("grp", "part").sortWithinPartitions("grp", "part") \
            .mapInArrow(_tally(("grp", "part"), min_count, min_count, sizes, True), "grp string, part int, code bigint, f bigint")
        found = checkpoint(ranked(found, "code"))
        left, right = F.shiftright("code", WORD_BITS), F.col("code").bitwiseAND(F.lit((1 << WORD_BITS) - 1))
        named = found.select("grp", "f", "id", left.alias("left"), right.alias("right")) \
            .join(before.select("grp", F.col("id").alias("left"), "phrase"), ["grp", "left"]).join(names, ["grp", "right"])
        before = checkpoint(named.select("grp", F.lit(m).alias("m"), F.concat_ws(" ", "phrase", "word").alias("phrase"), "f", "id"))
        levels.append(before)
        if m < max_words:
            asked = found.groupBy("grp", "part").applyInArrow(_together, _SENT).unionByName(sent)
            answers = asked.repartition(*dealt).sortWithinPartitions(*dealt, "kind").mapInArrow(_answer, "to bigint, codes binary, ids binary")
            packed = checkpoint(packed.groupBy("pack").cogroup(answers.groupBy("to")).applyInArrow(_rank_phrases(m - 1), _PACKED_SQL))
    phrases = levels[0]
    for df in levels[1:]:
        phrases = phrases.unionByName(df)
    return phrases.drop("id"), total


def _words(first: Column, n: Column) -> Column:
    """So many words of `phrase` from the given one (from 1)."""
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def collocations(rows: DataFrame, seq_col: str = "sequence", group_col: str = "traffic_type", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, top: int = TOP, sizes: Sizes = Sizes()) -> DataFrame:
    """(group_col, rank, phrase, a, l, r, n, score): the phrases of a group that keep together most.

    For record sequences of sessions (words are the fields of records, signs end a record) by
    traffic type, or any text by any group. A-Z is lower-cased; `. , ; : ! ?` and line ends part
    pieces, spaces and tabs part words. n is all words of a group, a the places of a phrase of 2
    to max_words words inside pieces, min_count at least. Of its cuts into two parts, met l and r
    times, the one of smallest floor(2000000 a / (l + r)) counts (the first of equal ones). A
    phrase goes if a longer one of the list holds it and has 80 in 100 of its places or more. The
    first `top` of each group come out, by score, a and the bytes of the phrase.

    Words are numbered by frequency; a phrase and the word behind it are a cell of a plane of two
    ranks. Tiles of the most frequent ranks are counted dense, by bincount; the others as sorted
    coordinates, dealt by a hash of the cell. Cells met often enough are ranked in their turn,
    packs of texts learn these ranks, and the next word is counted against them. Every count is
    summed in each pack first, so a word pair of a third of all places is one number a pack. A
    pack sends its cells to the parts that own them and gets ranks back; nothing is broadcast or
    collected. Packs are written once, with numbers for words. A group has at most 2^31 frequent
    words and 2^32 frequent phrases of a length.

    A null group is `und`, like a group of that name. Null and empty sequences have no words.
    Repeated rows count as often as they come. Other columns are not read. An empty table, and a
    group without a frequent phrase, give no rows.
    """
    phrases, total = frequent_phrases(rows, seq_col, group_col, min_count, max_words, sizes)
    long = phrases.filter("m > 1")
    cut = long.select("grp", "m", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cut = cut.withColumn("_l", _words(F.lit(1), F.col("k"))).withColumn("_r", _words(F.col("k") + 1, F.col("m") - F.col("k")))
    for side in ("l", "r"):
        cut = cut.join(phrases.select("grp", F.col("phrase").alias(f"_{side}"), F.col("f").alias(side)), ["grp", f"_{side}"])
    score = F.expr("CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    best = cut.groupBy("grp", "m", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_c"))
    part = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("m") - n + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, n), " ")))))
    inside = long.filter("m > 2").select("grp", "f", part.alias("phrase")).groupBy("grp", "phrase").agg(F.max("f").alias("_f"))
    kept = best.join(inside, ["grp", "phrase"], "left") \
        .filter(F.expr("_f IS NULL OR CAST(100 AS DECIMAL(3, 0)) * CAST(_f AS DECIMAL(19, 0)) < " + f"CAST({INSIDE} AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(19, 0))"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    kept = kept.select("grp", "phrase", "a", "_c.l", "_c.r", "_c.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("_s"))
    first = kept.withColumn("_n", F.row_number().over(Window.partitionBy("grp", "_s").orderBy(*order))).filter(F.col("_n") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return first.join(total, "grp").select(F.col("grp").alias(group_col), "rank", "phrase", "a", "l", "r", "n", "score")
