"""Operator 12: periodic runs by internal pattern matching."""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type

#: A run has so many words at least, and so many times its period.
LEAST, EXPONENT = 6, 4
#: Words of the sequences that share one suffix array; a longer sequence has its own.
BATCH_WORDS = 1 << 18


def suffixes(w: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array by doubling, and per dyadic length the blocks that occur again.

    A block of 2^k words starts at a multiple of 2^k; it comes with the range of the suffix
    array that its occurrences fill. That range is known as soon as suffixes are in order by
    their first 2^k words, since later rounds only sort inside it. Suffixes that are alone are
    left out of later rounds.
    """
    n = len(w)
    order = np.argsort(w, kind="stable")
    rank, size = np.zeros(n, np.int64), np.ones(n, np.int64)

    def classes(slots: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Rank the suffixes at these slots; True in `fresh` starts a class. The slots that are still shared."""
        first = np.flatnonzero(fresh)
        many = np.diff(np.append(first, len(slots)))
        rank[order[slots]] = np.repeat(slots[first], many)
        size[slots[first]] = many
        return slots[np.repeat(many > 1, many)]

    w = w[order]
    slots = classes(np.arange(n), np.append(True, w[1:] != w[:-1])[:n])
    length, blocks = 1, []
    while len(slots):
        at = order[slots]
        then = np.where(at + length < n, rank[np.minimum(at + length, n - 1)] + 1, 0)
        mine = rank[at]
        by = np.argsort(mine * (n + 1) + then, kind="stable")
        at, mine, then = at[by], mine[by], then[by]
        order[slots] = at
        slots = classes(slots, np.append(True, (mine[1:] != mine[:-1]) | (then[1:] != then[:-1])))
        length *= 2
        s = np.arange(0, max(0, n - length + 1), length)
        s = s[size[rank[s]] > 1]
        if len(s):
            blocks.append((length, s, rank[s], rank[s] + size[rank[s]]))
    return order, blocks


def _levels(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The levels of a wavelet matrix, highest bit first: (bit, zeros before each place)."""
    cur = values.astype(np.int32 if len(values) < 1 << 31 else np.int64)
    for bit in range(max(1, (len(values) - 1).bit_length()) - 1, -1, -1):
        zero = (cur >> bit & 1) == 0
        yield bit, np.append(cur.dtype.type(0), np.cumsum(zero, dtype=cur.dtype))
        cur = np.concatenate([cur[zero], cur[~zero]])


def smaller_in_range(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, than: np.ndarray) -> np.ndarray:
    """How many of values[lo:hi] are smaller than a number; values are a permutation."""
    out = np.zeros(len(lo), np.int64)
    for bit, zeros in _levels(values):
        a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
        one = (than >> bit & 1) == 1
        out[one] += (b - a)[one]
        lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
    return out


def nth_in_range(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The nth smallest (from 0) of values[lo:hi]."""
    out = np.zeros(len(lo), np.int64)
    for bit, zeros in _levels(values):
        a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
        one = nth >= b - a
        nth = np.where(one, nth - (b - a), nth)
        out[one] |= 1 << bit
        lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
    return out


def candidates(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, period, length) of stretches that a block and its neighbouring occurrence span.

    A block is matched in the window of its own length before and behind it; occurrences in a
    window are a progression, whose difference is the distance to the nearest one. In a run of
    period q and 4 q words or more (6 at least), a block of the smallest dyadic length from
    max(2, q) up lies so that it occurs again q words on or back inside the run.
    """
    order, blocks = suffixes(w)
    if not blocks:
        none = np.zeros(0, np.int64)
        return none, none, none
    length = np.concatenate([np.full(len(s), n) for n, s, _, _ in blocks])
    s, lo, hi = (np.concatenate([b[k] for b in blocks]) for k in (1, 2, 3))
    nth = smaller_in_range(order, lo, hi, s)
    back, on = np.flatnonzero(nth > 0), np.flatnonzero(nth + 1 < hi - lo)
    who = np.concatenate([back, on])
    met = nth_in_range(order, lo[who], hi[who], np.concatenate([nth[back] - 1, nth[on] + 1]))
    period = np.abs(met - s[who])
    near = period <= length[who]
    who, met, period = who[near], met[near], period[near]
    return np.minimum(s[who], met), period, length[who] + period


def _equal_on(w: np.ndarray, i: int, p: int) -> int:
    """The first place from i on whose word differs from the one p on."""
    step, end = 32, len(w) - p
    while i < end:
        j = min(end, i + step)
        differ = w[i:j] != w[i + p:j + p]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, step = j, 2 * step
    return end


def _equal_back(w: np.ndarray, i: int, p: int) -> int:
    """The first of the places before i that all equal the word p on."""
    step = 32
    while i > 0:
        j = max(0, i - step)
        differ = w[j:i] != w[j + p:i + p]
        k = int(differ[::-1].argmax())
        if differ[len(differ) - 1 - k]:
            return i - k
        i, step = j, 2 * step
    return 0


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of a sequence of numbers, by start, then period."""
    start, period, length = candidates(w)
    order = np.lexsort((start, period))
    out, last, end = [], 0, 0
    for i, p, n in zip(start[order].tolist(), period[order].tolist(), length[order].tolist()):
        if p == last and i + n <= end:                     # a stretch of two periods is in one run of this period only
            continue
        first, last = _equal_back(w, i, p), p
        end = _equal_on(w, i + n - p, p) + p
        if end - first >= max(LEAST, EXPONENT * p):
            out.append((first, end - first, p))
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def _results(texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Per sequence its runs and the kept words; the sequences share one suffix array, with a mark of its own behind each."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    arrays = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]
    ends = np.cumsum([len(a) + 1 for a in arrays])
    w = np.concatenate([x for k, a in enumerate(arrays) for x in (a, [len(numbers) + k])])
    found = defaultdict(list)
    for first, n, p in runs(w):
        k = int(np.searchsorted(ends, first, "right"))
        found[k].append((first - int(ends[k]) + len(arrays[k]) + 1, n, p))
    for k, words in enumerate(texts):
        if k in found:
            edge = np.zeros(len(words) + 1, np.int64)
            for first, n, p in found[k]:
                edge[first + p] += 1
                edge[first + n] -= 1
            words = [x for x, gone in zip(words, (np.cumsum(edge) > 0).tolist()) if not gone]
        yield found[k], b" ".join(words)


def _strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | tuple[None, None, None]:
    best = (None, None, None)
    for r in found:                                        # by start, then period, so the first of equal ones stays
        if best[0] is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_runs(rows: DataFrame, id_col: str = "row_id", seq_col: str = "sequence") -> DataFrame:
    """(id_col, n_runs, start, length, period, runs, collapsed): the periodic stretches of each sequence.

    For the records of a session as words (beacons, polling and replayed traffic repeat a
    pattern), or any text; words stand between ASCII white space and count from 0. A run is a
    stretch with smallest period q (words q apart are equal), of 6 words and 4 q at least, that
    no neighbouring word extends. start, length and period are of the run with most periods
    (ties: the first, then the shorter period), null without runs; `runs` has all of them by
    start, then period. `collapsed` is the words that no run holds behind its first q words,
    joined by one space.

    Sequences are taken together up to 2^18 words, with a mark of its own behind each, in one
    suffix array; a longer one is alone, with memory in proportion to it. Blocks of 2^k words
    find their occurrences in the neighbouring windows by the wavelet matrix of the suffix array
    (count what is smaller, take the next), which gives candidate periods; each is extended word
    by word as far as it goes. Rows need nothing of each other, so nothing is shuffled.

    Null and empty sequences have no runs and an empty `collapsed`. Repeated rows and ids, and
    null ids, come out each. Other columns are not read. An empty table gives an empty table.
    """
    sql, arrow = id_type(rows, id_col)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("i", arrow), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
                        ("runs", pa.list_(run)), ("collapsed", pa.binary())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            for i, (found, kept) in zip(ids, _results(texts)):
                named = [dict(zip(("start", "length", "period"), r)) for r in found]
                out.append((i, len(found), *_strongest(found), named, kept))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = (t or b"").split()
                if size and size + len(words) > BATCH_WORDS:
                    yield from flush()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(words)
                size += len(words) + 1
        yield from flush()

    given = rows.select(F.col(id_col).cast(sql).alias("i"), F.col(seq_col).cast("string").cast("binary").alias("t"))
    out = given.mapInArrow(find, f"i {sql}, n_runs bigint, start bigint, length bigint, period bigint, "
                                 "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return out.withColumnRenamed("i", id_col).withColumn("collapsed", F.col("collapsed").cast("string"))
