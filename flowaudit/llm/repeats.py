"""Operator 8: exact substring dedup with fixed-block anchors."""
from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type

WINDOW = 35
#: Every window of 35 words holds one whole block of 18 that starts at a multiple of 18.
CHUNK_BYTES = 2_000_000
#: Bits of a block's hash that are exchanged; chance hits only cost a later exact check.
ANCHOR_BITS = 45
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=64)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each run of n word hashes; the order of the words counts.

    A polynomial in the base: differences of running sums, shifted back to one exponent.
    """
    m = len(words) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, 1 << (len(words) - 1).bit_length())
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return _mix((sums[n:] - sums[:m]) * down[:m])


class Texts:
    """The words of a chunk's texts, hashed, with a gap between texts."""

    def __init__(self, texts: list[str | None]):
        digest = xxhash.xxh3_64_intdigest
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.hashes = [np.fromiter(map(digest, w), np.uint64, len(w)) for w in self.words]

    def blocks(self, n: int) -> list[np.ndarray]:
        return [rolling(h, n, _ODD[0]) >> np.uint64(64 - ANCHOR_BITS) for h in self.hashes]

    def windows(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Two hashes of each window, of 64 and 32 bits."""
        return [(rolling(h, n, _ODD[0]), (rolling(h, n, _ODD[1]) >> np.uint64(32)).astype(np.uint32)) for h in self.hashes]


def _pack(sorted_keys: np.ndarray) -> bytes:
    """The first of sorted keys, and the differences that follow in as few bytes as the largest needs."""
    d = np.diff(sorted_keys)
    width = max(1, (int(d.max(initial=np.uint64(0))).bit_length() + 7) // 8)
    return bytes([width]) + sorted_keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8, offset=9).reshape(-1, b[0])
    full = np.zeros((len(raw) + 1, 8), np.uint8)
    full[0] = np.frombuffer(b, np.uint8, count=8, offset=1)
    full[1:, :b[0]] = raw
    return np.cumsum(full.view("<u8")[:, 0], dtype=np.uint64)


def _deal(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each part's range of sorted keys of so many bits begins, and the end."""
    edges = [math.ceil(k * (1 << bits) / parts) for k in range(parts)]
    return np.append(np.searchsorted(keys, np.array(edges, np.uint64)), len(keys))


def _inside(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys


def _inside_pairs(x: np.ndarray, y: np.ndarray, keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Is (x, y) among the pairs, which are sorted and nearly always differ in the key?"""
    at, found = np.searchsorted(keys, x), np.zeros(len(x), bool)
    while True:
        here = at < len(keys)
        here[here] = keys[at[here]] == x[here]
        if not here.any():
            return found
        found[here] |= more[at[here]] == y[here]
        at += 1


def without_repeats(rows: DataFrame, id_col: str = "row_id", seq_col: str = "sequence", window: int = WINDOW) -> DataFrame:
    """(id_col, n_words, n_removed, kept): each sequence without the words of repeated runs.

    A sequence is the words of a capture's records (or any text) between ASCII white space. A
    word goes if it lies in a run of `window` words that also starts elsewhere, in the same
    sequence or another; runs are judged on the input.

    Blocks of (window + 1) / 2 words at fixed multiples are the index; every rolling block
    probes it. A repeated run holds a whole indexed block wherever it stands, so only runs
    around a block that is indexed and met twice can be repeated. Such hits are extended: the
    runs that hold one are compared whole, by 96 bits, and overlapping ones form the maximal
    repeats. Texts are dealt to chunks of about two megabytes by their id. A chunk sends each of
    its distinct hashes once, sorted, to the part that owns its range, so however often a block
    occurs, a part gets it once a chunk; the part answers which are met again. Nothing is
    paired, and texts are shuffled once.

    Null and empty sequences have no words. Repeated rows and ids are texts of their own, so
    equal rows of `window` words lose all of them. Null ids come out each. Other columns are not
    read. An empty table gives an empty table.
    """
    block = (window + 1) // 2
    sql, arrow = id_type(rows, id_col)
    d = rows.select(F.col(id_col).cast(sql).alias("i"), F.col(seq_col).cast("string").alias("t"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).head()[0]
    n = max(1, math.ceil(size / CHUNK_BYTES))
    d = d.withColumn("chunk", F.pmod(F.xxhash64("i", F.length("t")), F.lit(n)).cast("int"))
    sent = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("often", pa.binary())])
    answer = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())])
    sql_sent, sql_answer = "part int, chunk int, keys binary, more binary, often binary", "chunk int, keys binary, more binary"

    def send(chunk: int, keys: np.ndarray, bits: int, more: np.ndarray, often: np.ndarray) -> pa.Table:
        """keys: sorted and distinct, or by key and `more`; flags as bits, other numbers as they are."""
        at = _deal(keys, bits, n)
        full = np.flatnonzero(np.diff(at))
        cut = [slice(at[p], at[p + 1]) for p in full]
        flat = np.packbits if more.dtype == bool else np.ascontiguousarray
        return pa.Table.from_pydict({"part": full, "chunk": [chunk] * len(full), "keys": [_pack(keys[c]) for c in cut],
                                     "more": [flat(more[c]).tobytes() for c in cut], "often": [np.packbits(often[c]).tobytes() for c in cut]}, schema=sent)

    def gather(table: pa.Table):
        chunks = table["chunk"].to_pylist()
        keys = [_unpack(b) for b in table["keys"].to_pylist()]
        lens = [len(k) for k in keys]
        bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=m) for b, m in zip(table[c].to_pylist(), lens)]).astype(bool)
        return chunks, np.concatenate(keys), lens, bits

    def probe(table: pa.Table) -> pa.Table:
        """A chunk's distinct blocks; more: is one indexed; often: is it met twice here."""
        blocks = Texts(table["t"].to_pylist()).blocks(block)
        flat = np.concatenate(blocks)
        anchor = np.concatenate([np.arange(len(b)) % block == 0 for b in blocks])
        order = np.argsort(flat)
        flat, anchor = flat[order], anchor[order]
        first = np.flatnonzero(np.diff(flat, prepend=~flat[:1])) if len(flat) else np.zeros(0, int)
        counts = np.diff(np.append(first, len(flat)))
        indexed = np.logical_or.reduceat(anchor, first) if len(flat) else np.zeros(0, bool)
        return send(table["chunk"][0].as_py(), flat[first], ANCHOR_BITS, indexed, counts > 1)

    def met(table: pa.Table) -> pa.Table:
        chunks, keys, lens, bits = gather(table)
        _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again, indexed = counts > 1, np.zeros(len(counts), bool)
        again[where[bits("often")]] = True
        indexed[where[bits("more")]] = True
        hit, out = (again & indexed)[where], {"chunk": [], "keys": [], "more": []}
        for c, k, h in zip(chunks, np.split(keys, np.cumsum(lens)[:-1]), np.split(hit, np.cumsum(lens)[:-1])):
            if h.any():
                out["chunk"].append(c)
                out["keys"].append(_pack(k[h]))
                out["more"].append(b"")
        return pa.Table.from_pydict(out, schema=answer)

    def extend(texts: pa.Table, hits: pa.Table) -> pa.Table:
        """The runs of a chunk that hold a hit, by 64 and 32 bits; often: is it met twice here."""
        if not texts.num_rows or not hits.num_rows:
            return sent.empty_table()
        found = np.sort(np.concatenate([_unpack(b) for b in hits["keys"].to_pylist()]))
        t = Texts(texts["t"].to_pylist())
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for h, blocks, (x, y) in zip(t.hashes, t.blocks(block), t.windows(window)):
            if len(x):
                seen = np.concatenate([[0], np.cumsum(_inside(blocks, found))])
                near = seen[window - block + 1:] > seen[:len(seen) - (window - block + 1)]
                a.append(x[near])
                b.append(y[near])
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        if not len(a):
            return sent.empty_table()
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return send(texts["chunk"][0].as_py(), a[first], 64, b[first], np.diff(np.append(first, len(a))) > 1)

    def repeated(table: pa.Table) -> pa.Table:
        chunks, keys, lens, bits = gather(table)
        more = np.concatenate([np.frombuffer(b, np.uint32) for b in table["more"].to_pylist()])
        order = np.lexsort((more, keys))
        k, m = keys[order], more[order]
        same = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
        twice = np.zeros(len(keys), bool)
        twice[order] = np.append(same, False) | np.append(False, same)
        twice |= bits("often")
        cuts, out = np.cumsum(lens)[:-1], {"chunk": [], "keys": [], "more": []}
        for c, k, m, h in zip(chunks, np.split(keys, cuts), np.split(more, cuts), np.split(twice, cuts)):
            if h.any():
                out["chunk"].append(c)
                out["keys"].append(_pack(k[h]))
                out["more"].append(m[h].tobytes())
        return pa.Table.from_pydict(out, schema=answer)

    final = pa.schema([("i", arrow), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
        t = Texts(texts["t"].to_pylist())
        keys = np.concatenate([np.zeros(0, np.uint64), *[_unpack(b) for b in answers["keys"].to_pylist()]])
        more = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(b, np.uint32) for b in answers["more"].to_pylist()]])
        order = np.lexsort((more, keys))
        keys, more = keys[order], more[order]
        out = {"i": texts["i"], "n_words": [], "n_removed": [], "kept": []}
        for words, (x, y) in zip(t.words, t.windows(window)):
            n = len(words)
            gone = np.zeros(n, bool)
            if len(keys) and len(x):
                near = np.flatnonzero(_inside(x, keys))
                near = near[_inside_pairs(x[near], y[near], keys, more)]
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, near, 1)
                np.add.at(edge, near + window, -1)
                gone = np.cumsum(edge)[:n] > 0
            out["n_words"].append(n)
            out["n_removed"].append(int(gone.sum()))
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
            out["kept"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        return pa.Table.from_pydict(out, schema=final)

    asked = d.groupBy("chunk").applyInArrow(probe, sql_sent)
    hits = asked.groupBy("part").applyInArrow(met, sql_answer)
    runs = d.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, sql_sent)
    twice = runs.groupBy("part").applyInArrow(repeated, sql_answer)
    out = d.groupBy("chunk").cogroup(twice.groupBy("chunk")).applyInArrow(cut, f"i {sql}, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("i", id_col)
