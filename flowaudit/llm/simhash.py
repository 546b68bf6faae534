"""Operator 7: SimHash near-dedup with pivot distance tables.

`near_duplicate_sequences` links 64-bit fingerprints of three-word shingles at two bits.
`similar_sequences` links sequences whose five-word shingles are similar at 0.8 or more; such
pairs differ in a tenth of the bits and more, so it has fingerprints of 256 bits, and what they
bring together is compared by the shingles themselves.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, ceil, comb, log, log1p, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches
from .components import components

SEED, SHINGLE, MAX_BITS = 42, 3, 2
BLOCKS, BLOCK_BITS = 8, 8
#: Scattered reference fingerprints whose distances sift the candidates.
PIVOTS = np.random.default_rng(7).integers(0, 2**64, 32, dtype=np.uint64)
PAIRS_AT_ONCE = 1 << 20

WIDE_SHINGLE, WIDE_BITS = 5, 256
SIMILARITY = 0.8
#: Wide fingerprints meet in tables of sampled bits: TABLE_BITS at least, and as many as keep about
#: 2^BUCKET_LOG different fingerprints in a bucket; tables enough that pairs at FAR bits are missed once in 100.
TABLE_BITS, BUCKET_LOG, FAR = 12, 6, 50
#: Deviations of the estimate that the candidate radius grants.
DEVIATIONS = 4
#: Blocks of shingle sets that are compared with each other: sequences and shingles at most.
SET_ROWS, SET_SHINGLES = 2048, 1 << 20
#: Buckets of text hashes that sift the texts whose shingles are needed.
SIEVE = 1 << 18
WIDE_PIVOTS = np.random.default_rng(8).integers(0, 2**64, (16, WIDE_BITS // 64), dtype=np.uint64)
#: Buckets with more fingerprints are cut into blocks, and pairs of blocks are compared.
BLOCK_ROWS = 8192


def bits_at(similarity: float, deviations: float = 1) -> int:
    """Differing wide bits that two equally large shingle sets of this Jaccard similarity stay below, some deviations granted."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(WIDE_BITS * share + deviations * sqrt(WIDE_BITS * share * (1 - share)))


def sampled_bits(n: int) -> np.ndarray:
    """One row per table: the bits of a wide fingerprint that it samples, for n different fingerprints."""
    bits = min(30, max(TABLE_BITS, (n - 1).bit_length() - BUCKET_LOG))
    tables = ceil(log(0.01) / log1p(-comb(WIDE_BITS - FAR, bits) / comb(WIDE_BITS, bits)))
    return np.array([np.random.default_rng(70 + t).permutation(WIDE_BITS)[:bits] for t in range(tables)])


def fingerprint(words: list[bytes]) -> int:
    """64 majority bits over the XXH64 (seed 42) of 3-word shingles; 0 without words."""
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((digest(join(s), SEED) for s in zip(words, words[1:], words[2:])), np.uint64, len(words) - 2)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = np.ascontiguousarray(h[i:i + (1 << 14)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def sequence_fingerprints(rows: DataFrame, id_col: str = "row_id", seq_col: str = "sequence") -> DataFrame:
    """(id_col, fp): the signed 64-bit fingerprint of each row's words."""
    sql, arrow = id_type(rows, id_col)

    def prints(i, s):
        return {"i": i, "fp": [int(np.uint64(fingerprint((t or "").encode("utf-8", "surrogatepass").lower().split())).astype(np.int64)) for t in s]}

    d = rows.select(F.col(id_col).cast(sql).alias("i"), F.col(seq_col).cast("string").alias("s"))
    return map_batches(d, prints, f"i {sql}, fp bigint", pa.schema([("i", arrow), ("fp", pa.int64())])).withColumnRenamed("i", id_col)


def shingles(words: list[bytes]) -> set[bytes]:
    """The different 5-word shingles; fewer words are one."""
    return {b" ".join(words[k:k + WIDE_SHINGLE]) for k in range(max(1, len(words) - WIDE_SHINGLE + 1))} if words else set()


def shingle_hashes(grams: set[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of a set of shingles."""
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, grams)), "<u8"))


def wide_fingerprint(grams: set[bytes]) -> bytes:
    """256 majority bits over the hashes of a set of shingles; zero without any."""
    votes, digest, rest = np.zeros(WIDE_BITS, np.int64), xxhash.xxh3_128_digest, list(grams)
    for i in range(0, len(rest), 1 << 13):
        h = np.frombuffer(b"".join([digest(g, half) for g in rest[i:i + (1 << 13)] for half in (1, 2)]), np.uint8).reshape(-1, WIDE_BITS // 8)
        votes += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(votes * 2 > len(rest)).tobytes()


def pivot_distances(fp: np.ndarray, wide: bool = False) -> np.ndarray:
    """One row per fingerprint: its Hamming distances to the reference fingerprints."""
    if wide:
        return np.bitwise_count(fp[..., None, :] ^ WIDE_PIVOTS).sum(axis=-1, dtype=np.int16)
    return np.bitwise_count(fp[..., None] ^ PIVOTS).astype(np.int8)


def _sift(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, radius: int = MAX_BITS, wide: bool = False) -> np.ndarray:
    """Of pairs: the distance to no reference differs by more than the radius, and neither do the fingerprints."""
    near = np.abs(dx - dy).max(axis=-1) <= radius
    apart = np.bitwise_count(x[near] ^ y[near])
    near[near] = (apart.sum(axis=-1, dtype=np.int16) if wide else apart) <= radius
    return near


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what (a, b) connects, n - 1 at most."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            v = np.flatnonzero(label != np.arange(n))
            return v, label[v]


def _bucket_links(members: list[np.ndarray], radius: int = MAX_BITS, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links inside buckets; buckets of one size are handled together, large ones in blocks.

    A wide fingerprint is a row of four words.
    """
    by_size = defaultdict(list)
    for m in members:
        by_size[len(m)].append(m)
    left, right = [], []
    for n, group in by_size.items():
        if n <= (128 if wide else 256):
            i, j = np.triu_indices(n, 1)
            step = max(1, PAIRS_AT_ONCE // 16 // len(i))
            for k in range(0, len(group), step):
                m = np.stack(group[k:k + step])
                d = pivot_distances(m, wide)
                at, pair = np.nonzero(_sift(m[:, i], m[:, j], d[:, i], d[:, j], radius, wide))
                if wide:
                    v, root = _forest(len(m) * n, at * n + i[pair], at * n + j[pair])
                    m = m.reshape(-1, m.shape[-1])
                    left.append(m[v])
                    right.append(m[root])
                    continue
                left.append(m[at, i[pair]])
                right.append(m[at, j[pair]])
            continue
        for m in group:                                     # at most 2^16 fingerprints, or two blocks of wide ones
            d, a, b = pivot_distances(m, wide), [np.zeros(0, int)], [np.zeros(0, int)]
            for i in range(0, n, 256):
                for j in range(i, n, 256):
                    x, y = np.broadcast_arrays(m[i:i + 256, None], m[None, j:j + 256])
                    p, q = np.nonzero(_sift(x, y, d[i:i + 256, None], d[None, j:j + 256], radius, wide))
                    a.append(p + i)
                    b.append(q + j)
                if sum(map(len, a)) > PAIRS_AT_ONCE:
                    a, b = ([v] for v in _forest(n, np.concatenate(a), np.concatenate(b)))
            v, root = _forest(n, np.concatenate(a), np.concatenate(b))
            left.append(m[v])
            right.append(m[root])
    none = [np.zeros((0, WIDE_BITS // 64) if wide else 0, np.uint64)]
    return np.concatenate(left + none), np.concatenate(right + none)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect all within 2 bits of each other.

    The references of a block are the zero word and the single bits of the block: the distances
    to them spell the block. A link changes two bits at most, so six of the eight blocks keep
    all their coordinates; fingerprints meet where the coordinates of six blocks are equal
    (28 choices of six). There, pairs whose distance to any of 32 scattered references differs
    by more than 2 are discarded and the rest is verified. 2^16 fingerprints at most can share
    the coordinates of six blocks, so no bucket grows with the data, and a bucket returns
    no more than it takes to connect it.
    """
    masks = []
    for free in combinations(range(BLOCKS), MAX_BITS):
        mask = sum(((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * k) for k in range(BLOCKS) if k not in free)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keys = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("blocks"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    met = prints.select("fp", F.explode(keys).alias("k")).groupBy("k.blocks", "k.key") \
        .agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, off = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            a, b = _bucket_links([flat[i:j] for i, j in zip(off, off[1:])])
            yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    return met.mapInArrow(links, "a bigint, b bigint").distinct()


def near_duplicate_sequences(rows: DataFrame, id_col: str = "row_id", seq_col: str = "sequence") -> DataFrame:
    """Near-duplicate record sequences: (id_col, fingerprint, component_id).

    A row's sequence is the words of a capture session's records (protocol, service, state and
    history of its flows, say) joined by white space; any text will do. A-Z are lowered, words
    are runs of anything but ASCII white space. Fingerprints link at 2 or fewer differing bits;
    component_id is the smallest id that links reach, the row's own included.

    Null or empty sequences have fingerprint zero and link like any other. Rows with equal
    sequences, repeated ids included, share fingerprint and component, and every row comes out.
    A null id is never a component_id; a component of null ids only has a null one. Columns
    other than the two named are not read. An empty table gives an empty table.
    """
    p = sequence_fingerprints(rows, id_col, seq_col)
    return _classes(p, id_col, fingerprint_links).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(p: DataFrame, id_col: str, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    from ..session import checkpoint

    p = checkpoint(p)                                       # hashes are read four times
    kinds = checkpoint(p.groupBy("fp").agg(F.min(id_col).alias("first")))
    labels = components(link(kinds.select("fp")))
    joined = checkpoint(kinds.join(labels.withColumnRenamed("node", "fp"), "fp"))
    first = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = joined.join(first, "label").select("fp", "component_id")
    known = kinds.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return p.join(known, "fp")


def wide_links(prints: DataFrame, radius: int) -> DataFrame:
    """Distinct wide fingerprints (fp) -> links (a, b) that connect those within `radius` bits of each other.

    Fingerprints meet where all sampled bits of one of the tables are equal: pairs a table's
    sample may miss meet in another (a pair at 39 of 256 bits, similarity 0.8 in the mean, is
    missed by all tables about once in 5,000, one at 50 bits once in 100). Bits and tables follow
    the number of fingerprints, so buckets stay small and no more pairs are missed in a larger
    table. There, pairs whose distances to the references differ by more than the radius are
    discarded and the rest is verified. Buckets above BLOCK_ROWS are cut into blocks by hash and
    each pair of blocks is compared apart; what is broadcast for that is one row per large
    bucket. A comparison returns no more links than it takes to connect what it found.
    """
    sampled = sampled_bits(prints.count())
    tables, weights = len(sampled), (1 << np.arange(sampled.shape[1])).astype(np.int32)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                fps = batch.column(0).slice(at, 512)
                bits = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(len(fps), -1), axis=1)
                keys = bits[:, sampled].astype(np.int32) @ weights
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int16), len(fps))), pa.array(keys.ravel()),
                                                  fps.take(pa.array(np.repeat(np.arange(len(fps)), tables)))], names=["tbl", "key", "fp"])

    met = prints.mapInArrow(meet, "tbl smallint, key int, fp binary")
    large = met.groupBy("tbl", "key").count().filter(F.col("count") > BLOCK_ROWS) \
        .select("tbl", "key", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    d = met.join(F.broadcast(large), ["tbl", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    s = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    d = d.withColumn("s", s).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.groupBy("tbl", "key", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi")) \
        .agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in ((batch, at) for batch in batches for at in range(0, len(batch), 256)):
            lists = [np.frombuffer(b"".join(x), np.uint64).reshape(-1, WIDE_BITS // 64) for x in batch.column(0).slice(at, 256).to_pylist()]
            a, b = _bucket_links(lists, radius, wide=True)
            yield pa.RecordBatch.from_pydict({"a": [x.tobytes() for x in a], "b": [x.tobytes() for x in b]},
                                             schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return d.mapInArrow(links, "a binary, b binary").distinct()


def _set_links(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links that connect the sets of at least this Jaccard similarity; where there are two sides, across them only."""
    sizes = np.array([len(x) for x in sets])
    _, ids, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = seen[ids] > 1                                     # what one set alone holds is in no intersection
    ends = np.concatenate([[0], np.cumsum(met)])[np.concatenate([[0], np.cumsum(sizes)])]
    ids, mark = ids[met], np.zeros(len(seen), bool)
    label, left, right = np.arange(len(sets)), [], []
    two = side.min() != side.max()
    for i in np.flatnonzero(side == side.min()):
        near = (label != label[i]) & (sizes >= sizes[i] * similarity * 0.999) & (sizes[i] >= sizes * similarity * 0.999)
        near &= side != side[i] if two else np.arange(len(sets)) > i
        if not near.any():
            continue
        own = ids[ends[i]:ends[i + 1]]
        mark[own] = True
        both = np.diff(np.concatenate([[0], np.cumsum(mark[ids])])[ends])
        mark[own] = False
        near &= both / np.maximum(1, sizes[i] + sizes - both) >= similarity
        other, at = np.unique(label[near], return_index=True)
        right += np.flatnonzero(near)[at].tolist()
        left += [int(i)] * len(at)
        label[np.isin(label, other)] = label[i]
    return left, right


def similar_sequences(rows: DataFrame, id_col: str = "row_id", seq_col: str = "sequence", similarity: float = SIMILARITY) -> DataFrame:
    """Sequences of like five-word shingles: (id_col, component_id).

    Words are as in `near_duplicate_sequences`; a sequence of fewer than five is one shingle.
    Two sequences link where the Jaccard similarity of their sets of shingles is `similarity` or
    more. component_id is the smallest id that links reach.

    Fingerprints of 256 majority bits find the candidates: those within
    `bits_at(similarity, DEVIATIONS)` bits are connected first, and each set of such a component
    is compared with all others of it by the 64-bit hashes of its shingles, so no link is an
    estimate. Only texts of components of two sets and more are read again, one of each set, and
    large components are cut into blocks by hash; a pair of blocks returns no more links than
    connect what it found. A pair can be missed where its fingerprints met in no table.

    Null and empty sequences are alike. A null id is never a component_id; a component of null
    ids only has a null one. Every row comes out. Other columns are not read. An empty table
    gives an empty table.
    """
    from ..session import checkpoint

    sql, arrow = id_type(rows, id_col)

    def words(t: str | None) -> list[bytes]:
        return (t or "").encode("utf-8", "surrogatepass").lower().split()

    def prints(i, s, m):
        key, fp, size = [], [], []
        for t in s:                                         # the shingles of one text at a time
            grams = shingles(words(t))
            key.append(xxhash.xxh3_128_digest(shingle_hashes(grams).tobytes()))
            fp.append(wide_fingerprint(grams))
            size.append(len(grams))
        return {"i": i, "m": m, "key": key, "fp": fp, "size": size}

    def few(fn: Callable[..., dict[str, list]], types: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (batch.slice(at, 256) for batch in batches for at in range(0, len(batch), 256)):
                yield pa.RecordBatch.from_pydict(fn(*[c.to_pylist() for c in b.columns]), schema=types)
        return run

    def hashed(s, key, label, blocks):
        return {"key": key, "label": label, "blocks": blocks, "hashes": [shingle_hashes(shingles(words(t))).tobytes() for t in s]}

    def compared(group: pa.Table) -> pa.Table:
        key, side = group.column("key").to_pylist(), group.column("s").to_numpy()
        a, b = _set_links([np.frombuffer(x, "<u8") for x in group.column("hashes").to_pylist()], side, similarity)
        return pa.table({"a": [key[i] for i in a], "b": [key[i] for i in b]}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    d = rows.select(F.col(id_col).cast(sql).alias("i"), F.col(seq_col).cast("string").alias("s"))
    d = d.withColumn("m", F.unhex(F.md5(F.coalesce("s", F.lit("")))))
    types = pa.schema([("i", arrow), ("m", pa.binary()), ("key", pa.binary()), ("fp", pa.binary()), ("size", pa.int64())])
    p = checkpoint(d.mapInArrow(few(prints, types), f"i {sql}, m binary, key binary, fp binary, size bigint"))
    kinds = checkpoint(p.groupBy("key").agg(F.min("i").alias("first"), F.min("m").alias("m"), F.min("fp").alias("fp"), F.min("size").alias("size")))
    near = components(wide_links(kinds.select("fp").distinct(), bits_at(similarity, DEVIATIONS)))
    near = checkpoint(kinds.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("key", "m", "size", F.coalesce("label", "fp").alias("label")))
    cuts = F.ceil(F.greatest(F.count(F.lit(1)) / SET_ROWS, F.sum("size") / SET_SHINGLES)).cast("int")
    groups = near.groupBy("label").agg(F.count(F.lit(1)).alias("n"), cuts.alias("blocks")).filter("n > 1").select("label", "blocks")
    near = checkpoint(near.join(groups, "label").select("key", "m", "label", "blocks"))
    sieve = near.select(F.pmod(F.xxhash64("m"), F.lit(SIEVE)).alias("slot")).distinct()      # SIEVE rows at most
    texts = d.select("s", "m", F.pmod(F.xxhash64("m"), F.lit(SIEVE)).alias("slot")).join(F.broadcast(sieve), "slot", "left_semi")
    texts = texts.select("s", "m").dropDuplicates(["m"]).join(near, "m").select("s", "key", "label", "blocks")
    types = pa.schema([("key", pa.binary()), ("label", pa.binary()), ("blocks", pa.int32()), ("hashes", pa.binary())])
    sets = texts.mapInArrow(few(hashed, types), "key binary, label binary, blocks int, hashes binary")
    sets = sets.withColumn("s", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("key", "hashes", "s", "label", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"))
    links = sets.groupBy("label", "lo", "hi").applyInArrow(compared, "a binary, b binary")
    labels = components(links)
    joined = checkpoint(kinds.select("key", "first").join(labels.withColumnRenamed("node", "key"), "key"))
    first = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = joined.join(first, "label").select("key", "component_id")
    known = kinds.join(linked, "key", "left").select("key", F.coalesce("component_id", "first").alias("component_id"))
    return p.join(known, "key").select(F.col("i").alias(id_col), "component_id")
