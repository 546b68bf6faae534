"""Operator 13: exact top-k search by block-at-a-time pruning."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint

SCALE, EVERY, TOP = 64, 20, 20
#: Rows of a document range that is one unit of work, and of the blocks inside it.
RANGE_ROWS, BLOCK_ROWS = 8192, 512
#: Ranges whose maxima are one summary row, and tasks that share a summary row or a range.
SUMMARY, SALTS = 512, 8
#: Stands for a null id, behind all others; and for "no score yet".
NO_ID, NO_SCORE = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: Whole numbers up to here are exact in double precision.
EXACT = 1 << 53

_ROW = pa.schema([("range", pa.int64()), ("salt", pa.int32()), ("kind", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()),
                  ("asks", pa.binary()), ("least", pa.binary()), ("home", pa.int64())])
_ROW_SQL = "range bigint, salt int, kind int, dims int, ids binary, vectors binary, asks binary, least binary, home bigint"
_FOUND = pa.schema([("ask", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "ask bigint, query_id bigint, id bigint, score bigint"


def _packed(m: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they need; `_matrix` undoes it."""
    top = np.abs(m).max(initial=0)
    kind = next((k for k, most in (("<i2", 1 << 15), ("<i4", 1 << 31)) if top < most), "<f8")
    return kind.encode() + m.astype(kind).tobytes()


def _matrix(b: bytes, dims: int, n: int) -> np.ndarray:
    return np.frombuffer(b, b[:3].decode(), offset=3).astype(np.float64).reshape(n, dims)


def _longs(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i8").astype(np.int64)


def _row(**given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([given.get(f.name)], f.type) for f in _ROW], schema=_ROW)


def _is_exact(q: np.ndarray, x: np.ndarray) -> bool:
    return np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < EXACT


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit numbers; beyond double precision by Python's integers, cut off at 64 bits."""
    if _is_exact(q, x):
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = whole(q) @ whole(x).T if q.shape[1] else np.zeros((len(q), len(x)), object)
    return np.clip(out, NO_SCORE + 1, -NO_SCORE - 1).astype(np.int64)


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Summed maxima of the terms: no row between low and high scores more. Where doubles are not exact, none is given."""
    if _is_exact(q, low) and _is_exact(q, high):
        return (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T).astype(np.int64)
    return np.full((len(q), len(low)), -NO_SCORE - 1, np.int64)


def search(q: np.ndarray, own: np.ndarray, least: np.ndarray, x: np.ndarray, ids: np.ndarray, top: int,
           block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the rows of a range that may be among each query's best.

    `own` is the query's own row here (or -1), `least` a score that its last one reaches at
    least. Each query goes through the blocks by falling bound until a bound is below its kth
    score; an equal bound may still hold a smaller id.
    """
    starts = np.arange(0, len(x), block_rows)
    bounds = _bounds(q, np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0))
    by = np.argsort(~bounds, axis=1, kind="stable")
    score, row = np.full((len(q), top), NO_SCORE), np.full((len(q), top), -1)
    known = np.append(ids, NO_ID)                          # a free place is behind all
    for k in range(len(starts)):
        block = by[:, k]
        kth = np.maximum(least, score[:, -1])
        going = np.flatnonzero(bounds[np.arange(len(q)), block] >= kth)
        if not len(going):
            break
        for b in np.unique(block[going]).tolist():
            who = going[block[going] == b]
            rows = np.arange(starts[b], min(len(x), starts[b] + block_rows))
            new = _scores(q[who], x[rows])
            new[own[who, None] == rows] = NO_SCORE
            some = (new >= kth[who, None]).any(axis=1)
            who, new = who[some], new[some]
            s = np.hstack([score[who], new])
            r = np.hstack([row[who], np.where(new == NO_SCORE, -1, rows)])
            best = np.lexsort((known[r], ~s), axis=1)[:, :top]
            score[who], row[who] = np.take_along_axis(s, best, 1), np.take_along_axis(r, best, 1)
    at, place = np.nonzero((row >= 0) & (score >= least[:, None]))
    return at, row[at, place], score[at, place]


def _ranges(rows: int) -> object:
    """Rows in order become ranges of rows of one length: ids, vectors, and which of them are queries."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, made = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple]] = {}

        def flush(dims: int) -> pa.RecordBatch:
            nonlocal made
            ids, vectors, asks = zip(*waiting.pop(dims))
            x = np.floor(SCALE * np.array(vectors, np.float64).reshape(len(ids), dims))
            made += 1
            return _row(range=task << 32 | made, salt=0, kind=0, dims=dims, ids=np.array(ids, "<i8").tobytes(), vectors=_packed(x),
                        asks=np.flatnonzero(asks).astype("<i8").tobytes())

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                mine = waiting.setdefault(len(r[1]), [])
                mine.append(r)
                if len(mine) >= rows:
                    yield flush(len(r[1]))
        for dims in list(waiting):
            yield flush(dims)
    return pack


def _at_home(top: int):
    """Each query against its own range: what it found, and the score that its kth place has already."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, asks = _longs(r["ids"]), _longs(r["asks"])
                if not len(asks):
                    continue
                x = _matrix(r["vectors"], r["dims"], len(ids))
                least = np.full(len(asks), NO_SCORE)
                at, _, score = search(x[asks], asks, least, x, ids, top)
                full = np.bincount(at, minlength=len(asks)) >= top
                worst = np.full(len(asks), -NO_SCORE - 1)
                np.minimum.at(worst, at, score)
                yield _row(range=r["range"], salt=0, kind=1, dims=r["dims"], ids=np.stack([r["range"] * RANGE_ROWS + asks, ids[asks]]).astype("<i8").tobytes(),
                           vectors=_packed(x[asks]), asks=r["asks"], least=np.where(full, worst, least).astype("<i8").tobytes(), home=r["range"])
    return run


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest component of each term in a range."""
    for batch in batches:
        for r in batch.to_pylist():
            x = _matrix(r["vectors"], r["dims"], len(r["ids"]) // 8)
            yield _row(range=r["range"], salt=0, kind=0, dims=r["dims"], vectors=np.stack([x.min(axis=0), x.max(axis=0)]).astype("<f8").tobytes())


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries come first (kind 0); then each range's queries go to the ranges whose bound reaches their kth score."""
    key, low, high, targets = None, {}, {}, {}
    for batch in batches:
        for r in batch.to_pylist():
            if (k := (r["block"], r["salt"])) != key:
                key, low, high, targets = k, {}, {}, {}
            dims = r["dims"]
            if r["kind"] == 0:
                lo, hi = np.frombuffer(r["vectors"], "<f8").reshape(2, dims)
                for m, v in ((low, lo), (high, hi), (targets, r["range"])):
                    m.setdefault(dims, []).append(v)
                continue
            if dims not in targets:
                continue
            asks = _longs(r["ids"]).reshape(2, -1)
            q, least = _matrix(r["vectors"], dims, asks.shape[1]), _longs(r["least"])
            may = _bounds(q, np.array(low[dims]), np.array(high[dims])) >= least[:, None]
            for to, m in zip(targets[dims], may.T):
                if to != r["home"] and m.any():
                    yield _row(range=to, salt=r["home"] % SALTS, kind=1, dims=dims, ids=asks[:, m].tobytes(), vectors=_packed(q[m]),
                               least=least[m].astype("<i8").tobytes(), home=r["home"])


def _away(top: int, home: bool):
    """Queries against a range: the range comes first (kind 0), then those who ask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = x = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    ids = _longs(r["ids"])
                    x = _matrix(r["vectors"], r["dims"], len(ids))
                    if not home:
                        continue
                    asks = _longs(r["asks"])
                    who, q, own, least = np.stack([r["range"] * RANGE_ROWS + asks, ids[asks]]), x[asks], asks, np.full(len(asks), NO_SCORE)
                else:
                    who, least = _longs(r["ids"]).reshape(2, -1), _longs(r["least"])
                    q, own = _matrix(r["vectors"], r["dims"], who.shape[1]), np.full(who.shape[1], -1)
                at, row, score = search(q, own, least, x, ids, top)
                found = [who[0][at], who[1][at], ids[row], score]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], schema=_FOUND)
    return run


def top_by_score(rows: DataFrame, id_col: str = "row_id", vec_col: str = "features", every: int = EVERY, top: int = TOP) -> DataFrame:
    """(query_id, rank, id_col, score): for each query its `top` rows of highest inner product, exactly.

    For telemetry windows (or any vectors) that are asked for their nearest windows. A component
    x counts as floor(64 x). Queries are the rows whose id is divisible by `every`; candidates
    all rows but the query's own, ties by the smaller id.

    Rows are ordered by their strongest term, then id, and cut into ranges of 8,192 of one
    length. Each query is first scored in its own range, so its kth score is known early. Ranges
    are summarised by the least and greatest component of each term; a query only travels to
    ranges whose summed term maxima reach its kth score. There it takes blocks of 512 rows in
    order of the same bound and stops where it falls below the kth score. Ranges meet 1 / `every`
    of their size in queries, in rows sorted so that one range is held at a time; nothing is
    broadcast or collected. Vectors without structure prune little: then all ranges are scored,
    in matrix products.

    Vectors that are null, hold null or non-finite components, or leave the finite numbers when
    scaled, take no part. Vectors of other lengths than the query's are no candidates; empty
    vectors score zero. A row with a null id is a candidate behind equal scores and no query
    (2^63 - 1 stands for it, and comes out as null too). Repeated rows and ids are rows of their
    own, also as queries. Scores beyond 64 bits are cut off there. Other columns are not read.
    An empty table, or one without queries, gives no rows.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) * float(SCALE) < float("inf")))
    given = rows.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(NO_ID))).alias("i"), v.alias("v"),
                        F.coalesce(F.col(id_col) % every == 0, F.lit(False)).alias("asks")).filter(fine)
    n = math.ceil(given.count() / RANGE_ROWS)
    strongest = F.array_position("v", F.array_max("v"))
    dealt = given.repartitionByRange(max(1, n), F.size("v"), strongest, "i", F.xxhash64("v"), F.spark_partition_id())
    ranges = checkpoint(dealt.mapInArrow(_ranges(RANGE_ROWS), _ROW_SQL))
    blocks = max(1, math.ceil(ranges.count() / SUMMARY))
    asks = checkpoint(ranges.mapInArrow(_at_home(top), _ROW_SQL))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    block = F.pmod(F.xxhash64("range"), F.lit(blocks)).cast("int").alias("block")
    summaries = ranges.mapInArrow(_summaries, _ROW_SQL).select(block, "*").withColumn("salt", F.explode(salts))
    going = asks.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "*").withColumn("salt", F.pmod(F.xxhash64("range"), F.lit(SALTS)).cast("int"))
    routed = summaries.unionByName(going).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind").mapInArrow(_routed, _ROW_SQL)
    met = ranges.withColumn("salt", F.explode(salts)).unionByName(routed).repartition("range", "salt").sortWithinPartitions("range", "salt", "kind")
    found = met.mapInArrow(_away(top, False), _FOUND_SQL).unionByName(ranges.mapInArrow(_away(top, True), _FOUND_SQL))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= top)
    return best.select("query_id", "rank", F.when(F.col("id") != int(NO_ID), F.col("id")).alias(id_col), "score")
