"""Operator 10: best-fit packing of token sequences by matching large items."""
from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import hash_rank
from ..functions.scalars import hash_int
from ..session import checkpoint
from .common import id_type

CAPACITY, END_ID = 2048, 0
#: In texts of these characters both libraries split alike (tests compare each of them).
PLAIN = re.compile("[\x00-ɏ‐-‧€]*")


@lru_cache(maxsize=2)
def _encoders(vocabulary: str):
    """`tokenizers` for the vocabulary file, and a faster equal of it where its ranks lie beside it."""
    import public_tokenizers as files
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(files.path(vocabulary))
    with open(files.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(vocabulary, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    return slow, fast, special


def token_ids(text: str, vocabulary: str) -> list[int]:
    """The ids that `tokenizers` gives without added special tokens.

    Texts of Latin letters go through the same vocabulary in tiktoken, four times as fast, with
    the special strings cut out first as `tokenizers` does; all others go through `tokenizers`.
    """
    slow, fast, special = _encoders(vocabulary)
    if not PLAIN.fullmatch(text):
        return slow.encode(text, add_special_tokens=False).ids
    out: list[int] = []
    for part in re.split("(" + "|".join(map(re.escape, special)) + ")", text) if any(s in text for s in special) else [text]:
        out += [special[part]] if part in special else fast.encode_ordinary(part)
    return out


def pieces(rows: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): each text's ids and the end id, cut where longer than the capacity.

    All pieces of a cut text but the first hold `capacity` ids.
    """
    sql, arrow = id_type(rows, id_col)
    types = pa.schema([("i", arrow), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        for batch in batches:
            out = defaultdict(list)
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(token_ids(text or "", vocabulary) + [END_ID], "<u4")
                ends = list(range(len(ids) % capacity or capacity, len(ids) + 1, capacity))
                for piece, end in enumerate(ends):
                    start = ends[piece - 1] if piece else 0
                    for k, v in (("i", i), ("piece", piece), ("start", start), ("length", end - start), ("ids_crc32", zlib.crc32(ids[start:end].tobytes()))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({n: out[n] for n in types.names}, schema=types)

    d = rows.select(F.col(id_col).cast(sql).alias("i"), F.col(text_col).cast("string").alias("s"))
    return d.mapInArrow(cut, f"i {sql}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("i", id_col)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """How many pieces of each length -> (length, first rank, pieces, first bin, offset).

    Pieces of a length are alike, so whole ranges of them go to ranges of bins at once, and the
    plan's size depends on the capacity, not on the number of pieces. Pieces above a third of the
    capacity are matched first, the longest with the longest partner that fits, two to a bin at
    most. Shorter ones follow, longest first, each into the bin with the smallest gap that holds it.
    """
    left, used, plan, n_bins = dict(counts), defaultdict(int), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)          # gap -> ranges of bins

    def put(length: int, n: int, bins: int, offset: int) -> None:
        plan.append((length, used[length], n, bins, offset))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in counts if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at >= 0 and large[at] == a and left[a] < 2:
            at -= 1
        b = large[at] if at >= 0 else None
        n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        put(a, n, n_bins, 0)
        if b is not None:
            put(b, n, n_bins, a)
        if gap := capacity - a - (b or 0):
            gaps[gap].append((n_bins, n))
        n_bins += n
        for k in {a, b} - {None}:
            if not left[k]:
                large.remove(k)
    open_gaps = sorted(gaps)
    for s in sorted((k for k in counts if 3 * k <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(open_gaps, s)
            if at == len(open_gaps):
                n = -(-left[s] // (capacity // s))                       # new bins, filled with this length
                gaps[capacity].append((n_bins, n))
                n_bins += n
                bisect.insort(open_gaps, capacity)
                at = bisect.bisect_left(open_gaps, s)
            gap = open_gaps[at]
            first, n = gaps[gap].pop()
            take = min(n, left[s])
            put(s, take, first, capacity - gap)
            if n > take:
                gaps[gap].append((first + take, n - take))
            if not gaps[gap]:
                open_gaps.pop(at)
            if gap > s:
                if not gaps[gap - s]:
                    bisect.insort(open_gaps, gap - s)
                gaps[gap - s].append((first, take))
    return plan


def pack(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json",
         capacity: int = CAPACITY) -> DataFrame:
    """Pack texts into sequences of `capacity` tokens: (id_col, piece, start, length, ids_crc32, sequence_id, offset).

    General: the project keeps no texts to train on. A text is its ids and the end id 0; only
    texts longer than the capacity are cut. A histogram of the lengths, at most `capacity`
    numbers, is all that reaches the driver; from it `plan_bins` deals ranges of ranks to ranges
    of sequences. Ranks within a length come from hash buckets, so a length that a third of the
    rows share is many windows. The plan is joined by length and rank.

    A null text is empty: one piece that holds the end id. Repeated rows and ids are packed each;
    rows with a null id too. Other columns are not read. An empty table gives an empty table.
    """
    p = checkpoint(pieces(rows, id_col, text_col, vocabulary, capacity))
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_bins(counts, capacity)
    ranges = p.sparkSession.createDataFrame(plan, "length long, first long, n long, bin long, offset long")
    key = F.concat_ws("|", F.col(id_col).cast("string"), "piece", "start", "ids_crc32")
    ranked = hash_rank(p.withColumn("_key", key), hash_int("_key"), ["_key"], ["length"], name="_rank")
    inside = (F.col("_rank") > F.col("first")) & (F.col("_rank") <= F.col("first") + F.col("n"))
    return ranked.join(F.broadcast(ranges).withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & inside) \
        .select(id_col, "piece", "start", "length", "ids_crc32", (F.col("bin") + F.col("_rank") - F.col("first") - 1).alias("sequence_id"), "offset")
