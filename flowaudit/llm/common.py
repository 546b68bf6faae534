"""Small helpers that several operators share."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all else unchanged."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_batches(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, types: pa.Schema) -> DataFrame:
    """Apply `fn(**columns as lists) -> columns as lists` to each Arrow batch."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(**{n: b.column(i).to_pylist() for i, n in enumerate(names)})
            yield pa.RecordBatch.from_pydict(out, schema=types)

    return df.mapInArrow(run, schema)


def id_type(df: DataFrame, col: str) -> tuple[str, pa.DataType]:
    """SQL and Arrow type of an id column: bigint for whole numbers, else string."""
    kind = dict(df.dtypes)[col]
    return ("bigint", pa.int64()) if kind in ("bigint", "int", "smallint", "tinyint") else ("string", pa.string())


def first_by_hash(df: DataFrame, h: str, n: int) -> DataFrame:
    """The n rows of smallest hash (with ties by all columns), so a sample of fixed size.

    A count comes first: only rows whose hash is under a bound that about n + 5 sqrt(n) + 10 rows
    pass are sorted, so tasks do not send n rows each. Should fewer than n pass, all are sorted.
    """
    total = df.count()
    order = [h, *[c for c in df.columns if c != h]]
    share = (n + 5 * n ** 0.5 + 10) / max(1, total)
    if share < 1:
        near = df.filter(F.col(h) < int(-(1 << 63) + share * (1 << 64)))
        if near.count() >= n:
            df = near
    return df.orderBy(*order).limit(n)
