"""Ranks and running sums over a total order without a one-task window.

A window without a partition key, or with one hot key, sorts everything in one
task. Here the order is cut into buckets that follow it; each bucket is a window
of its own and only the per-bucket totals are accumulated over the whole order.
The buckets come from a hash (uniform by construction) or from quantiles of the
ordering column (balanced whatever its distribution).
"""
from __future__ import annotations

import math
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import hash_int

BUCKET = "_bucket"


def cached(df: DataFrame) -> DataFrame:
    """Keep a reduced table that the following steps read several times.

    Lost blocks are recomputed. `spark.catalog.clearCache()` frees them, or `released` around what needs them.
    """
    df = df.persist()
    if getattr(_held, "tables", None) is not None:
        _held.tables.append(df)
    return df


_held = threading.local()


@contextmanager
def released() -> Iterator[None]:
    """Frees at its end the tables kept inside by `cached`."""
    old, _held.tables = getattr(_held, "tables", None), []
    try:
        yield
    finally:
        for df in _held.tables:
            df.unpersist()
        _held.tables = old


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Count a reduced table and broadcast it where it is small; a larger one is joined as Spark plans it.

    It is kept, as it is read again by the join.
    """
    df = cached(df)
    return F.broadcast(df) if df.count() <= rows else df


def n_buckets(df: DataFrame, per_partition: int = 4) -> int:
    """A few buckets per shuffle partition, so their number follows the cluster."""
    return max(8, per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hash_bucket(h: Column, bits: int = 12) -> Column:
    """Leading bits of a 32-bit hash: equal-sized buckets in hash order."""
    return F.shiftright(h, 32 - bits).cast("int")


def quantile_buckets(df: DataFrame, col: str, n: int | None = None,
                     tie: Column | None = None, of: DataFrame | None = None) -> DataFrame:
    """Add `_bucket`, monotone in (`col`, `tie`), with cut points at its quantiles.

    The driver holds only the cut points. A value that spans several cut points is
    hot: it gets a bucket of its own and, with a 32-bit `tie` hash, is cut again by
    the leading bits of that hash. `of` has the same values and is cheaper to read, where given.
    """
    n = n or n_buckets(df)
    found = (df if of is None else of).approxQuantile(col, [i / n for i in range(1, n)], 0.25 / n)
    cuts = {float(x) for x in found}
    hot = sorted(x for x in cuts if found.count(x) > 1)
    splits = sorted(cuts | {math.nextafter(x, math.inf) for x in hot})
    splits = [-math.inf] + ([x for x in splits if math.isfinite(x)] or [0.0]) + [math.inf]
    b = Bucketizer(splits=splits, inputCol="_qin", outputCol="_qout", handleInvalid="keep")
    out = b.transform(df.withColumn("_qin", F.col(col).cast("double")))
    bucket = F.col("_qout").cast("long") * 4096
    if tie is not None and hot:
        bucket = bucket + F.when(F.col("_qin").isin(hot), F.shiftright(tie, 20)).otherwise(0)
    return out.withColumn(BUCKET, bucket).drop("_qin", "_qout")


def running_sums(df: DataFrame, order: list, sums: dict[str, Column], keys: list[str] = (),
                 bucket: str = BUCKET, totals: bool = False) -> DataFrame:
    """Inclusive running sums of `sums` in (bucket, order) order within `keys`.

    `bucket` must be monotone in `order`. With `totals`, also `<name>_all`, the sum
    over the whole key. The frame per bucket is RANGE-free: ties follow `order`,
    which should be total.
    """
    keys = list(keys)
    inner = (Window.partitionBy(*keys, bucket).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outer = Window.partitionBy(*keys).orderBy(bucket)
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(*keys, bucket).agg(*[F.sum(e).alias(f"_t_{k}") for k, e in sums.items()])
    offs = per.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(bucket).alias("_k_bucket"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
        *([F.sum(f"_t_{k}").over(Window.partitionBy(*keys)).alias(f"{k}_all") for k in sums]
          if totals else []))
    inner_df = df.select("*", *[F.sum(e).over(inner).alias(f"_i_{k}") for k, e in sums.items()])
    cond = F.col("_k_bucket") == F.col(bucket)
    for k in keys:
        cond = cond & F.col(f"_k_{k}").eqNullSafe(F.col(k))
    out = inner_df.join(offs, cond)
    for k in sums:
        out = out.withColumn(k, F.col(f"_i_{k}") + F.col(f"_o_{k}"))
    drop = [f"_i_{k}" for k in sums] + [f"_o_{k}" for k in sums] + [f"_k_{k}" for k in keys]
    return out.drop(*drop, "_k_bucket")


def hash_rank(df: DataFrame, h: Column, tie: list, keys: list[str] = (), name: str = "rank",
              totals: bool = False) -> DataFrame:
    """Row number by (hash, tie) within keys; with `totals`, also `<name>_all` = rows."""
    d = df.withColumn("_h", h).withColumn(BUCKET, hash_bucket(F.col("_h")))
    out = running_sums(d, [F.col("_h"), *[F.col(t) if isinstance(t, str) else t for t in tie]],
                       {name: F.lit(1)}, keys, totals=totals)
    return out.drop("_h", BUCKET)


def value_rank(df: DataFrame, col: str, tie: list[str], keys: list[str] = (),
               name: str = "rank", totals: bool = True) -> DataFrame:
    """Row number by (value, hash of the tie, tie) within keys."""
    d = df.withColumn("_h", hash_int(*tie))
    d = quantile_buckets(d, col, tie=F.col("_h"))
    out = running_sums(d, [F.col(col), F.col("_h"), *tie], {name: F.lit(1)}, keys, totals=totals)
    return out.drop("_h", BUCKET)


def previous(df: DataFrame, order: list, cols: list[str], keys: list[str] = (),
             bucket: str = BUCKET, prefix: str = "_prev_") -> DataFrame:
    """Add `_prev_<c>`, the value of c on the row before in (bucket, order), within keys.

    Inside a bucket this is a lag. The first row of a bucket reads the last row of the
    bucket before it, taken from a table with one row per (key, bucket). `order` holds
    column names and must be total.
    """
    keys = list(keys)
    last = df.groupBy(*keys, bucket).agg(
        F.max(F.struct(*order, *[c for c in cols if c not in order])).alias("_e"))
    wb = Window.partitionBy(*keys).orderBy(bucket)
    ends = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(bucket).alias("_k_bucket"),
                       F.lag("_e").over(wb).alias("_e"))
    w = Window.partitionBy(*keys, bucket).orderBy(*order)
    d = df.withColumn("_first", F.row_number().over(w) == 1)
    for c in cols:
        d = d.withColumn(f"_l_{c}", F.lag(c).over(w))
    cond = F.col("_k_bucket") == F.col(bucket)
    for k in keys:
        cond = cond & F.col(f"_k_{k}").eqNullSafe(F.col(k))
    d = d.join(ends, cond)
    for c in cols:
        d = d.withColumn(f"{prefix}{c}", F.when(F.col("_first"), F.col(f"_e.{c}")).otherwise(F.col(f"_l_{c}")))
    return d.drop("_first", "_e", "_k_bucket", *[f"_l_{c}" for c in cols], *[f"_k_{k}" for k in keys])


def first_n_by_hash(df: DataFrame, h: Column, tie: list[str], limit: Column, keys: list[str] = (),
                    out: str = "picked") -> DataFrame:
    """Flag the `limit` rows of smallest (hash, tie) in each key; `limit` may use `_all`, the row count.

    Only a 4096-way histogram of the hash is shuffled. It says for every key which bucket holds
    the cut; one row a key is broadcast, rows of other buckets are decided by it where they
    are, and the bucket with the cut is ranked.
    """
    keys = list(keys)
    d = df.withColumn("_h", h)
    d = d.withColumn(BUCKET, hash_bucket(F.col("_h")))
    hist = d.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_c"))
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = part.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_all", F.sum("_c").over(part))
    hist = hist.withColumn("_limit", limit.cast("long")).drop("_all")
    # the first bucket that is not wholly taken, and how many rows it gives
    over = F.col("_upto") > F.col("_limit")
    cuts = hist.filter(F.col("_limit").isNotNull()).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.coalesce(F.min(F.when(over, F.col(BUCKET))), F.lit(1 << 12)).alias("_cut"),
        F.max(F.when(over, F.col("_limit") - F.col("_upto") + F.col("_c"))).alias("_need"), F.count(F.lit(1)).alias("_n"))
    cond = F.col("_n") > 0
    for k in keys:
        cond = cond & F.col(f"_k_{k}").eqNullSafe(F.col(k))
    j = d.join(F.broadcast(cuts), cond)
    whole = j.filter(F.col(BUCKET) != F.col("_cut")).withColumn(out, F.col(BUCKET) < F.col("_cut"))
    rn = F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy("_h", *tie))
    ranked = j.filter(F.col(BUCKET) == F.col("_cut")).withColumn(out, rn <= F.col("_need"))
    return whole.unionByName(ranked).drop("_h", BUCKET, "_cut", "_need", "_n", *[f"_k_{k}" for k in keys])


def value_counts(df: DataFrame, col: str, keys: list[str] = (), freq: Column | None = None) -> DataFrame:
    """Distinct values with their count `c`, running count `cum` and total `cum_all` within keys."""
    keys = list(keys)
    n = F.count(F.lit(1)) if freq is None else F.sum(freq)
    v = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("value")).agg(n.alias("c"))
    return running_sums(quantile_buckets(cached(v), "value"), ["value"], {"cum": F.col("c")}, keys, totals=True).drop(BUCKET)


def _counts_near(df: DataFrame, col: str, qs: list[float], freq: Column | None = None) -> DataFrame:
    """`value_counts` of those values only that lie in a bucket with an order statistic of `qs`.

    Two passes over the stored column: the first counts buckets between quantiles, whose running counts
    (one row a bucket, on the driver) say which of them hold a wanted rank. Only their rows are shuffled.
    """
    v = cached(df.filter(F.col(col).isNotNull()).select(F.col(col).alias("value"), (F.lit(1) if freq is None else freq).alias("c")))
    v = quantile_buckets(v, "value")
    per = sorted((r[0], r[1] or 0) for r in v.groupBy(BUCKET).agg(F.sum("c")).collect())
    total = sum(n for _, n in per)
    ranks = {r for q in qs for lo in [math.floor(float(q) * (total - 1)) + 1] for r in (lo, min(lo + 1, total))}
    near, cum = [], 0
    for b, n in per:
        if any(cum < r <= cum + n for r in ranks):
            near.append((b, cum))
        cum += n
    before = F.coalesce(*[F.when(F.col(BUCKET) == b, F.lit(c)) for b, c in near], F.lit(0))
    few = v.filter(F.col(BUCKET).isin([b for b, _ in near])).groupBy(BUCKET, "value").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy(BUCKET).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return few.withColumn("cum", F.sum("c").over(upto) + before).withColumn("cum_all", F.lit(total)).drop(BUCKET)


def exact_percentiles(df: DataFrame, col: str, qs: dict[str, float], keys: list[str] = (), freq: Column | None = None) -> DataFrame:
    """Percentiles with linear interpolation, one column per entry of `qs`.

    The built-in exact percentile holds every distinct value of a group in one aggregation
    buffer; here the two order statistics are read from running counts of the values. Without
    keys only the buckets that hold them are counted by value.
    """
    keys = list(keys)
    h = value_counts(df, col, keys, freq) if keys else _counts_near(df, col, list(qs.values()), freq)
    aggs, out = [F.max("cum_all").alias("_n")], []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("cum_all") - 1)
        lo = F.floor(pos) + 1
        for end, r in (("a", lo), ("b", F.least(lo + 1, F.col("cum_all")))):
            aggs.append(F.min(F.when(F.col("cum") >= r, F.col("value"))).alias(f"_{end}_{name}"))
        p = F.lit(float(q)) * (F.col("_n") - 1)
        out.append((F.col(f"_a_{name}") + (p - F.floor(p)) * (F.col(f"_b_{name}") - F.col(f"_a_{name}"))).alias(name))
    return h.groupBy(*keys).agg(*aggs).select(*keys, *out)


def quantile_grid(df: DataFrame, col: str, n: int, keys: list[str] = ()) -> DataFrame:
    """(keys, i, q): n evenly spaced percentiles with linear interpolation, i from 0.

    A value that fills the ranks before..cum - 1 finds by arithmetic which steps need it, so
    the only rows after the running counts are two for each step.
    """
    keys, steps = list(keys), n - 1
    h = value_counts(df, col, keys).withColumn("_last", F.col("cum_all") - 1).withColumn("_from", F.col("cum") - F.col("c"))

    def reached(rank: str) -> str:                          # the first step whose position is at that rank or later
        return f"if(_last = 0, 0, ({rank}) * {steps} div _last + if(({rank}) * {steps} % _last > 0, 1, 0))"

    def steps_of(first: str, after: str) -> Column:
        first, end = reached(first), f"if(cum = cum_all, {steps}, {reached(after)} - 1)"
        return F.expr(f"if({first} <= {end}, sequence(cast({first} AS bigint), cast({end} AS bigint)), null)")

    ends = F.array(F.struct(F.lit("lo").alias("end"), steps_of("_from", "cum").alias("at")),
                   F.struct(F.lit("hi").alias("end"), steps_of("greatest(_from - 1, 0)", "cum - 1").alias("at")))
    d = h.select(*keys, "value", "_last", F.explode(ends).alias("e")).select(*keys, "value", "_last", "e.end", F.explode("e.at").alias("i"))
    q = d.groupBy(*keys, "i", "_last").agg(*[F.max(F.when(F.col("end") == e, F.col("value"))).alias(f"_{e}") for e in ("lo", "hi")])
    share = (F.col("i") * F.col("_last") % steps) / F.lit(float(steps))
    return q.select(*keys, "i", (F.col("_lo") + share * (F.col("_hi") - F.col("_lo"))).alias("q"))


def value_ranks(df: DataFrame, col: str, keys: list[str] = ()) -> DataFrame:
    """(keys, value, rank, dense): tie-averaged and dense rank of every distinct value."""
    keys = list(keys)
    v = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    r = running_sums(quantile_buckets(cached(v), "value"), ["value"], {"cum": F.col("c"), "dense": F.lit(1)}, keys)
    return r.select(*keys, "value", (F.col("cum") - (F.col("c") - 1) / 2.0).alias("rank"), "dense")
