"""Joins that are more than an equi join."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as O
from ..functions import scalars as S

MATCH_WINDOW_S = 2.0         # Fixed value: largest time offset of a matched packet.


def attach_group_stat(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """J2. A statistic of each key joined back to its rows (partial aggregate, then a join)."""
    g = df.groupBy(*keys).agg(*[e.alias(n) for n, e in stats.items()])
    return df.join(g, keys)


def nearest_in_time(a: DataFrame, b: DataFrame, keys: list[str], ts: str = "ts", tol: float = MATCH_WINDOW_S,
                    cell_s: float = 60.0) -> DataFrame:
    """J5. For each row of a the offset to the nearest b with an equal key; the earlier b on a tie.

    Rows meet in (key, time cell). A cell without an earlier or later b reads the last or
    first one of its neighbours from a table with one row per (key, cell), so a key that
    holds a third of all rows is as many tasks as it has cells. `dt` is NULL without a
    partner; `matched` is |dt| <= tol.
    """
    cols = a.columns
    da = a.withColumn("_b", F.lit(None).cast("double"))
    db = b.select(*keys, S.dbl(ts).alias("_b"))
    u = da.unionByName(db, allowMissingColumns=True)
    u = u.withColumn("_t", F.coalesce(F.col("_b"), S.dbl(ts))).withColumn("_c", F.floor(F.col("_t") / cell_s))
    isb = F.col("_b").isNotNull().cast("int")
    cells = u.groupBy(*keys, "_c").agg(F.max("_b").alias("_hi"), F.min("_b").alias("_lo"))
    past = (Window.unboundedPreceding, -1)
    up = Window.partitionBy(*keys).orderBy("_c").rowsBetween(*past)
    down = Window.partitionBy(*keys).orderBy(F.col("_c").desc()).rowsBetween(*past)
    cells = cells.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_c").alias("_kc"),
                         F.last("_hi", True).over(up).alias("_before"), F.last("_lo", True).over(down).alias("_after"))
    w = Window.partitionBy(*keys, "_c")
    upto = (Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("_p", F.last("_b", True).over(w.orderBy("_t", isb.desc()).rowsBetween(*upto)))
    u = u.withColumn("_n", F.last("_b", True).over(w.orderBy(F.col("_t").desc(), isb.desc()).rowsBetween(*upto)))
    u = u.filter(F.col("_b").isNull())
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_kc") == F.col("_c"))
    u = u.join(cells, cond)
    back = F.coalesce("_p", "_before") - S.dbl(ts)
    ahead = F.coalesce("_n", "_after") - S.dbl(ts)
    dt = F.when(ahead.isNull() | (F.abs(back) <= F.abs(ahead)), back).otherwise(ahead)
    return u.select(*cols, dt.alias("dt")).withColumn("matched", F.coalesce(F.abs("dt") <= tol, F.lit(False)))


def match_summary(m: DataFrame, by: list[str]) -> DataFrame:
    """A61. Matched share and quantiles of the offset of matched rows."""
    g = m.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("matched")).alias("n_matched"))
    q = O.exact_percentiles(m.filter("matched"), "dt", {"offset_p01": 0.01, "_q1": 0.25, "offset_median": 0.5, "_q3": 0.75, "offset_p99": 0.99}, by)
    return g.join(q, by, "left").select(*by, "n", "n_matched", (F.col("n_matched") / F.col("n")).alias("share"), "offset_median",
                                        (F.col("_q3") - F.col("_q1")).alias("offset_iqr"), "offset_p01", "offset_p99")


def match_sample(m: DataFrame, row_id: str, n: int) -> DataFrame:
    """A61. At most n rows in hash order, for plots of the offsets."""
    from .splits import subsample
    return subsample(m, n, 0, row_id)


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """J9. Distinct keys of each side, those on both, and the shares. One shuffle."""
    u = a.select(*by, *keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*by, *keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    k = u.groupBy(*by, *keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    g = k.groupBy(*by).agg(F.sum("_a").alias("keys_a"), F.sum("_b").alias("keys_b"),
                           F.sum(F.col("_a") * F.col("_b")).alias("shared"))
    one = F.lit(1)
    return g.withColumn("share_of_a", F.col("shared") / F.greatest("keys_a", one)) \
        .withColumn("share_of_b", F.col("shared") / F.greatest("keys_b", one))


def align_by_position(a: DataFrame, b: DataFrame, row_id: str, check: list[str], raise_on_error: bool = True) -> DataFrame:
    """J7. Join by row index. The check columns must agree on every row and no row may be alone."""
    rb = b.select(row_id, *[F.col(c).alias(f"_b_{c}") for c in b.columns if c != row_id])
    j = a.withColumn("_ia", F.lit(1)).join(rb.withColumn("_ib", F.lit(1)), row_id, "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in check],
                  F.col("_ia").isNotNull() & F.col("_ib").isNotNull())
    if raise_on_error:
        bad = j.agg(F.count_if(~same)).first()[0]
        if bad:
            raise ValueError(f"{bad} row(s) do not align")
    out = j.withColumn("aligned", same).drop("_ia", "_ib", *[f"_b_{c}" for c in check])
    return out.withColumnsRenamed({f"_b_{c}": c for c in b.columns if c not in a.columns})


def pair_runs(a: DataFrame, b: DataFrame, stem: str) -> DataFrame:
    """J12. Pair files of two layers by stem; a missing side is a status, not a dropped row."""
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), stem, "full_outer")
    st = F.when(F.col("_a").isNull(), "UNPAIRED_NO_PCAP").when(F.col("_b").isNull(), "UNPAIRED_NO_TELEMETRY") \
        .otherwise("PAIRED")
    return j.withColumn("status", st).drop("_a", "_b")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """J18, U5. Rows of one table that the other lacks, with how many; empty when equal."""
    cols = a.columns
    u = a.withColumn("_d", F.lit(1)).unionByName(b.select(*cols).withColumn("_d", F.lit(-1)))
    return u.groupBy(*cols).agg(F.sum("_d").alias("surplus")).filter(F.col("surplus") != 0)


def assert_counts_equal(a: DataFrame, b: DataFrame, keys: list[str], cells=("tp", "fp", "fn", "tn")) -> None:
    """J18. Totals per key of a re-run equal the original ones."""
    t = [d.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cells]) for d in (a, b)]
    bad = multiset_difference(*t).limit(5).collect()
    if bad:
        raise AssertionError(f"counts differ: {[r.asDict() for r in bad]}")


# --------------------------------------------------------------- frontier
def usable_axes(df: DataFrame, axes: dict[str, int]) -> list[str]:
    """Axes that are present and nowhere NULL."""
    have = [c for c in axes if c in df.columns]
    if not have:
        return []
    r = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in have]).first()
    return [c for c in have if r[c] == 0]


def _undominated(m: np.ndarray, against: np.ndarray) -> np.ndarray:
    keep = np.ones(len(m), bool)
    for i, row in enumerate(m):
        ge = (against >= row).all(axis=1)
        keep[i] = not (ge & (against > row).any(axis=1)).any()
    return keep


#: Cells of the frontier's grid in one key at most, so that pairs of cells stay a small table.
GRID_CELLS = 1024


def non_dominated(df: DataFrame, axes: dict[str, int], keys: list[str] = (), chunk: int = 2_000) -> DataFrame:
    """J17. Rows that no other row of their key beats: >= on all axes and > on one.

    Each task keeps only what is undominated among the rows it has seen; what one of them drops
    is dominated for good. The rows left are laid on a grid of quantiles of each axis. A cell
    that is above another on every axis beats all its rows, so the other goes unread; rows are
    compared only with those of cells that are nowhere below theirs, in chunks on both sides.
    Quantiles, cells and their pairs are tables by key; nothing is collected.
    """
    use = usable_axes(df, axes)
    cols = df.columns
    if not use:
        return df.limit(0)
    kt = F.to_json(F.struct(*keys)) if keys else F.lit("")
    sums = [F.col(c).cast("double") * axes[c] for c in use]
    d = df.select(*cols, kt.alias("_key"), F.array(*sums).alias("_m"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, pd.DataFrame] = {}
        for b in batches:
            for k, g in b.groupby("_key", sort=False):
                both = pd.concat([best[k], g]) if k in best else g
                m = np.stack(both["_m"].to_numpy())
                best[k] = both[_undominated(m, m)]
        for g in best.values():
            yield g

    from ..session import checkpoint
    cand = checkpoint(d.mapInPandas(local, d.schema)).withColumn("_id", F.monotonically_increasing_id())
    side = max(2, int(GRID_CELLS ** (1 / len(use)) + 1e-9))
    cuts = [F.percentile_approx(F.col("_m")[i], [k / side for k in range(1, side)], 1000).alias(f"_e{i}") for i in range(len(use))]

    def place(i: int) -> Column:
        return F.size(F.filter(F.col(f"_e{i}"), lambda e: e < F.col("_m")[i]))

    grid = cand.join(cand.groupBy("_key").agg(*cuts), "_key").withColumn("_cell", F.array(*[place(i) for i in range(len(use))])).drop(*[f"_e{i}" for i in range(len(use))])
    cells = grid.groupBy("_key", "_cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_n"))
    low, high = cells.select("_key", "_cell", "_n"), cells.select("_key", F.col("_cell").alias("_over"), F.col("_n").alias("_m_over"))
    pairs = checkpoint(low.join(high, "_key").filter(F.forall(F.zip_with("_over", "_cell", lambda a, b: a >= b), lambda x: x)))
    beaten = pairs.filter(F.forall(F.zip_with("_over", "_cell", lambda a, b: a > b), lambda x: x)).select("_key", "_cell").distinct()
    pairs = pairs.join(beaten, ["_key", "_cell"], "left_anti").join(beaten.withColumnRenamed("_cell", "_over"), ["_key", "_over"], "left_anti")
    pairs = pairs.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))) \
        .withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_m_over") - 1))).select("_key", "_cell", "_x", "_over", "_y")
    r = checkpoint(grid.join(beaten, ["_key", "_cell"], "left_anti").join(cells, ["_key", "_cell"])
                   .withColumn("_x", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int")).drop("_n"))
    left = r.select("_key", "_cell", "_x", "_m", "_id").join(pairs, ["_key", "_cell", "_x"])
    right = r.select("_key", F.col("_cell").alias("_over"), F.col("_x").alias("_y"), "_m").join(pairs, ["_key", "_over", "_y"])

    def lost(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        keep = _undominated(np.stack(a["_m"].to_numpy()), np.stack(b["_n"].to_numpy())) if len(a) and len(b) else np.ones(len(a), bool)
        return pd.DataFrame({"_id": a["_id"].to_numpy()[~keep]}, dtype="int64")

    by = ["_key", "_cell", "_x", "_over", "_y"]
    right = right.select(F.col("_m").alias("_n"), *[F.col(c).alias(f"{c}2") for c in by])
    worse = left.groupBy(*by).cogroup(right.groupBy(*[f"{c}2" for c in by])).applyInPandas(lost, "_id long")
    return r.join(worse.distinct(), "_id", "left_anti").select(*cols)


def pareto_2d(df: DataFrame, x: str, y: str, keys: list[str], sx: int = 1, sy: int = 1) -> DataFrame:
    """J17 on two axes. Along falling x, a row is efficient if its y beats every y at larger x
    and equals the best y at its own x."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", F.col(x) * sx).withColumn("_y", F.col(y) * sy)
    # the best y at larger x: a running maximum inside buckets of x, and over the buckets before
    pts = O.quantile_buckets(O.cached(d.groupBy(*keys, "_x").agg(F.max("_y").alias("_top"))), "_x")
    past = (Window.unboundedPreceding, -1)
    tops = pts.groupBy(*keys, O.BUCKET).agg(F.max("_top").alias("_bt"))
    tops = tops.withColumn("_before", F.max("_bt").over(Window.partitionBy(*keys).orderBy(F.col(O.BUCKET).desc()).rowsBetween(*past))).drop("_bt")
    inner = Window.partitionBy(*keys, O.BUCKET).orderBy(F.col("_x").desc()).rowsBetween(*past)
    pts = pts.withColumn("_in", F.max("_top").over(inner)).join(tops, [*keys, O.BUCKET])
    pts = pts.withColumn("_better", F.greatest("_in", "_before")).drop("_in", "_before", O.BUCKET)
    j = d.join(pts, [*keys, "_x"])
    eff = (F.col("_y") == F.col("_top")) & (F.col("_better").isNull() | (F.col("_y") > F.col("_better")))
    return j.withColumn("efficient", eff.cast("int")).drop("_x", "_y", "_top", "_better")


def axis_wins(df: DataFrame, axes: dict[str, int], on: str = "model", keys: list[str] = ()) -> DataFrame:
    """A51. The best model on each axis (lowest name on ties), gathered per model."""
    best = [F.max(F.when(F.col(c).isNotNull(), F.struct((F.col(c) * s).alias("v")))).alias(f"_b_{c}") for c, s in axes.items()]
    top = df.groupBy(*keys).agg(*best) if keys else df.agg(*best).withColumn("_one", F.lit(1))
    base = df if keys else df.withColumn("_one", F.lit(1))
    on_k = list(keys) or ["_one"]
    j = base.join(top, on_k)
    long = j.select(*on_k, on, F.explode(F.array(*[
        F.struct(F.lit(c).alias("axis"), (F.col(c) * s == F.col(f"_b_{c}.v")).alias("hit")) for c, s in axes.items()])).alias("x"))
    win = long.filter("x.hit").groupBy(*on_k, F.col("x.axis").alias("axis")).agg(F.min(on).alias(on))
    w = win.groupBy(*on_k, on).agg(F.concat_ws(";", F.array_sort(F.collect_list("axis"))).alias("wins_on"),
                                   F.count(F.lit(1)).alias("n_wins"))
    r = base.select(*on_k, on).distinct().join(w, [*on_k, on], "left")
    return r.select(*keys, on, F.coalesce("wins_on", F.lit("-")).alias("wins_on"), F.coalesce("n_wins", F.lit(0)).alias("n_wins"))


# ------------------------------------------------------- nearest neighbour
def standardise(train: DataFrame, others: list[DataFrame], vec: str, dim: int) -> list[DataFrame]:
    """z-score an array column with the training mean and population sd; sd 0 counts as 1."""
    r = train.agg(*[F.avg(F.col(vec)[i]).alias(f"m{i}") for i in range(dim)],
                  *[F.stddev_pop(F.col(vec)[i]).alias(f"s{i}") for i in range(dim)]).first()
    mu = F.array(*[F.lit(float(r[f"m{i}"])) for i in range(dim)])
    sd = F.array(*[F.lit(float(r[f"s{i}"]) or 1.0) for i in range(dim)])
    z = F.zip_with(F.zip_with(F.col(vec).cast("array<double>"), mu, lambda a, m: a - m), sd, lambda a, s: a / s)
    return [d.withColumn(vec, z) for d in [train, *others]]


PART_BLOCKS = 1024          # blocks whose bounds meet a chunk of queries in one task


def _meet(left: DataFrame, right: DataFrame, on: list[str], rows: int, fn, schema: str) -> DataFrame:
    """Cogroup on `on` with both sides bounded: the left is cut into chunks of about `rows`, the right repeated for each."""
    n = left.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_n"))
    left = left.join(n, on).withColumn("_ck", F.pmod(F.xxhash64("_qid"), F.col("_n")).cast("int")).drop("_n")
    right = right.join(n, on).withColumn("_ck", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return left.groupBy(*on, "_ck").cogroup(right.groupBy(*on, "_ck")).applyInPandas(fn, schema)


def nearest_neighbour(train: DataFrame, query: DataFrame, vec: str, train_id: str, query_id: str, n_pivots: int = 32,
                      block_rows: int = 4096, k: int = 1) -> DataFrame:
    """J16. Exact k nearest neighbours: (query_id, rank, train_id, dist), ties by train id.

    Training rows are cut into blocks of `block_rows`, whatever their number: nearest pivot, then
    rank by distance to it. Of each block the least and greatest distance to every pivot are kept,
    and by the triangle inequality the largest gap between them and the query's own pivot
    distances bounds what the block can hold from below. A query is bounded from above by the k-th
    distance around each pivot, then by its home block; it visits only the blocks under that
    bound. Bounds of cells (pivots squared) go with the tasks; those of blocks stay distributed
    and meet the queries by cell and part. Distances in a block are a matrix product; what lies
    within its rounding of the k-th is computed again exactly. Null vectors take no part.
    """
    from ..session import checkpoint
    types = {**dict(query.dtypes), **dict(train.dtypes)}
    tid, qid = types[train_id], dict(query.dtypes)[query_id]
    t = train.select(F.col(train_id).alias("_tid"), F.col(vec).cast("array<double>").alias("_v")).filter("_v IS NOT NULL")
    q = query.select(F.col(query_id).alias("_qid"), F.col(vec).cast("array<double>").alias("_v")).filter("_v IS NOT NULL")
    top = t.orderBy(S.hash_int(F.lit("pv"), "_tid"), "_tid").limit(n_pivots).select("_v").collect()      # n_pivots rows at most
    if not top:
        return q.select(F.col("_qid").alias(query_id), F.lit(1).alias("rank"), F.lit(None).cast(tid).alias(train_id), F.lit(0.0).alias("dist")).limit(0)
    piv = np.unique(np.array([r[0] for r in top]), axis=0)
    tile = max(1, (1 << 21) // piv.size)

    def dists(v) -> np.ndarray:
        """Distances to the pivots; the same vector gets the same figures in every task."""
        x = np.stack(v.to_numpy())
        return np.concatenate([np.sqrt(((x[i:i + tile, None, :] - piv[None, :, :]) ** 2).sum(-1)) for i in range(0, len(x), tile)])

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = dists(b["_v"])
                yield b.assign(_p=list(d), _cell=d.argmin(1), _d=d.min(1))

    t = O.value_rank(t.mapInPandas(home, f"_tid {tid}, _v array<double>, _p array<double>, _cell long, _d double"),
                     "_d", ["_tid"], ["_cell"], name="_rk", totals=False)
    t = checkpoint(t.withColumn("_blk", F.floor((F.col("_rk") - 1) / block_rows).cast("long")))
    ends = [F.array(*[f(F.col("_p")[i]) for i in range(len(piv))]).alias(n) for n, f in (("_lo", F.min), ("_hi", F.max))]
    cells = t.groupBy("_cell").agg(*ends, F.max(F.when(F.col("_rk") <= k, F.col("_d"))).alias("near"), F.count(F.lit(1)).alias("n"),
                                   F.max("_blk").alias("last")).toPandas()                              # one row a pivot
    cell, last = cells["_cell"].to_numpy(), cells["last"].to_numpy()
    c_lo, c_hi = np.stack(cells["_lo"].to_numpy()), np.stack(cells["_hi"].to_numpy())
    near = np.where(cells["n"] >= k, cells["near"], np.inf)
    blocks = checkpoint(t.groupBy("_cell", "_blk").agg(*ends).withColumn("_part", F.floor(F.col("_blk") / PART_BLOCKS).cast("long")))

    def gaps(d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Queries x boxes: the largest gap over the pivots, one pivot at a time."""
        g = np.zeros((len(d), len(lo)))
        for j in range(d.shape[1]):
            np.maximum(g, np.maximum(lo[:, j] - d[:, j, None], d[:, j, None] - hi[:, j]), out=g)
        return g

    def slack(d: np.ndarray) -> np.ndarray:
        return 1e-9 * (1.0 + d.max(1))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The nearest cell, and a first bound: to a pivot and on to the k-th of its cell."""
        for b in batches:
            if len(b):
                d = dists(b["_v"])
                to = d[:, cell]
                yield b.assign(_cell=cell[to.argmin(1)], _ub=(to + near).min(1) + slack(d))

    def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 4096):
                c = b.iloc[s:s + 4096]
                d = dists(c["_v"])
                i, j = np.nonzero(gaps(d, c_lo, c_hi) <= (c["_ub"].to_numpy() + slack(d))[:, None])
                yield c.iloc[i].assign(_cell=cell[j], _last=last[j])

    def pick(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The home block of each query: the one of least gap in this part of its cell."""
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["_qid", "_gap", "_blk"])
        b = b.sort_values("_blk")
        g = gaps(dists(a["_v"]), np.stack(b["_lo"].to_numpy()), np.stack(b["_hi"].to_numpy()))
        return pd.DataFrame({"_qid": a["_qid"].to_numpy(), "_gap": g.min(1), "_blk": b["_blk"].to_numpy()[g.argmin(1)]})

    def under(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The blocks of this part that may hold something nearer than the bound."""
        out = []
        if len(a) and len(b):
            lo, hi = np.stack(b["_lo"].to_numpy()), np.stack(b["_hi"].to_numpy())
            for s in range(0, len(a), 1024):
                c = a.iloc[s:s + 1024]
                d = dists(c["_v"])
                ok = gaps(d, lo, hi) <= (c["_ub"].to_numpy() + slack(d))[:, None]
                ok &= (c["_hc"].to_numpy() != c["_cell"].to_numpy())[:, None] | (c["_hb"].to_numpy()[:, None] != b["_blk"].to_numpy())
                i, j = np.nonzero(ok)
                out.append(pd.DataFrame({"_qid": c["_qid"].to_numpy()[i], "_v": c["_v"].to_numpy()[i], "_cell": b["_cell"].to_numpy()[j], "_blk": b["_blk"].to_numpy()[j]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["_qid", "_v", "_cell", "_blk"])

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The k nearest rows of one block for each query of a chunk."""
        out = []
        if len(a) and len(b):
            b = b.sort_values("_tid")
            x, ids = np.stack(b["_v"].to_numpy()), b["_tid"].to_numpy()
            xx, kk = (x * x).sum(1), min(k, len(x))
            for s in range(0, len(a), 512):
                y = np.stack(a["_v"].to_numpy()[s:s + 512])
                yy = (y * y).sum(1)
                g = yy[:, None] + xx - 2.0 * (y @ x.T)
                kth = np.take_along_axis(g, np.argpartition(g, kk - 1, axis=1)[:, kk - 1:kk], 1)
                i, j = np.nonzero(g <= kth + 1e-9 * (yy[:, None] + xx.max() + 1e-300))
                e = np.concatenate([np.sqrt(((x[j[m:m + 65536]] - y[i[m:m + 65536]]) ** 2).sum(1)) for m in range(0, len(i), 65536)])
                by = np.lexsort((j, e, i))
                i, j, e = i[by], j[by], e[by]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < kk
                out.append(pd.DataFrame({"_qid": a["_qid"].to_numpy()[s + i[keep]], "_tid": ids[j[keep]], "dist": e[keep]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["_qid", "_tid", "dist"])

    def visit(d: DataFrame) -> DataFrame:
        return _meet(d.select("_qid", "_v", "_cell", "_blk"), t.select("_cell", "_blk", "_tid", "_v"), ["_cell", "_blk"], block_rows, search,
                     f"_qid {qid}, _tid {tid}, dist double")

    def parts_of(d: DataFrame) -> DataFrame:
        return d.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / PART_BLOCKS).cast("long")))).drop("_last")

    of_cell = q.sparkSession.createDataFrame([(int(c), int(n)) for c, n in zip(cell, last)], "_cell long, _last long")
    c1 = checkpoint(q.mapInPandas(start, f"_qid {qid}, _v array<double>, _cell long, _ub double"))
    at = _meet(parts_of(c1.join(of_cell, "_cell")), blocks, ["_cell", "_part"], block_rows, pick, f"_qid {qid}, _gap double, _blk long")
    c1 = checkpoint(c1.join(at.groupBy("_qid").agg(F.min_by("_blk", F.struct("_gap", "_blk")).alias("_blk")), "_qid"))
    h1 = checkpoint(visit(c1))
    kth = h1.groupBy("_qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("_k"))
    c2 = c1.join(kth, "_qid", "left").select("_qid", "_v", F.col("_cell").alias("_hc"), F.col("_blk").alias("_hb"), F.least("_ub", "_k").alias("_ub"))
    c2 = parts_of(c2.mapInPandas(cells_of, f"_qid {qid}, _v array<double>, _hc long, _hb long, _ub double, _cell long, _last long"))
    c2 = checkpoint(_meet(c2, blocks, ["_cell", "_part"], block_rows, under, f"_qid {qid}, _v array<double>, _cell long, _blk long"))
    w = Window.partitionBy("_qid").orderBy("dist", "_tid")
    best = h1.unionByName(visit(c2)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select(F.col("_qid").alias(query_id), "rank", F.col("_tid").alias(train_id), "dist")


def nn_probe(train: DataFrame, test: DataFrame, vec: str, row_id: str, group: str, y: str, dim: int) -> DataFrame:
    """J16 as a leakage probe: share of same-group neighbours, label agreement, 1-NN counts."""
    tr, te = standardise(train, [test], vec, dim)
    tr = tr.select(F.col(row_id).alias("_nn"), F.col(vec), F.col(group).alias("_ng"), F.col(y).alias("_ny"))
    nn = nearest_neighbour(tr, te, vec, "_nn", row_id)
    j = nn.join(te.select(row_id, group, y), row_id).join(tr.drop(vec), "_nn")
    yy, p = F.col(y) == 1, F.col("_ny") == 1
    g = j.agg(F.count(F.lit(1)).alias("n_test"), F.avg((F.col("_ng") == F.col(group)).cast("int")).alias("nn_same_group"),
              F.avg((F.col("_ny") == F.col(y)).cast("int")).alias("nn1_label_agreement"),
              F.count_if(yy & p).alias("tp"), F.count_if(~yy & p).alias("fp"),
              F.count_if(yy & ~p).alias("fn"), F.count_if(~yy & ~p).alias("tn"))
    from .counts import detection_metrics
    return detection_metrics(g).select("n_test", "nn_same_group", "nn1_label_agreement", "tp", "fp", "fn", "tn",
                                       F.col("f1_macro").alias("nn1_f1_macro"))
