"""Decision trees, forests and boosted trees from histograms.

A fit turns its rows into bin numbers once, one byte a value, stored in blocks of rows. A level of its trees
is one pass over the blocks: tasks sum weights and targets by (node, column, bin), the sums meet by chunks of
nodes, and only the chosen splits reach the driver. So a fit holds a byte a value and shuffles histograms,
whatever the number of rows. A table whose bin numbers are few bytes is handed to the tasks whole instead, and each
of them grows whole trees (a fold, or some trees of a forest) by the same rules and draws, without a pass a level.
Parameters come from MLlib's estimators, and the rules are theirs: 32 bins with their cut points, splits by
impurity, boosting on the log loss.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

ESTIMATORS = (DecisionTreeClassifier, RandomForestClassifier, GBTClassifier)
SAMPLE_ROWS = 100_000        # rows that cut points are taken from
BLOCK_ROWS = 1 << 17
TASK_ROWS = 1 << 18          # most rows a task passes over, where there are more than cores have; its blocks go to Python in one batch
CHUNK_NODES = 64             # nodes whose histograms meet in one group
DRIVER_BYTES = 1 << 24       # histograms of all tasks in one pass that meet on the driver and not in a shuffle; bin numbers of a fit by one task
WHOLE_BYTES = 1 << 26        # bin numbers of a table that is handed to several tasks, one for each fold or for some trees
HISTOGRAM_BYTES = 1 << 26    # of one task in one pass; a level with more open nodes takes several
BLOCKS = "part int, nr int, n int, x binary, y binary, w binary, codes binary, m binary, k binary"


@dataclass
class Tree:
    """Nodes from 0. A leaf leads to itself, so a walk needs no end test."""
    feature: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    value: list[float]
    depth: int = 0

    @staticmethod
    def root() -> Tree:
        return Tree([0], [255], [0], [0], [0.0])

    def grow(self, node: int, feature: int, cut: int, left: float, right: float) -> tuple[int, int]:
        a = len(self.value)
        for i, v in ((a, left), (a + 1, right)):
            for name, x in (("feature", 0), ("cut", 255), ("left", i), ("right", i), ("value", v)):
                getattr(self, name).append(x)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, a + 1
        return a, a + 1

    def prune(self) -> Tree:
        """Splits whose two leaves predict the same class become leaves, from below, and what no walk reaches is dropped.

        Shares of one class are made exact. Children have larger numbers than their parents, and those of a level follow each other.
        """
        value = np.array(self.value)
        value[value < 1e-12], value[value > 1 - 1e-12] = 0.0, 1.0
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        me, levels = np.arange(len(value)), [np.zeros(1, np.int64)]
        while len(levels[-1]):
            inner = levels[-1][left[levels[-1]] != levels[-1]]
            levels.append(np.stack([left[inner], right[inner]], 1).reshape(-1))
        for level in reversed(levels):
            i = level[left[level] != level]
            a, b = left[i], right[i]
            i = i[(left[a] == a) & (left[b] == b) & ((value[a] > 0.5) == (value[b] > 0.5))]
            feature[i], cut[i], left[i], right[i] = 0, 255, i, i
        live = np.zeros(len(value), bool)
        for level in levels:
            level = level if not level.any() else level[live[level]]
            live[level] = live[left[level]] = live[right[level]] = True
        to = np.cumsum(live) - 1
        return Tree(feature[live], cut[live], to[left[live]], to[right[live]], value[live], self.depth).packed()

    def packed(self) -> Tree:
        """Nodes as arrays of few bytes."""
        kinds = (("feature", np.uint16), ("cut", np.uint8), ("left", np.int32), ("right", np.int32), ("value", np.float64))
        for name, kind in kinds:
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def arrays(self) -> tuple:
        """Limits are bin numbers."""
        return (np.array(self.feature, np.int64), np.array(self.cut, np.int32), np.array(self.left, np.int32), np.array(self.right, np.int32),
                np.array(self.value), self.depth)


def _walk(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf of every column of `x`, which has a row for each feature."""
    feature, cut, left, right, _, depth = tree
    n = x.shape[1]
    flat, rows, node = x.reshape(-1), np.arange(n), np.zeros(n, np.int32)
    for _ in range(depth):
        node = np.where(flat.take(feature.take(node) * n + rows) <= cut.take(node), left.take(node), right.take(node))
    return node


def cut_points(v: np.ndarray, w: np.ndarray, bins: int = 32) -> np.ndarray:
    """At most bins - 1 limits between values, of about equal weight between them."""
    values, inv = np.unique(v, return_inverse=True)
    mid = (values[:-1] + values[1:]) / 2.0
    if len(mid) < bins:
        return mid
    c = np.bincount(inv, weights=w).tolist()
    stride = sum(c) / bins
    out, upto, target = [], c[0], stride
    for i in range(1, len(c)):
        before, upto = upto, upto + c[i]
        if abs(before - target) < abs(upto - target):
            out.append(mid[i - 1])
            target += stride
    return np.array(out[:bins - 1])


def _matrix(pdf: pd.DataFrame, d: int) -> np.ndarray:
    x = pdf.iloc[:, :d].to_numpy(np.float64)
    if np.isnan(x).any():
        raise ValueError("a feature is NULL or NaN")
    return x


def _blocks(df: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Rows of (features…, y, w, k) as blocks of bin numbers; weights of few values are stored as codes."""
    d = len(cuts)

    def block(nr: int, held: list) -> pd.DataFrame:
        x, y, w, k = (np.concatenate([h[i] for h in held], axis=-1) for i in range(4))
        values, codes = np.unique(w, return_inverse=True)
        few = len(values) <= 256
        return pd.DataFrame([(TaskContext.get().partitionId(), nr, len(y), x.tobytes(), y.tobytes(), (values if few else w).tobytes(),
                              codes.astype(np.uint8).tobytes() if few else b"", b"", k.tobytes())], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    def run(it):
        held, rows, nr = [], 0, 0
        for pdf in it:
            x = _matrix(pdf, d)
            if pdf.iloc[:, d:].isna().any(axis=None):
                raise ValueError("a label or weight is NULL or NaN")
            held.append((np.stack([np.searchsorted(c, x[:, i]).astype(np.uint8) for i, c in enumerate(cuts)]),
                         pdf.iloc[:, d].to_numpy(np.int8), pdf.iloc[:, d + 1].to_numpy(np.float64),
                         pdf.iloc[:, d + 2].to_numpy(np.int8)))
            rows += len(pdf)
            if rows >= BLOCK_ROWS:
                yield block(nr, held)
                held, rows, nr = [], 0, nr + 1
        if rows:
            yield block(nr, held)
    return df.mapInPandas(run, BLOCKS)


def _read(b, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = np.frombuffer(b.w)
    return (np.frombuffer(b.x, np.uint8).reshape(d, b.n), np.frombuffer(b.y, np.int8).astype(np.float64),
            w.take(np.frombuffer(b.codes, np.uint8)) if len(b.codes) else w)


def _bag(w: np.ndarray, g: Growth, t: int, part: int, nr: int) -> np.ndarray:
    """Weights of a block under the draw of rows of a tree."""
    rng = np.random.default_rng([g.seed, g.first + t, part, nr]) if g.bag else None
    return w * rng.poisson(g.rate, len(w)) if g.bag == "poisson" else w * (rng.random(len(w)) < g.rate) if g.bag == "share" else w


def _tried(g: Growth, t: int, nodes: np.ndarray) -> np.ndarray:
    """The columns tried at nodes of a tree, in order: those with the least hash."""
    def mix(z: np.ndarray) -> np.ndarray:
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
    step = np.uint64(0x9E3779B97F4A7C15)
    h = mix(np.full(1, g.seed, np.uint64) + step)
    for x in (np.full(1, g.first + t, np.uint64), np.asarray(nodes, np.uint64)[:, None], np.arange(g.d, dtype=np.uint64)[None]):
        h = mix((h ^ x) + step)
    return np.sort(np.argsort(h, axis=1, kind="stable")[:, :g.features], axis=1)


def _margins(b, fits: int):
    """The margins of a block in each fit; None before the first tree."""
    return np.frombuffer(b.m).reshape(fits, b.n) if len(b.m) else [None] * fits


def _residual(y: np.ndarray, m: np.ndarray | None) -> np.ndarray:
    """The negative gradient of the log loss; the labels themselves before the first tree."""
    s = 2.0 * y - 1.0
    return s if m is None else 4.0 * s / (1.0 + np.exp(2.0 * s * m))


@dataclass
class Growth:
    """What the trees of a pass share."""
    d: int
    bins: int
    max_depth: int
    min_rows: int = 1
    features: int = 0             # columns tried at a node; 0 for all
    seed: int = 0
    bag: str = ""                 # poisson | share
    rate: float = 1.0
    boosted: bool = False
    folds: int = 0                # fits side by side, tree i without the rows of fold i
    first: int = 0                # number of the first tree, which its draws depend on


def _histograms(blocks: DataFrame, g: Growth, trees: list[Tree], todo: list[tuple[int, list[int]]]) -> DataFrame:
    """(tree, first, h): sums of weight, weighted target and rows by (node, column, bin), for each chunk of nodes and task."""
    plan = []
    for t, nodes in todo:
        slot = np.full(len(trees[t].value), -1, np.int64)
        slot[nodes] = np.arange(len(nodes))
        plan.append((t, trees[t].arrays(), slot, len(nodes)))
    kinds = 3 if g.min_rows > 1 else 2

    def run(it):
        acc = [np.zeros((kinds, g.d, k * g.bins)) for _, _, _, k in plan]
        for pdf in it:
            for b in pdf.itertuples():
                x, y, w0 = _read(b, g.d)
                margins, fold = _margins(b, max(g.folds, 1)) if g.boosted else None, np.frombuffer(b.k, np.int8)
                for (t, tree, slot, k), h in zip(plan, acc):
                    w = _bag(w0, g, t, b.part, b.nr)
                    at, target = slot.take(_walk(tree, x)), _residual(y, margins[t]) if g.boosted else y
                    use = (at >= 0) & (w > 0)
                    if g.folds:
                        use &= fold != t
                    xs, ts, some = x, target, at
                    if not use.all():
                        some, w, ts, xs = at[use], w[use], target[use], x[:, use]
                    base, wt = some * g.bins, w * ts
                    even = len(w) > 0 and w[0] == w.min() == w.max()      # counts are quicker than sums of weights
                    for f in range(g.d):
                        i = base + xs[f]
                        h[0, f] += w[0] * np.bincount(i, minlength=k * g.bins) if even else np.bincount(i, weights=w, minlength=k * g.bins)
                        h[1, f] += np.bincount(i, weights=wt, minlength=k * g.bins)
                        if kinds == 3:
                            h[2, f] += np.bincount(i, minlength=k * g.bins)
        for (t, _, _, k), h in zip(plan, acc):
            h = h.reshape(kinds, g.d, k, g.bins)
            for first in range(0, k, CHUNK_NODES):
                yield pd.DataFrame([(t, first, h[:, :, first:first + CHUNK_NODES].tobytes())], columns=["tree", "first", "h"])
    return blocks.mapInPandas(run, "tree int, first int, h binary")


def _best(h: np.ndarray, g: Growth, tried: np.ndarray | None = None) -> tuple:
    """The best split of each node from (kind, column, node, bin): first column, then lowest limit, among equals.

    (won, column, limit, weight, value, value left, value right). `tried` are columns of all, of which others do not count.
    """
    h = np.cumsum(h.transpose(0, 2, 1, 3), axis=3)                           # kind, node, column, bin
    left, total = h[..., :-1], h[..., -1:]
    right = total - left
    ok = (left[0] > 0) & (right[0] > 1e-9 * total[0])
    if len(h) == 3:
        ok &= (left[2] >= g.min_rows) & (right[2] >= g.min_rows)
    if tried is not None:
        use = np.zeros(h.shape[1:3], bool)
        np.put_along_axis(use, tried, True, axis=1)
        ok &= use[..., None]
    with np.errstate(divide="ignore", invalid="ignore"):
        own = total[1] ** 2 / total[0]
        gain = np.where(ok, left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - own, -np.inf).reshape(h.shape[1], -1)
        at = gain.argmax(axis=1)
        i, (f, c) = np.arange(h.shape[1]), np.divmod(at, g.bins - 1)
        w, s = total[0, :, 0, 0], total[1, :, 0, 0]
        won = gain[i, at] > 1e-12 * np.maximum(np.abs(s), w)
        of = lambda a: np.where(won, a[1, i, f, c] / a[0, i, f, c], 0.0)      # noqa: E731
        return won, f, c, w, np.where(w != 0, s / w, 0.0), of(left), of(right)


def _splits(sums: DataFrame, g: Growth, todo: list[tuple[int, list[int]]], tasks: int) -> list:
    """The best split of every node.

    Histograms of `tasks` tasks meet on the driver while all are below `DRIVER_BYTES`, which saves a stage, else in a shuffle.
    """
    open_nodes = dict(todo)
    kinds = 3 if g.min_rows > 1 else 2

    def best(key, pdf):
        t, first = int(key[0]), int(key[1])
        h = sum(np.frombuffer(b).reshape(kinds, g.d, -1, g.bins) for b in pdf["h"])
        nodes = open_nodes[t][first:first + h.shape[2]]
        won, f, c, _, value, lv, rv = _best(h, g, _tried(g, t, nodes) if g.features else None)
        return pd.DataFrame({"tree": t, "node": nodes, "feature": np.where(won, f, -1), "cut": c, "value": value, "lv": lv, "rv": rv})
    if tasks * kinds * g.d * g.bins * 8 * sum(len(nodes) for _, nodes in todo) <= DRIVER_BYTES:
        held = sums.toPandas()
        return [r for key, pdf in held.groupby(["tree", "first"]) for r in best(key, pdf).itertuples()]
    schema = "tree int, node int, feature int, cut int, value double, lv double, rv double"
    return sums.groupBy("tree", "first").applyInPandas(best, schema).collect()


def _grow_here(x: np.ndarray, w: np.ndarray, target: np.ndarray, g: Growth, t: int) -> Tree:
    """`_grow` of one tree over rows held here; `x` has a row for each column, and no row weighs nothing."""
    bins, kinds = g.bins, 3 if g.min_rows > 1 else 2
    even, wt = len(w) > 0 and w.min() == w.max(), w * target
    parts = [[np.array([v], k)] for v, k in ((0, np.uint16), (255, np.uint8), (0, np.int32), (0, np.int32), (0.0, np.float64))]
    size, depth, ids, at = 1, 0, np.zeros(1, np.int64), np.zeros(x.shape[1], np.int64)
    few = 0 < g.features <= g.d // 2                                         # then only tried columns are counted
    for _ in range(g.max_depth):
        k, cols = len(ids), g.features if few else g.d
        tried = _tried(g, t, ids) if g.features else None
        step = max(1, HISTOGRAM_BYTES // (8 * cols * bins * kinds))
        if k > step:
            order = np.argsort(at, kind="stable")
            x, w, wt, at = x[:, order], w[order], wt[order], at[order]
        found, flat, rows = [], x.reshape(-1), np.arange(x.shape[1])
        for a in range(0, k, step):
            m = min(step, k - a)
            lo, hi = (0, len(at)) if k <= step else np.searchsorted(at, [a, a + m])
            mine, ws, wts = at[lo:hi], w[lo:hi], wt[lo:hi]
            base, h = (mine - a) * bins, np.empty((kinds, cols, m * bins))
            for j in range(cols):
                i = base + (flat.take(tried[:, j].take(mine) * len(at) + rows[lo:hi]) if few else x[j, lo:hi])
                n = np.bincount(i, minlength=m * bins) if even or kinds == 3 else None
                h[0, j] = w[0] * n if even else np.bincount(i, weights=ws, minlength=m * bins)
                h[1, j] = np.bincount(i, weights=wts, minlength=m * bins)
                if kinds == 3:
                    h[2, j] = n
            found.append(_best(h.reshape(kinds, cols, m, bins), g, None if few or tried is None else tried[a:a + m]))
        won, f, c, _, value, lv, rv = (np.concatenate(v) for v in zip(*found))
        if size == 1:
            parts[4][0][0] = value[0]
        split = np.flatnonzero(won)
        if not len(split):
            break
        f = tried[np.arange(k), f] if few else f
        depth += 1
        below, v = size + np.arange(2 * len(split)), np.stack([lv[split], rv[split]], 1).reshape(-1)
        for i, (mine, new) in enumerate(zip(parts, (0, 255, below, below, v))):
            mine.append(np.full(len(below), new, mine[0].dtype) if i < 2 else new.astype(mine[0].dtype))
        whole = [np.concatenate(p) for p in parts]
        whole[0][ids[split]], whole[1][ids[split]], whole[2][ids[split]], whole[3][ids[split]] = f[split], c[split], below[::2], below[1::2]
        parts, size = [[p] for p in whole], size + len(below)
        on = np.ones(len(below), bool) if g.boosted else (v >= 1e-12) & (v <= 1 - 1e-12)
        if not on.any():
            break
        nth = np.full(k, -1)
        nth[split] = np.arange(len(split))
        child = 2 * nth.take(at) + (flat.take(f.take(at) * len(at) + rows) > c.take(at))
        to = np.where(on, np.cumsum(on) - 1, -1)
        at = np.where(child >= 0, to.take(np.maximum(child, 0)), -1)
        ids, keep = below[on], at >= 0
        if not keep.all():
            x, w, wt, at = x[:, keep], w[keep], wt[keep], at[keep]
    return Tree(*[p[0] if len(p) == 1 else np.concatenate(p) for p in parts], depth)


def _fit_whole(spark, blocks: list, g: Growth, units: int, rounds: int = 0, step: float = 0.0) -> list[list[Tree]]:
    """The trees of each unit: one tree, or with `rounds` the boosted trees of a fold. Blocks of all rows are sent to the tasks, which share no more."""
    shared = spark.sparkContext.broadcast(sorted(blocks, key=lambda b: (b.part, b.nr)))

    def run(t: int) -> list[Tree]:
        held = shared.value
        x, y, w = (np.concatenate(v, axis=-1) for v in zip(*[_read(b, g.d) for b in held]))
        here = np.ones(len(y), bool)
        if g.folds:
            here = np.concatenate([np.frombuffer(b.k, np.int8) for b in held]) != t
        bagged = lambda: np.concatenate([_bag(_read(b, g.d)[2], g, t, b.part, b.nr) for b in held])      # noqa: E731
        rows = lambda use: (x, slice(None)) if use.all() else (x[:, use], use)                         # noqa: E731
        if not rounds:
            w = bagged() if g.bag else w
            xs, use = rows(here & (w > 0))
            tree = _grow_here(xs, w[use], y[use], g, t)
            return [tree.prune()]
        margin, out = None, []
        xs, _ = rows(here & (w > 0))
        for r in range(rounds):
            g.first = r
            target = _residual(y, margin)
            if g.bag:
                drawn = bagged()
                xr, use = rows(here & (drawn > 0))
                tree = _grow_here(xr, drawn[use], target[use], g, t)
            else:
                use = here & (w > 0)
                tree = _grow_here(xs, w[use], target[use], g, t)
            out.append(tree)
            if r + 1 < rounds:
                own = (step if r else 1.0) * tree.value.take(_walk(tree.arrays(), x))
                margin = own if margin is None else margin + own
        return out
    try:
        return spark.sparkContext.parallelize(range(units), units).map(run).collect()
    finally:
        shared.destroy()


def _grow(blocks: DataFrame, g: Growth, n_trees: int = 1) -> list[Tree]:
    """Trees grown side by side, level by level."""
    trees = [Tree.root() for _ in range(n_trees)]
    level, tasks = [(t, [0]) for t in range(n_trees)], blocks.rdd.getNumPartitions()
    most = max(1, HISTOGRAM_BYTES // (8 * g.d * g.bins * (3 if g.min_rows > 1 else 2)))
    for depth in range(g.max_depth):
        after: dict[int, list[int]] = {}
        flat = [(t, n) for t, nodes in level for n in nodes]
        for i in range(0, len(flat), most):
            part: dict[int, list[int]] = {}
            for t, n in flat[i:i + most]:
                part.setdefault(t, []).append(n)
            todo = list(part.items())
            for r in sorted(_splits(_histograms(blocks, g, trees, todo), g, todo, tasks), key=lambda r: (r.tree, r.node)):
                if r.node == 0:
                    trees[r.tree].value[0] = r.value
                if r.feature < 0:
                    continue
                a, b = trees[r.tree].grow(r.node, r.feature, r.cut, r.lv, r.rv)
                pure = (lambda v: False) if g.boosted else (lambda v: v < 1e-12 or v > 1 - 1e-12)
                after.setdefault(r.tree, []).extend(n for n, v in ((a, r.lv), (b, r.rv)) if not pure(v))
        for t in after:
            trees[t].depth = depth + 1
        level = [(t, nodes) for t, nodes in sorted(after.items()) if nodes]
        if not level:
            break
    return trees


def _boost(blocks: DataFrame, g: Growth, rounds: int, step: float) -> list[list[Tree]]:
    """Trees on the residuals of those before. Margins are kept in the blocks, of which one round's are stored at a time."""
    fits, state = max(g.folds, 1), blocks
    out: list[list[Tree]] = [[] for _ in range(fits)]
    for r in range(rounds):
        g.first = r
        grown = _grow(state, g, fits)
        for mine, tree in zip(out, grown):
            mine.append(tree)
        if r + 1 == rounds:
            break
        last, scale = [t.arrays() for t in grown], step if r else 1.0

        def add(it, last=last, scale=scale):
            for pdf in it:
                ms = []
                for b in pdf.itertuples():
                    x = np.frombuffer(b.x, np.uint8).reshape(g.d, b.n)
                    own = [scale * t[4].take(_walk(t, x)) for t in last]
                    ms.append(b"".join((o if m is None else m + o).tobytes() for m, o in zip(_margins(b, fits), own)))
                yield pdf.assign(m=ms)
        # plans of nested stored tables took seconds to make at each level; a checkpoint is read by a plan of one step
        new = state.mapInPandas(add, BLOCKS).localCheckpoint()
        _free(state if r else None)
        state = new
    _free(state if rounds > 1 else None)
    return out


def _free(df: DataFrame | None) -> None:
    """Drop what a local checkpoint holds; left to the collection of garbage, a copy a round piled up."""
    if df is not None:
        df._jdf.queryExecution().analyzed().rdd().unpersist(False)


class Trees:
    """A fit: P(y = 1) of a row is the mean of its leaves, or the logistic of twice their sum."""

    def __init__(self, trees: list[Tree], cuts: list[np.ndarray], steps: list[float] | None):
        self.trees, self.cuts, self.steps = trees, cuts, steps

    def probability(self, df: DataFrame, cols: list[str]) -> Column:
        cuts, steps, d = self.cuts, self.steps, len(cols)
        shared = df.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf("double")
        def run(*xs: pd.Series) -> pd.Series:
            x = _matrix(pd.concat(xs, axis=1), d)
            x = np.stack([np.searchsorted(c, x[:, i]).astype(np.uint8) for i, c in enumerate(cuts)])
            total = np.zeros(x.shape[1])
            for t, k in zip(shared.value, steps or [1.0 / len(shared.value)] * len(shared.value)):
                a = t.arrays()
                total += k * a[4].take(_walk(a, x))
            return pd.Series(total if steps is None else 1.0 / (1.0 + np.exp(-2.0 * total)))
        return run(*[S.dbl(c) for c in cols])


def fit_folds(est: GBTClassifier, df: DataFrame, cols: list[str], folds: int, label: str, fold: str) -> list[Trees]:
    """One boosted fit for each fold, without its rows. All share the passes and the limits between values, which see no label."""
    return fit(est, df, cols, label, None, folds, fold)


def fit(est, df: DataFrame, cols: list[str], label: str = "label", weight: str | None = "weight", folds: int = 0, fold: str | None = None):
    """Fit one of `ESTIMATORS` on the whole table; labels are 0 and 1."""
    d = len(cols)
    rows = df.select(*[S.dbl(c).alias(f"_x{i}") for i, c in enumerate(cols)], F.col(label).cast("int").alias("_y"),
                     (F.lit(1.0) if weight is None else S.dbl(weight)).alias("_w"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("_k"))
    n, bins = rows.count(), est.getMaxBins()
    seen = (rows if n <= SAMPLE_ROWS else rows.sample(SAMPLE_ROWS / n, seed=est.getSeed() % (1 << 31))).drop("_y", "_k").toPandas()
    x = _matrix(seen, d)
    cuts = [cut_points(x[:, i], seen["_w"].to_numpy(), bins) for i in range(d)]
    g = Growth(d, bins, est.getMaxDepth(), est.getMinInstancesPerNode(), seed=est.getSeed() % (1 << 31))
    g.rate, g.bag = 1.0, ""
    units = 1
    if not isinstance(est, DecisionTreeClassifier):
        g.rate, tried = est.getSubsamplingRate(), est.getFeatureSubsetStrategy()
        if isinstance(est, RandomForestClassifier):
            units = est.getNumTrees()
            tried, g.bag = ("sqrt" if units > 1 else "all") if tried == "auto" else tried, "poisson" if units > 1 else ""
        else:
            g.boosted, g.folds, tried, g.bag = True, folds, "all" if tried == "auto" else tried, "share" if g.rate < 1 else ""
            units = max(folds, 1)
        if tried != "all":
            g.features = math.ceil(math.sqrt(d)) if tried == "sqrt" else min(d, math.ceil(float(tried) * d))
        if g.features == d:
            g.features = 0
    rounds, step = (est.getMaxIter(), est.getStepSize()) if g.boosted else (0, 0.0)
    spark = df.sparkSession
    tasks = max(min(spark.sparkContext.defaultParallelism, math.ceil(n / BLOCK_ROWS)), math.ceil(n / TASK_ROWS))
    blocks = _blocks(rows.coalesce(tasks), cuts)
    if 0 < n * d <= (DRIVER_BYTES if units == 1 else WHOLE_BYTES):
        grown = _fit_whole(spark, blocks.collect(), g, units, rounds, step)
        if g.boosted:
            fits = [Trees(t, cuts, [1.0] + [step] * (rounds - 1)) for t in grown]
            return fits if folds else fits[0]
        return Trees([t for own in grown for t in own], cuts, None)
    blocks = blocks.persist()
    try:
        if g.boosted:
            fits = [Trees(t, cuts, [1.0] + [step] * (rounds - 1)) for t in _boost(blocks, g, rounds, step)]
            return fits if folds else fits[0]
        return Trees([t.prune() for t in _grow(blocks, g, units)], cuts, None)
    finally:
        blocks.unpersist()
