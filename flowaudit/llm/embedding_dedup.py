"""Operator 1: near-duplicate feature vectors by spherical k-means cells and blocked products."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import first_by_hash, id_type
from .components import components
from .simhash import _forest

THRESHOLD = 0.98
#: Bound of the sample that the cells are fitted on: vectors, chosen by their hash.
SAMPLE_ROWS = 20_000
MAX_CELLS, CELL_ROWS, BLOCK_ROWS, TILE = 4096, 1024, 2048, 512


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)             # no overflow of squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centroids; a cell that empties takes the vector farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        cos = x @ c.T
        home = cos.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        empty = np.linalg.norm(sums, axis=1) < 1e-9
        if empty.any():
            far = np.argsort(cos.max(axis=1))[:empty.sum()]
            sums[empty] = np.resize(x[far], (int(empty.sum()), x.shape[1]))
        c = unit(sums)
    return c


def fit_cells(vectors: DataFrame, per_cell: int) -> dict[int, np.ndarray]:
    """Centroids for each length of vectors, from a bounded sample; as many as keep cells near `per_cell` rows a label."""
    n, labels = vectors.agg(F.count(F.lit(1)), F.approx_count_distinct("label")).head()
    sample = first_by_hash(vectors.select(F.xxhash64("node").alias("h"), "v"), "h", SAMPLE_ROWS).select("v").collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    k = min(MAX_CELLS, -(-n // (max(1, labels) * per_cell)))
    return {d: spherical_kmeans(unit(np.array(v)), min(len(v), max(1, round(k * len(v) / len(sample))))) for d, v in by_size.items()}


def _visits(x: np.ndarray, c: np.ndarray, reach: float):
    """Home cells, and (row, cell) of the later cells that may hold a vector within `reach` of the row.

    A vector of cell c lies on c's side of the plane between c and x's home; the plane must not
    be farther from x than `reach`. Of two near vectors the one of the earlier cell visits.
    """
    cos = x @ c.T
    home = cos.argmax(axis=1)
    gap = np.linalg.norm(c[:, None] - c[None], axis=2) if len(c) <= 512 else None
    between = gap[home] if gap is not None else np.sqrt(np.maximum(0, 2 - 2 * (c[home] @ c.T)))
    own = cos[np.arange(len(x)), home][:, None]
    near = (own - cos <= reach * between + 1e-9) & (np.arange(len(c)) > home[:, None])
    return home, np.nonzero(near)


def _compare(x: np.ndarray, visitor: np.ndarray, side: np.ndarray, weight: np.ndarray, threshold: float):
    """Link counts and a forest of the links of a block pair; side 0 meets side 1, or itself if there is no side 1.

    Rows are in the order of their distance to a fixed vector; tiles whose distances are more
    than the reach apart are left out.
    """
    reach = np.sqrt(2 - 2 * threshold) + 1e-9
    far = np.linalg.norm(x - unit(x.sum(axis=0, keepdims=True) + 1e-12), axis=1)
    order = np.argsort(far, kind="stable")
    x, visitor, side, weight, far = x[order], visitor[order], side[order], weight[order], far[order]
    one = not (side == 1).any()
    n, links, a, b = len(x), np.zeros(len(x), np.int64), [np.zeros(0, int)], [np.zeros(0, int)]
    for i in range(0, n, TILE):
        for j in range(i, n, TILE):
            if far[j] - far[min(i + TILE, n) - 1] > reach:
                break
            p, q = np.nonzero(x[i:i + TILE] @ x[j:j + TILE].T >= threshold)
            p, q = p + i, q + j
            ok = (p < q) & ~(visitor[p] & visitor[q]) & (one | (side[p] != side[q]))
            p, q = p[ok], q[ok]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            if len(p):
                p, q = _local_forest(p, q)
                a.append(p)
                b.append(q)
    v, root = _forest(n, np.concatenate(a), np.concatenate(b))
    back = np.empty(n, int)
    back[np.arange(n)] = order
    out = np.zeros(n, np.int64)
    out[order] = links
    return out, back[v], back[root]


def _local_forest(p: np.ndarray, q: np.ndarray):
    nodes, inv = np.unique(np.concatenate([p, q]), return_inverse=True)
    v, root = _forest(len(nodes), inv[:len(p)], inv[len(p):])
    return nodes[v], nodes[root]


def near_duplicate_windows(windows: DataFrame, id_col: str = "row_id", features_col: str = "features",
                           label_col: str = "traffic_type", threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate telemetry windows: (id_col, n_links, component_id, kept), one row per window.

    Feature vectors of windows with the same label link at a cosine of `threshold` or more, in
    double precision. component_id is the smallest id that links reach; the window that has it
    represents the group and is kept.

    Equal vectors of a label are one class with a count, made before anything else is shuffled.
    Spherical k-means, fitted on a bounded sample, gives each class a home cell; a class visits
    those later cells that may hold a vector near enough, so no pair across cells is lost. A
    cell with more than BLOCK_ROWS classes is cut into blocks by hash, and each pair of blocks is
    a group of its own, compared by matrix products. A group returns link counts and as many
    links as connect what it found, never the pairs. Vectors without structure visit most cells,
    and then the work is that of all blocks against all.

    A label that is null, a vector that is null, empty or zero or has a null or non-finite
    component: no links, its own component, kept. Vectors of different length do not link. Repeated
    rows link as equal vectors. A null id counts as a link but is never a component_id; its row
    has the component of the others and is not kept. Other columns are not read.
    """
    v = F.transform(F.col(features_col), lambda x: x.cast("double"))
    rows = windows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    sound = F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) \
        & F.exists("v", lambda x: x != 0)
    sql, _ = id_type(windows, id_col)
    rows = rows.withColumn("id", F.col("id").cast(sql)).withColumn("node", F.when(F.coalesce(sound, F.lit(False)), F.concat(
        F.hex(F.xxhash64("label", "v")), F.hex(F.xxhash64("v", "label", F.lit(1))))))
    classes = checkpoint(rows.filter("node IS NOT NULL").groupBy("node", "label", "v").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first")))
    cells = fit_cells(classes, CELL_ROWS)
    reach = float(np.sqrt(2 - 2 * threshold))
    kind = dict(classes.dtypes)["label"]
    types = {"node": pa.string(), "label": None, "size": pa.int32(), "cell": pa.int32(), "visitor": pa.bool_(), "c": pa.int64(), "v": pa.list_(pa.float64())}

    def place(batches):
        for b in batches:
            sizes = np.diff(b.column("v").offsets.to_numpy()) if len(b) else np.zeros(0, int)
            for d in np.unique(sizes):
                part = b.take(pa.array(np.flatnonzero(sizes == d)))
                flat = part.column("v").flatten()
                x = unit(flat.to_numpy().reshape(-1, d))
                centroids = cells.get(int(d), np.eye(1, int(d)))
                home, (row, cell) = _visits(x, centroids, reach)
                take = np.concatenate([np.arange(len(x)), row])
                got = part.take(pa.array(take))
                yield pa.RecordBatch.from_arrays(
                    [got.column("node"), got.column("label"), pa.array(np.full(len(take), d, np.int32)), pa.array(np.concatenate([home, cell]).astype(np.int32)),
                     pa.array(np.arange(len(take)) >= len(x)), got.column("c"), got.column("v")], names=list(types))

    placed = classes.select("node", "label", "c", "v").mapInArrow(place, f"node string, label {kind}, size int, cell int, visitor boolean, c bigint, v array<double>")
    key = ["label", "size", "cell"]
    blocks = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    d = placed.join(blocks, key).withColumn("s", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    d = d.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select(*key, F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"), (F.col("s") > F.col("t")).alias("side"), "node", "visitor", "c", "v")

    def compare(table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py()
        x = unit(table["v"].combine_chunks().flatten().to_numpy().reshape(-1, size))
        side = table["side"].to_numpy().astype(int)
        n, v, root = _compare(x, table["visitor"].to_numpy(), side, table["c"].to_numpy(), threshold) if table["lo"][0].as_py() == table["hi"][0].as_py() or 0 < side.sum() < len(side) \
            else (np.zeros(len(x), np.int64), np.zeros(0, int), np.zeros(0, int))
        node, some = table["node"].combine_chunks(), np.flatnonzero(n)
        return pa.table({"a": pa.concat_arrays([node.take(pa.array(some)), node.take(pa.array(v))]),
                         "b": pa.concat_arrays([pa.nulls(len(some), pa.string()), node.take(pa.array(root))]),
                         "n": pa.array(np.concatenate([n[some], np.zeros(len(v), np.int64)]))})

    found = checkpoint(d.groupBy(*key, "lo", "hi").applyInArrow(compare, "a string, b string, n bigint"))
    degree = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("near"))
    labels = components(found.filter("b IS NOT NULL").select("a", "b"))
    known = checkpoint(classes.select("node", "c", "first").join(degree, "node", "left").join(labels, "node", "left")
                       .withColumn("label", F.coalesce("label", "node")))
    first = known.groupBy("label").agg(F.min("first").alias("component"))
    known = known.join(first, "label").select("node", (F.col("c") - 1 + F.coalesce("near", F.lit(0))).alias("n"), "component")
    out = rows.select("id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.col("node").isNull()).alias("kept"))
