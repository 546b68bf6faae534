"""Multilayer perceptrons in matrix products.

MLlib's network spends most of its time in small products without a native library. Here a fit stores its scaled
rows once, in blocks; an evaluation is one pass in which tasks multiply blocks and return one sum of losses and
gradients each. Start, steps and end are MLlib's: its first weights of a seed, its L-BFGS with strong Wolfe steps,
its tolerance. The loss is MLlib's too, the mean over blocks of 128 rows of their means, so the rows of the last, smaller
block of a partition weigh more.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

BLOCK_ROWS = 1 << 14
CHUNK_ROWS = 1 << 11         # rows of one product, whose results stay in a core's cache
CORRECTIONS, KEPT_VALUES = 10, 20


class _Stuck(ArithmeticError):
    """No step satisfies the conditions."""


def _layers(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, offsets) of each layer; MLlib keeps matrices by column, then offsets."""
    out, at = [], 0
    for n, m in zip(sizes, sizes[1:]):
        out.append((weights[at:at + n * m].reshape(n, m), weights[at + n * m:at + n * m + m]))
        at += n * m + m
    return out


def loss_and_gradient(weights: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums over rows: cross entropy, then its gradient. Sigmoid layers, softmax at the end."""
    layers, total = _layers(weights, sizes), np.zeros(len(weights) + 1)
    grads = _layers(total[1:], sizes)
    for a in range(0, len(y), CHUNK_ROWS):
        outs, yy, t = [x[a:a + CHUNK_ROWS]], y[a:a + CHUNK_ROWS], times[a:a + CHUNK_ROWS]
        for i, (w, b) in enumerate(layers):
            z = outs[-1] @ w + b
            if i + 1 < len(layers):
                with np.errstate(over="ignore"):
                    z = 1.0 / (1.0 + np.exp(-z))
            else:
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
            outs.append(z)
        rows, p = np.arange(len(yy)), outs[-1]
        with np.errstate(divide="ignore"):
            total[0] -= t @ np.log(p[rows, yy])
        delta = p.copy()
        delta[rows, yy] -= 1.0
        delta *= t[:, None]
        for i in range(len(layers) - 1, -1, -1):
            grads[i][0][...] += outs[i].T @ delta
            grads[i][1][...] += delta.sum(axis=0)
            if i:
                delta = (delta @ layers[i][0].T) * outs[i] * (1.0 - outs[i])
    return total


def _step_length(phi: Callable[[float], tuple[float, float]], first: float) -> float:
    """A step that satisfies the strong Wolfe conditions, by Breeze's search: (t, value, slope) are its brackets."""
    c1, c2, most = 1e-4, 0.9, 10
    at = lambda t: (t, *phi(t))                                           # noqa: E731
    low = at(0.0)
    _, value, slope = low
    if slope > 0:
        raise _Stuck("the direction does not descend")

    def between(a: tuple, b: tuple) -> float:
        d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
        d2 = np.sqrt(d1 * d1 - a[2] * b[2])
        t = b[0] - (b[0] - a[0]) * (b[2] + d2 - d1) / (b[2] - a[2] + 2 * d2)
        lo, hi = a[0] + 0.1 * (b[0] - a[0]), a[0] + 0.9 * (b[0] - a[0])
        return lo if t < lo else hi if t > hi else float(t)

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(most):
            c = at(between(high, low) if low[0] > high[0] else between(low, high))
            if c[1] > value + c1 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= c2 * abs(slope):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Stuck("no step in the bracket")

    t = first
    for i in range(most):
        c = at(t)
        if not np.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > value + c1 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _Stuck("no step in the range")


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Breeze's L-BFGS, as MLlib calls it; a point is evaluated once."""
    last: list = [None, None]

    def cached(p: np.ndarray) -> tuple[float, np.ndarray]:
        if last[0] is None or not np.array_equal(last[0], p):
            last[:] = p.copy(), f(p)
        return last[1]

    value, grad = cached(x)
    first, steps, deltas, seen, failed = value, [], [], [np.inf], False
    for i in range(max_iter):
        if np.linalg.norm(grad) <= max(tol * value, 1e-8) or (len(seen) >= 2 and abs(value - max(seen)) <= tol * first):
            break
        try:
            d, a = grad.copy(), []
            with np.errstate(all="ignore"):
                for s, g in zip(steps, deltas):
                    a.append(s @ d / (s @ g))
                    d -= a[-1] * g
                if steps:
                    sy = steps[0] @ deltas[0]
                    if sy < 0 or not np.isfinite(sy) or np.isnan(a).any():
                        raise _Stuck("the history does not curve")
                    d *= sy / (deltas[0] @ deltas[0])
                for s, g, k in reversed([*zip(steps, deltas, a)]):
                    d += (k - g @ d / (s @ g)) * s
            d = -d

            def phi(t: float, d=d, x=x) -> tuple[float, float]:
                v, g = cached(x + t * d)
                return v, float(g @ d)
            t = _step_length(phi, 1.0 / np.linalg.norm(d) if i == 0 else 1.0)
            if t * np.linalg.norm(grad) < 1e-10:
                raise _Stuck("the step is too small")
        except _Stuck:
            if failed:
                break
            failed, steps, deltas = True, [], []           # once more from the gradient alone
            continue
        new = x + t * d
        v, g = cached(new)
        steps, deltas = [new - x, *steps][:CORRECTIONS], [g - grad, *deltas][:CORRECTIONS]
        x, value, grad, failed = new, v, g, False
        seen = [*seen, value][-KEPT_VALUES:]
    return x


def _blocks(df: DataFrame, d: int, stacked: int) -> DataFrame:
    """Rows of (features…, label, repeats) as blocks of numbers. A row weighs the share that its repeats have in MLlib's blocks."""
    def block(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([(np.ascontiguousarray(x).tobytes(), y.astype(np.int8).tobytes(), w.tobytes())], columns=["x", "y", "w"])

    def run(it):
        held = np.zeros((0, d + 2))                          # the last rows of the partition so far, not yet in a whole block
        for pdf in it:
            for a in range(0, len(pdf), BLOCK_ROWS):
                v = np.concatenate([held, pdf.iloc[a:a + BLOCK_ROWS].to_numpy(np.float64)])
                if np.isnan(v).any():
                    raise ValueError("a feature, label or weight is NULL or NaN")
                upto = np.cumsum(v[:, d + 1])
                whole = upto[-1] // stacked * stacked
                taken = np.clip(whole - upto + v[:, d + 1], 0.0, v[:, d + 1])
                use = taken > 0
                if use.any():
                    yield block(v[use, :d], v[use, d], taken[use] / stacked)
                held = v[taken < v[:, d + 1]]
                held[:, d + 1] -= taken[taken < v[:, d + 1]]
        if len(held):
            yield block(held[:, :d], held[:, d], held[:, d + 1] / held[:, d + 1].sum())
    return df.mapInPandas(run, "x binary, y binary, w binary")


def fit(est: MultilayerPerceptronClassifier, rows: DataFrame, means: np.ndarray, factors: np.ndarray) -> MultilayerPerceptronClassificationModel:
    """Fit `est` on rows of (features…, label, repeats); a feature less its mean times its factor goes in."""
    spark, sizes, d = rows.sparkSession, list(est.getLayers()), len(means)
    few = spark.createDataFrame([(y, Vectors.dense([y] * d)) for y in (0.0, 1.0)], ["label", "features"])
    still = est.copy({est.maxIter: 0})                       # a fit without a step: first weights in, a model of MLlib out
    start = est.getInitialWeights() if est.isSet(est.initialWeights) else still.fit(few).weights
    blocks = _blocks(rows, d, est.getBlockSize()).persist()
    try:
        sc = spark.sparkContext

        def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
            shared = sc.broadcast(weights)

            def run(it):
                out, n = np.zeros(len(shared.value) + 1), 0.0
                for pdf in it:
                    for b in pdf.itertuples():
                        x = (np.frombuffer(b.x).reshape(-1, d) - means) * factors
                        out += loss_and_gradient(shared.value, sizes, x, np.frombuffer(b.y, np.int8), np.frombuffer(b.w))
                        n += np.frombuffer(b.w).sum()
                yield pd.DataFrame([(out.tobytes(), n)], columns=["g", "n"])
            found = blocks.mapInPandas(run, "g binary, n double").collect()
            shared.destroy()
            s = sum(np.frombuffer(r.g) for r in found) / round(sum(r.n for r in found))
            return float(s[0]), s[1:]
        best = minimise(evaluate, np.array(start), est.getMaxIter(), est.getTol())
    finally:
        blocks.unpersist()
    return still.setInitialWeights(Vectors.dense(best)).fit(few)
