"""Operator 6: language identification by averaged hashed subword embeddings."""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, id_type, map_batches

BUCKETS, DIM, ORDERS = 1 << 16, 24, (2, 3, 4, 5)
#: Bound of the labelled sample that a model is fitted on: rows, chosen by the hash of their id.
SAMPLE_ROWS = 3000
UNDECIDED = "und"
CHUNK = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters and all bytes of other characters stay; the rest parts words.
_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _grams(text: bytes, back: int):
    """Buckets of the 2- to 5-byte subwords of words, word ends included.

    The first `back` bytes were in the chunk before; a gram whose last byte is there was taken then.
    """
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    space = b == 32
    h, inner = (b ^ np.uint32(2166136261)) * np.uint32(16777619), np.ones(len(b), bool)
    for n in range(2, max(ORDERS) + 1):
        m = len(b) - n + 1
        if m < 1:
            return
        h = (h[:m] ^ b[n - 1:]) * np.uint32(16777619)
        inner = inner[:m] & ~space[n - 2:n - 2 + m] if n > 2 else inner[:m]      # a space only at the ends
        ok = inner & ~(space[:m] & space[n - 1:]) if n == 2 else inner.copy()
        ok[:max(0, back - n + 1)] = False
        g = h[ok]
        yield (g ^ (g >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def subwords(text: str):
    """Buckets of all subwords of a text, one array for each megabyte."""
    b = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()) + b" "
    reach = max(ORDERS) - 1
    for at in range(0, len(b), CHUNK):
        back = min(at, reach)
        yield np.concatenate([np.zeros(0, np.uint32), *_grams(b[at - back:at + CHUNK], back)])


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray          # language x bucket: softmax layer times embedding
    bias: np.ndarray
    temperature: float
    threshold: float            # below this calibrated probability a text is rejected
    known: np.ndarray           # logarithm of one plus a bucket's count over the sample
    least: float = -1.0         # below this average of them a text is rejected, whatever its probability

    def read(self, text: str) -> tuple[np.ndarray, float] | None:
        """(logits, average of `known`) over the subwords of a text."""
        total, known, n = np.zeros(len(self.langs)), 0.0, 0
        for g in subwords(text):
            total += [by_bucket.take(g).sum(dtype=np.float64) for by_bucket in self.scores]
            known += float(self.known.take(g).sum(dtype=np.float64))
            n += len(g)
        return (total / n + self.bias, known / n) if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected); `und` and 0 without letters."""
        if not text or not LETTER.search(text):
            return UNDECIDED, 0.0, True
        got = self.read(text)
        if got is None:
            return UNDECIDED, 0.0, True
        z, known = got
        p = softmax(z[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.threshold or known < self.least)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _excerpts(texts: list[str], y: list[int], rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Each whole text and two runs of 3 to 40 of its words, so short texts are learned too."""
    out, labels = [], []
    for t, k in zip(texts, y):
        w = t.split()
        runs = [t]
        for _ in range(2):
            n = int(rng.integers(3, 41))
            if len(w) > n:
                at = int(rng.integers(0, len(w) - n))
                runs.append(" ".join(w[at:at + n]))
        out += runs
        labels += [k] * len(runs)
    return out, labels


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 5) -> Model:
    """Stochastic gradient descent on embeddings and softmax layer; temperature and threshold from a tenth held aside.

    The threshold is the 0.1 % quantile of the calibrated probability over the texts held aside
    that were told rightly, but a tenth of the way from chance to certainty at most: clean texts,
    the shortest included, pass. A softmax is sure of some language for any text, so a text must
    also be made of subwords that the sample had: the average logarithm of their counts must lie
    halfway or more from that of buckets drawn by chance to the least over the whole texts held aside.
    """
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    if not langs:
        return Model([UNDECIDED], np.zeros((1, BUCKETS), np.float32), np.zeros(1), 1.0, 0.0, np.zeros(BUCKETS, np.float32))
    index = {k: i for i, k in enumerate(langs)}
    aside = rng.random(len(texts)) < 0.1
    split = [([t for t, a in zip(texts, aside) if a == side], [index[k] for k, a in zip(labels, aside) if a == side]) for side in (False, True)]
    (tr, ytr), (ev, yev) = (_excerpts(t, y, rng) for t, y in split)
    bags, counts = [], np.zeros(BUCKETS)
    for t in tr:
        g = np.concatenate(list(subwords(t)))
        ids, c = np.unique(g, return_counts=True)
        counts[ids] += c
        bags.append((ids, (c / max(1, len(g))).astype(np.float32)))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    weight = len(ytr) / (len(langs) * np.maximum(1, np.bincount(ytr, minlength=len(langs)))) if ytr else np.ones(len(langs))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, c = bags[k]
            lr = rate * (1 - done / steps) * min(2.0, weight[ytr[k]])
            done += 1
            if not len(ids):
                continue
            v = c @ emb[ids]
            g = softmax((v @ out + bias)[None])[0]
            g[ytr[k]] -= 1
            back = out @ g
            out -= 0.1 * lr * np.outer(v, g)
            bias -= 0.01 * lr * g
            emb[ids] -= lr * back                              # the average moves by as much as each embedding
    m = Model(langs, np.ascontiguousarray((emb @ out).T), bias.astype(np.float64), 1.0, 0.0, np.log1p(counts).astype(np.float32))
    whole = [got[1] for t in split[1][0] if LETTER.search(t) and (got := m.read(t)) is not None]
    if whole:
        by_chance = float(m.known.mean(dtype=np.float64))
        m.least = by_chance + 0.5 * (min(whole) - by_chance)
    kept = [(got[0], k) for t, k in zip(ev, yev) if (got := m.read(t)) is not None]
    if kept:
        z, k = np.array([a for a, _ in kept]), np.array([b for _, b in kept])
        grid = np.geomspace(0.02, 5, 60)
        loss = [-np.log(softmax(z / t)[np.arange(len(k)), k] + 1e-12).mean() for t in grid]
        m.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / m.temperature)
        right = p.argmax(axis=1) == k
        chance = 1 / len(langs)
        m.threshold = float(min(chance + 0.1 * (1 - chance), np.quantile(p[right].max(axis=1), 0.001))) if right.any() else 0.0
    return m


def is_held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", label_col: str = "label", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample: the `sample_rows` labelled rows of smallest hash that are not held out."""
    s = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("k"), is_held_out(id_col).alias("held"))
    s = s.filter("NOT held AND t IS NOT NULL AND k IS NOT NULL AND t <> ''").select(F.xxhash64(F.col("i").cast("string"), F.lit(6)).alias("h"), "t", "k")
    got = first_by_hash(s, "h", sample_rows).select("t", "k").collect()
    return train([r["t"] for r in got], [r["k"] for r in got])


def identify(rows: DataFrame, model: Model, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, rejected) of every row, from its whole text alone.

    General: the project keeps no prose, so any table with an id and a text will do. A text's
    vector is the average of the embeddings of its hashed subwords (2 to 5 bytes, word ends
    included); a linear softmax layer follows, scaled by a temperature. Since both are linear,
    each bucket's share of the logits is stored instead of its embedding. A model of
    65,536 x languages numbers goes with the tasks.

    Null texts and texts without a letter are `und` with score 0 and rejected. Repeated rows
    come out each. A null id passes through. Other columns are not read.
    """
    sql, arrow = id_type(rows, id_col)
    types = pa.schema([("i", arrow), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def tell(i, t):
        p = [model.predict(x) for x in t]
        return {"i": i, "lang_pred": [a for a, _, _ in p], "score": [b for _, b, _ in p], "rejected": [c for _, _, c in p]}

    d = rows.select(F.col(id_col).cast(sql).alias("i"), F.col(text_col).cast("string").alias("t"))
    return map_batches(d, tell, f"i {sql}, lang_pred string, score double, rejected boolean", types).withColumnRenamed("i", id_col)


def keep_identified(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose language the model does not reject, unchanged, in one pass over them."""
    def keep(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([not model.predict(t)[2] for t in texts], pa.bool_()))

    return rows.mapInArrow(keep, rows.schema)
