"""Operators 11 to 13 against brute force, with the awkward rows each must take."""
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from flowaudit.llm import collocations, periodic_runs, queries, top_k_search

FIELDS = "tcp http SF ShADadFf udp dns S0 D icmp OTH REJ".split()


# ------------------------------------------------------------------ 11
def plain_collocations(rows, least, top=2000, longest=4):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for g, text in rows:
        g = "und" if g is None else g
        for piece in re.split(b"[.,;:!?\n-\r]", (text or "").encode().lower()):
            w = [x for x in re.split(b"[ \t]+", piece) if x]
            n[g] += len(w)
            for m in range(1, longest + 1):
                f[g].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for g, count in f.items():
        long = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in long.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        rows = []
        for p, a in long.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, b" ".join(p), count[p[:k]], count[p[k:]]))
        out += [(g, r, p.decode(), -a, x, y, n[g], -s) for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def record_texts(rng, n):
    sign = [" ", " ", " ", "\t", ". ", "\n", " , ", ";", "\x0b"]
    out = []
    for k in range(n):
        w = [FIELDS[min(int(rng.geometric(0.3)) - 1, len(FIELDS) - 1)] for _ in range(rng.integers(0, 60))]
        out.append((["web", "video", None, "und", "É"][k % 5], "".join(x + sign[rng.integers(len(sign))] for x in w)))
    return out


@pytest.mark.parametrize("sizes", [collocations.Sizes(), collocations.Sizes(pack=300, tile=2, part=400, waiting=40)])
def test_collocations_equal_brute_force(spark, sizes):
    rows = record_texts(np.random.default_rng(11), 300) + [("web", "a b c d " * 40), ("web", None), ("web", ""), ("few", "x y"), ("É", "Ünï ünï É" * 12)]
    df = spark.createDataFrame([(g, t, 1) for g, t in rows], "traffic_type string, sequence string, f int").repartition(3)
    got = collocations.collocations(df, min_count=8, top=25, sizes=sizes)
    assert got.columns == ["traffic_type", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 8, 25)


def test_collocations_of_few_rows(spark):
    schema = "traffic_type string, sequence string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([("web", "once and never more")], schema)).count() == 0
    got = collocations.collocations(spark.createDataFrame([("web", "Beep " * 20000), (None, "a.b," * 50)], schema)).collect()
    assert [(r.traffic_type, r.phrase, r.a, r.n) for r in got] == [("web", "beep beep beep beep", 19997, 20000)]


def test_packed_numbers_come_back():
    for a in (np.array([-1, 5, 7]), np.array([1 << 40, -1]), np.zeros(0, np.int64)):
        assert collocations._spread(collocations._squeezed(a)).tolist() == a.tolist()


# ------------------------------------------------------------------ 12
def plain_runs(w):
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p) and not any(all(w[x] == w[x + q] for x in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, n, letters):
    w = rng.integers(0, letters, n)
    for _ in range(rng.integers(0, 3) if n > 8 else 0):
        a = int(rng.integers(0, n))
        p = int(rng.integers(1, max(2, (n - a) // 3)))
        for i in range(a, int(rng.integers(a, n + 1))):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_equal_brute_force():
    rng = np.random.default_rng(12)
    found = 0
    for _ in range(1500):
        w = periodic(rng, int(rng.integers(0, 90)), int(rng.integers(1, 4)))
        want = plain_runs(w.tolist())
        assert periodic_runs.runs(w) == want, w.tolist()
        found += len(want)
    assert found > 500


def test_range_successors_equal_brute_force():
    rng = np.random.default_rng(13)
    values = rng.permutation(77)
    lo = rng.integers(0, 76, 200)
    hi = lo + 1 + rng.integers(0, 77 - lo)
    than = rng.integers(0, 77, 200)
    assert periodic_runs.smaller_in_range(values, lo, hi, than).tolist() == [int((values[a:b] < t).sum()) for a, b, t in zip(lo, hi, than)]
    nth = rng.integers(0, hi - lo)
    assert periodic_runs.nth_in_range(values, lo, hi, nth).tolist() == [sorted(values[a:b].tolist())[k] for a, b, k in zip(lo, hi, nth)]


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs_of_sequences(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 300)
    rng = np.random.default_rng(14)
    rows = [(k, " ".join(FIELDS[i] for i in periodic(rng, int(rng.integers(0, 120)), 4))) for k in range(80)]
    rows += [(5, rows[5][1]), (None, "a " * 9), (90, None), (91, ""), (92, " \t\n"), (93, "x\x0by\x0cx\ty x\ny x y z é"), (94, "S0 SF " * 4000 + "end")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "row_id long, sequence string, runs int")
    got = periodic_runs.periodic_runs(df).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        w = [x.decode() for x in w]
        r = plain_runs(w) if i != 94 else [(0, 8000, 2)]
        best = min(r, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        want[(i, len(r), best[0], best[1], best[2], tuple(r), collapsed(w, r))] += 1
    assert collections.Counter((r.row_id, r.n_runs, r.start, r.length, r.period, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got) == want
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_periodic_query_equals_brute_force(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op12_periodic_runs(spark, data).collect()
    assert len(got) == len(docs) and sum(r.n_runs for r in got) > 0
    for r in got:
        w = [x.decode() for x in (docs[r.doc_id] or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        if n > 1500:
            continue
        runs = plain_runs(w)
        assert r.n_runs == len(runs), r.doc_id
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        if runs:
            assert r.exponent_milli == max(1000 * m // p for _, m, p in runs)


# ------------------------------------------------------------------ 13
def plain_top(rows, every, top):
    """Of lists (id, vector) that take part; Python's whole numbers."""
    whole = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in rows]
    out = collections.Counter()
    for k, (i, q) in enumerate(whole):
        if i is None or i % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v)), (j is None, j)) for m, (j, v) in enumerate(whole) if m != k and len(v) == len(q))
        out.update((i, r, j, -s) for r, (s, (_, j)) in enumerate(found[:top], 1))
    return out


@pytest.mark.parametrize("size, summary", [(8192, 512), (40, 3)])
def test_top_by_score_equals_brute_force(spark, monkeypatch, size, summary):
    monkeypatch.setattr(top_k_search, "RANGE_ROWS", size)
    monkeypatch.setattr(top_k_search, "SUMMARY", summary)
    rng = np.random.default_rng(15)
    centres = rng.normal(size=(5, 6))
    rows = [(k, (centres[k % 5] + 0.1 * rng.normal(size=6)).round(2).tolist()) for k in range(300)]
    rows += [(k, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5]) for k in range(300, 340)]                    # ties
    rows += [(310, [1.0] * 6), (310, [1.0] * 6), (None, [9.0] * 6), (400, [1.0, 2.0]), (405, [1.0, 3.0]), (410, []), (412, [])]
    out = [(500, None), (505, [None] * 6), (510, [float("nan")] + [0.0] * 5), (515, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows + out], "row_id long, features array<double>, ask string").repartition(4)
    got = top_k_search.top_by_score(df, every=5, top=7)
    assert got.columns == ["query_id", "rank", "row_id", "score"]
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_top(rows, 5, 7)
    assert top_k_search.top_by_score(df.limit(0)).count() == 0


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(16)
    rows = [(k, (rng.integers(-2**23, 2**23, 5) + rng.random(5)).tolist()) for k in range(60)] + [(k, [1e200, 0.0, 0.0, 0.0, 0.0]) for k in (60, 61)]
    got = top_k_search.top_by_score(spark.createDataFrame(rows, "row_id long, features array<double>"), every=10, top=5).collect()
    want = plain_top(rows, 10, 5)
    clip = lambda s: max(-2**63 + 1, min(2**63 - 1, s))
    assert collections.Counter((r.query_id, r["rank"], r.score) for r in got) == collections.Counter((q, r, clip(s)) for q, r, _, s in want)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(17)
    x = np.floor(64 * (rng.normal(size=(8, 1, 12)) * 3 + rng.normal(size=(8, 500, 12)) * 0.1).reshape(-1, 12))
    scored = []
    keep, top_k_search._scores = top_k_search._scores, lambda q, b: scored.append(len(q) * len(b)) or keep(q, b)
    try:
        at, row, score = top_k_search.search(x[::40], np.arange(0, len(x), 40), np.full(100, top_k_search.NO_SCORE), x, np.arange(len(x)), 20, 128)
    finally:
        top_k_search._scores = keep
    full = x[::40] @ x.T
    full[np.arange(100), np.arange(0, len(x), 40)] = -np.inf
    assert sorted(score.tolist()) == sorted(-np.sort(-full, axis=1)[:, :20].ravel())
    assert sum(scored) < 0.5 * full.size
