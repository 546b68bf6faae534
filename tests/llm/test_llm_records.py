"""Operators on vectors and sequences against brute force, with the awkward rows each must take."""
import collections

import numpy as np
import pytest
import xxhash

from flowaudit.llm import components, decontamination, embedding_dedup, repeats, simhash

FLOW = "tcp http SF ShADadFf udp dns S0 D icmp OTH REJ Sr ssh RSTO ftp tls SH".split()


def flows(rng, n):
    """A session's records as words: protocol, service, state, history and a size."""
    return [f"{FLOW[rng.integers(len(FLOW))]}{rng.integers(40)}" for _ in range(n)]


def by_id(df, key):
    return {r[key]: r for r in df.collect()}


def union_find(n, pairs):
    p = list(range(n))

    def root(a):
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a
    for a, b in pairs:
        p[root(a)] = root(b)
    return [root(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(500, 500), (7, 8)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 140)}) == 1
    assert got[0] != got[100] and 500 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 7
def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(25):
        base = flows(rng, 300)
        for _ in range(6):
            w = list(base)
            for k in rng.integers(0, 300, rng.integers(0, 4)):
                w[k] = "changed"
            texts.append(" ".join(w))
    texts += [None, "", " \t\n", "tcp", "tcp http", "TCP HTTP", texts[0], "x " * 30000, "Ä ä Ä"]
    df = spark.createDataFrame([(i, t, "tcp", i) for i, t in enumerate(texts)], "row_id long, sequence string, fp string, label int")
    got = by_id(simhash.near_duplicate_sequences(df), "row_id")
    fp = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    root = union_find(len(fp), pairs)
    first = {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    for i in range(len(fp)):
        assert got[i].fingerprint == f"{fp[i]:016x}" and got[i].component_id == first[root[i]]
    assert len({got[i].component_id for i in range(150)}) < 150


def test_simhash_odd_rows(spark):
    schema = "row_id long, sequence string"
    assert simhash.near_duplicate_sequences(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "only null ids here")], schema)
    got = sorted(((r.row_id, r.component_id) for r in simhash.near_duplicate_sequences(df).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]


def plain_wide_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    h = [int.from_bytes(xxhash.xxh3_128_digest(g, 1) + xxhash.xxh3_128_digest(g, 2), "big") for g in grams]
    return sum(1 << b for b in range(256) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_similar_sequences_are_found(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    texts = []
    for k in range(30):
        base = flows(rng, 200)
        for j in range(40 if k == 0 else 5):
            w = list(base)
            if j:
                w[int(rng.integers(0, 195))] = f"changed{j}"
            texts.append(" ".join(w))
    texts += [None, "", "tcp http", "TCP  http", texts[3], "x " * 30000, "Ä ä Ä"]
    df = spark.createDataFrame([(i, t, "tcp", i) for i, t in enumerate(texts)], "row_id long, sequence string, fp string, label int")
    got = {i: r.component_id for i, r in by_id(simhash.similar_sequences(df), "row_id").items()}
    fp = [plain_wide_fingerprint(t) for t in texts]
    assert simhash.bits_at(0.8) == 44
    root = union_find(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 44])
    first = {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    assert got == {i: first[root[i]] for i in range(len(fp))}
    bases = [0, *range(40, 185, 5)]
    assert all(got[i] == max(b for b in bases if b <= i) for i in range(185))      # one word of 200 changed
    assert [got[i] for i in range(185, 192)] == [185, 185, 187, 187, 0, 190, 191]


def test_similar_odd_rows(spark):
    schema = "row_id long, sequence string"
    assert simhash.similar_sequences(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "only null ids here")], schema)
    got = sorted(((r.row_id, r.component_id) for r in simhash.similar_sequences(df).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_similar_sequences_have_the_similarity(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SET_ROWS", 16)
    rng = np.random.default_rng(8)
    texts = []
    for k in range(12):                                     # chains of growing distance on both sides of 0.8
        base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        for j in range(12):
            w = list(base)
            for x in rng.choice(300, j, replace=False):
                w[x] = f"new{k}.{j}.{x}"
            texts.append(" ".join(w))
    for _ in range(2):                                      # only repeated lines are shared: similarity 0.02
        own = [f"u{x}" for x in rng.integers(0, 10**6, 204)]
        texts.append(" ".join(own + [f"line{x % 10}" for x in range(300)]))
    sets = [plain_shingles(t) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])      # noqa: E731
    root = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(i, j)])
    first = {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, sequence string")
    got = {i: r.component_id for i, r in by_id(simhash.similar_sequences(df), "row_id").items()}
    assert got == {i: first[root[i]] for i in range(len(texts))}
    assert len(set(got.values())) > 30


def test_large_buckets_are_connected():
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**63))
    m = np.unique(np.array([base ^ int(x) for x in rng.integers(0, 2**13, 700)], np.uint64))
    a, b = simhash._bucket_links([m])
    at = {int(v): i for i, v in enumerate(m)}
    want = union_find(len(m), [(i, j) for i in range(len(m)) for j in range(i) if (int(m[i]) ^ int(m[j])).bit_count() <= 2])
    got = union_find(len(m), [(at[int(x)], at[int(y)]) for x, y in zip(a, b)])
    assert len(a) < len(m) and all((want[i] == want[j]) == (got[i] == got[j]) for i in range(len(m)) for j in range(i))


# ------------------------------------------------------------------ 8
def plain_repeats(texts, n):
    words = [(t or "").encode().split() for t in texts]
    c = collections.Counter(tuple(w[k:k + n]) for w in words for k in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if c[tuple(w[k:k + n])] > 1:
                gone |= set(range(k, k + n))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("chunk", [400, 2_000_000])
def test_repeats_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    rng = np.random.default_rng(11)
    passages = [flows(rng, n) for n in (34, 35, 36, 60, 200)]
    texts = []
    for i in range(60):
        w = flows(rng, int(rng.integers(0, 120)))
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = passages[rng.integers(len(passages))]
        texts.append(" ".join(w))
    texts += [None, "", "  ", "a " * 100, texts[3], texts[3], " ".join(passages[4] + passages[4])]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "row_id long, sequence string, chunk int")
    got = by_id(repeats.without_repeats(df), "row_id")
    for i, want in enumerate(plain_repeats(texts, 35)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == want


def test_repeats_odd_rows(spark):
    schema = "row_id long, sequence string"
    assert repeats.without_repeats(spark.createDataFrame([], schema)).count() == 0
    run = " ".join(f"w{k}" for k in range(40))
    got = repeats.without_repeats(spark.createDataFrame([(1, run), (1, run), (None, "x y")], schema)).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(2, 0), (40, 40), (40, 40)]


# ------------------------------------------------------------------ 3
def test_substituted_test_sequences_are_found(spark):
    rng = np.random.default_rng(2)
    tests = [flows(rng, n) for n in (15, 30, 60)]
    rows, want = [], {}
    for i in range(90):
        w = flows(rng, 80)
        if i % 3 == 0:
            t = list(tests[i % 9 // 3])
            for k in range(i // 30 * 7 + 3, len(t), 12 if i < 60 else 10**6):
                t[k] = "other"
            w[20:20] = [x.upper() + "," for x in t]
            want[i] = i % 9 // 3
        rows.append((i, " ".join(w)))
    rows += [(90, None), (91, ""), (92, "tcp"), (92, "tcp"), (None, " ".join(tests[1])), (93, " ".join(tests[2][:14])), (94, " ".join(tests[2][:9]))]
    r = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "row_id long, sequence string, test_id int, w int")
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(tests)] + [(7, None), (8, "tcp http"), (None, ""), (0, " ".join(tests[0]))], "test_id long, sequence string")
    got = by_id(decontamination.contamination(r, t), "row_id")
    assert {i for i, x in got.items() if x.contaminated} == set(want) | {None, 93}
    assert all(got[i].n_tests == 1 for i in want) and got[90].best_score is None and len(got) == 96
    pairs = {(x.row_id, x.test_id) for x in decontamination.test_overlaps(r, t).collect()}
    assert {(i, k) for i, k in want.items()} <= pairs
    assert {x.row_id for x in decontamination.without_tests(r, t).collect()} == set(range(95)) - set(want) - {93}
    for empty in (r.limit(0), t.limit(0)):
        assert decontamination.test_overlaps(empty if empty.columns == r.columns else r, t if empty.columns == r.columns else empty).count() == 0


def test_dense_substitutions_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    word = lambda: f"v{rng.integers(10**6)}"                # noqa: E731
    lengths = [4, 9, *range(10, 61, 5)]
    tests = [[word() for _ in range(n)] for n in lengths]
    rows, dense = [], set()
    for k, t in enumerate(tests):
        for every in (4, 5, 6):
            for at in range(every):
                w = [word() if i % every == at else x for i, x in enumerate(t)]
                dense |= {(len(rows), k)} if len(t) >= 10 else set()
                rows.append([word() for _ in range(20)] + w + [word() for _ in range(20)])
        for share in (0.0, 0.1, 0.2, 0.25, 0.4):
            out = set(rng.choice(len(t), int(share * len(t)), replace=False).tolist())
            dense |= {(len(rows), k)} if not share else set()
            rows.append([word() for _ in range(20)] + [word() if i in out else x for i, x in enumerate(t)] + [word()])

    def best(t, w):
        top = equal = unequal = 0
        for shift in range(-len(t), len(w)):
            run, e, u = 0, 0, 0
            for q, x in enumerate(t):
                hit = 0 <= q + shift < len(w) and w[q + shift] == x
                run, e, u = (run + 1, e + 1, u) if hit else (run - 1, e, u + 1)
                if run <= 0:
                    run, e, u = 0, 0, 0
                elif run > top:
                    top, equal, unequal = run, e, u
        return top, equal, unequal

    score = {(i, k): best(t, w) for i, w in enumerate(rows) for k, t in enumerate(tests) if set(t) & set(w)}
    need = [n if n < 10 else min(10, (n + 1) // 2) for n in lengths]
    want = {p for p, (s, _, _) in score.items() if s >= need[p[1]]}
    sure = {p for p in want if score[p][1] >= 2 * score[p][2] + 3}         # three quarters equal and more
    r = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "row_id long, sequence string")
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(tests)], "test_id long, sequence string")
    got = {(x.row_id, x.test_id): x.score for x in decontamination.test_overlaps(r, t).collect()}
    assert sure <= set(got) <= want and all(got[p] == score[p][0] for p in got)
    five = {(i, k) for i, k in dense if len(tests[k]) >= 20 or score[i, k][0] >= need[k]}
    assert five <= set(got) and len(five) > 100


def test_every_pattern_of_equal_words_holds_a_spaced_seed():
    """The masks' guarantee, by enumeration: bit i of a pattern tells whether word i of a stretch is equal."""
    def without_seed(patterns, length):
        for m in decontamination.MASKS:
            assert "0" in m
            bits = sum(1 << i for i, on in enumerate(m) if on == "1")
            for i in range(length - len(m) + 1):
                patterns = patterns[patterns >> i & bits != bits]
        return patterns

    for n in (15, 18, 21, 24):                              # two thirds equal; longer stretches hold such windows
        windows = np.arange(1 << n, dtype=np.uint32)
        assert not len(without_seed(windows[np.bitwise_count(windows) >= 2 * n // 3], n))
    for n in range(5, 23):                                  # shorter ones score what an item of at least ten and as many words needs
        p = np.arange(1 << n, dtype=np.uint32)
        equal = np.bitwise_count(p).astype(int)
        need = min(10, (max(n, 10) + 1) // 2)
        p = p[(p & 1 == 1) & (p >> (n - 1) == 1) & (equal >= 2 * (n - equal) + 3) & (2 * equal - n >= need)]
        assert len(p) and not len(without_seed(p, n))


def test_short_items_are_compared_whole(spark):
    t = spark.createDataFrame([(1, "Alpha"), (2, "beta gamma"), (3, "one two three four"), (4, ""), (5, None)], "test_id long, sequence string")
    rows = [(1, "x alpha y"), (2, "beta x gamma"), (3, "the beta, gamma ray"), (4, "one two three"), (5, "zero one two three four"), (6, "alpha"), (7, "")]
    r = spark.createDataFrame(rows, "row_id long, sequence string")
    got = sorted(tuple(x) for x in decontamination.test_overlaps(r, t).collect())
    assert got == [(1, 1, 1), (3, 2, 2), (5, 3, 4), (6, 1, 1)]


def test_shuffled_seeds_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    tests = [flows(rng, 40) for _ in range(3)]
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(tests)], "test_id long, sequence string")
    rows = [(i, " ".join(flows(rng, i) + tests[i % 3][i % 7:] + flows(rng, 20) + tests[0][:12])) for i in range(20)]
    rows += [rows[3], (30, rows[3][1]), (None, rows[4][1]), (31, None), (32, " ".join(flows(rng, 50)))]
    r = spark.createDataFrame(rows, "row_id long, sequence string")
    found = lambda: sorted(map(tuple, decontamination.test_overlaps(r, t).collect()), key=str)
    want = found()
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", -1)
    assert found() == want and (0, 0, 40) in want and {x[0] for x in want} == {*range(20), 30, None}


# ------------------------------------------------------------------ 1
def test_near_duplicate_windows_equal_brute_force(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 20), ("BLOCK_ROWS", 16), ("TILE", 8)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(9)
    rows = []
    for k in range(40):
        base = rng.normal(size=12)
        for _ in range(int(rng.integers(1, 12))):
            rows.append(((base + rng.normal(size=12) * rng.choice([0, 0.03, 0.06, 0.2])).tolist(), int(k % 3)))
    rows += [([1e300, 0.0] + [0.0] * 10, 0), ([1e-300, 0.0] + [0.0] * 10, 0), ([2.0, 1.0], 0), ([4.0, 2.0], 0), ([4.0, 2.0], 1)]
    odd = [(None, 0), ([], 0), ([0.0] * 12, 0), ([None] + [1.0] * 11, 0), ([float("nan")] + [1.0] * 11, 0), ([float("inf")] * 12, 0), (rows[0][0], None), (rows[0][0], None)]
    data = [(i, v, y, 7) for i, (v, y) in enumerate(rows + odd)]
    got = by_id(embedding_dedup.near_duplicate_windows(spark.createDataFrame(data, "row_id long, features array<double>, traffic_type int, node int")), "row_id")
    x = [np.array(v) / np.abs(v).max() for v, _ in rows]
    x = [v / np.linalg.norm(v) for v in x]
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if rows[i][1] == rows[j][1] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.98]
    root, links, first = union_find(len(x), pairs), collections.Counter(k for p in pairs for k in p), {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    assert len(pairs) > 100
    for i in range(len(x)):
        assert tuple(got[i])[1:] == (links[i], first[root[i]], first[root[i]] == i)
    for i in range(len(x), len(data)):
        assert tuple(got[i])[1:] == (0, i, True)


def test_near_duplicate_windows_odd_rows(spark):
    schema = "row_id long, features array<float>, traffic_type int"
    assert embedding_dedup.near_duplicate_windows(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, [0.0, 1.0], 0)], schema)
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicate_windows(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, False), (None, 2, 1, False)]
