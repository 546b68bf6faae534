"""Operators on texts and pages against plain Python, and the pipeline against its stages in plain Python."""
import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pytest

from flowaudit.llm import decontamination, html_text, language, licences, packing, pii, queries, token_counts

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ODD = [None, "", " ", "\n\n", "x" * 50000, "a b " * 20000, "é ﬁ 漢字 😀​", "1 " * 9000, "<|endoftext|> a<|endoftext|>", "<s> </s> <unk> <0x0A>", "  two   spaces\t\r\n", "▁ ▁▁a", "ABC!!!...???"]


def frame(spark, texts, extra="spans string"):
    return spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], f"row_id long, text string, {extra}")


def luhn(m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def base_spans(t):
    found = []
    for o, (k, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t or ""):
            n = sum(c.isdigit() for c in m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= n <= 19 and luhn(m[0]), "phone": 9 <= n <= 15}[k]:
                found.append((m.start(), o, k, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


# ------------------------------------------------------------------ 2
def test_base_spans_equal_regexes(spark):
    texts = ODD + ["mail é a.b@c.de_x@y.org, a@b, @c.d x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.2.3 1.2.3 000000000300.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 12",
                   "+1 (017) 555-7713 +44 +4 123456789012345678 +1-2-3-4-5-6-7-8-9", "card 4111111111111111+1 555 123 4567 at 10.0.0.1", "1.1.1.1 " * 300 + "a@b.c " * 200]
    got = {r.row["row_id"]: r for r in pii.find_personal_data(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in got[i].spans if s["kind"] in BASE] == base_spans(t), t


def test_checksums_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 paid", "IBAN DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "part 123-45-6789", "mail a@b.cd x"]
    got = {r.row["row_id"]: [(s["kind"], round(s["score"], 2)) for s in r.spans] for r in pii.find_personal_data(frame(spark, texts)).collect()}
    assert got == {0: [("iban", 1.0)], 1: [], 2: [("ssn", 0.6)], 3: [], 4: [("email", 1.0)]}


def test_redaction(spark):
    texts = ["write é a@b.cd or 10.0.0.1!", None, "", "no data", "4111111111111111", "x 1.2.3.4@b.cd y"]
    got = {r.row_id: (r.text, r.spans) for r in pii.redacted(frame(spark, texts)).collect()}
    assert [got[i][0] for i in range(5)] == ["write é [EMAIL] or [IP]!", None, "", "no data", "[CARD]"] and got[0][1] == "n"
    assert got[5][0] == "x [EMAIL] y"
    assert pii.redacted(frame(spark, [])).count() == 0


def test_many_matches_in_one_text(spark):
    """50,000 addresses in one text of 1.4 MB, each at its place, in time linear in the matches."""
    parts = [f"user{i}@host{i % 97}.example.org" for i in range(50_000)]
    one, at, want = frame(spark, [", ".join(parts)]), 0, []
    for p in parts:
        want.append((at, at + len(p)))
        at += len(p) + 2
    t = time.monotonic()
    spans = pii.find_personal_data(one).first().spans
    assert [(s["start"], s["end"]) for s in spans] == want and {s["kind"] for s in spans} == {"email"}
    assert pii.redacted(one).first().text == ", ".join(["[EMAIL]"] * len(parts))
    assert time.monotonic() - t < 60


# ------------------------------------------------------------------ 5
def test_counts_equal_the_library(spark):
    import public_tokenizers as files
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(8)
    pool = "etaoin shrdlu.,  \n▁éñ漢😀\t"
    texts = ODD + ["".join(rng.choice(list(pool), 200)) for _ in range(200)]
    got = {r.row_id: r for r in token_counts.count_tokens(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(sp.encode(t or ""))), repr(t)
        assert got[i].over_limit == (got[i].n_tokens > 4096)
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


# ------------------------------------------------------------------ 6
def test_language_on_held_out_rows(spark, data):
    df = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = queries.op6_language(spark, data.replace("sf0.001", "sf0.01")).collect()
    lang = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert sum(r.rejected for r in rows) <= 2


def test_language_rejects_what_the_sample_does_not_hold(spark, data):
    """Other scripts, noise and encoded bytes go; whole documents and runs of 30 of their words stay."""
    d = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    m = language.fit(d, "doc_id", "text", "lang")
    rng = np.random.default_rng(1)
    foreign = ["Съешь же ещё этих мягких французских булок да выпей чаю вместе с друзьями у реки", "안녕하세요 오늘 날씨가 정말 좋네요 우리 바다에 놀러 갑시다",
               "तेज़ भूरी लोमड़ी आलसी कुत्ते के ऊपर से कूदती है और जंगल में भाग जाती है", "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί",
               "".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 400)), "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 600))]
    texts = [r.text for r in d.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 40]
    runs = [" ".join(t.split()[5:35]) for t in texts]
    assert all(m.predict(t)[2] for t in foreign)
    assert not any(m.predict(t)[2] for t in texts)
    assert np.mean([m.predict(t)[2] for t in runs]) < 0.005
    kept = language.keep_identified(frame(spark, foreign + texts[:20] + [None, ""]), m).collect()
    assert sorted(r.row_id for r in kept) == list(range(len(foreign), len(foreign) + 20))


def test_language_odd_rows(spark):
    m = language.train(["the cat and the dog " * 5, "le chat et le chien " * 5] * 30, ["en", "fr"] * 30)
    got = {r.row_id: r for r in language.identify(frame(spark, ODD + ["le chien", "the dog"]), m).collect()}
    n = len(ODD)
    assert (got[n].lang_pred, got[n + 1].lang_pred) == ("fr", "en") and all(0 <= r.score <= 1 for r in got.values())
    for i in (0, 1, 2, 3, 7):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    long = "the dog and " * 200_000
    parts = [np.concatenate(list(language.subwords(long))), np.concatenate(list(language._grams(b" " + b" ".join(long.encode().split()) + b" ", 0)))]
    assert collections.Counter(parts[0].tolist()) == collections.Counter(parts[1].tolist())
    empty = language.fit(spark.createDataFrame([], "row_id long, text string, label string"))
    assert language.identify(frame(spark, ["abc"]), empty).head().lang_pred == "und"


# ------------------------------------------------------------------ 9
def test_licence_phrases_equal_plain_scan(spark):
    texts = ODD + ["MIT License, mit license; permit license", "The GNU General Public License. gnu GENERAL public-license", "cc by é cc by cc by", "apache license mit license apache\nlicense",
                   "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0"]
    got = {r.row_id: r for r in licences.scan_licences(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(k, label) for p, label in licences.BASE.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(hits), min(at, default=None), max(at, default=None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in hits})) and 0 <= got[i].score <= 1
    assert got[len(texts) - 1].labels == "apache,gpl,mit" and got[len(texts) - 1].base_labels == ""


def test_expressions():
    e = licences.evaluate
    f = frozenset
    assert e("MIT OR Apache-2.0 AND BSD-3-Clause") == f([f(["mit"]), f(["apache", "bsd"])])
    assert e("(MIT OR Apache-2.0) AND GPL-2.0+ WITH x") == f([f(["mit", "gpl"]), f(["apache", "gpl"])])
    assert e("((MIT") == f([f(["mit"])]) == e("MIT */") == e("MIT)") == e("MIT and")
    assert e("MIT OR (Apache-2.0 AND GPL-2.0 WITH x)", choices=False) == f(["mit", "apache", "gpl"]) and e("or", choices=False) == f()
    long = " AND ".join(f"(L{k} OR MIT)" for k in range(300))
    assert len(e(long, choices=False)) == 301
    assert e("") == e("AND MIT") == e(")") == e("()") == f()


# ------------------------------------------------------------------ 4
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>
<!-- x --><div class="ad">Buy <b>now</b></div>%s<div id="comments"><p>nice</div><footer>&copy; x</footer></body>"""


def test_main_text(spark):
    art = PAGE % "<article><h1>A &amp;amp; B</h1><p><b>One\n two<br><p>Three&nbsp;<i>x</i><aside>no</aside><div class='comment'>no</div><p>1 < 2 &lt;b&gt;</article>"
    pages = [(i, "https://h.org/a/%d" % i, PAGE % f"<div>Shared line</div><p>Own {i}</p><p>All the same</p>") for i in range(3)]
    pages += [(3, "https://h.org/b", art), (4, None, None), (5, "::bad[", ""), (6, "http://other.org/x", PAGE % "<p>Alone"), (6, "http://other.org/x", PAGE % "<p>Alone"), (None, "http://c.org", "plain text")]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in pages], "row_id long, url string, html string, text int")
    got = sorted(((r.row_id, r.text) for r in html_text.main_text(df).collect()), key=str)
    assert got == sorted([(0, "Own 0"), (1, "Own 1"), (2, "Own 2"), (3, "A &amp; B\n\nOne two\n\nThree x\n\n1 < 2 <b>"), (4, ""), (5, ""), (6, "Alone"), (6, "Alone"), (None, "plain text")], key=str)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_blocks_end_paragraphs():
    kept = [t for t, kind in html_text.blocks("<article><p class=ad>buy<p>one<p class=ad>buy<div>two</div><ul><li class=ad>buy<li>three</ul></article>")[0] if kind == html_text.KEEP]
    assert kept == ["one", "two", "three"]


def test_neighbours_are_the_nearest_of_a_large_host(spark):
    pages = []
    for k in range(120):                                    # two pages a section share its line, and no other page has it
        for j in "ab":
            pages.append((len(pages), f"http://h.org/s{k:03}/{j}", f"<p>Section {k}</p><p>Own {k}{j}</p>"))
    pages += [(1000 + k, "http://q.org/index.php?id=%03d" % k, f"<p>Query {k // 2}</p><p>Own {k}</p>") for k in range(160)]
    df = spark.createDataFrame(pages, "row_id long, url string, html string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # several ranges
    try:
        got = {r.row_id: r.text for r in html_text.main_text(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(got[2 * k + x] == f"Own {k}{j}" for k in range(120) for x, j in enumerate("ab"))
    order = sorted(pages[240:], key=lambda p: p[1])         # of equal paths the page before is the neighbour
    assert [got[i] for i, _, _ in order] == [f"Own {k}" if k % 2 or not k else f"Query {k // 2}\n\nOwn {k}" for k in range(160)]


def test_marks_are_whole_classes():
    kept = lambda html: [t for t, kind in html_text.blocks(html)[0] if kind == html_text.KEEP]      # noqa: E731
    loose = lambda html: [t for t, kind in html_text.blocks(html)[0] if kind == html_text.LOOSE]      # noqa: E731
    assert kept("<div class='layout with-sidebar'><article><p>one<p class='notice'>two</article></div>") == ["one", "two"]
    assert loose("<body class='x'><div class='has-cookie-banner'><p>one</div><nav>no</nav>") == ["one"]
    assert kept("<div class='page sidebar'><nav>no</nav><article><p>one<div class='ad'>no</div></article></div>") == ["one"]
    assert kept("<article>one<aside><article>no</article></aside></article><div class=sidebar><article>no</article></div>") == ["one"]
    assert loose("<form id=f><nav>no</nav><p>one<p>two</form>") == ["one", "two"] and loose("<p>one<form>no</form>") == ["one"]
    assert kept("<form id=f><main><p>one</main><p>no</form>") == ["one"]


def test_shared_lines_equal_the_table_method():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 15)).tolist() for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        got = html_text.shared_lines(a, b)
        at = iter(b)
        assert sum(got) == t[-1, -1] and all(x in at for x, g in zip(a, got) if g)


# ------------------------------------------------------------------ 10
def fits(rows, lengths, capacity):
    bins = collections.defaultdict(list)
    seen = collections.defaultdict(list)
    for i, piece, start, length, q, o in rows:
        bins[q].append((o, length))
        seen[i].append((piece, start, length))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    for i, v in seen.items():
        at = 0
        for k, (piece, start, n) in enumerate(sorted(v)):
            assert (piece, start) == (k, at) and (k == 0 or n == capacity)
            at += n
        assert at == lengths[i]
    assert set(seen) == set(lengths)
    return len(bins)


def test_packing_round_trip(spark):
    import public_tokenizers as files
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    texts = ODD + ["tcp flow " * k for k in range(1, 60)]
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(texts)}
    rows = packing.pack(frame(spark, texts, "length string")).collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.row_id][r.start:r.start + r.length], "<u4").tobytes())
    n = fits([(r.row_id, r.piece, r.start, r.length, r.sequence_id, r.offset) for r in rows], {i: len(v) for i, v in ids.items()}, 2048)
    assert n <= -(-sum(map(len, ids.values())) // 2048) + 1
    assert packing.pack(frame(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "row_id long, text string")
    assert sorted(r.offset for r in packing.pack(twice).collect()) == [0, 2, 4]


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_dense(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.geometric(1 / rng.choice([60, 300, 900]), 4000), 2048)
    counts = collections.Counter(sizes.tolist())
    plan = packing.plan_bins(dict(counts))
    bins, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for length, first, n, b, o in plan:
        ranks[length].append((first, n))
        for k in range(n):
            bins[b + k].append((o, length))
    for length, v in ranks.items():
        at = 0
        for first, n in sorted(v):
            assert first == at
            at += n
        assert at == counts[length]
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048 and sum(3 * n > 2048 for _, n in v) <= 2
    large = sum(3 * s > 2048 for s in sizes)
    assert len(bins) <= max(1.03 * sizes.sum() / 2048 + 1, large)


def test_both_tokenizers_agree_on_plain_characters():
    chars = [c for c in map(chr, range(0x250)) if packing.PLAIN.fullmatch(c)] + [chr(c) for c in range(0x2010, 0x2028)] + ["€"]
    slow, fast, _ = packing._encoders("byte_bpe_50k.json")
    rng = np.random.default_rng(5)
    for c in chars:
        for t in (c, f"a{c}b {c}1 {c}{c}  {c}", "".join(rng.choice(chars, 30)) + c):
            assert fast.encode_ordinary(t) == slow.encode(t, add_special_tokens=False).ids, repr(t)


# ------------------------------------------------------------------ pipeline
def test_pipeline_equals_its_stages_in_plain_python(spark, data):
    import public_tokenizers as files
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tests.llm.test_llm_records import union_find
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "personal_data", "packing"]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    model = language.fit(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text", "lang")
    docs = {i: t for i, t in docs.items() if not model.predict(t)[2]}
    ids = sorted(docs)
    words = lambda t: t.encode().lower().split()
    sets = [frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) for w in (words(docs[i]) for i in ids)]
    near = [(a, b) for a in range(len(ids)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = union_find(len(ids), near)
    assert near
    first = {}
    for k, r in enumerate(root):
        first.setdefault(r, ids[k])
    docs = {i: docs[i] for i in first.values()}
    words = lambda t: re.sub("[^0-9a-z\x80-\U0010ffff]+", " ", t.lower() if t.isascii() else "".join(c.lower() if c < "\x80" else c for c in t)).split()
    tests = [words(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]

    def overlaps(w):
        """Equal less unequal words of the best stretch reach what the item needs, from a fit of a mask on."""
        at = collections.defaultdict(list)
        for k, x in enumerate(w):
            at[x].append(k)
        for t in tests:
            need = len(t) if len(t) < 10 else min(10, (len(t) + 1) // 2)
            for shift in {p - q for q, x in enumerate(t) for p in at[x]}:
                same = [0 <= q + shift < len(w) and w[q + shift] == t[q] for q in range(len(t))]
                run = best = 0
                for s in same:
                    run = max(0, run + (1 if s else -1))
                    best = max(best, run)
                if best >= need and any(all(same[q + i] for i, on in enumerate(m) if on == "1")
                                        for m in decontamination.MASKS for q in range(len(t) - len(m) + 1)):
                    return True
        return False
    docs = {i: t for i, t in docs.items() if not overlaps(words(t))}
    for i, t in docs.items():
        spans = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in base_spans(t))]
        out, at, end = "", 0, -1
        for s, e, k in spans:
            if s >= end:
                out, end = out + t[at:s] + f"[{k.upper()}]", e
            end = max(end, e)
            at = end
        docs[i] = out + t[at:]
    tok = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    want = {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t in docs.items()}
    rows = corpus_pipeline.run(spark, data).collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()), r.doc_id
    fits([(r.doc_id, r.piece, r.start, r.length, r.sequence_id, r.offset) for r in rows], {i: len(v) for i, v in want.items()}, 2048)


def test_equal_ids_do_not_remove_texts(spark):
    import corpus_pipeline
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(7, one), (7, two), (7, one), (9, one), (8, two + " more"), (None, one), (10, "short")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.deduplicated(spark, df, "").collect()), key=str)
    assert got == sorted([(7, one), (7, two), (None, one), (10, "short")], key=str)


def test_queries_have_their_columns(spark, data):
    want = {"op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op4": "page_id url text n_chars", "op8": "doc_id n_words n_removed kept_sha256"}
    for name, f in queries.QUERIES.items():
        if (key := name.split("_")[0]) in want:
            df = f(spark, data)
            assert df.columns[:len(want[key].split())] == want[key].split() and df.count() > 0
    r = queries.op2_pii(spark, data).filter("spans = ''").head()
    assert r.base_sha256 == hashlib.sha256(b"").hexdigest()
