"""Registered queries of the numbered operators: thin steps between the given tables and the operators."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, embedding_dedup, html_text, language, licences, packing, periodic_runs, pii, repeats, simhash, token_counts, top_k_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(spans, kind: str):
    return F.filter(spans, lambda s: s["kind"] == kind)


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(d, "doc_id", "text")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))
    counts = [F.size(_of(spans, k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("row.doc_id", *counts, F.sha2(pii.span_text(base).cast("binary"), 256).alias("base_sha256"), pii.span_text(spans).alias("spans"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    model = language.fit(d, "doc_id", "text", "lang")
    return language.identify(d, model, "doc_id", "text").select("doc_id", language.is_held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_sequences(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_windows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.main_text(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return text.withColumn("n_chars", F.length("text").cast("long"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), "text", "lang")


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the texts, chosen by the hash of the id, repeat a stretch of themselves first."""
    h, words = F.crc32(F.col("doc_id").cast("string")), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    d = d.withColumn("words", F.when((F.col("h") % 10 == 0) & (F.trim(F.translate("text", "\t\n\x0b\x0c\r", " " * 5)) != ""), words))
    d = d.withColumn("n", F.size("words")).withColumn("a", F.col("g") % F.when(F.col("n") > 0, F.col("n")))
    d = d.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    stretch = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("CAST((n - a) div p + 1 AS INT)")))
    repeated = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(stretch, F.lit(1), F.col("n") - F.col("a")))
    d = d.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.periodic_runs(d, "doc_id", "text")
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
                        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search.top_by_score(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


ORACLE["op11_collocations"] = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m)),
f AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (2000000 * c.a) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:c.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda n: list_transform(range(1, m - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))))) AS phrase
        FROM cand WHERE m > 2) GROUP BY ALL)
SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS BIGINT) AS rank, b.phrase, CAST(a AS BIGINT) AS a,
       CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000
"""

ORACLE["op13_top_k"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS pos, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.pos, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.pos <> c.pos AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY pos ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY pos ORDER BY score DESC, vec_id) <= 20
"""
