"""Registered queries: a callable (spark, sf_dir) -> DataFrame and, where SQL can say it, its SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def r6(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for a comparison across engines; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


# ----------------------------------------------------------- SQL fragments
def h(expr: str) -> str:
    """First 32 bits of an md5."""
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def u(expr: str) -> str:
    return f"({h(expr)} / 4294967296e0)"


LI = """li AS (
  SELECT l.*, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * 100 + 0.5e0)::BIGINT) AS row_id,
         (l_returnflag = 'R')::INT AS y, l_suppkey::VARCHAR AS grp,
         CASE WHEN l_returnflag = 'R' THEN 'attack_' || l_linenumber::VARCHAR ELSE 'benign' END AS category,
         (year(l_shipdate) - 1994)::INT AS "file",
         (l_returnflag <> 'R' AND l_tax = 0.08e0 AND l_discount = 0.1e0) AS is_copy
  FROM lineitem l)"""

SCORES = LI + f""",
seeds AS (SELECT unnest([101, 102, 103, 104])::INT AS split_seed),
models AS (SELECT * FROM (VALUES ('linear', 0, 0.35e0), ('boost', 1, 0.5e0), ('net', 2, 0.65e0)) t(model, i, k0)),
raw AS (
  SELECT model, split_seed, CASE WHEN l_linestatus = 'O' THEN 'source_heldout' ELSE 'target' END AS "domain",
         row_id, y, category, grp, "file", is_copy,
         ('0x' || substr(md5(row_id), 1 + 8 * i, 8))::BIGINT / 4294967296e0 AS u,
         CASE WHEN l_linestatus = 'O' THEN k0 ELSE k0 * 0.5e0 END AS k
  FROM li, seeds, models
  WHERE l_linestatus <> 'O' OR {u("'held' || split_seed || '|' || grp")} < 0.2e0),
scores AS (
  SELECT model, split_seed, "domain", row_id, y, category, grp, "file", is_copy,
         least(floor((k * y + (1.0e0 - k) * u + ((split_seed * 37) % 11) * 0.004e0) * 10000.0e0) / 10000.0e0, 1.0e0) AS score
  FROM raw)"""

GRID = "[" + ", ".join(f"{t}e0" for t in
                       [round(0.05 * i, 4) for i in range(1, 20)] + [0.975, 0.99, 0.995, 0.999]) + "]"


def counts_sql(keys: str, source: str = "scores", grid: str = GRID, name: str = "counts") -> str:
    return f"""{name} AS (
  SELECT {keys}, tau, count(*) FILTER (WHERE y = 1 AND score >= tau) AS tp,
         count(*) FILTER (WHERE y = 0 AND score >= tau) AS fp,
         count(*) FILTER (WHERE y = 1 AND score < tau) AS fn, count(*) FILTER (WHERE y = 0 AND score < tau) AS tn
  FROM {source}, (SELECT unnest({grid}) AS tau) g GROUP BY {keys}, tau)"""


def pooled_sql(keys: str, source: str = "counts", name: str = "pooled") -> str:
    return f"""{name}0 AS (
  SELECT {keys}, tau, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn
  FROM {source} GROUP BY {keys}, tau),
{name} AS (
  SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS tpr, fp / nullif(fp + tn, 0)::DOUBLE AS fpr,
         tp / nullif(tp + fp, 0)::DOUBLE AS corpus_precision,
         {wilson_sql('fp', '(fp + tn)', False)} AS fpr_lo, {wilson_sql('fp', '(fp + tn)', True)} AS fpr_hi,
         {wilson_sql('tp', '(tp + fn)', False)} AS tpr_lo, {wilson_sql('tp', '(tp + fn)', True)} AS tpr_hi
  FROM {name}0)"""


def wilson_sql(k: str, n: str, upper: bool) -> str:
    p = f"({k} / {n}::DOUBLE)"
    z2 = "(1.96e0 * 1.96e0)"
    half = f"1.96e0 * sqrt({p} * (1 - {p}) / {n} + {z2} / (4e0 * {n} * {n}))"
    centre, d = f"({p} + {z2} / (2e0 * {n}))", f"(1 + {z2} / {n})"
    e = f"least(1e0, ({centre} + {half}) / {d})" if upper else f"greatest(0e0, ({centre} - {half}) / {d})"
    return f"CASE WHEN {n} > 0 THEN {e} END"


def ppv_sql(tpr: str, fpr: str, pi: str = "0.002e0") -> str:
    return f"({tpr} * {pi} / nullif({tpr} * {pi} + {fpr} * (1e0 - {pi}), 0))"


def ba_sql(p: str = "") -> str:
    return f"(0.5e0 * ({p}tp / nullif({p}tp + {p}fn, 0)::DOUBLE + {p}tn / nullif({p}tn + {p}fp, 0)::DOUBLE))"
