"""Analysis of measured latencies."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as O
from ..functions import scalars as S
from ..functions import statdist as D

# The budgets, in ms, and the terms of the decision loop.
BUDGETS_MS = [1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0]
LOOP_TERMS = ["t_ind_ms", "t_q_ms", "t_feat_ms", "t_inf_ms", "t_act_ms"]
LOOP_TERMS_ONE = ["t_ind_ms", "t_q_ms", "t_feat1_ms", "t_inf1_ms", "t_act_ms"]


def quantile_order_ci(df: DataFrame, col: str, qs: list[float], keys: list[str], conf: float = 0.95) -> DataFrame:
    """A45. Percentile (linear interpolation) with a binomial order-statistic interval.

    The group sizes give the ranks on the driver (one row per group, a result table); the
    order statistics are then read from the running counts of the values.
    """
    h = O.value_counts(df, col, keys)
    sizes = df.filter(F.col(col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    spec = []
    for n in sorted({r["n"] for r in sizes.select("n").distinct().collect()}):
        for q in qs:
            lo = D.binom_ppf((1 - conf) / 2, n, q)
            hi = D.binom_ppf(1 - (1 - conf) / 2, n, q)
            pos = q * (n - 1)
            spec.append((n, float(q), max(lo - 1, 0) + 1, min(hi, n - 1) + 1, int(pos) + 1,
                         min(int(pos) + 1, n - 1) + 1, pos - int(pos)))
    ranks = df.sparkSession.createDataFrame(spec, "n long, q double, r_lo long, r_hi long, r_a long, r_b long, frac double")
    s = h.join(sizes, keys).join(ranks, "n")

    def at(r: str) -> Column:
        return F.min(F.when(F.col("cum") >= F.col(r), F.col("value")))
    g = s.groupBy(*keys, "n", "q", "frac").agg(at("r_a").alias("_a"), at("r_b").alias("_b"),
                                               at("r_lo").alias("lo"), at("r_hi").alias("hi"))
    return g.select(*keys, "n", "q", (F.col("_a") + F.col("frac") * (F.col("_b") - F.col("_a"))).alias("est"), "lo", "hi")


def summarise(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """A45. n, mean and largest value."""
    return df.groupBy(*keys).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.max(col).alias("max"))


def budget_crossings(df: DataFrame, col: str, budgets: list[float] = BUDGETS_MS, out: str = "min_budget_ms") -> DataFrame:
    """A46. Smallest budget not below the value; NULL when none is."""
    b = F.array(*[F.lit(float(x)) for x in sorted(budgets)])
    return df.withColumn(out, F.array_min(F.filter(b, lambda x: x >= F.col(col))))


def parse_header(line: str | Column) -> dict[str, Column]:
    """A47. key=value pairs of a run's comment line as a map column."""
    c = S.as_col(line)
    keys = F.regexp_extract_all(c, F.lit(r"(\w+)=([-\d.e+]+)"), F.lit(1))
    vals = F.regexp_extract_all(c, F.lit(r"(\w+)=([-\d.e+]+)"), F.lit(2))
    return {"meta": F.map_from_arrays(keys, F.transform(vals, lambda v: v.cast("double")))}


def run_name(path: Column) -> tuple[Column, Column]:
    """A47. Model and period of a run file name."""
    pat = r"ric_(\w+?)_p(\d+)\.csv"
    return F.regexp_extract(path, pat, 1), F.regexp_extract(path, pat, 2).cast("int")


def loop_latency(df: DataFrame, keys: list[str], warmup: str = "warmup") -> DataFrame:
    """A47. Long table of the loop's terms and sums; warm-up and empty rows left out."""
    d = df.filter((F.col("seq") >= F.col(warmup)) & (F.col("n_ue") > 0))
    d = d.withColumn("e2e_all", S.row_total(LOOP_TERMS)).withColumn("e2e_one", S.row_total(LOOP_TERMS_ONE))
    terms = [c for c in dict.fromkeys([*LOOP_TERMS, *LOOP_TERMS_ONE, "e2e_one", "e2e_all"])]
    return d.select(*keys, F.explode(F.array(*[F.struct(F.lit(re.sub("_ms$", "", t)).alias("term"), S.dbl(t).alias("ms"))
                                               for t in terms])).alias("x")).select(*keys, "x.term", "x.ms")


def transport_share(long: DataFrame, keys: list[str]) -> DataFrame:
    """A47. Share of the loop spent in the two transport terms, from mean times."""
    m = long.groupBy(*keys).pivot("term", ["t_ind", "t_act", "e2e_all"]).agg(F.avg("ms"))
    return m.select(*keys, ((F.col("t_ind") + F.col("t_act")) / F.col("e2e_all")).alias("transport_share"))


def ecdf(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """A48. (rank - 0.5) / n. Equal values are one row with the range of their ranks."""
    h = O.value_counts(df, col, keys)
    return h.select(*keys, "value", F.col("c").alias("n"),
                    ((F.col("cum") - F.col("c") + 0.5) / F.col("cum_all")).alias("ecdf_first"),
                    ((F.col("cum") - 0.5) / F.col("cum_all")).alias("ecdf_last"))
