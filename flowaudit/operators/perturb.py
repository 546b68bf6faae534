"""Perturbations of a feature table for robustness runs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as O
from ..functions import scalars as S
from . import space as SP

# The grids, and the columns an attacker can only inflate.
EPS_GRID = [0.0, 0.01, 0.05, 0.10, 0.25, 0.50]
POISON_GRID = [0.0, 0.01, 0.05, 0.10, 0.25]
ATTACKS = ["gaussian_noise", "missing_telemetry", "stale_telemetry", "scaling_attack",
           "evasion_unconstrained", "evasion_constrained"]
MONOTONE_UP = ["duration", "src_bytes", "src_pkts", "tot_pkts", "tot_bytes", "mean_pkt_size",
               "src_mean_pkt_size", "bytes_per_s", "pkts_per_s"]


def column_scale(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Sample sd per column, 0 counted as 1; one aggregate of d numbers."""
    r = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    return {c: float(r[c] or 0.0) or 1.0 for c in cols}


def _put(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def gaussian_noise(df: DataFrame, scale: dict[str, float], eps: float, seed: str, row_id: str) -> DataFrame:
    """R1. Every row, every column: + N(0, eps·sd), from hashes so that a retry repeats it."""
    return _put(df, {c: F.col(c) + S.hash_normal(F.lit(seed), F.lit(c), row_id) * (eps * s) for c, s in scale.items()})


def missing_telemetry(df: DataFrame, cols: list[str], eps: float, seed: str) -> DataFrame:
    """R2. max(1, round(eps·d)) columns are set to 0."""
    import hashlib
    k = max(1, round(eps * len(cols)))
    order = sorted(cols, key=lambda c: hashlib.md5(f"{seed}|{c}".encode()).hexdigest()[:8])
    return _put(df, {c: F.lit(0.0) for c in order[:k]})


def stale_telemetry(df: DataFrame, cols: list[str], eps: float, seed: str, row_id: str, order: list[str],
                    bucket: Column | None = None) -> DataFrame:
    """R3, W18. max(1, round(eps·n)) rows take the previous row's vector; the first stays.

    `bucket` cuts the row order into ranges for the lag; by default at the quantiles of the
    first order column. Rows are picked before they are put in order, so that the ordered rows are
    made once; `df` itself is read several times.
    """
    k = F.greatest(F.bround(F.col("_all") * eps).cast("long"), F.lit(1))
    hit = O.first_n_by_hash(df, S.hash_int(F.lit(seed), row_id), [row_id], k, (), "_hit")
    d = hit.withColumn(O.BUCKET, bucket) if bucket is not None else O.quantile_buckets(hit, order[0], of=df)
    d = O.previous(d, order, cols)
    new = {c: F.when(F.col("_hit") & F.col(f"_prev_{c}").isNotNull(), F.col(f"_prev_{c}")).otherwise(F.col(c)) for c in cols}
    return _put(d, new).drop("_hit", O.BUCKET, *[f"_prev_{c}" for c in cols])


def scaling_attack(df: DataFrame, eps: float, y: str = "y", col: str = "tot_bytes") -> DataFrame:
    """R4. Attack rows: col × (1 + eps)."""
    return df.withColumn(col, F.when(F.col(y) == 1, F.col(col) * (1.0 + eps)).otherwise(F.col(col)))


def evasion(df: DataFrame, scale: dict[str, float], eps: float, seed: str, row_id: str, constrained: bool,
            y: str = "y") -> DataFrame:
    """R5, R6. Attack rows: ± U(eps·sd) on all columns, or + U(0, eps·sd) on the monotone ones."""
    new = {}
    for c, s in scale.items():
        u = S.hash_unit(F.lit(seed), F.lit(c), row_id)
        if constrained and c not in MONOTONE_UP:
            continue
        step = u * (eps * s) if constrained else (2.0 * u - 1.0) * (eps * s)
        new[c] = F.when(F.col(y) == 1, F.col(c) + step).otherwise(F.col(c))
    return _put(df, new)


def attack(df: DataFrame, name: str, eps: float, seed: int, row_id: str, cols: list[str] | None = None,
           scale: dict[str, float] | None = None, order: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """One named perturbation of the shared space; eps 0 leaves the table as it is."""
    if eps == 0.0 or name == "clean":
        return df
    cols = cols or [c for c in SP.SHARED_COLUMNS if c not in SP.PROTO_COLUMNS]
    key = f"{name}{seed}"
    if name == "missing_telemetry":
        return missing_telemetry(df, cols, eps, key)
    if name == "stale_telemetry":
        return stale_telemetry(df, [c for c in df.columns if c in SP.SHARED_COLUMNS or c in cols], eps, key, row_id,
                               order or [row_id], bucket)
    if name == "scaling_attack":
        return scaling_attack(df, eps)
    scale = scale or column_scale(df, cols)
    if name == "gaussian_noise":
        return gaussian_noise(df, scale, eps, key, row_id)
    if name in ("evasion_unconstrained", "evasion_constrained"):
        return evasion(df, scale, eps, key, row_id, name == "evasion_constrained")
    raise ValueError(f"unknown attack {name!r}")


def poison_labels(df: DataFrame, rate: float, seed: str, row_id: str, y: str = "y") -> DataFrame:
    """R7. Flip round(rate·n) labels."""
    k = F.bround(F.col("_all") * rate)
    d = O.first_n_by_hash(df, S.hash_int(F.lit(seed), row_id), [row_id], k, (), "_flip")
    return d.withColumn(y, F.when(F.col("_flip"), 1 - F.col(y)).otherwise(F.col(y))).drop("_flip")


def robustness_deltas(runs: DataFrame, keys: list[str]) -> DataFrame:
    """R8. Drop of F1 and recall, rise of FPR, and alerts against the unperturbed run of the key."""
    w = Window.partitionBy(*keys)
    base = lambda c: F.max(F.when(F.col("eps") == 0.0, F.col(c))).over(w)            # noqa: E731
    la = S.LAMBDA_B * S.PI / (1.0 - S.PI)
    d = runs.select("*", (base("f1_macro") - F.col("f1_macro")).alias("f1_drop"),
                    (base("recall") - F.col("recall")).alias("recall_drop"),
                    (F.col("fpr") - base("fpr")).alias("fpr_rise"),
                    (F.col("fpr") * S.LAMBDA_B).alias("false_alerts_per_hour"),
                    (F.col("recall") * la + F.col("fpr") * S.LAMBDA_B).alias("alerts_per_hour"))
    return d.withColumn("ppv_deploy", F.try_divide(F.col("recall") * la, F.col("alerts_per_hour")))
