"""Column expressions used by every layer. All of them stay in the JVM."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Declared operating parameters of the deployment test.
PI = 0.002                   # attack base rate
LAMBDA_B = 240_000.0         # benign flows per hour
DELTA = 0.10                 # largest allowed loss of balanced accuracy
R_MIN = 0.5                  # smallest recall
RHO = 0.1                    # smallest operational precision
A_MAX = 200.0                # most false alerts per hour
MIN_RECALL = 0.10            # reachability floor
WINDOWS_PER_UE_HOUR = 225    # 3600 s / 16 s windows
NORMAL_95 = 1.96


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    return as_col(c).cast("double")


def ratio(num, den) -> Column:
    """num / den, NULL when the denominator is 0."""
    return F.try_divide(dbl(num), dbl(den))


def ratio0(num, den) -> Column:
    """num / den, 0 when the denominator is 0."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def clip(c, lo=None, hi=None) -> Column:
    c = as_col(c)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def finite_or_zero(c) -> Column:
    c = as_col(c)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def nan_to_null(c) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def log1p_floor(c) -> Column:
    return F.log1p(F.greatest(dbl(c), F.lit(0.0)))


def signed_log1p(c) -> Column:
    c = dbl(c)
    return F.when(c >= 0, F.log1p(c)).otherwise(-F.log1p(-c))


def sigmoid(c) -> Column:
    return 1.0 / (1.0 + F.exp(-as_col(c)))


def odds(c) -> Column:
    c = as_col(c)
    return F.try_divide(c, 1.0 - c)


def logit(c) -> Column:
    return F.log(odds(c))


def same_tau(c, tau: float) -> Column:
    return F.abs(as_col(c) - F.lit(tau)) < 1e-9


def row_total(cols) -> Column:
    return reduce(lambda a, b: a + b, [as_col(c) for c in cols])


# ------------------------------------------------------------------ hashing
def hash_int(*parts) -> Column:
    """First 32 bits of the md5 of the parts joined by '|', as BIGINT."""
    key = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """A hash in [0, 1)."""
    return hash_int(*parts) / F.lit(4294967296.0)


def hash_normal(*parts) -> Column:
    """Standard normal by the Box-Muller rule on two hashes."""
    u1 = (hash_int(F.lit("n1"), *parts) + 1.0) / 4294967297.0
    u2 = hash_unit(F.lit("n2"), *parts)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)


# ------------------------------------------------------- rates and PPV
def recall(tp="tp", fn="fn") -> Column:
    return ratio(tp, as_col(tp) + as_col(fn))


def fpr(fp="fp", tn="tn") -> Column:
    return ratio(fp, as_col(fp) + as_col(tn))


def precision(tp="tp", fp="fp") -> Column:
    return ratio(tp, as_col(tp) + as_col(fp))


def ppv(tpr, fpr_, pi=PI) -> Column:
    """Bayes PPV, NULL at a zero denominator."""
    pi = F.lit(pi) if not isinstance(pi, Column) else pi
    num = as_col(tpr) * pi
    return F.try_divide(num, num + as_col(fpr_) * (1.0 - pi))


def balanced_accuracy(tp="tp", fp="fp", fn="fn", tn="tn") -> Column:
    return 0.5 * (recall(tp, fn) + ratio(tn, as_col(tn) + as_col(fp)))


def wilson(k, n, upper: bool, z: float = NORMAL_95) -> Column:
    """One end of the Wilson score interval, NULL for n <= 0."""
    k, n = dbl(k), dbl(n)
    n = F.when(n > 0, n)                       # NULL where there is nothing to divide by
    p = k / n
    d = 1.0 + z * z / n
    centre = p + z * z / (2.0 * n)
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n))
    end = F.least(F.lit(1.0), (centre + half) / d) if upper else \
        F.greatest(F.lit(0.0), (centre - half) / d)
    return F.when(n.isNotNull(), end)


def tri(lo, hi, bound: float, below: bool) -> Column:
    """pass / fail / inconclusive of one condition from its interval."""
    lo, hi = as_col(lo), as_col(hi)
    ok, bad = (hi <= bound, lo > bound) if below else (lo >= bound, hi < bound)
    return F.when(ok, "pass").when(bad, "fail").otherwise("inconclusive")


def combine(*outcomes) -> Column:
    cs = [as_col(o) for o in outcomes]
    any_fail = reduce(lambda a, b: a | b, [c == "fail" for c in cs])
    all_pass = reduce(lambda a, b: a & b, [c == "pass" for c in cs])
    return F.when(any_fail, "fail").when(all_pass, "pass").otherwise("inconclusive")


def pi_star(ppv_, pi: float = PI, rho: float = RHO) -> Column:
    """Prevalence at which the same likelihood ratio reaches precision rho."""
    p = as_col(ppv_)
    lr = F.try_divide(p, 1.0 - p) * ((1.0 - pi) / pi)
    o = F.try_divide(F.lit(rho / (1.0 - rho)), lr)
    return o / (1.0 + o)


def chance_macro_f1(prev) -> Column:
    """Macro-F1 of a fair coin at a prevalence."""
    p = as_col(prev)
    return (p / (p + 0.5) + (1.0 - p) / ((1.0 - p) + 0.5)) / 2.0


# ------------------------------------------------------------ byte fields
def ipv4_text(c) -> Column:
    c = as_col(c)
    octets = [F.shiftright(c, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)
