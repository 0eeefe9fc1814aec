"""Null-safe numeric expressions.

Every expression here stays inside code generation and never raises under ANSI mode: a zero
denominator or a constant series gives NULL.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """NaN and infinities become NULL, so aggregates skip them."""
    c = col(value)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def clean_doubles(df: DataFrame) -> DataFrame:
    """Apply :func:`finite` to every floating column of a scan."""
    return df.select(
        *[
            finite(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """top / bottom as a double, NULL on a zero denominator."""
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def moments(x: str, y: str) -> list[Column]:
    """The six pooled sums a correlation or a line needs, over rows where both are present."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return [
        F.count(F.when(both, F.lit(1))).alias("n"),
        F.sum(a).alias("sx"),
        F.sum(b).alias("sy"),
        F.sum(a * a).alias("sxx"),
        F.sum(b * b).alias("syy"),
        F.sum(a * b).alias("sxy"),
    ]


def corr_from_moments(n="n", sx="sx", sy="sy", sxx="sxx", syy="syy", sxy="sxy", tolerance: float = 1e-9) -> Column:
    """Pearson r from pooled sums; NULL when either side is constant to within rounding."""
    n, sx, sy, sxx, syy, sxy = (col(v).cast("double") for v in (n, sx, sy, sxx, syy, sxy))
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    ok = (n > 1) & (vx > tolerance * F.greatest(sxx, F.lit(1e-300))) & (vy > tolerance * F.greatest(syy, F.lit(1e-300)))
    r = F.try_divide(sxy - sx * sy / n, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0))))
    return F.when(ok, r)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Aggregate Pearson r over complete pairs, NULL for a constant side."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    small_a, small_b = 1e-9 * F.max(F.abs(a)), 1e-9 * F.max(F.abs(b))
    return F.when((sa > small_a) & (sb > small_b), F.try_divide(F.covar_pop(a, b), sa * sb))


def wrap_angle(angle: Column) -> Column:
    """Angle in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def heading_of(dy: Column, dx: Column) -> Column:
    """Angle of a step by the C library, as the SQL answers take it. The JVM's may differ in the last bit, which is what gives the
    difference of two opposite headings its sign."""

    @F.pandas_udf("double")
    def angle(y: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([math.atan2(a, b) for a, b in zip(y, x)], dtype="float64")

    return angle(dy, dx)


def circular_gap(a: Column, b: Column) -> Column:
    """Signed shortest difference of two phases in cycles, in [-0.5, 0.5)."""
    return F.pmod(a - b + F.lit(0.5), F.lit(1.0)) - F.lit(0.5)


def normal_upper(z: Column) -> Column:
    """P(Z > z) for z >= 0 by the published Abramowitz-Stegun 7.1.26 polynomial."""
    x = z / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    # fixed values: coefficients of the published approximation
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.lit(0.5) * poly * F.exp(-x * x)


NORMAL_UPPER_SQL = (
    "(0.5 * (1.0/(1.0+0.3275911*({z})/sqrt(2.0))) * (0.254829592 + (1.0/(1.0+0.3275911*({z})/sqrt(2.0))) * "
    "(-0.284496736 + (1.0/(1.0+0.3275911*({z})/sqrt(2.0))) * (1.421413741 + (1.0/(1.0+0.3275911*({z})/sqrt(2.0))) * "
    "(-1.453152027 + (1.0/(1.0+0.3275911*({z})/sqrt(2.0))) * 1.061405429)))) * exp(-({z})*({z})/2.0))"
)


def student_two_sided(t: Column, freedom: Column) -> Column:
    """P(|T| > |t|) for a whole number of degrees of freedom, by the finite trigonometric sum; NULL below one degree.

    Beyond 4,000,000 degrees, where the sum would be long, the normal distribution with the usual correction of t stands in.
    """
    v = freedom.cast("double")
    c2, odd = v / (v + t * t), freedom % 2 == 1
    sine = F.abs(t) / F.sqrt(v + t * t)
    terms = F.when(odd, (freedom - 1) / 2).otherwise(freedom / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        factor = F.when(odd, (2.0 * k) / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k))
        return F.struct((acc["term"] * factor * c2).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, step, lambda acc: acc["sum"])
    inside = F.when(odd, (F.asin(sine) + sine * F.sqrt(c2) * total) * (2 / math.pi)).otherwise(sine * total)
    z = F.abs(t) * (1 - 1 / (4 * v)) / F.sqrt(1 + t * t / (2 * v))
    far = F.when(freedom > 4_000_000, 2 * normal_upper(z)).otherwise(F.greatest(1.0 - inside, F.lit(0.0)))
    return F.when(freedom >= 1, F.when(F.abs(t) == float("inf"), F.lit(0.0)).otherwise(far))


def student_two_sided_sql(t: str, freedom: str) -> str:
    """The same in SQL, its terms by the gamma function."""
    c2 = f"({freedom}/({freedom}+({t})*({t})))"
    odd = f"list_sum(list_transform(range(CAST(({freedom}-1)//2 AS BIGINT)), lambda k: exp(lgamma(k+1.0)+lgamma(1.5)-lgamma(k+1.5)+k*ln({c2}))))"
    even = f"list_sum(list_transform(range(CAST({freedom}//2 AS BIGINT)), lambda k: exp(lgamma(k+0.5)-lgamma(0.5)-lgamma(k+1.0)+k*ln({c2}))))"
    sine = f"(abs({t})/sqrt({freedom}+({t})*({t})))"
    inside = f"CASE WHEN {freedom}%2=1 THEN (asin({sine})+{sine}*sqrt({c2})*coalesce({odd},0))*2/pi() ELSE {sine}*{even} END"
    return f"CASE WHEN {freedom}>=1 THEN CASE WHEN isinf({t}) THEN 0.0 ELSE greatest(1.0-({inside}),0.0) END END"


def rank_p_value(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation of n pairs, by Student's t with n - 2 degrees."""
    freedom = (n - 2).cast("long")
    left = F.greatest((1.0 - rho) * (1.0 + rho), F.lit(0.0))
    t = F.when(left == 0.0, F.lit(float("inf"))).otherwise(rho * F.sqrt(freedom / left))
    return F.when(rho.isNotNull(), student_two_sided(t, freedom))


def rank_p_value_sql(rho: str, n: str) -> str:
    t = f"(CASE WHEN (1.0-{rho})*(1.0+{rho})<=0 THEN CAST('inf' AS DOUBLE) ELSE {rho}*sqrt(({n}-2)/((1.0-{rho})*(1.0+{rho}))) END)"
    return f"CASE WHEN {rho} IS NOT NULL THEN {student_two_sided_sql(t, f'({n}-2)')} END"


def round_doubles(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round floating columns for display; adding 0.0 removes the sign of a negative zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`").cast("double"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
