"""Test-retest reliability of weekly features, by plain sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _complete(df: DataFrame, feature: str) -> Column:
    return F.col(f"{feature}_first").isNotNull() & F.col(f"{feature}_second").isNotNull()


def retest_correlation(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, r: Pearson's r of the log-normalised weeks over complete cases."""
    least = df.agg(*[F.min(F.when(_complete(df, f), F.col(f + s))).alias(f + s) for f in features for s in ("_first", "_second")]).first()

    def normal(f: str, s: str) -> Column:
        low = least[f + s]
        shift = float(abs(low) + 1) if low is not None and low <= 0 else 0.0
        return F.when(_complete(df, f), F.ln(F.col(f + s) + F.lit(shift)))

    wide = df.agg(*[F.corr(normal(f, "_first"), normal(f, "_second")).alias(f) for f in features])
    return wide.unpivot([], features, "feature", "r")


def icc2_1(df: DataFrame, features: list[str], least: int = 5) -> DataFrame:
    """feature, icc: two-way random, single-measure agreement of the two weeks; null
    for fewer than ``least`` complete subjects."""

    def icc(f: str) -> Column:
        ok = _complete(df, f)
        a, b = (F.when(ok, F.col(f + s).cast("double")) for s in ("_first", "_second"))
        n, sa, sb = F.count(a), F.sum(a), F.sum(b)
        grand = F.try_divide(sa + sb, 2 * n)
        squares = F.sum(a * a) + F.sum(b * b)
        rows = F.sum((a + b) * (a + b)) / 2 - 2 * n * grand * grand
        columns = F.try_divide(sa * sa + sb * sb, n) - 2 * n * grand * grand
        error = squares - 2 * n * grand * grand - rows - columns
        msr, msc, mse = F.try_divide(rows, n - 1), columns, F.try_divide(error, n - 1)
        return F.when(n >= least, F.try_divide(msr - mse, msr + mse + F.try_divide(2 * (msc - mse), n))).alias(f)

    return df.agg(*[icc(f) for f in features]).unpivot([], features, "feature", "icc")


def pair_columns(features: list[str]) -> list[str]:
    return reduce(lambda a, f: [*a, f"{f}_first", f"{f}_second"], features, [])
