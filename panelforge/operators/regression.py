"""Linear regression of portfolio returns on factor returns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .evaluation import YEAR


def factor_regression(
    returns: DataFrame, factors: DataFrame, columns: tuple[str, ...] = ("mktrf", "smb", "hml"), by: str | None = None,
    periods: int = YEAR,
) -> DataFrame:
    """Least squares with an intercept, per portfolio: term, coefficient, std_error, t_stat, annualised, r_squared, n_obs.

    Means and covariances are one aggregation over the joined dates; only that row per portfolio is solved. Dates with
    a missing value are left out. ``annualised`` is filled for the intercept. Terms are null if the system is singular.
    """
    terms = ["ret", *columns]
    joined = returns.join(factors.select("dt", *columns), "dt")
    for c in terms:
        joined = joined.where(F.col(c).isNotNull())
    means = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(terms)]
    covs = [F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if j >= i]
    moments = joined.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("n"), *means, *covs)
    fields = ["term string", "coefficient double", "std_error double", "t_stat double", "annualised double",
              "r_squared double", "n_obs bigint"]
    if by:
        fields.insert(0, f"{by} string")
    return moments.mapInPandas(lambda parts: _solve(parts, columns, by, periods), ", ".join(fields))


def _solve(parts: Iterator[pd.DataFrame], columns: tuple[str, ...], by: str | None, periods: int):
    k = len(columns)
    for part in parts:
        rows = []
        for r in part.to_dict("records"):
            n = int(r["n"])
            line = {by: r[by]} if by else {}
            if n == 0:
                continue
            mean = np.array([r[f"m_{i}"] for i in range(k + 1)], dtype=float)
            cov = np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], dtype=float)
            coef = np.full(k + 1, np.nan)
            error, r2 = coef.copy(), np.nan
            size = np.sqrt(np.diag(cov)[1:])
            if n > k + 1 and (size > 0).all() and np.linalg.cond(cov[1:, 1:] / np.outer(size, size)) < 1e12:
                inverse = np.linalg.inv(cov[1:, 1:])
                slope = inverse @ cov[1:, 0]
                rss = max(n * (cov[0, 0] - slope @ cov[1:, 0]), 0.0)
                s2 = rss / (n - k - 1)
                coef = np.concatenate([[mean[0] - slope @ mean[1:]], slope])
                spread = np.concatenate([[1.0 + mean[1:] @ inverse @ mean[1:]], np.diag(inverse)]) / n
                error = np.sqrt(s2 * spread)
                r2 = 1.0 - rss / (n * cov[0, 0]) if cov[0, 0] > 0 else np.nan
            for i, term in enumerate(["intercept", *columns]):
                t = coef[i] / error[i] if error[i] > 0 else np.nan
                year = coef[i] * periods if i == 0 else np.nan
                rows.append({**line, "term": term, "coefficient": coef[i], "std_error": error[i], "t_stat": t,
                             "annualised": year, "r_squared": r2, "n_obs": n})
        names = ([by] if by else []) + ["term", "coefficient", "std_error", "t_stat", "annualised", "r_squared", "n_obs"]
        yield pd.DataFrame(rows, columns=names).astype({"n_obs": "int64"})
