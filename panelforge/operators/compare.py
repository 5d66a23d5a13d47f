"""Several strategies side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .evaluation import pairwise_correlation, signal_correlation
from .portfolio import returns_summary

__all__ = ["align_strategies", "strategy_correlation", "strategy_comparison", "signal_correlation", "stack"]


def stack(tables: dict[str, DataFrame], name: str = "strategy") -> DataFrame:
    """Union of tables with equal columns, labelled by strategy, so that one job serves all of them."""
    out = None
    for label, df in tables.items():
        part = df.withColumn(name, F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def align_strategies(returns: dict[str, DataFrame], base: str) -> DataFrame:
    """One row per date of the ``base`` strategy, one return column per strategy; other dates are left out."""
    return align_stacked(stack({n: df.select("dt", "ret") for n, df in returns.items()}), list(returns), base)


def align_stacked(returns: DataFrame, names: list[str], base: str) -> DataFrame:
    """Same from stacked returns (strategy, dt, ret): one aggregation instead of a join per strategy."""
    here = F.col("strategy") == base
    cells = [F.max(F.when(F.col("strategy") == n, F.col("ret"))).alias(n) for n in names]
    wide = returns.groupBy("dt").agg(F.max(here).alias("__base"), *cells)
    return wide.where("__base").drop("__base")


def strategy_correlation(aligned: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row with the correlation of each pair of return columns, ``a_vs_b``."""
    return pairwise_correlation(aligned, names or [c for c in aligned.columns if c != "dt"])


def strategy_comparison(returns: DataFrame) -> DataFrame:
    """Return summary per strategy of stacked returns."""
    return returns_summary(returns, by="strategy")
