"""The research steps end to end: write a signal, write its weights, report on both.

Steps meet in Parquet tables, so each reads only what it needs and a lost executor costs a task, not the run. Reports
are dictionaries of DataFrames; nothing is rendered.
"""

from __future__ import annotations

import datetime as dtm

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import compare, crosssection as cs, evaluation as ev, portfolio as pf
from ..operators.regression import factor_regression
from ..sources.panel import (
    check_contract, read_table, replace_table, require_columns, require_rows, require_unique_key, with_contract, write_by_year,
)
from ..sources.staging import staged
from . import signals
from .sizing import by_series, panel_size, span_days


def _ordered(report: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables in reading order. Each holds at most a row per date and portfolio, so the sort is small."""
    keys = ("strategy", "quantile", "dt", "bin")
    out = {}
    for name, df in report.items():
        by = [k for k in keys if k in df.columns]
        out[name] = df.orderBy(*by) if by else df
    return out


def create_signal(
    kind: str, path: str, assets: DataFrame, exposures: DataFrame | None = None, factors: DataFrame | None = None,
    columns: list[str] | None = None, **options,
) -> DataFrame:
    """Write the ``standard``, ``idiosyncratic`` or ``industry`` signal to ``path``, replacing it, and read it back.

    Two rows of an asset on one date raise: lags and rolling sums count rows. An empty panel and a null asset or date
    raise, too. All of it is counted by the jobs that make the signal, and a refused signal leaves the old one in place.
    The series are dealt to tasks by ``max_rows``, a bound of the rows of ``assets`` (and ``exposures``), measured if not
    given; with 0 they are left as they are, for a panel stored by series.
    """
    require_columns(assets, "asset", "dt")
    rows = options.pop("max_rows", None)
    if rows is None or not options.get("max_dates"):
        days, found = panel_size(assets)
        if rows is None:
            rows = found if exposures is None else max(found, exposures.count())
        options["max_dates"] = options.get("max_dates") or max(days, span_days(factors) if factors is not None else 0)
    assets, seen = with_contract(by_series(assets, rows), "asset", "dt")
    if kind == "standard":
        signal = signals.standard_momentum(assets, **options)
    elif kind == "idiosyncratic":
        signal = signals.idiosyncratic_momentum(assets, **options)
    elif kind == "industry":
        if exposures is None or factors is None or not columns:
            raise ValueError("the industry signal needs exposures, factors and the industry columns")
        signal = signals.industry_momentum(assets, exposures, factors, columns, max_rows=rows, **options)
    else:
        raise ValueError(f"unknown signal {kind!r}")
    replace_table(signal, path, lambda: check_contract(seen.get, "the panel", ("asset", "dt")))
    return read_table(assets.sparkSession, path)


def run_backtest(
    spark: SparkSession, signal_path: str, weights_path: str, gamma: float = 591.0,
    constraints: list[str] | tuple[str, ...] = (),
) -> DataFrame:
    """Mean-variance weights of a written signal, one folder per year. A missing signal raises; run create_signal."""
    signal = read_table(spark, signal_path)
    require_columns(signal, "dt", "asset", "alpha", "specific_risk")
    require_unique_key(require_rows(signal, "signal"), "asset", "dt")
    write_by_year(pf.mv_weights(signal, gamma, constraints, span_days(signal)), weights_path)
    return read_table(spark, weights_path)


def signal_report(
    spark: SparkSession, signal_path: str, mode: str = "full", cutoff: dtm.date = ev.CUTOFF, n_quantiles: int = 5,
    factors: DataFrame | None = None, horizon: int = 1, returns: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Equal-weight evaluation of a written signal (dt, asset, signal, alpha, ret).

    ``returns`` (dt, asset, ret as a fraction) is the whole panel that the return ahead is read from.
    """
    signal = read_table(spark, signal_path).where(F.col("alpha").isNotNull())
    require_columns(signal, "dt", "asset", "signal", "alpha", "ret")
    require_rows(signal, "signal")
    signal = ev.sample_split(signal, mode, cutoff)
    quantiles = staged(ev.quantile_portfolios(signal, n_quantiles, horizon=horizon, returns=returns))
    long = ev.portfolios_long(quantiles)
    metrics = ev.portfolio_metrics(long)
    report = {
        "sample": ev.sample_summary(signal),
        "stats": ev.signal_stats(signal),
        "histogram": ev.signal_histogram(signal),
        "quantiles": quantiles,
        "cumulative": ev.cumulative_log_return(long),
        "metrics": metrics,
        "headline": ev.spread_headline(metrics, ev.rank_ic(signal, returns, horizon)),
    }
    if factors is not None:
        report["regression"] = factor_regression(long, factors, by="quantile")
    return _ordered(report)


def portfolio_report(
    spark: SparkSession, weights_path: str, signal_path: str, returns: DataFrame, mode: str = "full",
    cutoff: dtm.date = ev.CUTOFF, factors: DataFrame | None = None, horizon: int = 1,
) -> dict[str, DataFrame]:
    """Evaluation of written weights. ``returns``: dt, asset, ret (fraction)."""
    weights = require_rows(require_columns(read_table(spark, weights_path), "dt", "asset", "weight"), "weights")
    signal = require_rows(require_columns(read_table(spark, signal_path), "dt", "asset", "alpha", "ret"), "signal")
    weights = ev.sample_split(weights, mode, cutoff)
    signal = ev.sample_split(signal, mode, cutoff)
    made = staged(pf.portfolio_returns(weights, returns))
    levered, dips = pf.leverage(weights), pf.drawdown(made)
    ics = staged(ev.rank_ic(signal, returns, horizon))
    report = {
        "sample": ev.sample_summary(weights),
        "returns": made,
        "summary": pf.returns_summary(made),
        "cumulative": ev.cumulative_log_return(made.withColumn("strategy", F.lit("portfolio")), "strategy"),
        "drawdown": dips,
        "drawdown_summary": pf.drawdown_summary(dips),
        "leverage": levered,
        "leverage_summary": pf.leverage_summary(levered),
        "turnover": pf.turnover(weights),
        "turnover_summary": pf.turnover_summary(weights),
        "ic": ev.cumulative_ic(ics),
        "ic_summary": ev.ic_summary(ics),
    }
    if factors is not None:
        report["regression"] = factor_regression(made, factors)
    return _ordered(report)


def strategy_report(
    spark: SparkSession, weights_paths: dict[str, str], returns: DataFrame, base: str | None = None, digits: int = 2,
) -> dict[str, DataFrame]:
    """Returns of several written strategies side by side, their correlations (rounded) and summaries."""
    columns = ["dt", "asset", "weight"]
    weights = compare.stack({n: read_table(spark, p).select(*columns) for n, p in weights_paths.items()})
    made = staged(pf.portfolio_returns(weights, returns, "strategy"))
    names = list(weights_paths)
    aligned = compare.align_stacked(made, names, base or names[0])
    found = compare.strategy_correlation(aligned, names)
    return _ordered({
        "aligned": aligned,
        "correlation": found.select(*[F.round(c, digits).alias(c) for c in found.columns]),
        "comparison": compare.strategy_comparison(made),
    })


def percent_returns(assets: DataFrame) -> DataFrame:
    """dt, asset, ret as a fraction, from a panel in percent."""
    return cs.to_fraction(assets.select("dt", "asset", "ret"), "ret")
