"""One query per operator, each over the whole test tables."""

from __future__ import annotations

import datetime as dtm
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions import drop_null_rows
from panelforge.operators import compare, crosssection as cs, evaluation as ev, portfolio as pf, risk, series
from panelforge.operators.regression import factor_regression
from panelforge.plans import signals, workflow
from panelforge.plans.sizing import by_series, series_parts
from panelforge.sources import panel as tables, staged, standin
from panelforge.sources.staging import scratch_folder

BOTH = ("ZeroInvestment", "ZeroBeta")
STRATEGIES = ("standard", "industry", "idiosyncratic")
START, END = dtm.date(1996, 1, 1), dtm.date(2000, 12, 31)
SAMPLE_END = dtm.date(1999, 6, 30)
RISK = ("ret", "price", "specific_risk", "predicted_beta")

Query = Callable[[SparkSession, str], DataFrame]


def shown(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Rounded values and text dates, so that both engines print the same rows. ``other`` sets digits by column."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            rounded = F.round(c, other.get(name, digits))
            c = F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(name))
    return df.select(*out)


_folder = scratch_folder


# --- panels -----------------------------------------------------------------------------------------------------

def _assets(spark, sf, columns=RISK, **kw):
    return standin.assets(spark, sf, columns, **kw)


def _dealt(spark, sf, panel):
    """A panel whose series are dealt to tasks by the number of lines, for the windows over them."""
    return by_series(panel, standin.line_count(spark, sf))


def _standard(spark, sf, assets=None, days=None, rows=None):
    """``rows`` is 0 for a panel that is stored by series."""
    days, rows = days or standin.span(spark, sf), standin.line_count(spark, sf) if rows is None else rows
    return signals.standard_momentum(_assets(spark, sf) if assets is None else assets, max_dates=days, max_rows=rows)


def _idiosyncratic(spark, sf, assets=None, days=None):
    days = days or standin.span(spark, sf)
    if assets is None:
        assets = _assets(spark, sf, (*RISK, "specific_return"), max_dates=days)
    return signals.idiosyncratic_momentum(assets, max_dates=days, max_rows=standin.line_count(spark, sf))


def _industry(spark, sf, assets=None, days=None, all_zero="score_zero"):
    days = days or standin.span(spark, sf)
    return signals.industry_momentum(
        _assets(spark, sf) if assets is None else assets, standin.exposures(spark, sf),
        standin.factors(spark, sf), standin.INDUSTRIES, all_zero, max_dates=days, max_rows=standin.line_count(spark, sf),
    )


def _industry_drop(spark, sf):
    return _industry(spark, sf, all_zero="drop")


def _alphas(signal):
    return signal.where(F.col("alpha").isNotNull())


def _signal(spark, sf, days=None):
    """The signal the evaluation reads, without the rows that have no alpha."""
    return _alphas(_standard(spark, sf, days=days))


def _signal_table(spark, sf):
    """The same as a written table, for evaluations that pass over it several times."""
    return _alphas(staged(_standard(spark, sf)))


def _weights(spark, sf, constraints=BOTH):
    days = standin.span(spark, sf)
    return pf.mv_weights(_signal(spark, sf, days), 591, constraints, days)


def _returns(spark, sf):
    return cs.to_fraction(_assets(spark, sf, ("ret",)), "ret")


def _all_signals(spark, sf):
    """The three signals from one panel, which ``assets`` writes once. Each signal is read from its own written table."""
    days = standin.span(spark, sf)
    panel = _assets(spark, sf, (*RISK, "specific_return"), max_dates=days)
    made = {"standard": _standard, "industry": _industry, "idiosyncratic": _idiosyncratic}
    return {n: _alphas(make(spark, sf, panel, days)) for n, make in made.items()}, panel, days


def _strategy_returns(spark, sf):
    """Portfolio returns of the three strategies, stacked."""
    found, panel, days = _all_signals(spark, sf)
    stacked = compare.stack({n: pf.mv_weights(s, 591, BOTH, days) for n, s in found.items()})
    return pf.portfolio_returns(stacked, cs.to_fraction(panel.select("dt", "asset", "ret"), "ret"), "strategy")


def _portfolio(spark, sf):
    return pf.portfolio_returns(_weights(spark, sf), _returns(spark, sf))


def _scored(spark, sf):
    """The signal and the returns of the whole panel, both from one written panel."""
    panel, days = staged(_assets(spark, sf)), standin.span(spark, sf)
    returns = cs.to_fraction(panel.select("dt", "asset", "ret"), "ret")
    return _alphas(_standard(spark, sf, panel, days)), _dealt(spark, sf, returns)


def _quantiles(spark, sf):
    signal, returns = _scored(spark, sf)
    return ev.quantile_portfolios(signal, 5, returns=returns)


def _ics(spark, sf):
    return ev.rank_ic(*_scored(spark, sf))


def _fraction_panel(spark, sf):
    return _dealt(spark, sf, _returns(spark, sf))


# --- queries ----------------------------------------------------------------------------------------------------

def load_panel(spark, sf):
    return shown(cs.to_fraction(_assets(spark, sf, ("ret", "price"), start=START, end=END), "ret"), 10, price=12)


def exposures_wide(spark, sf):
    return shown(standin.exposures(spark, sf))


def factors_wide(spark, sf):
    return shown(standin.factors(spark, sf))


def _normalised(all_zero):
    def query(spark, sf):
        return shown(cs.normalise_exposures(standin.exposures(spark, sf), standin.INDUSTRIES, all_zero))
    return query


def factors_long(spark, sf):
    return shown(cs.unpivot(standin.factors(spark, sf), ["dt"], standin.INDUSTRIES, "industry", "ret"))


def drop_nulls_wide(spark, sf):
    return shown(drop_null_rows(standin.factor_model(spark, sf)), 8)


def ewm_std_min22(spark, sf):
    panel = series.ewm_std(_fraction_panel(spark, sf), "asset", "dt", "ret", 22, 22, "vol")
    return shown(panel.select("asset", "dt", "vol"), 8)


def ewm_std_blocks(spark, sf):
    """Blocks of 64 rows, so that every series restarts many times."""
    panel = series.ewm_std(_fraction_panel(spark, sf), "asset", "dt", "ret", 22, 22, "vol", block_rows=64)
    return shown(panel.select("asset", "dt", "vol"), 8)


def ewm_std_min1(spark, sf):
    long = cs.unpivot(standin.factors(spark, sf), ["dt"], standin.INDUSTRIES, "industry", "ret")
    return shown(series.ewm_std(long, "industry", "dt", "ret", 22, 1, "vol").select("industry", "dt", "vol"))


def rolling_sum_230(spark, sf):
    panel = series.rolling_sum(_fraction_panel(spark, sf), "asset", "dt", "ret", 230, "total")
    return shown(panel.select("asset", "dt", "total"))


def lag_22(spark, sf):
    return shown(series.lag(_fraction_panel(spark, sf), "asset", "dt", "ret", 22, "ret_lag"))


def price_lag(spark, sf):
    return shown(cs.price_filter(cs.lagged_price(_dealt(spark, sf, _assets(spark, sf, ("price",))))), 12)


def vol_scaled_momentum(spark, sf):
    panel = series.vol_scaled_momentum(_fraction_panel(spark, sf), "asset", "dt", "ret")
    return shown(panel.select("asset", "dt", "scaled_ret", "momentum"))


def factor_momentum(spark, sf):
    found = signals.factor_momentum(standin.factors(spark, sf), standin.INDUSTRIES, standin.span(spark, sf))
    return shown(found.select("dt", "industry", "vol", "momentum"))


def cs_zscore(spark, sf):
    panel = staged(_assets(spark, sf, ("price",)))
    return shown(cs.cs_zscore(panel, "price", out="price_z", max_dates=standin.span(spark, sf)), 9, price=12)


def alpha(spark, sf):
    panel = staged(_assets(spark, sf, ("ret", "specific_risk")))
    scored = cs.to_alpha(cs.cs_zscore(panel, "ret", out="z", max_dates=standin.span(spark, sf)), "z")
    return shown(scored.select("asset", "dt", "signal", "alpha"), 8)


def project_exposures(spark, sf):
    days = standin.span(spark, sf)
    momentum = signals.factor_momentum(standin.factors(spark, sf), standin.INDUSTRIES, days)
    long = cs.normalise_exposures(standin.exposures(spark, sf), standin.INDUSTRIES)
    return shown(cs.project_exposures(long, momentum, days * len(standin.INDUSTRIES)))


def _whole_signal(make):
    def query(spark, sf):
        columns = ["asset", "dt", "ret", "price_lag", "momentum_zscore", "alpha", "signal"]
        return shown(make(spark, sf).select(*columns), 7, ret=9, alpha=6, price_lag=12)
    return query


def _sample(mode):
    def query(spark, sf):
        return shown(ev.sample_split(_signal(spark, sf), mode, SAMPLE_END).select("asset", "dt", "alpha", "ret"))
    return query


def sample_summary(spark, sf):
    return shown(ev.sample_summary(_signal(spark, sf)))


def signal_stats(spark, sf):
    return shown(ev.signal_stats(_signal_table(spark, sf)))


def signal_histogram(spark, sf):
    return shown(ev.signal_histogram(_signal_table(spark, sf)))


def quantile_portfolios(spark, sf):
    return shown(_quantiles(spark, sf), 10)


def portfolios_long(spark, sf):
    return shown(ev.portfolios_long(_quantiles(spark, sf)), 10)


def quantile_cumulative(spark, sf):
    return shown(ev.cumulative_log_return(ev.portfolios_long(_quantiles(spark, sf))))


def portfolio_metrics(spark, sf):
    return shown(ev.portfolio_metrics(ev.portfolios_long(_quantiles(spark, sf))))


def spread_headline(spark, sf):
    signal = _signal_table(spark, sf)
    metrics = ev.portfolio_metrics(ev.portfolios_long(ev.quantile_portfolios(signal, 5, returns=_fraction_panel(spark, sf))))
    return shown(ev.spread_headline(metrics, ev.rank_ic(signal, _fraction_panel(spark, sf))))


def rank_ic(spark, sf):
    return shown(_ics(spark, sf))


def rank_ic_joined(spark, sf):
    signal = _signal_table(spark, sf)
    returns = signal.where(F.col("ret").isNotNull()).select("dt", "asset", "ret")
    return shown(ev.rank_ic(signal.select("dt", "asset", "alpha"), returns, horizon=0))


def ic_summary(spark, sf):
    return shown(ev.ic_summary(_ics(spark, sf)))


def cumulative_ic(spark, sf):
    return shown(ev.cumulative_ic(_ics(spark, sf)))


def quantile_regression(spark, sf):
    long = ev.portfolios_long(_quantiles(spark, sf))
    return shown(factor_regression(long, standin.factor_model(spark, sf), by="quantile"), 12, r_squared=10, t_stat=8)


def mv_weights(spark, sf):
    return shown(_weights(spark, sf), 9)


def _weights_under(*constraints):
    def query(spark, sf):
        return shown(_weights(spark, sf, constraints), 9)
    return query


def _covariance(spark, sf):
    return risk.factor_covariance(standin.factors(spark, sf), standin.INDUSTRIES, 63, 60)


def factor_covariance(spark, sf):
    return shown(_covariance(spark, sf), 9)


def project_exposures_sparse(spark, sf):
    days = standin.span(spark, sf)
    momentum = signals.factor_momentum(standin.factors(spark, sf), standin.INDUSTRIES, days)
    sparse = cs.sparse_exposures(standin.exposures(spark, sf), standin.INDUSTRIES)
    return shown(cs.project_exposures_sparse(sparse, momentum, standin.INDUSTRIES, days))


def mv_weights_factor_risk(spark, sf):
    """Weights without net investment or beta under the covariance of the factors and the specific risks."""
    days = standin.span(spark, sf)
    sparse = cs.sparse_exposures(standin.exposures(spark, sf), standin.INDUSTRIES)
    found = risk.factor_risk_weights(_signal(spark, sf, days), sparse, _covariance(spark, sf), len(standin.INDUSTRIES), 591, BOTH, days)
    return shown(found, 9)


def mv_weights_bounded(spark, sf):
    """Long only, at most a fifth in one asset, fully invested."""
    days = standin.span(spark, sf)
    return shown(risk.bounded_weights(_signal(spark, sf, days), 0.05, 0.0, 0.2, 1.0, days), 9)


def portfolio_returns(spark, sf):
    return shown(_portfolio(spark, sf), 12)


def leverage(spark, sf):
    return shown(pf.leverage(_weights(spark, sf)), 9)


def leverage_summary(spark, sf):
    return shown(pf.leverage_summary(pf.leverage(_weights(spark, sf))), 9)


def drawdown(spark, sf):
    return shown(pf.drawdown(_portfolio(spark, sf)), 9)


def drawdown_summary(spark, sf):
    return shown(pf.drawdown_summary(pf.drawdown(_portfolio(spark, sf))), 9)


def returns_summary(spark, sf):
    return shown(pf.returns_summary(_portfolio(spark, sf)), 11)


def cumulative_return(spark, sf):
    returns = _portfolio(spark, sf).withColumn("strategy", F.lit("standard"))
    return shown(ev.cumulative_log_return(returns, "strategy"))


def turnover(spark, sf):
    return shown(pf.turnover(_weights(spark, sf)), 9)


def turnover_summary(spark, sf):
    return shown(pf.turnover_summary(_weights(spark, sf)), 9)


def portfolio_regression(spark, sf):
    return shown(factor_regression(_portfolio(spark, sf), standin.factor_model(spark, sf)), 12, r_squared=10, t_stat=8)


def align_strategies(spark, sf):
    return shown(compare.align_stacked(_strategy_returns(spark, sf), list(STRATEGIES), "standard"), 9)


def strategy_correlation(spark, sf):
    aligned = compare.align_stacked(_strategy_returns(spark, sf), list(STRATEGIES), "standard")
    return shown(compare.strategy_correlation(aligned))


def signal_correlation(spark, sf):
    return shown(compare.signal_correlation(_all_signals(spark, sf)[0]))


def strategy_comparison(spark, sf):
    return shown(compare.strategy_comparison(_strategy_returns(spark, sf)), 11)


# --- the same through ranges, files and total losses -----------------------------------------------------------------

def rank_ic_ranges(spark, sf):
    """Dates of more than 8 rows are ranked by value ranges."""
    return shown(ev.rank_ic(_signal_table(spark, sf), _fraction_panel(spark, sf), group_rows=8))


def quantile_portfolios_ranges(spark, sf):
    return shown(ev.quantile_portfolios(_signal_table(spark, sf), 5, group_rows=8, returns=_fraction_panel(spark, sf)), 10)


def signal_stats_ranges(spark, sf):
    """Quartiles from a coarse sketch, so that a fifth of the rows lies around each place."""
    return shown(ev.signal_stats(_signal_table(spark, sf), accuracy=20))


def universe_panel(spark, sf):
    """A written panel with a universe flag (a price floor), read back through the flag and the dates."""
    path = _folder(spark, "universe")
    tables.write_table(_assets(spark, sf, ("ret", "price")).withColumn("in_universe", F.col("price") > 13), path)
    return shown(tables.load_panel(spark, path, START, END, ["asset", "dt", "price"]), 12)


def glob_union(spark, sf):
    """Two tables read as one through a pattern."""
    path = _folder(spark, "parts")
    rows = _signal(spark, sf).select("asset", "dt", "alpha", "ret")
    for mode in ("in", "out"):
        tables.write_table(ev.sample_split(rows, mode, SAMPLE_END), f"{path}/part-{mode}")
    return shown(tables.read_table(spark, f"{path}/part-*"))


def weights_round_trip(spark, sf):
    """Weights written by year and read back as year files."""
    path = _folder(spark, "years")
    tables.write_by_year(_weights(spark, sf), path)
    return shown(tables.read_year_files(spark, path).select("dt", "asset", "weight"), 9)


def total_loss(spark, sf):
    """Each asset held at 12.5 times its return, which makes the worst return, -8 percent, a total loss.

    Total returns above 1 are shown as their decimal logarithm; they reach 10^11.
    """
    held = _fraction_panel(spark, sf).withColumn("ret", F.col("ret") * 12.5)
    falls = pf.drawdown_summary(pf.drawdown(held, "asset"), "asset")
    summary = pf.returns_summary(held, "asset").select("asset", "count", "mean_annual_return", "total_return")
    total = F.col("total_return")
    summary = summary.withColumn("total_return", F.when(total > 1, F.log10(total)).otherwise(total))
    return shown(summary.join(falls, "asset"), 9)


def contract_counts(spark, sf):
    """Rows, nulls and repeated keys of the panel, counted by the job that writes it."""
    panel, seen = tables.with_contract(_dealt(spark, sf, _assets(spark, sf)), "asset", "dt", RISK)
    tables.replace_table(panel, _folder(spark, "contract"))
    return spark.createDataFrame([tuple(seen.get.values())], ", ".join(f"{c} bigint" for c in seen.get))


def factor_gaps(spark, sf):
    """Nulls of the factor model's series and the rows whose window of 230 they break."""
    long = cs.unpivot(standin.factor_model(spark, sf), ["dt"], ["mktrf", "smb", "hml"], "factor", "ret")
    return series.series_gaps(long, "factor", "dt", "ret", 230)


def signal_replaced(spark, sf):
    """A signal written twice, the second time from itself, and read through its pointer."""
    path = _folder(spark, "replaced")
    tables.replace_table(_signal(spark, sf).select("asset", "dt", "alpha", "ret"), path)
    tables.replace_table(tables.read_table(spark, path).withColumn("alpha", -F.col("alpha")), path)
    return shown(tables.read_table(spark, path))


def stored_panel(spark, sf):
    """The standard signal of a panel that is stored by asset, so that its series need no exchange."""
    name = f"panel_{uuid.uuid4().hex}"
    buckets = max(8, series_parts(spark, standin.line_count(spark, sf)))
    panel = _assets(spark, sf, ("ret", "price", "specific_risk"))
    panel = tables.store_by_series(panel, name, _folder(spark, "by-series"), buckets)
    return _whole_signal(lambda spark, sf: _standard(spark, sf, panel, rows=0))(spark, sf)


def _written(spark, sf, *kinds):
    """Signals and weights of some strategies, each written and read by the research steps; their folders."""
    panel = _assets(spark, sf, (*RISK, "specific_return"), max_dates=standin.span(spark, sf))
    made = {}
    for kind in kinds:
        made[kind] = _folder(spark, f"signal-{kind}"), _folder(spark, f"weights-{kind}")
        workflow.create_signal(kind, made[kind][0], panel)
        workflow.run_backtest(spark, *made[kind], 591, BOTH)
    return made, workflow.percent_returns(panel)


def workflow_summary(spark, sf):
    """Panel to signal, weights and the report on them, through files."""
    made, returns = _written(spark, sf, "standard")
    signal, weights = made["standard"]
    return shown(workflow.portfolio_report(spark, weights, signal, returns)["summary"], 11)


def workflow_correlation(spark, sf):
    """The rounded correlation of two strategies, through files."""
    made, returns = _written(spark, sf, "standard", "idiosyncratic")
    return workflow.strategy_report(spark, {n: w for n, (_, w) in made.items()}, returns)["correlation"]


def build() -> dict[str, Query]:
    plain = [
        load_panel, exposures_wide, factors_wide, factors_long, drop_nulls_wide, ewm_std_min22, ewm_std_blocks, ewm_std_min1,
        rolling_sum_230, lag_22, price_lag, vol_scaled_momentum, factor_momentum, cs_zscore, alpha, project_exposures,
        sample_summary, signal_stats, signal_histogram, quantile_portfolios, portfolios_long, quantile_cumulative,
        portfolio_metrics, spread_headline, rank_ic, rank_ic_joined, ic_summary, cumulative_ic, quantile_regression,
        mv_weights, portfolio_returns, leverage, leverage_summary, drawdown, drawdown_summary, returns_summary,
        cumulative_return, turnover, turnover_summary, portfolio_regression, align_strategies, strategy_correlation,
        signal_correlation, strategy_comparison, rank_ic_ranges, quantile_portfolios_ranges, signal_stats_ranges,
        universe_panel, glob_union, weights_round_trip, total_loss, factor_covariance, project_exposures_sparse,
        mv_weights_factor_risk, mv_weights_bounded, contract_counts, factor_gaps, signal_replaced, stored_panel, workflow_summary,
        workflow_correlation,
    ]
    found = {f.__name__: f for f in plain}
    found.update({
        "normalise_exposures_zero": _normalised("score_zero"),
        "normalise_exposures_drop": _normalised("drop"),
        "standard_momentum": _whole_signal(_standard),
        "idiosyncratic_momentum": _whole_signal(_idiosyncratic),
        "industry_momentum": _whole_signal(_industry),
        "industry_momentum_drop": _whole_signal(_industry_drop),
        "sample_in": _sample("in"),
        "sample_out": _sample("out"),
        "mv_weights_free": _weights_under(),
        "mv_weights_zero_investment": _weights_under("ZeroInvestment"),
        "mv_weights_zero_beta": _weights_under("ZeroBeta"),
    })
    return found
