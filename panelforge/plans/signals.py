"""The three momentum signals.

Each one shuffles its panel once, by asset, for all time-series steps; the result is staged as a table, because the
per-date statistics and the rows that use them are two passes over it. The per-date steps are then row-wise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import drop_null_rows, percent_to_fraction, present
from ..operators.crosssection import (
    cs_zscore, lagged_price, price_filter, project_exposures_wide, to_alpha, to_fraction, unpivot,
)
from ..operators.series import join_in_series, vol_scaled_momentum
from ..sources.panel import require_columns
from ..sources.staging import staged
from .sizing import by_series, span_days

SPAN, WINDOW, SKIP = 22, 230, 22


def _own_series_signal(
    assets: DataFrame, value: str, min_price: float, scale: float, max_dates: int | None, max_rows: int | None,
) -> DataFrame:
    if max_dates is None:
        max_dates = span_days(assets)
    panel = vol_scaled_momentum(
        lagged_price(by_series(assets, max_rows)), "asset", "dt", value, span=SPAN, min_periods=SPAN, window=WINDOW, skip=SKIP,
    )
    panel = price_filter(panel, min_price).where(F.col("momentum").isNotNull())
    return to_alpha(cs_zscore(staged(panel), "momentum", max_dates=max_dates), scale=scale)


def standard_momentum(
    assets: DataFrame, min_price: float = 5.0, scale: float = 0.5, max_dates: int | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Momentum of total returns. ``assets``: asset, dt, ret (percent), price, specific_risk.

    The price filter (> ``min_price``, yesterday's price) comes before the z-score, so excluded assets do not
    influence it. ``max_dates`` bounds the dates of the panel; measured if not given. ``max_rows`` bounds its rows: its
    series are dealt to tasks by it (``by_series``), or left as they are dealt if not given.
    """
    require_columns(assets, "asset", "dt", "ret", "price", "specific_risk")
    return _own_series_signal(to_fraction(assets, "ret"), "ret", min_price, scale, max_dates, max_rows)


def idiosyncratic_momentum(
    assets: DataFrame, min_price: float = 5.0, scale: float = 0.5, max_dates: int | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Momentum of specific returns (percent in the input). ``ret`` also leaves as a fraction, ready for evaluation."""
    require_columns(assets, "asset", "dt", "ret", "specific_return", "price", "specific_risk")
    panel = to_fraction(assets, "ret", "specific_return")
    return _own_series_signal(panel, "specific_return", min_price, scale, max_dates, max_rows)


def factor_momentum(factors: DataFrame, columns: list[str], max_dates: int | None = None) -> DataFrame:
    """Momentum of each factor from wide daily factor returns: dt, industry, ret, vol, scaled_ret, momentum."""
    require_columns(factors, "dt", *columns)
    long = unpivot(factors.select("dt", *columns), ["dt"], columns, "industry", "ret")
    scored = vol_scaled_momentum(
        long, "industry", "dt", "ret", span=SPAN, min_periods=1, window=WINDOW, skip=SKIP)
    return drop_null_rows(scored)


def industry_momentum(
    assets: DataFrame, exposures: DataFrame, factors: DataFrame, columns: list[str], all_zero: str = "score_zero",
    min_price: float = 5.0, scale: float = 0.5, max_dates: int | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Factor momentum projected on assets through their exposures.

    The z-score covers every scored asset; the price filter (>= ``min_price``) follows it. Yesterday's price is the
    one of the previous *scored* row of the asset. ``max_rows`` bounds the rows of ``assets`` and of ``exposures``.
    """
    require_columns(assets, "asset", "dt", "ret", "price", "specific_risk")
    require_columns(exposures, "asset", "dt", *columns)
    if max_dates is None:
        max_dates = max(span_days(assets), span_days(factors))
    momentum = factor_momentum(factors, columns, max_dates)
    scores = staged(project_exposures_wide(exposures, momentum, columns, all_zero, max_dates))
    scored = cs_zscore(scores, "momentum_score", max_dates=max_dates)
    panel = join_in_series(scored, assets, "asset", "dt", max_rows and 2 * max_rows).withColumn("ret", percent_to_fraction("ret"))
    panel = lagged_price(to_alpha(panel, scale=scale))
    return price_filter(panel, min_price, inclusive=True).where(present("alpha"))
