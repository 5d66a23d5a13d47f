"""Operators across the assets of one date.

A date may hold any share of the rows, so per-date statistics are aggregated (combined before the shuffle) and joined
back; no date is collected into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import nan_to_zero, null_to_zero, percent_to_fraction, ratio, row_total
from ..plans.sizing import join_small


def cs_zscore(
    df: DataFrame, value: str, by: str = "dt", out: str = "momentum_zscore", max_dates: int | None = None,
) -> DataFrame:
    """(value - mean) / sample deviation within each date; null for one-asset dates and equal values."""
    stats = df.groupBy(by).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__std"))
    joined = join_small(df, stats, by, max_dates)
    return joined.withColumn(out, ratio(F.col(value) - F.col("__mean"), "__std")).drop("__mean", "__std")


def to_alpha(df: DataFrame, score: str = "momentum_zscore", risk: str = "specific_risk", scale: float = 0.5) -> DataFrame:
    """Expected return ``scale * score * risk`` as ``alpha``; the score itself as ``signal``."""
    return df.withColumns({"alpha": F.col(score) * scale * F.col(risk), "signal": F.col(score)})


def lagged_price(df: DataFrame, key: str = "asset", order: str = "dt", price: str = "price") -> DataFrame:
    return df.withColumn("price_lag", F.lag(price).over(Window.partitionBy(key).orderBy(order)))


def price_filter(df: DataFrame, minimum: float = 5.0, inclusive: bool = False) -> DataFrame:
    """Keep rows whose previous price is above (or at least) ``minimum``; rows without one are dropped."""
    price = F.col("price_lag")
    return df.where(price >= minimum if inclusive else price > minimum)


def unpivot(df: DataFrame, index: list[str], columns: list[str] | None, name: str, value: str) -> DataFrame:
    """Wide to long; without ``columns`` every column outside ``index`` is unpivoted."""
    return df.unpivot(index, columns, name, value)


def _check_mode(all_zero: str) -> None:
    if all_zero not in ("score_zero", "drop"):
        raise ValueError(f"all_zero must be 'score_zero' or 'drop', not {all_zero!r}")


def exposure_shares(exposures: DataFrame, columns: list[str], all_zero: str = "score_zero") -> DataFrame:
    """Divide each row by its sum. A row summing to 0 becomes NaN (``score_zero``) or is removed (``drop``)."""
    _check_mode(all_zero)
    rows = exposures.withColumn("__total", row_total(columns))
    if all_zero == "drop":
        rows = rows.where(F.col("__total") != 0)
    total = F.when(F.col("__total") != 0, F.col("__total"))
    shares = {c: F.coalesce(ratio(null_to_zero(c), total), F.lit(float("nan"))) for c in columns}
    return rows.withColumns(shares).drop("__total")


def normalise_exposures(
    exposures: DataFrame, columns: list[str], all_zero: str = "score_zero", index: tuple[str, ...] = ("dt", "asset"),
) -> DataFrame:
    """Sparse long exposures (index, industry, exposure) whose rows sum to 1 per asset and date.

    With ``score_zero`` a row without any exposure stays, with exposure 0 to every industry, and so takes part in the
    statistics of its date; with ``drop`` it is left out. NaN sorts above every number, so ``> 0`` keeps it.
    """
    shares = exposure_shares(exposures, columns, all_zero).select(*index, *columns)
    cells = unpivot(shares, list(index), columns, "industry", "exposure")
    return cells.where(F.col("exposure") > 0).withColumn("exposure", nan_to_zero("exposure"))


def project_exposures(
    exposures: DataFrame, momentum: DataFrame, max_rows: int | None = None, out: str = "momentum_score",
) -> DataFrame:
    """Score per asset and date: exposure-weighted momentum of its industries; a missing momentum counts 0.

    ``max_rows`` bounds the momentum table (industries times dates).
    """
    factors = momentum.select("dt", "industry", "momentum")
    joined = join_small(exposures, factors, ["dt", "industry"], max_rows)
    return joined.groupBy("dt", "asset").agg(null_to_zero(F.sum(F.col("exposure") * F.col("momentum"))).alias(out))


def project_exposures_wide(
    exposures: DataFrame, momentum: DataFrame, columns: list[str], all_zero: str = "score_zero",
    max_dates: int | None = None, out: str = "momentum_score",
) -> DataFrame:
    """Same scores from the wide exposures, without unpivoting them.

    The momentum is pivoted to one row per date instead, so the projection is a row-wise sum of products behind one
    join on the date: exposures are neither multiplied by the number of industries nor shuffled.
    """
    by_date = momentum.groupBy("dt").pivot("industry", columns).agg(F.first("momentum"))
    by_date = by_date.select("dt", *[F.col(c).alias("__m_" + c) for c in columns])
    shares = exposure_shares(exposures, columns, all_zero)
    cells = [F.when(F.col(c) > 0, nan_to_zero(c) * F.col("__m_" + c)) for c in columns]
    scored = join_small(shares, by_date, "dt", max_dates)
    return scored.withColumn("__score", row_total(cells)).select("dt", "asset", F.col("__score").alias(out))


def sparse_exposures(
    exposures: DataFrame, columns: list[str], all_zero: str = "score_zero", index: tuple[str, ...] = ("dt", "asset"),
) -> DataFrame:
    """One row per asset and date with its shares above 0: places among ``columns`` (``at``, rising) and shares (``share``).

    A row without any exposure has empty arrays (``score_zero``) or is left out (``drop``). Stored, it takes room for the
    non-zero cells only, and scores need neither a row per cell nor a column per industry.
    """
    shares = exposure_shares(exposures, columns, all_zero)
    cells = F.array(*[F.struct(F.lit(i).alias("at"), nan_to_zero(c).alias("share")) for i, c in enumerate(columns)])
    kept = shares.select(*index, F.filter(cells, lambda c: c["share"] > 0).alias("__cells"))
    return kept.select(*index, F.col("__cells.at").alias("at"), F.col("__cells.share").alias("share"))


def sparse_dot(at: str, share: str, vector: str):
    """Sum of share times the vector's entry at its place; a missing vector or entry counts 0."""
    pairs = F.zip_with(F.col(at), F.col(share), lambda i, s: s * F.get(F.col(vector), i))
    return F.aggregate(F.coalesce(pairs, F.array().cast("array<double>")), F.lit(0.0), lambda total, x: total + null_to_zero(x))


def project_exposures_sparse(
    exposures: DataFrame, momentum: DataFrame, columns: list[str], max_dates: int | None = None, out: str = "momentum_score",
) -> DataFrame:
    """The scores of ``project_exposures`` from ``sparse_exposures``: the momentum of a date becomes one vector, which is
    joined on the date and multiplied with each row's few cells."""
    by_date = momentum.groupBy("dt").pivot("industry", columns).agg(F.first("momentum"))
    by_date = by_date.select("dt", F.array(*columns).alias("__m"))
    scored = join_small(exposures, by_date, "dt", max_dates and max_dates * len(columns))
    return scored.select("dt", "asset", sparse_dot("at", "share", "__m").alias(out))


def to_fraction(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: percent_to_fraction(c) for c in columns})
