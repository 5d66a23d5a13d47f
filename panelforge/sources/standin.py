"""Panels derived from the order tables, standing in for vendor data: asset = supplier, date = ship date."""

from __future__ import annotations

import datetime as dtm

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.sizing import join_small
from .panel import load_panel
from .staging import staged

INDUSTRIES = ["IND_ECONOMY", "IND_LARGE", "IND_MEDIUM", "IND_PROMO", "IND_SMALL", "IND_STANDARD"]


_NAMES = {"l_suppkey": "asset", "l_shipdate": "dt"}


def _cents(column: str):
    """Amounts have two decimals. Whole hundredths add up to the same sum in any order."""
    return F.floor(F.col(column) * 100 + 0.5)


def _mean_net(keep=None):
    """Mean of discount minus tax over the lines, in percent; over the lines where ``keep`` holds, if given."""
    net = _cents("l_discount") - _cents("l_tax")
    if keep is None:
        return F.try_divide(F.sum(net), F.count(net))
    return F.try_divide(F.sum(F.when(keep, net)), F.count(F.when(keep, net)))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span(spark: SparkSession, sf_dir: str) -> int:
    """Calendar days covered by the ship dates, from one column."""
    first, last = _table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    return 0 if first is None else (last.date() - first.date()).days + 1


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """Lines, a bound of the rows of the asset panel and of the exposures, from the file footers."""
    return _table(spark, sf_dir, "lineitem").count()


def _lines(spark: SparkSession, sf_dir: str, start: dtm.date | None = None, end: dtm.date | None = None) -> DataFrame:
    path = f"{sf_dir}/lineitem.parquet"
    if start and end:
        return load_panel(spark, path, start, end, in_universe=False, names=_NAMES)
    return spark.read.parquet(path).withColumnsRenamed(_NAMES).withColumn("dt", F.to_date("dt"))


def assets(
    spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("ret", "price", "specific_risk"),
    start: dtm.date | None = None, end: dtm.date | None = None, max_dates: int | None = None,
) -> DataFrame:
    """Asset panel with the requested columns of: ret, price, specific_return (percent), specific_risk, predicted_beta.

    Lines are combined per asset and date before the shuffle, so a supplier or date with many lines costs little.
    """
    panel = _lines(spark, sf_dir, start, end).groupBy("asset", "dt").agg(
        _mean_net().alias("ret"),
        (F.try_divide(F.sum(_cents("l_extendedprice")), F.sum("l_quantity")) / 10000).alias("price"),
    )
    supplier = _table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("asset"),
        (F.lit(10.0) + F.abs("s_acctbal") / 500).alias("specific_risk"),
        (F.lit(0.5) + (F.col("s_nationkey") % 10) / F.lit(10.0)).alias("predicted_beta"),
    )
    if set(columns) & set(supplier.columns):
        panel = panel.join(supplier, "asset")
    if "specific_return" in columns:
        panel = staged(panel)
        market = panel.groupBy("dt").agg(F.avg("ret").alias("__market"))
        panel = join_small(panel, market, "dt", max_dates)
        panel = panel.withColumn("specific_return", F.col("ret") - F.col("__market"))
    return panel.select("asset", "dt", *columns)


def _typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    return _lines(spark, sf_dir).join(part, "l_partkey")


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide exposures: discounted lines per asset, date and part type; null where there are none."""
    cells = [
        F.sum(F.when((F.col("p_type") == c[4:]) & (F.col("l_discount") > 0), F.lit(1.0))).alias(c) for c in INDUSTRIES
    ]
    return _typed_lines(spark, sf_dir).groupBy("asset", "dt").agg(*cells)


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide daily factor returns (percent), 0 where a part type was not shipped."""
    def cell(name: str):
        return F.coalesce(_mean_net(F.col("p_type") == name[4:]), F.lit(0.0)).alias(name)

    return _typed_lines(spark, sf_dir).groupBy("dt").agg(*[cell(c) for c in INDUSTRIES])


def factor_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns (fractions) of a market, a size and a volume factor."""
    def gap(mine):
        return (_mean_net(mine) - _mean_net(~mine)) / 100

    return _typed_lines(spark, sf_dir).groupBy("dt").agg(
        (_mean_net() / 100).alias("mktrf"), gap(F.col("p_size") <= 25).alias("smb"), gap(F.col("l_quantity") > 25).alias("hml"),
    )
