import datetime as dtm

import pytest
from helpers import DAY0, plan_of
from pyspark.errors import AnalysisException

from panelforge.plans import workflow
from panelforge.operators import series
from panelforge.sources import (
    check_contract, current_version, load_panel, read_table, read_year_files, replace_table, require_columns, require_rows,
    require_unique_key, scratch_folder, staged, staging_scope, standin, store_by_series, with_contract, write_by_year, write_table,
)
from panelforge.sources.staging import checked, staging_root

SF = "/root/testdata/sf0.001"


@pytest.fixture
def panel(spark, tmp_path):
    rows = [(f"s{i % 3}", DAY0 + dtm.timedelta(days=200 * i), float(i), i % 2 == 0) for i in range(8)]
    df = spark.createDataFrame(rows, "security string, date date, total_return double, in_universe boolean")
    path = str(tmp_path / "panel")
    write_table(df, path)
    return path


NAMES = {"security": "asset", "date": "dt", "total_return": "ret"}


def test_load_panel_filters_and_renames(spark, panel):
    end = DAY0 + dtm.timedelta(days=800)
    got = load_panel(spark, panel, DAY0, end, ["dt", "asset", "ret"], names=NAMES)
    assert got.columns == ["dt", "asset", "ret"]
    assert sorted(r.ret for r in got.collect()) == [0.0, 2.0, 4.0]
    everyone = load_panel(spark, panel, DAY0, end, ["ret"], in_universe=False, names=NAMES)
    assert everyone.count() == 5
    plan = plan_of(got)
    assert "GreaterThanOrEqual(date" in plan and "EqualTo(in_universe,true)" in plan
    assert "ReadSchema: struct<ret" not in plan


def test_load_panel_of_timestamps_reaches_the_scan(spark):
    start, end = dtm.date(1996, 1, 1), dtm.date(1996, 12, 31)
    names = {"l_suppkey": "asset", "l_shipdate": "dt"}
    got = load_panel(spark, f"{SF}/lineitem.parquet", start, end, ["asset", "dt", "l_tax"], in_universe=False, names=names)
    first, last = got.agg({"dt": "min"}).first()[0], got.agg({"dt": "max"}).first()[0]
    assert start <= first and last <= end and dict(got.dtypes)["dt"] == "date"
    plan = plan_of(got)
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert "l_extendedprice" not in plan


def test_tables_and_patterns(spark, tmp_path):
    for year in ("2020", "2021", "other"):
        write_table(spark.range(3).selectExpr(f"'{year}' as src"), str(tmp_path / "w" / f"{year}.parquet"))
    folder = str(tmp_path / "w")
    assert read_table(spark, f"{folder}/*.parquet").count() == 9
    assert read_table(spark, [f"{folder}/2020.parquet", f"{folder}/2021.parquet"]).count() == 6
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_table(spark, f"{folder}/missing.parquet")


def test_year_files_skip_other_names(spark, tmp_path):
    folder = tmp_path / "years"
    folder.mkdir()
    for name in ("2020", "2021", "other"):
        spark.createDataFrame([(name,)], "src string").toPandas().to_parquet(folder / f"{name}.parquet")
    assert {r.src for r in read_year_files(spark, str(folder)).collect()} == {"2020", "2021"}


def test_write_by_year(spark, panel, tmp_path):
    path = str(tmp_path / "weights")
    df = read_table(spark, panel).withColumnRenamed("date", "dt")
    write_by_year(df, path)
    write_by_year(df, path)
    back = read_table(spark, path)
    assert back.count() == 8 and {r.year for r in back.select("year").distinct().collect()} == {2020, 2021, 2022, 2023}
    assert "PartitionFilters: [isnotnull(year" in plan_of(back.where("year = 2021"))


def test_write_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(5), path)
    write_table(spark.range(2), path)
    assert read_table(spark, path).count() == 2


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "asset string, dt int")
    assert require_columns(df, "asset") is df and require_rows(df) is df
    assert require_unique_key(df, "asset", "dt") is df
    with pytest.raises(ValueError, match="weight"):
        require_columns(df, "asset", "weight")
    with pytest.raises(ValueError, match="signal is empty"):
        require_rows(df.where("false"), "signal")
    with pytest.raises(ValueError, match="not unique"):
        require_unique_key(df, "asset")


def test_staged_tables_run_once_and_keep_their_schema(spark):
    df = spark.range(10).selectExpr("id", "rand() as r", "cast(null as date) as d")
    kept = staged(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert sorted(kept.collect()) == sorted(kept.collect())


def test_workflow(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    assets = staged(standin.assets(spark, sf, ("ret", "price", "specific_return", "specific_risk", "predicted_beta")))
    returns = workflow.percent_returns(assets)
    factors = standin.factor_model(spark, sf)
    paths = {}
    for kind in ("standard", "idiosyncratic", "industry"):
        where = str(tmp_path / kind)
        extra = {} if kind != "industry" else {
            "exposures": standin.exposures(spark, sf), "factors": standin.factors(spark, sf), "columns": standin.INDUSTRIES}
        signal = workflow.create_signal(kind, where, assets, **extra)
        assert {"dt", "asset", "signal", "alpha", "ret"} <= set(signal.columns)
        paths[kind] = str(tmp_path / "weights" / kind)
        weights = workflow.run_backtest(spark, where, paths[kind], 591, ["ZeroInvestment", "ZeroBeta"])
        assert "year" in weights.columns
    report = workflow.signal_report(spark, str(tmp_path / "standard"), "out", dtm.date(1999, 6, 30), 4, factors)
    assert report["regression"].count() == 4 * 6 and report["histogram"].count() == 50
    assert report["sample"].first().first_date > dtm.date(1999, 6, 30)
    assert report["headline"].first().ic_mean is not None
    report = workflow.portfolio_report(
        spark, paths["standard"], str(tmp_path / "standard"), returns, "in", dtm.date(2000, 6, 30), factors)
    for name, table in report.items():
        assert table.count() > 0, name
    assert report["sample"].first().last_date <= dtm.date(2000, 6, 30)
    report = workflow.strategy_report(spark, paths, returns)
    row = report["correlation"].first().asDict()
    assert set(row) == {"standard_vs_idiosyncratic", "standard_vs_industry", "idiosyncratic_vs_industry"}
    assert all(-1 <= v <= 1 and round(v, 2) == v for v in row.values())
    assert report["comparison"].count() == 3
    with pytest.raises(ValueError):
        workflow.create_signal("other", str(tmp_path / "x"), assets)
    with pytest.raises(AnalysisException):
        workflow.run_backtest(spark, str(tmp_path / "missing"), str(tmp_path / "y"))


def test_scopes_drop_their_own_staged_tables(spark):
    def folder(table):
        return table.inputFiles()[0].rsplit("/", 1)[0]

    with staging_scope(spark):
        outer = folder(staged(spark.range(3)))
        with staging_scope(spark):
            inner = folder(staged(spark.range(4)))
        assert read_table(spark, outer).count() == 3
        with pytest.raises(AnalysisException):
            read_table(spark, inner)
    with pytest.raises(AnalysisException):
        read_table(spark, outer)


def test_missing_rows_of_a_staged_table_raise(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    with pytest.raises(RuntimeError):
        checked(spark, str(tmp_path / "x"), 4)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: {})
    with pytest.raises(ValueError):
        staging_root(SimpleNamespace(sparkContext=context, conf={}))


def test_universe_column_must_be_there(spark, tmp_path):
    spark.range(3).selectExpr("date'2020-01-01' as dt", "id as asset").write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        load_panel(spark, str(tmp_path / "p"), dtm.date(2020, 1, 1), dtm.date(2020, 1, 2))


def test_year_files_read_what_was_written(spark, tmp_path):
    def days(*years):
        return spark.createDataFrame([(dtm.date(y, 5, 1), y * 1.0) for y in years], "dt date, weight double")

    write_by_year(days(2020, 2021), str(tmp_path))
    write_by_year(days(2021), str(tmp_path))
    assert sorted(r.weight for r in read_year_files(spark, str(tmp_path)).collect()) == [2020.0, 2021.0]


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    replace_table(spark.range(5), path)
    before = current_version(spark, path)
    broken = spark.range(100).selectExpr("if(id = 77, raise_error('lost'), id) as id").repartition(4)
    with pytest.raises(Exception, match="lost"):
        replace_table(broken, path)

    def refuse():
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        replace_table(spark.range(9), path, refuse)
    assert current_version(spark, path) == before and read_table(spark, path).count() == 5
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("v-")]) == 1


def test_a_table_is_replaced_from_itself(spark, tmp_path):
    path = str(tmp_path / "table")
    replace_table(spark.range(5), path)
    held = read_table(spark, path)
    for k in (1, 2):
        replace_table(read_table(spark, path).selectExpr("id + 1 as id"), path)
        assert sorted(r.id for r in read_table(spark, path).collect()) == [k, 1 + k, 2 + k, 3 + k, 4 + k]
        if k == 1:
            assert held.count() == 5  # a reader that began before the switch
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("v-")]) == 2


def test_contract_is_counted_in_the_series_exchange(spark, series_of):
    df = series_of({"a": [1, None, 3], "b": [4]}).unionByName(series_of({"a": [9]}))
    counted, seen = with_contract(df, "asset", "dt", ["x"])
    plan = plan_of(series.lag(counted, "asset", "dt", "x", 1, "y"))
    assert plan.count("Exchange ") == 1
    assert counted.count() == 5 and seen.get == {"rows": 5, "repeated": 1, "null_asset": 0, "null_dt": 0, "null_x": 1}
    with pytest.raises(ValueError, match="unique"):
        check_contract(seen.get)
    for counts, said in (({"rows": 0, "repeated": 0}, "empty"), ({"rows": 1, "repeated": 0, "null_x": 2}, "nulls")):
        with pytest.raises(ValueError, match=said):
            check_contract(counts, "table", ("x",))


def test_gaps(spark, series_of):
    df = series_of({"a": [1, None, 3, 4, 5, 6, None, None, 9], "b": [1, 2, 3]})
    got = {r.asset: (r.n_rows, r.n_null, r.n_lost) for r in series.series_gaps(df, "asset", "dt", "x", 3).collect()}
    assert got == {"a": (9, 3, 5), "b": (3, 0, 0)}


def test_a_panel_stored_by_series_needs_no_exchange(spark, series_of, tmp_path):
    rows = series_of({f"a{i}": list(range(1, 30 + i)) for i in range(20)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    held = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(held, "false")
    try:
        x, y = (store_by_series(rows.withColumnRenamed("x", c), f"stored_{c}", str(tmp_path / c), 4) for c in "xy")
        first = series.vol_scaled_momentum(x, "asset", "dt", "x", 3, 2, 5, 2)
        second = series.rolling_sum(x, "asset", "dt", "x", 4, "total")
        joined = x.join(y, ["asset", "dt"])
        assert all("Exchange" not in plan_of(df) for df in (first, second, joined))
        assert joined.count() == rows.count() and first.where("momentum is not null").count() > 0
    finally:
        for c in ("spark.sql.autoBroadcastJoinThreshold", held):
            spark.conf.unset(c)
        for c in "xy":
            spark.sql(f"drop table if exists stored_{c}")


def test_scratch_folders_go_with_their_scope(spark, tmp_path):
    import os

    with staging_scope(spark):
        path = scratch_folder(spark, "mine")
        spark.range(3).write.parquet(path)
        assert os.path.isdir(path)
    assert not os.path.exists(path)
