"""Rounded doubles against DuckDB's, with the signs of zeros."""

import math

import duckdb

from tessera.plans import catalog
from tessera.plans.registry import rounded_doubles


def signed(values):
    return [None if v is None or math.isnan(v) else (v, math.copysign(1, v)) for v in values]


def test_doubles_round_as_in_sql(spark):
    values = [-2e-7, 2e-7, 0.0, 0.1234565, -0.1234565, 0.11899449999999999, 5e-7, -5e-7, 1.0000005, 12345678.1234565, None]
    wanted = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumns(rounded_doubles("v")).orderBy("i").collect()
    assert signed(r["v"] for r in found) == signed(wanted)


def test_a_baseline_next_to_the_mean(spark, tmp_path):
    """R² of about -1e-7, as large tables have, is a negative zero in SQL."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 0::BIGINT AS p_partkey, 100000.0::DOUBLE AS p_retailprice) TO '{tmp_path}/part.parquet'")
    lines = "(10, 1.0003), (7, 0.0), (8, 2.0), (17, 0.0), (18, 2.0)"
    con.execute(f"COPY (SELECT k::BIGINT AS l_orderkey, 0::BIGINT AS l_partkey, 1 AS l_linenumber, q::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, 'A' AS l_returnflag FROM (VALUES {lines}) v(k, q)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'; CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    wanted = con.execute(catalog.oracle_sql()["constant_baseline"]).fetch_df().sort_values("kind")
    found = catalog.queries()["constant_baseline"](spark, str(tmp_path)).toPandas().sort_values("kind")
    assert signed(wanted["r2"]) == [(0.0, -1.0)] * 2
    for name in ("mae", "mse", "rmse", "r2", "bias", "median_ae"):
        assert signed(found[name]) == signed(wanted[name]), name
