"""Logarithms of activities are those of the SQL, to the last bit."""

import duckdb
from pyspark.sql import functions as F

from scarp.operators import compounds


def test_logarithms_equal_sql_to_the_last_bit(spark):
    events = "/root/testdata/sf0.01/events.parquet"
    got = {r["event_id"]: r["la"] for r in spark.read.parquet(events).select("event_id", compounds.log_activity(F.col("value"), "nM").alias("la")).collect()}
    want = dict(duckdb.execute(f"SELECT event_id, CASE WHEN value > 0 THEN -log10(value) + 9 END FROM '{events}'").fetchall())
    assert got == want


def test_null_zero_negative_and_infinite_activities(spark):
    df = spark.createDataFrame([(0, None), (1, 0.0), (2, -1.0), (3, float("inf")), (4, 10.0)], "i long, x double")
    assert [r["la"] for r in df.select("i", compounds.log_activity(F.col("x"), "M").alias("la")).orderBy("i").collect()] == [None, None, None, float("-inf"), -1.0]
