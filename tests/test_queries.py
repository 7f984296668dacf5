"""Every engine query against its SQL, and what SQL cannot say."""

import pytest
from conftest import SF, collected, duck
from pyspark.sql import functions as F

from tidemark import queries as M


@pytest.mark.parametrize("name", sorted(M.oracle_sql()))
def test_same_as_sql(spark, name):
    assert collected(M.queries()[name](spark, SF)) == duck(M.oracle_sql()[name])


def test_restarted_slots_differ_from_a_grid(spark):
    from tidemark.operators.timeseries import rolling_max, rolling_max_at
    from tidemark.query_base import written

    keep = written(spark)
    rows = [(0, 5.0), (50, 1.0), (130, 2.0), (205, 3.0), (235, 9.0), (500, 1.0)]  # slots start at 0, 130, 235, 500
    df = spark.createDataFrame(rows, "s long, value double").select(F.timestamp_seconds("s").alias("ts"), "value", F.lit("a").alias("k"))
    got = [(r["start"] // 1_000_000, r["top"], r["rolling_max"]) for r in rolling_max(df, ["k"], 100, keep).orderBy("start").collect()]
    assert got == [(0, 5.0, 5.0), (130, 3.0, 5.0), (235, 9.0, 9.0), (500, 1.0, 1.0)]
    read = [rolling_max_at(df, ["k"], 100, f"1970-01-01 00:{s // 60:02d}:{s % 60:02d}", keep).first()["rolling_max"] for s in (60, 140, 240, 336, 434, 436, 500, 601)]
    assert read == [5.0, 5.0, 9.0, 9.0, 9.0, 0.0, 1.0, 1.0]


def test_bucket_checksums_find_one_changed_row(spark):
    from tidemark.operators.reconcile import bucket_checksums

    a = spark.range(500).withColumn("v", F.col("id") * 2)
    b = a.withColumn("v", F.when(F.col("id") == 77, 0).otherwise(F.col("v")))
    x, y = ({r["bucket"]: (r["n"], r["checksum"]) for r in bucket_checksums(df, ["id", "v"], "id").collect()} for df in (a, b))
    assert sum(x[k] != y[k] for k in x) == 1


def test_dead_letters_come_back_whole(spark):
    rows = M.dlq_roundtrip(spark, SF).collect()
    assert rows and all(r["restored"] and r["op"] == "d" for r in rows)
