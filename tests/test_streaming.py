"""Streams by calendar period equal the batch result, with late rows and a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.errors import GridError
from gridloom.streaming.windows import period_end, period_start, stream_aggregate

SCHEMA = "place string, time timestamp, value double"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def run(spark, folder, by, method, late="20 days"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = (stream_aggregate(stream, by, ["place"], method, late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination(180)
    assert query.exception() is None


@pytest.mark.parametrize("by,method", [("month", "mean"), ("season", "sum"), ("week", "max")])
def test_streams_equal_batches(rocks, tmp_path, by, method):
    spark, r = rocks, random.Random(by)
    first = datetime(2019, 11, 20)
    rows = [(r.choice("ab"), first + timedelta(days=k * 1.7, minutes=r.randrange(600)), r.choice((float(r.randrange(50)), None, float("nan")))) for k in range(120)]
    # Rows come up to nine days late, in three files before a restart and two after it.
    rows.sort(key=lambda x: x[1] + timedelta(days=r.random() * 9))
    parts = [rows[:25], rows[25:60], rows[60:80], rows[80:], [("end", datetime(2031, 1, 1), 0.0)]]
    for k, part in enumerate(parts[:3]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, tmp_path, by, method)
    before = spark.read.parquet(f"{tmp_path}/out").count()
    for part in parts[3:]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, tmp_path, by, method)
    got = sorted((x.place, x.time, x.n_valid, None if x.value is None else round(x.value, 9)) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("start", period_start(F.col("time"), by)).withColumn("v", F.when(~F.isnan("value"), F.col("value")))
    how = {"mean": F.avg, "sum": F.sum, "max": F.max}[method]
    want = sorted((x.place, x.start, x.n, None if x.v is None else round(x.v, 9)) for x in batch.groupBy("place", "start").agg(how("v").alias("v"), F.count("v").alias("n")).collect())
    # A sum of nothing is nothing in a batch, too.
    assert got == want and 0 < before < len(want)


def test_periods_follow_the_calendar(spark):
    days = ["2020-02-29", "2020-03-01", "2019-12-31", "2020-01-01", "2021-11-30"]
    frame = spark.createDataFrame([(d,) for d in days], "d string").withColumn("t", F.col("d").cast("timestamp"))
    got = {by: [(str(x.a)[:10], str(x.b)[:10]) for x in frame.select(period_start(F.col("t"), by).alias("a")).withColumn("b", period_end(F.col("a"), by)).collect()] for by in ("week", "month", "season", "year")}
    assert got["season"] == [("2019-12-01", "2020-03-01"), ("2020-03-01", "2020-06-01"), ("2019-12-01", "2020-03-01"), ("2019-12-01", "2020-03-01"), ("2021-09-01", "2021-12-01")]
    assert got["week"][:2] == [("2020-02-24", "2020-03-02")] * 2 and got["month"][0] == ("2020-02-01", "2020-03-01") and got["year"][2] == ("2019-01-01", "2020-01-01")


def test_calendar_periods_name_what_they_need(spark):
    events = spark.createDataFrame([], SCHEMA)
    with pytest.raises(GridError) as e:
        stream_aggregate(events, "month", ["place"])
    assert e.value.code == "stream_state"
    with pytest.raises(GridError):
        stream_aggregate(events, "decade", ["place"])
