"""Replayed tables: shared work inside a micro-batch, order and completeness across them."""

from pyspark.sql import functions as F

from stratocast.functions.timeutil import MINUTE
from stratocast.queries import QUERIES
from stratocast.session import intermediates, scratch
from stratocast.streaming import sources, state

SF = "/root/testdata/sf0.001"


def batches(spark, stream):
    seen = []

    def save(df, i):
        seen.append(tuple(df.withColumn("f", F.input_file_name()).agg(F.count(F.lit(1)), F.min("us"), F.max("us"), F.count_distinct("f")).first()))

    stream.writeStream.foreachBatch(save).option("checkpointLocation", scratch(spark, "replay-test")).trigger(availableNow=True).start().awaitTermination()
    return seen


def test_tasks_share_a_slice(spark):
    seen = batches(spark, sources.replay(spark, spark.range(600_000).select(((F.col("id") * 7919) % 600_000).alias("us")), "us"))
    assert len(seen) == 5 and sum(s[0] for s in seen) == 600_000
    assert all(s[3] == seen[0][3] > 1 for s in seen)
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))


def test_rows_without_time_are_replayed(spark):
    t = spark.range(100).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("us"), "id")
    assert sum(s[0] for s in batches(spark, sources.replay(spark, t, "us"))) == 100


def test_an_empty_table_is_replayed(spark):
    assert sum(s[0] for s in batches(spark, sources.replay(spark, spark.range(0).select(F.col("id").alias("us")), "us"))) == 0


def test_both_sides_of_the_fill_join_read_one_replay(spark):
    with intermediates(spark) as paths:
        QUERIES["stream_fill_matching"](spark, SF)
        assert sum("/replay-" in p for p in paths) == 1


def test_a_fill_cycle_makes_its_bars_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    rows = [("x", 0, 5, 9 * MINUTE), ("x", 2 * MINUTE, 6, 9 * MINUTE)]
    bars = spark.createDataFrame(rows, "mkt string, bucket_us long, bid int, close_us long")
    bars = bars.withColumn("bid", F.udf(count, "int")("bid"))
    root = scratch(spark, "cycles")
    state.extend_dense(spark, bars, 0, root, "mkt", ["bid"], "close_us")
    assert made.value == 2 and spark.read.parquet(f"{root}/dense").count() == 3
