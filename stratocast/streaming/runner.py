"""Running a bounded stream to completion.

Checkpoints, state and outputs all live below the shared folder of the session,
so a restarted job resumes from them.
"""

from ..session import scratch


def run_to_parquet(spark, stream, label, mode="append"):
    """Drain the available input into a parquet sink and read the result back."""
    root = scratch(spark, label)
    use_rocksdb(spark)
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_batches(spark, stream, fn, label, mode="append"):
    """Drain the input through ``fn(batch_df, batch_id)``; returns the output root."""
    root = scratch(spark, label)
    use_rocksdb(spark)
    q = (stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: fn(df, i, root))
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return root


def use_rocksdb(spark):
    """Large keyed state belongs in RocksDB rather than on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_updates(spark, stream, keys, label):
    """Drain an update-mode aggregation; the newest update of each key is its state."""
    from pyspark.sql import functions as F

    def save(df, i, root):
        df.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{root}/out/_b={i}")

    root = run_batches(spark, stream, save, label, mode="update")
    rest = [c for c in stream.columns if c not in keys]
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
