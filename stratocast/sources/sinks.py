"""Parquet and CSV outputs."""

from pyspark.sql import functions as F


def write_split(df, path, day, cutoff):
    """Full set in one pass, partitioned by split (train before ``cutoff``)."""
    split = F.when(F.col(day) < F.lit(cutoff).cast("date"), "train").otherwise("test")
    df.withColumn("split", split).write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def write_csv(df, path):
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
