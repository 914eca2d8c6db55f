"""Message streams over files."""

from pyspark.sql import functions as F

from ..functions.timeutil import MINUTE, epoch_us
from ..session import intermediates, scratch
from ..sources.readers import SCHEMAS


def read_events(spark, base, files_per_trigger=50):
    """The event table as a stream; ``ets`` is the event time as an instant (the table is in UTC)."""
    s = (spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", files_per_trigger)
         .parquet(f"{base.rstrip('/')}/events.parquet*"))
    return s.withColumns({"us": epoch_us("ts"), "ets": F.timestamp_micros(epoch_us("ts"))})


def replay(spark, table, time, parts=5, most=5_000_000, file_rows=50_000):
    """A stored table as a stream of ``parts`` micro-batches in the order of ``time``, or of as
    many as keep a batch to about ``most`` rows.

    Equal slices by count (their borders from one quantile sketch) are written one after the
    other as files of a new folder, which a file stream then takes one slice at a time; rows
    within a slice arrive in any order. The table is read once and dealt by slice; every slice
    has the same number of files, about one for ``file_rows`` rows of the smallest, so that
    the tasks of a micro-batch share its rows.
    """
    parts = max(parts, -(-table.count() // most))
    borders = table.agg(F.percentile_approx(time, F.array(*[F.lit(i / parts) for i in range(1, parts)]))).first()[0] or []
    folder = scratch(spark, "replay")
    slot = F.lit(0)
    for b in sorted(set(borders)):
        slot = slot + F.coalesce((F.col(time) > b).cast("int"), F.lit(0))
    with intermediates(spark):
        stage = scratch(spark, "slices")
        table.withColumn("_slot", slot).write.partitionBy("_slot").parquet(stage)
        staged = spark.read.schema(table.withColumn("_slot", slot).schema).parquet(stage)
        rows = sorted((r["_slot"], r["count"]) for r in staged.groupBy("_slot").count().collect())
        files = max(1, min((n for _, n in rows), default=0) // file_rows)
        for i, _ in rows:
            # Rows are dealt in turn, so with ``file_rows`` rows and more for a file none stays empty.
            part = staged.where(F.col("_slot") == i).drop("_slot")
            part = part.repartition(files) if files > 1 else part.coalesce(1)
            part.write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)
        if not rows:
            table.coalesce(1).write.mode("append").parquet(folder)
        found = len(spark.read.schema(table.schema).parquet(folder).inputFiles())
        if found != files * max(len(rows), 1):
            raise RuntimeError(f"{found} files for {len(rows)} slices of {files}: micro-batches would not end with a slice")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(folder)


def replayed_events(spark, events, parts=5):
    """The event table replayed in the order of its event time, columns as of ``read_events``."""
    with_us = events.withColumn("us", epoch_us("ts"))
    return replay(spark, with_us, "us", parts).withColumn("ets", F.timestamp_micros("us"))


def quotes(events):
    """Quote messages; absent fields are NULL."""
    e = F.col("event_id")
    return events.select(
        F.col("event_type").alias("city"), F.to_date("ts").alias("day"),
        F.concat_ws("|", "event_type", F.date_format("ts", "yyyyMMdd"), (F.col("user_id") % 6).cast("string")).alias("mkt"),
        "us", "ets", "event_id", F.when(e % 11 == 0, None).otherwise(1 + e % 90).alias("bid"),
        F.when(e % 13 == 0, None).otherwise(2 + e % 90 + e % 7).alias("ask"), (F.col("user_id") % 5).alias("volume"))


def trades(events):
    e = F.col("event_id")
    return events.select(
        F.concat_ws("|", "event_type", F.date_format("ts", "yyyyMMdd"), (F.col("user_id") % 6).cast("string")).alias("mkt"),
        "us", "ets", e.alias("seq"), (1 + e % 98).alias("price"), (1 + F.col("user_id") % 5).alias("cnt"))


def minute_of(us):
    return F.col(us) - F.pmod(F.col(us), F.lit(MINUTE))
