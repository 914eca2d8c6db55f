"""Day-grouped splits and folds. Days are few, so day ranks are computed on the
distinct days and joined back; rows are never ordered globally."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def day_ranks(df, day):
    """Distinct days with rank and total. One row per calendar day in the window."""
    d = df.select(F.col(day).alias("_d")).distinct()
    return d.withColumns({"_k": F.row_number().over(Window.orderBy("_d")),
                          "_n": F.count(F.lit(1)).over(Window.partitionBy())})


def by_date(df, day, cutoff):
    return df.withColumn("part", F.when(F.col(day) < F.lit(cutoff).cast("date"), "train").otherwise("test"))


def by_ratio(df, day, ratio):
    """Last max(1, floor(n*ratio)) distinct days are test; rows without a day are left out.

    The first test day is one value of the plan, so the rows are not shuffled by day."""
    test = F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))
    first = day_ranks(df, day).filter(F.col("_k") > F.col("_n") - test).agg(F.min("_d").alias("_d"))
    return df.filter(F.col(day).isNotNull()).withColumn("part", F.when(F.col(day) >= first.scalar(), "test").otherwise("train"))


def last_days(df, day, n):
    keep = df.select(day).distinct().orderBy(F.desc(day)).limit(n)
    return df.join(keep, day, "left_semi")


def expanding_folds(df, day, k, gap=0):
    """(fold, day, part): fold i trains on the first days and validates on the next
    n // (k+1) days after ``gap`` skipped ones."""
    r = day_ranks(df, day)
    size = F.floor(F.col("_n") / (k + 1))
    f = r.select(F.col("_d").alias(day), "_k", size.alias("_s"),
                 F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"))
    start = F.col("_s") * F.col("fold")
    part = (F.when(F.col("_k") <= start - gap, "train")
            .when((F.col("_k") > start) & (F.col("_k") <= start + F.col("_s")), "val"))
    return f.withColumn("part", part).filter("part IS NOT NULL").select("fold", day, "part")
