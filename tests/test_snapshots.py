"""A snapshot must not depend on anything after its cutoff."""

import pytest
from pyspark.sql import functions as F

from stratocast.features import build
from stratocast.features.registry import GROUPS, feature_columns
from stratocast.plans import datasets as D
from stratocast.plans.strategies import run_strategy

CUT = 1_705_334_400_000_000  # 2024-01-15 16:00


def features(tables, ctx):
    names = [n for n in GROUPS if n not in ("labels", "lags")]
    s = D.hourly(tables.settle.filter("city IN ('click', 'view') AND day = DATE'2024-01-15'"))
    d = build(s.filter(F.col("us") <= CUT), ctx, names)
    num, _ = feature_columns(d)
    return {(r.city, r.us): tuple(None if r[c] is None else round(float(r[c]), 9) for c in num) for r in d.collect()}


def test_future_rows_do_not_change_a_snapshot(tables):
    a = D.inputs(tables)
    b = D.inputs(tables)
    late = F.col("us") > CUT
    b.obs = b.obs.withColumn("temp_f", F.when(late, 999.0).otherwise(F.col("temp_f")))
    b.city_obs = b.city_obs.withColumn("temp_f", F.when(late, -999.0).otherwise(F.col("temp_f")))
    b.candles = b.candles.withColumn("bid", F.when(F.col("bucket_us") >= CUT, 1).otherwise(F.col("bid")))
    late_day = F.col("basis") >= F.lit("2024-01-15").cast("date")  # lead 0 is issued on the event day
    b.fcst = b.fcst.withColumn("tempmax_f", F.when(late_day, F.col("tempmax_f") + 500.0).otherwise(F.col("tempmax_f")))
    b.guidance = b.guidance.withColumn("peak_f", F.when(F.col("run_us") > CUT, 777.0).otherwise(F.col("peak_f")))
    x, y = features(tables, a), features(tables, b)
    assert len(x) == 14 and x == y


def test_unknown_names_are_refused(tables):
    with pytest.raises(KeyError):
        build(D.hourly(tables.settle), D.inputs(tables), ["nope"])
    with pytest.raises(KeyError):
        run_strategy("nope", tables)


def test_guidance_follows_the_runs(tables):
    a, b = D.inputs(tables), D.inputs(tables)
    b.guidance = b.guidance.withColumn("peak_f", F.when(F.col("run_us") <= CUT, 777.0).otherwise(F.col("peak_f")))
    assert features(tables, a) != features(tables, b)
