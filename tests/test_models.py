"""Fits on counted rows against the fits on all rows."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stratocast.ml import models as ML
from stratocast.operators import chunked, metrics, splits

NAMES = ["a", "b", "c"]


def small(**kw):
    return ML.gbt(**{**kw, "maxIter": 4, "maxDepth": 4})


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows: many values, a value on half of all rows, few values, and a label that follows them."""
    out = []
    for i in range(3000):
        a, b, c = (i * 7919 % 1009) / 7, float(i % 90) if i % 2 else 40.0, float(i % 5) - 2
        out.append((a, b, c, int((a > 60) ^ (b > 44) ^ (i % 11 == 0))))
    return spark.createDataFrame(out, "a double, b double, c double, won int")


def counted(df):
    return df.groupBy(*NAMES, "won").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.col("won").cast("double"))


def scores(model, df):
    s = model.transform(df).select(*NAMES, vector_to_array("probability")[1].alias("q"))
    return {(r.a, r.b, r.c): round(r.q, 9) for r in s.distinct().collect()}


def test_trees_on_counted_rows_equal_trees_on_all_rows(spark, rows):
    v = VectorAssembler(inputCols=NAMES, outputCol="features")
    want = small().fit(v.transform(rows.withColumn("label", F.col("won").cast("double"))))
    got = ML.BinnedTrees(NAMES, make=small).fit(counted(rows))
    assert scores(got, rows) == scores(want, v.transform(rows))
    assert [w for _, w in ML.importances(got, NAMES)] == pytest.approx([w for _, w in ML.importances(want, NAMES)], abs=1e-9)
    # Rows at, between and beyond the values seen fall on the same side of a cut.
    new = spark.createDataFrame([(x, y, float(z)) for x in (-9.0, 59.9, 500.0) for y in (39.5, 40.0, 44.5, 89.5) for z in range(-3, 4)], "a double, b double, c double")
    assert scores(got, new) == scores(want, v.transform(new))


def test_trees_do_not_depend_on_the_number_of_equal_rows_or_their_files(spark, rows):
    """30,000 rows, of which trees on all rows would sample their split candidates."""
    many = rows.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("_r")
    one, ten, dealt = [ML.BinnedTrees(NAMES, make=small).fit(counted(d)) for d in (rows, many, many.repartition(11))]
    assert one.cuts == ten.cuts == dealt.cuts and one.n_cells == ten.n_cells <= 2 * 32 ** 3
    assert scores(one, rows) == scores(ten, rows) == scores(dealt, rows)


def test_cuts_over_several_chunks(rows, monkeypatch):
    want = ML.cut_points(counted(rows), NAMES, 32)
    monkeypatch.setattr(chunked, "TASK_ROWS", 50)
    assert ML.cut_points(counted(rows), NAMES, 32) == want
    assert len(want["a"]) == 31 and want["c"] == [-1.5, -0.5, 0.5, 1.5]


def test_an_input_of_one_value(rows):
    m = ML.BinnedTrees(NAMES, make=small).fit(counted(rows.withColumn("c", F.lit(1.0))))
    assert m.cuts["c"] == [] and dict(ML.importances(m, NAMES))["c"] == 0.0


def test_auc_of_close_scores_is_dealt_by_their_number(spark, monkeypatch):
    """All scores within one of the equal bands, and equal rows counted."""
    rows = [(0.4 + i * 37 % 400 / 1e8, int(i % 3 == 0), 1 + i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "s double, y int, n int")
    seen = []
    scan = metrics.prefix_scan
    monkeypatch.setattr(metrics, "prefix_scan", lambda c, k, o, band, *a, **kw: seen.append(c.select(band.alias("x")).distinct().count()) or scan(c, k, o, band, *a, **kw))
    monkeypatch.setattr(chunked, "TASK_ROWS", 50)
    monkeypatch.setattr(metrics, "TASK_ROWS", 50)
    got = metrics.auc(df, "s", "y", weight="n").first()
    pos, neg = [(s, n) for s, y, n in rows if y], [(s, n) for s, y, n in rows if not y]
    wins = sum(m * n * ((p > q) + 0.5 * (p == q)) for p, m in pos for q, n in neg)
    assert seen[0] >= 8
    assert (got.n_pos, got.n_neg) == (sum(n for _, n in pos), sum(n for _, n in neg))
    assert abs(got.auc - wins / got.n_pos / got.n_neg) < 1e-12


def test_ratio_split_moves_no_rows(spark):
    """Days fall as by the day ranks, rows without a day are left out, and no row is shuffled or joined."""
    days = [f"2024-01-{d:02d}" for d in (1, 2, 3, 5, 8, 9, 20)]
    df = spark.createDataFrame([(days[i % 7], i) for i in range(50)] + [(None, 99)], "day string, i int").withColumn("day", F.col("day").cast("date"))
    d = splits.by_ratio(df, "day", 0.3)
    got = {(str(r.day), r.part) for r in d.collect()}
    assert got == {(x, "test" if x >= "2024-01-09" else "train") for x in days} and d.count() == 50
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
