"""Gap repair, sweeps, AUC and merges on hand-made frames."""

from pyspark.sql import functions as F

from stratocast.functions.timeutil import MINUTE
from stratocast.operators import fill
from stratocast.operators.equity import kelly_equity
from stratocast.operators.metrics import auc
from stratocast.operators.sweep import threshold_totals
from stratocast.operators.joins import fill_achievable
from stratocast.sources.upsert import latest, upsert_precedence


def test_small_gaps_are_filled_from_both_sides(spark):
    v = [None, 1.0] + [None] * 8 + [10.0, None]
    d = spark.createDataFrame([("a", i * MINUTE, i, x) for i, x in enumerate(v)], "k string, us long, id long, x double")
    got = [r.y for r in fill.interpolate_small_gaps(d, ["k"], "us", "id", "x", "y").orderBy("id").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 4.0, None, None, 7.0, 8.0, 9.0, 10.0, 10.0]


def test_dense_grid_merges_sources_and_has_no_gap(spark):
    m = MINUTE
    rows = [("x", 0, None, 5, 3, 0), ("x", 0, 4, 9, 7, 1), ("x", 7 * m, 6, None, 2, 0), ("x", 9 * m, 1, 1, None, 1)]
    s = spark.createDataFrame(rows, "mkt string, bucket_us long, bid int, ask int, volume int, source_rank int")
    k = spark.createDataFrame([("x", m, 8 * m + 5)], "mkt string, listed_us long, close_us long")
    full = fill.dense_grid(s, k.withColumns({"listed_us": F.lit(0).cast("long"), "close_us": F.lit(9 * m).cast("long")}), "mkt", ["bid", "ask"]).orderBy("bucket_us").collect()
    assert [r.bucket_us for r in full] == [i * m for i in range(10)]
    assert (full[0].bid, full[0].ask, full[0].volume) == (4, 5, 3) and (full[8].bid, full[8].ask, full[8].is_synthetic, full[8].volume) == (6, 5, 1, 0)
    cut = fill.dense_grid(s, k, "mkt", ["bid", "ask"]).orderBy("bucket_us").collect()
    assert cut[0].bucket_us == m and cut[-1].bucket_us == 8 * m and cut[0].bid is None


def test_threshold_totals_equal_filters(spark):
    d = spark.createDataFrame([(float(i % 10), i) for i in range(100)], "x double, p long")
    got = {r.thr: (r.n, r.s) for r in threshold_totals(d, "x", [0, 3.5, 9, 20], {"n": F.lit(1), "s": F.col("p")}).collect()}
    for thr in (0.0, 3.5, 9.0):
        rows = [i for i in range(100) if i % 10 >= thr]
        assert got[thr] == (len(rows), sum(rows))
    assert 20.0 not in got


def test_auc_with_one_score_on_a_third_of_the_rows(spark):
    rows = [(0.5, i % 2) for i in range(40)] + [((i * 37 % 100) / 100, int(i % 3 == 0)) for i in range(80)]
    got = auc(spark.createDataFrame(rows, "s double, y int"), "s", "y", bands=7).first().auc
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(got - want) < 1e-12


def test_fill_achievable_slots_equal_range_join(spark):
    m = MINUTE
    q = spark.createDataFrame([("a", t * m, 50 - t % 7, None) for t in range(0, 300, 11)] + [("b", 5 * m, 99, None)], "mkt string, bucket_us long, bid int, ask int")
    trades = [("a", lo * m, p) for lo in range(0, 200, 13) for p in (43, 44, 50)] + [("b", 0, 50)]
    t = spark.createDataFrame(trades, "mkt string, listed long, price int").withColumn("id", F.monotonically_increasing_id())
    for one in t.collect()[::5]:
        got = fill_achievable(t.filter(F.col("id") == one.id), q, "mkt", "listed", "price", 120 * m).count()
        want = any(r.mkt == one.mkt and one.listed <= r.bucket_us <= one.listed + 120 * m and r.bid <= one.price for r in q.collect())
        assert got == int(want)


def test_latest_and_precedence(spark):
    d = spark.createDataFrame([("a", 1, 10), ("a", 3, 30), ("a", 2, 20), ("b", 1, None)], "k string, ver int, v int")
    assert {r.k: r.v for r in latest(d, ["k"], "ver").collect()} == {"a": 30, "b": None}
    old = spark.createDataFrame([("a", 1, "cli"), ("b", 1, "cf6")], "k string, v int, src string")
    new = spark.createDataFrame([("a", 2, "cf6"), ("b", 2, "cf6"), ("c", 2, "cf6")], "k string, v int, src string")
    assert {r.k: r.v for r in upsert_precedence(old, new, ["k"], "v", "src").collect()} == {"a": 1, "b": 2, "c": 2}


def test_kelly_walk_restarts_per_run(spark):
    rows = [("a", i, 0.8, 50, 10) for i in range(3)] + [("b", 0, 0.4, 50, 10)]
    d = spark.createDataFrame(rows, "run string, i int, prob double, price int, pnl int")
    got = {(r.run, r.i): r for r in kelly_equity(d, ["run"], ["i"], start=100.0, fraction=0.1, cap=1000.0).collect()}
    e = 100.0
    for i in range(3):
        bet = 0.1 * 0.6 * e
        e += 0.1 * bet / 0.5
        assert abs(got["a", i].equity - e) < 1e-9
    assert got["b", 0].bet == 0.0 and got["b", 0].equity == 100.0
