"""Running P&L: parts of bounded size, few totals, same sums."""

from pyspark.sql import functions as F

from stratocast.operators import chunked, equity


def test_tasks_and_totals_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(chunked, "TASK_ROWS", 500)
    monkeypatch.setattr(equity, "TASK_ROWS", 500, raising=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        i = F.col("id")
        t = spark.range(10_000).select((i % 3).alias("k"), i.alias("ok"), (i % 7 - 3).alias("pnl"))
        d = equity.cumulative_pnl(t, ["k"], ["ok"], "pnl", 5)
        parts = d.rdd.glom().map(len).collect()
        got = {r.ok: r.cum_pnl for r in d.collect()}
        totals = [n for n in d._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(_k" in n]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want, run = {}, {0: 0, 1: 0, 2: 0}
    for x in range(10_000):
        run[x % 3] += x % 7 - 3
        want[x] = run[x % 3]
    assert got == want
    assert len(parts) == 20 and any("_c" in n and ", 20)" in n for n in totals)
