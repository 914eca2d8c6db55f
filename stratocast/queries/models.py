"""Models (P23-P26)."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..ml import models as ML
from ..operators import splits as S
from ..plans import datasets as D
from ..session import written
from .registry import query

N = F.lit
CLASSES = list(range(-3, 4))
NUM = ["vc_max_f_sofar", "vc_mean_f_sofar", "fcst_prev_max_f", "temp_mean_last_60min", "hours_to_event_close", "obs_fcst_max_gap", "market_mid_price"]


def training_rows(t):
    """Hourly snapshots with the clipped older label, written once for all fits."""
    d = D.hourly_dataset(t.settle, D.inputs(t), 5, groups=["clock", "trailing", "observed", "forecast", "market", "derived", "labels"])
    d = d.select("city", F.col("event_date").alias("day"), "us", *[F.col(c).cast("double").alias(c) for c in NUM],
                 F.greatest(N(-3), F.least(N(3), F.col("delta_obs"))).cast("int").alias("y"))
    return written(d, "training").filter("y IS NOT NULL")


@query("ml_ordinal_thresholds", "city s, n i, accuracy f, mae f, within_1 f, n_models i")
def ml_ordinal_thresholds(t):
    """Cumulative threshold models scored on the last fifth of the days."""
    d = S.by_ratio(training_rows(t), "day", 0.2)
    train, test = d.filter("part = 'train'"), d.filter("part = 'test'")
    prep = ML.preprocessor(NUM, ["city"]).fit(train)
    m = ML.Ordinal(CLASSES).fit(prep.transform(train))
    from ..operators.metrics import delta_metrics
    fitted = sum(k != "constant" for k in m.kinds().values())
    return delta_metrics(m.transform(prep.transform(test)), "y", "pred", ["city"]).withColumn("n_models", N(fitted))


@query("ml_preprocess", "city s, n i, width i, mean_first f, n_filled i")
def ml_preprocess(t):
    b = t.bt.withColumn("x", F.when(F.col("pk") % 7 == 0, None).otherwise(F.col("edge"))).withColumn("pr", F.col("price").cast("double"))
    b = ML.structural_nulls(b, zero=["pr"])
    f = ML.preprocessor(["x", "pr", "prob"], ["city"]).fit(b).transform(b).withColumn("v", vector_to_array("features"))
    return f.groupBy("city").agg(F.count(N(1)).alias("n"), F.max(F.size("v")).alias("width"), F.avg(F.col("v")[0]).alias("mean_first"),
                                 F.count_if(F.col("x").isNull() & F.col("x_i").isNotNull()).alias("n_filled"))


@query("ml_edge_filter", "part s, n i, taken i, mean_pnl f, hit_rate f, threshold f")
def ml_edge_filter(t):
    """Trade filter on day-grouped train, calibration and test parts."""
    v = VectorAssembler(inputCols=["edge", "prob", "pr"], outputCol="features")
    b = v.transform(t.bt.withColumn("pr", F.col("price").cast("double")))
    r = S.day_ranks(b, "day")
    part = F.when(F.col("_k") <= F.floor(F.col("_n") * 0.6), "train").when(F.col("_k") <= F.floor(F.col("_n") * 0.8), "calib").otherwise("test")
    b = written(b.join(r.select(F.col("_d").alias("day"), part.alias("part")), "day").select("day", "part", "features", "pnl", "won"), "filter")
    m = ML.TradeFilter().fit(b.filter("part = 'train'"), b.filter("part = 'calib'"))
    s = m.transform(b.filter("part <> 'train'"))
    return s.groupBy("part").agg(F.count(N(1)).alias("n"), F.sum("take").alias("taken"), F.avg(F.when(F.col("take") == 1, F.col("pnl"))).alias("mean_pnl"),
                                 F.avg(F.when(F.col("take") == 1, F.col("won"))).alias("hit_rate")).withColumn("threshold", N(m.threshold).cast("double"))


@query("ml_score_and_compare", "model s, n i, auc f, brier f, top_feature s, top_weight f")
def ml_score_and_compare(t):
    """Two classifiers on one split: AUC, Brier score and strongest input. Equal rows are counted once and weigh as many."""
    from ..operators.metrics import auc
    names = ["edge", "prob", "pr"]
    b = S.by_ratio(t.bt.withColumn("pr", F.col("price").cast("double")), "day", 0.2)
    b = written(b.groupBy("part", *names, "won").agg(F.count(N(1)).alias("n")), "compare").withColumn("label", F.col("won").cast("double"))
    b = VectorAssembler(inputCols=names, outputCol="features").transform(b)
    train, test = b.filter("part = 'train'"), b.filter("part = 'test'")
    out = None
    for name, est in (("logistic", ML.LogisticRegression(maxIter=100, weightCol="n")), ("gbt", ML.BinnedTrees(names))):
        m = est.fit(train)
        s = m.transform(test).select("won", "n", vector_to_array("probability")[1].alias("q"))
        s = written(s.groupBy("q", "won").agg(F.sum("n").alias("n")), "scored")
        e = F.col("q") - F.col("won")
        top = max(ML.importances(m, names), key=lambda x: x[1])
        r = s.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * e * e) / F.sum("n")).alias("brier")).withColumn("auc", auc(s, "q", "won", weight="n").select("auc").scalar()).select(
            N(name).alias("model"), "n", "auc", "brier", N(top[0]).alias("top_feature"), N(top[1]).alias("top_weight"))
        out = r if out is None else out.unionByName(r)
    return out
