"""Ordinal and trade-filter models on pyspark.ml."""

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, Imputer, OneHotEncoder, RobustScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from ..functions import probs as P
from ..operators import metrics as M
from ..operators.chunked import prefix_scan, value_chunk
from ..operators.sweep import threshold_totals, trade_stats
from ..session import written


def preprocessor(numeric, categorical):
    """Median imputation, robust scaling of numbers, one-hot of categories."""
    imp = [f"{c}_i" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=imp),
              VectorAssembler(inputCols=imp, outputCol="_num", handleInvalid="keep"),
              RobustScaler(inputCol="_num", outputCol="_scaled", withCentering=True)]
    hot = []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_x", handleInvalid="keep"),
                   OneHotEncoder(inputCol=f"{c}_x", outputCol=f"{c}_h")]
        hot.append(f"{c}_h")
    stages.append(VectorAssembler(inputCols=["_scaled", *hot], outputCol="features"))
    return Pipeline(stages=stages)


def structural_nulls(df, zero=()):
    """NULLs that mean "nothing there" become zero before imputation; all-NULL columns go."""
    return df.fillna(0, subset=[c for c in zero if c in df.columns])


class Ordinal:
    """K-1 binary models of y >= k; a threshold whose smaller side has less than ``min_share``
    of the rows is a constant, whatever the number of rows."""

    def __init__(self, classes, min_share=0.005, make=None):
        self.classes, self.min_share = classes, min_share
        self.make = make or (lambda: LogisticRegression(maxIter=100, regParam=0.01))
        self.models = {}

    def fit(self, df, y="y", features="features"):
        # All threshold counts in one pass.
        ks = self.classes[1:]
        n, *pos = df.agg(F.count(F.lit(1)), *[F.count_if(F.col(y) >= k) for k in ks]).first()
        for k, c in zip(ks, pos):
            if min(c, n - c) < self.min_share * n or min(c, n - c) == 0:
                self.models[k] = c / max(n, 1)
            else:
                t = df.withColumn("_label", (F.col(y) >= k).cast("double"))
                self.models[k] = self.make().setLabelCol("_label").setFeaturesCol(features).setProbabilityCol("_prob").setRawPredictionCol("_raw").setPredictionCol("_pred").fit(t)
        return self

    def transform(self, df):
        """Adds ``p``: monotone cumulative probabilities differenced into class probabilities."""
        cum = []
        for k, m in self.models.items():
            c = f"_ge_{k}".replace("-", "m")
            if isinstance(m, float):
                df = df.withColumn(c, F.lit(m))
            else:
                df = m.transform(df).withColumn(c, vector_to_array("_prob")[1]).drop("_prob", "_raw", "_pred")
            cum.append(c)
        df = df.withColumn("p", P.classes_from_cumulative(F.array(*cum))).drop(*cum)
        return df.withColumns({"classes": F.array(*[F.lit(k) for k in self.classes])}).withColumn("pred", P.mode("p", "classes"))

    def kinds(self):
        return {k: "constant" if isinstance(m, float) else type(m).__name__ for k, m in self.models.items()}


class TradeFilter:
    """Binary trade filter: model, isotonic calibration, probability cut by mean P&L.

    Only cuts that leave ``min_trades`` calibration trades compete; if none does, the
    threshold is None and ``take`` is NULL.
    """

    def __init__(self, thresholds=None, min_trades=50, model=None):
        self.thresholds = thresholds or [i / 100 for i in range(5, 96, 5)]
        self.min_trades = min_trades
        self.model = model or LogisticRegression(maxIter=100, regParam=0.01, elasticNetParam=0.5)

    def fit(self, train, calib, label="won"):
        t = train.withColumn("label", F.col(label).cast("double"))
        self.fitted = self.model.fit(t)
        c = self._score(calib).withColumn("label", F.col(label).cast("double"))
        self.iso = IsotonicRegression(featuresCol="_s", labelCol="label", predictionCol="prob_cal").fit(c)
        curve = self.curve(self.iso.transform(c))
        best = curve.filter(F.col("n") >= self.min_trades).orderBy(F.desc("mean_pnl"), "thr").select("thr").first()
        self.threshold = best.thr if best else None
        return self

    def _score(self, df):
        return self.fitted.transform(df).withColumn("_s", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")

    def transform(self, df):
        return self.iso.transform(self._score(df)).withColumn("take", (F.col("prob_cal") >= F.lit(self.threshold).cast("double")).cast("int"))

    def curve(self, scored, by=()):
        s = threshold_totals(scored, "prob_cal", self.thresholds, {"n": F.lit(1), "s": F.col("pnl"), "ss": F.col("pnl") * F.col("pnl"), "w": F.col("won")}, by)
        return trade_stats(s)


def cut_points(counted, names, bins, weight="n"):
    """Per input, up to ``bins - 1`` cuts between neighbouring values that part the weight evenly.

    An input of at most ``bins`` values is cut between all of them. Otherwise a cut precedes the first
    value whose middle lies beyond the next of the even shares; a value that spans several shares
    passes its spare cuts on to the values after it. These are the split candidates of the trees of
    ``pyspark.ml`` where they see every row (they sample beyond 10,000). All values count here.
    """
    x = counted.select(weight, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([weight], names, "input", "x")
    x = written(x.groupBy("input", "x").agg(F.sum(weight).alias("_w")), "input-values")
    size = x.groupBy("input").agg(F.count(F.lit(1)).alias("_size"), F.sum("_w").alias("_all"))
    rows = x.count()
    r = prefix_scan(value_chunk(x, "x", rows), ["input"], ["x"], F.col("_band"),
                    {"_i": ("count", F.lit(1)), "_to": ("sum", "_w"), "_before": ("prev", "x")}, rows=rows).join(size, "input")
    # Shares passed up to a value; cuts made up to it are the least of them plus the values since.
    passed = F.ceil((2 * F.col("_to") - F.col("_w")) * bins / (2 * F.col("_all"))) - 1
    passed = F.when(F.col("_i") == 1, 0).when(F.col("_size") <= bins, F.col("_i") - 1).otherwise(passed)
    r = prefix_scan(r.withColumn("_lag", passed - F.col("_i")), ["input"], ["x"], F.col("_band"),
                    {"_here": ("min", "_lag"), "_there": ("min_before", "_lag")}, rows=rows)
    cuts = {c: [] for c in names}
    for c, at in r.filter((F.col("_i") > 1) & (F.col("_here") + 1 > F.col("_there"))).select("input", (F.col("_before") + F.col("x")) / 2).collect():
        cuts[c].append(at)
    return {c: sorted(v) for c, v in cuts.items()}


class BinnedTrees:
    """Boosted trees on counted rows: inputs become bins, equal rows one weighted row.

    The trees read at most ``2 * bins ** len(names)`` rows however many there are, and split where
    trees on all rows would with the same candidates (``cut_points``).
    """

    def __init__(self, names, bins=32, make=None):
        self.names, self.bins, self.make = list(names), bins, make or gbt

    def fit(self, df, label="label", weight="n"):
        self.cuts = cut_points(df, self.names, self.bins, weight)
        cells = self._binned(df).groupBy(*self._ins, F.col(label).cast("double").alias("label")).agg(F.sum(weight).cast("double").alias("n"))
        cells = written(cells, "cells")
        self.n_cells = cells.count()
        # As many bins as make the trees look for their candidates in all cells instead of a sample.
        self.fitted = self.make(maxBins=max(self.bins, math.isqrt(self.n_cells) + 1), weightCol="n").fit(self._vector(cells))
        return self

    @property
    def _ins(self):
        return [f"_bin_{c}" for c in self.names]

    def _binned(self, df):
        # A value equal to a cut belongs below it, as in the trees.
        cut = {c: [-math.inf, *[math.nextafter(x, math.inf) for x in v], math.inf] for c, v in self.cuts.items() if v}
        if cut:
            df = Bucketizer(inputCols=list(cut), outputCols=[f"_bin_{c}" for c in cut], splitsArray=list(cut.values())).transform(df)
        for c in cut:  # marked as categories by the bucketizer; bins are ordered
            df = df.withMetadata(f"_bin_{c}", {})
        return df.withColumns({f"_bin_{c}": F.lit(0.0) for c in self.names if c not in cut})

    def _vector(self, df):
        return VectorAssembler(inputCols=self._ins, outputCol="features").transform(df).drop(*self._ins)

    def transform(self, df):
        return self.fitted.transform(self._vector(self._binned(df.drop("features"))))


def evaluation(scored, classes, y="y"):
    """Delta and ordinal metrics plus log loss, in one row."""
    o = M.ordinal_metrics(scored, y)
    return M.delta_metrics(scored, y, "pred").withColumns({
        "mean_rank_error": o.select("mean_rank_error").scalar(), "ordinal_loss": o.select("ordinal_loss").scalar(),
        "log_loss": M.log_loss(scored, y).select("log_loss").scalar()})


def importances(model, names):
    """(feature, weight) of a fitted tree or linear model; one row per feature."""
    model = getattr(model, "fitted", model)
    v = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return [(n, float(abs(x))) for n, x in zip(names, v.toArray())]


def gbt(**kw):
    return GBTClassifier(**{"maxIter": 30, "maxDepth": 5, "seed": 7, **kw})
