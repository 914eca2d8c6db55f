"""Evaluation metrics as grouped aggregates."""

from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.timeutil import col
from ..session import written
from .chunked import TASK_ROWS, prefix_scan, value_chunk


def delta_metrics(df, y, pred, by=()):
    e = F.abs(col(y) - col(pred))
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(e == 0).alias("accuracy"), F.avg(e.cast("double")).alias("mae"),
        share(e == 1).alias("off_by_1"), share(e >= 2).alias("off_by_2plus"),
        share(e <= 1).alias("within_1"), share(e <= 2).alias("within_2"))


def ordinal_metrics(df, y="y", p="p", classes="classes", by=()):
    """Mean rank error and expected squared rank error."""
    rank = F.array_position(col(classes), col(y)) - 1
    pred = F.array_position(col(p), F.array_max(col(p))) - 1
    sq = P.total(F.transform(col(p), lambda x, i: x * (i - rank) * (i - rank)))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(rank - pred).cast("double")).alias("mean_rank_error"),
                               F.avg(sq).alias("ordinal_loss"))


def _per_threshold(df, classes, expr, by=()):
    """One aggregate per class threshold from a single scan of the rows."""
    aggs = {f"t{i}": e for i, e in enumerate(expr)}
    wide = df.groupBy(*by).agg(*[e.alias(n) for n, e in aggs.items()])
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"t{i}").alias("score")) for i, k in enumerate(classes)])
    return wide.select(*by, F.explode(items).alias("_x")).select(*by, "_x.*")


def cumulative_accuracy(df, classes, y="y", p="p"):
    """How often P(y>=k) > 0.5 agrees with y >= k."""
    ks = classes[1:]
    return _per_threshold(df, ks, [F.avg(((P.mass(p, "classes", k) > 0.5) == (col(y) >= k)).cast("double")) for k in ks])


def cumulative_brier(df, classes, y="y", p="p"):
    ks = classes[1:]
    d = lambda k: P.mass(p, "classes", k) - (col(y) >= k).cast("double")
    return _per_threshold(df, ks, [F.avg(d(k) * d(k)) for k in ks])


def bracket_brier(df, threshold, settled, p="p", classes="classes", base="t_base"):
    q = P.mass(p, classes, F.lit(threshold) - col(base))
    hit = (col(settled) >= threshold).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(q).alias("mean_prob"), F.avg(hit).alias("hit_rate"),
                  F.avg((q - hit) * (q - hit)).alias("brier"))


def log_loss(df, y="y", p="p", classes="classes", eps=1e-15):
    """Mean negative log probability of the true class, probabilities clipped."""
    q = F.element_at(col(p), F.array_position(col(classes), col(y)).cast("int"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(-F.ln(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), q)))).alias("log_loss"))


def calibration_bins(df, prob, hit, bins=10, by=()):
    b = F.least(F.floor(col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(col(prob)).alias("mean_pred"),
                                               F.avg(col(hit).cast("double")).alias("observed"))


def expected_calibration_error(long, prob="p", hit="hit", cls="k", bins=10):
    c = calibration_bins(long, prob, hit, bins, [cls])
    return c.agg((F.sum(F.col("n") * F.abs(F.col("mean_pred") - F.col("observed"))) / F.sum("n")).alias("ece"))


def auc(df, score, label, bands=1000, weight=None):
    """Exact rank-sum ROC AUC; ``weight`` counts equal rows.

    Scores are first counted per distinct value (map-side), so a score shared by
    very many rows is one row; the running negatives are then accumulated over
    score bands in [0, 1], not in one global sort. More distinct scores than a task
    should hold may lie within one such band: they are dealt by their number.
    """
    w = F.lit(1) if weight is None else col(weight)
    c = df.groupBy(col(score).alias("s")).agg(F.sum(w * col(label)).alias("pos"), F.sum(w * (1 - col(label))).alias("neg"))
    c = written(c, "scores")
    n = c.count()
    band = F.floor(F.col("s") * bands).cast("long")
    if n > TASK_ROWS:
        c, band = value_chunk(c, "s", n), F.col("_band")
    r = prefix_scan(c, [], ["s"], band, {"below": ("sum", "neg")}, inclusive=False, rows=n)
    wins = F.sum(F.col("pos") * (F.coalesce("below", F.lit(0)) + F.col("neg") / 2))
    return r.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), (wins / F.sum("pos") / F.sum("neg")).alias("auc"))


# Bucket edges in hours to close, and their names.
HORIZON_EDGES = [0, 2, 6, 12, 18, 24]
HORIZON_NAMES = ["0-2h", "2-6h", "6-12h", "12-18h", "18-24h", "24h+"]


def horizon_bucket(hours):
    h = col(hours)
    e = F.lit(HORIZON_NAMES[-1])
    for lo, hi, name in reversed(list(zip(HORIZON_EDGES[:-1], HORIZON_EDGES[1:], HORIZON_NAMES[:-1]))):
        e = F.when((h >= lo) & (h < hi), name).otherwise(e)
    return e


def skill_by_horizon(df, hours, y, pred, raw, clip=(-2, 10)):
    """Metrics per hours-to-close bucket; empty buckets are kept."""
    b = df.withColumn("bucket", horizon_bucket(hours))
    m = delta_metrics(b, y, pred, ["bucket"]).drop("off_by_1", "off_by_2plus")
    r = b.groupBy("bucket").agg(F.stddev_pop(col(raw)).alias("raw_std"), F.avg(col(raw).cast("double")).alias("raw_mean"),
                                (F.avg((col(raw) < clip[0]).cast("double")) * 100).alias("clip_low_pct"),
                                (F.avg((col(raw) > clip[1]).cast("double")) * 100).alias("clip_high_pct"))
    names = df.sparkSession.createDataFrame([(n,) for n in HORIZON_NAMES], "bucket string")
    return names.join(m, "bucket", "left").join(r, "bucket", "left").fillna(0, ["n"])


def risk_multipliers(skill, baseline="0-2h"):
    """Size multiplier in [0.05, 1] and edge multiplier in [1, 3] relative to a bucket.
    ``skill`` has one row per bucket."""
    base = skill.filter(F.col("bucket") == baseline).agg(F.coalesce(F.max("raw_std"), F.lit(1.0)).alias("_b"))
    v, b = F.col("raw_std"), F.col("_b")
    return skill.filter(v.isNotNull() & (v > 0)).withColumn("_b", base.scalar()).select(
        "bucket", v, F.least(F.lit(1.0), F.greatest(F.lit(0.05), b * b / (v * v))).alias("size_mult"),
        F.greatest(F.lit(1.0), F.least(F.lit(3.0), v / b)).alias("edge_mult"))
