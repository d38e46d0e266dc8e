"""Measures between predicted and true segments, and joins in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.segments import iou


def overlaps(pred: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Pairs of predicted (p0, p1, score) and true (g0, g1) segments of one key that overlap, with iou; each pair once.

    Both sides are dealt by the buckets in time that they touch, twice their mean length wide, so that a key with very many segments is spread, and
    segments far from each other never meet.
    """
    p = pred.select(key, F.col("start").alias("p0"), F.col("end").alias("p1"), F.col("score").alias("p_score"))
    g = truth.select(key, F.col("start").alias("g0"), F.col("end").alias("g1"))
    mean = p.select((F.col("p1") - F.col("p0")).alias("l")).unionByName(g.select((F.col("g1") - F.col("g0")).alias("l"))).agg(F.avg("l").alias("l")).first()["l"]
    width = 2 * mean if mean and mean > 0 else 1.0
    at = lambda c: F.floor(c / width).cast("long")
    touched = lambda df, lo, hi: df.where(F.col(hi) > F.col(lo)).withColumn("_b", F.explode(F.sequence(at(F.col(lo)), at(F.col(hi)))))
    both = touched(p, "p0", "p1").join(touched(g, "g0", "g1"), [key, "_b"])
    # The first bucket that both touch stands for the pair.
    both = both.where((F.col("p0") < F.col("g1")) & (F.col("g0") < F.col("p1")) & (F.col("_b") == at(F.greatest("p0", "g0")))).drop("_b")
    return both.withColumn("iou", iou(F.col("p0"), F.col("p1"), F.col("g0"), F.col("g1")))


def mean_iou(pred: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """key, mean_iou (best match both ways, averaged; 0 if one side is empty), boundary_mae (best match of each true one; null for none).

    A true segment that no predicted one overlaps is matched with the first of its key.
    """
    pairs = overlaps(pred, truth, key)
    preds = pred.select(key, F.col("start").alias("p0"), F.col("end").alias("p1"), F.col("score").alias("p_score")).distinct()
    truths = truth.select(key, F.col("start").alias("g0"), F.col("end").alias("g1")).distinct()
    first = preds.groupBy(key).agg(F.min(F.struct("p0", "p1")).alias("f"))
    has = truths.select(key).distinct()
    best_p = pairs.groupBy(key, "p0", "p1", "p_score").agg(F.max("iou").alias("x"))
    a = preds.join(has, key, "left_semi").join(best_p, [key, "p0", "p1", "p_score"], "left").groupBy(key).agg(F.avg(F.coalesce("x", F.lit(0.0))).alias("a"))
    error = F.abs(F.col("p0") - F.col("g0")) + F.abs(F.col("p1") - F.col("g1"))
    best_g = pairs.withColumn("e", error).groupBy(key, "g0", "g1").agg(F.max("iou").alias("x"), F.max_by("e", F.struct("iou", -F.col("p0"))).alias("e"))
    far = F.abs(F.col("f.p0") - F.col("g0")) + F.abs(F.col("f.p1") - F.col("g1"))
    matched = truths.join(first, key).join(best_g, [key, "g0", "g1"], "left").withColumn("e", F.coalesce("e", far))
    b = matched.groupBy(key).agg(F.avg(F.coalesce("x", F.lit(0.0))).alias("b"), F.avg("e").alias("boundary_mae"))
    keys = pred.select(key).unionByName(truth.select(key)).distinct()
    out = keys.join(a, key, "left").join(b, key, "left")
    return out.select(key, F.coalesce((F.col("a") + F.col("b")) / 2, F.lit(0.0)).alias("mean_iou"), "boundary_mae")


def recall_at(pred: DataFrame, truth: DataFrame, key: str, k: int, threshold: float) -> DataFrame:
    """One row: share of the keys with predictions of which one of the k best reaches the threshold (above 0) with a true one."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "start")
    top = pred.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    hit = overlaps(top, truth, key).where(F.col("iou") >= threshold).select(key).distinct().withColumn("hit", F.lit(1.0))
    return pred.select(key).distinct().join(hit, key, "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


#: Thresholds of the mean average precision.
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


def average_precision(pred: DataFrame, truth: DataFrame, key: str, thresholds=THRESHOLDS) -> DataFrame:
    """key, threshold, ap: 11-point average precision of the predictions by score, at thresholds above 0. Keys with both sides."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "start")
    ranked = pred.withColumn("_rank", F.row_number().over(order)).withColumnsRenamed({"start": "p0", "end": "p1", "score": "p_score"})
    best = overlaps(pred, truth, key).groupBy(key, "p0", "p1", "p_score").agg(F.max("iou").alias("iou"))
    n = truth.groupBy(key).agg(F.count("*").alias("_n"))
    scored = ranked.join(n, key).join(best, [key, "p0", "p1", "p_score"], "left").select(key, "_rank", "_n", F.coalesce("iou", F.lit(0.0)).alias("iou"))
    rows = scored.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    by = Window.partitionBy(key, "threshold").orderBy("_rank")
    rows = rows.withColumn("tp", F.sum((F.col("iou") >= F.col("threshold")).cast("int")).over(by))
    rows = rows.withColumns({"precision": F.col("tp") / (F.col("_rank") + 1e-9), "recall": F.col("tp") / F.col("_n")})
    at = [F.coalesce(F.max(F.when(F.col("recall") >= r / 10, F.col("precision"))), F.lit(0.0)) for r in range(11)]
    return rows.groupBy(key, "threshold").agg((sum(at[1:], at[0]) / 11).alias("ap"))


def mean_average_precision(pred: DataFrame, truth: DataFrame, key: str, thresholds=THRESHOLDS) -> DataFrame:
    """One row: map, the mean over keys and thresholds, and map_at_half, that at the threshold 0.5."""
    each = average_precision(pred, truth, key, thresholds)
    return each.agg(F.avg("ap").alias("map"), F.avg(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("map_at_half"))


def tolerance_join(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Rows of left and right (both with ts) whose times round to the same bucket of ``width``, half to even: key, bucket, n_left, n_right."""
    bucket = F.bround(F.col("ts") / width, 0).cast("long")
    a = left.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n_left"))
    return a.join(right.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n_right")), [key, "bucket"])


def inside(points: DataFrame, intervals: DataFrame, key: str, width: float) -> DataFrame:
    """Rows of points (ts) with start and end of each interval that holds them. Both meet by buckets of ``width`` that an interval touches."""
    b = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = intervals.withColumn("_b", F.explode(F.sequence(b("start"), b("end")))).select(key, "start", "end", "_b")
    return points.withColumn("_b", b("ts")).join(spread, [key, "_b"]).where("ts BETWEEN start AND end").drop("_b")


def _variance(values: Column) -> Column:
    """Population variance of a short array by running means, each step as DuckDB rounds it: a variance that equals a threshold falls on the same side."""

    def step(a, x):
        n = a["n"] + 1
        return F.element_at(F.transform(F.array(a["mean"] + (x - a["mean"]) / n), lambda mean: F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + (x - mean) * (x - a["mean"])).alias("m2"))), 1)

    return F.aggregate(values, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), step, lambda a: F.when(a["n"] > 0, a["m2"] / a["n"]))


def variance_runs(rows: DataFrame, durations: DataFrame, key: str, order: str, value: str, fps: float, below: float) -> DataFrame:
    """key, start, end in seconds of runs of windows whose variance is below a threshold.

    Windows of max(4, fps / 2) rows start half a window apart, before the last window's length; a series shorter than that is one window,
    of one row none. A run ends where the first window that isn't still starts; one that is open ends with the
    video. durations: key, duration.
    """
    win = max(4, int(fps * 0.5))
    step = win // 2
    w = Window.partitionBy(key).orderBy(order)
    r = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(key)), "_w": F.collect_list(value).over(w.rowsBetween(0, win - 1))})
    r = r.where((F.col("_n") > 1) & (F.col("_i") % step == 0) & ((F.col("_i") < F.col("_n") - win) | (F.col("_i") == 0))).withColumn("_v", _variance(F.col("_w"))).drop("_w")
    again = Window.partitionBy(key).orderBy("_i")
    r = r.withColumns({"_low": F.col("_v") < below, "_next": F.lead("_i").over(again)}).withColumn("_run", F.sum((~F.col("_low")).cast("int")).over(again))
    runs = r.where("_low").groupBy(key, "_run").agg(F.min("_i").alias("_first"), F.max_by(F.struct("_next"), "_i").alias("_last"))
    return runs.join(durations, key).select(key, (F.col("_first") / fps).alias("start"), F.coalesce(F.col("_last._next") / fps, F.col("duration")).alias("end"))
