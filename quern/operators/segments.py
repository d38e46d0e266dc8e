"""Segments and sampling: smoothing, islands, merges, grids, masks, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smoothed(rows: DataFrame, key: str, ts: str, score: str, w: int = 3) -> DataFrame:
    """Adds smooth: the moving sum over w rows divided by w, with zeros beyond the ends."""
    # A series shorter than the window is the one that slides: w results come of it, of which the series' own are kept.
    back = (w - 1) // 2
    by = Window.partitionBy(key)
    mean = F.sum(score).over(by.orderBy(ts).rowsBetween(back - w + 1, back)) / w
    n = F.count("*").over(by)
    short = mean
    for m in range(1, w):
        low = (m - 1) // 2
        # Place i of the result takes in the rows up to i + low, and as many before as the window has.
        short = F.when(n == m, F.sum(score).over(by.orderBy(ts).rowsBetween(low - w + 1, low)) / w).otherwise(short)
    return rows.withColumn("smooth", short)


def islands(rows: DataFrame, key: str, ts: str, value: str, threshold: Column) -> DataFrame:
    """key, start, end, score of maximal runs of rows with value at or above the threshold."""
    w = Window.partitionBy(key).orderBy(ts)
    flagged = rows.withColumn("_on", F.col(value) >= threshold)
    new = F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    runs = flagged.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("_on").groupBy(key, "_run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.max(value).alias("score")).drop("_run")


def chain_merge(rows: DataFrame, key: str, gap: float) -> DataFrame:
    """Intervals (start, end, score) merged while the next starts within gap of the furthest end so far."""
    w = Window.partitionBy(key).orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.coalesce((F.col("start") - far > gap).cast("int"), F.lit(1)))
    chained = marked.withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy(key, "_chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("_chain")


def segments(rows: DataFrame, key: str, ts: str, score: str, pct: float = 0.8, w: int = 3, gap: float = 0.8, least: float = 0.3, k: int = 5) -> DataFrame:
    """The k best segments of each key, rank from 1: smooth, cut at the percentile, merge, drop short ones."""
    s = smoothed(rows, key, ts, score, w)
    cut = s.groupBy(key).agg(F.percentile("smooth", F.lit(pct)).alias("cut"))
    merged = chain_merge(islands(s.join(cut, key), key, ts, "smooth", F.col("cut")), key, gap).where(F.col("end") - F.col("start") >= least)
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "start")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals over their hull; 0 for an empty hull."""
    both, hull = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)), F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, both / hull).otherwise(0.0)


def uniform_grid(videos: DataFrame, fps: float, most: int) -> DataFrame:
    """video_id, i, ts: steps of 1 / fps over [0, duration), or ``most`` even ones where there would be more."""
    n = F.ceil(F.col("duration") * fps).cast("int")
    g = videos.withColumn("_n", n).where("_n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.col("_n"), F.lit(most)) - 1)))
    return g.select("video_id", "i", F.when(F.col("_n") > most, F.col("i") * F.col("duration") / most).otherwise(F.col("i") / fps).alias("ts"))


def nearest_gap(left: DataFrame, right: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Rows of left with gap: the time to the nearest row of right with the same key; null for none."""
    both = left.select(key, ts, F.lit(0).alias("_r")).unionByName(right.select(key, ts, F.lit(1).alias("_r")))
    mine = F.when(F.col("_r") == 1, F.col(ts))
    # Running values from both ends; at equal times rows of right come first in each direction.
    w = lambda time: Window.partitionBy(key).orderBy(time, F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"_b": F.max(mine).over(w(F.col(ts))), "_a": F.min(mine).over(w(F.col(ts).desc()))})
    return near.where("_r = 0").select(key, ts, F.least(F.col(ts) - F.col("_b"), F.col("_a") - F.col(ts)).alias("gap"))
