"""Sampling plans: which frames of a video tasks ask for, merged, masked and thinned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.scans import GAPS, anchored, anchors

MERGE_GAP, FPS, BUCKETS = 0.05, 25.0, 10
#: Seconds of a plan that are merged together.
BLOCK = 60
#: Buckets of a mask that go in one number.
WORD = 64


def _grid(fps: Column, most: Column, duration: Column) -> Column:
    """Array of times from 0 in steps of 1 / fps below the duration, or ``most`` even ones where there would be more."""
    d = F.greatest(duration, F.lit(1e-6))
    n = F.ceil(d / (1 / fps)).cast("int")
    steps = F.sequence(F.lit(0), F.least(n, most) - 1)
    return F.when(n > most, F.transform(steps, lambda i: i * d / most)).otherwise(F.transform(steps, lambda i: i * (1 / fps)))


def sparse_proposals(videos: DataFrame, tasks: DataFrame) -> DataFrame:
    """video_id, task_id, ts of the preview plan. tasks: task_id, sparse_fps, max_sparse, gated_by; gated ones and those without a rate ask nothing."""
    t = tasks.where("gated_by IS NULL AND sparse_fps > 0")
    # Tasks are a stated set of a few rows.
    return videos.crossJoin(F.broadcast(t)).select("video_id", "task_id", F.explode(_grid(F.col("sparse_fps"), F.col("max_sparse"), F.col("duration"))).alias("ts"))


def dense_proposals(intervals: DataFrame, tasks: DataFrame) -> DataFrame:
    """video_id, task_id, ts inside intervals (start, end), for tasks that raise interest or are gated; the first max_dense of each in time."""
    t = tasks.where("(can_interest OR gated_by IS NOT NULL) AND dense_fps > 0")
    n = F.ceil((F.col("end") - F.col("start")) / (1 / F.col("dense_fps"))).cast("int")
    rows = intervals.crossJoin(F.broadcast(t)).where(n > 0).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.select("video_id", "task_id", "max_dense", F.bround(F.col("start") + F.col("i") * (1 / F.col("dense_fps")), 3).alias("ts")).distinct()
    w = Window.partitionBy("video_id", "task_id").orderBy("ts")
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= F.col("max_dense")).select("video_id", "task_id", "ts")


def merged(proposals: DataFrame, gap: float = MERGE_GAP) -> DataFrame:
    """video_id, ts, subscribers (sorted), frame_idx: proposals less than gap after the first of a point join that point."""
    # Proposals are few a second, so that a block may be long.
    points = anchored(proposals, "video_id", "ts", gap, gaps=max(GAPS, int(BLOCK / gap)))
    plan = points.groupBy("video_id", F.col("anchor").alias("ts")).agg(F.array_sort(F.collect_set("task_id")).alias("subscribers"))
    return plan.select("video_id", "ts", "subscribers", F.floor(F.col("ts") * FPS).cast("int").alias("frame_idx"))


def union_of_samplers(samples: DataFrame, gap: float = 0.2) -> DataFrame:
    """video_id, ts, origins: samples (video_id, ts, origin) of several samplers; those up to gap after a point join it, with their origins."""
    points = anchored(samples, "video_id", "ts", gap, strict=True)
    return points.groupBy("video_id", F.col("anchor").alias("ts")).agg(F.array_join(F.array_sort(F.collect_set("origin")), "|").alias("origins"))


def mask_words(videos: DataFrame, static: DataFrame, boundaries: DataFrame, least: float = 2.0) -> DataFrame:
    """video_id, word, n, kept: :func:`static_mask` with ``WORD`` buckets to a row; bit i of kept is bucket word * WORD + i, and n are its buckets."""
    last = F.greatest(F.lit(1), F.floor(F.col("duration") * BUCKETS).cast("int"))
    word = lambda c: F.floor(c / WORD).cast("int")
    words = videos.select("video_id", last.alias("_last"), F.explode(F.sequence(F.lit(0), word(last - 1))).alias("word"))
    a, b = F.greatest(F.lit(0), F.floor(F.col("start") * BUCKETS).cast("int")) + 1, F.floor(F.col("end") * BUCKETS).cast("int") - 1
    gone = static.where(F.col("end") - F.col("start") >= least).where(b >= a).select("video_id", a.alias("_a"), b.alias("_b"), F.explode(F.sequence(word(a), word(b))).alias("word"))
    low, high = F.greatest(F.col("_a") - F.col("word") * WORD, F.lit(0)), F.least(F.col("_b") - F.col("word") * WORD, F.lit(WORD - 1))
    ones = lambda f, by: F.call_function(f, F.lit(-1).cast("long"), by)
    none = F.lit(0).cast("long")
    gone = gone.select("video_id", "word", ones("shiftleft", low).bitwiseAND(ones("shiftrightunsigned", F.lit(WORD - 1) - high)).alias("_gone"), none.alias("_back"))
    at = F.floor(F.col("ts") * BUCKETS).cast("int")
    back = boundaries.select("video_id", word(at).alias("word"), none.alias("_gone"), _bit(at).alias("_back"))
    marks = gone.unionByName(back).groupBy("video_id", "word").agg(F.bit_or("_gone").alias("_gone"), F.bit_or("_back").alias("_back"))
    # Not broadcast: Spark takes exploded rows for as few as there were before.
    rows = words.join(marks.hint("merge"), ["video_id", "word"], "left")
    kept = F.bitwise_not(F.coalesce("_gone", none)).bitwiseOR(F.coalesce("_back", none))
    return rows.select("video_id", "word", F.least(F.col("_last") - F.col("word") * WORD, F.lit(WORD)).alias("n"), kept.alias("kept"))


def _bit(bucket: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bucket, F.lit(WORD)).cast("int"))


def static_mask(videos: DataFrame, static: DataFrame, boundaries: DataFrame, least: float = 2.0) -> DataFrame:
    """video_id, bucket of 100 ms, keep. Of a static segment (start, end) of ``least`` seconds only the first bucket stays; buckets of boundaries (ts) do."""
    rows = mask_words(videos, static, boundaries, least).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    keep = F.call_function("shiftright", F.col("kept"), F.col("_i")).bitwiseAND(F.lit(1)) == 1
    return rows.select("video_id", (F.col("word") * WORD + F.col("_i")).alias("bucket"), keep.alias("keep"))


def apply_words(plan: DataFrame, words: DataFrame, exempt: list[str]) -> DataFrame:
    """Points of a merged plan whose bucket is kept by :func:`mask_words`, or that a task of ``exempt`` subscribes to."""
    free = F.arrays_overlap("subscribers", F.array(*[F.lit(t) for t in exempt])) if exempt else F.lit(False)
    at = F.floor(F.col("ts") * BUCKETS).cast("int")
    rows = plan.withColumns({"word": F.floor(at / WORD).cast("int"), "_bit": _bit(at)}).join(words.select("video_id", "word", "n", "kept").hint("merge"), ["video_id", "word"], "left")
    keep = (F.pmod(at, F.lit(WORD)) < F.col("n")) & (F.col("kept").bitwiseAND(F.col("_bit")) != 0)
    return rows.where(free | F.coalesce(keep, F.lit(False))).select(*plan.columns)


def apply_mask(plan: DataFrame, mask: DataFrame, exempt: list[str]) -> DataFrame:
    """Points of a merged plan whose bucket is kept by :func:`static_mask`, or that a task of ``exempt`` subscribes to."""
    bucket = F.col("bucket")
    words = mask.where("keep").groupBy("video_id", F.floor(bucket / WORD).cast("int").alias("word")).agg(F.bit_or(_bit(bucket)).alias("kept"), F.lit(WORD).alias("n"))
    return apply_words(plan, words, exempt)


def thinned(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key, at even places of their order: floor(i (n - 1) / (most - 1))."""
    by = Window.partitionBy(key)
    r = rows.withColumns({"_n": F.count("*").over(by), "_i": F.row_number().over(by.orderBy(order)) - 1})
    if most == 1:
        return r.where("_i = 0").drop("_n", "_i")
    # Place i is one of them if some j gives it; the least such j is ceil(i (most - 1) / (n - 1)).
    n = F.col("_n") - 1
    j = F.ceil(F.col("_i") * (most - 1) / n)
    return r.where((F.col("_n") <= most) | ((j < most) & (F.floor(j * n / (most - 1)) == F.col("_i")))).drop("_n", "_i")


def changed_frames(frames: DataFrame, key: str, ts: str, value: str, tau: float) -> DataFrame:
    """The first row of each key and those whose value is more than tau off the row before, kept or not."""
    d = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(ts)))
    return frames.withColumn("_d", d).where(F.col("_d").isNull() | (F.col("_d") > tau)).drop("_d")


def static_runs(frames: DataFrame, key: str, ts: str, value: str, threshold: float, boundary: float) -> tuple[DataFrame, DataFrame]:
    """Runs (start, end) of rows that change by less than threshold, and boundaries (ts) where they change by more than ``boundary``."""
    w = Window.partitionBy(key).orderBy(ts)
    d = frames.withColumns({"_d": F.abs(F.col(value) - F.lag(value).over(w)), "_from": F.lag(ts).over(w)})
    runs = d.withColumn("_still", F.coalesce(F.col("_d") < threshold, F.lit(False)))
    runs = runs.withColumn("_run", F.sum((~F.col("_still")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    static = runs.where("_still").groupBy(key, "_run").agg(F.min("_from").alias("start"), F.max(ts).alias("end")).drop("_run")
    return static, d.where(F.col("_d") > boundary).select(key, F.col(ts).alias("ts"))


def spaced(rows: DataFrame, key: str, ts: str, score: str, tau: float, gap: float, fallback: float | None = None) -> DataFrame:
    """key, ts of rows with a score of tau or more, each at least gap after the last one taken.

    With ``fallback`` a key without such a row gives its :func:`changed_frames` at that threshold.
    """
    taken = anchors(rows.where(F.col(score) >= tau), key, ts, gap)
    if fallback is None:
        return taken
    none = rows.groupBy(key).agg(F.max(score).alias("_m")).where((F.col("_m") < tau) | F.col("_m").isNull()).select(F.col(key).alias("_k"))
    rest = rows.join(none, F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    return taken.unionByName(changed_frames(rest, key, ts, score, fallback).select(key, ts))


def independent(videos: DataFrame, tasks: DataFrame) -> DataFrame:
    """video_id, task_id, n: frames that each task samples for itself, at its higher rate (a gated one at 0.5 or more)."""
    fps = F.when(F.col("gated_by").isNotNull(), F.greatest("dense_fps", F.lit(0.5))).otherwise(F.greatest("sparse_fps", "dense_fps"))
    return videos.crossJoin(F.broadcast(tasks)).where(fps > 0).select("video_id", "task_id", F.size(_grid(fps, F.lit(10**6), F.col("duration"))).alias("n"))


def union_fps(videos: DataFrame, tasks: DataFrame) -> DataFrame:
    """video_id, n: one grid at the highest dense rate, for all tasks."""
    top = tasks.agg(F.max("dense_fps").alias("fps"))
    return videos.crossJoin(F.broadcast(top)).select("video_id", F.size(_grid(F.col("fps"), F.lit(10**6), F.col("duration"))).alias("n"))


def interest(rows: DataFrame, key: str, ts: str, score: str, tau: float, width: float, most: int | None = None) -> DataFrame:
    """Intervals [ts - width, ts + width], cut at 0, around rows above tau; of each key the ``most`` best."""
    r = rows.where(F.col(score) > tau)
    if most:
        r = r.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc(), ts))).where(F.col("_k") <= most)
    return r.select(key, F.greatest(F.lit(0.0), F.col(ts) - width).alias("start"), (F.col(ts) + width).alias("end"), F.col(score).alias("score"))
