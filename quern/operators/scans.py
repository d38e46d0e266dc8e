"""Scans in time order and by score: anchors at least a gap apart, budgets, suppression of overlaps."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.segments import chain_merge, iou

#: Gaps of a block in time; the distinct times of a block are held together.
GAPS = 64
#: Rows of a run of overlapping segments from which its local maxima are taken out first, and most rounds of that.
LARGE, ROUNDS = 100_000, 20


def _next(times: np.ndarray, start: np.ndarray, gap: float, strict: bool) -> np.ndarray:
    """For each start the first place in sorted times that is gap or more (more, if strict) after it; len(times) for none."""
    far = (lambda at: times[at] - start > gap) if strict else (lambda at: times[at] - start >= gap)
    n = len(times)
    at = np.searchsorted(times, start + gap)
    # The sum is rounded otherwise than the difference that counts.
    while (back := (at > 0) & far(np.maximum(at - 1, 0))).any():
        at = at - back
    while (on := (at < n) & ~far(np.minimum(at, n - 1))).any():
        at = at + on
    return at


def _after(times: np.ndarray, at: np.ndarray, gap: float, strict: bool) -> np.ndarray:
    """For each time of blocks, which lie one after the other from ``at`` on, the first place of its block that is far enough; its block's end for none."""
    end = np.repeat(at[1:], np.diff(at))
    lo, hi = np.arange(len(times)) + 1, end.copy()
    # Halves the range of all of them at once.
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        d = times[np.minimum(mid, len(times) - 1)] - times
        far = (d > gap if strict else d >= gap) & open_
        hi, lo = np.where(far, mid, hi), np.where(open_ & ~far, mid + 1, lo)
    return lo


def _exits(times: np.ndarray, at: np.ndarray, gap: float, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times that may be their block's first anchor, whatever came before, and the last anchor that each leads to; and offsets of blocks in these."""
    after, end = _after(times, at, gap, strict), np.repeat(at[1:], np.diff(at))
    last = np.where(after < end, after, np.arange(len(times)))
    while (more := last[last] != last).any():
        last = np.where(more, last[last], last)
    # The first time of a block that is far from its first, and all before it.
    first = np.arange(len(times)) <= np.repeat(after[at[:-1]], np.diff(at))
    counts = np.add.reduceat(first, at[:-1], dtype=np.int64) if len(times) else np.zeros(0, np.int64)
    return times[first], times[last[first]], np.concatenate(([0], np.cumsum(counts)))


def _walked(times: np.ndarray, at: np.ndarray, entry: np.ndarray, gap: float, strict: bool) -> np.ndarray:
    """Which times are anchors, given the last anchor before each block (nan for none). All blocks go on a step at a time."""
    after, taken = _after(times, at, gap, strict), np.zeros(len(times), bool)
    now, end = at[:-1].copy(), at[1:]
    d = times - np.repeat(entry, np.diff(at))
    near = np.add.reduceat(~(np.isnan(d) | (d > gap if strict else d >= gap)), at[:-1], dtype=np.int64) if len(times) else 0
    now = now + near
    while (on := now < end).any():
        now, end = now[on], end[on]
        taken[now] = True
        now = after[now]
    return taken


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, none of them empty, and their offsets."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))


def _split(column: pa.ListArray) -> list[np.ndarray]:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


def anchor_blocks(rows: DataFrame, key: str, ts: str, gap: float, strict: bool = False, gaps: int = GAPS) -> DataFrame:
    """key, _block, entry (the last anchor before the block, or null) and anchors (array) of each block in time of a key.

    A key's first time is an anchor, and so is each that is gap or more after the last anchor. Blocks are scanned for themselves: each gives
    the last anchor for every first one that it may have. A pass over these short rows in the order of blocks finds
    which it has, and the blocks are scanned again from there. So a key with very many rows is spread over its blocks' tasks.
    """
    held = rows.where(F.col(ts).isNotNull()).select(F.col(key).alias("_key"), F.col(ts).cast("double").alias("_t"))
    held = held.groupBy("_key", block_of("_t", gap * gaps).alias("_block")).agg(F.array_sort(F.collect_set("_t")).alias("_times"))

    def ends(batches):
        for batch in batches:
            first, last, at = _exits(*_flat(batch.column(2)), gap, strict)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(first, at), _lists(last, at)], names=["_key", "_block", "firsts", "lasts"])

    def chain(batches):
        # Sorted by key and block; the state is a key and its last anchor.
        now, last = object(), None
        for batch in batches:
            entries = []
            for name, first, exit_ in zip(batch.column(0).to_pylist(), _split(batch.column(2)), _split(batch.column(3)), strict=True):
                if name != now:
                    now, last = name, None
                entries.append(last)
                at = 0 if last is None else int(_next(first, np.array([last]), gap, strict)[0])
                # Beyond the last of them there is no row far enough, and the anchor stays.
                last = float(exit_[at]) if at < len(first) else last
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.float64())], names=["_key", "_block", "entry"])

    def walk(batches):
        for batch in batches:
            times, at = _flat(batch.column(2))
            taken = _walked(times, at, batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64), gap, strict)
            ends = np.concatenate(([0], np.cumsum(taken)))[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), _lists(times[taken], ends)], names=["_key", "_block", "entry", "anchors"])

    base = held.select("_key", "_block").schema
    several = "array<double>"
    summary = held.mapInArrow(ends, _with(base, firsts=several, lasts=several))
    entries = summary.repartition("_key").sortWithinPartitions("_key", "_block").mapInArrow(chain, _with(base, entry="double"))
    same = (F.col("a._key").eqNullSafe(F.col("b._key"))) & (F.col("a._block") == F.col("b._block"))
    both = held.alias("a").join(entries.alias("b"), same).select("a._key", "a._block", "_times", "entry")
    return both.mapInArrow(walk, _with(base, entry="double", anchors=several)).withColumnRenamed("_key", key)


def block_of(ts: str, width: float) -> Column:
    return F.floor(F.col(ts) / width).cast("long")


def _with(schema, **more):
    kinds = {"double": T.DoubleType(), "array<double>": T.ArrayType(T.DoubleType())}
    return T.StructType([*schema.fields, *(T.StructField(name, kinds[kind]) for name, kind in more.items())])


def anchors(rows: DataFrame, key: str, ts: str, gap: float, strict: bool = False, gaps: int = GAPS) -> DataFrame:
    """key, ts of the anchors of each key."""
    blocks = anchor_blocks(rows, key, ts, gap, strict, gaps)
    return blocks.select(key, F.explode("anchors").alias(ts))


def anchored(rows: DataFrame, key: str, ts: str, gap: float, strict: bool = False, gaps: int = GAPS) -> DataFrame:
    """Rows with anchor: the anchor that each joins, the last one up to its time. Rows without a time are left out."""
    blocks = anchor_blocks(rows, key, ts, gap, strict, gaps).withColumnRenamed(key, "_key")
    mine = F.array_max(F.filter("anchors", lambda x: x <= F.col(ts)))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == block_of(ts, gap * gaps))
    return rows.where(F.col(ts).isNotNull()).join(blocks, same).withColumn("anchor", F.coalesce(mine, "entry")).drop("_key", "_block", "entry", "anchors")


def budgeted(intervals: DataFrame, key: str, most: int = 10, total: float = 60.0, least: float = 0.2, length: str | None = None) -> DataFrame:
    """key, start, end, score of the intervals taken by score while there are fewer than ``most`` and time is left.

    One that is longer than what is left is cut to it; where less than ``least`` is left, a longer one is passed over. Rows go by in the order of
    score, then start, with the time and number taken as state. Ties at the same start go by end. ``length`` names a column of lengths that are
    known better than as end - start, which is rounded.
    """
    kinds = [f.dataType.simpleString() for f in intervals.select(key).schema]

    def run(batches):
        now, used, n = object(), 0.0, 0
        for batch in batches:
            out = []
            for at, (name, a, b, size) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True)):
                if name != now:
                    now, used, n = name, 0.0, 0
                if n >= most:
                    continue
                left = total - used
                if size > left:
                    if left < least:
                        continue
                    b = min(b, a + total - used)
                out.append((at, b))
                used, n = used + min(size, left), n + 1
            kept = batch.take(pa.array([r for r, _ in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array([b for _, b in out], pa.float64()), kept.column(3)], names=[key, "start", "end", "score"])

    size = F.col(length) if length else F.col("end") - F.col("start")
    slim = intervals.select(key, *[F.col(c).cast("double").alias(c) for c in ("start", "end", "score")], size.cast("double").alias("_length"))
    ordered = slim.repartition(key).sortWithinPartitions(key, F.col("score").desc(), "start", "end")
    return ordered.mapInArrow(run, f"{key} {kinds[0]}, start double, end double, score double")


def interest_plan(intervals: DataFrame, key: str, expand: float = 0.3, gap: float = 0.5, most: int = 10, total: float = 60.0, least: float = 0.2) -> DataFrame:
    """Intervals widened on both sides (not below 0), merged where they come within gap of each other, and taken by score within the budget."""
    wide = intervals.select(key, F.greatest(F.lit(0.0), F.col("start") - expand).alias("start"), (F.col("end") + expand).alias("end"), "score")
    return budgeted(chain_merge(wide, key, gap), key, most, total, least)


def _overlap(a0, a1, b0, b1):
    """IoU over the hull of one interval with many."""
    both = np.maximum(np.minimum(a1, b1) - np.maximum(a0, b0), 0.0)
    hull = np.maximum(a1, b1) - np.minimum(a0, b0)
    return np.divide(both, hull, out=np.zeros_like(both), where=hull > 0)


def greedy_kept(start: np.ndarray, end: np.ndarray, score: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the segments kept by score (then start), each unless it overlaps one kept by the threshold or more."""
    order = np.lexsort((end, start, -score))
    by_start = np.argsort(start, kind="stable")
    starts, ends = start[by_start], end[by_start]
    longest = (end - start).max() if len(start) else 0.0
    place = np.empty(len(start), np.int64)
    place[by_start] = np.arange(len(start))
    alive, kept = np.ones(len(start), bool), []
    for k in order.tolist():
        p = place[k]
        if not alive[p]:
            continue
        kept.append(k)
        # Only segments whose start lies in reach can overlap it.
        lo, hi = np.searchsorted(starts, start[k] - longest, "left"), np.searchsorted(starts, end[k], "right")
        alive[lo:hi] &= _overlap(start[k], end[k], starts[lo:hi], ends[lo:hi]) < threshold
    return np.array(kept, np.int64)


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in spark.checkpoint.dir; in local mode, where that is unset, in a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return df.checkpoint()


def suppressed(segments: DataFrame, key: str, threshold: float, large: int = LARGE) -> DataFrame:
    """key, start, end, score of the segments kept: by score, then start, each if its IoU with every kept one is below the threshold (above 0).

    Segments are dealt into buckets as wide as the longest, so that overlapping ones lie in the same or neighbouring buckets; runs of occupied
    buckets don't touch each other and are worked on for themselves. In runs of more than ``large`` rows, the best of a bucket that
    is better than its neighbours' best is kept and what it suppresses goes, which parts the run, until none is so large.
    """
    width = segments.agg(F.max(F.col("end") - F.col("start")).alias("w")).first()["w"] or 0.0
    width = width if width > 0 else 1.0
    rows = segments.select(key, *[F.col(c).cast("double").alias(c) for c in ("start", "end", "score")]).distinct().withColumn("_b", block_of("start", width))
    kept = rows.limit(0).drop("_b")
    for round_ in range(ROUNDS + 1):
        by = Window.partitionBy(key).orderBy("_b")
        counts = rows.groupBy(key, "_b").agg(F.count("*").alias("n"))
        new = F.coalesce(F.col("_b") - F.lag("_b").over(by) > 1, F.lit(True)).cast("int")
        runs = counts.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).select(F.col(key).alias("_k"), F.col("_b").alias("_c"), "_run", "n")
        most = runs.groupBy("_k", "_run").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        if most <= large or round_ == ROUNDS:
            break
        order = F.struct("score", (-F.col("start")).alias("s"), (-F.col("end")).alias("e"))
        best = rows.groupBy(key, "_b").agg(F.max(order).alias("m"))
        beside = best.select(F.col(key).alias("_k"), F.explode(F.array(F.col("_b") - 1, F.col("_b") + 1)).alias("_c"), F.col("m").alias("o")).groupBy("_k", "_c").agg(F.max("o").alias("o"))
        top = best.join(beside, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")), "left").where("o IS NULL OR m > o")
        top = top.select(F.col(key).alias("_k"), (-F.col("m.s")).alias("s"), (-F.col("m.e")).alias("e"), F.col("m.score").alias("v"), F.col("_b").alias("_c"))
        kept = kept.unionByName(top.select(F.col("_k").alias(key), F.col("s").alias("start"), F.col("e").alias("end"), F.col("v").alias("score")))
        reach = top.withColumn("_c", F.explode(F.array(F.col("_c") - 1, "_c", F.col("_c") + 1)))
        hit = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")) & (iou(F.col("start"), F.col("end"), F.col("s"), F.col("e")) >= threshold)
        rows, kept = _cut(rows.join(reach, hit, "left_anti")), _cut(kept)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                cells = batch.column(1)[k].values
                s, e, v = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "score"))
                stay = greedy_kept(s, e, v, threshold)
                names = batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(stay), np.int64)))
                yield pa.RecordBatch.from_arrays([names, *(pa.array(x[stay]) for x in (s, e, v))], names=[key, "start", "end", "score"])

    lists = rows.join(runs, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c"))).groupBy(key, "_run").agg(F.collect_list(F.struct("start", "end", "score")).alias("x"))
    return kept.unionByName(lists.select(key, "x").mapInArrow(run, rows.drop("_b").schema))


def best_spaced(rows: DataFrame, key: str, ts: str, score: str, most: int = 8, gap: float = 0.3) -> DataFrame:
    """key, ts, score of the ``most`` best rows of each key that lie more than gap apart: by score, then time.

    A pass over a key's rows by score with at most ``most`` times as state; it ends where these are full.
    """
    slim = rows.select(key, F.col(ts).cast("double").alias(ts), F.col(score).cast("double").alias(score))

    def run(batches):
        now, kept = object(), []
        for batch in batches:
            out = []
            for at, (name, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if name != now:
                    now, kept = name, []
                if len(kept) < most and all(abs(t - k) > gap for k in kept):
                    kept.append(t)
                    out.append(at)
            yield batch.take(pa.array(out, pa.int64()))

    return slim.repartition(key).sortWithinPartitions(key, F.col(score).desc(), ts).mapInArrow(run, slim.schema)
