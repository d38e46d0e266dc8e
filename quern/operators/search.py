"""Prototypes, batch search with hubness correction, search under metadata constraints, utilities of routes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import dot, l2_normalise, mean_vector, pooled_scores

EASY, HARD = 0.08, 0.02


def prototypes(frames: DataFrame, ks=(2, 4, 6)) -> DataFrame:
    """video_id, k, slot, emb: K segment means of unit frame vectors, each made a unit vector.

    With K frames or fewer each frame is repeated instead and stays as it is.
    """
    unit = frames.select("video_id", "frame_no", l2_normalise(F.col("emb")).alias("emb"))
    video = unit.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("frame_no", "emb"))).alias("f"))
    n = F.size("f")
    rows = video.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    lo, hi = F.floor(F.col("slot") * n / F.col("k")).cast("int"), F.floor((F.col("slot") + 1) * n / F.col("k")).cast("int")
    repeat = F.ceil(F.col("k") / n).cast("int")
    part = F.when(n <= F.col("k"), F.slice("f", F.floor(F.col("slot") / repeat).cast("int") + 1, 1)).otherwise(F.slice("f", lo + 1, hi - lo))
    mean = mean_vector(F.transform(part, lambda x: x["emb"]))
    return rows.withColumn("mean", mean).select("video_id", "k", "slot", F.when(n <= F.col("k"), F.col("mean")).otherwise(l2_normalise(F.col("mean"))).alias("emb"))


def query_set(frames: DataFrame) -> DataFrame:
    """Queries: the frames whose vec_id is divisible by 20; the right answer is their own video."""
    return frames.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "video_id", l2_normalise(F.col("emb")).alias("emb"))


def proto_lists(protos: DataFrame, ks) -> DataFrame:
    """video_id and protos: an array of (k, emb) in the order of k. A video's prototypes number the sum of ``ks``; null ones are left out."""
    # Null ones go from the lists: a filter of rows would work out every prototype twice.
    lists = protos.where(F.col("k").isin(*ks)).groupBy("video_id").agg(F.collect_list(F.struct("k", "emb")).alias("protos"))
    return lists.withColumn("protos", F.array_sort(F.filter("protos", lambda p: p["emb"].isNotNull()), lambda a, b: a["k"] - b["k"]))


def base_scores(protos: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """query_id, video_id, base: the best product over the finest prototypes, of which there are ``k``."""
    return pooled_scores(proto_lists(protos, (k,)), queries, (k,), 1.0).select("query_id", "video_id", "base")


def qamp_scores(protos: DataFrame, queries: DataFrame, ks=(2, 4, 6), tau: float = 0.1) -> DataFrame:
    """query_id, video_id, base, qamp: softmax-weighted pooling over each K's prototypes, averaged over all K."""
    return pooled_scores(proto_lists(protos, ks), queries, ks, tau).select("query_id", "video_id", "base", "qamp")


def moments(scored: DataFrame) -> DataFrame:
    """The context of a gallery: video_id, n, total, squares over the base scores of queries; kept as a table, later searches read it and add to it."""
    return scored.groupBy("video_id").agg(F.count("base").alias("n"), F.sum("base").alias("total"), F.sum(F.col("base") * F.col("base")).alias("squares"))


def added_moments(*contexts: DataFrame) -> DataFrame:
    """One context of the queries of several."""
    out = contexts[0]
    for other in contexts[1:]:
        out = out.unionByName(other)
    return out.groupBy("video_id").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])


def single_search(protos: DataFrame, queries: DataFrame, k: int = 10, context: DataFrame | None = None, alpha: float = 0.5, tau: float = 0.01, beta: float = 0.4, top: int = 50, ks=(2, 4, 6)) -> DataFrame:
    """query_id, video_id, rank from 0, score, margin: each query searched for itself, whatever others are searched with it.

    Hubness is measured against ``context`` (see :func:`moments`), the scores of earlier queries; a video that it doesn't have counts as one with mean and
    deviation 0. Without a context the product with the mean of a video's finest prototypes is its expected score, and the query's scores give the
    deviation. The ``top`` videos by base score are re-ranked and put over the best of the others; with ``beta`` above 0, scores are a softmax over the videos.
    Queries are a stated set; a task holds the scores of one query's ``top`` videos and sums over the others.
    """
    scored = qamp_scores(protos, queries, ks, tau)
    own, t = Window.partitionBy("query_id"), max(beta, 1e-6)
    # Sums over all videos need no row of their own; only the best by base score go on, and Spark drops the others before the shuffle.
    sums = scored.groupBy("query_id").agg(F.stddev_pop("base").alias("_sd"), F.sum(F.exp((F.col("base") - 1) / t)).alias("_mass"))
    most = max(top, k) + 1
    rows = top_k(scored, most, "base").withColumn("_place", F.col("rank") + 1).drop("rank").join(sums, "query_id")
    if context is None:
        finest = protos.where((F.col("k") == max(ks)) & F.col("emb").isNotNull()).groupBy("video_id").agg(mean_vector(F.collect_list("emb")).alias("_mean"))
        rows = rows.join(finest, "video_id", "left").join(queries.select("query_id", "emb"), "query_id")
        rows = rows.withColumns({"mu": F.coalesce(dot(F.col("_mean"), F.col("emb")), F.lit(0.0)), "sd": F.col("_sd") + 1e-8})
    else:
        mean = F.col("total") / F.col("n")
        spread = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
        held = context.where("n > 0").select("video_id", mean.alias("mu"), (spread + 1e-8).alias("sd"))
        rows = rows.join(held, "video_id", "left").fillna({"mu": 0.0, "sd": 1e-8})
    rows = rows.withColumn("in", F.col("_place") <= top).withColumn("nnn", (F.col("base") - F.col("mu")) / F.col("sd"))
    inside = lambda c: F.when(F.col("in"), F.col(c))
    z = lambda c: (F.col(c) - F.avg(inside(c)).over(own)) / (F.stddev_pop(inside(c)).over(own) + 1e-8)
    rows = rows.withColumn("fused", (1 - alpha) * z("nnn") + alpha * z("qamp"))
    shift = F.coalesce(F.max(F.when(~F.col("in"), F.col("base"))).over(own), F.lit(0.0))
    rows = rows.withColumn("score", F.when(F.col("in"), F.col("fused") - F.min(inside("fused")).over(own) + shift + 1e-6).otherwise(F.col("base")))
    if beta > 0:
        high = F.max("score").over(own)
        # Those that aren't candidates keep their base score: their share of the sum is what candidates leave of all.
        rows = rows.withColumns({"_e": F.exp((F.col("score") - high) / t), "_rest": F.exp((1 - high) / t) * F.greatest(F.col("_mass") - F.sum(F.when(F.col("in"), F.exp((F.col("base") - 1) / t))).over(own), F.lit(0.0))})
        rows = rows.withColumn("score", F.col("_e") / (F.sum(inside("_e")).over(own) + F.col("_rest") + 1e-9))
    best = with_margin(top_k(rows, max(k, 2), "score"), "score").where(F.col("rank") < k)
    return best.select("query_id", "video_id", "rank", "score", "margin")


def beside(rows: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of a table that has one short row for each key: it goes to the rows, which are not shuffled."""
    return rows.join(F.broadcast(stats.withColumnRenamed(key, "_key")), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def query_ends(best: DataFrame, alpha: float = 0.7, top: int = 500, shift_mode: str = "reference") -> DataFrame:
    """A row for each query of what re-ranking needs to know of its best: query_id, _m_ and _s_ (mean and deviation) of nnn and qamp, _low, _shift and _last. best: the ``top`` + 1 best with rank, base, qamp and nnn."""
    all_, inside = Window.partitionBy("query_id"), lambda c: F.when(F.col("rank") < top, F.col(c))
    ends = {f"_{n}_{c}": f(inside(c)).over(all_) for c in ("nnn", "qamp") for n, f in (("m", F.avg), ("s", F.stddev_pop))}
    best = best.withColumns(ends).withColumn("_fused", _fused(alpha, F.col("nnn")))
    rest = F.max(F.when(F.col("rank") >= top, F.col("base")))
    shift = F.coalesce(-rest if shift_mode == "reference" else rest, F.lit(0.0))
    last = F.max_by(F.struct("base", "video_id"), F.when(F.col("rank") < top, F.col("rank")))
    return best.groupBy("query_id").agg(*[F.max(c).alias(c) for c in ends], F.min(inside("_fused")).alias("_low"), shift.alias("_shift"), last.alias("_last"))


def _fused(alpha: float, nnn: Column) -> Column:
    z = lambda c, value: (value - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8)
    return (1 - alpha) * z("nnn", nnn) + alpha * z("qamp", F.col("qamp"))


def reranked(scored: DataFrame, alpha: float = 0.7, top: int = 500, shift_mode: str = "reference") -> DataFrame:
    """Adds out: hubness-corrected re-ranking of each query's ``top`` videos, others keep base.

    Pairs are worked out again for each of: moments by video, counts by bins of the score, the best ``top`` + 1 of each query, and the result; only the best ones go through a shuffle.
    """
    column = scored.groupBy("video_id").agg(F.avg("base").alias("_mu"), (F.stddev_pop("base") + 1e-8).alias("_sd"))
    nnn = (F.col("base") - F.col("_mu")) / F.col("_sd")
    best = beside(top_k(likely(scored.select("query_id", "video_id", "base", "qamp"), top + 1, "base"), top + 1, "base"), column, "video_id").withColumn("nnn", nnn)
    query = query_ends(best, alpha, top, shift_mode)
    s = beside(beside(scored, column, "video_id"), query, "query_id")
    before = F.col("video_id") <= F.col("_last.video_id")
    within = F.when(F.col("_last.base").isNull(), F.col("base").isNotNull() | before).otherwise(F.coalesce((F.col("base") > F.col("_last.base")) | ((F.col("base") == F.col("_last.base")) & before), F.lit(False)))
    return s.select("query_id", "video_id", "base", "qamp", F.when(within, _fused(alpha, nnn) - F.col("_low") + F.col("_shift") + 1e-6).otherwise(F.col("base")).alias("out"))


#: Exponents that are summed together.
_SPAN = 300.0


def _softmax(scored: DataFrame, value: Column, beta: float) -> DataFrame:
    """Replaces out by the softmax of value over the queries of each video, null where it is null: one pass over the pairs for the sums, one for the result."""
    x = scored.withColumn("_x", value)
    part = F.floor(F.col("_x") / beta / _SPAN).cast("double")
    sums = x.where("_x IS NOT NULL").groupBy("video_id", part.alias("_p")).agg(F.max("_x").alias("_m"), F.sum(F.exp(F.col("_x") / beta - part * _SPAN)).alias("_s"))
    sums = sums.groupBy("video_id").agg(F.max("_m").alias("_m"), F.collect_list(F.struct("_p", "_s")).alias("_l"))
    total = F.aggregate("_l", F.lit(0.0), lambda t, l: t + l["_s"] * F.exp(l["_p"] * _SPAN - F.col("_m") / beta))
    e = beside(x, sums.select("video_id", "_m", total.alias("_t")), "video_id")
    return e.withColumn("out", F.exp((F.col("_x") - F.col("_m")) / beta) / (F.col("_t") + 1e-12)).drop("_x", "_m", "_t")


def column_softmax(scored: DataFrame, beta: float = 0.4) -> DataFrame:
    """Replaces out by its softmax over the queries of each video."""
    return _softmax(scored, F.col("out"), beta)


def best_of(rows: DataFrame, k: int, score: str, least: int = 200_000) -> DataFrame:
    """Rows without those that have k better ones of their query in their task: what is left for the shuffle is at most k rows for each query and task."""

    def cut(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        column = lambda c: t.column(c).combine_chunks() if t.num_rows else pa.nulls(0)
        group = column("query_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        value = column(score).cast(pa.float64())
        null = value.is_null().to_numpy(zero_copy_only=False)
        value = value.to_numpy(zero_copy_only=False)
        # As Spark orders them: nan is the greatest, null the least.
        value = np.where(null, -np.inf, np.where(np.isnan(value), np.inf, value))
        tie = pc.rank(column("video_id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((tie, -value, group))
        sizes = np.bincount(group)
        place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return t.take(pa.array(np.sort(order[place < k]))).combine_chunks().to_batches()

    def run(batches):
        kept, fresh, n = [], [], 0
        for batch in batches:
            if batch.num_rows:
                fresh.append(batch)
                n += batch.num_rows
            if n >= max(least, sum(b.num_rows for b in kept)):
                kept, fresh, n = cut(kept + fresh), [], 0
        if fresh:
            kept = cut(kept + fresh)
        yield from kept

    return rows.mapInArrow(run, rows.schema)


#: Width of the bins by which the best are told from the others.
_BIN = 1 / 512


def likely(scored: DataFrame, k: int, score: str) -> DataFrame:
    """Rows that may be among the k best of their query: whole bins of the score, counted first, from the best down until they hold k."""
    # Null is the least and goes to the last bin, as do all scores below -2; those above 2 and nan go to the first.
    place = F.floor(F.least(F.greatest(F.col(score).cast("double"), F.lit(-2.0)), F.lit(2.0)) / _BIN).cast("int")
    counts = scored.groupBy("query_id", place.alias("_bin")).agg(F.count("*").alias("_n"))
    held = F.sum("_n").over(Window.partitionBy("query_id").orderBy(F.col("_bin").desc()))
    bound = counts.withColumn("_held", held).groupBy("query_id").agg(F.max(F.when(F.col("_held") >= k, F.col("_bin"))).alias("_bound"))
    return beside(scored, bound, "query_id").where(F.col("_bound").isNull() | (place >= F.col("_bound"))).drop("_bound")


def top_k(scored: DataFrame, k: int, score: str = "out") -> DataFrame:
    """The k best of each query with rank from 0, ties by video_id."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "video_id")
    return best_of(scored, k, score).withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def difficulty(margin: Column) -> Column:
    return F.when(margin >= EASY, "easy").when(margin >= HARD, "medium").otherwise("hard")


def with_margin(ranked: DataFrame, score: str = "out") -> DataFrame:
    """Adds margin (best less second score, or the best alone) and difficulty."""
    w = Window.partitionBy("query_id")
    first, second = (F.max(F.when(F.col("rank") == r, F.col(score))).over(w) for r in (0, 1))
    return ranked.withColumn("margin", first - F.coalesce(second, F.lit(0.0))).withColumn("difficulty", difficulty(F.col("margin")))


def utility(rank: Column, filtered: Column, cost: Column) -> Column:
    """-2 where the right video is filtered or absent (rank below 0), else reciprocal rank with bonuses less cost."""
    hit = lambda k: (rank < k).cast("double")
    return F.when(filtered | (rank < 0), -2.0).otherwise(1 / (rank + 1) + 0.5 * hit(1) + 0.1 * hit(5) - 0.05 * cost)


def masked_softmax(scored: DataFrame, beta: float = 0.4, keep: str = "passed") -> DataFrame:
    """Replaces out by its softmax over the queries of each video, among the rows that pass; others get null."""
    return _softmax(scored, F.when(F.col(keep), F.col("out")), beta)


#: Fixed value: the score of a video that a filter shuts out.
FILTERED = -1e9


def hybrid_search(scored: DataFrame, k: int = 10, beta: float = 0.4, meta_alpha: float = 1.0, hard: bool = True, softmax_after: bool = True) -> DataFrame:
    """The k best of each query, with rank, out, semantic (the score before), passed and margin (best less second).

    scored: query_id, video_id, out (re-ranked scores of all pairs), passed, soft (metadata score) and constrained. With meta_alpha
    below 1 the scores of constrained queries are blended with soft. Rows that don't pass have ``FILTERED`` as score, and fill the list where
    fewer than k pass; with ``hard`` off all pass. The softmax over queries is taken among the rows that pass, or with ``softmax_after`` off among
    all; with beta 0 there is none.
    """
    s = scored.withColumn("semantic", F.col("out")).withColumn("passed", F.coalesce("passed", F.lit(False)) if hard else F.lit(True))
    if beta > 0:
        s = masked_softmax(s, beta) if softmax_after else column_softmax(s, beta)
    if meta_alpha < 1:
        s = s.withColumn("out", F.when(F.col("constrained"), meta_alpha * F.col("out") + (1 - meta_alpha) * F.col("soft")).otherwise(F.col("out")))
    s = s.withColumn("out", F.when(F.col("passed"), F.col("out")).otherwise(FILTERED))
    return with_margin(top_k(s, max(k, 2))).where(F.col("rank") < k)


def with_ends(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Adds lo_ and hi_ of columns over each query's rows, which are not shuffled."""
    return beside(scored, scored.groupBy("query_id").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]), "query_id")


def min_max(value: Column, by: list[str], constant: float) -> Column:
    """value scaled to 0..1 within its group; ``constant`` where all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(constant)


def fuse_scores(semantic: Column, meta: Column, alpha: float, by: list[str]) -> Column:
    """alpha x semantic, scaled by query if it varies, + (1 - alpha) x meta."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(semantic).over(w), F.max(semantic).over(w)
    return alpha * F.when(hi > lo, (semantic - lo) / (hi - lo)).otherwise(semantic) + (1 - alpha) * meta
