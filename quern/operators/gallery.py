"""Retrieval with experts over a gallery: signals of videos, what a query asks for, and ranks under every choice of experts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import l2_normalise, mean_vector, scores
from quern.operators.experts import BASE_COST, COSTS, NAMES, greedy, prediction_sets
from quern.operators.scans import _cut as cut

#: Words of a query that ask for persons, for highlights, and for scenes (the first that matches); weight of an expert, and of highlights that aren't asked for.
PERSON = ("person", "man", "woman", "people", "face", "someone", "child", "boy", "girl", "他", "她", "人", "脸", "面孔")
HIGHLIGHT = ("jump", "dance", "score", "goal", "trick", "highlight", "action", "running", "fast", "celebrate", "精彩", "高光")
SCENES = (
    ("indoor", ("indoor", "room", "inside", "室内", "屋里")),
    ("outdoor", ("outdoor", "outside", "户外")),
    ("nature", ("nature", "forest", "mountain", "natural", "自然", "山")),
    ("urban", ("city", "urban", "street", "downtown", "城市", "街")),
    ("beach", ("beach", "coast", "sea", "海", "沙滩")),
    ("sport", ("sport", "game", "match", "运动", "比赛")),
    ("kitchen", ("kitchen", "cook", "厨房")),
    ("office", ("office", "work", "办公")),
    ("party", ("party", "birthday", "聚会", "派对")),
    ("street", ("street", "road", "街道", "马路")),
    ("vehicle", ("car", "drive", "vehicle", "车", "驾驶")),
)
WEIGHT, UNASKED = 0.35, 0.3


def gallery_signals(frames: DataFrame) -> DataFrame:
    """video_id, emb (mean of the frames', as a unit vector), highlight, face (best confidence of frames with a face, or 0), face_emb (mean of those, as a unit vector, or null), scene, scenes.

    frames: video_id, frame_no, emb, highlight, face (whether there is one), confidence, face_emb, label. scenes are the labels' shares; scene is the label of
    the greatest, of equal ones that which comes first. A video's frames are those sampled from it, a bounded number.
    """
    with_face = lambda c: F.when(F.col("face"), F.col(c))
    by_frame = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("frame_no", c.alias("v")))), lambda x: x["v"])
    video = frames.groupBy("video_id").agg(
        by_frame(F.col("emb")).alias("_e"), F.coalesce(F.max("highlight"), F.lit(0.0)).alias("highlight"), F.coalesce(F.max(with_face("confidence")), F.lit(0.0)).alias("face"),
        F.array_compact(by_frame(with_face("face_emb"))).alias("_f"),
    )
    labels = frames.where("label IS NOT NULL").groupBy("video_id", "label").agg(F.count("*").alias("n"), F.min("frame_no").alias("first"))
    scene = labels.groupBy("video_id").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("scene"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("_n"), F.sum("n").alias("_all"))
    mean = lambda c: F.when(F.size(c) > 0, l2_normalise(mean_vector(F.col(c))))
    out = video.join(scene, "video_id", "left")
    shares = F.transform_values("_n", lambda _, n: n / F.col("_all"))
    return out.select("video_id", mean("_e").alias("emb"), "highlight", "face", mean("_f").alias("face_emb"), F.coalesce("scene", F.lit("other")).alias("scene"), shares.alias("scenes"))


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def priors(queries: DataFrame) -> DataFrame:
    """Adds wants_person, wants_highlight and scene_cue (or null) by words anywhere in a query's text, in either case."""
    text = F.lower(F.coalesce("text", F.lit("")))
    cue = F.lit(None).cast("string")
    for scene, words in reversed(SCENES):
        cue = F.when(_any(text, words), scene).otherwise(cue)
    return queries.withColumns({"wants_person": _any(text, PERSON), "wants_highlight": _any(text, HIGHLIGHT), "scene_cue": cue})


def scaled(value: Column, low: Column, high: Column) -> Column:
    """value in 0..1 between low and high; 0.5 where these are equal."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.5)


def expert_scores(signals: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, video_id, own, sem and a column for each expert of ``NAMES``: scores in 0..1 of every query with every video.

    queries: query_id, own (the right video), emb, text, face_emb (or null), a stated set. Experts that a query doesn't ask for give 0, highlights ``UNASKED`` of theirs.
    """
    # The vectors stay in the kernel, and what is known of queries goes to the pairs: no pair is shuffled, and none broadcast.
    asked = priors(queries).withColumn("face_emb", F.when(F.col("face_emb").isNotNull(), l2_normalise(F.col("face_emb"))))
    pairs = scores(signals.select("video_id", "highlight", "face", "face_emb", "scene", "emb"), asked.select("query_id", "emb", "face_emb"), second="face_emb").withColumnRenamed("face_emb", "_id")
    pairs = pairs.join(F.broadcast(asked.select("query_id", "own", "wants_person", "wants_highlight", "scene_cue")), "query_id")
    ends = pairs.groupBy("query_id").agg(*[f(c).alias(f"_{n}_{c}") for c in ("score", "_id", "highlight", "face") for n, f in (("lo", F.min), ("hi", F.max))])
    pairs = pairs.join(F.broadcast(ends), "query_id")
    part = lambda c: scaled(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))
    return pairs.select(
        "query_id", "video_id", "own", part("score").alias("sem"),
        (F.when(F.col("wants_highlight"), 1.0).otherwise(UNASKED) * part("highlight")).alias("highlight"), F.when(F.col("wants_person"), part("face")).otherwise(0.0).alias("face"),
        F.when(F.col("_id").isNotNull(), part("_id")).otherwise(0.0).alias("face_id"), F.coalesce((F.col("scene") == F.col("scene_cue")).cast("double"), F.lit(0.0)).alias("scene"),
    )


def subset_ranks(scored: DataFrame, weight: float = WEIGHT, names=NAMES) -> DataFrame:
    """query_id, sid, rank of the right video under every subset of the experts (bit j of sid is expert j); -1 where the gallery doesn't have it.

    A subset's score is the semantic one and ``weight`` times those of its experts; the rank is the number of better videos. One scan counts
    these for all subsets at once: a row for each query goes through the shuffle, and nothing is sorted.
    """
    total = lambda pre, s: sum((weight * F.col(pre + n) for j, n in enumerate(names) if s >> j & 1), F.col(pre + "sem"))
    mine = scored.where(F.col("video_id") == F.col("own")).select("query_id", *[F.col(c).alias(f"own_{c}") for c in ("sem", *names)])
    both = scored.select("query_id", "sem", *names).join(F.broadcast(mine), "query_id", "left")
    better = [F.count_if(F.round(total("", s), 9) > F.round(total("own_", s), 9)).alias(f"_{s}") for s in range(1 << len(names))]
    counts = both.groupBy("query_id").agg(F.max(F.col("own_sem").isNotNull()).alias("_has"), *better)
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("sid"), F.col(f"_{s}").cast("int").alias("rank")) for s in range(1 << len(names))]))
    return counts.select("query_id", "_has", rows.alias("r")).select("query_id", "r.sid", F.when(F.col("_has"), F.col("r.rank")).otherwise(-1).alias("rank"))


_ENDS = "query_id long, own_score double, own_id double, own_highlight double, own_face double, own_scene double, " + ", ".join(f"{n}_{c} double" for c in ("score", "id", "highlight", "face") for n in ("lo", "hi"))


def ranks_and_sets(signals: DataFrame, queries: DataFrame, threshold: float = 1.0, weight: float = WEIGHT, block: int = 4096, cells: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`subset_ranks` over :func:`expert_scores`, and query_id, set_size, in_set, the videos whose semantic nonconformity is at most the threshold.

    signals have a long as video_id. Pairs are worked out twice in the kernel, for the least and greatest scores of each query and for the counts, and do not leave it; what leaves a task are a few numbers for each query.
    """
    spark, names = signals.sparkSession, NAMES
    asked = priors(queries).withColumn("face_emb", F.when(F.col("face_emb").isNotNull(), l2_normalise(F.col("face_emb"))))
    slim = cut(signals.select("video_id", F.col("emb"), "face_emb", "highlight", "face", "scene").repartition(2 * spark.sparkContext.defaultParallelism))
    fields = ("query_id", "own", "wants_person", "wants_highlight", "scene_cue", "emb", "face_emb")
    sent, held = [], []

    def send(rows):
        q = {c: [r[c] for r in rows] for c in fields}
        faces = np.array([k for k, x in enumerate(q["face_emb"]) if x is not None], np.int64)
        ready = {"query_id": np.array(q["query_id"], np.int64), "own": np.array([-1 if x is None else x for x in q["own"]], np.int64), "known": np.array([x is not None for x in q["own"]], bool), "emb": np.array(q["emb"], np.float64), "faces": faces}
        ready |= {"face_emb": np.array([q["face_emb"][k] for k in faces], np.float64), "person": np.array(q["wants_person"], bool), "lively": np.where(np.array(q["wants_highlight"], bool), 1.0, UNASKED), "cue": np.array([x or "" for x in q["scene_cue"]])}
        sent.append(spark.sparkContext.broadcast(ready))

    for row in asked.select(*fields).toLocalIterator():
        held.append(row)
        if len(held) == block:
            send(held)
            held.clear()
    if held:
        send(held)

    def pairs(batches, q):
        """(ids of videos, semantic products, products of faces, highlights, faces, and whether scenes are those asked for) of each block; nan for null."""
        for batch in batches:
            step = max(1, cells // max(len(q["query_id"]), 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = part.num_rows
                product = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) @ q["emb"].T
                # Where only the video has no face, the product is 0.
                faces = np.full(product.shape, np.nan)
                faces[:, q["faces"]] = 0.0
                there = np.flatnonzero(part.column(2).is_valid().to_numpy(zero_copy_only=False))
                if len(there) and len(q["faces"]):
                    faces[np.ix_(there, q["faces"])] = part.column(2).take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).reshape(len(there), -1) @ q["face_emb"].T
                light, face = (part.column(c).to_numpy(zero_copy_only=False).astype(np.float64)[:, None] for c in ("highlight", "face"))
                scene = np.array([x or "-" for x in part.column(5).to_pylist()])[:, None] == q["cue"]
                # Rounded, so that a pair is the same wherever it stands in a product.
                yield part.column(0).to_numpy(zero_copy_only=False), np.round(product, 13), np.round(faces, 13), light, face, scene

    def every(kernel, schema: str, *more) -> DataFrame:
        out = None
        for k, one in enumerate(sent):
            rows = slim.mapInArrow(kernel(one, *[x[k] for x in more]), schema)
            out = rows if out is None else out.unionByName(rows)
        return spark.createDataFrame([], schema) if out is None else out

    columns = [x.split()[0] for x in _ENDS.split(", ")]

    def ends(one):
        def run(batches):
            q = one.value
            n = len(q["query_id"])
            out = {c: np.full(n, np.inf if c[:2] == "lo" else -np.inf if c[:2] == "hi" else np.nan) for c in columns[1:]}
            for video, *parts, scene in pairs(batches, q):
                row, column = np.nonzero((video[:, None] == q["own"]) & q["known"])
                for c, x in zip(("score", "id", "highlight", "face"), parts, strict=True):
                    low, high = np.where(np.isnan(x), np.inf, x).min(axis=0), np.where(np.isnan(x), -np.inf, x).max(axis=0)
                    out[f"lo_{c}"], out[f"hi_{c}"] = np.minimum(out[f"lo_{c}"], low), np.maximum(out[f"hi_{c}"], high)
                    out[f"own_{c}"][column] = np.broadcast_to(x, scene.shape)[row, column]
                out["own_scene"][column] = scene[row, column]
            yield pa.RecordBatch.from_arrays([pa.array(q["query_id"]), *[pa.array(out[c], mask=~np.isfinite(out[c])) for c in columns[1:]]], names=columns)

        return run

    found = every(ends, _ENDS).groupBy("query_id").agg(*[(F.min if c[:2] == "lo" else F.max)(c).alias(c) for c in columns[1:]])
    # A short row for each query; it goes to all tasks in the blocks of queries.
    facts = {r["query_id"]: r for r in found.toArrow().to_pylist()}
    told = []
    for one in sent:
        rows = [facts.get(q, {}) for q in one.value["query_id"].tolist()]
        told.append(spark.sparkContext.broadcast({c: np.array([np.nan if r.get(c) is None else r[c] for r in rows], np.float64) for c in columns[1:]}))
    subsets = 1 << len(names)
    counted = "query_id long, has boolean, size long, inside boolean, better array<long>"

    def counts(one, fact):
        def run(batches):
            q, e = one.value, fact.value
            n = len(q["query_id"])

            def scaled(c, x):
                low, high = e[f"lo_{c}"], e[f"hi_{c}"]
                with np.errstate(invalid="ignore", divide="ignore"):
                    return np.where(high > low, (x - low) / (high - low), 0.5)

            def experts(product, faces, light, face, scene):
                given = [q["lively"] * scaled("highlight", light), np.where(q["person"], scaled("face", face), 0.0), np.where(np.isnan(faces), 0.0, scaled("id", faces)), scene * 1.0]
                return scaled("score", product), given

            def totals(sem, given):
                for s in range(subsets):
                    x = sem
                    for j, one in enumerate(given):
                        if s >> j & 1:
                            x = x + weight * one
                    yield np.round(x, 9)

            sem, given = experts(*(e[f"own_{c}"] for c in ("score", "id", "highlight", "face", "scene")))
            has, mine = ~np.isnan(e["own_score"]), list(totals(sem, given))
            size, better, inside = np.zeros(n, np.int64), np.zeros((n, subsets), np.int64), has & (1 - sem <= threshold)
            for _, *parts in pairs(batches, q):
                sem, given = experts(*parts)
                size += (1 - sem <= threshold).sum(axis=0)
                for s, x in enumerate(totals(sem, given)):
                    better[:, s] += (x > mine[s]).sum(axis=0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * subsets), pa.array(better.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(q["query_id"]), pa.array(has), pa.array(size), pa.array(inside), lists], names=["query_id", "has", "size", "inside", "better"])

        return run

    sums = cut(every(counts, counted, told).groupBy("query_id").agg(F.max("has").alias("_has"), F.sum("size").alias("set_size"), F.max("inside").alias("in_set"), *[F.sum(F.col("better")[s]).alias(f"_{s}") for s in range(subsets)]).where("query_id IS NOT NULL"))
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("sid"), F.col(f"_{s}").cast("int").alias("rank")) for s in range(subsets)]))
    ranks = sums.select("query_id", "_has", rows.alias("r")).select("query_id", "r.sid", F.when(F.col("_has"), F.col("r.rank")).otherwise(-1).alias("rank"))
    return ranks, sums.select("query_id", "set_size", "in_set")


def value_of(rank: Column, metric: str = "rr") -> Column:
    """What a rank from 0 is worth: rr or recall@k; 0 for -1."""
    if metric == "rr":
        worth = 1 / (rank + 1)
    elif metric in ("recall@1", "recall@5", "recall@10"):
        worth = (rank < int(metric.split("@")[1])).cast("double")
    else:
        raise ValueError(f"unknown metric {metric}")
    return F.when(rank >= 0, worth).otherwise(0.0)


def lattice(ranks: DataFrame, metric: str = "rr") -> DataFrame:
    """query_id, sid, value of every subset."""
    return ranks.select("query_id", "sid", value_of(F.col("rank"), metric).alias("value"))


def selected(scored: DataFrame, ranks: DataFrame, values: DataFrame, budget: float = 5.0, stop: float = 0.0, threshold: float | None = None, costs=COSTS, base: float = BASE_COST) -> DataFrame:
    """query_id, sid, rank, cost, n_experts, in_set, set_size: experts picked greedily by ``values`` (query_id, sid, value: measured or predicted), the rank
    under them, and the set of videos whose semantic nonconformity is at most the threshold (all videos without one)."""
    sets = prediction_sets(scored, 1.0 if threshold is None else threshold, "sem").select("query_id", F.col("size").alias("set_size"), F.col("covered").alias("in_set"))
    return selected_of(ranks, sets, values, budget, stop, costs, base)


def selected_of(ranks: DataFrame, sets: DataFrame, values: DataFrame, budget: float = 5.0, stop: float = 0.0, costs=COSTS, base: float = BASE_COST) -> DataFrame:
    """Like :func:`selected`, with the sets (query_id, set_size, in_set) of :func:`ranks_and_sets`."""
    picked = greedy(values, costs, budget, stop, base)
    return picked.join(ranks, ["query_id", "sid"]).join(sets, "query_id").select("query_id", "sid", "rank", "cost", "n_experts", "in_set", "set_size")


def expert_ranking(marginals: DataFrame) -> DataFrame:
    """expert, n, mean, positive, place: experts by their mean marginal value, the best first; of equal ones the lower number."""
    m = marginals.groupBy("expert").agg(F.count("*").alias("n"), F.avg("marginal").alias("mean"), F.avg((F.col("marginal") > 0).cast("double")).alias("positive"))
    # One row for each expert.
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean").desc(), "expert")))
