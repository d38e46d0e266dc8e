import duckdb
import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from quern.functions import vectors
from quern.operators import gallery, hybrid, identity, metadata, planners, routes, search
from quern.plans import identities  # noqa: F401
from quern.plans.catalogue import SQL


def test_equal_frequencies_round_as_in_sql():
    """Two frequencies in the middle of the first frame are equal but for rounding. With very few frames SQL joins, and adds, in another order."""
    pixels = np.random.default_rng(0).integers(0, 256, (200, 64), dtype=np.uint8)
    pixels[0] = np.frombuffer(bytes.fromhex("8b90925d8da2389373d073916fa57f68846d82a9915f9741a4586daa8c4d8e4d6a7b4dc95d83537f74a997776c5fbd907a737e768a8f9bb273837e70695fb096"), np.uint8)
    frames = pa.table({"vec_id": np.arange(200), "embedding": pa.array(((pixels + 0.5) / 255 - 0.5).astype(np.float32).tolist(), pa.list_(pa.float32()))})
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.register("embeddings", frames)
    want = {k: h for k, _, h in c.execute(SQL["frame_hashes"]).fetchall()}
    assert identity.perceptual_hashes(pixels.reshape(-1, 8, 8)).tolist() == [want[k] for k in range(200)]


def _videos(spark, n=130, dim=8, queries=12):
    """Prototypes of videos, one of them without its finest, metadata, queries and intents."""
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, dim))).tolist()
    pick = lambda *x: x[rng.integers(len(x))]
    lists = [(v, [(k, e) for k, e in zip([2] * 2 + [4] * 4 + [6] * 6, unit(12), strict=True) if (v, k) != (7, 6)]) for v in range(n)]
    meta = [(v, pick(None, 5e3, 2e4, 9e4), pick(None, "a", "b"), pick(None, "x", "y"), pick(None, 0.0, 0.5), pick(None, "", "gopro 9", "iphone 12")) for v in range(n)]
    intents = [(20 * i, int(rng.integers(n)), *pick((None, None), (1e4, 2e4)), pick([], ["a"]), pick([], ["x"]), pick(None, "gopro")) for i in range(queries)]
    return (
        spark.createDataFrame(lists, "video_id long, protos array<struct<k:int,emb:array<double>>>"),
        spark.createDataFrame(meta, "video_id long, created double, geo string, motion string, confidence double, device string"),
        spark.createDataFrame([(20 * i, e) for i, e in enumerate(unit(queries))], "query_id long, emb array<double>"),
        spark.createDataFrame(intents, "query_id long, own long, t_start double, t_end double, q_geo array<string>, q_motion array<string>, q_device string"),
    )


def test_chosen_routes_and_margins_come_from_the_kernel(spark):
    lists, meta, queries, intents = _videos(spark)
    bank = routes.bank(spark)
    whole, margins = routes.grid_with_margins(lists, meta, queries, intents, bank, 100, block=5)
    rows = lambda df: sorted(str((r.query_id, r.route_id, r["rank"], r.gt_filtered, r.candidates, round(r.utility, 9))) for r in df.collect())
    chosen = intents.select("query_id", F.explode(F.array((F.col("query_id") / 20 % 30).cast("int"), F.lit(16), F.lit(29))).alias("idx")).distinct()
    got = routes.grid(lists, meta, queries, intents, bank, block=5, chosen=chosen)
    assert rows(got) == rows(whole.join(chosen, ["query_id", "idx"])) and got.count() == 36
    pairs = vectors.pooled_scores(lists, queries, (2, 4, 6), 0.1)
    two = search.with_margin(search.top_k(routes.single_scores(pairs, [100]), 2, "sem"), "sem").where("rank = 0")
    shown = lambda df: {r.query_id: round(r.margin, 9) for r in df.collect()}
    assert shown(margins) == shown(two)


def test_routes_of_a_querys_own_stand_once_in_the_wider_bank(spark):
    bank = routes.bank(spark)
    own = lambda axes: ("dynamic_soft_" + "_".join(axes), 30, [], axes, 500, "nnn_qamp", 1.0)
    plain = ("R00_semantic_only_top500", 0, [], [], 500, "nnn_qamp", 1.0)
    schema = "query_id long, route_id string, idx int, hard_axes array<string>, soft_axes array<string>, candidate_topm int, rerank_mode string, cost double"
    choices = spark.createDataFrame([(0, *own(["geo"])), (20, *own(["time"])), (40, *own(["geo"])), (60, *plain)], schema)
    wider = planners.with_own_routes(bank, choices).collect()
    assert [(r.route_id, r.idx) for r in wider[29:]] == [("R29_full_budget_all_soft_dense_refine", 29), ("dynamic_soft_geo", 30), ("dynamic_soft_time", 31)]


def test_cascade_over_results_of_all_queries(spark):
    ranks = {1: (2, 0, 0), 2: (7, 20, 0), 3: (30, 6, 1), 4: (30, 20, -1)}
    names = ("R00_semantic_only_top500", planners.LARGE, planners.FULL)
    results = spark.createDataFrame([(q, n, r, 1.0) for q, by in ranks.items() for n, r in zip(names, by, strict=True)], "query_id long, route_id string, rank int, cost double")
    got = {x.query_id: (x.route_id, x.rank, x.stage) for x in planners.cascade_of(results, results.where(F.col("route_id") == names[0])).collect()}
    assert got == {1: (names[0], 2, 1), 2: (names[0], 7, 2), 3: (names[1], 6, 2), 4: (names[1], 20, 3)}


def test_hybrid_search_in_the_kernel_equals_sorting(spark):
    """Also where scores tie, as do those of videos that pass for one query only."""
    lists, meta, queries, intents = _videos(spark, n=60)
    pairs = vectors.pooled_scores(lists, queries, (2, 4, 6), 0.1)
    s = search.reranked(pairs, top=20).join(intents, "query_id").join(meta, "video_id")
    s = s.select("query_id", "video_id", "out", metadata.hard_pass(False).alias("passed"), metadata.soft_score().alias("soft"), metadata.has_constraint().alias("constrained")).toPandas()
    for k, beta, alpha, hard, after in ((10, 0.4, 1.0, True, True), (10, 0.4, 0.6, True, True), (10, 0.4, 1.0, True, False), (10, 0.4, 0.6, False, True), (60, 0.0, 1.0, True, True)):
        passed = s.passed | (not hard)
        x = s.out.where(passed | (not after)) if beta else s.out
        e = np.exp((x - x.groupby(s.video_id).transform("max")) / beta) if beta else x
        f = e / (e.groupby(s.video_id).transform("sum") + 1e-12) if beta else x
        f = f.where(~s.constrained, alpha * f + (1 - alpha) * s.soft).where(passed, search.FILTERED)
        rows = s.assign(f=f, key=-f, passed=passed).sort_values(["query_id", "key", "video_id"], na_position="last")
        rows["rank"] = rows.groupby("query_id").cumcount()
        want = {(r.query_id, r.rank): (r.video_id, None if r.f != r.f else round(r.f, 9), r.passed) for r in rows[rows["rank"] < k].itertuples()}
        got = hybrid.hybrid_search(lists, meta, queries, intents, k, beta, alpha, hard, after, top=20, block=5).collect()
        assert {(r.query_id, r["rank"]): (r.video_id, None if r.out is None else round(r.out, 9), r.passed) for r in got} == want
    assert hybrid.hybrid_search(lists.limit(0), meta, queries, intents).count() == 0


def test_ranks_of_subsets_in_the_kernel_equal_those_of_pairs(spark):
    r = np.random.default_rng(3)
    vector = lambda: r.normal(size=4).tolist()
    signals = spark.createDataFrame([(v, vector(), float(r.random()), float(r.random()), vector() if v % 3 else None, ("beach", "sport", "other")[v % 3]) for v in range(40)], "video_id long, emb array<double>, highlight double, face double, face_emb array<double>, scene string")
    texts = ("a face", "jump on the beach", None, "match of people")
    queries = spark.createDataFrame([(q, (5 * q) % 45, vector(), texts[q % 4], vector() if q % 2 else None) for q in range(13)], "query_id long, own long, emb array<double>, text string, face_emb array<double>")
    scored = gallery.expert_scores(signals, queries)
    ranks, sets = gallery.ranks_and_sets(signals, queries, 0.4, block=5, cells=30)
    shown = lambda df: sorted(tuple(x) for x in df.collect())
    want = gallery.subset_ranks(scored)
    assert shown(ranks) == shown(want) and min(x[2] for x in shown(ranks)) == -1
    values = gallery.lattice(want)
    assert shown(gallery.selected_of(ranks, sets, values)) == shown(gallery.selected(scored, want, values, threshold=0.4))
