import math

import numpy as np
from pyspark.sql import functions as F

from quern.functions import vectors
from quern.operators import evaluate, metadata, scans, search, segments


def test_anchored_merge_compares_with_the_first_point(spark):
    df = spark.createDataFrame([(1, t) for t in (1.0, 1.02, 1.06, 1.07, 1.2)], "k int, t double")
    assert sorted(r.t for r in scans.anchors(df, "k", "t", 0.05).collect()) == [1.0, 1.06, 1.2]
    assert scans.anchors(df.limit(0), "k", "t", 0.05).count() == 0


def test_smoothing_pads_with_zeros(spark):
    df = spark.createDataFrame([(1, float(i), 1.0) for i in range(5)], "k int, t double, v double")
    out = [r.smooth for r in segments.smoothed(df, "k", "t", "v").orderBy("t").collect()]
    assert np.allclose(out, [2 / 3, 1, 1, 1, 2 / 3])


def test_interest_budget_cuts_the_interval_over(spark):
    df = spark.createDataFrame([(1, 0.0, 40.0, 0.9), (1, 50.0, 90.0, 0.8), (1, 95.0, 99.0, 0.1)], "k int, start double, end double, score double")
    assert sorted(tuple(x)[1:] for x in scans.budgeted(df, "k").collect()) == [(0.0, 40.0, 0.9), (50.0, 70.0, 0.8)]


def test_iou_uses_the_hull(spark):
    v = spark.range(1).select(segments.iou(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(4.0)).alias("a"), segments.iou(F.lit(0.0), F.lit(1.0), F.lit(3.0), F.lit(4.0)).alias("b")).first()
    assert v.a == 0.25 and v.b == 0.0


def test_prototypes_repeat_few_frames(spark):
    df = spark.createDataFrame([(1, 0, [3.0, 4.0]), (1, 1, [0.0, 2.0])], "video_id long, frame_no int, emb array<double>")
    got = {r.slot: r.emb for r in search.prototypes(df, (4,)).collect()}
    assert np.allclose(got[0], [0.6, 0.8]) and np.allclose(got[1], [0.6, 0.8]) and np.allclose(got[2], [0, 1]) and len(got) == 4


def test_shift_sign(spark):
    rows = [(0, v, b, b) for v, b in enumerate((0.9, 0.8, 0.3))]
    df = spark.createDataFrame(rows, "query_id long, video_id long, base double, qamp double")
    ref = {r.video_id: r.out for r in search.reranked(df, top=2).collect()}
    strict = {r.video_id: r.out for r in search.reranked(df, top=2, shift_mode="strict").collect()}
    assert math.isclose(strict[0] - ref[0], 0.6) and ref[2] == strict[2] == 0.3


def test_conformal_threshold(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 10)], "s double")
    assert evaluate.conformal_threshold(df, "s", 0.1).first().threshold == 9.0
    assert evaluate.conformal_threshold(df, "s", 0.01).first().threshold == math.inf


def test_unknown_is_a_mismatch_but_null_passes(spark):
    rows = [(None, None, None, None), (None, "unknown", None, None)]
    df = spark.createDataFrame(rows, "created double, geo string, motion string, device string")
    df = df.withColumns({"t_start": F.lit(None).cast("double"), "t_end": F.lit(None).cast("double"), "q_geo": F.array(F.lit("urban")), "q_motion": F.lit(None).cast("array<string>"), "q_device": F.lit(None).cast("string")})
    assert [r.p for r in df.select(metadata.hard_pass(False).alias("p")).collect()] == [True, False]


def test_haversine(spark):
    v = spark.range(1).select(metadata.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d")).first().d
    assert math.isclose(v, math.pi * 6371)


def test_discordance(spark):
    df = spark.createDataFrame([(True, False)] * 9 + [(False, True)] * 1 + [(True, True)] * 5, "a boolean, b boolean")
    r = evaluate.discordance(df, "a", "b").first()
    assert (r.only_a, r.only_b, r.statistic) == (9, 1, 4.9)
    assert math.isclose(evaluate.discordance_p(3.841458820694124), 0.05, rel_tol=1e-9)
    assert evaluate.discordance(df.limit(0), "a", "b").first().statistic == 0.0


def test_few_rows_in_a_bin_have_no_threshold(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(10)], "s double, m double")
    assert [r.threshold for r in evaluate.binned_thresholds(df, "s", "m", 0.1, 2).collect()] == [math.inf, math.inf]


def pooled_plain(protos, q, ks, tau):
    out = {}
    for v in {p[0] for p in protos}:
        pooled = []
        for k in ks:
            s = np.array([np.dot(e, q) for video, kk, e in protos if video == v and kk == k and e is not None])
            w = np.exp((s - s.max()) / tau) if len(s) else s
            pooled.append((w * s).sum() / (w.sum() + 1e-9) if len(s) else 0.0)
        fine = [np.dot(e, q) for video, kk, e in protos if video == v and kk == max(ks) and e is not None]
        out[v] = (max(fine) if fine else None, sum(pooled) / len(ks))
    return out


def test_pooled_scores_equal_loops(spark):
    r = np.random.RandomState(1)
    protos = [(v, k, r.randn(5).tolist()) for v in range(9) for k in (2, 4) for _ in range(k)] + [(9, 2, r.randn(5).tolist()), (0, 4, None)]
    queries = [(q, r.randn(5).tolist()) for q in range(7)]
    p, q = spark.createDataFrame(protos, "video_id int, k int, emb array<double>"), spark.createDataFrame(queries, "query_id long, emb array<double>")
    for block, cells in ((4096, 2_000_000), (3, 40)):
        got = {(x.query_id, x.video_id): (x.base, x.qamp) for x in vectors.pooled_scores(search.proto_lists(p, (2, 4)), q, (2, 4), 0.1, block, cells).collect()}
        assert len(got) == 70
        for k, e in queries:
            for v, (base, qamp) in pooled_plain(protos, e, (2, 4), 0.1).items():
                assert np.isclose(got[k, v][1], qamp) and (got[k, v][0] is None if base is None else np.isclose(got[k, v][0], base))
    assert search.qamp_scores(p, q.limit(0), (2, 4)).count() == 0


def test_context_of_parts_is_the_context_of_the_whole(spark):
    scored = spark.createDataFrame([(q, v, float(q * v % 7)) for q in range(10) for v in range(4)], "query_id int, video_id int, base double")
    whole = {x.video_id: tuple(x)[1:] for x in search.moments(scored).collect()}
    parts = search.added_moments(*[search.moments(scored.where(f"query_id % 3 = {k}")) for k in range(3)])
    assert {x.video_id: tuple(x)[1:] for x in parts.collect()} == whole


def one_hot(spark):
    protos = [(f"v{i}", 2, [float(i == j) for j in range(8)]) for i in range(3) for _ in range(2)]
    return spark.createDataFrame(protos, "video_id string, k int, emb array<double>"), spark.createDataFrame([(1, [0.0, 0.0, 1.0] + [0.0] * 5)], "query_id long, emb array<double>")


def test_single_search_finds_the_axis(spark):
    got = search.single_search(*one_hot(spark), k=3, alpha=0.0, beta=0.0, top=1, ks=(2,)).orderBy("rank").collect()
    assert got[0].video_id == "v2" and len(got) == 3
    # A context that makes v2 a hub puts another first among three candidates.
    context = spark.createDataFrame([("v0", 2, 0.0, 0.0), ("v2", 2, 20.0, 202.0)], "video_id string, n long, total double, squares double")
    assert search.single_search(*one_hot(spark), k=1, context=context, alpha=0.0, top=3, ks=(2,)).first().video_id != "v2"


def test_single_search_is_a_softmax_over_all_videos(spark):
    r = np.random.RandomState(4)
    unit = lambda x: (x / np.linalg.norm(x)).tolist()
    protos = spark.createDataFrame([(v, 2, unit(r.randn(6))) for v in range(40) for _ in range(2)], "video_id int, k int, emb array<double>")
    q = spark.createDataFrame([(k, unit(r.randn(6))) for k in range(3)], "query_id long, emb array<double>")
    all_ = search.single_search(protos, q, k=40, top=5, ks=(2,)).collect()
    for k in range(3):
        mine = [x.score for x in all_ if x.query_id == k]
        assert len(mine) == 40 and np.isclose(sum(mine), 1, atol=1e-6)
    few = {(x.query_id, x.video_id): x.score for x in search.single_search(protos, q, k=3, top=5, ks=(2,)).collect()}
    assert all(np.isclose(few[x.query_id, x.video_id], x.score) for x in all_ if x.rank < 3)


def test_hybrid_search_fills_up_with_what_fails(spark):
    rows = [(1, "a", 0.9, False, 0.0, True), (1, "b", 0.2, True, 1.0, True), (1, "c", 0.5, False, 0.0, True)]
    s = spark.createDataFrame(rows, "query_id int, video_id string, out double, passed boolean, soft double, constrained boolean")
    got = search.hybrid_search(s, 3, beta=0.0).orderBy("rank").collect()
    assert [(x.video_id, x.passed) for x in got] == [("b", True), ("a", False), ("c", False)]
    assert got[0].margin == 0.2 - search.FILTERED and got[1].semantic == 0.9
    assert [x.video_id for x in search.hybrid_search(s, 3, beta=0.0, hard=False).orderBy("rank").collect()] == ["a", "c", "b"]
    assert search.hybrid_search(s, 1, beta=0.0, meta_alpha=0.3, hard=False).first().video_id == "b"


def test_only_the_best_of_each_task_are_shuffled(spark):
    from quern.operators import search

    rows = [(q, v, None if v == 3 else float((q or 0) * v % 7)) for q in (1, 2, None) for v in range(40)]
    df = spark.createDataFrame(rows, "query_id long, video_id long, base double").coalesce(1)
    got = sorted((tuple(r) for r in search.best_of(df, 5, "base", least=16).collect()), key=str)
    want = [r for q in (1, 2) for r in sorted((x for x in rows if x[0] == q and x[2] is not None), key=lambda x: (-x[2], x[1]))[:5]]
    assert [r for r in got if r[0] is not None] == sorted(want, key=str) and len(got) == 15
    # The softmax over a video's queries, one of which is far below the others.
    s = spark.createDataFrame([(1, 1, 900.0), (2, 1, 900.4), (3, 1, -900.0)], "query_id long, video_id long, out double")
    p = {r.query_id: r.out for r in search.column_softmax(s, 0.4).collect()}
    assert abs(p[2] - 1 / (1 + 2.718281828459045**-1)) < 1e-9 and p[3] == 0 and abs(p[1] + p[2] - 1) < 1e-9
    plan = search.column_softmax(search.reranked(df.select("*", F.col("base").alias("qamp")), top=10))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("rightHint=(strategy=broadcast)")


def test_likely_best_are_cut_before_the_shuffle(spark):
    from quern.operators import search

    odd = [None, float("nan"), -9.0, 9.0]
    df = spark.createDataFrame([(q, v, odd[v] if v < 4 and q else (q * 31 + v * 7) % 61 / 61) for q in (0, 1) for v in range(60)], "query_id long, video_id long, base double").repartition(4)
    for k in (1, 3, 20, 59, 60, 100):
        want = sorted(str(tuple(r)) for r in search.top_k(df, k, "base").collect())
        assert sorted(str(tuple(r)) for r in search.top_k(search.likely(df, k, "base"), k, "base").collect()) == want
    assert search.likely(df, 3, "base").count() < 12
    # Re-ranking cuts before its best are shuffled.
    plan = search.reranked(df.select("*", F.col("base").alias("qamp")), top=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bound" in plan
