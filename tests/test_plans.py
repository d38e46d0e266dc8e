import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import vectors
from quern.operators import evaluate, experts, gallery, identity, metadata, noise, planners, routes, sampling, scans, segments, spans, spectra
from quern.plans import routing
from quern.sources import tables
from quern.streaming import events


def test_smoothing_of_series_shorter_than_the_window(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 5.0), (2, 0.0, 6.0)], "k int, t double, v double")
    got = {(r.k, r.t): round(r.smooth, 6) for r in segments.smoothed(df, "k", "t", "v").collect()}
    assert got == {(1, 0.0): 0.333333, (1, 1.0): 2.0, (2, 0.0): 2.0}


def test_empty_lists_constrain_nothing(spark):
    row = "1.0D AS created, 'coast' AS geo, 'running' AS motion, '' AS device, 0.0D AS confidence, null AS t_start, null AS t_end, cast(array() AS array<string>) AS q_geo, array('running') AS q_motion, 'gopro' AS q_device"
    r = spark.sql("SELECT " + row.replace("null AS t", "cast(null AS double) AS t")).select(metadata.hard_pass(False).alias("lenient"), metadata.hard_pass(True).alias("strict"), metadata.fired().alias("fired"), metadata.soft_score().alias("soft")).first()
    assert (r.lenient, r.strict, r.fired) == (True, False, ["motion", "device"]) and abs(r.soft - 0.5**0.5) < 1e-9


def test_words_within_words_are_no_time_rule(spark):
    now = dt.datetime(2026, 4, 24, 15, tzinfo=dt.timezone.utc)
    t = spark.createDataFrame([("holidaytoday",), ("last 2 days",), ("winter",)], "x string").select(metadata.time_window(F.col("x"), now).alias("w")).collect()
    assert t[0].w is None and t[1].w.t_end == now.timestamp() and t[1].w.t_start == now.timestamp() - 172800
    assert t[2].w.t_end - t[2].w.t_start == 90 * 86400


def test_wrong_routes_are_errors(spark):
    assert routes.bank(spark).count() == 30
    good = ("a", ["geo"], ["time"], 500, "qamp", "low", False)
    assert routes.bank(spark, [good]).count() == 1
    assert routes.bank(spark, [(*good[:5], "high", True)]).count() == 1
    wrong = {0: "", 1: ["time"], 2: ["place"], 3: 42, 4: "best", 5: "none", 6: True}
    for k, value in wrong.items():
        with pytest.raises(ValueError):
            routes.bank(spark, [(*good[:k], value, *good[k + 1 :])])
    with pytest.raises(ValueError):
        routes.bank(spark, [good, good])


def test_a_bank_without_a_plain_route_gets_one(spark, tmp_path):
    (tmp_path / "bank.json").write_text('{"route_id":"A","hard_axes":["geo"],"soft_axes":[],"candidate_topm":300,"rerank_mode":"none","budget_tier":"high"}\n')
    assert [(r.route_id, r.cost) for r in routes.read_bank(spark, str(tmp_path)).orderBy("idx").collect()] == [("R00_fallback", 1.0), ("A", 4.0)]


def test_plans_join_what_tasks_share(spark):
    v = spark.createDataFrame([(1, 5.0)], "video_id int, duration double")
    t = spark.createDataFrame([("a", 1.0, 50, None), ("b", 1.0, 50, None), ("c", 1.0, 50, "a")], "task_id string, sparse_fps double, max_sparse int, gated_by string")
    got = sampling.merged(sampling.sparse_proposals(v, t)).orderBy("ts").collect()
    assert [r.ts for r in got] == [0, 1, 2, 3, 4] and all(r.subscribers == ["a", "b"] for r in got)


def test_suppression(spark):
    x = spark.createDataFrame([(1, 0.0, 5.0, 0.9), (1, 1.0, 6.0, 0.8), (1, 20.0, 25.0, 0.7)], "k int, start double, end double, score double")
    assert sorted(r.start for r in scans.suppressed(x, "k", 0.3).collect()) == [0.0, 20.0]


def test_segment_measures(spark):
    p = spark.createDataFrame([(1, 0.0, 5.0, 0.9), (2, 0.0, 1.0, 0.5), (3, 0.5, 2.5, 0.5)], "k int, start double, end double, score double")
    g = spark.createDataFrame([(1, 0.0, 5.0), (2, 7.0, 8.0), (3, 0.0, 2.0), (4, 0.0, 1.0)], "k int, start double, end double")
    got = {r.k: (r.mean_iou, r.boundary_mae) for r in spans.mean_iou(p, g, "k").collect()}
    assert got[1] == (1.0, 0.0) and got[2][0] == 0.0 and got[3] == (0.6, 1.0) and got[4] == (0.0, None)


def test_running_sums_meet_across_blocks(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id")).cast("double").alias("v"), F.lit(1).alias("c"))
    assert evaluate.running(df, "v", ["c"]).where("run_c <> sqrt(v) + 1").count() == 0
    assert evaluate.running(df, "v", ["c"], descending=True).where("run_c <> 5000 - sqrt(v)").count() == 0
    assert evaluate.conformal_threshold(df.limit(0), "v", 0.1).first().threshold == float("inf")
    assert evaluate.conformal_threshold(df.where("v < 17"), "v", 0.01).first().threshold == float("inf")


def test_paired_tests_find_a_difference(spark):
    df = spark.range(300).select((F.col("id") % 3 == 0).alias("a"), (F.col("id") % 3 != 1).alias("b"))
    r = experts.paired_tests(df, "a", "b", 200).first()
    assert abs(r.delta - 1 / 3) < 1e-9 and r.p < 0.02 and r.low < r.delta < r.high and r.low > 0.2
    same = experts.paired_tests(df.withColumn("b", F.col("a")), "a", "b", 50).first()
    assert same.p == 1.0 and same.low == same.high == 0


def test_splits_do_not_move(spark):
    s = {"train": 0.6, "dev": 0.15, "test": 0.25}
    a = {r.id: r.split for r in experts.splits(spark.range(2000), "id", s).collect()}
    b = {r.id: r.split for r in experts.splits(spark.range(500), "id", s).collect()}
    assert all(a[k] == b[k] for k in b) and abs(sum(v == "train" for v in a.values()) / 2000 - 0.6) < 0.05


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"qid":1,"query":"x","vid":"v","duration":9.0,"relevant_windows":[[0,2],[4,6]]}\n{"qid":2,"query":"y","vid":"w","duration":5.0,"relevant_windows":[]}\n')
    assert sorted((r.qid, r.start) for r in tables.load_annotations(spark, str(tmp_path / "a.jsonl")).fillna(-1).collect()) == [(1, 0.0), (1, 4.0), (2, -1.0)]
    (tmp_path / "q.csv").write_text("sentence,video_id\na dog runs,v1\n")
    assert tables.load_queries(spark, str(tmp_path / "q.csv")).first().video_id == "v1"
    (tmp_path / "clip.mp4").write_bytes(b"1234")
    assert [tuple(r)[::2] for r in tables.list_videos(spark, str(tmp_path)).collect()] == [("clip", 4)]
    rows = spark.createDataFrame([("m", 0.5)], "method string, r1 double")
    tables.save_results(rows, str(tmp_path / "out"), "csv")
    assert "| m | 0.5 |" in tables.markdown(rows, "Results") and spark.read.option("header", True).csv(str(tmp_path / "out")).first().method == "m"


@pytest.mark.parametrize("form", ["sessions", "buckets", "first_seen"])
def test_streams_end_with_the_rows_of_a_batch(spark, tmp_path, form):
    rows = [(k, 1, f"2024-01-01 00:{m:02d}:00", "click", 1.0) for k, m in enumerate((0, 5, 10, 59))] + [(3, 1, "2024-01-01 00:59:00", "click", 1.0), (9, 2, "2024-01-03 00:00:00", "error", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = getattr(events, form)(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()
    if form == "sessions":
        assert [(r.user_id, r.n) for r in got if r.user_id == 1] == [(1, 3), (1, 2)] or sorted(r.n for r in got if r.user_id == 1) == [2, 3]
    elif form == "buckets":
        assert [(r.event_type, r.n, r.total) for r in got] == [("click", 5, 5.0)]
    else:
        assert sorted(r.event_id for r in got) == [0, 1, 2, 3, 9]


def test_still_runs_end_where_the_next_window_starts(spark):
    # Ten rows a second: windows of five rows, two apart. Still, moving, still to the end.
    values = [0.0] * 8 + [0.0, 9.0] * 4 + [1.0] * 12
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 1.0), ("c", 0, 1.0), ("c", 1, 1.0)], "k string, i int, v double")
    durations = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 7.0)], "k string, duration double")
    got = sorted((r.k, round(r.start, 3), round(r.end, 3)) for r in spans.variance_runs(rows, durations, "k", "i", "v", 10.0, 0.01).collect())
    # Windows start at 0, 2, .. 22; those from 6 on hold a 9, until the one at 16; "b" has one row, "c" one short window.
    assert got == [("a", 0.0, 0.6), ("a", 1.6, 3.0), ("c", 0.0, 7.0)]


def test_a_variance_at_the_threshold_is_not_below_it(spark):
    # The variance of the five is 0.08, which other ways to sum round to less.
    rows = spark.createDataFrame([(k, i, v) for k, values in enumerate(([0.3, 1.0, 0.4, 0.6, 0.2], [0.3, 0.9, 0.4, 0.6, 0.2])) for i, v in enumerate(values)], "k int, i int, v double")
    got = spans.variance_runs(rows, spark.createDataFrame([(0, 1.0), (1, 1.0)], "k int, duration double"), "k", "i", "v", 10.0, 0.08)
    assert [tuple(r) for r in got.collect()] == [(1, 0.0, 1.0)]


def test_masks_in_words_equal_sets_of_buckets(spark):
    r = random.Random(4)
    videos = [(k, r.choice([0.01, 6.4, 12.8, r.uniform(0, 30)])) for k in range(12)]
    static = [(r.randrange(14), a := r.uniform(-1, 25), a + r.uniform(0, 9)) for _ in range(30)] + [(1, 2.0, 2.0 + 12.8)]
    marks = [(r.randrange(14), r.uniform(0, 31)) for _ in range(40)]
    v, s, m = (spark.createDataFrame(x, f"video_id int, {c}") for x, c in ((videos, "duration double"), (static, "start double, end double"), (marks, "ts double")))
    mask = sampling.static_mask(v, s, m)
    want = {}
    for k, duration in videos:
        for b in range(max(1, math.floor(duration * 10))):
            gone = any(j == k and e - a >= 2 and max(0, math.floor(a * 10)) < b < math.floor(e * 10) for j, a, e in static)
            want[k, b] = not gone or any(j == k and math.floor(t * 10) == b for j, t in marks)
    assert {(x.video_id, x.bucket): x.keep for x in mask.collect()} == want and False in want.values()
    plan = spark.createDataFrame([(k, i / 10 + 0.05, ["a", "b"] if i % 7 else ["c"]) for k in range(13) for i in range(320)], "video_id int, ts double, subscribers array<string>")
    left = {(k, i) for k in range(13) for i in range(320) if i % 7 == 0 or want.get((k, i))}
    for got in (sampling.apply_words(plan, sampling.mask_words(v, s, m), ["c"]), sampling.apply_mask(plan, mask, ["c"])):
        assert {(x.video_id, math.floor(x.ts * 10)) for x in got.collect()} == left
        # Spark takes an exploded mask for small, and would send it to every task through the driver.
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in mask._jdf.queryExecution().executedPlan().toString()


def test_close_frames_have_close_hashes():
    r = np.random.RandomState(0)
    image = r.randint(0, 256, (64, 64, 3), dtype=np.uint8)
    other = image.copy()
    other[0, 0] = (other[0, 0].astype(int) + 1) % 256
    a, b = (int(x) for x in identity.perceptual_hashes(np.stack([image, other])))
    assert bin((a ^ b) & (2**64 - 1)).count("1") <= 5
    # A frame of another size, against the definition by sums.
    grey = r.randint(0, 256, (50, 70), dtype=np.uint8)
    ys, xs = np.linspace(0, 50, 33).astype(int), np.linspace(0, 70, 33).astype(int)
    small = np.array([[grey[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].mean() for j in range(32)] for i in range(32)])
    n = np.arange(32)
    low = np.array([[sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in n for x in n) * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 16 for v in range(8)] for u in range(8)])
    low[0, 0] = 0
    want = sum(1 << k for k, c in enumerate(low.ravel()) if c > np.median(low))
    assert int(identity.perceptual_hashes(grey[None])[0]) & (2**64 - 1) == want


def test_hashes_of_frames_of_all_shapes(spark):
    r = np.random.RandomState(1)
    shapes = [(40, 40, 3), (40, 40, 1), (8, 8, 1), (33, 90, 3), (40, 40, 3)]
    images = [r.randint(0, 256, s, dtype=np.uint8) for s in shapes]
    images[4] = images[0]
    rows = [(k, *s, bytearray(i.tobytes()), "x") for k, (s, i) in enumerate(zip(shapes, images, strict=True))] + [(5, 0, 0, 0, bytearray(), "x"), (6, None, None, None, None, "x")]
    got = {x.id: x for x in identity.hashed(spark.createDataFrame(rows, "id int, height int, width int, channels int, pixels binary, note string")).collect()}
    assert got[0].phash == got[4].phash and got[0].exact_key == got[4].exact_key == hashlib.sha256(np.ascontiguousarray(images[0][::16, ::16]).tobytes()).hexdigest()
    assert all(got[k].phash == int(identity.perceptual_hashes(images[k][None] if shapes[k][2] == 3 else images[k][None, ..., 0])[0]) for k in range(5))
    assert got[5].phash == got[6].phash == 0 and got[5].exact_key == got[6].exact_key == hashlib.sha256(b"").hexdigest() and got[6].note == "x"


@pytest.mark.parametrize("bands", [6, 7, 8])
def test_hamming_join_equals_all_pairs(spark, bands):
    r = random.Random(bands)
    seeds = [r.getrandbits(64) for _ in range(12)]
    signed = lambda x: x - 2**64 if x >> 63 else x
    turned = lambda x: signed(x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))))
    store = [(k, turned(r.choice(seeds))) for k in range(150)] + [(k, signed(seeds[0])) for k in range(150, 200)] + [(200, None)]
    queries = [(k, turned(r.choice(seeds))) for k in range(80)] + [(80, None), (81, signed(seeds[0]))] * 2
    got = identity.nearest_by_hash(spark.createDataFrame(queries, "query_id long, phash long"), spark.createDataFrame(store, "frame_id long, phash long"), 5, bands).collect()
    first, last = {}, {}
    for k, h in store:
        first.setdefault(h, k)
        last[h] = k
    want = []
    for q, h in queries:
        near = [] if h is None else sorted((bin((h ^ s) & (2**64 - 1)).count("1"), first[s], last[s]) for s in first if s is not None)
        want.append((q, near[0][2], near[0][0]) if near and near[0][0] <= 5 else (q, None, None))
    assert sorted(((x.query_id, x.match_id, x.distance) for x in got), key=repr) == sorted(want, key=repr)
    assert any(w[1] is None for w in want) and any((w[2] or 0) > 2 for w in want)


def test_masks_part_more_hashes_into_longer_keys():
    assert [identity.bands_for(n, 5) for n in (10, 10**5, 10**8, 10**10)] == [6, 7, 8, 9]
    assert all(bin(m & (2**64 - 1)).count("1") >= 18 for m in identity.masks_of(5, 7)) and len(identity.masks_of(5, 7)) == 21


def test_levels_of_identity(spark):
    store = spark.createDataFrame([(1, "a", 0, [1.0, 0.0]), (2, "a", 0, [1.0, 0.0]), (3, "b", 255, [0.0, 1.0])], "frame_id long, exact_key string, phash long, emb array<double>")
    queries = spark.createDataFrame([(1, "a", 2**62, [0.0, 1.0]), (2, "z", 7, [0.0, 1.0]), (3, "z", 2**62 - 1, [0.1, 0.995]), (4, "z", 2**62 - 1, [0.7, 0.7])], "query_id long, exact_key string, phash long, emb array<double>")
    got = lambda mode: sorted(tuple(r) for r in identity.matched(queries, store, mode).collect())
    assert got("embedding") == [(1, "exact", 2), (2, "perceptual", 2), (3, "embedding", 3), (4, "miss", None)]
    assert got("perceptual")[2:] == [(3, "miss", None), (4, "miss", None)] and got("exact")[1] == (2, "miss", None)


def walk(times, gap, strict=False):
    out = []
    for t in sorted(times):
        if not out or (t - out[-1] > gap if strict else t - out[-1] >= gap):
            out.append(t)
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_anchors_over_blocks_equal_one_walk(spark, strict):
    r = random.Random(3)
    series = {k: [round(r.uniform(0, 40), r.choice([1, 3])) for _ in range(n)] for k, n in enumerate((1, 2, 30, 400, 4000))}
    series[None] = [0.1 * i for i in range(300)] + [-3.7, -3.7, 1000.0]
    rows = [(k, t, "x") for k, ts in series.items() for t in ts] + [(3, None, "x")]
    df = spark.createDataFrame(rows, "k int, t double, anchor string").drop("anchor").repartition(3)
    for gap, gaps in ((0.3, 2), (0.1, 7), (5.0, 64)):
        got = {}
        for x in scans.anchors(df, "k", "t", gap, strict, gaps).collect():
            got.setdefault(x.k, []).append(x.t)
        assert {k: sorted(v) for k, v in got.items()} == {k: walk(v, gap, strict) for k, v in series.items()}
    for x in scans.anchored(df, "k", "t", 0.3, strict, 2).collect():
        assert x.anchor == max(a for a in walk(series[x.k], 0.3, strict) if a <= x.t)


def test_a_long_series_is_scanned_in_blocks(spark):
    rows = spark.range(80_000).select(F.lit(1).alias("k"), (F.col("id") * 0.01).alias("t"), F.lit(1.0).alias("v"))
    assert sampling.spaced(rows, "k", "t", "v", 0.5, 0.05).count() == len(walk([i * 0.01 for i in range(80_000)], 0.05))


def test_spaced_frames_fall_back_to_changes(spark):
    df = spark.createDataFrame([(1, 0.0, 0.1), (1, 1.0, 0.3), (1, 2.0, 0.31), (2, 0.0, 0.9), (2, 0.2, 0.9), (3, 0.0, None)], "k int, t double, v double")
    got = sorted(map(tuple, sampling.spaced(df, "k", "t", "v", 0.5, 1.0, fallback=0.06).collect()))
    assert got == [(1, 0.0), (1, 1.0), (2, 0.0), (3, 0.0)]
    assert sorted(map(tuple, sampling.spaced(df, "k", "t", "v", 0.5, 1.0).collect())) == [(2, 0.0)]


def test_union_of_samplers_joins_origins(spark):
    grid = [(1, i / 2, "uniform") for i in range(4)] + [(1, i / 4, "dense") for i in range(8)] + [(2, 0.1, "uniform")]
    got = sorted(map(tuple, sampling.union_of_samplers(spark.createDataFrame(grid, "video_id int, ts double, origin string"), 0.1).collect()))
    assert got == [(1, i / 4, "dense" if i % 2 else "dense|uniform") for i in range(8)] + [(2, 0.1, "uniform")]


def test_interest_is_merged_before_the_budget(spark):
    schema = "k int, start double, end double, score double"
    one = spark.createDataFrame([(1, 1.0, 2.0, 0.8), (1, 2.3, 3.0, 0.7), (1, 1.5, 2.5, 0.9)], schema)
    assert [tuple(x) for x in scans.interest_plan(one, "k", 0.0, 0.5).collect()] == [(1, 1.0, 3.0, 0.9)]
    three = spark.createDataFrame([(1, 0.0, 0.5, 0.9), (1, 2.0, 2.5, 0.8), (1, 4.0, 4.5, 0.7)], schema)
    assert sorted(x.start for x in scans.interest_plan(three, "k", 0.0, 0.0, most=2).collect()) == [0.0, 2.0]
    # What is left after the first is too little for the second, but the third fits.
    small = spark.createDataFrame([(1, 0.0, 59.9, 0.9), (1, 70.0, 75.0, 0.8), (1, 80.0, 80.05, 0.7)], schema)
    assert sorted(x.start for x in scans.budgeted(small, "k").collect()) == [0.0, 80.0]


def test_lengths_are_not_rounded_with_starts(spark):
    schema = "k int, start double, end double, score double"
    # 60 - 59.85 is rounded to less than 0.15, and a length that is given isn't rounded with its start.
    near = spark.createDataFrame([(1, 0.0, 59.85, 0.9, 59.85), (1, 70.0, 70.15, 0.8, 0.15), (1, 80.0, 80.14, 0.7, 0.14)], schema + ", length double")
    assert sorted(x.start for x in scans.budgeted(near, "k", length="length").collect()) == [0.0, 80.0]
    assert [x.score for x in scans.budgeted(spark.createDataFrame([(1, 0.0, 59.85, 0.9), (1, 0.0, 0.15, 0.8)], schema), "k").collect()] == [0.9]


@pytest.mark.parametrize("large", [5, 10**6])
def test_suppression_equals_one_greedy_walk(spark, large, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(7)
    rows = [(k, round(a := r.uniform(0, 60), 2), round(a + r.uniform(0, 6), 2), r.choice([0.5, r.random()])) for k in (1, 2, None) for _ in range(120)]
    rows += [(5, float(i), i + 1.5, i / 100) for i in range(60)] + rows[:3]
    got = sorted(map(tuple, scans.suppressed(spark.createDataFrame(rows, "k int, start double, end double, score double"), "k", 0.25, large).collect()), key=repr)
    want = []
    for k in (1, 2, None, 5):
        kept = []
        for x in sorted({x for x in rows if x[0] == k}, key=lambda x: (-x[3], x[1], x[2])):
            over = [max(0.0, min(x[2], y[2]) - max(x[1], y[1])) / (max(x[2], y[2]) - min(x[1], y[1]) or 1) for y in kept]
            if all(o < 0.25 for o in over):
                kept.append(x)
        want += kept
    assert got == sorted(want, key=repr)


def test_best_rows_lie_apart(spark):
    df = spark.createDataFrame([(1, 0.0, 0.9), (1, 0.3, 0.8), (1, 0.31, 0.7), (1, 5.0, 0.1), (2, 1.0, 0.5), (2, 1.0, 0.5)], "k int, t double, v double")
    assert sorted(map(tuple, scans.best_spaced(df, "k", "t", "v", 2, 0.3).collect())) == [(1, 0.0, 0.9), (1, 0.31, 0.7), (2, 1.0, 0.5)]


def test_main_frequency_in_one_task_and_spread(spark):
    r = np.random.RandomState(5)
    series = {"a": r.randn(50), "b": r.randn(51), "c": np.sin(np.arange(97) * 2 * np.pi * 11 / 97), "d": r.randn(2), "e": np.arange(200.0)}
    df = spark.createDataFrame([(k, i, float(x)) for k, xs in series.items() for i, x in enumerate(xs)] + [("one", 0, 1.0)], "key string, i int, v double").repartition(3)
    want = {k: (len(x), 1 + int(np.abs(np.fft.rfft(x - x.mean()))[1:].argmax())) for k, x in series.items()} | {"one": (1, None)}
    assert {x.key: (x.n_rows, x.bin) for x in spectra.main_frequency(df, "key", "i", "v").collect()} == want
    spread = {x.key: (x.n_rows, x.bin) for x in spectra.main_frequency(df, "key", "i", "v", long=10).collect()}
    assert spread == want


def test_spread_transform_equals_the_whole(spark):
    x = np.random.RandomState(2).randn(300)
    df = spark.createDataFrame([("a", i, float(v), 300) for i, v in enumerate(x)], "_key string, i long, x double, n long")
    got = sorted((r.i, r.re, r.im) for r in spectra.spread_transform(df).collect())
    assert np.allclose([complex(a, b) for _, a, b in got], np.fft.fft(x), atol=1e-8)


def test_motion_of_sensor_streams(spark):
    t = np.linspace(0, 2.0, 100)
    swing = 3.0 * np.sin(2 * np.pi * 3.0 * t)
    gyro = [("still", 0.0, 0.0, 0.0)] * 100 + [("run", *(0.3 * x)) for x in np.random.RandomState(0).randn(100, 3).tolist() for x in [np.array(x)]] + [("short", 1.0, 1.0, 1.0), ("alone", 0.9, 0.9, 0.9), ("alone", 0.9, 0.9, 0.9)]
    accel = [("still", i, 0.0, 0.0, 9.8) for i in range(100)] + [("run", i, 0.0, 0.0, 9.8 + float(s)) for i, s in enumerate(swing)] + [("alone", i, 0.0, 0.0, 20.0) for i in range(4)]
    got = {x.k: x for x in spectra.sensor_motion(spark.createDataFrame([(k, *map(float, v)) for k, *v in gyro], "k string, gx double, gy double, gz double"), spark.createDataFrame(accel, "k string, i int, ax double, ay double, az double"), "k").collect()}
    assert got["still"].label == "stationary" and got["run"].label == "running" and abs(got["run"].hz - 3) < 0.5
    assert tuple(got["short"])[1:] == ("unknown", 0.0, None, None, None)
    assert got["alone"].label == "running" and got["alone"].accel_mag is None and got["alone"].confidence == 0.5


def test_signals_of_a_gallery(spark):
    rows = [("a", 0, [1.0, 0.0], 0.2, True, 0.7, [0.0, 2.0], "x"), ("a", 1, [0.0, 1.0], 0.9, False, 0.99, [5.0, 0.0], "y"), ("a", 2, [0.0, 1.0], 0.1, True, 0.8, [0.0, 4.0], "y"), ("b", 0, [3.0, 4.0], None, False, None, None, None)]
    frames = spark.createDataFrame(rows, "video_id string, frame_no int, emb array<double>, highlight double, face boolean, confidence double, face_emb array<double>, label string")
    got = {r.video_id: r for r in gallery.gallery_signals(frames).collect()}
    assert np.allclose(got["a"].emb, np.array([1, 2]) / 5**0.5) and (got["a"].highlight, got["a"].face, got["a"].scene) == (0.9, 0.8, "y")
    assert np.allclose(got["a"].face_emb, [0, 1]) and np.isclose(got["a"].scenes["x"], 1 / 3)
    assert np.allclose(got["b"].emb, [0.6, 0.8]) and tuple(got["b"])[2:6] == (0.0, 0.0, None, "other")


def test_words_of_queries(spark):
    q = spark.createDataFrame([("A MAN runs to the Beach street",), ("精彩的山",), ("",), (None,)], "text string")
    got = [(r.wants_person, r.wants_highlight, r.scene_cue) for r in gallery.priors(q).collect()]
    assert got == [(True, False, "urban"), (False, True, "nature"), (False, False, None), (False, False, None)]


def test_ranks_of_all_subsets_equal_sorting(spark):
    r = np.random.RandomState(9)
    names = ["highlight", "face", "face_id", "scene"]
    rows = [(q, v, q if q < 4 else 99, *(round(float(x), 2) for x in r.rand(5))) for q in range(5) for v in range(30)]
    scored = spark.createDataFrame(rows, "query_id int, video_id int, own int, sem double, highlight double, face double, face_id double, scene double")
    got = {(x.query_id, x.sid): x.rank for x in gallery.subset_ranks(scored).collect()}
    assert len(got) == 80
    for q in range(5):
        for s in range(16):
            total = {v: round(sem + 0.35 * sum(e for j, e in enumerate(es) if s >> j & 1), 9) for query, v, _, sem, *es in rows if query == q}
            assert got[q, s] == (sum(t > total[q] for t in total.values()) if q < 4 else -1)
    values = gallery.lattice(gallery.subset_ranks(scored))
    picked = gallery.selected(scored, gallery.subset_ranks(scored), values, threshold=0.5).collect()
    assert all(p.cost <= 5 and p.rank == got[p.query_id, p.sid] for p in picked) and len(picked) == 5 and names == list(experts.NAMES)
    for metric, want in (("rr", 0.25), ("recall@1", 0.0), ("recall@5", 1.0)):
        assert spark.range(1).select(gallery.value_of(F.lit(3), metric).alias("v")).first().v == want


def test_pairs_of_a_gallery_are_neither_shuffled_nor_broadcast(spark):
    r = np.random.RandomState(3)
    vector = lambda: [float(x) for x in r.rand(4)]
    signals = spark.createDataFrame([(v, vector(), 0.1 * v, 0.5, vector() if v % 3 else None, "beach") for v in range(7)], "video_id long, emb array<double>, highlight double, face double, face_emb array<double>, scene string")
    queries = spark.createDataFrame([(q, q, vector(), "face", [0.0, 0.0, 3.0, 4.0] if q else None) for q in range(3)], "query_id long, own long, emb array<double>, text string, face_emb array<double>")
    scored = gallery.expert_scores(signals, queries)
    faces = {x.video_id: 0.6 * x.face_emb[2] + 0.8 * x.face_emb[3] if x.face_emb else 0.0 for x in signals.collect()}
    lo, hi = min(faces.values()), max(faces.values())
    got = {(x.query_id, x.video_id): x.face_id for x in scored.collect()}
    assert len(got) == 21 and all(abs(f - ((faces[v] - lo) / (hi - lo) if q else 0.0)) < 1e-6 for (q, v), f in got.items())
    plan = gallery.subset_ranks(scored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("rightHint=(strategy=broadcast)")


def test_exact_upper_bounds(spark):
    def bound(k, n, alpha=0.05):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            p = (lo + hi) / 2
            low = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
            lo, hi = (lo, p) if low <= alpha else (p, hi)
        return lo

    cases = [(0, 1), (0, 100), (2, 100), (37, 40), (39, 40), (50, 5000), (4000, 5000), (1, 100_000)]
    df = spark.createDataFrame([*cases, (0, 0), (7, 7)], "k int, n int")
    got = {(r.k, r.n): r.u for r in df.select("k", "n", evaluate.exact_upper(F.col("k"), F.col("n")).alias("u")).collect()}
    assert all(abs(got[c] - bound(*c)) < 1e-9 for c in cases) and got[0, 0] == got[7, 7] == 1.0
    assert abs(got[0, 100] - (1 - 0.05 ** (1 / 100))) < 1e-9 and 0.02 < got[2, 100] < 0.10


def _values(spark, rows):
    """rows: query, route, hard, soft, value and four probabilities."""
    schema = "query_id int, route_id string, idx int, hard_axes array<string>, soft_axes array<string>, candidate_topm int, rerank_mode string, cost double, value double, p_time double, p_geo double, p_motion double, p_device double"
    return spark.createDataFrame([(q, r, i, h, s, 500, "none", 1.0, v, *p) for q, r, i, h, s, v, p in rows], schema)


def test_choice_by_zones(spark):
    bank = [("plain", [], []), ("t", ["time"], []), ("tg", ["time", "geo"], []), ("g", ["geo"], ["time"]), ("s", [], ["geo"])]
    safe, doubt, no = 0.9, 0.4, 0.1
    cases = {1: ((safe, no, no, no), (0.1, 0.2, 0.9, 0.9, 0.9)), 2: ((safe, safe, no, no), (0.1, 0.2, 0.9, 0.8, 0.9)), 3: ((no, doubt, no, no), (0.5, 0.9, 0.9, 0.9, 0.2)), 4: ((no, no, no, safe), (0.5, 0.9, 0.9, 0.9, 0.9)), 5: ((doubt, doubt, no, no), (0.5, 0.9, 0.9, 0.9, 0.6))}
    rows = [(q, r, i, h, s, values[i], p) for q, (p, values) in cases.items() for i, (r, h, s) in enumerate(bank)]
    got = {x.query_id: x for x in planners.zoned_choice(_values(spark, rows), {"time": 0.5, "geo": 0.5, "motion": 0.5, "device": None}).collect()}
    assert {q: (x.route_id, x.fallback_type, x.n_hard, x.n_soft) for q, x in got.items()} == {
        1: ("t", "none", 1, 0), 2: ("tg", "none", 4, 0), 3: ("dynamic_soft_geo", "soft", 1, 1), 4: ("plain", "semantic", 0, 0), 5: ("s", "none", 1, 1),
    }
    assert abs(got[3].value - 0.5 * 1.05) < 1e-12 and got[3].soft_axes == ["geo"] and (got[3].cost, got[3].idx) == (1.0, 5)


def _sem(spark, ranks):
    """Scores under which the right video of a query (id 0) has the rank given for each number of candidates."""
    rows = [(q, v, 0, top, float(100 - v) if v else 99.5 - rank, *([True, 1.0, False] * 4)) for q, by in ranks.items() for top, rank in by.items() for v in range(60)]
    axes = ", ".join(f"pass_{a} boolean, soft_{a} double, has_{a} boolean" for a in metadata.AXES)
    return spark.createDataFrame(rows, f"query_id int, video_id int, own int, topm int, sem double, {axes}")


def test_cascade_searches_failed_queries_again(spark):
    bank = routes.bank(spark)
    sem = _sem(spark, {1: {500: 2, 1000: 0}, 2: {500: 7, 1000: 20}, 3: {500: 30, 1000: 6}, 4: {500: 30, 1000: 20}})
    plain = bank.where("idx = 0").drop("budget_tier", "dense")
    first = routes.executed_choices(sem, sem.select("query_id").distinct().crossJoin(plain))
    assert {x.query_id: x.rank for x in first.collect()} == {1: 2, 2: 7, 3: 30, 4: 30}
    got = {x.query_id: (x.route_id, x.rank, x.stage) for x in planners.cascade(sem, first, bank).collect()}
    # The full route reads the same scores as the large one.
    assert got == {1: (planners.PLAIN, 2, 1), 2: (planners.PLAIN, 7, 2), 3: (planners.LARGE, 6, 2), 4: (planners.LARGE, 20, 3)}
    lost = first.withColumn("rank", F.lit(-1)).withColumn("gt_filtered", F.lit(True))
    assert {x.query_id: x.rank for x in planners.cascade(sem, lost, bank).collect()} == {1: 0, 2: 20, 3: 6, 4: 20}


def test_baselines_choose_by_what_is_asked(spark):
    bank = routes.bank(spark)
    names = {r.idx: r.route_id for r in bank.collect()}
    asked = spark.createDataFrame([(1, [], 0.1), (2, ["time", "geo"], 0.05), (3, ["device", "motion"], 0.0), (4, ["time", "geo", "motion", "device"], None)], "query_id int, asked array<string>, margin double")
    grid = spark.createDataFrame([(q, n, i, (i * 7 + q) % 11 - 1, 1.0, float(-((i * 7 + q) % 11))) for q in range(1, 5) for i, n in names.items()], "query_id int, route_id string, idx int, rank int, cost double, utility double")
    got = {(x.query_id, x.baseline): x for x in planners.baselines(grid, bank, asked).collect()}
    assert len(got) == 28
    route = {k: x.route_id[:3] for k, x in got.items()}
    assert [route[q, "rules"] for q in range(1, 5)] == ["R00", "R06", "R04", "R09"] == [route[q, "all_hard"] for q in range(1, 5)]
    assert [route[q, "margin"] for q in range(1, 5)] == ["R00", "R16", "R29", "R29"]
    for q in range(1, 5):
        assert got[q, "oracle"].route_id == names[min(range(30), key=lambda i: ((i * 7 + q) % 11, i))]
        ranks = {i: (i * 7 + q) % 11 - 1 for i in names}
        place = lambda i: ranks[i] if ranks[i] >= 0 else 9999
        rule = int(got[q, "rules"].route_id[1:3])
        if ranks[1] == 0:
            want = 1
        elif q > 1 and 0 <= ranks[rule] < ranks[1]:
            want = rule
        else:
            want = min([1, rule if q > 1 else 1, 16], key=place)
        assert got[q, "cascade"].rank == ranks[want]


def test_places(spark):
    df = spark.createDataFrame([(19.0, 109.5, None), (30.0, 103.0, None), (30.0, 103.0, 1500.0), (None, None, 1500.0), (18.0, 111.0, 900.0)], "lat double, lon double, alt double")
    got = [r.g for r in df.select(metadata.geo_class(F.col("lat"), F.col("lon"), F.col("alt")).alias("g")).collect()]
    assert got == ["coast", "unknown", "mountain", "unknown", "coast"]
    way = spark.range(1).select(metadata.haversine_km(F.lit(52.52), F.lit(13.405), F.lit(48.8566), F.lit(2.3522)).alias("km")).first().km
    assert abs(way - 877.5) < 1


def test_draws_are_even_and_normal(spark):
    df = spark.range(20_000).select(noise.uniform(1, F.col("id"), "a").alias("u"), noise.uniform(1, F.col("id"), "b").alias("w"), noise.normal(1, F.col("id"), "a").alias("z"), noise.choice(1, F.col("id"), "c", "xyz").alias("c"))
    t = df.toPandas()
    assert 0 <= t.u.min() and t.u.max() < 1 and abs(t.u.mean() - 0.5) < 0.01 and abs(t.u.var() - 1 / 12) < 0.003 and abs(np.corrcoef(t.u, t.w)[0, 1]) < 0.03
    assert abs(t.z.mean()) < 0.03 and abs(t.z.std() - 1) < 0.03 and set(t.c) == {"x", "y", "z"} and t.c.value_counts(normalize=True).max() < 0.35


def test_noise_at_all_levels(spark):
    schema = "video_id int, creation_time double, latitude double, longitude double, geo_category string, motion_class string, motion_confidence double, device_make string, device_model string"
    full = (1e9, 30.0, 100.0, "urban", "walking", 0.9, "GoPro", "Hero")
    rows = [(k, *full) for k in range(3000)] + [(3000, *[None] * 8), (3001, None, None, None, "coast", None, 0.5, None, "Hero")]
    md = spark.createDataFrame(rows, schema)
    got = noise.noisy(md, noise.levels(spark)).toPandas()
    assert len(got) == 6 * len(rows)
    clean = got[(got.level == "clean") & (got.video_id < 3000)]
    assert [tuple(r)[1:9] for r in clean.itertuples(index=False)] == [full] * 3000
    for level, c in noise.LEVELS.items():
        mine = got[(got.level == level) & (got.video_id < 3000)]
        share = dict(zip(noise.FIELDS, c, strict=True))
        assert abs(mine.creation_time.isna().mean() - share["time_missing"]) < 0.03 and abs(mine.latitude.isna().mean() - share["place_missing"]) < 0.03
        assert (mine.latitude.isna() == mine.geo_category.isna()).all() and (mine.device_make.isna() == mine.device_model.isna()).all()
        assert abs(mine.motion_class.isna().mean() - share["motion_missing"]) < 0.03 and mine[mine.motion_confidence < 0.89].motion_confidence.round(6).isin([0.6]).all()
        assert abs((mine.creation_time - 1e9).std() - share["shift_days"] * 86400) <= 0.06 * share["shift_days"] * 86400 + 1e-9
    none = got[got.video_id == 3000].drop(columns=["video_id", "level"])
    assert none.isna().all().all()
    assert got[got.video_id == 3001][["creation_time", "latitude", "motion_class", "device_make"]].isna().all().all() and (got[got.video_id == 3001].device_model == "Hero").all()


def test_perturbed_gallery(spark):
    rows = [(k, [1.0], 0.5, 0.99, [1.0, 0.0] if k % 2 else None, "x", {"x": 1.0} if k % 3 else None) for k in range(600)]
    s = spark.createDataFrame(rows, "video_id int, emb array<double>, highlight double, face double, face_emb array<double>, scene string, scenes map<string,double>")
    same = noise.perturbed(s, 0.0).orderBy("video_id").collect()
    assert [tuple(r) for r in same] == rows
    t = noise.perturbed(s, 0.3).toPandas()
    assert t.highlight.between(0, 1).all() and t.face.between(0, 1).all() and abs(t.highlight.std() - 0.3) < 0.06
    assert (t[t.video_id % 3 == 0].scene == "x").all() and 0.2 < (t[t.video_id % 3 > 0].scene != "x").mean() < 0.4
    assert t[t.video_id % 2 == 0].face_emb.isna().all() and all(len(x) == 2 for x in t[t.video_id % 2 == 1].face_emb)


def test_overlaps_by_buckets_equal_all_pairs(spark):
    r = random.Random(11)
    seg = lambda n: [(k, a := round(r.uniform(-30, 50), 1), round(a + r.choice([0.0, 0.1, 1.5, 9.0]), 1)) for k in (1, 2) for _ in range(n)]
    pred = [(*s, round(r.random(), 3)) for s in {*seg(60), (1, -100.0, 200.0), (3, 0.0, 1.0)}]
    truth = [*{*seg(40), (2, 0.0, 500.0), (4, 0.0, 1.0)}]
    p = spark.createDataFrame(pred, "k int, start double, end double, score double")
    g = spark.createDataFrame(truth, "k int, start double, end double")
    want = sorted((k, a, b, c, d) for k, a, b, _ in pred for kk, c, d in truth if k == kk and a < d and c < b and a < b and c < d)
    assert sorted((x.k, x.p0, x.p1, x.g0, x.g1) for x in spans.overlaps(p, g, "k").collect()) == want
    assert spans.overlaps(p.limit(0), g.limit(0), "k").count() == 0
    got = {x.k: x for x in spans.mean_iou(p, g, "k").collect()}
    assert got[3].mean_iou == got[4].mean_iou == 0.0 and got[3].boundary_mae is None
    far = spark.createDataFrame([(1, 10.0, 11.0, 0.1), (1, 3.0, 5.0, 0.9)], "k int, start double, end double, score double")
    one = spans.mean_iou(far, spark.createDataFrame([(1, 0.0, 1.0)], "k int, start double, end double"), "k").first()
    assert (one.mean_iou, one.boundary_mae) == (0.0, 7.0)


def test_mean_average_precision(spark):
    p = spark.createDataFrame([(1, 0.0, 10.0, 0.9), (2, 0.0, 6.0, 0.9)], "k int, start double, end double, score double")
    g = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.0, 10.0)], "k int, start double, end double")
    got = spans.mean_average_precision(p, g, "k").first()
    # The second reaches 0.5, 0.55 and 0.6 of the ten thresholds.
    assert abs(got.map - (1 + 0.3) / 2) < 1e-6 and abs(got.map_at_half - 1) < 1e-6


def test_places_under_routes_equal_sorting_and_shuffle_no_pairs(spark):
    """Few values, so that many tie, filtered and missing right videos, and softmax over what passes, against a sort of each query's videos."""
    import math
    import random

    draw, beta, rows = random.Random(3), 0.4, []
    for q in range(3):
        for v in range(40):
            pair = [x for _ in metadata.AXES for x in (draw.random() < 0.7, draw.choice([0.0, 0.25, 1.0]), draw.random() < 0.5)]
            rows += [(q, v, 99 if q == 2 else 7 * q + 3, top, draw.choice([None, 0.1, 0.2, 0.3, 5.0]), *pair) for top in (100, 300, 500, 1000)]
    axes = ", ".join(f"pass_{a} boolean, soft_{a} double, has_{a} boolean" for a in metadata.AXES)
    sem = spark.createDataFrame(rows, f"query_id int, video_id int, own int, topm int, sem double, {axes}").repartition(3)
    got = {(x.query_id, x.route_id): (x.rank, x.gt_filtered, x.candidates) for x in routes.executed(sem, routes.bank(spark), beta).collect()}
    want = {}
    for name, hard, soft, top, mode, _, _ in routes.BANK:
        for q in range(2):
            held = []
            for _, v, own, _, x, *pair in [r for r in rows if r[0] == q and r[3] == top]:
                on = {a: pair[3 * k : 3 * k + 3] for k, a in enumerate(metadata.AXES)}
                asked = [on[a][1] for a in soft if on[a][2]]
                held.append((v, v == own, all(on[a][0] for a in hard), x, math.prod(asked) ** (1 / len(asked)) if asked else 1.0))
            inside = [x for *_, ok, x, _ in held if ok and x is not None]
            n = sum(ok for *_, ok, _, _ in held)
            post = mode == "col_softmax_post_filter" and n > 1
            value = lambda x: math.exp((x - max(inside)) / beta) / (sum(math.exp((y - max(inside)) / beta) for y in inside) + 1e-12) if post else x  # noqa: B023, E731
            lo, hi = (value(min(inside)), value(max(inside))) if inside else (0, 0)
            score = lambda ok, x, s: None if not ok or x is None else round(0.8 * ((value(x) - lo) / (hi - lo) if hi > lo else 0.5) + 0.2 * s if soft else value(x), 9)  # noqa: B023, E731
            order = sorted((score(ok, x, s) is None, -(score(ok, x, s) or 0), v, mine, ok) for v, mine, ok, x, s in held)
            place = next(k for k, x in enumerate(order) if x[3])
            want[q, name] = (place if order[place][4] else -1, not order[place][4], n)
    assert got == want
    # Without a limit of what is likely, every pair would go through the shuffle.
    pairs = spark.createDataFrame([(q, v, float((q * 31 + v * 7) % 97) / 97) for q in range(3) for v in range(97)], "query_id int, video_id int, base double")
    from quern.operators import search

    assert sorted(r.base for r in search.likely(pairs, 5, "base").where("query_id = 1").collect()) == [k / 97 for k in range(92, 97)]


def test_the_grid_in_the_kernel_equals_that_of_pairs(spark):
    rng = np.random.default_rng(8)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 8))).tolist()
    # More videos than the least number of candidates, some of them alike, one without its finest prototypes and one without metadata.
    each = {v: (unit(12) if v % 9 else unit(2) * 6) for v in range(130)}
    each |= {v: each[v - 1] for v in range(20, 30, 2)}
    lists = [(v, [(k, e) for k, e in zip([2] * 2 + [4] * 4 + [6] * 6, x, strict=True) if (v, k) != (7, 6)]) for v, x in each.items()]
    pick = lambda *x: x[rng.integers(len(x))]
    meta = [(v, *((pick(None, 5e3, 2e4, 9e4), pick(None, "a", "b"), pick(None, "x", "y"), pick(None, 0.0, 0.5), pick(None, "", "gopro 9", "iphone 12")) if v != 3 else (None,) * 5)) for v in each]
    intents = [(20 * i, int(rng.integers(140)), *pick((None, None), (1e4, 2e4), (8e4, 8e4)), pick([], ["a"], ["a", "b"], None), pick([], ["x"]), pick(None, "", "gopro")) for i in range(25)]
    lists = spark.createDataFrame(lists, "video_id long, protos array<struct<k:int,emb:array<double>>>")
    meta = spark.createDataFrame(meta, "video_id long, created double, geo string, motion string, confidence double, device string")
    intents = spark.createDataFrame(intents, "query_id long, own long, t_start double, t_end double, q_geo array<string>, q_motion array<string>, q_device string")
    queries = spark.createDataFrame([(20 * i, e) for i, e in enumerate(unit(25))], "query_id long, emb array<double>")
    bank = routes.bank(spark)
    got = routes.grid(lists, meta, queries, intents, bank, block=10)
    pairs = vectors.pooled_scores(lists, queries, (2, 4, 6), 0.1).join(intents, "query_id").join(meta, "video_id")
    for a in metadata.AXES:
        pairs = pairs.withColumns({f"has_{a}": metadata.constrained(a), f"pass_{a}": metadata.axis_pass(a, False), f"soft_{a}": metadata.axis_score(a)})
    want = routes.executed(routes.single_scores(pairs, [100, 300, 500, 1000]), bank)
    shown = lambda df: sorted((r.query_id, r.idx, r["rank"], r.gt_filtered, r.candidates, round(r.utility, 9)) for r in df.collect())
    assert shown(got) == shown(want) and got.count() > 300
    assert routes.grid(lists.limit(0), meta, queries, intents, bank).count() == 0


def test_metadata_of_videos_takes_no_shuffle_of_all_orders(spark, tmp_path):
    spark.createDataFrame([(i, i % 3, [1.0, float(i)]) for i in range(100)], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    orders = spark.range(50_000).selectExpr("id AS o_orderkey", "current_date() AS o_orderdate", "'F' AS o_orderstatus", "'1' AS o_orderpriority")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.sparkContext.setJobGroup("facts", "facts")
    it, md = routing._facts(spark, str(tmp_path))
    spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext._jsc.sc().statusStore()
    written = [tracker.lastStageAttempt(s).shuffleWriteRecords() for j in spark.sparkContext.statusTracker().getJobIdsForGroup("facts") for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    assert md.count() == 10 and it.count() == 5 and max(written) < 5_000
