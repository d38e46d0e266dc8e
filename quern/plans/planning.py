"""Queries of sampling plans, segment measures and joins in time, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import sampling, scans, spans
from quern.plans.catalogue import _SERIES, _series, query
from quern.sources.tables import table

_TASKS = "SELECT * FROM (VALUES ('highlight', 1.0, 4.0, 20, 30, true, NULL), ('scene', 0.4, 0.0, 10, 0, false, NULL), ('face', 2.0, 5.0, 30, 25, true, NULL), ('face_emb', 0.0, 2.5, 0, 12, false, 'face')) AS t(task_id, sparse_fps, dense_fps, max_sparse, max_dense, can_interest, gated_by)"
_T = f"ts AS (SELECT task_id, sparse_fps::DOUBLE AS sparse_fps, dense_fps::DOUBLE AS dense_fps, max_sparse, max_dense, can_interest, gated_by FROM ({_TASKS})),"
_V = "v AS (SELECT p_partkey AS video_id, (p_size % 50 + 1)::DOUBLE AS duration FROM part),"
#: Folds a video's proposals as the plan does.
_MERGE = """pl AS (SELECT video_id, list({'ts': ts, 'task': task_id} ORDER BY ts, task_id) AS p FROM pr GROUP BY video_id),
st AS (SELECT video_id, list_transform(p, lambda x: {'at': [x.ts], 'tasks': [[x.task]]}) AS p FROM pl),
fo AS (SELECT video_id, list_reduce(p, lambda a, x: CASE WHEN x.at[1] - a.at[len(a.at)] < 0.05 THEN {'at': a.at, 'tasks': list_concat(a.tasks[1:len(a.tasks) - 1], [list_distinct(list_concat(a.tasks[len(a.tasks)], x.tasks[1]))])}
 ELSE {'at': list_concat(a.at, x.at), 'tasks': list_concat(a.tasks, x.tasks)} END) AS f FROM st),
me AS (SELECT video_id, unnest(f.at) AS ts, unnest(f.tasks) AS tasks FROM fo)"""
_PLAN = "SELECT video_id, round(ts, 6) AS ts, array_to_string(list_sort(tasks), ',') AS subscribers, floor(ts * 25)::INT AS frame_idx FROM me"


def _tasks(spark: SparkSession) -> DataFrame:
    t = spark.sql(_TASKS)
    return t.select("task_id", *[F.col(c).cast("double") for c in ("sparse_fps", "dense_fps")], "max_sparse", "max_dense", "can_interest", F.col("gated_by").cast("string").alias("gated_by"))


def _videos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("video_id"), (F.col("p_size") % 50 + 1).cast("double").alias("duration"))


def _shown(plan: DataFrame) -> DataFrame:
    return plan.select("video_id", F.round("ts", 6).alias("ts"), F.array_join("subscribers", ",").alias("subscribers"), "frame_idx")


_SPARSE = f"""WITH {_T} {_V} sp AS (SELECT video_id, task_id, duration, sparse_fps, max_sparse, ceil(duration / (1 / sparse_fps))::INT AS n FROM v, ts WHERE gated_by IS NULL AND sparse_fps > 0),
pr AS (SELECT video_id, task_id, CASE WHEN n > max_sparse THEN i * duration / max_sparse ELSE i * (1 / sparse_fps) END AS ts FROM (SELECT *, unnest(range(0, least(n, max_sparse))) AS i FROM sp)), {_MERGE} """


@query(_SPARSE + _PLAN)
def sparse_plan(spark: SparkSession, d: str) -> DataFrame:
    return _shown(sampling.merged(sampling.sparse_proposals(_videos(spark, d), _tasks(spark))))


_INTERVALS = "iv AS (SELECT p_partkey AS video_id, unnest([{'s': (p_size % 7)::DOUBLE, 'e': (p_size % 7) + 1 + p_partkey % 3 / 2.0::DOUBLE}, {'s': 4.0 + p_size % 5, 'e': 6.5 + p_size % 5}]) AS x FROM part),"


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    p, k = F.col("p_size"), F.col("p_partkey")
    one = F.struct((p % 7).cast("double").alias("start"), (p % 7 + 1 + k % 3 / 2).alias("end"))
    two = F.struct((p % 5 + 4).cast("double").alias("start"), (p % 5 + 6.5).cast("double").alias("end"))
    return table(spark, d, "part").select(k.alias("video_id"), F.explode(F.array(one, two)).alias("x")).select("video_id", "x.*")


@query(f"""WITH {_T} {_INTERVALS} dn AS (SELECT video_id, task_id, max_dense, x.s::DOUBLE AS s, dense_fps, ceil((x.e - x.s)::DOUBLE / (1 / dense_fps))::INT AS n FROM iv, ts WHERE (can_interest OR gated_by IS NOT NULL) AND dense_fps > 0),
ds AS (SELECT DISTINCT video_id, task_id, max_dense, round(s + i * (1 / dense_fps), 3) AS ts FROM (SELECT *, unnest(range(0, n)) AS i FROM dn)),
pr AS (SELECT video_id, task_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY video_id, task_id ORDER BY ts) AS k FROM ds) WHERE k <= max_dense), {_MERGE} """ + _PLAN)
def dense_plan(spark: SparkSession, d: str) -> DataFrame:
    return _shown(sampling.merged(sampling.dense_proposals(_intervals(spark, d), _tasks(spark))))


_MASK = f"""bk AS (SELECT video_id, unnest(range(0, greatest(1, floor(duration * 10)::INT))) AS bucket FROM v), {_INTERVALS}
go AS (SELECT DISTINCT video_id, unnest(range(floor(x.s::DOUBLE * 10)::INT + 1, floor(x.e::DOUBLE * 10)::INT)) AS bucket FROM iv WHERE x.e - x.s >= 2), ba AS (SELECT DISTINCT video_id, floor((x.s + 1.3)::DOUBLE * 10)::INT AS bucket FROM iv),
mk AS (SELECT bk.video_id, bk.bucket, go.bucket IS NULL OR ba.bucket IS NOT NULL AS keep FROM bk LEFT JOIN go ON go.video_id = bk.video_id AND go.bucket = bk.bucket LEFT JOIN ba ON ba.video_id = bk.video_id AND ba.bucket = bk.bucket)"""


def _mask(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Videos, still segments and boundaries."""
    i = _intervals(spark, d)
    return _videos(spark, d), i, i.select("video_id", (F.col("start") + 1.3).alias("ts"))


@query(f"WITH {_V} {_MASK} SELECT video_id, count(*)::BIGINT AS buckets, count_if(keep)::BIGINT AS kept, sum(CASE WHEN keep THEN bucket END)::BIGINT AS places FROM mk GROUP BY video_id")
def static_mask(spark: SparkSession, d: str) -> DataFrame:
    m = sampling.static_mask(*_mask(spark, d))
    return m.groupBy("video_id").agg(F.count("*").alias("buckets"), F.count_if("keep").alias("kept"), F.sum(F.when(F.col("keep"), F.col("bucket"))).alias("places"))


@query(_SPARSE + ", " + _MASK + " SELECT me.video_id, count(*)::BIGINT AS n FROM me LEFT JOIN mk ON mk.video_id = me.video_id AND mk.bucket = floor(ts * 10)::INT WHERE list_contains(tasks, 'scene') OR keep GROUP BY me.video_id")
def masked_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = sampling.merged(sampling.sparse_proposals(_videos(spark, d), _tasks(spark)))
    return sampling.apply_words(plan, sampling.mask_words(*_mask(spark, d)), ["scene"]).groupBy("video_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_T} {_V} f AS (SELECT video_id, duration, task_id, CASE WHEN gated_by IS NOT NULL THEN greatest(dense_fps, 0.5) ELSE greatest(sparse_fps, dense_fps) END AS fps FROM v, ts), i AS (SELECT video_id, sum(ceil(duration / (1 / fps)))::BIGINT AS independent FROM f WHERE fps > 0 GROUP BY video_id)
SELECT video_id, independent, ceil(duration / (1 / (SELECT max(dense_fps) FROM ts)))::INT AS shared FROM i JOIN v USING (video_id)""")
def baseline_plans(spark: SparkSession, d: str) -> DataFrame:
    """Frames that tasks sample for themselves, and on one grid for all."""
    v, t = _videos(spark, d), _tasks(spark)
    own = sampling.independent(v, t).groupBy("video_id").agg(F.sum("n").alias("independent"))
    return own.join(sampling.union_fps(v, t).withColumnRenamed("n", "shared"), "video_id")


@query(_SERIES + ", n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM r), k AS (SELECT DISTINCT user_id, floor(j * (n - 1) / 19.0::DOUBLE)::BIGINT AS i FROM n, range(0, 20) q(j) WHERE n > 20) SELECT n.user_id, round(t, 6) AS t FROM n LEFT JOIN k ON k.user_id = n.user_id AND k.i = n.i WHERE n <= 20 OR k.i IS NOT NULL")
def thinned(spark: SparkSession, d: str) -> DataFrame:
    return sampling.thinned(_series(spark, d), "user_id", "t", 20).select("user_id", F.round("t", 6).alias("t"))


@query(_SERIES + ", l AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY t)) AS d FROM r) SELECT user_id, round(t, 6) AS t FROM l WHERE d IS NULL OR d > 20")
def changed_frames(spark: SparkSession, d: str) -> DataFrame:
    return sampling.changed_frames(_series(spark, d), "user_id", "t", "v", 20).select("user_id", F.round("t", 6).alias("t"))


@query(_SERIES + """, l AS (SELECT *, abs(v - lag(v) OVER w) < 15 AS s, lag(t) OVER w AS f FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t)), g AS (SELECT *, sum((NOT coalesce(s, false))::INT) OVER (PARTITION BY user_id ORDER BY t) AS run FROM l)
SELECT user_id, round(min(f), 5) AS "start", round(max(t), 5) AS "end" FROM g WHERE s GROUP BY user_id, run""")
def static_runs(spark: SparkSession, d: str) -> DataFrame:
    static, _ = sampling.static_runs(_series(spark, d), "user_id", "t", "v", 15, 60)
    return static.select("user_id", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"))


@query(_SERIES + """, p AS (SELECT user_id, list([t] ORDER BY t) AS p FROM r WHERE v >= 50 GROUP BY user_id), f AS (SELECT user_id, list_reduce(p, lambda a, x: CASE WHEN x[1] - a[len(a)] >= 5 THEN list_concat(a, x) ELSE a END) AS k FROM p)
SELECT user_id, round(unnest(k), 6) AS t FROM f""")
def spaced_frames(spark: SparkSession, d: str) -> DataFrame:
    return sampling.spaced(_series(spark, d), "user_id", "t", "v", 50, 5.0).select("user_id", F.round("t", 6).alias("t"))


@query(_SERIES + """, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, t) AS k FROM r WHERE v > 60) SELECT user_id, round(greatest(0, t - 1.5), 6) AS "start", round(t + 1.5, 6) AS "end", v AS score FROM k WHERE k <= 3""")
def interest_intervals(spark: SparkSession, d: str) -> DataFrame:
    i = sampling.interest(_series(spark, d), "user_id", "t", "v", 60, 1.5, 3)
    return i.select("user_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "score")


_NMS_IOU = "greatest(least(y.e, x[1].e) - greatest(y.s, x[1].s), 0) / (greatest(y.e, x[1].e) - least(y.s, x[1].s)) < 0.3"


@query(_SERIES + """, p AS (SELECT user_id, list([{'s': t, 'e': t + 3 + v / 10, 'v': v}] ORDER BY v DESC, t) AS p FROM r GROUP BY user_id),
f AS (SELECT user_id, list_reduce(p, lambda a, x: CASE WHEN len(list_filter(a, lambda y: NOT (""" + _NMS_IOU + """))) = 0 THEN list_concat(a, x) ELSE a END) AS k FROM p), u AS (SELECT user_id, unnest(k) AS k FROM f)
SELECT user_id, round(k.s, 5) AS "start", round(k.e, 5) AS "end", k.v AS score FROM u""")
def suppressed_segments(spark: SparkSession, d: str) -> DataFrame:
    x = _series(spark, d).select("user_id", F.col("t").alias("start"), (F.col("t") + 3 + F.col("v") / 10).alias("end"), F.col("v").alias("score"))
    return scans.suppressed(x, "user_id", 0.3).select("user_id", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"), "score")


#: True segments about clicks, predicted ones about errors.
_SPANS = """WITH e AS (SELECT user_id, event_type, epoch_us(ts) / 3600000000.0 AS t, value AS v FROM events), p AS (SELECT user_id, t - 20 AS s, t + 20 + v AS e, v FROM e WHERE event_type = 'error'), g AS (SELECT user_id, t - 25 AS s, t + 25 AS e FROM e WHERE event_type = 'click'),
x AS (SELECT p.user_id, p.s AS p0, p.e AS p1, p.v, g.s AS g0, g.e AS g1, greatest(least(p.e, g.e) - greatest(p.s, g.s), 0) / (greatest(p.e, g.e) - least(p.s, g.s)) AS iou FROM p JOIN g USING (user_id))
"""


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0)
    p = e.where("event_type = 'error'").select("user_id", (F.col("t") - 20).alias("start"), (F.col("t") + 20 + F.col("value")).alias("end"), F.col("value").alias("score"))
    return p, e.where("event_type = 'click'").select("user_id", (F.col("t") - 25).alias("start"), (F.col("t") + 25).alias("end"))


@query(_SPANS + """, a AS (SELECT user_id, avg(m) AS a FROM (SELECT user_id, p0, p1, v, max(iou) AS m FROM x GROUP BY ALL) GROUP BY user_id),
b AS (SELECT user_id, avg(m) AS b, avg(er) AS er FROM (SELECT user_id, g0, g1, max(iou) AS m, first(abs(p0 - g0) + abs(p1 - g1) ORDER BY iou DESC, p0) AS er FROM x GROUP BY user_id, g0, g1) GROUP BY user_id)
SELECT user_id, round(coalesce((a + b) / 2, 0), 5) AS mean_iou, round(er, 4) AS boundary_mae FROM (SELECT user_id FROM p UNION SELECT user_id FROM g) LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id)""")
def segment_agreement(spark: SparkSession, d: str) -> DataFrame:
    return spans.mean_iou(*_spans(spark, d), "user_id").select("user_id", F.round("mean_iou", 5).alias("mean_iou"), F.round("boundary_mae", 4).alias("boundary_mae"))


@query(_SPANS + """, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, s) AS k FROM p), h AS (SELECT DISTINCT k.user_id FROM k JOIN x ON x.user_id = k.user_id AND x.p0 = k.s AND x.v = k.v WHERE k <= 5 AND iou >= 0.5)
SELECT round(avg((h.user_id IS NOT NULL)::INT), 6) AS recall FROM (SELECT DISTINCT user_id FROM p) u LEFT JOIN h USING (user_id)""")
def recall_at_iou(spark: SparkSession, d: str) -> DataFrame:
    return spans.recall_at(*_spans(spark, d), "user_id", 5, 0.5).select(F.round("recall", 6).alias("recall"))


@query(_SPANS + """, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, s) AS k FROM p), m AS (SELECT k.user_id, k, max(iou) AS iou FROM k JOIN x ON x.user_id = k.user_id AND x.p0 = k.s AND x.v = k.v GROUP BY ALL),
t AS (SELECT m.*, th, sum((iou >= th)::INT) OVER (PARTITION BY user_id, th ORDER BY k) AS tp, (SELECT count(*) FROM g WHERE g.user_id = m.user_id) AS n FROM m, (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS th) q),
r AS (SELECT user_id, th, r / 10.0::DOUBLE AS lv, coalesce(max(CASE WHEN tp / n >= r / 10.0::DOUBLE THEN tp / (k + 1e-9) END), 0) AS pr FROM t, range(0, 11) z(r) GROUP BY ALL) SELECT user_id, th AS threshold, round(sum(pr) / 11, 5) AS ap FROM r GROUP BY ALL""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return spans.average_precision(*_spans(spark, d), "user_id", [0.3, 0.5, 0.7]).withColumn("ap", F.round("ap", 5))


@query(_SPANS + """, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, s) AS k FROM p), m AS (SELECT k.user_id, k, max(iou) AS iou FROM k JOIN x ON x.user_id = k.user_id AND x.p0 = k.s AND x.v = k.v GROUP BY ALL),
t AS (SELECT m.*, th, sum((iou >= th)::INT) OVER (PARTITION BY user_id, th ORDER BY k) AS tp, (SELECT count(*) FROM g WHERE g.user_id = m.user_id) AS n FROM m, (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS th) q),
r AS (SELECT user_id, th, r / 10.0::DOUBLE AS lv, coalesce(max(CASE WHEN tp / n >= r / 10.0::DOUBLE THEN tp / (k + 1e-9) END), 0) AS pr FROM t, range(0, 11) z(r) GROUP BY ALL), f AS (SELECT user_id, th, sum(pr) / 11 AS ap FROM r GROUP BY ALL) SELECT round(avg(ap), 5) AS map, round(avg(CASE WHEN th = 0.5 THEN ap END), 5) AS map_at_half FROM f""")
def mean_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return spans.mean_average_precision(*_spans(spark, d), "user_id").select(F.round("map", 5).alias("map"), F.round("map_at_half", 5).alias("map_at_half"))


def _points(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type") == kind).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0).alias("ts"))


@query("""WITH e AS (SELECT user_id, event_type, round_even(epoch_us(ts) / 3600000000.0 / 6, 0)::BIGINT AS bucket FROM events), a AS (SELECT user_id, bucket, count(*) AS n FROM e WHERE event_type = 'error' GROUP BY ALL), b AS (SELECT user_id, bucket, count(*) AS n FROM e WHERE event_type = 'click' GROUP BY ALL)
SELECT user_id, bucket, a.n AS n_left, b.n AS n_right FROM a JOIN b USING (user_id, bucket)""")
def tolerance_join(spark: SparkSession, d: str) -> DataFrame:
    return spans.tolerance_join(_points(spark, d, "error"), _points(spark, d, "click"), "user_id", 6.0)


@query(_SPANS + " SELECT e.user_id, round(t, 5) AS ts, count(*)::BIGINT AS n FROM e JOIN g ON g.user_id = e.user_id AND t BETWEEN g.s AND g.e WHERE event_type = 'error' GROUP BY ALL")
def points_inside(spark: SparkSession, d: str) -> DataFrame:
    i = spans.inside(_points(spark, d, "error"), _spans(spark, d)[1], "user_id", 24.0)
    return i.groupBy("user_id", F.round("ts", 5).alias("ts")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_suppkey AS k, sqrt((l_discount::DOUBLE * 10) ** 2 + (l_tax::DOUBLE * 10) ** 2) AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
p AS (SELECT 10.0::DOUBLE AS fps, greatest(4, floor(10.0 * 0.5)::INT) AS win), w AS (SELECT l.k, l.i, l.n, fps, win, var_pop(m.v) AS x FROM l, p JOIN l m ON m.k = l.k AND m.i >= l.i AND m.i < l.i + win WHERE l.n > 1 AND l.i % (win // 2) = 0 AND (l.i < l.n - win OR l.i = 0) GROUP BY ALL),
s AS (SELECT *, x < 0.08 AS still, coalesce(lag(x < 0.08) OVER o, false) AS was FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
e AS (SELECT k, i / fps AS t, still, n / fps + 0.25 AS duration FROM s WHERE still <> was), r AS (SELECT *, lead(t) OVER (PARTITION BY k ORDER BY t) AS stop FROM e)
SELECT k AS l_suppkey, round(t, 5)::DOUBLE AS "start", round(coalesce(stop, duration), 5)::DOUBLE AS "end" FROM r WHERE still""")
def gyro_static(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"), F.sqrt(F.pow(F.col("l_discount").cast("double") * 10, 2) + F.pow(F.col("l_tax").cast("double") * 10, 2)).alias("v"))
    durations = l.groupBy("l_suppkey").agg((F.count("*") / 10 + 0.25).alias("duration"))
    r = spans.variance_runs(l, durations, "l_suppkey", "o", "v", 10.0, 0.08)
    return r.select("l_suppkey", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"))


@query(_SERIES + """, p AS (SELECT user_id, list([t] ORDER BY t) AS p FROM r GROUP BY user_id), f AS (SELECT user_id, list_reduce(p, lambda a, x: CASE WHEN x[1] - a[len(a)] >= 5 THEN list_concat(a, x) ELSE a END) AS a FROM p)
SELECT user_id, len(a)::INT AS n, round(list_sum(a), 3) AS total FROM f""")
def anchored_merge(spark: SparkSession, d: str) -> DataFrame:
    a = scans.anchors(_series(spark, d), "user_id", "t", 5.0)
    return a.groupBy("user_id").agg(F.count("*").cast("int").alias("n"), F.round(F.sum("t"), 3).alias("total"))
