"""Queries over the test tables and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import evaluate, metadata, search, segments
from quern.sources.tables import frames, table

NOW = dt.datetime(2026, 4, 24, 15, tzinfo=dt.timezone.utc)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_R = 6
_FRAMES = """
WITH fr AS (SELECT vec_id, vec_id // 10 AS video_id, vec_id % 10 AS frame_no, vec_id % 10 * 2.0 AS ts, label, list_transform(embedding, lambda x: x::DOUBLE) AS e0 FROM embeddings),
un AS (SELECT *, list_transform(e0, lambda x: x / (sqrt(list_dot_product(e0, e0)) + 1e-9)) AS e FROM fr),
qs AS (SELECT vec_id AS query_id, video_id AS own, e AS q FROM un WHERE vec_id % 20 = 0),
ks AS (SELECT unnest([2, 4, 6]) AS k),
nv AS (SELECT video_id, count(*) AS n FROM un GROUP BY video_id),
sl AS (SELECT video_id, n, k, unnest(range(0, k)) AS slot FROM nv, ks),
rn AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_no) - 1 AS i FROM un),
mem AS (SELECT sl.video_id, sl.k, sl.slot, sl.n, rn.e FROM sl JOIN rn ON rn.video_id = sl.video_id AND
  CASE WHEN n <= k THEN i = slot // ((k + n - 1) // n) ELSE i >= slot * n // k AND i < (slot + 1) * n // k END),
el AS (SELECT video_id, k, slot, n, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM mem),
av AS (SELECT video_id, k, slot, n, p, avg(x) AS x FROM el GROUP BY ALL),
mv AS (SELECT video_id, k, slot, n, list(x ORDER BY p) AS m FROM av GROUP BY ALL),
pr AS (SELECT video_id, k, slot, CASE WHEN n <= k THEN m ELSE list_transform(m, lambda x: x / (sqrt(list_dot_product(m, m)) + 1e-9)) END AS e FROM mv),
sc AS (SELECT query_id, own, video_id, k, slot, list_dot_product(q, e) AS s FROM qs, pr),
pk AS (SELECT query_id, own, video_id, k, max(s) AS best, sum(exp((s - mx) / 0.1) * s) / (sum(exp((s - mx) / 0.1)) + 1e-9) AS pooled
  FROM (SELECT *, max(s) OVER (PARTITION BY query_id, video_id, k) AS mx FROM sc) GROUP BY ALL),
bq AS (SELECT query_id, own, video_id, max(CASE WHEN k = 6 THEN best END) AS base, sum(pooled) / 3 AS qamp FROM pk GROUP BY ALL),
cs AS (SELECT *, (base - avg(base) OVER (PARTITION BY video_id)) / (stddev_pop(base) OVER (PARTITION BY video_id) + 1e-8) AS nnn,
  row_number() OVER (PARTITION BY query_id ORDER BY base DESC, video_id) <= 500 AS inn FROM bq),
zz AS (SELECT *, 0.3 * (nnn - avg(CASE WHEN inn THEN nnn END) OVER w) / (stddev_pop(CASE WHEN inn THEN nnn END) OVER w + 1e-8)
  + 0.7 * (qamp - avg(CASE WHEN inn THEN qamp END) OVER w) / (stddev_pop(CASE WHEN inn THEN qamp END) OVER w + 1e-8) AS fused FROM cs WINDOW w AS (PARTITION BY query_id)),
ou AS (SELECT query_id, own, video_id, base, qamp, CASE WHEN inn THEN fused - min(CASE WHEN inn THEN fused END) OVER w + coalesce(-max(CASE WHEN NOT inn THEN base END) OVER w, 0) + 1e-6 ELSE base END AS out
  FROM zz WINDOW w AS (PARTITION BY query_id)),
so AS (SELECT query_id, own, video_id, base, qamp, out AS raw, exp((out - max(out) OVER v) / 0.4) AS ex FROM ou WINDOW v AS (PARTITION BY video_id)),
sm AS (SELECT query_id, own, video_id, base, qamp, raw, ex / (sum(ex) OVER (PARTITION BY video_id) + 1e-12) AS out FROM so)
"""


@query(_FRAMES + f"SELECT video_id, k::INT AS k, slot::INT AS slot, round(e[1], {_R}) AS x0, round(e[2], {_R}) AS x1, round(list_sum(e), {_R}) AS total FROM pr")
def proto_build(spark: SparkSession, d: str) -> DataFrame:
    p = search.prototypes(frames(spark, d))
    return p.select("video_id", "k", "slot", F.round(F.col("emb")[0], _R).alias("x0"), F.round(F.col("emb")[1], _R).alias("x1"), F.round(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x), _R).alias("total"))


@query(_FRAMES + f"""
, tk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, video_id) - 1 AS rank FROM bq),
mg AS (SELECT query_id, max(CASE WHEN rank = 0 THEN base END) - max(CASE WHEN rank = 1 THEN base END) AS margin FROM tk GROUP BY query_id)
SELECT query_id, video_id, rank::INT AS rank, round(base, {_R}) AS score, round(margin, {_R}) AS margin, CASE WHEN margin >= 0.08 THEN 'easy' WHEN margin >= 0.02 THEN 'medium' ELSE 'hard' END AS difficulty
FROM tk JOIN mg USING (query_id) WHERE rank < 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    base = search.base_scores(search.prototypes(f, (6,)), search.query_set(f))
    top = search.with_margin(search.top_k(base, 5, "base"), "base")
    return top.select("query_id", "video_id", "rank", F.round("base", _R).alias("score"), F.round("margin", _R).alias("margin"), "difficulty")


def _batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = frames(spark, d)
    q = search.query_set(f)
    return search.reranked(search.qamp_scores(search.prototypes(f), q)), q


@query(_FRAMES + "SELECT query_id, video_id, round(base, 5) AS base, round(qamp, 5) AS qamp, round(raw, 4) AS out FROM sm")
def batch_rerank(spark: SparkSession, d: str) -> DataFrame:
    s, _ = _batch(spark, d)
    return s.select("query_id", "video_id", F.round("base", 5).alias("base"), F.round("qamp", 5).alias("qamp"), F.round("out", 4).alias("out"))


@query(_FRAMES + "SELECT query_id, video_id, rank::INT AS rank, round(out, 5) AS out FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY out DESC, video_id) - 1 AS rank FROM sm) WHERE rank < 10")
def batch_search(spark: SparkSession, d: str) -> DataFrame:
    s, _ = _batch(spark, d)
    return search.top_k(search.column_softmax(s), 10).select("query_id", "video_id", "rank", F.round("out", 5).alias("out"))


_METRICS = """count(*)::BIGINT AS n, round(avg((rank >= 0 AND rank < 1)::INT), 6) AS r1, round(avg((rank >= 0 AND rank < 5)::INT), 6) AS r5, round(avg((rank >= 0 AND rank < 10)::INT), 6) AS r10,
round(avg(CASE WHEN rank >= 0 THEN 1 / (rank + 1) END), 6) AS mrr, round(avg(CASE WHEN rank >= 0 THEN rank + 1 ELSE 1001 END), 6) AS mean_rank, round(quantile_cont(CASE WHEN rank >= 0 THEN rank + 1 ELSE 1001 END, 0.5), 6) AS median_rank"""


@query(_FRAMES + f", r AS (SELECT query_id, own, video_id, rank() OVER (PARTITION BY query_id ORDER BY base DESC) - 1 AS rank FROM bq) SELECT {_METRICS} FROM r WHERE own = video_id")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    q = search.query_set(f)
    m = evaluate.retrieval_metrics(evaluate.answer_ranks(search.base_scores(search.prototypes(f, (6,)), q), q, "base"))
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


#: Metadata of videos from orders, and intents from customers' segments.
_META = """
WITH v AS (SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE epoch(o_orderdate::TIMESTAMP) END AS created, CASE o_orderstatus WHEN 'F' THEN 'urban' WHEN 'O' THEN 'coast' ELSE NULL END AS geo,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'walking' ELSE 'vehicle' END END AS motion, (o_orderkey % 4) / 4.0 AS confidence,
  CASE WHEN o_orderkey % 3 = 0 THEN 'GoPro 9' ELSE 'iPhone 12' END AS device FROM orders),
i AS (SELECT * FROM (VALUES (0, 757382400.0, 788918400.0, NULL, NULL, NULL), (1, NULL, NULL, ['urban', 'coast'], ['walking'], NULL), (2, 820454400.0, 825638400.0, ['urban'], NULL, 'gopro'), (3, NULL, NULL, NULL, NULL, NULL)) t(intent_id, t_start, t_end, q_geo, q_motion, q_device))
"""


def _meta(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    v = o.select(
        k.alias("video_id"), F.when(k % 7 != 0, F.col("o_orderdate").cast("timestamp").cast("double")).alias("created"),
        F.when(F.col("o_orderstatus") == "F", "urban").when(F.col("o_orderstatus") == "O", "coast").alias("geo"),
        F.when(k % 5 != 0, F.when(F.col("o_orderpriority").rlike("^[12]"), "walking").otherwise("vehicle")).alias("motion"),
        (k % 4 / 4).alias("confidence"), F.when(k % 3 == 0, "GoPro 9").otherwise("iPhone 12").alias("device"),
    )
    rows = "(0, 757382400.0D, 788918400.0D, null, null, null), (1, null, null, array('urban', 'coast'), array('walking'), null), (2, 820454400.0D, 825638400.0D, array('urban'), null, 'gopro'), (3, null, null, null, null, null)"
    intents = spark.sql(f"SELECT * FROM VALUES {rows} AS t(intent_id, t_start, t_end, q_geo, q_motion, q_device)")
    # Four intents: a stated query set against all videos.
    return v.crossJoin(F.broadcast(intents))


_AXES = """(t_start IS NULL OR coalesce(created BETWEEN t_start - 3600 AND t_end + 3600, {free})) AND (q_geo IS NULL OR coalesce(list_contains(q_geo, geo), {free}))
 AND (q_motion IS NULL OR coalesce(list_contains(q_motion, motion), {free})) AND (q_device IS NULL OR coalesce(contains(lower(device), lower(q_device)), {free}))"""


def _passes(free: str) -> str:
    # list_contains of a null needle is null in one engine and false in the other.
    return _AXES.replace("list_contains(q_geo, geo)", "CASE WHEN geo IS NOT NULL THEN list_contains(q_geo, geo) END").replace("list_contains(q_motion, motion)", "CASE WHEN motion IS NOT NULL THEN list_contains(q_motion, motion) END").format(free=free)


@query(_META + f"SELECT intent_id, count(*)::BIGINT AS n_total, sum(({_passes('true')})::INT)::BIGINT AS lenient, sum(({_passes('false')})::INT)::BIGINT AS strict, any_value(array_to_string(list_filter([CASE WHEN t_start IS NOT NULL THEN 'time' END, CASE WHEN q_geo IS NOT NULL THEN 'geo' END, CASE WHEN q_motion IS NOT NULL THEN 'motion' END, CASE WHEN q_device IS NOT NULL THEN 'device' END], lambda x: x IS NOT NULL), ',')) AS fired FROM v, i GROUP BY intent_id")
def meta_hard_filter(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).withColumns({"a": metadata.hard_pass(False).cast("int"), "b": metadata.hard_pass(True).cast("int"), "f": F.array_join(metadata.fired(), ",")})
    return m.groupBy("intent_id").agg(F.count("*").alias("n_total"), F.sum("a").alias("lenient"), F.sum("b").alias("strict"), F.first("f").alias("fired"))


@query(_META + """, s AS (SELECT video_id, intent_id, t_start, q_geo, q_motion, q_device, (t_start + t_end) / 2 AS c, greatest((t_end - t_start) / 2, 1) AS h, created, geo, motion, device, coalesce(nullif(confidence, 0), 1) AS conf FROM v, i),
x AS (SELECT video_id, intent_id,
 CASE WHEN t_start IS NULL THEN 1 WHEN created IS NULL THEN 0.5 WHEN abs(created - c) <= h THEN 1 WHEN abs(created - c) >= h + greatest(3600, h) THEN 0 ELSE 1 - (abs(created - c) - h) / greatest(3600, h) END
 * CASE WHEN q_geo IS NULL THEN 1 WHEN geo IS NULL THEN 0.5 ELSE list_contains(q_geo, geo)::INT END
 * CASE WHEN q_motion IS NULL THEN 1 WHEN motion IS NULL THEN 0.5 WHEN list_contains(q_motion, motion) THEN conf ELSE 0 END
 * CASE WHEN q_device IS NULL THEN 1 WHEN device IS NULL THEN 0.5 ELSE contains(lower(device), lower(q_device))::INT END AS p,
 (t_start IS NOT NULL)::INT + (q_geo IS NOT NULL)::INT + (q_motion IS NOT NULL)::INT + (q_device IS NOT NULL)::INT AS n FROM s)
SELECT video_id, intent_id, round(CASE WHEN n > 1 THEN pow(p::DOUBLE, 1.0::DOUBLE / n) ELSE p::DOUBLE END, 6) AS score FROM x""")
def meta_soft_score(spark: SparkSession, d: str) -> DataFrame:
    return _meta(spark, d).select("video_id", "intent_id", F.round(metadata.soft_score(), 6).alias("score"))


#: Phrases that texts start with, since the texts themselves hold hardly any keyword.
PHRASES = [
    "clips from today", "what I did yesterday", "this week at home", "Walking on the beach last week", "the weekend trip", "this month at the office", "last month in the mountains", "last year in Paris",
    "this year", "last 10 days by bike", "past 3 days", "videos from 2024", "a running dog", "上周末在海边跑步的视频", "前天在家里", "去年夏天骑行", "最近 5 天 华为", "summer evenings, driving downtown", "winter 2019年",
    "Samsung galaxy clip of a farm", "iPhone, sitting still in a cafe", "the capital driver was scared", "highway traffic 1999/", "no time at all",
]


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(l, '{w}')" for w in words) + ")"


def _phrase(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", F.concat_ws(" ", F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.pmod("conv_id", F.lit(len(PHRASES))) + 1).cast("int")), F.col("text")).alias("text"))


_PHRASED = "WITH t AS (SELECT conv_id, turn, lower(concat_ws(' ', ([" + ", ".join(f"'{p}'" for p in PHRASES) + f"])[conv_id % {len(PHRASES)} + 1], text)) AS l FROM conversations)"


@query(_PHRASED + " SELECT conv_id, turn, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_has(w)} THEN '{n}' END" for n, w in metadata.GEO.items()) + "], lambda x: x IS NOT NULL), ',') AS geo, array_to_string(list_filter(["
       + ", ".join(f"CASE WHEN {_has(w)} THEN '{n}' END" for n, w in metadata.MOTION.items()) + "], lambda x: x IS NOT NULL), ',') AS motion, CASE " + " ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in metadata.DEVICE.items()) + " END AS device FROM t")
def intent_labels(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return _phrase(spark, d).select("conv_id", "turn", F.array_join(metadata.classes(x, metadata.GEO), ",").alias("geo"), F.array_join(metadata.classes(x, metadata.MOTION), ",").alias("motion"), metadata.first_class(x, metadata.DEVICE).alias("device"))


@query(_PHRASED.replace("WITH t AS", "WITH p AS") + r""", n AS (SELECT *, TIMESTAMP '2026-04-24 15:00:00' AS t FROM p),
x AS (SELECT *, date_trunc('day', t) AS d, date_trunc('week', t) AS w, date_trunc('month', t) AS m, date_trunc('year', t) AS y FROM n),
s AS (SELECT conv_id, turn, CASE WHEN regexp_matches(l, '\btoday\b|今天|今日') THEN [d, d + INTERVAL 1 DAY]
 WHEN regexp_matches(l, '\byesterday\b|昨天|昨日') THEN [d - INTERVAL 1 DAY, d] WHEN contains(l, '前天') THEN [d - INTERVAL 2 DAY, d - INTERVAL 1 DAY]
 WHEN regexp_matches(l, '\bthis week\b|本周|这周') THEN [w, w + INTERVAL 7 DAY] WHEN regexp_matches(l, '\blast week\b|上周|上个星期|上星期') THEN [w - INTERVAL 7 DAY, w]
 WHEN regexp_matches(l, '\bthis month\b|本月|这个月') THEN [m, m + INTERVAL 1 MONTH] WHEN regexp_matches(l, '\blast month\b|上月|上个月') THEN [m - INTERVAL 1 MONTH, m]
 WHEN regexp_matches(l, '\bthis year\b|今年') THEN [y, y + INTERVAL 1 YEAR] WHEN regexp_matches(l, '\blast year\b|去年') THEN [y - INTERVAL 1 YEAR, y]
 WHEN regexp_matches(l, '(last|past|最近|过去|这)\s*(\d+)\s*(day|days|天)') THEN [t - regexp_extract(l, '(last|past|最近|过去|这)\s*(\d+)\s*(day|days|天)', 2)::INT * INTERVAL 1 DAY, t]
 WHEN regexp_matches(l, '\bweekend\b|周末|礼拜') THEN [w - INTERVAL 2 DAY + CASE WHEN isodow(t) >= 6 THEN INTERVAL 7 DAY ELSE INTERVAL 0 DAY END, w + CASE WHEN isodow(t) >= 6 THEN INTERVAL 7 DAY ELSE INTERVAL 0 DAY END]
 WHEN regexp_matches(l, 'spring|春天|春季') THEN [y + INTERVAL 2 MONTH, y + INTERVAL 5 MONTH] WHEN regexp_matches(l, 'summer|夏天|夏季') THEN [y + INTERVAL 5 MONTH, y + INTERVAL 8 MONTH]
 WHEN regexp_matches(l, 'autumn|fall|秋天|秋季') THEN [y + INTERVAL 8 MONTH, y + INTERVAL 11 MONTH] WHEN regexp_matches(l, 'winter|冬天|冬季') THEN [y + INTERVAL 11 MONTH, y + INTERVAL 14 MONTH]
 WHEN regexp_matches(l, '(\d{4})\s*(年|/|$)') THEN [make_timestamp(regexp_extract(l, '(\d{4})\s*(年|/|$)', 1)::BIGINT, 1, 1, 0, 0, 0.0), make_timestamp(regexp_extract(l, '(\d{4})\s*(年|/|$)', 1)::BIGINT + 1, 1, 1, 0, 0, 0.0)] END AS r FROM x)
SELECT conv_id, turn, epoch(r[1])::DOUBLE AS t_start, epoch(r[2])::DOUBLE AS t_end FROM s""")
def intent_time_window(spark: SparkSession, d: str) -> DataFrame:
    return _phrase(spark, d).select("conv_id", "turn", metadata.time_window(F.col("text"), NOW).alias("w")).select("conv_id", "turn", "w.t_start", "w.t_end")


#: Scored time series: events of a user, in hours.
_SERIES = "WITH s AS (SELECT user_id, epoch_us(ts) / 3600000000.0 AS t, event_id, value FROM events), r AS (SELECT user_id, t, max(value) AS v FROM s GROUP BY user_id, t)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0
    return e.select("user_id", hours.alias("t"), "value").groupBy("user_id", "t").agg(F.max("value").alias("v"))


@query(_SERIES + """, m AS (SELECT user_id, t, v, CASE WHEN count(*) OVER (PARTITION BY user_id) < 3 THEN sum(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE sum(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END / 3 AS sm FROM r),
c AS (SELECT user_id, quantile_cont(sm, 0.8) AS cut FROM m GROUP BY user_id),
f AS (SELECT m.*, sm >= cut AS hi, sm >= cut AND NOT coalesce(lag(sm >= cut) OVER (PARTITION BY user_id ORDER BY t), false) AS nw FROM m JOIN c USING (user_id)),
g AS (SELECT *, sum(nw::INT) OVER (PARTITION BY user_id ORDER BY t) AS run FROM f),
i AS (SELECT user_id, run, min(t) AS a, max(t) AS b, max(sm) AS score FROM g WHERE hi GROUP BY user_id, run),
h AS (SELECT *, coalesce((a - max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 2)::INT, 1) AS nw FROM i),
k AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS ch FROM h),
l AS (SELECT user_id, ch, min(a) AS a, max(b) AS b, max(score) AS score FROM k GROUP BY user_id, ch HAVING max(b) - min(a) >= 0.3),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, a) AS rank FROM l)
SELECT user_id, round(a, 5) AS "start", round(b, 5) AS "end", round(score, 5) AS score, rank::INT AS rank FROM o WHERE rank <= 5""")
def segments_topk(spark: SparkSession, d: str) -> DataFrame:
    s = segments.segments(_series(spark, d), "user_id", "t", "v", gap=2.0)
    return s.select("user_id", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"), F.round("score", 5).alias("score"), "rank")


@query(_SERIES + """, h AS (SELECT user_id, t AS a, t + v / 100 AS b, v FROM r),
k AS (SELECT *, coalesce((a - max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 1)::INT, 1) AS nw FROM h),
c AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS ch FROM k)
SELECT user_id, round(min(a), 5) AS "start", round(max(b), 5) AS "end", max(v) AS score FROM c GROUP BY user_id, ch""")
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    i = _series(spark, d).select("user_id", F.col("t").alias("start"), (F.col("t") + F.col("v") / 100).alias("end"), F.col("v").alias("score"))
    return segments.chain_merge(i, "user_id", 1.0).select("user_id", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"), "score")


_DURATIONS = "WITH v AS (SELECT p_partkey AS video_id, (p_size % 50 + 1)::DOUBLE AS duration FROM part)"


@query(_DURATIONS + ", n AS (SELECT *, ceil(duration * 2)::INT AS n FROM v) SELECT video_id, i::INT AS i, round(CASE WHEN n > 40 THEN i * duration / 40 ELSE i / 2.0 END, 6) AS ts FROM (SELECT *, unnest(range(0, least(n, 40))) AS i FROM n)")
def uniform_grid(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "part").select(F.col("p_partkey").alias("video_id"), (F.col("p_size") % 50 + 1).cast("double").alias("duration"))
    return segments.uniform_grid(v, 2.0, 40).select("video_id", "i", F.round("ts", 6).alias("ts"))


@query("""WITH e AS (SELECT user_id, event_type, epoch_us(ts) / 1000000.0 AS t FROM events),
a AS (SELECT * FROM e WHERE event_type = 'error'), b AS (SELECT * FROM e WHERE event_type = 'click')
SELECT a.user_id, round(a.t, 3) AS ts, round((SELECT min(abs(a.t - b.t)) FROM b WHERE b.user_id = a.user_id), 3) AS gap FROM a""")
def nearest_in_time(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("ts"))
    out = segments.nearest_gap(e.where("event_type = 'error'"), e.where("event_type = 'click'"), "user_id")
    return out.select("user_id", F.round("ts", 3).alias("ts"), F.round("gap", 3).alias("gap"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY user_id) AS s FROM c)
SELECT user_id, event_type AS dominant, round(n / s, 6) AS share FROM d WHERE k = 1""")
def scene_histogram(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id")
    c = c.withColumns({"k": F.row_number().over(w.orderBy(F.col("n").desc(), "event_type")), "s": F.sum("n").over(w)})
    return c.where("k = 1").select("user_id", F.col("event_type").alias("dominant"), F.round(F.col("n") / F.col("s"), 6).alias("share"))


@query("""WITH e AS (SELECT user_id, event_type, event_id % 2 AS h FROM events),
s AS (SELECT user_id, event_type, h, count(*) AS c FROM e GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY user_id, h) AS p FROM s),
b AS (SELECT coalesce(x.user_id, y.user_id) AS user_id, abs(coalesce(x.p, 0) - coalesce(y.p, 0)) AS d FROM (SELECT * FROM p WHERE h = 0) x FULL JOIN (SELECT * FROM p WHERE h = 1) y ON x.user_id = y.user_id AND x.event_type = y.event_type)
SELECT user_id, round(1 - sum(d) / 2, 6) AS overlap FROM b GROUP BY user_id""")
def tvd_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    o = evaluate.distribution_overlap(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_type")
    return o.select("user_id", F.round("overlap", 6).alias("overlap"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE / 50 AS gyro, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_discount::DOUBLE * 20 END AS acc, l_tax::DOUBLE * 50 AS hz FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN gyro < 0.05 AND (acc IS NULL OR acc < 0.3) THEN 'stationary' WHEN hz >= 2.2 AND hz <= 4 AND acc > 1.5 THEN 'running' WHEN hz >= 1.2 AND hz < 2.2 AND acc > 0.5 THEN 'walking'
 WHEN hz < 1 AND gyro < 0.2 AND acc < 0.5 THEN 'vehicle' WHEN gyro >= 0.05 AND gyro <= 0.5 THEN 'walking' WHEN gyro > 1 THEN 'running' ELSE 'unknown' END AS motion FROM t""")
def motion_class(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    acc = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_discount").cast("double") * 20)
    m = metadata.motion_class(F.col("l_quantity").cast("double") / 50, acc, F.col("l_tax").cast("double") * 50)
    return t.select("l_orderkey", "l_linenumber", m["label"].alias("motion"))


_HALF = "WITH l AS (SELECT vec_id, label, (list_transform(embedding, lambda x: x::DOUBLE)[1] + 1) / 2 AS p, (label % 3 = 0)::INT AS y FROM embeddings)"


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", ((F.col("embedding")[0].cast("double") + 1) / 2).alias("p"), (F.col("label") % 3 == 0).cast("int").alias("y"))


@query(_HALF + " SELECT least(floor(p * 10), 9)::INT AS bin, count(*)::BIGINT AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy FROM l GROUP BY 1")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.reliability(_probabilities(spark, d), "p", "y")
    return r.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(_HALF + """, e AS (SELECT p AS tau, count(*) AS c, sum(y) AS f FROM l GROUP BY p), r AS (SELECT tau, sum(c) OVER w AS n, sum(f) OVER w AS k FROM e WINDOW w AS (ORDER BY tau DESC)),
u AS (SELECT tau, n, k, CASE WHEN k >= n THEN 1 ELSE (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) END AS ucb FROM r WHERE n >= 20)
SELECT round(tau, 6) AS tau, n::BIGINT AS n, k::BIGINT AS k, round(ucb, 6) AS ucb FROM u WHERE ucb <= 0.6 ORDER BY tau LIMIT 1""")
def threshold_calibration(spark: SparkSession, d: str) -> DataFrame:
    t = evaluate.threshold_sweep(_probabilities(spark, d), "p", "y", 20, 0.6)
    return t.select(F.round("tau", 6).alias("tau"), "n", F.col("k").cast("bigint").alias("k"), F.round("ucb", 6).alias("ucb"))


@query(_HALF + ", o AS (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM l) SELECT n::BIGINT AS n, round(p, 6) AS threshold FROM o WHERE i = ceil((n + 1) * 0.9)")
def conformal_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.conformal_threshold(_probabilities(spark, d), "p", 0.1).select("n", F.round("threshold", 6).alias("threshold"))


_LATTICE = """WITH v AS (SELECT vec_id AS query_id, sid, list_sum(list_transform(range(0, 4), lambda j: ((sid >> j) & 1) * embedding[j + 1]::DOUBLE)) - 0.01 * bit_count(sid::INT) * bit_count(sid::INT) AS value FROM embeddings, range(0, 16) t(sid)),
m AS (SELECT a.query_id, a.sid, e AS expert, b.value - a.value AS marginal FROM v a, range(0, 4) t(e), v b WHERE (a.sid >> e) & 1 = 0 AND b.query_id = a.query_id AND b.sid = (a.sid | (1 << e)))"""


def _lattice(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("sid"))
    value = sum((F.when(F.expr(f"shiftright(sid, {j}) & 1 = 1"), F.col("embedding")[j].cast("double")).otherwise(0.0) for j in range(4)), F.lit(0.0))
    return e.select("query_id", "sid", (value - 0.01 * F.bit_count("sid") * F.bit_count("sid")).alias("value"))


@query(_LATTICE + " SELECT query_id, sid::INT AS sid, expert::INT AS expert, round(marginal, 6) AS marginal FROM m")
def expert_marginals(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.marginals(_lattice(spark, d), 4)
    return m.select("query_id", "sid", "expert", F.round("marginal", 6).alias("marginal"))


@query(_LATTICE + " SELECT expert::INT AS expert, count(*)::BIGINT AS n, round(avg(marginal), 6) AS mean, round(stddev_pop(marginal), 6) AS std, round(avg((marginal > 0)::INT), 6) AS positive FROM m GROUP BY expert")
def expert_contribution(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.marginals(_lattice(spark, d), 4)
    return m.groupBy("expert").agg(F.count("*").alias("n"), F.round(F.avg("marginal"), 6).alias("mean"), F.round(F.stddev_pop("marginal"), 6).alias("std"), F.round(F.avg((F.col("marginal") > 0).cast("double")), 6).alias("positive"))


@query("SELECT md5(text) AS hash, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(_FRAMES + """, g AS (SELECT query_id, 0 AS route, 1.0 AS cost, video_id, base AS s, own FROM sm UNION ALL SELECT query_id, 1, 2.0, video_id, qamp, own FROM sm UNION ALL SELECT query_id, 2, 4.0, video_id, round(raw, 9), own FROM sm),
rk AS (SELECT query_id, route, cost, own, video_id, rank() OVER (PARTITION BY query_id, route ORDER BY s DESC) - 1 AS rank FROM g)
SELECT query_id, route, rank::INT AS rank, round(1 / (rank + 1) + 0.5 * (rank < 1)::INT + 0.1 * (rank < 5)::INT - 0.05 * cost, 6)::DOUBLE AS utility FROM rk WHERE own = video_id""")
def route_utilities(spark: SparkSession, d: str) -> DataFrame:
    s, q = _batch(spark, d)
    # One scored table serves all routes: a rank is the number of better videos, which are counted where they are.
    each = {0: (1.0, F.col("base")), 1: (2.0, F.col("qamp")), 2: (4.0, F.round("out", 9))}
    s = s.select("query_id", "video_id", *[v.alias(f"s{k}") for k, (_, v) in each.items()])
    mine = s.join(F.broadcast(q.select("query_id", "video_id")), ["query_id", "video_id"]).select("query_id", *[F.col(f"s{k}").alias(f"o{k}") for k in each])
    better = s.join(F.broadcast(mine), "query_id").groupBy("query_id").agg(*[F.count_if(F.col(f"s{k}") > F.col(f"o{k}")).cast("int").alias(f"r{k}") for k in each])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("route"), F.lit(c).alias("cost"), F.col(f"r{k}").alias("rank")) for k, (c, _) in each.items()]))
    return better.select("query_id", rows.alias("r")).select("query_id", "r.route", "r.rank", F.round(search.utility(F.col("r.rank"), F.lit(False), F.col("r.cost")), 6).alias("utility"))


@query(_HALF + ", b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM l GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.calibration_error(_probabilities(spark, d), "p", "y").select(F.round("ece", 6).alias("ece"))


@query("""WITH l AS (SELECT (list_transform(embedding, lambda x: x::DOUBLE)[1] + 1) / 2 AS p, embedding[2]::DOUBLE AS m FROM embeddings),
e AS (SELECT quantile_cont(m, 0.25) AS a, quantile_cont(m, 0.5) AS b, quantile_cont(m, 0.75) AS c FROM l),
x AS (SELECT p, (m >= a)::INT + (m >= b)::INT + (m >= c)::INT AS bin FROM l, e),
o AS (SELECT bin, p, row_number() OVER (PARTITION BY bin ORDER BY p) AS i, count(*) OVER (PARTITION BY bin) AS n FROM x)
SELECT bin, n::BIGINT AS n, round(min(CASE WHEN i >= ceil((n + 1) * 0.9::DOUBLE) THEN p END), 6) AS threshold FROM o GROUP BY bin, n""")
def conformal_bins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(((F.col("embedding")[0].cast("double") + 1) / 2).alias("p"), F.col("embedding")[1].cast("double").alias("m"))
    return evaluate.binned_thresholds(e, "p", "m", 0.1, 4).select("bin", "n", F.round("threshold", 6).alias("threshold"))


@query("""WITH h AS (SELECT embedding[1] > 0 AS a, embedding[2] > 0 AS b FROM embeddings), n AS (SELECT count_if(a AND NOT b)::BIGINT AS only_a, count_if(b AND NOT a)::BIGINT AS only_b FROM h)
SELECT only_a, only_b, round(CASE WHEN only_a + only_b > 0 THEN pow(abs(only_a - only_b)::DOUBLE - 1, 2) / (only_a + only_b) ELSE 0 END, 6) AS statistic FROM n""")
def discordance(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "embeddings").select((F.col("embedding")[0] > 0).alias("a"), (F.col("embedding")[1] > 0).alias("b"))
    return evaluate.discordance(h, "a", "b").select("only_a", "only_b", F.round("statistic", 6).alias("statistic"))
