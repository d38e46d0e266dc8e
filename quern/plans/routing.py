"""Queries of hybrid search, routes and planners, and the SQL that gives the same rows."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.vectors import l2_normalise
from quern.operators import hybrid, metadata, planners, routes, search
from quern.operators.scans import _cut as cut
from quern.plans.catalogue import _FRAMES, query
from quern.sources.tables import frames, table

#: Metadata of the embeddings' videos, taken from orders; intents of queries from the metadata of the right video.
_VIDEO = """, md AS (SELECT v.video_id, CASE WHEN o_orderkey % 7 <> 0 THEN epoch(o_orderdate::TIMESTAMP) END AS created, CASE o_orderstatus WHEN 'F' THEN 'urban' WHEN 'O' THEN 'coast' END AS geo,
 CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderpriority < '3' THEN 'walking' ELSE 'vehicle' END END AS motion, (o_orderkey % 4) / 4.0::DOUBLE AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN 'GoPro 9' ELSE 'iPhone 12' END AS device
 FROM (SELECT DISTINCT video_id FROM un) v LEFT JOIN orders ON o_orderkey = v.video_id),
it AS (SELECT q.query_id, q.own, CASE WHEN own % 4 = 0 THEN created - 1209600 END AS t0, CASE WHEN own % 4 = 0 THEN created + 1209600 END AS t1, CASE WHEN own % 3 = 0 THEN geo END AS qg, CASE WHEN own % 5 <> 1 THEN motion END AS qm,
 CASE WHEN own % 7 = 0 THEN lower(device[1:5]) END AS qd FROM qs q JOIN md ON md.video_id = q.own),
ax AS (SELECT it.query_id, it.own, md.video_id, t0 IS NOT NULL AS h_t, qg IS NOT NULL AS h_g, qm IS NOT NULL AS h_m, qd IS NOT NULL AS h_d,
 t0 IS NULL OR created IS NULL OR created BETWEEN t0 - 3600 AND t1 + 3600 AS p_t, qg IS NULL OR geo IS NULL OR qg = geo AS p_g, qm IS NULL OR motion IS NULL OR qm = motion AS p_m, qd IS NULL OR device IS NULL OR contains(lower(device), qd) AS p_d,
 CASE WHEN created IS NULL THEN 0.5 WHEN abs(created - (t0 + t1) / 2) <= (t1 - t0) / 2 THEN 1 WHEN abs(created - (t0 + t1) / 2) >= t1 - t0 THEN 0 ELSE 1 - (abs(created - (t0 + t1) / 2) - (t1 - t0) / 2) / ((t1 - t0) / 2) END AS s_t,
 CASE WHEN geo IS NULL THEN 0.5 ELSE (qg = geo)::INT END AS s_g, CASE WHEN motion IS NULL THEN 0.5 WHEN qm = motion THEN CASE WHEN confidence = 0 THEN 1 ELSE confidence END ELSE 0 END AS s_m, CASE WHEN device IS NULL THEN 0.5 ELSE contains(lower(device), qd)::INT END AS s_d FROM it, md)
"""
_SOFT = "CASE WHEN {n} > 1 THEN pow({p}, 1.0::DOUBLE / {n}) ELSE {p} END"


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A short row for each query (its intent and own), and one for each video (its metadata); names of devices are lowered."""
    f = frames(spark, d)
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    orders = o.select(
        k, F.when(k % 7 != 0, F.col("o_orderdate").cast("timestamp").cast("double")).alias("created"), F.when(F.col("o_orderstatus") == "F", "urban").when(F.col("o_orderstatus") == "O", "coast").alias("geo"),
        F.when(k % 5 != 0, F.when(F.col("o_orderpriority") < "3", "walking").otherwise("vehicle")).alias("motion"), (k % 4 / 4).alias("confidence"), F.when(k % 3 == 0, "GoPro 9").otherwise("iPhone 12").alias("device"),
    )
    videos = f.select("video_id").distinct()
    # Videos' ids go to the orders, so that only their own are shuffled.
    orders = orders.join(F.broadcast(videos), videos["video_id"] == k, "left_semi")
    # A video without metadata has the values that the last branch of each CASE gives in SQL.
    md = cut(videos.join(orders, videos["video_id"] == k, "left").withColumn("device", F.coalesce("device", F.lit("iPhone 12"))).drop("o_orderkey"))
    own = F.col("own")
    it = search.query_set(f).select("query_id", F.col("video_id").alias("own")).join(F.broadcast(md.withColumnRenamed("video_id", "own")), "own")
    it = it.select(
        "query_id", "own", F.when(own % 4 == 0, F.col("created") - 1209600).alias("t_start"), F.when(own % 4 == 0, F.col("created") + 1209600).alias("t_end"),
        F.when((own % 3 == 0) & F.col("geo").isNotNull(), F.array("geo")).otherwise(F.array().cast("array<string>")).alias("q_geo"), F.when((own % 5 != 1) & F.col("motion").isNotNull(), F.array("motion")).otherwise(F.array().cast("array<string>")).alias("q_motion"),
        F.when(own % 7 == 0, F.lower(F.substring("device", 1, 5))).alias("q_device"),
    )
    return cut(it.withColumn("q_device", F.lower("q_device"))), md.withColumn("device", F.lower("device"))


def _axes(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    """pairs (query_id, video_id) with own and, for each axis, has_, pass_ and soft_."""
    it, md = _facts(spark, d)
    rows = pairs.join(F.broadcast(it), "query_id").join(F.broadcast(md), "video_id")
    as_is = lambda c: c
    for a in metadata.AXES:
        rows = rows.withColumn(f"has_{a}", metadata.constrained(a))
    made = {f"pass_{a}": metadata.axis_pass(a, False, lower=as_is) for a in metadata.AXES} | {f"soft_{a}": metadata.axis_score(a, lower=as_is) for a in metadata.AXES}
    rows = rows.withColumns(made)
    every = lambda of, join: functools.reduce(join, [F.col(f"{of}_{a}") for a in metadata.AXES])
    n = sum((F.col(f"has_{a}").cast("int") for a in metadata.AXES), F.lit(0))
    product = functools.reduce(lambda x, a: x * F.when(F.col(f"has_{a}"), F.col(f"soft_{a}")).otherwise(1.0), metadata.AXES, F.lit(1.0))
    return rows.withColumns({"passed": every("pass", operator.and_), "soft": F.when(n > 1, F.pow(product, 1 / n)).otherwise(product), "constrained": every("has", operator.or_)})


_ALL = "(h_t::INT + h_g::INT + h_m::INT + h_d::INT)"
_PRODUCT = "((CASE WHEN h_t THEN s_t ELSE 1 END) * (CASE WHEN h_g THEN s_g ELSE 1 END) * (CASE WHEN h_m THEN s_m ELSE 1 END) * (CASE WHEN h_d THEN s_d ELSE 1 END))::DOUBLE"
_HYBRID = _FRAMES + _VIDEO + f""", hx AS (SELECT ou.query_id, ou.video_id, out AS semantic, p_t AND p_g AND p_m AND p_d AS ok, {_ALL} AS n, {_SOFT.format(n=_ALL, p=_PRODUCT)} AS soft FROM ou JOIN ax USING (query_id, video_id)),
he AS (SELECT *, CASE WHEN {{inside}} THEN exp((semantic - max(CASE WHEN {{inside}} THEN semantic END) OVER (PARTITION BY video_id)) / 0.4) END AS e FROM hx),
hs AS (SELECT *, e / (sum(e) OVER (PARTITION BY video_id) + 1e-12) AS s FROM he), hf AS (SELECT *, CASE WHEN {{passed}} THEN {{score}} ELSE -1e9 END::DOUBLE AS f FROM hs),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, video_id) - 1 AS rank FROM hf),
hm AS (SELECT query_id, max(CASE WHEN rank = 0 THEN f END) - coalesce(max(CASE WHEN rank = 1 THEN f END), 0) AS margin FROM hr GROUP BY query_id)
SELECT query_id, video_id, rank::INT AS rank, round(f, 5) AS out, round(semantic, 4) AS semantic, round(margin, 5) AS margin, {{passed}} AS passed FROM hr JOIN hm USING (query_id) WHERE rank < 10"""


def _hybrid(spark: SparkSession, d: str, alpha: float, **switches) -> DataFrame:
    f = frames(spark, d)
    it, md = _facts(spark, d)
    r = hybrid.hybrid_search(search.proto_lists(search.prototypes(f), (2, 4, 6)), md, search.query_set(f), it, 10, 0.4, alpha, **switches)
    return r.select("query_id", "video_id", "rank", F.round("out", 5).alias("out"), F.round("semantic", 4).alias("semantic"), F.round("margin", 5).alias("margin"), "passed")


@query(_HYBRID.format(score="s", inside="ok", passed="ok"))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Search under the hard filter, with the softmax over what passes."""
    return _hybrid(spark, d, 1.0)


@query(_HYBRID.format(score="CASE WHEN n > 0 THEN 0.6 * s + 0.4 * soft ELSE s END", inside="ok", passed="ok"))
def hybrid_fused(spark: SparkSession, d: str) -> DataFrame:
    """The same with soft metadata scores blended in."""
    return _hybrid(spark, d, 0.6)


@query(_HYBRID.format(score="s", inside="true", passed="ok"))
def hybrid_softmax_before(spark: SparkSession, d: str) -> DataFrame:
    """Search under the hard filter, with the softmax over all videos before it."""
    return _hybrid(spark, d, 1.0, softmax_after=False)


@query(_HYBRID.format(score="CASE WHEN n > 0 THEN 0.6 * s + 0.4 * soft ELSE s END", inside="true", passed="true"))
def hybrid_without_filter(spark: SparkSession, d: str) -> DataFrame:
    """Soft metadata scores alone: nothing is shut out."""
    return _hybrid(spark, d, 0.6, hard=False)


#: Two sets of queries: those of the batch give the context, those beside them are searched.
_TWO = _FRAMES.replace("vec_id % 20 = 0", "vec_id % 10 = 0")
_SINGLE = """si AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, video_id) <= 20 AS inn, (base - mu) / sd AS nnn FROM sb),
sf AS (SELECT *, 0.5 * (nnn - avg(CASE WHEN inn THEN nnn END) OVER w) / (stddev_pop(CASE WHEN inn THEN nnn END) OVER w + 1e-8) + 0.5 * (qamp - avg(CASE WHEN inn THEN qamp END) OVER w) / (stddev_pop(CASE WHEN inn THEN qamp END) OVER w + 1e-8) AS fu FROM si WINDOW w AS (PARTITION BY query_id)),
ss AS (SELECT *, CASE WHEN inn THEN fu - min(CASE WHEN inn THEN fu END) OVER w + coalesce(max(CASE WHEN NOT inn THEN base END) OVER w, 0) + 1e-6 ELSE base END AS sco FROM sf WINDOW w AS (PARTITION BY query_id)),
se AS (SELECT *, exp((sco - max(sco) OVER w) / 0.4) AS ex FROM ss WINDOW w AS (PARTITION BY query_id)), st AS (SELECT *, ex / (sum(ex) OVER (PARTITION BY query_id) + 1e-9) AS f FROM se),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, video_id) - 1 AS rank FROM st), sg AS (SELECT query_id, max(CASE WHEN rank = 0 THEN f END) - max(CASE WHEN rank = 1 THEN f END) AS margin FROM sr GROUP BY query_id)
SELECT query_id, video_id, rank::INT AS rank, round(f, 5) AS score, round(margin, 5) AS margin FROM sr JOIN sg USING (query_id) WHERE rank < 5"""


def _beside(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = frames(spark, d)
    other = f.where("vec_id % 20 = 10").select(F.col("vec_id").alias("query_id"), "video_id", l2_normalise(F.col("emb")).alias("emb"))
    return search.prototypes(f), search.query_set(f), other


def _five(found: DataFrame) -> DataFrame:
    return found.select("query_id", "video_id", "rank", F.round("score", 5).alias("score"), F.round("margin", 5).alias("margin"))


@query(_TWO + ", cx AS (SELECT video_id, avg(base) AS mu, stddev_pop(base) + 1e-8 AS sd FROM bq WHERE query_id % 20 = 0 GROUP BY video_id), sb AS (SELECT query_id, video_id, base, qamp, mu, sd FROM bq JOIN cx USING (video_id) WHERE query_id % 20 = 10), " + _SINGLE)
def single_search(spark: SparkSession, d: str) -> DataFrame:
    """Each query for itself, against the kept context of two halves of the earlier queries."""
    protos, earlier, now = _beside(spark, d)
    halves = [search.moments(search.base_scores(protos, earlier.where(f"query_id % 40 = {r}"))) for r in (0, 20)]
    return _five(search.single_search(protos, now, 5, search.added_moments(*halves), tau=0.1, top=20))


@query(_TWO + """, me AS (SELECT video_id, p, avg(x) AS x FROM (SELECT video_id, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM pr WHERE k = 6) GROUP BY ALL), mn AS (SELECT video_id, list(x ORDER BY p) AS m FROM me GROUP BY video_id),
sb AS (SELECT b.query_id, b.video_id, base, qamp, list_dot_product(q, m) AS mu, stddev_pop(base) OVER (PARTITION BY b.query_id) + 1e-8 AS sd FROM bq b JOIN mn USING (video_id) JOIN qs ON qs.query_id = b.query_id WHERE b.query_id % 20 = 10), """ + _SINGLE)
def single_search_alone(spark: SparkSession, d: str) -> DataFrame:
    """Each query for itself, without a context."""
    protos, _, now = _beside(spark, d)
    return _five(search.single_search(protos, now, 5, tau=0.1, top=20))


@query(_FRAMES + """, x AS (SELECT query_id, video_id, base, qamp, min(base) OVER w AS lo, max(base) OVER w AS hi, min(qamp) OVER w AS l2, max(qamp) OVER w AS h2 FROM bq WINDOW w AS (PARTITION BY query_id))
SELECT query_id, video_id, round(0.5 * (CASE WHEN hi > lo THEN (base - lo) / (hi - lo) ELSE base END) + 0.5 * qamp, 6) AS fused, round(CASE WHEN h2 > l2 THEN (qamp - l2) / (h2 - l2) ELSE 0.5 END, 6) AS scaled FROM x""")
def fused_scores(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    s = search.qamp_scores(search.prototypes(f), search.query_set(f))
    s = search.with_ends(s, ["base", "qamp"])
    part = lambda c, same: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(same)
    fused, scaled = 0.5 * part("base", F.col("base")) + 0.5 * F.col("qamp"), part("qamp", F.lit(0.5))
    return s.select("query_id", "video_id", F.round(fused, 6).alias("fused"), F.round(scaled, 6).alias("scaled"))


_BANK = "rt AS (SELECT * FROM (VALUES " + ", ".join(
    f"({k}, '{name}', {hard}::VARCHAR[], {soft}::VARCHAR[], {top}, '{mode}', {routes.COST[tier]}::DOUBLE)" for k, (name, hard, soft, top, mode, tier, _) in enumerate(routes.BANK)
) + ") t(idx, route_id, hard, soft, topm, mode, cost))"


def _on(side: str, axis: str) -> str:
    return f"list_contains({side}, '{axis}')"


_N = " + ".join(f"({_on('soft', a)} AND h_{a[0]})::INT" for a in metadata.AXES)
_P = "(" + " * ".join(f"(CASE WHEN {_on('soft', a)} AND h_{a[0]} THEN s_{a[0]} ELSE 1 END)" for a in metadata.AXES) + ")::DOUBLE"
_IN = " AND ".join(f"(NOT {_on('hard', a)} OR p_{a[0]})" for a in metadata.AXES)
_GRID = _FRAMES + _VIDEO + f""", {_BANK}, g0 AS (SELECT query_id, video_id, base, qamp, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, video_id) AS place FROM bq),
g1 AS (SELECT g0.*, rt.*, place <= topm AS inn FROM g0, rt),
g2 AS (SELECT *, 0.7 * (qamp - avg(CASE WHEN inn THEN qamp END) OVER w) / (stddev_pop(CASE WHEN inn THEN qamp END) OVER w + 1e-8) AS fu FROM g1 WINDOW w AS (PARTITION BY query_id, route_id)),
g3 AS (SELECT *, CASE WHEN inn THEN fu - min(CASE WHEN inn THEN fu END) OVER w + coalesce(-max(CASE WHEN NOT inn THEN base END) OVER w, 0) + 1e-6 ELSE base END AS sem FROM g2 WINDOW w AS (PARTITION BY query_id, route_id)),
g4 AS (SELECT g3.*, ax.* EXCLUDE (query_id, video_id), ({_IN}) AS ok FROM g3 JOIN ax USING (query_id, video_id)),
g5 AS (SELECT *, count_if(ok) OVER w AS cand, CASE WHEN ok THEN exp((sem - max(CASE WHEN ok THEN sem END) OVER w) / 0.4) END AS e FROM g4 WINDOW w AS (PARTITION BY query_id, route_id)),
g6 AS (SELECT *, CASE WHEN mode = 'col_softmax_post_filter' AND cand > 1 THEN e / (sum(e) OVER w + 1e-12) WHEN ok THEN sem END AS v, {_N} AS n, {_P} AS p FROM g5 WINDOW w AS (PARTITION BY query_id, route_id)),
g7 AS (SELECT *, round(CASE WHEN len(soft) > 0 AND v IS NOT NULL THEN 0.8 * (CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0.5 END) + 0.2 * ({_SOFT.format(n='n', p='p')}) ELSE v END, 9) AS f FROM g6 WINDOW w AS (PARTITION BY query_id, route_id)),
g8 AS (SELECT *, row_number() OVER (PARTITION BY query_id, route_id ORDER BY f DESC NULLS LAST, video_id) - 1 AS pos FROM g7),
gr AS (SELECT query_id, route_id, idx, CASE WHEN ok THEN pos ELSE -1 END AS rank, NOT ok AS gt_filtered, cand, cost, CASE WHEN NOT ok THEN -2 ELSE 1 / (pos + 1) + 0.5 * (pos < 1)::INT + 0.1 * (pos < 5)::INT - 0.05 * cost END AS utility FROM g8 WHERE own = video_id),
ob AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(utility, 9) DESC, idx) AS k FROM gr) WHERE k = 1)
"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    it, md = _facts(spark, d)
    return routes.grid(search.proto_lists(search.prototypes(f), (2, 4, 6)), md, search.query_set(f), it, routes.bank(spark))


@query(_GRID + "SELECT query_id, route_id, rank::INT AS rank, gt_filtered, cand::BIGINT AS candidates, round(utility, 6)::DOUBLE AS utility FROM gr")
def route_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every query by every route of the bank."""
    return _grid(spark, d).select("query_id", "route_id", "rank", "gt_filtered", "candidates", F.round("utility", 6).alias("utility"))


@query(_GRID + "SELECT query_id, route_id, rank::INT AS rank, round(utility, 6)::DOUBLE AS utility FROM ob")
def oracle_route(spark: SparkSession, d: str) -> DataFrame:
    best = routes.best_route(_grid(spark, d).withColumn("utility", F.round("utility", 9)))
    return best.select("query_id", "route_id", "rank", F.round("utility", 6).alias("utility"))


@query(_GRID + """SELECT route_id, count(*)::BIGINT AS n, round(avg((rank = 0)::INT), 6) AS r1, round(avg((rank >= 0 AND rank < 5)::INT), 6) AS r5, round(avg((rank >= 0 AND rank < 10)::INT), 6) AS r10, round(avg(CASE WHEN rank >= 0 THEN 1 / (rank + 1) END), 6) AS mrr,
round(avg(CASE WHEN rank >= 0 THEN rank ELSE 1001 END) + 1, 6) AS mean_rank_global, round(avg(CASE WHEN rank >= 0 THEN rank + 1 END), 6) AS mean_rank_survived, round(avg(gt_filtered::INT), 6) AS gt_filtered_rate, round(avg(cost), 6) AS avg_cost FROM gr GROUP BY route_id""")
def route_report(spark: SparkSession, d: str) -> DataFrame:
    r = routes.report(_grid(spark, d), ["route_id"])
    return r.select("route_id", "n", *[F.round(c, 6).alias(c) for c in r.columns[2:]])


@query(_GRID + """SELECT round(avg((o.rank = 0)::INT), 6) AS oracle_r1, round(avg((m.rank = 0)::INT), 6) AS method_r1, round(avg((o.rank = 0)::INT) - avg((m.rank = 0)::INT), 6) AS gap_r1,
round(avg(CASE WHEN o.rank >= 0 THEN 1 / (o.rank + 1) END) - avg(CASE WHEN m.rank >= 0 THEN 1 / (m.rank + 1) END), 6) AS gap_mrr FROM ob o JOIN gr m ON m.query_id = o.query_id AND m.route_id = 'R00_semantic_only_top500'""")
def oracle_gap(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d).withColumn("utility", F.round("utility", 9))
    gap = routes.oracle_gap(g.where("route_id = 'R00_semantic_only_top500'"), routes.best_route(g))
    return gap.select(*[F.round(c, 6).alias(c) for c in gap.columns])


@query(_FRAMES + _VIDEO + "SELECT query_id, p_t AS time, p_g AS geo, p_m AS motion, p_d AS device FROM ax WHERE own = video_id")
def axis_survival(spark: SparkSession, d: str) -> DataFrame:
    """Whether the right video passes each axis for itself; unconstrained axes do."""
    f = frames(spark, d)
    own = search.query_set(f).select("query_id", "video_id")
    return _axes(spark, d, own).select("query_id", *[F.col(f"pass_{a}").alias(a) for a in metadata.AXES])


_TAU = {"time": 0.52, "geo": 0.45, "motion": 0.55, "device": None}
_PLAN = f"WITH {_BANK}, e AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: (x::DOUBLE + 1) / 2) AS p FROM embeddings),\n"


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("query_id"), *[((F.col("embedding")[k].cast("double") + 1) / 2).alias(f"p_{a}") for k, a in enumerate(metadata.AXES)])


@query(_PLAN + "z AS (SELECT query_id, " + ", ".join(f"CASE WHEN p[{k}] >= {t}::DOUBLE THEN 'hard_safe' WHEN p[{k}] >= {t}::DOUBLE * 0.6::DOUBLE THEN 'soft_uncertain' ELSE 'unsafe' END AS {a}" for k, (a, t) in enumerate(_TAU.items(), 1) if t) + ", 'unsafe' AS device FROM e) SELECT * FROM z")
def planner_zones(spark: SparkSession, d: str) -> DataFrame:
    return _probabilities(spark, d).select("query_id", *[routes.zone(F.col(f"p_{a}"), t or 1.0, enabled=t is not None).alias(a) for a, t in _TAU.items()])


@query(_PLAN + "v AS (SELECT e.query_id, rt.*, ((query_id * 7 + idx * 13) % 101) / 101.0::DOUBLE AS value, " + " AND ".join(f"(NOT {_on('hard', a)} OR {f'p[{k}] >= {t}::DOUBLE' if t else 'false'})" for k, (a, t) in enumerate(_TAU.items(), 1)) + """ AS safe FROM e, rt),
s AS (SELECT *, count_if(safe) OVER (PARTITION BY query_id) AS n_safe FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n_safe > 0 THEN safe ELSE len(soft) + len(hard) = 0 END DESC, CASE WHEN n_safe > 0 THEN value END DESC, idx) AS k FROM s)
SELECT query_id, route_id, round(value, 6) AS value, n_safe::BIGINT AS n_safe, n_safe = 0 AS used_fallback FROM r WHERE k = 1""")
def planner_choice(spark: SparkSession, d: str) -> DataFrame:
    """The calibrated planner over given route values."""
    bank = routes.bank(spark)
    # A stated bank of 30 routes.
    v = _probabilities(spark, d).crossJoin(F.broadcast(bank)).withColumn("value", (F.col("query_id") * 7 + F.col("idx") * 13) % 101 / 101)
    kept = routes.calibrated_choice(v, _TAU)
    return kept.select("query_id", "route_id", F.round("value", 6).alias("value"), "n_safe", "used_fallback")


@query(f"WITH {_BANK}, t AS (SELECT o_orderkey, (['low', 'medium', 'high', 'full', 'none'])[o_orderkey % 5 + 1] AS budget_tier FROM orders), c AS (SELECT CASE cost WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 4 THEN 'high' ELSE 'full' END AS budget_tier, count(*)::BIGINT AS n, count_if(len(hard) > 0)::BIGINT AS hard, count_if(len(soft) > 0)::BIGINT AS soft, max(cost) AS cost FROM rt GROUP BY cost) SELECT o_orderkey, t.budget_tier, n, hard, soft, cost FROM t LEFT JOIN c ON c.budget_tier = t.budget_tier")
def route_bank(spark: SparkSession, d: str) -> DataFrame:
    """The routes that the budget tier of each order allows."""
    tiers = F.array(*[F.lit(t) for t in (*routes.COST, "none")])
    orders = table(spark, d, "orders").select("o_orderkey", F.element_at(tiers, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("budget_tier"))
    return orders.join(F.broadcast(routes.summary(routes.bank(spark))), "budget_tier", "left").select("o_orderkey", "budget_tier", "n", "hard", "soft", "cost")


#: The bank, and a soft route for each set of axes beside it.
_SETS = [[a for j, a in enumerate(metadata.AXES) if k >> j & 1] for k in range(1, 16)]
_WIDER = _BANK.replace(") t(idx", ", " + ", ".join(f"(30, 'dynamic_soft_{'_'.join(sorted(x))}', []::VARCHAR[], {x}::VARCHAR[], 500, 'nnn_qamp', {2.0 if len(x) > 1 else 1.0}::DOUBLE)" for x in _SETS) + ") t(idx")
_ALLOWED = lambda axes, zones: " AND ".join(f"(NOT {_on(axes, a)} OR z_{a} IN ({zones}))" for a in metadata.AXES)
_ZONED = _GRID.replace(_BANK, _WIDER) + ", e AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: (x::DOUBLE + 1) / 2) AS p FROM embeddings WHERE vec_id % 20 = 0), zo AS (SELECT query_id, " + ", ".join(f"CASE WHEN p[{k}] >= {t}::DOUBLE THEN 'hard_safe' WHEN p[{k}] >= {t}::DOUBLE * 0.6::DOUBLE THEN 'soft_uncertain' ELSE 'unsafe' END AS z_{a}" if t else f"'unsafe' AS z_{a}" for k, (a, t) in enumerate(_TAU.items(), 1)) + """ FROM e),
pv AS (SELECT zo.*, rt.*, ((query_id * 7 + idx * 13) % 101) / 101.0::DOUBLE AS value FROM zo, rt WHERE idx < 30), pt AS (SELECT *, CASE WHEN len(hard) + len(soft) = 0 THEN 'semantic' WHEN """ + _ALLOWED("hard", "'hard_safe'") + " AND " + _ALLOWED("soft", "'hard_safe', 'soft_uncertain'") + """ THEN 'hard' END AS tier FROM pv),
pa AS (SELECT query_id, count_if(tier = 'hard') AS n_hard, avg(value) FILTER (tier = 'semantic') * 1.05::DOUBLE AS own, any_value(list_filter([""" + ", ".join(f"CASE WHEN z_{a} = 'soft_uncertain' THEN '{a}' END" for a in metadata.AXES) + """], lambda x: x IS NOT NULL)) AS doubt FROM pt GROUP BY query_id),
pc AS (SELECT query_id, route_id, idx, value, tier FROM pt WHERE tier IS NOT NULL UNION ALL SELECT query_id, 'dynamic_soft_' || array_to_string(list_sort(doubt), '_'), 30, own, 'soft' FROM pa WHERE len(doubt) > 0),
pp AS (SELECT pc.*, n_hard, (len(doubt) > 0)::INT AS n_soft FROM pc JOIN pa USING (query_id) QUALIFY row_number() OVER (PARTITION BY pc.query_id ORDER BY value DESC, idx) = 1),
pr1 AS (SELECT pp.*, gr.rank, gr.cost FROM pp JOIN gr USING (query_id, route_id))
"""


def _zoned(spark: SparkSession, d: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """The choices of the planner by zones, and the results of each query on the route chosen for it and on those named besides."""
    bank = routes.bank(spark)
    # A stated bank of 30 routes.
    values = _probabilities(spark, d).where("query_id % 20 = 0").crossJoin(F.broadcast(bank)).withColumn("value", (F.col("query_id") * 7 + F.col("idx") * 13) % 101 / 101)
    choices = cut(planners.zoned_choice(values, _TAU))
    wider = planners.with_own_routes(bank, choices)
    # Routes of a query's own have one number in its choices, and each its own in the wider bank.
    chosen = choices.select("query_id", "route_id")
    for name in more:
        chosen = chosen.unionByName(choices.select("query_id", F.lit(name).alias("route_id")))
    chosen = chosen.join(F.broadcast(wider.select("route_id", "idx")), "route_id").select("query_id", "idx")
    f = frames(spark, d)
    it, md = _facts(spark, d)
    return choices, routes.grid(search.proto_lists(search.prototypes(f), (2, 4, 6)), md, search.query_set(f), it, wider, chosen=chosen)


@query(_ZONED + "SELECT query_id, route_id, round(value, 6) AS value, n_hard::BIGINT AS n_hard, n_soft::BIGINT AS n_soft, CASE WHEN tier = 'semantic' AND n_hard = 0 AND n_soft = 0 THEN 'semantic' WHEN tier = 'soft' THEN 'soft' ELSE 'none' END AS fallback_type, rank::INT AS rank FROM pr1")
def zoned_planner(spark: SparkSession, d: str) -> DataFrame:
    """Routes chosen by zones, some of them the query's own, and the ranks under them."""
    choices, results = _zoned(spark, d)
    return choices.join(results.select("query_id", "route_id", "rank"), ["query_id", "route_id"]).select("query_id", "route_id", F.round("value", 6).alias("value"), "n_hard", F.col("n_soft").cast("long").alias("n_soft"), "fallback_type", F.col("rank").cast("int").alias("rank"))


@query(_ZONED + """, ca AS (SELECT a.query_id, a.route_id AS r1, a.rank AS k1, b.route_id AS r2, b.rank AS k2, c.route_id AS r3, c.rank AS k3 FROM pr1 a JOIN gr b ON b.query_id = a.query_id AND b.route_id = 'R16_semantic_top1000_nnn_qamp' JOIN gr c ON c.query_id = a.query_id AND c.route_id = 'R29_full_budget_all_soft_dense_refine'),
cb AS (SELECT *, k2 >= 0 AND k2 < k1 AS up FROM ca), cc AS (SELECT *, CASE WHEN k1 >= 0 AND k1 < 5 THEN 1 WHEN (CASE WHEN up THEN k2 ELSE k1 END) BETWEEN 0 AND 9 THEN 2 ELSE 3 END AS stage FROM cb),
cd AS (SELECT *, CASE stage WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN up THEN 2 ELSE 1 END ELSE CASE WHEN greatest(k1, k2, k3) < 0 THEN 1 WHEN k1 >= 0 AND k1 <= least(CASE WHEN k2 < 0 THEN 9999 ELSE k2 END, CASE WHEN k3 < 0 THEN 9999 ELSE k3 END) THEN 1 WHEN k2 >= 0 AND k2 <= (CASE WHEN k3 < 0 THEN 9999 ELSE k3 END) THEN 2 ELSE 3 END END AS w FROM cc)
SELECT query_id, CASE w WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END AS route_id, (CASE w WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END)::INT AS rank, stage::INT AS stage FROM cd""")
def planner_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The planner by zones, with larger routes for the queries that it fails."""
    choices, results = _zoned(spark, d, planners.LARGE, planners.FULL)
    first = choices.select("query_id", "route_id").join(results, ["query_id", "route_id"])
    return planners.cascade_of(results, first).select("query_id", "route_id", F.col("rank").cast("int").alias("rank"), "stage")


@query(_GRID + """, aq AS (SELECT it.query_id, list_filter([CASE WHEN t0 IS NOT NULL THEN 'time' END, CASE WHEN qg IS NOT NULL THEN 'geo' END, CASE WHEN qm IS NOT NULL THEN 'motion' END, CASE WHEN qd IS NOT NULL THEN 'device' END], lambda x: x IS NOT NULL) AS asked FROM it),
mr AS (SELECT query_id, max(CASE WHEN k = 1 THEN sem END) - max(CASE WHEN k = 2 THEN sem END) AS margin FROM (SELECT query_id, sem, row_number() OVER (PARTITION BY query_id ORDER BY sem DESC, video_id) AS k FROM g3 WHERE idx = 15) GROUP BY query_id),
ma AS (SELECT query_id, route_id, idx, mode, len(hard) AS n, len(hard) = len(asked) AS w FROM aq, rt WHERE len(hard) > 0 AND len(list_filter(hard, lambda x: NOT list_contains(asked, x))) = 0),
b1 AS (SELECT query_id, arg_max(route_id, n * 1000 - idx) AS r FROM ma GROUP BY query_id), b5 AS (SELECT query_id, arg_max(route_id, CASE WHEN w AND mode = 'col_softmax_post_filter' THEN 1000000 ELSE 0 END + n * 1000 - idx) AS r FROM ma GROUP BY query_id),
ch AS (SELECT query_id, 'semantic' AS baseline, 'R00_semantic_only_top500' AS route_id FROM aq UNION ALL SELECT query_id, 'rules', coalesce(r, 'R00_semantic_only_top500') FROM aq LEFT JOIN b1 USING (query_id) UNION ALL SELECT query_id, 'all_hard', coalesce(r, 'R00_semantic_only_top500') FROM aq LEFT JOIN b5 USING (query_id)
 UNION ALL SELECT query_id, 'margin', CASE WHEN margin > 0.08 THEN 'R00_semantic_only_top500' WHEN margin > 0.02 THEN 'R16_semantic_top1000_nnn_qamp' ELSE 'R29_full_budget_all_soft_dense_refine' END FROM mr
 UNION ALL SELECT query_id, 'random', rt.route_id FROM aq JOIN rt ON rt.idx = ('0x' || md5(query_id::VARCHAR)[1:8])::BIGINT % 30),
c8 AS (SELECT a.query_id, len(aq.asked) > 0 AS bound, a.route_id AS r1, a.rank AS k1, ru.route_id AS r2, b.rank AS k2, l.route_id AS r3, l.rank AS k3, a.cost AS o1, b.cost AS o2, l.cost AS o3 FROM gr a JOIN aq USING (query_id) JOIN ch ru ON ru.query_id = a.query_id AND ru.baseline = 'rules' JOIN gr b ON b.query_id = a.query_id AND b.route_id = ru.route_id JOIN gr l ON l.query_id = a.query_id AND l.route_id = 'R16_semantic_top1000_nnn_qamp' WHERE a.route_id = 'R01_semantic_only_top300'),
c9 AS (SELECT *, CASE WHEN k1 < 0 THEN 9999 ELSE k1 END AS a1, CASE WHEN NOT bound THEN 99999 WHEN k2 < 0 THEN 9999 ELSE k2 END AS a2, CASE WHEN k3 < 0 THEN 9999 ELSE k3 END AS a3 FROM c8),
cw AS (SELECT *, CASE WHEN k1 = 0 THEN 1 WHEN bound AND k2 >= 0 AND k2 < k1 THEN 2 WHEN a1 <= a2 AND a1 <= a3 THEN 1 WHEN a2 <= a3 THEN 2 ELSE 3 END AS w FROM c9)
SELECT query_id, baseline, route_id, rank::INT AS rank, cost FROM ch JOIN gr USING (query_id, route_id) UNION ALL SELECT query_id, 'oracle', route_id, rank::INT, cost FROM ob UNION ALL SELECT query_id, 'cascade', CASE w WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END, (CASE w WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END)::INT, CASE w WHEN 1 THEN o1 WHEN 2 THEN o2 ELSE o3 END FROM cw""")
def route_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Seven baselines of routing over the grid of all routes."""
    f, bank = frames(spark, d), routes.bank(spark)
    it, md = _facts(spark, d)
    grid, margins = routes.grid_with_margins(search.proto_lists(search.prototypes(f), (2, 4, 6)), md, search.query_set(f), it, bank, 100)
    asked = cut(it.select("query_id", metadata.fired().alias("asked")).join(margins, "query_id"))
    return planners.baselines(grid.withColumn("utility", F.round("utility", 9)), bank, asked)
