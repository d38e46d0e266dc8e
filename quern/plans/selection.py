"""Queries of expert selection, prediction sets and statistics, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.vectors import l2_normalise
from quern.operators import evaluate, experts, gallery, metadata, scans, search
from quern.plans.catalogue import _FRAMES, _LATTICE, _SERIES, _lattice, _series, query
from quern.sources.tables import frames, table

_SUBSETS = "su AS (SELECT sid, 1 + ((sid & 1) > 0)::INT * 2.0 + ((sid & 2) > 0)::INT * 2.0 + ((sid & 4) > 0)::INT * 3.0 + ((sid & 8) > 0)::INT * 1.5 AS cost FROM range(0, 16) t(sid))"


@query(f"WITH {_SUBSETS} SELECT o_orderkey, count(*)::BIGINT AS n, max(cost)::DOUBLE AS dearest, max(bit_count(sid::INT))::INT AS most FROM orders JOIN su ON cost <= 1 + o_orderkey % 10 GROUP BY o_orderkey")
def feasible_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Subsets of the experts within each order's budget."""
    orders = table(spark, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 10).alias("budget"))
    # Sixteen subsets.
    fit = experts.within_budget(orders.crossJoin(F.broadcast(experts.subset_table(spark))), F.col("budget"))
    return fit.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.max("cost").alias("dearest"), F.max(F.size("members")).alias("most"))


@query(_LATTICE + """, p AS (SELECT b.marginal - a.marginal AS x FROM m a JOIN m b ON a.query_id = b.query_id AND a.expert = b.expert AND a.sid <> b.sid AND (a.sid & b.sid) = a.sid),
s AS (SELECT avg((x > 1e-4)::INT) AS r, coalesce(avg(CASE WHEN x > 1e-4 THEN x END), 0) AS e FROM p) SELECT round((SELECT avg((marginal < -1e-4)::INT) FROM m), 6) AS monotone_violations, round(r, 6) AS diminishing_violations, round(e, 6) AS mean_excess,
CASE WHEN r < 0.05 THEN 'submodular' WHEN r <= 0.10 THEN 'weakly_submodular' ELSE 'non_submodular' END AS verdict FROM s""")
def submodularity(spark: SparkSession, d: str) -> DataFrame:
    r = experts.submodularity(_lattice(spark, d), 4)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns[:3]], "verdict")


@query(_LATTICE + """, g AS (SELECT v.query_id, v.sid, v.value - z.value AS gain, (SELECT sum(o.value - z.value) FROM v o WHERE o.query_id = v.query_id AND o.sid IN (1, 2, 4, 8) AND (o.sid & v.sid) > 0) AS ones FROM v JOIN v z ON z.query_id = v.query_id AND z.sid = 0 WHERE bit_count(v.sid::INT) > 1)
SELECT query_id, round(avg(CASE WHEN gain > 1e-9 THEN least(1, greatest(0, ones / gain)) END), 5) AS gamma FROM g GROUP BY query_id""")
def submodularity_ratio(spark: SparkSession, d: str) -> DataFrame:
    return experts.submodularity_ratio(_lattice(spark, d), 4).withColumn("gamma", F.round("gamma", 5))


@query(_LATTICE.replace("WITH v", "WITH RECURSIVE v") + """, c AS (SELECT unnest([0, 1, 2, 3]) AS e, unnest([2.0, 2.0, 3.0, 1.5])::DOUBLE AS cost),
st AS (SELECT query_id, 0::BIGINT AS sid, 4.0::DOUBLE AS remain, 0 AS step FROM v WHERE sid = 0 UNION ALL
 SELECT query_id, sid, remain, step FROM (SELECT st.query_id, st.sid | (1 << c.e) AS sid, st.remain - c.cost AS remain, step + 1 AS step, row_number() OVER (PARTITION BY st.query_id ORDER BY m.marginal DESC, c.e) AS k
 FROM st JOIN m ON m.query_id = st.query_id AND m.sid = st.sid JOIN c ON c.e = m.expert WHERE c.cost <= st.remain AND m.marginal > 0) WHERE k = 1)
SELECT query_id, sid::INT AS sid, 5 - remain AS cost, (1 + bit_count(sid::INT))::INT AS n_experts FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step DESC) AS k FROM st) WHERE k = 1""")
def greedy_pick(spark: SparkSession, d: str) -> DataFrame:
    return experts.greedy(_lattice(spark, d), experts.COSTS, 5.0).withColumn("n_experts", F.col("n_experts").cast("int"))


@query(_LATTICE + """, e AS (SELECT query_id, max(CASE WHEN sid = 0 THEN value END) AS base, max(CASE WHEN sid = 15 THEN value END) AS a, max(value) AS o FROM v GROUP BY query_id), t AS (SELECT avg(base) AS base, avg(a) AS a, avg(o) AS o FROM e)
SELECT 'base' AS policy, round(base, 6) AS mean_value, round(base / o, 6) AS of_oracle FROM t UNION ALL SELECT 'all', round(a, 6), round(a / o, 6) FROM t UNION ALL SELECT 'oracle', round(o, 6), 1.0 FROM t""")
def selection_policies(spark: SparkSession, d: str) -> DataFrame:
    p = experts.policies(_lattice(spark, d), experts.subset_table(spark))
    return p.select("policy", F.round("mean_value", 6).alias("mean_value"), F.round("of_oracle", 6).alias("of_oracle"))


def _base(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    q = search.query_set(f)
    return search.base_scores(search.prototypes(f, (6,)), q).join(q.select("query_id", F.col("video_id").alias("own")), "query_id")


@query(_FRAMES + "SELECT query_id, count_if(1 - base <= 0.9)::BIGINT AS size, max(1 - base <= 0.9 AND video_id = own) AS covered FROM bq GROUP BY query_id")
def prediction_sets(spark: SparkSession, d: str) -> DataFrame:
    return experts.prediction_sets(_base(spark, d), 0.9)


@query(_FRAMES + ", s AS (SELECT query_id, count_if(1 - base <= 0.5) AS size, max(1 - base <= 0.5 AND video_id = own)::INT AS c FROM bq GROUP BY query_id) SELECT round(avg(c), 6) AS coverage, round(avg(size), 6) AS mean_size FROM s")
def set_coverage(spark: SparkSession, d: str) -> DataFrame:
    return experts.coverage(experts.prediction_sets(_base(spark, d), 0.5)).select(F.round("coverage", 6).alias("coverage"), F.round("mean_size", 6).alias("mean_size"))


@query(_FRAMES + """, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, video_id) AS k FROM bq), t AS (SELECT *, exp((base - max(base) OVER (PARTITION BY query_id)) / 0.1) AS e FROM k WHERE k <= 20), p AS (SELECT *, greatest(e / sum(e) OVER (PARTITION BY query_id), 1e-12) AS p FROM t)
SELECT query_id, round(max(CASE WHEN k = 1 THEN base END), 5) AS top1, round(max(CASE WHEN k = 2 THEN base END), 5) AS top2, round(max(CASE WHEN k = 1 THEN base END) - max(CASE WHEN k = 2 THEN base END), 5) AS gap, round(avg(base), 5) AS mean, round(stddev_pop(base), 5) AS std, round(-sum(p * ln(p)), 5) AS entropy FROM p GROUP BY query_id""")
def score_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = experts.score_statistics(_base(spark, d), "base")
    return s.select("query_id", *[F.round(c, 5).alias(c) for c in s.columns[1:]])


@query("SELECT round(avg((CASE WHEN o_orderkey % 7 <> 0 THEN 1 END IS NOT NULL)::INT), 6) AS created, round(avg((o_orderstatus <> 'P')::INT), 6) AS geo FROM orders")
def metadata_availability(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rows = o.select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("created"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("geo"))
    return experts.availability(rows, ["created", "geo"]).select(F.round("created", 6).alias("created"), F.round("geo", 6).alias("geo"))


#: Boxes that stand for coasts beside the fixed ones, so that positions fall into some.
_COASTS = (*metadata.COASTS, (40.0, 60.0, 0.0, 90.0))


@query(r"""WITH t AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '+' || lpad((c_custkey * 37 % 90)::VARCHAR, 2, '0') || '.' || lpad((c_custkey * 7919 % 10000)::VARCHAR, 4, '0') || '-' || lpad((c_custkey * 53 % 180)::VARCHAR, 3, '0') || '.25+' || (c_custkey % 2000)::VARCHAR || '.5/'
 WHEN 1 THEN '-' || (c_custkey * 11 % 90)::VARCHAR || '+' || (c_custkey * 13 % 180)::VARCHAR || '/' WHEN 2 THEN c_name ELSE '+' || (c_custkey * 17 % 90)::VARCHAR || '.5+' || (c_custkey * 29 % 180)::VARCHAR || '.5' END AS t FROM customer),
p AS (SELECT k, regexp_extract(t, '([+-][0-9]+(\.[0-9]+)?)([+-][0-9]+(\.[0-9]+)?)([+-][0-9]+(\.[0-9]+)?)?', ['a', 'x', 'b', 'y', 'c', 'z']) AS r FROM t), n AS (SELECT k, try_cast(r.a AS DOUBLE) AS la, try_cast(r.b AS DOUBLE) AS lo, try_cast(r.c AS DOUBLE) AS al FROM p)
SELECT k AS c_custkey, la AS latitude, lo AS longitude, al AS altitude, CASE WHEN la IS NULL THEN 'unknown' WHEN la BETWEEN 18 AND 20 AND lo BETWEEN 108.5 AND 111 OR la BETWEEN 36.5 AND 38.5 AND lo BETWEEN 120 AND 122.5 OR la BETWEEN 22 AND 23.5 AND lo BETWEEN 113.5 AND 114.7 OR la BETWEEN 40 AND 60 AND lo BETWEEN 0 AND 90 THEN 'coast' WHEN al >= 800 THEN 'mountain' ELSE 'unknown' END AS place,
 round(2 * 6371 * asin(sqrt(power(sin(radians(la) / 2), 2) + cos(radians(la)) * power(sin(radians(lo) / 2), 2))), 3) AS km FROM n""")
def positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions read from texts of customers, with the kind of place and the way from the origin."""
    k = F.col("c_custkey")
    part = lambda f, m: (k * f % m).cast("string")
    long = F.concat(F.lit("+"), F.lpad(part(37, 90), 2, "0"), F.lit("."), F.lpad(part(7919, 10000), 4, "0"), F.lit("-"), F.lpad(part(53, 180), 3, "0"), F.lit(".25+"), part(1, 2000), F.lit(".5/"))
    short = F.concat(F.lit("-"), part(11, 90), F.lit("+"), part(13, 180), F.lit("/"))
    text = F.when(k % 4 == 0, long).when(k % 4 == 1, short).when(k % 4 == 2, F.col("c_name")).otherwise(F.concat(F.lit("+"), part(17, 90), F.lit(".5+"), part(29, 180), F.lit(".5")))
    p = table(spark, d, "customer").select("c_custkey", experts.iso6709(text).alias("p")).select("c_custkey", "p.*")
    la, lo = F.col("latitude"), F.col("longitude")
    return p.withColumns({"place": metadata.geo_class(la, lo, F.col("altitude"), _COASTS), "km": F.round(metadata.haversine_km(F.lit(0.0), F.lit(0.0), la, lo), 3)})


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (24000 + p_size * 1000)::VARCHAR || '/1001' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size::VARCHAR || '/' || (p_partkey % 3)::VARCHAR ELSE p_brand END AS t FROM part)
SELECT p_partkey, round(CASE WHEN contains(t, '/') THEN try_cast(split_part(t, '/', 1) AS DOUBLE) / nullif(try_cast(split_part(t, '/', 2) AS DOUBLE), 0) ELSE try_cast(t AS DOUBLE) END, 6) AS fps FROM t""")
def frame_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates read from texts of parts."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat((24000 + F.col("p_size") * 1000).cast("string"), F.lit("/1001"))).when(k % 4 == 1, size).when(k % 4 == 2, F.concat(size, F.lit("/"), (k % 3).cast("string"))).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.round(experts.frame_rate(text), 6).alias("fps"))


@query("SELECT 'delta' AS what, round(avg((embedding[2] > 0)::INT - (embedding[1] > 0)::INT), 6) AS value FROM embeddings")
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """The difference that the paired tests are about; the tests draw random numbers."""
    e = table(spark, d, "embeddings").select((F.col("embedding")[0] > 0).alias("a"), (F.col("embedding")[1] > 0).alias("b"))
    return experts.paired_tests(e, "a", "b", 100).select(F.lit("delta").alias("what"), F.round("delta", 6).alias("value"))


@query(_SERIES + """, p AS (SELECT user_id, list({'u': least(v / 10, 60), 's': [t], 'e': [least(t + v / 10, t + 60)], 'v': [v]} ORDER BY v DESC, t) AS p FROM r GROUP BY user_id),
f AS (SELECT user_id, list_reduce(p, lambda a, x: CASE WHEN len(a.s) < 10 AND (x.u <= 60 - a.u OR 60 - a.u >= 0.2) THEN {'u': a.u + least(x.u, 60 - a.u), 's': list_concat(a.s, x.s), 'e': list_concat(a.e, [least(x.e[1], x.s[1] + 60 - a.u)]), 'v': list_concat(a.v, x.v)} ELSE a END) AS k FROM p),
u AS (SELECT user_id, unnest(k.s) AS s, unnest(k.e) AS e, unnest(k.v) AS v FROM f) SELECT user_id, round(s, 5) AS "start", round(e, 5) AS "end", v AS score FROM u""")
def interest_budget(spark: SparkSession, d: str) -> DataFrame:
    i = _series(spark, d).select("user_id", F.col("t").alias("start"), (F.col("t") + F.col("v") / 10).alias("end"), F.col("v").alias("score"), (F.col("v") / 10).alias("length"))
    return scans.budgeted(i, "user_id", length="length").select("user_id", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"), "score")


def _words(words) -> str:
    return " OR ".join(f"contains(tx, '{w}')" for w in words)


#: Signals of videos out of embeddings, queries' texts out of documents, and the experts' scores.
_GALLERY = """WITH fr AS (SELECT vec_id, vec_id // 10 AS video_id, vec_id % 10 AS frame_no, embedding::DOUBLE[] AS e, embedding[2]::DOUBLE AS hl, vec_id % 3 = 0 AS face, embedding[3]::DOUBLE AS conf, list_reverse(embedding::DOUBLE[]) AS fe, CASE label WHEN 0 THEN 'vehicle' WHEN 1 THEN 'beach' WHEN 2 THEN 'sport' ELSE 'indoor' END AS label FROM embeddings),
ex AS (SELECT video_id, p, avg(x) AS x FROM (SELECT video_id, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM fr) GROUP BY ALL), em AS (SELECT video_id, list(x ORDER BY p) AS m FROM ex GROUP BY video_id),
fx AS (SELECT video_id, p, avg(x) AS x FROM (SELECT video_id, unnest(fe) AS x, generate_subscripts(fe, 1) AS p FROM fr WHERE face) GROUP BY ALL), fm AS (SELECT video_id, list(x ORDER BY p) AS m FROM fx GROUP BY video_id),
lb AS (SELECT video_id, arg_max(label, n * 1000 - first) AS scene FROM (SELECT video_id, label, count(*) AS n, min(frame_no) AS first FROM fr GROUP BY ALL) GROUP BY video_id),
ga AS (SELECT video_id, max(hl) AS hl, coalesce(max(conf) FILTER (face), 0) AS face, any_value(list_transform(em.m, lambda x: x / (sqrt(list_dot_product(em.m, em.m)) + 1e-9))) AS emb,
 any_value(list_transform(fm.m, lambda x: x / (sqrt(list_dot_product(fm.m, fm.m)) + 1e-9))) AS femb, any_value(scene) AS scene FROM fr JOIN em USING (video_id) LEFT JOIN fm USING (video_id) JOIN lb USING (video_id) GROUP BY video_id),
qu AS (SELECT vec_id AS query_id, video_id AS own, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-9)) AS q, list_transform(fe, lambda x: x / (sqrt(list_dot_product(fe, fe)) + 1e-9)) AS fq, lower(coalesce(text, '')) AS tx FROM fr LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0),
pi AS (SELECT *, """ + _words(gallery.PERSON) + " AS person, " + _words(gallery.HIGHLIGHT) + " AS lively, CASE " + " ".join(f"WHEN {_words(w)} THEN '{n}'" for n, w in gallery.SCENES) + """ END AS cue FROM qu),
pa AS (SELECT query_id, own, video_id, list_dot_product(q, emb) AS sem, hl, ga.face, CASE WHEN query_id % 40 = 0 THEN coalesce(list_dot_product(femb, fq), 0) END AS fid, scene = cue AS sc, person, lively FROM pi, ga),
xs AS (SELECT query_id, own, video_id, (sem - min(sem) OVER w) / (max(sem) OVER w - min(sem) OVER w) AS sem, CASE WHEN lively THEN 1 ELSE 0.3::DOUBLE END * (hl - min(hl) OVER w) / (max(hl) OVER w - min(hl) OVER w) AS highlight, CASE WHEN person THEN (face - min(face) OVER w) / (max(face) OVER w - min(face) OVER w) ELSE 0 END AS face,
 coalesce((fid - min(fid) OVER w) / (max(fid) OVER w - min(fid) OVER w), 0) AS face_id, coalesce(sc::INT, 0) AS scene FROM pa WINDOW w AS (PARTITION BY query_id)),
tt AS (SELECT query_id, own, video_id, sid, round(sem + (sid & 1) * 0.35::DOUBLE * highlight + ((sid >> 1) & 1) * 0.35::DOUBLE * face + ((sid >> 2) & 1) * 0.35::DOUBLE * face_id + ((sid >> 3) & 1) * 0.35::DOUBLE * scene, 9) AS t FROM xs, range(0, 16) z(sid)),
rk AS (SELECT query_id, sid, count_if(t > o) AS rank FROM (SELECT *, max(CASE WHEN video_id = own THEN t END) OVER (PARTITION BY query_id, sid) AS o FROM tt) GROUP BY query_id, sid),
v AS (SELECT query_id, sid, 1 / (rank + 1) AS value FROM rk), m AS (SELECT a.query_id, a.sid, e AS expert, b.value - a.value AS marginal FROM v a, range(0, 4) t(e), v b WHERE (a.sid >> e) & 1 = 0 AND b.query_id = a.query_id AND b.sid = (a.sid | (1 << e)))
"""


def _gallery(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ranks under every subset of the experts, and prediction sets."""
    e = table(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    video, label = F.floor(F.col("vec_id") / 10).cast("long"), F.when(F.col("label") == 0, "vehicle").when(F.col("label") == 1, "beach").when(F.col("label") == 2, "sport").otherwise("indoor")
    f = e.select("vec_id", video.alias("video_id"), (F.col("vec_id") % 10).alias("frame_no"), F.col("e").alias("emb"), F.col("e")[1].alias("highlight"), (F.col("vec_id") % 3 == 0).alias("face"), F.col("e")[2].alias("confidence"), F.reverse("e").alias("face_emb"), label.alias("label"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    q = f.where("vec_id % 20 = 0").join(texts, "vec_id", "left")
    q = q.select(F.col("vec_id").alias("query_id"), F.col("video_id").alias("own"), l2_normalise(F.col("emb")).alias("emb"), "text", F.when(F.col("vec_id") % 40 == 0, F.col("face_emb")).alias("face_emb"))
    return gallery.ranks_and_sets(gallery.gallery_signals(f), q, 0.4)


@query(_GALLERY + "SELECT query_id, sid::INT AS sid, rank::INT AS rank, round(1 / (rank + 1), 6) AS value FROM rk")
def subset_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of the right videos under all 16 subsets of the experts."""
    ranks, _ = _gallery(spark, d)
    return ranks.select("query_id", "sid", "rank", F.round(gallery.value_of(F.col("rank")), 6).alias("value"))


@query(_GALLERY + "SELECT expert::INT AS expert, count(*)::BIGINT AS n, round(avg(marginal), 6) AS mean, round(avg((marginal > 0)::INT), 6) AS positive, row_number() OVER (ORDER BY avg(marginal) DESC, expert)::INT AS place FROM m GROUP BY expert")
def expert_ranking(spark: SparkSession, d: str) -> DataFrame:
    """What each expert adds to the subsets without it, measured on ranks."""
    r = gallery.expert_ranking(evaluate.marginals(gallery.lattice(_gallery(spark, d)[0]), 4))
    return r.select("expert", "n", F.round("mean", 6).alias("mean"), F.round("positive", 6).alias("positive"), "place")


@query(_GALLERY.replace("WITH fr", "WITH RECURSIVE fr") + """, c AS (SELECT unnest([0, 1, 2, 3]) AS e, unnest([2.0, 2.0, 3.0, 1.5])::DOUBLE AS cost),
st AS (SELECT query_id, 0::BIGINT AS sid, 4.0::DOUBLE AS remain, 0 AS step FROM v WHERE sid = 0 UNION ALL
 SELECT query_id, sid, remain, step FROM (SELECT st.query_id, st.sid | (1 << c.e) AS sid, st.remain - c.cost AS remain, step + 1 AS step, row_number() OVER (PARTITION BY st.query_id ORDER BY m.marginal DESC, c.e) AS k
 FROM st JOIN m ON m.query_id = st.query_id AND m.sid = st.sid JOIN c ON c.e = m.expert WHERE c.cost <= st.remain AND m.marginal > 0) WHERE k = 1),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step DESC) AS k FROM st) WHERE k = 1), ps AS (SELECT query_id, count_if(1 - sem <= 0.4)::BIGINT AS set_size, max(1 - sem <= 0.4 AND video_id = own) AS in_set FROM xs GROUP BY query_id)
SELECT query_id, sid::INT AS sid, rank::INT AS rank, 5 - remain AS cost, (1 + bit_count(sid::INT))::INT AS n_experts, in_set, set_size FROM pk JOIN rk USING (query_id, sid) JOIN ps USING (query_id)""")
def expert_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Greedy choice of experts within a budget, the rank under it, and the prediction set."""
    ranks, sets = _gallery(spark, d)
    out = gallery.selected_of(ranks, sets, gallery.lattice(ranks))
    return out.withColumn("n_experts", F.col("n_experts").cast("int"))


@query("""WITH RECURSIVE g AS (SELECT source, count(*)::BIGINT AS n, sum(toxic)::BIGINT AS k FROM labels JOIN documents USING (doc_id) GROUP BY source),
b AS (SELECT source, n, k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM g UNION ALL SELECT source, n, k, CASE WHEN below THEN lo ELSE mid END, CASE WHEN below THEN mid ELSE hi END, step + 1
 FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(n - i + 1.0::DOUBLE) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) <= 0.05 AS below FROM b WHERE step < 50 AND k < n))
SELECT g.source, g.n, g.k AS failures, round(CASE WHEN g.k = g.n THEN 1 ELSE (lo + hi) / 2 END, 6)::DOUBLE AS upper FROM g LEFT JOIN b ON b.source IS NOT DISTINCT FROM g.source AND step = 50""")
def failure_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The exact upper bound of the share of toxic documents of each source."""
    g = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("failures"))
    return g.withColumn("upper", F.round(evaluate.exact_upper(F.col("failures"), F.col("n")), 6))
