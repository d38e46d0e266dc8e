"""Queries of frame identity, spectra and ordered scans, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.vectors import l2_normalise
from quern.operators import identity, noise, sampling, scans, spectra
from quern.plans.catalogue import _SERIES, _series, query
from quern.sources.tables import table

#: A frame of 8 x 8 grey pixels of each embedding; its hash by DCT of the frame blown up to 32 x 32.
_PIXELS = """WITH RECURSIVE px AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE + 0.5) * 255)))::INT)) AS p, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
bs AS (SELECT u, y, sum(cos(pi() * (2 * (4 * y + t) + 1) * u / 64.0::DOUBLE) * sqrt(2 / 32.0::DOUBLE) * CASE WHEN u = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END) AS b FROM range(0, 8) a(u), range(0, 8) b(y), range(0, 4) c(t) GROUP BY ALL),
dc AS (SELECT vec_id, v.u * 8 + h.u AS k, CASE WHEN v.u + h.u = 0 THEN 0 ELSE sum(p * v.b * h.b) END AS c FROM px JOIN bs v ON v.y = i // 8 JOIN bs h ON h.y = i % 8 GROUP BY vec_id, v.u, h.u),
md AS (SELECT vec_id, (list_sort(list(c))[32] + list_sort(list(c))[33]) / 2 AS m FROM dc GROUP BY vec_id),
hs AS (SELECT vec_id, sum(CASE WHEN c > m THEN CASE WHEN k = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << k::INT END ELSE 0 END)::BIGINT AS phash FROM dc JOIN md USING (vec_id) GROUP BY vec_id),
ek AS (SELECT vec_id, sha256(unhex(string_agg(lpad(hex(p), 2, '0'), '' ORDER BY i))) AS exact_key FROM px WHERE i // 8 % 2 = 0 AND i % 2 = 0 GROUP BY vec_id)
"""
#: Every 20th frame with up to seven bits turned.
_TURNED = """, tn AS (SELECT vec_id AS query_id, exact_key, xor(phash, coalesce((SELECT sum(DISTINCT CASE WHEN b = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << b::INT END) FROM (SELECT (vec_id * 7 + j * 9) % 64 AS b FROM range(0, 8) r(j) WHERE j < vec_id // 20 % 8)), 0)::BIGINT) AS phash FROM hs JOIN ek USING (vec_id) WHERE vec_id % 20 = 0)
, al AS (SELECT query_id, vec_id, bit_count(xor(t.phash, h.phash))::INT AS distance, min(vec_id) OVER (PARTITION BY h.phash, query_id) AS f, max(vec_id) OVER (PARTITION BY h.phash, query_id) AS l FROM tn t, hs h WHERE bit_count(xor(t.phash, h.phash)) <= 5)
, be AS (SELECT query_id, first(l ORDER BY distance, f) AS match_id, min(distance) AS distance FROM al GROUP BY query_id)
"""


def _frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    number = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.5) * 255).cast("int")))
    pixels = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(number(x)), 2, "0")), ""))
    return e.select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), pixels.alias("pixels"))


def _turned(hashed: DataFrame) -> DataFrame:
    """Every 20th frame as a query, with up to seven bits of its hash turned."""
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), ((F.col("vec_id") * 7 + j * 9) % 64).cast("int"))
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda a, j: F.when(j < F.floor(F.col("vec_id") / 20) % 8, a.bitwiseXOR(bit(j))).otherwise(a))
    return hashed.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "exact_key", F.col("phash").bitwiseXOR(bits).alias("phash"))


@query(_PIXELS + "SELECT vec_id, exact_key, phash FROM hs JOIN ek USING (vec_id)")
def frame_hashes(spark: SparkSession, d: str) -> DataFrame:
    return identity.hashed(_frames(spark, d), stride=2).select("vec_id", "exact_key", "phash")


@query(_PIXELS + _TURNED + "SELECT query_id, match_id, distance FROM tn LEFT JOIN be USING (query_id)")
def nearest_by_hash(spark: SparkSession, d: str) -> DataFrame:
    h = identity.hashed(_frames(spark, d), stride=2)
    return identity.nearest_by_hash(_turned(h).select("query_id", "phash"), h.select(F.col("vec_id").alias("frame_id"), "phash")).select("query_id", "match_id", "distance")


@query(_PIXELS + _TURNED + """, un AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9)) AS e FROM embeddings)
, q AS (SELECT query_id, CASE WHEN query_id % 60 = 0 THEN exact_key ELSE 'other' END AS exact_key FROM tn)
, x1 AS (SELECT query_id, max(k.vec_id) AS m FROM q JOIN ek k ON k.exact_key = q.exact_key AND k.vec_id % 3 = 0 GROUP BY query_id)
, a3 AS (SELECT query_id, h.vec_id, bit_count(xor(t.phash, h.phash)) AS distance, min(h.vec_id) OVER (PARTITION BY h.phash, query_id) AS f, max(h.vec_id) OVER (PARTITION BY h.phash, query_id) AS l FROM tn t, hs h WHERE h.vec_id % 3 = 0 AND bit_count(xor(t.phash, h.phash)) <= 5)
, x2 AS (SELECT query_id, first(l ORDER BY distance, f) AS m FROM a3 GROUP BY query_id)
, x3 AS (SELECT u.vec_id AS query_id, max(s.vec_id) AS m FROM un u, un s WHERE u.vec_id % 20 = 0 AND s.vec_id % 3 = 0 AND list_dot_product(u.e, s.e) >= 0.9 GROUP BY u.vec_id)
SELECT query_id, CASE WHEN x1.m IS NOT NULL THEN 'exact' WHEN x2.m IS NOT NULL THEN 'perceptual' WHEN x3.m IS NOT NULL THEN 'embedding' ELSE 'miss' END AS level, coalesce(x1.m, x2.m, x3.m) AS match_id
FROM q LEFT JOIN x1 USING (query_id) LEFT JOIN x2 USING (query_id) LEFT JOIN x3 USING (query_id)""")
def frame_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every 20th frame, two of three with another key, looked up among every third frame at three levels."""
    h = identity.hashed(_frames(spark, d), stride=2).select("vec_id", "exact_key", "phash")
    e = table(spark, d, "embeddings").select("vec_id", l2_normalise(F.col("embedding").cast("array<double>")).alias("emb"))
    q = _turned(h).withColumn("exact_key", F.when(F.col("query_id") % 60 == 0, F.col("exact_key")).otherwise("other")).join(e.withColumnRenamed("vec_id", "query_id"), "query_id")
    store = h.join(e, "vec_id").where("vec_id % 3 = 0").withColumnRenamed("vec_id", "frame_id")
    return identity.matched(q, store, cosine=0.9)


@query(_SERIES + """, w AS (SELECT user_id, greatest(0, t - 0.7) AS s, t + v / 20 + 0.7 AS e, v FROM r WHERE v > 30), m AS (SELECT *, coalesce(s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 1.5, true) AS n FROM w),
c AS (SELECT *, sum(n::INT) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m), j AS (SELECT user_id, min(s) AS s, max(e) AS e, max(v) AS v FROM c GROUP BY user_id, g),
p AS (SELECT user_id, list({'u': least(e - s, 25), 's': [s], 'e': [least(e, s + 25)], 'v': [v]} ORDER BY v DESC, s, e) AS p FROM j GROUP BY user_id),
f AS (SELECT user_id, list_reduce(p, lambda a, x: CASE WHEN len(a.s) < 6 AND (x.u <= 25 - a.u OR 25 - a.u >= 0.2) THEN {'u': a.u + least(x.u, 25 - a.u), 's': list_concat(a.s, x.s), 'e': list_concat(a.e, [least(x.e[1], x.s[1] + 25 - a.u)]), 'v': list_concat(a.v, x.v)} ELSE a END) AS k FROM p),
u AS (SELECT user_id, unnest(k.s) AS s, unnest(k.e) AS e, unnest(k.v) AS v FROM f) SELECT user_id, round(s, 4) AS "start", round(e, 4) AS "end", v AS score FROM u""")
def interest_plan(spark: SparkSession, d: str) -> DataFrame:
    """Interest about lively rows: widened, merged, and taken by score within a budget."""
    i = _series(spark, d).where("v > 30").select("user_id", F.col("t").alias("start"), (F.col("t") + F.col("v") / 20).alias("end"), F.col("v").alias("score"))
    return scans.interest_plan(i, "user_id", 0.7, 1.5, 6, 25.0).select("user_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "score")


@query(_SERIES + """, a AS (SELECT user_id, t, 'lively' AS o FROM r WHERE v > 40 UNION ALL SELECT user_id, t, 'even' FROM r WHERE floor(t)::BIGINT % 2 = 0), p AS (SELECT user_id, list({'t': [t], 'o': [[o]]} ORDER BY t, o) AS p FROM a GROUP BY user_id),
f AS (SELECT user_id, list_reduce(p, lambda a, x: CASE WHEN x.t[1] - a.t[len(a.t)] > 8 THEN {'t': list_concat(a.t, x.t), 'o': list_concat(a.o, x.o)} ELSE {'t': a.t, 'o': list_concat(a.o[1:len(a.o) - 1], [list_distinct(list_concat(a.o[len(a.o)], x.o[1]))])} END) AS f FROM p),
u AS (SELECT user_id, unnest(f.t) AS t, unnest(f.o) AS o FROM f) SELECT user_id, round(t, 6) AS t, array_to_string(list_sort(o), '|') AS origins FROM u""")
def union_of_samplers(spark: SparkSession, d: str) -> DataFrame:
    """Lively rows and those of even hours, of which those up to eight hours after a point join it."""
    r = _series(spark, d).withColumnsRenamed({"user_id": "video_id", "t": "ts"})
    both = r.where("v > 40").withColumn("origin", F.lit("lively")).unionByName(r.where(F.floor("ts") % 2 == 0).withColumn("origin", F.lit("even")))
    return sampling.union_of_samplers(both, 8.0).select(F.col("video_id").alias("user_id"), F.round("ts", 6).alias("t"), "origins")


@query(_SERIES + """, p AS (SELECT user_id, list([{'t': t, 'v': v}] ORDER BY v DESC, t) AS p FROM r GROUP BY user_id), f AS (SELECT user_id, list_reduce(p, lambda a, x: CASE WHEN len(a) < 5 AND len(list_filter(a, lambda y: abs(y.t - x[1].t) <= 12)) = 0 THEN list_concat(a, x) ELSE a END) AS k FROM p),
u AS (SELECT user_id, unnest(k) AS k FROM f) SELECT user_id, round(k.t, 6) AS t, k.v AS v FROM u""")
def best_spaced(spark: SparkSession, d: str) -> DataFrame:
    """The five best rows of each user that lie more than twelve hours apart."""
    return scans.best_spaced(_series(spark, d), "user_id", "t", "v", 5, 12.0).select("user_id", F.round("t", 6).alias("t"), "v")


#: Sensor streams of suppliers: gyroscope from prices, and a pull that swings with a frequency of each supplier's own.
_SENSOR = """WITH l AS (SELECT l_suppkey AS k, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t, l_quantity::DOUBLE AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
g AS (SELECT k, avg(sqrt((d * (k % 5)) ** 2 + (t * (k % 5)) ** 2 + (q / 500 * (k % 5)) ** 2)) AS gm FROM l GROUP BY k),
a AS (SELECT k, i, n, sqrt(d ** 2 + t ** 2 + (9.8 + (k % 4) * sin(2 * pi() * (k % 9 + 1) * 0.45 * i / 50) + q / 400) ** 2) - 9.80 AS v FROM l WHERE k % 11 <> 0),
m AS (SELECT k, avg(abs(v)) AS am FROM a WHERE n > 4 GROUP BY k), f AS (SELECT k, max(n) AS n, j, sum(v * cos(2 * pi() * (j * i % n) / n)) AS re, sum(v * sin(2 * pi() * (j * i % n) / n)) AS im FROM a, range(1, 100000) r(j) WHERE j <= n // 2 GROUP BY k, j),
h AS (SELECT k, arg_max(j, re * re + im * im) AS j, max(n) AS n FROM f GROUP BY k)
"""


def _sensors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, d, "lineitem")
    k = F.col("l_suppkey")
    x = l.select(k, *[F.col(c).cast("double").alias(c) for c in ("l_discount", "l_tax", "l_quantity")], (F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1).alias("i"))
    gyro = x.select("l_suppkey", (F.col("l_discount") * (k % 5)).alias("gx"), (F.col("l_tax") * (k % 5)).alias("gy"), (F.col("l_quantity") / 500 * (k % 5)).alias("gz"))
    swing = F.lit(9.8) + (k % 4) * F.sin(F.lit(2.0) * F.lit(3.141592653589793) * (k % 9 + 1) * 0.45 * F.col("i") / 50) + F.col("l_quantity") / 400
    accel = x.where(k % 11 != 0).select("l_suppkey", "i", F.col("l_discount").alias("ax"), F.col("l_tax").alias("ay"), swing.alias("az"))
    return gyro, accel


@query(_SENSOR + """SELECT g.k AS l_suppkey, CASE WHEN gm < 0.05 AND (am IS NULL OR am < 0.3) THEN 'stationary' WHEN hz BETWEEN 2.2 AND 4 AND am > 1.5 THEN 'running' WHEN hz >= 1.2 AND hz < 2.2 AND am > 0.5 THEN 'walking'
WHEN hz < 1 AND gm < 0.2 AND am < 0.5 THEN 'vehicle' WHEN gm BETWEEN 0.05 AND 0.5 THEN 'walking' WHEN gm > 1 THEN 'running' ELSE 'unknown' END AS label, round(gm, 5) AS gyro_mag, round(am, 5) AS accel_mag, round(hz, 5) AS hz
FROM g LEFT JOIN (SELECT k, am, j * 50.0::DOUBLE / n AS hz FROM m JOIN h USING (k)) USING (k)""")
def sensor_motion(spark: SparkSession, d: str) -> DataFrame:
    """Motion of suppliers' sensor streams by rules on means and main frequency."""
    m = spectra.sensor_motion(*_sensors(spark, d), "l_suppkey")
    return m.select("l_suppkey", "label", *[F.round(c, 5).alias(c) for c in ("gyro_mag", "accel_mag", "hz")])


def _u(name: str) -> str:
    return f"('0x' || md5('42:' || by_key || ':{name}')[1:13])::BIGINT / 4503599627370496.0::DOUBLE"


def _normal(name: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_u(name + '/a')})) * cos(6.283185307179586::DOUBLE * {_u(name + '/b')}))"


def _pick(name: str, values) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[floor({_u(name)} * {len(values)})::INT + 1]"


_NOISE = f"""WITH lv AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {', '.join(f'{x}::DOUBLE' for x in v)})" for n, v in noise.LEVELS.items())}) t(level, {', '.join(noise.FIELDS)})),
md AS (SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 9 <> 0 THEN epoch(o_orderdate::TIMESTAMP) END AS t, CASE WHEN o_orderkey % 7 <> 0 THEN (o_custkey % 90)::DOUBLE END AS la, CASE WHEN o_orderkey % 7 <> 0 THEN (o_custkey % 180)::DOUBLE END AS lo, CASE WHEN o_orderkey % 5 <> 0 THEN 'urban' END AS geo,
 CASE WHEN o_orderkey % 4 <> 0 THEN 'walking' END AS motion, CASE WHEN o_orderkey % 8 <> 0 THEN 0.75::DOUBLE END AS conf, CASE WHEN o_orderkey % 3 <> 0 THEN 'GoPro' END AS make, CASE WHEN o_orderkey % 3 <> 0 THEN 'Hero 9' END AS model FROM orders),
x AS (SELECT *, level || '/' || video_id::VARCHAR AS by_key FROM md, lv), y AS (SELECT *, la IS NOT NULL AND lo IS NOT NULL AS has, {_u('place missing')} < place_missing AS lost, {_u('place wrong')} < wrong_place AS wrong, {_u('motion missing')} < motion_missing AS still, {_u('motion flip')} < motion_flip AS flip, {_u('device missing')} < device_missing AS gone FROM x)
SELECT video_id, level, round(CASE WHEN {_u('time missing')} >= time_missing THEN t + shift_days * 86400 * {_normal('time')} END, 3) AS creation_time, round(CASE WHEN NOT has THEN la WHEN NOT lost THEN la + jitter_km * (1.0::DOUBLE / 111.0::DOUBLE) * {_normal('latitude')} END, 6) AS latitude,
 round(CASE WHEN NOT has THEN lo WHEN NOT lost THEN lo + jitter_km * (1.0::DOUBLE / 111.0::DOUBLE) * {_normal('longitude')} END, 6) AS longitude, CASE WHEN NOT lost AND (has OR geo IS NOT NULL) THEN CASE WHEN wrong THEN {_pick('place', noise.PLACES)} ELSE geo END END AS geo_category,
 CASE WHEN motion IS NOT NULL AND NOT still THEN CASE WHEN flip THEN {_pick('motion', noise.MOTIONS)} ELSE motion END END AS motion_class, round(CASE WHEN motion IS NULL THEN conf WHEN still THEN NULL WHEN flip THEN greatest(0.3, coalesce(conf, 0.8) - 0.3) ELSE conf END, 6)::DOUBLE AS motion_confidence,
 CASE WHEN make IS NOT NULL AND NOT gone THEN CASE WHEN {_u('device flip')} < device_flip THEN {_pick('device', noise.MAKERS)} ELSE make END END AS device_make, CASE WHEN NOT (make IS NOT NULL AND gone) THEN model END AS device_model FROM y"""


@query(_NOISE)
def noisy_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of orders' videos at six levels of noise."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    known = lambda m, v: F.when(k % m != 0, v)
    md = table(spark, d, "orders").select(
        k.alias("video_id"), known(9, F.col("o_orderdate").cast("timestamp").cast("double")).alias("creation_time"), known(7, (c % 90).cast("double")).alias("latitude"), known(7, (c % 180).cast("double")).alias("longitude"), known(5, F.lit("urban")).alias("geo_category"),
        known(4, F.lit("walking")).alias("motion_class"), known(8, F.lit(0.75)).alias("motion_confidence"), known(3, F.lit("GoPro")).alias("device_make"), known(3, F.lit("Hero 9")).alias("device_model"),
    )
    out = noise.noisy(md, noise.levels(spark))
    return out.select("video_id", "level", F.round("creation_time", 3).alias("creation_time"), *[F.round(x, 6).alias(x) for x in ("latitude", "longitude", "motion_confidence")], "geo_category", "motion_class", "device_make", "device_model")
