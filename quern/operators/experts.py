"""Selection among experts: subsets and costs, submodularity, greedy picks, prediction sets, and statistics of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.evaluate import marginals, subsets
from quern.operators.search import best_of

#: The optional experts, their costs, and the cost of the base that is always paid.
NAMES, COSTS, BASE_COST = ("highlight", "face", "face_id", "scene"), (2.0, 2.0, 3.0, 1.5), 1.0


def subset_table(spark: SparkSession, names=NAMES, costs=COSTS, base: float = BASE_COST) -> DataFrame:
    """sid, members, cost of every subset of the experts; bit j of sid is expert j."""
    return spark.createDataFrame([(s, m, c + base) for s, m, c in subsets(list(names), list(costs))], "sid int, members array<string>, cost double")


def within_budget(table: DataFrame, budget: float) -> DataFrame:
    return table.where(F.col("cost") <= budget)


def submodularity(values: DataFrame, experts: int, tol: float = 1e-4) -> DataFrame:
    """One row: monotone_violations (share of marginals below -tol), diminishing_violations (share of pairs S in S' where an expert adds
    over tol more to S'), mean_excess of those, and verdict."""
    m = marginals(values, experts)
    a = m.select("query_id", "expert", F.col("sid").alias("s"), F.col("marginal").alias("small"))
    b = m.select("query_id", "expert", F.col("sid").alias("t"), F.col("marginal").alias("big"))
    # A query has experts x 2^(experts - 1) rows, a constant.
    pairs = a.join(b, ["query_id", "expert"]).where("s <> t AND (s & t) = s").withColumn("excess", F.col("big") - F.col("small"))
    over = F.col("excess") > tol
    second = pairs.agg(F.avg(over.cast("double")).alias("diminishing_violations"), F.coalesce(F.avg(F.when(over, F.col("excess"))), F.lit(0.0)).alias("mean_excess"))
    first = m.agg(F.avg((F.col("marginal") < -tol).cast("double")).alias("monotone_violations"))
    rate = F.col("diminishing_violations")
    # One row on each side.
    return first.crossJoin(second).withColumn("verdict", F.when(rate < 0.05, "submodular").when(rate <= 0.10, "weakly_submodular").otherwise("non_submodular"))


def submodularity_ratio(values: DataFrame, experts: int) -> DataFrame:
    """query_id, gamma: over subsets of two or more with a gain, the mean of the singletons' gains over the subset's gain, cut to 0..1."""
    v = values.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("sid", "value"))).alias("v"))
    at = lambda k: F.element_at("v", F.lit(k))
    ratios = []
    for s in range(1, 1 << experts):
        own = [1 << j for j in range(experts) if s >> j & 1]
        if len(own) > 1:
            gain = at(s) - at(0)
            ratios.append(F.when(gain > 1e-9, F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum((at(k) - at(0) for k in own), F.lit(0.0)) / gain))))
    each = v.select("query_id", F.explode(F.array(*ratios)).alias("r"))
    return each.groupBy("query_id").agg(F.avg("r").alias("gamma"))


def greedy(values: DataFrame, costs, budget: float, stop: float = 0.0, base: float = BASE_COST) -> DataFrame:
    """query_id, sid, cost, n_experts: experts added while the best affordable one adds more than ``stop``; of equal ones the first."""
    v = values.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("sid", "value"))).alias("v"))

    # A fold over the steps: as columns of their own, steps would be written out in each other by the optimiser.
    def step(acc, _):
        options = []
        for j, cost in enumerate(costs):
            free = (F.shiftright(acc["sid"], j).bitwiseAND(F.lit(1)) == 0) & (F.lit(float(cost)) <= acc["left"])
            gain = F.element_at("v", acc["sid"].bitwiseOR(F.lit(1 << j))) - F.element_at("v", acc["sid"])
            options.append(F.when(free & (gain > stop), F.struct(gain.alias("gain"), F.lit(-j).alias("j"), F.lit(float(cost)).alias("cost"), F.lit(1 << j).alias("bit"))))
        best = F.array(F.array_max(F.array_compact(F.array(*options))))
        taken = lambda b: F.struct(acc["sid"].bitwiseOR(b["bit"]).alias("sid"), (acc["left"] - b["cost"]).alias("left"))
        return F.element_at(F.transform(best, lambda b: F.when(b.isNull(), acc).otherwise(taken(b))), 1)

    first = F.struct(F.lit(0).alias("sid"), F.lit(float(budget - base)).alias("left"))
    state = v.select("query_id", F.aggregate(F.sequence(F.lit(1), F.lit(len(costs))), first, step).alias("s")).select("query_id", "s.sid", "s.left")
    return state.select("query_id", "sid", (budget - F.col("left")).alias("cost"), (1 + F.bit_count("sid")).alias("n_experts"))


def policies(values: DataFrame, table: DataFrame) -> DataFrame:
    """policy, mean_value, of_oracle: the base alone, all experts, and the best subset of each query."""
    v = values.join(F.broadcast(table), "sid")
    full = table.agg(F.max("sid").alias("top"))
    each = v.crossJoin(F.broadcast(full)).groupBy("query_id").agg(F.max(F.when(F.col("sid") == 0, F.col("value"))).alias("base"), F.max(F.when(F.col("sid") == F.col("top"), F.col("value"))).alias("all"), F.max("value").alias("oracle"))
    mean = each.agg(*[F.avg(c).alias(c) for c in ("base", "all", "oracle")])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("policy"), F.col(c).alias("mean_value")) for c in ("base", "all", "oracle")]))
    return mean.select("oracle", rows.alias("r")).select("r.policy", "r.mean_value", (F.col("r.mean_value") / F.col("oracle")).alias("of_oracle"))


def prediction_sets(scored: DataFrame, threshold: float, score: str = "base") -> DataFrame:
    """query_id, size, covered: the videos whose nonconformity 1 - score is at most the threshold, and whether the right one (own) is among them."""
    inside = 1 - F.col(score) <= threshold
    return scored.groupBy("query_id").agg(F.count_if(inside).alias("size"), F.max(inside & (F.col("video_id") == F.col("own"))).alias("covered"))


def coverage(sets: DataFrame) -> DataFrame:
    return sets.agg(F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg("size").alias("mean_size"))


def score_statistics(scored: DataFrame, score: str, k: int = 20, tau: float = 0.1) -> DataFrame:
    """query_id, top1, top2, gap, mean, std and entropy of the softmax over a query's k best scores."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "video_id")
    t = best_of(scored, k, score).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    by = Window.partitionBy("query_id")
    t = t.withColumn("_e", F.exp((F.col(score) - F.max(score).over(by)) / tau)).withColumn("_p", F.col("_e") / F.sum("_e").over(by))
    one, two = (F.max(F.when(F.col("_k") == i, F.col(score))) for i in (1, 2))
    p = F.greatest(F.col("_p"), F.lit(1e-12))
    return t.groupBy("query_id").agg(one.alias("top1"), two.alias("top2"), (one - two).alias("gap"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), (-F.sum(p * F.log(p))).alias("entropy"))


def availability(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of rows that have each column."""
    return rows.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])


def splits(rows: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds split, drawn for each key by hash: the same in every run, and for other rows."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2**32)) / 2.0**32
    out, low = F.lit(list(shares)[-1]), 1.0
    for name in list(shares)[-2::-1]:
        low = sum(list(shares.values())[: list(shares).index(name) + 1])
        out = F.when(u < low, name).otherwise(out)
    return rows.withColumn("split", out)


def paired_tests(rows: DataFrame, a: str, b: str, times: int, seed: int = 0) -> DataFrame:
    """One row: delta (mean of b less a), p (paired permutation, both sides) and low, high (bootstrap, 95 %).

    Each repetition weighs each row by a number drawn from its hash, so that both are two sums by repetition: no collect, no shuffle of rows.
    """
    x = rows.select((F.col(b).cast("double") - F.col(a).cast("double")).alias("d"), F.monotonically_increasing_id().alias("_i"))
    each = x.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "_i", "t"), F.lit(2**32)) / 2.0**32
    # How often a row is drawn is Poisson with mean 1, which a bootstrap of many rows tends to.
    drawn, chance, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(12):
        total += chance
        drawn = drawn + (u(1) >= total).cast("int")
        chance /= k + 1
    sums = each.groupBy("t").agg(F.avg(F.when(u(0) < 0.5, F.col("d")).otherwise(-F.col("d"))).alias("flip"), (F.sum(drawn * F.col("d")) / F.sum(drawn)).alias("boot"))
    mean = x.agg(F.avg("d").alias("delta"))
    rows_ = sums.crossJoin(F.broadcast(mean))
    out = rows_.groupBy("delta").agg((F.count_if(F.abs("flip") >= F.abs("delta") - 1e-12) + 1).alias("k"), F.percentile("boot", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    return out.select("delta", (F.col("k") / (times + 1)).alias("p"), F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))


def iso6709(text: Column) -> Column:
    """struct<latitude, longitude, altitude> of a position such as +37.33-122.03+010.5/; null where there is none."""
    pattern = r"([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)(?:([+-]\d+(?:\.\d+)?))?"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("double")
    return F.when(text.rlike(pattern), F.struct(part(1).alias("latitude"), part(2).alias("longitude"), part(3).alias("altitude")))


def frame_rate(text: Column) -> Column:
    """The number of a rate such as 30000/1001; null for a denominator of 0."""
    a, b = (F.split_part(text, F.lit("/"), F.lit(k)).try_cast("double") for k in (1, 2))
    return F.when(F.instr(text, "/") > 0, F.try_divide(a, b)).otherwise(text.try_cast("double"))
