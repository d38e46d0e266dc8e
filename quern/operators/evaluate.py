"""Evaluation: ranks and retrieval metrics, calibration, conformal thresholds, expert subsets, hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def answer_ranks(scored: DataFrame, truth: DataFrame, score: str) -> DataFrame:
    """query_id, rank (from 0: scores above the right video's) and -1 where that video isn't scored."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc())
    ranked = scored.withColumn("rank", F.rank().over(w) - 1)
    return truth.join(ranked.select("query_id", "video_id", "rank"), ["query_id", "video_id"], "left").select("query_id", F.coalesce("rank", F.lit(-1)).alias("rank"))


def retrieval_metrics(ranks: DataFrame, absent: int = 1000) -> DataFrame:
    """One row: n, r1, r5, r10, mrr over valid ranks, mean_rank (from 1; absent counts absent + 1), median_rank."""
    r, ok = F.col("rank"), F.col("rank") >= 0
    hit = lambda k: F.avg((ok & (r < k)).cast("double"))
    one = F.when(ok, r + 1).otherwise(absent + 1)
    return ranks.agg(F.count("*").alias("n"), hit(1).alias("r1"), hit(5).alias("r5"), hit(10).alias("r10"), F.avg(F.when(ok, 1 / (r + 1))).alias("mrr"), F.avg(one).alias("mean_rank"), F.percentile(one, F.lit(0.5)).alias("median_rank"))


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """bin, n, confidence, accuracy over equal bins of p; the last is closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.withColumn("bin", b).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(y).alias("accuracy"))


def wilson_upper(failed: Column, n: Column, z: float = 1.96) -> Column:
    p = failed / n
    return (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


#: Ranges of values whose sums are run through first.
BLOCKS = 1024


def running(each: DataFrame, value: str, counts: list[str], descending: bool = False) -> DataFrame:
    """each (one row a value) with run_<count>: the sums of counts over all values up to its own.

    The sums of at most BLOCKS + 1 ranges of values go through one window, the values of a range through its own.
    """
    ends = F.broadcast(each.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    # One row of ends.
    rows = each.crossJoin(ends).withColumn("_block", F.coalesce(F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * BLOCKS), F.lit(0))).drop("_lo", "_hi")
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    blocks = rows.groupBy("_block").agg(*[F.sum(c).alias(c) for c in counts])
    before = Window.orderBy(way("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_to_{c}") for c in counts])
    w = Window.partitionBy("_block").orderBy(way(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"run_{c}": F.sum(c).over(w) for c in counts}).join(F.broadcast(blocks), "_block")
    return out.select(*each.columns, *[(F.col(f"run_{c}") + F.col(f"_to_{c}")).alias(f"run_{c}") for c in counts])


def threshold_sweep(rows: DataFrame, score: str, failed: str, least: int, delta: float) -> DataFrame:
    """tau, n, k, ucb of the smallest threshold that accepts ``least`` rows or more with a bounded failure rate; no row for none."""
    each = rows.groupBy(F.col(score).alias("tau")).agg(F.count("*").alias("c"), F.sum(failed).alias("f"))
    run = running(each, "tau", ["c", "f"], descending=True).select("tau", F.col("run_c").alias("n"), F.col("run_f").alias("k"))
    ok = run.where(F.col("n") >= least).withColumn("ucb", F.when(F.col("k") >= F.col("n"), 1.0).otherwise(wilson_upper(F.col("k"), F.col("n")))).where(F.col("ucb") <= delta)
    return ok.orderBy("tau").limit(1)


def conformal_threshold(rows: DataFrame, score: str, alpha: float) -> DataFrame:
    """n and the split-conformal threshold: the k-th least score, k = ceil((n + 1)(1 - alpha)); infinite beyond n, or without rows."""
    each = running(rows.groupBy(score).agg(F.count("*").alias("c")), score, ["c"])
    n = each.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    k = F.ceil((F.col("n") + 1) * (1 - alpha))
    # One row with n.
    reach = each.crossJoin(F.broadcast(n)).where(F.col("run_c") >= k).agg(F.min(score).alias("t"))
    return n.crossJoin(F.broadcast(reach)).select("n", F.coalesce("t", F.lit(float("inf"))).alias("threshold"))


def subsets(names: list[str], costs: list[float]) -> list[tuple[int, list[str], float]]:
    """All subsets of the experts as (bit set, names, cost)."""
    return [(s, [n for j, n in enumerate(names) if s >> j & 1], sum(c for j, c in enumerate(costs) if s >> j & 1)) for s in range(1 << len(names))]


def marginals(values: DataFrame, experts: int) -> DataFrame:
    """query_id, sid, expert, marginal: the value that an expert adds to each subset without it."""
    with_next = values.withColumn("expert", F.explode(F.sequence(F.lit(0), F.lit(experts - 1)))).where(F.expr("shiftright(sid, expert) & 1 = 0"))
    with_next = with_next.withColumn("to", F.expr("sid | shiftleft(1, expert)"))
    other = values.select("query_id", F.col("sid").alias("to"), F.col("value").alias("more"))
    return with_next.join(other, ["query_id", "to"]).select("query_id", "sid", "expert", (F.col("more") - F.col("value")).alias("marginal"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def distribution_overlap(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """key, overlap: one less the total variation distance of the labels' shares in a and b."""
    def share(x, name):
        each = x.groupBy(key, label).agg(F.count("*").alias("c"))
        return each.select(key, label, (F.col("c") / F.sum("c").over(Window.partitionBy(key))).alias(name))

    both = share(a, "_p").join(share(b, "_q"), [key, label], "full")
    return both.groupBy(key).agg((1 - F.sum(F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))) / 2).alias("overlap"))


def calibration_error(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: ece, the gap of confidence and accuracy over the bins, weighted by their rows."""
    r = reliability(rows, p, y, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def binned_thresholds(rows: DataFrame, score: str, margin: str, alpha: float, bins: int) -> DataFrame:
    """bin, n, threshold: the split-conformal threshold within each bin; edges are the inner quantiles of the margin.

    A bin is the number of edges not above the margin. Distinct scores are aggregated before the window over a bin.
    """
    edges = rows.agg(F.percentile(margin, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_edges"))
    binned = rows.crossJoin(F.broadcast(edges)).select(F.size(F.filter("_edges", lambda e: e <= F.col(margin))).alias("bin"), F.col(score).alias("s"))
    each = binned.groupBy("bin", "s").agg(F.count("*").alias("c"))
    w = Window.partitionBy("bin")
    each = each.withColumns({"n": F.sum("c").over(w), "upto": F.sum("c").over(w.orderBy("s"))})
    k = F.ceil((F.col("n") + 1) * (1 - alpha))
    return each.groupBy("bin", "n").agg(F.coalesce(F.min(F.when(F.col("upto") >= k, F.col("s"))), F.lit(float("inf"))).alias("threshold"))


def discordance(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: only_a, only_b (hits of one side alone) and McNemar's statistic with continuity correction, 0 without any."""
    only_a, only_b = F.count_if(F.col(a) & ~F.col(b)), F.count_if(~F.col(a) & F.col(b))
    n = rows.agg(only_a.alias("only_a"), only_b.alias("only_b"))
    x, y = F.col("only_a"), F.col("only_b")
    return n.withColumn("statistic", F.when(x + y > 0, F.pow(F.abs(x - y) - 1, F.lit(2)) / (x + y)).otherwise(0.0))


def discordance_p(statistic: float) -> float:
    """The chance of a larger statistic: chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(statistic / 2))


def log_gamma(z: Column) -> Column:
    """ln of the gamma function above 0: Stirling's series eight steps up, and back."""
    w = z + 8
    series = (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * F.pow(w, F.lit(3))) + 1 / (1260 * F.pow(w, F.lit(5)))
    product = z
    for k in range(1, 8):
        product = product * (z + k)
    return series - F.log(product)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function by its continued fraction, on the side of x where that settles fast."""
    flip = x > (a + 1) / (a + b + 2)
    held = F.array(F.struct(F.when(flip, 1 - x).otherwise(x).alias("x"), F.when(flip, b).otherwise(a).alias("a"), F.when(flip, a).otherwise(b).alias("b"), flip.alias("flip")))
    tiny = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def of(s):
        x, a, b = s["x"], s["a"], s["b"]
        depth = (100 + 4 * F.sqrt(F.greatest(a, b))).cast("int")
        first = F.array(1 / tiny(1 - (a + b) * x / (a + 1)))
        start = F.element_at(F.transform(first, lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))), 1)

        def turn(acc, part):
            step = F.array(F.struct(tiny(1 + part / acc["c"]).alias("c"), (1 / tiny(1 + part * acc["d"])).alias("d")))
            return F.element_at(F.transform(step, lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (acc["h"] * n["c"] * n["d"]).alias("h"))), 1)

        def pair(acc, m):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return turn(F.element_at(F.transform(F.array(turn(acc, even)), lambda t: t), 1), odd)

        fraction = F.aggregate(F.transform(F.sequence(F.lit(1), depth), lambda m: m.cast("double")), start, pair)["h"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
        return F.when(s["flip"], 1 - front * fraction).otherwise(front * fraction)

    value = F.element_at(F.transform(held, of), 1)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(value)


def exact_upper(failures: Column, n: Column, alpha: float = 0.05, steps: int = 50) -> Column:
    """The exact upper bound of a share of failures at level 1 - alpha: where so few of n come with a chance of alpha. 1 without rows, or if all fail.

    A bisection of a fixed number of steps. For one row for each group, not for rows of data.
    """
    k, m = failures.cast("double"), n.cast("double")

    def half(acc, _):
        middle = F.array((acc["lo"] + acc["hi"]) / 2)
        return F.element_at(F.transform(middle, lambda p: F.when(incomplete_beta(p, k + 1, m - k) < 1 - alpha, F.struct(p.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), p.alias("hi")))), 1)

    whole = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), whole, half, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when((n <= 0) | (failures >= n), 1.0).otherwise(found)
