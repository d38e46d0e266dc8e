"""Planners that choose a route for each query, and baselines beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.metadata import AXES
from quern.operators.routes import MODES, executed_choices, zone

#: Names of the routes that planners and baselines fall back on.
PLAIN, SMALL, LARGE, FULL = "R00_semantic_only_top500", "R01_semantic_only_top300", "R16_semantic_top1000_nnn_qamp", "R29_full_budget_all_soft_dense_refine"
#: Margins of the routing by difficulty, and ranks at which the cascade ends.
WIDE, NARROW = 0.08, 0.02
ENOUGH, FAIR = 5, 10

_ROUTE = ("route_id", "idx", "hard_axes", "soft_axes", "candidate_topm", "rerank_mode", "cost")


def _all_in(axes: str, zones: dict[str, Column], allowed: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for axis in AXES:
        out = out & (~F.array_contains(axes, axis) | zones[axis].isin(*allowed))
    return out


def zoned_choice(values: DataFrame, tau: dict[str, float | None], soft_ratio: float = 0.6) -> DataFrame:
    """query_id, the chosen route (route_id, idx, hard_axes, soft_axes, candidate_topm, rerank_mode, cost), value, n_hard, n_soft, fallback_type (none, soft, semantic).

    values: query_id, the columns of a route of the bank, value, and p_<axis>. A route counts if its hard axes are safe and its soft ones safe or uncertain; routes
    without axes always do. Where axes are uncertain a soft route over just these stands beside the bank, at the mean value of soft
    routes, or else 1.05 times that of routes without axes. The best value wins, of equal ones the first route.
    """
    zones = {a: zone(F.col(f"p_{a}"), tau.get(a) or 1.0, soft_ratio, enabled=tau.get(a) is not None) for a in AXES}
    bare = (F.size("hard_axes") == 0) & (F.size("soft_axes") == 0)
    soft_ok = _all_in("soft_axes", zones, ("hard_safe", "soft_uncertain"))
    tier = F.when(bare, "semantic").when(_all_in("hard_axes", zones, ("hard_safe",)) & soft_ok, "hard").when((F.size("hard_axes") == 0) & soft_ok, "soft")
    route = F.struct(*_ROUTE)
    rows = values.select("query_id", "value", tier.alias("tier"), route.alias("route"), F.array_compact(F.array(*[F.when(zones[a] == "soft_uncertain", a) for a in AXES])).alias("doubt"))
    # The bank is a few dozen routes: a query's candidates meet in one row of sums.
    best = F.max_by(F.struct("route", "tier", "value"), F.when(F.col("tier").isNotNull(), F.struct("value", (-F.col("route.idx")).alias("i"))))
    mean = lambda t: F.avg(F.when(F.col("tier") == t, F.col("value")))
    q = rows.groupBy("query_id").agg(
        best.alias("bank"), F.first("doubt").alias("doubt"), F.count_if(F.col("tier") == "hard").alias("n_hard"), F.count_if(F.col("tier") == "soft").alias("n_soft"), mean("soft").alias("soft"), mean("semantic").alias("plain"),
        (F.max("route.idx") + 1).alias("next"),
    )
    own = own_route("doubt", "next")
    worth = F.coalesce("soft", F.col("plain") * 1.05, F.lit(0.0))
    doubtful = F.size("doubt") > 0
    wins = doubtful & (F.col("bank").isNull() | (worth > F.col("bank.value")))
    q = q.select(
        "query_id", F.when(wins, own).otherwise(F.col("bank.route")).alias("route"), F.when(wins, worth).otherwise(F.col("bank.value")).alias("value"), F.when(wins, "soft").otherwise(F.col("bank.tier")).alias("tier"),
        "n_hard", (F.col("n_soft") + doubtful.cast("int")).alias("n_soft"),
    )
    kind = F.when((F.col("tier") == "semantic") & (F.col("n_hard") == 0) & (F.col("n_soft") == 0), "semantic").when(F.col("tier") == "soft", "soft").otherwise("none")
    return q.select("query_id", "route.*", "value", "n_hard", "n_soft", kind.alias("fallback_type"))


def own_route(axes: str, idx: str) -> Column:
    """A route of soft axes alone, as a struct of ``_ROUTE``."""
    name = F.concat(F.lit("dynamic_soft_"), F.array_join(F.array_sort(F.col(axes)), "_"))
    cost = F.when(F.size(axes) > 1, 2.0).otherwise(1.0)
    parts = {"route_id": name, "idx": F.col(idx), "hard_axes": F.array().cast("array<string>"), "soft_axes": F.col(axes), "candidate_topm": F.lit(500), "rerank_mode": F.lit(MODES[2]), "cost": cost}
    return F.struct(*[v.alias(c) for c, v in parts.items()])


def with_own_routes(bank: DataFrame, choices: DataFrame) -> DataFrame:
    """The bank and, behind it, each route of queries' own in choices: one for each set of axes at most."""
    own = choices.join(F.broadcast(bank.select("route_id")), "route_id", "left_anti").select(*[c for c in _ROUTE if c != "idx"]).distinct().collect()
    rows = [tuple(r[c] for c in _ROUTE) for r in bank.select(*_ROUTE).orderBy("idx").collect()]
    after = max(r[1] for r in rows) + 1
    rows += [(r.route_id, after + k, *[r[c] for c in _ROUTE[2:]]) for k, r in enumerate(sorted(own, key=lambda r: r.route_id))]
    return choices.sparkSession.createDataFrame(rows, bank.select(*_ROUTE).schema)


def _better(rank: Column, than: Column) -> Column:
    return (rank >= 0) & (rank < than)


def cascade(sem: DataFrame, first: DataFrame, bank: DataFrame, beta: float = 0.4) -> DataFrame:
    """query_id, route_id, rank, cost, stage: the first result, or where its rank isn't below ``ENOUGH`` the better of it and the large route's, or where that isn't below
    ``FAIR`` the best of these and the full route's.

    first: results of a planner. Only queries that a stage fails are searched again in the next; sem is read once more for each.
    """
    return _cascade(first, lambda failed, name: _again(sem, failed, bank, name, beta))


def cascade_of(results: DataFrame, first: DataFrame) -> DataFrame:
    """Like :func:`cascade`, over results that hold the large and the full route of every query."""
    return _cascade(first, lambda failed, name: _met(failed, results.where(F.col("route_id") == name)))


def _cascade(first: DataFrame, again) -> DataFrame:
    keep = ("query_id", "route_id", "rank", "cost")
    one = first.select(*keep)
    done = _better(F.col("rank"), F.lit(ENOUGH))
    two = again(one.where(~done), LARGE)
    # The better one, with what both had.
    held = two.select("query_id", "first", F.when(_better(F.col("next.rank"), F.col("first.rank")), F.col("next")).otherwise(F.col("first")).alias("best"), "next")
    fair = _better(F.col("best.rank"), F.lit(FAIR))
    three = again(held.where(~fair).select("query_id", "first.*"), FULL).withColumnRenamed("next", "last")
    rest = held.where(~fair).select("query_id", "next").join(three, "query_id")
    order = lambda c, k: F.when(F.col(f"{c}.rank") >= 0, F.struct(F.col(f"{c}.rank").alias("r"), F.lit(k).alias("k"), F.col(c).alias("x")))
    least = F.array_min(F.array_compact(F.array(order("first", 0), order("next", 1), order("last", 2))))
    rest = rest.select("query_id", F.coalesce(least["x"], F.col("first")).alias("x"))
    out = one.where(done).withColumn("stage", F.lit(1)).unionByName(held.where(fair).select("query_id", "best.*", F.lit(2).alias("stage")))
    return out.unionByName(rest.select("query_id", "x.*", F.lit(3).alias("stage")))


def _again(sem: DataFrame, failed: DataFrame, bank: DataFrame, name: str, beta: float) -> DataFrame:
    """query_id, first and next (route_id, rank, cost): what queries had, and their result on another route."""
    route = bank.where(F.col("route_id") == name).select(*_ROUTE)
    # One route.
    return _met(failed, executed_choices(sem, failed.select("query_id").crossJoin(F.broadcast(route)), beta))


def _met(failed: DataFrame, more: DataFrame) -> DataFrame:
    cells = lambda: F.struct("route_id", F.col("rank").cast("int").alias("rank"), "cost")
    return failed.select("query_id", cells().alias("first")).join(more.select("query_id", cells().alias("next")), "query_id")


def _matching(bank: DataFrame, asked: DataFrame, exact: bool) -> DataFrame:
    """query_id, route_id: the first route with the most hard axes, all of them asked for; with ``exact`` the first whose hard axes are those asked for goes before it."""
    # A few dozen routes, and queries are a stated set.
    pairs = asked.select("query_id", "asked").crossJoin(F.broadcast(bank.where(F.size("hard_axes") > 0).select("route_id", "idx", "hard_axes", "rerank_mode")))
    fits = pairs.where(F.size(F.array_except("hard_axes", "asked")) == 0)
    n = F.size("hard_axes")
    whole = ((n == F.size("asked")) & (F.col("rerank_mode") == MODES[3])).cast("int") if exact else F.lit(0)
    best = fits.groupBy("query_id").agg(F.max_by("route_id", F.struct(whole.alias("w"), n.alias("n"), (-F.col("idx")).alias("i"))).alias("route_id"))
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("route_id", F.lit(PLAIN)).alias("route_id"))


def baselines(grid: DataFrame, bank: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, baseline, route_id, rank, cost of the baselines, over the results of all routes.

    grid: query_id, route_id, idx, rank, cost, utility; asked: query_id, asked (the axes that the query constrains), margin (best less second score among the
    100 best). semantic: the plain route; rules: by the axes asked for; margin: by difficulty; random: drawn by md5 of the query; oracle: greatest utility;
    all_hard: all axes asked for as hard filters; cascade: small, by rules, large.
    """
    size = bank.count()
    drawn = F.conv(F.substring(F.md5(F.col("query_id").cast("string")), 1, 8), 16, 10).cast("long") % size
    by_margin = F.when(F.col("margin") > WIDE, PLAIN).when(F.col("margin") > NARROW, LARGE).otherwise(FULL)
    rules = _matching(bank, asked, False)
    one = lambda df, name: df.select("query_id", F.lit(name).alias("baseline"), "route_id")
    random = asked.select("query_id", drawn.alias("idx")).join(F.broadcast(bank.select(F.col("idx").cast("long").alias("idx"), "route_id")), "idx")
    chosen = one(asked.withColumn("route_id", F.lit(PLAIN)), "semantic").unionByName(one(rules, "rules")).unionByName(one(asked.withColumn("route_id", by_margin), "margin"))
    chosen = chosen.unionByName(one(random, "random")).unionByName(one(_matching(bank, asked, True), "all_hard"))
    results = grid.select("query_id", "route_id", F.col("rank").cast("int").alias("rank"), "cost")
    out = chosen.join(results, ["query_id", "route_id"])
    best = Window.partitionBy("query_id").orderBy(F.col("utility").desc(), "idx")
    oracle = grid.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("query_id", F.lit("oracle").alias("baseline"), "route_id", F.col("rank").cast("int").alias("rank"), "cost")
    cell = lambda name: results.where(F.col("route_id") == name).select("query_id", F.struct("route_id", "rank", "cost").alias(name[:3]))
    ruled = rules.join(results, ["query_id", "route_id"]).select("query_id", F.struct("route_id", "rank", "cost").alias("rule"))
    steps = asked.select("query_id", (F.size("asked") > 0).alias("some")).join(cell(SMALL), "query_id").join(ruled, "query_id").join(cell(LARGE), "query_id")
    place = lambda c, k: F.struct(F.when(F.col(f"{c}.rank") >= 0, F.col(f"{c}.rank")).otherwise(9999).alias("r"), F.lit(k).alias("k"), F.col(c).alias("x"))
    least = F.array_min(F.array_compact(F.array(place("R01", 0), F.when(F.col("some"), place("rule", 1)), place("R16", 2))))["x"]
    last = F.when(F.col("R01.rank") == 0, F.col("R01")).when(F.col("some") & _better(F.col("rule.rank"), F.col("R01.rank")), F.col("rule")).otherwise(least)
    stepped = steps.select("query_id", F.lit("cascade").alias("baseline"), last.alias("x")).select("query_id", "baseline", "x.*")
    return out.select("query_id", "baseline", "route_id", "rank", "cost").unionByName(oracle).unionByName(stepped)
