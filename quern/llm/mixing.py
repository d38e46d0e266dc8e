"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Operator 3. Each source has a target of words: its weight's share of 150% of all words, at most twice its own size,
the excess dealt again by weight. A source is taken whole as often as its target allows; of the rest, its
documents are read in a random order, cut into blocks, up to the target. Documents longer than the gap that is left are
then skipped, and the rest of the order is read up to the gap, round after round, until no document fits; then second copies
are taken in the same way. A source that still misses its target may take one document over it, or is filled anew from its
largest documents on, whichever is nearer. No document is taken more than twice.

Blocks are then dealt to output shards. The tree halves the shards again and again; at each node the number of blocks of
each source that go left is a multivariate hypergeometric draw, given the node's blocks and the left half's exact
number. The leaves have exact block counts for each source and shard; sources' permuted blocks fill them
disjointly, and each shard is shuffled by hash.

The tree has sources x shards numbers and is drawn on the driver, as are targets (one row for each source, at most
``MOST_SOURCES``). Rows only pass through windows over a block of one source, and a source's blocks number
at most ``MOST_BLOCKS``. All row work is DataFrame operations. Results depend on the rows and the seed alone.

Defined results: a null text has no words and is never taken. A null source is a source of its own, the last.
Equal rows are told apart by a rank among equals. Null doc_ids are allowed. If no source has a word, nothing is
taken. Other columns are kept by ``mix``, whatever their names. No rows give no rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import stash, table, words_of

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SHARDS = 8
#: A source that misses its target by more than this share, and its smallest document, is filled anew by size.
NEAR = 0.02
#: Documents of a block, about; most blocks of a source; most sources.
BLOCK, MOST_BLOCKS, MOST_SOURCES = 100, 50_000, 100_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target words of each source of (source, words)."""
    named = sorted((s for s, _ in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    order = named + [s for s, _ in sizes if s is None]
    size = dict(sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_ = share * sum(size.values()), list(order)
    out: dict[str | None, float] = {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] >= most * size[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
        left = max(left, 0.0)
    return out


def splitting_tree(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Blocks of each source in each shard; shards have equal numbers of blocks, but for one."""
    draw = np.random.Generator(np.random.PCG64(seed))
    total = sum(blocks)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(blocks), shards), np.int64)

    def split(held: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = held
            return
        mid = (lo + hi) // 2
        left = draw.multivariate_hypergeometric(held, sum(room[lo:mid]), method="marginals") if len(held) else held
        split(left, lo, mid)
        split(held - left, mid, hi)

    split(np.array(blocks, np.int64), 0, shards)
    return out.tolist()


def _literal(spark: SparkSession, rows: list[list], schema: str) -> DataFrame:
    """A small table as a literal of the plan."""
    parts = [F.lit(json.dumps(rows[k : k + 2000])) for k in range(0, len(rows), 2000)] or [F.lit("[]")]
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [f.split()[1] for f in schema.split(", ")]
    cells = spark.range(1).select(F.explode(F.array(*parts)).alias("j")).select(F.explode(F.from_json("j", "array<array<string>>")).alias("e"))
    return cells.select(*[(F.from_json(F.col("e")[k], t) if t.startswith("array") else F.col("e")[k].cast(t)).alias(n) for k, (n, t) in enumerate(zip(names, kinds, strict=True))])


def _hash(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def plan_mix(docs: DataFrame, key: str = "_row", shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """For each row of (doc_id, source, key, size): source_size, target, copies, taken, shards (of each copy), slot.

    ``key`` is a hash that equal rows share.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", key, "size")
    each = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(each) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    each.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([(r.source, r["size"]) for r in each])
    lines = []
    for k, r in enumerate(each):
        full = min(int(goal[r.source] // r["size"]), int(MOST)) if r["size"] else 0
        rest = goal[r.source] - full * r["size"]
        lines.append([k, None if r.source is None else r.source, r["size"], round(goal[r.source], 6), full, rest, max(1, min(MOST_BLOCKS, r.n // BLOCK))])
    plan = _literal(spark, lines, "_s int, _source string, source_size bigint, target double, _full int, _rest double, _blocks int")
    rows = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # A random order of a source: by u, which also cuts it into blocks of neighbours.
    same = Window.partitionBy(key).orderBy("doc_id")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col("_c")), 1)
    rows = rows.withColumn("_c", F.row_number().over(same)).withColumn("_u", u)
    rows = rows.withColumn("_b", F.least((F.col("_u") / F.lit(float(2**63)) * F.col("_blocks")).cast("int"), F.col("_blocks") - 1))
    rows = stash(rows, "mixrows")
    gap, room = {k: line[5] for k, line in enumerate(lines)}, {k: int(MOST) - line[4] for k, line in enumerate(lines)}
    rows = _filled(rows, gap, room, {k: line[3] for k, line in enumerate(lines)}, key)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("_full") + F.col("_in")).otherwise(0))
    return _dealt(rows, each, key, shards, seed)


def _filled(rows: DataFrame, gap: dict[int, float], room: dict[int, int], goal: dict[int, float], key: str) -> DataFrame:
    """Adds _in: how often a document is taken for its source's rest, at most as often as the source has ``room`` for.

    First copies come first; where no further document fits, second copies fill what is left. A source that still misses by
    more than its smallest document and ``NEAR`` of its target takes the smallest document that has room over the target, if
    that comes nearer. If it misses by as much then, it is filled anew from its largest documents on, and the nearer filling stays.
    """
    left = stash(rows.where("size > 0").select("_s", "_b", "_u", key, "_c", "size"), "mixleft")
    allowed = {r["_s"]: max(r["low"], NEAR * goal[r["_s"]]) for r in left.groupBy("_s").agg(F.min("size").alias("low")).collect()}
    taken, missed = _in_rounds(left, gap, room, allowed, key, by_size=False)
    again = {s for s, g in missed.items() if s in allowed and abs(g) > allowed[s]}
    if again:
        part = left.where(F.col("_s").isin(sorted(again)))
        other, now = _in_rounds(part, {s: gap[s] for s in again}, room, allowed, key, by_size=True)
        better = sorted(s for s in again if abs(now[s]) < abs(missed[s]))
        taken = taken.where(~F.col("_s").isin(better)).unionByName(other.where(F.col("_s").isin(better)))
    return rows.join(taken, ["_s", key, "_c"], "left").withColumn("_in", F.coalesce("_in", F.lit(0)))


def _in_rounds(rows: DataFrame, gap: dict[int, float], room: dict[int, int], allowed: dict[int, float], key: str, by_size: bool) -> tuple[DataFrame, dict[int, float]]:
    """(_s, key, _c, _in) of the documents taken, and what each source misses (below 0: is over by).

    A round takes documents of size up to the gap, in their order, while their sum is within it. The first of them always
    is, so a source that takes none in a round has none that fit.
    """
    spark = rows.sparkSession
    if by_size:
        # Sources whose largest documents make up most of them: these come first, by size, and each copy for itself.
        each = _literal(spark, [[s, list(range(1, room[s] + 1))] for s in gap], "_gs int, _each array<bigint>")
        rows = rows.join(F.broadcast(each), F.col("_gs") == F.col("_s")).withColumns({"_b": F.lit(0), "_u": -F.col("size"), "_k": F.explode("_each")}).drop("_gs", "_each")
        room = dict.fromkeys(gap, 1)
        # A target may be passed by what it may be missed by.
        gap = {s: g + allowed[s] for s, g in gap.items()}
    else:
        rows = rows.withColumn("_k", F.lit(1))
    inner = Window.partitionBy("_s", "_b").orderBy("_u", key, "_c", "_k").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    gap = dict(gap)
    now = rows.withColumn("_in", F.lit(0))
    for copy in (1, 2):
        # The second time over, what was taken once may be taken again.
        closed = {s for s in gap if room[s] < copy}
        while open_ := [[s, g] for s, g in gap.items() if g >= 1 and s not in closed]:
            fits = (F.col("_in") < copy) & (F.col("size") <= F.col("_gap"))
            tried = now.join(F.broadcast(_literal(spark, open_, "_gs int, _gap double")), F.col("_gs") == F.col("_s"), "left").drop("_gs")
            tried = tried.withColumn("_w", F.when(F.coalesce(fits, F.lit(False)), F.col("size")))
            sums = tried.groupBy("_s", "_b").agg(F.sum("_w").alias("w"))
            lead = sums.select("_s", "_b", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("_lead"))
            new = F.coalesce(F.col("_w").isNotNull() & (F.col("_lead") + F.sum("_w").over(inner) <= F.col("_gap")), F.lit(False))
            now = stash(tried.join(lead, ["_s", "_b"]).withColumn("_new", new).withColumn("_in", F.col("_in") + F.col("_new").cast("int")).drop("_lead", "_gap", "_w"), "mixorder")
            took = {r["_s"]: r.w for r in now.where("_new").groupBy("_s").agg(F.sum("size").alias("w")).collect()}
            closed |= {s for s, _ in open_ if s not in took}
            gap = {s: g - took.get(s, 0) for s, g in gap.items()}
            now = now.drop("_new")
    if by_size:
        gap = {s: g - allowed[s] for s, g in gap.items()}
    # One more where that comes nearer to a target that is missed.
    rooms = _literal(spark, [[s, room[s], g] for s, g in gap.items() if g > allowed.get(s, g)], "_gs int, _room int, _gap double")
    over = now.join(F.broadcast(rooms), F.col("_gs") == F.col("_s")).where((F.col("_in") < F.col("_room")) & (F.col("size") < 2 * F.col("_gap")))
    last = over.groupBy("_s").agg(F.min(F.struct("size", "_in", "_u", key, "_c", "_k")).alias("m")).select("_s", F.col(f"m.{key}").alias(key), F.col("m._c").alias("_c"), F.col("m._k").alias("_k"), F.col("m.size").alias("more"))
    gap |= {r["_s"]: gap[r["_s"]] - r.more for r in last.collect()}
    now = now.join(F.broadcast(last.withColumn("_more", F.lit(1)).drop("more")), ["_s", key, "_c", "_k"], "left").withColumn("_in", F.col("_in") + F.coalesce("_more", F.lit(0)))
    return now.where("_in > 0").groupBy("_s", key, "_c").agg(F.sum("_in").cast("int").alias("_in")), gap


def _dealt(rows: DataFrame, each: list, key: str, shards: int, seed: int) -> DataFrame:
    """Adds taken, shards and slot hashes: blocks of each copy go to shards as the tree says."""
    spark = rows.sparkSession
    rows = stash(rows, "mixtaken")
    units = rows.where("copies > 0").select("_s", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_k"), "_b").distinct()
    # Blocks of a source in the order of copies and hashes; their numbers stay small beside the rows'.
    ranked = units.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("_k", "_b")) - 1)
    count = {r["_s"]: r["n"] for r in units.groupBy("_s").agg(F.count("*").alias("n")).collect()}
    tree = splitting_tree([count.get(k, 0) for k in range(len(each))], shards, seed)
    # Which of its blocks a source gives to which shard is a matter of their order, which is random already.
    cuts = _literal(spark, [[k, np.cumsum(t).tolist()] for k, t in enumerate(tree)], "_cs int, _cuts array<bigint>")
    placed = ranked.join(F.broadcast(cuts), F.col("_cs") == F.col("_s")).withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_r"))).cast("int"))
    by_block = placed.groupBy("_s", "_b").agg(F.sort_array(F.collect_list(F.struct("_k", "shard"))).alias("_p"))
    out = rows.join(by_block, ["_s", "_b"], "left")
    mine = F.filter(F.coalesce("_p", F.array().cast("array<struct<_k:int,shard:int>>")), lambda x: x["_k"] <= F.col("copies"))
    return out.select(
        "doc_id", "source", key, "_c", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.transform(mine, lambda x: x["shard"]).alias("shards"), _hash(seed + 5, key, "_c").alias("place"),
    )


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.size(words_of(F.col("text"))).cast("long"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, shards of every row."""
    rows = _sized(docs.select("doc_id", "text", "source")).select("doc_id", "source", "size", F.xxhash64("doc_id", "source", "text").alias("_row"))
    return plan_mix(rows).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """The mixed documents: columns of the input, a row for each copy taken, in shuffled order in each output shard."""
    # The row goes along as one column, so that a user's columns can't clash with these.
    rows = docs.select(F.struct("*").alias("_doc"), F.xxhash64("doc_id", "source", "text").alias("_row"), "doc_id", "source", "text")
    plan = plan_mix(_sized(rows.select("doc_id", "source", "text", "_row")).select("doc_id", "source", "_row", "size"), shards=shards, seed=seed)
    # Equal rows share their plan's rows by sum: copies of a group of equals are dealt to the group.
    taken = plan.where("copies > 0").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_c", "shards", "place"))).alias("_t"))
    rows = rows.select("_doc", "_row")
    nth = Window.partitionBy("_row").orderBy("_row")
    if plan.where("_c > 1").limit(1).count():
        rows = rows.withColumn("_c", F.row_number().over(nth))
    else:
        rows = rows.withColumn("_c", F.lit(1))
    mine = F.flatten(F.transform(F.filter("_t", lambda x: x["_c"] == F.col("_c")), lambda x: F.transform(x["shards"], lambda s, k: F.struct(s.alias("shard"), F.xxhash64(x["place"], k).alias("place")))))
    out = rows.join(taken, "_row").withColumn("_m", F.explode(mine))
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = out.repartition(parts, F.col("_m.shard"), F.pmod(F.col("_m.place"), F.lit(parts // shards))).sortWithinPartitions("_m.shard", "_m.place")
    return out.select("_doc.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
