"""N-gram Jaccard join with a token-group matrix.

Operator 8. Documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more are linked; the
result is each document's component. Documents with equal sets form a class, which is one node from then on.

1. Reach. Shingles are ordered by hash. Two linked sets share at least ``_needed`` of the first ``_reach`` shingles
   of either; classes that share fewer of theirs with other classes have no link and leave. This is exact.
2. Groups. Remaining classes are compared with the most typical classes among those that share one of their least
   shingles: similar documents form a group, without pairs inside it. Components of these links are the groups.
3. Filter. A class counts how many of its shingles other groups hold, for each range of sizes that a linked class may
   have. Where none suffices, all its links are inside its group, and it leaves; as others then hold less, that goes
   on while many leave. Typical classes are known better then: who is left tries those, and the groups grow.
4. Matrix. One row for each shingle and group: the union of the group's members, with their sizes. Shingles of at most
   ``RARE`` groups are rare. A class's overlap with any member of a group is bounded by its rare shingles in the
   union and the frequent ones of both sides; groups below 6/7 of the smaller class stay closed. Where the
   frequent shingles alone may suffice, the class asks with the rarest of these, by ranges of both sizes.
5. Open. Each qualifying pair of groups, then of a class and a group, is tried with a likely member. Those that
   are in different components still are compared by members.

Shingles and classes are told apart by 64-bit hashes.

Defined results: a null text, or one without words, has an empty set and links with nothing; a text of fewer than
five words has one shingle, all its words. Repeated rows have equal sets. A row without doc_id links with nothing
and gets a null component. Rows of one doc_id with several texts are nodes by text, named by the same id. Only
doc_id and text are read; no rows give no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import connected_components, discard, has_word, release, stash, table
from quern.llm.wordhash import pieces, sequence_hashes, word_hashes

SHINGLE = 5
#: Least similarity: 3 / 4.
NUM, DEN = 3, 4
#: Rows up to which a list of ids is broadcast (16 bytes each); beyond, the join is by shuffle.
SMALL = 500_000
#: Least shingles by hash over which classes look for a typical class, and of how many such they try.
KEYS, TRIES = 8, 2
#: Turns of that, and how many classes one copy of a typical class's shingles is compared with.
TURNS, SALT = 2, 2000
#: Ranges of shingles whose shuffles follow one another.
RANGES = 2
#: Very common shingles are looked for in one class of SAMPLE, and told apart from the rest if SEEN or more of those hold them.
SAMPLE, SEEN, COMMON = 64, 8, 20_000
#: Classes whose counts are summed up together.
BLOCK = 50_000
#: Groups up to which a shingle is rare.
RARE = 32
#: Sizes are told apart by ranges of this ratio; those of a linked set are at most STEPS ranges away.
RATIO, STEPS = 1.1, 4


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    words, at = word_hashes(column, lower=True)
    grams = sequence_hashes(words, SHINGLE).view(np.int64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        # Few words: one hash of all, with their number.
        whole = b - a < SHINGLE
        out.append(np.unique(grams[a : b - SHINGLE + 1]) if not whole else (sequence_hashes(np.r_[words[a:b], np.uint64(b - a)], b - a + 1).view(np.int64) if b > a else np.zeros(0, np.int64)))
    return out


def _name(toks: np.ndarray) -> int:
    """The class of a set."""
    return xxhash.xxh3_64_intdigest(toks.tobytes()) - 2**63


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))


def _members(batches):
    """doc_id, n, k, ext of texts with words. Of the copies in one task only the first has ext."""
    known: set[int] = set()
    for batch in batches:
        for part in pieces(batch, 1):
            sets = shingle_sets(part.column(1))
            names = [_name(x) for x in sets]
            n = [len(x) for x in sets]
            ext = []
            for x, k in zip(sets, names, strict=True):
                # As _reach has it.
                ext.append(x[:0] if k in known else x[: len(x) - -(-len(x) * NUM // DEN) + -(-len(x) // 8)])
                known.add(k)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array(names, pa.int64()), _lists(ext)], names=["doc_id", "n", "k", "ext"])


def _wanted(batches):
    """k, sc, toks of texts whose class is the wanted one. Batches: want, text, sc."""
    for batch in batches:
        for part in pieces(batch, 1):
            sets = shingle_sets(part.column(1))
            good = [_name(x) == w for x, w in zip(sets, part.column(0).to_pylist(), strict=True)]
            kept = part.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), _lists([x for x, g in zip(sets, good, strict=True) if g])], names=["k", "sc", "toks"])


def _share(n: Column) -> Column:
    """Least overlap of a set of n with any linked one."""
    return F.ceil(n * NUM / DEN).cast("int")


def _share_above(n: Column) -> Column:
    """Least overlap of a set of n with a linked one of n or more: NUM (n + n) / (NUM + DEN)."""
    return F.ceil(n * (2 * NUM) / (NUM + DEN)).cast("int")


def _reach(n: Column) -> Column:
    return (n - _share(n) + F.ceil(n / 8)).cast("int")


def _needed(n: Column) -> Column:
    # A linked set has 3n/4 shingles or more, and reaches one for each eight of those beyond what may differ.
    return F.ceil(n * NUM / (DEN * 8)).cast("int")


def _linked(both: Column, n: Column, m: Column) -> Column:
    return DEN * both >= NUM * (n + m - both)


def _by_id(big: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Inner join with ids (key, k), broadcast if it is small."""
    return big.join(F.broadcast(ids) if ids.count() <= SMALL else ids, key)


def _common(flat: DataFrame, distinct: str) -> DataFrame:
    """Shingles (tok) that a sample of classes proves to be very common and in several ``distinct``: at most COMMON, so that they can be broadcast."""
    some = flat.where(F.pmod(F.xxhash64("k"), F.lit(SAMPLE)) == 0).groupBy("tok").agg(F.min(distinct).alias("lo"), F.max(distinct).alias("hi"), F.count("*").alias("seen"))
    return stash(some.where(f"lo <> hi AND seen >= {SEEN}").orderBy(F.desc("seen"), "tok").limit(COMMON).select("tok", F.lit(True).alias("common")), "common")


def _columns(batches, *names: str) -> list[np.ndarray]:
    """The columns of all batches of a task; shuffled by shingle without the common ones, a task has its share of the rows."""
    t = pa.Table.from_batches([b for b in batches if b.num_rows], schema=pa.schema([(n, pa.int64()) for n in names])) if (batches := list(batches)) else None
    return [t.column(n).to_numpy() for n in names] if t is not None else [np.zeros(0, np.int64)] * len(names)


def _edges_of(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.zeros(len(sorted_[0]), bool)
    new[:1] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _count_held(batches):
    """k, held: how many rows of each k have a tok that more than one g holds. Batches: tok, k, g."""
    tok, k, g = _columns(batches, "tok", "k", "g")
    if not len(tok):
        return
    order = np.argsort(tok, kind="stable")
    first = _edges_of(tok[order])
    several = np.minimum.reduceat(g[order], first) != np.maximum.reduceat(g[order], first)
    name, held = np.unique(k[order][np.repeat(several, np.diff(np.r_[first, len(tok)]))], return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(held.astype(np.int64))], names=["k", "held"])


def _held(flat: DataFrame) -> DataFrame:
    """k, held: how many shingles of flat (tok, k, g: long) of a class several g hold.

    What a sample proves to be common stays out of the shuffle by tok, so that no task gets a common tok's rows. Ranges of
    shingles follow one another, so that disk holds the shuffle of one range alone.
    """
    common = _common(flat, "g")
    marked = flat.join(F.broadcast(common), "tok", "left")
    parts = []
    for i in range(RANGES):
        dealt = marked.where(F.col("common").isNull() & (F.pmod("tok", F.lit(RANGES)) == i)).select("tok", "k", "g").repartition("tok")
        parts.append(stash(dealt.mapInArrow(_count_held, "k bigint, held bigint"), "held"))
        del dealt
        release(flat.sparkSession)
    parts.append(marked.where("common").groupBy("k").agg(F.count("*").alias("held")))
    return reduce(DataFrame.unionByName, parts).groupBy("k").agg(F.sum("held").alias("held"))


def classes_and_members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members: doc_id, n, k (class). Classes that may have links: k, doc_id, sc (part of shingles within reach that others share)."""
    rows = docs.where(F.col("doc_id").isNotNull() & has_word(F.col("text"))).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    wide = stash(rows.mapInArrow(_members, f"doc_id {kind}, n int, k bigint, ext array<bigint>"), "sets")
    flat = wide.select("k", F.explode("ext").alias("tok")).withColumn("g", F.col("k"))
    held = _held(flat)
    classes = wide.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.sum((F.size("ext") > 0).cast("int")).alias("copies"))
    # Copies of several tasks hold the same shingles, so each counted that many times.
    alive = classes.join(held, "k").where(F.col("held") >= _needed(F.col("n")) * F.col("copies"))
    alive = stash(alive.select("k", "doc_id", (F.col("held") / F.col("copies") / _reach(F.col("n"))).alias("sc")), "alive")
    members = stash(wide.select("doc_id", "n", "k"), "members")
    del flat, held, classes
    discard(wide)
    release(docs.sparkSession)
    return members, alive


def _typical(sets: DataFrame, turn: int, degree: DataFrame | None, group: DataFrame | None) -> DataFrame:
    """Links (a, b) of classes to typical ones: for each of a class's least shingles the class there that is linked most, then shares most.

    Each turn takes other shingles. Classes of one group are not compared again.
    """
    scored = sets.select("k", "sc", "toks")
    scored = scored.withColumn("deg", F.lit(0)) if degree is None else scored.join(degree.select(F.col("b").alias("k"), "deg"), "k", "left").fillna(0, ["deg"])
    keys = scored.select("k", "sc", "deg", F.explode(F.slice("toks", 1 + KEYS * turn, KEYS)).alias("tok"))
    best = keys.groupBy("tok").agg(F.max(F.struct("deg", "sc", "k")).alias("b")).select("tok", F.col("b.k").alias("b"), F.col("b.deg").alias("bdeg"))
    votes = keys.select("k", "tok").join(best, "tok").where("k <> b").groupBy("k", "b").agg(F.count("*").alias("v"), F.max("bdeg").alias("bdeg"))
    if group is not None:
        of = group.withColumnRenamed("component", "g")
        votes = votes.join(of.withColumnRenamed("node", "k"), "k", "left").join(of.select(F.col("node").alias("b"), F.col("g").alias("h")), "b", "left")
        votes = votes.where(~F.coalesce(F.col("g") == F.col("h"), F.lit(False)))
    picked = votes.groupBy("k").agg(F.slice(F.sort_array(F.collect_list(F.struct("bdeg", "v", "b")), asc=False), 1, TRIES).alias("p"))
    pairs = stash(picked.select("k", F.explode("p.b").alias("d")), "tries")
    return _compared(sets.select("k", F.size("toks").alias("n"), "toks"), pairs)


def _grown(links: DataFrame | None, found: DataFrame, name: str) -> tuple[DataFrame, DataFrame] | None:
    """links with those found, and the groups (node, component) they make; None if none were found."""
    found = stash(found, name)
    if not found.limit(1).count():
        discard(found)
        return None
    links = found if links is None else stash(links.unionByName(found), "links")
    return links, stash(connected_components(links), "groups")


def _grouped(sets: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Links (a, b) to typical classes, and the groups (node, component) that they make; None if there are none."""
    links = group = degree = None
    for turn in range(TURNS):
        grown = _grown(links, _typical(sets, turn, degree, group), "typical")
        if grown:
            links, group = grown
            degree = links.groupBy("b").agg(F.count("*").alias("deg"))
    return links, group


def _count_sizes(batches, blocks: int):
    """How many rows of each k have a tok that another g holds with a size of the range b + i, for each step i; packed. Batches: tok, k, g, b."""
    tok, k, g, b = _columns(batches, "tok", "k", "g", "b")
    if not len(tok):
        return
    order = np.lexsort((g, b, tok))
    tok, k, g, b = tok[order], k[order], g[order], b[order]
    first = _edges_of(tok, b)
    last = np.r_[first[1:], len(tok)]
    # Places of (tok, range), far enough apart that steps don't reach the next tok.
    at = np.searchsorted(_edges_of(tok), first, side="right") * 4096 + b[first]
    of = np.repeat(np.arange(len(first)), last - first)
    name, who = np.unique(k, return_inverse=True)
    c = np.zeros((len(name), 2 * STEPS + 1), np.int32)
    for i in range(2 * STEPS + 1):
        there = np.minimum(np.searchsorted(at, at + i - STEPS), len(at) - 1)
        found = at[there] == at + i - STEPS
        lo, hi = g[first[there]], g[last[there] - 1]
        c[:, i] = np.bincount(who[found[of] & ((lo[of] != g) | (hi[of] != g))], minlength=len(name))
    some = np.flatnonzero(c.any(axis=1))
    yield from _packed(name[some], c[some], blocks)


_PACKED = pa.schema([("block", pa.int32()), ("k", pa.list_(pa.int64())), ("c", pa.list_(pa.int32()))])


def _packed(k: np.ndarray, c: np.ndarray, blocks: int):
    """One row for each block of classes, so that a task sends few rows however many classes it has met."""
    block = (k.view(np.uint64) % np.uint64(blocks)).astype(np.int32)
    order = np.argsort(block, kind="stable")
    first = np.append(_edges_of(block[order]), len(k)).astype(np.int32)
    if len(k):
        ks = pa.ListArray.from_arrays(pa.array(first), pa.array(k[order]))
        cs = pa.ListArray.from_arrays(pa.array(first * c.shape[1]), pa.array(c[order].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(block[order][first[:-1]]), ks, cs], schema=_PACKED)


def _added(batches):
    """k, c: the counts of each class, summed up as they come. Batches: block, k, c."""
    k, c = np.zeros(0, np.int64), np.zeros((0, 2 * STEPS + 1), np.int64)
    for batch in batches:
        more = batch.column(2).flatten().to_numpy().reshape(-1, 2 * STEPS + 1)
        both = np.concatenate([k, batch.column(1).flatten().to_numpy()])
        k, who = np.unique(both, return_inverse=True)
        total = np.zeros((len(k), 2 * STEPS + 1), np.int64)
        np.add.at(total, who, np.concatenate([c, more]))
        c = total
    if len(k):
        yield pa.RecordBatch.from_arrays([pa.array(k), _lists(list(c))], names=["k", "c"])


def _sizes_met(part: DataFrame, blocks: int) -> DataFrame:
    """(k, c): for each class and range of sizes about its own, how many of its shingles a class of another group and that size holds.

    part: k, g, b (the range of its size), tok. Common shingles stay out of the shuffle, as in ``_held``.
    """
    common = _common(part, "k")
    marked = part.join(F.broadcast(common), "tok", "left")
    dealt = marked.where("common IS NULL").select("tok", "k", "g", F.col("b").cast("long").alias("b")).repartition("tok")
    often = marked.where("common").select(*part.columns)
    by_size = often.groupBy("tok", "b").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).groupBy("tok").agg(F.collect_list(F.struct("b", "lo", "hi")).alias("held"))
    # It has the common shingles alone, so that they needn't be told apart again.
    met = part.join(F.broadcast(stash(by_size, "often")), "tok")
    other = F.filter("held", lambda x: ((x["lo"] != F.col("g")) | (x["hi"] != F.col("g"))) & (F.abs(x["b"] - F.col("b")) <= STEPS))
    mask = F.aggregate(other, F.lit(0), lambda m, x: m + F.call_function("shiftleft", F.lit(1), x["b"] - F.col("b") + STEPS))
    met = met.select("k", mask.alias("mask")).groupBy("k").agg(F.array(*[F.sum(F.shiftright("mask", i).bitwiseAND(F.lit(1))).cast("long") for i in range(2 * STEPS + 1)]).alias("c"))
    packed = dealt.mapInArrow(lambda batches: _count_sizes(batches, blocks), "block int, k array<bigint>, c array<int>")
    return packed.repartition("block").mapInArrow(_added, "k bigint, c array<bigint>").unionByName(met)


def _outside(rows: DataFrame) -> DataFrame:
    """The rows (k, g, n, toks) that may have a link outside their group, by the sizes and the shingles that others hold."""
    flat = rows.select("k", "g", _sized(F.col("n")).alias("b"), F.explode("toks").alias("tok"))
    parts, blocks = [], max(16, rows.count() // BLOCK)
    for i in range(RANGES):
        parts.append(stash(_sizes_met(flat.where(F.pmod("tok", F.lit(RANGES)) == i), blocks), "met"))
        release(rows.sparkSession)
    each = reduce(DataFrame.unionByName, parts).groupBy("k").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(2 * STEPS + 1)]).alias("c"))
    sized = rows.select("k", "n").join(each, "k")
    b = F.floor(F.log("n") / F.lit(math.log(RATIO)))

    def enough(i: int) -> Column:
        # The least size of the range; a little less than it may be is safe.
        m = F.greatest(F.ceil(F.col("n") * NUM / DEN), F.floor(F.pow(F.lit(RATIO), b + (i - STEPS)) - 1e-6))
        return F.col("c")[i] * (NUM + DEN) >= (F.col("n") + m) * NUM

    kept = stash(sized.where(reduce(Column.__or__, [enough(i) for i in range(2 * STEPS + 1)])).select("k"), "kept")
    for part in parts:
        discard(part)
    left = stash(_by_id(rows, kept, "k"), "outside")
    discard(kept)
    return left


def _regrouped(rows: DataFrame, group: DataFrame | None) -> DataFrame:
    """rows with g, the group of k: itself if it has none."""
    if group is None:
        return rows.withColumn("g", F.col("k"))
    rows = rows.drop("g").join(group.select(F.col("node").alias("k"), F.col("component").alias("g")), "k", "left")
    return rows.withColumn("g", F.coalesce("g", "k"))


def _across(sets: DataFrame, links: DataFrame | None, group: DataFrame | None) -> DataFrame | None:
    """Groups (node, component) with the links between classes of different groups, by the token-group matrix."""
    rows = _regrouped(sets.select("k", F.size("toks").alias("n"), "toks"), group)
    # As in the first step, with other groups in the place of other classes.
    flat = rows.select("k", "g", "n", F.explode(F.slice("toks", 1, _reach(F.col("n")))).alias("tok"))
    held = rows.select("k", "n").join(_held(flat.select("tok", "k", "g")), "k").where(F.col("held") >= _needed(F.col("n"))).select("k")
    held = stash(held, "held")
    del flat
    release(sets.sparkSession)
    ask = stash(_by_id(rows, held, "k"), "ask")
    discard(sets)
    discard(held)
    while True:
        ask, ranked = _ranked(ask)
        # With all that is shared counted, typical classes are better known: link to those, and see who is left.
        grown = _grown(links, _compared(ranked, stash(_centres(ranked), "tries")), "typical")
        if not grown:
            break
        links, group = grown
        again = stash(_regrouped(ask, group), "ask")
        discard(ask)
        discard(ranked)
        ask = again
    discard(ask)
    open_ = stash(_qualifying(ranked), "open")
    # A group needs one link to another, and a class one to a group: most of the rest is in one component then.
    for who in (["g", "h"], ["k", "h"], None):
        if not open_.limit(1).count():
            break
        best = open_.groupBy(*who).agg(F.max(F.struct("ub", "k", "d")).alias("best")).select("best.k", "best.d").distinct() if who else _members_of(ranked, open_)
        grown = _grown(links, _compared(ranked, best), "first")
        if grown:
            links, group = grown
            k = group.select(F.col("node").alias("k"), F.col("component").alias("x"))
            h = group.select(F.col("node").alias("h"), F.col("component").alias("y"))
            left = open_.join(k, "k", "left").join(h, "h", "left").where(F.coalesce("x", "k") != F.coalesce("y", "h"))
            left = stash(left.select(*open_.columns), "left")
            discard(open_)
            open_ = left
    discard(ranked)
    return group


def _ranked(ask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may have a link outside their group; and of them k, g, n, toks (those in several groups, rarest first), r (how many of these are rare)."""
    # What leaves takes shingles with it that others counted, so go on as long as many leave.
    before, now = 0, ask.count()
    while now and (not before or now < 0.5 * before):
        left = _outside(ask)
        discard(ask)
        ask, before, now = left, now, left.count()
    flat = ask.select("k", "g", "n", F.explode("toks").alias("tok"))
    # Frequency is the number of groups. Shingles of one group are in no overlap that counts here.
    often = flat.groupBy("tok", "g").agg(F.lit(1).alias("one")).groupBy("tok").agg(F.count("*").alias("f")).where("f > 1")
    ranked = flat.join(often, "tok").groupBy("k", "g", "n").agg(F.sort_array(F.collect_set(F.struct("f", "tok"))).alias("t"))
    ranked = ranked.where(F.size("t") >= _share(F.col("n")))
    rare = F.size(F.filter("t", lambda x: x["f"] <= RARE))
    ranked = stash(ranked.select("k", "g", "n", F.col("t.tok").alias("toks"), rare.alias("r")), "ranked")
    del flat, often
    release(ranked.sparkSession)
    return ask, ranked


def _centres(ranked: DataFrame) -> DataFrame:
    """Pairs (k, d) of classes and typical ones of other groups: those with most frequent shingles that hold one of the class's most frequent."""
    often = F.size("toks") - F.col("r")
    best = ranked.select(F.struct(often.alias("q"), F.size("toks").alias("t"), "k", "g").alias("b"), F.explode("toks").alias("tok")).groupBy("tok").agg(F.max("b").alias("b"))
    keys = ranked.select("k", "g", F.explode(F.slice(F.reverse("toks"), 1, KEYS)).alias("tok"))
    votes = keys.join(best, "tok").where(F.col("g") != F.col("b.g")).groupBy("k", "b").agg(F.count("*").alias("v"))
    picked = votes.groupBy("k").agg(F.slice(F.sort_array(F.collect_list(F.struct("b.q", "v", "b.k")), asc=False), 1, TRIES).alias("p"))
    return picked.select("k", F.explode("p.k").alias("d"))


def _sized(n: Column) -> Column:
    return F.floor(F.log(n) / F.lit(math.log(RATIO))).cast("int")


def _frequent(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asks and answers by frequent shingles.

    Shingles go from the rarest to the most frequent. That at place i of t is the first one that a set of n has in common with a
    linked one of m only if NUM (n + m) <= (NUM + DEN) (t - i): up to ``most``. The smaller set asks, and rows meet by the ranges of both sizes.
    """
    n = F.col("n")
    placed = ranked.select("k", "g", "n", "r", F.size("toks").alias("t"), F.posexplode("toks").alias("i", "tok")).where("i >= r")
    placed = placed.select("k", "g", "n", "tok", "t", (F.floor((F.col("t") - F.col("i")) * (NUM + DEN) / NUM) - n).cast("int").alias("most")).where(F.col("most") >= _share(n))
    above = F.least(F.col("most"), F.floor(n * DEN / NUM))
    asks = placed.where("most >= n").withColumns({"b": _sized(n), "c": F.explode(F.sequence(_sized(n), _sized(above)))})
    answers = placed.withColumns({"c": _sized(n), "b": F.explode(F.sequence(_sized(_share(n)), _sized(F.least("most", "n"))))})
    return asks, answers.select(F.col("k").alias("d"), F.col("g").alias("h"), F.col("n").alias("m"), F.col("most").alias("top"), "tok", "t", "b", "c")


def _qualifying(ranked: DataFrame) -> DataFrame:
    """k, g, h, ub, d: groups h in which a class k may have a link, the bound of its overlap, and a likely member.

    Two sets share as many rare shingles as they share, and of frequent ones as many as the one with fewer of them has at most.
    """
    n, often = F.col("n"), F.size("toks") - F.col("r")
    rare = ranked.select("k", "g", "n", often.alias("q"), F.explode(F.slice("toks", 1, F.col("r"))).alias("tok"))
    # The matrix: each shingle of a group's union, with the sizes of the members that hold it.
    matrix = rare.groupBy(F.col("g").alias("h"), "tok").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("q").alias("hq"), F.max(F.struct("q", "k")).alias("d"))
    sizes = (F.col("g") != F.col("h")) & (F.col("hi") >= n) & (F.col("lo") * NUM <= n * DEN)
    met = rare.join(matrix, "tok").where(sizes).groupBy("k", "g", "n", "q", "h").agg(F.count("*").alias("v"), F.max("hq").alias("hq"), F.max("d").alias("d"))
    ub = F.col("v") + F.least("q", "hq")
    met = met.withColumn("ub", ub).where(ub >= _share_above(n)).select("k", "g", "h", "ub", F.col("d.k").alias("d"))
    # Sets that share no rare shingle share enough of the frequent ones.
    asks, answers = _frequent(ranked)
    matrix = answers.groupBy("h", "tok", "b", "c").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.max("top").alias("top"), F.max(F.struct("t", "d")).alias("d"))
    fits = (F.col("g") != F.col("h")) & (F.col("top") >= n) & (F.col("hi") >= n) & (F.col("lo") <= F.col("most"))
    asked = stash(asks.join(matrix, ["tok", "b", "c"]).where(fits).groupBy("k", "g", "n", "h").agg(F.max("d").alias("d")), "asked")
    if not asked.limit(1).count():
        return met
    high = F.slice("toks", F.col("r") + 1, F.greatest(often, F.lit(1)))
    union = ranked.withColumnRenamed("g", "h").join(asked.select("h").distinct(), "h", "left_semi").select("h", F.explode(high).alias("tok")).distinct()
    mine = ranked.join(asked.select("k").distinct(), "k", "left_semi").select("k", F.explode(high).alias("tok"))
    bound = asked.join(mine, "k").join(union, ["tok", "h"]).groupBy("k", "g", "n", "h").agg(F.count("*").alias("ub"), F.max("d").alias("d"))
    return met.unionByName(bound.where(F.col("ub") >= _share_above(n)).select("k", "g", "h", "ub", F.col("d.d").alias("d")))


def _members_of(ranked: DataFrame, open_: DataFrame) -> DataFrame:
    """Pairs (k, d) of classes and members of the groups open to them, that may be linked."""
    n, often = F.col("n"), F.size("toks") - F.col("r")
    asked = open_.select("k", "h").distinct()
    rare = ranked.select("k", "g", "n", often.alias("q"), F.explode(F.slice("toks", 1, F.col("r"))).alias("tok"))
    theirs = rare.select(F.col("k").alias("d"), F.col("g").alias("h"), F.col("n").alias("m"), F.col("q").alias("p"), "tok")
    size = (F.col("m") >= n) & (F.col("m") * NUM <= n * DEN)
    met = rare.join(asked, "k").join(theirs, ["tok", "h"]).where(size).groupBy("k", "n", "q", "d", "m", "p").agg(F.count("*").alias("v"))
    met = met.where((F.col("v") + F.least("q", "p")) * (NUM + DEN) >= (n + F.col("m")) * NUM).select("k", "d")
    asks, answers = _frequent(ranked)
    fits = (F.col("top") >= n) & (F.col("m") >= n) & (F.col("m") <= F.col("most"))
    return met.unionByName(asks.join(asked, "k").join(answers, ["tok", "h", "b", "c"]).where(fits).select("k", "d")).distinct()


def _compared(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The linked ones of pairs (k, d) of sets (k, n, toks), as (a, b). Shingles that toks leaves out are in no overlap.

    Many are compared with a typical class, so its shingles go to as many salts as that takes.
    """
    salts = pairs.groupBy("d").agg(F.ceil(F.count("*") / SALT).cast("int").alias("s"))
    b = _by_id(sets.select(F.col("k").alias("d"), F.col("n").alias("nb"), F.col("toks").alias("y")), salts, "d").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = pairs.select("k", "d").join(salts, "d").withColumn("salt", F.pmod(F.xxhash64("k"), F.col("s")).cast("int")).drop("s")
    a = _by_id(sets.select("k", F.col("n").alias("na"), F.col("toks").alias("x")), dealt, "k")
    both = a.join(b, ["d", "salt"])
    return both.where(_linked(F.size(F.array_intersect("x", "y")), F.col("na"), F.col("nb"))).select(F.col("k").alias("a"), F.col("d").alias("b"))


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members: doc_id, n, k (class). Classes: k, c (its component's node), component_id."""
    spark = docs.sparkSession
    members, alive = classes_and_members(docs)
    wanted = alive.select("doc_id", F.col("k").alias("want"), "sc")
    texts = _by_id(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), wanted, "doc_id").dropDuplicates(["doc_id", "want", "text"])
    sets = stash(texts.select("want", "text", "sc").mapInArrow(_wanted, "k bigint, sc double, toks array<bigint>"), "tokens")
    del texts
    release(spark)
    found = _across(sets, *_grouped(sets))
    release(spark)
    return members, classes_named(members, found)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row with a doc_id and a word."""
    members, named = _components(docs)
    return members.select("doc_id", "n", "k").join(named, "k").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def classes_named(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """k with c, its component, and component_id: the least doc_id of any class in that."""
    classes = members.groupBy("k").agg(F.min("doc_id").alias("least"))
    joined = _regrouped(classes, found).select("k", "least", F.col("g").alias("c"))
    low = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    return joined.join(low, "c").select("k", "c", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    some = jaccard_components(docs)
    # Rows without words, or without an id, are their own component.
    empty = docs.where(F.col("doc_id").isNull() | ~has_word(F.col("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = empty.select("doc_id", "text").mapInArrow(_members, f"doc_id {kind}, n int, k bigint, ext array<bigint>")
    rest = rest.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(rest)


def _of_class(batches):
    """Rows whose text is of the class in the first column, without that column. Batches: want, text, others."""
    for batch in batches:
        for part in pieces(batch, 1):
            good = [_name(x) == w for x, w in zip(shingle_sets(part.column(1)), part.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(part.filter(pa.array(good, pa.bool_())).columns[2:], names=part.schema.names[2:])


def near_duplicates_removed(docs: DataFrame) -> DataFrame:
    """Columns of the input, one row of each component: a text of the least doc_id in it. Rows without doc_id or words stay.

    Of several texts of that doc_id in one component the one of least class stays, of its repeated rows one by least hash.
    """
    members, named = _components(docs)
    first = members.join(named, "k").groupBy("c").agg(F.min(F.struct("doc_id", "k")).alias("one")).select("one.*")
    rows = members.groupBy("doc_id").agg(F.count("*").alias("rows"))
    first = stash(first.join(rows, "doc_id"), "firsts")
    some_word = has_word(F.col("text"))
    apart = docs.where(F.col("doc_id").isNull() | ~some_word)
    rest = docs.where(F.col("doc_id").isNotNull() & some_word)
    own = F.col("doc_id") == F.col("_quern_id")
    # As a rule an id has one row, and that is all there is to know. Of the others the text's class has to be looked up.
    single = rest.join(first.where("rows = 1").select(F.col("doc_id").alias("_quern_id")), own, "left_semi")
    several = rest.join(first.where("rows > 1").select(F.col("doc_id").alias("_quern_id"), F.col("k").alias("_quern_want")), own)
    mixed = several.select("_quern_want", F.col("text").alias("_quern_text"), F.xxhash64("doc_id", "_quern_want").alias("_quern_of"), F.xxhash64(*docs.columns).alias("_quern_row"), *docs.columns)
    schema = T.StructType(mixed.schema.fields[2:])
    mixed = mixed.mapInArrow(_of_class, schema)
    order = Window.partitionBy("_quern_of").orderBy("_quern_row")
    mixed = mixed.withColumn("_quern_at", F.row_number().over(order)).where("_quern_at = 1")
    return single.select(*docs.columns).unionByName(mixed.select(*docs.columns)).unionByName(apart.select(*docs.columns))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
    ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) END) AS g FROM d
), t AS (SELECT doc_id, unnest(g) AS h FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM c JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y WHERE 100 * n >= 75 * (len(p.g) + len(q.g) - n)
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, m AS component_id
FROM s JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = s.doc_id
"""
