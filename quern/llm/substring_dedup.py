"""Substring dedup by prefix-partitioned suffix trees over words.

Operator 10. A window is 20 consecutive words; every word inside a window whose word sequence also starts
earlier in the corpus is removed.

1. Anchors. In each window the 8-word sequence of least hash is its anchor. Equal windows have equal anchors, so
   a window can only repeat where its anchor does. Anchors are a seventh of the positions; a grouped count
   leaves those that occur twice or more.
2. Suffixes. Around those anchors every window start is a suffix of the corpus, written as a path of three
   hashed edges (words 1-8, 9-14, 15-20) with its document and start.
3. Groups. Suffixes are split by a prefix of the path: one edge as a rule, two where the anchor is frequent, all
   three where it is very frequent. Several prefixes share a memory-sized bin. Bins of one whole path, which
   no longer prefix can split, are salted by document, and the firsts of their salts meet in a second round.
4. Subtrees. In a bin the sorted paths with their common depths are the subtree; an internal node of depth 20
   is a repeat, whose earliest leaf stays and whose other leaves are reported.
5. Reported starts are gathered per document as word runs and removed from the text.

Path edges are hashes of 64, 32 and 32 bits of 64-bit word hashes: 128 bits tell a path apart. Batches are hashed with numpy as a whole.

Defined results: null and empty texts have no words; texts of fewer than 20 words lose nothing. Documents are
ordered by doc_id, null last, then by a hash of the text. Rows of one doc_id and text are one document: repeated rows don't
make each other repeats, and a removal holds for each of them. Other texts of that doc_id, or of none, are documents of their own. Only doc_id and text are read; no rows give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import NO_ID, discard, release, stash, table
from quern.llm.wordhash import MULTIPLIER, mixed, pieces, sequence_hashes, word_hashes

WINDOW, ANCHOR = 20, 8
EDGES = ((0, 8), (8, 14), (14, 20))
#: Suffixes of one anchor from which a prefix takes two edges; eight times as many: three edges and salt.
FREQUENT = 20_000
#: Suffixes in a bin, about.
BIN = 500_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Low bits that hold a position where hashes are compared; hashes keep the others.
_PLACE = np.uint64((1 << 28) - 1)


def anchors(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts of all texts, the position of the anchor of each, and the hash of each 8-word sequence.

    ``at`` has where each text starts in ``words``. Of equal hashes the first position counts.
    """
    grams = sequence_hashes(words, ANCHOR)
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    reach, span = 1, WINDOW - ANCHOR + 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: n], low[span - reach : span - reach + n])
    room = np.repeat(at[1:], np.diff(at))[:n] - np.arange(n)
    start = np.flatnonzero(room >= WINDOW)
    return start, (low[start] & _PLACE).astype(np.int64), grams


_ANCHORS = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("sub", pa.int64()), ("pos", pa.int32())])


def _find_anchors(batches):
    for batch in batches:
        for part in pieces(batch, 1):
            words, at = word_hashes(part.column(1))
            _, pos, grams = anchors(words, at)
            # Anchors never go back as windows go on, so equal ones are neighbours.
            pos = pos[np.diff(pos, prepend=-1) != 0]
            doc = np.searchsorted(at, pos, side="right") - 1
            ids = part.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(grams[pos].view(np.int64)), pa.array(ids[doc], pa.int64()), pa.array(part.column(2).to_numpy()[doc], pa.int64()), pa.array((pos - at[doc]).astype(np.int32))], schema=_ANCHORS)


_SUFFIXES = pa.schema([("bin", pa.int32()), ("hot", pa.bool_()), ("e1", pa.int64()), ("e2", pa.int32()), ("e3", pa.int32()), ("doc", pa.int64()), ("sub", pa.int64()), ("pos", pa.int32())])


def _find_suffixes(frequent: int, bins: int):
    """Suffixes of the windows whose anchor repeats. Batches: doc, text, positions of such anchors, their counts, sub."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                words, at = word_hashes(part.column(1))
                start, pos, _ = anchors(words, at)
                many = np.zeros(len(words) + 1, np.int64)
                for k, (p, c) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                    many[at[k] + np.asarray(p.values)] = np.asarray(c.values)
                n = many[pos]
                start, n = start[n > 0], n[n > 0]
                if not len(start):
                    continue
                edges = [sequence_hashes(words[a:], b - a)[start] for a, b in EDGES]
                two = mixed(edges[0] * MULTIPLIER + edges[1])
                whole = mixed(two * MULTIPLIER + edges[2])
                hot = n > 8 * frequent
                key = np.where(hot, whole, np.where(n > frequent, two, edges[0]))
                doc = np.searchsorted(at, start, side="right") - 1
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key % np.uint64(bins)).astype(np.int32)), pa.array(hot), pa.array(edges[0].view(np.int64)), *(pa.array((e >> np.uint64(32)).astype(np.uint32).view(np.int32)) for e in edges[1:]), pa.array(ids[doc], pa.int64()), pa.array(part.column(4).to_numpy()[doc], pa.int64()), pa.array((start - at[doc]).astype(np.int32))], schema=_SUFFIXES
                )

    return run


_LEAVES = "first boolean, e1 bigint, e2 int, e3 int, doc bigint, sub bigint, pos int"
_LEAF_SCHEMA = pa.schema([("first", pa.bool_()), ("e1", pa.int64()), ("e2", pa.int32()), ("e3", pa.int32()), ("doc", pa.int64()), ("sub", pa.int64()), ("pos", pa.int32())])


def subtree(e1, e2, e3, doc, sub, pos) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the leaves, the depth in words at which each parts from the one before, and whether it leads its node of depth 20."""
    order = np.lexsort((pos, sub, doc, e3, e2, e1))
    a, b, c = e1[order], e2[order], e3[order]
    depth = np.zeros(len(order), np.int64)
    one = a[1:] == a[:-1]
    two = one & (b[1:] == b[:-1])
    depth[1:] = np.where(two & (c[1:] == c[:-1]), 20, np.where(two, 14, np.where(one, 8, 0)))
    return order, depth, depth < WINDOW


def _subtrees(keep_firsts: bool):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        e1, e2, e3, doc, sub, pos = (t.column(k).to_numpy() for k in ("e1", "e2", "e3", "doc", "sub", "pos"))
        order, _, leads = subtree(e1, e2, e3, doc, sub, pos)
        d, u, p = doc[order], sub[order], pos[order]
        node = np.flatnonzero(leads)[np.cumsum(leads) - 1]
        later = (d != d[node]) | (u != u[node]) | (p != p[node])
        out = later | (leads if keep_firsts else False)
        pick = order[out]
        for k in range(0, len(pick), 100_000):
            i = pick[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(~later[out][k : k + 100_000]), *(pa.array(x[i], f.type) for x, f in zip((e1, e2, e3, doc, sub, pos), list(_LEAF_SCHEMA)[1:], strict=True))], schema=_LEAF_SCHEMA)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds doc, which orders documents (doc_id, null as the largest long), and sub, which tells different texts of one doc apart (0 for a single text)."""
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("doc_id", "text")
    several = docs.select(doc, text.alias("h")).groupBy("doc").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
    several = stash(several.select("doc", F.lit(True).alias("_several")), "several")
    return docs.select("doc_id", "text", doc).join(several, "doc", "left").select("doc_id", "text", "doc", F.when(F.col("_several"), text).otherwise(F.lit(0)).cast("long").alias("sub"))


def repeated_windows(keyed: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc and sub with the array of starts of its windows that start earlier elsewhere."""
    spark = keyed.sparkSession
    rows = keyed.select("doc", "text", "sub")
    found = rows.mapInArrow(_find_anchors, "anchor bigint, doc bigint, sub bigint, pos int")
    # Repeated rows of a document count too; that only leaves more to look at.
    many = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    near = found.join(many.hint("shuffle_hash"), "anchor").groupBy("doc", "sub").agg(F.collect_list(F.struct("pos", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n"))).alias("a"))
    near = stash(near.select("doc", "sub", F.col("a.pos").alias("pos"), F.col("a.n").alias("n"), F.size("a").alias("size")), "anchors")
    del found, many
    release(spark)
    total = (near.agg(F.sum("size")).first()[0] or 0) * 7
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BIN + 1)
    texts = rows.join(near.hint("shuffle_hash"), ["doc", "sub"]).select("doc", "text", "pos", "n", "sub")
    suffixes = texts.mapInArrow(_find_suffixes(frequent, 8 * bins), "bin int, hot boolean, e1 bigint, e2 int, e3 int, doc bigint, sub bigint, pos int")
    if (near.select(F.max(F.array_max("n"))).first()[0] or 0) > 8 * frequent:
        suffixes = stash(suffixes, "suffixes")
        hot = suffixes.where("hot").repartition(bins, "bin", F.pmod(F.xxhash64("doc", "sub"), F.lit(bins))).drop("hot", "bin")
        local = stash(hot.mapInArrow(_subtrees(True), _LEAVES), "salted")
        whole = F.pmod(F.xxhash64("e1", "e2", "e3"), F.lit(8 * bins)).cast("int").alias("bin")
        cold = suffixes.where("NOT hot").drop("hot").unionByName(local.where("first").select(whole, "e1", "e2", "e3", "doc", "sub", "pos"))
        early = local.where("NOT first").select("doc", "sub", "pos")
    else:
        cold, early = suffixes.drop("hot"), None
    leaves = cold.repartition(bins, "bin").drop("bin").mapInArrow(_subtrees(False), _LEAVES).select("doc", "sub", "pos")
    leaves = leaves if early is None else leaves.unionByName(early)
    out = stash(leaves.groupBy("doc", "sub").agg(F.collect_set("pos").alias("starts")), "repeats")
    del suffixes, cold, early, leaves, texts
    discard(near)
    release(spark)
    return out


def _covered(n: int, starts: np.ndarray) -> np.ndarray:
    step = np.zeros(n + WINDOW + 1, np.int64)
    starts = starts[starts <= n - WINDOW]
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return np.cumsum(step)[:n] > 0


def _removals(batches, make):
    for batch in batches:
        rows = []
        for text, starts in zip(batch.column(1), batch.column(2), strict=True):
            words = _WORD.findall(text.as_py() or "")
            gone = _covered(len(words), np.asarray(starts.values, np.int64)) if starts.is_valid else np.zeros(len(words), bool)
            rows.append(make(words, gone))
        yield batch, rows


def _joined(docs: DataFrame, frequent: int) -> DataFrame:
    rows = _keyed(docs)
    return rows.join(repeated_windows(rows, frequent).hint("shuffle_hash"), ["doc", "sub"], "left").select("doc_id", "text", "starts")


def substring_dedup(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept: the words left, joined by one blank; text stays as it was."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, rows in _removals(batches, lambda w, gone: (len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g))):
            n, r, k = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.string())], names=["doc_id", "text", "n_words", "n_removed", "kept"])

    return _joined(docs, frequent).mapInArrow(run, f"doc_id {kind}, text string, n_words bigint, n_removed bigint, kept string")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT r, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM s),
c AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM f WHERE k > 1),
a AS (SELECT r, list(p) AS gone FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""
