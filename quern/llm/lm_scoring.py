"""Cross-entropy difference of matched target and background n-gram models.

Operator 6. Both models are interpolated bigram models over one vocabulary: every word of the documents. The target model
counts the documents labelled as good, the background model counts every document. A document's score is the mean over its
words of the target's loss less the background's: the lower, the more it reads like the target.

1. Words (by 64-bit hash) are counted over all documents, in a written table that keeps every one.
2. Bigrams go in ``RANGES`` ranges of their first word, one after the other, so that only a part of them is on disk at
   once. Each is counted, none is left out; counts of both its words are joined to it, and its difference of losses is
   written, packed by bucket of its hash. A text's first word is a bigram that follows ``START``.
3. Each piece of documents is written with its bigrams packed by bucket likewise. Buckets of bigrams and of differences
   meet in one shuffle, and are summed by document. A task holds one bucket's differences at a time.

Words of at least ``OFTEN`` of all words and bigrams of at least ``OFTEN_PAIR`` are looked up in a broadcast table instead, with
the same result: a join by them would deal many rows to one task. All others are rare, and joins need no salt.

The target model counts every document labelled as good. Their doc_ids are broadcast up to ``TARGETS`` of them; with more
the documents meet them in a shuffle, and are written once with their label.

Defined results: a null or empty text has no words and a null score. With no target document, or no words, the two
models are the same and scores are 0 (null without words). Null labels and doc_ids label nothing. Several labels
of one document: good if any is. Repeated rows count as often as they occur. Only doc_id, text and the labels'
doc_id and quality are read; no rows give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import discard, release, stash, table
from quern.llm.wordhash import MULTIPLIER, mixed, pieces, word_hashes

#: Shares of all words and of all bigrams from which they are broadcast.
OFTEN = 2e-5
OFTEN_PAIR = 2e-6
#: Ranges of first words that are counted and joined one after the other.
RANGES = 4
#: Words of the corpus for a bucket, and the least number of buckets.
BUCKET = 1_000_000
BUCKETS = 64
#: Stands before the first word of a text.
START = 0
#: Most target documents whose doc_ids are broadcast.
TARGETS = 5_000_000
#: Weight of the bigram estimate.
MIX = 0.7


def _word_counts(batches):
    # Counts of a piece at a time, so that memory doesn't follow the partition.
    for batch in batches:
        for part in pieces(batch, 0, rows=8192, size=16_000_000):
            words, at = word_hashes(part.column(0), lower=True)
            yield _counted("word", words.view(np.int64), np.repeat(part.column(1).to_numpy(), np.diff(at)))


def _counted(name: str, keys: np.ndarray, good: np.ndarray) -> pa.RecordBatch:
    """Each key with its number of rows, and of rows of the target."""
    key, n = np.unique(keys, return_counts=True)
    mine, m = np.unique(keys[good > 0], return_counts=True)
    t = np.zeros(len(key), np.int64)
    t[np.searchsorted(key, mine)] = m
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(t, pa.int64())], names=[name, "n", "t"])


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * MULTIPLIER + second)


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word of the texts the word before it (START for a first one) and itself; and n + 1 offsets of texts."""
    words, at = word_hashes(column, lower=True)
    first = np.r_[np.uint64(START), words[:-1]] if len(words) else words
    first[at[:-1][at[:-1] < len(words)]] = START
    return first, words, at


def _in_range(first: np.ndarray, k: int) -> np.ndarray:
    return np.flatnonzero(first % np.uint64(RANGES) == k)


def _pair_counts(k: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, 0, rows=8192, size=16_000_000):
                first, second, at = _pairs(part.column(0))
                here = _in_range(first, k)
                good = np.repeat(part.column(1).to_numpy(), np.diff(at))[here]
                first, second = first[here], second[here]
                _, one, of = np.unique(_pair_keys(first, second), return_index=True, return_inverse=True)
                n, t = np.bincount(of, minlength=len(one)), np.bincount(of, weights=good, minlength=len(one)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first[one].view(np.int64), second[one].view(np.int64), n, t)], names=["first", "second", "n", "t"])

    return run


class Often:
    """Differences of losses of the bigrams that are broadcast, by their sorted keys."""

    def __init__(self, rows: list):
        pair = np.array([[r["first"], r["second"]] for r in rows], np.int64).reshape(-1, 2).view(np.uint64)
        keys = _pair_keys(pair[:, 0], pair[:, 1])
        order = np.argsort(keys)
        self.keys, self.d = keys[order], np.array([r.d for r in rows], np.float64)[order]

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a bigram is here, and its difference, or 0."""
        if not len(self.keys):
            return np.zeros(len(first), bool), np.zeros(len(first))
        keys = _pair_keys(first, second)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return found, np.where(found, self.d[at], 0.0)


def _buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of sorted keys, and the n + 1 offsets of their keys. A bucket is a range of keys."""
    of = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    here, start = np.unique(of, return_index=True)
    return here.astype(np.int64), np.r_[start, len(keys)]


def _cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes of each range of values."""
    return pa.array([values[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())


def _pack_documents(held, buckets: int, k: int):
    """Rows of two kinds: for a bucket, the rare bigrams of a piece of documents, each with its text and number; and for
    each document its key, words, and sum of the broadcast differences."""

    def run(batches):
        # The rows are written once, so that a partition and a place in it name a row of documents.
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch, 1, rows=8192, size=8_000_000):
                first, second, at = _pairs(part.column(1))
                text = np.repeat(np.arange(part.num_rows, dtype=np.uint32), np.diff(at))
                here = _in_range(first, k)
                first, second, text = first[here], second[here], text[here]
                found, d = held.value.find(first, second)
                near = np.bincount(text, weights=d, minlength=part.num_rows)
                keys, text = _pair_keys(first[~found], second[~found]), text[~found]
                order = np.argsort(keys, kind="stable")
                keys, text = keys[order], text[order]
                new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])][: len(keys)])
                m = np.diff(np.r_[new, len(keys)]).astype(np.uint32)
                keys, text = keys[new], text[new]
                of, cut = _buckets(keys, buckets)
                b, n = len(of), part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(of), pa.nulls(n, pa.int64())]),
                        pa.array(np.r_[np.full(b, base), base + np.arange(n)]),
                        *[pa.concat_arrays([_cut(x, cut), pa.nulls(n, pa.binary())]) for x in (keys, text, m)],
                        pa.concat_arrays([pa.nulls(b, pa.int64()), part.column(0)]),
                        pa.array(np.r_[np.zeros(b, np.int64), np.diff(at)]),
                        pa.array(np.r_[np.zeros(b), near]),
                    ],
                    names=["bucket", "base", "keys", "texts", "m", "doc", "n_tokens", "near"],
                )
                base += n

    return run


def _pack_differences(buckets: int, often: float):
    """Rows of two kinds: for a bucket, rare bigrams and their differences; and each bigram of at least often rows."""

    def run(batches):
        for batch in batches:
            first, second, n, d = (np.asarray(batch.column(i)) for i in range(4))
            rare = n < often
            keys = _pair_keys(first[rare].view(np.uint64), second[rare].view(np.uint64))
            order = np.argsort(keys)
            of, cut = _buckets(keys[order], buckets)
            b, k = len(of), int((~rare).sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(of), pa.nulls(k, pa.int64())]),
                    *[pa.concat_arrays([_cut(x, cut), pa.nulls(k, pa.binary())]) for x in (keys[order], d[rare][order])],
                    *[pa.concat_arrays([pa.nulls(b, pa.int64()), pa.array(x[~rare])]) for x in (first, second)],
                    pa.concat_arrays([pa.nulls(b, pa.float64()), pa.array(d[~rare])]),
                ],
                names=["bucket", "keys", "ds", "first", "second", "d"],
            )

    return run


def _sums(batches):
    """Sums of differences by document of rows sorted by bucket, its differences (base is null) first."""
    bucket, fresh, keys, d = None, [], np.zeros(0, np.uint64), np.zeros(0)
    for batch in batches:
        docs, sums = [], []
        for row in zip(*[batch.column(i) for i in range(6)]):
            if row[0].as_py() != bucket:
                bucket, fresh = row[0].as_py(), []
            own = np.frombuffer(row[2].as_buffer(), np.uint64)
            if row[1].as_py() is None:
                fresh.append((own.copy(), np.frombuffer(row[5].as_buffer(), np.float64).copy()))
                continue
            if fresh:
                keys, d = (np.concatenate([x[i] for x in fresh]) for i in (0, 1))
                order = np.argsort(keys)
                keys, d, fresh = keys[order], d[order], []
            text, m = (np.frombuffer(row[i].as_buffer(), np.uint32) for i in (3, 4))
            s = np.bincount(text, weights=m * d[np.searchsorted(keys, own)])
            there = np.unique(text)
            docs.append(row[1].as_py() + there.astype(np.int64))
            sums.append(s[there])
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(sums))], names=["base", "s"])


def target_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the target documents: all that are labelled good."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_good")).distinct()


def _keyed(pairs: DataFrame, often: DataFrame, side: str) -> DataFrame:
    """Adds _key: the word of one side, or for a frequent word a hash that spreads its rows and is no word's."""
    near = F.broadcast(often.select(F.col("word").alias("_often")))
    rows = pairs.join(near, F.col(side) == F.col("_often"), "left")
    return rows.select(*pairs.columns, F.when(F.col("_often").isNull(), F.col(side)).otherwise(F.xxhash64("first", "second")).alias("_key"))


def _with_counts(keyed: DataFrame, words: DataFrame, often: DataFrame, side: str) -> DataFrame:
    """Adds n and t of the bigrams' words of one side."""
    named = words.select(F.col("word").alias("_word"), F.col("n").alias("_n"), F.col("t").alias("_t"))
    near = F.broadcast(often.select(F.col("word").alias("_often"), F.col("n").alias("_on"), F.col("t").alias("_ot")))
    rows = keyed.join(named.hint("shuffle_hash"), F.col("_key") == F.col("_word"), "left").join(near, F.col(side) == F.col("_often"), "left")
    return rows.select(*[c for c in keyed.columns if c != "_key"], F.coalesce("_on", "_n").alias(f"{side}_n"), F.coalesce("_ot", "_t").alias(f"{side}_t"))


def _differences(counts: DataFrame, words: DataFrame, often: DataFrame, totals: tuple[int, int, int]) -> DataFrame:
    """first, second, n, d (target loss less background loss) of bigrams, from their counts in pieces."""
    n, t, size = totals
    # Dealt by the first word, which serves the sums and the join with its counts.
    pairs = _keyed(counts, often, "first").repartition("_key").groupBy("_key", "first", "second").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    rows = _with_counts(_keyed(_with_counts(pairs, words, often, "first"), often, "second"), words, often, "second")

    def gain(side: str, total: int) -> Column:
        # Add-one unigrams over the vocabulary and an unknown word.
        uni = (F.col(f"second_{side}") + 1) / F.lit(float(total + size + 1))
        given = F.when(F.col(f"first_{side}") > 0, F.col(side) / F.col(f"first_{side}")).otherwise(uni)
        return F.log(F.when(F.col("first") == START, uni).otherwise(MIX * given + (1 - MIX) * uni))

    return rows.select("first", "second", "n", (gain("n", n) - gain("t", t) if t else F.lit(0.0)).alias("d"))


def lm_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score (target loss less background loss for a word), selected (score below 0)."""
    spark = docs.sparkSession
    good = target_ids(labels)
    few = good.count() <= TARGETS
    rows = docs.join(F.broadcast(good) if few else good.hint("merge"), docs["doc_id"] == good["_good"], "left").select("text", F.col("_good").isNotNull().cast("int").alias("t"))
    if not few:
        rows = stash(rows, "labelled")
    words = stash(rows.mapInArrow(_word_counts, "word bigint, n bigint, t bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "words")
    n, t, size = (int(x or 0) for x in words.agg(F.sum("n"), F.sum("t"), F.count("*")).first())
    release(spark)
    often = words.where(F.col("n") >= OFTEN * n)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc"), "text")
    buckets = max(BUCKETS, n // BUCKET // RANGES)
    sums: list[DataFrame] = []
    for k in range(RANGES):
        counts = rows.mapInArrow(_pair_counts(k), "first bigint, second bigint, n bigint, t bigint")
        known = stash(
            _differences(counts, words, often, (n, t, size)).mapInArrow(
                _pack_differences(buckets, OFTEN_PAIR * n), "bucket bigint, keys binary, ds binary, first bigint, second bigint, d double"
            ),
            "differences",
        )
        release(spark)
        held = spark.sparkContext.broadcast(Often(known.where("bucket IS NULL").select("first", "second", "d").collect()))
        packed = stash(
            keyed.mapInArrow(_pack_documents(held, buckets, k), "bucket bigint, base bigint, keys binary, texts binary, m binary, doc bigint, n_tokens bigint, near double"), "packed"
        )
        none = F.lit(None)
        asked = packed.where("bucket IS NOT NULL").select("bucket", "base", "keys", "texts", "m", none.cast("binary").alias("ds"))
        given = known.where("bucket IS NOT NULL").select("bucket", none.cast("bigint").alias("base"), "keys", none.cast("binary").alias("texts"), none.cast("binary").alias("m"), "ds")
        met = asked.unionByName(given).repartition("bucket").sortWithinPartitions("bucket", F.col("base").asc_nulls_first())
        rare = met.mapInArrow(_sums, "base bigint, s double").groupBy("base").agg(F.sum("s").alias("s"))
        whole = packed.where("bucket IS NULL").select("base", "doc", "n_tokens", "near").join(rare, "base", "left")
        # Repeated rows share a key, and a mean.
        sums.append(stash(whole.groupBy("doc").agg(F.avg(F.col("near") + F.coalesce("s", F.lit(0.0))).alias("s"), F.max("n_tokens").alias("n_tokens")), "sums"))
        held.unpersist()
        for done in (known, packed):
            discard(done)
        release(spark)
    if not few:
        discard(rows)
    total = reduce(DataFrame.unionByName, sums).groupBy("doc").agg(F.sum("s").alias("s"), F.max("n_tokens").alias("n_tokens"))
    score = F.when(F.col("n_tokens") > 0, F.col("s") / F.col("n_tokens"))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc")).join(total, "doc").select("doc_id", "n_tokens", score.alias("score"), (score < 0).alias("selected"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
