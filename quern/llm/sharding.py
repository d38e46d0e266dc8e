"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Operator 2. Rows fall into source blocks by hash. Of each block exactly so many rows go to each shard as a
multivariate hypergeometric draw says, given the sizes of the blocks and the shards: this is the matrix of a
uniformly random assignment. Then rows are permuted inside their block, cut by the row of the matrix, exchanged,
and permuted again inside the shard, which numbers their slots. Shard sizes differ by one at most (law ``rows``).

The matrix has blocks x shards numbers and is drawn on the driver; rows only pass through windows of one
block's size: blocks and the sub-blocks of a shard hold ``BLOCK`` rows or so, however many rows a source has; rows that
are equal in doc_id and text share a block. All row work is DataFrame operations.

Results depend on the rows and the seed alone, so a lost executor's tasks are redone alike.

Defined results: a null text has size 1 and a null text_crc32. Rows that are equal in doc_id and text are
exchangeable. Null doc_ids are allowed. Columns named shard or slot are replaced, others kept. No rows give no rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import stash, table

SHARDS = 8
#: Rows of a block, about.
BLOCK = 2_000
#: Upper bound of blocks; beyond, blocks grow.
MOST_BLOCKS = 100_000


def communication_matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows to send from each block to each shard: sums are the blocks' sizes, and the shards' (equal, but for one)."""
    total = sum(blocks)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    draw = np.random.Generator(np.random.PCG64(seed))
    out = []
    for n in blocks:
        row = draw.multivariate_hypergeometric(left, n, method="marginals") if n else np.zeros(shards, np.int64)
        left = left - row
        out.append(row.tolist())
    return out


def _order(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """All columns of the input, shard (int from 0) and slot (long from 0, gapless in each shard)."""
    # The row goes along as one column, so that a user's columns can't clash with these.
    rows = docs.select(F.struct(*[c for c in docs.columns if c.lower() not in ("shard", "slot")]).alias("_doc"), _order(seed, "doc_id", "text").alias("_row"))
    n = rows.count()
    blocks = max(1, min(MOST_BLOCKS, n // BLOCK))
    rows = rows.withColumn("_block", F.pmod(_order(seed + 1, "_row"), F.lit(blocks)).cast("int"))
    # Equal rows have equal hashes; a block's copies are told apart by their rank only.
    sizes = {r["_block"]: r["n"] for r in rows.groupBy("_block").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([sizes.get(b, 0) for b in range(blocks)], shards, seed)
    cuts = [np.cumsum(r).tolist() for r in matrix]
    spark = docs.sparkSession
    # The matrix travels as a literal of its own size, blocks x shards.
    lines = [F.lit(json.dumps([[b, c] for b, c in enumerate(cuts)][k : k + 5000])) for k in range(0, blocks, 5000)]
    plan = spark.range(1).select(F.explode(F.array(*lines)).alias("j")).select(F.explode(F.from_json("j", "array<array<string>>")).alias("e"))
    plan = plan.select(F.col("e")[0].cast("int").alias("_block"), F.from_json(F.col("e")[1], "array<bigint>").alias("_cuts"))
    local = Window.partitionBy("_block").orderBy(_order(seed + 2, "_row"), "_row")
    ranked = rows.withColumn("_at", F.row_number().over(local) - 1).join(F.broadcast(plan), "_block")
    dealt = ranked.withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))).cast("int")).drop("_cuts")
    subs = max(1, n // shards // BLOCK)
    dealt = dealt.withColumn("_sub", F.pmod(_order(seed + 3, "_row", "_at"), F.lit(subs)).cast("int"))
    return _slots(dealt, seed)


def _slots(dealt: DataFrame, seed: int) -> DataFrame:
    """Second permutation: slots by sub-block, then by hash inside it."""
    dealt = stash(dealt, "dealt")
    counts = dealt.groupBy("shard", "_sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    lead = counts.select("shard", "_sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_lead"))
    inner = Window.partitionBy("shard", "_sub").orderBy(_order(seed + 4, "_row", "_at"), "_row", "_at", "_block")
    out = dealt.withColumn("slot", F.row_number().over(inner) - 1).join(lead, ["shard", "_sub"])
    return out.select("_doc.*", "shard", (F.col("slot") + F.col("_lead")).cast("long").alias("slot"))


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    # The text itself isn't exchanged: its digests stand for it.
    slim = docs.select("doc_id", F.sha2("text", 256).alias("text"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    out = shard(slim, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
