"""Pieces that the operators of this package share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the word pattern [^\x20\x09-\x0D]+ besides the blank.
BLANKS = "\t\n\x0b\x0c\r"
#: Stands for a null doc_id where documents are ordered: after every other.
NO_ID = 2**63 - 1


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, although the body may use it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives an empty one."""
    plain = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(plain, " "), "")


def has_word(text: Column) -> Column:
    """Whether a text holds a word; cheaper than to count them. False for null."""
    return F.coalesce(F.translate(text, " " + BLANKS, "") != "", F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or in local mode, where unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: the lineage ends there, and an executor's loss costs nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    # Python tells the JVM what it has dropped from another thread, which looks for that once a second; and of a query that has just ended
    # some is only let go after a first collection.
    for _ in range(2):
        time.sleep(0.6)
        spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a stashed table that no later plan reads."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quern-" in folder and folder.split("quern-")[-1] and root.split("://")[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum joined back to the edges, until nothing
    changes. Every round ends in a stashed table. Self-loops and nulls are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = stash(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = large.unionByName(now.join(low, "u").where("v = m").select("u", "v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stash(small.select("e.*").where("u != v").distinct(), "stars")
        discard(now)
        now = after
        # Done when each node has one smaller one, and that none.
        sides = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("side")), F.struct(F.col("v").alias("x"), F.lit(2).alias("side")))).alias("e")).select("e.*")
        sides = sides.groupBy("x").agg(F.bit_or("side").alias("in"), F.count(F.when(F.col("side") == 1, 1)).alias("n"))
        if not sides.where("in = 3 OR n > 1").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    release(spark)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
