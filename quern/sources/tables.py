"""Sources and sinks: Parquet tables, JSON lines, query CSV, and the index layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query CSV with the columns sentence and video_id."""
    return spark.read.option("header", True).csv(path).select("sentence", "video_id")


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of (qid, query, vid, duration, relevant_windows), a row for each window; one with null ends where there is none."""
    rows = spark.read.schema("qid long, query string, vid string, duration double, relevant_windows array<array<double>>").json(path)
    return rows.select("qid", "query", "vid", "duration", F.explode_outer("relevant_windows").alias("w")).select("qid", "query", "vid", "duration", F.col("w")[0].alias("start"), F.col("w")[1].alias("end"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of videos."""
    return spark.read.option("multiLine", True).json(path)


def list_videos(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """video_id, path, bytes of the files of a folder, where it has no manifest. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("bytes"))
    return found.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("video_id"), "path", "bytes")


def save_results(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Raw results as JSON lines or CSV with a header."""
    writer = rows.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def markdown(rows: DataFrame, title: str) -> str:
    """A report's table as Markdown. Reports hold a row for each method."""
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows.toLocalIterator()]
    return "\n".join(lines) + "\n"


def save_index(protos: DataFrame, path: str) -> None:
    """Prototypes by k, so that a search of one k reads its folder only."""
    protos.write.mode("overwrite").partitionBy("k").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame vectors: ten rows of embeddings make a video, two seconds apart."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.expr("vec_id div 10").alias("video_id"), (F.col("vec_id") % 10).cast("int").alias("frame_no"), (F.col("vec_id") % 10 * 2.0).alias("ts"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("emb")
    )
