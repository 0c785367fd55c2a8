"""Sources and sinks (S1-S8): forum CSV, image-id harvest, embedding store, cards JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TOPIC_CARD


def read_forum_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header whose quoted values may hold newlines and doubled quotes.

    ``multiLine`` files cannot be split; land them once as Parquet and read that.
    """
    r = spark.read.options(header=True, multiLine=True, escape='"', quote='"', mode="PERMISSIVE")
    return (r.schema(schema) if schema is not None else r.option("inferSchema", False)).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "ignore", partition_by: list[str] | None = None) -> None:
    """Parquet sink; the default ``ignore`` skips an existing output (no recompute)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def image_thread_ids(spark: SparkSession, glob: str) -> DataFrame:
    """Thread ids from image file names '<thread_id>!!...' (file content is never read)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*!!*")
             .option("recursiveFileLookup", "false").load(glob).select("path"))
    return files.select(F.regexp_extract("path", r"([^/]+?)!!", 1).alias("thread_id")).where(
        F.col("thread_id") != "").distinct()


def write_embeddings(vecs: DataFrame, path: str, model: str, mode: str = "ignore") -> None:
    """(thread_id, embedding) Parquet, and beside it one row of metadata: model, n, dim, dtype."""
    vecs.select("thread_id", F.col("embedding").cast("array<float>")).write.mode(mode).parquet(path)
    stored = vecs.sparkSession.read.parquet(path)
    stored.agg(F.lit(model).alias("model"), F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"),
               F.lit("float32").alias("dtype")).coalesce(1).write.mode(mode).json(f"{path.rstrip('/')}.meta")


def read_embeddings_meta(spark: SparkSession, path: str) -> dict:
    """What ``write_embeddings`` noted: model, n, dim, dtype."""
    return spark.read.schema("model string, n long, dim int, dtype string").json(f"{path.rstrip('/')}.meta").first().asDict()


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The store as (thread_id, embedding ARRAY<DOUBLE>); id -> row is an equi-join key."""
    return spark.read.parquet(path).select("thread_id", F.col("embedding").cast("array<double>"))


def write_cards(cards: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Topic cards as JSON lines."""
    cards.write.mode(mode).json(path)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Topic cards; a missing path is an empty result."""
    try:
        return spark.read.schema(TOPIC_CARD).json(path)
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for a missing path
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], TOPIC_CARD)
        raise
