"""Tables of a corpus folder, and the works and chunks that they hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share; only a local master may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="lexforge-shared-")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder under the shared one."""
    return f"{shared_folder(spark)}/lexforge-{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so that later plans start from it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt out to all cores where their files have fewer splits, as small tables of few files have."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works without their status: id, title (first line), content, author and dynasty; dealt out for searches, which work long on each text."""
    documents = dealt(load(spark, sf_dir, "documents"))
    return documents.select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("content"), F.col("source").alias("author"), F.col("lang").alias("dynasty"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status and deletion of works that have labels: id, status and deleted."""
    status = F.when(F.col("quality") == 1, "published").otherwise("archived")
    return load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), status.alias("status"), (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works: id, title (first line), content, author, dynasty, status and deleted (from labels)."""
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "quality", "toxic")
    status = F.when(F.col("label_id").isNull(), "draft").when(F.col("quality") == 1, "published").otherwise("archived")
    return (
        load(spark, sf_dir, "documents")
        .join(labels, F.col("doc_id") == F.col("label_id"), "left")
        .select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("content"), F.col("source").alias("author"), F.col("lang").alias("dynasty"), status.alias("status"), (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"))
    )


def line_chunks(rows: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """Non-blank trimmed lines with their number in the text and their place among the others, restarting for each row.

    Adds chunk_id (key and line; beyond a million lines a negative hash of both, which meets no other), line_no, chunk_index (long) and text; carriage returns count as line ends.
    The place comes from the array of lines, so no shuffle is needed.
    """
    flat = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.filter(F.transform(F.split(flat, "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("n"), F.trim(x).alias("t"))), lambda x: x["t"] != "")
    others = [c for c in rows.columns if c not in (text, "chunk_id", "line_no", "chunk_index", "text")]
    return rows.select(*others, F.posexplode(lines).alias("chunk_index", "line")).select(
        *others, F.when(F.col("line.n") < 1_000_000, F.col(key) * 1_000_000 + F.col("line.n")).otherwise(-F.shiftrightunsigned(F.xxhash64(key, "line.n"), 1)).alias("chunk_id"), F.col("line.n").alias("line_no"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("line.t").alias("text")
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries: query_id and question, their first sentence."""
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.trim(F.split("text", r"\.")[0]).alias("question"))


def ranked(*order: Column, by: str | list[str] = "query_id", name: str = "rank"):
    """A transformation that numbers rows from 1 within by, as a long."""
    by = [by] if isinstance(by, str) else by
    return lambda df: df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top(df: DataFrame, k: int, *order: Column, by: str | list[str] = "query_id", name: str = "rank") -> DataFrame:
    return df.transform(ranked(*order, by=by, name=name)).where(F.col(name) <= k)
