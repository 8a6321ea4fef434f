"""What the operators share: cutting lineage, row keys and free column names."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder named in spark.checkpoint.dir and read from there.

    Where that setting is missing, a local master, as in tests, gets a temporary folder; a cluster has to
    name a folder that all machines share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lexforge-checkpoint-"))
    return df.checkpoint()


def row_key(*columns: str, prefix: str = "key") -> list[Column]:
    """Two 64-bit columns that tell rows apart by content; equal rows share them."""
    return [F.xxhash64(F.lit(salt), *(F.col(c).isNull() for c in columns), *columns).alias(f"{prefix}{i}") for i, salt in enumerate((11, 29))]


def free(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until no column of df starts with it in any case."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def hash_sample(df: DataFrame, rows: int, *columns: str, seed: int = 1) -> DataFrame:
    """About rows of df's rows, all of them if there are no more: those whose hash of the columns is under their share.

    A threshold needs no sort of df: what reaches the driver doesn't grow with the number of partitions, as the
    parts of a top-k do. Rows that repeat share a hash, so that more may come; of more than twice rows the
    least by hash and columns stay, and reruns agree on them.
    """
    total = df.count()
    if total <= rows:
        return df
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    under = df.where(unit < int(rows / total * (1 << 53)))
    return under if under.limit(2 * rows + 1).count() <= 2 * rows else under.orderBy(unit, *columns).limit(2 * rows)


def copied(rows: DataFrame, count: str, copy: str, most: int) -> DataFrame:
    """Every row as often as its count column says, with the number of the copy from 0; rows of more than most copies are dealt out in pieces."""
    few = rows.where(F.col(count) <= most).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    pieces = rows.where(F.col(count) > most).withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(most).cast("long"))))
    last = F.least(F.col("__piece") + most, count) - 1
    return few.unionByName(pieces.repartition(*rows.columns[:1], "__piece").withColumn(copy, F.explode(F.sequence(F.col("__piece"), last))).drop("__piece"))
