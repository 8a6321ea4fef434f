"""A vector store of parquet files: points are appended in generations, the newest of each id counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, vector array<float>, payload map<string,string>, deleted boolean, generation long"


def points(spark: SparkSession, path: str) -> DataFrame:
    """The newest live point of every id; none where the store has no files yet."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SCHEMA).drop("deleted", "generation")
    newest = rows.groupBy("id").agg(F.max_by(F.struct("vector", "payload", "deleted"), "generation").alias("p"))
    return newest.where("NOT p.deleted").select("id", "p.vector", "p.payload")


def check_dimension(rows: DataFrame, dimension: int) -> None:
    """Raise unless all vectors have this length."""
    bad = rows.where((F.size("vector") != dimension) | F.col("vector").isNull()).select("id").first()
    if bad:
        raise ValueError(f"point {bad.id} has another dimension than {dimension}")


def write(rows: DataFrame, path: str, deleted: bool, generation: int) -> None:
    """Append a generation; an empty one writes nothing."""
    if not rows.isEmpty():
        rows.select("id", "vector", "payload", F.lit(deleted).alias("deleted"), F.lit(generation).cast("long").alias("generation")).write.mode("append").parquet(path)


def upsert(rows: DataFrame, path: str, dimension: int, generation: int) -> None:
    check_dimension(rows, dimension)
    write(rows, path, False, generation)


def delete(ids: DataFrame, path: str, generation: int) -> None:
    write(ids.select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("map<string,string>").alias("payload")), path, True, generation)
