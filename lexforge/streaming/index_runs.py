"""Index runs: their state machine, and the pipeline chunk, embed, upsert with a published result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import manifest

NEXT = {("pending", "start"): "running", ("running", "succeed"): "succeeded", ("running", "fail"): "failed", ("pending", "cancel"): "cancelled", ("running", "cancel"): "cancelled"}


def next_status(status: Column, command: Column) -> Column:
    """The status after a command, null where it is not allowed."""
    moves = F.create_map(*(F.lit(x) for (a, b), c in NEXT.items() for x in (f"{a}:{b}", c)))
    return F.try_element_at(moves, F.concat_ws(":", status, command))


def run_states(commands: DataFrame) -> DataFrame:
    """The status of each run (run_id) after its commands in order of seq; forbidden ones leave it and are counted."""
    ordered = commands.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "command"))).alias("c"))
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).cast("long").alias("refused"))

    def step(a: Column, x: Column) -> Column:
        moved = next_status(a["status"], x["command"])
        return F.struct(F.coalesce(moved, a["status"]).alias("status"), (a["refused"] + F.when(moved.isNull(), 1).otherwise(0)).alias("refused"))

    return ordered.select("run_id", F.aggregate("c", start, step).alias("s")).select("run_id", "s.status", "s.refused")


def one_active(runs: DataFrame) -> DataFrame:
    """Versions with more than one pending or running run, which must not be."""
    return runs.where(F.col("status").isin("pending", "running")).groupBy("version_id").agg(F.count("*").alias("n")).where("n > 1")


POINTS = "vector_id string, chunk_id long, embedding array<float>, deleted boolean"


def new_run() -> str:
    """The name of a new run, whose points lie in a folder of its own and count once the manifest names it."""
    return f"run-{uuid.uuid4().hex}"


def write_run(rows: DataFrame, store_path: str, run: str) -> DataFrame:
    rows.select(F.col("vector_id").cast("string"), F.col("chunk_id").cast("long"), F.col("embedding").cast("array<float>"), F.col("deleted")).write.parquet(f"{store_path}/points/{run}")
    return rows.sparkSession.read.schema(POINTS).parquet(f"{store_path}/points/{run}")


def index_chunks(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], store_path: str, dimension: int) -> DataFrame:
    """Embed pending chunks, check the vectors, publish them, and give all chunks with their new status.

    embed adds an embedding column. Two phases: a run's points are written under a folder of their own, which no reader
    sees, and checked there; then the manifest names the run, by compare and swap. A failure before that takes the
    folder away again and gives the chunks back as failed. A crash between the phases leaves a folder that doesn't
    count; one after them, before the statuses are stored, is mended by running again: of several runs that
    hold a vector_id the newest counts, so that reruns and overlapping runs leave one point each.
    """
    spark, run = chunks.sparkSession, new_run()
    pending = chunks.where(F.col("status") == "pending")
    if pending.isEmpty():
        return chunks
    good = False
    try:
        written = write_run(embed(pending).withColumn("deleted", F.lit(False)), store_path, run)
        bad = F.col("embedding").isNull() | (F.size("embedding") != dimension) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
        twice = written.groupBy("vector_id").agg(F.count("*").alias("n")).where("n > 1 OR vector_id IS NULL")
        good = written.where(bad).isEmpty() and twice.isEmpty()
    except PySparkException:
        good = False
    if good:
        manifest.published(spark, f"{store_path}/manifest", lambda names: [*names, run])
    else:
        manifest.removed(spark, f"{store_path}/points/{run}")
    change = pending.select("chunk_id", F.lit("ready" if good else "failed").alias("status"))
    return ingest.updated(chunks, change, "chunk_id", "status")


def withdrawn(ids: DataFrame, store_path: str) -> None:
    """Publish a run that deletes the points of these vector_ids."""
    spark, run = ids.sparkSession, new_run()
    write_run(ids.select("vector_id", F.lit(None).alias("chunk_id"), F.lit(None).alias("embedding"), F.lit(True).alias("deleted")), store_path, run)
    manifest.published(spark, f"{store_path}/manifest", lambda names: [*names, run])


def runs_of(spark: SparkSession, store_path: str, names: list[str]) -> DataFrame:
    """All rows of the named runs with their generation, the run's place in the manifest."""
    rows = spark.createDataFrame([], f"{POINTS}, generation int")
    if names:
        # One scan of all runs; a row's generation comes from its folder's name.
        order = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i + 1)))
        read = spark.read.schema(POINTS).parquet(*(f"{store_path}/points/{n}" for n in names))
        rows = read.withColumn("generation", order[F.element_at(F.split(F.input_file_name(), "/"), -2)])
    return rows


def live_points(spark: SparkSession, store_path: str, names: list[str] | None = None) -> DataFrame:
    """The newest point of every vector_id in published runs, or those named: (vector_id, chunk_id, embedding, generation); withdrawn ones are none."""
    rows = runs_of(spark, store_path, manifest.current(spark, f"{store_path}/manifest")[1] if names is None else names)
    newest = rows.groupBy("vector_id").agg(F.max_by(F.struct("chunk_id", "embedding", "deleted", "generation"), "generation").alias("p"))
    return newest.where("NOT p.deleted").select("vector_id", "p.chunk_id", "p.embedding", "p.generation")


def compacted(spark: SparkSession, store_path: str) -> None:
    """Write the live points as one run, which takes the place of those that it was made of; runs published meanwhile stay behind it.

    The old runs' folders stay for readers of an older manifest until swept() takes them away.
    """
    names, run = manifest.current(spark, f"{store_path}/manifest")[1], new_run()
    if len(names) < 2:
        return
    write_run(live_points(spark, store_path, names).withColumn("deleted", F.lit(False)), store_path, run)
    manifest.published(spark, f"{store_path}/manifest", lambda now: [run, *(n for n in now if n not in set(names))] if now[: len(names)] == names else now)
    if run not in manifest.current(spark, f"{store_path}/manifest")[1]:
        manifest.removed(spark, f"{store_path}/points/{run}")


def swept(spark: SparkSession, store_path: str) -> list[str]:
    """Remove the folders of runs that the newest manifest doesn't name, once no run is being written and no older manifest is being read; gives their names."""
    fs, at = manifest.file_system(spark, f"{store_path}/points")
    known = set(manifest.current(spark, f"{store_path}/manifest")[1])
    left = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName() not in known) if fs.exists(at) else []
    for name in left:
        manifest.removed(spark, f"{store_path}/points/{name}")
    return left
