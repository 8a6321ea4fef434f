"""Line-delimited JSON: strict or with an error column, many shards with hashes and both kinds of line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import checkpointed


def parsed_lines(lines: DataFrame, column: str) -> DataFrame:
    """lines with an error column: null for a JSON object, else why the line is none. Blank lines go."""
    found = lines.where(F.trim(column) != "")
    variant = F.try_parse_json(F.col(column))
    error = F.when(variant.isNull(), "invalid JSON").when(~F.schema_of_variant(variant).startswith("OBJECT"), "not an object")
    return found.withColumn("error", error)


#: A shard beyond this size has no hash of its bytes, as they would have to be one value; shard_trees hashes it by its lines.
HASHED_BYTES = 1 << 30
#: Children of a node of a shard's hash tree.
FAN = 1024


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of shards with file, block, at (their order in it), text and line, their number in the file.

    Base names have to differ. Lines are read in splits, so that a large shard is many tasks; a line's number is
    its place by split and within it.
    """
    names = [p.rstrip("/").rpartition("/")[2] for p in paths]
    if len(set(names)) < len(names):
        raise ValueError("shard names must differ")
    read = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    return counted(read, read, "line")


def counted(rows: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    """rows with their number among those of the same file, by block and at, which kept counts."""
    blocks = kept.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_block = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return rows.join(blocks.select("file", "block", before.alias("__before")), ["file", "block"]).withColumn(name, (F.col("__before") + in_block).cast("int")).drop("__before")


def read_shards(spark: SparkSession, paths: list[str], schema: str, strict: bool = True) -> DataFrame:
    """Records of NDJSON shards with file, line (of the file), source_line (of the file's records), error and sha256.

    Base names have to differ. strict raises with the line of the first bad one; a shard without records
    raises too. sha256 is null for a shard of more than HASHED_BYTES, which is not read for it.
    """
    lines = numbered_lines(spark, paths).withColumn("text", F.regexp_replace("text", "\r$", ""))
    rows = parsed_lines(lines, "text")
    sums = spark.read.format("binaryFile").load(paths).where(F.col("length") <= HASHED_BYTES).select(F.col("_metadata.file_name").alias("file"), F.sha2("content", 256).alias("sha256"))
    numbered = counted(rows, rows, "source_line").join(sums, "file", "left")
    if strict:
        bad = numbered.where("error IS NOT NULL").orderBy("file", "line").first()
        if bad:
            raise ValueError(f"{bad.file} line {bad.line}: {bad.error}")
        filled = numbered.select("file").distinct().count()
        if filled < len(paths):
            raise ValueError("a shard has no records")
    return numbered.select("file", "sha256", "line", "source_line", "error", F.from_json("text", schema).alias("record"))


def shard_trees(spark: SparkSession, paths: list[str], fan: int = FAN) -> DataFrame:
    """The hash tree of each shard: (file, bytes, lines, root), at any size of a shard.

    A leaf is the sha256 of a line without its line feed, a node that of the digests of fan children in order (lowercase hex), until one
    is left; a shard without bytes gives no row. No task holds more than fan digests of a node. A line feed at the end of the last line
    makes no difference.
    """
    leaves = checkpointed(numbered_lines(spark, paths).select("file", (F.col("line") - 1).cast("long").alias("place"), F.sha2("text", 256).alias("digest")))
    # As many rows as there are paths, which the caller lists.
    sizes = checkpointed(leaves.groupBy("file").agg(F.count("*").alias("lines")))
    nodes = leaves.join(F.broadcast(sizes.withColumnRenamed("lines", "width")), "file")
    left = sizes.agg(F.max("lines")).first()[0] or 0
    while left > 1:
        children = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
        # A shard that has come down to its root stays as it is while others go on.
        digest = F.when(F.col("width") == 1, F.min("digest")).otherwise(F.sha2(F.array_join(children, ""), 256))
        level = nodes.groupBy("file", "width", F.floor(F.col("place") / fan).cast("long").alias("parent")).agg(digest.alias("digest"))
        nodes = checkpointed(level.select("file", F.col("parent").alias("place"), "digest", F.ceil(F.col("width") / fan).cast("long").alias("width")))
        left = -(-left // fan)
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_name").alias("file"), F.col("length").alias("bytes"))
    roots = nodes.select("file", F.col("digest").alias("root"))
    return files.join(sizes, "file").join(roots, "file").select("file", "bytes", "lines", "root")


def shard_manifest(rows: DataFrame) -> DataFrame:
    """Each shard's hash and number of records."""
    return rows.groupBy("file", "sha256").agg(F.count("*").alias("records"))
