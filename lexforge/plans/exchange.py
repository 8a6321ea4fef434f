"""Round trips through readers, writers, the vector store and the index pipeline, each in a folder of its own under the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import datasets, ndjson, ports, vector_store
from ..sources.tables import line_chunks, load, shared_folder, works
from ..streaming import index_runs
from .shared import LINES, WORKS


def folder(spark) -> str:
    return f"{shared_folder(spark)}/lexforge-exchange-{uuid.uuid4().hex}"


def shards_read(spark, d):
    """Documents written as line-delimited JSON and read as shards, with the lines of each shard counted."""
    path = folder(spark)
    load(spark, d, "documents").select(F.to_json(F.struct("doc_id", "lang", "source", "text")).alias("value")).write.text(path)
    rows = ndjson.read_shards(spark, spark.read.text(path).inputFiles(), "doc_id long, lang string, source string, text string")
    same = F.col("line") == F.col("source_line")
    return rows.select("record.doc_id", "record.lang", F.sha2("record.text", 256).alias("text_sha256"), same.alias("same_line"))


def shard_trees(spark, d):
    """The hash trees of the documents' shards: how many lines and bytes they cover, and trees whose root a line's change would not show."""
    path = folder(spark)
    load(spark, d, "documents").select(F.to_json(F.struct("doc_id", "lang")).alias("value")).write.text(path)
    trees = ndjson.shard_trees(spark, spark.read.text(path).inputFiles())
    return trees.agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), (F.count("*") - F.countDistinct("root")).alias("same_roots"))


def report_read(spark, d):
    """A report of market segments as a table with six decimals, written and read again."""
    path = folder(spark)
    rows = load(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))), 6).alias("m"), F.round(F.avg(F.when(F.col("c_acctbal") > 1e9, F.col("c_custkey"))), 6).alias("none"), F.count("*").alias("n"))
    datasets.write_report(rows, path, "markdown")
    return spark.read.text(path).select(F.col("value").alias("line"))


def reviews_read(spark, d):
    """The template of all judged cases written as CSV, its scores filled in, written and read as reviews."""
    path = folder(spark)
    n = F.col("event_id")
    judged = load(spark, d, "events").where("event_type <> 'error'").select(F.concat(F.lit("case-"), n.cast("string")).alias("case_id"), F.col("event_type").alias("category"))
    datasets.write_review_template(judged, f"{path}/template")
    number = F.regexp_extract("case_id", r"\d+", 0).cast("long")
    blank = spark.read.option("header", True).csv(f"{path}/template")
    filled = blank.withColumns({"relevance_0_2": (number % 3).cast("string"), "faithfulness_0_2": (number % 2 + 1).cast("string")})
    filled.write.option("header", True).csv(f"{path}/filled")
    return datasets.read_reviews(spark, f"{path}/filled").select("case_id", "category", "relevance_0_2", "faithfulness_0_2")


def store_points(spark, d):
    """Points of a vector store after an upsert of all, a second one of some and a deletion of others."""
    path = folder(spark)
    rows = load(spark, d, "embeddings").where("embedding IS NOT NULL")
    points = lambda df, first: df.select(F.col("vec_id").cast("string").alias("id"), first.alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("payload"), "vec_id")
    width = rows.select(F.max(F.size("embedding"))).first()[0]
    vector_store.upsert(points(rows, F.col("embedding").cast("array<float>")), path, width, 1)
    vector_store.upsert(points(rows.where("vec_id % 3 = 0"), F.transform("embedding", lambda x: -x).cast("array<float>")), path, width, 2)
    vector_store.delete(points(rows.where("vec_id % 5 = 0"), F.col("embedding").cast("array<float>")), path, 3)
    return vector_store.points(spark, path).select("id", F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"), F.element_at("payload", "label").alias("label"))


def chunks_indexed(spark, d):
    """Lines of all works through the index pipeline: status after the run, and whether their points are in the store."""
    path = folder(spark)
    lines = line_chunks(works(spark, d)).select("chunk_id", F.col("chunk_id").cast("string").alias("vector_id"), "text", F.when(F.col("chunk_index") % 2 == 0, "pending").otherwise("ready").alias("status"))
    after = index_runs.index_chunks(lines, lambda rows: ports.embedded(rows, "text"), path, 32)
    stored = index_runs.live_points(spark, path).select("chunk_id", F.lit(True).alias("stored"))
    return after.join(stored, "chunk_id", "left").select("chunk_id", "status", F.coalesce("stored", F.lit(False)).alias("stored"))


def chunks_indexed_again(spark, d):
    """Two index runs that overlap, points withdrawn, and a compaction: each chunk's status and the points it has in the store."""
    path = folder(spark)
    lines = line_chunks(works(spark, d)).select("chunk_id", F.col("chunk_id").cast("string").alias("vector_id"), "text", "chunk_index", "line_no")
    embed = lambda rows: ports.embedded(rows, "text")
    run = lambda wanted: index_runs.index_chunks(lines.withColumn("status", F.when(wanted, "pending").otherwise("ready")), embed, path, 32)
    run(F.col("chunk_index") % 2 == 0)
    after = run(F.col("chunk_index") % 3 == 0)
    index_runs.withdrawn(lines.where("line_no % 5 = 0").select("vector_id"), path)
    index_runs.compacted(spark, path)
    stored = index_runs.live_points(spark, path).groupBy("chunk_id").agg(F.count("*").alias("points"))
    return after.join(stored, "chunk_id", "left").select("chunk_id", "status", F.coalesce("points", F.lit(0)).cast("long").alias("points"))


QUERIES = {f.__name__: f for f in (shards_read, shard_trees, report_read, reviews_read, store_points, chunks_indexed, chunks_indexed_again)}

ORACLES = {
    "shards_read": "SELECT doc_id, lang, sha256(text) AS text_sha256, true AS same_line FROM documents",
    "shard_trees": """SELECT count(*) AS lines, CAST(sum(strlen(CASE WHEN lang IS NULL THEN '{"doc_id":' || doc_id || '}' ELSE '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' END) + 1) AS BIGINT) AS bytes, 0::BIGINT AS same_roots FROM documents""",
    "report_read": "SELECT '| ' || c_mktsegment || ' | ' || printf('%.6f', round(avg(CASE WHEN c_acctbal > 0 THEN c_custkey END), 6)) || ' | n/a | ' || count(*) || ' |' AS line FROM customer GROUP BY c_mktsegment",
    "reviews_read": "SELECT 'case-' || event_id AS case_id, event_type AS category, CAST(event_id % 3 AS INT) AS relevance_0_2, CAST(event_id % 2 + 1 AS INT) AS faithfulness_0_2 FROM events WHERE event_type <> 'error'",
    "store_points": "SELECT CAST(vec_id AS VARCHAR) AS id, round(CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END::FLOAT::DOUBLE, 5) AS first, CAST(label AS VARCHAR) AS label FROM embeddings WHERE vec_id % 5 <> 0",
    "chunks_indexed": f"WITH {WORKS}, {LINES} SELECT chunk_id, 'ready' AS status, chunk_index % 2 = 0 AS stored FROM lines",
    "chunks_indexed_again": f"WITH {WORKS}, {LINES} SELECT chunk_id, 'ready' AS status, CASE WHEN (chunk_index % 2 = 0 OR chunk_index % 3 = 0) AND line_no % 5 <> 0 THEN 1::BIGINT ELSE 0 END AS points FROM lines",
}
