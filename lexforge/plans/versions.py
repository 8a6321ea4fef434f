"""Queries of version snapshots and small aggregates of evaluation runs; orders stand for works, their lines for categories and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, versions
from ..sources.tables import load, works


def parts(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("content"), F.col("o_orderstatus").alias("status"), F.lit(1).cast("long").alias("version_no"))
    lines = load(spark, d, "lineitem")
    categories = lines.join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("category_id"), F.col("p_brand").alias("name"))
    tags = lines.select(F.col("l_orderkey").alias("id"), F.concat(F.col("l_returnflag"), F.col("l_linenumber").cast("string")).alias("tag"))
    return orders, categories, tags


def version_snapshots(spark, d):
    return versions.snapshots(*parts(spark, d)).select("id", "version_no", "content_hash")


def version_backfill(spark, d):
    """Snapshots appended to those that published orders have already."""
    fresh = versions.snapshots(*parts(spark, d))
    have = fresh.join(load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), "id", "left_semi").withColumn("change_type", F.lit("import"))
    return versions.appended(have, fresh, "backfill").groupBy("change_type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("works"))


def annotated_chunks(spark, d):
    """Notes of works, from the assistant's turns of the conversation of the same number; only published ones are chunked."""
    c = load(spark, d, "conversations")
    notes = c.select(F.col("conv_id").alias("id"), F.col("turn").alias("annotation_id"), F.col("text").alias("content"), F.when(F.col("turn") % 2 == 0, F.lit(1)).alias("line_start"), F.when(F.col("turn") % 2 == 0, F.lit(2)).alias("line_end"), F.when(F.col("role") == "assistant", "published").otherwise("draft").alias("status"))
    rows = versions.annotated(works(spark, d).select("id", "content"), notes)
    made = chunking.chunk_texts(rows, notes="notes", most={"note": 1 << 20})
    return made.where("granularity = 'note'").select("id", "annotation_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("line_start").cast("long").alias("line_start"))


def strategy_list(spark, d):
    """The different strategies of a run's cases in order of appearance, joined, null for none."""
    e = load(spark, d, "events").select(F.col("user_id"), "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("s"))
    kept = e.groupBy("user_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("event_id", "s")))), lambda x: x["s"])).alias("l"))
    return kept.select("user_id", F.nullif(F.concat_ws(", ", "l"), F.lit("")).alias("strategies"))


QUERIES = {f.__name__: f for f in (version_snapshots, version_backfill, annotated_chunks, strategy_list)}

ORACLES = {
    "version_snapshots": """WITH c AS (SELECT l_orderkey, '[' || string_agg('{"id":' || l_partkey || ',"name":"' || p_brand || '"}', ',' ORDER BY l_partkey, p_brand) || ']' AS c, '["' || string_agg(l_returnflag || l_linenumber, '","' ORDER BY lower(l_returnflag || l_linenumber)) || '"]' AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
      SELECT o_orderkey AS id, CAST(1 AS BIGINT) AS version_no, sha256('{"categories":' || coalesce(c, '[]') || ',"content":null,"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","tags":' || coalesce(t, '[]') || ',"title":"' || o_orderpriority || '","version_no":1}') AS content_hash FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""",
    "version_backfill": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'import' ELSE 'backfill' END AS change_type, count(*) AS n, count(DISTINCT o_orderkey) AS works FROM orders GROUP BY 1",
    "annotated_chunks": "SELECT conv_id AS id, turn AS annotation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, CASE WHEN turn % 2 = 0 THEN CAST(1 AS BIGINT) END AS line_start FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND conv_id IN (SELECT doc_id FROM documents)",
    "strategy_list": "WITH f AS (SELECT user_id, event_type, min(event_id) AS i FROM events WHERE event_type <> 'error' GROUP BY 1, 2) SELECT u.user_id, string_agg(event_type, ', ' ORDER BY i) AS strategies FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN f ON f.user_id = u.user_id GROUP BY 1",
}
