"""Immutable version snapshots: nested rows, their canonical JSON and hash, and the next version of changed works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import nested


def canonical(row: Column) -> Column:
    """JSON of a struct whose fields are in alphabetical order, nulls kept, without blanks."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def snapshots(works: DataFrame, categories: DataFrame, tags: DataFrame) -> DataFrame:
    """works (id, title, content, status, version_no) with snapshot (JSON) and content_hash.

    categories: id, category_id, name; tags: id, tag. Categories are ordered by id, tags by lookup key, and
    both are summed up before they meet their work.
    """
    keyed = tags.select("id", F.struct(F.lower(F.trim("tag")).alias("k"), F.col("tag").alias("t")).alias("s"))
    ordered = keyed.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]).alias("tags"))
    rows = nested(works, categories, "id", ["category_id", "name"], "categories").join(ordered, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    shape = F.struct(F.transform("categories", lambda c: F.struct(c["category_id"].alias("id"), c["name"].alias("name"))).alias("categories"), "content", "id", "status", "tags", "title", "version_no")
    return rows.select("id", "version_no", canonical(shape).alias("snapshot")).withColumn("content_hash", F.sha2("snapshot", 256))


def appended(versions: DataFrame, fresh: DataFrame, change: str) -> DataFrame:
    """versions (id, version_no, snapshot, content_hash, change_type) and the fresh snapshots that it has no row for."""
    new = fresh.join(versions, ["id", "version_no"], "left_anti").select("id", "version_no", "snapshot", "content_hash", F.lit(change).alias("change_type"))
    return versions.unionByName(new)


def annotated(versions: DataFrame, annotations: DataFrame) -> DataFrame:
    """versions (id, content) with notes: their published annotations as an array, ready for chunking; empty for none."""
    published = annotations.where("status = 'published'").select("id", "annotation_id", "content", "line_start", "line_end")
    return nested(versions, published, "id", ["annotation_id", "content", "line_start", "line_end"], "notes")
