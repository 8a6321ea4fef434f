"""The whole row of a search hit: what a chunk, its version, work, author, dynasty and annotation hold, fetched for hits only."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: The columns of a candidate, in order.
CANDIDATE = (
    "chunk_id", "vector_id", "work_id", "version_id", "annotation_id", "annotation_type", "granularity", "chunk_index", "text", "normalized_text", "line_start", "line_end",
    "chunk_strategy", "chunk_status", "title", "author_id", "author_name", "dynasty_id", "dynasty_name", "published_at",
)


def detailed(hits: DataFrame, chunks: DataFrame, works: DataFrame, versions: DataFrame, authors: DataFrame, dynasties: DataFrame, annotations: DataFrame) -> DataFrame:
    """hits (chunk_id and columns of the search) with all columns of CANDIDATE.

    chunks: chunk_id, vector_id, work_id, version_id, annotation_id, granularity, chunk_index, text, normalized_text, line_start,
    line_end, chunk_strategy, chunk_status; works: work_id, title, author_id, dynasty_id, published_at; versions: version_id; authors:
    author_id, author_name; dynasties: dynasty_id, dynasty_name; annotations: annotation_id, annotation_type. A chunk without its work or version is dropped, other
    sides are optional. Hits are few, so that they are joined first and everything after is as small as they are.
    """
    own = [c for c in hits.columns if c not in CANDIDATE or c == "chunk_id"]
    rows = hits.select(*own).join(chunks, "chunk_id").join(works, "work_id").join(versions.select("version_id"), "version_id", "left_semi")
    rows = rows.join(authors.select("author_id", "author_name"), "author_id", "left").join(dynasties.select("dynasty_id", "dynasty_name"), "dynasty_id", "left")
    rows = rows.join(annotations.select("annotation_id", "annotation_type"), "annotation_id", "left")
    return rows.select(*(c for c in own if c != "chunk_id"), *CANDIDATE)
