"""A persisted index for literal search: the places of chosen runs of letters in the content keys of chunks.

Of every WINDOW neighbouring runs of GRAM letters the one of the least hash is chosen, so that a text and any part of it
choose the same ones, and about two in WINDOW + 1 letters have a place. A key of GRAM + WINDOW - 1 letters
or more holds a whole window; a search takes the two of its runs that have the fewest places, keeps the chunks in which
both stand as far from each other as in the key, and compares the texts of these only. Shorter keys are found by a pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import checkpointed, top
from .literal import LETTERS, Rolling, bounded, code_points

GRAM, WINDOW = 8, 25
SHORTEST = GRAM + WINDOW - 1
#: Folders that the places are dealt out to by their run; a search reads those of its runs.
BUCKETS = 64


def chosen_runs(texts: list[str], rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, place) of the chosen runs of texts of SHORTEST letters or more; of equal hashes the first of a window."""
    points, bounds = code_points(texts)
    n = len(points) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.arange(n)
    hashes = rolling.runs(rolling.sums(points), starts, starts + GRAM)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    text = np.searchsorted(bounds, starts[: len(windows)], "right") - 1
    whole = starts[: len(windows)] + SHORTEST <= bounds[text + 1]
    best = np.unique((windows[whole].argmin(axis=1) + np.flatnonzero(whole)))
    text = np.searchsorted(bounds, best, "right") - 1
    return text, hashes[best], best - bounds[text]


def placing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, gram, place) of batches (id, text). A very long text is read in pieces that overlap by a window, whose places are given once."""
    rolling = Rolling()

    def given(rows: list[int], at: list[int], part: list[str], ids: pa.Array) -> pa.RecordBatch:
        text, hashes, place = chosen_runs(part, rolling)
        row, place = np.array(rows, np.int64)[text], np.array(at, np.int64)[text] + place
        _, first = np.unique(np.stack([row, place]), axis=1, return_index=True)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row[first])), pa.array(hashes[first].view(np.int64)), pa.array(place[first])], ["id", "gram", "place"])

    for batch in bounded(batches):
        rows, at, part, letters = [], [], [], 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            for start in range(0, max(1, len(text or "") - SHORTEST + 1), LETTERS):
                rows.append(i)
                at.append(start)
                part.append((text or "")[start : start + LETTERS + SHORTEST - 1])
                letters += len(part[-1])
            if letters > LETTERS:
                yield given(rows, at, part, batch.column(0))
                rows, at, part, letters = [], [], [], 0
        if part:
            yield given(rows, at, part, batch.column(0))


def bucket(gram: str = "gram"):
    return F.pmod(F.col(gram), F.lit(BUCKETS)).cast("int")


def build_postings(chunks: DataFrame, path: str) -> PostingsIndex:
    """Write the places of chunks (chunk_id, content_key) to a new folder, sorted by run within each bucket.

    A run that very many chunks hold is split over tasks. Chunks whose key is null or shorter than SHORTEST have no place.
    """
    rows = chunks.where(F.length("content_key") >= SHORTEST).select(F.col("chunk_id").cast("long"), "content_key")
    places = rows.mapInArrow(placing, "id long, gram long, place long").select(F.col("id").alias("chunk_id"), "gram", F.col("place").cast("int").alias("place"), bucket().alias("bucket"))
    places.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "chunk_id").write.partitionBy("bucket").parquet(path)
    return PostingsIndex(chunks.sparkSession, path)


@dataclass
class PostingsIndex:
    """An index in a folder; open it with its path, or build it by build_postings."""

    spark: SparkSession
    path: str

    def places(self, buckets: list[int]) -> DataFrame:
        rows = self.spark.read.schema("chunk_id long, gram long, place int, bucket int").parquet(self.path)
        return rows.where(F.col("bucket").isin(buckets))

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id), each once, of the chunks that may hold a query's key (query_id, q_content of SHORTEST letters or more); none that does is missing."""
        asked = queries.select(F.col("query_id").cast("long"), "q_content").mapInArrow(placing, "id long, gram long, place long").toDF("query_id", "gram", "offset")
        asked = checkpointed(asked.withColumn("bucket", bucket()))
        wanted = asked.select("gram", "bucket").distinct()
        places = self.places([r.bucket for r in wanted.select("bucket").distinct().collect()])
        counts = places.join(wanted, ["bucket", "gram"]).groupBy("gram").agg(F.count("*").alias("n"))
        # A run without a place says that no chunk holds the key.
        rated = asked.groupBy("query_id", "gram", "bucket").agg(F.min("offset").alias("offset")).join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rare = checkpointed(top(rated, 2, F.asc("n"), F.asc("offset"), name="rare"))
        met = places.join(rare.select("query_id", "gram", "bucket", "offset", "rare"), ["bucket", "gram"]).select("query_id", "chunk_id", (F.col("place") - F.col("offset")).alias("start"), "rare")
        # A run may stand in a key more often than once: then any of its places stands for the first, and starts are compared by both runs' own.
        several = rare.groupBy("query_id").agg(F.count("*").alias("runs"), F.min("n").alias("least")).where("least > 0").select("query_id", "runs")
        both = met.groupBy("query_id", "chunk_id", "start").agg(F.countDistinct("rare").alias("met")).join(several, "query_id")
        return both.where("met = runs").select("query_id", "chunk_id").distinct()

    def pairs(self, rows: DataFrame, queries: DataFrame) -> DataFrame:
        """rows (chunk_id, content_key and others) with the columns of each query whose key they hold; texts are read once, for candidates only."""
        found = self.candidates(queries)
        return rows.join(found, "chunk_id").join(queries, "query_id").where(F.contains("content_key", F.col("q_content")))
