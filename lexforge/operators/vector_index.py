"""A persisted index for dense search: inverted lists around centroids, one parquet partition for each list.

A search reads only the lists that its queries ask: the nearest ones first, and then those which the
triangle inequality of angles does not rule out (exact), or, where a query found less than k, all others.
Scores are those of the scan, in double precision from the stored vectors, and facets are checked before the cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .dense import HITS, QUERY_BYTES, gathered, matrix, ranked_hits, scanning, slices, unit, usable

#: Vectors that the centroids are fitted on, about, and rounds of that; lists of an index; rows of a file.
SAMPLE_VECTORS, ROUNDS, MOST_LISTS, FILE_ROWS = 50_000, 10, 4096, 200_000
LISTS = "list int, centroid array<double>, least_cosine double, vectors long"


def fitted_centroids(rows: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means; an empty cluster takes the vector that its own centroid fits worst."""
    random = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    centroids = distinct[random.permutation(len(distinct))[:lists]]
    for _ in range(ROUNDS):
        near, fit = nearest_lists(rows, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rows)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centroids)) == 0)
        sums[empty] = rows[np.argsort(fit, kind="stable")[: len(empty)]]
        moved, some = unit(sums)
        centroids = np.where(some[:, None], moved, centroids)
    return centroids


def nearest_lists(rows: np.ndarray, centroids: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(list, cosine) of the nearest centroid of each unit vector."""
    near, fit = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for i in range(0, len(rows), block):
        scores = rows[i : i + block] @ centroids.T
        near[i : i + block] = scores.argmax(axis=1)
        fit[i : i + block] = scores.max(axis=1)
    return near, fit


def build_index(vectors: DataFrame, path: str, payload: tuple[str, ...] = (), lists: int | None = None, sample_vectors: int = SAMPLE_VECTORS) -> VectorIndex:
    """Write an index of vectors (vec_id, embedding and the payload columns) to a new folder, for cosine search.

    Centroids, the square root of the number of vectors unless lists says otherwise, are fitted on the driver on about
    sample_vectors vectors, chosen by the hash of vec_id (twice as many at most). All vectors are put into the list of their nearest centroid; those that no cosine search finds
    (null, zero, non-finite, of another length than most) are left out. Large lists are split over tasks and files.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull())
    widths = rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if widths is None:
        rows.select(F.col("vec_id").cast("long"), "embedding", *payload, F.lit(0).alias("list")).limit(0).write.partitionBy("list").parquet(f"{path}/vectors")
        spark.createDataFrame([], LISTS).write.parquet(f"{path}/lists")
        return VectorIndex(spark, path)
    width, total = widths.width, widths.n
    rows = rows.where(F.size("embedding") == width)
    chosen = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(3), "vec_id"), 11) < int(min(1.0, sample_vectors / total) * (1 << 53))).limit(2 * sample_vectors) if total > sample_vectors else rows
    sample, good = matrix(chosen.select("embedding").toArrow().column(0).combine_chunks(), width)
    sample, some = unit(sample)
    sample = sample[good & some]
    centroids = fitted_centroids(sample[np.lexsort(sample.T)], min(MOST_LISTS, lists or max(1, round(total**0.5)))) if len(sample) else np.eye(1, width)
    shared = spark.sparkContext.broadcast(centroids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, fit = nearest_lists(unit(matrix(batch.column(1), width)[0])[0], shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(fit)], [*batch.schema.names, "list", "cosine"])

    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", *payload)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    # Rebalancing brings a list's rows together and splits those that are larger than a partition should be.
    assigned = slim.mapInArrow(placed, f"{schema}, list int, cosine double").hint("rebalance", "list")
    assigned.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("list").parquet(f"{path}/vectors")
    figures = spark.read.parquet(f"{path}/vectors").groupBy("list").agg(F.min("cosine").alias("least_cosine"), F.count("*").alias("vectors"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    known.join(figures, "list").select("list", "centroid", "least_cosine", "vectors").coalesce(1).write.parquet(f"{path}/lists")
    return VectorIndex(spark, path)


@dataclass
class VectorIndex:
    """An index in a folder; open it with its path, or build it by build_index."""

    spark: SparkSession
    path: str

    @cached_property
    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, centroids, angles to the farthest vector) of the lists that hold vectors."""
        rows = self.spark.read.schema(LISTS).parquet(f"{self.path}/lists").orderBy("list").collect()
        return np.array([r.list for r in rows], np.int64), np.array([r.centroid for r in rows]).reshape(len(rows), len(rows[0].centroid) if rows else 0), np.arccos(np.clip([r.least_cosine for r in rows], -1, 1))

    def vectors(self, lists: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        return rows if lists is None else rows.where(F.col("list").isin(lists))

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, facets: list[str] | None = None, most_bytes: int = QUERY_BYTES) -> DataFrame:
        """The k nearest vectors of each query by cosine: (query_id, vec_id, score, rank), as dense_search gives them.

        Each query asks its probes nearest lists. exact: it then asks every list in which, by the angles, a vector could
        lie that is no worse than its k-th, so that the result is that of the scan. Otherwise only queries with
        less than k hits ask the other lists. facets are payload columns.
        """
        facets = facets or []
        numbers, centroids, radii = self.lists
        found = self.spark.createDataFrame([], HITS)
        if not len(numbers):
            return ranked_hits(found, k)
        shared = self.spark.sparkContext.broadcast((numbers, centroids, radii))
        for part, width in slices(queries.select("query_id", "embedding", *facets), k, most_bytes):
            if width != centroids.shape[1]:
                continue
            first = checkpointed(part.withColumn("asks", first_lists(shared, probes)("embedding")))
            hits = checkpointed(self.scanned(first, k, width, facets))
            least = ranked_hits(hits, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
            floor = F.when(F.coalesce("n", F.lit(0)) < k, -2.0).otherwise(F.col("kth"))
            again = first.join(least, "query_id", "left").withColumn("floor", floor if exact else F.when(floor < -1, floor).otherwise(2.0))
            again = again.withColumn("asks", other_lists(shared)("embedding", "asks", "floor")).where(F.size("asks") > 0)
            found = found.union(hits).union(self.scanned(again, k, width, facets))
        return ranked_hits(found, k)

    def scanned(self, asking: DataFrame, k: int, width: int, facets: list[str]) -> DataFrame:
        """The k best hits of each task for queries that ask the lists of their column asks; other lists are not read."""
        asked = gathered(asking.select("query_id", "embedding", *facets, "asks"), width, "cosine", facets)
        if not asked:
            return self.spark.createDataFrame([], HITS)
        askers: dict[int, list[int]] = {}
        for i, row in enumerate(asked[3]):
            for x in row.asks:
                askers.setdefault(x, []).append(i)
        shared = self.spark.sparkContext.broadcast((*asked[:3], {x: np.array(i) for x, i in askers.items()}))
        rows = self.vectors(sorted(askers)).select("vec_id", "embedding", *facets, "list")
        return rows.mapInArrow(scanning(shared, k, "cosine", len(facets), True), HITS)


def first_lists(shared, probes: int):
    """The probes nearest lists of a query's vector; none for a zero vector."""

    @F.arrow_udf("array<int>")
    def asks(vectors: pa.Array) -> pa.Array:
        numbers, centroids, _ = shared.value
        q, some = unit(matrix(vectors, centroids.shape[1])[0])
        near = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :probes]
        return pa.array([numbers[n].tolist() if s else [] for n, s in zip(near, some)], pa.list_(pa.int32()))

    return asks


def other_lists(shared):
    """The lists not asked yet that may hold a vector with a cosine of at least floor to the query's."""

    @F.arrow_udf("array<int>")
    def asks(vectors: pa.Array, before: pa.Array, floor: pa.Array) -> pa.Array:
        numbers, centroids, radii = shared.value
        q, some = unit(matrix(vectors, centroids.shape[1])[0])
        angles = np.arccos(np.clip(q @ centroids.T, -1, 1))
        # Scores are rounded to six decimals, and angles near 0 and pi are not exact.
        most = np.cos(np.maximum(0, angles - radii - 1e-6)) + 2e-6
        wanted = most >= floor.to_numpy(zero_copy_only=False)[:, None]
        return pa.array([sorted(set(numbers[w].tolist()) - set(b)) if s else [] for w, b, s in zip(wanted, before.to_pylist(), some)], pa.list_(pa.int32()))

    return asks
