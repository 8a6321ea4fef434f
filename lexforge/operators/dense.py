"""Dense search of a batch of queries by an exact scan: products of blocks, and a running top-k in every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import top

HITS = "query_id long, vec_id long, score double"
#: Bytes of queries and their hits that are broadcast together, and of the scores of one product.
QUERY_BYTES, PRODUCT_BYTES = 32 << 20, 4 << 20
#: Hits that wait before they are merged with the best so far.
WAITING = 200_000
METRICS = ("cosine", "dot", "euclid")


def usable(vector: str, width: int | None = None) -> Column:
    """Whether a vector can be compared: not null, of the width, and with finite components only."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.lit(True) if width is None else F.size(vector) == width) & finite, F.lit(False))


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, good) of vectors in double precision; null, shorter, longer and non-finite ones are zeros and not good."""
    rows = np.zeros((len(column), width))
    good = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width
    if good.any():
        rows[good] = column.filter(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    good &= np.isfinite(rows).all(axis=1)
    rows[~good] = 0
    return rows, good


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, whether they are not zero); scaled by the greatest component first, so that no square is lost."""
    most = np.abs(rows).max(axis=1, keepdims=True, initial=0)
    some = most[:, 0] > 0
    scaled = rows / np.where(most > 0, most, 1)
    return scaled / np.where(some, np.sqrt((scaled**2).sum(axis=1)), 1)[:, None], some


class Best:
    """The k best hits of each of n queries so far: greater scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((query, score, ids))
        self.count += len(query)
        if self.count > max(WAITING, len(self.held[0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        query, score, ids = (np.concatenate(parts) for parts in zip(self.held, *self.waiting))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        self.held, self.waiting, self.count = (query[keep], score[keep], ids[keep]), [], 0
        return self.held


def wanted_groups(wanted: list) -> list[tuple[set, np.ndarray]]:
    """(values, queries) of the different wishes of a facet; null is no wish, a list admits each of its values."""
    groups: dict = {}
    for i, want in enumerate(wanted):
        if want is not None:
            groups.setdefault(frozenset(want) if isinstance(want, (list, tuple)) else frozenset([want]), []).append(i)
    return [(set(values), np.array(queries)) for values, queries in groups.items()]


def scanning(shared, k: int, metric: str, facets: int, listed: bool):
    """A function over batches (vec_id, embedding, facets..., and the list where listed) that leaves each query's k best of a task.

    shared holds the queries' ids, their matrix, the wishes of each facet and, where listed, the queries that ask each list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, wishes, askers = shared.value
        length, groups = (q**2).sum(axis=1), [wanted_groups(w) for w in wishes]
        best = Best(len(ids), k)

        def compare(rows: np.ndarray, own: np.ndarray, refused: list[tuple[np.ndarray, np.ndarray]], asking: np.ndarray | None) -> None:
            mine = q if asking is None else q[asking]
            step = max(1, PRODUCT_BYTES // (8 * max(1, len(mine))))
            for start in range(0, len(rows), step):
                x = rows[start : start + step]
                scores = mine @ x.T
                if metric == "euclid":
                    scores *= -2
                    scores += (length if asking is None else length[asking])[:, None] + (x**2).sum(axis=1)
                    np.negative(np.sqrt(np.maximum(0, scores, out=scores), out=scores), out=scores)
                for queries, bad in refused:
                    at = queries if asking is None else np.flatnonzero(np.isin(asking, queries))
                    scores[np.ix_(at, np.flatnonzero(bad[start : start + step]))] = -np.inf
                least = best.least if asking is None else best.least[asking]
                if len(x) > k:
                    # What is not among the k best of the block can't be among the k best of all; a margin keeps ties after rounding.
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                qi, xi = np.nonzero((scores >= least[:, None] - 2e-6) & (scores > -np.inf))
                best.add(qi if asking is None else asking[qi], np.round(scores[qi, xi], 6), own[start + xi])

        for batch in batches:
            rows, good = matrix(batch.column(1), q.shape[1])
            if metric == "cosine":
                rows, some = unit(rows)
                good &= some
            good &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            kept = np.flatnonzero(good)
            own, rows = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)[kept], rows[kept]
            refused = []
            for f in range(facets):
                values = batch.column(2 + f).to_pylist()
                for admitted, queries in groups[f]:
                    bad = np.array([values[i] not in admitted for i in kept], bool)
                    if bad.any():
                        refused.append((queries, bad))
            if not listed:
                compare(rows, own, refused, None)
                continue
            lists = batch.column(2 + facets).to_numpy(zero_copy_only=False)[kept]
            for x in np.unique(lists):
                here = lists == x
                compare(rows[here], own[here], [(queries, bad[here]) for queries, bad in refused], askers[int(x)])
        query, score, found = best.merge()
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[query]), pa.array(found, pa.int64()), pa.array(-score if metric == "euclid" else score)], ["query_id", "vec_id", "score"])

    return run


def slices(queries: DataFrame, k: int, most_bytes: int) -> Iterator[tuple[DataFrame, int]]:
    """(queries, width): the comparable queries of each width, in slices whose vectors and hits take at most most_bytes."""
    good = queries.where(usable("embedding") & F.col("query_id").isNotNull())
    for row in good.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy("width").collect():
        same = good.where(F.size("embedding") == row.width)
        parts = -(-row.n * 8 * (row.width + 3 * k) // most_bytes)
        for i in range(parts):
            yield (same if parts == 1 else same.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)), row.width


def gathered(queries: DataFrame, width: int, metric: str, facets: list[str]) -> tuple[list, np.ndarray, list[list], list] | None:
    """The ids, matrix, wishes and rows of a slice; None where it has no query to compare."""
    rows = queries.collect()
    q = np.array([r.embedding for r in rows], float).reshape(-1, width)
    if metric == "cosine":
        q, some = unit(q)
        rows, q = [r for r, s in zip(rows, some) if s], q[some]
    return ([r.query_id for r in rows], q, [[r[f] for r in rows] for f in facets], rows) if rows else None


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", facets: list[str] | None = None, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k nearest vectors of each query: (query_id, vec_id, score, rank).

    vectors: vec_id, embedding; queries: query_id, embedding; facets: columns of both, checked before the cut:
    a query's value has to be equal, a list of values to hold the vector's, and null is no filter. cosine and dot are
    best large, euclid small; scores have six decimals, and ties go by vec_id. Vectors that are null, of another
    length than the query or hold null or non-finite components are no candidates, for the cosine zero vectors neither; such
    queries find nothing. Blocks of vectors are compared with a slice of the queries by one product in double
    precision; a task keeps each query's k best, and a window over these gives the result.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    spark, facets = vectors.sparkSession, facets or []
    found = spark.createDataFrame([], HITS)
    for part, width in slices(queries.select("query_id", "embedding", *facets), k, most_bytes):
        asked = gathered(part, width, metric, facets)
        if asked:
            shared = spark.sparkContext.broadcast((*asked[:3], None))
            found = found.union(vectors.select(F.col("vec_id").cast("long"), "embedding", *facets).mapInArrow(scanning(shared, k, metric, len(facets), False), HITS))
    return ranked_hits(found, k, metric)


def ranked_hits(found: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    return top(found, k, F.asc("score") if metric == "euclid" else F.desc("score"), F.asc("vec_id"))
