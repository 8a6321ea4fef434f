"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The pairwise part needs linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].
It learns on the driver from a bounded sample and scores every whole text on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._plan import hash_sample, small_batches
from ._text import Roller, find_words, lower_table, space_table, text_chunks

#: Labelled rows to learn from, about: those whose hash of doc_id is under their share.
SAMPLE_ROWS = 6000
BUCKET_BITS, FACTORS = 16, 8
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.05, 1e-5
STATISTICS = 12


@dataclass
class Machine:
    """Weights of the features; the last STATISTICS and metadata features are scaled by mean and deviation."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def plain(self) -> tuple:
        """Numbers and arrays only, for a broadcast that workers can read without this package."""
        return self.bias, self.linear, self.factors, self.mean, self.deviation


def features(data: np.ndarray, offsets: np.ndarray, roller: Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk of texts: (document, bucket, share of its words) of the hashed words, and a row of STATISTICS for each document."""
    n = len(offsets) - 1
    low = lower_table()[data]
    words = find_words(low, offsets, space_table())
    doc = np.repeat(np.arange(n), np.diff(words.first))
    count = np.diff(words.first).astype(float)
    hashes = roller.words(words)
    pair, times = np.unique((doc.astype(np.int64) << BUCKET_BITS) | (hashes & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64), return_counts=True)
    owner, bucket = pair >> BUCKET_BITS, pair & ((1 << BUCKET_BITS) - 1)
    share = times / np.maximum(count[owner], 1)

    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    some = np.maximum(count, 1)
    letters = (low >= 97) & (low <= 122) | (low >= 128)
    digits = (low >= 48) & (low <= 57)
    spaces = ~space_table()[low]
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])]) if len(hashes) else np.zeros(0, bool)
    lines = sums(low == 10) + 1
    of_doc = lambda values: np.bincount(doc, values, n)
    length = (words.ends - words.starts).astype(float)
    rows = [
        np.log1p(count), np.log1p(size), of_doc(length) / some, np.sqrt(np.maximum(0, of_doc(length**2) / some - (of_doc(length) / some) ** 2)), np.bincount(owner, minlength=n) / some, of_doc(again) / some,
        sums(~(letters | digits | spaces)) / size, sums(digits) / size, sums(data != low) / size, sums(low >= 128) / size, np.log1p(count / lines), np.bincount(owner, share**2, n),
    ]
    return owner, bucket, share, np.stack(rows, axis=1)


def scores(model: Machine, owner: np.ndarray, bucket: np.ndarray, share: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1 by the sum-of-squares identity."""
    n, words = len(dense), 1 << BUCKET_BITS
    x = (dense - model.mean) / model.deviation
    total = model.bias + np.bincount(owner, model.linear[bucket] * share, n) + x @ model.linear[words:]
    for f in range(model.factors.shape[1]):
        v = model.factors[:, f]
        total += 0.5 * ((np.bincount(owner, v[bucket] * share, n) + x @ v[words:]) ** 2 - np.bincount(owner, (v[bucket] * share) ** 2, n) - x**2 @ v[words:] ** 2)
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], metadata: int = 0, seed: int = 5) -> Machine:
    """Learn from (buckets, shares, statistics, label) rows by AdaGrad on the log loss. Without rows of both labels every score is the share of label 1, or 0.5."""
    words, wide = 1 << BUCKET_BITS, STATISTICS + metadata
    y = np.array([r[3] for r in rows], float)
    prior = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(rows) else 0.5
    linear, random = np.zeros(words + wide), np.random.default_rng(seed)
    factors = random.normal(0, 0.01, (words + wide, FACTORS))
    model = Machine(float(np.log(prior / (1 - prior))), linear, factors, np.zeros(wide), np.ones(wide))
    if len(set(y)) < 2:
        factors[:] = 0
        return model
    dense = np.stack([r[2] for r in rows])
    model.mean, model.deviation = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-6)
    dense = np.clip((dense - model.mean) / model.deviation, -5, 5)
    grown, grown_v, grown_bias = np.full(words + wide, 1e-6), np.full((words + wide, FACTORS), 1e-6), 1e-6
    fixed = np.arange(words, words + wide)
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            part = order[start : start + BATCH]
            index = np.concatenate([np.concatenate([rows[i][0], fixed]) for i in part])
            value = np.concatenate([np.concatenate([rows[i][1], dense[i]]) for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) + wide for i in part])
            vx = factors[index] * value[:, None]
            s = np.stack([np.bincount(owner, vx[:, f], len(part)) for f in range(FACTORS)], axis=1)
            total = model.bias + np.bincount(owner, linear[index] * value, len(part)) + 0.5 * ((s**2).sum(axis=1) - np.bincount(owner, (vx**2).sum(axis=1), len(part)))
            error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y[part]) / len(part)
            unique, place = np.unique(index, return_inverse=True)
            g = np.bincount(place, error[owner] * value, len(unique)) + DECAY * linear[unique]
            slope = error[owner][:, None] * value[:, None] * (s[owner] - vx)
            gv = np.stack([np.bincount(place, slope[:, f], len(unique)) for f in range(FACTORS)], axis=1) + DECAY * factors[unique]
            grown[unique] += g**2
            grown_v[unique] += gv**2
            grown_bias += error.sum() ** 2
            linear[unique] -= RATE * g / np.sqrt(grown[unique])
            factors[unique] -= RATE * gv / np.sqrt(grown_v[unique])
            model.bias -= RATE * float(error.sum()) / grown_bias**0.5
    return model


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: the remainder 1 of crc32(doc_id as text) by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def dense_columns(batch: pa.RecordBatch, first: int, rows: int, statistics: np.ndarray, metadata: list[int]) -> np.ndarray:
    extra = [np.log1p(np.maximum(0, np.nan_to_num(batch.column(i).slice(first, rows).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)))) for i in metadata]
    return np.column_stack([statistics, *extra]) if extra else statistics


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> Machine:
    """Fit a machine on about sample_rows labelled rows (twice at most) outside the held-out third.

    labels needs doc_id and quality (null rows are skipped; a doc_id with both labels counts with each).
    The sample is chosen by the hash of doc_id, so reruns agree; of several rows of one doc_id the one of
    the least content hash is learned from. Without documents or labels every score is 0.5.
    """
    small_batches(docs.sparkSession)
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = hash_sample(usable, sample_rows, "doc_id", seed=seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1)):
                owner, bucket, share, rows = features(data, offsets, roller)
                rows = dense_columns(batch, first, len(rows), rows, list(range(3, 3 + len(metadata))))
                cuts = np.searchsorted(owner, np.arange(1, len(rows)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(rows)), batch.column(2).slice(first, len(rows)), pa.array(np.split(bucket.astype(np.int32), cuts), pa.list_(pa.int32())), pa.array(np.split(share.astype(np.float32), cuts), pa.list_(pa.float32())), pa.array(list(rows), pa.list_(pa.float64()))],
                    ["doc_id", "quality", "buckets", "shares", "rest"],
                )

    meta = [F.col(c).cast("double") for c in metadata]
    rows = docs.select("doc_id", "text", *meta).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text", *metadata).alias("h"), "text", *metadata)).alias("s"))
    rows = one.select("doc_id", "s.text", "quality", *(f"s.{c}" for c in metadata))
    sample = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, buckets array<int>, shares array<float>, rest array<double>").toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    column = {c: sample.column(c).combine_chunks() for c in ("buckets", "shares", "rest")} if sample.num_rows else {}
    examples = [(column["buckets"][i].values.to_numpy(), column["shares"][i].values.to_numpy().astype(float), column["rest"][i].values.to_numpy(), int(q)) for i, q in enumerate(sample.column("quality").to_pylist())] if sample.num_rows else []
    return fit(examples, len(metadata), seed)


def add_scores(docs: DataFrame, model: Machine, metadata: tuple[str, ...] = ("n_chars",), name: str = "score") -> DataFrame:
    """docs with a double column of this name, from 0 to 1, which replaces one of this name.

    Inputs are text and the metadata columns only; a null text is empty, null metadata counts as 0. Empty
    texts get a score like others.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    @F.arrow_udf("double")
    def score(text: pa.Array, *rest: pa.Array) -> pa.Array:
        roller, out, known = Roller(), [], Machine(*shared.value)
        batch = pa.RecordBatch.from_arrays([text, *rest], [str(i) for i in range(1 + len(rest))])
        for first, data, offsets in text_chunks(text):
            owner, bucket, share, rows = features(data, offsets, roller)
            dense = dense_columns(batch, first, len(rows), rows, list(range(1, 1 + len(rest))))
            out.append(scores(known, owner, bucket, share, known.mean + known.deviation * np.clip((dense - known.mean) / known.deviation, -5, 5)))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, score("text", *(F.col(c).cast("double") for c in metadata)))
