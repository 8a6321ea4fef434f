"""Line deduplication with two Bloom filters.

Every task fills a filter of lines seen once and one of lines seen again. Merged bit by bit, the
second filter holds each line of two or more documents, and few others. Only lines that it suspects
shuffle, as counts summed up per task before; they are confirmed by their exact text. A corpus with
more lines than a pair of filters holds well gets a pair for each of several ranges of hashes, and the
ranges are looked up in passes of their own. A range count beyond MOST_RANGES is not split further: then more
lines go to the exact count, and the result is never another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import checkpointed, free, row_key, small_batches
from ._text import mixed

#: Bits for each line, probes for each line, and the largest filter: 2^28 bits are 32 MB. Ranges of hashes with filters of their own.
BITS_PER_LINE, PROBES, MOST_BITS, MOST_RANGES = 16, 4, 1 << 28, 16
SEGMENTS = 64
#: Bytes of confirmed line keys that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Different keys that a task counts before it hands the sums on.
HELD_KEYS = 100_000


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit places of 64-bit hashes: PROBES rows."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([((hashes + np.uint64(i) * step) % np.uint64(bits)) for i in range(PROBES)]).astype(np.int64)


def in_filter(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the packed filter holds all probes of each column of places."""
    return ((bitmap[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=0)


def put(bitmap: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (places >> 3).ravel(), (1 << (7 - (places & 7))).astype(np.uint8).ravel())


def places_set(bitmap: np.ndarray) -> np.ndarray:
    """The bits that are set in a packed filter, looked up in its non-zero bytes."""
    some = np.flatnonzero(bitmap)
    byte, bit = np.nonzero(np.unpackbits(bitmap[some]).reshape(-1, 8))
    return (some[byte] * 8 + bit).astype(np.uint32)


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(ranges)).astype(np.int64)


def text_hashes(text: str | None, least_length: int) -> list[int]:
    return [xxhash.xxh64_intdigest(k) for k in {line_key(x) for x in lines_of(text)} if len(k.decode("utf-8", "surrogatepass")) >= least_length]


def twice_seen(docs: DataFrame, bits: int, ranges: int, least_length: int) -> DataFrame:
    """(range, segment, bits) of the merged filters, as bytes, of line keys that two or more documents hold."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Filters of a task are made for one range after another, of the hashes of all its lines.
        hashes = np.concatenate([np.zeros(0, np.uint64), *(np.array(text_hashes(t.as_py(), least_length), np.uint64) for batch in batches for t in batch.column(0))])
        mine, width = range_of(hashes, ranges), bits // SEGMENTS // 8
        for r in range(ranges):
            once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
            part = hashes[mine == r] if ranges > 1 else hashes
            for i in range(0, len(part), 65536):
                unique, counts = np.unique(part[i : i + 65536], return_counts=True)
                places = probes(unique, bits)
                again = in_filter(once, places) | (counts > 1)
                put(once, places)
                put(twice, places[:, again])
            for s in range(SEGMENTS):
                pair = [places_set(x[s * width : (s + 1) * width]) for x in (once, twice)]
                if len(pair[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([s], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in pair)], ["range", "segment", "once", "twice"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = bits // SEGMENTS
        once, twice = np.zeros(width, bool), np.zeros(width, bool)
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("twice")):
                a, b = (np.frombuffer(x.as_py(), np.uint32) for x in (a, b))
                twice[a[once[a]]] = True
                twice[b] = True
                once[a] = True
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([np.packbits(twice).tobytes()], pa.binary())], ["range", "segment", "bits"])

    filled = docs.select("text").mapInArrow(fill, "range int, segment int, once binary, twice binary")
    return filled.groupBy("range", "segment").applyInArrow(merge, "range int, segment int, bits binary")


def repeated_lines(docs: DataFrame, least_docs: int = 10, least_length: int = 1, most_bits: int = MOST_BITS) -> DataFrame:
    """Line keys of at least least_docs documents: key (binary), docs, and the first place (doc key pair, line number).

    Rows that repeat a doc_id count as documents of their own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lines = int(docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0)
    wanted = BITS_PER_LINE * lines
    bits = min(most_bits, 1 << max(16, wanted.bit_length()))
    ranges = min(MOST_RANGES, max(1, -(-wanted // most_bits)))
    merged = twice_seen(docs, bits, ranges, least_length)
    if ranges > 1:
        merged = checkpointed(merged)
    counted = None
    for r in range(ranges):
        suspects = np.zeros(bits // 8, np.uint8)
        width = bits // SEGMENTS // 8
        for row in merged.where(F.col("range") == r).toLocalIterator():  # SEGMENTS rows of at most MOST_BITS / 8 bytes together
            suspects[row.segment * width : (row.segment + 1) * width] = np.frombuffer(row.bits, np.uint8)
        found = suspect_counts(docs, spark.sparkContext.broadcast(suspects), bits, r, ranges, least_length)
        counted = found if counted is None else counted.unionByName(found)
    summed = counted.groupBy("key").agg(F.sum("docs").alias("docs"), F.min(F.struct("first0", "first1", "line")).alias("first"))
    return summed.where(F.col("docs") >= least_docs)


def suspect_counts(docs: DataFrame, suspects, bits: int, part: int, ranges: int, least_length: int) -> DataFrame:
    """(key, docs, first place) of the keys of one range of hashes that the filter holds, summed up by task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, held = suspects.value, {}

        def flush() -> pa.RecordBatch:
            found = list(held.items())
            held.clear()
            firsts = [x[1][1] for x in found]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1][0] for x in found], pa.int64()), *(pa.array([f[i] for f in firsts], pa.int64()) for i in range(3))],
                ["key", "docs", "first0", "first1", "line"],
            )

        for batch in batches:
            for text, k0, k1 in zip(*(batch.column(i) for i in range(3))):
                at: dict[bytes, int] = {}
                for i, line in enumerate(lines_of(text.as_py())):
                    at.setdefault(line_key(line), i)
                keys = [k for k in at if len(k.decode("utf-8", "surrogatepass")) >= least_length]
                if not keys:
                    continue
                hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
                hit = in_filter(bitmap, probes(hashes, bits))
                if ranges > 1:
                    hit &= range_of(hashes, ranges) == part
                for i in np.flatnonzero(hit):
                    place = (k0.as_py(), k1.as_py(), at[keys[i]])
                    n, least = held.get(keys[i], (0, place))
                    held[keys[i]] = (n + 1, min(least, place))
                if len(held) > HELD_KEYS:
                    yield flush()
        if held:
            yield flush()

    return docs.select("text", *row_key("doc_id", "text")).mapInArrow(count, "key binary, docs long, first0 long, first1 long, line long")


def drop_lines(docs: DataFrame, least_docs: int = 10, least_length: int = 1, keep_first: bool = False, broadcast_bytes: int = BROADCAST_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """Drop lines whose key at least least_docs documents hold, everywhere or, with keep_first, but for one place of it.

    docs needs doc_id and text. Returns its columns and n_lines, n_dropped (long) and kept (the other
    lines joined by a line feed; for a null text too), which replace columns of these names. A null or
    empty text is one empty line; an empty table gives none. Keys shorter than least_length code points are never dropped. Repeated
    rows are treated alike, unless keep_first: then the copies of the first place all keep it.
    """
    bad = checkpointed(repeated_lines(docs, least_docs, least_length, most_bits))
    spark = docs.sparkSession
    weight = bad.agg(F.sum(F.length("key") + 100)).first()[0] or 0
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    docs, mine = docs.select(*names), free(docs, "__lines")

    def kept(text: str | None, drops) -> tuple[int, int, str]:
        lines = lines_of(text)
        stay = [x for i, x in enumerate(lines) if not drops(i, line_key(x))]
        return len(lines), len(lines) - len(stay), b"\n".join(stay).decode("utf-8", "surrogatepass")

    result = "struct<n_lines:long,n_dropped:long,kept:string>"
    if weight <= broadcast_bytes:
        found = spark.sparkContext.broadcast({bytes(r.key): tuple(r.first) for r in bad.select("key", F.col("first").alias("first")).toLocalIterator()})

        @F.arrow_udf(result)
        def clean(text: pa.Array, k0: pa.Array, k1: pa.Array) -> pa.Array:
            firsts = found.value
            rows = [kept(t.as_py(), lambda i, k, at=(a.as_py(), b.as_py()): k in firsts and not (keep_first and firsts[k] == (*at, i))) for t, a, b in zip(text, k0, k1)]
            return pa.StructArray.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["n_lines", "n_dropped", "kept"])

        out = docs.withColumn(mine, clean("text", *row_key("doc_id", "text")))
        return out.select(*names, f"{mine}.n_lines", f"{mine}.n_dropped", f"{mine}.kept")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(line_key(x), k0.as_py(), k1.as_py(), i) for t, k0, k1 in zip(*(batch.column(i) for i in range(3))) for i, x in enumerate(lines_of(t.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["key", "k0", "k1", "line"])

    keyed = docs.select("*", *row_key("doc_id", "text", prefix=mine))
    at = keyed.select("text", f"{mine}0", f"{mine}1").mapInArrow(places, "key binary, k0 long, k1 long, line long")
    hits = at.join(bad, "key").where(F.lit(not keep_first) | (F.struct("k0", "k1", "line") != F.col("first")))
    gone = hits.groupBy(F.col("k0").alias(f"{mine}0"), F.col("k1").alias(f"{mine}1")).agg(F.collect_set("line").alias(f"{mine}gone"))

    @F.arrow_udf(result)
    def remove(text: pa.Array, gone: pa.Array) -> pa.Array:
        rows = [kept(t.as_py(), lambda i, k, x=set(g.as_py() or ()): i in x) for t, g in zip(text, gone)]
        return pa.StructArray.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["n_lines", "n_dropped", "kept"])

    out = keyed.join(gone, [f"{mine}0", f"{mine}1"], "left").withColumn(mine, remove("text", f"{mine}gone"))
    return out.select(*names, f"{mine}.n_lines", f"{mine}.n_dropped", f"{mine}.kept")

