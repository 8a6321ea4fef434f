"""Removal of word passages that occur more than once, with suffix automata of reference shards.

The corpus is its own reference, which no broadcast can hold, so documents are not streamed through
shards of everything. Every window of WINDOW words names an anchor, the least hash of its runs of
GRAM words; equal windows name equal anchors. Places of a repeated anchor form a shard: its passages
(with equal ones counted) make a suffix automaton, through which each of them is streamed for
matching statistics. A window whose state has two or more places is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import checkpointed, row_key, small_batches
from ._text import BASE, Roller, Words, find_words, space_table, text_chunks

WINDOW, GRAM = 35, 8
#: Windows of one passage; a longer run of windows with one anchor is cut.
MOST_WINDOWS = 64
#: Passages of a shard that is made into one automaton; windows of commoner anchors are counted one by one.
SHARD = 2048
#: Parts that the rows of one hot window are dealt out to.
SALTS = 32
OTHER_BASE = 0xD6E8FEB86659FD93


class Automaton:
    """Suffix automaton of word lists; each list weighs as often as it occurs."""

    def __init__(self) -> None:
        self.step: list[dict[bytes, int]] = []
        self.link: list[int] = []
        self.length: list[int] = []
        self.places: list[int] = []
        self.state(0, {}, -1)

    def state(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.step) - 1

    def split(self, at: int, word: bytes) -> int:
        """The state for the words of state at and one more: a copy takes them over from a state that holds longer ones too."""
        old = self.step[at][word]
        if self.length[old] == self.length[at] + 1:
            return old
        copy = self.state(self.length[at] + 1, dict(self.step[old]), self.link[old])
        self.link[old] = copy
        while at != -1 and self.step[at].get(word) == old:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[bytes], weight: int) -> None:
        last = 0
        for word in words:
            if word in self.step[last]:
                last = self.split(last, word)
            else:
                new, at = self.state(self.length[last] + 1, {}, 0), last
                while at != -1 and word not in self.step[at]:
                    self.step[at][word] = new
                    at = self.link[at]
                if at != -1:
                    self.link[new] = self.split(at, word)
                last = new
            self.places[last] += weight

    def close(self) -> None:
        """Pass the numbers of places on to the suffixes."""
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]

    def repeated(self, words: list[bytes], width: int) -> list[bool]:
        """For each window of width words, whether it has two places or more; words must have been added."""
        state, matched, out = 0, 0, []
        for word in words:
            state, matched = self.step[state][word], matched + 1
            while self.length[self.link[state]] >= width:
                state = self.link[state]
            if matched >= width:
                out.append(self.places[state] >= 2)
        return out


def shard_windows(passages: dict[bytes, int], width: int) -> dict[bytes, list[tuple[int, int]]]:
    """For each passage of a shard with its number of places: the word ranges covered by repeated windows."""
    split = {p: p.split(b" ") for p in passages}
    automaton = Automaton()
    for p, w in split.items():
        automaton.add(w, passages[p])
    automaton.close()
    out = {}
    for p, w in split.items():
        flags = np.array(automaton.repeated(w, width), np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]))).reshape(-1, 2)
        out[p] = [(int(a), int(b) + width - 1) for a, b in edges]
    return out


def anchored(words: Words, hashes: np.ndarray, roller: Roller, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of the runs of windows of a chunk that share an anchor."""
    none = np.zeros(0, np.int64)
    if len(hashes) < width:
        return none.astype(np.uint64), none, none
    gram = min(GRAM, width)
    least, span, need = roller.windows(hashes, gram), 1, width - gram + 1
    while span * 2 <= need:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < need:
        least = np.minimum(least[: len(least) - (need - span)], least[need - span :])
    at = np.flatnonzero(words.room()[: len(least)] >= width)
    if not len(at):
        return none.astype(np.uint64), none, none
    anchor = least[at]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - begin) % MOST_WINDOWS == 0
    first = np.flatnonzero(new)
    return anchor[first], at[first], np.diff(np.append(first, len(at)))


def anchor_places(hashes: np.ndarray, roller: Roller, anchor: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """How often each run of windows holds its anchor; more than once, it may repeat a window by itself."""
    if not len(first):
        return first
    grams = roller.windows(hashes, min(GRAM, width))
    size = count + width - min(GRAM, width)
    begin = np.cumsum(size) - size
    at = np.repeat(first - begin, size) + np.arange(size.sum())
    return np.add.reduceat((grams[at] == np.repeat(anchor, size)).astype(np.int64), begin)


def doc_anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, table = Roller(), space_table()
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for row, data, offsets in text_chunks(batch.column(0)):
                words = find_words(data, offsets, table)
                hashes = roller.words(words)
                anchor, first, count = anchored(words, hashes, roller, width)
                doc = np.searchsorted(words.first, first, "right") - 1 + row
                places = anchor_places(hashes, roller, anchor, first, count, width)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(keys[doc]), pa.array(np.minimum(places, 2).astype(np.int32))], ["anchor", "key0", "places"])

    return run


def passages(width: int):
    """Rows (doc_id, text, key0, key1, anchors) to the passages of these anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, table = Roller(), space_table()
        for batch in batches:
            key0, key1 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for row, data, offsets in text_chunks(batch.column(1)):
                words = find_words(data, offsets, table)
                anchor, first, count = anchored(words, roller.words(words), roller, width)
                wanted = batch.column(4).slice(row, len(offsets) - 1).flatten().to_numpy().view(np.uint64)
                keep = np.isin(anchor, wanted)
                anchor, first, count = anchor[keep], first[keep], count[keep]
                doc = np.searchsorted(words.first, first, "right") - 1
                raw = data.tobytes()
                spans = zip(words.starts[first].tolist(), words.ends[first + count + width - 2].tolist()) if len(first) else ()
                texts = [b" ".join(raw[s:e].split()) for s, e in spans]
                for i in range(0, len(first), 10_000):
                    cut = slice(i, i + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[cut].view(np.int64)), pa.array(texts[cut], pa.binary()), pa.array(key0[doc[cut] + row]), pa.array(key1[doc[cut] + row]), pa.array((first - words.first[doc])[cut])],
                        ["anchor", "passage", "key0", "key1", "start"],
                    )

    return run


def single_windows(width: int):
    """Rows (doc_id, text, key0, key1, anchors) to two hashes of every window with one of these anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, other, table = Roller(), Roller(OTHER_BASE), space_table()
        for batch in batches:
            key0, key1 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for row, data, offsets in text_chunks(batch.column(1)):
                words = find_words(data, offsets, table)
                hashes = roller.words(words)
                anchor, first, count = anchored(words, hashes, roller, width)
                keep = np.isin(anchor, batch.column(4).slice(row, len(offsets) - 1).flatten().to_numpy().view(np.uint64))
                first, count = first[keep], count[keep]
                if not len(first):
                    continue
                at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                doc = np.searchsorted(words.first, at, "right") - 1
                w0, w1 = roller.windows(hashes, width)[at], other.windows(other.words(words), width)[at]
                for i in range(0, len(at), 50_000):
                    cut = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(w0[cut].view(np.int64)), pa.array(w1[cut].view(np.int64)), pa.array(key0[doc[cut] + row]), pa.array(key1[doc[cut] + row]), pa.array((at - words.first[doc])[cut])], ["w0", "w1", "key0", "key1", "start"])

    return run


def match_shards(width: int):
    """Rows (anchor, passage, key0, key1, start) sorted by anchor to the (key0, key1, start, end) that repeated windows cover."""

    def spans(rows: list[tuple]) -> Iterator[tuple]:
        counted: dict[bytes, int] = {}
        for r in rows:
            counted[r[1]] = counted.get(r[1], 0) + 1
        covered = shard_windows(counted, width)
        for _, passage, key0, key1, start in rows:
            for a, b in covered[passage]:
                yield key0, key1, start + a, start + b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if shard and shard[0][0] != row[0]:
                    out.extend(spans(shard))
                    shard = []
                shard.append(row)
            if out:
                yield packed(out)
                out = []
        if shard:
            out = list(spans(shard))
        if out:
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["key0", "key1", "start", "end"])

    return run


def repeated_spans(keyed: DataFrame, width: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """(key0, key1, start, end): word ranges of documents that repeated windows cover.

    keyed holds doc_id, text, key0, key1, one row per document; rows of equal content share keys and count
    each. Anchors of more than shard passages are the exact way for hot passages: their windows are counted
    one by one by 128-bit hash, summed up before the shuffle.
    """
    anchors = keyed.select("text", "key0").mapInArrow(doc_anchors(width), "anchor long, key0 long, places int")
    counts = anchors.groupBy("anchor").agg(F.sum("places").alias("places"), F.count("*").alias("passages")).where("places > 1")
    found = anchors.select("anchor", "key0").join(counts, "anchor").select("key0", "anchor", (F.col("passages") > shard).alias("hot"))
    found = checkpointed(found.groupBy("key0").agg(F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot_anchors")))
    schema = "anchor long, passage binary, key0 long, key1 long, start long"
    rows = keyed.join(found.where("size(anchors) > 0").select("key0", "anchors"), "key0").select("doc_id", "text", "key0", "key1", "anchors").mapInArrow(passages(width), schema)
    result = "key0 long, key1 long, start long, end long"
    spans = rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(match_shards(width), result)
    hot = found.where("size(hot_anchors) > 0").select("key0", F.col("hot_anchors").alias("anchors"))
    if not hot.isEmpty():
        windows = keyed.join(hot, "key0").select("doc_id", "text", "key0", "key1", "anchors").mapInArrow(single_windows(width), "w0 long, w1 long, key0 long, key1 long, start long")
        again = windows.groupBy("w0", "w1").agg(F.count("*").alias("places")).where("places > 1")
        # One window may hold a large share of the rows, so both sides are dealt out over SALTS parts of each window.
        again = again.select("w0", "w1", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        windows = windows.withColumn("salt", F.pmod(F.xxhash64("key0", "key1", "start"), F.lit(SALTS)).cast("int"))
        spans = spans.unionByName(windows.join(again, ["w0", "w1", "salt"]).select("key0", "key1", "start", (F.col("start") + width).alias("end")))
    return spans


def remove_repeats(docs: DataFrame, width: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Remove every word that a window of width words covers which also starts anywhere else.

    docs needs doc_id and text. Returns doc_id, n_words, n_removed (long) and kept (the other words joined
    by one space), one row per input row. Words are runs of other characters than ASCII white space; null
    and empty texts have none, and documents of fewer than width words lose nothing. Windows are judged on
    the input; a second place may be in the same document or in a repeated row. Other columns are unread.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    spans = repeated_spans(keyed, width, shard).groupBy("key0", "key1").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    spans = spans.withColumnRenamed("key1", "other1")

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept:string>")
    def clean(text: pa.Array, spans: pa.Array) -> pa.Array:
        n_words, n_removed, kept = [], [], []
        for t, s in zip(text, spans):
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
            stay, at = [], 0
            for span in s.as_py() or ():
                if span["start"] > at:
                    stay += words[at : span["start"]]
                at = max(at, span["end"])
            stay += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(stay))
            kept.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])

    # Joined by key0 alone, as the documents were above, so that both joins read one shuffle of them.
    joined = keyed.join(spans, (keyed.key0 == spans.key0) & (keyed.key1.bitwiseXOR(spans.other1) == 0), "left").select("doc_id", clean("text", "spans").alias("c"))
    return joined.select("doc_id", "c.n_words", "c.n_removed", "c.kept")
