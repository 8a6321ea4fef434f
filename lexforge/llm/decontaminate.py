"""Benchmark decontamination with suffix arrays of the training texts.

Each chunk of training documents gets a suffix array of its words; every suffix of the benchmark
items is found in it by binary search over its first words, and matches that go on from place to place
give the longest verbatim ones. Words that no item holds cannot be in a match, so suffixes are only
kept where enough words in a row are known to the benchmark and the first of them starts a test
window; this leaves the array small without losing a match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import free, row_key, small_batches
from ._text import Roller, Words, find_words, letter_table, lower_table, text_chunks

WINDOW = 13
#: Words of benchmark text that one pass over the documents takes; a larger benchmark takes more passes.
PASS_WORDS = 2_000_000


@dataclass
class Windows:
    """The different test windows of one length: a start of each, the items that hold it (items[first[k]:first[k + 1]]) and all its starts (alike)."""

    length: int
    start: np.ndarray
    items: np.ndarray
    item_first: np.ndarray
    places: np.ndarray
    place_first: np.ndarray


@dataclass
class Tests:
    """Benchmark items: their words as ranks in a sorted vocabulary of hashes, one item after another, and their windows by length."""

    items: list
    width: int
    vocabulary: np.ndarray
    spelled: list[bytes]
    ranks: np.ndarray
    windows: list[Windows]

    def plain(self) -> tuple:
        """Lists and arrays only, for a broadcast that workers can read without this package."""
        arrays = [(w.length, w.start, w.items, w.item_first, w.places, w.place_first) for w in self.windows]
        return self.items, self.width, self.vocabulary, self.spelled, self.ranks, arrays

    @staticmethod
    def of(plain: tuple) -> Tests:
        return Tests(*plain[:5], [Windows(*w) for w in plain[5]])


def different(ranks: np.ndarray, starts: np.ndarray, item: np.ndarray, length: int) -> Windows:
    """Windows of length words at starts, equal ones put together."""
    words = [ranks[starts + i] for i in range(length)]
    order = np.lexsort([starts, *reversed(words)])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for w in words:
        new[1:] |= w[order][1:] != w[order][:-1]
    window = np.cumsum(new) - 1
    pairs = np.unique(np.stack([window, item[order]]), axis=1)
    bounds = lambda x: np.searchsorted(x, np.arange(window[-1] + 2))
    return Windows(length, starts[order][new], pairs[1], bounds(pairs[0]), starts[order], bounds(window))


def prepare(rows: list[tuple], width: int) -> Tests:
    """Tests of (item id, text) rows. A window starts at every word with enough words behind it; items of fewer words are one window."""
    rows = [r for r in rows if r[1]]
    starts, item, length, hashes, spelled = [], [], [], [], []
    roller, lower, letters = Roller(), lower_table(), letter_table()
    at = 0
    for first, data, offsets in text_chunks(pa.array([r[1] for r in rows], pa.large_string())):
        words = find_words(lower[data], offsets, letters)
        hashes.append(roller.words(words))
        spelled += [words.data[s:e].tobytes() for s, e in zip(words.starts, words.ends)]
        for d in range(len(offsets) - 1):
            n = int(words.first[d + 1] - words.first[d])
            count = 1 if 0 < n < width else max(0, n - width + 1)
            starts += range(at, at + count)
            item += [first + d] * count
            length += [min(n, width)] * count
            at += n
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    vocabulary, where, ranks = np.unique(hashes, return_index=True, return_inverse=True)
    starts, item, length = (np.array(x, np.int64) for x in (starts, item, length))
    windows = [different(ranks, starts[length == n], item[length == n], int(n)) for n in np.unique(length)]
    return Tests([r[0] for r in rows], width, vocabulary, [spelled[i] for i in where], ranks.astype(np.int64), windows)


def suffix_array(ranks: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """places in the order of the words that follow them, to a depth; ranks ends with depth words of -1."""
    return places[np.lexsort([ranks[places + i] for i in reversed(range(depth))])]


def search(ranks: np.ndarray, array: np.ndarray, test: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each test window, the range of the suffix array whose suffixes begin with it; narrowed word by word by binary search."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
    for i in range(length):
        live = low < high
        word = test[starts + i]
        ends = []
        for side in (False, True):
            a, b = low.copy(), high.copy()
            while (open_ := live & (a < b)).any():
                mid = (a + b) // 2
                value = ranks[array[np.minimum(mid, len(array) - 1)] + i]
                right = open_ & ((value <= word) if side else (value < word))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            ends.append(a)
        low, high = np.where(live, ends[0], low), np.where(live, ends[1], high)
    return low, high


def longest_from(places: np.ndarray, window: np.ndarray, tests: Windows) -> np.ndarray:
    """For the hit places of a text in order, each with its window: the words of the longest verbatim match that ends with this window.

    A match goes on where the next place holds a window that follows one of the last place's in its item.
    """
    out = np.zeros(len(places), np.int64)
    starts, size, before = np.zeros(0, np.int64), np.zeros(0, np.int64), -2
    for i, (p, k) in enumerate(zip(places.tolist(), window.tolist())):
        now = tests.places[tests.place_first[k] : tests.place_first[k + 1]]
        new = np.full(len(now), tests.length, np.int64)
        if p == before + 1:
            at = np.minimum(np.searchsorted(starts, now - 1), len(starts) - 1)
            new = np.where(starts[at] == now - 1, size[at] + 1, new)
        starts, size, before = now, new, p
        out[i] = new.max()
    return out


def right_words(tests: Tests, words: Words, rank: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of word places that were found by hash, whether their bytes are those of the test word."""
    good = np.zeros(len(places), bool)
    order = np.argsort(rank[places], kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(rank[places][order])) + 1):
        want = np.frombuffer(tests.spelled[rank[places[part[0]]]], np.uint8)
        start = words.starts[places[part]]
        same = words.ends[places[part]] - start == len(want)
        inside = np.minimum(start[:, None] + np.arange(len(want)), len(words.data) - 1)
        good[part] = same & (words.data[inside] == want).all(axis=1)
    return good


def matches(tests: Tests, data: np.ndarray, offsets: np.ndarray, roller: Roller) -> Iterator[tuple[int, np.ndarray | None, list[int], int, int | None]]:
    """For each text of a chunk: its words, which of them are hit (None without a hit), items found, and the length and start of its longest match."""
    words = find_words(lower_table()[data], offsets, letter_table())
    n = len(words.starts)
    found, hits = [], np.zeros(n + 1, np.int64)
    best, best_end = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    if len(tests.vocabulary) and n:
        hashes = roller.words(words)
        rank = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
        known = tests.vocabulary[rank] == hashes
        for again in (False, True):
            ranks = np.concatenate([np.where(known, rank, -1), np.full(tests.width, -1)])
            # run[i]: known words in a row from word i, within its document
            stop = np.where(known, np.iinfo(np.int64).max, np.arange(n))
            run = np.minimum(np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n), words.room())
            found = [x for w in tests.windows if (x := found_in(tests, w, ranks, run))]
            hits[:] = 0
            for w, place, _ in found:
                np.add.at(hits, place, 1)
                np.add.at(hits, place + w.length, -1)
            places = np.flatnonzero(np.cumsum(hits[:-1]) > 0)
            good = right_words(tests, words, rank, places) if len(places) and not again else np.ones(len(places), bool)
            if good.all():
                break
            # Another word with the hash of a test word: it is unknown, and what it was part of is searched anew.
            known[places[~good]] = False
    pairs = [np.zeros((2, 0), np.int64)]
    for w, place, window in found:
        doc = np.searchsorted(words.first, place, "right") - 1
        of_doc = np.unique(np.stack([doc, window]), axis=1)
        count = w.item_first[of_doc[1] + 1] - w.item_first[of_doc[1]]
        at = np.repeat(w.item_first[of_doc[1]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        pairs.append(np.stack([np.repeat(of_doc[0], count), w.items[at]]))
        size = longest_from(place, window, w) if w.length == tests.width else np.full(len(place), w.length)
        order = np.lexsort([place, -size, doc])
        first = order[np.unique(doc[order], return_index=True)[1]]
        longer = first[size[first] > best[doc[first]]]
        best[doc[longer]], best_end[doc[longer]] = size[longer], place[longer] + w.length
    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
    ends = np.searchsorted(pairs[0], np.arange(len(offsets)))
    covered = np.cumsum(hits[:-1]) > 0
    for d in range(len(offsets) - 1):
        a, b = words.first[d], words.first[d + 1]
        items = pairs[1][ends[d] : ends[d + 1]].tolist()
        yield int(b - a), covered[a:b] if items else None, items, int(best[d]), int(best_end[d] - best[d] - a) if best[d] else None


def found_in(tests: Tests, w: Windows, ranks: np.ndarray, run: np.ndarray) -> tuple[Windows, np.ndarray, np.ndarray] | None:
    """(w, places in order, the window at each place) of the windows of one length in a chunk's words."""
    leads = np.zeros(len(tests.vocabulary), bool)
    leads[tests.ranks[w.start]] = True
    places = np.flatnonzero((run >= w.length) & leads[np.maximum(ranks[: len(run)], 0)])
    if not len(places):
        return None
    array = suffix_array(ranks, places, w.length)
    low, high = search(ranks, array, tests.ranks, w.start, w.length)
    count = high - low
    if not count.sum():
        return None
    at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    place, window = array[at], np.repeat(np.arange(len(count)), count)
    order = np.argsort(place)
    return w, place[order], window[order]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """Verbatim matches of benchmark windows in every document.

    docs needs doc_id and text, benchmark item_id and text. Returns one row per row of docs: doc_id, n_words
    (long), n_hit (long: words inside any occurrence of a window of width item words; a shorter item is one
    window), items (sorted array of item_ids as strings, each once), spans (the hit words as an array of
    (start, end)), longest and longest_start (words of the longest verbatim match with an item, which holds a
    window, and its first word, the leftmost of equals; 0 and null without a hit), key0 and key1 (of the row's
    content). Null texts have no words; items without words and an empty benchmark hit nothing; an item
    without an id hits, but is not listed; repeated rows are alike; extra columns are ignored. A benchmark of
    more than pass_words words (counted as characters / 2 at most) takes several passes of bounded size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    letters = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-letters // (2 * pass_words)))
    parts = []
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key0 long, key1 long, n_words long, items array<string>, spans array<struct<start:long,end:long>>, longest long, longest_start long"
    for i in range(passes):
        chosen = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i) if passes > 1 else benchmark
        rows = [(str(r.item_id) if r.item_id is not None else None, r.text) for r in chosen.select("item_id", "text").toLocalIterator()]
        tests = spark.sparkContext.broadcast(prepare(rows, width).plain())
        parts.append(docs.select("doc_id", "text", *row_key("doc_id", "text")).mapInArrow(scanner(tests), schema))
    hits = parts[0]
    for part in parts[1:]:
        other = part.groupBy("key0", "key1").agg(*(F.first(c).alias(n) for c, n in (("items", "more"), ("spans", "wider"), ("longest", "longer"), ("longest_start", "longer_start"))))
        better = F.struct(-F.col("longer"), "longer_start") < F.struct(-F.col("longest"), "longest_start")
        one = {"items": F.array_sort(F.array_union("items", "more")), "spans": F.concat("spans", "wider"), "longest": F.greatest("longest", "longer"), "longest_start": F.when(F.col("longer") == 0, F.col("longest_start")).when((F.col("longest") == 0) | better, F.col("longer_start")).otherwise(F.col("longest_start"))}
        hits = hits.join(other, ["key0", "key1"]).withColumns(one).drop("more", "wider", "longer", "longer_start")
    places = F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]) if passes == 1 else F.size(F.array_distinct(F.flatten(places))).cast("long")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans", "longest", "longest_start", "key0", "key1")


def scanner(tests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, roller = Tests.of(tests.value), Roller()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            counts, items, spans, longest, starts = [], [], [], [], []
            for _, data, offsets in text_chunks(batch.column(1)):
                for n, covered, found, size, start in matches(known, data, offsets, roller):
                    counts.append(n)
                    longest.append(size)
                    starts.append(start)
                    items.append(sorted({known.items[k] for k in found if known.items[k] is not None}))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))) if covered is not None else np.zeros(0, np.int64)
                    spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span), pa.array(longest, pa.int64()), pa.array(starts, pa.int64())],
                ["doc_id", "key0", "key1", "n_words", "items", "spans", "longest", "longest_start"],
            )

    return run


def contaminated():
    """At least a twentieth of the words, and one, are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs without the rows that contaminated() names; their keys are joined to the rows by content."""
    bad = benchmark_hits(docs, benchmark, width).where(contaminated()).select("key0", "key1").distinct()
    mine = free(docs, "__key")
    keyed = docs.select("*", *row_key("doc_id", "text", prefix=mine))
    return keyed.join(bad.toDF(f"{mine}2", f"{mine}3"), F.expr(f"{mine}0 = {mine}2 AND {mine}1 = {mine}3"), "left_anti").drop(f"{mine}0", f"{mine}1")
