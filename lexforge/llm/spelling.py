"""Grouping of spelling variants by full neighbourhoods.

Every word of the vocabulary emits all its distinct deletions, replacements and insertions over the alphabet
that the vocabulary uses. Candidates are joined with the vocabulary by their text; who is in it is near, and no
distance is ever worked out. A word of L letters has about 2 L |alphabet| candidates, nearly all of which are no
words, so Bloom filters of the vocabulary keep those from being made into text and shuffled. A filter has a fixed
largest size; a larger vocabulary gets one for each of several ranges of hashes, with a pass over the
words (not the texts) for each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._plan import checkpointed, small_batches
from ._text import BASE, CHUNK_BYTES, find_words, lower_table, mixed, text_chunks

#: Different words that a task counts before it hands the sums on.
HELD_WORDS = 500_000
#: Bits for each word and probes of the filters, and the largest filter: 2^29 bits are 64 MB, for some 22 million words a pass.
BITS_PER_WORD, PROBES, MOST_BITS = 24, 4, 1 << 29
#: Words of a task that makes candidates, and those whose candidates are hashed together.
TASK_WORDS, TOGETHER = 10_000, 1000


def inside_runs(data: np.ndarray) -> np.ndarray:
    """1 for the bytes of runs [A-Za-z\\u00C0-\\u00FF]+ in UTF-8, else 0: such a letter beyond ASCII is 0xC3 and one more byte."""
    lead = data == 0xC3
    inside = ((data | 0x20) >= 97) & ((data | 0x20) <= 122) | lead
    inside[1:] |= lead[:-1]
    return inside.astype(np.uint8)


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, their inside_runs, offsets) of a chunk of texts; one text longer than twice the limit comes in pieces cut between runs."""
    inside = inside_runs(data)
    if len(offsets) > 2 or len(data) <= 2 * limit:
        yield data, inside, offsets
        return
    gaps = np.flatnonzero(inside == 0)
    start = 0
    while start < len(data):
        at = np.searchsorted(gaps, start + limit)
        end = int(gaps[at]) + 1 if at < len(gaps) else len(data)
        yield data[start:end], inside[start:end], np.array([0, end - start])
        start = end


def slipped(word: bytes, h: int, slips: int) -> bytes:
    """The run without the letter at h by its length, where slips divides h."""
    if h % slips:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, slips: int | None = 31) -> DataFrame:
    """(word, n) of the runs of letters, A-Z lower-cased, of at least least_length letters that occur at least least_count times.

    With slips, a run loses one letter first where slips divides h, the crc32 of "doc_id:run", so that a known share
    of all runs is misspelt; the letter's place is h by the run's length. Runs of rows without a
    doc_id stay as they are. A null or empty text has none. Tasks sum up before the shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, table, held = lower_table(), np.array([False, True]), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, chunk, bounds in text_chunks(batch.column(1)):
                for data, inside, offsets in pieces(chunk, bounds, CHUNK_BYTES):
                    words = find_words(inside, offsets, table)
                    more = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
                    size = words.ends - words.starts - (more[words.ends] - more[words.starts])
                    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
                    text, long = low[data].tobytes(), size >= least_length
                    found = [text[a:b] for a, b in zip(words.starts[long].tolist(), words.ends[long].tolist())]
                    if slips is not None:
                        heads = [None if i is None else zlib.crc32(f"{i}:".encode()) for i in ids[row : row + len(offsets) - 1]]
                        owners = [heads[d] for d in doc[long].tolist()]
                        found = [w if head is None else slipped(w, zlib.crc32(w, head), slips) for w, head in zip(found, owners)]
                        found = [w for w, n in zip(found, size[long].tolist()) if n > least_length or len(w) >= least_length and len(w.decode()) >= least_length]
                    held.update(found)
                    if len(held) > HELD_WORDS:
                        yield flush()
        if held:
            yield flush()

    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds) of a column of words."""
    texts = column.to_pylist()
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def powers(most: int) -> np.ndarray:
    """The base's powers from 0 to most, modulo 2^64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(most, BASE, np.uint64)]))


def plain_hashes(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words, as neighbours() makes those of candidates."""
    size = np.diff(bounds)
    at = np.arange(len(points)) - np.repeat(bounds[:-1], size)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(int(size.max(initial=0)) + 1)[at], out=sums[1:])
    return mixed(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64))


def neighbours(points: np.ndarray, bounds: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(letter, word, place, hash) of all candidates, an edit at a time, as edited() reads them.

    Different edits that give the same text come once: of equal letters in a row the first is deleted, and a
    letter goes in before its equals, never behind one.
    """
    size = np.diff(bounds)
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(points)) - bounds[:-1][word]
    up = powers(int(size.max(initial=0)) + 2)
    value = points.astype(np.uint64) + np.uint64(1)
    term = value * up[at]
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(term, out=sums[1:])
    before = sums[:-1] - sums[bounds[:-1]][word]
    total = sums[bounds[1:]] - sums[bounds[:-1]]
    after = total[word] - before - term
    length = size.astype(np.uint64)
    # Letters after a deletion move down a place; the sums of what moves are divided by the base.
    down = np.uint64(pow(BASE, -1, 1 << 64))
    again = np.zeros(len(points), bool)
    again[1:] = (points[1:] == points[:-1]) & (word[1:] == word[:-1])
    own = ~again
    yield np.full(own.sum(), -1), word[own], at[own], mixed(before[own] + after[own] * down + length[word[own]] - np.uint64(1))
    # Places to put a letter in: before each letter, and at the end.
    gap_word = np.concatenate([word, np.arange(len(size))])
    gap_at = np.concatenate([at, size])
    gap_before, gap_after = np.concatenate([before, total]), np.concatenate([total[word] - before, np.zeros(len(size), np.uint64)]) * np.uint64(BASE)
    left = np.full(len(gap_word), np.iinfo(np.uint32).max, np.uint32)
    inner = np.flatnonzero(at > 0)
    left[inner] = points[inner - 1]
    some = size > 0
    left[len(points) :][some] = points[bounds[1:][some] - 1]
    for c in alphabet:
        v = np.uint64(int(c) + 1)
        other = points != c
        yield np.full(other.sum(), int(c)), word[other], at[other], mixed(before[other] + v * up[at[other]] + after[other] + length[word[other]])
        free = left != c
        yield np.full(free.sum(), int(c) + (1 << 32)), gap_word[free], gap_at[free], mixed(gap_before[free] + v * up[gap_at[free]] + gap_after[free] + length[gap_word[free]] + np.uint64(1))


def edited(text: str, letter: int, place: int) -> str:
    """The candidate that neighbours() names: -1 deletes the letter at place, a letter beyond 32 bits goes in before it, another replaces it."""
    if letter < 0:
        return text[:place] + text[place + 1 :]
    if letter >= 1 << 32:
        return text[:place] + chr(letter - (1 << 32)) + text[place:]
    return text[:place] + chr(letter) + text[place + 1 :]


def bit_places(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit of each hash at a probe; bits is a power of two."""
    return ((hashes + np.uint64(probe) * ((hashes >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(ranges)).astype(np.int64)


def filters(vocab: DataFrame, bits: int, ranges: int) -> list[np.ndarray]:
    """A Bloom filter for each range of hashes, as words of 64 bits: set bits are united by word before they reach the driver, bits / 64 of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = plain_hashes(*letters(batch.column(0)))
            mine = range_of(hashes, ranges)
            for p in range(PROBES):
                places = bit_places(hashes, p, bits)
                yield pa.RecordBatch.from_arrays([pa.array(mine.astype(np.int32)), pa.array((places >> 6).astype(np.int32)), pa.array(np.left_shift(np.int64(1), places & 63))], ["part", "at", "mask"])

    united = vocab.select("word").mapInArrow(run, "part int, at int, mask long").groupBy("part", "at").agg(F.bit_or("mask").alias("mask"))
    united = checkpointed(united) if ranges > 1 else united
    found = []
    for r in range(ranges):
        rows = united.where(F.col("part") == r).select("at", "mask").toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[rows.column("at").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
        found.append(words)
    return found


def candidates(vocab: DataFrame, alphabet: list[int], most_bits: int = MOST_BITS) -> DataFrame:
    """(word, n, candidate) of all candidates of the words that the filters let through: every word's near words, and a few that are no words."""
    spark, total = vocab.sparkSession, vocab.count()
    wanted = BITS_PER_WORD * max(1, total)
    bits = min(most_bits, 1 << max(12, (wanted - 1).bit_length()))
    ranges = max(1, -(-wanted // bits))
    known = np.array(sorted(alphabet), np.int64)
    # Few bytes of words make many candidates, so they are dealt out by their number.
    words = vocab.select("word", "n").repartition(-(-max(1, total) // TASK_WORDS), "word")
    found = None
    for r, bitmap in enumerate(filters(vocab, bits, ranges)):
        shared = spark.sparkContext.broadcast(bitmap)
        part = words.mapInArrow(passing(shared, known, bits, r, ranges), "word string, n long, candidate string")
        found = part if found is None else found.unionByName(part)
    return found


def passing(shared, alphabet: np.ndarray, bits: int, part: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                texts, kept = batch.column(0).to_pylist(), []
                for letter, word, place, hashes in neighbours(*letters(batch.column(0)), alphabet):
                    left = np.arange(len(hashes))
                    for p in range(PROBES):
                        places = bit_places(hashes[left], p, bits)
                        left = left[(bitmap[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1]
                    left = left[range_of(hashes[left], ranges) == part] if ranges > 1 else left
                    kept.append((word[left], [edited(texts[w], x, p) for w, x, p in zip(word[left].tolist(), letter[left].tolist(), place[left].tolist())]))
                owner = np.concatenate([k[0] for k in kept])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array([c for k in kept for c in k[1]], pa.string())], ["word", "n", "candidate"])

    return run


def best(n: Column, word: Column) -> Column:
    """The least of these structs has the largest n, and of equal ones the smallest word in code-point order."""
    return F.struct((-n).alias("less"), word.alias("form"))


def variant_groups(docs: DataFrame, least_length: int = 7, least_count: int = 2, times: int = 10, slips: int | None = 31, most_bits: int = MOST_BITS) -> DataFrame:
    """Every word of the corpus with its form: (word, n, n_near, form, form_n, root).

    docs needs doc_id and text; see vocabulary for words, slips and nulls. Two words
    are near if one inserted, deleted or replaced letter makes one of the other. form is the near word of
    the largest n (ties: the smallest in code-point order) if that is at least times the word's own, else null;
    root is the last word when forms are followed, the word itself without one. Rows that repeat count
    again, an empty table gives no rows, further columns don't matter. Being near is mutual, so
    that a candidate brings its word to the near word's own task: one shuffle counts and chooses, and no word
    has more than its neighbourhood.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    vocab = checkpointed(vocabulary(docs, least_length, least_count, slips))
    most = vocab.agg(F.max("n")).first()[0] or 1
    alphabet = [ord(r.c) for r in vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()]
    met = candidates(vocab, alphabet, most_bits).groupBy(F.col("candidate").alias("word")).agg(F.count("*").alias("n_near"), F.min(best(F.col("n"), F.col("word"))).alias("b"))
    known = vocab.join(met, "word", "left")
    good = -F.col("b.less") >= F.col("n") * times
    formed = checkpointed(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("b.form")).alias("form"), F.when(good, -F.col("b.less")).alias("form_n")))
    # Each step to a form multiplies n by times, so that there are few; a root found is twice as far on with each join.
    hops = 0
    while least_count * times ** (hops + 1) <= most:
        hops += 1
    roots, reach = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 1
    while reach < hops:
        roots = checkpointed(roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        reach *= 2
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
