"""Language identification with a string kernel.

The kernel of two texts is the share of blended-spectrum n-grams that both hold: presence of each n-gram of one
to GRAMS bytes, counted once however often it occurs, over the n-grams that the landmark texts know best, and normed
by both texts' own numbers. Nyström's method maps a text to its kernels with a few landmarks, and one
kernel ridge regression for each language against the rest learns on that map. Whole texts are scored in batches:
one matrix product of their presence rows with the landmarks', one with the regressions' weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._plan import checkpointed, small_batches
from ._text import CHUNK_BYTES, text_chunks

#: Texts to learn from and landmarks among them, over all languages, each with an equal share; n-grams that the kernel compares.
SAMPLE_TEXTS, LANDMARKS, KNOWN_GRAMS = 4000, 192, 8192
GRAMS, RIDGE = 4, 1e-3
#: Bits of the table that finds an n-gram's column, and texts that are multiplied together.
TABLE_BITS, TOGETHER = 20, 128
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: the remainder 2 of crc32(doc_id as text) by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters_only(text: Column) -> Column:
    """Lower case, with one blank for every run of what is no letter, and one at both ends; null where there is no letter."""
    return F.when(text.rlike(r"\p{L}"), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" ")))


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, code) of the n-grams of each length; the code holds the bytes and the length, and no n-gram crosses texts."""
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)
    room = np.repeat(offsets[1:], size) - np.arange(len(data))
    code = np.zeros(len(data), np.int64)
    for n in range(1, GRAMS + 1):
        whole = room >= n
        keep = len(data) - n + 1
        if keep <= 0:
            return
        code = (code[:keep] << 8) | data[n - 1 :]
        yield text[:keep][whole[:keep]], code[whole[:keep]] | (n << 40)


def cut(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One text in pieces of a bounded size; neighbours overlap, so that each n-gram is in one of them."""
    for i in range(0, len(data), CHUNK_BYTES):
        piece = data[i : i + CHUNK_BYTES + GRAMS - 1]
        yield piece, np.array([0, len(piece)])


def slots(codes: np.ndarray, turn: int) -> np.ndarray:
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[turn]
    return (codes.astype(np.uint64) * np.uint64(odd)) >> np.uint64(64 - TABLE_BITS)


def looked_up(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tables from slots to columns; an n-gram whose slot in the first is taken stands in the second."""
    tables = np.full((2, 1 << TABLE_BITS), len(grams), np.int32)
    codes = np.append(grams, -1)
    left = np.arange(len(grams))
    for turn in range(2):
        tables[turn, slots(grams[left], turn)] = left
        left = left[tables[turn, slots(grams[left], turn)] != left]
    if len(left):
        raise ValueError("n-grams share slots in both tables")
    return tables, codes


def presence(texts: pa.Array, grams: np.ndarray, tables: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, rows of 0 and 1) of TOGETHER texts or fewer. A very long text is read in pieces."""
    for start in range(0, len(texts), TOGETHER):
        part = texts.slice(start, TOGETHER)
        rows = np.zeros((len(part), len(grams) + 1), np.float32)
        for first, data, offsets in text_chunks(part):
            for piece, bounds in [(data, offsets)] if len(offsets) > 2 else cut(data):
                for text, code in gram_codes(piece, bounds):
                    column = tables[0, slots(code, 0)]
                    lost = codes[column] != code
                    column[lost] = tables[1, slots(code[lost], 1)]
                    hit = codes[column] == code
                    rows[first + text[hit], column[hit]] = 1
        yield start, rows[:, :-1]


@dataclass
class Kernel:
    """Languages, the n-grams' codes, the landmarks' presence rows divided by their norms, and the weights from kernels to languages."""

    languages: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def plain(self) -> tuple:
        """Numbers and arrays only, for a broadcast that workers can read without this package."""
        return self.languages, self.grams, self.landmarks, self.weights


def kernels(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """The kernels of presence rows with the landmarks; a text without a known n-gram has none but zeros."""
    norm = np.sqrt(rows.sum(axis=1, keepdims=True))
    return (rows @ landmarks.T) / np.maximum(norm, 1)


def labelled(docs: DataFrame, texts: int) -> DataFrame:
    """(lang, part, order) of about texts different texts to learn from, each language with an equal share: those whose hash of doc_id is under its share.

    A language with less than its share gives all. Which rows come does not depend on partitions, and twice a language's share is never exceeded.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return usable.select("lang", F.col("text").alias("part"), F.lit(0).cast("long").alias("order"), F.lit(0).alias("place")).limit(0)
    share = max(1, texts // len(counts))
    under = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, share / n) * (1 << 53)))))
    chosen = usable.where(F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 11) <= under[F.col("lang")])
    parts = chosen.select("lang", letters_only(F.col("text")).alias("part")).where("part IS NOT NULL")
    # Copies count once, by the hash of their text; the order of the hashes is the order of choice.
    distinct = parts.groupBy("lang", F.xxhash64(F.lit(7), "part").alias("order")).agg(F.min("part").alias("part"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    return distinct.withColumn("place", turn).where(F.col("place") <= 2 * share)


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, landmarks: int = LANDMARKS, known_grams: int = KNOWN_GRAMS, ridge: float = RIDGE) -> Kernel:
    """Learn from about sample_texts texts (twice at most) outside the held-out quarter.

    docs needs doc_id, text and lang; rows with a null in one of them, and texts without a letter, teach nothing. Each
    language's first texts by hash are landmarks; the known_grams n-grams that most landmarks hold are compared
    (ties by code). Reruns agree. Without a usable row no language is known.
    """
    small_batches(docs.sparkSession)
    sample = checkpointed(labelled(docs, sample_texts))
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not languages:
        return Kernel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    each = max(1, landmarks // len(languages))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = np.zeros(0, np.int64)
                for _, data, _ in text_chunks(batch.column(0).slice(i, 1)):
                    for piece, bounds in cut(data):
                        held = np.unique(np.concatenate([held, *(np.unique(code) for _, code in gram_codes(piece, bounds))]))
                yield pa.RecordBatch.from_arrays([pa.array(held)], ["code"])

    known = sample.where(F.col("place") <= each).select("part").mapInArrow(found, "code long").groupBy("code").agg(F.count("*").alias("n"))
    grams = np.array(sorted(r.code for r in known.orderBy(F.desc("n"), "code").limit(known_grams).collect()), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        tables, codes = looked_up(known)
        for batch in batches:
            for start, rows in presence(batch.column(2), known, tables, codes):
                bits = np.packbits(rows > 0, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), batch.column(1).slice(start, len(rows)), pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "place", "bits"])

    table = sample.select("lang", "place", "part").mapInArrow(rows_of, "lang string, place int, bits binary").toArrow().sort_by([("place", "ascending"), ("lang", "ascending")])
    rows = np.unpackbits(np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(table.num_rows, -1), axis=1, count=len(grams)).astype(np.float32)
    chosen = table.column("place").to_numpy() <= each
    return fitted(languages, grams, rows, np.array(table.column("lang").to_pylist()), chosen, ridge)


def fitted(languages: list[str], grams: np.ndarray, rows: np.ndarray, lang: np.ndarray, chosen: np.ndarray, ridge: float) -> Kernel:
    """The regressions of presence rows with their languages; the chosen rows are landmarks."""
    marks = rows[chosen] / np.sqrt(np.maximum(rows[chosen].sum(axis=1, keepdims=True), 1))
    among = kernels(rows[chosen], marks).astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-6 * values.max()
    nystroem = vectors[:, good] / np.sqrt(values[good])
    mapped = kernels(rows, marks) @ nystroem
    # Languages weigh alike, however many texts each has.
    wanted = (lang[:, None] == np.array(languages)[None, :]).astype(float)
    weight = (wanted / wanted.sum(axis=0)).sum(axis=1)[:, None] / len(languages)
    solved = np.linalg.solve(mapped.T @ (weight * mapped) + ridge * np.eye(mapped.shape[1]), mapped.T @ (weight * wanted))
    return Kernel(languages, grams, marks.astype(np.float32), (nystroem @ solved).astype(np.float32))


def add_languages(docs: DataFrame, model: Kernel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and a score from 0 to 1, which replace columns of these names.

    Only text is read. A null text, one without a letter, and any text where no language was learned, is "und" with the score 0.
    The score is the best regression's part of all those above 0, to six decimals; a text of unknown letters only gets the first language
    and an equal part.
    """
    small_batches(docs.sparkSession)
    if not model.languages:
        return docs.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        languages, grams, landmarks, weights = shared.value
        tables, codes = looked_up(grams)
        best, part = np.zeros(len(text), np.int64), np.zeros(len(text))
        for start, rows in presence(text, grams, tables, codes):
            out = np.maximum(kernels(rows, landmarks) @ weights, 0).astype(np.float64)
            total = out.sum(axis=1)
            at = out.argmax(axis=1)
            best[start : start + len(rows)] = at
            part[start : start + len(rows)] = np.where(total > 0, out[np.arange(len(rows)), at] / np.where(total > 0, total, 1), 1 / len(languages))
        none = np.array(text.is_null())
        names = [UNKNOWN if n else languages[b] for n, b in zip(none, best)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(none, 0.0, np.round(np.clip(part, 0, 1), 6)))], ["lang", "score"])

    made = "__language"
    while any(c.lower() == made for c in docs.columns):
        made += "_"
    others = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    return docs.withColumn(made, predict(letters_only(F.col("text")))).select(*others, F.col(f"{made}.lang").alias(lang), F.col(f"{made}.score").alias(score))
