"""Literal containment of many keys in many texts at once, without a join of all with all.

A table of rare runs of the keys' letters is looked up at every letter of the texts by rolling hashes; only where
one is found are the keys that hold it compared. One pass over the texts serves a slice of the keys of a
bounded size, so that neither the plan nor the rows grow with the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_keys, letter_table, lookup_key

#: Letters of the runs that are looked up; shorter keys are looked up whole.
ANCHOR = 8
#: Letters of texts or keys that are hashed or formed together, and bytes of keys that are broadcast together.
LETTERS, KEY_BYTES = 1 << 18, 16 << 20
BASE = 0x9E3779B97F4A7C15
#: Bits of a table of the runs that are looked up: so many more than those of their number, and the most.
SPARE_BITS, MOST_BITS = 6, 22
#: Bytes of rows that are worked on together.
ROW_BYTES = 4 << 20


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds) of texts that stand one after another."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


class Rolling:
    """Hashes of runs of letters by prefix sums modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, points: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(points):
            size = len(points) + 1
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
        out = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.up[: len(points)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (sums[ends] - sums[starts]) * self.down[starts] + np.asarray(ends - starts).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def mixed(self, sums: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of size letters, which takes fewer steps than its hash; its high bits are looked up first."""
        n = max(0, len(sums) - size)
        x = sums[size:] - sums[:n]
        x *= self.down[:n]
        x *= np.uint64(BASE)
        return x

    def first_bits(self, sums: np.ndarray, size: int, bits: int) -> np.ndarray:
        x = self.mixed(sums, size)
        x >>= np.uint64(64 - bits)
        return x.view(np.int64)


class Literals:
    """A set of keys that find() looks for in texts; an empty key is found nowhere."""

    def __init__(self, keys: list[str]):
        self.rolling = Rolling()
        self.sizes = np.array([len(k) for k in keys], np.int64)
        self.longest = int(self.sizes.max(initial=0))
        self.whole = np.zeros(len(keys), np.uint64)
        self.tables = []
        for size in np.unique(np.minimum(self.sizes[self.sizes > 0], ANCHOR)).tolist():
            mine = np.flatnonzero((self.sizes == size) if size < ANCHOR else (self.sizes >= ANCHOR))
            bits = min(MOST_BITS, int(self.sizes[mine].sum()).bit_length() + 1)
            times = np.zeros(1 << bits, np.int32)
            for _, _, _, place, sums in self.pieces(keys, mine, size):
                np.add.at(times, self.rolling.first_bits(sums, size, bits)[place], 1)
            # Each key is looked up by the run whose bits the fewest runs of all keys have.
            runs, mixed, offsets = np.zeros(len(mine), np.uint64), np.zeros(len(mine), np.uint64), np.zeros(len(mine), np.int64)
            for part, at, first, place, sums in self.pieces(keys, mine, size):
                number = mine[part]
                cost = times[self.rolling.first_bits(sums, size, bits)[place]].astype(np.int64) << 32 | (place - np.repeat(at, self.sizes[number] - size + 1))
                offsets[part] = np.minimum.reduceat(cost, first) & 0xFFFFFFFF
                begin = at + offsets[part]
                runs[part], mixed[part] = self.rolling.runs(sums, begin, begin + size), self.rolling.mixed(sums, size)[begin]
                self.whole[number] = self.rolling.runs(sums, at, at + self.sizes[number])
            by = np.argsort(runs, kind="stable")
            anchors, first, count = np.unique(runs[by], return_index=True, return_counts=True)
            bits = min(MOST_BITS, len(anchors).bit_length() + SPARE_BITS)
            bitmap = np.zeros(1 << bits, bool)
            bitmap[(mixed[by[first]] >> np.uint64(64 - bits)).view(np.int64)] = True
            self.tables.append((size, bits, bitmap, anchors, first, count, mine[by], offsets[by]))

    def pieces(self, keys: list[str], mine: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, starts, first runs, places of all runs of size letters, sums) of a part of the keys mine at a time, of about LETTERS letters."""
        for start, end in spans(self.sizes[mine], most_bytes=LETTERS):
            points, bounds = code_points([keys[i] for i in mine[start:end].tolist()])
            at, room = bounds[:-1], self.sizes[mine[start:end]] - size + 1
            first = np.cumsum(room) - room
            yield slice(start, end), at, first, np.arange(room.sum()) + np.repeat(at - first, room), self.rolling.sums(points)

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, key) of every key that a text holds, each pair once; both by number. A null text holds none."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        part, rows, letters = [], [], 0
        step = max(LETTERS, 2 * self.longest)
        for i, text in enumerate(texts):
            # A very long text is cut into pieces that overlap by a key.
            for start in range(0, max(1, len(text or "") - self.longest + 1), step):
                piece = (text or "")[start : start + step + self.longest]
                part.append(piece)
                rows.append(i)
                letters += len(piece)
                if letters > LETTERS:
                    found.append(self.held(part, rows))
                    part, rows, letters = [], [], 0
        found.append(self.held(part, rows))
        text, key = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(text * max(1, len(self.sizes)) + key)
        return pairs // max(1, len(self.sizes)), pairs % max(1, len(self.sizes))

    def held(self, part: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        points, bounds = code_points(part)
        sums, texts, keys = self.rolling.sums(points), [], []
        for size, bits, bitmap, anchors, first, count, key, offset in self.tables:
            at = np.flatnonzero(bitmap[self.rolling.first_bits(sums, size, bits)])
            run = self.rolling.runs(sums, at, at + size)
            spot = np.minimum(np.searchsorted(anchors, run), len(anchors) - 1)
            same = anchors[spot] == run
            at, spot = at[same], spot[same]
            each = count[spot]
            which = np.repeat(first[spot], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            begin = np.repeat(at, each) - offset[which]
            row = np.searchsorted(bounds, np.repeat(at, each), "right") - 1
            inside = (begin >= bounds[row]) & (begin + self.sizes[key[which]] <= bounds[row + 1])
            begin, row, which = begin[inside], row[inside], key[which[inside]]
            equal = self.rolling.runs(sums, begin, begin + self.sizes[which]) == self.whole[which]
            pairs = np.unique(row[equal] * max(1, len(self.sizes)) + which[equal])
            texts.append(pairs // max(1, len(self.sizes)))
            keys.append(pairs % max(1, len(self.sizes)))
        text, key = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (texts, keys))
        return np.array(rows, np.int64)[text], key


def key_slices(queries: DataFrame, columns: list[str], most_bytes: int = KEY_BYTES) -> Iterator[DataFrame]:
    """queries in slices whose key columns and ids take about most_bytes at most."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(64))
    total = queries.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-total // most_bytes))
    for i in range(parts):
        yield queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)


def matched(rows: DataFrame, queries: DataFrame, searched: list[tuple[str, str]], most_bytes: int = KEY_BYTES, measured: tuple[str, ...] = (), forms: dict[str, str] | None = None) -> DataFrame:
    """rows with the columns of each query that one of them matches, each pair once.

    searched: (column of rows, column of queries) pairs; the row's text has to hold the query's key, which is not
    empty. Rows and queries have no column in common. Values that rows of a batch share are looked up once. Texts of
    measured, columns that are searched for one key each, stay behind: a pair has {column}_held, whether that text holds the key, and {column}_length
    in place of them. forms names the columns searched that hold texts as they are, and which form of them (content or lookup)
    is searched and comes with the pairs; it is made where the text is searched, once for all rows of a batch that share it.
    """
    spark = rows.sparkSession
    types = {f.name: f.dataType.simpleString() for df in (rows, queries) for f in df.schema}
    kept = [c for c in rows.columns if c not in measured]
    types |= {f"{c}_held": "boolean" for c in measured} | {f"{c}_length": "int" for c in measured}
    names = [*kept, *(f"{c}_{x}" for c in measured for x in ("held", "length")), *queries.columns]
    schema = ", ".join(f"`{n}` {types[n]}" for n in names)
    keys = list(dict.fromkeys(q for _, q in searched))
    out = spark.createDataFrame([], schema)
    for part in key_slices(queries, keys, most_bytes):
        table = part.toArrow().combine_chunks()
        if not table.num_rows:
            continue
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        out = out.union(rows.mapInArrow(matching(shared, rows.columns, keys, searched, names, measured, forms), schema))
    return out


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ROW_BYTES at most."""
    for batch in batches:
        step = max(1, batch.num_rows * ROW_BYTES // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def spans(sizes: np.ndarray, most: int = 10_000, most_bytes: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows of these sizes, of about most_bytes (ROW_BYTES where this is not given) and of most rows at most."""
    ends, start, room = np.cumsum(sizes), 0, most_bytes or ROW_BYTES
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, min(start + most, int(np.searchsorted(ends, before + room, "right"))))
        yield start, end
        start = end


def text_bytes(columns: list[pa.Array]) -> np.ndarray:
    """The bytes of each row's texts."""
    sizes = np.full(len(columns[0]), 8, np.int64)
    for c in columns:
        if pa.types.is_dictionary(c.type) or pa.types.is_string(c.type):
            sizes += pc.fill_null(of_values(pc.binary_length, c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes


def of_values(function: Callable[[pa.Array], pa.Array], column: pa.Array) -> pa.Array:
    """The function of a column's texts, of each different one once where the column is a dictionary."""
    return function(column.dictionary).take(column.indices) if pa.types.is_dictionary(column.type) else function(column)


def former(kind: str) -> Callable[[list[str | None]], list[str | None]]:
    """A function that makes the forms of a kind, content or lookup, of texts."""
    if kind == "lookup":
        return lambda texts: [None if t is None else lookup_key(t) for t in texts]
    table = letter_table()
    return lambda texts: [t for start, end in spans(np.array([len(t or "") for t in texts], np.int64), most_bytes=LETTERS) for t in content_keys(texts[start:end], table)]


def matching(shared, columns: list[str], keys: list[str], searched: list[tuple[str, str]], names: list[str], measured: tuple[str, ...] = (), forms: dict[str, str] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        others = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in asked.columns]
        texts = {k: [x or "" for x in asked.column(k).to_pylist()] for k in keys}
        known = {k: Literals(texts[k]) for k in keys}
        key_bytes = text_bytes(others)
        formers = {column: former(kind) for column, kind in (forms or {}).items()}
        for batch in bounded(batches):
            pairs, held, current = [np.zeros(0, np.int64)], {}, dict(zip(columns, batch.columns))
            for column, key in searched:
                coded = current[column] if pa.types.is_dictionary(current[column].type) else current[column].dictionary_encode()
                values = coded.dictionary.to_pylist()
                if column in formers and coded is not current[column]:
                    values = formers[column](values)
                    current[column] = pa.DictionaryArray.from_arrays(coded.indices, pa.array(values, pa.string()))
                value, query = known[key].find(values)
                if column in measured:
                    true = np.array([texts[key][q] in values[v] for v, q in zip(value.tolist(), query.tolist())], bool)
                    value, query = value[true], query[true]
                of_row = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                # Rows by value, so that each match of a value comes for all rows that have it.
                order = np.argsort(of_row, kind="stable")
                low, high = np.searchsorted(of_row[order], value), np.searchsorted(of_row[order], value, "right")
                each = high - low
                row = order[np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
                pairs.append(row * asked.num_rows + np.repeat(query, each))
                held[column] = pairs[-1]
            found = np.unique(np.concatenate(pairs))
            rows = [c for n, c in current.items() if n not in measured]
            lengths = {c: of_values(pc.utf8_length, current[c]) for c in measured}
            sizes = text_bytes(rows)[found // asked.num_rows] + key_bytes[found % asked.num_rows] if len(found) else np.zeros(0)
            for start, end in spans(sizes):
                part = found[start:end]
                row, query = pa.array(part // asked.num_rows), pa.array(part % asked.num_rows)
                marks = [x for c in measured for x in (pa.array(np.isin(part, held[c])), lengths[c].take(row))]
                yield pa.RecordBatch.from_arrays([c.take(row).dictionary_decode() if pa.types.is_dictionary(c.type) else c.take(row) for c in rows] + marks + [c.take(query) for c in others], names)

    return run
