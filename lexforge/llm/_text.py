"""Vectorised tokenising and hashing of whole Arrow text columns.

A column's UTF-8 buffer is cut into chunks of whole documents; each chunk is tokenised at once
with byte tables, so that no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 21
BASE = 0x9E3779B97F4A7C15
SPACES = " \t\n\x0b\x0c\r"


def space_table() -> np.ndarray:
    """True for the bytes of words that white space [\\x20\\x09-\\x0D] separates."""
    table = np.ones(256, bool)
    table[list(SPACES.encode())] = False
    return table


def letter_table() -> np.ndarray:
    """True for bytes outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F], for text in which A-Z are lower-cased."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    content = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, content[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Words of a chunk: byte ranges into data, and first[d]:first[d + 1] are those of document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b]))

    def room(self) -> np.ndarray:
        """For each word, the number of words from it to the end of its document."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    inside = table[data]
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        begin[heads], end[tails] = inside[heads], inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roller:
    """Polynomial hashes of byte ranges and of word windows, by prefix sums modulo 2^64."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            factors = np.array([[1], [1]], np.uint64).repeat(n, axis=1)
            factors[:, 1:] = np.array([[self.base], [self.inverse]], np.uint64)
            self.up, self.down = np.cumprod(factors, axis=1)
        return self.up, self.down

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of values[starts:ends]."""
        up, down = self.powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def words(self, words: Words) -> np.ndarray:
        return self.ranges(words.data, words.starts, words.ends)

    def windows(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Hashes of every width neighbouring words, across documents too; mask with Words.room()."""
        starts = np.arange(max(0, len(hashes) - width + 1))
        return self.ranges(hashes, starts, starts + width)
