"""Structural chunking: whole texts, paragraphs, lines and notes. The packing folds run in Arrow batches, linear in the text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STRONG, WEAK, content_key
from .literal import bounded

BLANK_LINE = re.compile(r"\n\s*\n+")
MOST = {"poem": 480, "line": 200, "note": 800}
SCHEMA = "granularity string, chunk_index int, text string, normalized_text string, content_hash string, line_start int, line_end int, annotation_id long"


def pieces(text: str, most: int, strong: str = STRONG, weak: str = WEAK) -> list[str]:
    """text in pieces of at most most letters: apart at blank lines, else after the last strong mark, else the last weak one, of the second half, else hard."""
    out, todo = [], [text.replace("\r\n", "\n").replace("\r", "\n")]
    while todo:
        rest = todo.pop().strip()
        parts = [p for p in BLANK_LINE.split(rest) if p.strip()] if rest else []
        if len(parts) > 1:
            todo.extend(reversed(parts))
        elif len(rest) > most:
            half = rest[max(1, most // 2) : most]
            cuts = [max((half.rfind(c) for c in marks), default=-1) for marks in (strong, weak)]
            at = next((max(1, most // 2) + c + 1 for c in cuts if c >= 0), most)
            out.extend(p for p in [rest[:at].strip()] if p)
            todo.append(rest[at:])
        elif rest:
            out.append(rest)
    return out


def numbered_lines(content: str) -> list[tuple[int, str]]:
    flat = content.replace("\r\n", "\n").replace("\r", "\n")
    return [(n, line.strip()) for n, line in enumerate(flat.split("\n"), 1) if line.strip()]


def packed_lines(lines: list[tuple[int, str]], most: int) -> Iterator[tuple[str, int, int]]:
    """(text, first line, last line): all lines if they fit, else paragraphs, else lines packed greedily; a longer line is cut by itself."""
    if sum(len(t) + 1 for _, t in lines) - 1 <= most:
        yield "\n".join(t for _, t in lines), lines[0][0], lines[-1][0]
        return
    group: list[tuple[int, str]] = []
    size = 0
    for place, (n, t) in enumerate(lines):
        apart = place and n > lines[place - 1][0] + 1
        if group and (apart or len(t) > most or size + 1 + len(t) > most):
            yield "\n".join(x for _, x in group), group[0][0], group[-1][0]
            group = []
        if len(t) > most:
            for piece in pieces(t, most):
                yield piece, n, n
        else:
            size = size + 1 + len(t) if group else len(t)
            group.append((n, t))
    if group:
        yield "\n".join(x for _, x in group), group[0][0], group[-1][0]


def drafts(content: str | None, notes: list[dict] | None, most: dict[str, int] = MOST) -> list[tuple]:
    """Chunk rows of one text. A text without lines has no rows but those of its notes; a note with half a range, or a reversed one, is an error."""
    lines = numbered_lines(content or "")
    rows: dict[str, list[tuple]] = {"poem": [], "line": [], "note": []}
    if lines:
        rows["poem"] = [(t, a, b, None) for t, a, b in packed_lines(lines, most["poem"])]
        rows["line"] = [(p, n, n, None) for n, t in lines for p in pieces(t, most["line"])]
    for note in notes or ():
        a, b = note["line_start"], note["line_end"]
        if (a is None) != (b is None) or (a is not None and a > b):
            raise ValueError(f"annotation {note['annotation_id']} has no valid line range")
        rows["note"] += [(p, a, b, note["annotation_id"]) for p in pieces(note["content"] or "", most["note"])]
    return [(g, i, t, content_key(t), hashlib.sha256(t.encode()).hexdigest(), a, b, note) for g, found in rows.items() for i, (t, a, b, note) in enumerate(found)]


def drafting(key: str, limits: dict[str, int]):
    """A function over batches (key, text, notes) that gives the key and chunk columns of slices of a bounded size."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            made = [(i, row) for i, (text, extra) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) for row in drafts(text, extra, limits)]
            columns = [pa.array([row[j] for _, row in made], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in made], pa.int64())), *columns], [key, *names])

    return run


def chunk_texts(rows: DataFrame, key: str = "id", content: str = "content", notes: str | None = None, most: dict[str, int] | None = None) -> DataFrame:
    """key and the chunk columns of every text; notes is an array<struct<annotation_id,content,line_start,line_end>> column."""
    limits = {**MOST, **(most or {})}
    if min(limits.values()) < 1:
        raise ValueError("chunk limits must be positive")
    extra = F.col(notes) if notes else F.lit(None).cast("array<struct<annotation_id:long,content:string,line_start:int,line_end:int>>")
    return rows.select(key, content, extra.alias("notes")).mapInArrow(drafting(key, limits), f"{key} {rows.schema[key].dataType.simpleString()}, {SCHEMA}")


def islands(lines: DataFrame, by: str, order: str) -> DataFrame:
    """lines with island, which rises where numbers within by are more than one apart."""
    w = Window.partitionBy(by).orderBy(order)
    gap = F.when(F.col(order) - F.lag(order).over(w) > 1, 1).otherwise(0)
    return lines.withColumn("__gap", gap).withColumn("island", F.sum("__gap").over(w).cast("long")).drop("__gap")
