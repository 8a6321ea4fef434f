"""Table functions for lateral joins in SQL. Texts go to and from the workers a hundred rows at a time: Arrow batches hold thousands, and a lateral join takes no functions of whole Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="range_no bigint, first_line bigint, last_line bigint, text string", useArrow=False)
class LineRanges:
    """Runs of size lines of a text, the last of what is left: number, first and last line (from 1) and their text.

    A null text has none, an empty one a single empty line; a size below 1 counts as 1.
    """

    def eval(self, text: str | None, size: int | None) -> Iterator[tuple[int, int, int, str]]:
        if text is None or size is None:
            return
        step, lines = max(1, size), text.split("\n")
        for n, start in enumerate(range(0, len(lines), step)):
            run = lines[start : start + step]
            yield n, start + 1, start + len(run), "\n".join(run)


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: line_ranges(text, size)."""
    spark.udtf.register("line_ranges", LineRanges)
