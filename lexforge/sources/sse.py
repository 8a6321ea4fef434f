"""Server-sent events as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encoded(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def parsed(streams: DataFrame, key: str, column: str) -> DataFrame:
    """(key, place, event, data) of whole streams.

    Blocks end at blank lines, CRLF counts as LF, lines of data are joined, comments and blocks without
    data are dropped, and a block without a name is a message.
    """
    flat = F.replace(F.replace(F.col(column), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    value = lambda line, name: F.regexp_replace(line.substr(F.lit(len(name) + 2), F.length(line)), "^ ", "")

    def block(text: Column) -> Column:
        lines = F.split(text, "\n")
        named = F.transform(F.filter(lines, lambda x: x.startswith("event:")), lambda x: value(x, "event"))
        data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: value(x, "data"))
        return F.struct(F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("message")).alias("event"), F.array_join(data, "\n").alias("data"), F.size(data).alias("n"))

    blocks = F.filter(F.transform(F.split(flat, "\n\n+"), block), lambda b: b["n"] > 0)
    return streams.select(key, F.posexplode(blocks).alias("place", "b")).select(key, "place", "b.event", "b.data")
