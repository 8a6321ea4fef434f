"""Connected components of links, without ever holding them on the driver.

Every task first reduces its links to stars; then large-star and small-star rounds run until the
links stop changing. Joins instead of windows carry the labels, so that a hub with a third of all
nodes is split like any skewed join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import checkpointed

#: Links that one task may join up directly (16 bytes each); beyond it star rounds run.
ONE_TASK_LINKS = 400_000
#: Nodes that a task holds before it hands its stars on and starts anew.
HELD_NODES = 1_000_000


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as (node, smallest node of its group); a task of many nodes gives such stars of several parts of its links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def given() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in parent if parent[x] != x]
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD_NODES:
            yield from given()
            parent.clear()
    yield from given()


def large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least).distinct()


def connected_components(links: DataFrame, one_task: int = ONE_TASK_LINKS, rounds: int = 50) -> DataFrame:
    """(node, component) of every node that has a link, component being its group's smallest node.

    links: its first two columns are 64-bit node ids; loops, repeats and either direction are allowed.
    No links give no rows. A null id is not allowed.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    links = checkpointed(links.mapInArrow(stars, "a long, b long"))
    if links.count() <= min(one_task, HELD_NODES // 2):
        links = checkpointed(links.coalesce(1).mapInArrow(stars, "a long, b long"))
    else:
        seen = None
        for _ in range(rounds):
            links = checkpointed(small_star(large_star(links)))
            now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle within {rounds} rounds")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct()).toDF("node", "component")
