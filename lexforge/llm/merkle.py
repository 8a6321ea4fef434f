"""A Merkle manifest of a dataset: a tree of digests for each group, and one over the groups' subroots.

A level is one window: rows are partitioned by group and parent index, and the ordered collect_list over
the full frame gives both the parent's preimage and each node's siblings. The first child of every run
stands for its parent, so that the next level has an eighth of the rows. Runs hold FAN_OUT nodes at most, so
no window partition grows with the data, however large a group is. Paths go down again by joins of each level
with its parents'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._plan import checkpointed

FAN_OUT = 8
#: The columns that a leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")
#: A group's key: whether it is null, and its text. Joins on these two need no null-safe equality.
GROUP = ("g_null", "g")
STEP = "struct<place:int,siblings:array<string>>"


def digest(preimage: Column) -> Column:
    return F.sha2(preimage, 256)


def leaf_hash(*values: Column) -> Column:
    """The digest of values, each a dash if null, else its count of UTF-8 bytes, a colon and its text."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows of GROUP and other columns with idx, their place from 0 in their group by the order columns (nulls first), and size, the group's rows.

    Rows are sorted by ranges over all tasks and written; a place is the one in the partition, moved by the
    counts of the partitions before, of which there are no more than partitions and groups.
    """
    keys = [*GROUP, *order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    rows = checkpointed(spread).select("*", F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__place"))
    counts = rows.groupBy(*GROUP, "__part").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    group = Window.partitionBy(*GROUP)
    before = F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*GROUP, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__start"), F.sum("__n").over(group).alias("size"))
    return rows.join(starts, [*GROUP, "__part"]).withColumn("idx", F.col("__place") + F.col("__start")).drop("__at", "__part", "__place", "__start")


def runs(nodes: DataFrame) -> DataFrame:
    """nodes of groups that have several, with parent (index) and run, the digests of the parent's children in order."""
    rows = nodes.where("size > 1").withColumn("parent", F.floor(F.col("idx") / FAN_OUT))
    frame = Window.partitionBy(*GROUP, "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("run", F.collect_list("hash").over(frame))


def parents(level: DataFrame) -> DataFrame:
    """The parents of a level's runs, each once: by their first child."""
    first = level.where(F.col("idx") % FAN_OUT == 0)
    return first.select(*GROUP, F.col("parent").alias("idx"), F.ceil(F.col("size") / FAN_OUT).alias("size"), digest(F.array_join("run", "")).alias("hash"))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """The nodes (GROUP, idx, size, hash) of each level from the leaves up; the last level has groups of one node only."""
    levels, most = [leaves], leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        levels.append(checkpointed(parents(runs(levels[-1]))))
        most = -(-most // FAN_OUT)
    return levels


def paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's nodes with what tops (GROUP and path) has for their group, path being the steps from a node to its group's top and on."""
    others = [c for c in tops.columns if c not in (*GROUP, "path")]
    found = None
    for nodes in reversed(levels):
        known = [c for c in nodes.columns if c not in ("size", "hash")] if nodes is levels[0] else [*GROUP, "idx"]
        ends = nodes.where("size = 1").join(tops, list(GROUP)).select(*known, "hash", "path", *others)
        if found is not None:
            place = (F.col("idx") % FAN_OUT).cast("int")
            step = F.struct(place.alias("place"), F.concat(F.slice("run", F.lit(1), place), F.slice("run", place + 2, F.lit(FAN_OUT))).alias("siblings"))
            above = found.select(*GROUP, F.col("idx").alias("parent"), "path", *others)
            ends = ends.unionByName(runs(nodes).join(above, [*GROUP, "parent"]).select(*known, "hash", F.concat(F.array(step), "path").alias("path"), *others))
        found = ends
    return found


def manifest(docs: DataFrame, covered: tuple[str, ...] = COVERED, group: str = "lang", order: str = "doc_id", **claims: Column) -> DataFrame:
    """Every row of docs as a leaf with its proof: (order, group, idx, leaf, subroot, root, path) and the claims.

    A leaf is the leaf_hash of the covered columns. Leaves of a group ascend by order (nulls first; ties by
    the leaf, so that equal rows may stand in any order), and every 8 neighbours, the last run fewer, become their digest until one is left: the subroot. Groups
    ascend by their bytes, the null group first, and their subroots become root likewise. path is an array of
    (place, siblings) from the leaf up: folded() makes the root of it. claims are further columns by name,
    made of docs' columns and carried to the result, as digests that are to be held against the tree. Rows that
    repeat are leaves of their own, nulls in any column are covered as such, an empty table gives no rows, and
    docs' other columns don't matter.
    """
    key = F.col(group).cast("string")
    slim = docs.select(F.col(order).alias("key"), key.isNotNull().alias("g_null"), F.coalesce(key, F.lit("")).alias("g"), leaf_hash(*(F.col(c) for c in covered)).alias("hash"), *(c.alias(f"claim_{n}") for n, c in claims.items()))
    # False, the null group, sorts first. The digests are written before they are sorted, so that texts are read once.
    leaves = numbered(checkpointed(slim), "key", "hash")
    levels = tree(leaves)
    subroots = levels[0].where("size = 1").select(*GROUP, "hash")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("size = 1").select(*GROUP, "hash"))
    upper = tree(numbered(checkpointed(subroots.select(F.lit(True).alias("g_null"), F.lit("").alias("g"), F.col("g_null").alias("own_null"), F.col("g").alias("own"), "hash")), "own_null", "own"))
    root = upper[-1].select(*GROUP, F.array().cast(f"array<{STEP}>").alias("path"), F.col("hash").alias("root"))
    tops = paths(upper, root).select(F.col("own_null").alias("g_null"), F.col("own").alias("g"), F.col("hash").alias("subroot"), "root", "path")
    found = paths(levels, tops)
    return found.select(F.col("key").alias(order), F.when(F.col("g_null"), F.col("g")).alias(group), "idx", F.col("hash").alias("leaf"), "subroot", "root", "path", *(F.col(f"claim_{n}").alias(n) for n in claims))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""

    def up(below: Column, step: Column) -> Column:
        left, right = F.slice(step["siblings"], F.lit(1), step["place"]), F.slice(step["siblings"], step["place"] + 1, F.lit(FAN_OUT))
        return digest(F.concat(F.array_join(left, ""), below, F.array_join(right, "")))

    return F.aggregate(path, leaf, up)


def proof_hash(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf up and left to right."""
    return digest(F.array_join(F.flatten(F.transform(path, lambda s: s["siblings"])), ""))


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text's A-Z are lower-cased where 3 divides the crc32 of doc_id as text; of other rows, and those without a doc_id, their own."""
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    low = F.when(changed, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return leaf_hash(*(low if c == "text" else F.col(c) for c in COVERED))
