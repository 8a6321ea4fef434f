"""Mixing sources to target weights by distributed prefix sums; DataFrame operations only.

Rows get hash-random keys; equal rows are one until the end. A source's key range is cut into slices of
some hundred keys, so that running sums need no task to hold a source: sums of slices give each slice's
offset, and a window within the slice gives the rest. Sums over slices and over sources are themselves
taken in two levels, over the parts of a range partitioning and within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._plan import checkpointed, copied

SPACES = " \t\n\x0b\x0c\r"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Different rows of a slice of a source's key range, on average.
SLICE_ROWS = 400
#: Copies of a row that are written out in one piece; those of a commoner row are dealt out first.
COPIES = 1000


def word_count(text: Column) -> Column:
    """The number of runs of other characters than [\\x20\\x09-\\x0D]; 0 for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def running(rows: DataFrame, sums: dict[str, Column], order: list[Column], by: str | None = None) -> DataFrame:
    """rows with columns of exact sums over the rows before each, within by; no task holds more than a part of a range partitioning.

    order has to tell all rows (of a by) apart. Rows are written out first, as a part is known by its number.
    """
    keys = [by] if by else []
    first = [F.col(by).isNull(), F.col(by)] if by else []
    ranged = checkpointed(rows.repartitionByRange(*first, *order).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "__part").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = parts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__p"), *(F.coalesce(F.sum(n).over(earlier), zero).alias(f"__{n}") for n in sums))
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__part") == F.col("__p")
    joined = ranged.join(offsets, same & F.col(by).eqNullSafe(F.col(f"__{by}")) if by else same)
    return joined.withColumns({n: F.coalesce(F.sum(c).over(inside), zero) + F.col(f"__{n}") for n, c in sums.items()}).select(*rows.columns, *sums)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with a double target.

    Sources in code point order, null last, weigh weights in turn and share share times all sizes; no
    target exceeds most times its source's size, and what that leaves is shared by weight among the
    others. In order of size over weight the capped sources come first, so running sums find the water
    level: source k is capped if the level of those from k on, (budget - caps before) / weights, reaches it.
    The first that is not sets the level of all that follow.
    """
    ranked = running(sources.select("source", "source_size"), {"before": F.lit(1).cast("long")}, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight.cast("long")).drop("before")
    fill = [F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    rows = checkpointed(running(rows, {"size_before": F.col("source_size"), "weight_before": F.col("weight")}, fill))
    total, weighs = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    left, weigh = F.lit(share * (total or 0)) - most * F.col("size_before"), F.lit(weighs or 0) - F.col("weight_before")
    short = rows.where(most * F.col("source_size") * weigh > left * F.col("weight"))
    level = short.agg(F.min_by(F.struct(left.cast("double").alias("left"), weigh.cast("double").alias("weighs")), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(fill))))).first()[0]
    cap = (most * F.col("source_size")).cast("double")
    # Up to the level a source is capped; those at it or over get its water.
    target = cap if level is None else F.least(cap, F.col("weight") * F.lit(level.left) / F.lit(level.weighs))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """How many words of each document the mix takes.

    docs needs doc_id, text and source. Returns one row per input row: doc_id, size (words; 0 for a null
    text), source (may be null, a source like others), source_size, target (double) and taken: every
    source's floor(target) words exactly, as whole epochs of the source and then its rows in the order of
    their hash keys, the last of them in part. No row is taken more than most times its size. Keys depend
    on doc_id, text and seed, so reruns agree, and rows without a doc_id or with a common one are dealt out
    like others. Rows equal in source, doc_id and text are counted as one until the end and follow one
    another; which of them is taken in part is no difference. An empty table gives an empty result.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", "text").alias("key"))
    sized = checkpointed(sized.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("copies")))
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("rows"))
    sources = checkpointed(sources)
    aims = sources.select("source", "rows").join(targets(sources, weights, share, most).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    aims = checkpointed(aims.withColumn("slices", F.ceil(F.col("rows") / SLICE_ROWS)).withColumnRenamed("source", "s").drop("rows"))
    unit = (F.shiftrightunsigned("key", 11).cast("double")) / float(1 << 53)
    rows = sized.join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("slice", F.floor(unit * F.col("slices")))
    words = F.col("size") * F.col("copies")
    sums = rows.groupBy("source", "slice").agg(F.sum(words).alias("slice_size"))
    offsets = running(sums, {"offset": F.col("slice_size")}, [F.col("slice")], "source").select(F.col("source").alias("o"), F.col("slice").alias("at"), "offset")
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("o")) & (F.col("slice") == F.col("at")))
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.col("offset") + F.sum(words).over(within) - words).drop("o", "at", "offset", "slice", "slices", "key")
    rows = copied(rows.select("doc_id", "source", "size", "copies", "source_size", "target", "start"), "copies", "copy", COPIES)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - (F.col("start") + F.col("copy") * F.col("size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", rest))
    return rows.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))
