"""Catalogue operators: counts, facets, pages, existence searches and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(dimension: DataFrame, facts: DataFrame, key: str, name: str) -> DataFrame:
    """dimension with the number of facts for its key, 0 for none. Facts are summed up before the join."""
    counts = facts.groupBy(key).agg(F.count("*").alias(name))
    return dimension.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page number (from 1) of rows, with total and total_pages; the count is a separate one-row aggregate."""
    total = rows.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / F.lit(size)).cast("long"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def matching_any(facts: DataFrame, own: Column, *tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Facts for which own holds or a key occurs in one of the tables (keys, fact column, key column).

    A semi join can't stand under OR, so each table's distinct keys become a flag by a left join; a null
    fact column just fails its part.
    """
    held = own
    for i, (keys, column, key) in enumerate(tables):
        flag = keys.select(F.col(key).alias(f"__k{i}")).where(F.col(f"__k{i}").isNotNull()).distinct().withColumn(f"__f{i}", F.lit(True))
        facts = facts.join(flag, facts[column] == F.col(f"__k{i}"), "left")
        held = held | F.coalesce(f"__f{i}", F.lit(False))
    return facts.where(held).drop(*(f"__{x}{i}" for i in range(len(tables)) for x in "kf"))


def nested(parents: DataFrame, children: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """parents with a sorted array of structs of their children; empty where there are none."""
    packed = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))


def ancestors(nodes: DataFrame, most: int = 32) -> DataFrame:
    """(id, ancestor_id, hops, cycle) for every node's walk up the parents, of at most most hops, each ancestor once, where it is met first.

    A walk that comes back to its start is a cycle; one that leads into a cycle elsewhere ends there. Walks double:
    those of n hops go on with all walks of up to n hops from where they end.
    """
    walks = nodes.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("hops"))
    n = 1
    while n < most:
        ends = walks.where(F.col("hops") == n).select("id", F.col("ancestor_id").alias("middle"))
        more = ends.join(walks.select(F.col("id").alias("middle"), "ancestor_id", (F.col("hops") + n).alias("hops")), "middle")
        walks, n = walks.unionByName(more.drop("middle")), 2 * n
    first = walks.where(F.col("hops") <= most).groupBy("id", "ancestor_id").agg(F.min("hops").alias("hops"))
    return first.withColumn("cycle", F.col("ancestor_id") == F.col("id"))


def resolve_names(terms: DataFrame, dimension: DataFrame, term: str, name: str, target: str) -> DataFrame:
    """terms with the target of the one dimension row whose lookup key they name; null where none or several do."""
    keys = dimension.groupBy(F.lower(F.trim(F.col(name))).alias("__key")).agg(F.count("*").alias("__n"), F.min(target).alias(target)).where("__n = 1").drop("__n")
    return terms.join(keys, F.lower(F.trim(F.col(term))) == F.col("__key"), "left").drop("__key")
