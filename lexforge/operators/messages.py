"""Writes of conversations: messages appended in order, conversations touched, deletion with all that hangs on it, and citations as copies of their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with their place in the order of their key, from 0, as a long; rows that are equal in order come in any order.

    A range sort cuts a key of very many rows into slices; places are counted within a slice, and what
    comes before it is summed over slices, so that no key is gathered in one task. A null key is a key.
    """
    sliced = checkpointed(rows.repartitionByRange(key, *order).withColumn("__slice", F.spark_partition_id()))
    sizes = sliced.groupBy(key, "__slice").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(F.col(key).alias("__key"), F.col("__slice").alias("__of"), F.coalesce(earlier, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(key, "__slice").orderBy(*order)) - 1
    placed = sliced.withColumn(name, place).join(before, F.col("__slice").eqNullSafe(F.col("__of")) & F.col(key).eqNullSafe(F.col("__key")))
    return placed.withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__slice", "__key", "__of", "__before")


def appended(messages: DataFrame, new: DataFrame, order: list[str], key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """messages and new, whose rows take the turns after their conversation's last in the order of the columns order.

    new has the columns of messages but turn, and those of order; a conversation without messages starts at turn 0. New rows
    without a conversation are refused: they are not appended. Stored messages are read for the greatest turn only.
    """
    placed = numbered(new.where(F.col(key).isNotNull()), key, order, "__place")
    last = messages.join(placed.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max(turn).alias("__last"))
    added = placed.join(last, key, "left").withColumn(turn, (F.coalesce("__last", F.lit(-1)) + 1 + F.col("__place")).cast(messages.schema[turn].dataType))
    return messages.unionByName(added.select(*messages.columns))


def touched(conversations: DataFrame, new: DataFrame, at: str, key: str = "conv_id", last: str = "last_message_at") -> DataFrame:
    """conversations whose time of the last message is that of their last new one, where it is later than what they have."""
    latest = new.groupBy(key).agg(F.max(at).alias("__at"))
    return conversations.join(latest, key, "left").withColumn(last, F.greatest(last, "__at")).drop("__at").select(*conversations.columns)


def deleted(ids: DataFrame, conversations: DataFrame, messages: DataFrame, citations: DataFrame, key: str = "conv_id", message: str = "message_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the conversations of ids, their messages, and the citations of these messages.

    citations name their message only. Rows without a key hang on nothing and stay.
    """
    ids = ids.select(key).distinct()
    gone = messages.join(ids, key, "left_semi").select(message)
    return conversations.join(ids, key, "left_anti"), messages.join(ids, key, "left_anti"), citations.join(gone, message, "left_anti")


def cited(answers: DataFrame, ranks: Column, evidence: DataFrame, key: str, copied: list[str]) -> DataFrame:
    """A row (key, rank, copied columns) for each evidence that an answer cites: a copy, which stays as it is when a chunk changes.

    ranks are those of the answer's citation markers; each counts once, and one without evidence gives nothing.
    """
    asked = answers.select(key, F.explode(F.array_distinct(ranks)).alias("rank"))
    return asked.join(evidence.select(key, "rank", *copied), [key, "rank"]).select(key, "rank", *copied)
