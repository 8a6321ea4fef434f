"""Writes of conversations, and the payloads of a judge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import citation_ranks
from ..operators import messages
from ..sources.tables import checkpointed, load
from ..streaming import chat
from . import retrieval
from .streams import HISTORY

COPIED = ["chunk_id", "work_id", "version_id", "annotation_id", "title", "author_name", "dynasty_name", "granularity", "text", "score"]
#: A message's number: its conversation's, and its turn, which is below a million.
STEP = 1_000_000


def new_messages(spark, d):
    """Events as new messages of the conversation of their user's number."""
    return load(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.lit("user").alias("role"), F.col("props").alias("text"), "ts", "event_id")


def conversations(spark, d):
    """Every conversation, and its last message's time, where there is one (made from its number)."""
    at = F.when(F.col("conv_id") % 5 > 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 40).cast("string"), 2, "0")))
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", at.alias("last_message_at"))


def messages_appended(spark, d):
    """All messages after the events were appended, in the order of their time."""
    return messages.appended(load(spark, d, "conversations").select("conv_id", "turn", "role", "text"), new_messages(spark, d), ["ts", "event_id"])


def conversations_touched(spark, d):
    """The time of the last message of each conversation after the append."""
    new = new_messages(spark, d).withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return messages.touched(conversations(spark, d), new, "at")


def conversation_deleted(spark, d):
    """What is left of conversations, messages and citations after all conversations with a system message are deleted."""
    told = load(spark, d, "conversations").withColumn("message_id", F.col("conv_id") * STEP + F.col("turn"))
    cites = told.where("turn % 2 = 1").select("message_id", F.explode(F.sequence(F.lit(1), (F.col("turn") % 3 + 1).cast("int"))).alias("rank"))
    kept = messages.deleted(told.where("role = 'system'"), conversations(spark, d), told, cites)
    rows = [kept[0].select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), F.lit(0).cast("long").alias("rank")), kept[1].select(F.lit("message"), "message_id", F.lit(0).cast("long")), kept[2].select(F.lit("citation"), "message_id", F.col("rank").cast("long"))]
    return rows[0].union(rows[1]).union(rows[2])


def citations_copied(spark, d):
    """Answers to the benchmark's questions cite two of their candidates, one of them twice, and one that is not there."""
    evidence = checkpointed(retrieval.candidates_detailed(spark, d))
    answer = F.concat(F.lit("a [1] b ["), (F.col("query_id") % 4 + 1).cast("string"), F.lit(", 9] c [1]"))
    return messages.cited(evidence.select("query_id").distinct(), citation_ranks(answer), evidence, "query_id", COPIED)


def judge_payloads(spark, d):
    """What a judge gets of each conversation: its last question and answer, with the turns before as evidence, cut to 200 letters each and 500 in all."""
    rows = chat.last_messages(load(spark, d, "conversations"), 6)
    last = lambda role: F.max_by("text", F.when(F.col("role") == role, F.col("turn")))
    evidence = F.array_sort(F.collect_list(F.struct(F.col("place").alias("rank"), F.col("role").alias("title"), F.when(F.col("place") % 2 == 0, F.col("role")).alias("author_name"), F.lit(None).cast("string").alias("dynasty_name"), "text")))
    held = rows.groupBy("conv_id").agg(last("user").alias("question"), last("assistant").alias("answer"), evidence.alias("evidence"))
    made = chat.judge_messages("Judge the answer by its evidence.", F.col("question"), F.col("answer"), F.col("evidence"), 200, 500)
    return held.select("conv_id", F.size(made).cast("long").alias("n_messages"), F.element_at(made, -1)["content"].alias("payload"))


QUERIES = {f.__name__: f for f in (messages_appended, conversations_touched, conversation_deleted, citations_copied, judge_payloads)}

TOLD = f"told AS (SELECT *, conv_id * {STEP} + turn AS message_id FROM conversations), gone AS (SELECT conv_id FROM conversations WHERE role = 'system')"
ORACLES = {
    "messages_appended": """SELECT conv_id, turn, role, text FROM conversations UNION ALL
      SELECT user_id, coalesce(last, -1) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), 'user', props FROM events LEFT JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) c ON conv_id = user_id WHERE user_id IS NOT NULL""",
    "conversations_touched": """SELECT conv_id, greatest(own, seen) AS last_message_at
      FROM (SELECT DISTINCT conv_id, CASE WHEN conv_id % 5 > 0 THEN '2024-01-' || lpad(CAST(conv_id % 40 AS VARCHAR), 2, '0') END AS own FROM conversations) c LEFT JOIN (SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS seen FROM events GROUP BY 1) e ON user_id = conv_id""",
    "conversation_deleted": f"""WITH {TOLD}, kept AS (SELECT * FROM told WHERE conv_id NOT IN (SELECT conv_id FROM gone))
      SELECT DISTINCT 'conversation' AS kind, conv_id AS id, 0::BIGINT AS rank FROM kept UNION ALL SELECT 'message', message_id, 0 FROM kept UNION ALL SELECT 'citation', message_id, unnest(range(1, turn % 3 + 2)) FROM kept WHERE turn % 2 = 1""",
    "citations_copied": f"SELECT query_id, rank, {', '.join(COPIED)} FROM ({retrieval.ORACLES['candidates_detailed']}) c WHERE rank = 1 OR rank = query_id % 4 + 1",
    "judge_payloads": f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM ({HISTORY}) x WHERE back <= 6),
      b AS (SELECT *, coalesce(sum(least(length(text), 200)) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
      SELECT conv_id, 2::BIGINT AS n_messages, CAST(to_json(struct_pack(question := arg_max(text, turn) FILTER (role = 'user'), answer := arg_max(text, turn) FILTER (role = 'assistant'),
        citations := list(struct_pack(rank := place, title := role, author_name := CASE WHEN place % 2 = 0 THEN role END, dynasty_name := NULL::VARCHAR, text := substr(text, 1, CAST(least(200, 500 - before) AS BIGINT))) ORDER BY place) FILTER (before < 500))) AS VARCHAR) AS payload FROM b GROUP BY 1""",
}
