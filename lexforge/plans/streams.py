"""Queries of conversations and event streams; the events' types stand for kinds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import ports
from ..sources.tables import load, shared_folder
from ..streaming import chat, index_runs

KIND = {"click": "delta", "view": "delta", "purchase": "done", "error": "error"}


def stream_events(spark, d):
    kinds = F.create_map(*(F.lit(x) for pair in KIND.items() for x in pair))
    return load(spark, d, "events").select(F.col("user_id").cast("long").alias("stream_id"), F.col("event_id").alias("seq"), "ts", F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("timing")).alias("kind"), "value", F.col("props").alias("payload"))


def chat_history_last_n(spark, d):
    return chat.last_messages(load(spark, d, "conversations")).select("conv_id", "turn", "role", "place")


def stream_final_state(spark, d):
    return chat.final_states(stream_events(spark, d))


def ttft_by_stream(spark, d):
    return chat.timings(stream_events(spark, d))


def assess_route(spark, d):
    reply = F.when(F.col("event_id") % 3 == 0, F.lit('{"answerable": true, "reason_code": "supported"}')).when(F.col("event_id") % 3 == 1, F.lit('{"answerable": false, "reason_code": "missing_fact", "missing": ["year"]}')).otherwise(F.lit("no json"))
    return chat.routed(load(spark, d, "events").select(F.col("event_id").alias("query_id"), (F.col("event_id") % 4).alias("n_evidence"), reply.alias("reply")))


def answer_validation(spark, d):
    n = F.col("event_id")
    ranks = F.when(n % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(n % 5, (n % 7) + 1))
    rows = load(spark, d, "events").select("event_id", F.when(n % 13 > 0, F.col("event_type")).alias("answer"), ranks.alias("ranks"), (n % 6).alias("n_evidence"), (n % 9 == 0).alias("refused"))
    return chat.validated(rows).select("event_id", "error")


def prompt_messages(spark, d):
    """The messages for each conversation's last question, with its earlier turns as history."""
    rows = chat.last_messages(load(spark, d, "conversations"), 3)
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("m"))
    history = F.transform(F.slice("m", 1, F.size("m") - 1), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    made = chat.prompt("Answer from the evidence.", history, F.transform("m", lambda x: x["text"]), F.element_at("m", -1)["text"])
    return packed.select("conv_id", F.size(made).cast("long").alias("n_messages"), F.element_at(made, -1)["content"].alias("question"))


def index_run_states(spark, d):
    commands = F.element_at(F.array(*map(F.lit, ("start", "succeed", "fail", "cancel"))), (F.col("event_id") % 4 + 1).cast("int"))
    return index_runs.run_states(load(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), commands.alias("command")))


def until_read(stream, folder):
    """The rows of a stateful stream over what there is now, written to a folder and read from there."""
    spark = stream.sparkSession
    with chat.stateful(spark, until_read=True):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def events_state_stream(spark, d):
    """The stateful stream over all event files until they are read; streams without an end are still open."""
    schema = load(spark, d, "events").schema
    kinds = F.create_map(*(F.lit(x) for pair in KIND.items() for x in pair))
    raw = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    events = raw.select(F.col("user_id").cast("long").alias("stream_id"), F.col("event_id").alias("seq"), F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("timing")).alias("kind"), F.col("props").alias("payload"))
    folder = f"{shared_folder(spark)}/lexforge-states-{uuid.uuid4().hex}"
    return until_read(chat.final_state_stream(events, wait_ms=None), folder)


def sse_stream(spark, d):
    """Frames of a stream of chunks cut anywhere, as they come: every event's frame is cut in two and the halves arrive in order."""
    frames = load(spark, d, "events").select(F.col("user_id").cast("long").alias("stream_id"), "event_id", F.concat(F.lit("event: "), "event_type", F.lit("\r\ndata: "), F.col("event_id").cast("string"), F.lit("\r\n\r\n")).alias("f"))
    at = (F.col("event_id") % 20 + 1).cast("int")
    halves = frames.select("stream_id", F.posexplode(F.array(F.substring(F.col("f"), F.lit(1), at), F.substring(F.col("f"), at + 1, F.lit(1000)))).alias("half", "chunk"), "event_id").select("stream_id", (F.col("event_id") * 2 + F.col("half")).alias("seq"), "chunk")
    folder = f"{shared_folder(spark)}/lexforge-frames-{uuid.uuid4().hex}"
    halves.write.parquet(f"{folder}/in")
    read = chat.frame_stream(spark.readStream.schema(halves.schema).parquet(f"{folder}/in"))
    return until_read(read, folder)


def chat_reply_states(spark, d):
    """Replies of a model as lines, parsed to events, and their final states; some are no JSON, some have no text."""
    n, kind = F.col("event_id"), F.col("event_type")
    delta = F.concat(F.lit('data: {"choices": [{"delta": {"content": '), F.to_json(F.array("event_type")), F.lit("}}]}"))
    text = F.regexp_replace(delta, r"\[(\"[a-z_]+\")\]\}\}", "$1}}")
    line = F.when(kind == "purchase", "data: [DONE]").when(kind == "error", "data: {no json").when(n % 7 == 0, 'data: {"choices": [{"delta": {}}]}').when(n % 5 == 0, ": wait").otherwise(text)
    lines = load(spark, d, "events").select(F.col("user_id").cast("long").alias("stream_id"), n.alias("seq"), line.alias("line"))
    return chat.non_empty(chat.final_states(chat.data_lines(lines))).select("stream_id", "status", "error_code", "n_deltas", "content_length", "end_seq")


def stand_in(messages):
    """A stand-in for a model: what it is asked decides whether it cites well, badly, or nothing, says nothing or fails."""
    question = messages[-1]["content"].rpartition("Question: ")[2]
    kind = len(question) % 5
    if kind == 4:
        raise ports.ProviderError("busy")
    return ("Stated [1].", "Stated [1, 9].", "Not cited.", " ")[kind]


def rag_graph(spark, d):
    """Conversations' turns as questions with their earlier turns as evidence, routed, answered by a stand-in, and checked."""
    c = load(spark, d, "conversations").where("text IS NOT NULL")
    key = F.col("conv_id") * 1000 + F.col("turn")
    reply = F.when(F.col("turn") % 3 == 0, '{"answerable": true, "reason_code": "supported"}').when(F.col("turn") % 3 == 1, '{"answerable": false, "reason_code": "missing_fact"}')
    questions = c.where("role = 'user'").select(key.alias("query_id"), F.col("text").alias("question"), reply.alias("reply"))
    earlier = c.select("conv_id", F.col("turn").alias("t"), F.col("text").alias("e"))
    evidence = c.where("role = 'user'").join(earlier, "conv_id").where("t < turn AND t >= turn - 2").select(key.alias("query_id"), F.col("t").alias("rank"), F.col("e").alias("text"))
    return chat.answered(questions, evidence, lambda rows: ports.generated(rows, "messages", stand_in), "Answer from the evidence.", "I can't say.")


def events_windows(spark, d):
    """Beyond the model of the corpus: tumbling windows of a day with counts and sums by type."""
    rows = load(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def events_sessions(spark, d):
    """Beyond the model of the corpus: sessions of users with gaps of at most six hours."""
    rows = load(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (chat_history_last_n, stream_final_state, ttft_by_stream, assess_route, answer_validation, prompt_messages, index_run_states, events_state_stream, sse_stream, chat_reply_states, rag_graph, events_windows, events_sessions)}

EVENTS = "ev AS (SELECT user_id AS stream_id, event_id AS seq, ts, value, CASE event_type WHEN 'click' THEN 'delta' WHEN 'view' THEN 'delta' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'timing' END AS kind FROM events)"
HISTORY = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''"

ORACLES = {
    "chat_reply_states": """WITH p AS (SELECT user_id AS stream_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' THEN 'error' WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN NULL ELSE 'delta' END AS kind, event_type AS payload FROM events),
      t AS (SELECT stream_id, min(seq) AS end_seq, arg_min(kind, seq) AS k FROM p WHERE kind IN ('done', 'error') GROUP BY 1),
      s AS (SELECT p.stream_id, any_value(k) AS k, count(*) FILTER (kind = 'delta') AS n_deltas, CAST(coalesce(sum(length(payload)) FILTER (kind = 'delta'), 0) AS BIGINT) AS content_length, any_value(end_seq) AS end_seq FROM p LEFT JOIN t USING (stream_id) WHERE kind IS NOT NULL AND (end_seq IS NULL OR seq <= end_seq) GROUP BY 1)
      SELECT stream_id, CASE WHEN k = 'done' AND content_length > 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN k = 'done' AND content_length = 0 THEN 'empty_response' END AS error_code, n_deltas, content_length, end_seq FROM s""",
    "rag_graph": """WITH q AS (SELECT conv_id * 1000 + turn AS query_id, text AS question, turn, (SELECT count(*) FROM conversations e WHERE e.conv_id = c.conv_id AND e.text IS NOT NULL AND e.turn < c.turn AND e.turn >= c.turn - 2) AS n FROM conversations c WHERE role = 'user' AND text IS NOT NULL),
      r AS (SELECT *, CASE WHEN n = 0 THEN 'skipped' WHEN turn % 3 = 0 THEN 'passed' WHEN turn % 3 = 1 THEN 'refused' ELSE 'failed_open' END AS status, CASE WHEN n = 0 THEN 'no_evidence' WHEN turn % 3 = 0 THEN 'supported' WHEN turn % 3 = 1 THEN 'missing_fact' ELSE 'assessment_error' END AS reason_code FROM q),
      g AS (SELECT *, CASE WHEN status IN ('skipped', 'refused') THEN 'refuse' ELSE 'generate' END AS route, length(question) % 5 AS kind FROM r)
      SELECT query_id, route, status, reason_code, CASE WHEN route = 'refuse' THEN 'I can''t say.' WHEN kind = 0 THEN 'Stated [1].' WHEN kind = 1 THEN 'Stated [1, 9].' WHEN kind = 2 THEN 'Not cited.' END AS answer,
        CASE WHEN route = 'refuse' THEN NULL WHEN kind = 1 THEN 'citation_invalid' WHEN kind = 2 THEN 'citation_missing' WHEN kind = 3 THEN 'empty_response' WHEN kind = 4 THEN 'busy' END AS error FROM g""",
    "events_state_stream": f"""WITH {EVENTS}, p AS (SELECT ev.*, props AS payload FROM ev JOIN events ON event_id = seq), t AS (SELECT stream_id, min(seq) AS end_seq, arg_min(kind, seq) AS k FROM p WHERE kind IN ('done', 'error', 'cancelled') GROUP BY 1)
      SELECT t.stream_id, CASE k WHEN 'done' THEN 'completed' WHEN 'cancelled' THEN 'cancelled' ELSE 'failed' END AS status, count(p.seq) FILTER (p.kind = 'delta') AS n_deltas, CAST(coalesce(sum(length(p.payload)) FILTER (p.kind = 'delta'), 0) AS BIGINT) AS content_length, end_seq AS last_seq
      FROM t LEFT JOIN p ON p.stream_id = t.stream_id AND p.seq < t.end_seq GROUP BY ALL""",
    "sse_stream": "SELECT user_id AS stream_id, event_type AS event, CAST(event_id AS VARCHAR) AS data FROM events",
    "chat_history_last_n": f"SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM ({HISTORY}) x WHERE back <= 8",
    "stream_final_state": f"""WITH {EVENTS}, p AS (SELECT ev.*, props AS payload FROM ev JOIN events ON event_id = seq), t AS (SELECT stream_id, min(seq) AS end_seq, arg_min(kind, seq) AS k FROM ev WHERE kind IN ('done', 'error', 'cancelled') GROUP BY 1)
      SELECT e.stream_id, CASE any_value(k) WHEN 'done' THEN 'completed' WHEN 'cancelled' THEN 'cancelled' ELSE 'failed' END AS status, count(*) FILTER (kind = 'delta') AS n_deltas, CAST(coalesce(sum(length(payload)) FILTER (kind = 'delta'), 0) AS BIGINT) AS content_length, any_value(end_seq) AS end_seq, max(seq) AS last_seq
      FROM p e LEFT JOIN t USING (stream_id) WHERE end_seq IS NULL OR seq <= end_seq GROUP BY 1""",
    "ttft_by_stream": f"WITH {EVENTS} SELECT stream_id, round((epoch_us(min(ts) FILTER (kind = 'delta')) - epoch_us(min(ts))) / 1000.0::DOUBLE, 3) AS ttft_ms, round(greatest(0.0::DOUBLE, arg_max(value, seq) FILTER (kind = 'timing')), 3) AS duration_ms FROM ev GROUP BY 1",
    "assess_route": "SELECT event_id AS query_id, CASE WHEN event_id % 4 = 0 THEN 'skipped' WHEN event_id % 3 = 0 THEN 'passed' WHEN event_id % 3 = 1 THEN 'refused' ELSE 'failed_open' END AS status, CASE WHEN event_id % 4 = 0 THEN 'no_evidence' WHEN event_id % 3 = 0 THEN 'supported' WHEN event_id % 3 = 1 THEN 'missing_fact' ELSE 'assessment_error' END AS reason_code, CASE WHEN event_id % 4 = 0 OR event_id % 3 = 1 THEN 'refuse' ELSE 'generate' END AS route FROM events",
    "answer_validation": "WITH a AS (SELECT event_id AS n FROM events) SELECT n AS event_id, CASE WHEN n % 13 = 0 THEN 'empty_response' WHEN n % 3 <> 0 AND (n % 5 < 1 OR greatest(n % 5, n % 7 + 1) > n % 6) THEN 'citation_invalid' WHEN n % 6 > 0 AND n % 3 = 0 AND n % 9 <> 0 THEN 'citation_missing' END AS error FROM a",
    "prompt_messages": f"WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM ({HISTORY}) x WHERE back <= 3) SELECT conv_id, count(*) + 1 AS n_messages, 'Evidence:' || chr(10) || string_agg('[' || place || '] ' || text, chr(10) || chr(10) ORDER BY place) || chr(10) || chr(10) || 'Question: ' || arg_max(text, place) AS question FROM h GROUP BY 1",
    "index_run_states": """WITH RECURSIVE c AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, ['start', 'succeed', 'fail', 'cancel'][CAST(event_id % 4 + 1 AS INT)] AS command FROM events),
      w AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS i, 'pending' AS status, CAST(0 AS BIGINT) AS refused FROM c UNION ALL SELECT w.run_id, c.i, coalesce(m, status), refused + CASE WHEN m IS NULL THEN 1 ELSE 0 END FROM (SELECT w.run_id, w.status, w.refused, c.i, CASE WHEN status = 'pending' AND command = 'start' THEN 'running' WHEN status = 'running' AND command = 'succeed' THEN 'succeeded' WHEN status = 'running' AND command = 'fail' THEN 'failed' WHEN status IN ('pending', 'running') AND command = 'cancel' THEN 'cancelled' END AS m FROM w JOIN c ON c.run_id = w.run_id AND c.i = w.i + 1) w JOIN c ON c.run_id = w.run_id AND c.i = w.i)
      SELECT run_id, arg_max(status, i) AS status, max(refused) AS refused FROM w GROUP BY 1""",
    "events_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "events_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1",
}
