"""Event streams of answers: final states, timings, routing and the stateful streaming form."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import citation_ranks
from ..sources.tables import checkpointed

TERMINAL = ("done", "error", "cancelled")
STATUS = {"done": "completed", "cancelled": "cancelled"}
FINAL = "stream_id long, status string, n_deltas long, content_length long, last_seq long"
FRAME = "stream_id long, event string, data string"
#: How long a stream that ended is remembered, so that late events don't open it again, and how long the rest of a frame waits.
REMEMBERED_MS = 24 * 3600 * 1000


def last_messages(messages: DataFrame, most: int = 8, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last most user and assistant messages with text of every conversation; place counts from the oldest of them."""
    kept = messages.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    back = kept.withColumn("back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("back") <= most)
    return back.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long")).drop("back")


def final_states(events: DataFrame) -> DataFrame:
    """The state of each finished stream (stream_id, seq, kind, payload), from its first terminal event.

    done completes, error fails, cancelled cancels; only what comes before it in order of seq counts. A stream
    without a terminal event failed as well. final_state_stream goes by the same rule. Partial aggregates, no window.
    """
    terminal = F.col("kind").isin(*TERMINAL)
    ends = events.where(terminal).groupBy("stream_id").agg(F.min("seq").alias("end_seq"), F.min_by("kind", "seq").alias("end_kind"))
    used = events.join(ends, "stream_id", "left").where("end_seq IS NULL OR seq <= end_seq")
    status = F.when(F.col("end_kind") == "done", "completed").when(F.col("end_kind") == "cancelled", "cancelled").otherwise("failed")
    delta = F.col("kind") == "delta"
    counted = used.groupBy("stream_id", "end_seq", "end_kind").agg(F.count_if(delta).alias("n_deltas"), F.coalesce(F.sum(F.when(delta, F.length("payload"))), F.lit(0)).cast("long").alias("content_length"), F.max("seq").alias("last_seq"))
    return counted.select("stream_id", status.alias("status"), "n_deltas", "content_length", "end_seq", "last_seq")


def timings(events: DataFrame) -> DataFrame:
    """Milliseconds from the start of each stream to its first delta, and the last duration of its timing events."""
    start, first = F.min("ts"), F.min(F.when(F.col("kind") == "delta", F.col("ts")))
    ms = lambda c: F.unix_micros(c.cast("timestamp")) / 1000
    last = F.max_by("value", F.when(F.col("kind") == "timing", F.col("seq")))
    return events.groupBy("stream_id").agg(F.round(ms(first) - ms(start), 3).alias("ttft_ms"), F.round(F.greatest(F.lit(0.0), last), 3).alias("duration_ms"))


def request_metrics(events: DataFrame, strategy: str, variant_limit: int) -> DataFrame:
    """One row of figures for each request, over its events up to the one that ends it.

    events: request_id, seq, ts, kind, step and duration_ms (of the part that took the time), candidates and
    selected. A request without an end failed; times are from its first event, in whole milliseconds. Sums by
    step and the least and last events are partial aggregates, so that a long request is not gathered.
    """
    ends = events.groupBy("request_id").agg(F.min(F.when(F.col("kind").isin("done", "error", "cancelled"), F.col("seq"))).alias("end_seq"), F.min("ts").alias("t0"))
    used = events.join(ends, "request_id").where("end_seq IS NULL OR seq <= end_seq")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    whole = lambda c: F.floor((us(c) - us(F.min("t0"))) / 1000).cast("long")
    took = [F.sum(F.when(F.col("step") == s, F.col("duration_ms"))).alias(f"{s}_ms") for s in ("rewrite", "retrieval", "assess", "generation", "validate")]
    last, held = F.max_by("kind", "seq"), F.max("selected") > 0
    return used.groupBy("request_id").agg(
        F.first("request_id").alias("conversation_id"), F.coalesce(F.min("end_seq"), F.max("seq")).cast("long").alias("assistant_message_id"), F.when(last == "done", "completed").when(last == "cancelled", "cancelled").otherwise("failed").alias("status"),
        F.when(F.min("end_seq").isNull(), "stream_interrupted").when(last == "error", "generation_error").alias("error_code"), F.when(last == "done", "stop").when(last == "cancelled", "cancelled").otherwise("error").alias("finish_reason"),
        F.max("candidates").alias("candidate_count"), F.max("selected").alias("selected_count"), F.lit(strategy).alias("strategy"), F.when(held, "passed").otherwise("skipped").alias("assessment_status"), F.when(held, "supported").otherwise("no_evidence").alias("assessment_reason_code"),
        F.lit(variant_limit).alias("query_variant_limit"), *took, whole(F.min(F.when(F.col("kind") == "delta", F.col("ts")))).alias("ttft_ms"), whole(F.max("ts")).alias("total_ms"),
    )


def routed(questions: DataFrame) -> DataFrame:
    """Route questions (query_id, n_evidence, reply): without evidence they are refused without a model; a reply that is no assessment lets them pass."""
    reply = F.from_json("reply", "answerable boolean, reason_code string, missing array<string>", {"mode": "PERMISSIVE"})
    reasons = ("supported", "missing_fact", "ambiguous_question", "insufficient_context")
    read = F.coalesce(reply["answerable"].isNotNull() & reply["reason_code"].isin(*reasons), F.lit(False))
    none, answerable = F.col("n_evidence") == 0, reply["answerable"]
    status = F.when(none, "skipped").when(~read, "failed_open").when(answerable, "passed").otherwise("refused")
    reason = F.when(none, "no_evidence").when(~read, "assessment_error").otherwise(reply["reason_code"])
    return questions.select("query_id", status.alias("status"), reason.alias("reason_code"), F.when(none | (read & ~answerable), "refuse").otherwise("generate").alias("route"))


def validated(answers: DataFrame) -> DataFrame:
    """answers (answer, ranks, n_evidence, refused) with error: empty ones, ranks out of range, and evidence without a citation."""
    bad = F.exists("ranks", lambda r: (r < 1) | (r > F.col("n_evidence")))
    error = F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", "empty_response").when(bad, "citation_invalid").when((F.col("n_evidence") > 0) & (F.size("ranks") == 0) & ~F.col("refused"), "citation_missing")
    return answers.withColumn("error", error)


def answered(questions: DataFrame, evidence: DataFrame, generate: Callable[[DataFrame], DataFrame], system: str, refusal: str) -> DataFrame:
    """The whole way of a batch of questions from evidence to an answer: (query_id, route, status, reason_code, answer, error).

    questions: query_id, question, reply (of the model that assesses the evidence; null counts as no assessment);
    evidence: query_id, rank, text. One pass routes the questions; those refused get the refusal and reach no model, the others
    go to generate, which adds answer and error_code to rows with messages. Answers are then checked: a failed call keeps its error, an empty
    answer, a citation out of range, and none though there is evidence, are errors of their case alone.
    """
    held = evidence.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda e: e["text"]).alias("evidence"))
    asked = questions.join(held, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    route = routed(asked.withColumn("n_evidence", F.size("evidence")))
    rows = checkpointed(asked.select("query_id", "question", "evidence").join(route, "query_id"))
    made = generate(rows.where("route = 'generate'").withColumn("messages", prompt(system, F.lit(None), F.col("evidence"), F.col("question"))))
    refused = rows.where("route = 'refuse'").withColumns({"answer": F.lit(refusal), "error_code": F.lit(None).cast("string")})
    columns = ["query_id", "route", "status", "reason_code", "evidence", "answer", "error_code"]
    both = made.select(*columns).unionByName(refused.select(*columns))
    checked = validated(both.withColumns({"ranks": citation_ranks(F.coalesce("answer", F.lit(""))), "n_evidence": F.size("evidence"), "refused": F.col("route") == "refuse"}))
    return checked.select("query_id", "route", "status", "reason_code", "answer", F.coalesce("error_code", "error").alias("error"))


def data_lines(lines: DataFrame) -> DataFrame:
    """Events (stream_id, seq, kind, payload) of a model's streamed reply, given by its lines (stream_id, seq, line), as a table or a stream.

    A line "data: ..." with a delta of text is a delta, "data: [DONE]" is done, one that is no JSON object is an error; other lines, and
    deltas without text, give nothing. final_states and final_state_stream end a stream at its first done or error.
    """
    data = F.trim(F.substring(F.col("line"), 6, 1 << 30))
    value = F.try_parse_json(data)
    bad = F.coalesce(~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(True))
    text = F.try_variant_get(value, "$.choices[0].delta.content", "string")
    kind = F.when(data == "[DONE]", "done").when(bad, "error").when(F.length(text) > 0, "delta")
    rows = lines.where(F.col("line").startswith("data:") & (data != "")).select("stream_id", "seq", kind.alias("kind"), F.when(kind == "delta", text).alias("payload"))
    return rows.where("kind IS NOT NULL")


def non_empty(states: DataFrame) -> DataFrame:
    """Final states in which a completed stream without any text has failed: an empty answer is an error."""
    empty = (F.col("status") == "completed") & (F.col("content_length") == 0)
    return states.withColumns({"status": F.when(empty, "failed").otherwise(F.col("status")), "error_code": F.when(empty, "empty_response")})


def prompt(system: str, history: Column, evidence: Column, question: Column) -> Column:
    """Messages (role, content) of a question: system, history, and the question under its evidence."""
    ask = F.concat(F.lit("Evidence:\n"), F.array_join(F.transform(evidence, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e)), "\n\n"), F.lit("\n\nQuestion: "), question)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.concat(F.array(message("system", F.lit(system))), F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), F.array(message("user", ask)))


def judge_messages(system: str, question: Column, answer: Column, citations: Column, most_each: int = 2500, most: int = 12_000) -> Column:
    """Messages (role, content) to a model that judges an answer: system, and question, answer and cited evidence as compact JSON.

    citations: an array of (rank, title, author_name, dynasty_name, text) in order. Each text is cut to most_each letters, and all together to
    most: the one in which this is reached is the last that is given. Fields without a value are null.
    """
    kind = "struct<left:int,given:array<struct<rank:bigint,title:string,author_name:string,dynasty_name:string,text:string>>>"
    start = F.struct(F.lit(most).alias("left"), F.array().alias("given")).cast(kind)

    def give(held: Column, c: Column) -> Column:
        text = F.substring(F.coalesce(c["text"], F.lit("")), F.lit(1), F.least(F.lit(most_each), held["left"]))
        row = F.struct(c["rank"].cast("bigint").alias("rank"), *(c[n].alias(n) for n in ("title", "author_name", "dynasty_name")), text.alias("text"))
        more = F.struct((held["left"] - F.length(text)).alias("left"), F.array_append(held["given"], row).alias("given")).cast(kind)
        return F.when(held["left"] > 0, more).otherwise(held)

    given = F.aggregate(F.coalesce(citations, F.array()), start, give)["given"]
    payload = F.to_json(F.struct(question.alias("question"), answer.alias("answer"), given.alias("citations")), {"ignoreNullFields": "false"})
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), payload.alias("content")))


@contextmanager
def stateful(spark: SparkSession, until_read: bool = False):
    """Settings that stateful streams need while they are started: a state store that holds timers and lifetimes.

    until_read is for streams that end when all is read: batches without data, which timers ask for for ever, are off.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    wanted |= {"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if until_read else {}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class FinalStates(StatefulProcessor):
    """Counts of a stream until its terminal event, or wait_ms without events; then a tombstone, which late events meet, for remembered_ms."""

    def __init__(self, wait_ms: int | None, remembered_ms: int):
        self.wait_ms, self.remembered_ms = wait_ms, remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "deltas long, size long, last long")
        self.ended = handle.getValueState("ended", "last long", self.remembered_ms)

    def close_stream(self, key: tuple, status: str, deltas: int, size: int, last: int) -> pd.DataFrame:
        self.counts.clear()
        self.ended.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return pd.DataFrame({"stream_id": [key[0]], "status": [status], "n_deltas": [deltas], "content_length": [size], "last_seq": [last]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        if self.ended.exists():
            return
        deltas, size, last = self.counts.get() if self.counts.exists() else (0, 0, -1)
        for seq, kind, payload in zip(batch["seq"], batch["kind"], batch["payload"]):
            if kind in TERMINAL:
                yield self.close_stream(key, STATUS.get(kind, "failed"), deltas, size, int(seq))
                return
            deltas, size, last = deltas + (kind == "delta"), size + len(payload or "") * (kind == "delta"), max(last, int(seq))
        self.counts.update((int(deltas), int(size), last))
        if self.wait_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counts.exists() and not self.ended.exists():
            yield self.close_stream(key, "failed", *self.counts.get())


def final_state_stream(events: DataFrame, wait_ms: int | None = 60_000, remembered_ms: int = REMEMBERED_MS) -> DataFrame:
    """The streaming form of final_states: one row for each stream, when its terminal event comes or after wait_ms without events.

    Events that come in a later batch than the end are late: for remembered_ms they are ignored, whatever their
    seq. Without a wait, streams stay open until they end. Start it under stateful().
    """
    return events.groupBy("stream_id").transformWithStateInPandas(FinalStates(wait_ms, remembered_ms), FINAL, "Append", "ProcessingTime")


def read_event_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of parquet event files, one batch at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def split_frames(buffer: str, chunk: str) -> tuple[list[tuple[str, str]], str]:
    """Frames (event, data) that a chunk completes, and what is left in the buffer; the incremental twin of the SSE parser."""
    text = (buffer + chunk).replace("\r\n", "\n")
    *blocks, rest = text.split("\n\n")
    frames = []
    for block in blocks:
        lines = [x for x in block.split("\n") if x and not x.startswith(":")]
        names = [x[6:].removeprefix(" ") for x in lines if x.startswith("event:")]
        data = [x[5:].removeprefix(" ") for x in lines if x.startswith("data:")]
        if data:
            frames.append((names[-1] if names else "message", "\n".join(data)))
    return frames, rest


class Frames(StatefulProcessor):
    """What is left of a stream's last frame, and the last chunk's seq, for remembered_ms after it."""

    def __init__(self, remembered_ms: int):
        self.remembered_ms = remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "rest string, last long", self.remembered_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).drop_duplicates("seq").sort_values("seq")
        rest, last = self.rest.get() if self.rest.exists() else ("", -1)
        batch = batch[batch["seq"] > last]
        if batch.empty:
            return
        # A carriage return at the end may be half of a line end, so it waits as well.
        held = rest + "".join(batch["chunk"].fillna(""))
        text, back = (held[:-1], "\r") if held.endswith("\r") else (held, "")
        frames, left = split_frames("", text)
        self.rest.update((left + back, int(batch["seq"].iloc[-1])))
        if frames:
            yield pd.DataFrame({"stream_id": [key[0]] * len(frames), "event": [f[0] for f in frames], "data": [f[1] for f in frames]})


def frame_stream(chunks: DataFrame, remembered_ms: int = REMEMBERED_MS) -> DataFrame:
    """Frames (stream_id, event, data) of a stream of chunks (stream_id, seq, chunk), which may be cut anywhere.

    Chunks come in order of seq from batch to batch; one that is not beyond the last seen came before and is ignored. What is left of a
    stream waits for remembered_ms after its last chunk and is dropped then. Start it under stateful().
    """
    return chunks.groupBy("stream_id").transformWithStateInPandas(Frames(remembered_ms), FRAME, "Append", "ProcessingTime")
