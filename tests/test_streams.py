"""Stateful streams over several micro-batches: ends, late events, silence, redelivered chunks, and the batch twin."""

import random
import time

import pytest

from lexforge.streaming import chat

EVENTS = "stream_id long, seq long, kind string, payload string"


@pytest.fixture
def fed(spark, tmp_path):
    """Runs a stream over batches of rows, one micro-batch for each, and gives what it wrote."""

    def run(schema, batches, made):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
            time.sleep(0.01)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        name = f"t{random.randrange(10**9)}"
        with chat.stateful(spark, until_read=True):
            query = made(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
        return spark.table(name).collect()

    return run


def test_late_events_do_not_open_a_stream_again(fed, spark):
    batches = [
        [(1, 1, "delta", "ab"), (2, 1, "delta", "x"), (3, 5, "error", None)],
        [(1, 3, "done", None), (1, 2, "delta", "c"), (3, 6, "delta", "late"), (3, 7, "done", None)],
        [(1, 4, "delta", "late"), (1, 5, "error", None), (2, 2, "delta", None), (4, 1, "cancelled", None)],
    ]
    found = fed(EVENTS, batches, lambda df: chat.final_state_stream(df, wait_ms=None))
    rows = sorted((r.stream_id, r.status, r.n_deltas, r.content_length, r.last_seq) for r in found)
    assert rows == [(1, "completed", 2, 3, 3), (3, "failed", 0, 0, 5), (4, "cancelled", 0, 0, 1)]
    twin = chat.final_states(spark.createDataFrame([r for b in batches for r in b], EVENTS))
    ended = twin.where("end_seq IS NOT NULL").select("stream_id", "status", "n_deltas", "content_length", "last_seq").collect()
    assert sorted(map(tuple, ended)) == rows
    assert twin.where("end_seq IS NULL").select("stream_id", "status", "n_deltas", "content_length", "last_seq").collect() == [(2, "failed", 2, 1, 2)]


def test_silent_streams_fail_once(spark, tmp_path):
    source = lambda i: spark.createDataFrame([(1, i, "delta", "ab")], EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source(1)
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    with chat.stateful(spark):
        query = chat.final_state_stream(stream, wait_ms=500).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 60
        while spark.table("silent").count() == 0 and time.time() < until:
            time.sleep(0.3)
        source(2)
        time.sleep(4)
        assert [(r.stream_id, r.status, r.n_deltas, r.last_seq) for r in spark.table("silent").collect()] == [(1, "failed", 1, 1)]
    finally:
        query.stop()


def test_frames_over_batches(fed):
    text = ": c\r\nevent: a\r\ndata: 1\r\ndata: 2\r\n\r\ndata: x\n\nevent: z\ndata: unfinished"
    cuts = [0, 3, 14, 15, 24, 36, 37, 38, 39, 50, len(text)]
    pieces = [(7, i, text[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    # The second batch delivers two chunks again.
    found = fed("stream_id long, seq long, chunk string", [pieces[:4], pieces[2:7] + [pieces[5]], pieces[7:]], chat.frame_stream)
    assert [(r.event, r.data) for r in found] == [("a", "1\n2"), ("message", "x")]


def test_settings_are_put_back(spark):
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    with chat.stateful(spark, until_read=True):
        assert spark.conf.get(key) == "false"
    assert spark.conf.get(key) == before


def test_reply_lines(spark):
    rows = [(1, 1, 'data: {"choices": [{"delta": {"content": "ab"}}]}'), (1, 2, ": wait"), (1, 3, "data:"), (1, 4, 'data: {"choices": []}'), (1, 5, 'data:{"choices": [{"delta": {"content": "c"}}]}'), (1, 6, "data: [DONE]"), (1, 7, "data: late"), (2, 1, "data: [DONE]"), (3, 1, "data: [1]"), (4, 1, 'data: {"choices": [{"delta": {"content": null}}]}'), (5, 1, "event: x")]
    events = chat.data_lines(spark.createDataFrame(rows, "stream_id long, seq long, line string"))
    assert sorted((r.stream_id, r.seq, r.kind, r.payload) for r in events.collect()) == [(1, 1, "delta", "ab"), (1, 5, "delta", "c"), (1, 6, "done", None), (1, 7, "error", None), (2, 1, "done", None), (3, 1, "error", None)]
    states = {r.stream_id: (r.status, r.error_code, r.n_deltas, r.content_length) for r in chat.non_empty(chat.final_states(events)).collect()}
    assert states == {1: ("completed", None, 2, 3), 2: ("failed", "empty_response", 0, 0), 3: ("failed", None, 0, 0)}


def test_refused_questions_reach_no_model(spark, tmp_path):
    from lexforge.sources import ports

    seen = str(tmp_path / "seen")

    def model(messages):
        with open(seen, "a") as out:
            out.write(messages[-1]["content"].rpartition("Question: ")[2] + "\n")
        return "So it is [1]."

    yes, no = '{"answerable": true, "reason_code": "supported"}', '{"answerable": false, "reason_code": "missing_fact"}'
    questions = spark.createDataFrame([(1, "first", yes), (2, "second", no), (3, "third", None), (4, "none", yes)], "query_id long, question string, reply string")
    evidence = spark.createDataFrame([(q, 1, "e") for q in (1, 2, 3)], "query_id long, rank long, text string")
    found = chat.answered(questions, evidence, lambda df: ports.generated(df, "messages", model), "s", "No.")
    rows = {r.query_id: (r.route, r.status, r.answer, r.error) for r in found.collect()}
    assert rows == {1: ("generate", "passed", "So it is [1].", None), 2: ("refuse", "refused", "No.", None), 3: ("generate", "failed_open", "So it is [1].", None), 4: ("refuse", "skipped", "No.", None)}
    assert sorted(open(seen).read().split()) == ["first", "third"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
