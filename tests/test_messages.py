"""Writes of conversations, hash trees of shards, required fields, seeds, judges' payloads and table functions, against plain versions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lexforge.functions import tables, text
from lexforge.operators import ingest, messages
from lexforge.sources import ndjson
from lexforge.streaming import chat


def test_appended_messages_follow_their_conversation(spark):
    rng = random.Random(3)
    old = [(c, t, f"o{c}.{t}") for c in (1, 2) for t in range(3)]
    # One conversation holds most rows, and some times are equal.
    new = [(rng.choice((1, 1, 1, 1, 2, 7, None)), rng.randrange(40), i, f"n{i}") for i in range(600)]
    rows = messages.appended(spark.createDataFrame(old, "conv_id long, turn long, text string"), spark.createDataFrame(new, "conv_id long, at long, n long, text string").repartition(5), ["at", "n"]).collect()
    want = list(old)
    for conv in (1, 2, 7):
        start = 3 if conv < 3 else 0
        want += [(conv, start + i, r[3]) for i, r in enumerate(sorted((r for r in new if r[0] == conv), key=lambda r: r[1:3]))]
    assert sorted(map(tuple, rows)) == sorted(want)


def test_places_hold_beyond_one_slice(spark):
    rows = spark.range(5000).select((F.when(F.col("id") % 3 > 0, F.lit(9))).alias("k"), F.xxhash64("id").alias("o"), "id")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = messages.numbered(rows, "k", ["o"], "place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(found) == 5000
    for key in (None, 9):
        mine = sorted((r for r in found if r.k == key), key=lambda r: r.o)
        assert [r.place for r in mine] == list(range(len(mine)))
    assert messages.numbered(rows.limit(0), "k", ["o"], "place").count() == 0


def test_touch_and_delete(spark):
    conv = spark.createDataFrame([(1, "b"), (2, None), (3, "z"), (None, "n")], "conv_id long, last_message_at string")
    new = spark.createDataFrame([(1, "c"), (1, "a"), (2, "d"), (3, "y"), (None, "q")], "conv_id long, at string")
    assert sorted(map(tuple, messages.touched(conv, new, "at").collect()), key=str) == sorted([(1, "c"), (2, "d"), (3, "z"), (None, "n")], key=str)
    told = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 30)], "conv_id long, message_id long")
    cites = spark.createDataFrame([(10, 1), (11, 1), (11, 2), (20, 1), (30, 1)], "message_id long, rank long")
    ids = spark.createDataFrame([(1,), (1,), (5,), (None,)], "conv_id long")
    left = [sorted(map(tuple, df.collect()), key=str) for df in messages.deleted(ids, conv, told, cites)]
    assert [r[0] for r in left[0]] == [2, 3, None] and left[1] == [(2, 20), (None, 30)] and left[2] == [(20, 1), (30, 1)]


def test_citations_are_copies(spark):
    answers = spark.createDataFrame([(1, [2, 2, 9, 1]), (2, []), (3, [1])], "q long, ranks array<int>")
    evidence = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d")], "q long, rank int, text string")
    assert sorted(map(tuple, messages.cited(answers, F.col("ranks"), evidence, "q", ["text"]).collect())) == [(1, 1, "a"), (1, 2, "b")]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def root(lines, fan):
    nodes = [digest(x) for x in lines]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0]


def test_shard_trees(spark, tmp_path):
    shards = {"a.jsonl": [f"x{i}" * (i % 7) for i in range(500)], "b.jsonl": ["é\r", "", "c"], "c.jsonl": ["one"], "d.jsonl": [], "e.jsonl": [str(i) for i in range(65)]}
    for name, lines in shards.items():
        (tmp_path / name).write_bytes("".join(x + "\n" for x in lines).encode())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = {r.file: r for r in ndjson.shard_trees(spark, [str(tmp_path / n) for n in shards], fan=4).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert {n: (found[n].lines, found[n].root) for n in found} == {n: (len(x), root(x, 4)) for n, x in shards.items() if x}
    assert found["b.jsonl"].bytes == 7
    with pytest.raises(ValueError):
        ndjson.shard_trees(spark, [str(tmp_path / "a.jsonl"), "/elsewhere/a.jsonl"])


def test_a_shard_too_large_to_hash_keeps_its_records(spark, tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_text('{"x":1}\n')
    (tmp_path / "b.jsonl").write_text('{"x":2}\n\n{"x":3}\n')
    monkeypatch.setattr(ndjson, "HASHED_BYTES", 10)
    rows = ndjson.read_shards(spark, [str(tmp_path / n) for n in ("a.jsonl", "b.jsonl")], "x int").collect()
    assert sorted((r.file, r.line, r.source_line, r.record.x, r.sha256) for r in rows if r.file == "b.jsonl") == [("b.jsonl", 1, 1, 2, None), ("b.jsonl", 3, 2, 3, None)]
    assert [r.sha256 for r in rows if r.file == "a.jsonl"] == [hashlib.sha256(b'{"x":1}\n').hexdigest()]


def test_required_fields(spark):
    cases = [
        ('{"_id":{"$oid":" a\\u3000"}}', "a", None), ('{"_id":{"$oid":""}}', None, "line 2: missing _id.$oid"), ('{"_id":{"$oid":3}}', None, "line 3: missing _id.$oid"), ('{"_id":[]}', None, "line 4: missing _id object"),
        ("{}", None, "line 5: missing _id object"), ('{"_id":{}}', None, "line 6: missing _id.$oid"), ("not json", None, "line 7: missing _id object"), (None, None, "line 8: missing _id object"), ('{"_id":{"$oid":null}}', None, "line 9: missing _id.$oid"),
    ]
    df = spark.createDataFrame([(i + 1, c[0]) for i, c in enumerate(cases)], "line long, j string")
    found, error = text.required_text(F.try_parse_json("j"), F.col("line"), "_id", "$oid")
    assert [tuple(r) for r in df.select("line", found.alias("t"), error.alias("e")).orderBy("line").select("t", "e").collect()] == [c[1:] for c in cases]


def test_seeds_are_repaired_once(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "c", None), (9, "own", "z"), (None, "n", "n")], "k long, name string, note string")
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (None, "no")], "k long, name string")
    once = ingest.seeded(stored, wanted, "k")
    assert sorted(map(tuple, once.collect()), key=str) == sorted([(1, "a", "x", "kept"), (2, "b", "y", "repaired"), (3, None, None, "repaired"), (4, "d", None, "created"), (9, "own", "z", "own"), (None, "n", "n", "own")], key=str)
    again = ingest.seeded(once.drop("action"), wanted, "k").groupBy("action").count().collect()
    assert {r.action: r["count"] for r in again} == {"kept": 4, "own": 2}


def test_judges_get_no_more_than_their_share(spark):
    kind = "q string, a string, c array<struct<rank:int,title:string,author_name:string,dynasty_name:string,text:string>>"
    cited = lambda *sizes: [(i + 1, "t", None, "d", "é" * n) for i, n in enumerate(sizes)]
    rows = [("q", "a", cited(4, 30, 8, 5)), ("q", None, cited(10, 10, 10)), ("q", "a", cited(0, 20, 0)), (None, "a", []), ("q", "a", None)]
    made = spark.createDataFrame(rows, kind).select(chat.judge_messages("s", F.col("q"), F.col("a"), F.col("c"), 10, 20)[1]["content"].alias("p")).collect()
    found = [json.loads(r.p) for r in made]
    assert [[len(c["text"]) for c in p["citations"]] for p in found] == [[4, 10, 6], [10, 10], [0, 10, 0], [], []]
    assert found[1]["answer"] is None and found[3]["question"] is None
    assert found[0]["citations"][0] == {"rank": 1, "title": "t", "author_name": None, "dynasty_name": "d", "text": "éééé"}


def test_line_ranges(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, ""), (3, None), (4, "x\n")], "id long, t string")
    rows = spark.sql("SELECT id, r.* FROM {df} d, LATERAL line_ranges(d.t, 2) r", df=df).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 1, 2, "a\nb"), (1, 1, 3, 3, "c"), (2, 0, 1, 1, ""), (4, 0, 1, 2, "x\n")]
