"""What the findings of round 3 named, on small tables."""

from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexforge.functions import text as t
from lexforge.operators import chunking, dense, literal, postings


def against_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    rows = __spark_entry__.queries()[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(repr, map(tuple, rows))), sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", ["import_applied", "import_stored"])
def test_failed_rows_keep_their_upper_case(spark, tmp_path, name):
    """A deleted text that is too long to import stays as it was stored: in upper case, letter by letter."""
    documents = [(i, "straße ﬁ é\n" * (2000 if i % 2 else 1), "de", f"src{i}", 1) for i in range(6)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 3 % 2) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ours, sql = against_sql(spark, tmp_path, name)
    assert ours == sql and len(ours) == 5


def test_forms_are_made_in_slices_and_plain_letters_natively(spark, monkeypatch):
    monkeypatch.setattr(t, "FORM_BYTES", 100)
    texts = ["Ａ b" * 20, None, "ß²" * 9, ""] * 5
    assert t.formed(pa.array(texts), t.content_key).to_pylist() == [None if x is None else t.content_key(x) for x in texts]
    assert len(t.formed(pa.array([], pa.string()), t.content_key)) == 0
    plain = spark.createDataFrame([("Straße – «Ÿ» 明月 €",), ("é",), ("ŉ",), ("a\n²",)], "x string").select(t.is_plain(F.col("x"))).collect()
    assert [r[0] for r in plain] == [True, True, False, False]


def test_matched_texts_stay_behind_and_batches_are_small(monkeypatch):
    """Pairs have marks in place of measured texts, and those that carry texts come in batches of a bounded size."""
    monkeypatch.setattr(literal, "ROW_BYTES", 10_000)
    bodies = ["ab" * 500 + "c", "abc", None, "ab" * 500]
    rows = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(bodies)], ["id", "body"])
    keys = pa.table({"query_id": list(range(40)), "q": ["ab"] * 39 + ["abc"]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, keys.schema) as stream:
        stream.write_table(keys)
    shared = SimpleNamespace(value=sink.getvalue().to_pybytes())
    whole = list(literal.matching(shared, ["id", "body"], ["q"], [("body", "q")], ["id", "body", "query_id", "q"])(iter([rows])))
    assert sum(b.num_rows for b in whole) == 39 * 3 + 2 and max(b.num_rows for b in whole) < 60 and max(b.nbytes for b in whole) < 30_000
    light = pa.Table.from_batches(literal.matching(shared, ["id", "body"], ["q"], [("body", "q")], ["id", "body_held", "body_length", "query_id", "q"], ("body",))(iter([rows])))
    assert sorted((r["id"], r["query_id"]) for r in light.to_pylist()) == sorted((r["id"], r["query_id"]) for b in whole for r in b.to_pylist())
    assert {(r["id"], r["body_held"], r["body_length"]) for r in light.to_pylist()} == {(0, True, 1001), (1, True, 3), (3, True, 1000)}


def test_chunks_are_made_in_slices(monkeypatch):
    monkeypatch.setattr(literal, "ROW_BYTES", 2000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(["line one\nline two\n" * 30] * 20), pa.nulls(20, pa.list_(pa.struct([("annotation_id", pa.int64())])))], ["id", "content", "notes"])
    made = list(chunking.drafting("id", chunking.MOST)(iter([batch])))
    assert len(made) > 4 and [r["id"] for b in made for r in b.to_pylist()] == sorted(i for i in range(20) for _ in chunking.drafts(batch.column(1)[0].as_py(), None))


@pytest.mark.parametrize("metric", ["euclid", "cosine"])
def test_products_of_a_scan_stay_small(metric):
    """A block of scores and what is made of it take a few megabytes, whatever the number of queries."""
    import tracemalloc

    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(3000, 16)), rng.normal(size=(10_000, 16)).astype(np.float32)
    vectors = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(list(x))], ["vec_id", "embedding"])
    tracemalloc.start()
    found = pa.Table.from_batches(dense.scanning(SimpleNamespace(value=(list(range(len(q))), dense.unit(q)[0] if metric == "cosine" else q, [], None)), 5, metric, 0, False)(iter([vectors])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first = sorted((r["score"], r["vec_id"]) for r in found.to_pylist() if r["query_id"] == 7)
    if metric == "euclid":
        away = np.sqrt(((x.astype(float) - q[7]) ** 2).sum(axis=1))
        assert [v for _, v in first] == np.argsort(away)[:5].tolist() and abs(first[0][0] - away.min()) < 1e-6
    assert len(first) == 5 and peak < 60e6


def test_an_index_keeps_few_places():
    """Less than a tenth of the letters have a place."""
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefghij"), 20_000))
    assert len(postings.chosen_runs([text], literal.Rolling())[0]) < 0.1 * len(text)


def test_forms_made_in_the_search_are_the_full_forms():
    """Letter by letter through a table, by NFKC where a letter needs it."""
    low = [chr(c) for c in range(1, 0xA100) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}aB {c}" for c in low] + [None, "", "Straße ÄÖ", "ﬁne ²", "é", "İ", "x" * 50, "😀 a", "\ud800"]
    for kind, form in (("content", t.content_key), ("lookup", t.lookup_key)):
        assert literal.former(kind)(texts) == [None if x is None else form(x) for x in texts]


def test_chunks_without_keys_are_searched_as_those_with_keys(spark):
    """Keys made where texts are searched, of lines that share their title, give the same as keys that come with the chunks."""
    from lexforge.operators import retrieval

    texts = ["Die Straße, lang", "DIE STRASSE LANG", "ﬁne é", None, "", "a b-c", "A B C d"] * 3
    rows = [(i, i // 4, "line", x, ["Straße", None, "ＡＢ"][i // 4 % 3], "src1", [None, "DE"][i % 2]) for i, x in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, work_id long, granularity string, text string, title string, author string, dynasty string").repartition(2)
    keyed = chunks.withColumn("content_key", t.content_form(F.col("text"))).withColumns({f"{c}_key": t.lookup_form(F.col(c)) for c in ("title", "author", "dynasty")})
    queries = retrieval.query_keys(spark.createDataFrame([(1, "strasse"), (2, "abc"), (3, "AB"), (4, "de"), (5, "fine"), (6, "SRC")], "query_id long, question string").withColumn("only_dynasty", F.when(F.col("query_id") == 6, "de")))
    shape = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score, tuple(r.match_types), r.candidate_count) for r in df.collect())
    found = shape(retrieval.lexical_search(chunks, queries, 4))
    assert found == shape(retrieval.lexical_search(keyed, queries, 4)) and {x[0] for x in found} == {1, 2, 3, 4, 5, 6}


def test_strategies_together_are_the_strategies_one_by_one(spark, monkeypatch):
    """One pass over the texts serves all strategies, with the results that each has by itself."""
    from lexforge.operators import retrieval
    from lexforge.plans import stack

    texts = ["red moon over hill", "moon", "red", "blue hill", "moon red moon", "hill"] * 4
    chunks = spark.createDataFrame([(i, i, "poem", x, x[:4], "src1", "en") for i, x in enumerate(texts)], "chunk_id long, work_id long, granularity string, text string, title string, author string, dynasty string")
    vectors = spark.createDataFrame([(i, [float(i % 5) - 2, float(i % 3) + 0.5]) for i in range(24)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, "moon", [1.0, 0.5]), (2, "red", [-1.0, 2.0]), (3, "moon", [0.0, 1.0]), (4, None, [1.0, 1.0])], "query_id long, question string, embedding array<float>")
    variants = queries.selectExpr("query_id", "0 AS ord", "question", "3.0 AS weight", "embedding").unionByName(queries.selectExpr("query_id", "1 AS ord", "'hill' AS question", "1.5 AS weight", "embedding"))
    shape = lambda df: sorted((r.strategy, r.query_id, r.rank, r.chunk_id, r.score, tuple(r.match_types)) for r in df.collect())
    each = sorted(x for s in stack.STRATEGIES for x in shape(stack.search(chunks, queries, s, 2, vectors, variants)))
    passes, matched = [], retrieval.matched
    monkeypatch.setattr(retrieval, "matched", lambda *a, **k: passes.append(1) or matched(*a, **k))
    assert shape(stack.searches(chunks, queries, stack.STRATEGIES, 2, vectors, variants)) == each and len(passes) == 1
    assert {x[0] for x in each} == {"lexical", "dense", "hybrid", "expanded_lexical", "expanded_hybrid"}


def test_the_table_function_takes_few_rows_at_a_time(spark):
    """No Arrow batch of thousands of texts goes to a worker."""
    from lexforge.functions import tables

    tables.register(spark)
    rows = spark.sql("SELECT r.* FROM {df} d, LATERAL line_ranges(d.t, 2) r", df=spark.createDataFrame([("a\nb\nc",)], "t string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan and rows.count() == 2


def test_a_slice_of_keys_takes_little_more_than_its_tables():
    """Runs of keys are counted and chosen a part of the keys at a time; before, over 100 bytes were taken for each of their letters."""
    import tracemalloc

    rng = np.random.default_rng(3)
    keys = [bytes(row).decode() for row in rng.integers(97, 123, size=(20_000, 100), dtype=np.uint8)]
    tracemalloc.start()
    known = literal.Literals(keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    text, key = known.find(["x" + "".join(keys[7:10]) + "y", keys[5][1:], keys[3] + "z"])
    assert list(zip(text.tolist(), key.tolist())) == [(0, 7), (0, 8), (0, 9), (2, 3)] and peak < 60e6


def test_keys_in_parts_are_found_as_all_together(monkeypatch):
    """Wherever the keys are parted, each is found where a text holds it."""
    rng = np.random.default_rng(4)
    keys = ["".join(rng.choice(list("abß"), n)) for n in rng.integers(0, 14, 300)] + ["a" * 40, "ab" * 30, "", "😀b"]
    texts = ["".join(rng.choice(list("abß"), n)) for n in rng.integers(0, 120, 60)] + [None, "", "a" * 90, "x😀b", "ab" * 31]
    want = sorted((i, j) for i, t_ in enumerate(texts) for j, k in enumerate(keys) if t_ and k and k in t_)
    for letters in (1, 50, 1 << 18):
        monkeypatch.setattr(literal, "LETTERS", letters)
        text, key = literal.Literals(keys).find(texts)
        assert list(zip(text.tolist(), key.tolist())) == want


def test_forms_are_made_of_few_letters_at_a_time():
    """What the forms of a batch of texts take besides the texts does not grow with the batch."""
    import tracemalloc

    texts = [f"Word {i}, größer als " * 20 for i in range(9000)]
    form = literal.former("content")
    tracemalloc.start()
    made = form(texts)
    peak = tracemalloc.get_traced_memory()[1]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert made[8000] == t.content_key(texts[8000]) and peak - held < 20e6
