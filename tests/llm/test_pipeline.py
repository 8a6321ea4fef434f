"""The pipeline's stages on a small corpus, each against a plain version."""

import random

import pytest

import corpus_pipeline
from lexforge.llm.queries import QUERIES


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(4)
    folder = str(tmp_path_factory.mktemp("corpus"))
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8)))
    clean = lambda n: " ".join(word() for _ in range(n))
    bench = clean(30)
    rows = []
    for i in range(240):
        junk = i % 6 == 0
        text = " ".join(random.choice(["$$$", "###", "***!"]) for _ in range(60)) if junk else clean(80)
        if not junk and i % 4 == 1:
            text += "\nSubscribe to our newsletter"
        if i == 25:
            text = bench + " " + clean(5)
        rows.append([i, text, "en", f"s{i % 4}", len(text)])
    rows[31][1] = rows[29][1]
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 6 > 0), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus).cache()
        seen.append({r.doc_id: r for r in docs.collect()})
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen[0]) == {i for i in range(240) if i % 6}
    assert set(seen[1]) == set(seen[0]) and not any("Subscribe" in r.text for r in seen[1].values())
    assert set(seen[1]) - set(seen[2]) == {31}
    assert set(seen[2]) - set(seen[3]) == {25}
    assert set(seen[4]) <= set(seen[3]) and all(0 < r.taken <= 2 * r["size"] for r in seen[4].values())
    assert {tuple(r) for r in corpus_pipeline.run(spark, corpus).collect()} == {tuple(r) for r in seen[4].values()}


def test_query_names():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES if k != "pipeline"}


def test_stages_take_nulls_repeats_clashing_columns_and_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = ("kept", "key0", "score", "__row0", "__key1", "__lines", "__score", "component", "size", "h")
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (7, None, "en", "s1", None), (7, "some words of a text that differs", None, "s1", -5), (900, "long " * 50_000, "en", "s1", 250_000)]
    more = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.limit(5))
    for c in names:
        more = more.selectExpr("*", f"'x' AS {c}")
    for name, stage in corpus_pipeline.STAGES:
        before = more.count()
        after = stage(spark, more, corpus).cache()
        assert 0 < after.count() <= before, name
        assert stage(spark, more.limit(0), corpus).count() == 0, name
        if name != "mixing":
            assert after.columns == more.columns and after.where("doc_id IS NULL AND text IS NULL").count() <= 1, name
            more = after
