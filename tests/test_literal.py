"""Literal containment against plain Python, and its plans."""

import random

import pytest

from lexforge.operators import literal, postings, retrieval


def plain(texts, keys):
    return sorted((i, j) for i, t in enumerate(texts) for j, k in enumerate(keys) if k and k in (t or ""))


@pytest.mark.parametrize("letters", [7, 1 << 20])
def test_find_equals_containment(monkeypatch, letters):
    monkeypatch.setattr(literal, "LETTERS", letters)
    random.seed(3)
    word = lambda n, of="ab": "".join(random.choice(of) for _ in range(n))
    texts = [None, "", "a", *(word(random.randint(1, 60)) for _ in range(40)), *(word(random.randint(1, 60), "aé漢😀") for _ in range(40))]
    keys = ["", "a", "b", "zz", *(word(random.randint(1, 12)) for _ in range(60)), *(word(random.randint(1, 10), "aé漢😀") for _ in range(40)), texts[5], texts[5] + "x", "a" * 9]
    keys += keys[10:14] + ["prefixprefix" + word(4) for _ in range(20)]
    texts += ["xx" + keys[-1] + "yy" + keys[-3], keys[-2], "a" * 100]
    found = literal.Literals(keys).find(texts)
    assert sorted(zip(*(x.tolist() for x in found))) == plain(texts, keys)


def test_nothing_to_find():
    assert [len(x) for x in literal.Literals([]).find(["a"])] == [0, 0]
    assert [len(x) for x in literal.Literals([""]).find(["a", None])] == [0, 0]
    assert [len(x) for x in literal.Literals(["a"]).find([])] == [0, 0]


def test_matched_rows(spark):
    random.seed(4)
    texts = ["".join(random.choice("abc") for _ in range(random.randint(0, 30))) for _ in range(80)] + [None]
    names = [random.choice(["ab", "cab", None, ""]) for _ in texts]
    rows = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(zip(texts, names))], "id long, body string, name string").repartition(3)
    keys = ["abc", "a", "", None, "bcab", "cabcabca", "ab"]
    queries = spark.createDataFrame(list(enumerate(keys)), "query_id long, q string")
    want = sorted((i, j) for i in range(len(texts)) for j, k in enumerate(keys) if k and (k in (texts[i] or "") or k in (names[i] or "")))
    for most in (1 << 20, 130):
        found = literal.matched(rows, queries, [("body", "q"), ("name", "q")], most)
        assert sorted((r.id, r.query_id) for r in found.collect()) == want and found.columns == ["id", "body", "name", "query_id", "q"]
    assert literal.matched(rows.limit(0), queries, [("body", "q")]).count() == literal.matched(rows, queries.limit(0), [("body", "q")]).count() == 0


def test_chosen_runs_of_a_part_are_chosen_in_the_whole():
    random.seed(6)
    rolling = literal.Rolling()
    for _ in range(200):
        text = "".join(random.choice("abé漢") for _ in range(random.randint(0, 80)))
        a = random.randint(0, len(text))
        part = text[a : a + random.randint(0, 40)]
        whole = {(h, p) for _, h, p in zip(*(x.tolist() for x in postings.chosen_runs([text], rolling)))}
        mine = {(h, p + a) for _, h, p in zip(*(x.tolist() for x in postings.chosen_runs(["", part], rolling)))}
        assert mine <= whole and (len(part) < postings.SHORTEST) == (not mine)


@pytest.mark.parametrize("letters", [30, 1 << 20])
def test_search_by_postings_equals_the_pass_over_all(spark, tmp_path, monkeypatch, letters):
    monkeypatch.setattr(postings, "LETTERS", letters)
    random.seed(7)
    phrase = ["".join(random.choice("abc") for _ in range(24)) for _ in range(5)]
    texts = ["".join(random.choice([*"abc", *phrase]) for _ in range(random.randint(0, 40))) for _ in range(60)] + [None, "", "ab" * 40, phrase[0] * 3]
    names = [random.choice(["abc", phrase[1], None]) for _ in texts]
    rows = [(i, i // 3, "line", t, n, None, None) for i, (t, n) in enumerate(zip(texts, names))]
    chunks = spark.createDataFrame(rows, "chunk_id long, work_id long, granularity string, content_key string, title_key string, author_key string, dynasty_key string").repartition(3)
    keys = [*phrase, phrase[0] + phrase[0], "abab" * 6, "abc", "a", phrase[2][3:20], "x" * 30, "ab" * 8, "".join(p[:9] for p in phrase)]
    keys += [t[5:35] for t in texts if t and len(t) > 60][:10]
    queries = spark.createDataFrame([(i, k, k) for i, k in enumerate(keys)], "query_id long, q_content string, q_lookup string")
    index = postings.build_postings(chunks, str(tmp_path / "p"))
    shape = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score, tuple(r.match_types), r.candidate_count) for r in df.collect())
    assert shape(retrieval.lexical_search(chunks, queries, 40, index=index)) == shape(retrieval.lexical_search(chunks, queries, 40))
    held = {(r.query_id, r.chunk_id) for r in postings.PostingsIndex(spark, str(tmp_path / "p")).candidates(queries.where(f"length(q_content) >= {postings.SHORTEST}")).collect()}
    assert held >= {(j, i) for i, t in enumerate(texts) for j, k in enumerate(keys) if len(k) >= postings.SHORTEST and t and k in t}
    assert "PartitionFilters: [bucket" in index.places([1, 2])._jdf.queryExecution().toString().replace("isnotnull(bucket#", "bucket#")
