"""Dense search by the scan and by the index against all pairs, with zero, null, short and non-finite vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.operators import dense, vector_index

NAN, INF = float("nan"), float("inf")
#: Vectors that no search compares, and a zero vector, which only the cosine leaves out.
ODD = [None, [], [1.0], [1.0, None, 0.0], [NAN, 1.0, 0.0], [INF, 1.0, 0.0], [1.0, 2.0, 3.0, 4.0]]
ZERO = [0.0, 0.0, 0.0]


def plain(vectors, queries, k, metric="cosine", allowed=lambda want, have: want is None or want == have):
    out = []
    for q, a, want in queries:
        scored = []
        for v, b, have in vectors:
            if a is None or b is None or len(a) != len(b) or not len(a) or any(x is None or not np.isfinite(x) for x in [*a, *b]) or not allowed(want, have):
                continue
            x, y = np.array(a, float), np.array(b, float)
            if metric == "cosine":
                if not x.any() or not y.any():
                    continue
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                scored.append((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 6), v))
            else:
                scored.append((-round(float(x @ y), 6) if metric == "dot" else round(float(np.sqrt(((x - y) ** 2).sum())), 6), v))
        out += [(q, v, i + 1) for i, (_, v) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def frame(spark, rows, name="vec_id"):
    return spark.createDataFrame([(i, v, f) for i, v, f in rows], f"{name} long, embedding array<double>, label string")


def ids(df):
    return sorted((r.query_id, r.vec_id, r.rank) for r in df.collect())


def table(seed, n=120, width=3):
    random = np.random.default_rng(seed)
    rows = [(i, random.choice([-1, 0, 0.5, 1, 2], width).tolist(), random.choice(["a", "b", None])) for i in range(n)]
    return rows + [(n + i, v, "a") for i, v in enumerate([*ODD, ZERO, ZERO])]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_scan_equals_all_pairs(spark, metric):
    vectors, queries = table(1), [(i, v, f) for i, v, f in table(2, 12)]
    for k in (1, 3, 500):
        for facets in ([], ["label"]):
            found = dense.dense_search(frame(spark, vectors).repartition(3), frame(spark, queries, "query_id"), k, metric, facets)
            assert ids(found) == plain(vectors, [(q, v, f if facets else None) for q, v, f in queries], k, metric)


def test_zero_vectors_take_no_place(spark):
    vectors = [(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [0.0, 0.0], "a"), (4, [0.0, 0.0], "a"), (5, None, "a")]
    for k in range(1, 6):
        assert [r.vec_id for r in dense.dense_search(frame(spark, vectors).coalesce(1), frame(spark, [(9, [1.0, 0.0], "a")], "query_id"), k).orderBy("rank").collect()] == [1, 2][:k]


def test_extreme_lengths_keep_their_cosine(spark):
    vectors = [(1, [1e200, 1e190], None), (2, [1e-200, 0.0], None), (3, [0.0, 1e-300], None)]
    found = dense.dense_search(frame(spark, vectors), frame(spark, [(9, [1e200, 0.0], None)], "query_id"), 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 1.0), (2, 1.0), (3, 0.0)]


def test_blocks_and_slices_give_the_same(spark, monkeypatch):
    vectors, queries = table(3, 400), [(i, v, f) for i, v, f in table(4, 30)]
    want = plain(vectors, [(q, v, None) for q, v, _ in queries], 7)
    monkeypatch.setattr(dense, "PRODUCT_BYTES", 8 * 30 * 11)
    monkeypatch.setattr(dense, "WAITING", 5)
    assert ids(dense.dense_search(frame(spark, vectors), frame(spark, queries, "query_id"), 7, most_bytes=2000)) == want
    with pytest.raises(ValueError):
        dense.dense_search(frame(spark, vectors), frame(spark, queries, "query_id"), 7, "other")


def clustered(n, width, seed=5, spread=0.35):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(25, width))
    return centres[random.integers(0, 25, n)] + spread * random.normal(size=(n, width))


def test_index_is_exact_where_asked(spark, tmp_path):
    vectors, queries = table(6, 300), [(i, v, f) for i, v, f in table(7, 25)]
    index = vector_index.build_index(frame(spark, vectors).repartition(3), str(tmp_path / "i"), ("label",), lists=9)
    again = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    for k, probes, facets in ((1, 1, []), (5, 2, ["label"]), (400, 1, [])):
        want = plain([v for v in vectors if v[1] and len(v[1]) == 3], [(q, v, f if facets else None) for q, v, f in queries], k)
        assert ids(index.search(frame(spark, queries, "query_id"), k, probes, exact=True, facets=facets)) == want
    assert ids(again.search(frame(spark, queries, "query_id"), 5, exact=True, most_bytes=2400)) == ids(again.search(frame(spark, queries, "query_id"), 5, exact=True))
    # Less than k hits in the lists asked: the others are asked as well.
    assert ids(again.search(frame(spark, queries, "query_id"), 400, 1)) == plain([v for v in vectors if v[1] and len(v[1]) == 3], [(q, v, None) for q, v, _ in queries], 400)


def test_index_recall_and_pruning(spark, tmp_path):
    rows = [(i, v.tolist(), None) for i, v in enumerate(clustered(4000, 24))]
    queries = [(i, v.tolist(), None) for i, v in enumerate(clustered(100, 24, seed=8))]
    index = vector_index.build_index(frame(spark, rows).repartition(4), str(tmp_path / "i"))
    scan = ids(dense.dense_search(frame(spark, rows), frame(spark, queries, "query_id"), 10))
    found = ids(index.search(frame(spark, queries, "query_id"), 10))
    recall = len({f[:2] for f in found} & {f[:2] for f in scan}) / len(scan)
    assert recall >= 0.95
    assert ids(index.search(frame(spark, queries, "query_id"), 10, exact=True)) == scan
    plan = index.vectors([1, 2]).select("vec_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert index.vectors([1, 2]).select("list").distinct().count() <= 2 < len(index.lists[0])


def test_index_of_nothing_and_of_odd_rows(spark, tmp_path):
    none = vector_index.build_index(frame(spark, [(i, v, None) for i, v in enumerate([*ODD, ZERO]) if v is None or len(v) < 3]).where("size(embedding) <> 1"), str(tmp_path / "n"), ("label",))
    assert none.search(frame(spark, [(1, [1.0, 0.0, 0.0], None)], "query_id"), 3).collect() == []
    one = vector_index.build_index(frame(spark, [(1, [1.0, 0.0, 0.0], "a"), (1, [1.0, 0.0, 0.0], "a"), (2, ZERO, "a")]), str(tmp_path / "o"), ("label",))
    assert ids(one.search(frame(spark, [(1, [2.0, 0.0, 0.0], None), (2, ZERO, None), (3, [1.0], None)], "query_id"), 3)) == [(1, 1, 1), (1, 1, 2)]


def test_hybrid_search_takes_an_index(spark, tmp_path):
    from lexforge.plans import stack

    rows = [(i, v.tolist(), None) for i, v in enumerate(clustered(200, 8), 1)]
    chunks = spark.createDataFrame([(i, i, "line", f"text {i}", "t", None, None) for i in range(1, 201)], "chunk_id long, work_id long, granularity string, text string, title string, author string, dynasty string")
    chunks = chunks.withColumn("content_key", text.content_form(F.col("text"))).withColumns({f"{c}_key": text.lookup_form(F.col(c)) for c in ("title", "author", "dynasty")})
    queries = spark.createDataFrame([(1, "text 17", rows[3][1]), (2, "nothing", rows[9][1])], "query_id long, question string, embedding array<double>")
    index = vector_index.build_index(frame(spark, rows), str(tmp_path / "i"))
    for strategy in ("dense", "hybrid"):
        both = [sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in stack.search(chunks, queries, strategy, 5, v).collect()) for v in (frame(spark, rows), index)]
        assert both[0] == both[1] and both[0]
