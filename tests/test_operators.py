import random

import pytest
from pyspark.sql import functions as F

from lexforge.operators import catalog, evaluation, ingest, retrieval, selection
from lexforge.sources import datasets, ndjson, ports, sse
from lexforge.streaming import chat, index_runs


def chunks(spark):
    rows = [(1, 10, "poem", "床前明月光", "静夜思", "李白", "唐"), (2, 10, "line", "明月", "静夜思", "李白", "唐"), (3, 11, "line", "李白乘舟", "赠汪伦", "李白", "唐"), (4, 12, "note", "a%b", "x_y", None, None), (5, 13, "line", "登高望远", "望岳", "杜甫", "唐"), (6, 14, "poem", "风急天高", "登高", "杜甫", "唐")]
    frame = spark.createDataFrame(rows, "chunk_id long, work_id long, granularity string, text string, title string, author string, dynasty string")
    return frame.withColumn("content_key", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")).withColumns({f"{c}_key": F.lower(F.trim(c)) for c in ("title", "author", "dynasty")})


@pytest.mark.parametrize("most_bytes", [1 << 20, 100])
def test_lexical_search(spark, most_bytes):
    queries = retrieval.query_keys(spark.createDataFrame([(1, "明月"), (2, "登高"), (3, "%"), (4, "_"), (5, "李白"), (6, "!!"), (7, " ")], "query_id long, question string"))
    found = [(r.query_id, r.rank, r.chunk_id, r.score, list(r.match_types)) for r in retrieval.lexical_search(chunks(spark), queries, 3, most_bytes=most_bytes).orderBy("query_id", "rank").collect()]
    assert found[0] == (1, 1, 2, 1.0, ["chunk_exact"]) and found[1] == (1, 2, 1, 0.8, ["chunk_phrase"])
    assert [f[2] for f in found if f[0] == 2] == [6, 5] and [f[2] for f in found if f[0] == 4] == [4]
    assert not [f for f in found if f[0] in (3, 7)]
    assert [(f[2], f[3]) for f in found if f[0] == 5] == [(2, 0.95), (3, 0.95), (1, 0.95)]


@pytest.mark.parametrize("most_bytes", [1 << 20, 100])
def test_lexical_search_finds_long_names_in_any_number_of_slices(spark, most_bytes):
    names = [("a long summer night", "somebody else", "tang dynasty"), ("a long summer", "a long summer", None), ("night", None, "the long winter"), (None, "!!!!????....", "x")]
    rows = [(10 * w + i, w, "line", text, *names[w]) for w in range(4) for i, text in enumerate(["nothing of it", "A long summer night!", None])]
    frame = spark.createDataFrame(rows + rows[:1], "chunk_id long, work_id long, granularity string, text string, title string, author string, dynasty string")
    frame = frame.withColumn("content_key", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")).withColumns({f"{c}_key": F.lower(F.trim(c)) for c in ("title", "author", "dynasty")})
    asked = ["a long summer night", "a long summer", "somebody else", "the long winter", "!!!!????", "summer", "absent altogether"]
    queries = retrieval.query_keys(spark.createDataFrame(list(enumerate(asked)), "query_id long, question string"))
    found = retrieval.lexical_search(frame, queries, 20, most_bytes=most_bytes).collect()
    key = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    want = [(q, r[0]) for q, a in enumerate(asked) for r in rows + rows[:1] if key(a) and key(a) in key(r[3]) or any(a in (n or "") for n in r[4:])]
    assert sorted((r.query_id, r.chunk_id) for r in found) == sorted(want)
    filtered = queries.withColumns({"only_author": F.when(F.col("query_id") < 2, "somebody else"), "only_dynasty": F.lit(None).cast("string")})
    some = {(r.query_id, r.chunk_id) for r in retrieval.lexical_search(frame, filtered, 20, most_bytes=most_bytes, fetch=("text",)).collect()}
    assert some == {(q, c) for q, c in want if q > 1 or c < 10}
    assert {(r.chunk_id, r.score) for r in found if r.query_id == 0} >= {(0, 1.0), (2, 1.0)} and all(r.candidate_count == sum(q == r.query_id for q, _ in want) for r in found)


def test_dense_search_and_floor(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.6, 0.8], 1), (3, [2.0, 0.0], 2), (4, [-1.0, 0.0], 1)], "vec_id long, embedding array<float>, f int")
    query = spark.createDataFrame([(9, [1.0, 0.0], 1)], "query_id long, embedding array<float>, f int")
    rows = lambda df: [(r.vec_id, r.score) for r in df.orderBy("rank").collect()]
    assert rows(retrieval.dense_search(vectors, query, 3)) == [(1, 1.0), (3, 1.0), (2, 0.6)]
    assert rows(retrieval.dense_search(vectors, query, 2, facets=["f"])) == [(1, 1.0), (2, 0.6)]
    assert rows(retrieval.dense_search(vectors, query, 2, "dot"))[0] == (3, 2.0) and rows(retrieval.dense_search(vectors, query, 2, "euclid"))[1] == (2, 0.894427)
    assert rows(retrieval.dense_search(vectors, query, 3, most_bytes=1)) == [(1, 1.0), (3, 1.0), (2, 0.6)]
    hits = spark.createDataFrame([(1, "line", 0.585), (2, "note", 0.585), (3, "note", 1.2)], "chunk_id long, granularity string, score double")
    assert [r.chunk_id for r in retrieval.above_floor(hits, 0.6).collect()] == [1, 3]
    assert retrieval.dense_search(vectors, query.limit(0), 3).count() == 0


def branch(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank long, chunk_id long, score double, match_types array<string>")


def test_hybrid(spark):
    lexical, dense = branch(spark, [(1, 1, 7, 1.0, ["chunk_exact"]), (1, 2, 8, 0.8, ["chunk_phrase"]), (2, 1, 9, 1.0, [])]), branch(spark, [(1, 1, 8, 0.9, []), (1, 2, 6, 0.8, [])])
    rows = retrieval.hybrid(lexical, dense, 3, spark.createDataFrame([(2,)], "query_id long")).orderBy("rank").collect()
    assert [(r.chunk_id, list(r.match_types)) for r in rows] == [(8, ["lexical", "chunk_phrase", "dense", "rrf_fusion"]), (7, ["lexical", "chunk_exact", "rrf_fusion"]), (6, ["dense", "rrf_fusion"])]
    assert rows[0].score == round((1 / 62 + 1 / 61) / (2 / 61), 6)
    assert [r.strategy for r in retrieval.hybrid(lexical, dense, 1, dense_failed=True).collect()] == ["lexical", "lexical"]


def test_expanded_counts_every_variant(spark):
    rows = spark.createDataFrame([(1, 0, 1, 5, ["a"], 3.0), (1, 1, 1, 6, ["b"], 1.5), (1, 2, 2, 6, ["a"], 1.5)], "query_id long, ord int, rank long, chunk_id long, match_types array<string>, weight double")
    found = {r.chunk_id: r for r in retrieval.expanded(rows, 5).collect()}
    assert found[5].rank == 1 and list(found[6].match_types) == ["b", "a", "query_expansion", "rrf_fusion"] and found[5].score == 0.5
    kept = retrieval.weighted_variants(spark.createDataFrame([(1, 0, "q", 3.0), (1, 1, "x", 0.5), (1, 2, "y", 1.5)], "query_id long, ord int, variant string, weight double"), 2)
    assert sorted(r.ord for r in kept.collect()) == [0, 2]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank long, chunk_id long, work_id long, title string, granularity string, text string, line_start int, rrf double, best_rank long")


def test_selectors(spark):
    rows = ranked(spark, [(1, i, i, w, f"t{w}", g, x, i, 1 / (60 + i), i) for i, (w, g, x) in enumerate([(1, "line", "moon"), (1, "line", "sun"), (1, "poem", "moon sun"), (2, "note", "moon river"), (2, "line", "river"), (3, "poem", "hill")], 1)])
    wanted = lambda titles, groups=(), anchors=(): spark.createDataFrame([(1, list(titles), ["moon"], [list(g) for g in groups], [list(a) for a in anchors])], "query_id long, titles array<string>, terms array<string>, groups array<array<string>>, anchors array<array<string>>")
    picks = lambda df: [r.chunk_id for r in df.orderBy("place").collect()]
    assert picks(selection.explicit_titles(rows, wanted(["t1"]), 3)) == [1, 3, 2]
    assert picks(selection.explicit_titles(rows, wanted(["t1"]), 1, tail=True)) == [3]
    assert picks(selection.explicit_titles(rows, wanted(["t2"]), 1, primary=True)) == [5]
    missing = selection.explicit_titles(rows, wanted(["t1", "none"]), 3).collect()
    assert [(r.hard_filtered, r.chunk_id) for r in missing] == [(True, None)]
    assert picks(selection.multi_evidence(rows, wanted([], [["river"], ["hill"]], [[], []]), 4)) == [5, 6, 1, 2]
    assert picks(retrieval.diversified(rows.drop("text"), 4)) == [1, 2, 4, 5]
    theme = rows.withColumn("terms", F.array(F.lit("river"))).select("query_id", "rank", "work_id", "chunk_id", "granularity", "text", "terms", "rrf", "best_rank")
    assert picks(retrieval.theme_insert(theme, 4)) == [1, 2, 3, 4]
    assert picks(retrieval.theme_insert(theme.where("rank <> 3"), 4)) == [1, 2, 4, 5]


def plain_context(works, chunk_sizes, max_chunks, max_chars):
    place, used, out = {w: 0 for w in works}, 0, []
    while len(out) < max_chunks and used < max_chars:
        added = False
        for w in works:
            if place[w] < len(chunk_sizes[w]) and len(out) < max_chunks and used < max_chars:
                chunk, size = chunk_sizes[w][place[w]]
                place[w] += 1
                if used + size <= max_chars:
                    out.append(chunk)
                    used += size
                    added = True
        if not added:
            break
    return out


def test_context_fold(spark):
    random.seed(3)
    for _ in range(4):
        works = random.sample(range(1, 9), 4)
        sizes = {w: [(w * 100 + i, random.choice([1, 5, 20, 60])) for i in range(random.randint(0, 6))] for w in works}
        results = spark.createDataFrame([(1, i, -w, w, 0.5) for i, w in enumerate(works, 1)], "query_id long, rank long, chunk_id long, work_id long, score double")
        table = spark.createDataFrame([(w, c, i, "x" * n) for w in works for i, (c, n) in enumerate(sizes[w])] or [(0, 0, 0, "")], "work_id long, chunk_id long, chunk_index long, text string")
        for most, letters in ((3, 100), (40, 50), (40, 4800), (5, 0)):
            got = [r.chunk_id for r in retrieval.context_rows(results, table, most, letters).orderBy("place").collect()]
            assert got == plain_context(works, sizes, most, letters)
    with pytest.raises(ValueError):
        retrieval.context_rows(results, table, -1, 5)


def test_budgets(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 5), (1, 2, "b" * 9), (1, 3, "c")], "query_id long, rank long, text string")
    assert [r.text for r in retrieval.prefix_budget(rows, 6, 10).orderBy("rank").collect()] == ["aaaaa"]
    assert [r.text for r in retrieval.clipped_budget(rows, 6, 10).orderBy("rank").collect()] == ["aaaaa", "bbbbb"]


def test_quotas_equal_handing_out_one_by_one(spark):
    random.seed(4)
    for _ in range(5):
        sizes = {f"d{i}": random.randint(1, 30) for i in range(random.randint(1, 6))}
        total, order = sum(sizes.values()), sorted(sizes, key=lambda d: (-sizes[d], d))
        limit = random.randint(len(sizes), total)
        want = {d: 1 for d in sizes}
        for _ in range(limit - len(sizes)):
            d = max((d for d in order if want[d] < sizes[d]), key=lambda d: (limit * sizes[d] / total - want[d], sizes[d] - want[d], -order.index(d)))
            want[d] += 1
        got = ingest.quotas(spark.createDataFrame(list(sizes.items()), "dynasty string, size long"), limit)
        assert {r.dynasty: r.quota for r in got.collect()} == want


def test_ingest_results(spark):
    current = spark.createDataFrame([("a", "t", None, "published"), ("b", "t", 1, "draft"), ("c", "old", 1, "published")], "id string, title string, n int, status string")
    staged = spark.createDataFrame([("a", "t", None, True), ("b", "t", 1, True), ("c", "new", 1, True), ("d", "t", 1, True), ("e", "", 1, True)], "id string, title string, n int, publish boolean")
    done = ingest.classify(staged, current, "id", ["title", "n"], F.when(F.col("title") == "", "blank"))
    assert {r.id: r.result for r in done.collect()} == {"a": "unchanged", "b": "updated", "c": "updated", "d": "created", "e": "failed"}
    assert tuple(ingest.report(done).first()) == (1, 2, 1, 1)
    dims = ingest.with_keys(spark.createDataFrame([(" Du Fu",), ("LI BAI",), ("du fu",), (" ",)], "name string"), spark.createDataFrame([(4, "Li Bai")], "id int, name string"), "name", "id")
    assert sorted((r.id, r.name) for r in dims.collect()) == [(4, "Li Bai"), (5, "Du Fu")]
    assert ingest.first_wins(spark.createDataFrame([(2, "k"), (1, "k"), (3, "m")], "i int, k string"), ["k"], "i").count() == 2
    labels = spark.createDataFrame([('["a"," A ","b",""]',), ('"x"',), ("5x",)], "v string").select(ingest.label_list(F.col("v")).alias("l")).collect()
    assert [list(r.l) for r in labels] == [["a", "b"], ["x"], []]


def files_of(path):
    found = {}
    for f in path.rglob("*.parquet"):
        found.setdefault(f.parent.name, set()).add(f.name)
    return found


def test_imports_rewrite_touched_parts_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"t{i}", "published", 1) for i in range(60)], "id long, title string, status string, version_no long")
    ingest.create_stored(rows, path, "id", 8)
    before = files_of(tmp_path / "t")
    staged = rows.select("id", F.when(F.col("id") == 7, "new").otherwise(F.col("title")).alias("title"))
    results = ingest.apply_stored(staged, path, "id", ["title"], parts=8)
    assert {r.result: r.n for r in results.groupBy("result").count().withColumnRenamed("count", "n").collect()} == {"updated": 1, "unchanged": 59}
    after = files_of(tmp_path / "t")
    [changed] = [p for p in before if before[p] != after[p]]
    assert ingest.stored(spark, path).where("id = 7").select("part", "title", "version_no").collect() == [(int(changed.split("=")[1]), "new", 2)]
    assert ingest.stored(spark, path).count() == 60
    again = ingest.apply_stored(staged, path, "id", ["title"], parts=8)
    assert {r.result for r in again.collect()} == {"unchanged"} and files_of(tmp_path / "t") == after


def test_rebuilding_rewrites_the_named_versions_only(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([(v, i, f"{v}-{i}", "x" if v == 3 else None) for v in range(1, 4) for i in range(4)], "version_id int, chunk_id long, text string, vector_id string")
    ingest.rewritten(rows, path, "version_id")
    before = files_of(tmp_path / "c")
    ingest.rebuild_stored(ingest.stored(spark, path).where("version_id = 2 AND chunk_id < 2").withColumn("text", F.upper("text")), path)
    after = files_of(tmp_path / "c")
    assert [v for v in before if before[v] != after[v]] == ["version_id=2"]
    assert {r.version_id: r["count"] for r in ingest.stored(spark, path).groupBy("version_id").count().collect()} == {1: 4, 2: 2, 3: 4}
    with pytest.raises(ValueError, match="version 3"):
        ingest.rebuild_stored(rows.where("version_id = 3"), path)


def test_catalogue(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id long, parent_id long")
    chains = spark.range(1_100_000).select("id", F.when(F.col("id") % 11 > 0, F.col("id") - 1).alias("parent_id"))
    assert catalog.ancestors(chains, 4).count() == 100_000 * (1 + 2 + 3 + 4 * 7)
    found = {(r.id, r.ancestor_id, r.cycle) for r in catalog.ancestors(nodes).collect()}
    assert {(3, 2, False), (3, 1, False), (8, 8, True)} <= found and len([f for f in found if f[0] == 8]) == 2
    into = spark.createDataFrame([(4, 1), (1, 2), (2, 3), (3, 1)], "id long, parent_id long")
    assert sorted((r.ancestor_id, r.hops, r.cycle) for r in catalog.ancestors(into).where("id = 4").collect()) == [(1, 1, False), (2, 2, False), (3, 3, False)]
    page = catalog.page(nodes, 2, 2, F.asc("id")).collect()
    assert [r.id for r in page] == [3, 8] and page[0].total == 5 and page[0].total_pages == 3


def test_evaluation_summaries(spark):
    rows = spark.createDataFrame([("a", "evidence", 1.0, 5, 0.5, 1.0, True), ("a", "evidence", 2.0, 0, 0.0, 0.0, False), ("b", "no_evidence", 3.0, 0, None, None, True), ("b", "no_evidence", 4.0, 2, None, None, False)], "category string, expected string, latency_ms double, retrieved_count long, recall_at_k double, reciprocal_rank double, passed boolean")
    s = evaluation.retrieval_summary(rows).first()
    assert (s.pass_rate, s.recall_at_k, s.mrr, s.hit_rate_at_k, s.refusal_precision, s.refusal_recall, s.refusal_f1, s.p95_latency_ms) == (0.5, 0.25, 0.5, 0.5, 0.5, 0.5, 0.5, 4.0)
    assert evaluation.retrieval_summary(rows, ["category"], overall=True).count() == 3
    none = evaluation.retrieval_summary(rows.limit(0)).first()
    assert (none.total_cases, none.recall_at_k, none.average_latency_ms, none.p95_latency_ms) == (0, None, 0.0, 0.0)
    supports = spark.createDataFrame([(["supported"],), (["unsupported"],), (["supported", "unsupported"],), ([],)], "s array<string>")
    assert [r[0] for r in supports.select(evaluation.faithfulness(F.col("s"))).collect()] == ["supported", "unsupported", "partially_supported", "partially_supported"]
    sel = spark.createDataFrame([(None, None), ("x", None), ("x", "x"), ("y", "x")], "want string, have string")
    assert [r[0] for r in sel.select(evaluation.selector_matches({"f": F.col("want")}, {"f": F.col("have")})).collect()] == [True, False, True, False]


def test_calibration_needs_a_case(spark):
    judged = spark.createDataFrame([("a", "judged", False), ("b", "skipped", True)], "case_id string, judge_status string, bad boolean")
    assert [r.case_id for r in evaluation.selected_for_calibration(judged, F.col("bad"), "all").collect()] == ["a"]
    for scope in ("failures", "other"):
        with pytest.raises(ValueError):
            evaluation.selected_for_calibration(judged, F.col("bad"), scope)


def test_overlap_ranking_equals_the_score_of_every_pair(spark):
    from lexforge.functions import text as t

    random.seed(8)
    word = lambda: random.choice(["moon", "moonlight", "river", "sun", "sunset", "hill", "illness"])
    rows = spark.createDataFrame([(i, " ".join(word() for _ in range(random.randint(0, 5))), random.choice([word(), None])) for i in range(60)] + [(99, None, "moon")], "work_id long, body string, head string")
    queries = spark.createDataFrame([(i, [word() for _ in range(3)] + ["", "sun", "sun"], [word()]) for i in range(9)] + [(20, [], ["hill"]), (21, None, None)], "query_id long, terms array<string>, anchors array<string>")
    body, head = F.coalesce("body", F.lit("")), F.coalesce("head", F.lit(""))
    every = rows.crossJoin(queries.where("terms IS NOT NULL")).select("query_id", "work_id", t.group_score(body, head, F.col("terms"), F.col("anchors")).alias("score")).where("score > 0").collect()
    assert sorted(map(tuple, retrieval.overlap_ranked(rows, queries, 1000).select("query_id", "work_id", "score").collect())) == sorted(map(tuple, every))


def test_chat_states(spark):
    rows = [(1, 1, "delta", "ab"), (1, 2, "done", None), (1, 3, "error", None), (1, 4, "delta", "late"), (2, 1, "delta", "x"), (3, 1, "cancelled", None)]
    found = {r.stream_id: (r.status, r.n_deltas) for r in chat.final_states(spark.createDataFrame(rows, "stream_id long, seq long, kind string, payload string")).collect()}
    assert found == {1: ("completed", 1), 2: ("failed", 1), 3: ("cancelled", 0)}
    runs = spark.createDataFrame([(1, 1, "start"), (1, 2, "succeed"), (1, 3, "start"), (2, 1, "fail")], "run_id long, seq long, command string")
    assert {r.run_id: (r.status, r.refused) for r in index_runs.run_states(runs).collect()} == {1: ("succeeded", 1), 2: ("pending", 1)}


def test_index_pipeline_publishes_all_or_nothing(spark, tmp_path):
    table = spark.createDataFrame([(1, "v1", "moon", "pending"), (2, "v2", "sun", "ready")], "chunk_id long, vector_id string, text string, status string")
    embed = lambda df: ports.embedded(df, "text")
    good = index_runs.index_chunks(table, embed, str(tmp_path / "a"), 32)
    assert {r.status for r in good.collect()} == {"ready"} and index_runs.live_points(spark, str(tmp_path / "a")).count() == 1
    bad = index_runs.index_chunks(table, embed, str(tmp_path / "b"), 99)
    assert {r.chunk_id: r.status for r in bad.collect()} == {1: "failed", 2: "ready"} and index_runs.live_points(spark, str(tmp_path / "b")).count() == 0
    assert index_runs.swept(spark, str(tmp_path / "b")) == [] and index_runs.index_chunks(good, embed, str(tmp_path / "a"), 32).count() == 2

    def broken(df):
        def fail(texts):
            raise ports.ProviderError("down")

        return ports.embedded(df, "text", fail)

    assert {r.chunk_id: r.status for r in index_runs.index_chunks(table, broken, str(tmp_path / "a"), 32).collect()} == {1: "failed", 2: "ready"}
    assert index_runs.live_points(spark, str(tmp_path / "a")).count() == 1 and index_runs.swept(spark, str(tmp_path / "a")) == []


def test_index_runs_that_overlap_and_crash(spark, tmp_path):
    path = str(tmp_path / "s")

    def run(ids, text):
        rows = spark.createDataFrame([(i, f"v{i}", text, "pending") for i in ids], "chunk_id long, vector_id string, text string, status string")
        return index_runs.index_chunks(rows, lambda df: ports.embedded(df, "text", dimension_of(text)), path, 3)

    def dimension_of(text):
        return lambda texts: [[float(len(text)), 0.0, 1.0]] * len(texts)

    live = lambda: {r.vector_id: (r.embedding[0], r.generation) for r in index_runs.live_points(spark, path).collect()}
    run([1, 2], "a")
    run([2, 3], "bb")
    assert live() == {"v1": (1.0, 1), "v2": (2.0, 2), "v3": (2.0, 2)}
    # A crash between the phases: points are there, but no manifest names them.
    rows = spark.createDataFrame([("v1", 1, [9.0, 9.0, 9.0], False)], "vector_id string, chunk_id long, embedding array<float>, deleted boolean")
    index_runs.write_run(rows, path, "run-crashed")
    assert live()["v1"] == (1.0, 1)
    run([1], "ccc")
    index_runs.withdrawn(spark.createDataFrame([("v3",)], "vector_id string"), path)
    assert live() == {"v1": (3.0, 3), "v2": (2.0, 2)}
    index_runs.compacted(spark, path)
    assert {v: e for v, (e, _) in live().items()} == {"v1": 3.0, "v2": 2.0}
    assert "run-crashed" in index_runs.swept(spark, path) and len(live()) == 2


def test_manifest_is_changed_by_compare_and_swap(spark, tmp_path):
    from lexforge.sources import manifest

    folder, calls = str(tmp_path / "m"), []

    def change(names):
        calls.append(list(names))
        if len(calls) == 1:
            manifest.published(spark, folder, lambda now: [*now, "other"])
        return [*names, "mine"]

    assert manifest.current(spark, folder) == (0, [])
    assert manifest.published(spark, folder, change) == 2
    assert calls == [[], ["other"]] and manifest.current(spark, folder) == (2, ["other", "mine"])


def test_ports(spark):
    assert ports.ordered_vectors([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], 2) == [[1.0], [2.0]]
    for reply in ([{"index": 0, "embedding": [1.0]}], [{"index": 0, "embedding": [1.0]}, {"index": 1, "embedding": [1.0, 2.0]}]):
        with pytest.raises(ports.ProviderError):
            ports.ordered_vectors(reply, 2)
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ports.ProviderError("busy", retryable=True)
        return x

    assert ports.retried(flaky, 5, wait=0) == 5 and len(calls) == 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"t": "x"}\n\n{"t": "y"}\n')
    (tmp_path / "b.ndjson").write_text('{"t": "z"}\nbad\n[1]\n')
    rows = ndjson.read_shards(spark, [str(tmp_path / "a.ndjson")], "t string").orderBy("line").collect()
    assert [(r.line, r.source_line, r.record.t) for r in rows] == [(1, 1, "x"), (3, 2, "y")]
    both = ndjson.read_shards(spark, [str(tmp_path / "a.ndjson"), str(tmp_path / "b.ndjson")], "t string", strict=False)
    assert {(r.file, r.line, r.error) for r in both.where("error IS NOT NULL").collect()} == {("b.ndjson", 2, "invalid JSON"), ("b.ndjson", 3, "not an object")}
    assert {r.records for r in ndjson.shard_manifest(both).collect()} == {2, 3}
    with pytest.raises(ValueError, match="line 2"):
        ndjson.read_shards(spark, [str(tmp_path / "b.ndjson")], "t string")
    with pytest.raises(ValueError, match="differ"):
        ndjson.read_shards(spark, [str(tmp_path / "a.ndjson"), str(tmp_path / "x/a.ndjson")], "t string")
    (tmp_path / "r.csv").write_text("﻿case_id,relevance_0_2,faithfulness_0_2\nc1,2, 1\n,,\n", encoding="utf-8")
    assert [tuple(r) for r in datasets.read_reviews(spark, str(tmp_path / "r.csv")).collect()] == [("c1", 2, 1)]
    (tmp_path / "r.csv").write_text("case_id,relevance_0_2,faithfulness_0_2\nc1,3,1\n")
    with pytest.raises(ValueError, match="c1"):
        datasets.read_reviews(spark, str(tmp_path / "r.csv"))
    (tmp_path / "d.json").write_text('{"version": "1", "records": [{"external_id": "a", "title": "t", "content": "c"}, {"external_id": "a", "title": "t", "content": "c"}]}')
    with pytest.raises(ValueError, match="external_id repeats"):
        datasets.read_dataset(spark, str(tmp_path / "d.json"))
    datasets.write_report(spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double").coalesce(1), str(tmp_path / "out"), "markdown")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["| a | 0.500000 |", "| b | n/a |"]
    stream = spark.createDataFrame([(1, ": c\r\nevent: a\r\ndata: 1\r\ndata: 2\r\n\r\ndata: x\n\n")], "k long, s string")
    assert [(r.event, r.data) for r in sse.parsed(stream, "k", "s").orderBy("place").collect()] == [("a", "1\n2"), ("message", "x")]


def test_stack(spark):
    from lexforge.plans import stack

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (6, [0.0, 1.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, "明月", [0.0, 1.0])], "query_id long, question string, embedding array<float>")
    variants = spark.createDataFrame([(1, 0, "明月", 3.0, [0.0, 1.0]), (1, 1, "登高", 1.5, [0.0, 1.0])], "query_id long, ord int, question string, weight double, embedding array<float>")
    got = {s: [r.chunk_id for r in stack.search(chunks(spark), queries, s, 3, vectors, variants).orderBy("rank").collect()] for s in stack.STRATEGIES}
    assert got["lexical"] == [2, 1] and got["dense"] == [6, 1] and got["expanded_lexical"][0] == 2 and set(got["expanded_lexical"]) == {1, 2, 6}
    assert set(got["hybrid"]) == {1, 2, 6} and len(got["expanded_hybrid"]) == 3
    assert {r.strategy for r in stack.search(chunks(spark), queries, "hybrid", 3).collect()} == {"lexical"}
    with pytest.raises(ValueError):
        stack.search(chunks(spark), queries, "other", 3)
    results = stack.search(chunks(spark), queries, "lexical", 1).withColumn("work_id", F.lit(10).cast("long"))
    rows = stack.with_context(results, chunks(spark).withColumn("chunk_index", F.col("chunk_id"))).orderBy("rank").collect()
    assert [(r.chunk_id, list(r.match_types)) for r in rows] == [(2, ["chunk_exact"]), (1, ["parent_context"])]


def test_strategies_and_works_that_may_be_found(spark):
    table = chunks(spark).withColumn("chunk_strategy", F.when(F.col("chunk_id") % 2 == 0, "a").otherwise("b"))
    queries = retrieval.query_keys(spark.createDataFrame([(1, "李白")], "query_id long, question string"))
    ids = lambda **kw: [r.chunk_id for r in retrieval.lexical_search(table, queries, 5, **kw).orderBy("rank").collect()]
    assert ids() == ids(strategies=[]) == [2, 3, 1] and ids(strategies=["b"]) == [3, 1] and ids(granularities=["line"], strategies=["a"]) == [2]
    assert ids(among=spark.createDataFrame([(11,)], "work_id long")) == [3]


def test_candidate_columns(spark):
    from lexforge.operators.candidates import CANDIDATE, detailed

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    stored = frame([(i, f"v{i}", 10 + i, 20 + i, 5 if i == 1 else None, "line", 0, "t", "t", 1, 2, "s", "ready") for i in (1, 2, 3)], "chunk_id long, vector_id string, work_id long, version_id long, annotation_id long, granularity string, chunk_index int, text string, normalized_text string, line_start int, line_end int, chunk_strategy string, chunk_status string")
    works_of = frame([(11, "T", 1, 7, "d"), (12, "U", None, None, None), (13, "V", 1, 7, "d")], "work_id long, title string, author_id long, dynasty_id long, published_at string")
    sides = frame([(21,), (22,)], "version_id long"), frame([(1, "A")], "author_id long, author_name string"), frame([(8, "D")], "dynasty_id long, dynasty_name string"), frame([(5, "note")], "annotation_id long, annotation_type string")
    hits = frame([(9, 1, 1, "x"), (9, 2, 2, "x"), (9, 3, 3, "x")], "query_id long, rank long, chunk_id long, text string")
    rows = detailed(hits, stored, works_of, *sides).orderBy("rank").collect()
    assert rows[0].__fields__ == ["query_id", "rank", *CANDIDATE] and len(CANDIDATE) == 20
    assert [(r.chunk_id, r.author_name, r.dynasty_id, r.dynasty_name, r.annotation_type) for r in rows] == [(1, "A", 7, None, "note"), (2, None, None, None, None)]


def test_expanded_search(spark):
    from lexforge.plans import stack
    from lexforge.plans.rewrite import Lexicon

    lexicon = Lexicon((("moon", ("月亮", "明月"), ("明月", "月光")),), ("李白", "杜甫"), ("唐",), ("诗", "描写"))
    authors, dynasties = spark.createDataFrame([("李白",), ("杜甫",), (None,)], "author string"), spark.createDataFrame([("唐",)], "dynasty string")
    asked = [(1, "杜甫的出生地", None), (2, "李白的诗", None), (3, "《登高》", None), (4, "《无名》", None), (5, "  ", None), (6, "明月", "杜甫"), (7, "比较《静夜思》和《登高》", None), (8, None, None), (9, "明月", None)]
    queries = spark.createDataFrame(asked, "query_id long, question string, caller_author string")
    got = {}
    for row in stack.expanded_search(chunks(spark), queries, lexicon, authors, dynasties, 3).orderBy("query_id", "place").collect():
        got.setdefault(row.query_id, []).append(row)
    picks = {q: [(r.chunk_id, r.hard_filtered) for r in rows] for q, rows in got.items()}
    assert picks[1] == picks[4] == [(None, True)] and not {5, 6, 8} & set(picks)
    assert [c for c, _ in picks[2]] == [2, 3, 1] and got[2][0].score == 0.4 and "query_expansion" in got[2][0].match_types
    assert [c for c, _ in picks[3]] == [6, 5] and [c for c, _ in picks[7]][:2] == [1, 6]
    assert [(r.chunk_id, r.score, list(r.match_types)) for r in got[9]][:1] == [(2, 1.0, ["chunk_exact"])]
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "李白", "唐"), (6, [1.0, 0.0], "杜甫", "唐")], "vec_id long, embedding array<float>, author_key string, dynasty_key string")
    embed = lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    both = stack.expanded_search(chunks(spark), queries.where("query_id IN (2, 9)"), lexicon, authors, dynasties, 5, vectors, embed, 0.5).collect()
    assert {r.chunk_id for r in both if r.query_id == 2} == {1, 2, 3} and 6 in {r.chunk_id for r in both if r.query_id == 9}


def test_variants_are_capped_and_names_go_behind_filters(spark):
    from lexforge.plans import stack
    from lexforge.plans.rewrite import Lexicon, rewrites

    lexicon = Lexicon((), ("李白",), ("唐",), ("诗",))
    made = stack.resolved(rewrites(spark, [(1, "李白怎样描写黄河的诗句")], lexicon), spark.createDataFrame([("李白",)], "author string"), spark.createDataFrame([("唐",)], "dynasty string"))
    rows = stack.weighted(made, 5, 3).collect()
    assert all(r.only_author == "李白" and r.own_k == 25 for r in rows) and "李白" not in {r.question for r in rows} and len(rows) == 2
    twice = stack.resolved(made.drop("only_author", "only_dynasty", "author_name", "dynasty_name", "author_found", "dynasty_found"), spark.createDataFrame([("李白",), (" 李白",)], "author string"), spark.createDataFrame([], "dynasty string"))
    assert {r.only_author for r in twice.collect()} == {None}


def test_facets_of_queries(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "b"), (3, [1.0, 0.2], None)], "vec_id long, embedding array<float>, f string")
    ids = lambda df: [r.vec_id for r in df.orderBy("rank").collect()]
    ask = lambda value, kind: retrieval.dense_search(vectors, spark.createDataFrame([(9, [1.0, 0.0], value)], f"query_id long, embedding array<float>, f {kind}"), 3, facets=["f"])
    assert ids(ask(None, "string")) == [1, 2, 3] and ids(ask("b", "string")) == [2] and ids(ask(["a", "b"], "array<string>")) == [1, 2]


def test_request_metrics(spark):
    ts = lambda s: f"2024-01-01 00:00:0{s}"
    rows = [(1, 1, ts(0), "timing", "rewrite", 5, 9, 2), (1, 2, ts(1), "delta", "generation", 7, 9, 2), (1, 3, ts(2), "done", "validate", 1, 9, 2), (1, 4, ts(3), "delta", "generation", 100, 99, 5), (2, 1, ts(0), "delta", "retrieval", 3, 0, 0)]
    frame = spark.createDataFrame(rows, "request_id long, seq long, ts string, kind string, step string, duration_ms long, candidates long, selected long").withColumn("ts", F.to_timestamp("ts"))
    got = {r.request_id: r for r in chat.request_metrics(frame, "hybrid", 8).collect()}
    assert (got[1].status, got[1].finish_reason, got[1].generation_ms, got[1].candidate_count, got[1].ttft_ms, got[1].total_ms, got[1].assess_ms) == ("completed", "stop", 7, 9, 1000, 2000, None)
    assert (got[2].status, got[2].error_code, got[2].assessment_reason_code) == ("failed", "stream_interrupted", "no_evidence")


def test_vector_store(spark, tmp_path):
    from lexforge.sources import vector_store as vs

    path = str(tmp_path / "points")
    rows = lambda *r: spark.createDataFrame([(i, v, {"k": i}) for i, v in r], "id string, vector array<float>, payload map<string,string>")
    assert vs.points(spark, path).count() == 0
    vs.upsert(rows(("a", [1.0, 2.0]), ("b", [3.0, 4.0])), path, 2, 1)
    vs.upsert(rows(("a", [5.0, 6.0])), path, 2, 2)
    vs.delete(spark.createDataFrame([("b",)], "id string"), path, 3)
    vs.upsert(rows(), path, 2, 4)
    assert [(r.id, r.vector) for r in vs.points(spark, path).collect()] == [("a", [5.0, 6.0])]
    with pytest.raises(ValueError):
        vs.upsert(rows(("c", [1.0])), path, 2, 5)
