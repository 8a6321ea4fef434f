"""Whole searches by strategy, and queries that trace them: the online stack is context over expanded over hybrid, or over lexical without vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import catalog, selection
from ..operators import retrieval as r
from ..operators.evaluation import first_ranks
from ..sources.ports import embedded, hashed_vectors
from ..sources.tables import checkpointed, line_chunks, load, texts, works
from ..streaming import chat
from .evaluation import gold
from .retrieval import CONTEXT, FUSED, HYBRID, TEXT_KEYS, asked, branches, dense_sql, lexical_sql, line_view, text_view, texts_of
from .rewrite import Lexicon, rewritten
from .shared import QUESTIONS, WORKS, folded_content, folded_lookup

STRATEGIES = ("lexical", "dense", "hybrid", "expanded_lexical", "expanded_hybrid")
#: The k best of queries (query_id, question, embedding) by one branch.
Branch = Callable[[DataFrame, int], DataFrame]
#: Hits of a variant that is a title in the query, and of one that asks for a work's end; variants of a query.
TITLE_HITS, TAIL_HITS, MOST_VARIANTS = 50, 200, 8


def search(chunks: DataFrame, queries: DataFrame, strategy: str, k: int, vectors: DataFrame | r.VectorIndex | None = None, variants: DataFrame | None = None, lexical_part: Branch | None = None, dense_part: Branch | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, score, match_types, strategy) of a batch of queries.

    queries: query_id, question and, for dense parts, embedding; vectors: vec_id (a chunk_id), embedding, or an index of them.
    variants (query_id, ord, question, weight, and embedding for dense parts) are needed by the expanded
    strategies. Without vectors the hybrid strategies fall back to the lexical branch. lexical_part and dense_part give the k
    best of queries where these were found before.
    """
    lexical_part = lexical_part or (lambda asking, most: r.lexical_search(chunks, r.query_keys(asking), most))
    dense_part = dense_part or (lambda asking, most: r.dense_hits(vectors, asking.select("query_id", "embedding"), most))
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy.startswith("expanded"):
        ids = with_ids(variants)
        inner = search(chunks, ids, strategy.removeprefix("expanded_"), r.candidate_limit(k), vectors, None, lexical_part, dense_part)
        results = inner.join(ids.select("query_id", "origin", "ord", "weight"), "query_id").select(F.col("origin").alias("query_id"), "ord", "rank", "chunk_id", "match_types", "weight")
        return r.expanded(results, k, variants).select("query_id", "rank", "chunk_id", "score", "match_types", F.lit(strategy).alias("strategy"))
    if strategy == "dense":
        return dense_part(queries, k).select("query_id", "rank", F.col("vec_id").alias("chunk_id"), "score", F.array(F.lit("dense")).alias("match_types"), F.lit(strategy).alias("strategy"))
    wide = k if strategy == "lexical" else r.candidate_limit(k)
    lexical = lexical_part(queries, wide).select("query_id", "rank", "chunk_id", "score", "match_types")
    if strategy == "lexical":
        return lexical.withColumn("strategy", F.lit(strategy))
    dense = None if vectors is None else dense_part(queries, wide).select("query_id", "rank", F.col("vec_id").alias("chunk_id"))
    return r.hybrid(lexical, dense, k, dense_failed=dense is None).select("query_id", "rank", "chunk_id", "score", "match_types", "strategy")


def with_ids(variants: DataFrame) -> DataFrame:
    """variants as queries of their own; origin is the query's id."""
    return variants.withColumns({"origin": F.col("query_id"), "query_id": F.xxhash64("query_id", "ord")})


def searches(chunks: DataFrame, queries: DataFrame, strategies: Sequence[str], k: int, vectors: DataFrame | r.VectorIndex | None = None, variants: DataFrame | None = None) -> DataFrame:
    """The results of search() by each of the strategies, one after another; texts and vectors are gone through once for all of them.

    Each different question is looked for once, and so is each vector, with the widest limit that a strategy has; what
    a narrower one gives is taken from the candidates.
    """
    columns = ["query_id", "question", *(["embedding"] if vectors is not None else [])]
    asking = [queries.select(*columns)] + ([with_ids(variants).select(*columns)] if any(s.startswith("expanded") for s in strategies) else [])
    both, wide = reduce(DataFrame.unionByName, asking), r.candidate_limit(r.candidate_limit(k))
    question = F.xxhash64("question").alias("asked")
    different = both.select("question").distinct().withColumn("query_id", F.xxhash64("question"))
    candidates = checkpointed(r.lexical_candidates(chunks, r.query_keys(different), wide))
    nearest = None if vectors is None else checkpointed(r.dense_hits(vectors, both.select("query_id", "embedding"), wide))

    def lexical_part(rows: DataFrame, most: int) -> DataFrame:
        return r.lexical_best(candidates, most).withColumnRenamed("query_id", "asked").join(rows.select("query_id", question), "asked").drop("asked")

    def dense_part(rows: DataFrame, most: int) -> DataFrame:
        return nearest.where(F.col("rank") <= most).join(rows.select("query_id"), "query_id", "left_semi")

    return reduce(DataFrame.unionByName, [search(chunks, queries, s, k, vectors, variants, lexical_part, dense_part) for s in strategies])


def resolved(rewrites: DataFrame, authors: DataFrame, dynasties: DataFrame) -> DataFrame:
    """rewrites with only_author and only_dynasty: the one author (dynasty) that a query names and that exists.

    A query that asks for several works is not bound to an author. What rewrites brings in caller_author and
    caller_dynasty, lookup keys or null, comes first. authors (author) and dynasties (dynasty) are the names
    there are; one that several rows share counts as none.
    """
    one = lambda names: F.when(F.size(names) == 1, F.element_at(names, 1))
    named = rewrites.withColumns({"author_name": F.when(~F.col("multi_evidence"), one("matched_authors")), "dynasty_name": one("matched_dynasties")})
    for kind, names in (("author", authors), ("dynasty", dynasties)):
        keys = names.select(F.col(kind).alias("name"), t.lookup_form(F.col(kind)).alias(f"{kind}_found")).where(f"{kind}_found <> ''")
        named = catalog.resolve_names(named, keys, f"{kind}_name", "name", f"{kind}_found")
        caller = [F.col(f"caller_{kind}")] if f"caller_{kind}" in rewrites.columns else []
        named = named.withColumn(f"only_{kind}", F.coalesce(*caller, F.col(f"{kind}_found")))
    return named


def weighted(rewrites: DataFrame, k: int, most: int = MOST_VARIANTS) -> DataFrame:
    """The variants to run of resolved rewrites: query_id, ord, question, weight, own_k and the filters.

    The most of the greatest weight stay. Then names go that a filter stands for, where a query has terms of
    its own and asks neither for a title nor for several works.
    """
    kept = r.weighted_variants(rewrites.select(*(c for c in rewrites.columns if c != "question"), F.inline("runs")), most)
    free = (F.size("content_terms") > 0) & (F.size("explicit_titles") == 0) & ~F.col("multi_evidence")
    stands = free & ((F.col("author_found").isNotNull() & F.col("author")) | (F.col("dynasty_found").isNotNull() & F.col("dynasty")))
    wide = r.candidate_limit(k)
    own = F.when(F.col("title"), F.when(F.col("prefer_tail"), max(wide, TAIL_HITS)).otherwise(max(wide, TITLE_HITS))).otherwise(wide)
    return kept.where(~stands).select("query_id", "ord", "question", "weight", own.alias("own_k"), "only_author", "only_dynasty")


def expanded_search(
    chunks: DataFrame, queries: DataFrame, lexicon: Lexicon, authors: DataFrame, dynasties: DataFrame, k: int, vectors: DataFrame | r.VectorIndex | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, floor: float | None = None, most: int = MOST_VARIANTS
) -> DataFrame:
    """Rewrite, filter, run all variants as one batch, fuse and select: (query_id, place, chunk_id, work_id, score, match_types, hard_filtered).

    chunks: as lexical_search takes them, with line_start; queries: query_id, question and, where a caller
    filters, caller_author and caller_dynasty. embed adds an embedding to rows with a question; with vectors
    (vec_id, a chunk_id; embedding, author_key, dynasty_key; or an index with these as payload) every variant runs lexically and densely, with
    hits above floor only. A query for facts that no corpus holds, or for a title that it lacks, gives one row
    with hard_filtered and no chunk; a blank query gives none. A query of one variant keeps that one's result.
    """
    asked = queries.where(F.trim(F.coalesce("question", F.lit(""))) != "")
    callers = [c for c in ("caller_author", "caller_dynasty") if c in queries.columns]
    made = rewritten(asked, lexicon)
    made = made.join(asked.select("query_id", *callers), "query_id") if callers else made
    rewrites = checkpointed(resolved(made, authors, dynasties))
    runs = checkpointed(weighted(rewrites.where(~F.col("unavailable")), k, most).withColumns({"origin": F.col("query_id"), "query_id": F.xxhash64("query_id", "ord")}))
    widest = max(r.candidate_limit(k), TAIL_HITS)
    limits = runs.select("query_id", "own_k")
    if vectors is None:
        found = r.lexical_search(chunks, r.query_keys(runs), widest)
    else:
        inner = checkpointed(r.query_keys(runs.withColumn("own_k", r.own_limit("own_k"))))
        lexical = r.lexical_search(chunks, inner, widest)
        asking = embed(runs).select("query_id", "embedding", F.col("only_author").alias("author_key"), F.col("only_dynasty").alias("dynasty_key"))
        dense = r.dense_hits(vectors, checkpointed(asking), widest, ["author_key", "dynasty_key"])
        dense = dense.where(F.col("score") >= floor) if floor is not None else dense
        dense = dense.join(inner.select("query_id", "own_k"), "query_id").where("rank <= own_k").withColumnRenamed("vec_id", "chunk_id")
        found = r.hybrid(lexical, dense, widest).join(limits, "query_id").where("rank <= own_k")
    results = checkpointed(found.join(runs.select("query_id", "origin", "ord", "weight"), "query_id").select(F.col("origin").alias("query_id"), "ord", "rank", "chunk_id", "score", "match_types", "weight"))
    each = runs.select(F.col("origin").alias("query_id"), "ord", "weight")
    alone = each.groupBy("query_id").agg(F.count("*").alias("n")).where("n = 1").select("query_id")
    single = results.where(F.col("rank") <= k).join(alone, "query_id", "left_semi").select("query_id", F.col("rank").alias("place"), "chunk_id", "score", "match_types")
    fused = r.expanded(results.join(alone, "query_id", "left_anti").drop("score"), 1 << 30, each)
    details = chunks.select("chunk_id", "work_id", "title", "granularity", "text", *(["line_start"] if "line_start" in chunks.columns else [F.lit(None).cast("int").alias("line_start")]))
    ranked = checkpointed(fused.join(details, "chunk_id"))
    several = rewrites.join(alone, "query_id", "left_anti").where(~F.col("unavailable"))
    titled = several.where("size(explicit_titles) > 0").select("query_id", F.col("explicit_titles").alias("titles"), "terms", F.col("multi_evidence").alias("diversify"), F.col("prefer_tail").alias("tail"), F.col("multi_evidence").alias("primary"))
    plural = several.where("size(explicit_titles) = 0 AND multi_evidence").select("query_id", F.array().cast("array<string>").alias("titles"), "terms", F.col("content_term_groups").alias("groups"), F.col("content_term_group_anchors").alias("anchors"))
    themed = several.where("size(explicit_titles) = 0 AND NOT multi_evidence").select("query_id", "terms", ((F.size("content_terms") > 0) & F.coalesce("only_author", "only_dynasty").isNotNull()).alias("primary"))
    theme = ranked.join(themed, "query_id").withColumns({"text": t.lookup_form(F.col("text")), "terms": F.when(F.col("primary"), t.lookup_forms("terms")).otherwise(F.array().cast("array<string>"))})
    picked = selection.explicit_titles(ranked, titled, k).unionByName(selection.multi_evidence(ranked, plural, k)).select("query_id", "place", "chunk_id", "hard_filtered")
    picked = picked.unionByName(r.theme_insert(theme, k).select("query_id", "place", "chunk_id", F.lit(False).alias("hard_filtered")))
    lost = titled.select("query_id").join(ranked.select("query_id"), "query_id", "left_anti").unionByName(rewrites.where("unavailable").select("query_id"))
    ends = picked.join(ranked.select("query_id", "chunk_id", "work_id", "score", "match_types"), ["query_id", "chunk_id"], "left")
    ends = ends.unionByName(single.join(details.select("chunk_id", "work_id"), "chunk_id").withColumn("hard_filtered", F.lit(False)))
    return ends.unionByName(lost.withColumn("hard_filtered", F.lit(True)), allowMissingColumns=True).select("query_id", "place", "chunk_id", "work_id", "score", "match_types", "hard_filtered")


def with_context(results: DataFrame, chunks: DataFrame, max_chunks: int = 40, max_chars: int = 4800) -> DataFrame:
    """results (query_id, rank, chunk_id, work_id, score, match_types) and, ranked after them, their works' missing chunks."""
    added = r.context_rows(results, chunks, max_chunks, max_chars)
    last = results.groupBy("query_id").agg(F.max("rank").alias("last"))
    works_of = chunks.select("chunk_id", "work_id")
    extra = added.join(last, "query_id").join(works_of, "chunk_id").select("query_id", (F.col("last") + F.col("place")).alias("rank"), "chunk_id", "work_id", "score", F.array(F.lit("parent_context")).alias("match_types"))
    return results.select(*extra.columns).unionByName(extra)


def gold_rank_by_branch(spark, d):
    """The first rank of each item's whole text in the lexical and in the dense branch."""
    lexical, dense = branches(spark, d)
    both = lexical.select("query_id", F.lit("lexical").alias("branch"), "rank", "chunk_id").unionByName(dense.select("query_id", F.lit("dense").alias("branch"), "rank", "chunk_id"))
    bodies = texts_of(texts(spark, d)).select(F.col("chunk_id").alias("c"), "content_key")
    evidence = both.join(bodies, F.col("chunk_id") == F.col("c")).select(F.col("query_id").alias("case_id"), "branch", "rank", "content_key")
    wanted = gold(spark, d).where("gold_id = 1").crossJoin(F.broadcast(spark.createDataFrame([("lexical",), ("dense",)], "want string")))
    found = first_ranks(wanted.withColumn("gold_id", F.col("want")), evidence, (F.col("branch") == F.col("want")) & F.contains("content_key", F.col("contains")))
    return found.select("case_id", F.col("gold_id").alias("branch"), "first_rank")


def strategy_counts(spark, d):
    """Hits of every strategy on the benchmark, with vectors by item number."""
    vectors = load(spark, d, "embeddings").select((F.col("vec_id") * 1_000_000).alias("vec_id"), "embedding")
    queries = asked(spark, d).join(load(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").select("query_id", "question", "embedding")
    variants = queries.select("query_id", F.lit(0).alias("ord"), "question", F.lit(3.0).alias("weight"), "embedding")
    found = searches(text_view(texts(spark, d)), queries, STRATEGIES, 4, vectors, variants)
    return found.groupBy("strategy").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))


def online_context(spark, d):
    """Lexical lines with the missing lines of their works."""
    lines = line_view(texts(spark, d))
    found = checkpointed(r.lexical_search(lines, asked(spark, d), 5).select("query_id", "rank", "chunk_id", "work_id", "score", "match_types"))
    hit = works(spark, d).join(found.select(F.col("work_id").alias("id")).distinct(), "id", "left_semi")
    rows = with_context(found, line_chunks(hit).select(F.col("id").alias("work_id"), "chunk_id", "chunk_index", "text"))
    return rows.select("query_id", "rank", "chunk_id", "score", F.concat_ws(",", "match_types").alias("match_types"))


#: Names and words that the registered questions are rewritten with.
LEXICON = Lexicon(concepts=(("ending", ("eronth",), ("theth", "ention")),), authors=("src3", "src5"), dynasties=("en", "de"), intents=("find",))


def composed_questions(spark, d):
    """Benchmark items as questions of four kinds: for a fact no corpus holds, as they are, with a quoted word, and for a word of one author."""
    n, word = F.col("query_id") % 4, F.regexp_extract(F.lower("question"), "[a-z]{4,}", 0)
    made = F.when(n == 0, F.concat("question", F.lit(" 出生地"))).when(n == 1, F.col("question")).when(n == 2, F.concat(F.lit("q “"), word, F.lit("”"))).otherwise(F.concat(F.lit("src5 "), word))
    return asked(spark, d).withColumn("question", made).select("query_id", "question")


def composed(spark, d, **dense):
    rows = texts(spark, d)
    return expanded_search(text_view(rows), composed_questions(spark, d), LEXICON, rows.select("author").distinct(), rows.select("dynasty").distinct(), 5, **dense)


def expanded_search_lexical(spark, d):
    """The whole expanded search: rewriting, filters, weights, fusion and selection."""
    return composed(spark, d).select("query_id", "place", "chunk_id", "score", F.concat_ws(",", "match_types").alias("match_types"), "hard_filtered")


def online_stack(spark, d):
    """The stack behind an answer: context over expanded over hybrid search, with vectors of works by number and a stand-in model."""
    keys = texts_of(texts(spark, d)).select("chunk_id", "author_key", "dynasty_key")
    vectors = load(spark, d, "embeddings").select((F.col("vec_id") * 1_000_000).alias("vec_id"), "embedding").join(keys, F.col("vec_id") == F.col("chunk_id")).drop("chunk_id")
    width = vectors.select(F.max(F.size("embedding"))).first()[0]
    found = composed(spark, d, vectors=vectors, embed=lambda rows: embedded(rows, "question", lambda texts: hashed_vectors(texts, width)), floor=0.0)
    found = found.where("chunk_id IS NOT NULL").withColumnRenamed("place", "rank")
    found = checkpointed(found)
    hit = works(spark, d).join(found.select(F.col("work_id").alias("id")).distinct(), "id", "left_semi")
    rows = with_context(found, line_chunks(hit).select(F.col("id").alias("work_id"), "chunk_id", "chunk_index", "text"))
    return rows.select("query_id", "rank", "chunk_id", "score", F.concat_ws(",", "match_types").alias("match_types"))


def stream_metrics(spark, d):
    """One row of figures for each stream, with the eighteen fields of a request's log."""
    n = F.col("event_id")
    steps = F.element_at(F.array(*map(F.lit, ("rewrite", "retrieval", "assess", "generation", "validate"))), (n % 5 + 1).cast("int"))
    rows = load(spark, d, "events").select(F.col("user_id").alias("request_id"), n.alias("seq"), "ts", "event_type", steps.alias("step"), (n % 40).alias("duration_ms"), (n % 200).alias("candidates"), (n % 6).alias("selected"))
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").when(F.col("event_type").isin("click", "view"), "delta").otherwise("timing")
    return chat.request_metrics(rows.withColumn("kind", kind), "expanded_hybrid", MOST_VARIANTS)


def message_order(spark, d):
    """Messages of conversations in order with the role before each."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("after"), "role")


QUERIES = {f.__name__: f for f in (gold_rank_by_branch, strategy_counts, online_context, expanded_search_lexical, online_stack, stream_metrics, message_order)}

COMPOSED = f"""WITH {WORKS}, {QUESTIONS}, {TEXT_KEYS}, words AS (SELECT query_id, question, regexp_extract(lower(question), '[a-z]{{4,}}') AS word FROM questions),
  variants AS (SELECT query_id, 0 AS ord, CASE query_id % 4 WHEN 1 THEN question WHEN 2 THEN 'q “' || word || '”' ELSE 'src5 ' || word END AS question, 3.0::DOUBLE AS weight FROM words WHERE query_id % 4 > 0
    UNION ALL SELECT query_id, 1, CASE query_id % 4 WHEN 2 THEN word ELSE 'src5' END, CASE query_id % 4 WHEN 2 THEN 3.0 ELSE 2.0 END FROM words WHERE query_id % 4 > 1 AND word <> ''),
  several AS (SELECT query_id FROM variants WHERE ord = 1),
  vkeys AS (SELECT query_id * 10 + ord AS query_id, {folded_content('question')} AS qc, {folded_lookup('question')} AS ql FROM variants),
  {lexical_sql('tc', 25, 'vkeys', only="(query_id // 10 % 4 <> 3 OR ak = 'src5')")}, {FUSED}
  SELECT query_id, rank AS place, chunk_id, score, match_types, false AS hard_filtered FROM final WHERE rank <= 5 AND query_id IN (SELECT query_id FROM several)
  UNION ALL SELECT query_id // 10, rank, chunk_id, score, match_types, false FROM lex WHERE rank <= 5 AND query_id // 10 NOT IN (SELECT query_id FROM several)
  UNION ALL SELECT query_id, NULL, NULL, NULL, '', true FROM words WHERE query_id % 4 = 0""".replace("SEP", "','")

WITH_VECTORS = "(SELECT query_id, qc, ql FROM keys WHERE query_id IN (SELECT vec_id FROM embeddings))"
DENSE_QUERIES = "(SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id)"

ORACLES = {
    "online_context": f"""{CONTEXT}, last AS (SELECT query_id, max(rank) AS last FROM lex GROUP BY 1) SELECT query_id, rank, chunk_id, score, match_types FROM lex
      UNION ALL SELECT c.query_id, last + place, chunk_id, score, 'parent_context' FROM context c JOIN last l ON l.query_id = c.query_id""",
    "expanded_search_lexical": COMPOSED,
    "strategy_counts": f"""WITH {WORKS}, {QUESTIONS}, keys AS (SELECT query_id, {folded_content('question')} AS qc, {folded_lookup('question')} AS ql FROM questions), {TEXT_KEYS}, {lexical_sql('tc', 4, WITH_VECTORS, 'a')}, {lexical_sql('tc', 20, WITH_VECTORS, 'b')}, {lexical_sql('tc', 100, WITH_VECTORS, 'c')},
      d AS ({dense_sql(100, queries=DENSE_QUERIES)}), hits AS (SELECT 'lexical' AS strategy, query_id, chunk_id FROM lexa UNION ALL SELECT 'expanded_lexical', query_id, chunk_id FROM lexb UNION ALL SELECT 'dense', query_id, vec_id FROM d WHERE rank <= 4
        UNION SELECT 'hybrid', query_id, chunk_id FROM lexb UNION SELECT 'hybrid', query_id, vec_id * 1000000 FROM d WHERE rank <= 20 UNION SELECT 'expanded_hybrid', query_id, chunk_id FROM lexc UNION SELECT 'expanded_hybrid', query_id, vec_id * 1000000 FROM d),
      per AS (SELECT strategy, query_id, least(4, count(DISTINCT chunk_id)) AS n FROM hits GROUP BY 1, 2) SELECT strategy, CAST(sum(n) AS BIGINT) AS n, count(*) AS queries FROM per GROUP BY 1""",
    "gold_rank_by_branch": f"""{HYBRID}, items AS (SELECT item_id AS case_id, {folded_content('text')} AS k FROM benchmark),
      hits AS (SELECT query_id, 'lexical' AS branch, rank, chunk_id FROM lex UNION ALL SELECT query_id, 'dense', rank, vec_id * 1000000 FROM dense), ev AS (SELECT h.*, t.ck FROM hits h JOIN tc t USING (chunk_id))
      SELECT i.case_id, b.branch, min(e.rank) AS first_rank FROM items i CROSS JOIN (VALUES ('lexical'), ('dense')) b(branch) LEFT JOIN ev e ON e.query_id = i.case_id AND e.branch = b.branch AND contains(e.ck, i.k) GROUP BY 1, 2""",
    "stream_metrics": """WITH e AS (SELECT user_id AS request_id, event_id AS seq, ts, ['rewrite', 'retrieval', 'assess', 'generation', 'validate'][CAST(event_id % 5 + 1 AS INT)] AS step, event_id % 40 AS ms, event_id % 200 AS candidates, event_id % 6 AS selected,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'delta' WHEN 'view' THEN 'delta' ELSE 'timing' END AS kind FROM events),
      m AS (SELECT request_id, min(seq) FILTER (kind IN ('done', 'error', 'cancelled')) AS end_seq, min(ts) AS t0 FROM e GROUP BY 1),
      u AS (SELECT e.*, m.t0, m.end_seq FROM e JOIN m USING (request_id) WHERE end_seq IS NULL OR seq <= end_seq)
      SELECT request_id, request_id AS conversation_id, CAST(coalesce(any_value(end_seq), max(seq)) AS BIGINT) AS assistant_message_id,
        CASE arg_max(kind, seq) WHEN 'done' THEN 'completed' WHEN 'cancelled' THEN 'cancelled' ELSE 'failed' END AS status, CASE WHEN any_value(end_seq) IS NULL THEN 'stream_interrupted' WHEN arg_max(kind, seq) = 'error' THEN 'generation_error' END AS error_code,
        CASE arg_max(kind, seq) WHEN 'done' THEN 'stop' WHEN 'cancelled' THEN 'cancelled' ELSE 'error' END AS finish_reason, max(candidates) AS candidate_count, max(selected) AS selected_count, 'expanded_hybrid' AS strategy,
        CASE WHEN max(selected) = 0 THEN 'skipped' ELSE 'passed' END AS assessment_status, CASE WHEN max(selected) = 0 THEN 'no_evidence' ELSE 'supported' END AS assessment_reason_code, 8 AS query_variant_limit,
        CAST(sum(ms) FILTER (step = 'rewrite') AS BIGINT) AS rewrite_ms, CAST(sum(ms) FILTER (step = 'retrieval') AS BIGINT) AS retrieval_ms, CAST(sum(ms) FILTER (step = 'assess') AS BIGINT) AS assess_ms, CAST(sum(ms) FILTER (step = 'generation') AS BIGINT) AS generation_ms, CAST(sum(ms) FILTER (step = 'validate') AS BIGINT) AS validate_ms,
        (epoch_us(min(ts) FILTER (kind = 'delta')) - epoch_us(any_value(t0))) // 1000 AS ttft_ms, (epoch_us(max(ts)) - epoch_us(any_value(t0))) // 1000 AS total_ms FROM u GROUP BY 1""",
    "message_order": "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after, role FROM conversations",
}
