"""Retrieval queries: benchmark sentences against lines and texts, vectors against vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import retrieval as r
from ..operators import candidates, postings, selection, vector_index
from ..sources.tables import checkpointed, fresh_folder, line_chunks, load, questions, ranked, statuses, texts, top, works
from .shared import LINES, QUESTIONS, WORKS, folded_content, folded_lookup


def keyed(rows):
    return rows.select("chunk_id", F.col("id").alias("work_id"), "granularity", "text", "title", t.content_form(F.col("text")).alias("content_key"), *(t.lookup_form(F.col(c)).alias(f"{c}_key") for c in ("title", "author", "dynasty")))


def lines_of(rows):
    return keyed(line_chunks(rows).withColumn("granularity", F.lit("line")))


def texts_of(rows):
    return keyed(rows.select((F.col("id") * 1_000_000).alias("chunk_id"), "id", "title", "author", "dynasty", F.col("content").alias("text"), F.lit("poem").alias("granularity")))


def line_view(rows):
    """Lines of works as chunks; their keys are made by the search."""
    return line_chunks(rows).select("chunk_id", F.col("id").alias("work_id"), F.lit("line").alias("granularity"), "text", "title", "author", "dynasty")


def text_view(rows):
    """Whole texts of works as chunks; their keys are made by the search."""
    return rows.select((F.col("id") * 1_000_000).alias("chunk_id"), F.col("id").alias("work_id"), F.lit("poem").alias("granularity"), F.col("content").alias("text"), "title", "author", "dynasty")


def asked(spark, d):
    return r.query_keys(questions(spark, d))


def lexical_top5_lines(spark, d):
    """Each benchmark item's first sentence, and the five best lines of all works."""
    found = r.lexical_search(line_view(texts(spark, d)), asked(spark, d), 5)
    return found.select("query_id", "rank", "chunk_id", "work_id", "score", F.concat_ws(",", "match_types").alias("match_types"), "candidate_count")


def lexical_indexed(spark, d):
    """The same by an index of the lines' content, which is written first and would serve many batches."""
    rows = lines_of(texts(spark, d))
    index = postings.build_postings(rows, fresh_folder(spark, "postings"))
    found = r.lexical_search(rows, asked(spark, d), 5, index=index)
    return found.select("query_id", "rank", "chunk_id", "work_id", "score", F.concat_ws(",", "match_types").alias("match_types"), "candidate_count")


def lexical_scored(spark, d):
    """Lines and whole texts of the visible works."""
    rows = texts(spark, d)
    seen = statuses(spark, d).where((F.col("status") == "published") & ~F.col("deleted")).select(F.col("id").alias("work_id"))
    found = r.lexical_search(line_view(rows).unionByName(text_view(rows)), asked(spark, d), 8, among=seen)
    return found.select("query_id", "rank", "chunk_id", "granularity", "score", F.concat_ws(",", "match_types").alias("match_types"))


def lexical_by_name(spark, d):
    """Queries that name a source, a language or a part of one: priorities keep exact names before others."""
    queries = spark.createDataFrame([(1, "src1"), (2, "SRC12 "), (3, "en"), (4, "e"), (5, "%"), (6, "_")], "query_id long, question string")
    found = r.lexical_search(text_view(texts(spark, d)), r.query_keys(queries), 7)
    return found.select("query_id", "rank", "chunk_id", "score", F.concat_ws(",", "match_types").alias("match_types"), "candidate_count")


def stored_chunks(spark, d):
    """Lines as stored chunks with all their columns: of two strategies, every third with an annotation, some without a vector."""
    rows, n = line_chunks(texts(spark, d)), F.col("chunk_index")
    made = rows.select("*", F.col("id").alias("work_id"), (F.col("id") * 10 + 1).alias("version_id"), F.when(n % 3 == 0, F.col("id") % 50).alias("annotation_id"), F.when(n % 4 > 0, F.sha1(F.col("chunk_id").cast("string"))).alias("vector_id"))
    return made.withColumns({"granularity": F.lit("line"), "normalized_text": t.content_form(F.col("text")), "line_start": F.col("line_no"), "line_end": F.col("line_no"), "chunk_strategy": F.concat(F.lit("v"), (n % 2 + 1).cast("string")), "chunk_status": F.lit("ready")})


def candidates_detailed(spark, d):
    """The best lines of one chunking strategy with all twenty columns; authors, dynasties and annotations are looked up for the hits."""
    rows = stored_chunks(spark, d)
    keys = rows.select("chunk_id", "work_id", "granularity", "chunk_strategy", F.col("normalized_text").alias("content_key"), *(t.lookup_form(F.col(c)).alias(f"{c}_key") for c in ("title", "author", "dynasty")))
    hits = r.lexical_search(keys, asked(spark, d), 3, strategies=["v1"]).select("query_id", "rank", "score", "chunk_id")
    number = F.regexp_extract("author", r"\d+", 0).cast("long")
    works_of = texts(spark, d).select(F.col("id").alias("work_id"), "title", number.alias("author_id"), F.ascii(F.substring("dynasty", 2, 1)).cast("long").alias("dynasty_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 365).cast("int")).alias("published_at"))
    names = load(spark, d, "documents").select(F.col("source").alias("author"), F.col("lang").alias("dynasty"))
    authors = names.select(number.alias("author_id"), F.col("author").alias("author_name")).distinct().where("author_id % 4 > 0")
    dynasties = names.select(F.ascii(F.substring("dynasty", 2, 1)).cast("long").alias("dynasty_id"), F.col("dynasty").alias("dynasty_name")).distinct()
    notes = load(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("annotation_id"), F.col("role").alias("annotation_type"))
    versions = texts(spark, d).where("id % 11 > 0").select((F.col("id") * 10 + 1).alias("version_id"))
    return candidates.detailed(hits, rows.select("chunk_id", "vector_id", "work_id", "version_id", "annotation_id", "granularity", "chunk_index", "text", "normalized_text", "line_start", "line_end", "chunk_strategy", "chunk_status"), works_of, versions, authors, dynasties, notes)


def query_vectors(spark, d):
    return load(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def dense_topk_cosine(spark, d):
    return r.dense_search(load(spark, d, "embeddings"), query_vectors(spark, d), 10).withColumn("score", t.clamped(F.col("score")))


def dense_topk_filtered(spark, d):
    return r.dense_search(load(spark, d, "embeddings"), query_vectors(spark, d), 5, facets=["label"])


def vector_distance_dot(spark, d):
    return r.dense_search(load(spark, d, "embeddings"), query_vectors(spark, d), 5, "dot")


def vector_distance_euclid(spark, d):
    return r.dense_search(load(spark, d, "embeddings"), query_vectors(spark, d), 5, "euclid")


def indexed(spark, d):
    """An index of all vectors with their labels, in a folder of its own."""
    return vector_index.build_index(load(spark, d, "embeddings"), fresh_folder(spark, "vectors"), ("label",))


def dense_index_topk(spark, d):
    """The nearest vectors by an index of inverted lists, searched until no other list can hold a better one."""
    return indexed(spark, d).search(query_vectors(spark, d), 10, probes=4, exact=True)


def dense_index_filtered(spark, d):
    """The same with the label as a facet, checked before the cut."""
    return indexed(spark, d).search(query_vectors(spark, d), 5, probes=4, exact=True, facets=["label"])


def granular(hits):
    return hits.withColumn("granularity", F.element_at(F.array(F.lit("poem"), F.lit("line"), F.lit("note")), (F.col("vec_id") % 3 + 1).cast("int")))


def dense_floor_by_granularity(spark, d):
    hits = granular(r.dense_search(load(spark, d, "embeddings"), query_vectors(spark, d), 50))
    return r.above_floor(hits, 0.3).select("query_id", "vec_id", "granularity", "score")


def dense_stale_dropped(spark, d):
    """Hits whose work is not visible go; ranks close up."""
    rows = works(spark, d).where((F.col("status") == "published") & ~F.col("deleted")).select(F.col("id").alias("vec_id"))
    hits = r.dense_search(load(spark, d, "embeddings"), query_vectors(spark, d), 25).drop("rank").join(rows, "vec_id", "left_semi")
    return top(hits, 5, F.desc("score"), F.asc("vec_id"))


def branches(spark, d):
    """Lexical and dense branches of the benchmark: an item's vector is that of its number; dense hits are whole texts."""
    vectors = load(spark, d, "embeddings")
    lexical = r.lexical_search(text_view(texts(spark, d)), asked(spark, d), 25).select("query_id", "rank", "chunk_id", "score", "match_types")
    queries = questions(spark, d).join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    dense = r.dense_search(vectors, queries, 25).select("query_id", "rank", (F.col("vec_id") * 1_000_000).alias("chunk_id"))
    return lexical, dense


def hybrid_rrf(spark, d):
    found = r.hybrid(*branches(spark, d), 10)
    return found.select("query_id", "rank", "chunk_id", "score", F.concat_ws(",", "match_types").alias("match_types"))


def hybrid_guarded(spark, d):
    """Hard-filtered queries give nothing; without the dense branch the lexical result is cut to k."""
    lexical, dense = branches(spark, d)
    blocked = questions(spark, d).where(F.length("question") < 40)
    both = r.hybrid(lexical, dense, 3, blocked).unionByName(r.hybrid(lexical, dense, 3, blocked, dense_failed=True))
    return both.select("query_id", "strategy", "rank", "chunk_id")


def variants(spark, d):
    """The question and its first three different longer words, weighted; the two best of each are kept."""
    words = F.slice(F.array_distinct(F.filter(F.split(F.lower("question"), "[^a-zà-ÿ]+"), lambda w: F.length(w) >= 5)), 1, 3)
    none = F.array().cast("array<string>")
    q = questions(spark, d).withColumn("terms", words)
    rows = q.select("query_id", F.col("question").alias("q"), "terms", F.posexplode(F.concat(F.array("question"), "terms")).alias("ord", "question"))
    rows = rows.withColumn("weight", r.variant_weight(F.col("question"), F.col("q"), none, none, none, none, F.col("terms")))
    return r.weighted_variants(rows, 3).select("query_id", "ord", "question", "weight")


def variant_results(spark, d):
    """All variants run as one batch, under ids made of the query's and the variant's."""
    rows = variants(spark, d).withColumns({"origin": F.col("query_id"), "query_id": F.col("query_id") * 10 + F.col("ord")})
    found = r.lexical_search(text_view(texts(spark, d)), r.query_keys(rows.select("query_id", "question")), 10, fetch=("title", "text"))
    return found.join(rows.select("query_id", "origin", "ord", "weight"), "query_id").select(F.col("origin").alias("query_id"), "ord", "rank", "chunk_id", "work_id", "title", "granularity", "text", "match_types", "weight")


def expanded_weighted_rrf(spark, d):
    found = r.expanded(variant_results(spark, d), 10, variants(spark, d))
    return found.select("query_id", "rank", "chunk_id", "score", F.concat_ws(",", "match_types").alias("match_types"))


def match_types_union(spark, d):
    """First-seen match types of every chunk over all variants, then the fixed marks; the batch runs once."""
    results = checkpointed(variant_results(spark, d).select("query_id", "ord", "rank", "chunk_id", "match_types", "weight"))
    return r.expanded(results, 1 << 20).select("query_id", "chunk_id", F.array_join("match_types", ">").alias("match_types"))


def content_overlap_rank(spark, d):
    """Works by how much of a question's longer words their text and title hold, its first such word being the anchor."""
    terms = F.array_distinct(F.filter(F.split(F.lower("question"), "[^a-z]+"), lambda w: F.length(w) >= 6))
    queries = questions(spark, d).select("query_id", terms.alias("terms"), F.slice(terms, 1, 1).alias("anchors"))
    rows = texts(spark, d).select(F.col("id").alias("work_id"), F.lower("content").alias("body"), F.lower("title").alias("head"))
    return r.overlap_ranked(rows, queries, 5).select("query_id", "rank", "work_id", "score")


def lines_ranked(spark, d):
    """Lines of every source by length: sources are the queries, works the parents."""
    rows = line_chunks(works(spark, d)).select(F.regexp_extract("author", r"\d+", 0).cast("long").alias("query_id"), F.col("id").alias("work_id"), "chunk_id", "text", F.length("text").alias("size"))
    return rows.transform(ranked(F.desc("size"), F.asc("chunk_id")))


def diversified_top_k(spark, d):
    return r.diversified(lines_ranked(spark, d), 10).select("query_id", "place", "work_id", "chunk_id")


def theme_primary_insert(spark, d):
    rows = lines_ranked(spark, d).where("rank <= 200").select("query_id", "rank", F.col("chunk_id").alias("c"), (F.col("work_id") % 7).alias("work_id"), "chunk_id", F.lower("text").alias("text"))
    rows = rows.withColumns({"granularity": F.element_at(F.array(F.lit("note"), F.lit("line"), F.lit("poem")), (F.col("rank") % 3 + 1).cast("int")), "terms": F.array(F.lit("the"), F.lit("die"), F.lit("que")), "rrf": 1.0 / (F.col("rank") + 60), "best_rank": F.col("rank")})
    return r.theme_insert(rows, 6)


def selected_rows(spark, d):
    """The fused results of the variants with their chunks' columns; the batch runs once."""
    results = checkpointed(variant_results(spark, d))
    details = results.select("query_id", "chunk_id", "work_id", "title", "granularity", "text").dropDuplicates(["query_id", "chunk_id"])
    return r.expanded(results, 200).join(details, ["query_id", "chunk_id"]).withColumn("line_start", F.lit(None).cast("int"))


def title_selector(spark, d):
    rows = selected_rows(spark, d)
    wanted = rows.where("rank = 1").select("query_id", F.array("title").alias("titles"), F.array(F.lit("the")).alias("terms"))
    return selection.explicit_titles(rows, wanted, 5)


def multi_evidence_selector(spark, d):
    groups = variants(spark, d).where("ord > 0").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "question"))), lambda x: F.array(x["question"])).alias("groups"))
    wanted = groups.select("query_id", F.array().cast("array<string>").alias("titles"), F.flatten("groups").alias("terms"), "groups", F.transform("groups", lambda g: F.array().cast("array<string>")).alias("anchors"))
    return selection.multi_evidence(selected_rows(spark, d), wanted, 5)


def parent_context(spark, d):
    """Lines of the works that hits name; only these works are cut into lines again."""
    found = checkpointed(r.lexical_search(line_view(texts(spark, d)), asked(spark, d), 5).select("query_id", "rank", "chunk_id", "work_id", "score"))
    hit = works(spark, d).join(found.select(F.col("work_id").alias("id")).distinct(), "id", "left_semi")
    return r.context_rows(found, line_chunks(hit).select(F.col("id").alias("work_id"), "chunk_id", "chunk_index", "text"))


def lexical_filtered(spark, d):
    """Questions that ask for one author, for one language, for both or for none."""
    n = F.col("query_id")
    queries = asked(spark, d).withColumns({"only_author": F.when(n % 2 == 0, F.concat(F.lit("src"), (n % 7).cast("string"))), "only_dynasty": F.when(n % 3 == 0, "en")})
    found = r.lexical_search(text_view(texts(spark, d)), queries, 5)
    return found.select("query_id", "rank", "chunk_id", "score", "candidate_count")


def context_prefix_budget(spark, d):
    rows = r.prefix_budget(lines_ranked(spark, d))
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters"))


def evidence_clip_budget(spark, d):
    rows = r.clipped_budget(lines_ranked(spark, d))
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters"), F.max_by("text", "rank").alias("last"))


QUERIES = {f.__name__: f for f in (lexical_top5_lines, lexical_indexed, lexical_scored, lexical_by_name, lexical_filtered, candidates_detailed, dense_topk_cosine, dense_topk_filtered, dense_index_topk, dense_index_filtered, vector_distance_dot, vector_distance_euclid, dense_floor_by_granularity, dense_stale_dropped, hybrid_rrf, hybrid_guarded, expanded_weighted_rrf, match_types_union, content_overlap_rank, diversified_top_k, theme_primary_insert, title_selector, multi_evidence_selector, parent_context, context_prefix_budget, evidence_clip_budget)}


def lexical_sql(chunks: str, k: int, queries: str = "keys", name: str = "", only: str = "true") -> str:
    """CTEs cut{name} and lex{name} of a lexical search over chunks (chunk_id, granularity, ck, tk, ak, dk)."""
    n = name
    return f"""pairs{n} AS (SELECT c.*, q.query_id, q.qc, q.ql,
        CASE WHEN qc <> '' AND ck = qc THEN 0 WHEN ql <> '' AND tk = ql THEN 1 WHEN ql <> '' AND ak = ql THEN 2 WHEN ql <> '' AND dk = ql THEN 3
             WHEN ql <> '' AND contains(tk, ql) THEN 4 WHEN ql <> '' AND contains(ak, ql) THEN 5 WHEN ql <> '' AND contains(dk, ql) THEN 6 ELSE 7 END AS priority
        FROM {chunks} c JOIN {queries} q ON ((qc <> '' AND contains(ck, qc)) OR (ql <> '' AND (contains(tk, ql) OR contains(ak, ql) OR contains(dk, ql)))) AND {only}),
      cut{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, chunk_id) AS cut FROM pairs{n}) x WHERE cut <= {min(max(5 * k, k), 200)}),
      scored{n} AS (SELECT *, round(least(1.0::DOUBLE, greatest(
          CASE WHEN qc <> '' AND ck = qc THEN 1.0::DOUBLE WHEN qc <> '' AND contains(ck, qc) THEN 0.7::DOUBLE + 0.25::DOUBLE * length(qc) / greatest(length(ck), 1) ELSE 0.0::DOUBLE END,
          CASE WHEN ql <> '' AND tk = ql THEN 1.0::DOUBLE WHEN ql <> '' AND contains(tk, ql) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END,
          CASE WHEN ql <> '' AND ak = ql THEN 0.95::DOUBLE WHEN ql <> '' AND contains(ak, ql) THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END,
          CASE WHEN ql <> '' AND dk = ql THEN 0.9::DOUBLE WHEN ql <> '' AND contains(dk, ql) THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS score,
        concat_ws(',', CASE WHEN qc <> '' AND ck = qc THEN 'chunk_exact' WHEN qc <> '' AND contains(ck, qc) THEN 'chunk_phrase' END, CASE WHEN ql <> '' AND contains(tk, ql) THEN 'title_phrase' END,
          CASE WHEN ql <> '' AND contains(ak, ql) THEN 'author_phrase' END, CASE WHEN ql <> '' AND contains(dk, ql) THEN 'dynasty_phrase' END) AS match_types FROM cut{n}),
      lex{n} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS candidate_count,
          row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE granularity WHEN 'line' THEN 0 WHEN 'poem' THEN 1 ELSE 2 END, chunk_id) AS rank FROM scored{n} WHERE score > 0) x WHERE rank <= {k})"""


KEYS = f"keys AS (SELECT query_id, {folded_content('question')} AS qc, {folded_lookup('question')} AS ql FROM questions)"
LINE_KEYS = f"lc AS (SELECT chunk_id, work_id, status, deleted, 'line' AS granularity, {folded_content('text')} AS ck, {folded_lookup('title')} AS tk, {folded_lookup('author')} AS ak, {folded_lookup('dynasty')} AS dk FROM lines)"
TEXT_KEYS = f"tc AS (SELECT id * 1000000 AS chunk_id, id AS work_id, status, deleted, 'poem' AS granularity, {folded_content('content')} AS ck, {folded_lookup('title')} AS tk, {folded_lookup('author')} AS ak, {folded_lookup('dynasty')} AS dk FROM works)"
COSINE = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"


def dense_sql(k: int, score: str = COSINE, order: str = "DESC", on: str = "true", queries: str = "(SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 100 = 0)") -> str:
    return f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank FROM (SELECT q.query_id, v.vec_id, {score} AS score FROM {queries} q JOIN embeddings v ON {on}) x) y WHERE rank <= {k}"


HYBRID = f"""WITH {WORKS}, {QUESTIONS}, {KEYS}, {TEXT_KEYS}, {lexical_sql('tc', 25)},
  dense AS ({dense_sql(25, queries="(SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id)")}),
  sides AS (SELECT query_id, chunk_id, rank AS l, NULL AS d, match_types FROM lex UNION ALL SELECT query_id, vec_id * 1000000, NULL, rank, NULL FROM dense),
  fused AS (SELECT query_id, chunk_id, max(l) AS l, max(d) AS d, max(match_types) AS mt FROM sides GROUP BY 1, 2),
  summed AS (SELECT *, CASE WHEN l IS NULL THEN 1.0::DOUBLE / (60 + d) WHEN d IS NULL THEN 1.0::DOUBLE / (60 + l) ELSE 1.0::DOUBLE / (60 + l) + 1.0::DOUBLE / (60 + d) END AS rrf, least(coalesce(l, 999), coalesce(d, 999)) AS best FROM fused),
  hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, best, chunk_id) AS rank FROM summed)"""

VARIANTS = f"""words AS (SELECT query_id, question, list_filter(regexp_split_to_array(lower(question), '[^a-zà-ÿ]+'), lambda w: length(w) >= 5) AS w FROM questions),
  firsts AS (SELECT query_id, word, min(i) AS i FROM (SELECT query_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM words) x GROUP BY 1, 2),
  terms AS (SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY i) AS ord FROM firsts),
  allv AS (SELECT query_id, 0 AS ord, question, 3.0::DOUBLE AS weight FROM questions UNION ALL SELECT t.query_id, t.ord, t.word, CASE WHEN t.word = {folded_lookup('q.question')} THEN 3.0 ELSE 1.5 END FROM terms t JOIN questions q USING (query_id) WHERE ord <= 3),
  variants AS (SELECT query_id, ord, question, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, ord) AS kept FROM allv) x WHERE kept <= 3),
  vkeys AS (SELECT query_id * 10 + ord AS query_id, {folded_content('question')} AS qc, {folded_lookup('question')} AS ql FROM variants)"""

FUSED = f"""res AS (SELECT v.query_id, v.ord, v.weight, l.rank, l.chunk_id, l.match_types FROM lex l JOIN variants v ON v.query_id * 10 + v.ord = l.query_id),
  used AS (SELECT query_id, sum(weight) AS total FROM variants GROUP BY 1),
  types AS (SELECT query_id, chunk_id, string_agg(m, SEP ORDER BY o, i) AS mt FROM (SELECT query_id, chunk_id, m, min(ord) AS o, min(ord * 10 + i) AS i FROM (SELECT query_id, chunk_id, ord, unnest(string_split(match_types, ',')) AS m, unnest(range(5)) AS i FROM res) x WHERE m IS NOT NULL GROUP BY 1, 2, 3) y GROUP BY 1, 2),
  packed AS (SELECT query_id, chunk_id, list_reduce(list(weight / (60 + rank) ORDER BY ord), lambda a, b: a + b) AS rrf, min(rank) AS best, max(ord) AS last FROM res GROUP BY 1, 2),
  final AS (SELECT p.query_id, p.chunk_id, row_number() OVER (PARTITION BY p.query_id ORDER BY round(rrf, 12) DESC, best, p.chunk_id) AS rank, round(least(1.0::DOUBLE, rrf / (total / 61)), 6) AS score,
    mt || CASE WHEN last > 0 THEN SEP || 'query_expansion' ELSE '' END || SEP || 'rrf_fusion' AS match_types FROM packed p JOIN used USING (query_id) JOIN types t ON t.query_id = p.query_id AND t.chunk_id = p.chunk_id)"""

EXPANDED = f"WITH {WORKS}, {QUESTIONS}, {VARIANTS}, {TEXT_KEYS}, {lexical_sql('tc', 10, 'vkeys')}, {FUSED}"

RANKED = f"ranked AS (SELECT CAST(regexp_extract(author, '\\d+') AS BIGINT) AS query_id, work_id, chunk_id, text, row_number() OVER (PARTITION BY author ORDER BY length(text) DESC, chunk_id) AS rank FROM lines)"

FILTERED = "(query_id % 2 <> 0 OR ak = 'src' || (query_id % 7)) AND (query_id % 3 <> 0 OR dk = 'en')"

CONTEXT = f"""WITH RECURSIVE {WORKS}, {LINES}, {QUESTIONS}, {KEYS}, {LINE_KEYS}, {lexical_sql('lc', 5)},
  hits AS (SELECT query_id, work_id, min(rank) AS first, max(score) AS score FROM lex GROUP BY 1, 2), turns AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS turn FROM hits),
  missing AS (SELECT t.query_id, t.turn, t.score, l.chunk_id, length(l.text) AS size, row_number() OVER (PARTITION BY t.query_id, t.work_id ORDER BY l.chunk_index) AS round
    FROM turns t JOIN lines l USING (work_id) WHERE NOT EXISTS (SELECT 1 FROM lex x WHERE x.query_id = t.query_id AND x.chunk_id = l.chunk_id)),
  deal AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round, turn) AS i FROM missing),
  fold AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS place, CAST(1 AS BIGINT) AS round, true AS added, false AS ended, false AS take, CAST(NULL AS BIGINT) AS chunk_id, CAST(NULL AS DOUBLE) AS score FROM deal
    UNION ALL SELECT query_id, i, used + CASE WHEN take THEN size ELSE 0 END, place + CASE WHEN take THEN 1 ELSE 0 END, round, CASE WHEN fresh THEN take ELSE added OR take END, ended, take, chunk_id, score
      FROM (SELECT *, NOT ended AND used + size <= 4800 AS take FROM (SELECT d.query_id, d.i, d.size, d.round, d.chunk_id, d.score, f.used, f.place, f.added, d.round <> f.round AS fresh, (d.round <> f.round AND NOT f.added) OR f.place >= 40 OR f.used >= 4800 AS ended FROM fold f JOIN deal d ON d.query_id = f.query_id AND d.i = f.i + 1 WHERE NOT f.ended) a) b),
  context AS (SELECT query_id, place, chunk_id, score FROM fold WHERE take)"""

ORACLES = {
    "parent_context": f"{CONTEXT} SELECT query_id, place, chunk_id, score FROM context",
    "lexical_filtered": f"WITH {WORKS}, {QUESTIONS}, {KEYS}, {TEXT_KEYS}, {lexical_sql('tc', 5, only=FILTERED)} SELECT query_id, rank, chunk_id, score, candidate_count FROM lex",
    "lexical_top5_lines": f"WITH {WORKS}, {LINES}, {QUESTIONS}, {KEYS}, {LINE_KEYS}, {lexical_sql('lc', 5)} SELECT query_id, rank, chunk_id, work_id, score, match_types, candidate_count FROM lex",
    "lexical_indexed": f"WITH {WORKS}, {LINES}, {QUESTIONS}, {KEYS}, {LINE_KEYS}, {lexical_sql('lc', 5)} SELECT query_id, rank, chunk_id, work_id, score, match_types, candidate_count FROM lex",
    "candidates_detailed": f"""WITH {WORKS}, {LINES}, {QUESTIONS}, {KEYS}, {LINE_KEYS}, v1 AS (SELECT lc.* FROM lc JOIN lines USING (chunk_id) WHERE chunk_index % 2 = 0), {lexical_sql('v1', 3)},
      au AS (SELECT DISTINCT CAST(regexp_extract(source, '\\d+') AS BIGINT) AS author_id, source AS author_name FROM documents), dy AS (SELECT DISTINCT CAST(ascii(substr(lang, 2, 1)) AS BIGINT) AS dynasty_id, lang AS dynasty_name FROM documents)
      SELECT query_id, rank, score, x.chunk_id, CASE WHEN chunk_index % 4 > 0 THEN sha1(CAST(x.chunk_id AS VARCHAR)) END AS vector_id, w.work_id, w.work_id * 10 + 1 AS version_id, CASE WHEN chunk_index % 3 = 0 THEN w.work_id % 50 END AS annotation_id, c.role AS annotation_type,
        x.granularity, chunk_index, text, ck AS normalized_text, line_no AS line_start, line_no AS line_end, 'v1' AS chunk_strategy, 'ready' AS chunk_status, title, CAST(regexp_extract(author, '\\d+') AS BIGINT) AS author_id, author_name, CAST(ascii(substr(dynasty, 2, 1)) AS BIGINT) AS dynasty_id, dynasty_name,
        CAST(DATE '2024-01-01' + CAST(w.work_id % 365 AS INTEGER) AS DATE) AS published_at
      FROM lex x JOIN lines w ON w.chunk_id = x.chunk_id LEFT JOIN (SELECT conv_id, role FROM conversations WHERE turn = 0) c ON chunk_index % 3 = 0 AND c.conv_id = w.work_id % 50
      LEFT JOIN au ON au.author_name = author AND author_id % 4 > 0 LEFT JOIN dy ON dy.dynasty_name = dynasty WHERE w.work_id % 11 > 0""",
    "lexical_scored": f"WITH {WORKS}, {LINES}, {QUESTIONS}, {KEYS}, {LINE_KEYS}, {TEXT_KEYS}, vis AS (SELECT * FROM lc WHERE status = 'published' AND NOT deleted UNION ALL SELECT * FROM tc WHERE status = 'published' AND NOT deleted), {lexical_sql('vis', 8)} SELECT query_id, rank, chunk_id, granularity, score, match_types FROM lex",
    "lexical_by_name": f"WITH {WORKS}, questions(query_id, question) AS (VALUES (1::BIGINT, 'src1'), (2, 'SRC12 '), (3, 'en'), (4, 'e'), (5, '%'), (6, '_')), {KEYS}, {TEXT_KEYS}, {lexical_sql('tc', 7)} SELECT query_id, rank, chunk_id, score, match_types, candidate_count FROM lex",
    "dense_topk_cosine": f"SELECT query_id, vec_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, score)), 6) AS score, rank FROM ({dense_sql(10)}) z",
    "dense_topk_filtered": dense_sql(5, on="q.label = v.label"),
    "dense_index_topk": dense_sql(10),
    "dense_index_filtered": dense_sql(5, on="q.label = v.label"),
    "vector_distance_dot": dense_sql(5, "round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"),
    "vector_distance_euclid": dense_sql(5, "round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)", "ASC"),
    "dense_floor_by_granularity": f"WITH h AS ({dense_sql(50)}) SELECT query_id, vec_id, granularity, score FROM (SELECT query_id, vec_id, ['poem', 'line', 'note'][CAST(vec_id % 3 + 1 AS INT)] AS granularity, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, score)), 6) AS score FROM h) x WHERE score >= CASE WHEN granularity = 'note' THEN 0.3::DOUBLE ELSE 0.28::DOUBLE END",
    "dense_stale_dropped": f"WITH {WORKS}, h AS ({dense_sql(25)}) SELECT query_id, vec_id, score, rank FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM h WHERE vec_id IN (SELECT id FROM works WHERE status = 'published' AND NOT deleted)) x WHERE rank <= 5",
    "hybrid_rrf": f"{HYBRID} SELECT query_id, rank, chunk_id, round(least(1.0::DOUBLE, rrf / (2.0::DOUBLE / 61)), 6) AS score, concat_ws(',', CASE WHEN l IS NOT NULL THEN 'lexical' END, mt, CASE WHEN d IS NOT NULL THEN 'dense' END, 'rrf_fusion') AS match_types FROM hybrid WHERE rank <= 10",
    "hybrid_guarded": f"{HYBRID}, ok AS (SELECT query_id FROM questions WHERE length(question) >= 40) SELECT query_id, 'hybrid' AS strategy, rank, chunk_id FROM hybrid WHERE rank <= 3 AND query_id IN (SELECT query_id FROM ok) UNION ALL SELECT query_id, 'lexical', rank, chunk_id FROM lex WHERE rank <= 3 AND query_id IN (SELECT query_id FROM ok)",
    "expanded_weighted_rrf": f"{EXPANDED} SELECT query_id, rank, chunk_id, score, match_types FROM final WHERE rank <= 10".replace("SEP", "','"),
    "match_types_union": f"{EXPANDED} SELECT query_id, chunk_id, match_types FROM final".replace("SEP", "'>'"),
    "content_overlap_rank": rf"""WITH {WORKS}, {QUESTIONS}, w AS (SELECT query_id, unnest(regexp_split_to_array(lower(question), '[^a-z]+')) AS word, unnest(range(200)) AS i FROM questions),
        tm AS (SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) AS o FROM w WHERE length(word) >= 6 GROUP BY 1, 2),
        s AS (SELECT k.id AS work_id, t.query_id, sum(CASE WHEN contains(lower(content), word) THEN length(word) * length(word) ELSE 0 END) + sum(CASE WHEN contains(lower(title), word) THEN length(word) * length(word) ELSE 0 END) AS base,
          sum(CASE WHEN o = 1 AND contains(lower(content), word) THEN 2 * length(word) * length(word) ELSE 0 END) + sum(CASE WHEN o = 1 AND contains(lower(title), word) THEN 3 * length(word) * length(word) ELSE 0 END) AS anchor FROM works k CROSS JOIN tm t GROUP BY 1, 2),
        r AS (SELECT query_id, work_id, CAST(base * CASE WHEN anchor > 0 THEN 2 ELSE 1 END + anchor AS BIGINT) AS score FROM s)
        SELECT query_id, rank, work_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, work_id) AS rank FROM r WHERE score > 0) x WHERE rank <= 5""",
    "diversified_top_k": f"WITH {WORKS}, {LINES}, {RANKED}, p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, work_id ORDER BY rank) <= 2 THEN 1 ELSE 2 END AS pass FROM ranked) SELECT query_id, place, work_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pass, rank) AS place FROM p) x WHERE place <= 10",
    "theme_primary_insert": f"""WITH {WORKS}, {LINES}, {RANKED}, b AS (SELECT query_id, rank, chunk_id, work_id % 7 AS work_id, lower(text) AS text, ['note', 'line', 'poem'][CAST(rank % 3 + 1 AS INT)] AS granularity, 1.0::DOUBLE / (rank + 60) AS rrf FROM ranked WHERE rank <= 200),
        o AS (SELECT *, 9 * (CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'die') AS INT) + CAST(contains(text, 'que') AS INT)) AS overlap FROM b),
        a AS (SELECT query_id, min(rank) AS ar, arg_min(work_id, rank) AS aw FROM o WHERE rank <= 6 AND granularity = 'note' AND overlap > 0 GROUP BY 1),
        t AS (SELECT o.query_id, o.chunk_id, ar + 0.5 AS spot, row_number() OVER (PARTITION BY o.query_id ORDER BY CASE WHEN granularity = 'poem' THEN 0 ELSE 1 END, overlap DESC, rrf DESC, rank, chunk_id) AS one FROM o JOIN a USING (query_id) WHERE rank > 6 AND granularity IN ('poem', 'line') AND o.work_id = aw),
        u AS (SELECT query_id, chunk_id, rank::DOUBLE AS spot FROM o WHERE rank <= 6 UNION ALL SELECT query_id, chunk_id, spot::DOUBLE FROM t WHERE one = 1)
        SELECT query_id, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS place FROM u) x WHERE place <= 6""",
    "context_prefix_budget": f"WITH {WORKS}, {LINES}, {RANKED}, s AS (SELECT *, sum(least(length(text), 1200)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ranked) SELECT query_id, count(*) AS n, CAST(sum(least(length(text), 1200)) AS BIGINT) AS letters FROM s WHERE used <= 6000 GROUP BY 1",
    "evidence_clip_budget": f"WITH {WORKS}, {LINES}, {RANKED}, s AS (SELECT *, greatest(0, least(2500, 12000 - coalesce(sum(least(length(text), 2500)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS room FROM ranked) SELECT query_id, count(*) AS n, CAST(sum(least(length(text), room)) AS BIGINT) AS letters, arg_max(substr(text, 1, CAST(room AS BIGINT)), rank) AS last FROM s WHERE room > 0 GROUP BY 1",
}
