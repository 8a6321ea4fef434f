"""Lexical and dense search of a batch of queries, rank fusion and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamped, content_form, content_overlap, lookup_form, normalize_lookup
from ..sources.tables import checkpointed, top
from .dense import dense_search
from .literal import KEY_BYTES, matched
from .postings import SHORTEST, PostingsIndex
from .vector_index import VectorIndex

#: Rank constant of the fusion, best score of two branches, order of granularities.
RRF = 60
BEST_OF_TWO = 2 / (RRF + 1)
GRANULARITIES = {"line": 0, "poem": 1, "note": 2}
NAMES = ("title", "author", "dynasty")
#: Columns of chunks that hold texts as they are, the keys that are made of them and their forms.
PLAIN = {"text": "content_key", "title": "title_key", "author": "author_key", "dynasty": "dynasty_key"}
FORMS = {"content_key": "content", "title_key": "lookup", "author_key": "lookup", "dynasty_key": "lookup"}
#: Columns that don't travel with candidates; they are fetched for the hits.
HEAVY = ("text", "title", "content_key", "title_key", "author_key", "dynasty_key")


def candidate_limit(k: int) -> int:
    return min(max(5 * k, k), 200)


def own_limit(column: str) -> Column:
    """candidate_limit of a column."""
    return F.least(F.greatest(5 * F.col(column), F.col(column)), F.lit(200))


def granularity_order(column: str | Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in GRANULARITIES.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, F.col(column) if isinstance(column, str) else column), F.lit(99))


def visible(statuses: tuple[str, ...] = ("pending", "ready"), drafts: bool = False) -> Column:
    """The visibility of chunks joined with their work, version and annotation: published and not deleted, of the current version, of a searchable status, and notes only of published annotations. drafts skips the first part, for indexing."""
    note = (F.col("granularity") != "note") | (F.col("annotation_id").isNotNull() & (F.col("annotation_status") == "published"))
    current = (F.col("version_no") == F.col("work_version_no")) & F.col("chunk_status").isin(*statuses)
    return current if drafts else (F.col("work_status") == "published") & F.col("deleted_at").isNull() & current & F.coalesce(note, F.lit(False))


def query_keys(queries: DataFrame, column: str = "question") -> DataFrame:
    """queries with content and lookup keys; those with neither go."""
    keyed = queries.withColumns({"q_content": content_form(F.col(column)), "q_lookup": lookup_form(F.col(column))})
    return keyed.where("q_content <> '' OR q_lookup <> ''")


def lexical_pairs(rows: DataFrame, queries: DataFrame, most_bytes: int = KEY_BYTES, index: PostingsIndex | None = None, forms: dict[str, str] | None = None) -> DataFrame:
    """Pairs of rows and queries that match by content, title, author or dynasty, each once.

    Contents stay behind: a pair has content_key_held and content_key_length in place of the row's content_key.
    With an index of the rows' content, texts are fetched only for those that may hold a long key; short keys are looked for in
    all, and names in a pass that reads no content, so that rows found there have no content_key_length unless they
    match by it. forms are those that matched() makes; an index needs keys that are made before.
    """
    if index is not None and forms:
        raise ValueError("a search by an index needs chunks with their keys")
    names = [(f"{n}_key", "q_lookup") for n in NAMES]
    measured = ("content_key",)
    if index is None:
        return matched(rows, queries, [("content_key", "q_content"), *names], most_bytes, measured, forms).where(lexical_match()[0])
    long = F.length("q_content") >= SHORTEST
    met = index.pairs(rows, queries.where(long)).withColumns({"content_key_held": F.lit(True), "content_key_length": F.length("content_key")}).drop("content_key")
    by_content = checkpointed(met.unionByName(matched(rows, queries.where(~long), [("content_key", "q_content")], most_bytes, measured)).where("content_key_held"))
    lighter = matched(rows.drop("content_key"), queries, names, most_bytes).join(by_content.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    return by_content.unionByName(lighter.withColumns({"content_key_held": F.lit(False), "content_key_length": F.lit(None).cast("int")}))


def lexical_match() -> tuple[Column, Column, list[Column]]:
    """(match, match by content, matches by each name) of a row's keys and a query's."""
    lookup, phrase = F.col("q_lookup"), F.col("content_key_held")
    part = [(lookup != "") & F.contains(F.coalesce(F.col(f"{n}_key"), F.lit("")), lookup) for n in NAMES]
    return phrase | part[0] | part[1] | part[2], phrase, part


def lexical_columns() -> tuple[Column, Column, Column]:
    """(priority, score, match types) of a pair that lexical_pairs gives."""
    size, q, lookup = F.col("content_key_length"), F.col("q_content"), F.col("q_lookup")
    _, phrase, part = lexical_match()
    equal = [(lookup != "") & (F.coalesce(F.col(f"{n}_key"), F.lit("")) == lookup) for n in NAMES]
    exact = phrase & (size == F.length(q))
    priority = F.when(exact, 0)
    for i, cond in enumerate([*equal, *part, phrase], 1):
        priority = priority.when(cond, i)
    zero = F.lit(0.0)
    scores = [F.when(exact, 1.0).when(phrase, F.lit(0.7) + F.lit(0.25) * F.length(q) / F.greatest(size, F.lit(1))).otherwise(zero)]
    for e, p, (high, low) in zip(equal, part, ((1.0, 0.8), (0.95, 0.6), (0.9, 0.55))):
        scores.append(F.when(e, high).when(p, low).otherwise(zero))
    score = F.round(F.least(F.lit(1.0), F.greatest(*scores)), 6)
    types = F.array_compact(F.array(F.when(exact, "chunk_exact").when(phrase, "chunk_phrase"), *(F.when(p, f"{n}_phrase") for p, n in zip(part, NAMES))))
    return priority.otherwise(99), score, types


def lexical_search(chunks: DataFrame, queries: DataFrame, k: int, granularities: list[str] | None = None, strategies: list[str] | None = None, most_bytes: int = KEY_BYTES, fetch: tuple[str, ...] = (), among: DataFrame | None = None, index: PostingsIndex | None = None) -> DataFrame:
    """The k best chunks of each query: a cut of candidates by priority, then scores.

    chunks: chunk_id, work_id, granularity, text, content_key, title_key, author_key, dynasty_key; or, without content_key, text, title,
    author and dynasty as they are, whose keys are then made in the pass that searches them. queries:
    query_id, q_content, q_lookup and, where wanted, only_author and only_dynasty: lookup keys that a chunk's
    have to equal, null for no filter. granularities and strategies (of a column
    chunk_strategy) admit the chunks of these, an empty list all. Adds rank, score, match_types and candidate_count (scored candidates
    after the cut). A column own_k of the queries gives each its own k, of at most k. Rows and queries meet in
    one pass over the rows for each slice of the queries (most_bytes of keys), however many these are. Scores are made there,
    so that texts and keys don't travel; those named in fetch are joined to the hits by chunk_id. among
    (work_id) names the works that may be found; it is joined with the matches before the cut, not with the texts.
    index is one of the chunks' content keys; the result is the same without it.
    """
    found = lexical_best(lexical_candidates(chunks, queries, k, granularities, strategies, most_bytes, among, index), k)
    return found.join(chunks.select("chunk_id", *fetch), "chunk_id") if fetch else found


def lexical_candidates(chunks: DataFrame, queries: DataFrame, k: int, granularities: list[str] | None = None, strategies: list[str] | None = None, most_bytes: int = KEY_BYTES, among: DataFrame | None = None, index: PostingsIndex | None = None) -> DataFrame:
    """The first part of lexical_search: the candidates of each query up to the cut that k needs, with their place in it. lexical_best() of them gives the result for k and for any smaller one."""
    rows = chunks.where(F.col("granularity").isin(granularities)) if granularities else chunks
    rows = rows.where(F.col("chunk_strategy").isin(strategies)) if strategies else rows
    priority, score, types = lexical_columns()
    only = [c for c in ("only_author", "only_dynasty") if c in queries.columns]
    own = ["own_k"] if "own_k" in queries.columns else []
    # Keys of the rows meet those of the queries; texts stay behind.
    plain = "content_key" not in chunks.columns
    if plain:
        rows = rows.select(*(c for c in rows.columns if c not in PLAIN), *(F.col(c).alias(key) for c, key in PLAIN.items()))
    keys = [c for c in rows.columns if c not in ("text", "title")]
    pairs = lexical_pairs(rows.select(*keys), queries.select("query_id", "q_content", "q_lookup", *only, *own), most_bytes, index, FORMS if plain else None)
    for c in only:
        pairs = pairs.where(F.col(c).isNull() | F.col(c).eqNullSafe(F.col(f"{c.removeprefix('only_')}_key")))
    light = [c for c in rows.columns if c not in HEAVY]
    slim = pairs.select("query_id", *own, *light, priority.alias("priority"), score.alias("score"), types.alias("match_types"))
    slim = slim.join(among, "work_id", "left_semi") if among is not None else slim
    return top(slim, candidate_limit(k), F.asc("priority"), F.asc("chunk_id"), name="cut")


def lexical_best(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of lexical_candidates()."""
    own = "own_k" in candidates.columns
    cut = candidates.where(F.col("cut") <= candidate_limit(k))
    if own:
        cut = cut.where(F.col("cut") <= own_limit("own_k"))
    scored = cut.where("score > 0").withColumn("candidate_count", F.count("*").over(Window.partitionBy("query_id")))
    found = top(scored, k, F.desc("score"), granularity_order("granularity"), F.asc("chunk_id")).drop("priority", "cut")
    return found.where("rank <= own_k").drop("own_k") if own else found


def dense_hits(vectors: DataFrame | VectorIndex, queries: DataFrame, k: int, facets: list[str] | None = None) -> DataFrame:
    """The k nearest vectors of each query by cosine: of a table by a scan, of an index by its lists, with the same result."""
    return vectors.search(queries, k, exact=True, facets=facets) if isinstance(vectors, VectorIndex) else dense_search(vectors, queries, k, facets=facets)


def overlap_ranked(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k works of the greatest group_score for each query: (query_id, work_id, score, rank).

    rows: work_id, body, head; queries: query_id, terms and anchors (arrays; a term that repeats counts again). The different
    terms meet the texts in one pass, and only (work, term) pairs go on, so that neither texts nor pairs of all with all travel.
    """
    asked = queries.select("query_id", F.explode("terms").alias("term"), F.lit(1).alias("base"), F.lit(0).alias("anchor"))
    asked = asked.unionByName(queries.select("query_id", F.explode("anchors").alias("term"), F.lit(0).alias("base"), F.lit(1).alias("anchor"))).where("term <> ''")
    asked = asked.groupBy("query_id", "term").agg(F.sum("base").alias("base"), F.sum("anchor").alias("anchor"))
    terms = asked.select("term").distinct().withColumn("query_id", F.xxhash64("term"))
    met = matched(rows, terms, [("body", "term"), ("head", "term")], measured=("body", "head"))
    held = met.select("work_id", "term", F.col("body_held").cast("int").alias("in_body"), F.col("head_held").cast("int").alias("in_head"))
    square = (F.length("term") * F.length("term")).cast("long")
    base = F.sum(square * F.col("base") * (F.col("in_body") + F.col("in_head")))
    anchor = F.sum(square * F.col("anchor") * (2 * F.col("in_body") + 3 * F.col("in_head")))
    sums = held.join(asked, "term").groupBy("query_id", "work_id").agg(base.alias("base"), anchor.alias("anchor"))
    score = F.col("base") * F.when(F.col("anchor") > 0, 2).otherwise(1) + F.col("anchor")
    return top(sums.select("query_id", "work_id", score.alias("score")).where("score > 0"), k, F.desc("score"), F.asc("work_id"))


def above_floor(hits: DataFrame, floor: float, tolerance: float = 0.02) -> DataFrame:
    """Hits with a clamped score not under the floor of their granularity: a little lower for texts and lines than for notes."""
    low = F.when(F.col("granularity").isin("poem", "line"), max(0.0, floor - tolerance)).otherwise(floor)
    return hits.withColumn("score", clamped(F.col("score"))).where(F.col("score") >= low)


def fuse(branches: DataFrame, k: int, best: float | Column = BEST_OF_TWO, first_only: bool = True) -> DataFrame:
    """Reciprocal rank fusion of (query_id, branch, rank, chunk_id, match_types, weight).

    A chunk counts once per branch, its first rank, unless first_only is off. Sums are taken in branch
    order, so that they don't depend on a shuffle; ties go by best rank, then chunk_id. Match types are
    united in branch order, each once.
    """
    rows = branches.withColumn("weight", F.col("weight").cast("double")) if "weight" in branches.columns else branches.withColumn("weight", F.lit(1.0))
    if first_only:
        rows = rows.groupBy("query_id", "branch", "chunk_id").agg(F.min(F.struct("rank", "match_types", "weight")).alias("s")).select("query_id", "branch", "chunk_id", "s.rank", "s.match_types", "s.weight")
    packed = rows.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("branch", "rank", (F.col("weight") / (F.col("rank") + RRF)).alias("part"), "match_types"))).alias("p"))
    summed = packed.select(
        "query_id", "chunk_id", F.aggregate("p", F.lit(0.0), lambda a, x: a + x["part"]).alias("rrf"), F.array_min(F.transform("p", lambda x: x["rank"])).alias("best_rank"),
        F.array_distinct(F.flatten(F.transform("p", lambda x: x["match_types"]))).alias("match_types"), F.array_max(F.transform("p", lambda x: x["branch"])).alias("last_branch"),
    )
    ranked = top(summed.withColumn("candidate_count", F.count("*").over(Window.partitionBy("query_id"))), k, F.desc(F.round("rrf", 12)), F.asc("best_rank"), F.asc("chunk_id"))
    return ranked.withColumn("score", F.round(F.least(F.lit(1.0), F.col("rrf") / (F.lit(best) if isinstance(best, float) else best)), 6))


def hybrid(lexical: DataFrame, dense: DataFrame, k: int, hard_filtered: DataFrame | None = None, dense_failed: bool = False) -> DataFrame:
    """Lexical (rank, match_types) and dense (rank) branches fused; queries of hard_filtered give nothing.

    Without a dense branch the lexical result stands, cut to k and under its own strategy name.
    """
    if dense_failed:
        out = lexical.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score", "match_types", F.lit("lexical").alias("strategy"))
    else:
        sides = lexical.select("query_id", F.lit(0).alias("branch"), "rank", "chunk_id", F.concat(F.array(F.lit("lexical")), "match_types").alias("match_types")).unionByName(
            dense.select("query_id", F.lit(1).alias("branch"), "rank", "chunk_id", F.array(F.lit("dense")).alias("match_types"))
        )
        fused = fuse(sides, k)
        out = fused.select("query_id", "chunk_id", "rank", "score", F.array_distinct(F.concat("match_types", F.array(F.lit("rrf_fusion")))).alias("match_types"), F.lit("hybrid").alias("strategy"))
    return out.join(hard_filtered.select("query_id").distinct(), "query_id", "left_anti") if hard_filtered is not None else out


def variant_weight(variant: Column, query: Column, titles: Column, quoted: Column, entities: Column, concepts: Column, terms: Column) -> Column:
    """The weight of a query variant, by the first list that holds its lookup key."""
    key = normalize_lookup(variant)
    held = lambda values: F.exists(values, lambda v: normalize_lookup(v) == key)
    return F.when(key == normalize_lookup(query), 3.0).when(held(titles), 2.5).when(held(quoted), 3.0).when(held(entities), 2.0).when(held(concepts), 1.5).when(held(terms), F.when(F.length(key) >= 4, 1.5).otherwise(0.5)).otherwise(1.0)


def weighted_variants(variants: DataFrame, most: int) -> DataFrame:
    """The most variants (query_id, ord, variant, weight) of the greatest weight, ties by ord; ord stays the order."""
    return top(variants, most, F.desc("weight"), F.asc("ord"), name="kept").drop("kept")


def expanded(results: DataFrame, k: int, variants: DataFrame | None = None) -> DataFrame:
    """Weighted fusion of the results (query_id, ord, rank, chunk_id, match_types, weight) of all variants; later variants are expansions.

    The best score there can be is that of a chunk that is first for every one of variants (query_id, ord,
    weight), also of those that found nothing; without variants for every one of the results'.
    """
    run = results if variants is None else variants
    used = run.select("query_id", "ord", "weight").distinct().groupBy("query_id").agg(F.sum("weight").alias("total"))
    fused = fuse(results.withColumnRenamed("ord", "branch"), 1 << 30, first_only=False).join(used, "query_id")
    types = F.array_distinct(F.concat("match_types", F.when(F.col("last_branch") > 0, F.array(F.lit("query_expansion"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("rrf_fusion"))))
    score = F.round(F.least(F.lit(1.0), F.col("rrf") / (F.col("total") / (RRF + 1))), 6)
    return fused.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", score.alias("score"), types.alias("match_types"), "rrf", "best_rank")


def diversified(ranked: DataFrame, k: int, each: int = 2, parent: str = "work_id") -> DataFrame:
    """The first each rows of every parent by rank, then the rest, k in all; place is the new rank."""
    turn = F.row_number().over(Window.partitionBy("query_id", parent).orderBy("rank"))
    return top(ranked.withColumn("pass", F.when(turn <= each, 1).otherwise(2)), k, F.asc("pass"), F.asc("rank"), name="place")


def theme_insert(ranked: DataFrame, k: int) -> DataFrame:
    """Where a note among the first k overlaps the query's terms, the best text of its work comes right after it.

    ranked: query_id, rank, work_id, chunk_id, granularity, text (its lookup form), terms, rrf, best_rank.
    """
    overlap = content_overlap(F.col("text"), F.col("terms"))
    rows = ranked.withColumn("overlap", overlap)
    anchor = rows.where((F.col("rank") <= k) & (F.col("granularity") == "note") & (F.col("overlap") > 0)).groupBy("query_id").agg(F.min(F.struct("rank", "work_id")).alias("a"))
    texts = rows.where((F.col("rank") > k) & F.col("granularity").isin("poem", "line")).join(anchor, "query_id").where("work_id = a.work_id")
    order = [F.when(F.col("granularity") == "poem", 0).otherwise(1), F.desc("overlap"), F.desc("rrf"), F.asc("best_rank"), F.asc("chunk_id")]
    added = top(texts, 1, *order, name="one").select("query_id", "chunk_id", (F.col("a.rank") + 0.5).alias("at"))
    kept = rows.where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("rank").cast("double").alias("at"))
    return top(kept.unionByName(added) if k > 1 else kept, k, F.asc("at"), name="place").select("query_id", "chunk_id", "place")


def context_rows(results: DataFrame, chunks: DataFrame, max_chunks: int = 40, max_chars: int = 4800) -> DataFrame:
    """Missing whole-text chunks of the works that results name: (query_id, place, chunk_id, score), dealt out in turns over the works.

    A chunk that does not fit is skipped and its turn is used up; the deal ends with the budgets or with a
    turn that adds nothing. results: query_id, rank, chunk_id, work_id, score.
    """
    if max_chunks < 0 or max_chars < 0:
        raise ValueError("budgets must not be negative")
    works = results.groupBy("query_id", "work_id").agg(F.min("rank").alias("first"), F.max("score").alias("score"))
    works = works.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    missing = works.join(chunks.select("work_id", "chunk_id", "chunk_index", F.length("text").alias("size")), "work_id").join(results.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    placed = missing.withColumn("round", F.row_number().over(Window.partitionBy("query_id", "work_id").orderBy("chunk_index", "chunk_id")))
    # Each turn takes at most one chunk of a work, and at most max_chunks turns add anything.
    packed = placed.where(F.col("round") <= F.lit(max_chunks * 50 + 50)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("round", "turn", "chunk_id", "size", "score"))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(1).alias("round"), F.lit(True).alias("added"), F.lit(False).alias("over"), F.array().cast("array<struct<place:int,chunk_id:bigint,score:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = x["round"] != a["round"]
        over = a["over"] | (new & ~a["added"]) | (a["n"] >= max_chunks) | (a["used"] >= max_chars)
        take = ~over & (a["used"] + x["size"] <= max_chars)
        return F.struct(
            F.when(take, a["used"] + x["size"]).otherwise(a["used"]).alias("used"), F.when(take, a["n"] + 1).otherwise(a["n"]).alias("n"), x["round"].alias("round"), F.when(new, take).otherwise(a["added"] | take).alias("added"), over.alias("over"),
            F.when(take, F.concat(a["out"], F.array(F.struct((a["n"] + 1).alias("place"), x["chunk_id"].alias("chunk_id"), x["score"].cast("double").alias("score"))))).otherwise(a["out"]).alias("out"),
        )

    return packed.select("query_id", F.explode(F.aggregate("c", start, step, lambda a: a["out"])).alias("o")).select("query_id", F.col("o.place").cast("long").alias("place"), "o.chunk_id", "o.score")


def prefix_budget(rows: DataFrame, each: int = 1200, total: int = 6000, by: str = "query_id") -> DataFrame:
    """Texts cut to each letters, up to the first that overflows the total."""
    size = F.least(F.length("text"), F.lit(each))
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__sum", F.sum(size).over(w)).where(F.col("__sum") <= total).withColumn("text", F.substring("text", 1, each)).drop("__sum")


def clipped_budget(rows: DataFrame, each: int = 2500, total: int = 12000, by: str = "query_id") -> DataFrame:
    """Texts cut to each letters and to what those before left of the total; texts without a letter left go."""
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.least(F.length("text"), F.lit(each))).over(w), F.lit(0))
    cut = rows.withColumn("__left", F.greatest(F.lit(0), F.least(F.lit(each), F.lit(total) - before)).cast("int"))
    return cut.withColumn("text", F.substring(F.col("text"), F.lit(1), F.col("__left"))).where("__left > 0").drop("__left")
