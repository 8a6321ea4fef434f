"""Evaluation queries: benchmark items as retrieval cases, orders and their lines as judged answers and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import evaluation as e
from ..operators import retrieval as r
from ..sources.tables import checkpointed, load, texts
from .retrieval import KEYS, TEXT_KEYS, asked, lexical_sql, texts_of
from .shared import QUESTIONS, WORKS, content_key, folded_content


def evidence(spark, d):
    found = r.lexical_search(texts_of(texts(spark, d)), asked(spark, d), 5, fetch=("content_key", "title_key", "author_key"))
    return checkpointed(found.select(F.col("query_id").alias("case_id"), "rank", "content_key", "title_key", "author_key"))


def gold(spark, d):
    """Two selectors for each item: its whole text, and its first forty letters in any text of a named author."""
    items = load(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), t.content_form(F.col("text")).alias("k"))
    return items.select("case_id", F.explode(F.array(F.struct(F.lit(1).alias("gold_id"), F.col("k").alias("contains"), F.lit(None).cast("string").alias("author")), F.struct(F.lit(2).alias("gold_id"), F.substring("k", 1, 40).alias("contains"), F.lit("src1").alias("author")))).alias("g")).select("case_id", "g.*")


def ranks(spark, d, ev=None):
    g, ev = gold(spark, d), evidence(spark, d) if ev is None else ev
    match = e.selector_matches({"text_contains": F.col("contains"), "author": F.col("author")}, {"text_contains": F.col("content_key"), "author": F.col("author_key")})
    return e.first_ranks(g, ev, match)


def results(spark, d):
    """Cases by the size of their item; items that no work holds are unanswerable."""
    items = load(spark, d, "benchmark")
    category = F.element_at(F.array(*map(F.lit, ("exact_quote", "phrase", "long_form"))), (F.col("item_id") % 3 + 1).cast("int"))
    found = evidence(spark, d)
    first = ranks(spark, d, found).where("gold_id = 1").select("case_id", "gold_id", "first_rank")
    expected = F.when(F.length("text") % 4 == 0, "no_evidence").otherwise("evidence")
    cases = items.select(F.col("item_id").alias("case_id"), category.alias("category"), expected.alias("expected"), (F.length("text") * 1.5).cast("double").alias("latency_ms"))
    counts = found.groupBy("case_id").agg(F.count("*").alias("retrieved_count"))
    return e.case_results(cases, first, counts)


def gold_first_rank(spark, d):
    return ranks(spark, d).withColumn("gold_id", F.col("gold_id").cast("long"))


def retrieval_case_results(spark, d):
    return results(spark, d)


def retrieval_summary(spark, d):
    return e.retrieval_summary(results(spark, d))


def retrieval_summary_grouping_sets(spark, d):
    return e.retrieval_summary(results(spark, d), ["category"], overall=True)


def latency_p95_nearest_rank(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(e.p95("value").alias("p95"), e.mean("value").alias("average"), F.count("*").alias("n"))


def answers(spark, d):
    """Orders as answers: the priority is the text, the status says whether it was refused or failed, the lines are citations."""
    facts = lambda *sets: F.array(*(F.struct(F.lit(f"f{i}").alias("id"), F.array(*map(F.lit, e.keys(s))).alias("any_of")) for i, s in enumerate(sets)))
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("citation_count"), F.count_if(F.col("l_returnflag") == "N").alias("matched_ranks"), F.count_if(F.col("l_linestatus") == "O").alias("expected_count"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 2)).alias("matched_expected"))
    orders = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderkey") % 5 == 0, "refusal").otherwise("answer").alias("expected"), t.normalize_content(F.col("o_orderpriority")).alias("answer_key"),
        (F.col("o_orderstatus") == "P").alias("refused"), F.when(F.col("o_custkey") % 11 == 0, "provider_error").alias("error_code"), facts(["1 Urgent!", "high"], ["u", "g", "l"]).alias("required"), facts(["NOT specified"]).alias("forbidden"), F.round(F.col("o_totalprice") / 100, 3).alias("latency_ms"),
    )
    counts = ("citation_count", "matched_ranks", "expected_count", "matched_expected")
    return orders.join(lines, F.col("case_id") == F.col("l_orderkey"), "left").drop("l_orderkey").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def generation_case_verdict(spark, d):
    out = e.generation_verdicts(answers(spark, d))
    return out.select("case_id", F.concat_ws(",", "missing_facts").alias("missing_facts"), F.concat_ws(",", "forbidden_present").alias("forbidden_present"), "citation_precision", "citation_recall", "answer_correct", "passed")


def generation_summary_micro(spark, d):
    return e.generation_summary(e.generation_verdicts(answers(spark, d)), ["category"], overall=True)


def judged(spark, d):
    claims = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.array("l_linenumber").alias("citation_ranks"), F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "R", "unsupported").otherwise(F.when(F.col("l_quantity") > 40, "partially_supported").otherwise("supported")).alias("support")))).alias("claims"))
    rows = load(spark, d, "orders").join(claims, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    refused, error = F.col("o_orderstatus") == "P", F.when(F.col("o_custkey") % 11 == 0, "provider_error")
    readable = F.coalesce(e.ranks_allowed(F.col("claims"), F.sequence(F.lit(1), F.lit(6))), F.lit(False))
    relevance = F.element_at(F.array(*map(F.lit, e.RELEVANCE)), (F.col("o_custkey") % 3 + 1).cast("int"))
    return rows.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderkey") % 5 == 0, "refusal").otherwise("answer").alias("expected"), e.judge_status(refused, error, F.col("o_orderpriority"), readable).alias("judge_status"), relevance.alias("relevance"),
        F.transform("claims", lambda c: c["support"]).alias("supports"), (F.col("o_totalprice") > 100000).alias("passed"), refused.alias("refused"), error.alias("error_code"), readable.alias("ranks_allowed"),
    )


def judge_routing(spark, d):
    return judged(spark, d).groupBy("judge_status", "category").agg(F.count("*").alias("n"))


def judge_summary(spark, d):
    return e.judge_summary(judged(spark, d), ["category"], overall=True)


def rank_subset_check(spark, d):
    return judged(spark, d).select("case_id", "ranks_allowed")


def reviews(spark, d):
    return load(spark, d, "orders").where("o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'").select(F.col("o_orderkey").alias("case_id"), (F.floor("o_totalprice") % 3).cast("int").alias("relevance_0_2"), (F.floor(F.col("o_totalprice") / 7) % 3).cast("int").alias("faithfulness_0_2"))


def calibration_summary(spark, d):
    rows = judged(spark, d).where("judge_status = 'judged'")
    return e.calibration_summary(e.calibration_cases(rows, reviews(spark, d)), rows)


def unknown_reviews_anti(spark, d):
    return e.unknown(reviews(spark, d), judged(spark, d).where("judge_status = 'judged'")).select("case_id")


def judge_failures(spark, d):
    """The cases that a calibration of flagged ones takes: judged, and not faithful or not relevant."""
    flagged = (e.faithfulness(F.col("supports")) != "supported") | (F.col("relevance") != "relevant")
    return e.selected_for_calibration(judged(spark, d), flagged, "failures").select("case_id", "category")


QUERIES = {f.__name__: f for f in (gold_first_rank, retrieval_case_results, retrieval_summary, retrieval_summary_grouping_sets, latency_p95_nearest_rank, generation_case_verdict, generation_summary_micro, judge_routing, judge_summary, rank_subset_check, calibration_summary, unknown_reviews_anti, judge_failures)}

GOLD = f"""WITH {WORKS}, {QUESTIONS}, {KEYS}, {TEXT_KEYS}, {lexical_sql('tc', 5)},
  items AS (SELECT item_id AS case_id, text, {folded_content('text')} AS k FROM benchmark),
  gold AS (SELECT case_id, 1::BIGINT AS gold_id, k AS c, NULL AS author FROM items UNION ALL SELECT case_id, 2, substr(k, 1, 40), 'src1' FROM items),
  firsts AS (SELECT g.case_id, g.gold_id, min(l.rank) AS first_rank FROM gold g LEFT JOIN lex l ON l.query_id = g.case_id AND contains(l.ck, g.c) AND (g.author IS NULL OR l.ak = g.author) GROUP BY 1, 2)"""
RESULTS = f"""{GOLD}, results AS (SELECT i.case_id, ['exact_quote', 'phrase', 'long_form'][CAST(i.case_id % 3 + 1 AS INT)] AS category, CASE WHEN length(i.text) % 4 = 0 THEN 'no_evidence' ELSE 'evidence' END AS expected, length(i.text) * 1.5::DOUBLE AS latency_ms,
    (SELECT count(*) FROM lex WHERE query_id = i.case_id) AS retrieved_count, f.first_rank FROM items i JOIN firsts f ON f.case_id = i.case_id AND f.gold_id = 1),
  cases AS (SELECT case_id, category, expected, latency_ms, retrieved_count, CASE WHEN expected = 'evidence' THEN CASE WHEN first_rank IS NULL THEN 0.0::DOUBLE ELSE 1.0 END END AS recall_at_k,
    CASE WHEN expected = 'evidence' THEN coalesce(round(1.0::DOUBLE / first_rank, 6), 0.0) END AS reciprocal_rank, CASE WHEN expected = 'evidence' THEN first_rank IS NOT NULL ELSE retrieved_count = 0 END AS passed FROM results)"""


def ratio_sql(a: str, b: str) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0), 6)"


def f1_sql(p: str, q: str) -> str:
    return f"round(coalesce(2 * {p} * {q} / nullif({p} + {q}, 0), 0.0), 6)"


LATENCY = "coalesce(round(avg(latency_ms), 3), 0.0) AS average_latency_ms, coalesce(round(quantile_disc(latency_ms, 0.95), 3), 0.0) AS p95_latency_ms"


def refusal_sql(ok: str, bad: str, n: str) -> str:
    p, q = ratio_sql(ok, f"({ok} + {bad})"), ratio_sql(ok, n)
    return f"{p} AS refusal_precision, {q} AS refusal_recall, {f1_sql(p, q)} AS refusal_f1"


E_ = "count(*) FILTER (expected = 'evidence')"
U_ = "count(*) FILTER (expected <> 'evidence')"
OK_, BAD_ = "count(*) FILTER (expected <> 'evidence' AND passed)", "count(*) FILTER (expected = 'evidence' AND retrieved_count = 0)"
SUMMARY = f"""count(*) AS total_cases, {E_} AS answerable_cases, {U_} AS unanswerable_cases, count(*) FILTER (passed) AS passed_cases, {ratio_sql('count(*) FILTER (passed)', 'count(*)')} AS pass_rate, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(reciprocal_rank), 6) AS mrr,
  {ratio_sql('count(*) FILTER (recall_at_k > 0)', E_)} AS hit_rate_at_k, {ratio_sql(BAD_, E_)} AS answerable_no_result_rate, {ratio_sql(OK_, U_)} AS unanswerable_accuracy, {refusal_sql(OK_, BAD_, U_)}, {LATENCY}"""

ANSWERS = """WITH l AS (SELECT l_orderkey, count(*) AS citation_count, count(*) FILTER (l_returnflag = 'N') AS matched_ranks, count(*) FILTER (l_linestatus = 'O') AS expected_count, count(*) FILTER (l_linestatus = 'O' AND l_quantity > 2) AS matched_expected FROM lineitem GROUP BY 1),
  a AS (SELECT o_orderkey AS case_id, o_orderpriority AS category, CASE WHEN o_orderkey % 5 = 0 THEN 'refusal' ELSE 'answer' END AS expected, regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') AS k, o_orderstatus = 'P' AS refused, CASE WHEN o_custkey % 11 = 0 THEN 'provider_error' END AS error_code,
    round(o_totalprice / 100, 3) AS latency_ms, coalesce(citation_count, 0) AS citation_count, coalesce(matched_ranks, 0) AS matched_ranks, coalesce(expected_count, 0) AS expected_count, coalesce(matched_expected, 0) AS matched_expected FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
  m AS (SELECT *, concat_ws(',', CASE WHEN NOT (contains(k, '1urgent') OR contains(k, 'high')) THEN 'f0' END, CASE WHEN NOT (contains(k, 'u') OR contains(k, 'g') OR contains(k, 'l')) THEN 'f1' END) AS missing_facts, CASE WHEN contains(k, 'notspecified') THEN 'f0' ELSE '' END AS forbidden_present,
    CASE WHEN citation_count > 0 THEN round(matched_ranks::DOUBLE / citation_count, 6) END AS citation_precision, CASE WHEN expected_count > 0 THEN round(matched_expected::DOUBLE / expected_count, 6) END AS citation_recall FROM a),
  c AS (SELECT *, CASE WHEN expected = 'answer' THEN error_code IS NULL AND NOT refused AND missing_facts = '' AND forbidden_present = '' ELSE error_code IS NULL AND refused END AS answer_correct FROM m),
  v AS (SELECT *, answer_correct AND CASE WHEN expected = 'answer' THEN coalesce(citation_recall = 1.0, false) ELSE citation_count = 0 END AS passed FROM c)"""
A_, R_ = "count(*) FILTER (expected = 'answer')", "count(*) FILTER (expected = 'refusal')"
GOK, GBAD = "count(*) FILTER (expected = 'refusal' AND refused AND error_code IS NULL)", "count(*) FILTER (expected = 'answer' AND refused AND error_code IS NULL)"

JUDGED = """WITH cl AS (SELECT l_orderkey, count(*) AS claims, count(*) FILTER (s = 'supported') AS sup, count(*) FILTER (s = 'unsupported') AS uns, max(l_linenumber) AS most FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'supported' WHEN 'R' THEN 'unsupported' ELSE CASE WHEN l_quantity > 40 THEN 'partially_supported' ELSE 'supported' END END AS s FROM lineitem) x GROUP BY 1),
  j AS (SELECT o_orderkey AS case_id, o_orderpriority AS category, CASE WHEN o_orderkey % 5 = 0 THEN 'refusal' ELSE 'answer' END AS expected, coalesce(most <= 6, false) AS ranks_allowed, o_orderstatus = 'P' AS refused, CASE WHEN o_custkey % 11 = 0 THEN 'provider_error' END AS error_code,
    CASE WHEN o_custkey % 11 = 0 THEN 'skipped_error' WHEN o_orderstatus = 'P' THEN 'skipped_refusal' WHEN coalesce(most <= 6, false) THEN 'judged' ELSE 'judge_error' END AS judge_status, ['irrelevant', 'partially_relevant', 'relevant'][CAST(o_custkey % 3 + 1 AS INT)] AS relevance,
    o_totalprice > 100000 AS passed, o_totalprice, claims, sup, uns, CASE WHEN claims = sup THEN 'supported' WHEN claims = uns THEN 'unsupported' ELSE 'partially_supported' END AS faith FROM orders LEFT JOIN cl ON l_orderkey = o_orderkey)"""
J_, REF = "count(*) FILTER (judge_status = 'judged')", "count(*) FILTER (expected = 'refusal')"
CLAIMS = "sum(claims) FILTER (judge_status = 'judged')"
REVIEWED = f"{JUDGED}, rv AS (SELECT o_orderkey AS case_id, CAST(floor(o_totalprice) AS BIGINT) % 3 AS hr, CAST(floor(o_totalprice / 7) AS BIGINT) % 3 AS hf FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')"

ORACLES = {
    "gold_first_rank": f"{GOLD} SELECT case_id, gold_id, first_rank FROM firsts",
    "retrieval_case_results": f"{RESULTS} SELECT * FROM cases",
    "retrieval_summary": f"{RESULTS} SELECT {SUMMARY} FROM cases",
    "retrieval_summary_grouping_sets": f"{RESULTS} SELECT category, {SUMMARY} FROM cases GROUP BY GROUPING SETS ((), (category))",
    "latency_p95_nearest_rank": "SELECT event_type, round(quantile_disc(value, 0.95), 3) AS p95, round(avg(value), 3) AS average, count(*) AS n FROM events GROUP BY 1",
    "generation_case_verdict": f"{ANSWERS} SELECT case_id, missing_facts, forbidden_present, citation_precision, citation_recall, answer_correct, passed FROM v",
    "generation_summary_micro": f"""{ANSWERS} SELECT category, count(*) AS total_cases, {A_} AS answerable_cases, {R_} AS refusal_cases, count(*) FILTER (passed) AS passed_cases, {ratio_sql('count(*) FILTER (passed)', 'count(*)')} AS pass_rate,
      CASE WHEN {A_} > 0 THEN {ratio_sql("count(*) FILTER (expected = 'answer' AND answer_correct)", A_)} END AS answer_accuracy, CASE WHEN {R_} > 0 THEN {ratio_sql("count(*) FILTER (expected = 'refusal' AND answer_correct)", R_)} END AS refusal_accuracy, {refusal_sql(GOK, GBAD, R_)},
      CASE WHEN sum(citation_count) > 0 THEN {ratio_sql('sum(matched_ranks)', 'sum(citation_count)')} END AS citation_precision, CASE WHEN sum(expected_count) > 0 THEN {ratio_sql('sum(matched_expected)', 'sum(expected_count)')} END AS citation_recall, {LATENCY} FROM v GROUP BY GROUPING SETS ((), (category))""",
    "judge_routing": f"{JUDGED} SELECT judge_status, category, count(*) AS n FROM j GROUP BY 1, 2",
    "judge_summary": f"""{JUDGED} SELECT category, count(*) AS total_cases, count(*) FILTER (expected <> 'refusal') AS answerable_cases, {REF} AS refusal_cases, {J_} AS judged_cases, count(*) FILTER (judge_status = 'judge_error') AS judge_error_cases, {ratio_sql('count(*) FILTER (passed)', 'count(*)')} AS deterministic_pass_rate,
      CASE WHEN {J_} > 0 THEN {ratio_sql("count(*) FILTER (judge_status = 'judged' AND faith = 'supported')", J_)} END AS faithfulness_pass_rate, CASE WHEN {J_} > 0 THEN {ratio_sql("count(*) FILTER (judge_status = 'judged' AND relevance = 'relevant')", J_)} END AS answer_relevance_rate,
      CASE WHEN {CLAIMS} > 0 THEN {ratio_sql("sum(sup) FILTER (judge_status = 'judged')", CLAIMS)} END AS claim_support_rate, CASE WHEN {J_} > 0 THEN round(CAST(sum(uns) FILTER (judge_status = 'judged') AS DOUBLE) / {J_}, 3) END AS average_unsupported_claims,
      CASE WHEN {REF} > 0 THEN {ratio_sql("count(*) FILTER (expected = 'refusal' AND refused AND error_code IS NULL)", REF)} END AS refusal_accuracy FROM j GROUP BY GROUPING SETS ((), (category))""",
    "rank_subset_check": f"{JUDGED} SELECT case_id, ranks_allowed FROM j",
    "calibration_summary": f"""{REVIEWED}, c AS (SELECT hr = CASE relevance WHEN 'irrelevant' THEN 0 WHEN 'partially_relevant' THEN 1 ELSE 2 END AS rm, hf = CASE faith WHEN 'unsupported' THEN 0 WHEN 'partially_supported' THEN 1 ELSE 2 END AS fm, hr = 2 AND hf = 2 AS h, relevance = 'relevant' AND faith = 'supported' AS jp FROM j JOIN rv USING (case_id) WHERE judge_status = 'judged'),
      s AS (SELECT count(*) AS reviewed_cases, {ratio_sql('count(*) FILTER (rm)', 'count(*)')} AS relevance_agreement, {ratio_sql('count(*) FILTER (fm)', 'count(*)')} AS faithfulness_agreement, {ratio_sql('count(*) FILTER (h = jp)', 'count(*)')} AS strict_agreement, count(*) FILTER (h AND NOT jp) AS judge_stricter, count(*) FILTER (jp AND NOT h) AS judge_looser FROM c),
      n AS (SELECT {J_} AS eligible_cases FROM j) SELECT s.*, n.eligible_cases, {ratio_sql('reviewed_cases', 'eligible_cases')} AS coverage_rate FROM s, n""",
    "unknown_reviews_anti": f"{REVIEWED} SELECT case_id FROM rv WHERE case_id NOT IN (SELECT case_id FROM j WHERE judge_status = 'judged')",
    "judge_failures": f"{JUDGED} SELECT case_id, category FROM j WHERE judge_status = 'judged' AND (faith <> 'supported' OR relevance <> 'relevant')",
}
