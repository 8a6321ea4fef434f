"""Evaluation operators: gold matching, retrieval, generation, judge and calibration metrics. Summaries are one aggregate over all cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_key, f1, lookup_key, ratio

#: Ordinal scores of judge labels.
RELEVANCE = {"irrelevant": 0, "partially_relevant": 1, "relevant": 2}
FAITHFULNESS = {"unsupported": 0, "partially_supported": 1, "supported": 2}


def selector_matches(selector: dict[str, Column], evidence: dict[str, Column], text: str = "text_contains") -> Column:
    """Whether evidence meets a selector: a null field of the selector fits all, a null field of the evidence no set one; text has to be contained."""
    held = F.lit(True)
    for field, wanted in selector.items():
        fits = F.contains(evidence[field], wanted) if field == text else evidence[field] == wanted
        held = held & (wanted.isNull() | F.coalesce(fits, F.lit(False)))
    return held


def first_ranks(gold: DataFrame, evidence: DataFrame, condition: Column) -> DataFrame:
    """(case_id, gold_id, first_rank): the least rank of the evidence that meets each gold selector, null for none."""
    hits = gold.join(evidence.withColumnRenamed("case_id", "__case"), (gold["case_id"] == F.col("__case")) & condition, "left")
    return hits.groupBy("case_id", "gold_id").agg(F.min("rank").alias("first_rank"))


def case_results(cases: DataFrame, ranks: DataFrame, counts: DataFrame) -> DataFrame:
    """Retrieval results of cases (case_id, category, expected, latency_ms): recall and reciprocal rank over their gold, and whether they pass."""
    found = ranks.groupBy("case_id").agg(F.count("first_rank").alias("hit"), F.count("*").alias("gold"), F.min("first_rank").alias("best"))
    rows = cases.join(found, "case_id", "left").join(counts, "case_id", "left").withColumn("retrieved_count", F.coalesce("retrieved_count", F.lit(0)))
    answerable = F.col("expected") == "evidence"
    return rows.select(
        "case_id", "category", "expected", "latency_ms", "retrieved_count",
        F.when(answerable, F.round(F.col("hit") / F.col("gold"), 6)).alias("recall_at_k"),
        F.when(answerable, F.coalesce(F.round(1.0 / F.col("best"), 6), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(answerable, F.coalesce(F.col("hit") == F.col("gold"), F.lit(False))).otherwise(F.col("retrieved_count") == 0).alias("passed"),
    )


def p95(column: str) -> Column:
    """The nearest-rank 95th percentile, 0.0 without values."""
    return F.coalesce(F.round(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {column})"), 3), F.lit(0.0))


def mean(column: str, digits: int = 3) -> Column:
    return F.coalesce(F.round(F.avg(column), digits), F.lit(0.0))


def grouped(rows: DataFrame, by: list[str], overall: bool):
    """Groups by the columns, or with overall the total and each value in one pass over the rows."""
    return rows.groupingSets([[], by], *by) if overall else rows.groupBy(*by)


def refusals(correct: Column, wrong: Column, total: Column) -> list[Column]:
    precision, recall = ratio(correct, correct + wrong), ratio(correct, total)
    return [precision.alias("refusal_precision"), recall.alias("refusal_recall"), f1(precision, recall).alias("refusal_f1")]


def retrieval_summary(results: DataFrame, by: list[str] | None = None, overall: bool = False) -> DataFrame:
    answerable = F.col("expected") == "evidence"
    n, total = F.count_if(answerable), F.count("*")
    correct, wrong = F.count_if(~answerable & F.col("passed")), F.count_if(answerable & (F.col("retrieved_count") == 0))
    return grouped(results, by or [], overall).agg(
        total.alias("total_cases"), n.alias("answerable_cases"), (total - n).alias("unanswerable_cases"), F.count_if("passed").alias("passed_cases"), ratio(F.count_if("passed"), total).alias("pass_rate"),
        F.round(F.avg("recall_at_k"), 6).alias("recall_at_k"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), ratio(F.count_if(F.col("recall_at_k") > 0), n).alias("hit_rate_at_k"),
        ratio(wrong, n).alias("answerable_no_result_rate"), ratio(correct, total - n).alias("unanswerable_accuracy"), *refusals(correct, wrong, total - n), mean("latency_ms").alias("average_latency_ms"), p95("latency_ms").alias("p95_latency_ms"),
    )


def fact_matches(facts: Column, answer: Column) -> Column:
    """For each fact (id, any_of) the first alternative that the answer's content key holds, null for none."""
    return F.transform(facts, lambda f: F.struct(f["id"].alias("id"), F.try_element_at(F.filter(f["any_of"], lambda a: (a != "") & F.contains(answer, a)), F.lit(1)).alias("hit")))


def generation_verdicts(rows: DataFrame) -> DataFrame:
    """Verdicts of generated answers.

    rows: case_id, category, expected, answer_key (content key), refused, error_code, required and forbidden
    (arrays of id, any_of as content keys), citation_count, matched_ranks and matched_expected (sizes),
    expected_count, latency_ms.
    """
    required, forbidden = fact_matches(F.col("required"), F.col("answer_key")), fact_matches(F.col("forbidden"), F.col("answer_key"))
    missing = F.transform(F.filter(required, lambda f: f["hit"].isNull()), lambda f: f["id"])
    present = F.transform(F.filter(forbidden, lambda f: f["hit"].isNotNull()), lambda f: f["id"])
    fine, answer = F.col("error_code").isNull(), F.col("expected") == "answer"
    part = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    out = rows.withColumns({"missing_facts": missing, "forbidden_present": present, "citation_precision": part("matched_ranks", "citation_count"), "citation_recall": part("matched_expected", "expected_count")})
    correct = F.when(answer, fine & ~F.col("refused") & (F.size("missing_facts") == 0) & (F.size("forbidden_present") == 0)).otherwise(fine & F.col("refused"))
    out = out.withColumn("answer_correct", correct)
    return out.withColumn("passed", F.col("answer_correct") & F.when(answer, F.coalesce(F.col("citation_recall") == 1.0, F.lit(False))).otherwise(F.col("citation_count") == 0)).drop("required", "forbidden")


def generation_summary(verdicts: DataFrame, by: list[str] | None = None, overall: bool = False) -> DataFrame:
    answer, fine = F.col("expected") == "answer", F.col("error_code").isNull()
    n, total = F.count_if(answer), F.count("*")
    correct, wrong = F.count_if(~answer & F.col("refused") & fine), F.count_if(answer & F.col("refused") & fine)
    some = lambda a, b: F.when(F.sum(b) > 0, ratio(F.sum(a), F.sum(b)))
    return grouped(verdicts, by or [], overall).agg(
        total.alias("total_cases"), n.alias("answerable_cases"), (total - n).alias("refusal_cases"), F.count_if("passed").alias("passed_cases"), ratio(F.count_if("passed"), total).alias("pass_rate"),
        F.when(n > 0, ratio(F.count_if(answer & F.col("answer_correct")), n)).alias("answer_accuracy"), F.when(total > n, ratio(F.count_if(~answer & F.col("answer_correct")), total - n)).alias("refusal_accuracy"),
        *refusals(correct, wrong, total - n), some("matched_ranks", "citation_count").alias("citation_precision"), some("matched_expected", "expected_count").alias("citation_recall"), mean("latency_ms").alias("average_latency_ms"), p95("latency_ms").alias("p95_latency_ms"),
    )


def judge_status(refused: Column, error_code: Column, answer: Column, parsed: Column) -> Column:
    """Where a case goes: refusals, errors and empty answers are skipped; what the judge's reply can't be read from is its error."""
    return F.when(error_code.isNotNull(), "skipped_error").when(refused, "skipped_refusal").when(F.trim(F.coalesce(answer, F.lit(""))) == "", "skipped_empty").when(parsed, "judged").otherwise("judge_error")


def faithfulness(supports: Column) -> Column:
    """supported or unsupported where all claims are, else partially_supported, without claims too."""
    some = F.size(supports) > 0
    return F.when(some & F.forall(supports, lambda s: s == "supported"), "supported").when(some & F.forall(supports, lambda s: s == "unsupported"), "unsupported").otherwise("partially_supported")


def ranks_allowed(claims: Column, allowed: Column) -> Column:
    """Whether all citation ranks of all claims are allowed ones."""
    return F.forall(claims, lambda c: F.size(F.array_except(c["citation_ranks"], allowed)) == 0)


def judge_summary(rows: DataFrame, by: list[str] | None = None, overall: bool = False) -> DataFrame:
    """rows: expected, judge_status, relevance, supports (of the claims), passed, refused, error_code."""
    judged = F.col("judge_status") == "judged"
    n, total, refusal = F.count_if(judged), F.count("*"), F.col("expected") == "refusal"
    count = lambda s: F.sum(F.when(judged, F.size(F.filter("supports", lambda x: x == s))))
    claims = F.sum(F.when(judged, F.size("supports")))
    return grouped(rows, by or [], overall).agg(
        total.alias("total_cases"), F.count_if(~refusal).alias("answerable_cases"), F.count_if(refusal).alias("refusal_cases"), n.alias("judged_cases"), F.count_if(F.col("judge_status") == "judge_error").alias("judge_error_cases"),
        ratio(F.count_if("passed"), total).alias("deterministic_pass_rate"), F.when(n > 0, ratio(F.count_if(judged & (faithfulness(F.col("supports")) == "supported")), n)).alias("faithfulness_pass_rate"),
        F.when(n > 0, ratio(F.count_if(judged & (F.col("relevance") == "relevant")), n)).alias("answer_relevance_rate"), F.when(claims > 0, ratio(count("supported"), claims)).alias("claim_support_rate"),
        F.when(n > 0, F.round(count("unsupported") / n, 3)).alias("average_unsupported_claims"), F.when(F.count_if(refusal) > 0, ratio(F.count_if(refusal & F.col("refused") & F.col("error_code").isNull()), F.count_if(refusal))).alias("refusal_accuracy"),
    )


def scored(label: Column, scores: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in scores.items() for x in pair)), label)


def calibration_cases(judged: DataFrame, reviews: DataFrame) -> DataFrame:
    """Judged cases (case_id, relevance, supports) with human scores (relevance_0_2, faithfulness_0_2): which agree, and which side is stricter."""
    rows = judged.join(reviews.select("case_id", "relevance_0_2", "faithfulness_0_2"), "case_id")
    rows = rows.withColumns({"judge_relevance": scored(F.col("relevance"), RELEVANCE), "judge_faithfulness": scored(faithfulness(F.col("supports")), FAITHFULNESS)})
    human, judge = (F.col("relevance_0_2") == 2) & (F.col("faithfulness_0_2") == 2), (F.col("judge_relevance") == 2) & (F.col("judge_faithfulness") == 2)
    direction = F.when(human == judge, "match").when(human, "judge_stricter").otherwise("judge_looser")
    return rows.select("case_id", (F.col("relevance_0_2") == F.col("judge_relevance")).alias("relevance_match"), (F.col("faithfulness_0_2") == F.col("judge_faithfulness")).alias("faithfulness_match"), (human == judge).alias("strict_match"), direction.alias("direction"))


def calibration_summary(cases: DataFrame, eligible: DataFrame) -> DataFrame:
    n = F.count("*")
    rates = cases.agg(
        n.alias("reviewed_cases"), *(ratio(F.count_if(f"{c}_match"), n).alias(f"{c}_agreement") for c in ("relevance", "faithfulness", "strict")), *(F.count_if(F.col("direction") == c).alias(c) for c in ("judge_stricter", "judge_looser"))
    )
    return rates.crossJoin(F.broadcast(eligible.agg(F.count("*").alias("eligible_cases")))).withColumn("coverage_rate", ratio(F.col("reviewed_cases"), F.col("eligible_cases")))


def selected_for_calibration(judged: DataFrame, flagged: Column, scope: str) -> DataFrame:
    """The judged cases that a calibration reviews: all, or those flagged by the judge; an empty selection is an error."""
    if scope not in ("all", "failures"):
        raise ValueError(f"unknown scope: {scope}")
    rows = judged.where(F.col("judge_status") == "judged")
    rows = rows if scope == "all" else rows.where(flagged)
    if rows.isEmpty():
        raise ValueError(f"no judged case to calibrate on (scope {scope})")
    return rows


def unknown(reviews: DataFrame, judged: DataFrame) -> DataFrame:
    """Reviews of cases that were not judged."""
    return reviews.join(judged, "case_id", "left_anti")


def keys(values: list[str], full: bool = True) -> list[str]:
    """Alternatives of facts as keys, made on the driver: there are few."""
    return [content_key(v) if full else lookup_key(v) for v in values]
