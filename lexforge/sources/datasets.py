"""Readers and writers of data sets, evaluation cases, lexicons, reviews and reports. Each checks what it reads and names what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_lookup_full

DATASET = """version string, source struct<source_key:string,source_type:string,source_name:string,source_url:string,license_note:string>, defaults struct<publish:boolean>,
 records array<struct<external_id:string,title:string,content:string,author_name:string,dynasty_name:string,summary:string,source_url:string,publish:boolean,categories:array<struct<name:string,type:string>>,tags:array<string>,
 annotations:array<struct<type:string,title:string,content:string,line_start:int,line_end:int,status:string>>,raw_payload:map<string,string>>>"""
CASES = """version string, cases array<struct<id:string,category:string,question:string,expected:string,
 gold_evidence:array<struct<poem_title:string,author_name:string,dynasty_name:string,granularity:string,text_contains:string,line_start:int,line_end:int>>>>"""
LEXICON = "version string, concepts array<struct<name:string,triggers:array<string>,expansions:array<string>>>, known_authors array<string>, known_dynasties array<string>, poetic_intent_terms array<string>"


def repeated(rows: DataFrame, *keys: Column) -> DataFrame:
    """Values that occur more than once."""
    return rows.groupBy(*keys).count().where("count > 1")


def unique(rows: DataFrame, what: str, *keys: Column) -> DataFrame:
    bad = repeated(rows, *keys).first()
    if bad:
        raise ValueError(f"{what} repeats: {bad[0]}")
    return rows


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Records of an import data set, one row each with the version and source; external ids have to differ, and titles and contents be there."""
    whole = spark.read.schema(DATASET).option("mode", "FAILFAST").json(path, multiLine=True)
    rows = whole.select("version", "source", "defaults", F.inline("records"))
    blank = rows.where((F.trim(F.coalesce("title", F.lit(""))) == "") | (F.trim(F.coalesce("content", F.lit(""))) == "")).first()
    if blank:
        raise ValueError(f"record {blank.external_id} has no title or content")
    return unique(rows, "external_id", F.col("external_id"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; ids and questions have to differ, and answerable ones name evidence."""
    rows = spark.read.schema(CASES).option("mode", "FAILFAST").json(path, multiLine=True).select(F.inline("cases"))
    bare = rows.where((F.col("expected") == "evidence") & (F.size("gold_evidence") < 1)).first()
    if bare:
        raise ValueError(f"case {bare.id} expects evidence and names none")
    return unique(unique(rows, "id", F.col("id")), "question", normalize_lookup_full("question"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A query lexicon as one row; terms of a list have to differ after normalising and not be blank."""
    rows = spark.read.schema(LEXICON).option("mode", "FAILFAST").json(path, multiLine=True)
    lists = [F.transform("concepts", lambda c: c["name"]), "known_authors", "known_dynasties", "poetic_intent_terms"]
    for i, values in enumerate(lists):
        terms = rows.select(F.explode(values).alias("term"))
        if not terms.where(F.trim(F.coalesce("term", F.lit(""))) == "").isEmpty():
            raise ValueError(f"a blank term in list {i}")
        unique(terms, "term", normalize_lookup_full("term"))
    return rows


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Human scores of judged cases from CSV: required columns, scores 0, 1 or 2, each case once; blank rows go."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    missing = {"case_id", "relevance_0_2", "faithfulness_0_2"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    blank = F.lit(True)
    for c in raw.columns:
        blank = blank & (F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) == "")
    rows = raw.where(~blank)
    for c in ("relevance_0_2", "faithfulness_0_2"):
        bad = rows.where(~F.coalesce(F.trim(c).isin("0", "1", "2"), F.lit(False))).first()
        if bad:
            raise ValueError(f"case {bad.case_id}: {c} must be 0, 1 or 2")
        rows = rows.withColumn(c, F.trim(c).cast("int"))
    return unique(rows.withColumn("case_id", F.trim("case_id")), "case_id", F.col("case_id"))


def write_review_template(judged: DataFrame, path: str) -> None:
    """Judged cases as CSV with empty scores."""
    judged.select("case_id", "category", F.lit("").alias("relevance_0_2"), F.lit("").alias("faithfulness_0_2"), F.lit("").alias("notes")).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def fixed(value: Column) -> Column:
    """Six decimals, n/a for null."""
    return F.when(value.isNull(), F.lit("n/a")).otherwise(F.format_string("%.6f", value.cast("double")))


def write_report(rows: DataFrame, path: str, form: str = "json") -> None:
    """Rows as JSON lines, or as a Markdown table with fixed decimals."""
    if form == "json":
        return rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    cells = [fixed(F.col(f.name)) if f.dataType.typeName() == "double" else F.coalesce(F.col(f.name).cast("string"), F.lit("n/a")) for f in rows.schema]
    line = F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    return rows.select(line.alias("value")).write.mode("overwrite").text(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table of a relational database, read in parallel over ranges of an integer key where one is given."""
    options = {"url": url, "dbtable": table}
    if key:
        options |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()
