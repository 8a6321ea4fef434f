"""Queries of text functions and chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as t
from ..operators import chunking
from ..sources import sse
from ..sources.ndjson import parsed_lines
from ..sources.tables import line_chunks, load, questions, ranked, works
from .shared import LINES, QUESTIONS, WORKS, content_key


def normalize_content_native(spark, d):
    return load(spark, d, "documents").select("doc_id", t.normalize_content(F.col("text")).alias("key"))


def normalize_full(spark, d):
    """NFKC and case-folded keys of whole texts."""
    return load(spark, d, "documents").select("doc_id", F.sha2(t.normalize_content_full("text"), 256).alias("content_hash"), F.length(t.normalize_lookup_full("text")).alias("lookup_length"))


def content_sha256(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def length_buckets(spark, d):
    """Texts by dynasty and length bucket; every bucket shows, with 0 where it has none."""
    rows = works(spark, d).groupBy("dynasty", t.length_bucket(F.col("content"), 600, 2000).alias("bucket")).agg(F.count("*").alias("n"))
    domain = spark.createDataFrame([("short",), ("medium",), ("long",), ("huge",)], "bucket string")
    dynasties = rows.select("dynasty").distinct()
    return dynasties.crossJoin(F.broadcast(domain)).join(rows, ["dynasty", "bucket"], "left").select("dynasty", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def line_chunk_rows(spark, d):
    return line_chunks(works(spark, d)).select("chunk_id", F.col("id").alias("work_id"), "line_no", "chunk_index", "text")


def paragraph_islands(spark, d):
    """Runs of longer lines without a gap in their numbers."""
    lines = line_chunks(works(spark, d)).where(F.length("text") > 150)
    return chunking.islands(lines, "id", "line_no").groupBy("id", "island").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.count("*").alias("n"))


def verse_heuristic(spark, d):
    verse = t.is_verse(F.col("content"), F.col("title"), most=4000, line_most=400, line_short=330, letters="[a-z]")
    return works(spark, d).select("id", verse.alias("is_verse"))


def citation_markers(spark, d):
    """Ranks cited by answers that are made of a document's length and its id."""
    answer = F.concat(F.lit("see ["), (F.col("doc_id") % 7).cast("string"), F.lit("] and [2, "), (F.col("n_chars") % 5).cast("string"), F.lit("，"), (F.col("doc_id") % 7).cast("string"), F.lit("]"))
    ranks = t.citation_ranks(answer)
    return load(spark, d, "documents").select("doc_id", F.concat_ws(",", F.transform(ranks, lambda r: r.cast("string"))).alias("ranks"), F.forall(ranks, lambda r: r.between(1, 5)).alias("valid"))


def ngram_terms(spark, d):
    run = F.regexp_extract("question", r"[a-z]{5,}", 0)
    return questions(spark, d).select("query_id", F.concat_ws("|", t.gram_terms(run)).alias("terms"))


def literal_extract(spark, d):
    words = F.split("question", " ")
    quoted = F.concat(F.lit("《"), words[0], F.lit('》 "'), F.try_element_at(words, F.lit(2)), F.lit('" “'), words[0], F.lit("” ‘'"), F.lit("’"))
    return questions(spark, d).select("query_id", F.concat_ws("|", t.literals(quoted)).alias("literals"))


def stripped_terms(spark, d):
    return questions(spark, d).select("query_id", t.preview(t.strip_terms(F.lower("question"), ["the", "of", "that", "de", "la"])).alias("rest"))


def name_mapping_default(spark, d):
    return works(spark, d).select("id", t.mapped(F.col("dynasty"), {"en": "English", "de": "German"}).alias("dynasty"))


def props_json_fields(spark, d):
    """Fields of the events' JSON, with the reason where a field is missing."""
    parsed = parsed_lines(load(spark, d, "events").select("event_id", F.col("props").alias("line")), "line")
    return parsed.select("event_id", F.get_json_object("line", "$.k").alias("k"), "error", F.when(F.get_json_object("line", "$.k").isNull(), "missing k").alias("missing"))


def nested_fields(spark, d):
    """A nested and a plain required field of JSON records, with the line in the error where one is missing."""
    kind = F.col("event_type")
    inner = F.when(kind == "click", '{"$oid":7}').when(kind == "view", '"x"').when(kind == "error", '{"$oid":" \\t "}').when(kind == "signup", F.concat(F.lit('{"$oid":" e'), F.col("event_id").cast("string"), F.lit('\\n"}'))).otherwise(F.concat(F.lit('{"$oid":"'), F.col("event_id").cast("string"), F.lit('","n":{}}')))
    record = F.concat(F.lit('{"_id":'), inner, F.when(F.col("user_id") % 3 == 0, ',"name":null').otherwise(F.concat(F.lit(',"name":"'), kind, F.lit(' "'))), F.lit(',"props":'), F.col("props"), F.lit("}"))
    value, line = F.try_parse_json(record), F.col("event_id") + 1
    (source, bad), (name, none) = t.required_text(value, line, "_id", "$oid"), t.required_text(value, line, "name")
    return load(spark, d, "events").select("event_id", source.alias("source_id"), name.alias("name"), F.coalesce(bad, none).alias("error"))


def line_ranges_lateral(spark, d):
    """Ranges of three lines of each document by a table function in a lateral join."""
    tables.register(spark)
    return spark.sql("SELECT doc_id, range_no, first_line, last_line, sha2(r.text, 256) AS text_sha256 FROM {docs} d, LATERAL line_ranges(d.text, 3) r", docs=load(spark, d, "documents").select("doc_id", "text"))


def text_previews(spark, d):
    return load(spark, d, "documents").select("doc_id", t.preview(F.col("text")).alias("preview"))


def poem_chunks(spark, d):
    """All chunks of all works, as made by the packing folds."""
    return chunking.chunk_texts(works(spark, d))


def vector_ids(spark, d):
    name = F.concat_ws(":", F.col("id").cast("string"), F.lit("line"), F.lit("structural_v1"), F.col("chunk_index").cast("string"), F.sha2("text", 256))
    return line_chunks(works(spark, d)).select("chunk_id", t.vector_id("6ba7b811-9dad-11d1-80b4-00c04fd430c8", name).alias("vector_id"))


def redacted_props(spark, d):
    return load(spark, d, "events").select("event_id", t.redacted(F.concat(F.lit('{"api_key":"x","n":'), F.col("event_id").cast("string"), F.lit("}"))).alias("props"))


def sse_encode(spark, d):
    return load(spark, d, "events").select("event_id", sse.encoded(F.col("event_type"), F.col("props")).alias("frame"))


def sse_parse(spark, d):
    """Events of users' streams, written as frames with comments and CRLF and parsed again."""
    events = load(spark, d, "events")
    frame = F.concat(F.lit(": ping\r\n"), F.replace(sse.encoded(F.col("event_type"), F.col("props")), F.lit("\n"), F.lit("\r\n")))
    streams = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", frame.alias("f")))).alias("fs")).select("user_id", F.array_join(F.transform("fs", lambda x: x["f"]), "").alias("stream"))
    return sse.parsed(streams, "user_id", "stream").select("user_id", (F.col("place") + 1).cast("long").alias("place"), "event", "data")


def canonical_snapshot(spark, d):
    """Canonical JSON of works, keys in order and nulls kept, and its hash."""
    payload = F.to_json(F.struct("author", "content", "dynasty", "id", F.when(F.col("deleted"), "yes").alias("note"), "status"), {"ignoreNullFields": "false"})
    return works(spark, d).select("id", F.sha2(payload, 256).alias("content_hash"))


def fixed_report_lines(spark, d):
    """Report lines with six decimals and n/a for null."""
    rows = load(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))), 6).alias("m"), F.count_if(F.col("c_acctbal") > 1e9).alias("n"))
    return rows.select("c_mktsegment", F.concat(F.lit("| "), F.col("c_mktsegment"), F.lit(" | "), F.when(F.col("n") > 0, F.format_string("%.6f", "m")).otherwise("n/a"), F.lit(" | "), F.format_string("%.6f", "m"), F.lit(" |")).alias("line"))


def primary_flags(spark, d):
    """The first of each order's lines in input order is primary."""
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), "l_linenumber", "l_partkey")
    return lines.transform(ranked(F.asc("l_linenumber"), F.asc("l_partkey"))).select("query_id", "l_linenumber", (F.col("rank") == 1).alias("is_primary"))


def natural_shard_order(spark, d):
    """Sources as shard names in natural order: prefix, first number, name."""
    names = works(spark, d).select("author").distinct()
    order = [F.regexp_extract("author", r"^\D*", 0), F.try_element_at(F.regexp_extract_all("author", F.lit(r"(\d+)"), F.lit(1)), F.lit(1)).cast("int"), F.col("author")]
    return names.select("author", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("source_index"))


QUERIES = {f.__name__: f for f in (nested_fields, line_ranges_lateral, normalize_content_native, normalize_full, content_sha256, length_buckets, line_chunk_rows, paragraph_islands, verse_heuristic, citation_markers, ngram_terms, literal_extract, stripped_terms, name_mapping_default, props_json_fields, text_previews, poem_chunks, vector_ids, redacted_props, sse_encode, sse_parse, canonical_snapshot, fixed_report_lines, primary_flags, natural_shard_order)}

GRAMS = """list_distinct(list_concat(CASE WHEN len(r) BETWEEN 2 AND 4 THEN [r] ELSE [] END,
  list_transform(range(1, greatest(len(r), 1)), lambda i: substr(r, CAST(i AS BIGINT), 2)), list_transform(range(1, greatest(len(r) - 1, 1)), lambda i: substr(r, CAST(i AS BIGINT), 3))))"""

ORACLES = {
    "nested_fields": r"""WITH r AS (SELECT *, '{"_id":' || CASE event_type WHEN 'click' THEN '{"$oid":7}' WHEN 'view' THEN '"x"' WHEN 'error' THEN '{"$oid":" \t "}' WHEN 'signup' THEN '{"$oid":" e' || event_id || '\n"}' ELSE '{"$oid":"' || event_id || '","n":{}}' END
        || CASE WHEN user_id % 3 = 0 THEN ',"name":null' ELSE ',"name":"' || event_type || ' "' END || ',"props":' || props || '}' AS j FROM events),
      f AS (SELECT event_id, CASE WHEN json_type(j, '$._id') = 'OBJECT' THEN nullif(trim(CASE WHEN json_type(j, '$._id."$oid"') = 'VARCHAR' THEN json_extract_string(j, '$._id."$oid"') END, ' ' || chr(9) || chr(10)), '') END AS source_id,
        nullif(trim(CASE WHEN json_type(j, '$.name') = 'VARCHAR' THEN json_extract_string(j, '$.name') END), '') AS name, json_type(j, '$._id') <> 'OBJECT' AS flat FROM r)
      SELECT event_id, source_id, name, CASE WHEN flat THEN 'line ' || (event_id + 1) || ': missing _id object' WHEN source_id IS NULL THEN 'line ' || (event_id + 1) || ': missing _id.$oid' WHEN name IS NULL THEN 'line ' || (event_id + 1) || ': missing name' END AS error FROM f""",
    "line_ranges_lateral": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, a, unnest(range(0, (len(a) + 2) // 3)) AS range_no FROM l)
      SELECT doc_id, range_no, range_no * 3 + 1 AS first_line, least(range_no * 3 + 3, len(a)) AS last_line, sha256(array_to_string(a[range_no * 3 + 1 : range_no * 3 + 3], chr(10))) AS text_sha256 FROM r""",
    "vector_ids": f"""WITH {WORKS}, {LINES}, h AS (SELECT chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(work_id || ':line:structural_v1:' || chunk_index || ':' || sha256(text))) AS h FROM lines)
      SELECT chunk_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20], h[21:32]) AS vector_id FROM h""",
    "normalize_content_native": f"SELECT doc_id, {content_key('text')} AS key FROM documents",
    "content_sha256": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "length_buckets": "WITH b AS (SELECT lang AS dynasty, CASE WHEN length(text) < 600 THEN 'short' WHEN length(text) <= 2000 THEN 'medium' ELSE 'long' END AS bucket FROM documents) SELECT y.dynasty, x.bucket, count(b.bucket) AS n FROM (SELECT DISTINCT dynasty FROM b) y CROSS JOIN (VALUES ('short'), ('medium'), ('long'), ('huge')) x(bucket) LEFT JOIN b ON b.dynasty = y.dynasty AND b.bucket = x.bucket GROUP BY 1, 2",
    "line_chunk_rows": f"WITH {WORKS}, {LINES} SELECT chunk_id, work_id, line_no, chunk_index, text FROM lines",
    "paragraph_islands": f"WITH {WORKS}, {LINES}, g AS (SELECT work_id AS id, line_no, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY work_id ORDER BY line_no) > 1 THEN 1 ELSE 0 END AS gap FROM lines WHERE length(text) > 150), s AS (SELECT id, line_no, CAST(sum(gap) OVER (PARTITION BY id ORDER BY line_no) AS BIGINT) AS island FROM g) SELECT id, island, min(line_no) AS line_start, max(line_no) AS line_end, count(*) AS n FROM s GROUP BY 1, 2",
    "verse_heuristic": rf"""WITH {WORKS}, b AS (SELECT id, title, regexp_replace(content, '^\s+|\s+$', '', 'g') AS body FROM works),
        s AS (SELECT *, list_transform(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: length(x)) AS sizes FROM b)
        SELECT id, CASE WHEN body = '' OR length(body) > 4000 THEN false WHEN contains(title, '·') THEN true
          ELSE coalesce(len(sizes) >= 2 AND list_max(sizes) <= 400 AND len(list_filter(sizes, lambda n: n <= 330)) >= 0.8 * len(sizes) AND length(body) - length(regexp_replace(body, '[a-z]', '', 'g')) >= 0.6 * length(body), false) END AS is_verse FROM s""",
    "citation_markers": "SELECT doc_id, CASE WHEN a = 2 AND b = 2 THEN '2' WHEN a = 2 THEN a || ',' || b WHEN b IN (a, 2) THEN a || ',2' ELSE a || ',2,' || b END AS ranks, a BETWEEN 1 AND 5 AND b BETWEEN 1 AND 5 AS valid FROM (SELECT doc_id, doc_id % 7 AS a, n_chars % 5 AS b FROM documents) x",
    "literal_extract": f"""WITH {QUESTIONS}, w AS (SELECT query_id, trim(string_split(question, ' ')[1]) AS a, trim(string_split(question, ' ')[2]) AS b FROM questions)
        SELECT query_id, CASE WHEN b IS NULL THEN '' ELSE concat_ws('|', nullif(a, ''), chr(39), CASE WHEN lower(b) <> lower(a) AND b <> '' THEN b END) END AS literals FROM w""",
    "name_mapping_default": "SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS dynasty FROM documents",
    "props_json_fields": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS error, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing k' END AS missing FROM events",
    "text_previews": r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '...' ELSE t END AS preview FROM f",
    "ngram_terms": f"WITH {QUESTIONS}, r AS (SELECT query_id, regexp_extract(question, '[a-z]{{5,}}') AS r FROM questions), g AS (SELECT query_id, unnest(range(1, greatest(len(r), 1))) AS i, r FROM r) SELECT r.query_id, CASE WHEN len(r.r) >= 2 THEN array_to_string(list_slice(t.terms, 1, 8), '|') ELSE '' END AS terms FROM r LEFT JOIN (SELECT query_id, list(term ORDER BY n, i) AS terms FROM (SELECT query_id, term, min(n) AS n, min(i) AS i FROM (SELECT query_id, substr(r, i, 2) AS term, 2 AS n, i FROM g UNION ALL SELECT query_id, substr(r, i, 3), 3, i FROM g WHERE i <= len(r) - 2) x GROUP BY 1, 2) y GROUP BY 1) t ON t.query_id = r.query_id",
    "stripped_terms": rf"WITH {QUESTIONS}, s AS (SELECT query_id, trim(regexp_replace(replace(replace(replace(replace(replace(lower(question), 'that', ' '), 'the', ' '), 'de', ' '), 'la', ' '), 'of', ' '), '\s+', ' ', 'g')) AS t FROM questions) SELECT query_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '...' ELSE t END AS rest FROM s",
    "redacted_props": """SELECT event_id, '{"api_key":"[REDACTED]","n":' || event_id || '}' AS props FROM events""",
    "sse_encode": "SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events",
    "sse_parse": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, event_type AS event, props AS data FROM events",
    "canonical_snapshot": f"""WITH {WORKS} SELECT id, sha256('{{"author":"' || author || '","content":"' || replace(replace(replace(content, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '","dynasty":"' || dynasty || '","id":' || id || ',"note":' || CASE WHEN deleted THEN '"yes"' ELSE 'null' END || ',"status":"' || status || '"}}') AS content_hash FROM works""",
    "fixed_report_lines": "SELECT c_mktsegment, '| ' || c_mktsegment || ' | n/a | ' || printf('%.6f', round(avg(CASE WHEN c_acctbal > 0 THEN c_custkey END), 6)) || ' |' AS line FROM customer GROUP BY 1",
    "primary_flags": "SELECT l_orderkey AS query_id, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1 AS is_primary FROM lineitem",
    "natural_shard_order": r"SELECT author, row_number() OVER (ORDER BY regexp_extract(author, '^\D*'), CAST(nullif(regexp_extract(author, '(\d+)', 1), '') AS INT), author) - 1 AS source_index FROM (SELECT DISTINCT source AS author FROM documents) x",
}
