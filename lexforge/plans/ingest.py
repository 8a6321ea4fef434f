"""Ingest queries over documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import ingest, retrieval
from ..sources.tables import fresh_folder, line_chunks, load, works
from .shared import LINES, WORKS, content_key


def dedupe_first_wins(spark, d):
    rows = works(spark, d).select("id", "author", t.normalize_lookup(F.col("title")).alias("title_key"), F.sha2(t.normalize_content(F.col("content")), 256).alias("content_key"))
    return ingest.first_wins(rows, ["title_key", "content_key"], "id").select("id", "author")


def bucketed(spark, d):
    return works(spark, d).select("id", "dynasty", t.length_bucket(F.col("content"), 600, 2000).alias("bucket"))


def stratified_quotas(spark, d):
    return ingest.quotas(bucketed(spark, d).groupBy("dynasty").agg(F.count("*").alias("size")), 150)


def stratified_sample(spark, d):
    return ingest.stratified(bucketed(spark, d), 150)


def conversion_pipeline(spark, d):
    """Verse-like works, the first of each title and content, stratified: the conversion from end to end."""
    verse = t.is_verse(F.col("content"), F.col("title"), most=4000, line_most=400, line_short=330, letters="[a-z]")
    rows = works(spark, d).where(verse).select("id", "dynasty", t.length_bucket(F.col("content"), 600, 2000).alias("bucket"), t.normalize_lookup(F.col("title")).alias("title_key"), F.sha2(t.normalize_content(F.col("content")), 256).alias("content_key"))
    return ingest.stratified(ingest.first_wins(rows, ["title_key", "content_key"], "id"), 60).select("id", "dynasty", "bucket")


def candidate_reasons(spark, d):
    """Records by why they are candidates; types are a JSON string or list made of source and language."""
    labels = ingest.label_list(F.when(F.col("deleted"), F.to_json(F.array("author", F.upper("author"), "dynasty", F.lit(" ")))).otherwise(F.concat(F.lit('"'), F.col("author"), F.lit('"'))))
    rows = works(spark, d).withColumn("types", labels)
    reason = ingest.candidate_reason(F.col("types"), F.length("content") < 900, ["src1"], ["src2"], ["src3"], ["c1"])
    return rows.select("id", F.size("types").cast("long").alias("n_types"), reason.alias("reason"))


def staged_and_current(spark, d):
    rows = works(spark, d)
    staged = rows.select("id", "title", F.col("content"), "author", F.lit(True).alias("publish"))
    current = rows.where("status <> 'draft'").select("id", "title", F.when(F.col("deleted"), t.upper_by_letter(F.col("content"))).otherwise(F.col("content")).alias("content"), F.when(F.col("author") != "src3", F.col("author")).alias("author"), "status")
    return staged, current


def import_classify(spark, d):
    staged, current = staged_and_current(spark, d)
    error = F.when(F.length("content") > 15000, "too long")
    return ingest.classify(staged, current, "id", ["title", "content", "author"], error).select("id", "result")


def import_report(spark, d):
    staged, current = staged_and_current(spark, d)
    return ingest.report(ingest.classify(staged, current, "id", ["title", "content", "author"]))


def import_applied(spark, d):
    """The works after an import: merged rows with their versions, once more imported to show that it settles."""
    staged, current = staged_and_current(spark, d)
    current = current.withColumn("version_no", (F.col("id") % 3 + 1).cast("long"))
    compared, error = ["title", "content", "author"], F.when(F.length("content") > 15000, "too long")
    once = ingest.applied(staged, current, "id", compared, error)
    again = ingest.applied(staged, once.drop("result"), "id", compared, error)
    return again.select("id", F.sha2("content", 256).alias("content_hash"), "author", "status", "version_no", "result")


def import_stored(spark, d):
    """The same into a table that is stored, twice; what is in it then, and the second import's results."""
    staged, current = staged_and_current(spark, d)
    path, compared, error = fresh_folder(spark, "import"), ["title", "content", "author"], F.when(F.length("content") > 15000, "too long")
    ingest.create_stored(current.withColumn("version_no", (F.col("id") % 3 + 1).cast("long")), path, "id", 16)
    ingest.apply_stored(staged, path, "id", compared, error, 16)
    again = ingest.apply_stored(staged, path, "id", compared, error, 16).select("id", "result")
    return ingest.stored(spark, path).join(again, "id", "left").select("id", F.sha2("content", 256).alias("content_hash"), "author", "status", "version_no", "result")


def chunks_rebuilt_stored(spark, d):
    """Lines stored as chunks in sixteen folders, and some of these rebuilt, each line with a mark."""
    path, group = fresh_folder(spark, "chunks"), F.col("id") % 16
    lines = line_chunks(works(spark, d)).select(group.cast("int").alias("version_id"), "chunk_id", "text", F.lit(None).cast("string").alias("vector_id"))
    ingest.rewritten(lines, path, "version_id")
    ingest.rebuild_stored(ingest.stored(spark, path).where("version_id % 5 = 0").withColumn("text", F.concat(F.lit("* "), "text")), path)
    return ingest.stored(spark, path).groupBy("version_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("text").startswith("* ")).alias("marked"), F.sum(F.length("text")).alias("letters"))


def chunks_rebuilt(spark, d):
    """Lines as chunks, those of the shorter works rebuilt as one chunk each."""
    lines = line_chunks(works(spark, d)).select(F.col("id").alias("version_id"), "chunk_index", "text", F.lit(None).cast("string").alias("vector_id"))
    made = works(spark, d).where(F.length("content") < 600).select(F.col("id").alias("version_id"), F.lit(0).cast("long").alias("chunk_index"), F.col("content").alias("text"))
    return ingest.rebuilt(lines, made).groupBy("version_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("letters"))


def unchanged_multiset_compare(spark, d):
    """Orders whose lines have the same flags as statuses, as multisets with nulls kept."""
    flags = lambda c: F.sort_array(F.collect_list(F.coalesce(c, F.lit(""))))
    one, other = F.when(F.col("l_returnflag") != "A", "x"), F.when(F.col("l_linestatus") != "F", "x")
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(flags(one).alias("a"), flags(other).alias("b")).select("l_orderkey", (F.col("a").eqNullSafe(F.col("b"))).alias("unchanged"))


def current_version(spark, d):
    return ingest.latest(load(spark, d, "events"), "user_id", "event_id", ["event_id", "event_type", "value"])


def lifecycle_transitions(spark, d):
    commands = F.element_at(F.array(*map(F.lit, ("publish", "unpublish", "delete", "restore", "update"))), (F.length("content") % 5 + 1).cast("int"))
    rows = works(spark, d).select("id", commands.alias("command"), (F.length("title") % 2 + 1).cast("long").alias("expected_version"), "status", F.lit(1).cast("long").alias("version_no"), "deleted")
    return ingest.lifecycle(rows)


def get_or_create_dim(spark, d):
    known = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    names = load(spark, d, "documents").select(F.col("source").alias("name")).union(load(spark, d, "nation").select(F.concat(F.lower("n_name"), F.lit(" "))))
    return ingest.with_keys(names, known, "name", "id")


def seed_repaired(spark, d):
    """Suppliers seeded again after rows were lost, fields had drifted and rows of the table's own had come."""
    suppliers = load(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"))
    drifted = suppliers.where("s_suppkey % 7 > 0").withColumns({"s_name": F.when(F.col("s_suppkey") % 5 > 0, F.col("s_name")), "s_nationkey": F.col("s_nationkey") + F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0)})
    own = suppliers.where("s_suppkey % 11 = 0").withColumn("s_suppkey", -1 - F.col("s_suppkey"))
    return ingest.seeded(drifted.union(own), suppliers.select("s_suppkey", "s_name"), "s_suppkey")


def bulk_case_update(spark, d):
    changes = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit("CHANGED").alias("c_mktsegment")).distinct()
    return ingest.updated(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), changes, "c_custkey", "c_mktsegment")


def vector_upsert(spark, d):
    """Points of one label replaced by scaled ones; the store's dimension and size after it."""
    store = load(spark, d, "embeddings")
    points = store.where("label = 3").select("vec_id", F.transform("embedding", lambda x: x * F.lit(2).cast("float")).alias("embedding"), "label")
    done = ingest.upserted(store, points, "vec_id")
    return done.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("least"), F.max(F.size("embedding")).cast("long").alias("most"), F.round(F.sum(F.element_at("embedding", 1).cast("double")), 4).alias("first"))


def visibility_current_version(spark, d):
    """Lines as chunks of three granularities, several statuses and versions; who may be found, by both rules."""
    g = F.element_at(F.array(*map(F.lit, ("line", "poem", "note"))), (F.col("chunk_index") % 3 + 1).cast("int"))
    rows = line_chunks(works(spark, d)).select(
        "chunk_id", g.alias("granularity"), F.element_at(F.array(*map(F.lit, ("pending", "ready", "failed", "disabled"))), (F.col("line_no") % 4 + 1).cast("int")).alias("chunk_status"), F.when(F.length("text") % 2 == 0, F.col("line_no")).alias("annotation_id"),
        F.when(F.length("text") % 4 == 0, "published").alias("annotation_status"), (F.col("line_no") % 2).alias("version_no"), F.lit(1).alias("work_version_no"), F.col("status").alias("work_status"), F.when(F.col("deleted"), F.lit("2024")).alias("deleted_at"),
    )
    both = rows.select("chunk_id", retrieval.visible().alias("searchable"), retrieval.visible(("ready",)).alias("dense"), retrieval.visible(drafts=True).alias("indexable"))
    return both.where("searchable OR dense OR indexable").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("searchable", "dense", "indexable")})


def annotation_completeness(spark, d):
    filled = lambda c: F.count_if(F.trim(F.coalesce(c, F.lit(""))) != "")
    return load(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), filled(F.col("text")).alias("with_text"), filled(F.when(F.length("text") > 100, F.col("text"))).alias("with_long_text"))


QUERIES = {f.__name__: f for f in (seed_repaired, dedupe_first_wins, stratified_quotas, stratified_sample, conversion_pipeline, candidate_reasons, import_classify, import_report, import_applied, import_stored, chunks_rebuilt, chunks_rebuilt_stored, unchanged_multiset_compare, current_version, lifecycle_transitions, get_or_create_dim, bulk_case_update, vector_upsert, visibility_current_version, annotation_completeness)}

BUCKETED = "bucketed AS (SELECT id, dynasty, title, content, CASE WHEN length(content) < 600 THEN 'short' WHEN length(content) <= 2000 THEN 'medium' ELSE 'long' END AS bucket FROM works)"


def stratified_sql(rows: str, limit: int) -> str:
    return f"""sz AS (SELECT dynasty, count(*) AS size FROM {rows} GROUP BY 1),
      sh AS (SELECT *, {limit} * size / sum(size) OVER () AS share, row_number() OVER (ORDER BY size DESC, dynasty) AS ord, count(*) OVER () AS groups FROM sz),
      seats AS (SELECT *, unnest(range(1, size)) AS k FROM sh), won AS (SELECT dynasty, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY share - k DESC, size - k DESC, ord) AS seat FROM seats) x WHERE seat <= {limit} - groups GROUP BY 1),
      quota AS (SELECT s.dynasty, s.size, 1 + coalesce(won, 0) AS quota FROM sh s LEFT JOIN won USING (dynasty)),
      turns AS (SELECT *, row_number() OVER (PARTITION BY dynasty, bucket ORDER BY id) AS turn FROM {rows}),
      dealt AS (SELECT *, row_number() OVER (PARTITION BY dynasty ORDER BY turn, CASE bucket WHEN 'short' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS seat FROM turns),
      sample AS (SELECT id, dynasty, bucket FROM dealt JOIN quota USING (dynasty) WHERE seat <= quota)"""


VERSE = r"""verse AS (SELECT * FROM (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS body, list_transform(list_filter(list_transform(string_split(regexp_replace(content, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: length(x)) AS sizes FROM bucketed) x
  WHERE CASE WHEN body = '' OR length(body) > 4000 THEN false WHEN contains(title, '·') THEN true ELSE coalesce(len(sizes) >= 2 AND list_max(sizes) <= 400 AND len(list_filter(sizes, lambda n: n <= 330)) >= 0.8 * len(sizes) AND length(body) - length(regexp_replace(body, '[a-z]', '', 'g')) >= 0.6 * length(body), false) END)"""

CLASSIFIED = f"WITH {WORKS}, cur AS (SELECT id, title, CASE WHEN deleted THEN upper(content) ELSE content END AS content, CASE WHEN author <> 'src3' THEN author END AS author, status FROM works WHERE status <> 'draft'), res AS (SELECT w.id, w.content, CASE WHEN c.id IS NULL THEN 'created' WHEN w.title IS NOT DISTINCT FROM c.title AND w.content IS NOT DISTINCT FROM c.content AND w.author IS NOT DISTINCT FROM c.author AND c.status = 'published' THEN 'unchanged' ELSE 'updated' END AS result FROM works w LEFT JOIN cur c ON c.id = w.id)"

IMPORTED = f"""{CLASSIFIED}, now AS (SELECT id, CASE WHEN length(content) > 15000 THEN 'failed' ELSE result END AS result FROM res)
        SELECT w.id, sha256(CASE WHEN n.result IN ('created', 'updated') THEN w.content ELSE c.content END) AS content_hash, CASE WHEN n.result IN ('created', 'updated') THEN w.author ELSE c.author END AS author,
          CASE WHEN n.result IN ('created', 'updated') THEN 'published' ELSE c.status END AS status, CAST(CASE WHEN n.result = 'created' THEN 1 WHEN n.result = 'updated' THEN w.id % 3 + 2 ELSE w.id % 3 + 1 END AS BIGINT) AS version_no,
          CASE WHEN n.result = 'failed' THEN 'failed' ELSE 'unchanged' END AS result FROM works w JOIN now n ON n.id = w.id LEFT JOIN cur c ON c.id = w.id WHERE NOT (n.result = 'failed' AND c.id IS NULL)"""

ORACLES = {
    "seed_repaired": """SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 > 0 THEN CAST(s_nationkey AS BIGINT) + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END END AS s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN 'created' WHEN s_suppkey % 5 = 0 THEN 'repaired' ELSE 'kept' END AS action FROM supplier
      UNION ALL SELECT -1 - s_suppkey, s_name, CAST(s_nationkey AS BIGINT), 'own' FROM supplier WHERE s_suppkey % 11 = 0""",
    "import_applied": IMPORTED,
    "import_stored": IMPORTED,
    "chunks_rebuilt_stored": f"WITH {WORKS}, {LINES}, c AS (SELECT CAST(work_id % 16 AS INT) AS version_id, CASE WHEN work_id % 16 % 5 = 0 THEN '* ' || text ELSE text END AS text FROM lines) SELECT version_id, count(*) AS chunks, count(*) FILTER (starts_with(text, '* ')) AS marked, CAST(sum(length(text)) AS BIGINT) AS letters FROM c GROUP BY 1",
    "chunks_rebuilt": f"WITH {WORKS}, {LINES}, short AS (SELECT id FROM works WHERE length(content) < 600), a AS (SELECT work_id AS version_id, text FROM lines WHERE work_id NOT IN (SELECT id FROM short) UNION ALL SELECT id, content FROM works WHERE length(content) < 600) SELECT version_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS letters FROM a GROUP BY 1",
    "dedupe_first_wins": f"WITH {WORKS} SELECT id, author FROM (SELECT id, author, row_number() OVER (PARTITION BY lower(trim(title)), {content_key('content')} ORDER BY id) AS n FROM works) x WHERE n = 1",
    "stratified_quotas": f"WITH {WORKS}, {BUCKETED}, {stratified_sql('bucketed', 150)} SELECT dynasty, size, quota FROM quota",
    "stratified_sample": f"WITH {WORKS}, {BUCKETED}, {stratified_sql('bucketed', 150)} SELECT id, dynasty, bucket FROM sample",
    "conversion_pipeline": f"WITH {WORKS}, {BUCKETED}, {VERSE}, uniq AS (SELECT id, dynasty, bucket FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(title)), {content_key('content')} ORDER BY id) AS n FROM verse) x WHERE n = 1), {stratified_sql('uniq', 60)} SELECT id, dynasty, bucket FROM sample",
    "candidate_reasons": f"WITH {WORKS} SELECT id, CASE WHEN deleted THEN 2 ELSE 1 END::BIGINT AS n_types, CASE WHEN author = 'src1' THEN 'explicit_prose' WHEN author = 'src2' THEN 'marked' WHEN author = 'src3' OR contains(author, 'c1') THEN 'labelled' WHEN length(content) < 900 THEN 'verse' ELSE 'low_confidence' END AS reason FROM works",
    "import_classify": f"{CLASSIFIED} SELECT id, CASE WHEN length(content) > 15000 THEN 'failed' ELSE result END AS result FROM res",
    "import_report": f"{CLASSIFIED} SELECT count(*) FILTER (result = 'created') AS created, count(*) FILTER (result = 'updated') AS updated, count(*) FILTER (result = 'unchanged') AS unchanged, count(*) FILTER (result = 'failed') AS failed FROM res",
    "unchanged_multiset_compare": "SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'A') = count(*) FILTER (l_linestatus <> 'F') AS unchanged FROM lineitem GROUP BY 1",
    "current_version": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) x WHERE n = 1",
    "lifecycle_transitions": f"""WITH {WORKS}, c AS (SELECT *, ['publish', 'unpublish', 'delete', 'restore', 'update'][length(content) % 5 + 1] AS command, length(title) % 2 + 1 AS expected FROM works),
        e AS (SELECT *, CASE WHEN command = 'restore' AND NOT deleted THEN 'not_deleted' WHEN command <> 'restore' AND deleted THEN 'not_found' WHEN command = 'update' AND expected <> 1 THEN 'version_conflict' WHEN command = 'publish' AND status = 'published' THEN 'invalid_status' WHEN command = 'unpublish' AND status <> 'published' THEN 'invalid_status' END AS error FROM c)
        SELECT id, CASE WHEN error IS NOT NULL THEN status WHEN command = 'publish' THEN 'published' WHEN command IN ('unpublish', 'restore') THEN 'draft' WHEN command = 'delete' THEN 'archived' ELSE status END AS status,
          CAST(1 + CASE WHEN error IS NULL AND command IN ('update', 'delete', 'restore') THEN 1 ELSE 0 END AS BIGINT) AS version_no, CASE WHEN error IS NULL AND command = 'delete' THEN true WHEN error IS NULL AND command = 'restore' THEN false ELSE deleted END AS deleted, error FROM e""",
    "get_or_create_dim": "WITH known AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation), fresh AS (SELECT DISTINCT source AS name FROM documents WHERE lower(trim(source)) NOT IN (SELECT lower(trim(name)) FROM known)) SELECT id, name FROM known UNION ALL SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY lower(trim(name))), name FROM fresh",
    "bulk_case_update": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "vector_upsert": "SELECT label, count(*) AS n, min(len(embedding)) AS least, max(len(embedding)) AS most, round(sum(CAST(CASE WHEN label = 3 THEN 2 ELSE 1 END * embedding[1] AS DOUBLE)), 4) AS first FROM embeddings GROUP BY 1",
    "visibility_current_version": f"""WITH {WORKS}, {LINES}, c AS (SELECT *, ['line', 'poem', 'note'][chunk_index % 3 + 1] AS g, ['pending', 'ready', 'failed', 'disabled'][line_no % 4 + 1] AS s, line_no % 2 = 1 AS cur, length(text) % 4 = 0 AS pub FROM lines),
        v AS (SELECT chunk_id, status = 'published' AND NOT deleted AND cur AND s IN ('pending', 'ready') AND (g <> 'note' OR pub) AS searchable, status = 'published' AND NOT deleted AND cur AND s = 'ready' AND (g <> 'note' OR pub) AS dense, cur AND s IN ('pending', 'ready') AS indexable FROM c)
        SELECT * FROM v WHERE searchable OR dense OR indexable""",
    "annotation_completeness": "SELECT role, count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) <> '') AS with_text, count(*) FILTER (length(text) > 100 AND trim(text) <> '') AS with_long_text FROM conversations GROUP BY 1",
}
