"""Catalogue queries over works, customers and orders."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import catalog
from ..sources.tables import line_chunks, load, works
from .shared import LINES, WORKS


def works_public_page(spark, d):
    rows = works(spark, d).where((F.col("status") == "published") & ~F.col("deleted")).select("id", "title", "author", "dynasty")
    return catalog.page(rows, 2, 20, F.desc("id"))


def works_search_disjunctive(spark, d):
    """Orders whose priority holds a text, or whose customer or customer's nation has a name that does."""
    customers, nations = load(spark, d, "customer"), load(spark, d, "nation")
    named = customers.where(F.contains(F.lower("c_name"), F.lit("0000001"))).select("c_custkey")
    of_nation = customers.join(nations.where(F.contains(F.lower("n_name"), F.lit("an"))), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return catalog.matching_any(orders, F.contains(F.lower("o_orderpriority"), F.lit("urgent")), (named, "o_custkey", "c_custkey"), (of_nation, "o_custkey", "c_custkey"))


def author_work_counts(spark, d):
    customers = load(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"))
    orders = load(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("author_id"))
    return catalog.counted(customers, orders, "author_id", "work_count")


def category_counts_bridge(spark, d):
    orders = load(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    bridge = load(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_partkey").alias("category_id"))
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("category_id"), F.col("p_brand").alias("name"))
    return catalog.counted(parts, bridge, "category_id", "work_count")


def dynasty_counts_all(spark, d):
    return works(spark, d).groupBy("dynasty").agg(F.count("*").alias("work_count"))


def work_with_relations_nested(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey")
    found = catalog.nested(orders, lines, "id", ["l_linenumber", "l_partkey"], "parts")
    return found.select("id", "status", F.size("parts").cast("long").alias("n_parts"), F.concat_ws(",", F.transform("parts", lambda p: F.concat_ws(":", p["l_linenumber"].cast("string"), p["l_partkey"].cast("string")))).alias("parts"))


def category_ancestors_recursive(spark, d):
    """Customers under nations under regions as one tree; ids are made apart by offsets."""
    customers = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.lit(-1000) - F.col("c_nationkey")).cast("long").alias("parent_id"))
    nations = load(spark, d, "nation").select((F.lit(-1000) - F.col("n_nationkey")).cast("long").alias("id"), (F.lit(-10) - F.col("n_regionkey")).cast("long").alias("parent_id"))
    regions = load(spark, d, "region").select((F.lit(-10) - F.col("r_regionkey")).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"))
    return catalog.ancestors(customers.union(nations).union(regions)).withColumn("hops", F.col("hops").cast("long"))


def author_like_unescaped(spark, d):
    return load(spark, d, "customer").where(F.lower("c_name").like("%c%0_1%")).select("c_custkey", "c_name")


def concat_search(spark, d):
    joined = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return load(spark, d, "part").where(F.contains(joined, F.lit("brand#1"))).select("p_partkey", "p_name")


def pending_versions_distinct(spark, d):
    return load(spark, d, "lineitem").where("l_linestatus = 'O' AND l_returnflag = 'N'").select(F.col("l_orderkey").alias("version_id")).distinct().orderBy("version_id")


def batch_key_lookup_semi(spark, d):
    asked = load(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return load(spark, d, "documents").join(asked, "doc_id", "left_semi").select("doc_id", "source", "n_chars")


def bulk_facets(spark, d):
    """Lines of published works by author and dynasty, with both facets' own totals in one pass."""
    lines = line_chunks(works(spark, d).where((F.col("status") == "published") & ~F.col("deleted")))
    return lines.groupBy("author", "dynasty").agg(F.count("*").alias("n_lines"), F.countDistinct("id").alias("n_works"))


def entity_resolution(spark, d):
    """Nation names to ids, where exactly one nation has that name."""
    nations = load(spark, d, "nation")
    terms = load(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit(" "), F.upper("n_name")).alias("term"))
    return catalog.resolve_names(terms, nations.select("n_name", "n_nationkey"), "term", "n_name", "n_nationkey")


def all_keys_found(spark, d):
    """Whether every line of an order names a part that exists."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    parts = load(spark, d, "part").where("p_size > 3").select("p_partkey")
    found = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return found.groupBy("l_orderkey").agg((F.count("p_partkey") == F.count("*")).alias("complete"))


def conversations_recent(spark, d):
    """The fifty conversations with the most turns, ties by id downwards."""
    found = load(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("turns"))
    return found.orderBy(F.desc_nulls_last("last_turn"), F.desc("turns"), F.desc("conv_id")).limit(50)


def works_admin_page(spark, d):
    """All orders, the last changed first; ties by id downwards."""
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"), "o_orderstatus")
    return catalog.page(rows, 3, 25, F.desc("updated_at"), F.desc("id"))


def authors_by_name(spark, d):
    """Suppliers by name, then id, with their place in this order; only the first page is sorted on the driver's side."""
    rows = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return catalog.page(rows, 1, 50, F.asc("name"), F.asc("id"))


def dimensions_in_order(spark, d):
    """Nations by their region's place, then id."""
    rows = load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("sort_order"), F.col("n_name").alias("name"))
    return rows.orderBy("sort_order", "id")


def chunks_in_order(spark, d):
    """The first chunks to index: by granularity, place and id; whole texts are longer lines here."""
    kind = F.when(F.length("text") > 400, "poem").otherwise("line")
    rows = line_chunks(works(spark, d)).select("chunk_id", F.col("id").alias("version_id"), "chunk_index", kind.alias("granularity"))
    return rows.orderBy("granularity", "chunk_index", "chunk_id").limit(200)


def works_of_author(spark, d):
    """The public works of one author, the newest first."""
    rows = works(spark, d).where((F.col("author") == "src1") & (F.col("status") == "published") & ~F.col("deleted"))
    return rows.select("id", "title", "dynasty").orderBy(F.desc("id")).limit(100)


def conversation_of_owner(spark, d):
    """One conversation by its id, only where its first turn is of the role that may see it; a point get by two keys."""
    rows = load(spark, d, "conversations").where("conv_id = 7")
    owner = rows.where("turn = 0 AND role = 'user'").select("conv_id")
    return rows.join(owner, "conv_id", "left_semi").select("conv_id", "turn", "role")


def observed_batch(spark, d):
    """Figures of a batch as it is written: rows, slowest and mean latency by kind, without a second pass over it."""
    seen = Observation("batch")
    rows = load(spark, d, "events").select("event_type", "value").observe(seen, F.count("*").alias("n"), F.max("value").alias("most"), F.sum("value").alias("total"))
    rows.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["n"], got["most"], round(got["total"], 3))], "n long, most double, total double")


QUERIES = {f.__name__: f for f in (works_public_page, works_search_disjunctive, author_work_counts, category_counts_bridge, dynasty_counts_all, work_with_relations_nested, category_ancestors_recursive, author_like_unescaped, concat_search, pending_versions_distinct, batch_key_lookup_semi, bulk_facets, entity_resolution, all_keys_found, conversations_recent, works_admin_page, authors_by_name, dimensions_in_order, chunks_in_order, works_of_author, conversation_of_owner, observed_batch)}

ORACLES = {
    "works_admin_page": "SELECT o_orderkey AS id, o_orderdate AS updated_at, o_orderstatus, (SELECT count(*) FROM orders) AS total, (SELECT CAST(ceil(count(*) / 25.0) AS BIGINT) FROM orders) AS total_pages FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50",
    "authors_by_name": "SELECT s_suppkey AS id, s_name AS name, (SELECT count(*) FROM supplier) AS total, (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) FROM supplier) AS total_pages FROM supplier ORDER BY s_name, s_suppkey LIMIT 50",
    "dimensions_in_order": "SELECT n_nationkey AS id, n_regionkey AS sort_order, n_name AS name FROM nation ORDER BY 2, 1",
    "chunks_in_order": f"WITH {WORKS}, {LINES} SELECT chunk_id, work_id AS version_id, chunk_index, CASE WHEN length(text) > 400 THEN 'poem' ELSE 'line' END AS granularity FROM lines ORDER BY 4, 3, 1 LIMIT 200",
    "works_of_author": f"WITH {WORKS} SELECT id, title, dynasty FROM works WHERE author = 'src1' AND status = 'published' AND NOT deleted ORDER BY id DESC LIMIT 100",
    "conversation_of_owner": "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7 AND EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = 7 AND c.turn = 0 AND c.role = 'user')",
    "observed_batch": "SELECT count(*) AS n, max(value) AS most, round(sum(value), 3) AS total FROM events",
    "works_public_page": f"WITH {WORKS}, p AS (SELECT id, title, author, dynasty FROM works WHERE status = 'published' AND NOT deleted) SELECT p.*, (SELECT count(*) FROM p) AS total, (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) FROM p) AS total_pages FROM p ORDER BY id DESC LIMIT 20 OFFSET 20",
    "works_search_disjunctive": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'urgent') OR o_custkey IN (SELECT c_custkey FROM customer WHERE contains(lower(c_name), '0000001')) OR o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name), 'an'))",
    "author_work_counts": "SELECT c_custkey AS author_id, c_name AS name, coalesce(n, 0) AS work_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) x ON x.o_custkey = c_custkey",
    "category_counts_bridge": "SELECT p_partkey AS category_id, p_brand AS name, coalesce(n, 0) AS work_count FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY 1) x ON x.l_partkey = p_partkey",
    "dynasty_counts_all": "SELECT lang AS dynasty, count(*) AS work_count FROM documents GROUP BY lang",
    "work_with_relations_nested": "SELECT o_orderkey AS id, o_orderstatus AS status, coalesce(n, 0) AS n_parts, coalesce(p, '') AS parts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey",
    "category_ancestors_recursive": """WITH RECURSIVE nodes AS (SELECT c_custkey AS id, CAST(-1000 - c_nationkey AS BIGINT) AS parent_id FROM customer UNION ALL SELECT -1000 - n_nationkey, -10 - n_regionkey FROM nation UNION ALL SELECT -10 - r_regionkey, NULL FROM region),
        walk AS (SELECT id, parent_id AS ancestor_id, CAST(1 AS BIGINT) AS hops FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT w.id, n.parent_id, w.hops + 1 FROM walk w JOIN nodes n ON n.id = w.ancestor_id WHERE n.parent_id IS NOT NULL AND w.hops < 32)
        SELECT id, ancestor_id, hops, id = ancestor_id AS cycle FROM walk""",
    "author_like_unescaped": "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%c%0_1%'",
    "concat_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')",
    "pending_versions_distinct": "SELECT DISTINCT l_orderkey AS version_id FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N' ORDER BY 1",
    "batch_key_lookup_semi": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
    "bulk_facets": f"WITH {WORKS}, {LINES} SELECT author, dynasty, count(*) AS n_lines, count(DISTINCT work_id) AS n_works FROM lines WHERE status = 'published' AND NOT deleted GROUP BY 1, 2",
    "entity_resolution": "SELECT c.c_custkey, ' ' || upper(n.n_name) AS term, x.k AS n_nationkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN (SELECT lower(trim(n_name)) AS key, min(n_nationkey) AS k FROM nation GROUP BY 1 HAVING count(*) = 1) x ON x.key = lower(trim(n.n_name))",
    "all_keys_found": "SELECT l_orderkey, bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 3)) AS complete FROM lineitem GROUP BY 1",
    "conversations_recent": "SELECT conv_id, max(turn) AS last_turn, count(*) AS turns FROM conversations GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 3 DESC, 1 DESC LIMIT 50",
}
