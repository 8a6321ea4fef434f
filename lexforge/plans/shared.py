"""SQL twins of the shared views."""

WORKS = """works AS (
  SELECT d.doc_id AS id, string_split(d.text, chr(10))[1] AS title, d.text AS content, d.source AS author, d.lang AS dynasty,
         CASE WHEN l.doc_id IS NULL THEN 'draft' WHEN l.quality = 1 THEN 'published' ELSE 'archived' END AS status, coalesce(l.toxic, 0) = 1 AS deleted
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

LINES = """lines AS (
  SELECT id * 1000000 + n AS chunk_id, id AS work_id, title, author, dynasty, status, deleted, n AS line_no,
         row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS chunk_index, trim(line) AS text
  FROM (SELECT *, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS line FROM (SELECT *, string_split(content, chr(10)) AS a FROM works) x) y
  WHERE trim(line) <> '')"""

QUESTIONS = "questions AS (SELECT item_id AS query_id, trim(string_split(text, '.')[1]) AS question FROM benchmark)"
CONTENT_KEY = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def content_key(column: str) -> str:
    return CONTENT_KEY.format(column)


def folded_lookup(column: str) -> str:
    """The lookup form for the letters of the test tables: of these, case folding and lower case differ for one only."""
    return f"replace(lower(trim({column})), 'ß', 'ss')"


def folded_content(column: str) -> str:
    return content_key(f"replace(lower({column}), 'ß', 'ss')")
