"""DuckDB SQL for the operators that SQL can express."""

from .license_scan import BASE, GRAM, NEAR, NOTICES, VERIFIED

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, n, line, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) x) y),
bad AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(bad.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (bad.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN bad ON lines.k = bad.k GROUP BY doc_id"""

URL_FILTER = rf"""
WITH rules(rule, rank, verdict, pattern) AS (VALUES
  ('www.example.com/en/', 0, 'allow', '^(?:[^/]*\.)?www\.example\.com/en/'),
  ('example.com/en/', 1, 'block', '^(?:[^/]*\.)?example\.com/en/'),
  ('net/es/', 2, 'block', '^(?:[^/]*\.)?net/es/'), ('net/fr/', 3, 'block', '^(?:[^/]*\.)?net/fr/'),
  ('com/', 4, 'allow', '^(?:[^/]*\.)?com/'),
  (NULL, 5, 'block', '(?i)(?:^|[^a-z0-9])(?:casino|pills|porn|viagra|torrent|warez|xxx)(?:[^a-z0-9]|$)')),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS whole FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(whole, '^[^/]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(whole, '^[^/]*((?s:.*))$', 1) AS path FROM cut),
best AS (SELECT p.page_id, p.host, p.path, min(r.rank) AS rank FROM parts p LEFT JOIN rules r ON regexp_matches(p.host || p.path, r.pattern) GROUP BY ALL)
SELECT b.page_id, b.host, b.path, r.rule, coalesce(r.verdict, 'allow') AS verdict FROM best b LEFT JOIN rules r ON b.rank = r.rank"""

DECONTAMINATE = rf"""
WITH words AS (
  SELECT kind, id, unnest(range(len(w))) AS p, unnest(w) AS word, len(w) AS n FROM (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark) x),
grams AS (
  SELECT kind, id, p, n, array_to_string(list(word) OVER (PARTITION BY kind, id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING), ' ') AS gram13, word
  FROM words),
items AS (
  SELECT id, least(n, 13) AS len, gram13 AS gram FROM grams WHERE kind = 'b' AND (p + 13 <= n OR (n < 13 AND p = 0))),
lens AS (SELECT DISTINCT len FROM items),
found AS (
  SELECT g.id, g.p, i.len, i.id AS item FROM lens l JOIN grams g ON g.kind = 'd' AND g.p + l.len <= g.n
  JOIN items i ON i.len = l.len AND i.gram = array_to_string(list_slice(string_split(g.gram13, ' '), 1, l.len), ' ')),
hits AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p + len)) AS q FROM found) x GROUP BY id),
named AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS names FROM found GROUP BY id),
sizes AS (SELECT doc_id, len(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS n_words FROM documents)
SELECT s.doc_id, s.n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.names, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= s.n_words AS contaminated
FROM sizes s LEFT JOIN hits h ON h.id = s.doc_id LEFT JOIN named m ON m.id = s.doc_id"""

SUBSTRING_DEDUP = r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word, len(w) AS n FROM docs),
windows AS (
  SELECT doc_id, p, n, word, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING), ' ') AS gram FROM words),
again AS (SELECT gram FROM windows WHERE p + 35 <= n GROUP BY gram HAVING count(*) > 1),
flags AS (SELECT w.doc_id, w.p, w.word, (a.gram IS NOT NULL AND w.p + 35 <= w.n)::INT AS starts FROM windows w LEFT JOIN again a ON a.gram = w.gram),
covered AS (SELECT doc_id, p, word, max(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM flags),
kept AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM covered GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least m ON m.a = e.vec_id"""



def license_scan(templates=BASE + NOTICES) -> str:
    """Votes of template grams on diagonals; over NEAR diagonals each place of a template counts once and its share verifies."""
    shapes, grams = [], []
    for i, t in enumerate(templates):
        words = t.text.split()
        count = len(words) - GRAM + 1
        shapes.append(f"({i}, '{t.label}', {count}, {str(t.exact).lower()})")
        grams += [f"('{' '.join(words[j : j + GRAM])}', {i}, {j})" for j in range(count)]
    return rf"""
WITH grams(gram, template, place) AS (VALUES {", ".join(grams)}), shapes(template, label, grams, exact) AS (VALUES {", ".join(shapes)}),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM docs),
pairs AS (SELECT doc_id, p, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY p) AS gram FROM words),
marks AS (SELECT doc_id, template, p - place AS start, place FROM pairs JOIN grams USING (gram)),
votes AS (SELECT doc_id, template, start, count(*) AS votes FROM marks GROUP BY 1, 2, 3),
merged AS (SELECT v.doc_id, v.template, v.start, v.votes, count(DISTINCT m.place) AS held FROM votes v JOIN marks m ON m.doc_id = v.doc_id AND m.template = v.template AND m.start BETWEEN v.start AND v.start + {NEAR} GROUP BY 1, 2, 3, 4),
spans AS (SELECT doc_id, start, label, exact AND votes = grams AS whole, held::DOUBLE / grams AS share, NOT exact AND held::DOUBLE / grams >= {VERIFIED}::DOUBLE AS verified FROM merged JOIN shapes USING (template)),
found AS (SELECT doc_id, count(*) FILTER (whole) AS n_base, min(start) FILTER (whole) AS first_word, max(start) FILTER (whole) AS last_word, max(share) AS share,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole OR verified) AS labels FROM spans GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM docs d LEFT JOIN found f ON f.doc_id = d.doc_id"""


#: The table of crc32 as a list, and the crc32 of a column of lists of bytes by it.
CRC_TABLE = "crc(t) AS (SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) r(i)) x)"


def crc32(octets: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


def digits(column: str) -> str:
    """The bytes of a number's decimal text."""
    return f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"


def octets(text: str) -> str:
    """The UTF-8 bytes of a text."""
    return f"list_transform(range(CAST(strlen({text}) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"


def leaf(text: str) -> str:
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


def climbed(start: str, runs: str, name: str) -> str:
    """Rows (r, g, idx, lvl, acc, proof) of start led up the runs of a tree; the last level of each r is kept."""
    own = "CAST(f.idx % 8 AS BIGINT)"
    return f"""{name}_all AS ({start} UNION ALL SELECT f.r, f.g, f.idx // 8, f.lvl + 1, sha256(array_to_string(u.run[1:{own}] || [f.acc] || u.run[{own} + 2:], '')), f.proof || array_to_string(u.run[1:{own}] || u.run[{own} + 2:], '')
    FROM {name}_all f JOIN {runs} u ON u.g = f.g AND u.lvl = f.lvl AND u.parent = f.idx // 8),
  {name} AS (SELECT r, g, arg_max(acc, lvl) AS acc, arg_max(proof, lvl) AS proof FROM {name}_all GROUP BY r, g)"""


def raised(leaves: str, name: str) -> str:
    """Nodes and runs of the trees over leaves (g, idx, hash)."""
    return f"""{name} AS (SELECT g, 0 AS lvl, idx, hash, count(*) OVER (PARTITION BY g) AS size FROM {leaves}
    UNION ALL SELECT g, lvl + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), (any_value(size) + 7) // 8 FROM {name} WHERE size > 1 GROUP BY g, lvl, idx // 8),
  {name}_runs AS (SELECT g, lvl, idx // 8 AS parent, list(hash ORDER BY idx) AS run FROM {name} WHERE size > 1 GROUP BY ALL)"""


MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
  d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf, CASE WHEN coalesce({crc32(digits('doc_id'))} % 3 = 0, false) THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS claimed FROM documents, crc),
  leaves AS (SELECT *, leaf AS hash, row_number() OVER () AS r, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
  {raised('leaves', 'nodes')},
  subs AS (SELECT g AS own, hash, '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx FROM nodes WHERE size = 1),
  {raised('subs', 'upper_nodes')},
  {climbed("SELECT r, g, idx, 0 AS lvl, claimed AS acc, '' AS proof FROM leaves", 'nodes_runs', 'low')},
  {climbed("SELECT r, '' AS g, idx, 0 AS lvl, acc, proof FROM low JOIN subs ON subs.own = low.g", 'upper_nodes_runs', 'high')},
  top AS (SELECT hash AS root FROM upper_nodes WHERE size = 1)
SELECT doc_id, leaf, subs.hash AS subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM leaves JOIN high USING (r) JOIN subs ON subs.own = leaves.g, top"""

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
  runs AS (SELECT doc_id, translate(w, '{UPPER}', '{LOWER}') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS w FROM documents) x GROUP BY 1, 2),
  hashed AS (SELECT w, n, {crc32(octets("(CAST(doc_id AS VARCHAR) || ':' || w)"))} AS h FROM runs, crc),
  slips AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
  v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slips WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
  cut AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
  holes AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM cut),
  pairs AS (SELECT a.word, b.word AS near FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT word, rest FROM holes SEMI JOIN v ON v.word = holes.rest UNION SELECT rest, word FROM holes SEMI JOIN v ON v.word = holes.rest),
  ranked AS (SELECT p.word, near, n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY n DESC, near) AS i FROM pairs p JOIN v ON v.word = p.near),
  formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 10 * v.n THEN near END AS form, CASE WHEN r.n >= 10 * v.n THEN r.n END AS form_n FROM v LEFT JOIN ranked r ON r.word = v.word AND r.i = 1),
  follow AS (SELECT word, word AS root, 0 AS hop FROM v UNION ALL SELECT f.word, g.form, hop + 1 FROM follow f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, (SELECT arg_max(root, hop) FROM follow w WHERE w.word = formed.word) AS root FROM formed"""

ORACLES = {
    "op12_merkle": MERKLE,
    "op13_spelling": SPELLING,
    "op5_license_scan": license_scan(),
    "op2_line_dedup": LINE_DEDUP,
    "op3_url_filter": URL_FILTER,
    "op6_embedding_dedup": EMBEDDING_DEDUP,
    "op8_substring_dedup": SUBSTRING_DEDUP,
    "op10_decontaminate": DECONTAMINATE,
}
