"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

#: A-Z lower-cased, nothing else.
LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = r"regexp_extract_all({x}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BLACK_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"


def words_of(table: str, key: str, pattern: str = ALNUM_WORDS) -> str:
    return f"SELECT {key}, coalesce({pattern.format(x=LOWER.format(x='text'))}, []) AS w FROM {table}"


SQL["op3_decontamination"] = f"""
WITH d AS ({words_of("documents", "doc_id")}),
b AS ({words_of("benchmark", "item_id")}),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, list_aggregate(w[i:i + least(10, len(w)) - 1], 'string_agg', ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, i, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
),
hits AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
n_hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY 1),
items AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(list_aggregate(list_sort(ids), 'string_agg', ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit ON n_hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

SQL["op10_line_dedup"] = f"""
WITH ln AS (
  SELECT doc_id, i - 1 AS line, w, list_aggregate(w, 'string_agg', ' ') AS s, len(w) AS n
  FROM (SELECT doc_id, i, {BLACK_WORDS.format(x=LOWER.format(x="lines[i]"))} AS w
        FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
              FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL)))
  WHERE len(w) >= 1
),
u AS (SELECT s, any_value(w) AS w, any_value(n) AS n, min({{'d': doc_id, 'l': line}}) AS f FROM ln GROUP BY s),
unit AS (SELECT s, f, 'word' AS kind, n AS size FROM u WHERE n >= 8 UNION ALL SELECT s, f, 'char', length(s) FROM u WHERE n < 8 AND length(s) >= 24),
cut AS (
  SELECT s, kind, n AS size, f, i, coalesce(list_aggregate(list_concat(w[1:i - 1], w[i + 1:n]), 'string_agg', ' '), '') AS v
  FROM (SELECT u.*, 'word' AS kind, unnest(range(1, n + 1)) AS i FROM u WHERE n >= 8)
  UNION ALL
  SELECT s, kind, size, f, i, substr(s, 1, i - 1) || substr(s, i + 1)
  FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM unit WHERE kind = 'char')
),
near AS (
  SELECT a.s FROM cut a JOIN cut b ON a.kind = b.kind AND a.v = b.v AND a.i = b.i AND a.size = b.size AND b.f < a.f
  UNION SELECT a.s FROM cut a JOIN unit b ON a.kind = b.kind AND a.v = b.s AND b.f < a.f
  UNION SELECT b.s FROM cut a JOIN unit b ON a.kind = b.kind AND a.v = b.s AND a.f < b.f
),
gone AS (
  SELECT doc_id, line, {{'d': doc_id, 'l': line}} <> u.f AS ex, near.s IS NOT NULL AS nr
  FROM ln JOIN u ON u.s = ln.s LEFT JOIN near ON near.s = ln.s
),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE ex) AS e, count(*) FILTER (WHERE NOT ex) AS m, list(line) AS ls
  FROM gone WHERE ex OR nr GROUP BY 1
)
SELECT d.doc_id, coalesce(e, 0) AS exact_lines, coalesce(m, 0) AS near_lines,
  sha256(CASE WHEN ls IS NULL THEN text ELSE coalesce(list_aggregate(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(ls, i - 1)), 'string_agg', chr(10)), '') END) AS text_sha256
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""

SQL["op2_token_counts"] = r"""
WITH d AS (SELECT source, lang, coalesce(text, '') AS t FROM documents),
c AS (
  SELECT source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words,
    len(regexp_extract_all(t, '[A-Za-z0-9\x{80}-\x{10FFFF}]+')) AS runs,
    (SELECT coalesce(sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))), 0) FROM (SELECT DISTINCT unnest(string_split(t, chr(10))) AS line)) AS once
  FROM d
)
SELECT source, lang, tokenizer_version, CAST(sum(n_docs) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM (
  SELECT source, lang, 'words-1' AS tokenizer_version, CASE WHEN words = 0 OR runs = 0 THEN 0 ELSE 1 END AS n_docs,
    once - CASE WHEN words = 0 OR runs = 0 THEN words ELSE 0 END AS n FROM c
  UNION ALL
  SELECT source, lang, 'runs-1', CASE WHEN words = 0 OR runs = 0 THEN 0 ELSE 1 END, CASE WHEN words = 0 OR runs = 0 THEN 0 ELSE runs END FROM c
) GROUP BY ALL HAVING sum(n_docs) <> 0 OR sum(n) <> 0
"""

#: A path never inserts a turn at these costs (see ``convrepair``), so the recursion has one step a row.
SQL["op13_conversation_repair"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))
),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
),
hashed AS (
  SELECT src.*, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)), CAST(4294967295 AS UBIGINT)) % 20 AS kind
  FROM src, crc_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM damaged)
),
ordered AS (
  SELECT *, left(role, 1) AS letter, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault
  FROM placed
),
moves AS (
  SELECT * FROM (VALUES ('E', 's', 'S'), ('E', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')) AS m(st, letter, nst)
),
edits AS (
  SELECT st, 'D' AS l, NULL AS letter, st AS nst, 2 AS cost FROM (VALUES ('E'), ('S'), ('U'), ('A')) AS s(st)
  UNION ALL SELECT st, 'K', letter, nst, 0 FROM moves
  UNION ALL SELECT st, 'R', NULL, nst, 1 FROM moves WHERE letter <> 's'
),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 'E' AS st, {'c': 0, 'a': ''} AS best FROM ordered
  UNION ALL
  SELECT o.conv_id, o.pos, e.nst, min({'c': d.best.c + e.cost + CASE WHEN e.l <> 'D' AND o.fault = 't' THEN 5 ELSE 0 END, 'a': d.best.a || e.l})
  FROM dp d JOIN ordered o ON o.conv_id IS NOT DISTINCT FROM d.conv_id AND o.pos = d.pos + 1
  JOIN edits e ON e.st = d.st AND (e.l = 'D' OR o.fault NOT IN ('b', 'd') AND (e.l = 'R' OR e.letter = o.letter))
  GROUP BY o.conv_id, o.pos, e.nst
),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(CAST(turn AS HUGEINT)) - min(CAST(turn AS HUGEINT)) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ordered GROUP BY conv_id
),
solved AS (
  SELECT c.conv_id, min(d.best) AS best FROM counted c JOIN dp d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.pos = c.n AND d.st IN ('E', 'A') GROUP BY c.conv_id
),
edited AS (
  SELECT o.conv_id, o.pos, o.role, o.text, substr(s.best.a, o.pos, 1) AS l, o.letter
  FROM ordered o JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
),
numbered AS (
  SELECT *, row_number() OVER w - CAST(first_value(letter = 's' AND l = 'K') OVER w AS INTEGER) AS j FROM edited WHERE l <> 'D' WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS body FROM numbered GROUP BY conv_id
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(s.best.c, 0) AS BIGINT) AS cost, coalesce(s.best.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""
