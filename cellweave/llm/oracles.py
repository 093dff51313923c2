"""DuckDB texts for the operators whose results SQL can express over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS seq FROM t),
r AS (SELECT doc_id, i, word, seq IS NOT NULL AND row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) > 1 AS again FROM s),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS x FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS x FROM b WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM q),
t AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n)),
h AS (SELECT DISTINCT t.doc_id, t.i, t.n, q.item_id FROM t JOIN q USING (n, x)),
v AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM h) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN v USING (doc_id) LEFT JOIN g USING (doc_id)
"""

LINE_DEDUP = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.doc_id, k.i, k.line, m.last IS NOT NULL AND m.last <> k.doc_id AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id
"""


def _longer(path: str, cost: str, letter: str, line: str) -> str:
    """A path (nine digits of cost, edits, chr(1), lines that each follow a newline) with one more edit."""
    return f"lpad(CAST(CAST(left({path}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || split_part(substr({path}, 10), chr(1), 1) || '{letter}' || chr(1) || split_part({path}, chr(1), 2) || {line}"


def _inserted(paths: str) -> str:
    """The best paths in each state (s0 to s3) after the rows of ``paths``, with inserts."""
    user = ", ".join(_longer(s, "5", "I", "chr(10) || 'user:'") for s in ("s0", "s1", "s3"))
    added = _longer("t2", "5", "I", "chr(10) || 'assistant:'")
    return f"(SELECT * EXCLUDE (t2), t2 AS a2, least(a3, {added}) AS b3 FROM (SELECT *, s0 AS a0, s1 AS a1, s3 AS a3, least(s2, {user}) AS t2 FROM {paths}))"


def _row_edits() -> str:
    kept, more = "chr(10) || role || ':' || text", "CASE fault WHEN 1 THEN 5 ELSE 0 END"
    step = lambda s, letter, initial, role: f"CASE WHEN fault < 2 AND r {'=' if letter == 'K' else '<>'} '{initial}' THEN {_longer(s, more if letter == 'K' else '1 + ' + more, letter, kept if letter == 'K' else f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"
    drop = lambda s: _longer(s, "2", "D", "''")
    user = [step(s, x, "u", "user") for s in ("a0", "a1", "b3") for x in "KR"]
    return f"{drop('a0')} AS s0, least({drop('a1')}, {step('a0', 'K', 's', '')}) AS s1, least({drop('a2')}, {', '.join(user)}) AS s2, least({drop('b3')}, {step('a2', 'K', 'a', 'assistant')}, {step('a2', 'R', 'a', 'assistant')}) AS s3"


_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

CONVERSATION_REPAIR = f"""
WITH RECURSIVE bytes(v, b, step) AS (SELECT CAST(i AS BIGINT), i, 0 FROM range(256) AS r(i) UNION ALL SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b, step + 1 FROM bytes WHERE step < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bytes WHERE step = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc),
hurt AS (SELECT conv_id, turn, kind, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text FROM kinds WHERE kind <> 0),
twice AS (SELECT * FROM hurt UNION ALL SELECT * FROM hurt WHERE kind = 3),
placed AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM twice),
judged AS (SELECT *, CASE WHEN trim(text, {_WHITE}) = '' THEN 2 WHEN nth > 1 THEN 3 WHEN right(rtrim(text, {_WHITE}), 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM placed),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
paths(conv_id, i, s0, s1, s2, s3) AS (SELECT conv_id, CAST(0 AS BIGINT), '000000000' || chr(1), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM sums UNION ALL SELECT conv_id, j, {_row_edits()} FROM (SELECT p.*, q.i AS j, q.role, q.text, q.r, q.fault FROM {_inserted('paths')} AS p JOIN judged AS q ON p.conv_id IS NOT DISTINCT FROM q.conv_id AND q.i = p.i + 1)),
ends AS (SELECT e.conv_id, least(e.a0, e.b3) AS best FROM {_inserted('paths')} AS e JOIN sums AS s ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(split_part(substr(best, 10), chr(1), 1), '') AS audit, sha256(coalesce(substr(split_part(best, chr(1), 2), 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN sums ON c.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN ends ON c.conv_id IS NOT DISTINCT FROM ends.conv_id
"""

RULE_COUNTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1 AS again FROM i),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE again) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_SPACED}') GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""
