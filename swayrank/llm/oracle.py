"""SQL for DuckDB that gives the rows of the queries SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from swayrank.llm.quality import BOILERPLATE, NAVIGATION
from swayrank.llm.sharding import fill_table

WORDS = r"'[^\x20\x09-\x0D]+'"


def mixing(table: str = "documents") -> str:
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORDS})), 0)::BIGINT AS size,
    md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM {table}),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, source_size * 2 AS cap,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM totals),
levels AS (SELECT *, cap::DOUBLE / weight::DOUBLE AS level FROM weighted),
cells AS (SELECT level, sum(cap)::BIGINT AS caps, sum(weight)::BIGINT AS weights FROM levels GROUP BY level),
running AS (
  SELECT level, caps, weights, sum(caps) OVER (ORDER BY level)::BIGINT AS cum_caps,
    sum(weights) OVER (ORDER BY level)::BIGINT AS cum_weights, sum(weights) OVER ()::BIGINT AS all_weights,
    (SELECT sum(source_size)::BIGINT::DOUBLE * 1.5::DOUBLE FROM totals) AS wanted
  FROM cells),
candidates AS (
  SELECT level, (wanted - (cum_caps - caps)::DOUBLE) / (all_weights - (cum_weights - weights))::DOUBLE AS common
  FROM running WHERE cum_caps::DOUBLE + level * (all_weights - cum_weights)::DOUBLE >= wanted),
targets AS (
  SELECT source, source_size,
    least(cap::DOUBLE, coalesce(weight::DOUBLE * (SELECT common FROM candidates ORDER BY level LIMIT 1), cap::DOUBLE)) AS target
  FROM levels),
epochs AS (
  SELECT *, floor(target)::BIGINT AS whole, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs
  FROM targets),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized)
SELECT p.doc_id, p.source, p.size, e.source_size, e.target,
  (e.epochs * p.size + greatest(0, least(p.size, e.whole - e.epochs * e.source_size - p.before)))::BIGINT AS taken
FROM placed p JOIN epochs e ON p.source IS NOT DISTINCT FROM e.source"""


def quality(table: str = "documents") -> str:
    boilerplate, navigation = "|".join(BOILERPLATE), "|".join(NAVIGATION)
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS words FROM {table}),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
counted AS (SELECT doc_id, line, regexp_extract_all(line, {WORDS}) AS words FROM split),
judged AS (
  SELECT doc_id, line, len(words) AS n, len(words) > 0 AND (
    NOT regexp_matches(line, '[.!?:;…。！？؟।]')
    OR 100 * len([x for x in words if regexp_matches(x, '[#*$%&|<>]{{2}}|[!?]{{2}}')]) > 30 * len(words)
    OR 100 * len([x for x in words if x IN ('|', '>', '/', '»', '•', '·')]) >= 20 * len(words)
    OR (len(words) <= 20 AND regexp_matches(line, '(?i)({boilerplate})'))
    OR (len(words) <= 4 AND regexp_full_match(trim(line, ' .!?:;' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '(?i)({navigation})'))
  ) AS fails FROM counted),
by_line AS (
  SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines,
    count(*) FILTER (WHERE fails) AS n_failed_lines, coalesce(sum(n) FILTER (WHERE fails), 0) AS n_lost_words
  FROM judged GROUP BY doc_id),
places AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS pos FROM texts),
triples AS (SELECT doc_id, pos, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM places WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
repeats AS (
  SELECT doc_id, pos, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS again FROM triples),
covered AS (
  SELECT doc_id, again OR coalesce(lag(again) OVER w, false) OR coalesce(lag(again, 2) OVER w, false) AS hit
  FROM repeats WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
by_word AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n_repeat_words FROM covered GROUP BY doc_id),
measured AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    n_failed_lines::BIGINT AS n_failed_lines, n_lost_words::BIGINT AS n_lost_words
  FROM texts t LEFT JOIN by_line l ON t.doc_id = l.doc_id LEFT JOIN by_word r ON t.doc_id = r.doc_id),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_lost_words <= 30 * n_words AS kept, n_failed_lines, n_lost_words
FROM based"""


def warc(table: str = "pages") -> str:
    return f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM {table}),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f"""


def substrings(table: str = "documents", window: int = 50) -> str:
    return f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS words FROM {table}),
places AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
starts AS (
  SELECT doc_id, pos, CASE WHEN pos + {window - 1} <= len(words) THEN md5(array_to_string(words[pos : pos + {window - 1}], ' ')) END AS key
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM texts)),
firsts AS (SELECT key, min(doc_id) AS first_id FROM starts WHERE key IS NOT NULL GROUP BY key),
flagged AS (SELECT s.doc_id, s.pos, CASE WHEN f.first_id < s.doc_id THEN 1 ELSE 0 END AS again FROM starts s LEFT JOIN firsts f ON s.key = f.key),
covered AS (
  SELECT doc_id, pos, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM flagged),
kept AS (
  SELECT p.doc_id, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE gone = 0), '') AS rest
  FROM places p JOIN covered c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id"""


def near_vectors(table: str = "embeddings") -> str:
    return f"""
WITH RECURSIVE rows AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM {table}),
usable AS (
  SELECT vec_id, label, v FROM rows
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(v) > 0 AND len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in v if x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reached(node, root) AS (
  SELECT a, a FROM links
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node WHERE r.root < l.b),
components AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
SELECT r.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(k.root, r.vec_id) AS component_id, coalesce(k.root, r.vec_id) = r.vec_id AS kept
FROM rows r LEFT JOIN counts c ON r.vec_id = c.a LEFT JOIN components k ON r.vec_id = k.node"""


def spelling(table: str = "documents") -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE steps(i, v, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
lookup AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[a-z\u00C0-\u00FF]+')) AS run FROM {table}),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    [4294967295::BIGINT] || [('0x' || b)::BIGINT for b in regexp_extract_all(hex(encode(doc_id || ':' || run)), '..')],
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM counted, lookup),
thinned AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM words, range(length(word)) t(i)),
near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
ranked AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place
  FROM near p JOIN words w ON p.near = w.word),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form,
    CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.place = 1),
chains(word, place) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chains c JOIN formed f ON c.place = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.place AS root
FROM formed f JOIN chains c ON f.word = c.word JOIN formed last ON c.place = last.word AND last.form IS NULL"""


def placement(shards: Sequence[str], size: int, table: str = "documents") -> str:
    """The lookup table is the one of the operator, as a list; its filling turn by turn is tested on its own."""
    names = ", ".join(f"'{name}'" for name in shards)
    return f"""
WITH held AS (SELECT [{names}] AS names, [{", ".join(map(str, fill_table(shards, size)))}] AS slots),
placed AS (
  SELECT doc_id, source, ((('0x' || left(md5(coalesce(doc_id::VARCHAR, 'null')), 15))::BIGINT) % {size})::INT AS slot FROM {table})
SELECT doc_id, source, slot, names[slots[slot + 1] + 1] AS shard FROM placed, held"""
