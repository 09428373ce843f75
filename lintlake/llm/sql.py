"""SQL of the queries that SQL can express."""

from .licenses import DRIFT, LOWER, MIN_SHARE, PHRASES, TEMPLATES, UPPER
from .sharding import SHARD_BYTES

_TEMPLATES = ", ".join(f"({exact}, {n}, '{words}', '{label}')" for n, (exact, (words, label)) in enumerate([("true", x) for x in PHRASES] + [("false", x) for x in TEMPLATES]))

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op3_quality": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
grams AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 2)
),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT g.doc_id, g.i + j.j AS w FROM grams g JOIN twice t ON g.doc_id = t.doc_id AND g.g = t.g CROSS JOIN (VALUES (0), (1), (2)) j(j)
  ) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS n_distinct
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
m AS (
  SELECT d.doc_id, d.source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(l.n - l.n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN rep r USING (doc_id)
),
j AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (n_symbols > 0.1::DOUBLE * n_words)::INT + (n_dup_lines > 0.3::DOUBLE * n_lines)::INT
    + (NOT (word_chars::DOUBLE / greatest(n_words, 1) BETWEEN 2 AND 15))::INT AS soft_failures
  FROM m
),
h AS (SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR soft_failures > 0)::INT)::DOUBLE AS f FROM j GROUP BY source),
t AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS k, sum(n * n) AS n2, sum(n * (f / n) * (f / n)) AS r2 FROM h),
v AS (
  SELECT f / n AS mean, r2 - n * (f / n) * (f / n) AS spread, (f / n) * (1 - f / n) * (k - 1) AS chance, (f / n) * (1 - f / n) * (n - n2 / n) AS whole FROM t
),
p AS (
  SELECT mean, 1 / (CASE WHEN whole > chance THEN least(greatest((spread - chance) / (whole - chance), 1e-6), 0.999::DOUBLE) ELSE 1e-6 END) - 1 AS strength FROM v
),
rates AS (SELECT source, (f + mean * strength) / (n + strength) AS host_rate FROM h CROSS JOIN p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND soft_failures <= CASE WHEN host_rate > 0.5 THEN 0 ELSE 1 END AS kept,
  soft_failures, round(host_rate, 6) AS host_rate
FROM j JOIN rates ON j.source IS NOT DISTINCT FROM rates.source
""",
    "op5_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
texts AS (SELECT text, min(doc_id) AS least, count(*) AS copies FROM d GROUP BY text),
w AS (SELECT least AS id, {_WORDS} AS ws FROM texts),
s AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
pairs AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.id = x JOIN n ny ON ny.id = y WHERE c >= 0.8::DOUBLE * (nx.n + ny.n - c) - 1e-9),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
class AS (SELECT x, min(y) AS least FROM reach GROUP BY x),
degree AS (SELECT x, sum(copies) AS n FROM both_ways JOIN texts ON texts.least = y GROUP BY x)
SELECT d.doc_id,
  CASE WHEN len(ws) = 0 THEN d.doc_id ELSE least(t.least, coalesce(class.least, t.least)) END AS class_id,
  CASE WHEN len(ws) = 0 THEN 0 ELSE coalesce(degree.n, 0) + t.copies - 1 END::BIGINT AS n_links
FROM d JOIN texts t ON d.text = t.text JOIN w ON w.id = t.least LEFT JOIN class ON class.x = t.least LEFT JOIN degree ON degree.x = t.least
""",
    "op7_substrings": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS w FROM win SEMI JOIN rep USING (h) CROSS JOIN (SELECT unnest(range(35)) AS j)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS w FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY w) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, w) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op9_sharding": f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    (16 + strlen(coalesce(text, '')) + strlen(coalesce(lang, '')) + strlen(coalesce(source, '')))::BIGINT AS row_bytes,
    ('0x' || substr(md5(concat_ws(chr(31), coalesce('=' || doc_id, '-'), '=' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents
),
levels AS (SELECT doc_id, n_bytes, row_bytes, h, bits, sum(row_bytes) OVER (PARTITION BY bits, h >> (60 - bits)) AS size FROM d CROSS JOIN (SELECT unnest(range(0, 61)) AS bits)),
placed AS (SELECT doc_id, n_bytes, row_bytes, h, min(bits)::INT AS depth FROM levels WHERE size <= {SHARD_BYTES} GROUP BY ALL),
named AS (SELECT doc_id, n_bytes, row_bytes, depth, substr(lpad(bin(h), 60, '0'), 1, depth) AS shard FROM placed)
SELECT doc_id, n_bytes, row_bytes, shard, depth, 0::BIGINT AS overflow,
  count(*) OVER (PARTITION BY shard, depth) AS shard_rows, sum(row_bytes) OVER (PARTITION BY shard, depth)::BIGINT AS shard_bytes
FROM named
""",
    "op10_licenses": rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
),
templates(exact, template, words, label) AS (VALUES {_TEMPLATES}),
t AS (SELECT *, string_split(words, ' ') AS tw FROM templates),
grams AS (
  SELECT template, label, exact, len(tw) - 2 AS grams, i - 1 AS q, array_to_string(tw[i:i + 2], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(tw) - 1)) AS i FROM t)
),
rolled AS (SELECT doc_id, i - 1 AS pos, array_to_string(ws[i:i + 2], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 2)),
hits AS (SELECT doc_id, template, label, exact, grams, pos, q, pos - q AS diagonal FROM rolled JOIN grams USING (gram)),
marked AS (
  SELECT *, (exact OR coalesce(diagonal - lag(diagonal) OVER w > {DRIFT}, true))::INT AS new FROM (SELECT DISTINCT doc_id, template, exact, diagonal FROM hits)
  WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)
),
bands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS band FROM marked),
spans AS (
  SELECT doc_id, template, label, exact, grams, band, count(DISTINCT q) AS votes, min(pos) AS first_pos, max(pos) AS last_pos
  FROM hits JOIN bands USING (doc_id, template, exact, diagonal) GROUP BY ALL
),
good AS (SELECT *, votes::DOUBLE / grams AS share FROM spans WHERE CASE WHEN exact THEN votes = grams ELSE votes::DOUBLE / grams >= {MIN_SHARE}::DOUBLE AND last_pos - first_pos + 1 <= 2 * grams END),
found AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(first_pos) FILTER (exact) AS first_word, max(first_pos) FILTER (exact) AS last_word,
    list_sort(list(DISTINCT label) FILTER (exact)) AS base, list_sort(list(DISTINCT label)) AS every, max(share) AS score
  FROM good GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels, coalesce(array_to_string(every, ','), '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN found USING (doc_id)
""",
}
