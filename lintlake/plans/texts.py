"""Queries over the texts of documents and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import extension
from lintlake.operators import clones
from lintlake.plans.corpus import LINES_SQL, sources

#: Words that a list of named values holds, by list; the first list wins. Fixed values.
VOCABULARY = {"Status": ("active", "error", "on", "in"), "Article": ("the", "la", "le", "die", "der"), "Event": ("click", "view", "on", "le")}
_TAG = "<([a-zA-Z][a-zA-Z0-9]*)"


def _pages(s, d):
    return s.read.parquet(f"{d}/pages.parquet")


def inventory_select_topk(s, d):
    files = sources(s, d).select("path", F.octet_length("content").alias("size"))
    return files.filter(extension(F.col("path")).isin(".en", ".de") & (F.col("size") <= 500 * 1024)).orderBy(F.lower("path"), "path").limit(5000)


def ext_filter(s, d):
    return sources(s, d).groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n_files"), F.sum(F.octet_length("content")).alias("bytes"))


def html_tag_stats(s, d):
    tags = _pages(s, d).select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_TAG), 1)).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


def html_h1_singleton(s, d):
    return _pages(s, d).select("page_id", F.regexp_count("html", F.lit("<h1")).cast("long").alias("n_h1"), (F.regexp_count("html", F.lit("<h1")) != 1).alias("violates"))


def html_meta_missing(s, d):
    html = F.lower("html")
    return _pages(s, d).select("page_id", (~html.rlike('name="description"')).alias("no_description"), (~html.rlike('rel="canonical"')).alias("no_canonical"), (~html.rlike("<html[^>]* lang=")).alias("no_lang"))


def html_link_edges(s, d):
    links = _pages(s, d).select("url", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)).alias("href"))
    return links.groupBy("url", "href").agg(F.count("*").alias("n"))


def html_list_children(s, d):
    return _pages(s, d).select(
        "page_id",
        F.regexp_count("html", F.lit("<li[ >]")).cast("long").alias("n_items"),
        F.regexp_count("html", F.lit("<(ul|ol)[ >]")).cast("long").alias("n_lists"),
        (F.regexp_count("html", F.lit("<b>")) - F.regexp_count("html", F.lit("</b>"))).cast("long").alias("unclosed_b"),
    )


def string_literal_contexts(s, d):
    raw = sources(s, d).select("path", F.explode(F.regexp_extract_all("content", F.lit("(token|key|email|card)[ :=]+"), 1)).alias("context"))
    return raw.groupBy("context").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"))


def enum_vocab_tag(s, d):
    rows = [(w, name, i) for i, (name, ws) in enumerate(VOCABULARY.items()) for w in ws]
    vocabulary = s.createDataFrame(rows, "word string, enum string, ord int")
    # a literal table of this module
    words = sources(s, d).select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit("([a-z]+)"), 1)).alias("word"))
    counts = words.join(F.broadcast(vocabulary.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    first = vocabulary.groupBy("word").agg(F.min_by("enum", "ord").alias("enum"))
    return counts.join(first, "word").select("word", "enum", "n")


def clone_windows(s, d):
    w = clones.windows(sources(s, d))
    return w.groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).filter("n > 1")


def clone_pairs(s, d):
    return clones.pairs(clones.windows(sources(s, d))).groupBy("a", "b").agg(F.count("*").alias("n_windows"))


def clone_runs(s, d):
    return clones.runs(clones.pairs(clones.windows(sources(s, d))))


def clone_members(s, d):
    return clones.members(clones.windows(sources(s, d)))


def _intervals(s, d):
    """Both sides of each run: as `clone_runs` and the SQL, of a window's first places. `clones.shared_intervals` covers all places."""
    return clones.intervals(clones.runs(clones.pairs(clones.windows(sources(s, d)))))


def clone_interval_union(s, d):
    return clones.covered(_intervals(s, d))


def duplication_pct(s, d):
    tokens = sources(s, d).select("path", F.size(F.filter(F.split("content", r"[\x20\x09-\x0D]+"), lambda t: t != "")).alias("n"))
    dup = clones.covered(_intervals(s, d)).groupBy("path").agg(F.sum(F.col("last") - F.col("first") + 1).alias("duplicated"), F.count("*").alias("n_blocks"))
    return dup.join(tokens, "path").select("path", "duplicated", "n_blocks", F.bround(F.col("duplicated") / F.col("n") * 100, 4).alias("pct"))


def file_metrics(s, d):
    lines = F.split("content", "\n")
    m = sources(s, d).select("path", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long").alias("n_blank"), F.array_max(F.transform(lines, F.char_length)).cast("long").alias("longest"))
    return m.withColumn("n_code", F.col("n_lines") - F.col("n_blank"))


def project_metrics(s, d):
    m = file_metrics(s, d)
    return m.agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.bround(F.avg("n_code"), 4).alias("avg_code"), F.max("longest").alias("longest"), F.bround(F.least(F.lit(1.0), F.sum("n_blank") / F.sum("n_code")) * 100, 4).alias("blank_pct"))


def role_assignment(s, d):
    c = F.col("content")
    roles = F.array_compact(F.array(F.when(c.rlike("(Licensed|Released) under"), F.lit("licensed")), F.when(c.rlike("[0-9a-f]{40}"), F.lit("secret")), F.when(c.rlike("!!"), F.lit("loud")), F.when(F.char_length(c) > 2000, F.lit("long"))))
    return sources(s, d).select("path", F.explode(roles).alias("role"))


def context_marker_argmax(s, d):
    t = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    score = lambda *words: sum((F.regexp_count("t", F.lit(f"(^|[ \n]){w}[ ,.]")) * k for w, k in words), F.lit(0)).cast("long")
    scored = t.select("doc_id", score(("the", 2), ("and", 1)).alias("en"), score(("der", 2), ("und", 1)).alias("de"), score(("le", 2), ("une", 1)).alias("fr"), score(("los", 2), ("una", 1)).alias("es"))
    best = F.greatest("en", "de", "fr", "es")
    profile = F.when(best == 0, "unknown").when(F.col("en") == best, "en").when(F.col("de") == best, "de").when(F.col("fr") == best, "fr").otherwise("es")
    return scored.select("doc_id", profile.alias("profile"), best.alias("best"))


def contract_array_except(s, d):
    words = lambda side: s.read.parquet(f"{d}/conversations.parquet").filter(F.col("role") == side).groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)))).alias(side))
    return words("user").join(words("assistant"), "conv_id").select("conv_id", F.size(F.array_except("user", "assistant")).cast("long").alias("n_unanswered"), F.size(F.array_intersect("user", "assistant")).cast("long").alias("n_shared"))


def filter_signature_dup(s, d):
    sig = sources(s, d).select("path", F.concat_ws(" ", F.slice(F.split("content", " "), 1, 5)).alias("signature"))
    return sig.groupBy("signature").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).filter("n > 1")


_SRC = "src AS (SELECT 'doc/' || doc_id || '.' || lang AS path, coalesce(text, '') AS content FROM documents)"
_WIN = _SRC + r""",
tok AS (SELECT path, regexp_extract_all(content, '[^\x20\x09-\x0D]+') AS t FROM src),
win AS (
  SELECT path, i::INT AS idx, substr(sha256(array_to_string(t[i * 25 + 1:i * 25 + 50], ' ')), 1, 16) AS hash
  FROM (SELECT path, t, unnest(range(0, (len(t) - 50) // 25 + 1)) AS i FROM tok WHERE len(t) >= 50)
)"""
_PAIRS = _WIN + """,
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path, idx) AS n FROM win) WHERE n <= 16),
pairs AS (SELECT a.path AS a, b.path AS b, a.idx AS ia, b.idx AS ib, a.hash FROM firsts a JOIN firsts b ON a.hash = b.hash AND a.path < b.path)"""
_RUNS = _PAIRS + """,
steps AS (
  SELECT *, CASE WHEN ia - lag(ia) OVER w = 1 AND ib - lag(ib) OVER w = 1 THEN 0 ELSE 1 END AS fresh FROM pairs WINDOW w AS (PARTITION BY a, b ORDER BY ia, ib, hash)
),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY a, b ORDER BY ia, ib, hash ROWS UNBOUNDED PRECEDING) AS run FROM steps),
runs AS (SELECT a, b, min(ia) AS first_a, min(ib) AS first_b, count(*) AS n_windows, 50 + (count(*) - 1) * 25 AS n_tokens FROM islands GROUP BY a, b, run HAVING count(*) >= 2)"""
_COVER = _RUNS + """,
spans AS (
  SELECT a AS path, first_a * 25 AS first, first_a * 25 + n_tokens - 1 AS last FROM runs UNION ALL SELECT b, first_b * 25, first_b * 25 + n_tokens - 1 FROM runs
),
marked AS (
  SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY path ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans
),
cover AS (
  SELECT path, min(first) AS first, max(last) AS last FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS i FROM marked) GROUP BY path, i
)"""


def _n(pattern: str, text: str = "html") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _marks(*words) -> str:
    return " + ".join(f"{_n(f'(^|[ {chr(10)}]){w}[ ,.]', 't')} * {k}" for w, k in words)


SQL = {
    "inventory_select_topk": f"WITH {_SRC} SELECT path, octet_length(content::BLOB)::INT AS size FROM src WHERE (path LIKE '%.en' OR path LIKE '%.de') AND octet_length(content::BLOB) <= 512000 ORDER BY lower(path), path LIMIT 5000".replace("content::BLOB", "encode(content)"),
    "ext_filter": f"WITH {_SRC} SELECT '.' || string_split(path, '.')[2] AS ext, count(*) AS n_files, sum(octet_length(encode(content)))::BIGINT AS bytes FROM src GROUP BY ext",
    "html_tag_stats": f"WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '{_TAG}', 1))) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM t GROUP BY tag",
    "html_h1_singleton": f"SELECT page_id, {_n('<h1')} AS n_h1, {_n('<h1')} <> 1 AS violates FROM pages",
    "html_meta_missing": """SELECT page_id, NOT regexp_matches(lower(html), 'name="description"') AS no_description, NOT regexp_matches(lower(html), 'rel="canonical"') AS no_canonical,
  NOT regexp_matches(lower(html), '<html[^>]* lang=') AS no_lang FROM pages""",
    "html_link_edges": """WITH l AS (SELECT url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT url, href, count(*) AS n FROM l GROUP BY ALL""",
    "html_list_children": f"SELECT page_id, {_n('<li[ >]')} AS n_items, {_n('<(ul|ol)[ >]')} AS n_lists, {_n('<b>')} - {_n('</b>')} AS unclosed_b FROM pages",
    "string_literal_contexts": f"WITH {_SRC}, r AS (SELECT path, unnest(regexp_extract_all(content, '(token|key|email|card)[ :=]+', 1)) AS context FROM src) SELECT context, count(*) AS n, count(DISTINCT path) AS n_files FROM r GROUP BY context",
    "enum_vocab_tag": f"WITH {_SRC}, v(word, enum, ord) AS (VALUES " + ", ".join(f"('{w}', '{n}', {i})" for i, (n, ws) in enumerate(VOCABULARY.items()) for w in ws)
    + "), f AS (SELECT word, arg_min(enum, ord) AS enum FROM v GROUP BY word), w AS (SELECT unnest(regexp_extract_all(lower(content), '[a-z]+')) AS word FROM src) SELECT word, enum, count(*) AS n FROM w JOIN f USING (word) GROUP BY ALL",
    "clone_windows": f"WITH {_WIN} SELECT hash, count(*) AS n, min(path) AS first_path FROM win GROUP BY hash HAVING count(*) > 1",
    "clone_pairs": f"WITH {_PAIRS} SELECT a, b, count(*) AS n_windows FROM pairs GROUP BY a, b",
    "clone_members": f"""WITH {_WIN}, c AS (SELECT hash, min(path) AS first_path, count(DISTINCT path) AS n_files FROM win GROUP BY hash HAVING count(DISTINCT path) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path, idx) AS n FROM win)
SELECT path, idx, hash, first_path, n_files FROM r JOIN c USING (hash) WHERE n > 16""",
    "clone_runs": f"WITH {_RUNS} SELECT * FROM runs",
    "clone_interval_union": f"WITH {_COVER} SELECT path, first::BIGINT AS first, last::BIGINT AS last FROM cover",
    "duplication_pct": f"WITH {_COVER} SELECT c.path, sum(last - first + 1)::BIGINT AS duplicated, count(*) AS n_blocks, round_even(sum(last - first + 1) / any_value(len(t)) * 100, 4) AS pct FROM cover c JOIN tok USING (path) GROUP BY c.path",
    "file_metrics": f"""WITH {_SRC}, l AS (SELECT path, string_split(content, chr(10)) AS ls FROM src),
m AS (SELECT path, len(ls) AS n_lines, len(list_filter(ls, lambda x: trim(x) = '')) AS n_blank, list_max(list_transform(ls, lambda x: length(x))) AS longest FROM l)
SELECT *, n_lines - n_blank AS n_code FROM m""",
    "project_metrics": f"""WITH {_SRC}, l AS (SELECT path, string_split(content, chr(10)) AS ls FROM src),
m AS (SELECT path, len(ls) AS n_lines, len(list_filter(ls, lambda x: trim(x) = '')) AS n_blank, list_max(list_transform(ls, lambda x: length(x))) AS longest FROM l)
SELECT count(*) AS n_files, sum(n_lines)::BIGINT AS n_lines, round_even(avg(n_lines - n_blank), 4) AS avg_code, max(longest) AS longest, round_even(least(1, sum(n_blank) / sum(n_lines - n_blank)) * 100, 4) AS blank_pct FROM m""",
    "role_assignment": f"""WITH {_SRC} SELECT path, 'licensed' AS role FROM src WHERE regexp_matches(content, '(Licensed|Released) under')
UNION ALL SELECT path, 'secret' FROM src WHERE regexp_matches(content, '[0-9a-f]{{40}}') UNION ALL SELECT path, 'loud' FROM src WHERE contains(content, '!!')
UNION ALL SELECT path, 'long' FROM src WHERE length(content) > 2000""",
    "context_marker_argmax": f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
s AS (SELECT doc_id, {_marks(("the", 2), ("and", 1))} AS en, {_marks(("der", 2), ("und", 1))} AS de, {_marks(("le", 2), ("une", 1))} AS fr, {_marks(("los", 2), ("una", 1))} AS es FROM t)
SELECT doc_id, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'unknown' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS profile,
  greatest(en, de, fr, es) AS best FROM s""",
    "contract_array_except": """WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations),
b AS (SELECT c.conv_id FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user') c SEMI JOIN (SELECT conv_id FROM conversations WHERE role = 'assistant') USING (conv_id)),
u AS (SELECT DISTINCT conv_id, word FROM w WHERE role = 'user'), a AS (SELECT DISTINCT conv_id, word FROM w WHERE role = 'assistant')
SELECT b.conv_id, count(u.word) FILTER (a.word IS NULL) AS n_unanswered, count(u.word) FILTER (a.word IS NOT NULL) AS n_shared
FROM b LEFT JOIN u USING (conv_id) LEFT JOIN a ON a.conv_id = u.conv_id AND a.word = u.word GROUP BY b.conv_id""",
    "filter_signature_dup": f"WITH {_SRC} SELECT array_to_string(string_split(content, ' ')[1:5], ' ') AS signature, count(*) AS n, min(path) AS first_path FROM src GROUP BY signature HAVING count(*) > 1",
}
QUERIES = {n: globals()[n] for n in SQL}
