"""Queries over the element stream, with their SQL: the web pages as they are, and the samples of the element rules rendered
once for each supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import dealt
from lintlake.operators import jsx


def _pages(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("content"))


def page_elements(s, d):
    return jsx.elements(_pages(s, d)).groupBy("path", "tag").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.count_if(F.size("attrs") > 0).alias("n_with_attrs"))


def page_classes(s, d):
    return jsx.utility_classes(jsx.elements(_pages(s, d))).groupBy("class").agg(F.count("*").alias("n"))


def jsx_rule_findings(s, d):
    """What all element rules find in the samples of all of them."""
    samples = s.createDataFrame([(f"{side}-{r.rule_id}", getattr(r, side)) for r in jsx.RULES for side in ("hit", "miss")], "name string, body string")
    suppliers = dealt(s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name"))
    # the samples are the operator's constants
    both = suppliers.crossJoin(F.broadcast(samples))
    sources = both.select(F.concat(F.col("name"), F.lit("/"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(F.lit("// "), F.col("s_name"), F.lit("\n"), F.col("body")).alias("content"))
    return jsx.scan_elements(sources).groupBy("file", "rule_id", "severity").agg(F.min("line").alias("line"))


_TAGS = r"<([A-Za-z][A-Za-z0-9]*)((?:\s+[^<>]*)?)>"
SQL = {
    "page_elements": rf"""WITH l AS (SELECT 'p' || page_id AS path, unnest(string_split(html, chr(10))) AS l, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS i FROM pages),
t AS (SELECT path, i, unnest(regexp_extract_all(l, '{_TAGS}')) AS x FROM l)
SELECT path, regexp_extract(x, '<([A-Za-z][A-Za-z0-9]*)', 1) AS tag, count(*) AS n, min(i)::INT AS first_line,
  count(*) FILTER (regexp_matches(x, '<[A-Za-z0-9]+\s+[^\s/>]')) AS n_with_attrs FROM t GROUP BY ALL""",
    "page_classes": rf"""WITH t AS (SELECT unnest(regexp_extract_all(html, '{_TAGS}')) AS x FROM pages),
c AS (SELECT unnest(string_split_regex(trim(regexp_extract(x, '\sclass(?:Name)?=["'']([^"'']*)["'']', 1)), '\s+')) AS class FROM t)
SELECT class, count(*) AS n FROM c WHERE class <> '' GROUP BY class""",
    "jsx_rule_findings": "SELECT 'hit-' || rule_id || '/' || s_suppkey AS file, rule_id, severity, 2 AS line FROM supplier CROSS JOIN (VALUES "
    + ", ".join(f"('{r.rule_id}', '{r.severity}')" for r in jsx.RULES)
    + ") v(rule_id, severity)",
}
QUERIES = {n: globals()[n] for n in SQL}
