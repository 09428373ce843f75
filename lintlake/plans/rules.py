"""Queries of the rules on texts, by family, with their SQL.

The tables hold no code, so sources are rendered: every rule's two samples, once for each supplier, whose name stands in a
comment below. The SQL matches the same patterns on the same texts. `page_rule_findings` reads the web pages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import dealt
from lintlake.operators import textrules
from lintlake.operators.textrules import COMMENT, KINDS, MASK, MAX_MATCH, TextRule, regex

_STYLES = ("css", "tailwind-", "focus-indicator")
_BACKEND = ("php", "blade", "controllers", "jobs", "models", "migrations", "routes", "api_routes", "config", "middleware", "providers", "php_tests", "env", "composer", "package", "gitignore", "workflow", "vite")


def _family(r: TextRule) -> str:
    if r.rule_id.startswith(_STYLES):
        return "styles"
    if r.kind in _BACKEND:
        return "security" if r.category == "security" else "backend"
    return "accessibility" if r.category in ("accessibility", "seo") else "react"


FAMILIES = {f: [r for r in textrules.RULES if _family(r) == f] for f in ("security", "backend", "react", "accessibility", "styles")}
#: Headings of the pages are left to the element stream (`jsx`).
PAGE_RULES = [r for r in textrules.RULES if r.kind in ("markup", "html") and r.rule_id != "heading-order"]


def _samples(rules: list[TextRule]) -> list[tuple[str, str]]:
    return [(f"{side}{n}/{getattr(r, side)[0]}", getattr(r, side)[1]) for n, r in enumerate(rules) for side in ("hit", "miss")]


def rendered(spark: SparkSession, sf_dir: str, rules: list[TextRule]) -> DataFrame:
    """(path, content): the samples in a folder of each supplier."""
    samples = spark.createDataFrame(_samples(rules), "name string, body string")
    suppliers = dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name"))
    # the samples are this module's constants
    both = suppliers.crossJoin(F.broadcast(samples))
    return both.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("/"), F.col("name")).alias("path"), F.concat("body", F.lit("\n// "), F.col("s_name"), F.lit("\n")).alias("content")
    )


def _found(sources: DataFrame, rules: list[TextRule]) -> DataFrame:
    return textrules.scan_texts(sources, rules).select("file", "line", "rule_id", "category", "severity", "confidence", "context", "fingerprint")


def _query(family: str):
    return lambda s, d: _found(rendered(s, d, FAMILIES[family]), FAMILIES[family])


def page_rule_findings(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return _found(pages, PAGE_RULES)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _like(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q(regex(pattern))})"


def _rule_sql(r: TextRule) -> str:
    only, never = KINDS[r.kind]
    where = [_like("path", only), f"NOT {_like('path', never)}"]
    where += [_like("content", r.needs)] if r.needs else []
    where += [f"NOT {_like('content', r.unless)}"] if r.unless else []
    text = "content" if r.whole else f"regexp_replace(l, {_q(regex(MASK))}, repeat(chr(39), 2), 'g')" if r.masked else "l"
    where += [_like(text, r.pattern)]
    if not r.whole:
        where += [f"NOT regexp_matches({text}, {_q(COMMENT)})"] + ([f"NOT {_like(text, r.skip)}"] if r.skip else [])
    before = f"regexp_extract(content, {_q(regex(chr(92) + 'A(.*?)(?:' + r.pattern + ')'))}, 1)"
    line = f"len({before}) - len(replace({before}, chr(10), '')) + 1" if r.whole else "i"
    return f"""SELECT path AS file, ({line})::INT AS line, {_q(r.rule_id)} AS rule_id, '{r.category}' AS category, '{r.severity}' AS severity, {r.confidence}::DOUBLE AS confidence,
  substr(regexp_extract({text}, {_q(regex(r.pattern))}), 1, {MAX_MATCH}) AS context FROM {"files" if r.whole else "lines"} WHERE {" AND ".join(where)}"""


def _sql(files: str, rules: list[TextRule]) -> str:
    every = "\nUNION ALL\n".join(map(_rule_sql, rules))
    return f"""WITH files AS ({files}),
lines AS (SELECT path, content, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files),
found AS ({every})
SELECT *, substr(sha1(rule_id || ':' || file || ':' || CASE WHEN context = '' THEN rule_id ELSE context END), 1, 12) AS fingerprint FROM found"""


def _rendered_sql(rules: list[TextRule]) -> str:
    values = ", ".join(f"({_q(n)}, {_q(b)})" for n, b in _samples(rules))
    return f"SELECT 's' || s_suppkey || '/' || name AS path, body || chr(10) || '// ' || s_name || chr(10) AS content FROM supplier CROSS JOIN (VALUES {values}) v(name, body)"


QUERIES = {f"{f}_rule_findings": _query(f) for f in FAMILIES} | {"page_rule_findings": page_rule_findings}
SQL = {f"{f}_rule_findings": _sql(_rendered_sql(rules), rules) for f, rules in FAMILIES.items()} | {
    "page_rule_findings": _sql("SELECT 'pages/' || page_id || '.html' AS path, html AS content FROM pages WHERE html IS NOT NULL", PAGE_RULES)
}
