"""Queries over findings that line rules have in the documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import CLASSIFICATION_RANK, SEVERITY_RANK
from lintlake.operators import changes, filters, findings, remediation, scoring

RULES = [
    findings.LineRule("secret-token", r"\b[0-9a-f]{40}\b", "security", "critical", "defect", 0.95, 0, "Secret in text", "credential", 2),
    findings.LineRule("hex-run", r"[0-9a-f]{16}", "security", "medium", "risk", 0.6, 0, "Long hexadecimal run", "credential", 1),
    findings.LineRule("email-address", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+", "security", "high", "risk", 0.7, 6, "Email address"),
    findings.LineRule("ip-address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "security", "medium", "risk", 0.66, 0, "Network address"),
    findings.LineRule("card-number", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "security", "high", "defect", 0.9, 0, "Card number"),
    findings.LineRule("license-line", r"(Licensed|Released) under", "maintainability", "info", "advisory", 0.8, 0, "License line"),
    findings.LineRule("shouting", r"!!", "validation", "low", "advisory", 0.6, 0, "Shouting"),
    findings.LineRule("long-line", r"^.{240}", "complexity", "low", "risk", 0.5, 0, "Long line"),
]
CATEGORIES = ["security", "maintainability", "validation", "complexity", "performance"]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.scan_lines(sources(spark, sf_dir), RULES)


def _rule_sql(n: int, r: findings.LineRule) -> str:
    pattern = r.pattern
    return f"""SELECT file, line, {n} AS rule_ord, '{r.rule_id}' AS rule_id, '{r.title}' AS title, '{r.category}' AS category, '{r.severity}' AS severity,
  '{r.classification}' AS classification, {r.confidence}::DOUBLE AS confidence, {r.score_impact} AS score_impact, '{r.overlap_group}' AS overlap_group, {r.overlap_rank} AS overlap_rank,
  substr(regexp_extract(content, '{pattern}'), 1, 120) AS context FROM lines WHERE regexp_matches(content, '{pattern}')"""


LINES_SQL = """lines AS (
  SELECT 'doc/' || doc_id || '.' || lang AS file, i AS line, l AS content
  FROM (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
)"""
FOUND_SQL = (
    LINES_SQL
    + ",\nraw AS (\n"
    + "\nUNION ALL\n".join(_rule_sql(n, r) for n, r in enumerate(RULES))
    + "\n),\nfound AS (SELECT *, substr(sha1(rule_id || ':' || file || ':' || CASE WHEN context = '' THEN title ELSE context END), 1, 12) AS fingerprint FROM raw)"
)


def _case(column: str, values: dict, default) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default} END"


_SEV, _CLS = _case("severity", SEVERITY_RANK, 0), _case("classification", CLASSIFICATION_RANK, 0)
_PENALTY = f"(CASE WHEN score_impact > 0 THEN score_impact::DOUBLE ELSE {_case('severity', scoring.PENALTY, '0')} END) * {_case('classification', scoring.MULTIPLIER, '1')}"
_WEIGHT = _case("category", scoring.WEIGHT, "10::DOUBLE")
_SCORES_SQL = f"""p AS (SELECT *, {_PENALTY} AS penalty FROM found),
parts AS (
  SELECT category, file, rule_id, coalesce(sum(penalty) FILTER (severity NOT IN ('low', 'info')), 0) + coalesce(max(penalty) FILTER (severity IN ('low', 'info')), 0) AS penalty, count(*) AS n
  FROM p GROUP BY category, file, rule_id
),
scores AS (
  SELECT c.category, coalesce(sum(n), 0)::BIGINT AS n_findings, round_even(greatest(0, 100 - coalesce(sum(penalty), 0) * 0.05::DOUBLE), 1) AS raw_score
  FROM (VALUES {", ".join(f"('{c}')" for c in CATEGORIES)}) c(category) LEFT JOIN parts USING (category) GROUP BY c.category
)"""

#: Entries of a suppression file, for the query of that name.
LISTED = [
    {"rule_id": "ip-address", "file_pattern": "doc/1*.en"},
    {"rule_id": "*", "file_pattern": "doc/*.fr", "line_start": 1, "line_end": 3},
    {"rule_id": "shouting", "file_pattern": "*", "until": "2020-01-01"},
]
_KEY = ("file", "line", "rule_id", "fingerprint", "confidence")


def line_regex_scan(s, d):
    return found(s, d).select("file", "line", "rule_id", "context", "severity", "fingerprint")


def secret_lines(s, d):
    lines = findings.lines_of(sources(s, d)).filter(F.col("content").rlike("token") & F.col("content").rlike("[0-9a-f]{40}"))
    return lines.select("path", "line", F.regexp_extract("content", "[0-9a-f]{40}", 0).alias("token"))


def confidence_filter(s, d):
    return filters.by_confidence(found(s, d), "startup", {"shouting": 0.6}).select(*_KEY)


def band_suppression(s, d):
    marks = findings.lines_of(sources(s, d)).filter(F.col("content").rlike("(Licensed|Released) under")).select(
        F.col("path").alias("file"), "line", F.lit("*").alias("rule_id"), (F.col("line") % 2 == 0).alias("is_next")
    )
    return filters.without_inline(found(s, d), marks).select(*_KEY)


def glob_suppression(s, d):
    return filters.without_listed(found(s, d), LISTED, "2025-01-01").select(*_KEY)


def overlap_dedupe(s, d):
    return filters.one_of_overlaps(found(s, d)).select(*_KEY, F.concat_ws(",", "suppressed_rules").alias("suppressed"))


def semi_changed(s, d):
    changed = s.read.parquet(f"{d}/labels.parquet").filter("quality = 0").select("doc_id")
    files = s.read.parquet(f"{d}/documents.parquet").join(changed, "doc_id").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("file"))
    return filters.in_changed(found(s, d), files).select(*_KEY)


def category_score(s, d):
    return scoring.category_scores(found(s, d), CATEGORIES, file_count=1000)


def overall_grade(s, d):
    return scoring.overall(scoring.category_scores(found(s, d), CATEGORIES, file_count=1000))


def _rule_table(s):
    return s.createDataFrame([(r.rule_id, r.category, r.severity) for r in RULES], "rule_id string, category string, severity string")


def v2_bucket_score(s, d):
    return scoring.bucket_scores(found(s, d), _rule_table(s))


def v2_overall(s, d):
    return scoring.bucket_overall(scoring.bucket_scores(found(s, d), _rule_table(s)))


def file_summary(s, d):
    return scoring.file_summaries(found(s, d)).orderBy(F.desc("n_findings"), "file")


def action_plan(s, d):
    return scoring.action_plan(found(s, d))


def triage_plan(s, d):
    return scoring.triage(found(s, d))


def group_views(s, d):
    return found(s, d).groupBy("severity", "classification").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"))


def hotspots_topk(s, d):
    return found(s, d).groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("n_rules")).orderBy(F.desc("n"), F.desc("n_rules"), "file").limit(10)


def _marked(s, d):
    """One scan of findings that stands for two: each leaves out the documents of another last digit."""
    number = F.regexp_extract("file", r"doc/(\d+)", 1).cast("long")
    return found(s, d).withColumn("now", number % 10 != 0).withColumn("before", number % 10 != 1)


def _diff(s, d):
    return changes.compare_marked(_marked(s, d), "now", "before")


def baseline_diff(s, d):
    return _diff(s, d).select("fingerprint", "severity", "status")


def baseline_severity_counts(s, d):
    return _diff(s, d).groupBy("status", "severity").agg(F.count("*").alias("n"))


def pr_gate(s, d):
    new = _diff(s, d).filter("status = 'new'")
    return new.groupBy("rule_id", "severity").agg(F.count("*").alias("n_new"), F.max((F.col("severity").isin("critical", "high")).cast("int")).alias("blocks"))


def rescan_deltas(s, d):
    counts = _marked(s, d).groupBy("severity").agg(F.count_if("now").alias("now"), F.count_if("before").alias("before"))
    return counts.withColumn("delta", F.col("now") - F.col("before"))


def sarif_rules_first(s, d):
    first = found(s, d).groupBy("rule_id").agg(F.min(F.struct("file", "line")).alias("x"), F.count("*").alias("n"))
    return first.select("rule_id", F.col("x.file").alias("file"), F.col("x.line").alias("line"), "n")


def next_findings(s, d):
    return filters.next_findings(found(s, d), 20, "secret-token").select(*_KEY)


def per_file_cap(s, d):
    return filters.first_of_each_file(found(s, d), 2).select(*_KEY)


def field_filter(s, d):
    return filters.by_fields(found(s, d), 0.7, severity=["high", "critical"], category=["security"], rule_id=[]).select(*_KEY)


def allowlist_filter(s, d):
    return filters.outside_allowlist(found(s, d), ["doc/2*"], ["de"]).select(*_KEY)


def remediation_tasks(s, d):
    return remediation.grouped(found(s, d).select("file", "category", "rule_id", "fingerprint"), "category").groupBy("task_kind", "task_key").agg(F.count("*").alias("n_findings"), F.countDistinct("file").alias("n_files"))


_NUMBER = "regexp_extract(file, 'doc/([0-9]+)', 1)::BIGINT"
_DIFF = f"""c AS (SELECT fingerprint, min(severity) AS now FROM found WHERE {_NUMBER} % 10 <> 0 GROUP BY fingerprint),
b AS (SELECT fingerprint, min(severity) AS prev FROM found WHERE {_NUMBER} % 10 <> 1 GROUP BY fingerprint),
diff AS (
  SELECT coalesce(c.fingerprint, b.fingerprint) AS fingerprint, coalesce(now, prev) AS severity,
    CASE WHEN b.fingerprint IS NULL THEN 'new' WHEN c.fingerprint IS NULL THEN 'resolved' ELSE 'unchanged' END AS status
  FROM c FULL JOIN b ON c.fingerprint = b.fingerprint
)"""
_COLUMNS = "file, line, rule_id, fingerprint, confidence"
_IMPACT, _RISK = _case("severity", scoring.IMPACT, "0.2"), _case("classification", scoring.RISK, "0.46")

_BUCKET = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scoring.BUCKET.items()) + " ELSE 'quality' END"
_BUCKETS = f"""rules(rule_id, category, severity) AS (VALUES {", ".join(f"('{r.rule_id}', '{r.category}', '{r.severity}')" for r in RULES)}),
possible AS (SELECT {_BUCKET("category")} AS bucket, sum({_case("severity", scoring.V2_WEIGHT, "5::DOUBLE")}) AS possible FROM rules GROUP BY 1),
once AS (SELECT {_BUCKET("category")} AS bucket, fingerprint, max({_case("severity", scoring.V2_WEIGHT, "5::DOUBLE")} * {_case("classification", scoring.MULTIPLIER, "1")}) AS p FROM found GROUP BY ALL),
pen AS (SELECT bucket, sum(p) AS penalty FROM once GROUP BY bucket),
buckets AS (
  SELECT bucket, coalesce(possible, 0) AS possible, round_even(coalesce(penalty, 0), 6) AS penalty,
    CASE WHEN coalesce(possible, 0) = 0 THEN CASE WHEN penalty > 0 THEN 0 ELSE 100 END ELSE greatest(0, round_even(100 - coalesce(penalty, 0) / possible * 100, 0)) END::DOUBLE AS score
  FROM (VALUES {", ".join(f"('{b}')" for b in scoring.BUCKET_WEIGHT)}) b(bucket) LEFT JOIN possible USING (bucket) LEFT JOIN pen USING (bucket)
)"""

SQL = {
    "line_regex_scan": f"WITH {FOUND_SQL} SELECT file, line, rule_id, context, severity, fingerprint FROM found",
    "secret_lines": f"""WITH {LINES_SQL}
SELECT file AS path, line, regexp_extract(content, '[0-9a-f]{{40}}') AS token FROM lines WHERE contains(content, 'token') AND regexp_matches(content, '[0-9a-f]{{40}}')""",
    "confidence_filter": f"""WITH {FOUND_SQL} SELECT {_COLUMNS} FROM found
WHERE confidence + 1e-9 >= CASE WHEN rule_id = 'shouting' THEN 0.6 ELSE 0.65 + CASE classification WHEN 'risk' THEN 0.02 WHEN 'advisory' THEN 0.05 ELSE 0 END END""",
    "band_suppression": f"""WITH {FOUND_SQL},
m AS (SELECT file, line, line % 2 = 0 AS nxt FROM ({LINES_SQL[len("lines AS ("):-1]}) WHERE regexp_matches(content, '(Licensed|Released) under'))
SELECT {_COLUMNS} FROM found f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file = f.file AND CASE WHEN nxt THEN f.line = m.line + 1 ELSE f.line BETWEEN m.line AND m.line + 2 END)""",
    "glob_suppression": f"""WITH {FOUND_SQL} SELECT {_COLUMNS} FROM found
WHERE NOT (rule_id = 'ip-address' AND file ILIKE 'doc/1%.en') AND NOT (file ILIKE 'doc/%.fr' AND line BETWEEN 1 AND 3)""",
    "overlap_dedupe": f"""WITH {FOUND_SQL},
g AS (
  SELECT *, row_number() OVER (PARTITION BY overlap_group, context ORDER BY overlap_rank DESC, {_CLS} DESC, {_SEV} DESC, confidence DESC, score_impact DESC, rule_ord, file, line) AS n,
    list(rule_id) OVER (PARTITION BY overlap_group, context) AS rules FROM found WHERE overlap_group <> '' AND context <> ''
)
SELECT {_COLUMNS}, array_to_string(list_sort(list_distinct(list_filter(rules, lambda r: r <> rule_id))), ',') AS suppressed FROM g WHERE n = 1
UNION ALL SELECT {_COLUMNS}, '' FROM found WHERE overlap_group = '' OR context = ''""",
    "semi_changed": f"""WITH {FOUND_SQL} SELECT {_COLUMNS} FROM found
WHERE file IN (SELECT 'doc/' || doc_id || '.' || lang FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 0) USING (doc_id))""",
    "category_score": f"WITH {FOUND_SQL}, {_SCORES_SQL} SELECT * FROM scores",
    "overall_grade": f"""WITH {FOUND_SQL}, {_SCORES_SQL}, t AS (SELECT sum(raw_score * {_WEIGHT}) / sum({_WEIGHT}) AS s, sum((100 - raw_score) * {_WEIGHT} / 100) AS i FROM scores)
SELECT round_even(s, 1) AS overall_score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade, round_even(i, 2) AS improvement FROM t""",
    "v2_bucket_score": f"WITH {FOUND_SQL}, {_BUCKETS} SELECT bucket, possible, penalty, score FROM buckets",
    "v2_overall": f"WITH {FOUND_SQL}, {_BUCKETS} SELECT round_even(sum(score * w) / sum(w), 0)::DOUBLE AS overall FROM buckets JOIN (VALUES {', '.join(f'{kv}' for kv in scoring.BUCKET_WEIGHT.items())}) b(bucket, w) USING (bucket)",
    "file_summary": f"WITH {FOUND_SQL} SELECT file, count(*) AS n_findings, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in SEVERITY_RANK) + " FROM found GROUP BY file",
    "action_plan": f"""WITH {FOUND_SQL}, p AS (SELECT *, {_PENALTY} AS penalty FROM found),
f AS (SELECT rule_id, min(row(file, context, fingerprint)) AS x FROM p GROUP BY rule_id)
SELECT p.rule_id, category, round_even(sum(penalty * {_WEIGHT}) / 100, 2) AS priority, max({_SEV})::INT AS severity_rank, max({_CLS})::INT AS classification_rank,
  count(DISTINCT fingerprint) AS n_fingerprints, count(DISTINCT file) AS n_files, any_value(x[1]) AS sample_file, any_value(x[3]) AS sample_fingerprint
FROM p JOIN f USING (rule_id) GROUP BY p.rule_id, category""",
    "triage_plan": f"""WITH {FOUND_SQL}, p AS (SELECT *, {_PENALTY} AS penalty FROM found),
g AS (
  SELECT rule_id, any_value(category) AS category, any_value(severity) AS severity, any_value(classification) AS classification, max({_SEV})::INT AS severity_rank, max({_CLS})::INT AS classification_rank,
    sum(penalty) AS p, count(*) AS n, avg(confidence) AS conf, count(DISTINCT file) AS n_files FROM p GROUP BY rule_id
),
f AS (
  SELECT *, least(1, 0.55::DOUBLE * {_IMPACT} + 0.30::DOUBLE * least(1, p / 20) + 0.15::DOUBLE * least(1, n / 8)) AS impact,
    least(1, 0.60::DOUBLE * {_RISK} + 0.30::DOUBLE * conf + CASE WHEN category = 'security' THEN 0.12::DOUBLE ELSE 0 END) AS risk,
    least(1, 0.55::DOUBLE + least(0.2::DOUBLE, (n_files - 1) / 5 * 0.2::DOUBLE) + 0.005::DOUBLE) AS effort, CASE WHEN category = 'security' THEN 1.1 ELSE 1 END::DOUBLE AS context FROM g
),
s AS (SELECT *, round_even(greatest(0, least(100, 100 * impact * risk * (1 - 0.6::DOUBLE * effort) * context)), 2) AS score FROM f)
SELECT rule_id, category, 'risky' AS strategy, CASE WHEN score >= 60 THEN 'fix_now' WHEN score >= 35 OR (category = 'security' AND classification = 'defect') THEN 'schedule_next' ELSE 'ignore_safely_candidate' END AS recommendation,
  round_even(impact, 4) AS impact, round_even(risk, 4) AS risk, round_even(effort, 4) AS effort, round_even(context, 4) AS context, score, severity_rank, classification_rank, n_files,
  row_number() OVER (ORDER BY classification_rank DESC, score DESC, category, rule_id)::INT AS rank FROM s""",
    "next_findings": f"WITH {FOUND_SQL} SELECT {_COLUMNS} FROM found ORDER BY {_SEV} DESC, score_impact DESC, (rule_id = 'secret-token') DESC, rule_id, file, line LIMIT 20",
    "per_file_cap": f"WITH {FOUND_SQL} SELECT {_COLUMNS} FROM found QUALIFY row_number() OVER (PARTITION BY file, rule_id ORDER BY line, fingerprint) <= 2",
    "field_filter": f"WITH {FOUND_SQL} SELECT {_COLUMNS} FROM found WHERE severity IN ('high', 'critical') AND category = 'security' AND confidence >= 0.7",
    "allowlist_filter": f"WITH {FOUND_SQL} SELECT {_COLUMNS} FROM found WHERE NOT file ILIKE 'doc/2%' AND NOT lower(file) LIKE '%.de'",
    "remediation_tasks": f"""WITH {FOUND_SQL}, a AS (SELECT *, count(*) OVER (PARTITION BY file, category) AS n FROM found),
r AS (SELECT rule_id, count(*) AS m FROM a WHERE n = 1 GROUP BY rule_id)
SELECT CASE WHEN n > 1 THEN 'by_file' WHEN m > 1 THEN 'by_rule' ELSE 'singleton' END AS task_kind, CASE WHEN n > 1 THEN file || '::' || category WHEN m > 1 THEN rule_id ELSE fingerprint END AS task_key,
  count(*) AS n_findings, count(DISTINCT file) AS n_files FROM a LEFT JOIN r USING (rule_id) GROUP BY ALL""",
    "group_views": f"WITH {FOUND_SQL} SELECT severity, classification, count(*) AS n, count(DISTINCT file) AS n_files FROM found GROUP BY ALL",
    "hotspots_topk": f"WITH {FOUND_SQL} SELECT file, count(*) AS n, count(DISTINCT rule_id) AS n_rules FROM found GROUP BY file ORDER BY n DESC, n_rules DESC, file LIMIT 10",
    "baseline_diff": f"WITH {FOUND_SQL}, {_DIFF} SELECT fingerprint, severity, status FROM diff",
    "baseline_severity_counts": f"WITH {FOUND_SQL}, {_DIFF} SELECT status, severity, count(*) AS n FROM diff GROUP BY ALL",
    "pr_gate": f"""WITH {FOUND_SQL}, {_DIFF} SELECT rule_id, severity, count(DISTINCT fingerprint) AS n_new, max((severity IN ('critical', 'high'))::INT) AS blocks
FROM found WHERE {_NUMBER} % 10 <> 0 AND fingerprint IN (SELECT fingerprint FROM diff WHERE status = 'new') GROUP BY ALL""",
    "rescan_deltas": f"""WITH {FOUND_SQL} SELECT severity, count(*) FILTER ({_NUMBER} % 10 <> 0) AS now, count(*) FILTER ({_NUMBER} % 10 <> 1) AS "before",
  count(*) FILTER ({_NUMBER} % 10 <> 0) - count(*) FILTER ({_NUMBER} % 10 <> 1) AS delta FROM found GROUP BY severity""",
    "sarif_rules_first": f"WITH {FOUND_SQL} SELECT rule_id, min(row(file, line))[1] AS file, min(row(file, line))[2]::INT AS line, count(*) AS n FROM found GROUP BY rule_id",
}
QUERIES = {n: globals()[n] for n in SQL}
