"""What removes findings after the rules: confidence, suppressions, overlaps and change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import CLASSIFICATION_RANK, SEVERITY_RANK, like_glob, lookup

#: Least confidence by profile, and what a classification adds to it.
FLOOR = {"startup": 0.65, "balanced": 0.55, "strict": 0.45}
FLOOR_SHIFT = {
    "startup": {"defect": 0.0, "risk": 0.02, "advisory": 0.05},
    "balanced": {"defect": 0.0, "risk": 0.01, "advisory": 0.03},
    "strict": {"defect": 0.0, "risk": 0.0, "advisory": 0.01},
}


def by_confidence(findings: DataFrame, profile: str, own_floor: dict[str, float] | None = None) -> DataFrame:
    """Findings at or above their floor: the rule's own, or else that of the profile and the classification."""
    floor = F.lit(FLOOR[profile]) + lookup(FLOOR_SHIFT[profile], "classification", 0.0)
    if own_floor:
        floor = F.coalesce(lookup({r: max(0.0, min(1.0, f)) for r, f in own_floor.items()}, "rule_id"), floor)
    return findings.filter(F.col("confidence") + 1e-9 >= floor)


def without_inline(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Anti join with marks (file, line, rule_id or '*', is_next): a mark covers its line and the two below it, a
    next-line mark the line below. Marks are spread over the lines they cover, so the join has equal keys."""
    covered = marks.select("file", "rule_id", F.explode(F.when(F.col("is_next"), F.array(F.col("line") + 1)).otherwise(F.array(*(F.col("line") + i for i in range(3))))).alias("line")).distinct()
    named = findings.join(covered.filter("rule_id != '*'"), ["file", "line", "rule_id"], "left_anti")
    return named.join(covered.filter("rule_id = '*'").select("file", "line"), ["file", "line"], "left_anti")


def without_listed(findings: DataFrame, suppressions: list[dict], as_of: str) -> DataFrame:
    """Findings that no entry (rule_id or '*', file_pattern, line_start, line_end, until) names; expired entries don't
    count. Entries are configuration, so they become one predicate."""
    hit: Column = F.lit(False)
    for s in suppressions:
        if s.get("until") and s["until"] < as_of:
            continue
        one = F.col("file").rlike(like_glob(s["file_pattern"]))
        if s["rule_id"] != "*":
            one &= F.col("rule_id") == s["rule_id"]
        if s.get("line_start") is not None:
            one &= F.col("line").between(s["line_start"], s.get("line_end") or s["line_start"])
        hit |= one
    return findings.filter(~hit)


def one_of_overlaps(findings: DataFrame) -> DataFrame:
    """Of the findings that share an overlap group and a scope (`overlap_scope` if there is such a column and it isn't empty, else
    the context) the strongest stays, with the rules it stood over. Findings without a group or a scope stay as they are.

    One grouping over all findings: each one without a group has a key of its own, so equal ones stay apart, and the strongest
    is found on the map side first, so a context that many findings share is in no one task.
    """
    scope = F.coalesce("context", F.lit(""))
    if "overlap_scope" in findings.columns:
        scope = F.coalesce(F.nullif(F.trim("overlap_scope"), F.lit("")), scope)
    grouped = (F.coalesce("overlap_group", F.lit("")) != "") & (F.trim(scope) != "")
    keyed = findings.withColumn("_nth", F.monotonically_increasing_id()).select(
        F.when(grouped, F.struct(F.col("overlap_group").alias("group"), F.trim(scope).alias("scope"), F.lit(-1).cast("long").alias("own")))
        .otherwise(F.struct(F.lit("").alias("group"), F.lit("").alias("scope"), F.col("_nth").alias("own"))).alias("key"),
        F.struct(
            -F.col("overlap_rank"), -lookup(CLASSIFICATION_RANK, "classification", 0), -lookup(SEVERITY_RANK, "severity", 0), -F.col("confidence"), -F.col("score_impact"), "rule_ord", "file", "line"
        ).alias("weakness"),
        F.struct(*(F.col(f"`{c}`") for c in findings.columns)).alias("row"), "rule_id",
    )
    best = keyed.groupBy("key").agg(F.min_by("row", "weakness").alias("row"), F.collect_set("rule_id").alias("rules"))
    return best.select("row.*", F.array_sort(F.filter("rules", lambda r: r != F.col("row.rule_id"))).alias("suppressed_rules"))


def in_changed(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings in files of `changed` (file)."""
    return findings.join(changed.select("file").distinct(), "file", "left_semi")


#: Inline marks: `@lint-ignore rule` or `*`, `-next-line`, and `until:` with the last day it holds.
MARK = r"(?i)@lint-ignore(-next-line)?\s+([a-z0-9._*-]+)(.*)$"


def inline_marks(lines: DataFrame, today: str, mark: str = MARK) -> DataFrame:
    """(file, line, rule_id, is_next) of the marks in lines (path, line, content), for `without_inline`. A mark past its day, or
    with a day that is none, doesn't hold."""
    until = F.regexp_extract(F.regexp_extract("content", mark, 3), r"(?i)\buntil:(\d{4}-\d{2}-\d{2})\b", 1)
    holds = (until == "") | (F.try_to_timestamp(until, F.lit("yyyy-MM-dd")).cast("date") >= F.lit(today).cast("date"))
    return lines.filter(F.col("content").rlike(mark) & F.coalesce(holds, F.lit(False))).select(
        F.col("path").alias("file"), "line", F.lower(F.regexp_extract("content", mark, 2)).alias("rule_id"), (F.regexp_extract("content", mark, 1) != "").alias("is_next")
    )


def in_changed_or_related(findings: DataFrame, changed: DataFrame, related: str = "related_files") -> DataFrame:
    """Findings whose file, or any of whose related files, is in `changed` (file)."""
    files = F.array_distinct(F.concat(F.array("file"), F.coalesce(related, F.array().cast("array<string>"))))
    rows = findings.withColumn("_row", F.struct("*")).select("_row", F.explode(files).alias("_file"))
    hit = rows.join(changed.select(F.col("file").alias("_file")).distinct(), "_file", "left_semi")
    return hit.select("_row").distinct().select("_row.*")


def outside_allowlist(findings: DataFrame, globs: list[str], extensions: list[str] = ()) -> DataFrame:
    """Findings in files that no pattern and no extension of the list names."""
    named = F.lit(False)
    for g in globs:
        named |= F.col("file").rlike(like_glob(g))
    for e in extensions:
        named |= F.lower("file").endswith(e.lower() if e.startswith(".") else "." + e.lower())
    return findings.filter(~named)


def by_fields(findings: DataFrame, least_confidence: float | None = None, **wanted: list) -> DataFrame:
    """Findings whose columns have one of the wanted values; an empty list asks for nothing."""
    for column, values in wanted.items():
        if values:
            findings = findings.filter(F.col(column).isin(*values))
    return findings if least_confidence is None else findings.filter(F.col("confidence") >= least_confidence)


def next_findings(findings: DataFrame, limit: int = 1, preferred: str = "") -> DataFrame:
    """What to look at next: the severest, by what they cost, those of the preferred rule first among equals; 1 to 50."""
    order = [F.desc(lookup(SEVERITY_RANK, "severity", 0)), F.desc("score_impact"), F.desc(F.col("rule_id") == preferred), "rule_id", "file", "line"]
    return findings.orderBy(*order).limit(max(1, min(50, limit)))


def first_of_each_file(findings: DataFrame, most: int) -> DataFrame:
    """At most so many findings of a rule in a file, the first by line: a cap that some rules have."""
    place = Window.partitionBy("file", "rule_id").orderBy("line", "fingerprint")
    return findings.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= most).drop("_n")


def app_routes(routes: DataFrame, prefixes=("/_ignition", "/_debugbar", "/telescope", "/horizon", "/sanctum")) -> DataFrame:
    """Routes (uri) that aren't a framework's own."""
    own = F.lit(False)
    for p in prefixes:
        own |= F.col("uri").startswith(p)
    return routes.filter(~own)
