"""Line rules over texts, and the one table of findings that they give."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import fingerprint


@dataclass(frozen=True)
class LineRule:
    """One pattern. It is a Java regex; those of the catalogue also read the same in RE2."""

    rule_id: str
    pattern: str
    category: str
    severity: str
    classification: str
    confidence: float
    score_impact: int = 0
    title: str = ""
    overlap_group: str = ""
    overlap_rank: int = 0


MAX_MATCH = 120


def lines_of(sources: DataFrame) -> DataFrame:
    """(path, line, content) with a row for each line, from 1; a null content has no line."""
    return sources.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "content")).select("path", (F.col("pos") + 1).alias("line"), "content")


def scan_lines(sources: DataFrame, rules: list[LineRule]) -> DataFrame:
    """Findings of all rules in one pass over the lines: for each line and rule the first match, which must not be empty. The
    whole line is searched, once for each rule; only the stored match is cut. The scan is one projection, so no row is shuffled."""
    matches = F.array(*(F.regexp_extract("content", r.pattern, 0) for r in rules))
    hits = F.filter(F.transform(matches, lambda m, n: F.struct(n.alias("rule_ord"), F.substring(m, 1, MAX_MATCH).alias("context"))), lambda x: x["context"] != "")
    marks = F.array(
        *(
            F.struct(
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.title or r.rule_id).alias("title"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"),
                F.lit(r.classification).alias("classification"), F.lit(r.confidence).alias("confidence"), F.lit(r.score_impact).alias("score_impact"),
                F.lit(r.overlap_group).alias("overlap_group"), F.lit(r.overlap_rank).alias("overlap_rank"),
            )
            for r in rules
        )
    )
    found = lines_of(sources).select(F.col("path").alias("file"), "line", F.explode(hits).alias("x"))
    marked = found.select("file", "line", "x.rule_ord", F.element_at(marks, F.col("x.rule_ord") + 1).alias("m"), "x.context").select("file", "line", "rule_ord", "m.*", "context")
    return marked.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), F.col("context"), F.col("title")))
