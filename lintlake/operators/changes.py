"""Comparisons between two scans, gates on what is new, and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_fingerprints(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(fingerprint, severity, status) with status new, resolved or unchanged."""
    c = current.groupBy("fingerprint").agg(F.min("severity").alias("now"))
    b = baseline.groupBy("fingerprint").agg(F.min("severity").alias("then"))
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("unchanged")
    return c.join(b, "fingerprint", "full_outer").select("fingerprint", F.coalesce("now", "then").alias("severity"), status.alias("status"))


def compare_marked(findings: DataFrame, now: str, before: str) -> DataFrame:
    """(fingerprint, rule_id, severity, status) like `compare_fingerprints`, from one table in which the boolean columns `now` and
    `before` say which of two scans have a finding: one pass, one grouping. A fingerprint belongs to one rule."""
    in_now, in_before = F.coalesce(F.col(now), F.lit(False)), F.coalesce(F.col(before), F.lit(False))
    both = findings.filter(in_now | in_before).groupBy("fingerprint").agg(
        F.min("rule_id").alias("rule_id"), F.min(F.when(in_now, F.col("severity"))).alias("now"), F.min(F.when(in_before, F.col("severity"))).alias("then")
    )
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("unchanged")
    return both.select("fingerprint", "rule_id", F.coalesce("now", "then").alias("severity"), status.alias("status"))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) from (path, hash) of two inventories."""
    b = before.select("path", F.col("hash").alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("hash").isNull(), "deleted").when(F.col("hash") != F.col("old"), "modified").otherwise("unchanged")
    return now.select("path", "hash").join(b, "path", "full_outer").select("path", change.alias("change"))


def trend(scans: DataFrame, project: str, order: list[str], score: str, limit: int = 10, least: float = 5.0) -> DataFrame:
    """(project, n_scans, first_score, last_score, direction) over each project's last `limit` scans."""
    last = Window.partitionBy(project).orderBy(*(F.desc(c) for c in order))
    kept = scans.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= limit)
    g = kept.groupBy(project).agg(F.count("*").alias("n_scans"), F.max_by(score, "_n").alias("first_score"), F.min_by(score, "_n").alias("last_score"))
    change = F.col("last_score") - F.col("first_score")
    direction = F.when(F.col("n_scans") < 2, "insufficient_data").when(change > least, "improving").when(change < -least, "regressing").otherwise("stable")
    return g.withColumn("direction", direction)


def keep_last(scans: DataFrame, project: str, order: list[str], n: int = 50) -> DataFrame:
    """Each project's last n scans."""
    return scans.withColumn("_n", F.row_number().over(Window.partitionBy(project).orderBy(*(F.desc(c) for c in order)))).filter(F.col("_n") <= n).drop("_n")


def upsert(history: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` in place of the rows of `history` with the same key."""
    return history.join(new.select(key), key, "left_anti").unionByName(new)
