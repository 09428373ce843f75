"""Work on findings: tasks, what a ledger of steps says, and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.graphs import cut, shared

#: Fixed values of a fix's rank.
CONFIDENCE, SAFETY = {"high": 1.0, "medium": 0.6, "low": 0.3}, {"safe_edit": 1.0, "guided_edit": 0.7, "defer": 0.6, "suppress_with_evidence": 0.5, "manual_review": 0.3}


def grouped(findings: DataFrame, group: str = "rule_id") -> DataFrame:
    """The findings with the task that each is in: `task_kind` and `task_key`. Two or more of a file and group make a task
    (by_file); of the rest two or more of a rule (by_rule); others stand alone. Clusters of rules that name each other are
    given by `group`, a column with the cluster's name. Counts are added up first and joined, so no task's findings are collected. The
    findings are read four times, so they are written once: what finds them may be a scan of all texts."""
    shared(findings)
    findings = cut(findings)
    files = findings.groupBy("file", group).agg(F.count("*").alias("_in_file"))
    marked = findings.join(files, ["file", group])
    rules = marked.filter("_in_file = 1").groupBy("rule_id").agg(F.count("*").alias("_of_rule"))
    both = marked.join(rules, "rule_id", "left")
    kind = F.when(F.col("_in_file") > 1, "by_file").when(F.col("_of_rule") > 1, "by_rule").otherwise("singleton")
    key = F.when(kind == "by_file", F.concat_ws("::", "file", group)).when(kind == "by_rule", F.col("rule_id")).otherwise(F.col("fingerprint"))
    return both.withColumn("task_kind", kind).withColumn("task_key", key).drop("_in_file", "_of_rule")


def ranked(fixes: DataFrame) -> DataFrame:
    """`fixes` (strategy, confidence, n_files) with `rank_score`."""
    from lintlake.functions import lookup

    scope = F.when(F.col("n_files") <= 1, 1.0).when(F.col("n_files") <= 3, 0.7).when(F.col("n_files") <= 10, 0.4).otherwise(0.1)
    return fixes.withColumn("rank_score", F.bround(0.35 * lookup(CONFIDENCE, "confidence", 0.6) + 0.40 * lookup(SAFETY, "strategy", 0.3) + 0.25 * scope, 4))


def broken_links(entries: DataFrame, run: str, order: list[str], entry: str = "entry_hash", previous: str = "prev_hash") -> DataFrame:
    """Entries of a hash chain whose `prev_hash` isn't the hash of the entry before; a run's first has none."""
    before = F.lag(entry).over(Window.partitionBy(run).orderBy(*order))
    return entries.withColumn("_before", before).filter(~F.col(previous).eqNullSafe(F.col("_before"))).drop("_before")


def replayed(entries: DataFrame, run: str, task: str, order: str, state: str) -> DataFrame:
    """The last state of each task of a run, and how many steps led there."""
    return entries.groupBy(run, task).agg(F.max_by(state, order).alias(state), F.count("*").alias("n_steps"))


def write_feedback(feedback: DataFrame, path: str) -> None:
    """Adds to the feedback (finding, rule_id, kind, at); nothing is ever rewritten."""
    feedback.write.mode("append").parquet(path)


def claiming(first: DataFrame, related: DataFrame) -> DataFrame:
    """(rule_id, seeds): of rules with their first finding's place (rule_id, first) those that start clusters, where `related` (rule_id, other) says
    which rules name each other, in either direction: taken by place, a rule starts clusters unless one that is related to it and comes before
    it does. In rounds: a rule that comes first among its undecided neighbours starts, and its neighbours don't."""
    shared(first)
    both = related.select("rule_id", "other").unionByName(related.select(F.col("other").alias("rule_id"), F.col("rule_id").alias("other"))).filter("rule_id <> other").distinct()
    order = F.struct("first", "rule_id")
    left = cut(first.select("rule_id", "first").distinct())
    links = cut(both.join(left.select("rule_id"), "rule_id", "left_semi").join(left.select(F.col("rule_id").alias("other")), "other", "left_semi").select("rule_id", "other"))
    done = left.join(links, "rule_id", "left_anti").select("rule_id", F.lit(False).alias("seeds"))  # rules without relations start none
    left = cut(left.join(links.select("rule_id").distinct(), "rule_id", "left_semi"))
    while not left.isEmpty():
        near = links.join(left.select(F.col("rule_id").alias("other"), order.alias("theirs")), "other").groupBy("rule_id").agg(F.min("theirs").alias("theirs"))
        ahead = cut(left.join(near, "rule_id", "left").filter(F.col("theirs").isNull() | (order < F.col("theirs"))).select("rule_id"))
        claimed = cut(links.join(ahead, "rule_id").select(F.col("other").alias("rule_id")).distinct().join(left.select("rule_id"), "rule_id", "left_semi"))
        done = done.unionByName(ahead.withColumn("seeds", F.lit(True))).unionByName(claimed.withColumn("seeds", F.lit(False)))
        left = cut(left.join(ahead.unionByName(claimed), "rule_id", "left_anti"))
    return cut(done)


def related_tasks(findings: DataFrame, related: DataFrame, group: str = "rule_id") -> DataFrame:
    """(task_kind, task_key, seed, n): tasks of findings (rule_id, fingerprint, file, ord, severity_weight, and `group`).

    A finding of a rule that starts clusters makes one (by_related) with all findings of the rules that its rule is related to; its key is the rule of the
    severest of them, of equal ones that of the first by place. What is in no cluster is grouped as `grouped` does. Members of clusters are counted by rule and never
    listed, since each finding of a rule would repeat them; `seed` and the relations say who they are."""
    shared(findings)
    f = cut(findings)
    by_rule = cut(f.groupBy("rule_id").agg(F.min("ord").alias("first"), F.count("*").alias("n"), F.max(F.struct("severity_weight", -F.col("ord"), F.col("rule_id").alias("rule"))).alias("top")))
    starts = claiming(by_rule, related).filter("seeds").select("rule_id")
    both = related.select("rule_id", "other").unionByName(related.select(F.col("other").alias("rule_id"), F.col("rule_id").alias("other"))).distinct()
    near = both.filter("rule_id <> other").join(by_rule.select(F.col("rule_id").alias("other"), "n", "top"), "other").join(starts, "rule_id", "left_semi")
    near = cut(near)
    around = near.groupBy("rule_id").agg(F.sum("n").alias("more"), F.max("top").alias("top"))
    seeds = f.join(around, "rule_id").select("fingerprint", F.greatest(F.col("top"), F.struct("severity_weight", (-F.col("ord")).alias("col2"), F.col("rule_id").alias("rule"))).alias("top"), (F.col("more") + 1).alias("n"))
    clusters = seeds.select(F.lit("by_related").alias("task_kind"), F.col("top.rule").alias("task_key"), F.col("fingerprint").alias("seed"), "n")
    taken = near.select("rule_id").unionByName(near.select(F.col("other").alias("rule_id"))).distinct()
    rest = grouped(f.join(taken, "rule_id", "left_anti"), group)
    return clusters.unionByName(rest.groupBy("task_kind", "task_key").agg(F.min("fingerprint").alias("seed"), F.count("*").alias("n")))
