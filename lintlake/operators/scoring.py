"""Scores, summaries and plans over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import CLASSIFICATION_RANK, SEVERITY_RANK, lookup

#: Fixed values.
PENALTY = {"critical": 40.0, "high": 15.0, "medium": 5.0, "low": 0.75, "info": 0.25}
MULTIPLIER = {"defect": 1.0, "risk": 1.0, "advisory": 0.35}
WEIGHT = {
    "architecture": 20.0, "dry": 15.0, "laravel": 20.0, "complexity": 15.0, "security": 15.0, "accessibility": 5.0,
    "maintainability": 10.0, "validation": 5.0, "performance": 10.0, "react": 10.0,
}
DEFAULT_WEIGHT = 10.0
V2_WEIGHT = {"critical": 10.0, "high": 8.0, "medium": 5.0, "low": 2.0}
#: The buckets of the second score, their weights, and the bucket of a category (else quality).
BUCKET_WEIGHT = {"security": 2.0, "performance": 1.0, "architecture": 1.0, "quality": 0.8, "accessibility": 0.6}
BUCKET = {"security": "security", "performance": "performance", "accessibility": "accessibility", "architecture": "architecture", "laravel_best_practice": "architecture"}
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))


def with_penalty(findings: DataFrame) -> DataFrame:
    base = F.when(F.col("score_impact") > 0, F.col("score_impact").cast("double")).otherwise(lookup(PENALTY, "severity", 0.0))
    return findings.withColumn("penalty", base * lookup(MULTIPLIER, "classification", 1.0))


def category_scores(findings: DataFrame, categories: list[str], file_count: int = 0) -> DataFrame:
    """(category, n_findings, raw_score): minor findings count once for each file and rule, by their largest penalty; larger
    projects' penalties shrink. Categories without findings have 100."""
    p = with_penalty(findings)
    minor = F.col("severity").isin("low", "info")
    parts = p.groupBy("category", "file", "rule_id").agg(
        F.coalesce(F.sum(F.when(~minor, F.col("penalty"))), F.lit(0.0)) + F.coalesce(F.max(F.when(minor, F.col("penalty"))), F.lit(0.0)), F.count("*").alias("n")
    ).toDF("category", "file", "rule_id", "penalty", "n")
    shrink = min(1.0, 50 / file_count) if file_count > 0 else 1.0
    scores = parts.groupBy("category").agg(F.sum("penalty").alias("penalty"), F.sum("n").alias("n_findings"))
    every = findings.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return every.join(scores, "category", "left").select(
        "category", F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        F.bround(F.greatest(F.lit(0.0), 100 - F.coalesce("penalty", F.lit(0.0)) * shrink), 1).alias("raw_score"),
    )


def grade(score):
    out = None
    for least, letter in GRADES:
        out = F.when(score >= least, letter) if out is None else out.when(score >= least, letter)
    return out.otherwise("F")


def overall(scores: DataFrame) -> DataFrame:
    """(overall_score, grade, improvement): the grade is given before rounding."""
    w = lookup(WEIGHT, "category", DEFAULT_WEIGHT)
    t = scores.agg(F.sum(w).alias("w"), F.sum(F.col("raw_score") * w).alias("s"), F.sum((100 - F.col("raw_score")) * w / 100).alias("i"))
    score = F.when(F.coalesce("w", F.lit(0.0)) == 0, F.lit(100.0)).otherwise(F.least(F.greatest(F.col("s") / F.col("w"), F.lit(0.0)), F.lit(100.0)))
    return t.select(F.bround(score, 1).alias("overall_score"), grade(score).alias("grade"), F.bround("i", 2).alias("improvement"))


def normal_weights(weights: dict[str, float], aliases: dict[str, str] | None = None) -> dict[str, float]:
    """Category weights of a configuration: aliases resolved, unknown categories dropped, shares of one made percent."""
    named = {(aliases or {}).get(k, k): float(v) for k, v in weights.items()}
    known = {k: v for k, v in named.items() if k in WEIGHT}
    return {k: v * 100 for k, v in known.items()} if known and max(known.values()) <= 1 and sum(known.values()) <= 2 else known


def bucket_scores(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(bucket, possible, penalty, score) of the five buckets over the enabled `rules` (rule_id, category, severity). A finding counts
    once by its fingerprint, or else its rule, file, context and line, with its rule's weight; one of an unknown rule weighs 5 in
    the bucket of its own category."""
    worth, bucket = lookup(V2_WEIGHT, "severity", 5.0), lookup(BUCKET, "category", "quality")
    known = rules.select("rule_id", worth.alias("rule_weight"), bucket.alias("rule_bucket"))
    possible = known.groupBy(F.col("rule_bucket").alias("bucket")).agg(F.sum("rule_weight").alias("possible"))
    identity = F.coalesce(F.nullif("fingerprint", F.lit("")), F.concat_ws("|", "rule_id", "file", "context", F.col("line").cast("string")))
    # the rules are configuration: some hundred rows
    own = findings.join(F.broadcast(known), "rule_id", "left").select(
        F.coalesce("rule_bucket", bucket).alias("bucket"), identity.alias("identity"), (F.coalesce("rule_weight", F.lit(5.0)) * lookup(MULTIPLIER, "classification", 1.0)).alias("p")
    )
    penalty = own.groupBy("bucket", "identity").agg(F.max("p").alias("p")).groupBy("bucket").agg(F.sum("p").alias("penalty"))
    every = findings.sparkSession.createDataFrame([(b,) for b in BUCKET_WEIGHT], "bucket string")
    joined = every.join(possible, "bucket", "left").join(penalty, "bucket", "left").na.fill(0.0, ["possible", "penalty"])
    score = F.when(F.col("possible") == 0, F.when(F.col("penalty") > 0, 0.0).otherwise(100.0)).otherwise(F.greatest(F.lit(0.0), F.bround(100 - F.col("penalty") / F.col("possible") * 100, 0)))
    return joined.select("bucket", "possible", F.bround("penalty", 6).alias("penalty"), score.alias("score"))


def bucket_overall(buckets: DataFrame) -> DataFrame:
    """(overall): the weighted mean of the five scores."""
    w = lookup(BUCKET_WEIGHT, "bucket", 0.0)
    return buckets.agg((F.sum(F.col("score") * w) / F.sum(w)).alias("x")).select(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround("x", 0))).alias("overall"))


def file_summaries(findings: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY_RANK]
    return findings.groupBy("file").agg(F.count("*").alias("n_findings"), *counts)


def action_plan(findings: DataFrame) -> DataFrame:
    """A row for each rule with what its findings cost, how many there are, and one of them as a sample."""
    w = lookup(WEIGHT, "category", DEFAULT_WEIGHT)
    plan = with_penalty(findings).groupBy("rule_id", "category").agg(
        F.bround(F.sum(F.col("penalty") * w) / 100, 2).alias("priority"),
        F.max(lookup(SEVERITY_RANK, "severity", 0)).alias("severity_rank"),
        F.max(lookup(CLASSIFICATION_RANK, "classification", 0)).alias("classification_rank"),
        F.countDistinct("fingerprint").alias("n_fingerprints"),
        F.countDistinct("file").alias("n_files"),
        F.min(F.struct("file", "context", "fingerprint")).alias("sample"),
    )
    return plan.select("rule_id", "category", "priority", "severity_rank", "classification_rank", "n_fingerprints", "n_files", F.col("sample.file").alias("sample_file"), F.col("sample.fingerprint").alias("sample_fingerprint"))


#: Fixed values of the triage score.
IMPACT = {"critical": 1.0, "high": 0.82, "medium": 0.62, "low": 0.38, "info": 0.2}
RISK = {"defect": 0.92, "risk": 0.78, "advisory": 0.46}


#: How a rule's findings are mended, where that isn't risky, and the effort of each way.
STRATEGY = {
    "no-log-debug-in-app": "safe", "missing-form-request": "refactor", "hooks-in-conditional-or-loop": "refactor", "no-dangerously-set-inner-html": "refactor", "missing-key-on-list-render": "refactor",
}
EFFORT = {"safe": 0.2, "risky": 0.55, "refactor": 0.8}
REGULATED = ("fintech_platform", "healthcare_platform", "marketplace_platform")


def triage(findings: DataFrame, memory: DataFrame | None = None, project_type: str = "", weights: dict[str, float] | None = None) -> DataFrame:
    """A row for each rule: impact, risk, effort, context factor, score, what to do, and the rank among all.

    `memory` (rule_id, factor) is what a team's past decisions say of a rule; `findings` may have `last_line` and
    `public_surface`. `weights` are the exponents impact, risk, effort, context and the share effort_discount, which is held to 0..0.95. The rank is
    by classification, score, category and rule; one row a rule, so it takes one small sort.
    """
    w = {"impact": 1.0, "risk": 1.0, "effort": 1.0, "context": 1.0, "effort_discount": 0.6} | (weights or {})
    w["effort_discount"] = max(0.0, min(0.95, float(w["effort_discount"])))
    lines = F.greatest(F.lit(1), F.col("last_line") - F.col("line") + 1) if "last_line" in findings.columns else F.lit(1)
    public = F.max(F.coalesce("public_surface", F.lit(False)).cast("double")) if "public_surface" in findings.columns else F.lit(0.0)
    g = with_penalty(findings).groupBy("rule_id").agg(
        F.max(lookup(SEVERITY_RANK, "severity", 0)).alias("severity_rank"), F.max(lookup(CLASSIFICATION_RANK, "classification", 0)).alias("classification_rank"), F.sum("penalty").alias("p"),
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.min(F.struct("file", "context", "fingerprint", "category")).alias("sample"), F.countDistinct("file").alias("n_files"),
        F.avg(lines).alias("span"), public.alias("public"),
    )
    by_rank = lambda values, ranks, default: lookup({ranks[k]: v for k, v in values.items()}, F.col(f"{'severity' if ranks is SEVERITY_RANK else 'classification'}_rank"), default)
    secure = F.col("category") == "security"
    strategy = lookup(STRATEGY, "rule_id", "risky")
    capped = lambda c: F.least(F.lit(1.0), c)
    g = g.withColumn("category", F.col("sample.category")).withColumn("strategy", strategy)
    if memory is not None:
        g = g.join(memory.select("rule_id", "factor"), "rule_id", "left")
    factor = F.coalesce("factor", F.lit(1.0)) if memory is not None else F.lit(1.0)
    boost = 1 + F.when(secure, 0.10 + (0.05 if project_type in REGULATED else 0.0)).otherwise(0.0)
    g = (
        g.withColumn("impact", capped(0.55 * by_rank(IMPACT, SEVERITY_RANK, 0.4) + 0.30 * capped(F.col("p") / 20) + 0.15 * capped(F.col("n") / 8)))
        .withColumn("risk", capped(0.60 * by_rank(RISK, CLASSIFICATION_RANK, 0.5) + 0.30 * F.col("confidence") + F.when(secure, 0.12).otherwise(0.0) + 0.08 * F.col("public")))
        .withColumn("effort", capped(lookup(EFFORT, "strategy", 0.55) + F.least(F.lit(0.2), (F.col("n_files") - 1) / 5 * 0.2) + F.least(F.lit(0.2), F.col("span") / 40 * 0.2)))
        .withColumn("context", F.greatest(F.lit(0.7), F.least(F.lit(1.35), boost * factor)))
    )
    power = lambda c, x: F.pow(F.col(c), F.lit(float(x))) if x != 1 else F.col(c)
    raw = 100 * power("impact", w["impact"]) * power("risk", w["risk"]) * (1 - w["effort_discount"] * power("effort", w["effort"])) * power("context", w["context"])
    g = g.withColumn("score", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2))
    defect = F.col("classification_rank") == CLASSIFICATION_RANK["defect"]
    todo = F.when(F.col("score") >= 60, "fix_now").when((F.col("score") >= 35) | (secure & defect), "schedule_next").otherwise("ignore_safely_candidate")
    order = Window.orderBy(F.desc("classification_rank"), F.desc("score"), "category", "rule_id")
    return g.select(
        "rule_id", "category", "strategy", todo.alias("recommendation"), *(F.bround(c, 4).alias(c) for c in ("impact", "risk", "effort", "context")), "score", "severity_rank",
        "classification_rank", "n_files", F.row_number().over(order).alias("rank"),
    )
