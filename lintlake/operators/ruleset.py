"""Which rules run: a configuration laid over the rules, aliases, and what applies to a project. Rule tables are small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import lookup
from lintlake.operators.filters import FLOOR, FLOOR_SHIFT


def overlaid(base: DataFrame, user: DataFrame, key: str = "rule_id") -> DataFrame:
    """The rows of `base`, each replaced as a whole where `user` has the key, and what `user` adds."""
    return base.join(user.select(key), key, "left_anti").unionByName(user.select(*base.columns))


def enabled(rules: DataFrame, config: DataFrame) -> DataFrame:
    """`rules` (rule_id, ...) with `enabled`: as `config` (rule_id, enabled) says; a rule it doesn't name is off, unless it names none."""
    any_named = F.broadcast(config.agg((F.count("*") > 0).alias("_any")))  # one row
    found = rules.join(config.select("rule_id", F.col("enabled").alias("_on")), "rule_id", "left").crossJoin(any_named)
    return found.withColumn("enabled", F.coalesce("_on", ~F.col("_any"))).drop("_on", "_any")


def resolved(selected: DataFrame, aliases: DataFrame) -> DataFrame:
    """(rule_id): the selected rules with each alias (alias, canonical) replaced by its rule, each once."""
    return selected.join(aliases, selected["rule_id"] == aliases["alias"], "left").select(F.coalesce("canonical", "rule_id").alias("rule_id")).distinct()


def applicable(rules: DataFrame, project: DataFrame) -> DataFrame:
    """The enabled rules (enabled, family, project_types) that fit the one row of `project` (project_type, families): their family is
    one of the project's, and they name its type or none."""
    fits = F.array_contains("families", F.col("family")) & ((F.size("project_types") == 0) | F.array_contains("project_types", F.col("project_type")))
    return rules.crossJoin(F.broadcast(project.limit(1))).filter(F.col("enabled") & fits).select(*(rules[c] for c in rules.columns))


def calibrated(rules: DataFrame, patches: DataFrame) -> DataFrame:
    """`rules` (rule_id, enabled, severity, thresholds) after `patches` (rule_id, ord, enabled, severity, thresholds): of enabled and severity the last that is
    not null holds, thresholds are merged by name, the last one holds. `ord` gives the order of the layers (profile, project type, capabilities,
    expectations); patches of rules that aren't there are left out; of equal `ord` the
    greatest value holds. A rule has a few thresholds, so these are collected by rule."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ord", c))).alias(f"_{c}")
    own = patches.join(rules.select("rule_id"), "rule_id", "left_semi")
    switched = own.groupBy("rule_id").agg(last("enabled"), last("severity"))
    named = rules.select("rule_id", F.lit(None).cast("long").alias("ord"), F.explode("thresholds")).unionByName(own.select("rule_id", F.col("ord").cast("long"), F.explode("thresholds")))
    # a default comes before every patch
    values = named.groupBy("rule_id", "key").agg(F.max_by("value", F.struct(F.col("ord").isNotNull(), "ord", "value")).alias("value"))
    merged = values.groupBy("rule_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_thresholds"))
    found = rules.join(switched, "rule_id", "left").join(merged, "rule_id", "left")
    return found.select("rule_id", F.coalesce("_enabled", "enabled").alias("enabled"), F.coalesce("_severity", "severity").alias("severity"), F.coalesce("_thresholds", "thresholds").alias("thresholds"))


def unreachable(declared: DataFrame, profile: str, own_floor: DataFrame | None = None) -> DataFrame:
    """(rule_id, ceiling, floor): rules none of whose declared findings (rule_id, confidence, classification) can pass the profile's floor, or
    that of `own_floor` (rule_id, floor), which holds for all classifications. A rule with a finding whose confidence or
    classification is only known when it runs (null) is left out. One grouping; the nearest miss is named."""
    base, shift = F.lit(FLOOR.get(profile, FLOOR["balanced"])), lookup(FLOOR_SHIFT.get(profile, FLOOR_SHIFT["balanced"]), "classification", 0.0)
    if own_floor is None:
        rows = declared.withColumn("floor", base + shift)
    else:
        own = own_floor.select("rule_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("floor").cast("double"))).alias("own"))
        rows = declared.join(own, "rule_id", "left").withColumn("floor", F.coalesce("own", base + shift))
    rows = rows.withColumn("floor", F.least(F.col("floor"), F.lit(1.0)))
    unknown = F.col("confidence").isNull() | F.col("classification").isNull()
    margin = F.col("confidence") - F.col("floor")
    each = rows.groupBy("rule_id").agg(F.max(unknown).alias("unknown"), F.max(margin).alias("margin"), F.max(F.struct(margin, F.col("confidence"), F.col("floor"))).alias("best"))
    return each.filter(~F.col("unknown") & (F.col("margin") < -1e-9)).select("rule_id", F.col("best.confidence").alias("ceiling"), F.col("best.floor").alias("floor"))


def drift(listed: DataFrame, found: DataFrame, internal: DataFrame, aliases: DataFrame) -> DataFrame:
    """(rule_id, state): where a list of rules and the rules that are there differ: `pending` are there, not listed and not internal, `listed_only` aren't
    there, `internal` are there and wrapped by others, `alias_only` are old names (alias) of none that is there."""
    a, b, i, old = (t.select(t.columns[0]).toDF("rule_id").distinct() for t in (listed, found, internal, aliases))
    known = b.withColumn("listed", F.lit(False)).join(a.withColumn("in_list", F.lit(True)), "rule_id", "left").join(i.withColumn("inner", F.lit(True)), "rule_id", "left")
    pending = known.filter("in_list is null and inner is null").select("rule_id", F.lit("pending").alias("state"))
    wrapped = known.filter("inner").select("rule_id", F.lit("internal").alias("state"))
    return pending.unionByName(wrapped).unionByName(a.join(b, "rule_id", "left_anti").withColumn("state", F.lit("listed_only"))).unionByName(old.join(b, "rule_id", "left_anti").withColumn("state", F.lit("alias_only")))
