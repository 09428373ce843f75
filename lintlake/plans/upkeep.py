"""Queries over duplicated blocks, rewrites and rules that can't pass, with their SQL.

A class is rendered for each part, with as many statements as its size says, and a script for each supplier; what rules declare
stands in the parts themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import dealt
from lintlake.operators import blocks, fixes, rules, ruleset
from lintlake.plans.code import rendered


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def classes(s, d):
    """Statements of ten tokens, which name and number things differently in each class."""
    line = F.transform(F.sequence(F.lit(1), F.col("p_size") + 10), lambda i: F.concat(F.lit("        $v"), F.col("p_partkey"), F.lit(" = go("), i, F.lit(", '"), F.col("p_brand"), F.lit("'); // "), F.col("p_name"), F.lit("\n")))
    p = dealt(_t(s, d, "part")).withColumn("lines", F.array_join(line, ""))
    return rendered(p, "app/P[[p_partkey]].php", "<?php\nclass P[[p_partkey]]\n{\n    public function f()\n    {\n[[lines]]    }\n}\n")


def clone_blocks(s, d):
    at = blocks.block_places(blocks.places(classes(s, d)))
    return blocks.largest(at).select(F.col("tokens").cast("long").alias("tokens"), "n_places", "n_files", "first_path")


def file_duplication(s, d):
    return blocks.duplication(blocks.places(classes(s, d))).select("path", "total", "duplicated", "pct")


def scripts(s, d):
    p = dealt(_t(s, d, "supplier")).withColumn("debug", F.when(F.col("s_acctbal") < 0, "debug").otherwise("info"))
    return rendered(p, "app/Services/S[[s_suppkey]].php", "<?php\n// [[s_name]]\nclass S[[s_suppkey]]\n{\n    public function f()\n    {\n        $a = env('NATION') . [[s_nationkey]];\n        Log::[[debug]]($a);\n        return $a;\n    }\n}\n")


def fix_diffs(s, d):
    """What the rewrites of two rules make of the findings that these rules have."""
    src = scripts(s, d)
    found = rules.scan(src, [r for r in rules.RULES if r.rule_id in ("env-outside-config", "no-log-debug-in-app")])
    changed = fixes.apply(src, fixes.suggestions(found, src))
    return fixes.diffs(changed).select("path", "diff", F.col("added").cast("long").alias("added"), F.col("removed").cast("long").alias("removed"))


def unreachable_rules(s, d):
    """Parts as declared findings: brand and size as the rule, what they cost as the confidence."""
    p = _t(s, d, "part")
    declared = p.select(
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("rule_id"), F.when(F.col("p_size") != 7, F.round((F.col("p_retailprice") - 800) / 1000, 3)).alias("confidence"),
        F.when(F.col("p_type").like("%A%"), "defect").when(F.col("p_type").like("%O%"), "risk").otherwise("advisory").alias("classification"),
    )
    own = p.filter("p_size < 3").groupBy(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("rule_id")).agg(F.lit(0.2).alias("floor"))
    found = ruleset.unreachable(declared, "startup", own)
    return found.select("rule_id", F.round("ceiling", 3).alias("ceiling"), F.round("floor", 3).alias("floor"))


_N = "p AS (SELECT p_partkey AS k, 10 * (10 + p_size) AS n, (10 * (10 + p_size) - 50) // 25 AS w FROM part), b AS (SELECT w, 50 + 25 * w AS tokens, count(*) AS c, min('app/P' || k || '.php') AS first_path FROM p GROUP BY ALL)"
_D = chr(36)
SQL = {
    "clone_blocks": f"WITH {_N} SELECT tokens::BIGINT AS tokens, c AS n_places, c AS n_files, first_path FROM b",
    "file_duplication": f"WITH {_N} SELECT 'app/P' || k || '.php' AS path, n::BIGINT AS total, tokens::BIGINT AS duplicated, round(100 * tokens / n, 2) AS pct FROM p JOIN b USING (w)",
    "fix_diffs": f"""WITH s AS (SELECT 'app/Services/S' || s_suppkey || '.php' AS path, s_suppkey AS k, s_nationkey AS n, s_acctbal < 0 AS two, chr(10) AS e FROM supplier)
SELECT path, '--- a/' || path || e || '+++ b/' || path || e || CASE WHEN two THEN '@@ -4,8 +4,8 @@' ELSE '@@ -4,7 +4,7 @@' END || e || ' {{' || e || '     public function f()' || e || '     {{' || e
  || '-        {_D}a = env(''NATION'') . ' || n || ';' || e
  || CASE WHEN two THEN '-        Log::debug({_D}a);' || e || '+        {_D}a = config(''app.nation'') . ' || n || ';' || e || '+        Log::info({_D}a);' || e || '         return {_D}a;' || e || '     }}' || e || ' }}'
     ELSE '+        {_D}a = config(''app.nation'') . ' || n || ';' || e || '         Log::info({_D}a);' || e || '         return {_D}a;' || e || '     }}' END AS diff,
  1 + two::BIGINT AS added, 1 + two::BIGINT AS removed FROM s""",
    "unreachable_rules": """WITH r AS (SELECT p_brand || '/' || p_size AS id, CASE WHEN p_size <> 7 THEN round((p_retailprice - 800) / 1000, 3) END AS c,
  CASE WHEN p_size < 3 THEN 0.2::DOUBLE ELSE 0.65::DOUBLE + CASE WHEN p_type LIKE '%A%' THEN 0 WHEN p_type LIKE '%O%' THEN 0.02::DOUBLE ELSE 0.05::DOUBLE END END AS f FROM part)
SELECT id AS rule_id, round(max_by(c, [c - f, c, f]), 3) AS ceiling, round(max_by(f, [c - f, c, f]), 3) AS floor FROM r GROUP BY id HAVING count(*) = count(c) AND max(c - f) < -1e-9""",
}
QUERIES = {n: globals()[n] for n in SQL}
