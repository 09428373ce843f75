"""Queries over what bodies of PHP do with data, with their SQL. The sources are rendered: a controller for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import dealt
from lintlake.operators import bodies, php, rules, ruleset
from lintlake.plans.code import rendered

#: Half of the controllers load two relations, a fifth check a third field; a heredoc is a decoy.
CONTROLLER = """<?php
declare(strict_types=1);
namespace App\\Http\\Controllers;

class Customer[[c_custkey]]Controller extends Controller
{
    public function index(Request $request)
    {
        $request->validate([
            'name' => 'required|max:[[c_nationkey]]',
            'tags' => ['array', 'min:1'],
[[third]]        ]);
        $text = <<<SQL
            foreach ($a as $b) { Order::all(); }
            SQL;
        $orders = Order::[[eager]]where('c', [[c_custkey]])->get();
        foreach ($orders as $order) {
            $order->customer->touch();
            $order->lines()->first();
            Part::where('id', $order->id)->first();
            log($order->id);
        }
        return $orders->map(fn ($o) => $o->clerk->name);
    }
}
"""
RULES = [r for r in rules.RULES if r.rule_id in ("n-plus-one-risk", "eager-loading", "column-selection-suggestion", "controller-inline-validation", "missing-form-request")]


def controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet"))
    third = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("            'segment' => 'in:A,B',\n")).otherwise(F.lit(""))
    c = c.withColumn("third", third).withColumn("eager", F.when(F.col("c_nationkey") % 2 == 0, F.lit("with('customer', 'clerk')->")).otherwise(F.lit("")))
    return rendered(c, "app/Http/Controllers/Customer[[c_custkey]]Controller.php", CONTROLLER)


def body_loops(s, d):
    return bodies.loops(controllers(s, d)).select("path", F.col("line").cast("long").alias("line"), F.col("last_line").cast("long").alias("last_line"), "kind", "collection", "variable")


def body_queries(s, d):
    q = bodies.queries(controllers(s, d))
    return q.select("path", F.col("line").cast("long").alias("line"), "model", F.array_join("chain", ",").alias("chain"), "type", "is_eager", "in_loop", "n_plus_one_risk")


def relation_accesses(s, d):
    a = bodies.accesses(controllers(s, d))
    return a.groupBy("collection", "variable", "relation", "how").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"))


def lazy_relations(s, d):
    src = controllers(s, d)
    found = bodies.lazy_accesses(bodies.accesses(src), bodies.loaded(src))
    return found.select("path", F.col("line").cast("long").alias("line"), F.col("loop_line").cast("long").alias("loop_line"), "collection", "relation", "n")


def validation_fields(s, d):
    v = bodies.validations(php.methods(php.declarations(controllers(s, d))))
    return v.select("path", "class", "method", "kind", F.col("ord").cast("long").alias("ord"), "field", F.array_join("rules", ";").alias("rules"))


def body_rule_findings(s, d):
    return rules.scan(controllers(s, d), RULES).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"), F.countDistinct("context").alias("n_contexts"))


def rule_calibration(s, d):
    part = s.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("rule_id"), F.lit(True).alias("enabled"), F.col("p_brand").alias("severity"), F.create_map(F.lit("size"), F.col("p_size").cast("long")).alias("thresholds")
    )
    line = s.read.parquet(f"{d}/lineitem.parquet")
    patches = line.select(
        F.col("l_partkey").alias("rule_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_returnflag") == "R", F.lit(False)).when(F.col("l_returnflag") == "A", F.lit(True)).alias("enabled"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("level"), "l_linenumber")).alias("severity"),
        F.create_map(F.when(F.col("l_linenumber") > 2, F.lit("size")).otherwise(F.concat(F.lit("from"), F.col("l_suppkey") % 3)), F.col("l_quantity").cast("long")).alias("thresholds"),
    )
    out = ruleset.calibrated(part, patches)
    listed = F.array_sort(F.transform(F.map_entries("thresholds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return out.select("rule_id", "enabled", "severity", F.array_join(listed, ",").alias("thresholds"))


_C = "c AS (SELECT *, 'Customer' || c_custkey || 'Controller' AS class, 'app/Http/Controllers/Customer' || c_custkey || 'Controller.php' AS path, (c_mktsegment = 'BUILDING')::INT AS e, c_nationkey % 2 AS lazy FROM customer)"
SQL = {
    "body_loops": f"""WITH {_C} SELECT path, (17 + e)::BIGINT AS line, (22 + e)::BIGINT AS last_line, 'foreach' AS kind, '$orders' AS collection, 'order' AS variable FROM c
UNION ALL SELECT path, 23 + e, 23 + e, 'map', '$orders', 'o' FROM c""",
    "body_queries": f"""WITH {_C} SELECT path, (16 + e)::BIGINT AS line, 'Order' AS model, CASE WHEN lazy = 1 THEN 'where,get' ELSE 'with,where,get' END AS chain, 'select' AS type, lazy = 0 AS is_eager, false AS in_loop, false AS n_plus_one_risk FROM c
UNION ALL SELECT path, 20 + e, 'Part', 'where,first', 'select', false, true, true FROM c""",
    "relation_accesses": """SELECT '$orders' AS collection, v.* , (SELECT count(*) FROM customer) * CASE WHEN relation = 'id' THEN 2 ELSE 1 END AS n, (SELECT count(*) FROM customer) AS n_files
FROM (VALUES ('order', 'customer', 'chained'), ('order', 'lines', 'query'), ('order', 'id', 'attribute'), ('o', 'clerk', 'chained')) v(variable, relation, how) WHERE EXISTS (SELECT 1 FROM customer)""",
    "lazy_relations": f"""WITH {_C} SELECT path, (18 + e)::BIGINT AS line, (17 + e)::BIGINT AS loop_line, '$orders' AS collection, 'customer' AS relation, 1::BIGINT AS n FROM c WHERE lazy = 1
UNION ALL SELECT path, 19 + e, 17 + e, '$orders', 'lines', 1 FROM c UNION ALL SELECT path, 23 + e, 23 + e, '$orders', 'clerk', 1 FROM c WHERE lazy = 1""",
    "validation_fields": f"""WITH {_C} SELECT path, class, 'index' AS method, 'inline' AS kind, 0::BIGINT AS ord, 'name' AS field, 'required;max:' || c_nationkey AS rules FROM c
UNION ALL SELECT path, class, 'index', 'inline', 1, 'tags', 'array;min:1' FROM c UNION ALL SELECT path, class, 'index', 'inline', 2, 'segment', 'in:A,B' FROM c WHERE e = 1""",
    "body_rule_findings": f"""WITH {_C}, f AS (
  SELECT 'n-plus-one-risk' AS rule_id, 'high' AS severity, path, '$orders->lines' AS context FROM c UNION ALL SELECT 'n-plus-one-risk', 'high', path, '$orders->customer' FROM c WHERE lazy = 1
  UNION ALL SELECT 'n-plus-one-risk', 'high', path, '$orders->clerk' FROM c WHERE lazy = 1 UNION ALL SELECT 'eager-loading', 'medium', path, 'Part' FROM c
  UNION ALL SELECT 'column-selection-suggestion', 'low', path, 'Order' || lazy FROM c UNION ALL SELECT 'controller-inline-validation', 'medium', path, class FROM c
  UNION ALL SELECT 'missing-form-request', 'medium', path, class FROM c WHERE e = 1)
SELECT rule_id, severity, count(*) AS n, count(DISTINCT path) AS n_files, count(DISTINCT context) AS n_contexts FROM f GROUP BY ALL""",
    "rule_calibration": """WITH p AS (SELECT l_partkey AS rule_id, l_orderkey * 100 + l_linenumber AS ord, CASE l_returnflag WHEN 'R' THEN false WHEN 'A' THEN true END AS enabled,
  CASE WHEN l_linestatus = 'O' THEN 'level' || l_linenumber END AS severity, CASE WHEN l_linenumber > 2 THEN 'size' ELSE 'from' || (l_suppkey % 3) END AS k, l_quantity::BIGINT AS v FROM lineitem),
s AS (SELECT rule_id, arg_max(enabled, row(ord, enabled)) FILTER (enabled IS NOT NULL) AS enabled, arg_max(severity, row(ord, severity)) FILTER (severity IS NOT NULL) AS severity FROM p GROUP BY rule_id),
t AS (SELECT rule_id, k, arg_max(v, row(ord, v)) AS v FROM (SELECT rule_id, k, v, ord FROM p UNION ALL SELECT p_partkey, 'size', p_size::BIGINT, -1 FROM part) GROUP BY rule_id, k),
l AS (SELECT rule_id, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS thresholds FROM t GROUP BY rule_id)
SELECT p_partkey AS rule_id, coalesce(s.enabled, true) AS enabled, coalesce(s.severity, p_brand) AS severity, l.thresholds FROM part LEFT JOIN s ON s.rule_id = p_partkey JOIN l ON l.rule_id = p_partkey""",
}
QUERIES = {n: globals()[n] for n in SQL}
