"""Queries over flows, chains of calls and complexity, with their SQL.

Flows go over the tables' own edges. Classes are rendered from the parts: a chain of methods as long as the part's size says, a
ring at its end where the part is dear, and a method that is nested as deep.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import dealt
from lintlake.operators import callmap, complexity, graphs, php
from lintlake.plans.code import rendered

BUDGET = 30


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def project_flows(s, d):
    """Of each customer: orders, then their parts, within a budget; who ships them isn't followed."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders, lines = _t(s, d, "orders"), _t(s, d, "lineitem")
    edges = orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.lit("places").alias("type"))
    edges = edges.unionByName(lines.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"), F.lit("holds").alias("type")))
    edges = edges.unionByName(lines.select(name("o", "l_orderkey").alias("src"), name("s", "l_suppkey").alias("dst"), F.lit("ships").alias("type")))
    found = callmap.flows(edges, _t(s, d, "customer").select(name("c", "c_custkey").alias("node")), ["places", "holds"], max_nodes=BUDGET)
    return found.groupBy("start", "n_nodes", "truncated", "cycle").agg(F.max("depth").cast("long").alias("deepest"), F.max("node").alias("last"))


def classes(s, d):
    p = dealt(_t(s, d, "part")).withColumn("n", F.expr("6 + p_size div 10")).withColumn("ring", F.col("p_retailprice") > 1200)
    last = F.when(F.col("ring"), F.concat(F.lit("$this->m"), F.col("n") - 1, F.lit("();"))).otherwise(F.lit("// $this->m1();"))
    body = lambda i: F.when(i < F.col("n"), F.concat(F.lit("$this->m"), i + 1, F.lit("();"))).otherwise(last)
    methods = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("    function m"), i, F.lit("()\n    {\n        "), body(i), F.lit("\n    }\n")))
    depth = F.col("n") - 5
    deep = F.concat(F.lit("    function deep($a)\n    {\n"), F.repeat(F.lit("        if ($a && deep($a)) {\n"), depth), F.lit("        $x = $a ? 1 : 2;\n"), F.repeat(F.lit("        }\n"), depth), F.lit("    }\n"))
    flat = F.when(F.col("ring"), F.lit("    function flat($a)\n    {\n        foreach ($a as $b) {\n            if ($b) {\n                g();\n            } elseif ($a || $b) {\n                h();\n            } else {\n                i();\n            }\n        }\n    }\n")).otherwise(F.lit(""))
    p = p.withColumn("methods", F.concat(F.array_join(methods, ""), deep, flat))
    return rendered(p, "app/Parts/P[[p_partkey]].php", "<?php\nnamespace App\\Parts;\nclass P[[p_partkey]]\n{\n[[methods]]}\n")


def call_chains(s, d):
    """The longest chains from each class's first method, of eight calls and more."""
    src = classes(s, d)
    graphs.shared(src)
    declared = graphs.cut(php.declarations(src))  # files are parsed once
    edges = graphs.cut(callmap.call_edges(graphs.cut(php.classes(declared, src)), graphs.cut(php.methods(declared))))
    starts = edges.select(F.col("src").alias("node")).filter("node like '%::m1'").distinct()
    chains = callmap.longest_chains(edges, starts, callmap.DEEP_CHAIN)
    return chains.select("start", "depth", "cyclic", F.size("path").cast("long").alias("n_steps"), F.element_at("path", -1).alias("last"))


def cognitive_complexity(s, d):
    m = complexity.measures(classes(s, d)).filter("name in ('deep', 'flat')")
    return m.select("path", "name", F.col("cyclomatic").cast("long").alias("cyclomatic"), F.col("cognitive").cast("long").alias("cognitive"), F.col("nesting").cast("long").alias("nesting"))


def complexity_hotspots(s, d):
    return complexity.hotspots(complexity.measures(classes(s, d))).select("method", F.col("cognitive").cast("long").alias("cognitive"), F.col("cyclomatic").cast("long").alias("cyclomatic"))


_P = "p AS (SELECT p_partkey AS k, 6 + p_size // 10 AS n, 1 + p_size // 10 AS d, p_retailprice > 1200 AS ring FROM part)"
# d conditions of two parts each within each other, and a choice in the innermost
_M = """m AS (SELECT k, 'deep' AS name, 2 + 2 * d AS cyclomatic, d * (d + 1) // 2 + d + 1 + d AS cognitive, d + 1 AS nesting FROM p
UNION ALL SELECT k, 'flat', 5, 1 + 2 + 2 + 1 + 2, 2 FROM p WHERE ring)"""
SQL = {
    "project_flows": f"""WITH o AS (SELECT DISTINCT 'c' || o_custkey AS start, 'o' || o_orderkey AS o FROM orders),
k1 AS (SELECT start, o FROM o QUALIFY row_number() OVER (PARTITION BY start ORDER BY o) <= {BUDGET - 1}),
n1 AS (SELECT 'c' || c_custkey AS start, count(o) AS n FROM customer LEFT JOIN k1 ON start = 'c' || c_custkey GROUP BY ALL),
e AS (SELECT DISTINCT start, o, 'p' || l_partkey AS p FROM k1 JOIN lineitem ON 'o' || l_orderkey = o),
k2 AS (SELECT start, p FROM (SELECT DISTINCT start, p FROM e) JOIN n1 USING (start) QUALIFY row_number() OVER (PARTITION BY start ORDER BY p) <= {BUDGET - 1} - n),
f AS (SELECT start, count(*) AS n_edges FROM e SEMI JOIN k2 ON e.start = k2.start AND e.p = k2.p GROUP BY start),
n2 AS (SELECT start, count(*) AS n, max(p) AS last FROM k2 GROUP BY start), l AS (SELECT start, max(o) AS last FROM k1 GROUP BY start)
SELECT n1.start, 1 + n1.n + coalesce(n2.n, 0) AS n_nodes, 1 + n1.n + coalesce(n2.n, 0) >= {BUDGET} AS truncated, coalesce(f.n_edges, 0) > coalesce(n2.n, 0) AS cycle,
  (n1.n > 0)::BIGINT + (n2.n IS NOT NULL)::BIGINT AS deepest, coalesce(n2.last, l.last, n1.start) AS last
FROM n1 LEFT JOIN n2 USING (start) LEFT JOIN f USING (start) LEFT JOIN l USING (start)""",
    "call_chains": f"""WITH {_P} SELECT 'App\\Parts\\P' || k || '::m1' AS start, n::BIGINT AS depth, ring AS cyclic, (n - ring::INT)::BIGINT AS n_steps, 'App\\Parts\\P' || k || '::m' || CASE WHEN ring THEN least('' || n, '' || (n - 1)) ELSE '' || n END AS last
FROM p WHERE n >= 8""",
    "cognitive_complexity": f"WITH {_P}, {_M} SELECT 'app/Parts/P' || k || '.php' AS path, name, cyclomatic::BIGINT AS cyclomatic, cognitive::BIGINT AS cognitive, nesting::BIGINT AS nesting FROM m",
    "complexity_hotspots": f"WITH {_P}, {_M} SELECT 'P' || k || '::' || name AS method, cognitive::BIGINT AS cognitive, cyclomatic::BIGINT AS cyclomatic FROM m ORDER BY cognitive DESC, cyclomatic DESC, method LIMIT 10",
}
QUERIES = {n: globals()[n] for n in SQL}
