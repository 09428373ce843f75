"""Queries over the data flow of PHP sources, with their SQL.

Sources are rendered from the tables, a controller for each order: what a request gives goes through as many variables as the
order's priority says, and then, by its status, through a cast (F), into a redirect behind a loop (P), or into a private
method that builds SQL of it (O). `stock_withdrawals` renders a service for each part. The edges of `taint_spread` are the tables' own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import dealt
from lintlake.operators import dataflow, rules
from lintlake.plans.code import rendered


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def sources(s, d):
    o = dealt(_t(s, d, "orders")).withColumn("k", F.substring("o_orderpriority", 1, 1).cast("int"))
    steps = F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.concat(F.lit("        $v"), i, F.lit(" = trim($v"), i - 1, F.lit(");\n")))
    last = F.concat(F.lit("$v"), F.col("k"))
    ends = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("        $id = (int) "), last, F.lit(";\n        return DB::select(\"select $id\");\n")))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit("        foreach ($rows as $row) {\n            $to = $row ?: "), last, F.lit(";\n        }\n        return redirect($to);\n")))
        .otherwise(F.concat(F.lit("        return $this->load(1, "), last, F.lit(");\n")))
    )
    o = o.withColumn("steps", F.array_join(steps, "")).withColumn("ends", ends)
    return rendered(
        o, "app/Http/Controllers/C[[o_orderkey]]Controller.php",
        "<?php\nclass C[[o_orderkey]]Controller\n{\n    public function show(Request $request)\n    {\n        // $v0 = 'none';\n        $v0 = $request->input('q');\n        $spare = $request->input('unused');\n        $spare = 'fixed';\n"
        "[[steps]][[ends]]    }\n    private function load($n, $key)\n    {\n        $sql = \"select * from t where id = $key\";\n        if ($n) {\n            $sql = $sql . ' limit 1';\n        }\n"
        "        Storage::get($spare);\n        return DB::select($sql);\n    }\n}\n",
    )


def taint_flows(s, d):
    """What reaches a sink: the line that asks, that of the sink, and how many definitions lie between."""
    return dataflow.flows(sources(s, d)).select("path", "unit", F.col("line").cast("long").alias("line"), "kind", "sink", F.col("source_line").cast("long").alias("source_line"), F.col("steps").cast("long").alias("steps"))


def definition_uses(s, d):
    """How many definitions reach each function's uses, by kind of use."""
    return dataflow.uses(dataflow.event_lists(sources(s, d)))


def _part_edges(s, d):
    """Parts to suppliers and suppliers to the orders that they served; returned lines make a value harmless for `sql`, orders after 1996 for `path`."""
    li = _t(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_returnflag", "l_shipdate")
    sql = F.when(F.col("l_returnflag") == "R", F.array(F.lit("sql"))).otherwise(F.array().cast("array<string>"))
    path = F.when(F.year("l_shipdate") > 1996, F.array(F.lit("path"))).otherwise(F.array().cast("array<string>"))
    first = li.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), sql.alias("clears"))
    return first.unionByName(li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("o"), "l_orderkey").alias("dst"), path.alias("clears"))).distinct()


def taint_spread(s, d):
    """How far two kinds spread from the smallest parts over the tables' edges, unless an edge clears them."""
    seeds = _t(s, d, "part").filter("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.explode(F.array(F.lit("sql"), F.lit("path"))).alias("kind"), F.col("p_partkey").alias("origin"))
    return dataflow.spread(seeds, _part_edges(s, d)).select("node", "kind", "origin", F.col("steps").cast("long").alias("steps"))


def services(s, d):
    p = dealt(_t(s, d, "part")).withColumn("field", F.element_at(F.array(*map(F.lit, ("stock", "rating", "seats"))), (F.col("p_size") % 3 + 1).cast("int")))
    guard = F.when(F.col("p_size") < 10, F.concat(F.lit("        if ($part->"), "field", F.lit(" < $n) {\n            return null;\n        }\n"))).otherwise(F.lit(""))
    p = p.withColumn("guard", guard).withColumn("lock", F.when(F.col("p_retailprice") > 1200, F.lit("->lockForUpdate()")).otherwise(F.lit("")))
    return rendered(
        p, "app/Services/Part[[p_partkey]].php",
        "<?php\nclass Part[[p_partkey]]\n{\n    public function take(int $n)\n    {\n        $part = Part::query()[[lock]]->find([[p_partkey]]);\n[[guard]]        $part->decrement('[[field]]', $n);\n    }\n}\n",
    )


def stock_withdrawals(s, d):
    w = dataflow.withdrawals(services(s, d))
    return w.select("path", F.col("line").cast("long").alias("line"), "operation", "field", "amount", "has_floor", "has_lock")


def flow_rule_findings(s, d):
    """Findings of the rules over data flow, over both kinds of sources."""
    ids = ("unsafe-redirect", "ssrf-risk-http-client", "path-traversal-file-access", "insecure-file-download-response", "insecure-deserialization", "negative-stock-not-guarded", "missing-inventory-lock-on-decrement")
    found = rules.scan(sources(s, d).unionByName(services(s, d)), [r for r in rules.RULES if r.rule_id in ids])
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"), F.min("line").cast("long").alias("first_line"))


_O = "o AS (SELECT o_orderkey AS id, o_orderstatus AS st, substr(o_orderpriority, 1, 1)::BIGINT AS k FROM orders)"
# the way of a value as edges: v0 to vk, then $to, or $key, $sql and $sql again
_WAY = """e AS (
  SELECT id, 'v' || (i - 1) AS src, 'v' || i AS dst FROM (SELECT id, unnest(range(1, k + 1)) AS i FROM o)
  UNION ALL SELECT id, 'v' || k, 'to' FROM o WHERE st = 'P' UNION ALL SELECT id, 'v' || k, 'key' FROM o WHERE st = 'O'
  UNION ALL SELECT id, 'key', 'sql' FROM o UNION ALL SELECT id, 'sql', 'sql2' FROM o),
r(id, node, steps) AS (SELECT id, 'v0', 0 FROM o UNION ALL SELECT r.id, dst, steps + 1 FROM r JOIN e ON r.id = e.id AND r.node = e.src)"""
_P = "p AS (SELECT p_partkey, p_size, ['stock', 'rating', 'seats'][p_size % 3 + 1] AS field, p_size < 10 AS has_floor, p_retailprice > 1200 AS has_lock FROM part), w AS (SELECT * FROM p WHERE field <> 'rating')"
SQL = {
    "taint_flows": f"""WITH RECURSIVE {_O}, {_WAY}
SELECT 'app/Http/Controllers/C' || id || 'Controller.php' AS path, 'C' || id || 'Controller::' || CASE st WHEN 'P' THEN 'show' ELSE 'load' END AS unit,
  CASE st WHEN 'P' THEN 13 + k ELSE 19 + k END AS line, CASE st WHEN 'P' THEN 'redirect' ELSE 'sql' END AS kind, CASE st WHEN 'P' THEN 'redirect' ELSE 'DB::select' END AS sink, 7::BIGINT AS source_line, min(steps + 1)::BIGINT AS steps
FROM r JOIN o USING (id) WHERE (st = 'P' AND node = 'to') OR (st = 'O' AND node IN ('sql', 'sql2')) GROUP BY ALL""",
    "definition_uses": f"""WITH {_O}, n AS (SELECT 'app/Http/Controllers/C' || id || 'Controller.php' AS path, st, k FROM o)
SELECT path, 'show' AS "function", 'assign' AS "user", k + CASE st WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS n, k + CASE st WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS n_names FROM n
UNION ALL SELECT path, 'show', 'argument', 1, 1 FROM n WHERE st = 'O'
UNION ALL SELECT path, 'show', 'return', 1, 1 FROM n
UNION ALL SELECT path, 'show', 'sink', 1, 1 FROM n WHERE st <> 'O'
UNION ALL SELECT path, 'load', 'assign', 2, 2 FROM n UNION ALL SELECT path, 'load', 'sink', 2, 1 FROM n UNION ALL SELECT path, 'load', 'return', 2, 1 FROM n""",
    "taint_spread": """WITH RECURSIVE e AS (
  SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'sql' END AS clears FROM lineitem
  UNION SELECT DISTINCT 's' || l_suppkey, 'o' || l_orderkey, CASE WHEN year(l_shipdate) > 1996 THEN 'path' END FROM lineitem),
r(node, kind, origin, steps) AS (
  SELECT 'p' || p_partkey, kind, p_partkey, 0 FROM part, (VALUES ('sql'), ('path')) k(kind) WHERE p_size = 1
  UNION SELECT dst, kind, origin, steps + 1 FROM r JOIN e ON node = src AND kind IS DISTINCT FROM clears)
SELECT node, kind, min(origin) AS origin, min(steps)::BIGINT AS steps FROM r GROUP BY node, kind""",
    "stock_withdrawals": f"""WITH {_P} SELECT 'app/Services/Part' || p_partkey || '.php' AS path, (7 + 3 * has_floor::INT)::BIGINT AS line, 'decrement' AS operation, field, '$n' AS amount, has_floor, has_lock FROM w""",
    "flow_rule_findings": f"""WITH {_O}, {_P}, f AS (
  SELECT 'unsafe-redirect' AS rule_id, 13 + k AS line FROM o WHERE st = 'P'
  UNION ALL SELECT 'negative-stock-not-guarded', 7 FROM w WHERE NOT has_floor
  UNION ALL SELECT 'missing-inventory-lock-on-decrement', 7 + 3 * has_floor::INT FROM w WHERE NOT has_lock)
SELECT rule_id, 'high' AS severity, count(*) AS n, count(*) AS n_files, min(line)::BIGINT AS first_line FROM f GROUP BY rule_id""",
}
QUERIES = {n: globals()[n] for n in SQL}
