"""Queries over facts of PHP sources, with their SQL.

The test tables hold no code, so sources are rendered from them, a file for each row: a controller for each order, a
route file for each supplier, a migration for each part and a template for each page. The facts are then read from
that text alone, and the SQL says from the tables what must be found.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import dealt
from lintlake.operators import graphs, php, rules


def _table(s, d, name):
    return dealt(s.read.parquet(f"{d}/{name}.parquet"))


def rendered(df: DataFrame, path: str, text: str) -> DataFrame:
    """`[[column]]` in path and text stand for columns."""

    def filled(template: str):
        return F.concat(*(F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(re.split(r"\[\[(\w+)\]\]", template))))

    return df.select(filled(path).alias("path"), filled(text).alias("content"))


def controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order a class with as many methods as its priority says; the i-th has i branches, and as decoys a comment and a string."""
    o = _table(spark, sf_dir, "orders").withColumn("k", F.substring("o_orderpriority", 1, 1).cast("int"))
    method = F.transform(
        F.sequence(F.lit(1), F.col("k")),
        lambda i: F.concat(
            F.lit("    private function step"), i, F.lit("(int $a, Part $part)\n    {\n        // if (while) {\n"), F.repeat(F.concat(F.lit("        if ($a) { $this->step"), i + 1, F.lit("($a); }\n")), i),
            F.lit("        return 'for { }';\n    }\n"),
        ),
    )
    body = F.when(F.col("o_orderstatus") == "F", F.lit("    public function run()\n    {\n        return eval(Order::find(1)->code);\n    }\n")).otherwise(F.lit(""))
    o = o.withColumn("methods", F.concat(F.array_join(method, ""), body))
    return rendered(o, "app/Http/Controllers/Order[[o_orderkey]].php", "<?php\nnamespace App\\Orders;\n\nfinal class Order[[o_orderkey]] extends Customer[[o_custkey]] implements Countable, Status[[o_orderstatus]]\n{\n[[methods]]}\n")


def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(
        _table(spark, sf_dir, "supplier"),
        "routes/[[s_suppkey]]/api.php",
        "<?php\nRoute::middleware(['auth', 'throttle:60'])->prefix('n[[s_nationkey]]')->group(function () {\n    Route::get('/s/[[s_suppkey]]', [SupplierController::class, 'show']);\n"
        "    Route::prefix('admin')->group(function () {\n        Route::post('orders', [OrderController::class, 'store'])->middleware('signed');\n    });\n});\n"
        "Route::delete('/s/{id}', function ($id) { return $id; });\n",
    )


def migration_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(
        _table(spark, sf_dir, "part"),
        "database/migrations/[[p_partkey]].php",
        "<?php\nclass M[[p_partkey]] extends Migration\n{\n    public function up(): void\n    {\n        Schema::create('part_[[p_size]]', function (Blueprint $table) {\n            $table->id();\n"
        "            $table->string('name')->index();\n            $table->unsignedBigInteger('brand_id');\n        });\n        Schema::dropIfExists('old_[[p_partkey]]');\n    }\n"
        "    public function down(): void\n    {\n        Schema::dropIfExists('part_[[p_size]]');\n    }\n}\n",
    )


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(_table(spark, sf_dir, "pages"), "views/[[page_id]].blade.php", "<p>\n{!! $request->input('q') !!} {!! $page !!}\n@foreach (User::all() as $u)\n[[page_id]]\n")


def php_classes(s, d):
    src = controllers(s, d)
    c = php.classes(php.declarations(src), src)
    return c.select("path", "fqcn", "parent", F.array_join("interfaces", ",").alias("interfaces"), F.col("last_line").cast("long").alias("last_line"))


def php_methods(s, d):
    m = php.methods(php.declarations(controllers(s, d)))
    return m.select("class", "name", "visibility", F.array_join("params", ",").alias("params"), F.array_join("calls", ",").alias("calls"), F.col("loc").cast("long").alias("loc"), F.col("cyclomatic").cast("long").alias("cyclomatic"))


def php_dependencies(s, d):
    src = controllers(s, d)
    declared = graphs.cut(php.declarations(src))  # five kinds of dependencies are read from it
    return php.dependencies(php.classes(declared, src), php.methods(declared)).groupBy("how", "raw").agg(F.count("*").alias("n"))


def php_routes(s, d):
    return php.routes(route_files(s, d)).select("path", F.col("line").cast("long").alias("line"), "verb", "uri", "controller", "action", F.array_join("middleware", ",").alias("middleware"), "is_closure")


def php_migrations(s, d):
    return php.migrations(php.declarations(migration_files(s, d))).select("path", "op", "table", "column", "type", "indexed")


def blade_marks(s, d):
    return php.template_marks(templates(s, d)).select("path", F.col("line").cast("long").alias("line"), "kind", "context")


def fact_rule_findings(s, d):
    src = controllers(s, d).unionByName(route_files(s, d)).unionByName(migration_files(s, d)).unionByName(templates(s, d))
    return rules.scan(src).groupBy("rule_id", "severity", "classification").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"), F.countDistinct("fingerprint").alias("n_fingerprints"))


_ORDERS = "o AS (SELECT *, substr(o_orderpriority, 1, 1)::INT AS k, 'Order' || o_orderkey AS class, (o_orderstatus = 'F')::INT AS f FROM orders)"
_STEPS = f"{_ORDERS}, m AS (SELECT *, unnest(range(1, k + 1)) AS i FROM o)"
SQL = {
    # a step has its head, two braces, a comment, a return and i branches
    "php_classes": f"""WITH {_ORDERS} SELECT 'app/Http/Controllers/' || class || '.php' AS path, 'App\\Orders\\' || class AS fqcn, 'Customer' || o_custkey AS parent,
  'Countable,Status' || o_orderstatus AS interfaces, (5 + 5 * k + k * (k + 1) // 2 + 4 * f + 1)::BIGINT AS last_line FROM o""",
    "php_methods": f"""WITH {_STEPS} SELECT class, 'step' || i AS name, 'private' AS visibility, 'a,part' AS params, 'step' || (i + 1) AS calls, (5 + i)::BIGINT AS loc, (1 + i)::BIGINT AS cyclomatic FROM m
UNION ALL SELECT class, 'run', 'public', '', 'find', 4, 1 FROM o WHERE f = 1""",
    "php_dependencies": f"""WITH {_ORDERS} SELECT 'extends' AS how, 'Customer' || o_custkey AS raw, count(*) AS n FROM o GROUP BY ALL
UNION ALL SELECT 'implements', 'Countable', count(*) FROM o HAVING count(*) > 0 UNION ALL SELECT 'implements', 'Status' || o_orderstatus, count(*) FROM o GROUP BY ALL UNION ALL SELECT 'static', 'Order', count(*) FROM o WHERE f = 1 HAVING count(*) > 0""",
    "php_routes": """SELECT 'routes/' || s_suppkey || '/api.php' AS path, 3::BIGINT AS line, 'get' AS verb, '/n' || s_nationkey || '/s/' || s_suppkey AS uri, 'SupplierController' AS controller, 'show' AS action,
  'auth,throttle:60' AS middleware, false AS is_closure FROM supplier
UNION ALL SELECT 'routes/' || s_suppkey || '/api.php', 5, 'post', '/n' || s_nationkey || '/admin/orders', 'OrderController', 'store', 'auth,throttle:60,signed', false FROM supplier
UNION ALL SELECT 'routes/' || s_suppkey || '/api.php', 8, 'delete', '/s/{id}', NULL, NULL, '', true FROM supplier""",
    "php_migrations": """SELECT 'database/migrations/' || p_partkey || '.php' AS path, 'create' AS op, 'part_' || p_size AS "table", 'name' AS "column", 'string' AS type, true AS indexed FROM part
UNION ALL SELECT 'database/migrations/' || p_partkey || '.php', 'create', 'part_' || p_size, 'brand_id', 'unsignedBigInteger', false FROM part
UNION ALL SELECT 'database/migrations/' || p_partkey || '.php', 'dropIfExists', 'old_' || p_partkey, NULL, NULL, NULL FROM part""",
    "blade_marks": """SELECT 'views/' || page_id || '.blade.php' AS path, 2::BIGINT AS line, 'raw_echo' AS kind, '{!! $request->input(''q'') !!}' AS context FROM pages
UNION ALL SELECT 'views/' || page_id || '.blade.php', 2, 'raw_echo', '{!! $page !!}' FROM pages UNION ALL SELECT 'views/' || page_id || '.blade.php', 3, 'query', 'User::all(' FROM pages""",
    # fingerprints are of rule, file and context, so repeated contexts of a file share one
    "fact_rule_findings": f"""WITH {_STEPS}, r AS (
  SELECT 'unused-private-method' AS rule_id, 'low' AS severity, 'advisory' AS classification, count(*) AS n, count(*) AS n_files FROM o
  UNION ALL SELECT 'unsafe-eval', 'high', 'defect', sum(f), sum(f) FROM o
  UNION ALL SELECT 'controller-query-direct', 'high', 'risk', sum(f), sum(f) FROM o
  UNION ALL SELECT 'missing-strict-types', 'medium', 'advisory', (SELECT count(*) FROM o) + (SELECT count(*) FROM part), (SELECT count(*) FROM o) + (SELECT count(*) FROM part)
  UNION ALL SELECT 'no-closure-routes', 'medium', 'advisory', count(*), count(*) FROM supplier
  UNION ALL SELECT 'missing-auth-on-mutating-api-routes', 'high', 'risk', count(*), count(*) FROM supplier
  UNION ALL SELECT 'blade-queries', 'high', 'risk', count(*), count(*) FROM pages
  UNION ALL SELECT 'blade-xss-risk', 'medium', 'risk', count(*), count(*) FROM pages
  UNION ALL SELECT 'destructive-migration-without-safety-guard', 'high', 'risk', count(*), count(*) FROM part
  UNION ALL SELECT 'missing-index-on-lookup-columns', 'medium', 'risk', count(*), count(*) FROM part
), dup AS (
  SELECT s_suppkey AS id, 'd' AS route, row_number() OVER (ORDER BY 'routes/' || s_suppkey) AS place FROM supplier
  UNION ALL SELECT s_suppkey, 'p', row_number() OVER (PARTITION BY s_nationkey ORDER BY 'routes/' || s_suppkey) FROM supplier
)
SELECT rule_id, severity, classification, n::BIGINT AS n, n_files::BIGINT AS n_files, n::BIGINT AS n_fingerprints FROM r WHERE n > 0
UNION ALL SELECT 'duplicate-route-definition', 'high', 'defect', count(*), count(DISTINCT id), count(*) FROM dup WHERE place > 1 HAVING count(*) > 0""",
}
QUERIES = {n: globals()[n] for n in SQL}
