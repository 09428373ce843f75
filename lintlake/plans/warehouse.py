"""Queries over the star tables and the events, which stand in for scan history, edges and configuration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lintlake.operators import changes, filters, graphs, remediation, ruleset

def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def dep_edges(s, d):
    e = _t(s, d, "lineitem").select((F.col("l_partkey") % 97).alias("src"), (F.col("l_suppkey") % 89).alias("dst"))
    return graphs.simple(e)


def out_degree_topk(s, d):
    return graphs.degrees(dep_edges(s, d)).orderBy(F.desc("out_degree"), F.desc("in_degree"), "node").limit(10)


def unique_basename_resolution(s, d):
    known = _t(s, d, "part").select(F.concat(F.lit("App\\"), F.col("p_brand"), F.lit("\\"), F.col("p_type")).alias("fqcn")).distinct()
    raw = _t(s, d, "part").select(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lit("App\\"), F.col("p_brand"), F.lit("\\"), F.col("p_type"))).alias("raw")).distinct()
    return graphs.unresolved_to_known(raw, known)


def anti_unused(s, d):
    return _t(s, d, "customer").join(_t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def tenant_index_anti(s, d):
    busy = _t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("k"))
    indexed = _t(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return busy.filter("k > 2").join(indexed, "o_custkey", "left_anti").select("o_custkey", "n", "k")


def route_dup_groups(s, d):
    o = _t(s, d, "orders").select("o_custkey", F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("m"), "o_orderkey")
    return o.groupBy("o_custkey", F.date_format("m", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key")).filter("n > 1")


def method_like_metrics(s, d):
    g = _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("loc"), F.countDistinct("l_partkey").alias("coupling"), F.countDistinct("l_returnflag").alias("params"))
    c = 1 + F.floor(F.col("loc") / 15) + F.floor(F.col("coupling") / 4) + F.col("params")
    return g.select("l_orderkey", "loc", "coupling", "params", c.cast("long").alias("complexity"), F.least(F.greatest(F.floor((c - 1) / 3), F.lit(0)), F.lit(8)).cast("long").alias("nesting"))


def history_trend(s, d):
    e = _t(s, d, "events").select(F.col("user_id").alias("project"), "ts", "event_id", "value")
    return changes.trend(e, "project", ["ts", "event_id"], "value")


def history_keep_n(s, d):
    return changes.keep_last(_t(s, d, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id")


def change_detection(s, d):
    docs = _t(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("t"), "doc_id")
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16).alias("hash")
    now = docs.filter("doc_id % 10 != 1").select("path", short(F.col("t")))
    before = docs.filter("doc_id % 10 != 0").select("path", short(F.when(F.col("doc_id") % 7 == 0, F.concat("t", F.lit("x"))).otherwise(F.col("t"))))
    return changes.changed_files(now, before)


def feedback_pivot(s, d):
    kinds = ["click", "error", "view"]
    return _t(s, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_id")).na.fill(0).select("user_id", *(F.col(k).alias(f"n_{k}") for k in kinds))


def memory_factor(s, d):
    g = _t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("skipped"), F.count_if(F.col("event_type") == "purchase").alias("fixed"))
    factor = F.when(F.col("skipped") / F.col("n") >= 0.6, 0.88).when(F.col("fixed") / F.col("n") >= 0.65, 1.08).otherwise(1.0)
    return g.select("user_id", "n", "skipped", "fixed", factor.alias("factor"))


def fix_confidence(s, d):
    c = 0.35 * F.col("l_discount") + 0.25 * F.col("l_tax") + 0.2 * (F.col("l_quantity") / 50) + 0.2 * (F.col("l_linenumber") / 7)
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(c, 4).alias("confidence"))


def default_disable_config(s, d):
    rules = _t(s, d, "nation").select(F.col("n_name").alias("rule_id"))
    config = s.createDataFrame([(f"NATION_{i}", i % 3 != 0) for i in range(0, 25, 2)], "rule_id string, enabled boolean")
    return ruleset.enabled(rules, config)


def rule_applicability(s, d):
    """Parts stand in for rules: their brand is the family, their type the project types that they name."""
    rules = _t(s, d, "part").select(
        F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("family"), F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("project_types"),
        (F.col("p_size") > 10).alias("enabled"),
    )
    first = _t(s, d, "part").agg(F.min("p_type").alias("project_type"), F.array(F.min("p_brand"), F.max("p_brand")).alias("families"))
    return ruleset.applicable(rules, first).select("rule_id", "family")


def alias_resolution(s, d):
    aliases = _t(s, d, "supplier").select(F.col("s_suppkey").alias("alias"), F.col("s_nationkey").cast("long").alias("canonical")).filter("alias % 3 = 0")
    return ruleset.resolved(_t(s, d, "lineitem").select(F.col("l_suppkey").alias("rule_id")), aliases)


def ledger_breaks(s, d):
    """Each event is an entry whose hash is that of its own fields; every seventh names another entry than the one before it."""
    own = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256)
    before = F.lag("entry_hash").over(Window.partitionBy("user_id").orderBy("event_id"))
    chain = _t(s, d, "events").select("user_id", "event_id", own.alias("entry_hash")).withColumn("prev_hash", F.when(F.col("event_id") % 7 == 0, F.lit("x")).otherwise(before))
    return remediation.broken_links(chain, "user_id", ["event_id"]).select("user_id", "event_id")


def ledger_replay(s, d):
    return remediation.replayed(_t(s, d, "events").withColumn("task", F.col("event_id") % 5), "user_id", "task", "event_id", "event_type")


def category_trend(s, d):
    scans = _t(s, d, "orders").select(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("project"), "o_orderdate", "o_orderkey", "o_totalprice")
    return changes.trend(scans, "project", ["o_orderdate", "o_orderkey"], "o_totalprice", limit=5, least=1000.0)


def import_resolution(s, d):
    """Parts stand in for files: a part's file imports that of its brand, which has one of several endings or none."""
    part = _t(s, d, "part")
    files = part.select(F.concat(F.lit("src/"), F.col("p_brand"), F.when(F.col("p_size") % 3 == 0, ".ts").when(F.col("p_size") % 3 == 1, "/index.js").otherwise(".css")).alias("path"))
    imports = part.select(F.concat(F.lit("src/app/"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), F.concat(F.when(F.col("p_size") % 2 == 0, "../").otherwise("@/"), F.col("p_brand")).alias("target"))
    return graphs.resolved_imports(imports, files, {"@/": "src/"})


def class_hierarchy(s, d):
    """Customers stand in for classes: each extends the one at half its number."""
    c = _t(s, d, "customer").select(F.col("c_custkey").alias("node"))
    return graphs.ancestors(c.select("node", F.when(F.floor(F.col("node") / 2) >= 1, F.floor(F.col("node") / 2)).alias("parent")))


def inline_suppressed(s, d):
    """Orders stand in for files of three lines: a mark, which may be for the next line and may have passed, and two findings."""
    o = _t(s, d, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") % 4).alias("k"),
        F.concat(F.lit("// @lint-ignore"), F.when(F.col("o_orderkey") % 2 == 0, "-next-line").otherwise(""), F.lit(" rule-"), (F.col("o_orderkey") % 3).cast("string"), F.lit(" until:"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("content"),
    )
    marks = filters.inline_marks(o.select("path", F.lit(1).alias("line"), "content"), "1996-01-01")
    found = o.select(F.col("path").alias("file"), F.explode(F.array(F.lit(2), F.lit(3))).alias("line"), F.concat(F.lit("rule-"), (F.col("k") % 3).cast("string")).alias("rule_id"))
    return filters.without_inline(found, marks)


def ruleset_overlay(s, d):
    base = _t(s, d, "nation").select(F.col("n_name").alias("rule_id"), F.col("n_regionkey").alias("level"))
    user = _t(s, d, "nation").filter("n_nationkey % 4 = 0").select(F.col("n_name").alias("rule_id"), (F.col("n_regionkey") + 10).alias("level"))
    return ruleset.overlaid(base, user)


def _edges(s, d):
    """Edges between nations, by how many customers and suppliers each has."""
    owed = _t(s, d, "customer").groupBy(F.col("c_nationkey").alias("src")).agg(F.count("*").alias("n"))
    lent = _t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("m"))
    # a row a nation on either side
    return graphs.simple(owed.join(F.broadcast(lent), F.expr("pmod(n * 7 + src, 25) = dst or pmod(m * 11 + dst, 25) = src")))


def scc(s, d):
    return graphs.cycles(_edges(s, d))


def bfs(s, d):
    e = _edges(s, d)
    return graphs.reach(e, e.agg(F.min("src").alias("node"))).select("start", "node", "depth")


def _part_edges(s, d):
    return graphs.simple(_t(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


def dep_scc(s, d):
    return graphs.cycles(_part_edges(s, d))


def dep_bfs(s, d):
    e = _part_edges(s, d)
    return graphs.reach(e, e.agg(F.max("src").alias("node")), max_depth=None).select("start", "node", "depth")


_E = "e AS (SELECT DISTINCT l_partkey % 97 AS src, l_suppkey % 89 AS dst FROM lineitem WHERE l_partkey % 97 <> l_suppkey % 89)"
_CONFIG = ", ".join(f"('NATION_{i}', {str(i % 3 != 0).lower()})" for i in range(0, 25, 2))
_CLOSURE = """o AS (SELECT c_nationkey AS src, count(*) AS n FROM customer GROUP BY ALL), l AS (SELECT s_nationkey AS dst, count(*) AS m FROM supplier GROUP BY ALL),
e AS (SELECT DISTINCT src, dst FROM o JOIN l ON (n * 7 + src) % 25 = dst OR (m * 11 + dst) % 25 = src WHERE src <> dst),
r(a, b, n) AS (SELECT src, dst, 1 FROM e UNION SELECT a, dst, n + 1 FROM r JOIN e ON b = src WHERE n < 25)"""

_PARTS = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey)"

SQL = {
    "dep_edges": f"WITH {_E} SELECT src, dst FROM e",
    "out_degree_topk": f"""WITH {_E}, o AS (SELECT src AS node, count(*) AS out_degree FROM e GROUP BY src), i AS (SELECT dst AS node, count(*) AS in_degree FROM e GROUP BY dst)
SELECT node, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree FROM o FULL JOIN i USING (node) ORDER BY out_degree DESC, in_degree DESC, node LIMIT 10""",
    "unique_basename_resolution": r"""WITH k AS (SELECT DISTINCT 'App\' || p_brand || '\' || p_type AS fqcn, p_type FROM part),
r AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'App\' || p_brand || '\' || p_type END AS raw FROM part),
b AS (SELECT p_type AS base, min(fqcn) AS only_one FROM k GROUP BY p_type HAVING count(*) = 1)
SELECT raw, coalesce(k.fqcn, CASE WHEN NOT contains(raw, '\') THEN only_one END) AS fqcn FROM r LEFT JOIN k ON raw = k.fqcn LEFT JOIN b ON raw = base""",
    "anti_unused": "SELECT c_custkey, c_mktsegment FROM customer ANTI JOIN orders ON c_custkey = o_custkey",
    "tenant_index_anti": """SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS k FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 2""",
    "route_dup_groups": "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
    "method_like_metrics": """WITH g AS (SELECT l_orderkey, count(*) AS loc, count(DISTINCT l_partkey) AS coupling, count(DISTINCT l_returnflag) AS params FROM lineitem GROUP BY 1),
c AS (SELECT *, 1 + loc // 15 + coupling // 4 + params AS complexity FROM g)
SELECT *, least(greatest((complexity - 1) // 3, 0), 8) AS nesting FROM c""",
    "history_trend": """WITH k AS (SELECT user_id AS project, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
g AS (SELECT project, count(*) AS n_scans, arg_max(value, n) AS first_score, arg_min(value, n) AS last_score FROM k WHERE n <= 10 GROUP BY project)
SELECT *, CASE WHEN n_scans < 2 THEN 'insufficient_data' WHEN last_score - first_score > 5 THEN 'improving' WHEN last_score - first_score < -5 THEN 'regressing' ELSE 'stable' END AS direction FROM g""",
    "history_keep_n": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5",
    "change_detection": """WITH n AS (SELECT doc_id::VARCHAR AS path, coalesce(text, '') AS t FROM documents WHERE doc_id % 10 <> 1),
b AS (SELECT doc_id::VARCHAR AS path, coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END AS t FROM documents WHERE doc_id % 10 <> 0)
SELECT path, CASE WHEN b.t IS NULL THEN 'added' WHEN n.t IS NULL THEN 'deleted' WHEN n.t <> b.t THEN 'modified' ELSE 'unchanged' END AS change FROM n FULL JOIN b USING (path)""",
    "feedback_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("click", "error", "view")) + " FROM events GROUP BY user_id",
    "memory_factor": """WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS skipped, count(*) FILTER (event_type = 'purchase') AS fixed FROM events GROUP BY 1)
SELECT *, CASE WHEN skipped / n >= 0.6 THEN 0.88 WHEN fixed / n >= 0.65 THEN 1.08 ELSE 1 END::DOUBLE AS factor FROM g""",
    "fix_confidence": """SELECT l_orderkey, l_linenumber, round_even(0.35::DOUBLE * l_discount + 0.25::DOUBLE * l_tax + 0.2::DOUBLE * (l_quantity / 50) + 0.2::DOUBLE * (l_linenumber / 7), 4) AS confidence FROM lineitem""",
    "default_disable_config": f"WITH c(rule_id, enabled) AS (VALUES {_CONFIG}) SELECT n_name AS rule_id, coalesce(enabled, false) AS enabled FROM nation LEFT JOIN c ON n_name = rule_id",
    "rule_applicability": """WITH p AS (SELECT min(p_type) AS t, min(p_brand) AS a, max(p_brand) AS b FROM part)
SELECT p_partkey AS rule_id, p_brand AS family FROM part, p WHERE p_size > 10 AND p_brand IN (a, b) AND (p_size % 2 <> 0 OR p_type = t)""",
    "alias_resolution": """SELECT DISTINCT coalesce(s_nationkey::BIGINT, l_suppkey) AS rule_id FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) ON l_suppkey = s_suppkey""",
    "ledger_breaks": "SELECT user_id, event_id FROM events WHERE event_id % 7 = 0",
    "ledger_replay": "SELECT user_id, event_id % 5 AS task, arg_max(event_type, event_id) AS event_type, count(*) AS n_steps FROM events GROUP BY 1, 2",
    "category_trend": """WITH k AS (SELECT o_custkey || '/' || o_orderpriority AS project, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
g AS (SELECT project, count(*) AS n_scans, arg_max(o_totalprice, n) AS first_score, arg_min(o_totalprice, n) AS last_score FROM k WHERE n <= 5 GROUP BY project)
SELECT *, CASE WHEN n_scans < 2 THEN 'insufficient_data' WHEN last_score - first_score > 1000 THEN 'improving' WHEN last_score - first_score < -1000 THEN 'regressing' ELSE 'stable' END AS direction FROM g""",
    "import_resolution": """WITH f AS (SELECT DISTINCT 'src/' || p_brand || CASE p_size % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.js' ELSE '.css' END AS file FROM part),
i AS (SELECT 'src/app/' || p_partkey || '.ts' AS path, CASE WHEN p_size % 2 = 0 THEN '../' ELSE '@/' END || p_brand AS target, 'src/' || p_brand AS base FROM part)
SELECT DISTINCT path, target, coalesce(a.file, b.file) AS file FROM i LEFT JOIN f a ON a.file = base || '.ts' LEFT JOIN f b ON b.file = base || '/index.js' WHERE coalesce(a.file, b.file) IS NOT NULL""",
    "class_hierarchy": "SELECT c_custkey AS node, least(c_custkey, 1)::BIGINT AS root, CASE WHEN c_custkey < 2 THEN 0 ELSE floor(log2(c_custkey)) END::BIGINT AS depth FROM customer",
    "inline_suppressed": """WITH o AS (SELECT 'o' || o_orderkey AS file, o_orderkey AS k, o_orderdate::DATE >= DATE '1996-01-01' AS holds FROM orders)
SELECT file, line, 'rule-' || (k % 4 % 3) AS rule_id FROM o CROSS JOIN (VALUES (2), (3)) l(line)
WHERE NOT (holds AND k % 3 = k % 4 % 3 AND (k % 2 <> 0 OR line = 2))""",
    "ruleset_overlay": "SELECT n_name AS rule_id, CASE WHEN n_nationkey % 4 = 0 THEN n_regionkey + 10 ELSE n_regionkey END AS level FROM nation",
    "scc": f"WITH RECURSIVE {_CLOSURE}, p AS (SELECT DISTINCT a, b FROM r) SELECT x.a AS node, least(min(x.b), x.a) AS component FROM p x JOIN p y ON x.a = y.b AND x.b = y.a GROUP BY x.a",
    "bfs": f"WITH RECURSIVE {_CLOSURE} SELECT a AS start, b AS node, CASE WHEN a = b THEN 0 ELSE min(n) END AS depth FROM r WHERE a = (SELECT min(src) FROM e) GROUP BY a, b UNION SELECT min(src), min(src), 0 FROM e HAVING min(src) IS NOT NULL",
    "dep_scc": f"""WITH RECURSIVE {_PARTS}, r(a, b) AS (SELECT src, dst FROM e WHERE src IN (SELECT dst FROM e) UNION SELECT a, dst FROM r JOIN e ON b = src)
SELECT x.a AS node, least(min(x.b), x.a) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""",
    "dep_bfs": f"""WITH RECURSIVE {_PARTS}, t AS (SELECT max(src) AS a FROM e), m AS (SELECT count(DISTINCT dst) AS n FROM e),
r(a, b, n) AS (SELECT a, a, 0 FROM t UNION SELECT a, dst, r.n + 1 FROM r JOIN e ON b = src WHERE r.n < (SELECT n FROM m))
SELECT a AS start, b AS node, min(n) AS depth FROM r GROUP BY a, b""",
}
QUERIES = {n: globals()[n] for n in SQL}
