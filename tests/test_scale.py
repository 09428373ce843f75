"""What keeps the queries over rendered sources and graphs in proportion to their tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lintlake import catalog
from lintlake.operators import bodies as bodies_operators
from lintlake.operators import callmap as callmap_operators
from lintlake.operators import blocks, clones, dataflow, graphs, php, remediation, textrules
from lintlake.plans import bodies, callmap, code, contracts, flows, rules, upkeep

RENDERED = [
    bodies.controllers, callmap.classes, code.controllers, code.route_files, code.migration_files, code.templates, contracts.contract_sources, contracts.route_sources, flows.sources, flows.services,
    upkeep.classes, upkeep.scripts, lambda s, d: rules.rendered(s, d, rules.FAMILIES["security"]),
]


@pytest.mark.parametrize("n", range(len(RENDERED)))
def test_a_table_in_one_file_is_many_tasks(spark, small, n):
    assert RENDERED[n](spark, small).rdd.getNumPartitions() >= 8


def test_a_path_is_tested_once_for_each_kind(spark):
    some = [r for r in textrules.RULES if r.kind == "php"][:12]
    found = textrules.scan_texts(spark.createDataFrame([("a.php", "x"), ("tests/a.php", "x")], "path string, content string"), some)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"node_modules") == 1


def test_chains_parse_once_and_broadcast_nothing(spark, small, monkeypatch):
    plans, cut = [], graphs.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graphs, "cut", seen)
    monkeypatch.setattr(callmap_operators, "cut", seen)
    callmap.call_chains(spark, small)
    assert sum(p.count("MapInArrow") for p in plans) == 1
    names = ("fqcn", "node", "src", "dst", "_c", "raw")
    assert not [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line and any(n + "#" in line for n in names)]


@pytest.mark.parametrize("name", ["clone_interval_union", "duplication_pct"])
def test_coverage_of_many_copies_equals_sql(spark, tmp_path, name):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(140))
    rows = [(i, text(i % 2) + (" tail" * (i % 3)), "en") for i in range(50)] + [(90, text(7) + " " + text(7), "en"), (91, text(7), "de"), (92, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = catalog.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    # equal spans are ties in the SQL's last window, which may then give a span twice
    key = lambda r: r[:3] if name == "clone_interval_union" else r[0]
    assert sorted(map(key, df.collect())) == sorted({key(r) for r in want})
    assert want


def test_windows_split_a_text_once(spark):
    df = spark.createDataFrame([("a", "x")], "path string, content string")
    plan = clones.windows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "sha2" in line]


def test_rules_that_flows_also_have_are_still_matched_on_texts():
    ids = lambda f: {r.rule_id for r in rules.FAMILIES[f]}
    assert {"ssrf-risk-http-client", "path-traversal-file-access", "insecure-file-download-response", "insecure-deserialization"} <= ids("security")
    assert "heading-order" in ids("accessibility")


def test_every_sink_has_a_word_that_its_kind_is_looked_for_by():
    calls = {
        "ssrf": ["Http::get(", "Http::withToken($a)->post(", "curl_init("],
        "path": ["file_get_contents(", "file_put_contents(", "fopen(", "readfile(", "unlink(", "copy(", "rename(", "file(", "Storage::get(", "File::delete("],
        "download": ["response()->download(", "response() -> file(", "Storage::download(", "Response::download("], "redirect": ["redirect(", "redirect()->to(", "Redirect::away("],
        "deserialize": ["unserialize(", "yaml_parse("], "sql": ["DB::select(", "DB::raw(", "->whereRaw(", "-> groupByRaw("],
        "command": ["exec(", "shell_exec(", "system(", "passthru(", "proc_open(", "popen(", "Process::run("], "include": ["include ", "require_once "], "xss": ["echo ", "print "], "eval": ["eval(", "assert(", "create_function("],
    }
    assert calls.keys() == dataflow.SINKS.keys()
    for kind, some in calls.items():
        for call in some:
            text = f"<?php function f(Request $request) {{ {call}{'$request->input(1)' if call.endswith(' ') else '$request->input(1))'}; }}"
            assert kind in {e[6] for e in dataflow._events("a.php", text) if e[4] == "sink"}, call


def test_dependencies_parse_once(spark, small, monkeypatch):
    plans, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    last = code.php_dependencies(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert sum(p.count("MapInArrow") for p in [*plans, last]) == 1


@pytest.mark.parametrize("name", ["clone_blocks", "file_duplication"])
def test_blocks_parse_once(spark, small, monkeypatch, name):
    plans, cut = [], graphs.cut
    monkeypatch.setattr(blocks, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    last = catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert sum(p.count("MapInArrow") for p in [*plans, last]) == 1


def test_tokens_of_odd_signs_and_strings_over_lines():
    code = "é = 'a\nb' . \"c\"; // x\n/* y\n */ ² + 12.5 <<<X\nab\nX . '"
    want = [("ID", 0), ("=", 0), ("STR", 0), (".", 1), ("STR", 1), (";", 1), ("NUM", 3), ("+", 3), ("NUM", 3), ("ID", 3), (".", 3), ("'", 3)]
    assert blocks.tokens(code) == want


def test_a_line_is_tried_with_few_patterns(spark):
    """A rule's flag is read, not looked for among those of all rules, and a pattern is tried where a text that it can't do without stands."""
    some = [r for r in textrules.RULES if not r.whole and not r.masked][:40]
    plan = textrules.scan_texts(spark.createDataFrame([("a.php", "x")], "path string, content string"), some)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_contains(") == 1
    assert plan.count("Contains(low") >= 35


def test_required_texts_are_in_every_match():
    for r in textrules.RULES:
        for pattern, text in ((r.pattern, r.hit[1]), (r.needs, r.hit[1]), (r.unless, r.miss[1])):
            some = textrules.required(pattern)
            assert not some or all(any(t in m[0].lower() for t in some) for m in re.finditer(textrules.regex(pattern), text)), (r.rule_id, pattern)
    cases = {"ab*c": [["a"], ["c"]], "(foo|bar)+x?": [["foo", "bar"]], "(foo|b?)": [[]], "(?!abc)d": [["d"]], "(?:abc)?": [[]], "(?-i:Use)[A-Z]": [["use"]], "[ab]": [[]], "x{0,3}yz{2}": [["y"], ["z"]], "ünter": [["nter"]]}
    assert [p for p, want in cases.items() if textrules.required(p) not in want] == []


def test_lines_without_findings_and_comments(spark):
    text = "// useEffect(f)\n\nuseEffect(f) // x\n/* y */ console.log(1)\n// console.log(1)\nUSEEFFECT (f)\n"
    found = textrules.scan_texts(spark.createDataFrame([("resources/js/A.tsx", text)], "path string, content string"))
    assert {(r.line, r.rule_id) for r in found.collect()} == {(3, "no-direct-useeffect"), (4, "console-log-in-production-code"), (6, "no-direct-useeffect")}


def test_tasks_scan_the_texts_once(spark, small, monkeypatch):
    plans, cut = [], graphs.cut
    monkeypatch.setattr(remediation, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    last = catalog.queries()["remediation_tasks"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert sum(p.count("Generate posexplode(") for p in [*plans, last]) == 1


def test_a_level_of_flows_is_one_join_and_one_shuffle_by_start(spark, monkeypatch):
    plans, cut = [], graphs.cut
    monkeypatch.setattr(callmap_operators, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("b", "a", "x"), ("a", "b", "x")], "src string, dst string, type string")
    found = callmap_operators.flows(edges, spark.createDataFrame([("a",), ("z",)], "node string"), ["x"])
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert [p.count("SortMergeJoin") for p in plans] == [0, 0, 1, 0, 1, 0, 1, 0]  # edges, starts, what is met and the flows of each level, flags
    assert [p.count("Exchange hashpartitioning(") for p in plans] == [1, 1, 2, 1, 2, 1, 2, 1]
    assert {tuple(r) for r in found.collect()} == {("a", n, d, 3, False, True) for n, d in (("a", 0), ("b", 1), ("c", 2))} | {("z", "z", 0, 1, False, False)}


@pytest.mark.parametrize("name", ["definition_uses", "taint_flows"])
def test_flows_within_files_need_no_shuffle(spark, small, monkeypatch, name):
    cuts = []
    monkeypatch.setattr(graphs, "cut", lambda df: cuts.append(df) or df)
    monkeypatch.setattr(dataflow, "cut", lambda df: cuts.append(df) or df)
    plan = catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert not cuts and "Join" not in plan and "hashpartitioning" not in plan  # the one exchange deals the table's rows over tasks


def test_rules_make_texts_once(spark, small, monkeypatch):
    plans, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    last = catalog.queries()["flow_rule_findings"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Repartition" in p for p in plans) == 1 and "Repartition" not in last  # the texts are rendered for the first written table only


def test_files_that_hold_no_fact_are_not_parsed(spark):
    texts = {"none.php": "<?php class A { function f($a) { /* for */ return $a->step1($a); } }", "all.php": "<?php class B { function f($request) { foreach ($as as $a) { $a->b->c; Post::find(1); $a->decrement('stock', $n); } } }\nRoute::get('/a', [B::class, 'f']);"}
    src = spark.createDataFrame(list(texts.items()), "path string, content string")
    for found in (php.routes(src), bodies_operators.queries(src), bodies_operators.accesses(src), dataflow.withdrawals(src.withColumn("path", F.concat(F.lit("app/Jobs/"), "path")))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert {r.path.rpartition("/")[2] for r in found.collect()} == {"all.php"}
        assert "RLIKE" in plan or "Contains" in plan, plan
    assert list(dataflow._asked("none.php", texts["none.php"])) == [] and list(dataflow._asked("a.php", "<?php eval($_GET['a']);"))
