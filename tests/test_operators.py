"""Functions, sources, filters and graphs on small tables."""

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lintlake import functions, sources, streaming
from lintlake.operators import changes, clones, filters, findings, graphs, php, rules, scoring
from lintlake.plans import corpus


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("pattern", "path", "hit"), [("a/*.php", "a/b/c.php", True), ("*.PHP", "x.php", True), ("a?c", "abc", True), ("a[!b]c", "abc", False), ("a.c", "abc", False)])
def test_glob_crosses_slashes(pattern, path, hit):
    assert bool(re.match(functions.like_glob(pattern), path)) == hit


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("vendor/", "a/vendor/x.php", True), ("/dist/*.js", "dist/a.js", True), ("/dist/*.js", "dist/b/a.js", False), ("**/gen/*", "a/b/gen/x", True), ("*.min.js", "a/b.min.js", True), ("node", "nodes/x", False)],
)
def test_ignore_glob(pattern, path, hit):
    assert bool(re.search(functions.ignore_glob(pattern), path)) == hit


def test_scalars(spark):
    assert one(spark, functions.normal_path(F.lit("./a\\\\b//c"))) == "a/b/c"
    assert one(spark, functions.extension(F.lit("x/y.blade.php"))) == ".blade.php"
    assert one(spark, functions.extension(F.lit("x.y/Z.PHP"))) == ".php"
    assert one(spark, functions.snake_case(F.lit("OrderItem"))) == "order_item"
    assert one(spark, functions.table_name(F.lit("Category"))) == "categories"
    assert one(spark, functions.table_name(F.lit("Box"))) == "boxes"
    assert one(spark, functions.half_even(F.lit(2.5), 0)) == 2.0
    assert one(spark, functions.entropy(F.lit("abab"))) == pytest.approx(1.0)
    assert one(spark, functions.line_of(F.lit("a\nb\nc"), F.lit(4))) == 3


def rule(**more):
    return findings.LineRule(**({"rule_id": "r", "pattern": "bad", "category": "security", "severity": "low", "classification": "risk", "confidence": 0.6} | more))


def test_identity_has_no_line_number(spark):
    df = spark.createDataFrame([("a", "bad"), ("b", "x\n\nbad bad")], "path string, content string")
    rows = findings.scan_lines(df, [rule()]).orderBy("file").collect()
    assert [(r.file, r.line) for r in rows] == [("a", 1), ("b", 3)]
    moved = findings.scan_lines(df.withColumn("content", F.concat(F.lit("\n"), "content")), [rule()])
    assert {r.fingerprint for r in rows} == {r.fingerprint for r in moved.collect()}


def test_empty_and_null_sources(spark):
    df = spark.createDataFrame([(None, None), ("a", None), ("b", "")], "path string, content string")
    assert findings.scan_lines(df, [rule()]).count() == 0
    assert findings.scan_lines(df.limit(0), [rule()]).count() == 0


def test_long_lines_are_searched_whole(spark):
    far = "x" * 235 + " bad " + "y" * 300
    df = spark.createDataFrame([("past", "z" * 300 + " bad"), ("across", far), ("long", "q" * 400)], "path string, content string")
    rows = findings.scan_lines(df, [rule(pattern="(z{300} )?bad"), rule(rule_id="after", pattern="bad y+")]).collect()
    assert sorted((r.file, r.rule_id, len(r.context)) for r in rows) == [("across", "after", 120), ("across", "r", 3), ("past", "r", 120)]
    long_line = next(r for r in corpus.RULES if r.rule_id == "long-line")
    sizes = spark.createDataFrame([("a", "q" * 239), ("b", "q" * 240), ("c", "q" * 241), ("d", "q" * 250 + "\r" + "q")], "path string, content string")
    assert {r.file for r in findings.scan_lines(sizes, [long_line]).collect()} == {"b", "c", "d"}


def test_inline_marks(spark):
    f = spark.createDataFrame([("a", n, r) for n in range(1, 6) for r in ("r", "s")], "file string, line int, rule_id string")
    marks = spark.createDataFrame([("a", 1, "r", False), ("a", 4, "*", True)], "file string, line int, rule_id string, is_next boolean")
    left = {(x.line, x.rule_id) for x in filters.without_inline(f, marks).collect()}
    assert left == {(1, "s"), (2, "s"), (3, "s"), (4, "r"), (4, "s")}


def test_overlaps_are_deduped_once(spark):
    df = spark.createDataFrame([("a", "bad bad")], "path string, content string")
    f = findings.scan_lines(df, [rule(overlap_group="g", overlap_rank=1), rule(rule_id="s", overlap_group="g", overlap_rank=2)])
    once = filters.one_of_overlaps(f)
    assert [(r.rule_id, r.suppressed_rules) for r in once.collect()] == [("s", ["r"])]
    assert filters.one_of_overlaps(once.drop("suppressed_rules")).count() == 1


def test_scores_stay_in_range(spark):
    df = spark.createDataFrame([("a", "\n".join(["bad"] * 50))], "path string, content string")
    scores = scoring.category_scores(findings.scan_lines(df, [rule(severity="critical")]), ["security", "react"]).collect()
    assert {r.category: r.raw_score for r in scores} == {"security": 0.0, "react": 100.0}


def test_baseline_counts(spark):
    kind = "fingerprint string, severity string"
    now, before = spark.createDataFrame([("a", "low"), ("b", "low")], kind), spark.createDataFrame([("b", "low"), ("c", "high")], kind)
    assert {r.fingerprint: r.status for r in changes.compare_fingerprints(now, before).collect()} == {"a": "new", "b": "unchanged", "c": "resolved"}


def test_intervals(spark):
    df = spark.createDataFrame([("a", 0, 9), ("a", 5, 7), ("a", 9, 12), ("a", 20, 21), ("b", 1, 1)], "path string, first int, last int")
    assert sorted(map(tuple, clones.covered(df).collect())) == [("a", 0, 12), ("a", 20, 21), ("b", 1, 1)]


def test_coverage_has_no_cap_of_copies(spark):
    text = " ".join(f"w{i}" for i in range(130))  # windows at 0, 25, 50 and 75: tokens 0 to 124
    own = lambda n: " ".join(f"own{n}x{i}" for i in range(60))
    rows = [(f"f{n:02}", text) for n in range(40)] + [("alone", own(1)), ("z", " ".join([*(f"w{i}" for i in range(75)), own(2)]))]
    w = clones.neighbours(spark.createDataFrame(rows, "path string, content string"))
    spans = sorted(map(tuple, clones.covered(clones.shared_intervals(w)).collect()))
    assert spans == [(f"f{n:02}", 0, 124) for n in range(40)] + [("z", 0, 74)]
    rest = clones.members(w).collect()
    assert {r.path for r in rest} == {f"f{n:02}" for n in range(16, 40)} | {"z"}
    assert {(r.first_path, r.n_files) for r in rest} == {("f00", 40), ("f00", 41)}


def test_reach_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert sorted(map(tuple, graphs.cycles(e).collect())) == [("a", "a"), ("b", "a")]
    assert sorted(map(tuple, graphs.reach(e, spark.createDataFrame([("a",)], "node string"), 1).collect())) == [("a", "a", 0), ("a", "b", 1)]


def test_long_cycles_are_whole(spark):
    ring = lambda first, n: [(first + i, first + (i + 1) % n) for i in range(n)]
    # a ring of 24, one of 26 that it leads to, two small ones and paths in and out
    e = ring(0, 24) + ring(100, 26) + [(5, 120), (200, 201), (201, 200), (201, 300), (300, 301), (301, 302), (302, 300), (302, 0), (7, 400), (400, 401), (500, 501), (501, 200), (9, 9), (600, 600)]
    want = {i: 0 for i in range(24)} | {100 + i: 100 for i in range(26)} | {200: 200, 201: 200, 300: 300, 301: 300, 302: 300}
    got = graphs.cycles(spark.createDataFrame(e, "src int, dst int")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert graphs.cycles(spark.createDataFrame([], "src int, dst int")).count() == 0
    far = graphs.reach(spark.createDataFrame(e, "src int, dst int"), spark.createDataFrame([(100,)], "node int"), None)
    assert {r.node: r.depth for r in far.collect()} == {100 + i: i for i in range(26)}


def test_project_files(spark, tmp_path):
    for name, text in (("app/A.php", "x"), ("vendor/B.php", "y"), ("app/view.blade.php", "z"), ("README.md", "r"), ("composer.json", "{}"), ("sub/composer.json", "{}")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = sources.read_project(spark, str(tmp_path))
    assert {r.path for r in sources.select_files(files, ignored=["vendor/"]).collect()} == {"app/A.php", "app/view.blade.php"}
    assert sources.best_manifest(files, "composer.json").first().path == "composer.json"


def test_coverage_readers(spark, tmp_path):
    (tmp_path / "clover.xml").write_text('<coverage><file name="a.php"><line num="1" type="stmt" count="2"/><line num="2" type="stmt" count="0"/><line num="3" type="method" count="1"/></file></coverage>')
    (tmp_path / "jest.json").write_text(json.dumps({"total": {"lines": {"total": 9, "covered": 1, "pct": 1.0}}, "b.ts": {"lines": {"total": 4, "covered": 3, "pct": 75.0}}}))
    assert tuple(sources.read_clover(spark, str(tmp_path / "clover.xml")).first()) == ("a.php", 2, 1, 50.0)
    assert tuple(sources.read_jest(spark, str(tmp_path / "jest.json")).first()) == ("b.ts", 4, 3, 75.0)


def test_sarif_and_baseline(spark, tmp_path):
    df = spark.createDataFrame([("a", "bad"), ("b", "bad")], "path string, content string")
    f = findings.scan_lines(df, [rule(severity="high")])
    run = json.loads(sources.sarif(f).first().sarif)["runs"][0]
    parts = [json.loads(r.sarif)["runs"][0] for r in sources.sarif(f, results=1).collect()]
    assert sum(len(x["results"]) for x in parts) == f.count() and all({r["ruleId"] for r in x["results"]} == {r["id"] for r in x["tool"]["driver"]["rules"]} for x in parts)
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r"]
    assert [r["level"] for r in run["results"]] == ["error", "error"]
    for profile in ("strict", "startup"):
        sources.save_baseline(f, str(tmp_path / "base"), "p", profile)
    sources.save_baseline(f.limit(1), str(tmp_path / "base"), "p", "strict")
    assert [sources.load_baseline(spark, str(tmp_path / "base"), "p", x).count() for x in ("strict", "startup")] == [1, 2]


def test_stream(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "bad", "en", "s", 3)], kind).write.parquet(str(tmp_path / "in"))
    docs = streaming.document_stream(spark, str(tmp_path / "in"))
    for n in (1, 2):
        streaming.scan_stream(docs, [rule()], str(tmp_path / "found"), str(tmp_path / "c1")).awaitTermination(60)
        streaming.manifest_stream(docs, str(tmp_path / "manifest"), str(tmp_path / "c2")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "found")).count() == n
        spark.createDataFrame([(2, "bad", "en", "s", 3)], kind).write.mode("append").parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "manifest" / "1")).count() == 2


def test_trend(spark):
    rows = [("p", datetime(2025, 1, d), float(d)) for d in range(1, 15)] + [("q", datetime(2025, 1, 1), 3.0)]
    got = changes.trend(spark.createDataFrame(rows, "project string, at timestamp, score double"), "project", ["at"], "score").collect()
    assert {r.project: (r.n_scans, r.first_score, r.last_score, r.direction) for r in got} == {"p": (10, 5.0, 14.0, "improving"), "q": (1, 3.0, 3.0, "insufficient_data")}


PHP = {
    "app/Services/PayService.php": """<?php
namespace App\\Services;
use App\\Models\\Order;
/* class Hidden { function no() {} } */
abstract class PayService extends Base implements Payable, \\Countable {
    public function __construct(private Gateway $gateway, LedgerService $ledger) {}
    public static function pay(?int $a = null, ...$rest): ?string {
        if ($a && $rest) { throw new \\Exception("if {"); }
        foreach ($rest as $r) { $x .= $r; }
        Order::create($request->all()); $this->log->save();
        return $a ? 'x' : null;
    }
    private function idle() { try { run(); } catch (E $e) { } }
    private function used() { exec("ls $dir"); return $this->used(); }
}
function free() { return new class { public function inner() {} }; }
interface Payable { public function pay(); }
""",
    "app/Services/LedgerService.php": "<?php declare(strict_types=1);\nnamespace App\\Services;\nclass LedgerService { function a() { return new PayService(); } }\n",
    "routes/web.php": "<?php\nRoute::get('/a/{x}', [A::class, 'i']);\n// Route::get('/b', 'no');\nRoute::get('a/{y}/', fn () => env('K'));\nRoute::match(['get', 'post'], 'm', [B::class, 'j'])->middleware(['auth']);\n",
    "broken.php": "<?php class Open { function f() { if (",
    "empty.php": "",
    "null.php": None,
}


@pytest.fixture(scope="module")
def php_facts(spark):
    return rules.Facts(spark.createDataFrame(list(PHP.items()), "path string, content string"))


def test_php_facts(php_facts):
    classes = {r.name: r for r in php_facts.classes.collect()}
    assert set(classes) == {"PayService", "Payable", "LedgerService", "Open"}
    pay = classes["PayService"]
    assert (pay.fqcn, pay.parent, pay.interfaces, pay.is_abstract, pay.first_line, pay.last_line) == ("App\\Services\\PayService", "Base", ["Payable", "\\Countable"], True, 5, 15)
    methods = {(r["class"], r.name): r for r in php_facts.methods.collect()}
    m = methods["PayService", "pay"]
    assert (m.visibility, m.is_static, m.params, m.thrown, m.returns, m.loc) == ("public", True, ["a", "rest"], ["\\Exception"], "?string", 6)
    assert m.cyclomatic == 5  # if, &&, foreach, ?:
    assert methods["PayService", "__construct"].types == ["Gateway", "LedgerService"]
    assert ("Open", "f") in methods
    assert {tuple(r) for r in php_facts.edges.collect()} >= {("App\\Services\\PayService", "App\\Services\\LedgerService"), ("App\\Services\\LedgerService", "App\\Services\\PayService")}


def test_php_routes(php_facts):
    got = [(r.line, r.verb, r.uri, r.controller, r.action, r.middleware, r.is_closure) for r in php_facts.routes.orderBy("line").collect()]
    assert got == [(2, "get", "/a/{x}", "A", "i", [], False), (4, "get", "/a/{y}", None, None, [], True), (5, "match", "/m", "B", "j", ["auth"], False)]


def test_rules_over_facts(php_facts):
    found = {(r.rule_id, r.file) for r in rules.scan(php_facts.sources).collect()}
    pay, web = "app/Services/PayService.php", "routes/web.php"
    want = "unused-private-method command-injection-risk mass-assignment-risk custom-exception-suggestion exception-swallowing string-concat-in-loop missing-strict-types transaction-required-for-multi-write"
    assert {r for r, f in found if f == pay} == set(want.split())
    assert {r for r, f in found if f == web} == {"duplicate-route-definition", "no-closure-routes", "env-outside-config"}
    assert {f for r, f in found if r == "circular-dependency"} == {"app/Services/LedgerService.php"}  # once, at the least class
    assert not any(f in ("empty.php", "null.php") for _, f in found)


def test_rules_over_no_files(spark):
    assert rules.scan(spark.createDataFrame([], "path string, content string")).count() == 0


def test_components(spark):
    src = spark.createDataFrame([("a/B.tsx", "import React, { useState } from 'react'\nexport default function B() { const [x] = useState(1); return <C/> }\nconst C = () => import('./d')\n")], "path string, content string")
    r = php.components(src).first()
    assert (r.components, r.hooks, r.imports) == (["B", "C"], ["useState"], ["react", "./d"])


def test_overlaps_by_scope_or_context(spark):
    names = "file string, line int, rule_id string, context string, severity string, classification string, confidence double, score_impact int, overlap_group string, overlap_rank int, rule_ord int, overlap_scope string"
    row = lambda line, rule, context, rank, group="g", scope="": ("a", line, rule, context, "low", "risk", 0.5, 0, group, rank, line, scope)
    rows = [row(1, "r1", "same", 1), row(9, "r2", "same", 2), row(2, "r1", "other", 1), row(3, "r3", "x", 1, scope="s"), row(4, "r4", "y", 2, scope="s"), row(5, "r5", "", 1), row(6, "r5", "", 1), row(7, "r1", "same", 1, group=""), row(7, "r1", "same", 1, group="")]
    got = sorted((r.line, tuple(r.suppressed_rules)) for r in filters.one_of_overlaps(spark.createDataFrame(rows, names)).collect())
    assert got == [(2, ()), (4, ("r3",)), (5, ()), (6, ()), (7, ()), (7, ()), (9, ("r1",))]  # equal ones without a group stay apart


def test_line_rules_look_behind_column_240(spark):
    rule = findings.LineRule("secret", r"[0-9a-f]{40}", "security", "high", "defect", 0.9)
    d = spark.createDataFrame([("a", "x " * 300 + "0123456789" * 4)], "path string, content string")
    assert [r.context for r in findings.scan_lines(d, [rule]).collect()] == ["0123456789" * 4]


def test_inline_marks(spark):
    texts = ["// @lint-ignore r1", "# @LINT-IGNORE-next-line * until:2020-01-01", "@lint-ignore r2 until:2030-01-01", "@lint-ignore r3 until:2020-99-99", "none"]
    lines = spark.createDataFrame([("a", i + 1, t) for i, t in enumerate(texts)], "path string, line int, content string")
    assert {(r.line, r.rule_id, r.is_next) for r in filters.inline_marks(lines, "2020-01-01").collect()} == {(1, "r1", False), (2, "*", True), (3, "r2", False)}
    assert {r.line for r in filters.inline_marks(lines, "2020-01-02").collect()} == {1, 3}


def test_related_files_and_paths(spark):
    f = spark.createDataFrame([("a", ["b"]), ("c", None), ("d", ["e"])], "file string, related_files array<string>")
    assert {r.file for r in filters.in_changed_or_related(f, spark.createDataFrame([("b",), ("c",)], "file string")).collect()} == {"a", "c"}
    files = spark.createDataFrame([("/r/a/../b.php",), ("/r/../x.php",), ("/r/tests/ATest.php",), ("/r/phpunit.xml",)], "path string")
    assert {r.path for r in sources.inside(files, "/r").collect()} == {"/r/b.php", "/r/tests/ATest.php", "/r/phpunit.xml"}
    deep = [("/r/" + "a/" * 12 + "../" * n + "x",) for n in (12, 13, 14)] + [("/../r/./x",), ("/r/..",), ("r/x",)]
    assert [r.path for r in sources.inside(spark.createDataFrame(deep, "path string"), "/r").collect()] == ["/r/x", "/r/x"]
    assert [r.path for r in sources.test_files(files).collect()] == ["/r/tests/ATest.php"]
    assert sources.first_existing(files, ["/r/none", "/r/phpunit.xml"]).first().path == "/r/phpunit.xml"


def test_hierarchy_without_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(40)] + [(100, 101), (101, 100)]
    got = {r.node: (r.root, r.depth) for r in graphs.ancestors(spark.createDataFrame(rows, "node int, parent int")).collect()}
    assert got == {i: (0, i) for i in range(40)}


def test_weights():
    assert scoring.normal_weights({"sec": 0.5, "dry": 0.5, "nope": 1}, {"sec": "security"}) == {"security": 50, "dry": 50}
    assert scoring.normal_weights({"security": 30, "dry": 10}) == {"security": 30, "dry": 10}


def test_fix_ranks(spark):
    from lintlake.operators import remediation

    fixes = spark.createDataFrame([("safe_edit", "high", 1), ("manual_review", "low", 20)], "strategy string, confidence string, n_files int")
    assert [r.rank_score for r in remediation.ranked(fixes).collect()] == [1.0, 0.25]
