"""Loops, queries, relations and validations of PHP bodies, and the settings of rules."""

from lintlake.operators import bodies, php, ruleset

SOURCE = """<?php
class PostController {
    public function a(?int $n) {
        foreach (Post::with('author')->get() as $k => $post) {
            echo $post->author->name . $post->title;
            foreach ($post->tags as $tag) { Tag::find($tag->id)->update(['a' => 1]); }
        }
        foreach ($rows as $row): $row->owner->x; endforeach;
        $text = <<<'X'
            foreach ($a as $b) { Post::all(); } {
            X;
        return $posts->map(function (Post $p) { return $p->comments()->count(); });
    }
    public function b() {
        DB::table('posts')->where('a', 1)->delete();
        Validator::make($data, ['x.*' => "required|in:a,b", 'y' => ['int', Rule::in([1, 2])]]);
        return User::whereRaw('a = 1')->select('id')->get();
    }
}
class PostRequest { public function rules() { return ['t' => 'string']; } }
"""


def sources(spark, *texts):
    return spark.createDataFrame([(f"app/Http/Controllers/f{i}.php", t) for i, t in enumerate(texts)], "path string, content string")


def test_loops(spark):
    rows = bodies.loops(sources(spark, SOURCE)).orderBy("line", "last_line").collect()
    assert [(r.line, r.last_line, r.kind, r.variable) for r in rows] == [(4, 7, "foreach", "post"), (6, 6, "foreach", "tag"), (8, 8, "foreach", "row"), (12, 12, "map", "p")]
    assert [r.collection for r in rows][1:] == ["$post->tags", "$rows", "$posts"]


def test_queries(spark):
    rows = bodies.queries(sources(spark, SOURCE, SOURCE[:400], None, "")).filter("path like '%f0.php'").orderBy("line").collect()
    assert [(r.line, r.model, r.type, r.in_loop, r.n_plus_one_risk) for r in rows] == [
        (4, "Post", "select", False, False), (6, "Tag", "update", True, True), (15, "posts", "delete", False, False), (17, "User", "select", False, False)
    ]
    assert rows[0].is_eager and rows[3].is_raw and rows[3].chain == ["whereRaw", "select", "get"]


def test_lazy_relations(spark):
    src = sources(spark, SOURCE)
    found = bodies.lazy_accesses(bodies.accesses(src), bodies.loaded(src)).collect()
    assert {(r.line, r.relation) for r in found} == {(6, "tags"), (8, "owner"), (12, "comments")}  # author is loaded, title no relation


def test_validations(spark):
    rows = bodies.validations(php.methods(php.declarations(sources(spark, SOURCE)))).orderBy("line", "ord").collect()
    assert [(r["class"], r.method, r.kind, r.field, r.rules) for r in rows] == [
        ("PostController", "b", "make", "x.*", ["required", "in:a,b"]), ("PostController", "b", "make", "y", ["int"]), ("PostRequest", "rules", "form_request", "t", ["string"])
    ]


def test_branches_leave_types_and_heredocs_alone(spark):
    text = "<?php class A { function f(?int $a): ?string { $g = function (?B $b, ?C $c): ?D { return $b ? 1 : 2; };\n$t = <<<X\nif (a) {\nX;\nreturn $t; } }"
    assert [r.cyclomatic for r in php.methods(php.declarations(sources(spark, text))).collect()] == [2]


def test_calibrated(spark):
    rules = spark.createDataFrame([("a", True, "low", {"n": 1, "m": 2}), ("b", False, "high", {})], "rule_id string, enabled boolean, severity string, thresholds map<string,long>")
    patches = spark.createDataFrame([("a", 1, False, "high", {"n": 5}), ("a", 3, None, None, {"n": 7, "k": 0}), ("a", 2, True, None, None), ("z", 1, True, "low", {})], "rule_id string, ord int, enabled boolean, severity string, thresholds map<string,long>")
    got = {r.rule_id: (r.enabled, r.severity, r.thresholds) for r in ruleset.calibrated(rules, patches).collect()}
    assert got == {"a": (True, "high", {"n": 7, "m": 2, "k": 0}), "b": (False, "high", {})}
