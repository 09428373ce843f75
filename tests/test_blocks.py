"""Duplicated blocks, rewrites, rules that fail or can't pass."""

import subprocess

import pytest
from pyspark.sql import functions as F

from lintlake.operators import blocks, fixes, rules, ruleset


def method(name, var, n, salt=""):
    """Statements of 8 tokens each."""
    return f"  function {name}() {{\n" + "".join(f"    ${var}{i}{'->' if (i * 7) % 3 == 0 else '::'}{'go' if i % 2 else 'run'}({i}, '{salt}{i}');\n" + ("    if (1) { }\n" if i % 5 == 0 else "") for i in range(n)) + "  }\n"


def test_tokens():
    code = "$a = foo('x \\' y', 12.5); // $b\n# no\n/* two\nlines */ return \"z\";"
    assert blocks.tokens(code) == [("$", 0), ("ID", 0), ("=", 0), ("ID", 0), ("(", 0), ("STR", 0), (",", 0), ("NUM", 0), (")", 0), (";", 0), ("ID", 3), ("STR", 3), (";", 3)]


def test_renamed_methods_are_one_block(spark):
    files = {
        "a.php": "<?php\nclass A {\n" + method("f", "x", 30) + method("tiny", "x", 2) + "}\n",
        "b.php": "<?php\nclass B {\n" + method("g", "other", 30, "s") + "}\n",
        "c.php": "<?php\nclass C {\n" + method("h", "y", 30)[::-1].replace("}", "", 1)[::-1] + "    $more->than($that, 1, 2, 3);\n  }\n}\n",
        "d.php": "<?php\nclass D {\n  function i() {\n" + "".join(f"    return [{i}, [{i}]];\n" for i in range(40)) + "  }\n}\n",
    }
    found = blocks.places(spark.createDataFrame(list(files.items()), "path string, content string"))
    at = sorted(map(tuple, blocks.block_places(found).select("path", "first_line", "tokens").collect()))
    assert {p for p, _, _ in at} == {"a.php", "b.php", "c.php", "d.php"} - {"d.php"}
    assert {line for _, line, _ in at} == {4}
    top = blocks.largest(blocks.block_places(found)).collect()
    assert [(r.n_places, r.n_files, r.first_path) for r in top] == [(3, 3, "a.php")]
    pct = {r.path: r for r in blocks.duplication(found).collect()}
    assert pct["d.php"].duplicated == 0
    assert pct["a.php"].duplicated == pct["b.php"].duplicated == top[0].tokens
    assert pct["a.php"].total > pct["b.php"].total


def test_many_copies_in_any_order(spark):
    one, two = method("f", "x", 25), "".join(f"    $z{i} = [{i} => [1, 2], 'k' => ${i % 7}a];\n" for i in range(25))
    files = [(f"n{i}.php", "<?php\nclass N {\n" + one + "}\n") for i in range(60)]
    a, b = one.split("{\n", 1)[1].rsplit("  }", 1)[0], two
    files += [("ab.php", "<?php\nclass N {\n  function f() {\n" + a + b + "  }\n}\n"), ("ba.php", "<?php\nclass N {\n  function f() {\n" + b + a + "  }\n}\n")]
    found = blocks.places(spark.createDataFrame(files, "path string, content string"))
    at = blocks.block_places(found)
    assert at.groupBy("block").count().filter("count < 2").count() == 0
    assert at.filter("path like 'n%'").select("path").distinct().count() == 60  # none is left out
    assert {r.path for r in at.filter("path in ('ab.php', 'ba.php')").collect()} >= {"ab.php"}
    none = blocks.places(spark.createDataFrame([("x.php", None)], "path string, content string"))
    assert (blocks.block_places(none).count(), blocks.duplication(none).count()) == (0, 0)


FIXES = {
    ("env-outside-config", "a.php"): ("  $k = env('APP_KEY') . env(\"APP_KEY\");", "  $k = config('app.app_key') . config('app.app_key');"),
    ("no-log-debug-in-app", "b.php"): ("Log::debug($x); Log::debug($y);", "Log::info($x); Log::info($y);"),
    ("react-no-array-index-key", "c.tsx"): ("<li key={index}>a</li>", "<li key={item.id || `item-${index}`}>a</li>"),
    ("no-dangerously-set-inner-html", "d.tsx"): ("<p dangerouslySetInnerHTML={{__html: body}} />", "<p dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(body) }} />"),
    ("unsafe-unserialize", "e.php"): ("$x = unserialize($d);", "$x = unserialize($d, ['allowed_classes' => false]);"),
    ("insecure-random-for-security", "f.php"): ("$token = mt_rand(1, 9);", "$token = random_int(1, 9);"),
    ("timing-attack-token-comparison", "g.php"): ("if ($apiToken === $given) {", "if (hash_equals($apiToken, $given)) {"),
    ("missing-strict-types", "h.php"): ("<?php", "<?php\n\ndeclare(strict_types=1);"),
}


def test_rewrites_and_diffs(spark, tmp_path):
    before, after = "".join(f"// {i}\n" for i in range(9)), "".join(f"// end {i}\n" for i in range(9))
    texts = {path: (old + "\n" + after if rule == "missing-strict-types" else before + old + "\n" + after) for (rule, path), (old, _) in FIXES.items()} | {"same.php": "x\n"}
    sources = spark.createDataFrame(list(texts.items()), "path string, content string")
    found = [(path, 1 if rule == "missing-strict-types" else 10, rule) for rule, path in FIXES] + [("a.php", 2, "env-outside-config"), ("a.php", 99, "env-outside-config"), ("gone.php", 1, "env-outside-config"), ("a.php", 10, "no-such-rule"), ("a.php", 10, "env-outside-config")]
    made = fixes.suggestions(spark.createDataFrame(found, "file string, line int, rule_id string"), sources)
    assert {(r.rule_id, r.file): (r.original, r.fixed) for r in made.collect()} == FIXES
    assert {r.rule_id for r in made.filter("auto").collect()} == {"no-log-debug-in-app"}
    assert made.count() == len(FIXES)
    changed = fixes.apply(sources, made)
    diffs = {r.path: r for r in fixes.diffs(changed).collect()}
    assert diffs.keys() == {p for _, p in FIXES}
    for r in changed.collect():  # the diff, applied by another program, gives the file
        (tmp_path / r.path).write_text(r.content)
        (tmp_path / "p").write_text(diffs[r.path].diff + "\n")
        if subprocess.run(["which", "patch"], capture_output=True).returncode == 0:
            subprocess.run(["patch", "-s", str(tmp_path / r.path), str(tmp_path / "p")], check=True)
            assert (tmp_path / r.path).read_text() == r.fixed
    assert (diffs["h.php"].added, diffs["h.php"].removed, diffs["a.php"].added, diffs["a.php"].removed) == (2, 0, 1, 1)
    assert diffs["a.php"].diff.split("\n")[2] == "@@ -7,7 +7,7 @@"


def test_a_rule_that_fails_costs_only_itself(spark):
    sources = spark.createDataFrame([("app/A.php", "<?php\nclass A { private function f() { eval($x); } }\n")], "path string, content string")
    ok = [r for r in rules.RULES if r.rule_id in ("unsafe-eval", "unused-private-method", "missing-strict-types", "high-complexity")]
    late = rules.FactRule("late", "x", "low", "risk", 1.0, rules.RowTest("methods", lambda: F.raise_error(F.concat(F.lit("no "), "name")).cast("boolean"), "name"))
    early = rules.FactRule("early", "x", "low", "risk", 1.0, lambda f: f.none)
    own = rules.FactRule("own", "x", "low", "risk", 1.0, lambda f: f.methods.select(F.col("path").alias("file"), F.lit(1).alias("line"), F.expr("cast(1 / (loc - loc) AS string)").alias("context")))
    every = [ok[0], late, *ok[1:], early, own]
    found, states = rules.scan_each(sources, every)
    got = {r.rule_id: (r.state, r.n) for r in states.collect()}
    assert {k: v[0] for k, v in got.items()} == {r.rule_id: "skipped" if r in (late, early, own) else "run" for r in every}
    assert {r.rule_id: r.rule_ord for r in found.collect()} == {r.rule_id: every.index(r) for r in ok if r.rule_id != "high-complexity"}
    assert sorted(r.fingerprint for r in found.collect()) == sorted(r.fingerprint for r in rules.scan(sources, ok).collect())
    assert "no f" in {r.rule_id: r.reason for r in states.collect()}["late"]


def test_rules_that_cannot_pass(spark):
    rows = [("low", 0.5, "risk"), ("low", 0.6, "advisory"), ("edge", 0.65, "defect"), ("one", 0.1, "risk"), ("one", 0.9, "risk"), ("known late", None, "risk"), ("known late", 0.1, "risk"), ("own", 0.4, "risk"), ("own high", 0.7, "defect")]
    declared = spark.createDataFrame(rows, "rule_id string, confidence double, classification string")
    own = spark.createDataFrame([("own", 0.3), ("own high", 2.0)], "rule_id string, floor double")
    got = {r.rule_id: (r.ceiling, round(r.floor, 4)) for r in ruleset.unreachable(declared, "startup", own).collect()}
    assert got == {"low": (0.6, 0.7), "own high": (0.7, 1.0)}
    assert {r.rule_id for r in ruleset.unreachable(declared, "strict").collect()} == {"own"}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "rule_id string")
    drift = {(r.rule_id, r.state) for r in ruleset.drift(ids("a", "b"), ids("b", "c", "d", "c"), ids("d", "z"), ids("b", "old")).collect()}
    assert drift == {("a", "listed_only"), ("c", "pending"), ("d", "internal"), ("old", "alias_only")}
