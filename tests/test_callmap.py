"""Complexity, flows and chains against plain versions."""

import random
from collections import defaultdict

import pytest

from lintlake.operators import callmap, complexity, php

BODIES = {
    "": (1, 1, 0),
    "if ($a && $b) { if ($a || $b) { return 1; } else { return 2; } } return 0;": (5, 7, 2),
    "if ($a) { } elseif ($b) { } else { }": (3, 3, 1),
    "if ($a) { } else if ($b) { }": (3, 4, 2),
    "if ($a) return 1; else return 2;": (2, 2, 1),
    "if ($a) foreach ($b as $c) if ($c) d();": (4, 6, 3),
    "if ($a): foreach ($b as $c): d(); endforeach; elseif ($c): e(); endif;": (4, 4, 2),
    "for ($i = 0; $i < 3 && $j; $i++) { while ($x) { $y++; } }": (4, 4, 2),
    "do { if ($a) { } } while ($a and $b);": (4, 4, 2),
    "switch ($a) { case 1: if ($b) { } break; case 2: default: }": (5, 4, 1),
    "try { a(); } catch (E $e) { if ($a) { } } finally { }": (3, 2, 1),
    "return $a ? 1 : ($b ? 2 : 3);": (3, 2, 1),
    "$x = $a && $b ? 1 : 2; $y = $c ?? $d; $z = $e?->f;": (3, 2, 1),
    "return match (true) { $a => 1, default => 2 };": (2, 1, 1),
    "$f = function (?int $a = null): ?string { if ($a) { return 'if'; } }; // if": (2, 1, 1),
    "$this->if($a); $b->match; Foo::for(1); $case = 1;": (1, 1, 0),
    "if (f(function () { return 1; })) { g(); } h(fn ($x) => $x ? 1 : 2);": (3, 2, 1),
    "if ($a) { class_exists('b'); function inner() { if ($b) { } } }": (2, 1, 1),
    "while ($a": (2, 1, 1),
}


@pytest.mark.parametrize("body", BODIES)
def test_measures(body):
    got = {r[2]: r[5:] for r in complexity._measured("a.php", f"<?php class A {{\n public function f($a) {{ {body} }} }}")}
    assert got["f"] == BODIES[body]


def test_measures_of_files(spark):
    src = spark.createDataFrame([("a.php", "<?php\nclass A {\n  function f() { if (1) { } }\n  abstract function g();\n}\nfunction free() { }\n"), ("b.php", None)], "path string, content string")
    assert sorted(map(tuple, complexity.measures(src).collect()), key=repr) == [("a.php", "A", "f", 3, 3, 2, 1, 1), ("a.php", None, "free", 6, 6, 1, 1, 0)]
    assert [r.method for r in complexity.hotspots(complexity.measures(src), 1).collect()] == ["A::f"]


def plain_flow(edges, start, max_nodes, max_depth):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    depth, level = {start: 0}, [start]
    for d in range(1, max_depth + 1):
        new = sorted({b for a in level for b in out[a]} - depth.keys())[: max_nodes - len(depth)]
        depth |= dict.fromkeys(new, d)
        level = new
    n_edges = sum(b in depth for a, d in depth.items() if d < max_depth for b in out[a])
    return depth, len(depth) >= max_nodes or max(depth.values()) >= max_depth, n_edges > len(depth) - 1


@pytest.mark.parametrize("seed", range(3))
def test_flows_within_budgets(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}", "calls") for _ in range(60)] + [("hub", f"n{i}", "calls") for i in range(40)] + [("n1", "n2", "uses")]
    starts = ["hub", "n0", "n1", "n2", "alone"]
    for max_nodes, max_depth in ((320, 20), (6, 20), (15, 2)):
        got = callmap.flows(spark.createDataFrame(edges, "src string, dst string, type string"), spark.createDataFrame([(s,) for s in starts], "node string"), ["calls"], max_nodes, max_depth).collect()
        for s in starts:
            depth, truncated, cycle = plain_flow([e[:2] for e in edges if e[2] == "calls"], s, max_nodes, max_depth)
            rows = [x for x in got if x.start == s]
            assert {x.node: x.depth for x in rows} == depth
            assert {(x.n_nodes, x.truncated, x.cycle) for x in rows} == {(len(depth), truncated, cycle)}


def test_longest_chains(spark):
    edges = [(f"a{i}", f"a{i + 1}") for i in range(12)] + [("a0", "a5"), ("a0", "b"), ("b", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c2", "d"), ("d", "d"), ("x", "y")]
    e = spark.createDataFrame(edges, "src string, dst string")
    got = {r.start: (r.depth, r.path, r.cyclic) for r in callmap.longest_chains(e, spark.createDataFrame([("a0",), ("b",), ("c3",), ("y",), ("none",)], "node string")).collect()}
    assert got["a0"] == (13, [f"a{i}" for i in range(13)], False)
    assert got["b"] == (5, ["b", "c1", "d"], True)
    assert got["c3"] == (4, ["c1", "d"], True)
    assert got["y"] == (1, ["y"], False)
    assert got["none"] == (1, ["none"], False)
    assert callmap.longest_chains(e, spark.createDataFrame([("b",), ("a0",)], "node string"), least=callmap.DEEP_CHAIN).count() == 1


def test_longest_chains_against_a_plain_search(spark):
    r = random.Random(2)
    edges = [(a, b) for a in range(30) for b in range(a + 1, 30) if r.random() < 0.1]
    longest = {}
    for n in reversed(range(30)):
        longest[n] = max([(1 + longest[b][0], -b) for a, b in edges if a == n], default=(1, 0))
    got = callmap.longest_chains(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(n,) for n in range(30)], "node int")).collect()
    assert {x.start: x.depth for x in got} == {n: d for n, (d, _) in longest.items()}
    for x in got:
        assert len(x.path) == x.depth
        assert all((a, b) in set(edges) for a, b in zip(x.path, x.path[1:], strict=False))


def test_call_edges(spark):
    files = {
        "a.php": "<?php\nnamespace App;\nclass A {\n  public function __construct(private Store $store, \\Other\\Log $log) {}\n  function f() { $this->g(); self::h(); Store::open(); $this->store->save(); $this->log->write(); Gone::x(); $this->none(); // $this->i();\n }\n  function g() { }\n  static function h() { }\n  function i() { }\n}\n",
        "b.php": "<?php\nnamespace Lib;\nclass Store { static function open() { } function save() { static::open(); } }\n",
    }
    src = spark.createDataFrame(list(files.items()), "path string, content string")
    declared = php.declarations(src)
    got = {(r.src, r.dst) for r in callmap.call_edges(php.classes(declared, src), php.methods(declared)).collect()}
    f = "App\\A::f"
    assert got == {(f, "App\\A::g"), (f, "App\\A::h"), (f, "Lib\\Store::open"), (f, "Lib\\Store::save"), ("Lib\\Store::save", "Lib\\Store::open")}
