"""The element stream and the rules over it."""

import pytest

from lintlake.operators import jsx


def parsed(spark, text):
    return jsx.elements(spark.createDataFrame([("a.tsx", text)], "path string, content string")).orderBy("ord").collect()


def test_elements(spark):
    rows = parsed(
        spark,
        "const [u] = useState<User>(null)\nreturn (\n <>\n  <A.B x={{a: '}'}} y=\"1 > 0\" on {...rest} onClick={() => { if (a < b) go(`}`) }}>\n   {list.map(i => <li key={i.id}>t</li>)}\n   <img src='a' />\n  </A.B>\n </>\n)",
    )
    assert [(r.tag, r.line, r.parent, r.depth) for r in rows] == [("", 3, None, 0), ("A.B", 4, 0, 1), ("li", 5, 1, 2), ("img", 6, 1, 2)]
    assert rows[1].attrs == {"x": "{{a: '}'}}", "y": "1 > 0", "on": "", "{...rest}": "", "onClick": "{() => { if (a < b) go(`}`) }}"}
    assert rows[2].attrs == {"key": "{i.id}"} and rows[2].inner == "t" and rows[3].inner == ""
    assert parsed(spark, "if (a < b && c > d) { x<y }") == []
    assert [r.tag for r in parsed(spark, "<p>open <br> <b")] == ["p", "br"]
    assert jsx.elements(spark.createDataFrame([("a", None), ("b", "")], "path string, content string")).count() == 0


def test_utility_classes(spark):
    found = jsx.elements(spark.createDataFrame([("a", "<p className='md:hover:p-2 bg-[url(a:b)] x'>a</p>")], "path string, content string"))
    assert {(r["class"], tuple(r.variants), r.utility) for r in jsx.utility_classes(found).collect()} >= {("md:hover:p-2", ("md", "hover"), "p-2"), ("x", (), "x")}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{side}{n}", getattr(r, side)) for n, r in enumerate(jsx.RULES) for side in ("hit", "miss")]
    return {(x.file, x.rule_id) for x in jsx.scan_elements(spark.createDataFrame(rows, "path string, content string")).collect()}


@pytest.mark.parametrize("n", range(len(jsx.RULES)), ids=[r.rule_id for r in jsx.RULES])
def test_samples(found, n):
    r = jsx.RULES[n]
    assert (f"hit{n}", r.rule_id) in found and (f"miss{n}", r.rule_id) not in found


def test_heading_order(spark):
    texts = {"skips": "<h2>a</h2><h5>b</h5>", "nested": "<div><h1>a</h1><section><h3>b</h3></section></div>", "fine": "<h3>a</h3><h1>b</h1><h2>c</h2><h3>d</h3><h2>e</h2>", "alone": "<h4>a</h4>", "twice": "<h1>a</h1><h3>b</h3><h2>c</h2><h4>d</h4>"}
    src = spark.createDataFrame([(f"{k}.tsx", v) for k, v in texts.items()], "path string, content string")
    found = [r.file for r in jsx.scan_elements(src, [r for r in jsx.RULES if r.rule_id == "heading-order"]).collect()]
    assert sorted(found) == ["nested.tsx", "skips.tsx", "twice.tsx", "twice.tsx"]
