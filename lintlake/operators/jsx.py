"""The element stream of JSX and HTML sources, and rules over it.

Only cutting a text into tags runs in Python, over batches of files (`elements`); rules, parents and utility classes are
column work and joins on the rows that it gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import fingerprint
from lintlake.operators.php import each_file

ELEMENTS = "path string, ord int, parent int, depth int, tag string, line int, attrs map<string,string>, inner string"
#: Elements of HTML that have no end tag.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_OPEN = re.compile(r"<(/?)([A-Za-z][\w.:-]*(?=[\s/>])|(?=>))")
_SCRIPT = re.compile(r"\.[jt]sx?$")
_NAME = re.compile(r"[^\s=/>{]+")
_SKIP = re.compile(r"\s*(?:/(?!>))?\s*")


def _braced(text: str, at: int) -> int:
    """The place after the brace that closes the one at `at`; strings inside may hold braces."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            if c == quote and text[i - 1] != "\\":
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
    return len(text)


def _attributes(text: str, at: int) -> tuple[dict[str, str], int, bool]:
    """(attributes, place after the tag, whether it closes itself). Values are as written, in braces or without quotes."""
    attrs: dict[str, str] = {}
    while at < len(text):
        at = _SKIP.match(text, at).end()
        if text.startswith("/>", at):
            return attrs, at + 2, True
        if text.startswith(">", at):
            return attrs, at + 1, False
        if text.startswith("{", at):  # a spread
            end = _braced(text, at)
            attrs[text[at:end]] = ""
            at = end
            continue
        m = _NAME.match(text, at)
        if not m:
            at += 1
            continue
        name, at = m[0], m.end()
        eq = re.compile(r"\s*=\s*").match(text, at)
        value = ""
        if eq:
            at = eq.end()
            if at < len(text) and text[at] in "'\"":
                end = text.find(text[at], at + 1)
                end = len(text) if end < 0 else end
                value, at = text[at + 1 : end], end + 1
            elif at < len(text) and text[at] == "{":
                end = _braced(text, at)
                value, at = text[at:end], end
            else:
                m = re.compile(r"[^\s>]*").match(text, at)
                value, at = m[0], m.end()
        attrs.setdefault(name, value)
    return attrs, at, False


def _elements(path: str, text: str) -> Iterator[tuple]:
    rows: list[list] = []
    stack: list[int] = []
    at, line, counted, script = 0, 1, 0, bool(_SCRIPT.search(path or ""))
    while m := _OPEN.search(text, at):
        begin = m.start()
        # in a script a type argument or a comparison follows a name: useState<User>; text before a tag does so too
        if script and not m[1] and begin and (text[begin - 1].isalnum() or text[begin - 1] in "_)]") and not (stack and m[2][:1].islower()):
            at = begin + 1
            continue
        line += text.count("\n", counted, begin)
        counted = begin
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if rows[stack[k]][4] == m[2]:
                    for i in stack[k:]:
                        rows[i][7] = text[rows[i][7] : begin]
                    del stack[k:]
                    break
            at = text.find(">", begin) + 1 or len(text)
            continue
        attrs, at, closed = _attributes(text, m.end())
        rows.append([path, len(rows), stack[-1] if stack else None, len(stack), m[2], line, attrs, at])
        if closed or m[2].lower() in _VOID:
            rows[-1][7] = ""
        else:
            stack.append(len(rows) - 1)
    for i in stack:  # never closed
        rows[i][7] = ""
    for r in rows:
        r[6] = list(r[6].items())
        yield tuple(r)


def elements(sources: DataFrame) -> DataFrame:
    """(path, ord, parent, depth, tag, line, attrs, inner) of each element in the order of their start tags; `parent` is the
    `ord` of the element around it, `inner` the source between its tags. Fragments have an empty tag. An element that is
    never closed has no inner text; a null content has no element."""
    return each_file(sources, _elements, ELEMENTS)


def utility_classes(found: DataFrame) -> DataFrame:
    """(path, ord, line, class, variants, utility): each class name in `class` or `className`, its variants (hover:, md:) apart."""
    names = F.coalesce(F.col("attrs")["className"], F.col("attrs")["class"])
    each = found.select("path", "ord", "line", F.explode(F.regexp_extract_all(names, F.lit(r"([^\s'\"`{}$,()?]+)"))).alias("class"))
    parts = F.split("class", r":(?![^\[]*\])")
    return each.select("path", "ord", "line", "class", F.slice(parts, 1, F.size(parts) - 1).alias("variants"), F.element_at(parts, -1).alias("utility"))


@dataclass(frozen=True)
class ElementRule:
    """`when` says of a row of `with_parents` whether it is a finding; `hit` and `miss` are texts."""

    rule_id: str
    category: str
    severity: str
    confidence: float
    when: Callable[[], Column]
    hit: str
    miss: str


def with_parents(found: DataFrame) -> DataFrame:
    """The elements with `up_tag` and `up_attrs` of the element around each, and `heading_before`, the level of the last heading before it
    in the file."""
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    found = found.withColumn("heading_before", F.last(level, ignorenulls=True).over(Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)))
    up = found.select("path", F.col("ord").alias("parent"), F.col("tag").alias("up_tag"), F.col("attrs").alias("up_attrs"))
    return found.join(up, ["path", "parent"], "left")


def _a(name: str) -> Column:
    return F.col("attrs")[name]


def _has(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out |= F.map_contains_key("attrs", n)
    return out


def _tag(*names: str) -> Column:
    return F.col("tag").isin(*names)


def _up(*names: str) -> Column:
    return F.coalesce(F.col("up_tag").isin(*names), F.lit(False))


def _role(*names: str) -> Column:
    return F.coalesce(_a("role").isin(*names), F.lit(False))


def _like(name: str, pattern: str) -> Column:
    return F.coalesce(_a(name).rlike(pattern), F.lit(False))


_PLAIN = r"^[a-z]"  # an element of HTML, not a component
_CONTROL = r"<(input|select|textarea|[A-Z]\w*(Input|Select|Field|Textarea))\b"
_SPACE = r"(^|\s|['\"`])(-?m[xytblr]?)-[\w\[]"

RULES = [
    ElementRule("heading-order", "accessibility", "medium", 0.85, lambda: F.coalesce(F.col("tag").rlike("^h[1-6]$") & (F.substring("tag", 2, 1).try_cast("int") > F.col("heading_before") + 1), F.lit(False)), "<div><h2>a</h2><h4>b</h4></div>", "<div><h1>a</h1><h2>b</h2><h3>c</h3><h1>d</h1></div>"),
    ElementRule("interactive-accessible-name-required", "accessibility", "high", 0.9, lambda: _tag("button", "a") & ~_has("aria-label", "aria-labelledby", "title") & ~F.col("inner").rlike(r"(>|^)[^<>{}]*[A-Za-z0-9][^<>{}]*(<|$)|\{|\balt=['\"][^'\"]"), "<button><Icon /></button>", "<button aria-label='Close'><Icon /></button>"),
    ElementRule("jsx-aria-attribute-format", "accessibility", "medium", 0.96, lambda: F.exists(F.map_keys("attrs"), lambda k: k.rlike(r"^aria([A-Z_]|-[A-Z])")), "<p ariaLabel='x'>a</p>", "<p aria-label='x'>a</p>"),
    ElementRule("semantic-wrapper-breakage", "accessibility", "medium", 0.92, lambda: F.col("tag").rlike(_PLAIN) & ((_up("ul", "ol") & ~_tag("li", "script", "template")) | (_up("tr") & ~_tag("td", "th")) | (_up("dl") & ~_tag("dt", "dd", "div"))), "<ul><div>a</div></ul>", "<ul><li>a</li></ul>"),
    ElementRule("form-label-association", "accessibility", "high", 0.9, lambda: _tag("label") & ~_has("htmlFor", "for") & ~F.col("inner").rlike(_CONTROL), "<label>Name</label>", "<label>Name <input /></label>"),
    ElementRule("apg-tabs-keyboard-contract", "accessibility", "high", 0.9, lambda: (_role("tab") & ~_has("aria-selected")) | (_role("tablist") & ~F.col("inner").rlike("onKeyDown") & ~_has("onKeyDown")), "<div role='tablist'><b role='tab'>a</b></div>", "<div role='tablist' onKeyDown={f}><b role='tab' aria-selected={s}>a</b></div>"),
    ElementRule("apg-accordion-disclosure-contract", "accessibility", "medium", 0.88, lambda: _tag("button", "div", "summary") & _like("className", r"(?i)(accordion|disclosure)[\w-]*(trigger|header|button)") & ~_has("aria-expanded"), "<button className='accordion-trigger'>a</button>", "<button className='accordion-trigger' aria-expanded={o}>a</button>"),
    ElementRule("apg-menu-button-contract", "accessibility", "high", 0.9, lambda: _like("aria-haspopup", r"^\{?['\"]?(menu|true)") & ~_has("aria-expanded"), "<button aria-haspopup='menu'>a</button>", "<button aria-haspopup='menu' aria-expanded={o}>a</button>"),
    ElementRule("apg-combobox-contract", "accessibility", "high", 0.9, lambda: _role("combobox") & ~(_has("aria-expanded") & _has("aria-controls")), "<input role='combobox' />", "<input role='combobox' aria-expanded={o} aria-controls='l' />"),
    ElementRule("suspense-fallback-missing", "react_best_practice", "medium", 0.92, lambda: _tag("Suspense", "React.Suspense") & ~_has("fallback"), "<Suspense><A /></Suspense>", "<Suspense fallback={<p>a</p>}><A /></Suspense>"),
    ElementRule("controlled-uncontrolled-input-mismatch", "react_best_practice", "high", 0.9, lambda: _tag("input", "select", "textarea") & ((_has("value") & _has("defaultValue")) | (_has("checked") & _has("defaultChecked")) | (_has("value") & ~_has("onChange", "onInput", "readOnly", "disabled", "type"))), "<input value={v} defaultValue='a' />", "<input value={v} onChange={f} />"),
    ElementRule("duplicate-key-source", "react_best_practice", "medium", 0.75, lambda: _like("key", r"^\{\s*\w+\.(name|title|label|type|status|text|value)\s*\}$"), "<li key={x.name}>a</li>", "<li key={x.id}>a</li>"),
    ElementRule("ref-access-during-render", "react_best_practice", "medium", 0.88, lambda: F.exists(F.map_entries("attrs"), lambda e: e["value"].rlike(r"\w\.current\b") & ~e["key"].rlike("^(on[A-Z]|ref$)")), "<p title={box.current}>a</p>", "<p onClick={() => box.current.focus()}>a</p>"),
    ElementRule("dangerous-html-sink-without-sanitizer", "security", "high", 0.9, lambda: _has("dangerouslySetInnerHTML") & ~_like("dangerouslySetInnerHTML", r"(?i)sanitize|purify|trusted"), "<p dangerouslySetInnerHTML={{ __html: body }} />", "<p dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(body) }} />"),
    ElementRule("context-oversized-provider", "performance", "medium", 0.82, lambda: F.col("tag").endswith(".Provider") & _like("value", r"^\{\s*\{([^,{}]+,){5,}[^{}]*\}"), "<A.Provider value={{ a, b, c, d, e, f }}>x</A.Provider>", "<A.Provider value={{ a, b }}>x</A.Provider>"),
    ElementRule("react-parent-child-spacing-overlap", "react_best_practice", "medium", 0.8, lambda: F.coalesce(F.col("up_attrs")["className"].rlike(r"(^|\s)(gap|space-[xy])-"), F.lit(False)) & _like("className", _SPACE), "<div className='flex gap-4'><p className='mt-2'>a</p></div>", "<div className='flex gap-4'><p className='text-sm'>a</p></div>"),
]


def scan_elements(sources: DataFrame, rules: list[ElementRule] | None = None) -> DataFrame:
    """(file, line, rule_ord, rule_id, category, severity, confidence, context, fingerprint): all rules in one pass over the elements."""
    rules = RULES if rules is None else rules
    marks = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence")) for r in rules))
    hits = F.array_compact(F.array(*(F.when(r.when(), F.lit(n)) for n, r in enumerate(rules))))
    found = with_parents(elements(sources)).select(F.col("path").alias("file"), "line", F.concat(F.lit("<"), F.col("tag"), F.lit("> "), F.col("ord").cast("string")).alias("context"), F.explode(hits).alias("rule_ord"))
    marked = found.select("file", "line", "rule_ord", F.element_at(marks, F.col("rule_ord") + 1).alias("m"), "context").select("file", "line", "rule_ord", "m.*", "context")
    return marked.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), F.col("context"), F.col("rule_id")))
