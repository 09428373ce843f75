"""Facts of PHP sources: declarations, classes, methods, routes, migrations and templates.

Only what needs matching brackets runs in Python, over batches of files: `declarations` and `route_statements`.
All else is column work on the rows that these two give. A null content has no facts; unclosed brackets reach the
end of the file.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lintlake.functions import extension
from lintlake.operators.findings import lines_of

_QUIET = re.compile(r"<<<[ \t]*(['\"]?)(\w+)\1\n.*?(?:\n[ \t]*\2\b|\Z)|//[^\n]*|#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"", re.S)
_DECLARED = re.compile(r"\b((?:\b(?:public|protected|private|static|abstract|final|readonly)\s+)*)(?<!::)(?<!new )\b(class|interface|trait|enum|function)\s+&?([A-Za-z_]\w*)")
_ROUTE, _GROUP = re.compile(r"\bRoute::"), re.compile(r"(?:->|::)group\s*\(")

#: Words and signs of a body that add a path through it.
BRANCHES = r"\b(?:if|elseif|for|foreach|while|case|catch)\b|&&|\|\||\?\?|(?<![(,:]\s{0,3})(?<!\b(?:public|private|protected|readonly|static)\s{1,3})\?(?![>:?-])"
LOOPS = r"\b(?:for|foreach|while)\s*\("
CALL = r"(?:->|::)\s*([A-Za-z_]\w*)\s*\("
MODEL_CALL = r"\b([A-Z]\w*)::(?:where|query|find|findOrFail|all|with|create|first|insert|update|delete)\s*\("
WRITE_CALL = r"(?:->|::)(?:create|insert|update|delete|save|forceDelete|upsert)\s*\("
VERBS = "get|post|put|patch|delete|options|any|match"

DECLARATIONS = "path string, ord int, kind string, name string, owner string, head string, body string, quiet string, first_line int, last_line int"
STATEMENTS = "path string, line int, statement string, heads array<string>"


def blank(text: str) -> str:
    """As many blanks as the text has signs; its line ends stay."""
    return re.sub(r"[^\n]", " ", text) if "\n" in text else " " * len(text)


def quieted(text: str) -> str:
    """The text with all but line ends of its comments and strings as blanks, so that places stay."""
    return _QUIET.sub(lambda m: blank(m[0]), text)


def _closing(quiet: str) -> dict[int, int]:
    """The place of the closing brace of each opening one."""
    stack, pairs = [], {}
    for m in re.finditer("[{}]", quiet):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs | dict.fromkeys(stack, len(quiet))


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def _declared(path: str, text: str) -> Iterator[tuple]:
    quiet = quieted(text)
    closing, starts = _closing(quiet), line_starts(text)
    owners: list[tuple[int, str]] = []
    for n, m in enumerate(_DECLARED.finditer(quiet)):
        stop = re.compile("[{;]").search(quiet, m.end())
        opened = stop.start() if stop else len(text)
        end = closing.get(opened, opened)
        while owners and owners[-1][0] < m.start():
            owners.pop()
        owner = owners[-1][1] if owners else None
        if m[2] != "function":
            owners.append((end, m[3]))
        inside = slice(opened + 1, end)
        yield path, n, m[2], m[3], owner, text[m.start() : opened], text[inside], quiet[inside], bisect_right(starts, m.start()), bisect_right(starts, end)


def _statements(path: str, text: str) -> Iterator[tuple]:
    quiet = quieted(text)
    closing, starts = _closing(quiet), line_starts(text)
    groups: list[tuple[int, str]] = []
    for m in _ROUTE.finditer(quiet):
        while groups and groups[-1][0] < m.start():
            groups.pop()
        depth, end = 0, len(text)
        for sign in re.compile("[(){};]").finditer(quiet, m.end()):
            at = sign.start()
            if sign[0] == "{" and _GROUP.search(quiet, m.start(), at):
                groups.append((closing[at], text[m.start() : at]))
                end = -1
                break
            depth += {"(": 1, "{": 1, ")": -1, "}": -1, ";": 0}[sign[0]]
            if sign[0] == ";" and depth <= 0:
                end = at
                break
        if end >= 0:
            yield path, bisect_right(starts, m.start()), text[m.start() : end], [head for _, head in groups]


def each_file(sources: DataFrame, rows, schema: str, flush: int = 2000) -> DataFrame:
    """What `rows` gives for each file; a task holds about `flush` rows before it passes them on."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        held = []
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held += rows(path, text)
                if len(held) >= flush:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                    held = []
        if held:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return sources.filter("content is not null").select("path", "content").mapInArrow(run, schema)


def by_file(sources: DataFrame, rows, name: str, fields: str, flush: int = 5000) -> DataFrame:
    """(path, `name`): what `rows` gives for each file, without its path, in one row as an array of structs with these `fields`. Files
    of which it gives nothing have no row."""
    schema = f"path string, {name} array<struct<{fields}>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    of = arrow.field(name).type
    inner = [of.value_type.field(i) for i in range(of.value_type.num_fields)]

    def batch(paths, held, ends):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), inner, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=inner), type=of)
        return pa.record_batch([pa.array(paths, pa.string()), lists], schema=arrow)

    def run(batches):
        paths, held, ends = [], [], [0]
        for given in batches:
            for path, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
                held += (r[1:] for r in rows(path, text))
                if len(held) > ends[-1]:
                    paths.append(path)
                    ends.append(len(held))
                if len(held) >= flush:
                    yield batch(paths, held, ends)
                    paths, held, ends = [], [], [0]
        if held:
            yield batch(paths, held, ends)

    return sources.filter("content is not null").select("path", "content").mapInArrow(run, schema)


def declarations(sources: DataFrame) -> DataFrame:
    """A row for each named class, interface, trait, enum and function, with its head, body and lines; `owner` is the
    class around it, `quiet` the body without comments and strings."""
    return each_file(sources, _declared, DECLARATIONS)


def namespaces(sources: DataFrame) -> DataFrame:
    return sources.select("path", F.regexp_extract("content", r"(?m)^\s*namespace\s+([\w\\]+)", 1).alias("namespace"))


def classes(declared: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, kind, name, fqcn, parent, interfaces, is_abstract, first_line, last_line, quiet)"""
    named = declared.filter("kind != 'function'").join(namespaces(sources), "path")
    parent = F.regexp_extract("head", r"\bextends\s+([\w\\]+)", 1)
    listed = F.regexp_extract("head", r"\bimplements\s+([\w\\,\s]+)", 1)
    return named.select(
        "path", "kind", "name", F.concat(F.when(F.col("namespace") != "", F.concat("namespace", F.lit("\\"))).otherwise(F.lit("")), "name").alias("fqcn"),
        F.when(parent != "", parent).alias("parent"), F.filter(F.split(F.regexp_replace(listed, r"\s+", ""), ","), lambda x: x != "").alias("interfaces"),
        F.col("head").rlike(r"\babstract\b").alias("is_abstract"), "first_line", "last_line", "quiet",
    )


def methods(declared: DataFrame) -> DataFrame:
    """(path, class, name, visibility, is_static, params, types, calls, created, thrown, body, quiet, lines and measures)"""
    head = F.col("head")
    m = declared.filter("kind = 'function' and owner is not null").select(
        "path", "ord", "head", F.col("owner").alias("class"), "name", F.coalesce(F.nullif(F.regexp_extract(head, r"\b(public|protected|private)\b", 1), F.lit("")), F.lit("public")).alias("visibility"),
        head.rlike(r"\bstatic\b.*\bfunction\b").alias("is_static"), F.regexp_extract_all(head, F.lit(r"\$(\w+)"), 1).alias("params"),
        F.regexp_extract_all(head, F.lit(r"([A-Z\\][\w\\]*)\s+\$\w+"), 1).alias("types"), F.nullif(F.regexp_extract(head, r"\)\s*:\s*([\w\\|?]+)", 1), F.lit("")).alias("returns"),
        F.array_distinct(F.regexp_extract_all("quiet", F.lit(CALL), 1)).alias("calls"), F.array_distinct(F.regexp_extract_all("quiet", F.lit(r"\bnew\s+([A-Z\\][\w\\]*)"), 1)).alias("created"),
        F.array_distinct(F.regexp_extract_all("quiet", F.lit(r"\bthrow\s+new\s+([\w\\]+)"), 1)).alias("thrown"), F.array_distinct(F.regexp_extract_all("quiet", F.lit(r"\b([A-Z]\w*)::"), 1)).alias("statics"),
        "body", "quiet", "first_line", "last_line",
    )
    return m.select(
        "*", (F.col("last_line") - F.col("first_line") + 1).alias("loc"), (F.regexp_count("quiet", F.lit(BRANCHES)) + 1).alias("cyclomatic"),
        F.size(F.array_distinct(F.transform("calls", F.lower))).alias("coupling"), F.regexp_count("quiet", F.lit(MODEL_CALL)).alias("n_queries"), F.regexp_count("quiet", F.lit(WRITE_CALL)).alias("n_writes"),
    )


def roles(classes_: DataFrame) -> DataFrame:
    """(path, fqcn, role): by place, name and parent; a class may have several."""
    under = lambda d: F.col("path").rlike(rf"(?i)(^|/){d}/")
    ends = lambda s: F.col("name").endswith(s)
    child = lambda *p: F.coalesce(F.element_at(F.split("parent", r"\\"), -1).isin(*p), F.lit(False))
    tests = {
        "controllers": under("controllers") | ends("Controller"), "models": under("models") | child("Model", "Authenticatable", "Pivot"), "services": under("services") | ends("Service"),
        "form_requests": under("requests") | child("FormRequest"), "repositories": under("repositories") | ends("Repository"), "jobs": under("jobs") | F.array_contains("interfaces", "ShouldQueue"),
        "middleware": under("middleware"), "policies": under("policies") | ends("Policy"), "migrations": child("Migration"), "exceptions": child("Exception", "RuntimeException") | ends("Exception"),
        "enums": F.col("kind") == "enum", "contracts": F.col("kind") == "interface",
    }
    return classes_.select("path", "fqcn", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(r)) for r, t in tests.items())))).alias("role"))


def dependencies(classes_: DataFrame, methods_: DataFrame) -> DataFrame:
    """(src, raw, how): names of classes that a class extends, implements, takes in its constructor, makes or calls."""
    own = classes_.select("path", F.col("name").alias("class"), F.col("fqcn").alias("src"))
    named = lambda how, names: F.transform(names, lambda n: F.struct(F.lit(how).alias("how"), n.alias("raw")))
    injected = F.when(F.col("name") == "__construct", F.col("types")).otherwise(F.array().cast("array<string>"))
    m = methods_.select("path", "class", F.explode(F.concat(named("injected", injected), named("new", F.col("created")), named("static", F.col("statics")))).alias("x"))
    parts = [
        classes_.filter("parent is not null").select(F.col("fqcn").alias("src"), F.col("parent").alias("raw"), F.lit("extends").alias("how")),
        classes_.select(F.col("fqcn").alias("src"), F.explode("interfaces").alias("raw"), F.lit("implements").alias("how")),
        m.join(own, ["path", "class"]).select("src", "x.raw", "x.how"),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.withColumn("raw", F.regexp_replace("raw", r"^\\", "")).distinct()


def listed(text: Column, call: str, key: str) -> Column:
    """The strings that a call `call('a')`, `call(['a', 'b'])` or a key `'key' => ...` of an older group gives."""
    value = r"(\[[^\]]*\]|'[^']*')"
    found = F.concat(F.regexp_extract_all(text, F.lit(rf"\b{call}\(\s*{value}"), 1), F.regexp_extract_all(text, F.lit(rf"'{key}'\s*=>\s*{value}"), 1))
    return F.flatten(F.transform(found, lambda x: F.regexp_extract_all(x, F.lit("'([^']*)'"), 1)))


def routes(sources: DataFrame) -> DataFrame:
    """(path, line, verb, uri, name, controller, action, middleware, is_closure): groups around a route lend it prefix, name and
    middleware, as calls or as an array of options; an action may also be written as 'Controller@action'."""
    s = each_file(sources.filter(F.contains("content", F.lit("Route::"))), _statements, STATEMENTS)
    within = lambda call, key: F.flatten(F.transform("heads", lambda h: listed(h, call, key)))
    first = lambda *patterns: F.coalesce(*(F.nullif(F.regexp_extract("statement", p, 1), F.lit("")) for p in patterns))
    verb = F.regexp_extract("statement", rf"(?:Route::|->)({VERBS})\s*\(", 1)
    own = F.regexp_extract("statement", rf"(?:Route::|->)(?:{VERBS})\s*\(\s*(?:\[[^\]]*\]\s*,\s*)?'([^']*)'", 1)
    uri = F.regexp_replace(F.concat_ws("/", F.array_append(within("prefix", "prefix"), own)), "/+", "/")
    given = F.regexp_extract("statement", r"->name\(\s*'([^']*)'", 1)
    return s.filter(verb != "").select(
        "path", "line", verb.alias("verb"), F.concat(F.lit("/"), F.regexp_replace(uri, "^/|/$", "")).alias("uri"),
        F.when(given != "", F.concat(F.array_join(within("(?:name|as)", "as"), ""), given)).alias("name"),
        first(r"\[\s*([\w\\]+)::class", r"'([\w\\]+)@\w+'", r",\s*([\w\\]+)::class\s*\)").alias("controller"), first(r"\[[^\]]*::class\s*,\s*'(\w+)'", r"'[\w\\]+@(\w+)'").alias("action"),
        F.array_distinct(F.concat(within("middleware", "middleware"), listed(F.col("statement"), "middleware", "middleware"))).alias("middleware"),
        F.col("statement").rlike(r"function\s*\(|\bfn\s*\(").alias("is_closure"),
    )


def migrations(declared: DataFrame) -> DataFrame:
    """(path, op, table, column, type, indexed, foreign): what `up` methods do; a table without columns has a null one."""
    blocks = declared.filter("kind = 'function' and name = 'up'").select("path", F.explode(F.filter(F.split("body", "Schema::"), lambda _, i: i > 0)).alias("block"))
    act = blocks.select(
        "path", F.regexp_extract("block", r"^(\w+)", 1).alias("op"), F.regexp_extract("block", r"^\w+\(\s*'(\w+)'", 1).alias("table"),
        F.explode_outer(F.regexp_extract_all("block", F.lit(r"\$table->\w+\(\s*'\w+'[^;]*"), 0)).alias("part"),
    )
    return act.select(
        "path", "op", "table", F.regexp_extract("part", r"\('(\w+)'", 1).alias("column"), F.regexp_extract("part", r"->(\w+)\(", 1).alias("type"),
        F.col("part").rlike(r"->(index|unique|primary)\(|->foreignId\(|->constrained\(").alias("indexed"), F.col("part").rlike(r"->constrained\(|->references\(|->foreign\(").alias("foreign"),
    )


def template_marks(sources: DataFrame) -> DataFrame:
    """(path, line, kind, context): raw echoes and queries in Blade templates."""
    lines = lines_of(sources.filter(extension(F.col("path")) == ".blade.php"))
    marks = lambda kind, p: F.transform(F.regexp_extract_all("content", F.lit(p), 0), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("context")))
    found = F.concat(marks("raw_echo", r"\{!!.*?!!\}"), marks("query", MODEL_CALL + r"|\bDB::\w+\("))
    return lines.select("path", "line", F.explode(found).alias("x")).select("path", "line", "x.*")


def components(sources: DataFrame) -> DataFrame:
    """(path, components, hooks, imports) of script files with JSX."""
    all_of = lambda p: F.array_distinct(F.regexp_extract_all("content", F.lit(p), 1))
    return sources.filter(extension(F.col("path")).isin(".js", ".jsx", ".ts", ".tsx")).select(
        "path", all_of(r"\b(?:function|const|class)\s+([A-Z]\w*)").alias("components"), all_of(r"\b(use[A-Z]\w*)\s*\(").alias("hooks"),
        all_of(r"(?:\bfrom\s*|\bimport\s*\(?\s*)['\"]([^'\"]+)['\"]").alias("imports"),
    )
