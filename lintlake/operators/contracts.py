"""What routes, requests, data objects, pages and forms ask of each other, and where they don't agree.

A field is named by what stands before its first dot: `items.*.id` is a field of `items`, and who gives `items` gives it. Each
contract is a table of sets for a route; where one set asks for more than the other has, there is a finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import normal_path
from lintlake.operators import bodies

#: Paths that belong to tools, and namespaces of frameworks.
TOOL_PATHS = ("_debugbar", "_ignition", "horizon", "livewire", "nova", "sanctum/csrf-cookie", "storage", "telescope", "up", "vendor")
FRAMEWORKS = ("Illuminate\\", "Laravel\\", "Symfony\\", "Spatie\\", "Barryvdh\\")
MUTATING = ("post", "put", "patch", "delete")

_ROUND = r"[^()]*+(?:\([^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+\)[^()]*+)*+"  # what stands in brackets, four deep


def field(name: Column) -> Column:
    return F.trim(F.substring_index(F.regexp_replace(name, r"\.\*", ""), ".", 1))


def _fields(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, field), lambda x: x != "")))


def _all(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _strings_in(texts: Column) -> Column:
    return F.flatten(F.transform(texts, lambda x: _all(x, r"['\"]([\w.*-]+)['\"]")))


def app_routes(routes: DataFrame) -> DataFrame:
    """Routes of the application: neither a tool's, nor a package's, nor a framework's controller."""
    uri = F.lower(F.regexp_replace("uri", "^/+|/+$", ""))
    tool = F.lit(False)
    for t in TOOL_PATHS:
        tool |= (uri == t) | uri.startswith(t + "/")
    package = F.concat(F.lit("/"), F.lower("path")).contains("/vendor/")
    foreign = F.lit(False)
    for n in FRAMEWORKS:
        foreign |= F.coalesce(F.ltrim(F.col("controller"), F.lit("\\")).startswith(n), F.lit(False))
    return routes.filter(~tool & ~package & ~foreign)


def named_classes(names: DataFrame, classes: DataFrame) -> DataFrame:
    """(raw, path, name, fqcn): the class of each name `raw`: that of the full name, else the first by full name of those with its last part."""
    last = lambda c: F.element_at(F.split(c, r"\\"), -1)
    raw = names.select("raw", F.ltrim(F.col("raw"), F.lit("\\")).alias("full")).distinct()
    known = classes.select("path", "name", "fqcn").distinct()
    exact = raw.join(known.groupBy(F.col("fqcn").alias("full")).agg(F.min(F.struct("fqcn", "path", "name")).alias("exact")), "full", "left")
    short = known.groupBy(F.col("name").alias("last")).agg(F.min(F.struct("fqcn", "path", "name")).alias("short"))
    both = exact.withColumn("last", last("full")).join(short, "last", "left").withColumn("c", F.coalesce("exact", "short"))
    return both.filter("c is not null").select("raw", "c.path", "c.name", "c.fqcn")


def actions(routes: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Routes with a controller, and `class_path`, `class` and `fqcn` of its class and the columns of the method that they run; nulls where there is none."""
    r = app_routes(routes).filter("controller is not null and not is_closure").withColumn("method", F.coalesce("action", F.lit("__invoke")))
    found = named_classes(r.select(F.col("controller").alias("raw")), classes).toDF("controller", "class_path", "class", "fqcn")
    m = methods.select(
        F.col("path").alias("class_path"), "class", F.col("name").alias("method"), "head", "body", F.col("first_line").alias("method_line"), "params", "types", F.lit(True).alias("has_method")
    ).dropDuplicates(["class_path", "class", "method"])
    return r.join(found, "controller", "left").join(m, ["class_path", "class", "method"], "left")


def accepted(validations: DataFrame) -> DataFrame:
    """(path, class, method, accepted, required): fields that a method, or a request class by `rules`, lets through and asks for. A confirmed
    field comes with its confirmation; one that may be null or missing isn't asked for."""
    rule = F.lower(F.array_join("rules", "|"))
    f = field(F.col("field"))
    each = validations.select(
        "path", "class", "method", F.explode(F.array_compact(F.array(f, F.when(F.array_contains(F.split(rule, r"\s*\|\s*"), "confirmed"), F.concat(f, F.lit("_confirmation")))))).alias("one"),
        F.when(rule.contains("required") & ~rule.contains("nullable") & ~rule.contains("sometimes"), f).alias("asked"),
    )
    return each.groupBy("path", "class", "method").agg(F.array_sort(F.collect_set("one")).alias("accepted"), F.array_sort(F.collect_set("asked")).alias("required"))


def used_fields(body: Column) -> Column:
    """Fields of the request that a method reads."""
    single = F.concat(
        _all(body, r"(?i)\$request\s*->\s*(?:input|get|post|query|boolean|integer|string|date)\s*\(\s*['\"]([^'\"]+)['\"]"), _all(body, r"(?i)\brequest\s*\(\s*['\"]([^'\"]+)['\"]"),
        _all(body, r"(?i)\$request\s*->\s*(?:validated|safe)\s*\(\s*['\"]([^'\"]+)['\"]"),
    )
    return _fields(F.concat(single, _strings_in(_all(body, r"(?s)\$request\s*->\s*(?:safe\s*\(\s*\)\s*->\s*)?(?:only|except)\s*\((.*?)\)"))))


def route_contracts(routes: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """`actions` whose method is there, with the sets `accepted`, `required` (by the method itself or the request class that it
    takes), `used` (what it reads) and `uri_params`."""
    none = F.expr("cast(array() AS array<string>)")
    checks = bodies.validations(methods)
    own = accepted(checks.filter("kind <> 'form_request'")).toDF("class_path", "class", "method", "own_accepted", "own_required")
    a = actions(routes, classes, methods).filter("has_method").join(own, ["class_path", "class", "method"], "left")
    a = a.withColumn("request", F.element_at(F.concat(F.filter("types", lambda t: t.endswith("Request") & (F.element_at(F.split(t, r"\\"), -1) != "Request")), F.array(F.lit(None).cast("string"))), 1))
    by_class = accepted(checks.filter("kind = 'form_request'")).select(F.col("path").alias("request_path"), F.col("class").alias("request_class"), F.col("accepted").alias("class_accepted"), F.col("required").alias("class_required"))
    requests = named_classes(a.filter("request is not null").select(F.col("request").alias("raw")), classes).select(F.col("raw").alias("request"), F.col("path").alias("request_path"), F.col("name").alias("request_class"))
    a = a.join(requests.join(by_class, ["request_path", "request_class"], "left"), "request", "left")
    both = lambda c: F.array_sort(F.array_union(F.coalesce(f"own_{c}", none), F.coalesce(f"class_{c}", none)))
    return a.select(
        F.col("path").alias("route_path"), F.col("line").alias("route_line"), "verb", "uri", F.col("name").alias("route_name"), "controller", "method", "class_path", "class", "head", "body", "method_line", "params",
        both("accepted").alias("accepted"), both("required").alias("required"), used_fields(F.col("body")).alias("used"), _all("uri", r"\{([A-Za-z_][\w-]*)\??(?::[^}]*)?\}").alias("uri_params"),
    )


_LABEL = "concat_ws(' ', upper(verb), uri)"


def _found(df: DataFrame, kind: str, file: str, line: str, severity: Column, confidence: float, subject: str, missing: str = "missing") -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"), F.col(file).alias("file"), F.expr(line).cast("int").alias("line"), severity.alias("severity"), F.lit(confidence).alias("confidence"), F.expr(_LABEL).alias("route"),
        F.expr(subject).alias("subject"), F.expr(missing).alias("missing"),
    )


def _by_verb(mutating: str = "high", else_: str = "medium") -> Column:
    return F.when(F.col("verb").isin(*MUTATING), mutating).otherwise(else_)


def target_findings(routes: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Routes whose controller, or whose method of it, isn't there."""
    a = actions(routes, classes, methods)
    high, no = F.lit("high"), "cast(array() AS array<string>)"
    return _found(a.filter("fqcn is null"), "route_target", "path", "line", high, 0.92, "controller", no).unionByName(
        _found(a.filter("fqcn is not null and has_method is null"), "route_target", "class_path", "line", high, 0.94, "concat_ws('::', controller, method)", no)
    )


def request_findings(contracts: DataFrame) -> DataFrame:
    """Fields that a method reads and nothing lets through. Queries of a GET are of little weight."""
    queried = _fields(_all("body", r"->\s*query\s*\(\s*['\"]([^'\"]+)['\"]"))
    missing = F.array_except(F.array_except("used", "accepted"), "uri_params")
    c = contracts.withColumn("missing", F.when(F.col("verb") == "get", F.array_except(missing, queried)).otherwise(missing)).filter("size(missing) > 0")
    return _found(c, "request_validation", "class_path", "method_line", _by_verb(), 0.82, "concat_ws('::', class, method)")


def binding_findings(contracts: DataFrame) -> DataFrame:
    """Parameters of the path that the method doesn't take."""
    asked = F.filter("uri_params", lambda p: ~F.array_contains("params", p) & ~F.array_contains("params", F.replace(p, F.lit("-"), F.lit("_"))))
    c = contracts.withColumn("missing", F.array_sort(F.array_distinct(asked))).filter("size(missing) > 0")
    return _found(c, "route_model_binding", "class_path", "method_line", F.lit("low"), 0.62, "concat_ws('::', class, method)")


def constructor_fields(methods: DataFrame) -> DataFrame:
    """(path, class, asked): what a data object's constructor needs: parameters without a default that can't be null."""
    inside = F.regexp_extract("head", r"(?s)\((.*)\)", 1)
    part = r"(?:[^,()\[\]]|\([^()]*\)|\[[^\[\]]*\])+"
    needed = F.filter(_all(inside, part, 0), lambda p: ~p.contains("=") & ~F.substring_index(p, "$", 1).contains("?") & p.contains("$"))
    data = methods.filter(F.col("class").rlike("(Dto|DTO|Data|Payload)$") & (F.col("name") == "__construct"))
    return data.select("path", "class", F.transform(needed, lambda p: F.regexp_extract(p, r"\$(\w+)", 1)).alias("asked"))


def data_findings(contracts: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Data objects that a method makes without what they need. Arguments by name or the keys of an array count; a whole request gives what it lets through."""
    made = [rf"(?s)new\s+([A-Z][\w\\]*(?:Dto|DTO|Data|Payload))\s*\(({_ROUND})\)", rf"(?s)([A-Z][\w\\]*(?:Dto|DTO|Data|Payload))::(fromArray|fromRequest|make)\s*\(({_ROUND})\)"]
    calls = F.concat(
        F.transform(F.arrays_zip(_all("body", made[0], 1).alias("n"), _all("body", made[0], 2).alias("a")), lambda x: F.struct(x["n"].alias("n"), F.lit("new").alias("how"), x["a"].alias("a"))),
        F.transform(F.arrays_zip(_all("body", made[1], 1).alias("n"), _all("body", made[1], 2).alias("h"), _all("body", made[1], 3).alias("a")), lambda x: F.struct(x["n"].alias("n"), x["h"].alias("how"), x["a"].alias("a"))),
    )
    each = contracts.select("verb", "uri", "class_path", "class", "method", "method_line", "accepted", F.explode(calls).alias("x")).select("*", F.col("x.n").alias("raw"))
    by_name, keys = _fields(_all("x.a", r"(?<![:?])\b([A-Za-z_]\w*)\s*:(?!:)")), _fields(_all("x.a", r"['\"]([\w.*-]+)['\"]\s*=>"))
    whole = (F.col("x.how") == "fromRequest") | F.lower("x.a").contains("validated") | F.col("x.a").contains("$request")
    given = F.when(F.size(by_name) > 0, by_name).when(F.size(keys) > 0, keys).when(whole, F.col("accepted")).otherwise(F.expr("cast(array() AS array<string>)"))
    known = named_classes(each.select("raw"), classes.filter(F.col("name").rlike("(Dto|DTO|Data|Payload)$"))).select("raw", F.col("path").alias("data_path"), F.col("name").alias("data_class"), F.col("fqcn").alias("data"))
    asked = constructor_fields(methods).toDF("data_path", "data_class", "asked")
    c = each.join(known, "raw").join(asked, ["data_path", "data_class"]).withColumn("missing", F.array_sort(F.array_except("asked", given))).filter("size(missing) > 0")
    return _found(c, "dto_contract", "class_path", "method_line", _by_verb(), 0.78, "data")


#: Where pages lie, as the place of the folder and then of the ending in which they are looked for.
PAGE_FOLDERS, PAGE_ENDINGS = ("resources/js/pages", "js/pages"), tuple(f"{i}.{e}" for i in ("", "/index") for e in ("tsx", "jsx", "ts", "js", "vue"))


def page_props(sources: DataFrame) -> DataFrame:
    """(path, asked): what a page can't do without: members of its `...Props` that aren't optional, else what its function takes apart."""
    typed = F.flatten(F.transform(_all("content", r"(?s)(?:interface|type)\s+\w*Props\s*(?:=\s*)?\{(.*?)\n?\}(?:\s*;)?(?=\s|$)"), lambda b: _all(b, r"(?m)^\s*([A-Za-z_]\w*)\s*:")))
    apart = _all("content", r"(?:function\s+\w+|const\s+\w+\s*=\s*\(|export\s+default\s+function\s*\w*)\s*\(?\s*\{([^}]*)\}")
    plain = F.flatten(F.transform(apart, lambda b: F.filter(F.transform(F.split(b, ","), lambda p: F.regexp_extract(p, r"^\s*([A-Za-z_]\w*)\s*(?:[:=]|$)", 1)), lambda n: ~n.isin("", "className", "children"))))
    pages = sources.filter(F.lower("path").rlike(r"(^|/)js/pages/.*\.(tsx|jsx|ts|js|vue)$") & F.col("content").isNotNull())
    asked = F.array_distinct(F.when(F.size(typed) > 0, typed).otherwise(plain))
    return pages.select("path", F.array_sort(F.filter(asked, lambda x: x != "children")).alias("asked"))


def page_findings(contracts: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages that a method renders and that aren't there, or that need more than it sends. What can't be read off counts as unknown."""
    call = rf"(?s)Inertia::render\s*\(\s*['\"]([^'\"]+)['\"]\s*(?:,({_ROUND}))?\)"
    sent = F.regexp_extract("body", call, 2)
    keys = F.array_union(_fields(_all(sent, r"['\"]([\w.*-]+)['\"]\s*=>")), _fields(_strings_in(_all(sent, r"(?s)compact\s*\((.*?)\)"))))
    page = F.lower(F.regexp_replace(normal_path(F.regexp_extract("body", call, 1)), "^/|/$", ""))
    shown = contracts.withColumn("page", page).filter("page <> ''").withColumn("name", F.regexp_extract("body", call, 1)).withColumn("sent", keys)
    shown = shown.withColumn("unknown", (F.trim(sent) != "") & (F.size("sent") == 0) & ~F.regexp_replace(sent, r"\s", "").isin("[]", "array()"))
    places = [F.concat(F.lit(f + "/"), "page", F.lit(e)) for f in PAGE_FOLDERS for e in PAGE_ENDINGS]
    tried = shown.select("page", F.posexplode(F.array(*places)).alias("nth", "key")).distinct()
    known = page_props(sources).withColumn("key", F.lower("path"))
    best = tried.join(known, "key").groupBy("page").agg(F.min_by("asked", "nth").alias("asked"), F.lit(True).alias("there"))
    c = shown.join(best, "page", "left")
    gone = _found(c.filter("there is null"), "inertia_page", "class_path", "method_line", F.lit("high"), 0.9, "name", "cast(array() AS array<string>)")
    less = c.filter("there and not unknown").withColumn("missing", F.array_except("asked", "sent")).filter("size(missing) > 0")
    return gone.unionByName(_found(less, "inertia_props", "class_path", "method_line", F.lit("high"), 0.84, "name"))


def form_payloads(sources: DataFrame) -> DataFrame:
    """(file, route_name, sent): what scripts send to named routes: the object of the call, else what `useForm` starts with."""
    keys = lambda body: _fields(F.concat(_all(body, r"(?:^|[,{\s])([A-Za-z_]\w*)\s*:"), _all(body, r"['\"]([\w.-]+)['\"]\s*:"), _all(body, r"(?:^|,)\s*([A-Za-z_]\w*)\s*(?=,|$)")))
    scripts = sources.filter(F.concat(F.lit("/"), "path").rlike(r"/resources/js/.*\.(tsx|jsx|ts|js|vue)$") & F.col("content").contains("route("))
    parts = F.split("content", r"\broute\s*\(\s*(?=['\"])")
    started = keys(F.array_join(_all("content", r"(?s)useForm\s*(?:<[^>]+>)?\s*\(\s*\{(.*?)\}\s*\)"), ","))
    each = scripts.select(F.col("path").alias("file"), started.alias("started"), parts.alias("parts"), F.posexplode(parts).alias("i", "after")).filter("i > 0")
    near = F.concat(F.expr("right(parts[i - 1], 600)"), F.lit("route("), F.substring("after", 1, 1000))
    bodies_ = F.filter(F.transform(_all(near, r"(?s)(?:router|form|Inertia)\s*\.\s*(?:post|put|patch|delete|submit)\s*\([^;]*?,\s*\{(.*?)\}\s*(?:,|\))"), keys), lambda k: F.size(k) > 0)
    sent = F.when(F.size(bodies_) > 0, bodies_).when(F.size("started") > 0, F.array("started"))
    return each.select("file", F.regexp_extract("after", r"^['\"]([^'\"]+)['\"]", 1).alias("route_name"), F.explode(sent).alias("sent")).distinct()


def form_findings(contracts: DataFrame, sources: DataFrame) -> DataFrame:
    """Forms that send less than a mutating route asks for, or what it doesn't let through (`missing` then has a plus before the name)."""
    c = contracts.filter(F.col("verb").isin(*MUTATING) & (F.size("required") > 0)).join(form_payloads(sources), "route_name")
    less, more = F.array_except("required", "sent"), F.when(F.size("accepted") > 0, F.array_except("sent", "accepted")).otherwise(F.expr("cast(array() AS array<string>)"))
    c = c.withColumn("less", less).withColumn("missing", F.array_sort(F.concat(less, F.transform(more, lambda x: F.concat(F.lit("+"), x))))).filter("size(missing) > 0")
    return _found(c, "frontend_form_payload", "file", "1", F.when(F.size("less") > 0, "high").otherwise("medium"), 0.76, "route_name")


def contract_findings(routes: DataFrame, classes: DataFrame, methods: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, file, line, severity, confidence, route, subject, missing) of all contracts; the rule of a finding is `runtime-` and its kind."""
    c = route_contracts(routes, classes, methods)
    out = target_findings(routes, classes, methods)
    for more in (request_findings(c), binding_findings(c), data_findings(c, classes, methods), page_findings(c, sources), form_findings(c, sources)):
        out = out.unionByName(more)
    return out
