"""Column helpers: paths, globs, identities, ranks and rounding."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
CLASSIFICATION_RANK = {"defect": 3, "risk": 2, "advisory": 1}


def lookup(values: dict, key: Column | str, default=None) -> Column:
    """The literal map's value of `key`, or `default`."""
    found = F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items()))), F.col(key) if isinstance(key, str) else key)
    return found if default is None else F.coalesce(found, F.lit(default))


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over as many tasks as a shuffle has. A small table may lie in one file and so be one task, however much
    is made of each of its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def normal_path(path: Column) -> Column:
    """Forward slashes, none doubled, no leading './'."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/"), r"^(\./)+", "")


def worked_out(path: Column) -> Column:
    """`.` and `..` worked out, however many there are; `..` stays where nothing is left to leave, and goes at an absolute root."""

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        return (
            F.when(part == ".", done)
            .when((part == "..") & (last == "") & (F.size(done) == 1), done)
            .when((part == "..") & F.coalesce(last != "..", F.lit(False)), F.slice(done, 1, F.size(done) - 1))
            .otherwise(F.array_append(done, part))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower case with its dot; '.blade.php' is one extension. Empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.blade\.php|\.[^.]+)$", 1))


def like_glob(pattern: str) -> str:
    """Regex of a shell pattern in which * also crosses slashes; for any case."""
    out = []
    for part in re.findall(r"\[[^\]]+\]|.", pattern, re.S):
        if part == "*":
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif len(part) > 1:
            out.append("[" + ("^" + part[2:-1] if part[1] == "!" else part[1:-1]).replace("\\", "\\\\") + "]")
        else:
            out.append(re.escape(part))
    return "(?is)^" + "".join(out) + "$"


def ignore_glob(pattern: str) -> str:
    """Regex of one line of an ignore file: * stays within a name, ** crosses, a slash inside anchors the pattern."""
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    out = []
    for part in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", body):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part))
    return ("^" if anchored else "(?:^|/)") + "".join(out) + ("/" if pattern.endswith("/") else "(?:/|$)")


def line_of(text: Column, position: Column) -> Column:
    """Line number, from 1, of a position that counts from 0."""
    return F.regexp_count(F.substring(text, F.lit(1), position), F.lit("\n")) + 1


def fingerprint(rule: Column, file: Column, context: Column, title: Column) -> Column:
    """A finding's identity; it holds no line number, so moving code keeps it."""
    what = F.when(F.coalesce(context, F.lit("")) == "", title).otherwise(context)
    return F.substring(F.sha1(F.concat_ws(":", rule, file, what)), 1, 12)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"))


def table_name(model: Column) -> Column:
    """The table that a model class names by convention."""
    s = snake_case(model)
    return (
        F.when(s.rlike("[^aeiou]y$"), F.regexp_replace(s, "y$", "ies"))
        .when(s.rlike("(s|x|z|ch|sh)$"), F.concat(s, F.lit("es")))
        .otherwise(F.concat(s, F.lit("s")))
    )


def entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - F.size(F.filter(chars, lambda x: x == c)) / n * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def is_test_path(path: Column) -> Column:
    """Whether a path is that of a test: by folder or by name; the settings of test tools are none."""
    name = F.lower(base_name(path))
    named = name.rlike(r"(test|tests|spec)\.php$|\.(test|spec)\.[jt]sx?$") | F.lower(path).rlike(r"(^|/)(tests?|__tests__|spec)/")
    return named & ~name.rlike(r"^(phpunit(\.\w+)*\.xml.*|pest\.php|jest\.config\.\w+|vitest\.config\.\w+)$")
