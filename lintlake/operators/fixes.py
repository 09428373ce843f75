"""Rewrites of what findings point at, and unified diffs of the files that come out."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines around a change that a diff shows.
CONTEXT = 3


@dataclass(frozen=True)
class Rewrite:
    """`pattern` (Java) becomes `into`; only what is `safe` may be applied unseen."""

    rule_id: str
    pattern: str
    into: str
    note: str
    strategy: str = "risky"
    lower_group: bool = False


#: Which rules have a rewrite, and what comes out.
REWRITES = [
    Rewrite("env-outside-config", r"env\(['\"]([A-Z_]+)['\"]\)", "config('app.$1')", "Move env() to a config file and read that", lower_group=True),
    Rewrite("no-log-debug-in-app", r"Log::debug\(", "Log::info(", "Use Log::info() in production code", "safe"),
    Rewrite("react-no-array-index-key", r"key=\{\s*(index|i)\s*\}", "key={item.id || `item-\\${$1}`}", "Use a stable key of the data"),
    Rewrite("no-dangerously-set-inner-html", r"dangerouslySetInnerHTML=\{\{\s*__html:\s*([^}]+?)\s*\}\}", "dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize($1) }}", "Sanitize what is shown"),
    Rewrite("unsafe-unserialize", r"unserialize\(\s*([^,()]+)\s*\)", "unserialize($1, ['allowed_classes' => false])", "Allow no classes"),
    Rewrite("insecure-random-for-security", r"\b(mt_rand|rand)\(", "random_int(", "Use a secure generator"),
    Rewrite("missing-strict-types", r"^<\?php", "<?php\n\ndeclare(strict_types=1);", "Declare strict types"),
    Rewrite("timing-attack-token-comparison", r"(\$\w+)\s*={2,3}\s*(\$\w+)", "hash_equals($1, $2)", "Compare in constant time"),
]


def _rewritten(r: Rewrite, line: Column) -> Column:
    if not r.lower_group:
        return F.regexp_replace(line, r.pattern, r.into)
    key = F.lower(F.regexp_extract(line, r.pattern, 1))
    return F.regexp_replace(line, F.lit(r.pattern), F.replace(F.lit(r.into), F.lit("$1"), key))


def suggestions(findings: DataFrame, sources: DataFrame, rewrites: list[Rewrite] = REWRITES) -> DataFrame:
    """(file, line, rule_id, original, fixed, note, strategy, auto): a rewrite for each finding (file, line, rule_id) whose rule has one and whose
    line (of `sources`: path, content) it changes. Findings of one rule on one line are one; a line that isn't there has none."""
    named = findings.filter(F.col("rule_id").isin(*(r.rule_id for r in rewrites))).select("file", "line", "rule_id").distinct()
    text = named.join(sources.select(F.col("path").alias("file"), F.split("content", "\n").alias("lines")), "file").withColumn("original", F.get("lines", (F.col("line") - 1).cast("int"))).drop("lines")
    each = F.coalesce(*(F.when(F.col("rule_id") == r.rule_id, F.struct(_rewritten(r, F.col("original")).alias("fixed"), F.lit(r.note).alias("note"), F.lit(r.strategy).alias("strategy"))) for r in rewrites))
    return text.select("file", "line", "rule_id", "original", each.alias("x")).select("file", "line", "rule_id", "original", "x.*", (F.col("x.strategy") == "safe").alias("auto")).filter("fixed <> original")


def apply(sources: DataFrame, fixes: DataFrame, rewrites: list[Rewrite] = REWRITES) -> DataFrame:
    """(path, content, fixed): files with all of their `fixes`; on a line that several rules rewrite they act one after the other, in the order of `rewrites`."""
    by_line = fixes.select(F.col("file").alias("path"), "line", "rule_id").distinct().groupBy("path").agg(F.collect_set(F.struct("line", "rule_id")).alias("due"))

    def fixed(line: Column, i: Column) -> Column:
        out = line
        for r in rewrites:
            out = F.when(F.array_contains("due", F.struct((i + 1).cast("int").alias("line"), F.lit(r.rule_id).alias("rule_id"))), _rewritten(r, out)).otherwise(out)
        return out

    joined = sources.select("path", "content").join(by_line, "path")
    return joined.select("path", "content", F.array_join(F.transform(F.split("content", "\n"), fixed), "\n").alias("fixed"))


def diffs(changed: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(path, diff, added, removed) of files (path, content, fixed): the longest common lines stay, hunks show `context` lines around changes. Files that didn't
    change have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, old, new in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                lines = list(difflib.unified_diff((old or "").split("\n"), (new or "").split("\n"), f"a/{path}", f"b/{path}", lineterm="", n=context))
                if lines:
                    rows.append((path, "\n".join(lines), sum(x.startswith("+") for x in lines[2:]), sum(x.startswith("-") for x in lines[2:])))
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))], ["path", "diff", "added", "removed"])

    return changed.select("path", "content", "fixed").mapInArrow(run, "path string, diff string, added int, removed int")
