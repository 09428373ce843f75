"""Duplicated blocks of methods by what their tokens are, not how they are named: names, strings and numbers count as ID, STR and NUM.

Windows of tokens are hashed, and two windows that follow each other belong to a class with all methods that have the same two.
Where neighbouring places of a method belong to classes of the same methods they are one segment; a segment's hash tells the block. There
is no limit on how many methods share a block, since pairs of methods are never formed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.graphs import cut, shared
from lintlake.operators.php import _QUIET, _declared, blank, each_file

WINDOW, STEP = 50, 25
#: Blocks of a report.
MOST = 200

PLACES = "path string, method string, idx int, hash string, next string, first_line int, last_line int, tokens int"
_KIND = dict.fromkeys("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_", "ID") | dict.fromkeys("0123456789", "NUM")
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d+(?:\.\d+)?|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\n|[^\s]")


def tokens(code: str) -> list[tuple[str, int]]:
    """(token, line) of a piece of code without its comments; lines count from 0."""
    bare = _QUIET.sub(lambda m: m[0] if m[0][0] in "'\"" else "STR" if m[0].startswith("<<<") else blank(m[0]), code)
    out, line = [], 0
    for t in _TOKEN.findall(bare):
        if t == "\n":
            line += 1
        elif kind := _KIND.get(t[0]):
            out.append((kind, line))
        elif t[0] in "'\"" and len(t) > 1:
            out.append(("STR", line))
            line += t.count("\n")
        else:
            out.append((t if t[0] < "\x80" else "ID" if t[0].isalpha() else "NUM" if t[0].isdigit() else t, line))
    return out


def _windowed(path: str, text: str, window: int, step: int) -> Iterator[tuple]:
    for _, n, kind, name, owner, head, body, _, first, _ in _declared(path, text):
        if kind != "function":
            continue
        t, method = tokens(body), f"{owner or ''}::{name}#{n}"
        at, kinds = first + head.count("\n"), [x for x, _ in t]
        found = [(hashlib.blake2b("\x1f".join(kinds[i : i + window]).encode(), digest_size=8).hexdigest(), t[i][1], t[i + window - 1][1]) for i in range(0, len(t) - window + 1, step)]
        yield path, method, None, None, None, first, first, len(t)  # the method itself
        for i, (a, b) in enumerate(zip(found, found[1:], strict=False)):
            yield path, method, i, a[0], b[0], at + a[1], at + b[2], len(t)


def places(sources: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """(path, method, idx, hash, next, first_line, last_line, tokens): a row for each method, without idx, and one for each two windows of it that
    follow each other."""
    return each_file(sources, lambda path, text: _windowed(path, text, window, step), PLACES)


def _shared(found: DataFrame) -> DataFrame:
    """The places of two windows that another method has too, with `who`, which stands for the set of these methods."""
    two = found.filter("idx is not null")
    who = two.select("hash", "next", "path", "method").distinct().groupBy("hash", "next").agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "method").cast("decimal(38,0)")).alias("who"))
    return two.join(who.filter("n > 1").select("hash", "next", "who"), ["hash", "next"])


def block_places(found: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """(block, tokens, path, first_line, last_line): where each block stands, overlapping places in a file as one; every block stands in two places or
    more. `found` is what `places` gives."""
    shared(found)
    found = cut(found)  # files are parsed once
    order = Window.partitionBy("path", "method").orderBy("idx")
    follows = (F.col("idx") - F.lag("idx").over(order) == 1) & (F.col("who") == F.lag("who").over(order))
    runs = _shared(found).withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(order))
    each = F.struct("idx", "hash", "next", "first_line", "last_line")
    segments = runs.groupBy("path", "method", "run").agg(F.array_sort(F.collect_list(each)).alias("parts"))  # a method's own windows
    named = cut(segments.withColumn("block", _name("parts")))
    several = named.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1").select("block")
    whole = named.join(several, "block", "left_semi")
    # a segment that stands nowhere else as it is: its windows do, two by two
    pairs = named.join(several, "block", "left_anti").select("path", "method", "run", F.explode("parts").alias("p")).select("path", F.array("p").alias("parts"))
    both = whole.select("block", "path", "parts").unionByName(pairs.select(_name("parts").alias("block"), "path", "parts"))
    rows = both.select("block", (window + F.size("parts") * step).alias("tokens"), "path", F.col("parts")[0]["first_line"].alias("first_line"), F.element_at("parts", -1)["last_line"].alias("last_line"))
    before = Window.partitionBy("block", "path").orderBy("first_line", "last_line")
    apart = F.coalesce(F.col("first_line") > F.max("last_line").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = rows.withColumn("new", apart.cast("int")).withColumn("i", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = cut(islands.groupBy("block", "path", "i").agg(F.max("tokens").alias("tokens"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line")).drop("i"))
    again = merged.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1").select("block")
    return merged.join(again, "block", "left_semi").select("block", "tokens", "path", "first_line", "last_line")


def _name(parts: str):
    whole = F.concat_ws("|", F.transform(parts, lambda p: p["hash"]), F.element_at(F.col(parts), -1)["next"])
    return F.substring(F.sha2(whole, 256), 1, 16)


def largest(at: DataFrame, most: int = MOST) -> DataFrame:
    """(block, tokens, n_places, n_files, first_path): the longest blocks, then those in most places: a report of `most` rows."""
    g = at.groupBy("block").agg(F.max("tokens").alias("tokens"), F.count("*").alias("n_places"), F.countDistinct("path").alias("n_files"), F.min("path").alias("first_path"))
    return g.orderBy(F.desc("tokens"), F.desc("n_places"), "block").limit(most)


def duplication(found: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """(path, total, duplicated, pct): of each file the tokens of its methods, and those that lie in windows shared with another method."""
    shared(found)
    found = cut(found)  # files are parsed once
    first = F.col("idx") * step
    spans = _shared(found).select("path", "method", first.alias("a"), (first + step + window).alias("b"))
    order = Window.partitionBy("path", "method").orderBy("a")
    reached = F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    twice = spans.withColumn("own", F.greatest(F.lit(0), F.col("b") - F.greatest("a", reached))).groupBy("path").agg(F.sum("own").alias("duplicated"))
    total = found.filter("idx is null").groupBy("path").agg(F.sum("tokens").alias("total"))
    return total.join(twice, "path", "left").select("path", "total", F.coalesce("duplicated", F.lit(0)).alias("duplicated"), F.when(F.col("total") > 0, F.round(100 * F.coalesce("duplicated", F.lit(0)) / F.col("total"), 2)).otherwise(0.0).alias("pct"))
