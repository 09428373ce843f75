"""Complexity of PHP functions: paths, and how hard they are to follow, where what is nested deeper weighs more."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.operators.bodies import _pairs
from lintlake.operators.php import each_file, line_starts, quieted

MEASURES = "path string, class string, name string, first_line int, last_line int, cyclomatic int, cognitive int, nesting int"

_CLASS = re.compile(r"(?<!::)\b(?:class|trait|enum|interface)\s+([A-Za-z_]\w*)")
_FUNCTION = re.compile(r"\bfunction\s+&?([A-Za-z_]\w*)\s*\(")
_TOKEN = re.compile(
    r"(?<![$>:\w])(if|elseif|else\s+if|else|foreach|for|while|do|switch|case|catch|match)\b(?!\s*(?:=>|::))|(?<![(,:|]\s)(?<![(,:|])(?<!\b(?:public|static)\s)(?<!\b(?:private)\s)(?<!\bprotected\s)(?<!\?)\?(?!\??->|\?)|(\{)"
)
_BOOLEAN = re.compile(r"&&|\|\||(?<![$>:\w])(?:and|or|xor)\b", re.I)
_NESTED = re.compile(r"(?<!::)\b(?:class|trait|interface|enum)\s+[A-Za-z_]\w*[^{;]*\{|\bfunction\s+&?[A-Za-z_]\w*\s*\([^{;]*\{")


class _Walk:
    """One function's statements. A branch or a loop adds one and how deep it lies; an `else` and what it holds too; each boolean
    sign of a condition adds one."""

    def __init__(self, quiet: str, pairs: dict[int, int]):
        self.quiet, self.pairs = quiet, pairs
        self.cyclomatic, self.cognitive, self.nesting = 1, 0, 0

    def add(self, nesting: int, path: bool = True) -> None:
        self.cyclomatic += path
        self.cognitive += 1 + nesting
        self.nesting = max(self.nesting, nesting + 1)

    def booleans(self, a: int, b: int) -> None:
        n = len(_BOOLEAN.findall(self.quiet, a, b))
        self.cyclomatic += n
        self.cognitive += n

    def brackets(self, at: int) -> tuple[int, int]:
        """What stands in the round brackets that follow, and where they end; nothing if there are none."""
        m = re.compile(r"\s*\(").match(self.quiet, at)
        return (m.end(), self.pairs.get(m.end() - 1, len(self.quiet))) if m else (at, at - 1)

    def body(self, at: int, word: str) -> tuple[int, int, int]:
        """(begin, end, after) of the statement from `at` on: a block, one up to `endif` and the like, or a single one."""
        m = re.compile(r"\s*([{:]?)").match(self.quiet, at)
        if m[1] == "{":
            end = self.pairs.get(m.end() - 1, len(self.quiet))
            return m.end(), end, end + 1
        if m[1] == ":":
            stops = "elseif|else|endif" if word in ("if", "elseif", "else") else "end" + word
            depth, at = 0, m.end()
            own = "if" if word in ("if", "elseif", "else") else word
            for t in re.compile(rf"\b(?:{own}\b(?=\s*\([^{{;]*\)\s*:)|{stops})\b").finditer(self.quiet, at):
                if t[0] == own:
                    depth += 1
                elif depth == 0:
                    return at, t.start(), t.start() if own == "if" else t.end()
                elif t[0].startswith("end"):
                    depth -= 1
            return at, len(self.quiet), len(self.quiet)
        end = self.statement_end(m.end())
        return m.end(), end, end

    def statement_end(self, at: int) -> int:
        """Where one statement ends, with the blocks that are its own and any `else` that follows."""
        m = re.compile(r"\s*(if|foreach|for|while|switch)\b").match(self.quiet, at)
        if m:
            _, closed = self.brackets(m.end())
            _, _, after = self.body(closed + 1, m[1])
            while e := re.compile(r"\s*(elseif|else\s+if|else)\b").match(self.quiet, after) if m[1] == "if" else None:
                closed = self.brackets(e.end())[1] if e[1] != "else" else e.end() - 1
                _, _, after = self.body(closed + 1, "else")
            return after
        sign = re.compile(r"[;({\[}]")
        while s := sign.search(self.quiet, at):
            if s[0] in ";}":
                return s.end() if s[0] == ";" else s.start()
            at = self.pairs.get(s.start(), len(self.quiet)) + 1
        return len(self.quiet)

    def walk(self, a: int, b: int, nesting: int) -> None:
        at = a
        while at < b and (m := _TOKEN.search(self.quiet, at, b)):
            word = re.sub(r"\s+", " ", m[1] or "")
            inner = _NESTED.match(self.quiet, self._line_of(m.start())) if m[2] else None
            if m[2]:  # a block: one of a named function or class is not this function's
                named = inner and inner.end() - 1 == m.start()
                at = self.pairs.get(m.start(), b) + 1 if named else m.end()
            elif not word:  # a choice by `? :`
                self.add(nesting)
                begin = max(self.quiet.rfind(c, a, m.start()) for c in ";{}=,(") + 1
                self.booleans(max(begin, a), m.start())
                at = m.end()
            elif word in ("case", "catch"):
                self.add(nesting)
                at = m.end()
            elif word in ("switch", "match"):
                opened, closed = self.brackets(m.end())
                if closed < opened:  # a name
                    at = m.end()
                    continue
                self.add(nesting)
                at = closed + 1
            elif word == "else":
                self.add(nesting, path=False)
                begin, end, at = self.body(m.end(), word)
                self.walk(begin, end, nesting + 1)
            elif word == "else if":  # an `else` that holds an `if`
                self.add(nesting, path=False)
                begin = m.end() - 2
                end = self.statement_end(begin)
                self.walk(begin, end, nesting + 1)
                at = end
            elif word == "do":
                self.add(nesting)
                begin, end, after = self.body(m.end(), word)
                self.walk(begin, end, nesting + 1)
                w = re.compile(r"\s*while\b").match(self.quiet, after)
                opened, closed = self.brackets(w.end()) if w else (after, after - 1)
                self.booleans(opened, closed)
                at = closed + 1
            else:
                opened, closed = self.brackets(m.end())
                self.add(nesting)
                self.booleans(opened, closed)
                begin, end, at = self.body(closed + 1, word)
                self.walk(begin, end, nesting + 1)
            at = max(at, m.end())

    def _line_of(self, at: int) -> int:
        """The start of the statement that a brace at `at` belongs to."""
        begin = max(self.quiet.rfind(c, 0, at) for c in ";{}") + 1
        return re.compile(r"\s*(?:(?:public|private|protected|static|final|abstract|readonly)\s+)*").match(self.quiet, begin).end()


def _measured(path: str, text: str) -> Iterator[tuple]:
    quiet = quieted(text)
    pairs, starts = _pairs(quiet), line_starts(text)
    classes = [(m.start(), m[1]) for m in _CLASS.finditer(quiet)]
    for m in _FUNCTION.finditer(quiet):
        opened = re.compile("[{;]").search(quiet, pairs.get(m.end() - 1, len(quiet)))
        if not opened or opened[0] == ";":
            continue
        end = pairs[opened.start()]
        w = _Walk(quiet, pairs)
        w.walk(opened.end(), end, 0)
        owner = next((n for at, n in reversed(classes) if at < m.start() and pairs.get(quiet.find("{", at), -1) > m.start()), None)
        yield path, owner, m[1], bisect_right(starts, m.start()), bisect_right(starts, end), w.cyclomatic, max(1, w.cognitive), w.nesting


def measures(sources: DataFrame) -> DataFrame:
    """(path, class, name, first_line, last_line, cyclomatic, cognitive, nesting) of each function with a body. Closures count as part of
    the function around them; functions and classes within a function don't. A null content has none."""
    return each_file(sources, _measured, MEASURES)


def hotspots(measures_: DataFrame, most: int = 10) -> DataFrame:
    """The hardest functions to follow, then those with most paths, then by name: a report of `most` rows."""
    full = F.concat_ws("::", "class", "name")
    return measures_.withColumn("method", full).orderBy(F.desc("cognitive"), F.desc("cyclomatic"), "method", "path").limit(most)
