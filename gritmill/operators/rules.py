"""Rule engine over source trees: declarative rules compiled into one pass over the files (TXT-11).

A file is one row: its text, its lines, and its lines without comments (computed once). Every rule is an expression that
gives an array of hits; all rules of a file kind are concatenated and exploded, so a tree is scanned once however many
rules there are. A rule's trigger is tried on the whole text first, so files without it cost one search.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritmill.functions import text as T

HIT = "array<struct<rule:string, cases:array<string>, severity:string, confidence:string, category:string, cwe:array<string>, language:string, title:string, line:int, snippet:string>>"


def _strings(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def hit(rule, line: Column, snippet: Column, *, severity: Column | None = None, confidence: Column | None = None, cases: Column | None = None, cwe: Column | None = None) -> Column:
    """One hit of `rule`; any field may be given as an expression."""
    return F.struct(
        F.lit(rule.id).alias("rule"), (cases if cases is not None else _strings(rule.cases)).alias("cases"), (severity if severity is not None else F.lit(rule.severity)).alias("severity"),
        (confidence if confidence is not None else F.lit(rule.confidence)).alias("confidence"), F.lit(rule.category).alias("category"), (cwe if cwe is not None else _strings(f"CWE-{c}" for c in rule.cwe)).alias("cwe"),
        F.lit(rule.language).alias("language"), F.lit(rule.title).alias("title"), line.cast("int").alias("line"), snippet.alias("snippet"),
    )


@dataclass(frozen=True)
class LineRule:
    """A line that matches `trigger`, if the window around it matches all of `all_of` and none of `none_of`.

    `window` is (lines before, lines after); None means that side is absent. `on` is ``code`` (without comments) or ``raw``;
    `least` and `below` bound the number that group 1 of `number` finds in the window; `cap` keeps the first hits of a file.
    """

    id: str
    title: str
    cases: tuple[str, ...]
    severity: str
    confidence: str
    cwe: tuple[int, ...]
    trigger: str
    window: tuple[int | None, int | None] = (None, 0)
    all_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    line_none_of: tuple[str, ...] = ()
    shown: tuple[int, int] = (1, 1)
    on: str = "code"
    category: str = "security"
    language: str = "csharp"
    number: str = ""
    least: int | None = None
    below: int | None = None
    cap: int = 0
    paths: str = ""
    redact: tuple[str, str] | None = None
    commentless: bool = False

    def hits(self) -> Column:
        raw = F.col("lines")
        src = F.col("code") if self.on == "code" else raw

        def of(line: Column, i: Column) -> Column:
            n = i + 1
            ok = line.rlike(self.trigger)
            for p in self.line_none_of:
                ok = ok & ~line.rlike(p)
            if self.commentless:
                ok = ok & (F.trim(F.get(F.col("code"), i)) != "")
            before, after = self.window
            parts = ([T.window_before(src, n, before)] if before is not None else []) + ([T.window_after(src, n, after)] if after is not None else [])
            win = parts[0] if len(parts) == 1 else F.concat_ws(" ", *parts)
            for p in self.all_of:
                ok = ok & win.rlike(p)
            for p in self.none_of:
                ok = ok & ~win.rlike(p)
            if self.number:
                num = F.regexp_extract(win, self.number, 1).try_cast("bigint")
                ok = ok & F.coalesce(num >= self.least, F.lit(False)) if self.least is not None else ok
                ok = ok & F.coalesce(num < self.below, F.lit(False)) if self.below is not None else ok
            shown = T.snippet(raw, n, *self.shown)
            if self.redact:
                shown = F.regexp_replace(shown, *self.redact)
            return F.when(ok, hit(self, n, shown))

        found = F.filter(F.transform(src, of), lambda h: h.isNotNull())
        if self.cap:
            found = F.slice(found, 1, self.cap)
        gate = F.col("text").rlike("(?m)" + self.trigger)
        return F.when(gate & (F.col("path").rlike(self.paths) if self.paths else F.lit(True)), found)


@dataclass(frozen=True)
class FileRule:
    """A rule over a whole file; `make` gives an array of hits from the file's columns."""

    id: str
    title: str
    cases: tuple[str, ...]
    severity: str
    confidence: str
    cwe: tuple[int, ...]
    make: object = field(repr=False)
    category: str = "security"
    language: str = "xml"

    def hits(self) -> Column:
        return self.make(self)


def first_match(pattern: str, where: Column | None = None, whole_line: bool = True, redact: bool = False):
    """Hits of a rule that reports its first match alone."""

    def make(rule) -> Column:
        line = T.first_line(F.col("text"), pattern)
        shown = F.get(F.col("lines"), line - 1) if whole_line else F.regexp_extract("text", pattern, 0)
        return F.when(line.isNotNull() & (where if where is not None else F.lit(True)), F.array(hit(rule, line, redacted(shown) if redact else shown)))

    return make


def every_match(pattern: str, where=None, show=None):
    """Hits of a rule that reports all matches; `where` and `show` take the matched text."""

    def make(rule) -> Column:
        found = T.all_matches(F.col("text"), pattern)
        if where is not None:
            found = F.filter(found, lambda m: where(m["hit"]))
        return F.when(F.col("text").rlike(pattern), F.transform(found, lambda m: hit(rule, m["line"], show(m["hit"]) if show else m["hit"])))

    return make


def redacted(c: Column) -> Column:
    """TXT-08: values of credential attributes replaced."""
    c = F.regexp_replace(c, r"""(?i)(password|pwd|secret|key|credential|token)(\s*=\s*)("[^"]*"|'[^']*'|[^\s;]+)""", "$1$2***REDACTED***")
    return F.regexp_replace(c, r'(?i)(password|pwd)=[^;"]+', "$1=***REDACTED***")


def scan(files: DataFrame, rules: list, kind: str) -> DataFrame:
    """``(project, path, no, hit)`` of `rules` over files ``(project, path, text, lines, code, plain, ...)``; a hit array that fails gives none."""
    arrays = [F.coalesce(r.hits(), F.array().cast(HIT)).cast(HIT) for r in rules]
    every = reduce(lambda a, b: F.concat(a, b), arrays)
    return files.select("project", "path", F.posexplode(every).alias("no", "hit")).withColumn("kind", F.lit(kind))
