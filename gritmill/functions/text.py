"""Lines, windows and comments of source text (TXT-01 to TXT-06)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STOP = re.compile(r"""["']|//|/\*""")
_REST = {q: re.compile(rf"(?:[^{q}\\]|\\.)*(?:{q}|\\?$)", re.S) for q in "\"'"}


def strip_comments(lines: list[str]) -> list[str]:
    """TXT-01: lines without comments; block comments run over lines, quoted text is kept to its end or the end of its line."""
    out, inside = [], False
    for raw in lines:
        kept, at = [], 0
        while at < len(raw):
            if inside:
                end = raw.find("*/", at)
                if end < 0:
                    break
                inside, at = False, end + 2
                continue
            m = _STOP.search(raw, at)
            if not m:
                kept.append(raw[at:])
                break
            kept.append(raw[at : m.start()])
            if m[0] == "//":
                break
            if m[0] == "/*":
                inside, at = True, m.end()
            else:
                end = _REST[m[0]].match(raw, m.end()).end()
                kept.append(raw[m.start() : end])
                at = end
        out.append("".join(kept))
    return out


def strip_comments_plain(lines: list[str]) -> list[str]:
    """TXT-02: the stripper of start-up files, which knows no quotes and drops all of a line from its last block comment on if ``//`` follows."""
    out, inside = [], False
    for raw in lines:
        kept, at = [], 0
        while at < len(raw):
            if inside:
                end = raw.find("*/", at)
                if end < 0:
                    break
                inside, at = False, end + 2
                continue
            block, line = raw.find("/*", at), raw.find("//", at)
            if line >= 0 and (block < 0 or line < block):
                break
            if block < 0:
                kept.append(raw[at:])
                break
            kept.append(raw[at:block])
            inside, at = True, block + 2
        out.append("".join(kept))
    return out


@F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("code", "plain")]))
def stripped(lines: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Both strippings of an array of lines; null gives empty arrays. State crosses lines, so a whole file is one value."""
    for s in lines:
        rows = [[] if x is None else [y or "" for y in x] for x in s]
        yield pd.DataFrame({"code": [strip_comments(r) for r in rows], "plain": [strip_comments_plain(r) for r in rows]})


def lines_of(text: Column) -> Column:
    """SCAN-10: lines, split at ``\\n`` with an optional ``\\r`` before it."""
    return F.split(text, "\r?\n")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def window_after(lines: Column, n: Column, r: int) -> Column:
    """TXT-03: lines n to n + r, from 1, joined and squeezed."""
    return squeezed(F.array_join(F.slice(lines, n, F.lit(r + 1)), " "))


def window_before(lines: Column, n: Column, r: int) -> Column:
    """TXT-04: lines max(1, n - r) to n + 1, joined and squeezed."""
    start = F.greatest(F.lit(1), n - r)
    return squeezed(F.array_join(F.slice(lines, start, n + 2 - start), " "))


def snippet(lines: Column, n: Column, before: int, after: int) -> Column:
    """TXT-05: lines around line n."""
    start = F.greatest(F.lit(1), n - before)
    return F.array_join(F.slice(lines, start, n + after + 1 - start), "\n")


def line_of(text: Column, pos: Column) -> Column:
    """TXT-06: the line, from 1, of a 1-based position."""
    return F.size(F.split(F.left(text, pos - 1), "\n"))


def first_line(text: Column, pattern: str) -> Column:
    """Line of the first match; null if there is none."""
    pos = F.regexp_instr(text, F.lit(pattern))
    return F.when(pos > 0, line_of(text, pos))


def attribute(tag: Column, name: str) -> Column:
    """TXT-07: an XML attribute's value; null if it is absent."""
    p = rf'(?i){name}\s*=\s*"([^"]*)"'
    return F.when(tag.rlike(p), F.regexp_extract(tag, p, 1))


def all_matches(text: Column, pattern: str) -> Column:
    """Every match as ``(hit, line)``."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    upto = lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i + 1), ""), F.array_join(F.slice(hits, F.lit(1), i), ""))
    return F.transform(hits, lambda h, i: F.struct(h.alias("hit"), F.size(F.split(upto(i), "\n")).alias("line")))
