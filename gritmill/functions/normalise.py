"""Scalar normalisation of severities, scores, paths, snippets and versions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What tools call a severity.
SEVERITY_NAMES = {
    "CRITICAL": ("CRITICAL", "BLOCKER"),
    "HIGH": ("HIGH", "ERROR"),
    "MEDIUM": ("MEDIUM", "MODERATE", "WARNING", "MINOR", "MAJOR"),
    "LOW": ("LOW", "NOTE", "INFO", "INFORMATIONAL"),
    "INFO": ("NONE", "UNKNOWN"),
}


def severity_name(c: Column, fallback: str = "MEDIUM") -> Column:
    """NORM-10: a tool's severity in our terms; null, empty and unknown give `fallback`."""
    up, out = F.upper(c), F
    for name, spellings in SEVERITY_NAMES.items():
        out = out.when(up.isin(*spellings), name)
    return out.otherwise(fallback)


def severity_of_score(score: Column) -> Column:
    """NORM-11: CVSS bands; null, NaN and scores up to 0 are INFO."""
    ok = score.isNotNull() & ~F.isnan(score) & (score > 0)
    return F.when(~F.coalesce(ok, F.lit(False)), "INFO").when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")


def one_decimal(score: Column) -> Column:
    """Half up on the binary value."""
    return F.floor(score * 10 + 0.5) / 10


def path_key(c: Column) -> Column:
    """NORM-12: forward slashes, one leading ``./`` off, lower case; null as the empty path."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\\", "/"), r"^\./", ""))


def snippet_key(c: Column) -> Column:
    """NORM-13: lines with blanks collapsed, empty lines dropped."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def fingerprint() -> Column:
    """COR-13: sha-256 over rule, path and snippet of a finding."""
    rule = F.coalesce(non_empty(F.col("subcategory")), non_empty(F.get(F.col("detection.rules"), F.lit(0))["ruleId"]), F.col("title"), F.lit("undefined"))
    zero = F.lit("\x00")
    return F.sha2(F.concat(rule, zero, path_key(F.col("location.file")), zero, snippet_key(F.col("evidence.snippet"))), 256)


def uri_path(c: Column) -> Column:
    """A file URI as a path: percent signs decoded if well formed, the scheme off, forward slashes."""
    raw = F.coalesce(c, F.lit(""))
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    return F.translate(F.regexp_replace(decoded, r"^file:///?", ""), "\\", "/")


def relative_to(path: Column, root: str) -> Column:
    """NORM-14: `path` below `root`, compared without case; other paths stay."""
    p = F.translate(F.coalesce(path, F.lit("")), "\\", "/")
    if not root:
        return p
    r = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.lower(F.left(p, F.lit(len(r)))) == r.lower(), F.substring(p, len(r) + 1, 1 << 20)).otherwise(p)


def cwe_ids(texts: Column) -> Column:
    """NORM-04: CWE ids in an array of texts, in order, each once."""
    all_ = F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.regexp_extract_all(t, F.lit(r"(?i)CWE[-_ ]?(\d+)"), F.lit(1))))
    return F.array_distinct(F.transform(all_, lambda d: F.concat(F.lit("CWE-"), d)))


def advisory_ids(texts: Column) -> Column:
    """NORM-05: CVE and GHSA ids in an array of texts, upper case, in order, each once."""
    pat = r"(?i)(CVE-\d{4}-\d{4,7}|GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4})"
    all_ = F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.regexp_extract_all(t, F.lit(pat), F.lit(1))))
    return F.array_distinct(F.transform(all_, lambda d: F.upper(d)))


def version_key(c: Column) -> Column:
    """NORM-16: up to four numeric parts, padded with 0; null where any part is no number. Arrays compare part by part."""
    v = F.trim(F.coalesce(c, F.lit("")))
    parts = F.transform(F.split(v, r"\."), lambda p: p.try_cast("int"))
    return F.when(v.rlike(r"^\d{1,9}(\.\d{1,9}){0,3}\z"), F.slice(F.concat(parts, F.array(*[F.lit(0)] * 3)), 1, 4))


def first_sentence(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)^.*?[.!?](?=\s|\z)|^.*\z", 0)
