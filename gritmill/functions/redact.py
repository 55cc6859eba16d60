"""Scrubbing and masking of credentials in text, as column expressions (TXT-08 to TXT-10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "***REDACTED***"
#: Shapes that are replaced as a whole, and shapes whose label stays (groups 1 and 2), in this order.
SHAPES = (
    r"sk-ant-[A-Za-z0-9_-]{8,}",
    r"sk-[A-Za-z0-9_-]{12,}",
    r"\b[0-9a-f]{32}\.[A-Za-z0-9]{16,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\b(?:ghp|gho|ghu|ghs)_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
)
LABELLED = (
    (r"(?i)(Bearer\s+)[A-Za-z0-9._-]{16,}", f"$1{MASK}"),
    (r'(?i)("(?:api[_-]?key|apikey|authorization|x-api-key|access[_-]?token|secret|token)"?\s*[:=]\s*")[^"]{8,}(")', f"$1{MASK}$2"),
    (r"(?i)((?:api[_-]?key|apikey|access[_-]?token|secret)\s*[=:]\s*)[A-Za-z0-9._-]{16,}", f"$1{MASK}"),
)
#: Fixed value: what stands for a credential.
PLACEHOLDER = r"(?i)^\s*(?:<[^>]*>|\$\{[^}]*\}|\.{3}|x+|REDACTED(?:\s*\*.*)?|YOUR[_A-Z-]*|CHANGE[_A-Z-]*|EXAMPLE[_A-Z-]*|set-[A-Za-z0-9_-]+)\s*\z"


def scrub(c: Column) -> Column:
    """Text without what is shaped like a credential; null stays null. A shape without a label that says REDACTED itself stays."""
    for p in SHAPES:
        c = F.regexp_replace(c, r"(?![\w.\-]*(?i:REDACTED))" + p, MASK)
    for p, to in LABELLED:
        c = F.regexp_replace(c, p, to)
    return c


def masked(c: Column) -> Column:
    """A known secret for display: a fixed mask and the last four characters."""
    return F.when(c.isNull() | (c == ""), "(not set)").when(c.rlike(PLACEHOLDER), "(placeholder)").otherwise(F.concat(F.lit("****"), F.right(c, F.lit(4))))


def without_passwords(c: Column) -> Column:
    """Connection strings and attributes with their passwords masked."""
    c = F.regexp_replace(c, r"(?i)\b(password|pwd|passphrase|secret)(\s*=\s*)(['\"]?)[^;'\"<>\s]+", r"$1$2$3****")
    return F.regexp_replace(c, r"(://[^/\s:@]+:)[^@\s/]+@", "$1****@")
