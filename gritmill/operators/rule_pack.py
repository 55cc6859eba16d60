"""A pack of credential rules for .NET files (UDX-04), whose patterns both Spark and RE2 understand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule, pattern, group that holds the value, patterns of matches that are let pass.
RULES = (
    ("dotnet-connectionstring-password", r"""(?i)(?:password|pwd)\s*=\s*([^;"'<>\s][^;"'<>]{2,})""", 1, (r"(?i)password\s*=\s*(\{[^}]*\}|\$\([^)]*\)|%[A-Za-z_]+%|<[^>]*>)", r"(?i)password\s*=\s*(changeme|placeholder|yourpassword|xxx+|\*+|todo)")),
    ("dotnet-appsetting-secret", r'(?i)<add\s+key\s*=\s*"[^"]*(password|pwd|secret|apikey|api[-_]?key|encryptionkey|privatekey|accesstoken|clientsecret|credential)[^"]*"\s+value\s*=\s*"([^"]{3,})"', 2, (r'(?i)value\s*=\s*""', r'(?i)value\s*=\s*"(\{[^}]*\}|\$\([^)]*\)|%[A-Za-z_]+%)"', r'(?i)value\s*=\s*"(false|true|changeme|placeholder|todo|n/a)"')),
    ("dotnet-commented-credential", r'(?is)<!--\s*(?:<add\s+key\s*=\s*"[^"]*"\s+value\s*=\s*"[^"]*"\s*/?>\s*){0,6}<add\s+key\s*=\s*"[^"]*(?:password|pwd|secret|apikey|encryptionkey)[^"]*"\s+value\s*=\s*"([^"]{3,})"', 1, ()),
    ("dotnet-inline-credential-assignment", r'(?i)\.\s*(Password|ClientSecret|ApiKey|SecretKey|AccessKey)\s*=\s*"([^"]{4,})"', 2, (r'(?i)=\s*"(\{[^}]*\}|changeme|placeholder|todo|)"',)),
    ("dotnet-weak-static-key", r'(?i)(?:encryptionkey|aeskey|cryptokey|machinekey|validationkey|decryptionkey)\s*"?\s*(?:=|value\s*=\s*)"?\s*([A-Za-z0-9+/=]{8,64})', 1, ()),
)
#: Paths that the pack lets pass.
LET_PASS_PATHS = (r"(^|/)packages/", r"(^|/)(bin|obj)/", r"(^|/)node_modules/", r"(^|/)\.sonarqube/", r"(^|/)\.vs/", r"\.(dll|pdb|exe|nupkg|xml\.bak)$", r"(^|/)[^/]*\.xml$")


def hits(text: Column) -> Column:
    """``array<struct<rule, shown>>``: matches of all rules in a text, the value masked."""

    def of(rule: str, pattern: str, group: int, passes: tuple[str, ...]) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        for p in passes:
            found = F.filter(found, lambda m: ~m.rlike(p))
        masked = lambda m: F.replace(m, F.regexp_extract(m, pattern, group), F.lit("****"))
        return F.transform(found, lambda m: F.struct(F.lit(rule).alias("rule"), masked(m).alias("shown")))

    return F.flatten(F.array(*[of(*r) for r in RULES]))


def scan_pack(files: DataFrame) -> DataFrame:
    """``(project, path, rule, shown)`` over files ``(project, path, text)``; build output, vendored files and XML documents are let pass."""
    path = F.translate("path", "\\", "/")
    keep = files.where("text IS NOT NULL AND path IS NOT NULL")
    for p in LET_PASS_PATHS:
        keep = keep.where(~path.rlike(p))
    return keep.select("project", path.alias("path"), F.explode(hits(F.col("text"))).alias("h")).select("project", "path", "h.rule", "h.shown")
