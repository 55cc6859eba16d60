"""Findings over deployed assemblies (BIN-01 to BIN-10, COR-20 to COR-22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritmill.functions.normalise import version_key
from gritmill.operators.baseline import first_by_key
from gritmill.operators.supplychain import version_conflicts

FOUND = ["project", "rule", "severity", "path", "detail"]
#: References below these versions are known to be defective; frameworks out of support.
FIXED_IN = {"newtonsoft.json": "13.0.0.1", "log4net": "2.0.10", "icsharpcode.sharpziplib": "1.0.0"}
OLD_FRAMEWORKS = ("v2.0", "v3.0", "v3.5", "v4.0", "v4.5", "v4.5.1", "v4.5.2", "v4.6", "v4.6.1")
PDB_MOST, MISSING_MOST = 3, 20


def known_vulnerable(name: Column, version: Column) -> Column:
    """COR-20: whether a reference is below its fixed version; unreadable versions are not."""
    out = F.lit(False)
    for k, v in FIXED_IN.items():
        out = F.when(F.lower(name) == k, F.coalesce(version_key(version) < version_key(F.lit(v)), F.lit(False))).otherwise(out)
    return out


def _row(df: DataFrame, rule: str, severity: Column | str, detail: Column, path: str = "path") -> DataFrame:
    return df.select("project", F.lit(rule).alias("rule"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.col(path).alias("path"), detail.cast("string").alias("detail"))


def old_framework(target: Column, strict: bool) -> Column:
    """BIN-02. `strict` compares without the ``v`` that the list has, as the original does, so it never fires; else it compares with it."""
    m = F.lower(F.regexp_extract(target, r"(?i)version=(v[0-9.]+)", 1))
    return (F.regexp_replace(m, "^v", "") if strict else m).isin(*OLD_FRAMEWORKS)


def missing_dependencies(assemblies: DataFrame) -> DataFrame:
    """COR-21: references whose assembly is not in the tree, each name once, with the first file that needs it."""
    have = assemblies.select("project", F.lower(F.coalesce("name", F.regexp_extract("path", r"([^/\\]*)\.[^.]*\z", 1))).alias("n")).unionByName(assemblies.select("project", F.lower(F.regexp_extract("path", r"([^/\\]*)\.[^.]*\z", 1)).alias("n"))).distinct()
    refs = assemblies.where("managed").select("project", "path", F.explode("references").alias("r")).select("project", "path", F.col("r.name").alias("name"), F.col("r.version").alias("version"), F.lower("r.name").alias("n"))
    gone = refs.where("n <> ''").join(have, ["project", "n"], "left_anti").where(~F.col("n").rlike(r"^(system|microsoft\.(win32|csharp|visualbasic)|mscorlib|netstandard|windowsbase|presentation)"))
    return first_by_key(gone, [F.col("project"), F.col("n")], [F.col("path"), F.col("name"), F.col("version")])


def binary_findings(assemblies: DataFrame, redirects: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """FOUND rows of an inventory of assemblies and binding redirects."""
    a = assemblies.where("managed")
    refs = a.select("project", "path", F.explode("references").alias("r"))
    parts = [
        _row(a.where("debug"), "binary-debug-build", "HIGH", F.col("name")),
        _row(a.where(old_framework(F.col("target_framework"), strict)), "binary-eol-runtime", "MEDIUM", F.col("target_framework")),
        _row(a.where("signed = false"), "binary-not-strong-named", "LOW", F.col("name")),
        _row(a.select("project", "path", F.explode(F.slice("pdb_paths", 1, PDB_MOST)).alias("p")), "binary-pdb-path", "LOW", F.col("p")),
        _row(refs.where(known_vulnerable(F.col("r.name"), F.col("r.version"))), "binary-known-vulnerable-reference", "HIGH", F.concat_ws(" ", "r.name", "r.version")),
        _row(assemblies.select("project", "path", F.explode("strings").alias("s")), "binary-string", F.when(F.col("s.rule") == "binary-internal-endpoint", "MEDIUM").otherwise("HIGH"), F.concat_ws(": ", "s.rule", "s.shown")),
    ]
    conflicts = version_conflicts(a.where(~F.col("path").rlike(r"(?i)(^|[/\\])packages[/\\]")).select("project", "name", "version"))
    where = a.groupBy("project", F.lower("name").alias("name")).agg(F.min("path").alias("path"))
    parts.append(_row(conflicts.join(where, ["project", "name"]), "binary-version-conflict", "MEDIUM", F.concat_ws(" ", "name", F.array_join("versions", ", "))))
    from pyspark.sql import Window

    gone = missing_dependencies(assemblies).withColumn("rn", F.row_number().over(Window.partitionBy("project").orderBy("path", "name", "version"))).where(F.col("rn") <= MISSING_MOST)
    parts.append(_row(gone, "binary-missing-dependency", "LOW", F.concat_ws(" ", "name", "version")))
    if redirects is not None:
        major = lambda c: F.get(version_key(F.col(c)), F.lit(0))
        sev = F.when(known_vulnerable(F.col("name"), F.col("new_version")), "HIGH").when(F.coalesce(major("old_min") != major("new_version"), F.lit(False)), "MEDIUM").otherwise("LOW")
        parts.append(_row(redirects, "binary-binding-redirect", sev, F.concat_ws(" ", "name", "old_version", F.lit("->"), "new_version")))
    # nothing is decompiled here, which is told once a tree that holds managed code
    parts.append(_row(a.groupBy("project").agg(F.min("path").alias("path")), "binary-no-decompiler", "INFO", F.lit("managed code was not decompiled")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
