"""Catalogs of cases: what is wrong with them, cases left to people, and checks of run results and sources (NORM-15, COR-18)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritmill.schema import KINDS, RUN_STATUSES

#: What a case may say, and the category of a case's letter.
STACKS = ("framework", "core", "both")
WAYS = ("DETERMINISTIC", "AI_ASSISTED", "DYNAMIC", "MANUAL")
REQUIRED = ("title", "lookFor", "expected", "stack", "type", "priority", "automatable")
OTHER_LETTERS = {"G": "observability", "H": "configuration", "N": "configuration", "O": "dependency", "P": "performance", "R": "code-quality"}
SECURITY_LETTERS = tuple("ABCDEFGHIJKMNQ")


def _listed(*problems: Column) -> Column:
    return F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull()))


def case_problems(catalog: DataFrame, categories: list[str]) -> DataFrame:
    """``(id, problem)``: repeated ids, unknown categories, missing fields, values out of range."""
    many = catalog.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    bad = [F.when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "unknown category"), *[F.when(F.coalesce(F.col(c), F.lit("")) == "", f"no {c}") for c in REQUIRED]]
    bad += [F.when((F.col("stack") != "") & ~F.col("stack").isin(*STACKS), "unknown stack"), F.when((F.col("automatable") != "") & ~F.col("automatable").isin(*WAYS), "unknown automatable")]
    return catalog.select("id", _listed(*bad).alias("problem")).unionByName(many)


def reference_warnings(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(findingId, problem)``: findings without a case, and security findings none of whose cases is about security."""
    none = findings.where(F.size(F.coalesce("tests", F.array().cast("array<string>"))) == 0).select("findingId", F.lit("no case").alias("problem"))
    named = findings.where("category = 'security'").select("seq", "findingId", F.explode("tests").alias("id"))
    c = catalog.select("id", F.col("category").isin(*SECURITY_LETTERS).alias("sec")).groupBy("id").agg(F.bool_or("sec").alias("sec"))
    off = named.join(c, "id", "left").groupBy("seq", "findingId").agg(F.bool_or(F.coalesce("sec", F.lit(False))).alias("ok")).where("NOT ok").select("findingId", F.lit("no security case").alias("problem"))
    return none.unionByName(off)


def manual_reviews(coverage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Findings for the cases that no check decided: INFO, UNVERIFIED, in ``(project)``."""
    c = coverage.where("outcome = 'manual-review'").select(F.col("caseId").alias("id")).distinct().join(catalog, "id")
    category = F
    for letter, name in OTHER_LETTERS.items():
        category = category.when(F.col("category") == letter, name)
    none = F.lit(None).cast("string")
    return c.select(
        F.concat(F.lit("Manual review: "), F.coalesce("title", F.lit("")), F.lit(" ("), "id", F.lit(")")).alias("title"), category.otherwise("security").alias("category"), F.col("id").alias("subcategory"), F.lit("INFO").alias("severity"), F.lit("UNVERIFIED").alias("confidence"), F.lit("OPEN").alias("status"),
        F.when((F.col("cwe") != "") & (F.col("cwe") != "N/A"), F.array("cwe")).alias("cwe"), F.array("id").alias("tests"), F.struct(F.lit("(project)").alias("file")).alias("location"), F.struct(F.lit("").alias("snippet"), F.lit("markdown").alias("language")).alias("evidence"),
        F.col("lookFor").alias("problem"), F.col("expected").alias("impact"), F.concat_ws(" ", F.lit("Review by hand."), "lookFor").alias("recommendation"),
        F.struct(F.lit("MANUAL_REVIEW").alias("class"), F.array(F.struct(F.lit("native").alias("engine"), F.col("id").alias("ruleId"), F.lit("NOT_AUTOMATED").alias("status"))).alias("rules")).alias("detection"),
        F.array(F.struct(F.lit("native").alias("tool"), none.alias("sourceFindingId"), F.lit("REPORTED").alias("status"), F.lit("not decided by any check").alias("note"))).alias("sources"),
    )


def run_problems(runs: DataFrame) -> DataFrame:
    """``(tool, problem)`` of run results ``(tool, status, exitCode, findings)``, findings being their number."""
    ok = F.coalesce(F.col("status").isin(*RUN_STATUSES), F.lit(False))
    return runs.select("tool", _listed(F.when(~ok, "unknown status"), F.when(F.col("findings").isNull(), "no findings list"), F.when((F.col("status") != "EXECUTED") & (F.col("findings") > 0), "findings of a tool that did not run"), F.when((F.col("status") == "EXECUTED") & F.col("exitCode").isNull(), "no exit code")).alias("problem"))


def source_problems(source: object) -> list[str]:
    """What is wrong with a source plug-in."""
    out = [f"no {k}" for k in ("id", "kind", "parse") if getattr(source, k, None) is None]
    if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", str(getattr(source, "id", "") or "")):
        out.append("id is not in lower case with hyphens")
    if getattr(source, "kind", None) not in KINDS:
        out.append("unknown kind")
    if not callable(getattr(source, "parse", None)):
        out.append("parse cannot be called")
    return out


def missing_suppressions(findings: DataFrame) -> DataFrame:
    """AGG-13: findings that are accepted or false without a suppression that says why."""
    return findings.where(F.col("status").isin("FALSE_POSITIVE", "ACCEPTED_RISK") & F.col("suppression").isNull()).select("seq", "findingId", "status")


def net_surface(files: DataFrame) -> DataFrame:
    """TXT-13: ``(project, net)``: whether a tree looks like a .NET application; top-level files count by name, sources at any depth."""
    path = F.translate("path", "\\", "/")
    deep = path.rlike(r"(?i)\.(cs|csproj|vbproj|fsproj)\z")
    top = path.rlike(r"(?i)^((web|app)\.(\w+\.)?config|appsettings(\.\w+)?\.json|global\.asax|packages\.config|[^/]*\.sln)\z")
    return files.where("path IS NOT NULL").groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(F.bool_or(deep | top).alias("net"))
