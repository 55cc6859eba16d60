"""Roll-ups and integrity checks of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritmill.operators.correlate import reported
from gritmill.schema import CATEGORIES, CONFIDENCES, NOT_SCOREABLE, SEVERITIES, rank

#: Fixed value: the form of a CVSS 3.1 base vector.
VECTOR = r"^CVSS:3\.1/AV:[NALP]/AC:[LH]/PR:[NLH]/UI:[NR]/S:[UC]/C:[NLH]/I:[NLH]/A:[NLH]\z"


def severity_totals(findings: DataFrame) -> DataFrame:
    """AGG-01: ``(severity, n)`` for every severity, also those without a finding."""
    dim = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return dim.join(findings.groupBy("severity").count(), "severity", "left").select("severity", F.coalesce("count", F.lit(0)).alias("n"))


def counts_by(findings: DataFrame, *cols: str) -> DataFrame:
    """AGG-02 and AGG-11: counts by each column alone, in one pass by grouping sets: ``(dimension, value, n)``."""
    cube = findings.groupingSets([[F.col(c)] for c in cols], *cols).agg(F.count("*").alias("n"), F.grouping_id(*cols).alias("g"))
    name, value, all_bits = F, F, (1 << len(cols)) - 1
    for i, c in enumerate(cols):
        here = F.col("g") == all_bits - (1 << (len(cols) - 1 - i))
        name, value = name.when(here, c), value.when(here, F.col(c))
    return cube.select(name.alias("dimension"), value.alias("value"), "n")


def tool_pivot(findings: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """AGG-03: ``(tool, reported, missed)`` from the sources, with every tool of `runs` ``(tool)`` even if it found nothing."""
    s = findings.select(F.explode("sources").alias("s")).groupBy(F.col("s.tool").alias("tool"))
    out = s.agg(F.count_if(F.col("s.status") == "REPORTED").alias("reported"), F.count_if(F.col("s.status") == "MISSED").alias("missed"))
    if runs is None:
        return out
    return out.join(runs.select("tool").distinct(), "tool", "full").na.fill(0, ["reported", "missed"])


def score_summary(findings: DataFrame) -> DataFrame:
    """AGG-04: how many findings have a score, how many have none, and the highest."""
    return findings.agg(F.count_if(F.col("cvss").isNotNull()).alias("scored"), F.count_if(F.col("cvss").isNull()).alias("not_scored"), F.max("cvss.score").alias("max_score"))


def coverage_rollup(coverage: DataFrame) -> DataFrame:
    """AGG-05: ``(outcome, n)`` over cases; a case's best outcome counts, over all tools of ``(caseId, tool, outcome)``."""
    order = ("checked", "manual-review", "not-applicable")
    best = coverage.groupBy("caseId").agg(F.min(rank(F.col("outcome"), order)).alias("r")).where(F.col("r") < len(order))
    return best.groupBy(F.element_at(F.array(*[F.lit(o) for o in order]), F.col("r") + 1).alias("outcome")).agg(F.count("*").alias("n"))


def coverage_sheet(coverage: DataFrame, findings: DataFrame) -> DataFrame:
    """AGG-06: for each case the tools that decided it and the findings that name it."""
    decided = coverage.where("outcome = 'checked'").groupBy("caseId").agg(F.sort_array(F.collect_set("tool")).alias("decided_by"))
    named = findings.select("findingId", F.explode("tests").alias("caseId")).groupBy("caseId").agg(F.sort_array(F.collect_set("findingId")).alias("finding_ids"))
    empty = F.array().cast("array<string>")
    return decided.join(named, "caseId", "full").select("caseId", F.coalesce("decided_by", empty).alias("decided_by"), F.coalesce("finding_ids", empty).alias("finding_ids"))


def overall_risk(findings: DataFrame, default: str = "LOW") -> DataFrame:
    """AGG-07: the first severity that has a finding, INFO apart; else `default`."""
    r = F.min(rank(F.col("severity"), SEVERITIES[:4]))
    return findings.agg(F.when(r < 4, F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), r + 1)).otherwise(default).alias("risk"))


def dependency_queue() -> Column:
    """AGG-08: the queue of a dependency finding: security if an advisory names it, else maintenance; null for others."""
    return F.when(F.col("category") == "dependency", F.when(F.size(F.coalesce("advisories", F.array().cast("array<string>"))) > 0, "security").otherwise("maintenance"))


def priority_or_default() -> Column:
    """AGG-09: the finding's priority, else one from its severity."""
    return F.coalesce(F.when(F.col("priority") != "", F.col("priority")), F.when(F.col("severity") == "CRITICAL", "P0").when(F.col("severity") == "HIGH", "P1").when(F.col("severity") == "MEDIUM", "P2").otherwise("P3"))


def roadmap(findings: DataFrame) -> DataFrame:
    return findings.groupBy(priority_or_default().alias("priority")).agg(F.count("*").alias("n"))


def multi_tool(findings: DataFrame) -> DataFrame:
    """AGG-10: findings with more than one REPORTED entry; ``distinct_tools`` tells how many tools these are."""
    r = reported()
    return findings.where(F.size(r) > 1).select("seq", "findingId", F.size(r).alias("reported_entries"), F.size(F.array_distinct(r["tool"])).alias("distinct_tools"))


def false_negatives(findings: DataFrame) -> DataFrame:
    """AGG-10: ``(tool, n)`` of findings a tool ran for and missed."""
    miss = findings.select(F.explode("sources").alias("s")).where(F.col("s.status").isin("MISSED", "FALSE_NEGATIVE"))
    return miss.groupBy(F.col("s.tool").alias("tool")).agg(F.count("*").alias("n"))


def projection_order() -> list[Column]:
    """SORT-01: severity, score down, confidence, id, input order."""
    return [rank(F.col("severity"), SEVERITIES), -F.coalesce(F.col("cvss.score"), F.lit(-1.0)), rank(F.col("confidence"), CONFIDENCES), F.coalesce("findingId", F.lit("")), F.col("seq")]


def top_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    """TOP-01: the first `n` in projection order; each partition keeps `n` rows before any exchange."""
    return findings.orderBy(*projection_order()).limit(n)


def violations(findings: DataFrame) -> DataFrame:
    """NORM-15 and AGG-13: ``(seq, findingId, path, problem)`` of everything the record's contract rejects; never an exception."""
    bad = lambda path, problem, cond: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(problem).alias("problem")))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    checks = F.array(
        bad("title", "missing", blank("title")),
        bad("category", "not in the list", ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))),
        bad("severity", "not in the list", ~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))),
        bad("confidence", "not in the list", ~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False))),
        bad("location.file", "missing", F.col("location").isNull() | blank("location.file")),
        bad("sources", "empty", F.col("sources").isNull() | (F.size("sources") == 0)),
        bad("cvss.vector", "malformed", F.col("cvss.vector").isNotNull() & ~F.col("cvss.vector").rlike(VECTOR)),
        bad("cvss", "category has no score", F.col("category").isin(*NOT_SCOREABLE) & F.col("cvss").isNotNull()),
        bad("location.startLine", "below 1", F.col("location.startLine") < 1),
    )
    return findings.select("seq", "findingId", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("v")).select("seq", "findingId", "v.path", "v.problem")


def duplicate_ids(findings: DataFrame) -> DataFrame:
    """COR-18: ids that occur more than once."""
    return findings.where("findingId IS NOT NULL").groupBy("findingId").agg(F.count("*").alias("n")).where("n > 1")


def unknown_references(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """COR-18: case ids that findings name and the catalog ``(id)`` lacks, with how many findings name them."""
    named = findings.select(F.explode("tests").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return named.join(catalog.select("id").distinct(), "id", "left_anti")


def probe_coverage(texts: DataFrame, probes: DataFrame) -> DataFrame:
    """COR-19: ``(probe, hits)``: how many texts contain each of a short list of needles, without regard to case.

    The needles become columns of one pass over the texts; they are a fixed list of the caller's, never data.
    """
    needles = [r[0] for r in probes.select("probe").orderBy("probe").collect()]
    low = F.lower("text")
    counts = texts.agg(*[F.count_if(low.contains(n.lower())).alias(f"c{i}") for i, n in enumerate(needles)]) if needles else None
    if counts is None:
        return texts.sparkSession.createDataFrame([], "probe string, hits bigint")
    pairs = F.array(*[F.struct(F.lit(n).alias("probe"), F.col(f"c{i}").alias("hits")) for i, n in enumerate(needles)])
    return counts.select(F.explode(pairs).alias("p")).select("p.probe", "p.hits")
