"""Baseline, diff, gates, roll-ups."""

import pytest
from gritmill.operators import baseline as B
from gritmill.operators import crosscheck, discovery
from gritmill.operators import rollups as R
from helpers import finding, frame
from pyspark.sql import functions as F

NOW = "2025-06-01T00:00:00Z"


def _entries(spark, rows, supp=()):
    f = frame(spark, rows).withColumn("findingId", F.concat(F.lit("ID-"), F.col("seq")))
    s = spark.createDataFrame(list(supp), "findingId string, justification string, expires string")
    return B.baseline_entries(f, s, "2025-01-01")


def test_drift_of_blanks_and_lines_stays_existing(spark):
    e, bad = _entries(spark, [finding(1, rule="A", snippet="a  =  1\r\n\r\n b"), finding(2, rule="GONE")])
    got = {(r.state, r.title) for r in B.classify(frame(spark, [finding(7, rule="A", snippet=" a = 1\nb ", line=99), finding(8, rule="NEW")]), e.withColumn("entry_seq", F.monotonically_increasing_id()), NOW).collect()}
    assert sorted(s for s, _ in got) == ["EXISTING", "FIXED", "NEW"] and bad.count() == 0


def test_suppressions(spark):
    supp = [("ID-1", "ok", None), ("ID-2", "ok", "2025-06-01"), ("ID-3", " ", None), ("ID-4", "x", "soon"), ("ID-9", "x", None)]
    rows = [finding(i, rule=f"S{i}") for i in (1, 2, 3, 4)]
    e, bad = _entries(spark, rows, supp)
    assert {(r.findingId, r.problem) for r in bad.collect()} == {("ID-3", "no justification"), ("ID-4", "expires is not a date"), ("ID-9", "no such finding")}
    cls = B.classify(frame(spark, rows), e.withColumn("entry_seq", F.lit(1)), NOW)
    assert sorted((r.status, r.suppression_state) for r in cls.where("suppression_state IS NOT NULL").collect()) == [("OPEN", "expired"), ("SUPPRESSED", "active")]
    g = B.gate(cls, "HIGH").first()
    assert (g.fail, g.new_offenders, g.expired) == (True, 0, 1)
    with pytest.raises(ValueError):
        B.gate(cls, "SOMETIMES")


def test_diff(spark):
    rows = [finding(1, file="Src\\Foo.cs"), finding(2, file="b.cs", location={"file": "b.cs", "additionalLocations": [{"file": "./SRC/foo.cs"}]}), finding(3, file="c.cs")]
    changed = spark.createDataFrame([("src/foo.cs",), (None,)], "path string")
    got = {r.seq: (r.diffRelation, r.in_diff) for r in B.diff_partition(frame(spark, rows), changed).collect()}
    assert got == {1: ("primary", True), 2: ("context", False), 3: ("outside", False)}
    assert B.diff_partition(frame(spark, rows), changed, context=True).where("in_diff").count() == 2


def test_rollups(spark):
    rows = [finding(1, severity="HIGH", tests=["A-1", "ZZ"]), finding(2, severity="INFO", priority="P0"), finding(3, severity="LOW", category="dependency", advisories=["CVE-1"]), finding(4, severity="Bad", title=" ", cvss={"vector": "x", "score": 1.0})]
    f = frame(spark, rows)
    assert {r.severity: r.n for r in R.severity_totals(f).collect()} == {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 0, "LOW": 1, "INFO": 1}
    assert R.overall_risk(f).first().risk == "HIGH" and R.overall_risk(f.where("severity = 'INFO'"), "MEDIUM").first().risk == "MEDIUM"
    assert {r.priority: r.n for r in R.roadmap(f).collect()} == {"P0": 1, "P1": 1, "P3": 2}
    assert {(r.seq, r.path) for r in R.violations(f).collect()} == {(4, "severity"), (4, "title"), (4, "cvss.vector")}
    cat = spark.createDataFrame([("A-1",)], "id string")
    assert [r.id for r in R.unknown_references(f, cat).collect()] == ["ZZ"]
    cov = spark.createDataFrame([("A-1", "n", "checked"), ("A-1", "m", "manual-review"), ("B", "n", "manual-review"), ("C", "n", "not-applicable")], "caseId string, tool string, outcome string")
    assert {r.outcome: r.n for r in R.coverage_rollup(cov).collect()} == {"checked": 1, "manual-review": 1, "not-applicable": 1}
    runs = spark.createDataFrame([("idle",), ("tool-a",)], "tool string")
    assert {r.tool: (r.reported, r.missed) for r in R.tool_pivot(f, runs).collect()} == {"idle": (0, 0), "tool-a": (4, 0)}
    assert R.probe_coverage(spark.createDataFrame([("A Certificate",), (None,)], "text string"), spark.createDataFrame([("certificate",)], "probe string")).first().hits == 1


def test_cross_check(spark):
    ai = frame(spark, [finding(1, file="a", line=10, severity="HIGH"), finding(2, file="a", line=50, cwe=["CWE-1"]), finding(3, file="b")])
    prior = frame(spark, [finding(11, file="./A", line=14, severity="HIGH"), finding(12, file="a", line=90, cwe=["CWE-1"], severity="CRITICAL")])
    got = {r.seq: (r.outcome, r.counterpart) for r in crosscheck.cross_check(ai, prior).collect()}
    assert got == {1: ("agrees", 11), 2: ("CONTRADICTED", 12), 3: ("alone", None)}


def test_discovery(spark):
    tree = [("p", "a.sln", ""), ("p", "A/A.csproj", '<Project Sdk="x"><TargetFramework>net8.0</TargetFramework></Project>'), ("p", "B/B.Tests.csproj", "<Project/>"), ("p", "B/packages.config", ""), ("q", "x.txt", "")]
    got = {r.project: r for r in discovery.discover(spark.createDataFrame(tree, "project string, path string, text string")).collect()}
    assert (got["p"].stack, got["p"].test_projects, got["p"].any_packages_config, got["p"].can_list_packages, got["q"].stack) == ("mixed", 1, True, False, "unknown")
