"""Catalog checks, manual reviews, the rule pack, settings."""

from gritmill.operators.catalog import case_problems, manual_reviews, net_surface, reference_warnings, run_problems, source_problems
from gritmill.operators.rule_pack import scan_pack
from gritmill.schema import conform
from gritmill.sinks.tables import split_manual
from gritmill.sources.reports import CASE_DDL, redacted_settings, write_inventory
from gritmill.sources.scanners import SOURCES
from helpers import finding, frame
from pyspark.sql import functions as F

CASE = ("A-1", "A", "t", "look", "pass", "both", "x", "HIGH", "MANUAL", "CWE-1")


def test_cases(spark):
    cat = spark.createDataFrame([CASE, CASE, ("B-1", "?", None, "l", "e", "odd", "x", "p", "NO", "N/A"), ("O-1", "O", "t", "l", "e", "core", "x", "p", "MANUAL", "N/A")], CASE_DDL)
    got = {(r.id, r.problem) for r in case_problems(cat, ["A", "O"]).collect()}
    assert got == {("A-1", "repeated id"), ("B-1", "unknown category"), ("B-1", "no title"), ("B-1", "unknown stack"), ("B-1", "unknown automatable")}
    cov = spark.createDataFrame([("O-1", "manual-review"), ("A-1", "checked")], "caseId string, outcome string")
    (m,) = conform(manual_reviews(cov, cat).withColumn("seq", F.lit(1))).collect()
    assert (m.category, m.severity, m.location.file, m.cwe, m.detection["class"]) == ("dependency", "INFO", "(project)", None, "MANUAL_REVIEW")
    act, manual = split_manual(conform(manual_reviews(cov, cat).withColumn("seq", F.lit(1))))
    assert act.count() == 0 and manual.count() == 1
    f = frame(spark, [finding(1, findingId="x", tests=["O-1"]), finding(2, findingId="y"), finding(3, findingId="z", tests=["A-1", "O-1"])])
    assert {(r.findingId, r.problem) for r in reference_warnings(f, cat).collect()} == {("x", "no security case"), ("y", "no case")}


def test_runs_and_sources(spark):
    runs = spark.createDataFrame([("a", "EXECUTED", 0, 3), ("b", "FAILED", 1, 2), ("c", "ODD", None, None), ("d", "EXECUTED", None, 0)], "tool string, status string, exitCode int, findings int")
    assert {(r.tool, r.problem) for r in run_problems(runs).collect()} == {("b", "findings of a tool that did not run"), ("c", "unknown status"), ("c", "no findings list"), ("d", "no exit code")}
    assert all(source_problems(s) == [] for s in SOURCES.values()) and len(source_problems(object())) == 6


def test_pack(spark):
    text = '<add key="DbPassword" value="hunter22" />\n<add key="Secret" value="{token}" />\nx.Password = "abcd";\n<add connectionString="a;Password=realone;b" />'
    df = spark.createDataFrame([("p", "Web.config", text), ("p", "bin/Web.config", text), ("p", "doc.xml", text), ("p", None, text), ("p", "n", None)], "project string, path string, text string")
    rows = scan_pack(df).collect()
    assert sorted(r.rule for r in rows) == ["dotnet-appsetting-secret", "dotnet-connectionstring-password", "dotnet-inline-credential-assignment"]
    assert not any(v in str(rows) for v in ("hunter22", "abcd", "realone"))
    assert {r.project: r.net for r in net_surface(df).collect()} == {"p": True}


def test_settings_and_inventory(spark, tmp_path):
    assert redacted_settings({"keys": {"a": "abcdefgh"}, "token": "", "x": {"password": "12345678", "n": 3}, "l": ["y"]}) == {"keys": {"a": "****efgh"}, "token": "(not set)", "x": {"password": "****5678", "n": 3}, "l": ["y"]}
    write_inventory({"f": spark.createDataFrame([("p", "t")], "path string, text string")}, str(tmp_path / "inv"))
    assert spark.read.parquet(str(tmp_path / "inv" / "f")).columns == ["path"]
