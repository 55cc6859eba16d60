"""Scanner readers on small documents in each tool's shape, and on junk."""

import json

import pytest
from gritmill.sources.files import NATIVE, list_files, read_texts, review_selection, walk
from gritmill.sources.scanners import SOURCES, read_source
from gritmill.operators import correlate as C
from pyspark.sql import functions as F


def _read(spark, source, *docs, root=""):
    raw = spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)], "doc bigint, raw string")
    return read_source(raw, source, ["doc"], root).collect()


def _sarif(*results, rules=(), **run):
    return {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "x", "version": "1.0", "rules": list(rules)}}, "results": list(results)} | run]}


def _at(uri, line=None, **more):
    return {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line} | more}}


@pytest.mark.parametrize("source", sorted(SOURCES))
def test_junk_gives_no_rows(spark, source):
    assert _read(spark, source, "", "{}", "[]", None, "{not json", '{"runs":[]}', "null", "7") == []


def test_sarif_precedence_and_places(spark):
    rules = [{"id": "R", "shortDescription": {"text": "old"}}, {"id": "R", "shortDescription": {"text": "CWE-295: Improper"}, "properties": {"tags": ["CWE-295: x", "security"], "security-severity": "9.1", "precision": "very-high"}, "help": {"markdown": "fix"}}]
    doc = _sarif(
        {"ruleId": "R", "level": "note", "message": {"text": "first\nsecond"}, "locations": [_at("file:///C:/x/Web%20a.config", 3), _at("b\\c.cs", 4)], "suppressions": [{"kind": "external"}], "partialFingerprints": {"k": "v"}},
        {"ruleId": "none", "level": "error", "message": {"text": "see cve-2030-1234"}, "locations": [{}]}, {"message": {"text": ""}}, None, rules=rules,
    )
    a, b, c = _read(spark, "semgrep", doc)
    assert (a.title, a.severity, a.confidence, a.cvss.score, a.cvss.vector, a.status, a.cwe) == ("first", "CRITICAL", "CONFIRMED", 9.1, None, "FALSE_POSITIVE", ["CWE-295"])
    assert (a.location.file, a.location.startLine, a.location.additionalLocations[0].file, a.recommendation, a.sources[0].note) == ("C:/x/Web a.config", 3, "b/c.cs", "fix", "fingerprint: v")
    assert (b.severity, b.confidence, b.location.file, b.cvss, b.advisories) == ("HIGH", "LIKELY", "(unknown)", None, ["CVE-2030-1234"])
    assert (c.title, c.severity, c.confidence) == ("Unnamed finding", "MEDIUM", "POSSIBLE")


def test_dataflow_takes_the_shortest_and_cuts_long_ones(spark):
    step = lambda i: {"location": _at(f"f{i}.cs", i + 1)}
    flow = lambda n: {"threadFlows": [{"locations": [step(i) for i in range(n)]}]}
    (a,) = _read(spark, "semgrep", _sarif({"ruleId": "R", "message": {"text": "m"}, "codeFlows": [flow(50), {"threadFlows": [{"locations": []}]}, flow(45)]}))
    d = a.dataflow
    assert (d.pathCount, len(d.steps), d.steps[0].role, d.steps[-1].role, d.steps[-1].startLine) == (3, 40, "source", "sink", 45)
    assert "5 intermediate" in d.steps[19].message


def test_roslyn(spark):
    doc = {"tool": "roslyn", "logs": [_sarif({"ruleId": "CA5359", "level": "warning", "message": {"text": "m"}, "locations": [_at("a.cs", 8)]}, {"ruleId": "CA1305", "message": {"text": "m"}}, {"ruleId": "CA2190", "message": {"text": "m"}}), None]}
    a, b, c = _read(spark, "roslyn", doc)
    assert (a.severity, a.cwe, a.category, a.confidence) == ("HIGH", ["CWE-295"], "security", "LIKELY") and b.category == "code-quality" and c.category == "security"
    assert len(_read(spark, "roslyn", [doc["logs"][0], doc["logs"][0]])) == 6


def test_gitleaks_never_shows_the_value(spark):
    doc = _sarif({"ruleId": "dotnet-commented-credential", "message": {"text": "m"}, "locations": [_at("/src/Web.config", 12, snippet={"text": "pw=topsecret"})], "partialFingerprints": {"secret": "topsecret"}})
    (a,) = _read(spark, "gitleaks", doc, root="/SRC/")
    assert (a.severity, a.confidence, a.cwe, a.location.file, a.priority, a.cvss) == ("HIGH", "LIKELY", ["CWE-540", "CWE-798"], "Web.config", "P0", None) and "topsecret" not in str(a)


def test_trivy(spark):
    doc = {"Results": [None, {"Target": "a\\x.lock", "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "p", "InstalledVersion": "1", "FixedVersion": "2", "Severity": "LOW", "CVSS": {"ghsa": {"V3Score": 5.0}, "nvd": {"V3Score": 7.45, "V3Vector": "CVSS:3.1/x"}}}, {"VulnerabilityID": "CVE-2", "PkgName": "q", "Severity": "UNKNOWN", "CVSS": {"other": {"V3Score": 5.3}}}, None], "Secrets": [{"RuleID": "k", "Severity": "CRITICAL", "StartLine": 14, "Match": "hunter22"}], "Misconfigurations": [{"ID": "m", "Severity": "bogus", "CauseMetadata": {"StartLine": 0}}]}]}
    rows = {r.subcategory: r for r in _read(spark, "trivy", doc)}
    assert (rows["CVE-1"].severity, rows["CVE-1"].cvss.score, rows["CVE-1"].package.fixed, rows["CVE-1"].location.file) == ("HIGH", 7.5, "2", "a/x.lock")
    assert rows["CVE-2"].severity == "MEDIUM" and rows["k"].severity == "CRITICAL" and rows["m"].severity == "MEDIUM" and rows["m"].location.startLine is None and "hunter22" not in str(rows)


def test_snyk(spark):
    v = {"id": "S-1", "packageName": "p", "version": "1", "severity": "high", "cvssScore": 7.5, "identifiers": {"CVE": ["CVE-1"], "CWE": ["CWE-79", "bad"]}, "from": ["a", "b", "c"], "isUpgradable": True, "upgradePath": [False, "p@2"]}
    rows = _read(spark, "snyk", [{"displayTargetFile": "x", "vulnerabilities": [v, v]}, {"vulnerabilities": [v, {**v, "version": "2", "cvssScore": None}, {"id": None}]}], {"vulnerabilities": [v]})
    assert sorted((r.doc, r.package.installed, r.severity) for r in rows) == [(0, "1", "HIGH"), (0, "2", "HIGH"), (1, "1", "HIGH")]
    assert rows[0].cwe == ["CWE-79"] and rows[0].advisories == ["CVE-1", "S-1"] and "p@2" in rows[0].recommendation


def test_osv(spark):
    doc = {"packages": [{"packageId": "N", "version": "9", "file": "f", "line": 2, "vulnId": "G-1"}, {"packageId": "A", "version": "3", "file": "f", "line": 3, "vulnId": "G-2"}], "vulns": [{"id": "G-1", "database_specific": {"severity": "HIGH"}, "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "13"}]}]}]}]}
    a, b = _read(spark, "osv", doc)
    assert (a.severity, a.package.fixed, b.severity, b.package.fixed, a.confidence, a.cvss) == ("HIGH", "13", "MEDIUM", None, "CONFIRMED", None)


def test_sonarqube(spark):
    issues = [{"rule": "csharp:S2068", "severity": "BLOCKER", "type": "VULNERABILITY", "component": "key:Web.config", "line": 12, "message": "m"}, {"rule": "S4830", "securityCategory": "hotspot", "vulnerabilityProbability": "CRITICAL", "component": "Http.cs", "message": "h"}]
    pascal = {"Issues": [{"RuleId": "x:S1", "Severity": "MINOR", "Message": "m", "FileName": "a.cs", "Location": {"StartLine": 3}}]}
    rows = {(r.doc, r.subcategory): r for r in _read(spark, "sonarqube", {"issues": issues}, pascal, issues, _sarif({"ruleId": "S9", "level": "error", "message": {"text": "m"}, "locations": [_at("a.cs", 1)]}))}
    assert set(rows) == {(0, "S2068"), (0, "S4830"), (1, "S1"), (2, "S2068"), (2, "S4830"), (3, "S9")}
    a, h, p = rows[0, "S2068"], rows[0, "S4830"], rows[1, "S1"]
    assert (a.severity, a.location.file, a.category, h.confidence, h.severity, p.severity, p.location.startLine, rows[3, "S9"].severity) == ("CRITICAL", "Web.config", "security", "POSSIBLE", "CRITICAL", "MEDIUM", 3, "CRITICAL")


def test_ai_review(spark):
    item = {"title": "T", "file": "a\\b.cs", "startLine": 4, "severity": "HIGH", "category": "odd", "cwe": ["CWE-79", "x"], "snippet": "k = sk-abcdefghijklmnop\n" * 20}
    said = "Here:\n```json\n" + json.dumps([item, {"title": "no file"}, 3]) + "\n```"
    rows = _read(spark, "ai-review", {"content": [{"type": "text", "text": said}]}, {"choices": [{"message": {"content": said}}]}, [item])
    assert len(rows) == 3
    r = rows[0]
    assert (r.confidence, r.status, r.category, r.cwe, r.location.file, r.location.startLine, r.cvss) == ("POSSIBLE", "UNVERIFIED", "security", ["CWE-79"], "a/b.cs", 4, None)
    assert r.evidence.snippet.count("\n") == 11 and "sk-abc" not in r.evidence.snippet


def test_one_defect_from_two_tools(spark):
    sonar = {"issues": [{"rule": "S4830", "type": "VULNERABILITY", "severity": "CRITICAL", "component": "k:App/Http.cs", "line": 42, "message": "m"}, {"rule": "S1450", "severity": "MINOR", "component": "k:App/Http.cs", "line": 9, "message": "m"}]}
    pattern = _sarif({"ruleId": "acme-dotnet-disable-cert-validation", "level": "error", "message": {"text": "m"}, "locations": [_at("App/Http.cs", 44)]})
    raw = lambda d: spark.createDataFrame([(0, json.dumps(d))], "doc bigint, raw string")
    both = read_source(raw(sonar), "sonarqube", ["doc"]).unionByName(read_source(raw(pattern), "semgrep", ["doc"])).drop("doc").withColumn("seq", F.monotonically_increasing_id())
    out, stats = C.correlate(both, ["sonarqube", "semgrep", "trivy"])
    assert stats.first().canonicalFindings == 2
    r = next(r for r in out.collect() if r.concept == "weak-cert-validation")
    assert [(s.tool, s.status) for s in r.sources] == [("sonarqube", "REPORTED"), ("semgrep", "REPORTED"), ("trivy", "MISSED")] and r.findingId == "SEC-CRYPTO-001"


def test_walk_reads_hidden_names(spark, tmp_path):
    for p, t in {"Views/_Layout.cs": "a", ".dot/x.cs": "b", "bin/y.cs": "c", "Tests/z.cs": "d", "empty.cs": "", "auth.cs": "é", "n.txt": "x"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    files, left, cut = walk(str(tmp_path), NATIVE)
    assert [f[0] for f in files] == ["auth.cs", ".dot/x.cs", "Views/_Layout.cs"] and set(left) == {"bin/", "Tests/"} and not cut
    df = read_texts(list_files(spark, str(tmp_path), NATIVE, "p"))
    assert {r.path: r.text for r in df.collect()} == {"auth.cs": "é", ".dot/x.cs": "b", "Views/_Layout.cs": "a"}
    assert [r.path for r in review_selection(df, 1).collect()] == ["auth.cs"]
