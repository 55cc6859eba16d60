"""Files that are written from findings."""

import csv
import json

from gritmill.sinks import pages as P
from gritmill.sinks import tables as S
from helpers import finding, frame


def _df(spark):
    rows = [
        finding(1, findingId="SEC-GEN-001", title='a "b", c', severity="HIGH", problem="line1\nline2", impact="Bad. Very.", tests=["A-1"], cwe=["CWE-1"], location={"file": "a\\b.cs", "startLine": 3, "additionalLocations": [{"file": "c.cs", "startLine": 4}]}),
        finding(2, findingId="DEP-VULN-001", category="dependency", severity="INFO", title="<x> & \x01y", evidence={"snippet": "s\r\nt", "redacted": True}),
    ]
    return frame(spark, rows)


def test_csv(spark, tmp_path):
    p = tmp_path / "f.csv"
    assert S.write_csv(_df(spark), str(p)) == 3
    text = p.read_bytes().decode()
    assert text.count("\r\n") == 4 and "line1\nline2" in text
    rows = list(csv.DictReader(text.splitlines(keepends=True)))
    assert rows[1]["problem"] == "line1\nline2 (additional location 2 of 2)" and rows[1]["snippet"] == "" and rows[0]["title"] == 'a "b", c'


def test_sarif(spark, tmp_path):
    for extended in (False, True):
        p = tmp_path / "f.sarif"
        S.write_sarif(_df(spark), str(p), extended=extended)
        run = json.loads(p.read_text())["runs"][0]
        assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["SEC-GEN-001", "DEP-VULN-001"]
        assert run["results"][0]["message"]["text"] == 'a "b", c — Bad.' and run["results"][0]["level"] == "error"
        assert run["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a/b.cs"
        assert ("relatedLocations" in run["results"][0]) == extended


def test_report_round_trip(spark, tmp_path):
    p = tmp_path / "report.json"
    df = _df(spark)
    S.write_report(df, df.limit(0), {"n": 2}, str(p))
    doc = json.loads(p.read_text())
    assert doc["findings"][0]["cvss"] is None and doc["manualReview"] == [] and doc["summary"] == {"n": 2}
    back = S.read_report(spark, str(p)).orderBy("seq").collect()
    assert [r.findingId for r in back] == ["SEC-GEN-001", "DEP-VULN-001"] and back[0].location.additionalLocations[0].file == "c.cs"


def test_pages(spark, tmp_path):
    df = _df(spark)
    text = "".join(P.markdown(df))
    assert '<a id="SEC-GEN-001"></a>' in text and "&lt;x&gt;" in text and text.index("# HIGH") < text.index("# INFO")
    (tmp_path / "findings").mkdir()
    (tmp_path / "findings" / "SEC-GEN-099.md").write_text("stale")
    (tmp_path / "findings" / "my notes.md").write_text("mine")
    assert P.write_vault(df, str(tmp_path)) == 2
    assert sorted(p.name for p in (tmp_path / "findings").iterdir()) == ["DEP-VULN-001.md", "SEC-GEN-001.md", "my notes.md"] and (tmp_path / "08-Remediation-Roadmap.md").exists()
    assert P.topic_pages(df)["03-dependencies-security"].count() == 0 and P.topic_pages(df)["04-dependencies-maintenance"].count() == 1


def test_spreadsheet(spark):
    xml = P.spreadsheet(_df(spark))
    assert P.verify_spreadsheet(xml) == [] and "&lt;x&gt; &amp; y" in xml
    assert P.verify_spreadsheet(xml.replace("</Table>", "", 1)) and P.verify_spreadsheet(xml.replace('ss:Name="Findings"', 'ss:Name="a/b"')) and P.verify_spreadsheet("\x01")


def test_blocks():
    once = P.upsert_block("# t\n", "A-1", "body")
    assert P.upsert_block(once, "A-1", "body") == once
    two = P.upsert_block(once, "B-2", "other")
    assert P.upsert_block(two, "A-1", "new").count("new") == 1 and "other" in P.upsert_block(two, "A-1", "new")
    torn = two.replace("<!-- block:A-1:end -->\n", "")
    assert "other" in P.upsert_block(torn, "A-1", "x") and "body" not in P.upsert_block(torn, "A-1", "x")
    try:
        P.upsert_block(once + once, "A-1", "x")
        raise AssertionError
    except ValueError:
        pass


def test_small_things(spark):
    df = _df(spark)
    assert P.severity_bars({"HIGH": 1000, "LOW": 1})[3].startswith("LOW      █") and P.cut_path("a" * 50, 10) == "…" + "a" * 9
    targets, below = P.narrative_targets(df)
    assert [r.seq for r in targets.collect()] == [1] and below == 1
    act, manual = S.split_manual(df)
    assert act.count() == 2 and S.manual_queue(manual).count() == 0
    assert {r.headline for r in S.headlines(df).collect()} == {'a "b", c — Bad.', "<x> & \x01y"}
