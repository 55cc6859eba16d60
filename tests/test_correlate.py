"""Correlation against a plain loop, attribution, order, ids, families."""

import random

from gritmill.operators import correlate as C
from helpers import finding, frame


def _loop(rows):
    """The merge as one loop over all findings: which finding each one ends up in."""
    owner, target = {}, {}
    for seq, keys in rows:
        t = next((owner[k] for k in keys if k in owner), seq)
        target[seq] = t
        for k in keys:
            owner.setdefault(k, t)
    return target


def test_greedy_equals_the_loop(spark):
    rng = random.Random(5)
    rows = [finding(i, file=f"f{rng.randrange(4)}.cs", rule=rng.choice(["S2068", "S4830", "X1", "X2", "CA5359"]), line=rng.randrange(12), advisories=[f"CVE-2030-{1000 + rng.randrange(3)}"] if rng.random() < 0.2 else None, cwe=rng.choice([None, ["CWE-89"], ["CWE-327"]]), tool=f"t{i % 3}") for i in range(120)]
    df = frame(spark, rows)
    keys = [(r.seq, r["keys"]) for r in C.with_keys(df).select("seq", "keys").orderBy("seq").collect()]
    want = _loop(keys)
    got = {r.seq: r.merged for r in C.merged_findings(df).select("seq", "merged").collect()}
    assert set(got) == set(want.values())
    assert all(n == sum(t == s for t in want.values()) - 1 for s, n in got.items())


def test_merge_keeps_the_best_of_both(spark):
    a = finding(1, rule="S2068", tool="sonar", severity="LOW", confidence="POSSIBLE", problem="x", cwe=["CWE-798"], cvss={"score": 5.0, "vector": "v"}, evidence={"snippet": "s", "toolOutput": "one"})
    b = finding(2, rule="generic-api-key", tool="trivy", line=90, severity="CRITICAL", confidence="CONFIRMED", problem="longer", cwe=["CWE-798", "CWE-1"], cvss={"score": 9.0}, evidence={"snippet": "longer", "toolOutput": "two"}, status="FALSE_POSITIVE")
    (r,) = C.merged_findings(frame(spark, [a, b])).collect()
    assert (r.severity, r.confidence, r.problem, r.status, r.merged) == ("CRITICAL", "CONFIRMED", "longer", "FALSE_POSITIVE", 1)
    assert r.cwe == ["CWE-798", "CWE-1"] and r.cvss.score == 9.0 and r.cvss.vector is None
    assert r.evidence.snippet == "longer" and r.evidence.toolOutput == "one\ntwo"
    assert [s.tool for s in r.sources] == ["sonar", "trivy"] and r.correlation.mergedFrom == ["trivy:generic-api-key"]


def test_what_does_not_merge(spark):
    rows = [finding(1, rule="A"), finding(2, rule="A", line=11), finding(3, rule="A", file="b.cs"), finding(4, rule=None, file=""), finding(5, rule=None, file=""), finding(6, rule="S2068", file="x"), finding(7, rule="S2068", file="y")]
    assert C.merged_findings(frame(spark, rows)).count() == 7


def test_paths_and_vendor_prefix_are_normalised(spark):
    rows = [finding(1, rule="acme-dotnet-regex-no-timeout", file=".\\SRC\\a.cs"), finding(2, rule="S6444", file="src/A.cs", line=500)]
    assert C.merged_findings(frame(spark, rows)).count() == 1


def test_attribution_ids_and_stats(spark):
    rows = [finding(1, severity="LOW"), finding(2, severity="HIGH", file="z"), finding(3, severity="HIGH", file="b"), finding(4, category="dependency")]
    out, stats = C.correlate(frame(spark, rows), ["tool-a", "tool-b"])
    got = {r.seq: (r.findingId, [(s.tool, s.status) for s in r.sources]) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {3: "SEC-GEN-001", 2: "SEC-GEN-002", 1: "SEC-GEN-003", 4: "DEP-VULN-001"}
    assert got[1][1] == [("tool-a", "REPORTED"), ("tool-b", "MISSED")]
    s = stats.first()
    assert (s.inputFindings, s.canonicalFindings, s.mergedAway, s.dedupRatio, s.multiToolConfirmed) == (4, 4, 0, 0.0, 0)


def test_families(spark):
    rows = [finding(i, rule="R", file=f"f{i}", severity="CRITICAL" if i == 3 else "LOW") for i in range(1, 6)] + [finding(9, rule="R", severity="INFO"), finding(10, rule="R", category="dependency"), finding(11, rule="Q")]
    got = {r.seq: r for r in C.consolidate(frame(spark, rows), max_locations=2).collect()}
    assert set(got) == {1, 9, 10, 11}
    assert got[1].severity == "CRITICAL" and got[1].consolidated.locations == 3 and [p.file for p in got[1].location.additionalLocations] == ["f2", "f3"]
    assert len(got[1].sources) == 1 and got[11].consolidated is None


def test_empty(spark):
    out, stats = C.correlate(frame(spark, []), ["a"])
    assert out.count() == 0 and stats.first().inputFindings == 0 and C.consolidate(frame(spark, [])).count() == 0
