"""Queries over planted files and deliveries against their SQL, on a small report table."""

import duckdb
import pytest
from gritmill.sources import scanners


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A report table of 360 rows with nulls, blanks and repeated ids."""
    root = str(tmp_path_factory.mktemp("planted"))
    sql = """SELECT CAST(i AS BIGINT) AS row_id, CAST(i % 10 AS INTEGER) AS batch_id, TIMESTAMP '2025-01-01' AS received_at, CASE WHEN i % 17 <> 0 THEN 'repo-' || (i % 5) END AS repo, CASE WHEN i % 13 <> 0 THEN 'F-' || (i % 300) END AS findingId, CASE WHEN i % 19 <> 0 THEN 'Title ' || i ELSE '' END AS title,
    CASE i % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'dependency' WHEN 2 THEN 'reliability' END AS category, 'R-' || (i % 9) AS subcategory, ['CRITICAL', 'high', 'MEDIUM', 'LOW', 'INFO', NULL][i % 6 + 1] AS severity, ['CONFIRMED', 'LIKELY', 'POSSIBLE'][i % 3 + 1] AS confidence, 'OPEN' AS status,
    CASE WHEN i % 2 = 0 THEN {'version': '3.1', 'score': CAST(i % 10 AS DOUBLE), 'vector': 'v', 'severity': 'HIGH'} END AS cvss, CASE WHEN i % 3 = 0 THEN ['CWE-89', 'CWE-' || (i % 7)] END AS cwe, CASE WHEN i % 11 <> 0 THEN {'file': 'src\\A' || (i % 6) || '.cs', 'startLine': CAST(i % 40 AS INTEGER), 'endLine': CAST(i % 40 AS INTEGER), 'class': 'c', 'method': 'm'} END AS location,
    CASE WHEN i % 23 <> 0 THEN {'snippet': 'pwd="abc' || i || '"', 'language': 'csharp', 'toolOutput': 't', 'redacted': false} END AS evidence, 'p' AS problem, 'i' AS impact, 'r' AS recommendation, '' AS priority, [{'tool': 'roslyn', 'sourceFindingId': 'SCS0002', 'status': 'REPORTED', 'note': 'n'}] AS sources FROM range(1, 361) t(i)"""
    con = duckdb.connect()
    con.execute(f"COPY ({sql}) TO '{root}/report.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW report AS SELECT * FROM '{root}/report.parquet'")
    return root, con


NAMES = """native_configuration native_settings native_manifest native_startup native_whole_files nuget_inventory binary_checks correlate_greedy 
scan_osv scan_sonarqube scan_semgrep scan_model_review baseline_problems baseline_created catalog_problems report_json redacted_elements dependency_queue_rows""".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, small, name):
    from gritmill.plans import adapters, checks, findings, inventories, records, texts  # noqa: F401
    from gritmill.plans.registry import ORACLES, QUERIES

    root, con = small
    df = QUERIES[name](spark, root)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(dict(zip(names, row))[c] for c in cols) for row in rel.fetchall()), key=repr)
    assert sorted(names) == cols and got == want and got


def test_registered_sources():
    one = scanners.Source("my-tool", "sast", lambda df, o, root: scanners.osv_findings(df, o))
    scanners.register_source(one)
    assert scanners.SOURCES.pop("my-tool") is one
    for bad in (scanners.Source("My Tool", "sast", one.parse), scanners.Source("x", "nothing", one.parse), scanners.Source("osv", "sast", one.parse)):
        with pytest.raises(ValueError):
            scanners.register_source(bad)
