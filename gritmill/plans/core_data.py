"""Queries of the general data operators (snapshots, nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritmill.operators.nested import identifier_items
from gritmill.operators.snapshots import finding_changes
from gritmill.plans.registry import query
from gritmill.session import table

P2_SQL = r"""
WITH r AS (SELECT repo, snapshot_id, row_id, upper(trim(findingId)) AS f, upper(trim(severity)) AS sev FROM report_snapshot),
snaps AS (SELECT repo, snapshot_id, lag(snapshot_id) OVER (PARTITION BY repo ORDER BY snapshot_id) AS prev, lead(snapshot_id) OVER (PARTITION BY repo ORDER BY snapshot_id) AS nxt
          FROM (SELECT DISTINCT repo, snapshot_id FROM r)),
latest AS (SELECT repo, snapshot_id, f, sev FROM r WHERE f IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, snapshot_id, f ORDER BY row_id DESC) = 1),
cur AS (SELECT l.*, s.prev, s.nxt FROM latest l JOIN snaps s ON s.repo = l.repo AND s.snapshot_id = l.snapshot_id)
SELECT c.snapshot_id, c.repo, c.f AS finding_id, CASE WHEN p.f IS NULL THEN 'added' ELSE 'changed' END AS change
FROM cur c LEFT JOIN cur p ON p.repo = c.repo AND p.f = c.f AND p.snapshot_id = c.prev
WHERE c.prev IS NOT NULL AND (p.f IS NULL OR p.sev IS DISTINCT FROM c.sev)
UNION ALL
SELECT c.nxt, c.repo, c.f, 'removed' FROM cur c LEFT JOIN cur n ON n.repo = c.repo AND n.f = c.f AND n.snapshot_id = c.nxt
WHERE c.nxt IS NOT NULL AND n.f IS NULL
"""

P3_SQL = r"""
WITH l AS (SELECT delivery_id, unnest(logs) AS e, generate_subscripts(logs, 1) - 1 AS i FROM roslyn),
u AS (SELECT delivery_id, i, unnest(e.runs) AS e, generate_subscripts(e.runs, 1) - 1 AS j FROM l),
s AS (SELECT delivery_id, i, j, unnest(e.results) AS e, generate_subscripts(e.results, 1) - 1 AS k FROM u),
t AS (SELECT delivery_id, unnest(Results) AS e, generate_subscripts(Results, 1) - 1 AS i FROM trivy),
v AS (SELECT delivery_id, i, unnest(e.Vulnerabilities) AS e, generate_subscripts(e.Vulnerabilities, 1) - 1 AS j FROM t),
y AS (SELECT delivery_id, CASE WHEN json_type(p) = 'ARRAY' THEN CAST(p AS JSON[]) ELSE [p] END AS ps FROM (SELECT delivery_id, CAST(payload AS JSON) AS p FROM snyk WHERE json_valid(payload))),
pr AS (SELECT delivery_id, unnest(ps) AS e, generate_subscripts(ps, 1) - 1 AS i FROM y),
vu AS (SELECT delivery_id, i, unnest(vs) AS e, generate_subscripts(vs, 1) - 1 AS j FROM (SELECT delivery_id, i, CASE WHEN json_type(e, '$.vulnerabilities') = 'ARRAY' THEN CAST(json_extract(e, '$.vulnerabilities') AS JSON[]) END AS vs FROM pr)),
cv AS (SELECT delivery_id, i, j, CASE json_type(e, '$.identifiers.CVE') WHEN 'ARRAY' THEN CAST(json_extract(e, '$.identifiers.CVE') AS VARCHAR[]) WHEN 'VARCHAR' THEN [json_extract_string(e, '$.identifiers.CVE')] END AS cs FROM vu),
en AS (SELECT delivery_id, i, j, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS k FROM cv)
SELECT 'roslyn' AS src, delivery_id, i || '/' || j || '/' || k AS item_path, e.ruleId AS item_value FROM s WHERE trim(e.ruleId) <> ''
UNION ALL SELECT 'trivy', delivery_id, i || '/' || j, e.PkgName FROM v WHERE trim(e.PkgName) <> ''
UNION ALL SELECT 'snyk', delivery_id, i || '/' || j || '/' || k, c FROM en WHERE trim(c) <> ''
"""


@query("p2_found", P2_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding_changes(table(spark, sf_dir, "report_snapshot"))


@query("p3_found", P3_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifier_items(*[table(spark, sf_dir, t) for t in ("roslyn", "trivy", "snyk")])
