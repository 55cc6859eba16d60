"""Scanner deliveries as findings, and the whole review over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritmill.operators import correlate as C
from gritmill.operators import rollups as R
from gritmill.operators.numbering import number_within
from gritmill.plans.registry import query
from gritmill.session import table
from gritmill.sources import scanners as S
from gritmill.sources.sarif import finish

_BRIEF = ["delivery_id", "subcategory", "category", "severity", "confidence", "file", "line", "n_cwe"]


def _brief(df: DataFrame) -> DataFrame:
    return df.select("delivery_id", "subcategory", "category", "severity", "confidence", F.col("location.file").alias("file"), F.col("location.startLine").alias("line"), F.size(F.coalesce("cwe", F.array().cast("array<string>"))).alias("n_cwe"))


_URI = r"replace(regexp_replace(url_decode(coalesce({c}, '')), '^file:///?', ''), '\', '/')"
_SARIF_SQL = rf"""
u AS (SELECT delivery_id, i, unnest(runs) AS u, generate_subscripts(runs, 1) AS j FROM d),
r AS (SELECT delivery_id, u.tool.driver.rules AS rules, unnest(u.results) AS r FROM u),
x AS (SELECT delivery_id, r, list_filter(coalesce(rules, []), lambda z: z.id = r.ruleId)[-1] AS rule FROM r WHERE r IS NOT NULL),
y AS (SELECT delivery_id, r, rule, lower(coalesce(nullif(r.level, ''), nullif(rule.defaultConfiguration.level, ''), '')) AS lvl, lower(coalesce(array_to_string(rule.properties.tags, ' '), '')) AS tags,
  list_distinct(list_transform(flatten(list_transform(list_filter(list_concat(coalesce(rule.properties.tags, []), [rule.id, rule.shortDescription.text, r.ruleId]), lambda t: t IS NOT NULL), lambda t: regexp_extract_all(t, '(?i)CWE[-_ ]?(\d+)', 1))), lambda t: 'CWE-' || t)) AS cwe,
  lower(coalesce(rule.properties.precision, '')) AS p, coalesce(nullif({_URI.format(c="r.locations[1].physicalLocation.artifactLocation.uri")}, ''), '(unknown)') AS file, r.locations[1].physicalLocation.region.startLine AS line FROM x)
"""
_LEVEL = "CASE lvl WHEN 'error' THEN 'HIGH' WHEN 'note' THEN 'LOW' WHEN 'none' THEN 'INFO' ELSE 'MEDIUM' END"
_KNOWN = ", ".join(f"('{k}', '{s}', '{c}')" for k, (s, c) in S._ANALYSER.items())
query(
    "scan_roslyn",
    rf"""
WITH d AS (SELECT delivery_id, i, l.runs AS runs FROM (SELECT delivery_id, unnest(logs) AS l, generate_subscripts(logs, 1) AS i FROM roslyn) WHERE l IS NOT NULL),
{_SARIF_SQL}, known(rid, sev, kcwe) AS (VALUES {_KNOWN})
SELECT delivery_id, r.ruleId AS subcategory,
  CASE WHEN sev IS NOT NULL OR regexp_matches(coalesce(r.ruleId, ''), '^(CA2[13]\d\d|CA3\d\d\d|CA5\d\d\d|SCS\d+)$') THEN 'security' WHEN regexp_matches(coalesce(r.ruleId, ''), '^(CS|CA|S|IDE)\d+$') THEN 'code-quality'
    WHEN regexp_matches(tags, 'security|cwe|owasp|injection|xss|crypto') THEN 'security' WHEN regexp_matches(tags, 'performance') THEN 'performance' WHEN regexp_matches(tags, 'maintainability|style|convention') THEN 'code-quality' ELSE 'security' END AS category,
  coalesce(sev, {_LEVEL}) AS severity,
  CASE WHEN sev IS NOT NULL AND line > 0 THEN 'LIKELY' WHEN p = 'very-high' THEN 'CONFIRMED' WHEN p = 'high' THEN 'LIKELY' WHEN p = 'medium' THEN 'POSSIBLE' WHEN p = 'low' THEN 'UNVERIFIED' WHEN len(coalesce(r.locations, [])) > 0 THEN 'LIKELY' ELSE 'POSSIBLE' END AS confidence,
  file, line, CASE WHEN kcwe IS NOT NULL AND NOT list_contains(cwe, kcwe) THEN len(cwe) + 1 ELSE len(cwe) END AS n_cwe
FROM y LEFT JOIN known ON rid = r.ruleId
""",
)(lambda spark, d: _brief(S.roslyn_findings(S.roslyn_runs(table(spark, d, "roslyn")), ["delivery_id"])))
query(
    "scan_gitleaks",
    rf"""
WITH d AS (SELECT delivery_id, 1 AS i, runs FROM gitleaks), {_SARIF_SQL}
SELECT delivery_id, r.ruleId AS subcategory, 'security' AS category, 'HIGH' AS severity, 'LIKELY' AS confidence, regexp_replace(file, '^\./', '') AS file, line, CASE WHEN contains(lower(coalesce(r.ruleId, '')), 'commented') THEN 2 ELSE 1 END AS n_cwe FROM y
""",
)(lambda spark, d: _brief(S.gitleaks_findings(table(spark, d, "gitleaks"), ["delivery_id"])))
_SEV = "CASE WHEN upper(x.Severity) IN ('CRITICAL','BLOCKER') THEN 'CRITICAL' WHEN upper(x.Severity) IN ('HIGH','ERROR') THEN 'HIGH' WHEN upper(x.Severity) IN ('MEDIUM','MODERATE','WARNING','MINOR','MAJOR') THEN 'MEDIUM' WHEN upper(x.Severity) IN ('LOW','NOTE','INFO','INFORMATIONAL') THEN 'LOW' WHEN upper(x.Severity) IN ('NONE','UNKNOWN') THEN 'INFO' ELSE '{0}' END"
_SCORE = "coalesce(x.CVSS['nvd'].V3Score, CASE WHEN x.CVSS['nvd'] IS NULL THEN coalesce(x.CVSS['ghsa'].V3Score, CASE WHEN x.CVSS['ghsa'] IS NULL THEN map_values(x.CVSS)[1].V3Score END) END)"
query(
    "scan_trivy",
    rf"""
WITH r AS (SELECT delivery_id, unnest(Results) AS r FROM trivy), t AS (SELECT delivery_id, r, replace(coalesce(r.Target, ''), '\', '/') AS target FROM r),
v AS (SELECT delivery_id, target, unnest(r.Vulnerabilities) AS x FROM t), s AS (SELECT delivery_id, target, unnest(r.Secrets) AS x FROM t), m AS (SELECT delivery_id, target, unnest(r.Misconfigurations) AS x FROM t)
SELECT delivery_id, x.VulnerabilityID AS subcategory, 'dependency' AS category, CASE WHEN {_SCORE} > 0 THEN CASE WHEN {_SCORE} >= 9 THEN 'CRITICAL' WHEN {_SCORE} >= 7 THEN 'HIGH' WHEN {_SCORE} >= 4 THEN 'MEDIUM' ELSE 'LOW' END ELSE {_SEV.format('MEDIUM')} END AS severity, 'CONFIRMED' AS confidence, coalesce(nullif(target, ''), '(manifest)') AS file, NULL AS line, len(coalesce(x.CweIDs, [])) AS n_cwe FROM v WHERE x IS NOT NULL
UNION ALL SELECT delivery_id, x.RuleID, 'security', {_SEV.format('HIGH')}, 'LIKELY', target, x.StartLine, 1 FROM s WHERE x IS NOT NULL
UNION ALL SELECT delivery_id, x.ID, 'configuration', {_SEV.format('MEDIUM')}, 'LIKELY', target, CASE WHEN x.CauseMetadata.StartLine > 0 THEN x.CauseMetadata.StartLine END, 0 FROM m WHERE x IS NOT NULL
""",
)(lambda spark, d: _brief(S.trivy_findings(table(spark, d, "trivy"), ["delivery_id"])))
query(
    "scan_snyk",
    r"""
WITH y AS (SELECT delivery_id, CASE WHEN json_type(p) = 'ARRAY' THEN CAST(p AS JSON[]) ELSE [p] END AS ps FROM (SELECT delivery_id, CAST(payload AS JSON) AS p FROM snyk WHERE json_valid(payload))),
pr AS (SELECT delivery_id, unnest(ps) AS e, generate_subscripts(ps, 1) AS i FROM y),
vu AS (SELECT delivery_id, i, unnest(vs) AS x, generate_subscripts(vs, 1) AS j FROM (SELECT delivery_id, i, CASE WHEN json_type(e, '$.vulnerabilities') = 'ARRAY' THEN CAST(json_extract(e, '$.vulnerabilities') AS JSON[]) END AS vs FROM pr)),
f AS (SELECT delivery_id, i, j, json_extract_string(x, '$.id') AS id, json_extract_string(x, '$.packageName') AS pkg, json_extract_string(x, '$.version') AS ver, upper(json_extract_string(x, '$.severity')) AS sev, CAST(json_extract_string(x, '$.cvssScore') AS DOUBLE) AS score FROM vu),
u AS (SELECT * FROM f WHERE id <> '' QUALIFY row_number() OVER (PARTITION BY delivery_id, id, coalesce(pkg, 'undefined'), coalesce(ver, 'undefined') ORDER BY i, j) = 1)
SELECT delivery_id, id AS subcategory, CASE WHEN score > 0 THEN CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' ELSE 'LOW' END WHEN sev IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN sev ELSE 'MEDIUM' END AS severity FROM u
""",
)(lambda spark, d: S.snyk_findings(table(spark, d, "snyk"), ["delivery_id"]).select("delivery_id", "subcategory", "severity"))
query(
    "secret_tally",
    "SELECT x.ruleId AS rule, count(*) AS n FROM (SELECT unnest(u.results) AS x FROM (SELECT unnest(runs) AS u FROM gitleaks)) WHERE x IS NOT NULL GROUP BY 1",
)(lambda spark, d: S.gitleaks_findings(table(spark, d, "gitleaks"), ["delivery_id"]).groupBy(F.col("subcategory").alias("rule")).agg(F.count("*").alias("n")))


def all_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all four scanners' deliveries; `seq` counts them by tool, delivery and place in the delivery."""
    t = lambda n: table(spark, sf_dir, n)
    keep = ["delivery_id", "repo"]
    parts = [
        S.roslyn_findings(S.roslyn_runs(t("roslyn")), ["delivery_id"], keep), S.gitleaks_findings(t("gitleaks"), ["delivery_id"], "", keep),
        S.trivy_findings(t("trivy"), ["delivery_id"], "", keep).withColumn("__run_no", F.col("__run_no") * 3 + F.col("__kind")), S.snyk_findings(t("snyk"), ["delivery_id"], "payload", keep),
    ]
    out = None
    for i, p in enumerate(parts):
        # files of one name in different repositories are different files
        p = p.withColumn("seq", F.lit(None).cast("bigint")).withColumn("__tool", F.lit(i)).withColumn("location", F.col("location").withField("file", F.concat_ws("/", "repo", "location.file")))
        f = finish(p, [*keep, "__tool", "__run_no", "__no"])
        out = f if out is None else out.unionByName(f)
    place = ["__tool", "delivery_id", "__run_no", "__no"]
    numbered = number_within(out.drop("seq").withColumn("__all", F.lit(0)), "__all", [F.col(c) for c in place], "seq")
    return numbered.drop("__all", "__tool", "__run_no", "__no")


@query("review_pipeline")
def review_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, correlate, attribute, number and fold: the whole review over the deliveries of four scanners."""
    canonical, _ = C.correlate(all_scans(spark, sf_dir).drop("delivery_id", "repo"), ["roslyn", "gitleaks", "trivy", "snyk"])
    return C.consolidate(canonical).select("findingId", "category", "severity", F.col("location.file").alias("file"), F.col("consolidated.locations").alias("locations"))


@query("review_totals")
def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.severity_totals(C.merged_findings(all_scans(spark, sf_dir).drop("delivery_id", "repo")))


@query("scan_statistics")
def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.correlation_stats(C.merged_findings(all_scans(spark, sf_dir).drop("delivery_id", "repo")))
