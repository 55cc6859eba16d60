"""Baselines, catalogs, sinks and connections of findings over `report`, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritmill.operators import baseline, catalog, native_rules, rules
from gritmill.operators import rollups as R
from gritmill.plans.findings import FP, PATH, findings
from gritmill.plans.registry import query
from gritmill.session import table
from gritmill.sinks import tables as sinks

NOW = "2025-07-01T00:00:00Z"


def _suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One suppression a row: some without a reason, some with a date that is none, some for a finding that is not there."""
    i = F.col("row_id")
    name = F.when(i % 7 == 0, F.concat(F.lit("NONE-"), i.cast("string"))).otherwise(F.coalesce("findingId", F.lit("NONE")))
    expires = F.when(i % 5 == 0, "soon").when(i % 5 < 3, "2026-01-01T00:00:00Z")
    return table(spark, sf_dir, "report").select(name.alias("findingId"), F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("reason "), (i % 4).cast("string"))).alias("justification"), expires.alias("expires"))


_SUPPRESSED = """s AS (SELECT CASE WHEN row_id % 7 = 0 THEN 'NONE-' || row_id ELSE coalesce(findingId, 'NONE') END AS findingId, CASE WHEN row_id % 3 = 0 THEN '' ELSE 'reason ' || (row_id % 4) END AS justification, CASE WHEN row_id % 5 = 0 THEN 'soon' WHEN row_id % 5 < 3 THEN '2026-01-01T00:00:00Z' END AS expires FROM report),
j AS (SELECT *, CASE WHEN justification = '' THEN 'no justification' WHEN expires = 'soon' THEN 'expires is not a date' WHEN findingId NOT IN (SELECT findingId FROM report WHERE findingId IS NOT NULL) THEN 'no such finding' END AS problem FROM s)"""
query("baseline_problems", f"WITH {_SUPPRESSED} SELECT findingId, problem FROM j WHERE problem IS NOT NULL")(lambda spark, d: baseline.baseline_entries(findings(spark, d), _suppressions(spark, d), NOW)[1])
query(
    "baseline_created",
    f"""WITH {_SUPPRESSED}, g AS (SELECT findingId, min(justification) AS justification, min(expires) AS expires FROM j WHERE problem IS NULL GROUP BY 1)
SELECT {FP} AS fingerprint, r.findingId, r.severity, {PATH.format(c="location.file")} AS file, '{NOW}' AS firstSeen, g.justification, g.expires FROM report r LEFT JOIN g ON g.findingId = r.findingId""",
)(lambda spark, d: baseline.baseline_entries(findings(spark, d), _suppressions(spark, d), NOW)[0].select("fingerprint", "findingId", "severity", "file", "firstSeen", "suppressed.justification", "suppressed.expires"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each row, some with faults, some with an id that others have."""
    i = F.col("row_id")
    text = lambda c: F.lit(c)
    return table(spark, sf_dir, "report").select(
        F.concat(F.lit("C-"), F.when(i % 50 == 0, F.lit("0")).otherwise(i.cast("string"))).alias("id"), F.when(i % 4 == 0, "Z").otherwise("A").alias("category"), F.when(i % 6 == 0, "").otherwise("t").alias("title"), text("l").alias("lookFor"), text("e").alias("expected"),
        F.when(i % 9 == 0, "cobol").otherwise("both").alias("stack"), text("x").alias("type"), F.when(i % 11 != 0, "P1").alias("priority"), F.when(i % 13 == 0, "SOMEHOW").otherwise("MANUAL").alias("automatable"),
    )


query(
    "catalog_problems",
    """WITH c AS (SELECT row_id AS i, 'C-' || CASE WHEN row_id % 50 = 0 THEN '0' ELSE CAST(row_id AS VARCHAR) END AS id FROM report)
SELECT id, 'unknown category' AS problem FROM c WHERE i % 4 = 0 UNION ALL SELECT id, 'no title' FROM c WHERE i % 6 = 0 UNION ALL SELECT id, 'no priority' FROM c WHERE i % 11 = 0
UNION ALL SELECT id, 'unknown stack' FROM c WHERE i % 9 = 0 UNION ALL SELECT id, 'unknown automatable' FROM c WHERE i % 13 = 0 UNION ALL SELECT id, 'repeated id' FROM c GROUP BY id HAVING count(*) > 1""",
)(lambda spark, d: catalog.case_problems(_catalog(spark, d), ["A", "B"]))


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("seq")
    tests = F.when(i % 3 == 0, F.array().cast("array<string>")).when(i % 3 == 1, F.array(F.concat(F.lit("A-"), (i % 5).cast("string")))).otherwise(F.array(F.lit("P-1"), F.lit("gone")))
    return findings(spark, sf_dir).withColumn("tests", tests)


query(
    "catalog_references",
    "SELECT findingId, 'no case' AS problem FROM report WHERE row_id % 3 = 0 UNION ALL SELECT findingId, 'no security case' FROM report WHERE category = 'security' AND (row_id % 3 = 2 OR (row_id % 3 = 1 AND row_id % 5 > 2))",
)(lambda spark, d: catalog.reference_warnings(_tested(spark, d), spark.createDataFrame([("A-0", "A"), ("A-1", "A"), ("A-2", "A"), ("P-1", "P")], "id string, category string")))
query(
    "native_catalog_coverage",
    """SELECT 'C-' || row_id AS caseId, 'native' AS tool, CASE WHEN row_id % 3 = 0 THEN 'not-applicable' WHEN row_id % 2 = 0 THEN 'checked' ELSE 'manual-review' END AS outcome FROM report""",
)(
    lambda spark, d: native_rules.catalog_coverage(
        table(spark, d, "report").where("row_id % 2 = 0").select(F.struct(F.array(F.concat(F.lit("C-"), F.col("row_id").cast("string"))).alias("cases")).alias("hit")),
        table(spark, d, "report").select(F.concat(F.lit("C-"), F.col("row_id").cast("string")).alias("id"), F.when(F.col("row_id") % 3 == 0, "core").otherwise("both").alias("stack")), "framework",
    )
)
query("manual_queue", "SELECT category, count(*) AS n FROM report WHERE row_id % 4 = 0 GROUP BY 1")(
    lambda spark, d: sinks.manual_queue(sinks.split_manual(findings(spark, d).withColumn("detection", F.struct(F.when(F.col("seq") % 4 == 0, "MANUAL_REVIEW").otherwise("DETERMINISTIC").alias("class"), F.lit(None).cast("array<struct<engine:string,ruleId:string,status:string>>").alias("rules"))))[1])
)
query(
    "report_json",
    """SELECT row_id AS seq, title, severity, coalesce(location.file, '-') AS file, evidence.snippet AS snippet, cvss IS NULL AS unscored FROM report""",
)(
    # written as JSON and read back: nothing is lost, and a missing score is there as null
    lambda spark, d: sinks.finding_json(findings(spark, d)).select(
        "seq", F.get_json_object("json", "$.title").alias("title"), F.get_json_object("json", "$.severity").alias("severity"), F.coalesce(F.get_json_object("json", "$.location.file"), F.lit("-")).alias("file"), F.get_json_object("json", "$.evidence.snippet").alias("snippet"), F.col("json").contains('"cvss":null').alias("unscored"),
    )
)
query(
    "redacted_elements",
    r"""SELECT row_id, regexp_replace(regexp_replace(s, '(?i)(password|pwd|secret|key|credential|token)(\s*=\s*)("[^"]*"|''[^'']*''|[^\s;]+)', '\1\2***REDACTED***', 'g'), '(?i)(password|pwd)=[^;"]+', '\1=***REDACTED***', 'g') AS shown FROM (SELECT row_id, evidence.snippet AS s FROM report)""",
)(lambda spark, d: table(spark, d, "report").select("row_id", rules.redacted(F.col("evidence.snippet")).alias("shown")))
query("dependency_queue_rows", "SELECT row_id AS seq, CASE WHEN row_id % 2 = 0 THEN 'security' ELSE 'maintenance' END AS queue FROM report WHERE category = 'dependency'")(
    # every other dependency finding names an advisory
    lambda spark, d: findings(spark, d).withColumn("advisories", F.when(F.col("seq") % 2 == 0, F.array(F.lit("CVE-2024-1")))).select("seq", R.dependency_queue().alias("queue")).where("queue IS NOT NULL")
)
