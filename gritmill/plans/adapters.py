"""Adapters without a driver table of their own: each row of `report` is written as a delivery of the format and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritmill.plans.registry import query
from gritmill.session import table
from gritmill.sources import scanners as S
from gritmill.sources.sarif import parse_documents

_SEVERITY = "CASE WHEN upper({0}) IN ('CRITICAL','BLOCKER') THEN 'CRITICAL' WHEN upper({0}) IN ('HIGH','ERROR') THEN 'HIGH' WHEN upper({0}) IN ('MEDIUM','MODERATE','WARNING','MINOR','MAJOR') THEN 'MEDIUM' WHEN upper({0}) IN ('LOW','NOTE','INFO','INFORMATIONAL') THEN 'LOW' WHEN upper({0}) IN ('NONE','UNKNOWN') THEN 'INFO' ELSE 'MEDIUM' END"
_ROWS = "WITH r AS (SELECT row_id AS i, coalesce(location.file, 'a.cs') AS file, coalesce(subcategory, '') AS sub, * FROM report)"


def _deliveries(spark: SparkSession, sf_dir: str, raw: Column) -> DataFrame:
    return table(spark, sf_dir, "report").withColumnRenamed("row_id", "i").select("i", raw.alias("raw"))


def _row() -> tuple[Column, Column]:
    """A row's id, and its file or a stand-in."""
    return F.col("i"), F.coalesce("location.file", F.lit("a.cs"))


def _obj(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _osv(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, file = _row()
    vid = F.concat(F.lit("CVE-2024-"), i.cast("string"))
    hit = _obj(packageId=F.coalesce("subcategory", F.lit("")), version=F.concat(F.lit("1."), (i % 5).cast("string")), file=file, line=(i % 100).cast("int"), vulnId=vid)
    events = F.array(F.create_map(F.lit("introduced"), F.lit("0")), F.create_map(F.lit("fixed"), F.lit("2.1")))
    # without a fix, and without the advisory itself
    affected = F.when(i % 2 == 0, F.array(_obj(ranges=F.array(_obj(type=F.lit("ECOSYSTEM"), events=events)))))
    vuln = _obj(id=F.when(i % 3 == 0, F.lit("OTHER")).otherwise(vid), summary=F.col("title"), database_specific=_obj(severity=F.col("severity")), affected=affected)
    raw = F.to_json(_obj(packages=F.array(hit, hit), vulns=F.array(vuln)))
    f = S.osv_findings(_deliveries(spark, sf_dir, raw), ["i"])
    return f.select(F.col("i").alias("seq"), F.col("__no").alias("no"), "title", "severity", F.col("package.fixed").alias("fixed"), F.col("location.file").alias("file"), F.col("location.startLine").alias("line"), F.get("advisories", F.lit(0)).alias("advisory"))


query(
    "scan_osv",
    _ROWS
    + """ SELECT i AS seq, CAST(no AS INTEGER) AS no, sub || ' 1.' || (i % 5) || ': CVE-2024-' || i AS title, CASE WHEN i % 3 <> 0 AND severity IN ('CRITICAL', 'HIGH', 'LOW') THEN severity ELSE 'MEDIUM' END AS severity,
CASE WHEN i % 3 <> 0 AND i % 2 = 0 THEN '2.1' END AS fixed, file, CAST(i % 100 AS INTEGER) AS line, 'CVE-2024-' || i AS advisory FROM r, (VALUES (0), (1)) AS n(no)""",
)(_osv)


def _sonar(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, file = _row()
    rule, comp = F.concat(F.lit("csharp:S"), (i % 9000).cast("string")), F.concat(F.lit("key:"), file)
    kind = F.when(i % 4 == 0, "VULNERABILITY").when(i % 4 == 1, "BUG").when(i % 4 == 2, "SECURITY_HOTSPOT").otherwise("CODE_SMELL")
    line = (i % 100 + 1).cast("int")
    small = _obj(rule=rule, severity=F.col("severity"), type=kind, component=comp, line=line, message=F.col("title"))
    large = _obj(RuleId=rule, Severity=F.col("severity"), Type=kind, Component=comp, Line=line, Message=F.col("title"))
    bare = F.array(_obj(ruleKey=rule, severity=F.col("severity"), type=kind, component=comp, textRange=_obj(startLine=line), message=F.col("title")))
    raw = F.when(i % 3 == 0, F.to_json(_obj(issues=F.array(small)))).when(i % 3 == 1, F.to_json(_obj(Issues=F.array(large)))).otherwise(F.to_json(bare))
    f = S.sonarqube_findings(_deliveries(spark, sf_dir, raw), ["i"])
    return f.select(F.col("i").alias("seq"), "title", "category", "subcategory", "severity", "confidence", F.col("location.file").alias("file"), F.col("location.startLine").alias("line"))


query(
    "scan_sonarqube",
    _ROWS
    + f""" SELECT i AS seq, left(coalesce(nullif(title, ''), 'S' || (i % 9000)), 200) AS title, CASE i % 4 WHEN 1 THEN 'reliability' WHEN 3 THEN 'code-quality' ELSE 'security' END AS category, 'S' || (i % 9000) AS subcategory,
{_SEVERITY.format("coalesce(nullif(severity, ''), 'MAJOR')")} AS severity, CASE WHEN i % 4 = 2 THEN 'POSSIBLE' ELSE 'LIKELY' END AS confidence, file, CAST(i % 100 + 1 AS INTEGER) AS line FROM r""",
)(_sonar)


def _semgrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, file = _row()
    region = _obj(startLine=(i % 100 + 1).cast("int"))
    place = _obj(physicalLocation=_obj(artifactLocation=_obj(uri=F.concat(F.lit("src/"), i.cast("string"), F.lit(".cs"))), region=region))
    level = F.when(i % 3 == 0, "error").when(i % 3 == 1, "warning").otherwise("note")
    result = _obj(ruleId=F.concat(F.lit("rule-"), (i % 40).cast("string")), level=level, message=_obj(text=F.concat(F.lit("found "), i.cast("string"))), locations=F.array(place))
    tool = _obj(driver=_obj(name=F.lit("semgrep")))
    raw = F.to_json(_obj(version=F.lit("2.1.0"), runs=F.array(_obj(tool=tool, results=F.array(result, result)))))
    f = S.semgrep_findings(parse_documents(_deliveries(spark, sf_dir, raw), ["i"], "raw"), ["i"])
    return f.select(F.col("i").alias("seq"), "subcategory", "severity", "status", F.col("location.file").alias("file"), F.col("location.startLine").alias("line"))


query(
    "scan_semgrep",
    """SELECT row_id AS seq, 'rule-' || (row_id % 40) AS subcategory, CASE row_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'OPEN' AS status, 'src/' || row_id || '.cs' AS file, CAST(row_id % 100 + 1 AS INTEGER) AS line FROM report, (VALUES (0), (1)) AS n(no)""",
)(_semgrep)


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, file = _row()
    item = _obj(title=F.col("title"), file=file, startLine=(i % 50).cast("int"), category=F.col("category"), severity=F.col("severity"), cwe=F.array(F.lit("CWE-79"), F.lit("79")), snippet=F.lit("x"), problem=F.lit("p"))
    said = F.concat(F.lit("Here is what I found:\n```json\n"), F.to_json(F.array(item)), F.lit("\n```"))
    raw = F.when(i % 2 == 0, F.to_json(_obj(content=F.array(_obj(text=said))))).otherwise(F.to_json(_obj(choices=F.array(_obj(message=_obj(content=said))))))
    f = S.ai_findings(_deliveries(spark, sf_dir, raw), ["i"])
    return f.select(F.col("i").alias("seq"), "title", "category", "severity", "confidence", "status", F.array_join("cwe", ",").alias("cwe"), F.col("location.file").alias("file"), F.col("location.startLine").alias("line"))


query(
    "scan_model_review",
    _ROWS
    + f""" SELECT i AS seq, left(title, 200) AS title, CASE WHEN category IN ({", ".join(f"'{c}'" for c in S.AI_CATEGORIES)}) THEN category ELSE 'security' END AS category, {_SEVERITY.format("severity")} AS severity,
'POSSIBLE' AS confidence, 'UNVERIFIED' AS status, 'CWE-79' AS cwe, replace(file, chr(92), '/') AS file, CAST(i % 50 AS INTEGER) AS line FROM r WHERE title <> '' AND file <> ''""",
)(_model)
