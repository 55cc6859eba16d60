"""Findings algebra over `report`: keys, order, families, baseline, diff, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritmill.functions import normalise as N
from gritmill.operators import baseline as B
from gritmill.operators import correlate as C
from gritmill.operators import rollups as R
from gritmill.plans.registry import query
from gritmill.schema import conform
from gritmill.session import table

RANKS = "CASE {c} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 99 END"
CONF = "CASE {c} WHEN 'CONFIRMED' THEN 0 WHEN 'LIKELY' THEN 1 WHEN 'POSSIBLE' THEN 2 WHEN 'UNVERIFIED' THEN 3 ELSE 99 END"
PATH = r"lower(regexp_replace(replace(coalesce({c}, ''), '\', '/'), '^\./', ''))"
SNIPPET = r"array_to_string(list_filter(list_transform(string_split(replace(coalesce(evidence.snippet, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{00A0}\x{0085}\p{Z}]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"
FP = f"sha256(coalesce(nullif(subcategory, ''), title, 'undefined') || chr(0) || {PATH.format(c='location.file')} || chr(0) || {SNIPPET})"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`report` as findings; its row id is the input order."""
    return conform(table(spark, sf_dir, "report").withColumnRenamed("row_id", "seq"))


def _of(f):
    return lambda spark, sf_dir: f(findings(spark, sf_dir))


query("severity_totals", "SELECT s.severity, count(r.row_id) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity) LEFT JOIN report r ON r.severity = s.severity GROUP BY 1")(_of(R.severity_totals))
query(
    "finding_counts",
    "SELECT 'category' AS dimension, category AS value, count(*) AS n FROM report GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM report GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM report GROUP BY 2",
)(_of(lambda f: R.counts_by(f, "category", "confidence", "status")))
query("tool_pivot", "SELECT s.tool, count(*) FILTER (s.status = 'REPORTED') AS reported, count(*) FILTER (s.status = 'MISSED') AS missed FROM (SELECT unnest(sources) AS s FROM report) GROUP BY 1")(_of(R.tool_pivot))
query("score_summary", "SELECT count(*) FILTER (cvss IS NOT NULL) AS scored, count(*) FILTER (cvss IS NULL) AS not_scored, max(cvss.score) AS max_score FROM report")(_of(R.score_summary))
query("overall_risk", f"SELECT CASE min({RANKS.format(c='severity')}) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM report")(_of(R.overall_risk))
query(
    "roadmap",
    "SELECT coalesce(nullif(priority, ''), CASE severity WHEN 'CRITICAL' THEN 'P0' WHEN 'HIGH' THEN 'P1' WHEN 'MEDIUM' THEN 'P2' ELSE 'P3' END) AS priority, count(*) AS n FROM report GROUP BY 1",
)(_of(R.roadmap))
query(
    "multi_tool_confirmed",
    "WITH r AS (SELECT row_id AS seq, findingId, list_filter(coalesce(sources, []), lambda s: s.status = 'REPORTED') AS l FROM report) SELECT seq, findingId, len(l) AS reported_entries, len(list_distinct(list_transform(l, lambda s: coalesce(s.tool, chr(0))))) AS distinct_tools FROM r WHERE len(l) > 1",
)(_of(R.multi_tool))
query("false_negatives", "SELECT s.tool, count(*) AS n FROM (SELECT unnest(sources) AS s FROM report) WHERE s.status IN ('MISSED', 'FALSE_NEGATIVE') GROUP BY 1")(_of(R.false_negatives))
query(
    "top_findings",
    f"SELECT row_id AS seq, findingId, severity, cvss.score AS score FROM report ORDER BY {RANKS.format(c='severity')}, coalesce(cvss.score, -1) DESC, {CONF.format(c='confidence')}, coalesce(findingId, ''), row_id LIMIT 10",
)(_of(lambda f: R.top_findings(f).select("seq", "findingId", "severity", F.col("cvss.score").alias("score"))))
query("dependency_queues", "SELECT 'maintenance' AS queue, count(*) AS n FROM report WHERE category = 'dependency' HAVING count(*) > 0")(_of(lambda f: f.groupBy(R.dependency_queue().alias("queue")).agg(F.count("*").alias("n")).where("queue IS NOT NULL")))
query("duplicate_ids", "SELECT findingId, count(*) AS n FROM report WHERE findingId IS NOT NULL GROUP BY 1 HAVING count(*) > 1")(_of(R.duplicate_ids))
query(
    "contract_violations",
    r"""
WITH f AS (SELECT *, unnest([
  CASE WHEN title IS NULL OR trim(title) = '' THEN 'title|missing' END,
  CASE WHEN category IS NULL OR category NOT IN ('security','code-quality','architecture','performance','reliability','configuration','dependency','testing','deployment','observability','process') THEN 'category|not in the list' END,
  CASE WHEN severity IS NULL OR severity NOT IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') THEN 'severity|not in the list' END,
  CASE WHEN confidence IS NULL OR confidence NOT IN ('CONFIRMED','LIKELY','POSSIBLE','UNVERIFIED') THEN 'confidence|not in the list' END,
  CASE WHEN location IS NULL OR location.file IS NULL OR trim(location.file) = '' THEN 'location.file|missing' END,
  CASE WHEN sources IS NULL OR len(sources) = 0 THEN 'sources|empty' END,
  CASE WHEN cvss.vector IS NOT NULL AND NOT regexp_matches(cvss.vector, '^CVSS:3\.1/AV:[NALP]/AC:[LH]/PR:[NLH]/UI:[NR]/S:[UC]/C:[NLH]/I:[NLH]/A:[NLH]$') THEN 'cvss.vector|malformed' END,
  CASE WHEN category IN ('architecture','testing','process') AND cvss IS NOT NULL THEN 'cvss|category has no score' END,
  CASE WHEN location.startLine < 1 THEN 'location.startLine|below 1' END]) AS v FROM report)
SELECT row_id AS seq, findingId, string_split(v, '|')[1] AS path, string_split(v, '|')[2] AS problem FROM f WHERE v IS NOT NULL
""",
)(_of(R.violations))
query("snippet_fingerprint", f"SELECT row_id AS seq, {FP} AS fingerprint FROM report")(_of(lambda f: f.select("seq", N.fingerprint().alias("fingerprint"))))
query("path_normalise", f"SELECT row_id AS seq, {PATH.format(c='location.file')} AS path FROM report")(_of(lambda f: f.select("seq", N.path_key(F.col("location.file")).alias("path"))))
query(
    "cvss_bands",
    "SELECT row_id AS seq, CASE WHEN coalesce(cvss.score, 0) <= 0 THEN 'INFO' WHEN cvss.score >= 9 THEN 'CRITICAL' WHEN cvss.score >= 7 THEN 'HIGH' WHEN cvss.score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS band, floor(cvss.score * 10 + 0.5) / 10 AS score FROM report",
)(_of(lambda f: f.select("seq", N.severity_of_score(F.col("cvss.score")).alias("band"), N.one_decimal(F.col("cvss.score")).alias("score"))))
query(
    "severity_names",
    "SELECT row_id, CASE WHEN upper(severity) IN ('CRITICAL','BLOCKER') THEN 'CRITICAL' WHEN upper(severity) IN ('HIGH','ERROR') THEN 'HIGH' WHEN upper(severity) IN ('MEDIUM','MODERATE','WARNING','MINOR','MAJOR') THEN 'MEDIUM' WHEN upper(severity) IN ('LOW','NOTE','INFO','INFORMATIONAL') THEN 'LOW' WHEN upper(severity) IN ('NONE','UNKNOWN') THEN 'INFO' ELSE 'MEDIUM' END AS severity FROM report_snapshot",
)(lambda spark, d: table(spark, d, "report_snapshot").select("row_id", N.severity_name(F.col("severity")).alias("severity")))

_VALUES = ", ".join(f"('{r}', '{c}')" for r, c in C.CONCEPT_OF.items())
KEYS_SQL = rf"""
WITH known(rule, concept) AS (VALUES {_VALUES}),
c AS (SELECT row_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM (SELECT row_id, list_concat(list_concat([subcategory], list_transform(coalesce(sources, []), lambda s: s.sourceFindingId)), coalesce(cwe, [])) AS ids FROM report)),
con AS (SELECT row_id, arg_min(concept, i) AS concept FROM c JOIN known ON rule = regexp_replace(upper(id), '^[A-Z]+-DOTNET-', 'DOTNET-') GROUP BY 1),
r AS (SELECT row_id AS seq, con.concept, {PATH.format(c='location.file')} AS f, coalesce(location.startLine, 0) AS l, subcategory FROM report LEFT JOIN con USING (row_id))
SELECT seq, concept, 'concept:' || concept || ':' || f || ':' || (l // 4) AS k FROM r WHERE concept IS NOT NULL AND f <> ''
UNION ALL SELECT seq, concept, 'conceptfile:' || concept || ':' || f FROM r WHERE concept IS NOT NULL AND f <> ''
UNION ALL SELECT seq, concept, 'rule:' || upper(subcategory) || ':' || f || ':' || l FROM r WHERE f <> '' AND subcategory <> ''
"""
query("correlate_keys", KEYS_SQL)(_of(lambda f: C.with_keys(f).select("seq", "concept", F.explode("keys").alias("k"))))


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`report` with three files a repository, so that findings meet: the repository stands in the path."""
    r = findings(spark, sf_dir).withColumn("__i", F.col("seq"))
    repo = table(spark, sf_dir, "report").select(F.col("row_id").alias("__i"), F.coalesce("repo", F.lit("")).alias("__repo"))
    file = F.concat("__repo", F.lit("/src/"), (F.col("__i") % 3).cast("string"), F.lit(".cs"))
    where = F.col("location").withField("file", file).withField("startLine", (F.col("__i") % 30).cast("int"))
    return r.join(repo, "__i").withColumn("location", where).drop("__i", "__repo")


_CROWDED = (
    "rep AS (SELECT * REPLACE (CASE WHEN location IS NOT NULL THEN {'file': coalesce(repo, '') || '/src/' || (row_id % 3) || '.cs', 'startLine': CAST(row_id % 30 AS INTEGER)} END AS location) FROM report)"
)
#: The merge as a fold over the findings in order; the state maps each key to the finding that claimed it first.
_FOLD = f"""
WITH RECURSIVE {_CROWDED},
keys AS ({KEYS_SQL.replace("FROM report", "FROM rep")}),
ks AS (SELECT row_id AS seq, row_number() OVER (ORDER BY row_id) AS i, coalesce(ks, []) AS ks FROM rep LEFT JOIN (SELECT seq, list(k ORDER BY CASE WHEN k LIKE 'concept:%' THEN 0 WHEN k LIKE 'conceptfile:%' THEN 1 ELSE 2 END) AS ks FROM keys GROUP BY seq) ON seq = row_id),
fold AS (
  SELECT CAST(0 AS BIGINT) AS i, MAP(CAST([] AS VARCHAR[]), CAST([] AS BIGINT[])) AS own, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS target
  UNION ALL
  SELECT i, map_concat(MAP(list_distinct(ks), list_transform(list_distinct(ks), lambda x: t)), own), seq, t
  FROM (SELECT k.i, k.seq, k.ks, fold.own, coalesce(list_filter(list_transform(k.ks, lambda x: fold.own[x]), lambda v: v IS NOT NULL)[1], k.seq) AS t FROM fold JOIN ks k ON k.i = fold.i + 1)
)
SELECT target AS seq, CAST(count(*) - 1 AS INTEGER) AS merged, arg_min(severity, [{RANKS.format(c="severity")}, row_id]) AS severity, arg_min(confidence, [{CONF.format(c="confidence")}, row_id]) AS confidence FROM fold JOIN rep ON rep.row_id = fold.seq GROUP BY target
"""
query("correlate_greedy", _FOLD)(lambda spark, d: C.merged_findings(crowded(spark, d)).select("seq", "merged", "severity", "confidence"))


query(
    "correlation_stats",
    _FOLD[: _FOLD.rindex("SELECT target AS seq")].rstrip()
    + """,
e AS (SELECT target, row_id, unnest(sources) AS s, generate_subscripts(sources, 1) AS k FROM fold JOIN rep ON rep.row_id = fold.seq),
u AS (SELECT * FROM e QUALIFY row_id = target OR row_number() OVER (PARTITION BY target, s.tool, coalesce(s.sourceFindingId, '') ORDER BY row_id, k) = 1),
c AS (SELECT target, count(*) AS n, len(list_distinct(list(coalesce(s.tool, chr(0))))) AS tools FROM u WHERE s.status = 'REPORTED' GROUP BY 1),
t AS (SELECT count(*) AS n, count(DISTINCT target) AS kept FROM fold WHERE target IS NOT NULL)
SELECT n AS inputFindings, kept AS canonicalFindings, n - kept AS mergedAway, round((n - kept) / n, 3) AS dedupRatio, (SELECT count(*) FROM c WHERE c.n > 1) AS multiToolConfirmed, (SELECT count(*) FROM c WHERE tools > 1) AS distinctToolsConfirmed FROM t
""",
)(lambda spark, d: C.correlation_stats(C.merged_findings(crowded(spark, d))))


query(
    "correlate_by_rule",
    rf"""
WITH g AS (SELECT upper(subcategory) || ':' || {PATH.format(c='location.file')} AS k, * FROM report WHERE subcategory <> '')
SELECT k, min(row_id) AS first_seq, count(*) AS n, min({RANKS.format(c='severity')}) AS severity_rank, min({CONF.format(c='confidence')}) AS confidence_rank, max(cvss.score) AS max_score, max(length(coalesce(problem, ''))) AS longest_problem FROM g GROUP BY 1
""",
)(
    _of(
        lambda f: f.where("subcategory <> ''").groupBy(F.concat(F.upper("subcategory"), F.lit(":"), N.path_key(F.col("location.file"))).alias("k")).agg(
            F.min("seq").alias("first_seq"), F.count("*").alias("n"), F.min(C.rank(F.col("severity"), C.SEVERITIES)).alias("severity_rank"), F.min(C.rank(F.col("confidence"), C.CONFIDENCES)).alias("confidence_rank"),
            F.max("cvss.score").alias("max_score"), F.max(F.length(F.coalesce("problem", F.lit("")))).alias("longest_problem"),
        )
    )
)

_TOOLS = ["gitleaks", "osv", "roslyn", "semgrep", "snyk", "sonarqube", "trivy"]
query(
    "missed_attribution",
    f"SELECT row_id AS seq, t AS tool FROM report, (SELECT unnest({_TOOLS}) AS t) WHERE NOT list_contains(list_transform(coalesce(sources, []), lambda s: coalesce(s.tool, '')), t)",
)(_of(lambda f: C.attribute_missed(f.withColumn("__n", F.size(F.coalesce("sources", F.array().cast("array<struct<tool string, sourceFindingId string, status string, note string>>")))), _TOOLS).select("seq", F.explode(F.slice("sources", F.col("__n") + 1, F.lit(99))).alias("s")).select("seq", "s.tool")))
query(
    "finding_ids",
    rf"""
WITH known(rule, concept) AS (VALUES {_VALUES}),
c AS (SELECT row_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM (SELECT row_id, list_concat(list_concat([subcategory], list_transform(coalesce(sources, []), lambda s: s.sourceFindingId)), coalesce(cwe, [])) AS ids FROM report)),
con AS (SELECT row_id, arg_min(concept, i) AS concept FROM c JOIN known ON rule = regexp_replace(upper(id), '^[A-Z]+-DOTNET-', 'DOTNET-') GROUP BY 1),
p AS (SELECT r.*, CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.PREFIX_OF_CATEGORY.items())} ELSE CASE concept {' '.join(f"WHEN '{n}' THEN '{k}'" for k, v in C.PREFIX_OF_CONCEPT.items() for n in v)} ELSE 'SEC-GEN' END END AS pre FROM report r LEFT JOIN con USING (row_id)),
n AS (SELECT row_id AS seq, pre, row_number() OVER (PARTITION BY pre ORDER BY {RANKS.format(c='severity')}, coalesce(cvss.score, 0) DESC, {CONF.format(c='confidence')}, {PATH.format(c='location.file')}, coalesce(location.startLine, 0), row_id) AS no FROM p)
SELECT seq, pre || '-' || CASE WHEN no > 999 THEN CAST(no AS VARCHAR) ELSE lpad(CAST(no AS VARCHAR), 3, '0') END AS findingId FROM n
""",
)(_of(lambda f: C.assign_ids(f).select("seq", "findingId")))
query(
    "rule_families",
    rf"""
WITH k AS (SELECT *, CASE WHEN severity = 'INFO' OR category = 'dependency' THEN 'single:' || row_id ELSE lower(coalesce(nullif(sources[1].tool, ''), 'unknown')) || ':' || coalesce(nullif(subcategory, ''), title, 'undefined') END AS fam FROM report),
g AS (SELECT fam, min(row_id) AS seq, count(*) AS n, min({RANKS.format(c='severity')}) AS sev FROM k GROUP BY 1)
SELECT g.seq, CASE WHEN n > 1 THEN least(n, 501) END AS locations, CASE WHEN n > 1 AND sev < 99 THEN (['CRITICAL','HIGH','MEDIUM','LOW','INFO'])[sev + 1] ELSE k.severity END AS severity FROM g JOIN k ON k.row_id = g.seq
""",
)(_of(lambda f: C.consolidate(f).select("seq", F.col("consolidated.locations").alias("locations"), "severity")))


def _entries(f: DataFrame) -> DataFrame:
    """The first load as a baseline: its findings with the suppressions their status tells of."""
    e = f.select(N.fingerprint().alias("fingerprint"), "findingId", "title", "severity", N.path_key(F.col("location.file")).alias("file"), F.lit("2025-01-01").alias("firstSeen"), F.col("seq").alias("entry_seq"), "status")
    supp = F.when(F.col("status") == "ACCEPTED_RISK", F.struct(F.lit("accepted").alias("justification"), F.when(F.col("entry_seq") % 2 == 0, "2025-06-01").alias("expires")))
    return e.withColumn("suppressed", supp).drop("status")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "report").withColumnRenamed("row_id", "seq")
    return B.classify(conform(raw.where("batch_id >= 1")), _entries(conform(raw.where("batch_id = 0"))), "2025-07-01T00:00:00Z")


CLASSIFIED_SQL = f"""
f AS (SELECT *, {FP} AS fingerprint, {PATH.format(c='location.file')} AS pfile FROM report),
cur AS (SELECT * FROM f WHERE batch_id >= 1),
ent AS (SELECT *, CASE WHEN status = 'ACCEPTED_RISK' THEN CASE WHEN row_id % 2 = 0 THEN 'expired' ELSE 'active' END END AS st FROM f WHERE batch_id = 0),
last AS (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY row_id DESC) = 1),
cls AS (SELECT cur.fingerprint, cur.findingId, cur.title, cur.severity, cur.pfile AS file, CASE WHEN last.fingerprint IS NULL THEN 'NEW' ELSE 'EXISTING' END AS state, CASE WHEN last.fingerprint IS NOT NULL THEN '2025-01-01' END AS first_seen,
  CASE last.st WHEN 'active' THEN 'SUPPRESSED' WHEN 'expired' THEN 'OPEN' ELSE cur.status END AS status, last.st AS suppression_state FROM cur LEFT JOIN last ON last.fingerprint = cur.fingerprint
  UNION ALL SELECT fingerprint, findingId, title, severity, pfile, 'FIXED', '2025-01-01', NULL, NULL FROM ent WHERE fingerprint NOT IN (SELECT fingerprint FROM cur))
"""
query("baseline_classify", f"WITH {CLASSIFIED_SQL} SELECT * FROM cls")(_classified)
query(
    "baseline_gate",
    f"WITH {CLASSIFIED_SQL} SELECT (count(*) FILTER (state = 'NEW' AND severity IN ('CRITICAL', 'HIGH')) > 0 OR count(*) FILTER (suppression_state = 'expired') > 0) AS fail, count(*) FILTER (state = 'NEW' AND severity IN ('CRITICAL', 'HIGH')) AS new_offenders, count(DISTINCT CASE WHEN suppression_state = 'expired' THEN fingerprint END) AS expired FROM cls",
)(lambda spark, d: B.gate(_classified(spark, d), "HIGH"))


@query(
    "diff_partition",
    f"""
WITH changed AS (SELECT DISTINCT {PATH.format(c='location.file')} AS p FROM report WHERE batch_id = 9)
SELECT row_id AS seq, CASE WHEN {PATH.format(c='location.file')} IN (SELECT p FROM changed) THEN 'primary' ELSE 'outside' END AS diffRelation FROM report
""",
)
def diff_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in files that the last batch touched."""
    changed = table(spark, sf_dir, "report").where("batch_id = 9").select(F.col("location.file").alias("path"))
    return B.diff_partition(findings(spark, sf_dir), changed).select("seq", "diffRelation")


query(
    "first_declared",
    "SELECT row_id AS seq, repo FROM report WHERE repo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(repo) ORDER BY received_at, row_id) = 1",
)(lambda spark, d: B.first_by_key(table(spark, d, "report").where("repo IS NOT NULL"), [F.lower("repo")], [F.col("received_at"), F.col("row_id")]).select(F.col("row_id").alias("seq"), "repo"))
