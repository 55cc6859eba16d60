"""Findings against a stored baseline and against a set of changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritmill.functions.normalise import fingerprint, path_key
from gritmill.schema import SEVERITIES, rank

ENTRY_DDL = "fingerprint string, findingId string, title string, severity string, file string, firstSeen string, suppressed struct<justification string, expires string>"


def baseline_entries(findings: DataFrame, suppressions: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """COR-14: entries of a new baseline, and what is wrong with the suppressions ``(findingId, justification, expires)``.

    A suppression needs a justification, a date if it expires, and a finding of its id; those that lack one are listed as
    ``(findingId, problem)`` and not applied.
    """
    just = F.trim(F.coalesce("justification", F.lit("")))
    expires = F.try_to_timestamp("expires")
    s = suppressions.select("findingId", just.alias("justification"), "expires", (just == "").alias("unexplained"), (F.col("expires").isNotNull() & expires.isNull()).alias("undated"))
    known = findings.select("findingId").distinct().withColumn("known", F.lit(True))
    judged = s.join(known, "findingId", "left").withColumn(
        "problem", F.when(F.col("unexplained"), "no justification").when(F.col("undated"), "expires is not a date").when(F.col("known").isNull(), "no such finding")
    )
    good = judged.where("problem IS NULL").groupBy("findingId").agg(F.struct(F.min("justification").alias("justification"), F.min("expires").alias("expires")).alias("suppressed"))
    entries = findings.select(fingerprint().alias("fingerprint"), "findingId", "title", "severity", path_key(F.col("location.file")).alias("file"), F.lit(now).alias("firstSeen"))
    return entries.join(good, "findingId", "left").select(*[c.split()[0] for c in ("fingerprint", "findingId", "title", "severity", "file", "firstSeen", "suppressed")]), judged.where("problem IS NOT NULL").select("findingId", "problem")


def suppression_state(suppressed: Column, now: Column) -> Column:
    """COR-16: ``active``, ``expired`` or null. Without a date a suppression never expires; at its date it has."""
    return F.when(suppressed.isNotNull(), F.when(F.coalesce(F.try_to_timestamp(suppressed["expires"]) <= now, F.lit(False)), "expired").otherwise("active"))


def classify(findings: DataFrame, entries: DataFrame, now: str, seq: str = "entry_seq") -> DataFrame:
    """COR-15: one row for each finding (NEW or EXISTING) and each entry without one (FIXED).

    Of several entries with one fingerprint the last (by `seq`) describes the findings; all of them are fixed together.
    Columns: fingerprint, findingId, title, severity, file, state, first_seen, status, suppression_state.
    """
    at = F.lit(now).cast("timestamp")
    cur = findings.withColumn("fingerprint", fingerprint())
    last = entries.groupBy("fingerprint").agg(F.max_by(F.struct("firstSeen", "suppressed"), seq).alias("e"))
    placed = cur.join(last, "fingerprint", "left")
    state = suppression_state(F.col("e.suppressed"), at)
    out = placed.select(
        "fingerprint", "findingId", "title", "severity", path_key(F.col("location.file")).alias("file"),
        F.when(F.col("e").isNull(), "NEW").otherwise("EXISTING").alias("state"), F.col("e.firstSeen").alias("first_seen"),
        F.when(state == "active", "SUPPRESSED").when(state == "expired", "OPEN").otherwise(F.col("status")).alias("status"), state.alias("suppression_state"),
    )
    gone = entries.join(cur.select("fingerprint").distinct(), "fingerprint", "left_anti")
    fixed = gone.select("fingerprint", "findingId", "title", "severity", "file", F.lit("FIXED").alias("state"), F.col("firstSeen").alias("first_seen"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("suppression_state"))
    return out.unionByName(fixed)


def gate(classified: DataFrame, threshold: str) -> DataFrame:
    """COR-17: one row ``(fail, new_offenders, expired)``: new findings at or above `threshold`, else expired suppressions."""
    if threshold.upper() not in SEVERITIES:
        raise ValueError(f"unknown severity {threshold}")
    cut = SEVERITIES.index(threshold.upper())
    new = F.count_if((F.col("state") == "NEW") & (rank(F.col("severity"), SEVERITIES) <= cut))
    expired = F.count_distinct(F.when(F.col("suppression_state") == "expired", F.col("fingerprint")))
    return classified.agg(((new > 0) | (expired > 0)).alias("fail"), new.alias("new_offenders"), expired.alias("expired"))


def severity_gate(findings: DataFrame, threshold: str) -> bool:
    """Whether any finding is at or above `threshold`; stops at the first."""
    return not findings.where(rank(F.col("severity"), SEVERITIES) <= SEVERITIES.index(threshold.upper())).limit(1).isEmpty()


def diff_partition(findings: DataFrame, changed: DataFrame, context: bool = False) -> DataFrame:
    """COR-12: ``diffRelation`` primary, context or outside, and ``in_diff``.

    `changed` holds paths. A finding is primary by its own file, else context by any of its further places. Each finding's
    paths are looked up as rows, so no list of all changed files travels with the data.
    """
    paths = changed.select(path_key(F.col("path")).alias("p")).distinct()
    keyed = findings.withColumn("__own", path_key(F.col("location.file")))
    own = keyed.join(paths.withColumnRenamed("p", "__own").withColumn("__hit", F.lit(True)), "__own", "left")
    more = findings.select("seq", F.explode("location.additionalLocations.file").alias("f")).select("seq", path_key(F.col("f")).alias("p"))
    near = more.join(paths, "p", "left_semi").select("seq").distinct().withColumn("__near", F.lit(True))
    rel = F.when(F.col("__hit"), "primary").when(F.col("__near"), "context").otherwise("outside")
    out = own.join(near, "seq", "left").withColumn("diffRelation", rel).drop("__own", "__hit", "__near")
    return out.withColumn("in_diff", (F.col("diffRelation") == "primary") | ((F.col("diffRelation") == "context") & F.lit(context)))


def first_by_key(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in `order` (SC-04, SCAN-13): ranks before the exchange keep one row a key and partition."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
