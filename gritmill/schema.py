"""The finding record, its enumerations, and bringing any table into its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values, in order of rank.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CONFIDENCES = ("CONFIRMED", "LIKELY", "POSSIBLE", "UNVERIFIED")
PRIORITIES = ("P0", "P1", "P2", "P3")
EFFORTS = ("LOW", "MEDIUM", "HIGH", "UNKNOWN")
RUN_STATUSES = ("EXECUTED", "FAILED", "NOT_AVAILABLE", "NOT_APPLICABLE", "UNVERIFIED")
KINDS = ("dependency", "secret", "sast", "quality", "build", "config", "ai")
CATEGORIES = ("security", "code-quality", "architecture", "performance", "reliability", "configuration", "dependency", "testing", "deployment", "observability", "process")
NOT_SCOREABLE = ("architecture", "testing", "process")
UNKNOWN_RANK = 99

LOCATION = "file string, startLine int, endLine int, class string, method string, additionalLocations array<struct<file string, startLine int, note string>>"
SOURCE = "tool string, sourceFindingId string, status string, note string"
FINDING_DDL = f"""
seq bigint, findingId string, title string, category string, subcategory string, severity string, confidence string, status string,
priority string, effort string,
cvss struct<version string, score double, vector string, severity string, note string>,
cwe array<string>, owasp array<string>, advisories array<string>, tests array<string>, references array<string>,
package struct<name string, installed string, fixed string>,
location struct<{LOCATION}>,
evidence struct<snippet string, language string, toolOutput string, redacted boolean>,
problem string, impact string, recommendation string, attackScenario string, rootCause string, correctedCode string,
dataflow struct<engine string, pathCount int, steps array<struct<file string, startLine int, endLine int, message string, snippet string, role string>>>,
detection struct<class string, rules array<struct<engine string, ruleId string, status string>>>,
sources array<struct<{SOURCE}>>,
correlation struct<mergedFrom array<string>>,
consolidated struct<locations int, rule string>,
suppression struct<active boolean, expired boolean, justification string, expires string>,
baseline struct<state string, firstSeen string>,
diffRelation string
""".replace("\n", " ")

def finding_schema(df: DataFrame) -> T.StructType:
    return df.sparkSession.createDataFrame([], FINDING_DDL).schema


def _shape(c: Column, have: T.DataType | None, want: T.DataType) -> Column:
    if have is None:
        return F.lit(None).cast(want)
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        names = {f.name: f.dataType for f in have.fields}
        made = F.struct(*[_shape(c[f.name] if f.name in names else F.lit(None), names.get(f.name), f.dataType).alias(f.name) for f in want.fields])
        return F.when(c.isNotNull(), made)
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType) and isinstance(want.elementType, T.StructType):
        return F.transform(c, lambda x: _shape(x, have.elementType, want.elementType))
    return c.cast(want)


def conform(df: DataFrame) -> DataFrame:
    """`df` as findings: absent fields null, further columns dropped, structs brought into shape."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[_shape(F.col(f.name) if f.name in have else F.lit(None), have.get(f.name), f.dataType).alias(f.name) for f in finding_schema(df).fields])


def rank(c: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in `order`, from 0; UNKNOWN_RANK for any other value and null."""
    out = None
    for i, v in enumerate(order):
        out = F.when(c == v, i) if out is None else out.when(c == v, i)
    return out.otherwise(UNKNOWN_RANK)
