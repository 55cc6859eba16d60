"""SARIF 2.1.0 as findings: one schema, one explode, column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritmill.functions.normalise import advisory_ids, cwe_ids, one_decimal, severity_name, severity_of_score, uri_path
from gritmill.schema import _shape, conform

_TEXT = "struct<text:string, markdown:string>"
_PROPS = "struct<tags:array<string>, precision:string, `security-severity`:string, severity:string, cwe:string, cvss:string, cvssV3_vector:string, cvss_vector:string>"
_LOC = f"struct<physicalLocation:struct<artifactLocation:struct<uri:string>, region:struct<startLine:int, endLine:int, snippet:struct<text:string, rendered:string>>>, message:{_TEXT}>"
_RULE = f"struct<id:string, name:string, shortDescription:{_TEXT}, fullDescription:{_TEXT}, help:{_TEXT}, helpUri:string, defaultConfiguration:struct<level:string>, properties:{_PROPS}, relationships:array<struct<target:struct<id:string, guid:string>>>>"
_RESULT = f"struct<ruleId:string, level:string, message:{_TEXT}, locations:array<{_LOC}>, relatedLocations:array<{_LOC}>, codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<location:{_LOC}>>>>>>, suppressions:array<struct<kind:string>>, partialFingerprints:map<string,string>, properties:{_PROPS}>"
RUNS_DDL = f"array<struct<tool:struct<driver:struct<name:string, version:string, semanticVersion:string, rules:array<{_RULE}>>, extensions:array<struct<rules:array<{_RULE}>>>>, results:array<{_RESULT}>>>"
SARIF_DDL = f"struct<version:string, runs:{RUNS_DDL}>"
MAX_STEPS, HALF_STEPS = 40, 20


def parse_documents(raw: DataFrame, ids: list[str], text: str = "raw") -> DataFrame:
    """`ids` and ``runs`` of SARIF texts: one document, a list of documents, or documents under ``logs``. Junk gives no runs."""
    ok = F.try_parse_json(text)
    one = F.from_json(text, f"struct<runs:{RUNS_DDL}, logs:array<{SARIF_DDL}>>")
    many = F.from_json(text, f"array<{SARIF_DDL}>")
    runs = F.when(F.col(text).rlike(r"^\s*\["), F.flatten(F.transform(F.filter(many, lambda d: d.isNotNull() & d["runs"].isNotNull()), lambda d: d["runs"]))).otherwise(
        F.coalesce(F.flatten(F.transform(F.filter(one["logs"], lambda d: d.isNotNull() & d["runs"].isNotNull()), lambda d: d["runs"])), one["runs"])
    )
    return raw.select(*ids, F.when(ok.isNotNull(), runs).alias("runs"))


def _said(c: Column) -> Column:
    return F.coalesce(F.when(c["text"] != "", c["text"]), F.when(c["markdown"] != "", c["markdown"]), F.lit(""))


def _full(c: Column) -> Column:
    return F.when(c != "", c)


def _plain(lines: Column) -> Column:
    return F.trim(lines)


def _places(r: Column) -> Column:
    empty = F.array().cast(f"array<{_LOC}>")
    more = F.concat(F.slice(F.coalesce(r["locations"], empty), 2, 1 << 30), F.coalesce(r["relatedLocations"], empty))
    made = F.transform(more, lambda x: F.struct(uri_path(x["physicalLocation"]["artifactLocation"]["uri"]).alias("file"), x["physicalLocation"]["region"]["startLine"].alias("startLine"), _full(_said(x["message"])).alias("note")))
    kept = F.filter(made, lambda x: x["file"] != "")
    return F.when(F.size(kept) > 0, kept)


def _dataflow(r: Column, engine: str) -> Column:
    """NORM-03: the shortest flow, the first of equals; roles by position; long flows keep both ends."""
    flows = F.flatten(F.transform(F.filter(r["codeFlows"], lambda c: c["threadFlows"].isNotNull()), lambda c: c["threadFlows"]))
    full = F.filter(F.transform(flows, lambda t: t["locations"]), lambda s: s.isNotNull() & (F.size(s) > 0))
    ordered = F.array_sort(F.transform(full, lambda s, i: F.struct(F.size(s).alias("n"), i.alias("i"))))
    best = F.try_element_at(full, F.get(ordered, F.lit(0))["i"] + 1)
    n = F.size(best)

    def step(x: Column, i: Column) -> Column:
        p = x["location"]["physicalLocation"]
        role = F.when(n == 1, "sink").when(i == 0, "source").when(i == n - 1, "sink").otherwise("step")
        return F.struct(
            _full(uri_path(p["artifactLocation"]["uri"])).alias("file"), p["region"]["startLine"].alias("startLine"), p["region"]["endLine"].alias("endLine"),
            _full(F.trim(_said(x["location"]["message"]))).alias("message"), _full(F.trim(F.coalesce(_full(p["region"]["snippet"]["text"]), p["region"]["snippet"]["rendered"], F.lit("")))).alias("snippet"), role.alias("role"),
        )

    steps = F.transform(best, step)
    note = F.concat(F.lit(" [... "), (n - MAX_STEPS).cast("string"), F.lit(" intermediate steps omitted ...]"))
    head = F.transform(F.slice(steps, 1, HALF_STEPS), lambda s, i: F.when(i == HALF_STEPS - 1, s.withField("message", F.concat(F.coalesce(s["message"], F.lit("")), note))).otherwise(s))
    cut = F.when(n > MAX_STEPS, F.concat(head, F.slice(steps, -HALF_STEPS, HALF_STEPS))).otherwise(steps)
    return F.when(F.size(full) > 0, F.struct(F.lit(engine).alias("engine"), F.size(flows).alias("pathCount"), cut.alias("steps")))


def sarif_findings(docs: DataFrame, tool: str, kind: str, order: list[str], runs: str = "runs", keep: list[str] | None = None) -> DataFrame:
    """SCAN-11: findings of ``runs`` (typed or of any narrower shape), in the order of `order`, then run and result.

    The rule of a result is the last of its id in driver and extensions, looked up inside the run, so neither a join nor a
    copy of the rules for each result is needed. Columns of `keep` are carried along in front.
    """
    keep = keep or []
    spark = docs.sparkSession
    want = spark.createDataFrame([], f"runs {RUNS_DDL}").schema["runs"].dataType
    shaped = docs.select(*dict.fromkeys([*order, *keep]), _shape(F.col(runs), docs.schema[runs].dataType, want).alias("__runs"))
    run = shaped.select(*dict.fromkeys([*order, *keep]), F.posexplode("__runs").alias("__run_no", "__run"))
    rules = F.concat(
        F.coalesce(F.col("__run.tool.driver.rules"), F.array().cast(f"array<{_RULE}>")),
        F.flatten(F.transform(F.filter(F.coalesce(F.col("__run.tool.extensions"), F.array().cast(f"array<struct<rules:array<{_RULE}>>>")), lambda e: e["rules"].isNotNull()), lambda e: e["rules"])),
    )
    with_rule = F.transform(
        F.col("__run.results"),
        lambda r: F.struct(r.alias("r"), F.try_element_at(F.filter(rules, lambda x: x["id"] == r["ruleId"]), F.lit(-1)).alias("rule")),
    )
    version = F.coalesce(_full(F.col("__run.tool.driver.semanticVersion")), _full(F.col("__run.tool.driver.version")))
    hit = run.select(*dict.fromkeys([*order, *keep]), "__run_no", version.alias("__version"), F.posexplode(with_rule).alias("__no", "__hit")).where("__hit.r IS NOT NULL")
    r, rule = F.col("__hit.r"), F.col("__hit.rule")
    first = F.get(r["locations"], F.lit(0))["physicalLocation"]
    pp, rp = r["properties"], rule["properties"]
    score = F.coalesce(pp["security-severity"], rp["security-severity"]).try_cast("double")
    scored = F.coalesce((score > 0) & (score < F.lit(float("inf"))), F.lit(False))
    raw_severity = F.coalesce(_full(pp["severity"]), _full(rp["severity"]))
    level = F.lower(F.coalesce(_full(r["level"]), _full(rule["defaultConfiguration"]["level"]), F.lit("")))
    by_level = F.when(level == "error", "HIGH").when(level == "note", "LOW").when(level == "none", "INFO").otherwise("MEDIUM")
    severity = F.when(scored, severity_of_score(score)).when(raw_severity.isNotNull(), severity_name(raw_severity)).otherwise(by_level)
    vector = F.coalesce(_full(pp["cvssV3_vector"]), _full(pp["cvss_vector"]), _full(rp["cvssV3_vector"]), _full(rp["cvss_vector"]), F.when(pp["cvss"].rlike("^CVSS:3"), pp["cvss"]))
    precision = F.lower(F.coalesce(_full(pp["precision"]), rp["precision"]))
    has_place = F.size(F.coalesce(r["locations"], F.array().cast(f"array<{_LOC}>"))) > 0
    confidence = F.when(precision == "very-high", "CONFIRMED").when(precision == "high", "LIKELY").when(precision == "medium", "POSSIBLE").when(precision == "low", "UNVERIFIED").when(has_place, "LIKELY").otherwise("POSSIBLE")
    tags = F.lower(F.array_join(F.coalesce(rp["tags"], F.array().cast("array<string>")), " "))
    fixed = {"dependency": "dependency", "secret": "security", "config": "configuration"}.get(kind)
    by_tag = F.when(tags.rlike("security|cwe|owasp|injection|xss|crypto"), "security").when(tags.rlike("performance"), "performance").when(tags.rlike("maintainability|style|convention"), "code-quality")
    category = F.lit(fixed) if fixed else by_tag.otherwise("code-quality" if kind == "quality" else "security")
    targets = F.transform(F.coalesce(rule["relationships"], F.array().cast("array<struct<target:struct<id:string, guid:string>>>")), lambda x: F.coalesce(_full(x["target"]["id"]), x["target"]["guid"]))
    no_text = F.array().cast("array<string>")
    cwe = cwe_ids(F.concat(F.coalesce(rp["tags"], no_text), F.array(rp["cwe"], rule["id"], _said(rule["shortDescription"])), targets, F.array(pp["cwe"], r["ruleId"])))
    adv = advisory_ids(F.concat(F.array(r["ruleId"], rule["id"], _said(rule["shortDescription"])), F.coalesce(rp["tags"], no_text), F.array(_said(r["message"]))))
    title = F.coalesce(_full(F.trim(F.split(_said(r["message"]), "\n")[0])), _full(_said(rule["shortDescription"])), _full(r["ruleId"]), F.lit("Unnamed finding"))
    file = F.coalesce(_full(uri_path(first["artifactLocation"]["uri"])), F.lit("(unknown)"))
    output = F.concat(F.lit(tool), F.coalesce(F.concat(F.lit(" "), F.col("__version")), F.lit("")), F.lit(" rule "), F.coalesce(_full(r["ruleId"]), F.lit("(none)")), F.coalesce(F.concat(F.lit(" level="), _full(r["level"])), F.lit("")))
    mark = F.get(F.map_values(r["partialFingerprints"]), F.lit(0))
    out = hit.select(
        *dict.fromkeys([*order, *keep]), "__run_no", "__no",
        F.left(title, F.lit(200)).alias("title"), category.alias("category"), r["ruleId"].alias("subcategory"), severity.alias("severity"), confidence.alias("confidence"),
        F.when(F.size(F.coalesce(r["suppressions"], F.array().cast("array<struct<kind:string>>"))) > 0, "FALSE_POSITIVE").otherwise("OPEN").alias("status"),
        F.when(scored, F.struct(F.lit("3.1").alias("version"), one_decimal(score).alias("score"), vector.alias("vector"), severity_of_score(score).alias("severity"), F.when(vector.isNull(), "score as reported, without a vector").alias("note"))).alias("cvss"),
        F.when(F.size(cwe) > 0, cwe).alias("cwe"), F.when(F.size(adv) > 0, adv).alias("advisories"),
        F.struct(file.alias("file"), first["region"]["startLine"].alias("startLine"), first["region"]["endLine"].alias("endLine"), _places(r).alias("additionalLocations")).alias("location"),
        F.struct(F.trim(F.coalesce(_full(first["region"]["snippet"]["text"]), first["region"]["snippet"]["rendered"], F.lit(""))).alias("snippet"), F.lit("csharp").alias("language"), output.alias("toolOutput")).alias("evidence"),
        F.coalesce(_full(_said(r["message"])), _full(_said(rule["fullDescription"])), _said(rule["shortDescription"])).alias("problem"), F.lit("").alias("impact"),
        F.coalesce(_full(_said(rule["help"])), _said(rule["fullDescription"])).alias("recommendation"), _dataflow(r, tool).alias("dataflow"),
        F.array(F.struct(F.lit(tool).alias("tool"), r["ruleId"].alias("sourceFindingId"), F.lit("REPORTED").alias("status"), F.when(mark.isNotNull(), F.concat(F.lit("fingerprint: "), mark)).alias("note"))).alias("sources"),
    )
    return out


def finish(df: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and the finding record."""
    shaped = conform(df)
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = [_shape(F.col(f.name) if f.name in have else F.lit(None), have.get(f.name), f.dataType).alias(f.name) for f in shaped.schema.fields if f.name not in keep]
    return df.select(*keep, *cols)
