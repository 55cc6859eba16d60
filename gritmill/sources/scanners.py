"""Scanner outputs as findings: `Source` objects with a pure ``parse(raw, root)`` over rows of raw text, and typed forms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritmill.functions.normalise import one_decimal, relative_to, severity_name, severity_of_score
from gritmill.functions.redact import scrub
from gritmill.operators.baseline import first_by_key
from gritmill.operators.nested import string_or_list
from gritmill.sources.sarif import finish, parse_documents, sarif_findings

#: CWE and severity that analyser rules stand for.
ANALYSER_RULES = {
    "HIGH": "SCS0001:78 SCS0002:89 SCS0004:295 SCS0007:611 SCS0012:862 SCS0015:798 SCS0018:22 SCS0024:807 SCS0026:90 SCS0028:502 SCS0029:79 SCS0031:90 "
    "CA2100:89 CA3001:89 CA3002:79 CA3003:22 CA3005:90 CA3006:78 CA3011:114 CA3075:611 CA3076:94 CA5351:327 CA5359:295 CA5360:502 CA5380:295 CA5381:295 CA5389:22 CA5390:798 CA5401:329 CA5403:798 "
    "CA2300:502 CA2301:502 CA2302:502 CA2305:502 CA2310:502 CA2311:502 CA2312:502 CA2321:502 CA2322:502 CA2326:502 CA2327:502 CA2328:502 CA2329:502 CA2330:502",
    "MEDIUM": "SCS0003:643 SCS0005:338 SCS0006:328 SCS0008:614 SCS0009:1004 SCS0010:327 SCS0011:611 SCS0013:326 SCS0016:352 SCS0017:20 SCS0019:524 SCS0021:20 SCS0022:807 SCS0023:311 SCS0027:601 SCS0030:20 "
    "CA3004:209 CA3007:601 CA3008:643 CA3009:91 CA3010:91 CA3012:1333 CA3061:611 CA3077:611 CA3147:352 CA5350:327 CA5358:326 CA5361:757 CA5362:502 CA5363:20 CA5364:327 CA5365:113 CA5366:611 CA5369:611 CA5370:611 CA5371:611 CA5372:611 "
    "CA5373:327 CA5374:94 CA5375:522 CA5376:319 CA5377:284 CA5378:757 CA5379:327 CA5382:614 CA5383:614 CA5384:327 CA5385:326 CA5387:916 CA5388:916 CA5391:352 CA5392:114 CA5393:114 CA5394:338 CA5395:352 CA5396:1004 CA5397:327 CA5399:299 CA5400:299 CA5402:329",
    "LOW": "SCS0032:521 SCS0033:521 SCS0034:521 CA5386:757 CA5398:327",
}
_ANALYSER = {r.split(":")[0]: (s, "CWE-" + r.split(":")[1]) for s, rules in ANALYSER_RULES.items() for r in rules.split()}
#: Catalog cases that pattern rules answer; a vendor's prefix before ``dotnet-`` does not count.
PATTERN_CASES = {
    "dotnet-disable-cert-validation": "F-001 F-002", "dotnet-cors-reflected-origin": "N-001 N-003", "dotnet-cors-wildcard-with-credentials": "N-002", "dotnet-static-zero-iv": "E-004 E-005",
    "dotnet-weak-pbkdf2-iterations": "E-007", "dotnet-sftp-accept-any-hostkey": "F-003", "dotnet-log-request-body": "G-001 G-004", "dotnet-log-dir-under-basedirectory": "G-002 G-003",
    "dotnet-absolute-path-in-response": "H-004", "dotnet-timestamp-filename": "I-005 I-006", "dotnet-pathcombine-unvalidated-param": "I-001", "dotnet-validatecredentials-no-empty-guard": "A-001 A-002",
    "dotnet-principalcontext-no-ssl": "A-003", "dotnet-oauth-validate-client-unconditional": "A-006", "dotnet-token-lifetime-excessive": "A-007 A-008", "dotnet-swagger-unconditional": "H-006",
    "dotnet-expression-built-by-concat": "C-008 U-008", "dotnet-catch-returns-default": "L-001", "dotnet-tostring-no-invariant-numeric": "C-015 L-008", "dotnet-regex-no-timeout": "P-004 P-005",
    "dotnet-sync-over-async-content-read": "P-002", "dotnet-parse-body-without-contenttype-check": "H-003",
}
REDACTED = "[redacted by adapter]"


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for kv in d.items() for x in kv])


def _full(c: Column) -> Column:
    return F.when(c != "", c)


def _source(tool: str, rule: Column, note: Column | None = None) -> Column:
    return F.array(F.struct(F.lit(tool).alias("tool"), rule.alias("sourceFindingId"), F.lit("REPORTED").alias("status"), (note if note is not None else F.lit(None).cast("string")).alias("note")))


def _detection(engine: str, rule: Column) -> Column:
    return F.struct(F.lit("DETERMINISTIC").alias("class"), F.array(F.struct(F.lit(engine).alias("engine"), rule.alias("ruleId"), F.lit("EXISTS").alias("status"))).alias("rules"))


def _cvss(score: Column, vector: Column, note: str) -> Column:
    ok = F.coalesce((score > 0) & ~F.isnan(score), F.lit(False))
    v = F.when(vector.rlike("^CVSS:3"), vector)
    made = F.struct(F.lit("3.1").alias("version"), one_decimal(score).alias("score"), v.alias("vector"), severity_of_score(score).alias("severity"), F.when(v.isNull(), note).alias("note"))
    return F.when(ok, made)


def _scored_severity(score: Column, name: Column) -> Column:
    return F.when(F.coalesce((score > 0) & ~F.isnan(score), F.lit(False)), severity_of_score(score)).otherwise(severity_name(name))


def _strings(*cols: Column) -> Column:
    return F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != ""))


def roslyn_runs(roslyn: DataFrame) -> DataFrame:
    """The runs of typed deliveries, over all their logs in order."""
    return roslyn.withColumn("runs", F.flatten(F.transform(F.filter("logs", lambda d: d.isNotNull() & d["runs"].isNotNull()), lambda d: d["runs"])))


def roslyn_findings(docs: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """SCAN-16 and NORM-09: analyser results, with the CWE and severity of known rules."""
    f = sarif_findings(docs, "roslyn", "sast", order, keep=keep)
    known = _lit_map({k: F.struct(F.lit(s).alias("severity"), F.lit(c).alias("cwe")) for k, (s, c) in _ANALYSER.items()})
    e = F.try_element_at(known, F.coalesce("subcategory", F.lit("")))
    f = f.withColumn("__e", e)
    family = F.when(F.col("__e").isNotNull(), "security").when(F.col("subcategory").rlike(r"^(CA2[13]\d\d|CA3\d\d\d|CA5\d\d\d|SCS\d+)\z"), "security").when(F.col("subcategory").rlike(r"^(CS|CA|S|IDE)\d+\z"), "code-quality")
    out = (
        f.withColumn("cwe", F.when(F.col("__e").isNotNull(), F.array_distinct(F.concat(F.coalesce("cwe", F.array().cast("array<string>")), F.array("__e.cwe")))).otherwise(F.col("cwe")))
        .withColumn("severity", F.coalesce("__e.severity", "severity"))
        .withColumn("category", F.coalesce(family, "category"))
        .withColumn("confidence", F.when(F.col("__e").isNotNull() & (F.col("location.startLine") > 0), "LIKELY").otherwise(F.col("confidence")))
        .withColumn("detection", _detection("roslyn", F.coalesce(_full(F.col("subcategory")), F.lit("(unknown)"))))
    )
    return out.drop("__e")


def gitleaks_findings(docs: DataFrame, order: list[str], root: str = "", keep: list[str] | None = None) -> DataFrame:
    """SCAN-17: secret hits, rewritten so that nothing of the value stays."""
    f = sarif_findings(docs, "gitleaks", "secret", order, keep=keep)
    rule = F.coalesce("subcategory", F.lit(""))
    commented, weak = F.lower(rule).contains("commented"), F.lower(rule).contains("weak-static-key")
    kind = F.when(commented, "Credential left in a comment").when(weak, "Key literal in code").otherwise("Secret-shaped literal in source or configuration")
    return (
        f.withColumn("title", F.concat(kind, F.lit(" ("), F.coalesce(_full(rule), F.lit("gitleaks")), F.lit(")")))
        .withColumn("location", F.col("location").withField("file", F.regexp_replace(relative_to(F.col("location.file"), root), r"^\./", "")))
        .withColumn("category", F.lit("security")).withColumn("severity", F.lit("HIGH")).withColumn("confidence", F.lit("LIKELY"))
        .withColumn("cvss", F.lit(None).cast("struct<version:string, score:double, vector:string, severity:string, note:string>"))
        .withColumn("cwe", F.when(commented, F.array(F.lit("CWE-540"), F.lit("CWE-798"))).otherwise(F.array(F.lit("CWE-798"))))
        .withColumn("owasp", F.array(F.lit("A07:2021"), F.lit("A05:2021")))
        .withColumn("evidence", F.struct(F.lit(REDACTED).alias("snippet"), F.lit("text").alias("language"), F.concat(F.lit("gitleaks rule="), F.coalesce(_full(rule), F.lit("(unknown)"))).alias("toolOutput"), F.lit(True).alias("redacted")))
        .withColumn("problem", F.concat(kind, F.lit(", found by rule "), rule, F.lit(".")))
        .withColumn("impact", F.lit("Whoever can read the repository, a build or a backup can use the value if it is live."))
        .withColumn("recommendation", F.lit("Find out whether the value is live; if so, replace it and keep it in a secret store."))
        .withColumn("tests", F.when(commented, F.array(F.lit("E-002"), F.lit("E-003"), F.lit("E-012"))).otherwise(F.array(F.lit("E-001"), F.lit("E-003"), F.lit("E-012"))))
        .withColumn("detection", _detection("gitleaks", F.coalesce(_full(rule), F.lit("(unknown)"))))
        .withColumn("sources", F.transform("sources", lambda s: s.withField("note", F.lit(None).cast("string"))))
        .withColumn("priority", F.lit("P0")).withColumn("effort", F.lit("MEDIUM"))
    )


def semgrep_findings(docs: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """SCAN-18: pattern hits with the catalog cases they answer."""
    f = sarif_findings(docs, "semgrep", "sast", order, keep=keep)
    cases = _lit_map({k: F.array(*[F.lit(x) for x in v.split()]) for k, v in PATTERN_CASES.items()})
    rule = F.regexp_replace(F.coalesce("subcategory", F.lit("")), "^[a-z]+-(?=dotnet-)", "")
    impact = F.when((F.col("impact") == "") & (F.col("problem") != ""), "The scanner states no impact; assess whether the code can be reached.").otherwise(F.col("impact"))
    return f.withColumn("tests", F.try_element_at(cases, rule)).withColumn("impact", impact).withColumn("detection", _detection("semgrep", F.coalesce(_full(F.col("subcategory")), F.lit("(unknown)"))))


def trivy_findings(trivy: DataFrame, order: list[str], root: str = "", keep: list[str] | None = None) -> DataFrame:
    """SCAN-12: three kinds of rows under each result; a matched value is never carried over."""
    keep = list(dict.fromkeys([*order, *(keep or [])]))
    el = {f.name for f in trivy.schema["Results"].dataType.elementType.fields}
    res = trivy.select(*keep, F.posexplode("Results").alias("__run_no", "__r"))

    def rows(name: str) -> DataFrame | None:
        if name not in el:
            return None
        t = res.select(*keep, "__run_no", relative_to(F.col("__r.Target"), root).alias("__target"), F.posexplode(f"__r.{name}").alias("__no", "x"))
        return t.where("x IS NOT NULL")

    def field(t: DataFrame, name: str, kind: str = "string") -> Column:
        return F.col(f"x.{name}") if name in {f.name for f in t.schema["x"].dataType.fields} else F.lit(None).cast(kind)

    parts = []
    if (t := rows("Vulnerabilities")) is not None:
        scores = F.col("x.CVSS")
        vendor = F.coalesce(scores["nvd"], scores["ghsa"], F.get(F.map_values(scores), F.lit(0)))
        score, vector, fixed = vendor["V3Score"], vendor["V3Vector"], _full(F.col("x.FixedVersion"))
        vid, name, have = F.col("x.VulnerabilityID"), F.col("x.PkgName"), F.col("x.InstalledVersion")
        refs = F.slice(F.concat(_strings(field(t, "PrimaryURL")), F.coalesce(field(t, "References", "array<string>"), F.array().cast("array<string>"))), 1, 5)
        at = F.concat(F.coalesce(name, F.lit("undefined")), F.lit(" "), F.coalesce(have, F.lit("undefined")))
        parts.append(
            t.select(
                *keep, "__run_no", F.lit(0).alias("__kind"), "__no",
                F.trim(F.concat(F.coalesce(_full(name), F.lit("package")), F.lit(" "), F.coalesce(have, F.lit("")), F.lit(": "), F.coalesce(_full(F.col("x.Title")), _full(vid), F.lit("known vulnerability")))).alias("title"),
                F.lit("dependency").alias("category"), vid.alias("subcategory"), _scored_severity(score, F.col("x.Severity")).alias("severity"), F.lit("CONFIRMED").alias("confidence"), F.lit("OPEN").alias("status"),
                _cvss(score, vector, "score of the advisory database, without a vector").alias("cvss"), F.when(F.size("x.CweIDs") > 0, F.col("x.CweIDs")).alias("cwe"), F.array(F.lit("A06:2021")).alias("owasp"), _strings(vid).alias("advisories"),
                F.array(F.lit("O-001"), F.lit("DEP-001")).alias("tests"), refs.alias("references"), F.struct(name.alias("name"), have.alias("installed"), fixed.alias("fixed")).alias("package"),
                F.struct(F.coalesce(_full(F.col("__target")), F.lit("(manifest)")).alias("file")).alias("location"),
                F.struct(F.concat(at, F.coalesce(F.concat(F.lit("  ->  fixed in "), fixed), F.lit("  ->  no fixed version"))).alias("snippet"), F.lit("text").alias("language"), F.concat_ws(" ", F.lit("trivy"), vid, F.concat(F.lit("severity="), F.col("x.Severity"))).alias("toolOutput")).alias("evidence"),
                F.left(F.coalesce(_full(F.col("x.Description")), F.col("x.Title"), F.lit("")), F.lit(1200)).alias("problem"),
                F.concat(F.lit("Comes with "), at, F.when(fixed.isNotNull(), F.concat(F.lit("; fixed in "), fixed, F.lit("."))).otherwise(F.lit("; no fixed version is published."))).alias("impact"),
                F.when(fixed.isNotNull(), F.concat(F.lit("Upgrade "), F.coalesce(name, F.lit("the package")), F.lit(" to "), fixed, F.lit(" or later."))).otherwise(F.lit("Find out whether the code can be reached; replace or shield the package.")).alias("recommendation"),
                _detection("trivy", vid).alias("detection"), _source("trivy", vid).alias("sources"),
            )
        )
    if (t := rows("Secrets")) is not None:
        rid = F.col("x.RuleID")
        parts.append(
            t.select(
                *keep, "__run_no", F.lit(1).alias("__kind"), "__no", F.concat(F.lit("Secret in source: "), F.coalesce(_full(F.col("x.Title")), rid, F.lit("undefined"))).alias("title"),
                F.lit("security").alias("category"), rid.alias("subcategory"), severity_name(F.col("x.Severity"), "HIGH").alias("severity"), F.lit("LIKELY").alias("confidence"), F.lit("OPEN").alias("status"),
                F.array(F.lit("CWE-798")).alias("cwe"), F.array(F.lit("A07:2021")).alias("owasp"), F.array(F.lit("E-001"), F.lit("E-012")).alias("tests"),
                F.struct(F.col("__target").alias("file"), F.col("x.StartLine").alias("startLine")).alias("location"),
                F.struct(F.lit(REDACTED).alias("snippet"), F.lit("text").alias("language"), F.concat_ws(" ", F.lit("trivy secret"), F.concat(F.lit("rule="), rid), F.concat(F.lit("category="), F.col("x.Category"))).alias("toolOutput"), F.lit(True).alias("redacted")).alias("evidence"),
                F.concat_ws(" ", F.lit("Rule"), rid, F.lit("matched a secret in"), F.col("__target")).alias("problem"), F.lit("Whoever can read the repository or the artefact can use the value if it is live.").alias("impact"),
                F.lit("Find out whether the value is live; if so, replace it and keep it in a secret store.").alias("recommendation"), _detection("trivy", rid).alias("detection"), _source("trivy", rid).alias("sources"),
            )
        )
    if (t := rows("Misconfigurations")) is not None:
        mid = F.col("x.ID")
        cause = {f.name: f.dataType for f in t.schema["x"].dataType["CauseMetadata"].dataType.fields} if "CauseMetadata" in {f.name for f in t.schema["x"].dataType.fields} else {}
        line = F.col("x.CauseMetadata.StartLine") if "StartLine" in cause else F.lit(None).cast("int")
        code = F.array_join(F.col("x.CauseMetadata.Code.Lines.Content"), "\n") if "Code" in cause else F.lit(None).cast("string")
        parts.append(
            t.select(
                *keep, "__run_no", F.lit(2).alias("__kind"), "__no", F.coalesce(_full(F.col("x.Title")), mid).alias("title"), F.lit("configuration").alias("category"), mid.alias("subcategory"),
                severity_name(F.col("x.Severity")).alias("severity"), F.lit("LIKELY").alias("confidence"), F.lit("OPEN").alias("status"), F.array(F.lit("N-004")).alias("tests"), _strings(field(t, "PrimaryURL")).alias("references"),
                F.struct(F.col("__target").alias("file"), F.when(line > 0, line).alias("startLine")).alias("location"),
                F.struct(F.coalesce(code, F.lit("")).alias("snippet"), F.lit("text").alias("language"), F.concat_ws(" ", F.lit("trivy misconfig"), mid, F.concat(F.lit("severity="), F.col("x.Severity"))).alias("toolOutput")).alias("evidence"),
                F.coalesce(_full(field(t, "Description")), F.col("x.Title"), F.lit("")).alias("problem"), F.coalesce(_full(F.col("x.Message")), F.lit("The configuration departs from a hardening baseline.")).alias("impact"),
                F.coalesce(_full(F.col("x.Resolution")), F.lit("Apply the hardening guidance referred to.")).alias("recommendation"), _detection("trivy", mid).alias("detection"), _source("trivy", mid).alias("sources"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


SNYK_DDL = (
    "array<struct<projectName:string, displayTargetFile:string, targetFile:string, vulnerabilities:array<struct<id:string, title:string, severity:string, cvssScore:double, CVSSv3:string, identifiers:struct<CVE:string, CWE:string>, "
    "packageName:string, version:string, `from`:array<string>, isUpgradable:boolean, isPatchable:boolean, upgradePath:array<string>, fixedIn:array<string>, description:string>>>>"
)


def snyk_findings(raw: DataFrame, order: list[str], text: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """SCAN-13: one finding for each id, package and version of a document, the first of them; more than two steps of origin are transitive."""
    keep = list(dict.fromkeys([*order, *(keep or [])]))
    whole = F.when(F.col(text).rlike(r"^\s*\{"), F.concat(F.lit("["), F.col(text), F.lit("]"))).otherwise(F.col(text))
    projects = F.when(F.try_parse_json(text).isNotNull(), F.from_json(whole, SNYK_DDL))
    p = raw.select(*keep, F.posexplode(projects).alias("__run_no", "p"))
    target = F.coalesce(_full(F.col("p.displayTargetFile")), _full(F.col("p.targetFile")), _full(F.col("p.projectName")), F.lit("packages.config"))
    t = p.select(*keep, "__run_no", F.translate(target, "\\", "/").alias("__target"), F.posexplode("p.vulnerabilities").alias("__no", "x")).where("x.id <> ''")
    key = [F.col(c) for c in order] + [F.coalesce(F.col(f"x.{c}"), F.lit("undefined")) for c in ("id", "packageName", "version")]
    t = first_by_key(t, key, [F.col("__run_no"), F.col("__no")])
    vid, name, have, score = F.col("x.id"), F.col("x.packageName"), F.col("x.version"), F.col("x.cvssScore")
    cves = F.filter(F.coalesce(string_or_list(F.col("x.identifiers.CVE")), F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    cwes = F.filter(F.coalesce(string_or_list(F.col("x.identifiers.CWE")), F.array().cast("array<string>")), lambda c: c.rlike(r"^CWE-\d+\z"))
    chain = F.coalesce("x.from", F.array().cast("array<string>"))
    fixed = F.try_element_at(F.col("x.fixedIn"), F.lit(1))
    path = F.filter(F.coalesce("x.upgradePath", F.array().cast("array<string>")), lambda u: u.isNotNull() & ~u.isin("false", ""))
    transitive = F.size(chain) > 2
    return t.select(
        *keep, "__run_no", "__no", F.left(F.trim(F.concat(F.coalesce(_full(name), F.lit("package")), F.lit(" "), F.coalesce(have, F.lit("")), F.lit(": "), F.coalesce(_full(F.col("x.title")), vid))), F.lit(200)).alias("title"),
        F.lit("dependency").alias("category"), vid.alias("subcategory"), _scored_severity(score, F.col("x.severity")).alias("severity"), F.lit("CONFIRMED").alias("confidence"), F.lit("OPEN").alias("status"),
        _cvss(score, F.col("x.CVSSv3"), "score of the vendor's database, without a vector").alias("cvss"), F.when(F.size(cwes) > 0, cwes).alias("cwe"), F.array(F.lit("A06:2021")).alias("owasp"), F.array_distinct(F.concat(cves, F.array(vid))).alias("advisories"),
        F.array(F.lit("O-001"), F.lit("DEP-001")).alias("tests"), F.struct(name.alias("name"), have.alias("installed"), fixed.alias("fixed")).alias("package"), F.struct(F.col("__target").alias("file")).alias("location"),
        F.struct(F.when(F.size(chain) > 0, F.array_join(chain, "\n  -> ")).otherwise(F.concat_ws(" ", name, have)).alias("snippet"), F.lit("text").alias("language"), F.concat_ws(" ", F.lit("snyk"), vid, F.concat(F.lit("severity="), F.col("x.severity"))).alias("toolOutput")).alias("evidence"),
        F.left(F.coalesce(_full(F.col("x.description")), F.col("x.title"), F.lit("")), F.lit(1200)).alias("problem"),
        F.when(transitive, F.concat(F.lit("Comes in through "), (F.size(chain) - 1).cast("string"), F.lit(" levels of dependencies."))).otherwise(F.lit("A direct dependency of the project.")).alias("impact"),
        F.when(F.col("x.isUpgradable") & (F.size(path) > 0), F.concat(F.lit("Upgrade: "), F.array_join(path, " -> "))).when(fixed.isNotNull(), F.concat(F.lit("Upgrade to "), fixed, F.lit(" or later."))).otherwise(F.lit("No upgrade is available; replace or shield the package.")).alias("recommendation"),
        _detection("snyk", vid).alias("detection"), _source("snyk", vid).alias("sources"), transitive.alias("transitive"),
    )


OSV_DDL = (
    "struct<packages:array<struct<packageId:string, version:string, file:string, line:int, vulnId:string>>, vulns:array<struct<id:string, summary:string, details:string, "
    "database_specific:struct<severity:string>, cwe:array<string>, affected:array<struct<ranges:array<struct<type:string, events:array<map<string,string>>>>>>>>>"
)


def osv_findings(raw: DataFrame, order: list[str], text: str = "raw") -> DataFrame:
    """SCAN-14: hits left-joined to the advisories of their own document."""
    d = raw.select(*order, F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, OSV_DDL)).alias("d")).where("d.packages IS NOT NULL AND d.vulns IS NOT NULL")
    pair = F.transform("d.packages", lambda h: F.struct(h.alias("h"), F.try_element_at(F.filter("d.vulns", lambda v: v["id"] == h["vulnId"]), F.lit(-1)).alias("v")))
    t = d.select(*order, F.posexplode(pair).alias("__no", "x")).where("x.h IS NOT NULL")
    events = F.flatten(F.transform(F.flatten(F.transform(F.coalesce("x.v.affected", F.array().cast("array<struct<ranges:array<struct<type:string, events:array<map<string,string>>>>>>")), lambda a: F.coalesce(a["ranges"], F.array().cast("array<struct<type:string, events:array<map<string,string>>>>")))), lambda r: F.coalesce(r["events"], F.array().cast("array<map<string,string>>"))))
    fixes = F.filter(F.transform(events, lambda e: e["fixed"]), lambda f: f.isNotNull() & (f != ""))
    h, vid = F.col("x.h"), F.col("x.h.vulnId")
    label = F.col("x.v.database_specific.severity")
    fixed = F.try_element_at(fixes, F.lit(1))
    return t.select(
        *order, "__no", F.concat(h["packageId"], F.lit(" "), h["version"], F.lit(": "), vid).alias("title"), F.lit("dependency").alias("category"), vid.alias("subcategory"),
        F.when(label.isin("CRITICAL", "HIGH", "LOW"), label).otherwise("MEDIUM").alias("severity"), F.lit("CONFIRMED").alias("confidence"), F.lit("OPEN").alias("status"), F.slice(F.coalesce("x.v.cwe", F.array().cast("array<string>")), 1, 3).alias("cwe"), F.array(vid).alias("advisories"), F.array(F.lit("O-001")).alias("tests"),
        F.struct(h["packageId"].alias("name"), h["version"].alias("installed"), fixed.alias("fixed")).alias("package"), F.struct(h["file"].alias("file"), h["line"].alias("startLine")).alias("location"),
        F.struct(F.concat(F.lit('<package id="'), h["packageId"], F.lit('" version="'), h["version"], F.lit('" />')).alias("snippet"), F.lit("xml").alias("language"), F.concat(F.lit("osv "), vid).alias("toolOutput")).alias("evidence"),
        F.left(F.split(F.coalesce(_full(F.col("x.v.summary")), _full(F.col("x.v.details")), vid), "\n")[0], F.lit(300)).alias("problem"), F.lit("A published defect of a dependency.").alias("impact"),
        F.when(fixed.isNotNull(), F.concat(F.lit("Upgrade to "), fixed, F.lit(" or later."))).otherwise(F.lit("No fixed version is published; replace or shield the package.")).alias("recommendation"),
        _detection("osv", vid).alias("detection"), _source("osv", vid).alias("sources"),
    )


_ISSUE = "struct<rule:string, RuleId:string, ruleKey:string, severity:string, Severity:string, type:string, Type:string, component:string, Component:string, FileName:string, line:int, Line:int, message:string, Message:string, effort:string, debt:string, securityCategory:string, vulnerabilityProbability:string, textRange:struct<startLine:int>, Location:struct<StartLine:int>>"


def sonarqube_findings(raw: DataFrame, order: list[str], text: str = "raw") -> DataFrame:
    """SCAN-15: issues in either spelling, a bare list, or SARIF-like runs; the project key before the first colon is cut."""
    v = F.try_parse_json(text)
    own = lambda path: F.try_variant_get(v, path, "string")
    body = F.coalesce(own("$.issues"), own("$.Issues"), F.when(F.col(text).rlike(r"^\s*\["), F.col(text)))
    get = lambda path: lambda x: F.try_variant_get(x, path, "string")
    issues = F.when(F.try_variant_get(F.try_parse_json(body), "$", "array<variant>").isNotNull(), F.try_variant_get(F.try_parse_json(body), "$", "array<variant>"))
    t = raw.select(*order, F.posexplode(issues).alias("__no", "x"))
    pick = lambda *ps: F.coalesce(*[_full(get(p)(F.col("x"))) for p in ps])
    flat = t.select(
        *order, "__no", F.coalesce(pick("$.rule", "$.RuleId", "$.ruleKey"), F.lit("")).alias("rule"), F.coalesce(pick("$.message", "$.Message"), F.lit("")).alias("msg"),
        F.coalesce(pick("$.type", "$.Type"), F.when(F.lower(pick("$.securityCategory")).contains("hotspot"), "SECURITY_HOTSPOT").otherwise("CODE_SMELL")).alias("type"),
        F.coalesce(pick("$.severity", "$.Severity", "$.vulnerabilityProbability"), F.lit("MAJOR")).alias("sev"), F.coalesce(pick("$.component", "$.Component", "$.FileName"), F.lit("")).alias("comp"),
        pick("$.line", "$.Line", "$.textRange.startLine", "$.Location.StartLine").try_cast("int").alias("line"),
    )
    runs = parse_documents(raw, order, text)
    s = sarif_findings(runs, "sonarqube", "quality", order).select(
        *order, "__no", F.coalesce("subcategory", F.lit("")).alias("rule"), F.col("problem").alias("msg"), F.lit("CODE_SMELL").alias("type"),
        F.when(F.col("evidence.toolOutput").endswith("level=error"), "CRITICAL").when(F.col("evidence.toolOutput").endswith("level=warning"), "MAJOR").otherwise("MINOR").alias("sev"),
        F.concat(F.lit("run:"), F.when(F.col("location.file") != "(unknown)", F.col("location.file")).otherwise("")).alias("comp"), F.col("location.startLine").alias("line"),
    )
    u = flat.unionByName(s).where("rule <> '' OR msg <> ''")
    rule = F.element_at(F.split("rule", ":"), -1)
    file = F.when(F.col("comp").contains(":"), F.regexp_replace("comp", "^[^:]*:", "")).otherwise(F.col("comp"))
    hotspot = F.col("type") == "SECURITY_HOTSPOT"
    return u.select(
        *order, "__no", F.left(F.coalesce(_full(F.col("msg")), rule), F.lit(200)).alias("title"), F.when(F.col("type").isin("VULNERABILITY", "SECURITY_HOTSPOT"), "security").when(F.col("type") == "BUG", "reliability").otherwise("code-quality").alias("category"),
        _full(rule).alias("subcategory"), severity_name(F.col("sev")).alias("severity"), F.when(hotspot, "POSSIBLE").otherwise("LIKELY").alias("confidence"), F.lit("OPEN").alias("status"),
        F.struct(F.coalesce(_full(file), F.lit("(unknown)")).alias("file"), F.col("line").alias("startLine")).alias("location"),
        F.struct(F.lit("").alias("snippet"), F.lit("csharp").alias("language"), F.concat(F.lit("sonarqube rule="), "rule", F.lit(" type="), "type", F.lit(" severity="), "sev").alias("toolOutput")).alias("evidence"), F.col("msg").alias("problem"),
        F.when(hotspot, "A construct that a person has to review.").otherwise("").alias("impact"), F.concat(F.lit("See rule "), rule).alias("recommendation"), _detection("sonarqube", rule).alias("detection"),
        _source("sonarqube", rule, F.when(hotspot, "security hotspot (review-required)")).alias("sources"),
    )


AI_CATEGORIES = ("security", "configuration", "reliability", "code-quality", "architecture")


def ai_findings(raw: DataFrame, order: list[str], text: str = "raw") -> DataFrame:
    """SCAN-19: a captured model response; its first JSON list, never more certain than POSSIBLE, always UNVERIFIED."""
    d = F.from_json(text, "struct<content:array<struct<text:string>>, choices:array<struct<message:struct<content:string>>>>")
    said = F.when(F.col(text).rlike(r"^\s*\["), F.col(text)).otherwise(F.coalesce(F.array_join(F.transform(d["content"], lambda c: F.coalesce(c["text"], F.lit(""))), "\n"), F.array_join(F.transform(d["choices"], lambda c: F.coalesce(c["message"]["content"], F.lit(""))), "\n")))
    body = F.regexp_extract(said, r"(?s)\[.*\]", 0)
    items = F.when(F.try_parse_json(text).isNotNull(), F.try_variant_get(F.try_parse_json(body), "$", "array<variant>"))
    t = raw.select(*order, F.posexplode(items).alias("__no", "v"))
    text_of = [F.try_variant_get("v", f"$.{k}", "string").alias(k) for k in "title file startLine category severity snippet problem impact recommendation".split()]
    t = t.select(*order, "__no", F.struct(*text_of, F.try_variant_get("v", "$.cwe", "array<string>").alias("cwe")).alias("x")).where("x.title <> '' AND x.file <> ''")
    lines = F.array_join(F.slice(F.split(scrub(F.coalesce("x.snippet", F.lit(""))), "\n"), 1, 12), "\n")
    return t.select(
        *order, "__no", F.left("x.title", F.lit(200)).alias("title"), F.when(F.col("x.category").isin(*AI_CATEGORIES), F.col("x.category")).otherwise("security").alias("category"), F.lit("ai-review").alias("subcategory"),
        severity_name(F.col("x.severity")).alias("severity"), F.lit("POSSIBLE").alias("confidence"), F.lit("UNVERIFIED").alias("status"), F.filter("x.cwe", lambda c: c.rlike(r"^CWE-\d+\z")).alias("cwe"),
        F.struct(F.translate("x.file", "\\", "/").alias("file"), F.when(F.col("x.startLine").rlike(r"^-?\d+\z"), F.col("x.startLine").try_cast("int")).alias("startLine")).alias("location"),
        F.struct(lines.alias("snippet"), F.lit("csharp").alias("language"), F.lit("ai-review: proposed by a model, not confirmed").alias("toolOutput")).alias("evidence"),
        *[scrub(F.coalesce(f"x.{c}", F.lit(""))).alias(c) for c in ("problem", "impact", "recommendation")],
        F.struct(F.lit("AI_ASSISTED").alias("class"), F.array().cast("array<struct<engine:string, ruleId:string, status:string>>").alias("rules")).alias("detection"), _source("ai-review", F.lit(None).cast("string"), F.lit("proposed by a model; to be confirmed")).alias("sources"),
    )


@dataclass(frozen=True)
class Source:
    """A kind of scanner output (UDX-01): `parse` turns rows ``(*order, raw)`` of text into findings and never raises on junk."""

    id: str
    kind: str
    parse: Callable[[DataFrame, list[str], str], DataFrame]


def _typed(text: str, ddl: str) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, ddl))


_TRIVY_DDL = (
    "struct<Results:array<struct<Target:string, Class:string, Type:string, Vulnerabilities:array<struct<VulnerabilityID:string, PkgName:string, InstalledVersion:string, FixedVersion:string, Severity:string, Title:string, Description:string, PrimaryURL:string, CweIDs:array<string>, CVSS:map<string,struct<V3Vector:string, V3Score:double>>, References:array<string>>>, "
    "Secrets:array<struct<RuleID:string, Category:string, Severity:string, Title:string, StartLine:int, EndLine:int, Match:string>>, Misconfigurations:array<struct<ID:string, Title:string, Description:string, Message:string, Severity:string, Resolution:string, PrimaryURL:string, CauseMetadata:struct<StartLine:int, Code:struct<Lines:array<struct<Content:string>>>>>>>>>"
)
SOURCES = {
    s.id: s
    for s in (
        Source("roslyn", "sast", lambda df, o, root: roslyn_findings(parse_documents(df, o), o)),
        Source("gitleaks", "secret", lambda df, o, root: gitleaks_findings(parse_documents(df, o), o, root)),
        Source("semgrep", "sast", lambda df, o, root: semgrep_findings(parse_documents(df, o), o)),
        Source("trivy", "dependency", lambda df, o, root: trivy_findings(df.select(*o, _typed("raw", _TRIVY_DDL)["Results"].alias("Results")), o, root)),
        Source("snyk", "dependency", lambda df, o, root: snyk_findings(df, o, "raw")),
        Source("osv", "dependency", lambda df, o, root: osv_findings(df, o)),
        Source("sonarqube", "quality", lambda df, o, root: sonarqube_findings(df, o)),
        Source("ai-review", "ai", lambda df, o, root: ai_findings(df, o)),
    )
}


def register_source(source: Source) -> None:
    """Adds a kind of scanner output from outside this package; one that breaks the contract is refused."""
    from gritmill.operators.catalog import source_problems

    if problems := source_problems(source):
        raise ValueError(f"source {source.id}: {'; '.join(problems)}")
    if source.id in SOURCES:
        raise ValueError(f"source {source.id} is there already")
    SOURCES[source.id] = source


def read_source(raw: DataFrame, source: str, order: list[str], root: str = "") -> DataFrame:
    """`order` columns and findings of raw texts in column ``raw``."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source}; known are {', '.join(SOURCES)}")
    return finish(SOURCES[source].parse(raw, order, root), order)
