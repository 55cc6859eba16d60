"""Entity resolution over findings of several tools: keys, greedy merge, attribution, order, ids, families."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritmill.functions.normalise import path_key
from gritmill.operators.components import least_labels
from gritmill.operators.numbering import number_within
from gritmill.schema import CONFIDENCES, SEVERITIES, UNKNOWN_RANK, conform, rank
from gritmill.session import materialise

#: Rule ids of several tools that stand for one concept. A vendor's prefix before ``dotnet-`` does not count.
CONCEPTS = {
    "hardcoded-credentials": "S2068 dotnet-appsetting-secret dotnet-connectionstring-password generic-api-key CWE-798 SCS0015 cs/hardcoded-credentials cs/password-in-configuration",
    "weak-cert-validation": "S4830 CA5359 dotnet-disable-cert-validation CWE-295 SCS0004",
    "static-iv": "S3329 CA5401 dotnet-static-zero-iv CWE-329",
    "regex-no-timeout": "S6444 dotnet-regex-no-timeout CWE-1333",
    "permissive-cors": "S5122 dotnet-cors-reflected-origin CWE-346 CWE-942",
    "sql-injection": "S3649 CA2100 csharp.lang.security.sqli CWE-89 SCS0002 cs/sql-injection",
    "weak-hash": "S4790 CA5350 CA5351 CWE-327 CWE-328 SCS0006",
    "unsafe-deserialization": "S5766 CA2300 CA2301 CA2302 CWE-502 SCS0028 cs/unsafe-deserialization",
    "xxe": "S2755 CA3075 CWE-611 SCS0007",
    "path-traversal": "S2083 CA3003 CWE-22 SCS0018 cs/path-injection",
    "weak-random": "S2245 CA5394 CWE-338 SCS0005",
    "cleartext-transmission": "S5332 CWE-319",
    "shared-mutable-state": "S1450 CWE-488",
    "null-dereference": "S2259 CS8602 CWE-476",
    "missing-authorization": "dotnet-controller-missing-authorize CWE-862",
    "command-injection": "SCS0001 cs/command-line-injection CA3006 S2076 CWE-78",
    "xss": "SCS0029 cs/web/xss CA3002 S5131 CWE-79",
    "code-injection": "cs/code-injection CWE-94",
    "ldap-injection": "SCS0031 SCS0026 CA3005 S2078 CWE-90",
    "xpath-injection": "SCS0003 CA3008 CWE-643",
    "open-redirect": "SCS0027 CA3007 S5146 CWE-601",
    "csrf": "SCS0016 S4502 CWE-352",
    "weak-cipher": "SCS0010 SCS0013 CA5358 CWE-326",
}
CONCEPT_OF = {r.upper(): c for c, rules in CONCEPTS.items() for r in rules.split()}
LINE_WINDOW = 4
PREFIX_OF_CATEGORY = {
    "dependency": "DEP-VULN", "configuration": "CFG-GEN", "code-quality": "CODE-QUAL", "architecture": "ARCH-GEN", "performance": "PERF-GEN",
    "reliability": "REL-GEN", "testing": "TEST-GEN", "deployment": "DEP-PROC", "process": "PROC-GEN",
}
PREFIX_OF_CONCEPT = {
    "SEC-SECRET": ("hardcoded-credentials",),
    "SEC-AUTHZ": ("missing-authorization",),
    "SEC-CORS": ("permissive-cors",),
    "SEC-CRYPTO": ("static-iv", "weak-hash", "weak-random", "weak-cert-validation", "weak-cipher"),
    "SEC-INJ": ("sql-injection", "xxe", "unsafe-deserialization", "command-injection", "xss", "code-injection", "ldap-injection", "xpath-injection"),
    "SEC-FILE": ("path-traversal",),
}
TEXTS = ("problem", "impact", "recommendation", "attackScenario", "rootCause", "correctedCode")
MISSED_NOTE = "ran on this code and did not report this finding"


def _empty(c: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(c, F.array().cast(kind))


def concept(extra: dict[str, str] | None = None) -> Column:
    """COR-01: the concept of the first known id among subcategory, source ids and CWEs; null if none is known."""
    table = CONCEPT_OF | {k.upper(): v for k, v in (extra or {}).items()}
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    ids = F.concat(F.array("subcategory"), F.transform(_empty(F.col("sources.sourceFindingId")), lambda s: s), _empty(F.col("cwe")))
    named = F.transform(F.filter(ids, lambda i: i.isNotNull()), lambda i: F.try_element_at(known, F.regexp_replace(F.upper(i), "^[A-Z]+-(?=DOTNET-)", "")))
    return F.try_element_at(F.filter(named, lambda n: n.isNotNull()), F.lit(1))


def keys(concept_col: Column) -> Column:
    """COR-02: correlation keys in order of trust: advisory and package, concept and place, rule and place."""
    file, line = path_key(F.col("location.file")), F.coalesce(F.col("location.startLine"), F.lit(0))
    pkg = F.lower(F.coalesce(F.when(F.col("package.name") != "", F.col("package.name")), F.col("subcategory"), F.lit("")))
    adv = F.transform(_empty(F.col("advisories")), lambda a: F.concat(F.lit("adv:"), F.upper(a), F.lit(":"), pkg))
    sub = F.col("subcategory")
    rest = F.array(
        F.when(concept_col.isNotNull() & (file != ""), F.concat(F.lit("concept:"), concept_col, F.lit(":"), file, F.lit(":"), F.floor(line / LINE_WINDOW).cast("string"))),
        F.when(concept_col.isNotNull() & (file != ""), F.concat(F.lit("conceptfile:"), concept_col, F.lit(":"), file)),
        F.when((file != "") & (sub != ""), F.concat(F.lit("rule:"), F.upper(sub), F.lit(":"), file, F.lit(":"), line.cast("string"))),
    )
    return F.filter(F.concat(adv, rest), lambda k: k.isNotNull())


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("concept", concept()).withColumn("keys", keys(F.col("concept")))


def _rank(value: str | None, order: tuple[str, ...]) -> int:
    return order.index(value) if value in order else UNKNOWN_RANK


def _union(a: list | None, b: list | None) -> list | None:
    return list(dict.fromkeys([*(a or []), *(b or [])])) or None


def merge_into(a: dict, b: dict) -> None:
    """COR-04: what `b` adds to the earlier finding `a`."""
    for field, order in (("severity", SEVERITIES), ("confidence", CONFIDENCES)):
        if _rank(b[field], order) < _rank(a[field], order):
            a[field] = b[field]
    steps = lambda f: len(((f["dataflow"] or {}).get("steps")) or [])
    if b["dataflow"] and (not a["dataflow"] or steps(b) > steps(a)):
        a["dataflow"] = b["dataflow"]
    ca, cb = a["cvss"], b["cvss"]
    if cb and (not ca or (cb["vector"] and not ca["vector"]) or (cb["score"] or 0) > (ca["score"] or 0)):
        a["cvss"] = cb
    for t in TEXTS:
        if len(b[t] or "") > len(a[t] or ""):
            a[t] = b[t]
    if b["evidence"]:
        mine = a["evidence"] = a["evidence"] or dict.fromkeys(b["evidence"])
        if len(b["evidence"]["snippet"] or "") > len(mine["snippet"] or ""):
            mine["snippet"] = b["evidence"]["snippet"]
        if b["evidence"]["toolOutput"]:
            mine["toolOutput"] = "\n".join(x for x in (mine["toolOutput"], b["evidence"]["toolOutput"]) if x)
    for field in ("cwe", "owasp", "advisories", "tests"):
        a[field] = _union(a[field], b[field])
    name = lambda s: (s["tool"], s["sourceFindingId"] or "")
    seen = {name(s) for s in a["sources"] or []}
    for s in b["sources"] or []:
        if name(s) not in seen:
            seen.add(name(s))
            a["sources"] = [*(a["sources"] or []), s]
    origin = [f"{s['tool']}:{s['sourceFindingId'] or 'n/a'}" for s in b["sources"] or []]
    a["correlation"] = {"mergedFrom": list(dict.fromkeys([*((a["correlation"] or {}).get("mergedFrom") or []), *((b["correlation"] or {}).get("mergedFrom") or []), *origin]))}
    extra = (b["location"] or {}).get("additionalLocations")
    if extra:
        a["location"] = a["location"] or dict.fromkeys(b["location"])
        a["location"]["additionalLocations"] = [*(a["location"]["additionalLocations"] or []), *extra]
    if b["status"] == "FALSE_POSITIVE" and a["status"] == "OPEN":
        a["status"] = "FALSE_POSITIVE"


class Greedy:
    """COR-03: each finding joins the finding that first claimed one of its keys, tried in order; new keys go to the finding it joined.

    Findings are taken one at a time, so only the merged ones are held.
    """

    def __init__(self) -> None:
        self.owner: dict[str, dict] = {}
        self.out: list[dict] = []

    def add(self, row: dict) -> None:
        keys = row.pop("keys")
        target = next((self.owner[k] for k in keys if k in self.owner), None)
        if target is None:
            row["merged"] = 0
            self.out.append(row)
            target = row
        else:
            merge_into(target, row)
            target["merged"] += 1
        for k in keys:
            self.owner.setdefault(k, target)


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds rows that come sorted by block and input order."""
    block, held, schema = None, Greedy(), None
    done: list[dict] = []
    for b in batches:
        if schema is None:
            schema = pa.schema([*(f for f in b.schema if f.name not in ("block", "keys")), pa.field("merged", pa.int32())])
        for part in range(0, b.num_rows, 500):
            for row in b.slice(part, 500).to_pylist():
                at = row.pop("block")
                if at != block:
                    done += held.out
                    held = Greedy()
                    if len(done) >= 2000:
                        yield pa.RecordBatch.from_pylist(done, schema=schema)
                        done = []
                block = at
                held.add(row)
    if done or held.out:
        yield pa.RecordBatch.from_pylist(done + held.out, schema=schema)


def blocks(keyed: DataFrame) -> DataFrame:
    """``(id, label)``: findings that any chain of shared keys links have one label. The greedy result depends on nothing outside a block."""
    pairs = keyed.select("seq", F.explode("keys").alias("k"))
    first = pairs.groupBy("k").agg(F.min("seq").alias("first"))
    links = pairs.join(first, "k").where("seq <> first").select(F.col("seq").alias("a"), F.col("first").alias("b")).distinct()
    return least_labels(keyed.select(F.col("seq").alias("id"), F.col("seq").alias("label")), links)


def merged_findings(findings: DataFrame) -> DataFrame:
    """Canonical findings with ``concept`` and ``merged`` (how many were merged into each); `seq` gives the order and must be unique."""
    keyed = materialise(with_keys(conform(findings)), "correlate-keys")
    labels = blocks(keyed).withColumnRenamed("id", "__id")
    placed = keyed.join(labels, keyed.seq == labels["__id"]).drop("__id").withColumnRenamed("label", "block")
    placed = placed.repartition("block").sortWithinPartitions("block", "seq")
    ddl = ", ".join(f"`{n}` {t}" for n, t in placed.dtypes if n not in ("block", "keys")) + ", merged int"
    return placed.mapInArrow(_merge_blocks, ddl)


def attribute_missed(findings: DataFrame, tools: list[str]) -> DataFrame:
    """COR-05: every tool that ran and is not among a finding's sources is added as MISSED, in the order of `tools`."""
    ran = F.array(*[F.lit(t) for t in tools]).cast("array<string>")
    missed = F.filter(ran, lambda t: ~F.array_contains(_empty(F.col("sources.tool")), t))
    entry = lambda t: F.struct(t.alias("tool"), F.lit(None).cast("string").alias("sourceFindingId"), F.lit("MISSED").alias("status"), F.lit(MISSED_NOTE).alias("note"))
    return findings.withColumn("sources", F.concat(_empty(F.col("sources"), "array<struct<tool string, sourceFindingId string, status string, note string>>"), F.transform(missed, entry)))


def total_order() -> list[Column]:
    """COR-06: severity, score, confidence, path, line, then input order. Paths compare by bytes."""
    return [
        rank(F.col("severity"), SEVERITIES),
        -F.coalesce(F.col("cvss.score"), F.lit(0.0)),
        rank(F.col("confidence"), CONFIDENCES),
        path_key(F.col("location.file")),
        F.coalesce(F.col("location.startLine"), F.lit(0)),
        F.col("seq"),
    ]


def id_prefix(concept_col: Column) -> Column:
    out = F
    for cat, p in PREFIX_OF_CATEGORY.items():
        out = out.when(F.col("category") == cat, p)
    for p, names in PREFIX_OF_CONCEPT.items():
        out = out.when(concept_col.isin(*names), p)
    return out.otherwise("SEC-GEN")


def padded(n: Column) -> Column:
    return F.when(n > 999, n.cast("string")).otherwise(F.lpad(n.cast("string"), 3, "0"))


def assign_ids(findings: DataFrame, concept_col: Column | None = None) -> DataFrame:
    """COR-07: ``findingId`` from a prefix and the number in the total order within it."""
    pre = findings.withColumn("__prefix", id_prefix(concept_col if concept_col is not None else concept()))
    numbered = number_within(pre, "__prefix", total_order(), "__no")
    return numbered.withColumn("findingId", F.concat("__prefix", F.lit("-"), padded(F.col("__no")))).drop("__prefix", "__no")


def correlate(findings: DataFrame, tools: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical findings with attribution and ids, and one row of statistics (COR-03 to COR-08)."""
    canonical = materialise(merged_findings(findings), "correlate-merged")
    out = assign_ids(attribute_missed(canonical, tools or []), F.col("concept"))
    return out, correlation_stats(canonical)


def reported(col: str = "sources") -> Column:
    return F.filter(_empty(F.col(col), "array<struct<tool string, sourceFindingId string, status string, note string>>"), lambda s: s["status"] == "REPORTED")


def correlation_stats(canonical: DataFrame) -> DataFrame:
    """COR-08: input, canonical and merged counts, their ratio, and findings confirmed by several entries or by several tools."""
    n, m = F.count("*"), F.coalesce(F.sum("merged"), F.lit(0))
    return canonical.agg(
        (n + m).alias("inputFindings"), n.alias("canonicalFindings"), m.alias("mergedAway"),
        F.when(n + m > 0, F.round(m / (n + m), 3)).otherwise(F.lit(0.0)).alias("dedupRatio"),
        F.count_if(F.size(reported()) > 1).alias("multiToolConfirmed"),
        F.count_if(F.size(F.array_distinct(reported()["tool"])) > 1).alias("distinctToolsConfirmed"),
    )


def rule_family() -> Column:
    """Tool and rule that make a family; null for findings that are never folded."""
    tool = F.lower(F.coalesce(F.when(F.get(F.col("sources"), F.lit(0))["tool"] != "", F.get(F.col("sources"), F.lit(0))["tool"]), F.lit("unknown")))
    rule = F.coalesce(F.when(F.get(F.col("detection.rules"), F.lit(0))["ruleId"] != "", F.get(F.col("detection.rules"), F.lit(0))["ruleId"]), F.when(F.col("subcategory") != "", F.col("subcategory")), F.col("title"), F.lit("undefined"))
    exempt = F.coalesce(F.col("severity") == "INFO", F.lit(False)) | F.coalesce(F.col("category") == "dependency", F.lit(False))
    return F.when(~exempt, F.concat(tool, F.lit(":"), rule))


def consolidate(findings: DataFrame, max_locations: int = 500) -> DataFrame:
    """COR-09: hits of one tool and rule fold into the first of them; at most `max_locations` others are listed as places.

    The first member comes by a pre-aggregated minimum; each shuffle partial keeps no more than the places that can be
    listed, found by a rank filter that runs before the exchange, so a rule with a third of all hits is no single task's load.
    """
    keyed = conform(findings).withColumn("__family", F.coalesce(rule_family(), F.concat(F.lit("\x00"), F.col("seq").cast("string"))))
    w = Window.partitionBy("__family").orderBy("seq")
    base = keyed.select("__family", "seq", "location", "subcategory", "sources", "severity", "confidence")
    first = base.groupBy("__family").agg(
        F.min("seq").alias("__first"), F.count("*").alias("__n"),
        F.min(rank(F.col("severity"), SEVERITIES)).alias("__sev"), F.min(rank(F.col("confidence"), CONFIDENCES)).alias("__conf"),
    )
    place = F.struct(
        F.col("seq"),
        F.struct(F.coalesce(F.when(F.col("location.file") != "", F.col("location.file")), F.lit("(unknown)")).alias("file"), F.coalesce("location.startLine", F.lit(0)).alias("startLine"), F.when(F.col("subcategory") != "", F.col("subcategory")).alias("note")).alias("at"),
    )
    capped = base.withColumn("__k", F.row_number().over(w)).where((F.col("__k") > 1) & (F.col("__k") <= max_locations + 1))
    places = capped.groupBy("__family").agg(F.transform(F.sort_array(F.collect_list(place)), lambda p: p["at"]).alias("__places"))
    entries = base.select("__family", "seq", F.posexplode("sources").alias("__i", "__s")).groupBy("__family", F.col("__s.tool").alias("__t"), F.coalesce("__s.sourceFindingId", F.lit("")).alias("__r"))
    entries = entries.agg(F.min(F.struct("seq", "__i", "__s")).alias("__e")).groupBy("__family").agg(F.transform(F.sort_array(F.collect_list("__e")), lambda e: e["__s"]).alias("__sources"))
    # families and first rows are matched by the row as well, so a family with most rows is spread like any other
    kept = keyed.join(first.withColumn("seq", F.col("__first")), ["__family", "seq"]).join(places, "__family", "left").join(entries, "__family", "left")
    pick = lambda name, order: F.when((F.col("__n") > 1) & (F.col(f"__{name}") < UNKNOWN_RANK), F.element_at(F.array(*[F.lit(v) for v in order]), F.least(F.col(f"__{name}") + 1, F.lit(len(order)))))
    old = F.coalesce(F.col("location.additionalLocations"), F.array().cast("array<struct<file string, startLine int, note string>>"))
    room = F.greatest(F.lit(0), F.lit(max_locations) - F.size(old))
    extra = F.concat(old, F.slice(F.coalesce(F.col("__places"), F.array().cast("array<struct<file string, startLine int, note string>>")), F.lit(1), room))
    rule = F.coalesce(F.when(F.get(F.col("detection.rules"), F.lit(0))["ruleId"] != "", F.get(F.col("detection.rules"), F.lit(0))["ruleId"]), F.when(F.col("subcategory") != "", F.col("subcategory")))
    extras = F.size("__extra") > 0
    return (
        kept.withColumn("__extra", extra)
        .withColumn("severity", F.coalesce(pick("sev", SEVERITIES), F.col("severity")))
        .withColumn("confidence", F.coalesce(pick("conf", CONFIDENCES), F.col("confidence")))
        .withColumn("sources", F.when(F.col("__n") > 1, F.col("__sources")).otherwise(F.col("sources")))
        .withColumn("location", F.col("location").withField("additionalLocations", F.when(extras, F.col("__extra"))))
        .withColumn("consolidated", F.when(extras, F.struct((F.size("__extra") + 1).alias("locations"), rule.alias("rule"))))
        .drop("__family", "__first", "__n", "__sev", "__conf", "__places", "__sources", "__extra")
    )
