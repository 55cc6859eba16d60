"""CSV and SARIF rows (SINK-02 to SINK-04), report JSON (SINK-01), manual queue (SINK-09) and tallies (SINK-14)."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritmill.functions.normalise import first_sentence
from gritmill.operators.correlate import reported

#: The columns of the CSV file.
CSV_COLUMNS = "id severity confidence category cwe title file line tools confirmed_by problem recommendation snippet".split()


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def csv_rows(findings: DataFrame) -> DataFrame:
    """SINK-04: one row for each place of a finding, the primary first; ``seq`` and ``place`` give the order of rows."""
    place = "array<struct<file:string, startLine:int>>"
    extras = F.transform(F.coalesce(F.col("location.additionalLocations"), F.array().cast("array<struct<file:string, startLine:int, note:string>>")), lambda x: F.struct(x["file"].alias("file"), x["startLine"].alias("startLine")))
    places = F.concat(F.array(F.struct(F.col("location.file").alias("file"), F.col("location.startLine").alias("startLine"))), extras.cast(place))
    none = F.array().cast("array<string>")
    tools = F.array_join(F.array_distinct(F.coalesce(F.col("sources.tool"), none)), "+")
    by = reported()["tool"]
    f = findings.select("*", tools.alias("__tools"), F.when(F.size(by) > 1, F.array_join(by, "+")).otherwise("").alias("__by"), F.size(places).alias("__n"), F.posexplode(places).alias("place", "__at"))
    first = F.col("place") == 0
    more = F.concat(_text(F.col("problem")), F.lit(" (additional location "), (F.col("place") + 1).cast("string"), F.lit(" of "), F.col("__n").cast("string"), F.lit(")"))
    return f.select(
        "seq", "place", _text(F.col("findingId")).alias("id"), _text(F.col("severity")).alias("severity"), _text(F.col("confidence")).alias("confidence"), _text(F.col("category")).alias("category"), F.array_join(F.coalesce("cwe", none), " ").alias("cwe"), _text(F.col("title")).alias("title"),
        _text(F.col("__at.file")).alias("file"), F.when(F.col("__at.startLine") != 0, F.col("__at.startLine").cast("string")).otherwise("").alias("line"), F.col("__tools").alias("tools"), F.col("__by").alias("confirmed_by"),
        F.when(first, _text(F.col("problem"))).otherwise(more).alias("problem"), F.when(first, _text(F.col("recommendation"))).otherwise("").alias("recommendation"), F.when(first, F.replace(_text(F.col("evidence.snippet")), F.lit("\r"), F.lit(""))).otherwise("").alias("snippet"),
    )


def csv_lines(rows: DataFrame) -> DataFrame:
    """``(seq, place, line)``: rows as CSV text; line ends inside quoted fields stay as they are."""
    quoted = lambda c: F.when(F.col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return rows.select("seq", "place", F.concat_ws(",", *[quoted(c) for c in CSV_COLUMNS]).alias("line"))


def write_csv(findings: DataFrame, path: str) -> int:
    """One file on the driver with CRLF row ends; rows stream through, so the file's size is no limit. Gives the number of rows."""
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(",".join(CSV_COLUMNS) + "\r\n")
        for r in csv_lines(csv_rows(findings)).orderBy("seq", "place").toLocalIterator(prefetchPartitions=True):
            out.write(r.line + "\r\n")
            n += 1
    return n


def _level(c: Column) -> Column:
    return F.when(c.isin("CRITICAL", "HIGH"), "error").when(c == "MEDIUM", "warning").otherwise("note")


def sarif_rows(findings: DataFrame, extended: bool = False) -> DataFrame:
    """SINK-02 and, `extended`, SINK-03: ``(seq, rule, result)`` structs of each finding in SARIF's shape."""
    none = F.array().cast("array<string>")
    level = _level(F.col("severity"))
    impact = F.when(F.col("impact") != "", F.concat(F.lit(" — "), F.split("impact", r"\. ")[0], F.lit(".")))
    precision = F.when(F.col("confidence") == "CONFIRMED", "very-high").when(F.col("confidence") == "LIKELY", "high").when(F.col("confidence") == "POSSIBLE", "medium").when(F.col("confidence") == "UNVERIFIED", "low")
    text = lambda c: F.struct(c.alias("text"))
    tags = F.filter(F.concat(F.array("category"), F.coalesce("cwe", none), F.coalesce("owasp", none)), lambda t: t.isNotNull() & (t != ""))
    props = [tags.alias("tags"), F.col("cvss.score").cast("string").alias("security-severity"), precision.alias("precision")]
    rule = [F.col("findingId").alias("id"), text(F.col("title")).alias("shortDescription"), text(F.coalesce(F.when(F.col("problem") != "", F.col("problem")), F.col("title"))).alias("fullDescription"), text(F.coalesce("recommendation", F.lit(""))).alias("help"), F.struct(level.alias("level")).alias("defaultConfiguration"), F.struct(*props).alias("properties")]
    start = F.coalesce(F.when(F.col("location.startLine") != 0, F.col("location.startLine")), F.lit(1))
    where = lambda file, a, b: F.struct(F.struct(F.struct(F.translate(F.coalesce(file, F.lit("")), "\\", "/").alias("uri")).alias("artifactLocation"), F.struct(a.alias("startLine"), b.alias("endLine")).alias("region")).alias("physicalLocation"))
    result = [
        F.col("findingId").alias("ruleId"), level.alias("level"), text(F.concat(F.coalesce("title", F.lit("")), F.coalesce(impact, F.lit("")))).alias("message"), F.array(where(F.col("location.file"), start, F.coalesce("location.endLine", start))).alias("locations"),
        F.struct(F.col("findingId").alias("findingId")).alias("partialFingerprints"), F.struct(F.col("confidence"), F.col("status"), F.transform(F.coalesce("sources", F.array().cast("array<struct<tool string, sourceFindingId string, status string, note string>>")), lambda s: F.concat_ws(":", s["tool"], s["status"])).alias("sources"), *([F.col("priority")] if extended else [])).alias("properties"),
    ]
    if extended:
        rule.insert(1, F.col("subcategory").alias("name"))
        line = lambda x: F.coalesce(x["startLine"], F.lit(1))
        result.append(F.transform("location.additionalLocations", lambda x: where(x["file"], line(x), line(x))).alias("relatedLocations"))
    return findings.select("seq", F.struct(*rule).alias("rule"), F.struct(*result).alias("result"))


def write_sarif(findings: DataFrame, path: str, tool: str = "gritmill", version: str = "1", extended: bool = False) -> None:
    """One SARIF file on the driver; rules and results stream through in input order."""
    rows = sarif_rows(findings, extended).select("seq", F.to_json("rule").alias("rule"), F.to_json("result").alias("result")).orderBy("seq")
    tmp = f"{path}.results"
    with open(path, "w", encoding="utf-8") as out, open(tmp, "w", encoding="utf-8") as results:
        out.write(f'{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":[')
        for i, r in enumerate(rows.toLocalIterator()):
            out.write("," * (i > 0) + r.rule)
            results.write("," * (i > 0) + r.result)
        results.flush()
        out.write(']}},"results":[')
        with open(tmp, encoding="utf-8") as done:
            for part in iter(lambda: done.read(1 << 20), ""):
                out.write(part)
        out.write("]}]}")
    os.remove(tmp)


def finding_json(findings: DataFrame) -> DataFrame:
    """``(seq, json)``: absent fields are left out, but ``cvss`` is always there, as null where no model applies."""
    body = F.to_json(F.struct(*[c for c in findings.columns if c != "seq"]))
    return findings.select("seq", F.when(F.col("cvss").isNull(), F.concat(F.left(body, F.length(body) - 1), F.lit(',"cvss":null}'))).otherwise(body).alias("json"))


def write_report(findings: DataFrame, manual: DataFrame, summary: dict, path: str) -> None:
    """SINK-01: summary, findings and manual queue in one JSON file, streamed."""
    import json

    with open(path, "w", encoding="utf-8") as out:
        out.write('{"summary":' + json.dumps(summary, default=str))
        for name, df in (("findings", findings), ("manualReview", manual)):
            out.write(f',"{name}":[')
            for i, r in enumerate(finding_json(df).orderBy("seq").toLocalIterator()):
                out.write("," * (i > 0) + r.json)
            out.write("]")
        out.write("}")


def read_report(spark, path: str) -> DataFrame:
    """SCAN-35: the findings of a report file, in order."""
    from gritmill.schema import FINDING_DDL

    ddl = f"findings array<struct<{FINDING_DDL.replace('seq bigint,', '').strip()}>>"
    doc = spark.read.text(str(Path(path)), wholetext=True).select(F.from_json("value", f"struct<{ddl}>").alias("d"))
    return doc.select(F.posexplode("d.findings").alias("n", "f")).select(F.col("n").cast("bigint").alias("seq"), "f.*")


def split_manual(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """COR-10: what can be acted on, and what people have to decide."""
    undecided = F.coalesce(F.col("detection.class") == "MANUAL_REVIEW", F.lit(False))
    return findings.where(~undecided), findings.where(undecided)


def manual_queue(manual: DataFrame) -> DataFrame:
    """SINK-09: how many undecided cases each category has."""
    return manual.groupBy("category").agg(F.count("*").alias("n"))


def secret_rollup(findings: DataFrame, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """SINK-14: secret hits by rule, and the most frequent ends of paths (two steps)."""
    parts = F.split(F.translate(F.coalesce("location.file", F.lit("")), "\\", "/"), "/")
    end = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")
    by_rule = findings.groupBy(F.col("subcategory").alias("rule")).agg(F.count("*").alias("n"))
    by_path = findings.groupBy(end.alias("place")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "place").limit(most)
    return by_rule, by_path


def headlines(findings: DataFrame) -> DataFrame:
    """``(seq, headline)``: title and the first sentence of the impact."""
    return findings.select("seq", F.concat_ws(" — ", "title", F.when(F.col("impact") != "", first_sentence(F.col("impact")))).alias("headline"))
