"""Markdown, vault pages, spreadsheet and narrative blocks (SINK-05 to SINK-08, SINK-10, SINK-11, SINK-13)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gritmill.operators import rollups as R
from gritmill.schema import SEVERITIES, rank

_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_PAGE = re.compile(r"^[A-Z]+(?:-[A-Z]+)*-\d{3,}\.md$")
SHEET_NS = "urn:schemas-microsoft-com:office:spreadsheet"


def html(s: object) -> str:
    return str("" if s is None else s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def cell(s: object) -> str:
    """Text of a spreadsheet cell: illegal characters out, one kind of line end, entities."""
    t = _ILLEGAL.sub("", str("" if s is None else s)).replace("\r\n", "\n").replace("\r", "\n")
    return html(t).replace('"', "&quot;").replace("'", "&apos;")


def _tools(f: Row, status: str) -> list[str]:
    return [s.tool for s in f.sources or [] if s.status == status]


def _place(f: Row) -> str:
    return f"{f.location.file if f.location else ''}{':' + str(f.location.startLine) if f.location and f.location.startLine else ''}"


def table(head: list[str], rows: Iterable[Iterable[object]]) -> str:
    body = "".join("| " + " | ".join(html(x).replace("|", "\\|").replace("\n", " ") for x in r) + " |\n" for r in rows)
    return f"| {' | '.join(head)} |\n|{'---|' * len(head)}\n{body}"


def section(f: Row, level: int = 2) -> str:
    """A finding in Markdown under a stable anchor."""
    name = f.findingId or "unlinked"
    fields = [
        ("Severity", f.severity), ("CVSS", f"{f.cvss.score} ({f.cvss.severity})" if f.cvss else "N/A"), ("Confidence", f.confidence), ("Category", f.category), ("CWE", ", ".join(f.cwe or []) or "—"),
        ("Location", _place(f)), ("Found by", ", ".join(_tools(f, "REPORTED")) or "—"), ("Missed by", ", ".join(_tools(f, "MISSED")) or "—"), ("Status", f.status or "OPEN"),
    ]
    if f.tests:
        fields.append(("Catalog cases", " ".join(f.tests)))
    out = [f'<a id="{html(name)}"></a>\n\n{"#" * level} {html(name)} — {html(f.title)}\n\n{table(["Field", "Value"], fields)}']
    out += [f"**{t}.** {html(v)}\n" for t, v in (("Problem", f.problem), ("Impact", f.impact), ("Fix", f.recommendation)) if v]
    if f.evidence and f.evidence.snippet:
        out.append(f"```{f.evidence.language or 'text'}\n{f.evidence.snippet}\n```\n" + ("*Secret material is redacted.*\n" if f.evidence.redacted else ""))
    return "\n".join(out)


def markdown(findings: DataFrame, title: str = "Code review") -> Iterator[str]:
    """SINK-07: pieces of one Markdown document: totals, index, then sections by severity. Findings stream through in order."""
    totals = {r.severity: r.n for r in R.severity_totals(findings).collect()}
    yield f"# {title}\n\n" + table(["Severity", "Count"], [(s, totals[s]) for s in SEVERITIES if totals.get(s)]) + "\n"
    yield "| Finding | Severity | Location |\n|---|---|---|\n"
    for f in findings.orderBy("seq").toLocalIterator():
        name = f.findingId or "unlinked"
        yield f"| [{html(name)}](#{quote(name)}) {html(f.title)[:90]} | {f.severity} | `{html(_place(f))}` |\n"
    last = None
    for f in findings.where(F.col("severity").isin(*SEVERITIES)).orderBy(rank(F.col("severity"), SEVERITIES), "seq").toLocalIterator():
        if f.severity != last:
            yield f"\n---\n\n# {f.severity}\n\n"
            last = f.severity
        yield section(f) + "\n"


def vault_pages(findings: DataFrame, project: str = "project") -> dict[str, str]:
    """SINK-08: the overview pages, each a query over dimensions or the whole list of its findings, which streams through."""
    rows = lambda df, *cols: [[r[c] for c in cols] for r in df.collect()]
    risk = R.overall_risk(findings).first().risk
    top = R.top_findings(findings, 10).collect()
    dep = findings.withColumn("queue", R.dependency_queue()).where("queue IS NOT NULL")
    listed = lambda df: ((f.findingId, f.severity, f.title) for f in df.orderBy(*R.projection_order()).toLocalIterator())
    head = ["Finding", "Severity", "Title"]
    cov = findings.select(F.explode("tests").alias("case")).groupBy("case").agg(F.count("*").alias("n")).orderBy("case")
    return {
        "00-Executive-Summary.md": f"# {project}\n\nOverall risk: **{risk}**\n\n" + table(["Severity", "Count"], rows(R.severity_totals(findings), "severity", "n")) + "\n" + table(head, [(f.findingId, f.severity, f.title) for f in top]),
        "01-Findings.md": "# Findings\n\n" + table(head, listed(findings)),
        "02-Tool-Results.md": "# Tools\n\n" + table(["Tool", "Reported", "Missed"], rows(R.tool_pivot(findings).orderBy("tool"), "tool", "reported", "missed")),
        "03-Dependencies-Security.md": "# Dependencies with advisories\n\n" + table(head, listed(dep.where("queue = 'security'"))),
        "04-Dependencies-Maintenance.md": "# Dependencies to maintain\n\n" + table(head, listed(dep.where("queue = 'maintenance'"))),
        "05-Test-Coverage.md": "# Cases\n\n" + table(["Case", "Findings"], rows(cov, "case", "n")),
        "06-Configuration.md": "# Configuration\n\n" + table(head, listed(findings.where("category = 'configuration'"))),
        "07-Correlation-and-Dedup.md": "# Tools that missed\n\n" + table(["Tool", "Missed"], rows(R.false_negatives(findings).orderBy("tool"), "tool", "n")),
        "08-Remediation-Roadmap.md": "# Roadmap\n\n" + table(["Priority", "Findings"], rows(R.roadmap(findings).orderBy("priority"), "priority", "n")),
    }


def write_vault(findings: DataFrame, folder: str, project: str = "project") -> int:
    """Writes overview pages and a page for each finding; removes generated pages of findings that are gone, keeps all other notes."""
    root = Path(folder)
    (root / "findings").mkdir(parents=True, exist_ok=True)
    for name, text in vault_pages(findings, project).items():
        (root / name).write_text(text, encoding="utf-8")
    kept = set()
    for f in findings.where("findingId IS NOT NULL").orderBy("seq").toLocalIterator():
        page = f"{re.sub(r'[^A-Za-z0-9._-]', '_', f.findingId)}.md"
        kept.add(page)
        (root / "findings" / page).write_text(section(f, 1), encoding="utf-8")
    for p in (root / "findings").iterdir():
        if _PAGE.match(p.name) and p.name not in kept:
            p.unlink()
    return len(kept)


def topic_pages(findings: DataFrame) -> dict[str, DataFrame]:
    """SINK-10: topic reports as filters over the findings, by kind of matter."""
    cat = lambda *c: findings.where(F.col("category").isin(*c))
    scored = F.col("cvss").isNotNull()
    return {
        "01-security": cat("security"), "02-configuration": cat("configuration"), "03-dependencies-security": cat("dependency").where(scored), "04-dependencies-maintenance": cat("dependency").where(~scored),
        "05-architecture": cat("architecture"), "06-performance": cat("performance"), "07-reliability": cat("reliability"), "08-code-quality": cat("code-quality"), "09-testing": cat("testing"), "10-deployment": cat("deployment", "process"),
        "11-observability": cat("observability"), "12-environment-dependent": findings.where("status = 'NEEDS_ENVIRONMENT'"), "13-accepted": findings.where("status IN ('ACCEPTED_RISK', 'SUPPRESSED')"), "14-false-positives": findings.where("status = 'FALSE_POSITIVE'"), "15-multi-tool": findings.where(F.size(R.reported()) > 1),
    }


def _sheet(name: str, rows: Iterable[Iterable[object]]) -> str:
    def one(v: object, head: bool) -> str:
        kind = "Number" if isinstance(v, (int, float)) and not isinstance(v, bool) else "String"
        return f'<Cell{" ss:StyleID=" + chr(34) + "h" + chr(34) if head else ""}><Data ss:Type="{kind}">{cell(v)}</Data></Cell>'

    body = "".join(f"<Row>{''.join(one(v, i == 0) for v in r)}</Row>" for i, r in enumerate(rows))
    safe = re.sub(r"[:\\/?*\[\]]", "-", name)[:31]
    return f'<Worksheet ss:Name="{cell(safe)}"><Table>{body}</Table></Worksheet>'


def spreadsheet(findings: DataFrame, coverage: DataFrame | None = None, most: int = 100_000) -> str:
    """SINK-05: SpreadsheetML with the sheets Summary, Findings and Coverage; findings go on in further sheets after `most` rows each."""
    summary: list[list[object]] = [["Summary", ""], ["Total findings", findings.count()]]
    summary += [[r.severity, r.n] for r in R.severity_totals(findings).collect() if r.n]
    summary += [[r.tool, r.reported, r.missed] for r in R.tool_pivot(findings).orderBy("tool").collect()]
    summary += [[r.value, r.n] for r in R.counts_by(findings, "category").orderBy(F.desc("n"), "value").collect()]
    head = "ID Severity Title CWE CVSS File Line Found-by Missed-by Confidence Status Remediation".split()
    rows = [[f.findingId, f.severity, f.title, ", ".join(f.cwe or []), f.cvss.score if f.cvss else "", f.location.file if f.location else "", (f.location and f.location.startLine) or "", ", ".join(_tools(f, "REPORTED")), ", ".join(_tools(f, "MISSED")), f.confidence, f.status or "OPEN", f.recommendation or ""] for f in findings.orderBy("seq").toLocalIterator()]
    cov = [["Catalog case", "Decided by", "Findings"]] + ([[r.caseId, ", ".join(r.decided_by), ", ".join(r.finding_ids)] for r in R.coverage_sheet(coverage, findings).orderBy("caseId").collect()] if coverage is not None else [["(no coverage in this run)", "", ""]])
    parts = [rows[i : i + most] for i in range(0, len(rows), most)] or [[]]
    named = "".join(_sheet("Findings" if i == 0 else f"Findings {i + 1}", [head, *p]) for i, p in enumerate(parts))
    sheets = _sheet("Summary", summary) + named + _sheet("Coverage", cov)
    style = '<Styles><Style ss:ID="h"><Font ss:Bold="1"/></Style></Styles>'
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<Workbook xmlns="{SHEET_NS}" xmlns:ss="{SHEET_NS}">{style}{sheets}</Workbook>'


def verify_spreadsheet(xml: str) -> list[str]:
    """SINK-06: what is wrong with a spreadsheet: form, sheets, names, cells."""
    if _ILLEGAL.search(xml):
        return ["illegal characters"]
    try:
        root = ET.fromstring(xml.encode("utf-8"))
    except ET.ParseError as e:
        return [f"not well-formed: {e}"]
    ns, bad = f"{{{SHEET_NS}}}", []
    sheets = root.findall(f"{ns}Worksheet")
    if not sheets:
        bad.append("no sheet")
    names = [s.get(f"{ns}Name") or "" for s in sheets]
    if len(set(names)) < len(names) or any(not n or len(n) > 31 or re.search(r"[:\\/?*\[\]]", n) for n in names):
        bad.append("bad sheet name")
    if any(d.get(f"{ns}Type") not in ("String", "Number") for d in root.iter(f"{ns}Data")):
        bad.append("bad cell type")
    return bad


def upsert_block(text: str, key: str, body: str) -> str:
    """SINK-11: the block of `key` between its markers, replaced in place or added at the end; twice is once.

    A block whose end is missing runs to the next block or the end. Repeated or crossed markers of one key are refused.
    """
    name = re.sub(r"[^A-Za-z0-9._-]", "_", key)
    start, end = f"<!-- block:{name}:begin -->", f"<!-- block:{name}:end -->"
    body = body.replace("<!-- block:", "<!- block:").strip("\n")
    if text.count(start) > 1 or text.count(end) > 1 or (end in text and (start not in text or text.index(end) < text.index(start))):
        raise ValueError(f"the markers of {key} are torn")
    new = f"{start}\n{body}\n{end}"
    if start not in text:
        return (text.rstrip("\n") + "\n\n" if text.strip() else "") + new + "\n"
    a = text.index(start)
    if end in text:
        b = text.index(end) + len(end)
        return text[:a] + new + text[b:]
    m = re.search(r"<!-- block:", text[a + len(start) :])
    rest = text[a + len(start) + m.start() :] if m else ""
    return text[:a] + new + "\n" + ("\n" + rest if rest else "")


def narrative_targets(findings: DataFrame, threshold: str = "HIGH", most: int = 10) -> tuple[DataFrame, int]:
    """AGG-15: the findings that get a narrative, in order, and how many are below the threshold."""
    from gritmill.schema import rank

    above = rank(F.col("severity"), SEVERITIES) <= SEVERITIES.index(threshold)
    return findings.where(above).orderBy(rank(F.col("severity"), SEVERITIES), "seq").limit(most), findings.where(~above).count()


def severity_bars(totals: dict[str, int], width: int = 30) -> list[str]:
    """SINK-13: a bar for each severity, at least one cell where there is any."""
    most = max([1, *totals.values()])
    return [f"{s:<9}{'█' * max(1, round(totals.get(s, 0) / most * width)) if totals.get(s) else '':<{width}} {totals.get(s, 0)}" for s in SEVERITIES]


def cut_path(path: str, most: int = 40) -> str:
    """A path cut at its left end."""
    return path if len(path) <= most else "…" + path[-(most - 1) :]
