"""Builders of small findings."""

from __future__ import annotations

import json

from gritmill.schema import FINDING_DDL, conform


def finding(seq, **kw):
    """A finding with harmless defaults; `file`, `line`, `tool`, `rule` and `snippet` are short forms."""
    base = {
        "seq": seq, "title": "t", "category": "security", "subcategory": kw.pop("rule", f"R{seq}"), "severity": "MEDIUM", "confidence": "LIKELY", "status": "OPEN", "problem": "p",
        "location": {"file": kw.pop("file", "src/A.cs"), "startLine": kw.pop("line", 10)}, "evidence": {"snippet": kw.pop("snippet", "code"), "language": "csharp"},
    }
    tool = kw.pop("tool", "tool-a")
    base["sources"] = [{"tool": tool, "sourceFindingId": base["subcategory"], "status": "REPORTED"}]
    return base | kw


def frame(spark, rows):
    if not rows:
        return spark.createDataFrame([], FINDING_DDL)
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    from pyspark.sql import functions as F

    return conform(text.select(F.from_json("j", FINDING_DDL).alias("f")).select("f.*"))
