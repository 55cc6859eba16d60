"""Stored JSON: catalogs of cases, earlier reports, baselines, settings (SCAN-08, SCAN-09, SCAN-35, SCAN-36, UDX)."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritmill.operators.baseline import ENTRY_DDL
from gritmill.schema import FINDING_DDL

CASE_DDL = "id string, category string, title string, lookFor string, expected string, stack string, type string, priority string, automatable string, cwe string"


def _documents(spark: SparkSession, paths: list[str], ddl: str) -> DataFrame:
    """Parsed documents with ``file``; a document that is no JSON gives nulls."""
    text = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return text.select("file", F.from_json("value", ddl).alias("d"))


def read_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """SCAN-09: the cases of all catalogs of a folder, by file name and place; a folder that is missing or empty gives none."""
    paths = sorted(str(p) for p in Path(folder).glob("*.json")) if os.path.isdir(folder) else []
    if not paths:
        return spark.createDataFrame([], f"file string, no int, {CASE_DDL}")
    d = _documents(spark, paths, f"tests array<struct<{CASE_DDL}>>")
    return d.select("file", F.posexplode("d.tests").alias("no", "t")).select("file", "no", "t.*").orderBy("file", "no")


def read_reviews(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SCAN-36: the findings of authored review files, in order of file name and place, numbered through."""
    fields = FINDING_DDL.replace("seq bigint,", "", 1).strip()
    d = _documents(spark, paths, f"findings array<struct<{fields}>>").select(F.element_at(F.split("file", "/"), -1).alias("file"), F.posexplode("d.findings").alias("no", "f"))
    order = F.array_position(F.array(*[F.lit(n) for n in sorted({os.path.basename(p) for p in paths})]), F.col("file"))  # file names, given by the caller
    return d.select((order * (1 << 32) + F.col("no")).alias("seq"), "f.*")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """SCAN-35: entries of a baseline file with ``entry_seq``."""
    d = _documents(spark, [path], f"entries array<struct<{ENTRY_DDL}>>")
    return d.select(F.posexplode("d.entries").alias("n", "e")).select(F.col("n").cast("bigint").alias("entry_seq"), "e.*")


def newest_export(start: str, name: str = ".sonarqube", up: int = 4) -> str | None:
    """SCAN-08: the newest run folder, by name, below `name` in `start` or one of its ancestors."""
    at = Path(start).resolve()
    for folder in [at, *at.parents][: up + 1]:
        if (folder / name).is_dir():
            runs = sorted((p for p in (folder / name).iterdir() if p.is_dir()), key=lambda p: p.name, reverse=True)
            if runs:
                return str(runs[0])
    return None


def merged_settings(*layers: dict) -> dict:
    """Settings by precedence, the first layer strongest: nested objects merge, other values replace, None does not count."""
    out: dict = {}
    for layer in reversed(layers):
        for k, v in layer.items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = merged_settings(v, out[k])
            elif v is not None:
                out[k] = merged_settings(v) if isinstance(v, dict) else v
    return out


_SENSITIVE = re.compile(r"(?i)^(?:key|apikey|api[_-]?key|token|secret|password|authorization|creds?|credentials)$")


def redacted_settings(value: object, name: str = "") -> object:
    """Settings for display: values under a credential's name, and everything below ``keys``, show their last four characters at most."""
    if isinstance(value, dict):
        return {k: redacted_settings(v, "secret" if name == "keys" or _SENSITIVE.match(k) else k) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted_settings(v, name) for v in value]
    if isinstance(value, str) and name == "secret":
        return "****" + value[-4:] if value else "(not set)"
    return value


def write_inventory(tables: dict[str, DataFrame], folder: str) -> None:
    """SINK-12: inventories as Parquet, one folder a table; texts and file contents are left out."""
    for name, df in tables.items():
        df.drop("text", "content").write.mode("overwrite").parquet(f"{folder}/{name}")
