"""Source trees as rows: a driver-side walk for the names, then reads spread over the executors.

Spark's own file index leaves out names that start with ``_`` or ``.``, which source trees contain; so paths are listed here
and contents read in Arrow batches. Texts are decoded as UTF-8 with replacement.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """What a walk takes: extensions or a name pattern, folders it skips, and limits. None means no limit."""

    extensions: tuple[str, ...] = ()
    names: str = ""
    skip: str = r"(?!)"
    max_depth: int | None = None
    max_files: int | None = None
    max_bytes: int | None = None


#: The walks of the engines (SCAN-01 to SCAN-05 and SCAN-07).
NATIVE = Policy((".cs", ".vb", ".config", ".json", ".csproj", ".vbproj", ".fsproj"), skip=r"(?i)^(bin|obj|packages|node_modules|tests?|Migrations|\.git|\.vs|\.idea|\.svn|\.sonarqube|TestResults)$", max_files=20_000, max_bytes=2 << 20)
DISCOVERY = Policy(names=r"(?i)\.(sln|csproj|vbproj|fsproj|config|json|asax|props)$", skip=r"(?i)^(bin|obj|packages|node_modules|\.git|\.vs)$", max_depth=12)
SUPPLY_CHAIN = Policy(names=r"(?i)^(nuget\.config|packages\.config|directory\.packages\.props|directory\.build\.(props|targets)|packages\.lock\.json|(install|init)\.ps1|.*\.(csproj|vbproj|fsproj|nuspec|props|targets))$", skip=r"(?i)^(bin|obj|node_modules|\.git|\.vs|\.svn|\.idea|\.sonarqube|TestResults|dist|out)$", max_depth=15, max_bytes=2 << 20)
ASSEMBLIES = Policy((".dll", ".exe"), skip=r"(?i)^(node_modules|\.git|\.vs)$", max_depth=10, max_files=5_000)
CONFIGS = Policy(names=r"(?i)^(web|app)(\.\w+)?\.config$|\.(dll|exe)\.config$", skip=r"(?i)^(node_modules|\.git|\.vs)$", max_depth=6, max_files=50)
DEPS = Policy(names=r"(?i)\.deps\.json$", skip=r"(?i)^(node_modules|\.git|\.vs)$", max_depth=6, max_files=20)
PACKAGES = Policy(names=r"(?i)^packages\.config$", skip=r"(?i)^(bin|obj|packages|node_modules|\.git|\.vs|tests?|Migrations)$", max_depth=6)
REVIEWED = Policy((".cs", ".config", ".json"), skip=r"(?i)^(bin|obj|packages|node_modules|\.git|\.vs|\.sonarqube)$", max_bytes=60_000)


def walk(root: str, policy: Policy) -> tuple[list[tuple[str, str, int, float]], list[str], bool]:
    """``(path below root, absolute path, size, mtime)`` of each file, what was left out, and whether a limit stopped the walk."""
    files: list[tuple[str, str, int, float]] = []
    left_out: list[str] = []
    skip, names = re.compile(policy.skip), re.compile(policy.names) if policy.names else None
    todo = [(root, 0)]
    while todo:
        folder, depth = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            left_out.append(f"{os.path.relpath(folder, root)} (unreadable)")
            continue
        deeper = []
        for e in entries:
            rel = os.path.relpath(e.path, root).replace(os.sep, "/")
            if e.is_dir(follow_symlinks=False):
                if skip.search(e.name):
                    left_out.append(rel + "/")
                elif policy.max_depth is None or depth < policy.max_depth:
                    deeper.append((e.path, depth + 1))
                continue
            if policy.extensions and os.path.splitext(e.name)[1].lower() not in policy.extensions or names and not names.search(e.name):
                continue
            if policy.max_files is not None and len(files) >= policy.max_files:
                return files, left_out, True
            try:
                st = e.stat()
            except OSError:
                continue
            if st.st_size and (policy.max_bytes is None or st.st_size <= policy.max_bytes):
                files.append((rel, e.path, st.st_size, st.st_mtime))
            elif st.st_size:
                left_out.append(f"{rel} (too large)")
        todo.extend(reversed(deeper))
    return files, left_out, False


def list_files(spark: SparkSession, root: str, policy: Policy, project: str = "") -> DataFrame:
    """``(project, seq, path, full, size, modified)`` of a tree."""
    rows = [(project, i, *f) for i, f in enumerate(walk(root, policy)[0])]
    return spark.createDataFrame(rows, "project string, seq bigint, path string, full string, size bigint, modified double")


def _read(binary: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                try:
                    with open(row["full"], "rb") as f:
                        data = f.read()
                except OSError:
                    data = None
                body = data if binary else None if data is None else data.decode("utf-8", "replace")
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("project", "seq", "path", "size", "modified")} | {"content" if binary else "text": body}], schema=pa.schema([("project", pa.string()), ("seq", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("modified", pa.float64()), ("content", pa.binary()) if binary else ("text", pa.string())]))

    return run


_HEAD = "project string, seq bigint, path string, size bigint, modified double"


def read_texts(files: DataFrame) -> DataFrame:
    """Files with their text; null where a file cannot be read."""
    return files.repartition("path").mapInArrow(_read(False), f"{_HEAD}, text string")


def read_bytes(files: DataFrame) -> DataFrame:
    return files.repartition("path").mapInArrow(_read(True), f"{_HEAD}, content binary")


#: In this order files are proposed for a model's review.
REVIEW_ORDER = (r"(?i)auth", r"(?i)identity|login|token|jwt|principal", r"(?i)startup|global\.asax|program\.cs", r"(?i)config", r"(?i)middleware|filter|handler", r"(?i)repositor|dataaccess|dbcontext", r"(?i)controller", r"(?i)service")


def review_selection(files: DataFrame, max_files: int = 12, max_bytes: int = 60_000) -> DataFrame:
    """SCAN-07: the first files by kind of name, then by place in the walk."""
    score = F
    for i, p in enumerate(REVIEW_ORDER):
        score = score.when(F.col("path").rlike(p), i)
    return files.where((F.col("size") > 0) & (F.col("size") <= max_bytes)).withColumn("score", score.otherwise(len(REVIEW_ORDER))).orderBy("score", "seq").limit(max_files)


def changed_files(spark: SparkSession, repo: str, base: str, merge_base: bool = True) -> DataFrame:
    """SCAN-34: ``(path)`` of the files that git sees changed against `base`; against the common ancestor unless `merge_base` is off."""
    import subprocess

    if base.startswith("-"):
        raise ValueError("a revision, not an option")
    out = subprocess.run(["git", "-C", repo, "diff", "--name-only", "-z", f"{base}{'...' if merge_base else '..'}HEAD"], capture_output=True, check=True)
    return spark.createDataFrame([(p,) for p in out.stdout.decode("utf-8", "replace").split("\0") if p], "path string")
