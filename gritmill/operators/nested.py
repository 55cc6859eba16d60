"""Nested records as flat tables, by Dewey labels.

Every element of a list gets a label: its parent's label plus its own 0-based position. The parent link is the
label cut at its last ``/``; nodes are grouped into one table for each schema path. Lists are walked with
``posexplode_outer``-free generators, so the plan is scan -> generate -> project: no shuffle, and the scan
reads only the fields that the wanted table names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = "/"


def parent_of(label: Column) -> Column:
    """The label without its last step; null for a node of the topmost list."""
    return F.when(F.instr(label, SEP) > 0, F.regexp_replace(label, "/[^/]*$", ""))


def nodes(df: DataFrame, ids: list[str], lists: list[str], fields: dict[str, str | Column] | None = None) -> DataFrame:
    """The nodes under the schema path `lists`, e.g. ``["logs", "runs", "results"]``: ids, ``node``, ``parent``, and `fields`.

    `lists` starts at a column of `df`; each further name is a (dotted) field of the element before it. Null and
    empty lists give no nodes; a null element keeps its position and gives a node whose fields are null. `fields`
    maps output names to field paths of the element (``"."``: the element itself).
    """
    cur = df.select(*[F.col(i).alias(f"__id{k}") for k, i in enumerate(ids)], F.col(lists[0]).alias("__list"), F.lit(None).cast("string").alias("__up"))
    own = [f"__id{k}" for k in range(len(ids))]
    for depth, name in enumerate(lists):
        gen = cur.select(*own, "__up", F.posexplode("__list").alias("__pos", "__el"))
        label = F.concat_ws(SEP, "__up", F.col("__pos").cast("string"))
        if depth + 1 < len(lists):
            cur = gen.select(*own, label.alias("__up"), F.col(f"__el.{lists[depth + 1]}").alias("__list"))
        else:
            cur = gen.select(*own, label.alias("__node"), "__el")
    out = [F.col(f"__id{k}").alias(i) for k, i in enumerate(ids)]
    vals = [(p if isinstance(p, Column) else F.col("__el" if p == "." else f"__el.{p}")).alias(o) for o, p in (fields or {}).items()]
    return cur.select(*out, F.col("__node").alias("node"), parent_of(F.col("__node")).alias("parent"), *vals)


def _scalars(t: T.StructType, prefix: str = "") -> tuple[dict[str, str], dict[str, T.StructType]]:
    """Paths of the plain values of a struct (nested structs flattened with ``_``), and its lists of structs."""
    plain: dict[str, str] = {}
    lists: dict[str, T.StructType] = {}
    for f in t.fields:
        path = f"{prefix}`{f.name}`"
        name = path.replace("`", "").replace(".", "_")
        if isinstance(f.dataType, T.StructType):
            p, x = _scalars(f.dataType, f"{path}.")
            plain |= p
            lists |= x
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            lists[path] = f.dataType.elementType
        else:
            plain[name] = path
    return plain, lists


def shred(df: DataFrame, ids: list[str], root: str) -> dict[str, DataFrame]:
    """One table for each schema path below the list column `root`: ids, ``node``, ``parent`` and the plain fields found there.

    The set of tables follows from the schema alone, so it is the same for empty input. Join a table to its
    parent on the ids and ``parent = node``; labels sort within a list by their last step as a number. A field
    called like an id, `node` or `parent` is put out with a trailing underscore.
    """
    out: dict[str, DataFrame] = {}

    def walk(path: list[str], t: T.StructType) -> None:
        plain, lists = _scalars(t)
        taken = {*ids, "node", "parent"}
        out["/".join(p.replace("`", "") for p in path)] = nodes(df, ids, path, {f"{n}_" if n in taken else n: p for n, p in plain.items()})
        for p, el in lists.items():
            walk([*path, p], el)

    el = df.schema[root].dataType.elementType
    walk([f"`{root}`"], el)
    return out


#: A payload is one project or a list of them; ``identifiers`` stays text because its CVE is a string or a list of strings.
SNYK_DDL = "array<struct<projectName:string, displayTargetFile:string, packageManager:string, vulnerabilities:array<struct<id:string, title:string, severity:string, cvssScore:double, packageName:string, version:string, `from`:array<string>, isUpgradable:boolean, upgradePath:array<string>, fixedIn:array<string>, identifiers:struct<CVE:string, CWE:string>>>>>"


def string_or_list(c: Column) -> Column:
    """JSON text of a list as an array of strings; other text as a list of one; null stays null."""
    return F.when(c.isNull(), F.lit(None)).when(c.rlike(r"^\s*\["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def snyk_projects(snyk: DataFrame, ids: list[str], payload: str = "payload") -> DataFrame:
    """`ids` and ``projects``: the payload as a list of projects, a single one as a list of one; null where it is not complete JSON.

    ``try_parse_json`` judges completeness (a truncated text is null as a whole; inside brackets it also sees text
    after the end), ``from_json`` gives the typed fields.
    """
    ok = F.try_parse_json(payload).isNotNull() & F.try_parse_json(F.concat(F.lit("["), F.col(payload), F.lit("]"))).isNotNull()
    whole = F.when(F.col(payload).rlike(r"^\s*\{"), F.concat(F.lit("["), F.col(payload), F.lit("]"))).otherwise(F.col(payload))
    return snyk.select(*ids, F.when(ok, F.from_json(whole, SNYK_DDL)).alias("projects"))


def identifier_tables(roslyn: DataFrame, trivy: DataFrame, snyk: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of rule ids, package names and CVE ids with ids, ``node`` and ``parent``."""
    cve = F.transform(F.col("__el.vulnerabilities"), lambda v: F.struct(string_or_list(v["identifiers"]["CVE"]).alias("cve")))
    projects = nodes(snyk_projects(snyk, ["delivery_id"]), ["delivery_id"], ["projects"], {"vulns": cve})
    vulns = projects.select("delivery_id", F.col("node").alias("up"), F.posexplode("vulns").alias("i", "v"))
    entries = vulns.select("delivery_id", F.concat_ws(SEP, "up", F.col("i").cast("string")).alias("up"), F.posexplode("v.cve").alias("i", "value"))
    label = F.concat_ws(SEP, "up", F.col("i").cast("string"))
    return {
        "roslyn": nodes(roslyn, ["delivery_id"], ["logs", "runs", "results"], {"value": "ruleId"}),
        "trivy": nodes(trivy, ["delivery_id"], ["Results", "Vulnerabilities"], {"value": "PkgName"}),
        "snyk": entries.select("delivery_id", label.alias("node"), parent_of(label).alias("parent"), "value"),
    }


def identifier_items(roslyn: DataFrame, trivy: DataFrame, snyk: DataFrame) -> DataFrame:
    """``(src, delivery_id, item_path, item_value)`` of every non-blank identifier."""
    parts = [
        t.where(F.col("value").rlike(r"[^\s\p{Z}]")).select(F.lit(src).alias("src"), "delivery_id", F.col("node").alias("item_path"), F.col("value").alias("item_value"))
        for src, t in identifier_tables(roslyn, trivy, snyk).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
