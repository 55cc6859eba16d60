"""Supply-chain and assembly checks over inventories planted by the rows of `report`: one project, or one assembly, a row.

What a project or an assembly has follows from its row's id `i`; the files are written out and read by the parsers, while the
SQL reasons from the same facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritmill.operators import binaries, supplychain
from gritmill.plans.registry import query
from gritmill.session import table
from gritmill.sources.nuget import nuget_inventory, nuget_items

_LOCK = '{\n  "version": 1,\n  "dependencies": {\n    "net8.0": {'
_CORE = '      "Contoso.Core": {\n        "type": "Direct",\n        "requested": "[1.0.0, )",\n        "resolved": "1.0.0"'
_SERILOG = '      },\n      "Serilog": {\n        "type": "Direct",\n        "requested": "[2.0.0, )",\n        "resolved": "2.0.0",\n        "contentHash": "b"'
#: Path, for which ids there is such a file, and its parts, each for all ids or for some.
TREE = [
    (
        "nuget.config", "i % 2 = 0 OR i % 3 = 0",
        [("true", "<configuration>\n<packageSources>"), ("i % 5 = 0", "<clear />"), ("i % 3 = 0", '<add key="nuget.org" value="https://api.nuget.org/v3/index.json" />'), ("i % 2 = 0", '<add key="inner" value="https://feed.inner.invalid/v3" />'), ("true", "</packageSources>"), ("i % 22 = 0", '<disabledPackageSources>\n<add key="inner" value="true" />\n</disabledPackageSources>'), ("i % 7 = 0", '<packageSourceMapping>\n<packageSource key="inner">\n<package pattern="Contoso.*" />\n</packageSource>\n</packageSourceMapping>'), ("true", "</configuration>")],
    ),
    (
        "src/a.csproj", "true",
        [("true", '<Project Sdk="x">'), ("i % 4 = 0", '<PackageReference Include="Contoso.Core" Version="1.0.0" />'), ("i % 4 = 1", '<PackageReference Include="Contoso.Core" Version="1.*" />'), ("i % 4 = 2", '<PackageReference Include="Contoso.Core">\n<Version>[1.0,2.0)</Version>\n</PackageReference>'), ("i % 4 = 3", '<PackageReference Include="Contoso.Core" />'), ("true", '<PackageReference Include="Serilog" Version="2.0.0" />'), ("i % 6 = 0", '<PackageReference Include="Newtonsoft.Jsom" Version="13.0.1" />'), ("i % 8 IN (2, 3)", '<Import Project="..\\packages\\x.1.0\\build\\x.targets" />'), ("true", "</Project>")],
    ),
    ("Directory.Packages.props", "i % 9 = 0", [("i % 18 <> 0", '<PackageVersion Include="Contoso.Core" Version="1.0.0" />'), ("i % 18 = 0", '<PackageVersion Include="Contoso.Core" Version="3.*" />')]),
    ("packages.config", "i % 10 = 0", [("i % 20 = 0", '<package id="Old.Lib" version="[1.0,2.0)" />'), ("i % 20 <> 0", '<package id="Old.Lib" version="1.0.0" />')]),
    ("src/packages.lock.json", "i % 3 = 1", [("true", _LOCK), ("i % 2 = 0", _CORE + ',\n        "contentHash": "a"'), ("i % 2 <> 0", _CORE), ("i % 5 <> 0", _SERILOG), ("i % 11 = 0", "broken"), ("true", "      }\n    }\n  }\n}")]),
    ("packages/x.1.0/tools/install.ps1", "i % 4 = 1", [("true", "Write-Host hi")]),
    ("packages/x.1.0/build/x.targets", "i % 4 IN (2, 3)", [("true", "<Project>"), ("i % 4 = 2", '<Exec Command="x" />'), ("true", "</Project>")]),
    ("packages/x.1.0/x.nuspec", "i % 13 = 0", [("true", '<file src="tools\\install.ps1" target="tools" />')]),
]
_LOCKED, _PRIVATE, _PUBLIC = "(i % 3 = 1 AND i % 11 <> 0)", "(i % 2 = 0 AND i % 22 <> 0)", "(i % 3 = 0 OR i % 5 <> 0)"
_CONFUSED = f"{_PRIVATE} AND {_PUBLIC}"
_SURE = "CASE WHEN i % 3 = 0 THEN 'CONFIRMED' ELSE 'LIKELY' END"
_GRAVE = "CASE WHEN i % 7 = 0 THEN 'MEDIUM' ELSE 'HIGH' END"
#: Rule, severity, confidence, path and the ids it must be found for.
_EXPECTED = [
    ("nuget-dependency-confusion", _GRAVE, _SURE, "src/a.csproj", f"{_CONFUSED} AND i % 7 <> 0"),
    ("nuget-dependency-confusion", _GRAVE, _SURE, "src/a.csproj", _CONFUSED),
    ("nuget-dependency-confusion", _GRAVE, _SURE, "src/a.csproj", f"{_CONFUSED} AND i % 6 = 0"),
    ("nuget-dependency-confusion", _GRAVE, _SURE, "packages.config", f"{_CONFUSED} AND i % 10 = 0"),
    ("nuget-floating-version", "'MEDIUM'", "'CONFIRMED'", "src/a.csproj", "i % 4 IN (1, 2) OR (i % 4 = 3 AND i % 9 <> 0)"),
    ("nuget-floating-version", "'MEDIUM'", "'CONFIRMED'", "Directory.Packages.props", "i % 18 = 0"),
    ("nuget-packages-config-range", "'MEDIUM'", "'CONFIRMED'", "packages.config", "i % 20 = 0"),
    ("nuget-lockfile-absent", "'MEDIUM'", "'CONFIRMED'", "src/a.csproj", "i % 3 <> 1"),
    ("nuget-lockfile-invalid", "'MEDIUM'", "'CONFIRMED'", "src/packages.lock.json", "i % 3 = 1 AND i % 11 = 0"),
    ("nuget-lockfile-stale", "'MEDIUM'", "'CONFIRMED'", "src/packages.lock.json", f"{_LOCKED} AND (i % 5 = 0 OR i % 6 = 0 OR i % 4 = 2)"),
    ("nuget-lockfile-missing-hash", "'MEDIUM'", "'CONFIRMED'", "src/packages.lock.json", f"{_LOCKED} AND i % 2 <> 0"),
    ("nuget-package-name-risk", "'LOW'", "'POSSIBLE'", "src/a.csproj", "i % 6 = 0"),
    ("nuget-install-script", "'HIGH'", "'CONFIRMED'", "packages/x.1.0/tools/install.ps1", "i % 4 = 1"),
    ("nuget-package-msbuild-hook", "'HIGH'", "'CONFIRMED'", "packages/x.1.0/build/x.targets", "i % 4 = 2"),
    ("nuget-package-msbuild-declarative", "'INFO'", "'CONFIRMED'", "packages/x.1.0/build/x.targets", "i % 4 = 3"),
    ("nuget-project-imports-package-targets", "'HIGH'", "'CONFIRMED'", "src/a.csproj", "i % 8 = 2"),
    ("nuget-project-imports-package-declarative", "'INFO'", "'CONFIRMED'", "src/a.csproj", "i % 8 = 3"),
    ("nuget-nuspec-declares-install-hook", "'HIGH'", "'CONFIRMED'", "packages/x.1.0/x.nuspec", "i % 13 = 0"),
]


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(project, path, text)`` of all projects."""
    rows = table(spark, sf_dir, "report").select(F.col("row_id").alias("i"))

    def text(parts) -> F.Column:
        return F.concat_ws("\n", *[F.when(F.expr(cond), F.lit(t)) for cond, t in parts])

    files = F.array(*[F.when(F.expr(cond), F.struct(F.lit(path).alias("path"), text(parts).alias("text"))) for path, cond, parts in TREE])
    return rows.select(F.concat(F.lit("p"), F.col("i").cast("string")).alias("project"), F.explode(files).alias("f")).where("f IS NOT NULL").select("project", "f.path", "f.text")


query("supply_chain_checks", "WITH r AS (SELECT row_id AS i FROM report)\n" + "\nUNION ALL ".join(f"SELECT 'p' || i AS project, '{rule}' AS rule, {severity} AS severity, {confidence} AS confidence, '{path}' AS path FROM r WHERE {cond}" for rule, severity, confidence, path, cond in _EXPECTED))(
    lambda spark, d: supplychain.supplychain_hits(nuget_items(project_files(spark, d))).select("project", "rule", "severity", "confidence", "path")
)
query(
    "feed_picture",
    f"""WITH r AS (SELECT row_id AS i FROM report)
SELECT 'p' || i AS project, i % 3 = 0 AS explicit_public, i % 3 <> 0 AND i % 5 <> 0 AS inherited_public, {_PUBLIC} AS public_enabled, CAST({_PRIVATE} AS BIGINT) AS private_feeds FROM r WHERE i % 3 = 0 OR {_PRIVATE}""",
)(lambda spark, d: supplychain.feed_picture(nuget_inventory(nuget_items(project_files(spark, d)))))
_ITEMS = [
    ("feed", "'nuget.org'", "i % 3 = 0"), ("feed", "'inner'", "i % 2 = 0"), ("clear", "NULL", "i % 5 = 0 AND (i % 2 = 0 OR i % 3 = 0)"), ("disabled", "'inner'", "i % 22 = 0"), ("mapping", "'inner'", "i % 7 = 0 AND (i % 2 = 0 OR i % 3 = 0)"), ("project", "NULL", "true"), ("reference", "'Contoso.Core'", "true"), ("reference", "'Serilog'", "true"),
    ("reference", "'Newtonsoft.Jsom'", "i % 6 = 0"), ("import", "'..\\packages\\x.1.0\\build\\x.targets'", "i % 8 IN (2, 3)"), ("central_version", "'Contoso.Core'", "i % 9 = 0"), ("config_package", "'Old.Lib'", "i % 10 = 0"), ("lockfile", "NULL", "i % 3 = 1"), ("lock_invalid", "NULL", "i % 3 = 1 AND i % 11 = 0"),
    ("lock_entry", "'Contoso.Core'", "i % 3 = 1"), ("lock_entry", "'Serilog'", "i % 3 = 1 AND i % 5 <> 0"), ("install_script", "NULL", "i % 4 = 1"), ("build_file", "NULL", "i % 4 IN (2, 3)"), ("executes", "NULL", "i % 4 = 2"), ("nuspec_script", "'tools\\install.ps1'", "i % 13 = 0"),
]
query("nuget_inventory", "WITH r AS (SELECT row_id AS i FROM report)\n" + "\nUNION ALL ".join(f"SELECT 'p' || i AS project, '{item}' AS item, {name} AS name FROM r WHERE {cond}" for item, name, cond in _ITEMS))(
    # items without a name of their own, whatever the parser notes there, count by their kind
    lambda spark, d: nuget_items(project_files(spark, d)).select("project", "item", F.when(F.col("item").isin("feed", "disabled", "mapping", "reference", "import", "central_version", "config_package", "lock_entry", "nuspec_script"), F.col("name")).alias("name"))
)

#: The scalar facts of assembly `i`, in SQL that both engines read.
_FACTS = """coalesce(repo, '(none)') AS project, concat(CASE WHEN i % 11 = 0 THEN 'packages/x/' ELSE 'bin/' END, 'Lib', CAST(i % 50 AS STRING), '.dll') AS path, concat('Lib', CAST(i % 50 AS STRING)) AS name, concat('1.', CAST(i % 3 AS STRING), '.0.0') AS version,
i % 6 <> 0 AS managed, i % 5 = 0 AS debug, i % 3 <> 0 AS signed, CASE i % 4 WHEN 0 THEN '.NETFramework,Version=v4.5' WHEN 1 THEN '.NETFramework,Version=v4.8' WHEN 3 THEN '.NETCoreApp,Version=v8.0' END AS target_framework"""


def assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "report").select(F.col("row_id").alias("i"), "repo")
    i = F.col("i")
    num = lambda k: (i % k).cast("string")
    ref = lambda name, version: F.struct(name.alias("name"), version.alias("version"))
    facts = spark.sql(f"SELECT i, {_FACTS} FROM {{rows}}", rows=rows)
    one = F.lit("1.0.0.0")
    refs = F.array(ref(F.lit("Newtonsoft.Json"), F.when(i % 2 == 0, "12.0.0.0").otherwise("13.0.0.1")), ref(F.lit("log4net"), F.concat(F.lit("2.0."), num(20))), ref(F.lit("System.Core"), one), ref(F.concat(F.lit("Missing"), num(9)), one), ref(F.concat(F.lit("lib"), num(60)), one))
    pdb = F.when(i % 7 == 0, F.array(*[F.lit(f"C:\\src\\a{k}.pdb") for k in range(5)])).otherwise(F.array().cast("array<string>"))
    text = lambda rule, shown: F.struct(F.lit(rule).alias("rule"), F.lit(shown).alias("shown"))
    strings = F.when(i % 8 == 0, F.array(text("binary-internal-endpoint", "http://inner"), text("binary-secret", "pwd=***")))
    return facts.select("*", refs.alias("references"), pdb.alias("pdb_paths"), strings.alias("strings"))


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("row_id")
    new = F.concat((i % 3 + 1).cast("string"), F.lit(".0.0.0"))
    name = F.when(i % 5 == 0, "log4net").otherwise("Some.Lib")
    return table(spark, sf_dir, "report").select(F.coalesce("repo", F.lit("(none)")).alias("project"), F.lit("app.config").alias("path"), name.alias("name"), F.lit("1.0.0.0").alias("old_min"), F.lit("1.0.0.0-1.9.0.0").alias("old_version"), new.alias("new_version"))


_BIN_SQL = f"""
WITH a AS (SELECT i, {_FACTS.replace('AS STRING', 'AS VARCHAR')} FROM (SELECT row_id AS i, repo FROM report)), m AS (SELECT * FROM a WHERE managed),
refs AS (SELECT project, path, unnest([{{'n': 'Newtonsoft.Json', 'v': CASE WHEN i % 2 = 0 THEN '12.0.0.0' ELSE '13.0.0.1' END}}, {{'n': 'log4net', 'v': '2.0.' || (i % 20)}}, {{'n': 'System.Core', 'v': '1.0.0.0'}}, {{'n': 'Missing' || (i % 9), 'v': '1.0.0.0'}}, {{'n': 'lib' || (i % 60), 'v': '1.0.0.0'}}]) AS r FROM m),
have AS (SELECT DISTINCT project, lower(name) AS n FROM a),
gone AS (SELECT project, path, r.n AS name, r.v AS version FROM refs WHERE r.n <> 'System.Core' AND NOT EXISTS (SELECT 1 FROM have h WHERE h.project = refs.project AND h.n = lower(r.n))),
v AS (SELECT project, lower(name) AS name, list_sort(list_distinct(list(version))) AS vs FROM m WHERE path NOT LIKE 'packages/%' GROUP BY 1, 2 HAVING count(DISTINCT version) > 1)
SELECT project, 'binary-debug-build' AS rule, 'HIGH' AS severity, path, name AS detail FROM m WHERE debug
UNION ALL SELECT project, 'binary-eol-runtime', 'MEDIUM', path, target_framework FROM m WHERE i % 4 = 0
UNION ALL SELECT project, 'binary-not-strong-named', 'LOW', path, name FROM m WHERE NOT signed
UNION ALL SELECT project, 'binary-pdb-path', 'LOW', path, 'C:\\src\\a' || k || '.pdb' FROM m, (VALUES (0), (1), (2)) AS p(k) WHERE i % 7 = 0
UNION ALL SELECT project, 'binary-known-vulnerable-reference', 'HIGH', path, r.n || ' ' || r.v FROM refs WHERE r.v = '12.0.0.0' OR (r.n = 'log4net' AND length(r.v) = 5)
UNION ALL SELECT project, 'binary-string', s.sev, path, s.d FROM a, (VALUES ('MEDIUM', 'binary-internal-endpoint: http://inner'), ('HIGH', 'binary-secret: pwd=***')) AS s(sev, d) WHERE i % 8 = 0
UNION ALL SELECT v.project, 'binary-version-conflict', 'MEDIUM', (SELECT min(path) FROM m WHERE m.project = v.project AND lower(m.name) = v.name), v.name || ' ' || array_to_string(vs, ', ') FROM v
UNION ALL SELECT project, 'binary-missing-dependency', 'LOW', path, name || ' ' || version FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path, name, version) AS k FROM (SELECT * FROM gone QUALIFY row_number() OVER (PARTITION BY project, lower(name) ORDER BY path, name, version) = 1)) WHERE k <= 20
UNION ALL SELECT coalesce(repo, '(none)'), 'binary-binding-redirect', CASE WHEN row_id % 5 = 0 AND row_id % 3 < 2 THEN 'HIGH' WHEN row_id % 3 <> 0 THEN 'MEDIUM' ELSE 'LOW' END, 'app.config', CASE WHEN row_id % 5 = 0 THEN 'log4net' ELSE 'Some.Lib' END || ' 1.0.0.0-1.9.0.0 -> ' || (row_id % 3 + 1) || '.0.0.0' FROM report
UNION ALL SELECT project, 'binary-no-decompiler', 'INFO', min(path), 'managed code was not decompiled' FROM m GROUP BY project
"""
query("binary_checks", _BIN_SQL)(lambda spark, d: binaries.binary_findings(assemblies(spark, d), redirects(spark, d), strict=False))
