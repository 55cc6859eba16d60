"""Small NuGet trees through parsers and checks."""

from gritmill.operators.supplychain import name_risk, supplychain_hits
from gritmill.sources.nuget import nuget_items, version_spec

CONFIG = """<configuration>
  <packageSources>
    <clear />
    <add key="nuget.org" value="https://api.nuget.org/v3/index.json" />
    <add key="inner" value="https://u:secretpw@feed.inner.invalid/v3" />
    <add key="old" value="https://old.invalid/v3" />
  </packageSources>
  <disabledPackageSources><add key="old" value="true" /></disabledPackageSources>
  <packageSourceCredentials>
    <inner>
      <add key="ClearTextPassword" value="topsecret" />
    </inner>
  </packageSourceCredentials>
  <packageSourceMapping>
    <packageSource key="inner">
      <package pattern="Corp.*" />
    </packageSource>
  </packageSourceMapping>
</configuration>"""
PROJECT = """<Project Sdk="x">
  <PackageReference Include="Corp.Core" Version="1.0.0" />
  <PackageReference Include="Newtonsoft.Jsom" Version="13.*" />
  <PackageReference Include="Serilog">
    <Version>[1.0,2.0)</Version>
  </PackageReference>
  <PackageReference Include="Central.Pkg" />
  <PackageReference Include="Lost.Pkg" />
  <Import Project="..\\packages\\Evil.1.0\\build\\Evil.targets" />
</Project>"""
LOCK = """{
  "version": 1,
  "dependencies": {
    "net8.0": {
      "Corp.Core": {
        "type": "Direct",
        "requested": "[0.9.0, )",
        "resolved": "0.9.0"
      }
    }
  }
}"""
TREE = {
    "nuget.config": CONFIG, "src/App.csproj": PROJECT, "src/packages.lock.json": LOCK, "Directory.Packages.props": '<PackageVersion Include="Central.Pkg" Version="2.0.0" />',
    "packages/Evil.1.0/build/Evil.targets": "<Project>\n<Exec Command='x' />\n</Project>", "packages/Evil.1.0/tools/install.ps1": "\n  Write-Host hi", "packages/Calm.1.0/build/Calm.props": "<Project/>", "packages/Evil.1.0/Evil.nuspec": '<file src="tools\\install.ps1" />', "web/packages.config": '<packages>\n<package id="Oddé" version="1.0" />\n<package id="R" version="[1,)" />\n</packages>',
}


def _df(spark, tree):
    return spark.createDataFrame([("p", k, v) for k, v in tree.items()], "project string, path string, text string")


def test_checks(spark):
    items = nuget_items(_df(spark, TREE)).cache()
    rows = supplychain_hits(items).collect()
    got = {(r.rule, r.path, r.line): r for r in rows}
    conf = {(r.path, r.line) for r in rows if r.rule == "nuget-dependency-confusion"}
    assert ("src/App.csproj", 2) not in conf and {("src/App.csproj", 3), ("src/App.csproj", 4), ("web/packages.config", 2)} <= conf
    assert all(r.severity == "MEDIUM" and r.confidence == "CONFIRMED" for r in rows if r.rule == "nuget-dependency-confusion")
    floating = got["nuget-floating-version", "src/App.csproj", 3].snippet
    assert "Newtonsoft.Jsom" in floating and "Serilog" in floating and "Lost.Pkg" in floating and "Central.Pkg" not in floating
    stale = got["nuget-lockfile-stale", "src/packages.lock.json", 1].snippet
    assert "Corp.Core: pinned 1.0.0" in stale and "Serilog: not in" in stale
    assert ("nuget-lockfile-missing-hash", "src/packages.lock.json", 5) in got
    assert ("nuget-package-name-risk", "src/App.csproj", 3) in got and ("nuget-package-name-risk", "web/packages.config", 2) in got
    assert ("nuget-install-script", "packages/Evil.1.0/tools/install.ps1", 1) in got
    assert ("nuget-package-msbuild-hook", "packages/Evil.1.0/build/Evil.targets", 2) in got
    assert ("nuget-package-msbuild-declarative", "packages/Calm.1.0/build/Calm.props", 1) in got
    assert ("nuget-project-imports-package-targets", "src/App.csproj", 9) in got
    assert ("nuget-nuspec-declares-install-hook", "packages/Evil.1.0/Evil.nuspec", 1) in got
    assert ("nuget-packages-config-range", "web/packages.config", 3) in got
    text = str(items.collect())
    assert "secretpw" not in text and "topsecret" not in text
    kinds = {(r.item, r.kind) for r in items.where("item = 'credential'").collect()}
    assert kinds == {("credential", "ClearTextPassword"), ("credential", "credentials-in-URL")}


def test_absent_and_invalid_lock(spark):
    tree = {"a/A.csproj": '<PackageReference Include="X" Version="1" />', "b/B.csproj": '<PackageReference Include="X" Version="1" />', "b/packages.lock.json": "{nope"}
    got = {(r.rule, r.path) for r in supplychain_hits(nuget_items(_df(spark, tree))).collect()}
    assert got == {("nuget-lockfile-absent", "a/A.csproj"), ("nuget-lockfile-invalid", "b/packages.lock.json")}


def test_empty(spark):
    assert supplychain_hits(nuget_items(_df(spark, {}) )).count() == 0


def test_versions_and_names(spark):
    assert [version_spec(v)["kind"] for v in (None, " ", "1.*", "[1.2]", "[1,2)", "1.0")] == ["missing", "missing", "floating", "exact", "range", "exact"]
    assert version_spec("[1,)")["unbounded"] and not version_spec("[1,2)")["unbounded"]
    names = spark.createDataFrame([("Dappr",), ("Newtonsoft.Json",), ("AutoMaper",), ("System.Data.SqlClentt",), (None,), ("",), ("Far.Away.Name",)], "name string")
    got = {r.name: (r.nearest, r.distance) for r in name_risk(names).collect()}
    assert got == {"AutoMaper": ("automapper", 1), "System.Data.SqlClentt": ("system.data.sqlclient", 2)}
