"""Planted defects in small source trees."""

from gritmill.operators.native_rules import native_findings, native_hits, catalog_coverage

NOW = "2025-01-01T00:00:00"
WEB = '''<?xml version="1.0"?>
<configuration>
  <system.web>
    <compilation debug="true" />
    <customErrors mode="Off" />
    <machineKey validationKey="ABCDEF" decryptionKey="AutoGenerate" validation="SHA1" />
  </system.web>
  <connectionStrings>
    <add name="a" connectionString="Server=x;Password=hunter22;Uid=u" />
  </connectionStrings>
</configuration>'''
BAD = '''using System;
public class BadController : Controller
{
    // new SqlCommand("a" + b)
    [HttpPost]
    public void Do(string id)
    {
        var c = new SqlCommand("select * from t where id = " + id);
        Response.Write(Request["x"]);
        var r = new Regex("(a+)+$");
        if (File.Exists(name)) { File.Delete(name); }
        new Rfc2898DeriveBytes(p, s, 1000);
        var t = new Regex("a", RegexOptions.None, TimeSpan.FromSeconds(1));
    }
}'''
GOOD = '''[Authorize]
public class GoodController : Controller
{
    [HttpPost]
    [ValidateAntiForgeryToken]
    public void Do(int id) { }
}'''


def _tree(spark, files, project="p"):
    return spark.createDataFrame([(project, p, t) for p, t in files.items()], "project string, path string, text string")


def _found(spark, files):
    rows = native_findings(_tree(spark, files), NOW).collect()
    return {(r.detection.rules[0].ruleId, r.location.file, r.location.startLine): r for r in rows}


def test_planted_defects(spark):
    got = _found(spark, {"Web.config": WEB, "Controllers/BadController.cs": BAD, "Controllers/GoodController.cs": GOOD, "appsettings.json": '{\n "ClientSecret": "abcd1234",\n "Token": "changeme"\n}', "a.csproj": "<Project>\n<TargetFramework>netcoreapp2.1</TargetFramework>\n<PackageReference Include=\"x\" Version=\"1.*\" />\n</Project>"})
    keys = {k[:1] + k[1:] for k in got}
    bad = "Controllers/BadController.cs"
    for k in [
        ("web-debug-compilation", "Web.config", 4), ("web-custom-errors-off", "Web.config", 5), ("web-machinekey", "Web.config", 6), ("web-connection-string", "Web.config", 9),
        ("cs-sql-concat", bad, 8), ("cs-response-write", bad, 9), ("cs-regex-timeout", bad, 10), ("cs-toctou-file-race", bad, 11), ("cs-pbkdf2-iterations", bad, 12),
        ("cs-controller-no-authorization", bad, 5), ("cs-antiforgery", bad, 5), ("web-appsettings-secret", "appsettings.json", 2), ("manifest-eol-tfm", "a.csproj", 2), ("manifest-floating-version", "a.csproj", 3), ("native-no-lockfile", "a.csproj", 1),
    ]:
        assert k in keys, k
    assert not any(k[0] == "cs-regex-timeout" and k[2] == 13 for k in keys)
    assert not any(k[1].endswith("GoodController.cs") for k in keys)
    assert ("cs-sql-concat", bad, 4) not in keys
    assert got["cs-controller-no-authorization", bad, 5].severity == "CRITICAL"
    assert "hunter22" not in got["web-connection-string", "Web.config", 9].evidence.snippet
    assert not any(k == ("web-appsettings-secret", "appsettings.json", 3) for k in keys)


def test_global_filter_clears_controllers(spark):
    got = _found(spark, {"BadController.cs": BAD, "App_Start/FilterConfig.cs": "filters.Filters.Add(new AuthorizeAttribute());"})
    assert not any(k[0] == "cs-controller-no-authorization" for k in got)


def test_bearer_sign_in_lowers_csrf(spark):
    got = _found(spark, {"BadController.cs": BAD.replace(": Controller", ": ApiController"), "Startup.cs": "services.AddJwtBearer();"})
    r = got["cs-antiforgery", "BadController.cs", 5]
    assert (r.severity, r.confidence) == ("LOW", "POSSIBLE")


def test_nulls_and_empty_tables(spark):
    assert native_hits(_tree(spark, {}), NOW).count() == 0
    df = spark.createDataFrame([(None, "a.cs", None), (None, None, "x"), (None, "b.cs", "")], "project string, path string, text string")
    assert native_hits(df, NOW).count() == 0


def test_coverage(spark):
    hits = native_hits(_tree(spark, {"Web.config": WEB}), NOW)
    cat = spark.createDataFrame([("N-006", "both"), ("Z-1", "core"), ("Z-2", "framework")], "id string, stack string")
    got = {r.caseId: r.outcome for r in catalog_coverage(hits, cat, "framework").collect()}
    assert got == {"N-006": "checked", "Z-1": "not-applicable", "Z-2": "manual-review"}
