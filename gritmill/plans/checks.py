"""Checks of source, configuration and manifests over planted files: one for each row of `report`.

The file of a row is one of the templates below, behind as many lines as its id asks for, so every rule has files in which
it fires, files in which it must not, and lines that differ. The SQL builds the same files and tries the same patterns;
where its regular expressions know no look-ahead, the pattern is written without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritmill.operators import native_rules as N
from gritmill.operators.rules import LineRule, scan
from gritmill.plans.registry import query
from gritmill.session import table

NOW = "2025-07-01T00:00:00"

#: A line or lines each; those that no rule may report are among them.
SOURCE = [
    'cmd = new SqlCommand("select " + name);', 'cmd.CommandText = "select 1";', "x = new BinaryFormatter();", "s.TypeNameHandling = TypeNameHandling.Auto;", "s.TypeNameHandling = TypeNameHandling.None;",
    "ServicePointManager.ServerCertificateValidationCallback = (a, b) => true;", "h.ServerCertificateCustomValidationCallback = f;\nreturn true;", "Response.Write(x);\ny = a + b;", "Response.Write(x);",
    'Process.Start("a" + b);', "Process.Start(p);", 'var password1 = "hunter22x";', 'var password1 = "short";', "h = new MD5CryptoServiceProvider();\ng = new MD5();", "m = CipherMode.ECB;", "r = new Random();\nvar token = r.Next();", "r = new Random();\nvar n = 1;",
    "p.ValidateIssuer = false;", "nonce check: p.ValidateLifetime = false;\nopenid", "[AllowAnonymous]\npublic void Admin()", "[AllowAnonymous]\npublic void Login()", "r.DtdProcessing = DtdProcessing.Parse;", "r.ProhibitDtd = false;", "r.XmlResolver = resolver;", "r.XmlResolver = null;",
    "return Redirect(ReturnUrl);", "return Redirect(a);", 'h["Access-Control-Allow-Origin"] = Request.Headers["Origin"];', "p.AllowAnyOrigin();\np.AllowCredentials();", "p.AllowAnyOrigin();", "x = new Regex(a);", "x = new Regex(a, o, TimeSpan.Zero);",
    "t = Type.GetType(Request.X);", "t = Type.GetType(a);", "CSharpScript.EvaluateAsync(a);", "x.SecurityProtocol = SecurityProtocolType.Tls;", "x.SecurityProtocol = SecurityProtocolType.Tls12;", 'c = "Server=a;Encrypt=False;pwd=b";', "GiveUpSecurityAndAcceptAnySshHostKey = true;",
    "c.ValidateCredentials(u, p);", "o = SecureSocketLayer;\nc.ValidateCredentials(u, p);", "k = new Rfc2898DeriveBytes(p, s, 1000);", "k = new Rfc2898DeriveBytes(p, s, 600000);", "k = new Rfc2898DeriveBytes(p, s);", 'aes.Key = Convert.FromBase64String("AAAABBBBCCCC");', 'aes.IV = Convert.FromBase64String("AAAABBBBCCCC");',
    'if (row["a"].ToString() == "True") { }', 'v = AppSettings["a"].ToString();', "catch (Exception e)\n{ return false; }", "catch (Exception e)\n{ throw; }", "double.Parse(x.ToString());", "b = Convert.FromBase64String(x);\np = MapPath(y);\nFile.WriteAllBytes(p, b);", "File.WriteAllBytes(p, b);",
    'n = DateTime.Now.ToString("yyyyMMddHHmm");\nFile.Copy(a, n);', 's = Regex.Replace(s, "<script", e, o, TimeSpan.Zero);', "p = Path.Combine(root, fileName);", "p = Path.Combine(root, fileName);\np = GetFullPath(p);", "r.Message = ex.Message;", "e = x.Entities[0];\nf = x.Entities[0];\ng = x.Entities[0];\nh = x.Entities[0];",
    'u = "http://10.1.2.3/a";', 'u = "http://portal.invalid/a";', 'u = "http://localhost/a";', 'u = "https://portal.invalid/a";', "o.AccessTokenExpireTimeSpan = TimeSpan.FromMinutes(600);", "o.AccessTokenExpireTimeSpan = TimeSpan.FromMinutes(20);", "o.AccessTokenExpireTimeSpan = TimeSpan.FromHours(8);",
    'd = new DirectoryEntry("LDAP://" + dn);', "DataSet s;\ns.ReadXml(p);", "DataSet s;\ns.ReadXml(p, XmlReadMode.ReadSchema);", "x = new XmlSerializer(Type.GetType(n));", 'p = "powershell.exe";\na = "-Command";', "nothing here",
]
CONFIG = [
    '<compilation debug="true" />', '<compilation debug="false" />', '<customErrors mode="Off" />', '<customErrors mode="On" />', '<pages enableViewStateMac="false" />', '<pages validateRequest="false" />\n<httpRuntime requestValidationMode="2.0" />', '<trace enabled="true" />', '<directoryBrowse enabled="true" />',
    '<httpCookies secure="false" />\n<httpCookies httpOnlyCookies="true" />', '<serviceMetadata httpGetEnabled="true" />', '<serviceDebug includeExceptionDetailInFaults="true" />', '<binding name="a" mode="None" />', '<binding name="a" mode="Transport" />', '<httpRuntime maxRequestLength="204800" />', '<httpRuntime maxRequestLength="4096" />',
    '<add name="a" connectionString="Server=x;Password=p1;" />\n<add name="b" connectionString="Server=x;" />', "<system.webServer>\n</system.webServer>", "<system.webServer>\n<customHeaders />", '<membership>\n<providers><add minRequiredPasswordLength="4" /></providers>', '<membership>\n<providers><add minRequiredPasswordLength="9" passwordStrengthRegularExpression="a" /></providers>',
    '<machineKey validationKey="ABCD" decryptionKey="AutoGenerate" validation="SHA1" />', '<machineKey validationKey="AutoGenerate" validation="HMACSHA256" />', '<forms protection="None" timeout="30" />', '<forms requireSSL="true" timeout="900" />', '<forms requireSSL="true" timeout="30" />', "<nothing />",
]
SETTINGS = ['"ClientSecret": "abcd1234",', '"ClientSecret": "changeme",', '"DbPassword": "x9y8z7",\n"Token": "REDACTED",', '"Name": "abcd1234"', '"ApiKey": "abc"']
MANIFEST = [
    "<TargetFramework>netcoreapp2.1</TargetFramework>", "<TargetFrameworkVersion>v4.5</TargetFrameworkVersion>", "<TargetFramework>net9.9</TargetFramework>", '<PackageReference Include="a" Version="1.*" />\n<PackageReference Include="b" Version="2.*" />', '<PackageReference Include="a" Version="1.0" />',
    "<AllowUnsafeBlocks>true</AllowUnsafeBlocks>", '<package id="a" version="" />',
]
STARTUP = [
    "void Configure(App app)\n{ }", "void Configure(App app)\n{ app.UseHsts(); }", "o.AllowAnyOrigin();\no.AllowCredentials();", "o.AllowAnyOrigin();", "app.UseDeveloperExceptionPage();", "if (env.IsDevelopment())\napp.UseDeveloperExceptionPage();",
    "app.UseRouting();\napp.MapControllers();\napp.UseHsts();", "app.UseRouting();\napp.MapControllers();\napp.UseAuthorization();\napp.UseHsts();", "nothing();",
]


def _sql_list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in xs) + "]"


def planted(spark: SparkSession, sf_dir: str, templates: list[str], path: str, head: str) -> DataFrame:
    """``(project, path, text)``: for each row of `report` its template behind one to seven lines of `head`."""
    i = F.col("row_id")
    text = F.concat(F.repeat(F.lit(head + "\n"), (F.pmod(i, F.lit(7)) + 1).cast("int")), F.get(F.array(*[F.lit(t) for t in templates]), F.pmod(i, F.lit(len(templates))).cast("int")))
    return table(spark, sf_dir, "report").select(F.concat(F.lit("p"), i.cast("string")).alias("project"), F.lit(path).alias("path"), text.alias("text"))


def _files(templates: list[str], head: str) -> str:
    """The same files in SQL, as ``f (project, text)``, with their lines in ``x (project, l, line, n)``."""
    text = f"repeat('{head}' || chr(10), CAST(row_id % 7 + 1 AS INTEGER)) || {_sql_list(templates)}[row_id % {len(templates)} + 1]"
    return f"""WITH f AS (SELECT 'p' || row_id AS project, {text} AS text FROM report),
x AS (SELECT project, l, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM (SELECT project, string_split(text, chr(10)) AS l FROM f))"""


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


#: Patterns with look-ahead: what must match instead, and what must not.
_PLAIN = {
    r"TypeNameHandling\s*\.\s*(?!None\b)(Objects|All|Arrays|Auto)\b": (r"TypeNameHandling\s*\.\s*(Objects|All|Arrays|Auto)\b", None),
    r"\.XmlResolver\s*=\s*(?!null\b)\w": (r"\.XmlResolver\s*=\s*\w", r"\.XmlResolver\s*=\s*null\b"),
    r"SecurityProtocol\s*=?[^;\n]*\b(Ssl3|Tls)\b(?!2|3)": (r"SecurityProtocol\s*=?[^;\n]*\b(Ssl3|Tls)\b", None),
}
_URL, _BARE = r'"http://[^"\s]+"', r'"http://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}'
_HOSTS = r'"http://[^"\s]*(?i:xmlns|schemas\.(?:microsoft|openxmlformats)|w3\.org|localhost|127\.0\.0\.1|tempuri|example\.com|wordnik|swagger\.io)'


def _trigger(r: LineRule) -> str:
    t = r.trigger
    if r.id == "cs-cleartext-url":
        bare = f"regexp_matches(line, {_q(_BARE)})"
        return f"regexp_matches(line, {_q(_URL)}) AND NOT regexp_matches(line, {_q(_HOSTS)}) AND {bare if r.severity == 'MEDIUM' else 'NOT ' + bare}"
    if r.id == "cs-jwt-validation-nonce":
        return rf"regexp_matches(line, '(?i)\bnonce\b') AND regexp_matches(line, {_q(t.split('.*', 2)[2])})"
    must, never = _PLAIN.get(t, (t, None))
    return f"regexp_matches(line, {_q(must)})" + (f" AND NOT regexp_matches(line, {_q(never)})" if never else "")


def _line_rule_sql(r: LineRule) -> str:
    before, after = r.window
    # the line itself and those behind it, and, where asked for, those before it
    span = f"array_to_string(l[n:n + {after or 0}], ' ')" if before is None else f"array_to_string(l[greatest(1, n - {before}):n], ' ')"
    if before is not None and after is not None:
        span = f"array_to_string(l[greatest(1, n - {before}):n + {after}], ' ')"
    where = [_trigger(r)]
    where += [f"NOT regexp_matches(line, {_q(p)})" for p in r.line_none_of] + [f"regexp_matches({span}, {_q(p)})" for p in r.all_of] + [f"NOT regexp_matches({span}, {_q(p)})" for p in r.none_of]
    if r.number:
        num = f"TRY_CAST(regexp_extract({span}, {_q(r.number)}, 1) AS BIGINT)"
        where += ([f"{num} >= {r.least}"] if r.least is not None else []) + ([f"{num} < {r.below}"] if r.below is not None else [])
    cap = f" QUALIFY row_number() OVER (PARTITION BY project ORDER BY n) <= {r.cap}" if r.cap else ""
    return f"SELECT project, '{r.id}' AS rule, '{r.severity}' AS severity, CAST(n AS INTEGER) AS line FROM x WHERE {' AND '.join(where)}{cap}"


def _rule_hits(spark: SparkSession, sf_dir: str, rules: list, templates: list[str], path: str, head: str) -> DataFrame:
    hits = scan(N.prepare(planted(spark, sf_dir, templates, path, head)), rules, "planted")
    return hits.select("project", "hit.rule", "hit.severity", "hit.line")


query("native_language", _files(SOURCE, "var head = 1;") + "\n" + "\nUNION ALL ".join(_line_rule_sql(r) for r in N.CSHARP))(lambda spark, d: _rule_hits(spark, d, N.CSHARP, SOURCE, "src/A.cs", "var head = 1;"))


def _first(rule: str, severity: str, pattern: str, where: str = "true") -> str:
    return f"SELECT project, '{rule}' AS rule, '{severity}' AS severity, CAST(1 + len(h) - len(replace(h, chr(10), '')) AS INTEGER) AS line FROM (SELECT *, regexp_extract(text, {_q('(?s)^(.*?)' + pattern)}, 1) AS h FROM f WHERE regexp_matches(text, {_q(pattern)})) WHERE {where}"


def _every(rule: str, severity: str, pattern: str, where: str = "true") -> str:
    """All matches, each within a line of its own."""
    return f"SELECT project, '{rule}' AS rule, '{severity}' AS severity, CAST(n AS INTEGER) AS line FROM (SELECT *, regexp_extract(line, {_q(pattern)}, 0) AS e FROM x WHERE regexp_matches(line, {_q(pattern)})) WHERE {where}"


_CONFIG_SQL = [
    _first("web-debug-compilation", "MEDIUM", r'(?i)<compilation[^>]*\bdebug\s*=\s*"true"'), _first("web-custom-errors-off", "HIGH", r'(?i)<customErrors[^>]*\bmode\s*=\s*"Off"'), _first("web-viewstate-mac", "CRITICAL", r'(?i)<pages[^>]*\benableViewStateMac\s*=\s*"false"'),
    _every("web-request-validation", "HIGH", r'(?i)<(?:pages|httpRuntime)[^>]*\b(?:validateRequest\s*=\s*"false"|requestValidationMode\s*=\s*"2\.0")'), _first("web-trace", "HIGH", r'(?i)<trace[^>]*\benabled\s*=\s*"true"'), _first("web-directory-browsing", "MEDIUM", r'(?i)<directoryBrowse[^>]*\benabled\s*=\s*"true"'),
    _every("web-cookie-flags", "MEDIUM", r"(?i)<httpCookie[^>]*>", r"""regexp_matches(e, '(?i)secure\s*=\s*"false"|httpOnlyCookies\s*=\s*"false"')"""), _first("V-002", "MEDIUM", r'(?i)<serviceMetadata[^>]*\bhttpGetEnabled\s*=\s*"true"'), _first("V-003", "HIGH", r'(?i)<serviceDebug[^>]*\bincludeExceptionDetailInFaults\s*=\s*"true"'),
    _first("V-001", "CRITICAL", r'(?i)<binding[^>]*\bmode\s*=\s*"None"'), _first("web-execution-limits", "LOW", r"(?i)<httpRuntime[^>]*\bmaxRequestLength", r"""CAST(regexp_extract(text, 'maxRequestLength="(\d+)"', 1) AS INTEGER) >= 103000"""),
    _every("web-connection-string", "CRITICAL", r'(?i)<add\s+[^>]*connectionString\s*=\s*"[^"]*"', r"""regexp_matches(e, '(?i)(password|pwd)\s*=\s*[^;"\s]')"""), _first("web-security-headers", "MEDIUM", r"(?i)<system\.webServer", "NOT contains(text, '<customHeaders')"),
    _first("web-membership-policy", "MEDIUM", "(?i)<membership", r"""NOT (coalesce(TRY_CAST(regexp_extract(text, 'minRequiredPasswordLength="(\d+)"', 1) AS INTEGER) >= 8, false) AND contains(text, 'passwordStrengthRegularExpression'))"""),
    # of the planted keys and sign-in elements, those with a short key or SHA1, and those without protection or that live too long
    _first("web-machinekey", "CRITICAL", "<machineKey", """contains(text, 'validationKey="ABCD"')"""), _first("web-forms-auth", "HIGH", "<forms", """contains(text, 'protection="None"') OR contains(text, 'timeout="900"')"""),
]
query("native_configuration", _files(CONFIG, "<!-- head -->") + "\n" + "\nUNION ALL ".join(_CONFIG_SQL))(lambda spark, d: _rule_hits(spark, d, N.CONFIG, CONFIG, "src/Web.config", "<!-- head -->"))
query(
    "native_settings",
    _files(SETTINGS, "{") + "\n" + _every("web-appsettings-secret", "CRITICAL", r'(?i)"\w*(?:password|passwd|pwd|secret|apikey|api_key|token|connectionstring|connstr)\w*"\s*:\s*"[^"]{4,}"', r"""NOT regexp_matches(e, '(?i):\s*"(?:\{your|<|changeme|x+|placeholder|\*+|REDACTED)')"""),
)(lambda spark, d: _rule_hits(spark, d, N.SETTINGS, SETTINGS, "appsettings.json", "{"))
_GONE = ", ".join(f"'{t}'" for t, d in N.END_OF_SUPPORT.items() if f"{d}T23:59:59" <= NOW)
_MANIFEST_SQL = [
    _first("manifest-eol-tfm", "HIGH", "<TargetFramework", rf"regexp_extract(text, 'TargetFramework\w*>([^<]+)<', 1) IN ({_GONE})"),
    _first("manifest-floating-version", "MEDIUM", r'(?i)<package(?:Reference)?\s+[^>]*version\s*=\s*"(?:[^"]*[\s*][^"]*)?"'),
    _first("manifest-unsafe-blocks", "LOW", r"(?i)<AllowUnsafeBlocks\s*>\s*true\s*<"),
]
query("native_manifest", _files(MANIFEST, "<Item />") + "\n" + "\nUNION ALL ".join(_MANIFEST_SQL))(lambda spark, d: _rule_hits(spark, d, N.manifest_rules(NOW), MANIFEST, "src/a.csproj", "<Item />"))
_STARTUP_SQL = [
    r"SELECT project, 'startup-security-headers' AS rule, 'MEDIUM' AS severity, CAST(greatest(1, coalesce(list_position(list_transform(l, lambda s: regexp_matches(s, 'void\s+Configure|Configure\s*\(|Application_Start')), true), 0)) AS INTEGER) AS line FROM (SELECT project, text, string_split(text, chr(10)) AS l FROM f) WHERE regexp_matches(text, '(Configure(?:Services)?|UseRouting|MapControllers|Application_Start)\s*\(') AND NOT contains(text, 'UseHsts(')",
    _first("startup-cors", "HIGH", r"AllowAnyOrigin\s*\(", "NOT contains(text, 'AllowCredentials')"), _first("startup-cors", "CRITICAL", r"AllowAnyOrigin\s*\(", "contains(text, 'AllowCredentials')"),
    r"SELECT project, 'startup-dev-exception' AS rule, 'HIGH' AS severity, CAST(n AS INTEGER) AS line FROM x WHERE contains(line, '.UseDeveloperExceptionPage(') AND NOT regexp_matches(line, 'if\s*\(') AND NOT regexp_matches(coalesce(l[n - 1], ''), 'if\s*\(\s*\w+\.IsDevelopment')",
    _first("startup-authz-middleware", "CRITICAL", r"MapControllers\s*\(", "NOT contains(text, 'UseAuthorization')"),
]
query("native_startup", _files(STARTUP, "using A;") + "\n" + "\nUNION ALL ".join(_STARTUP_SQL))(lambda spark, d: _rule_hits(spark, d, N.STARTUP, STARTUP, "src/Startup.cs", "using A;"))
#: Controllers and other files that are judged as a whole, with what is to be found: rule, severity, line behind the head.
WHOLE = [
    ("class AController : Controller {\n[HttpPost]\npublic void Do() { }\n}", [("cs-antiforgery", "HIGH", 2), ("cs-controller-no-authorization", "CRITICAL", 2)]),
    ("class AController : Controller {\n[HttpGet]\npublic void Do() { }\n}", [("cs-controller-no-authorization", "HIGH", 2)]),
    ("[Authorize]\nclass AController : Controller {\n[HttpPost]\n[ValidateAntiForgeryToken]\npublic void Do() { }\n}", []),
    ("[Authorize]\nclass AController : ApiController {\n[HttpPut]\npublic void Do() { }\n}", [("cs-antiforgery", "?", 3)]),
    ("class AHandler {\nprivate int count = 0;\nvoid Go() { this.count = 2; }\n}", [("cs-shared-handler-state", "MEDIUM", 1)]),
    ("class AHandler {\nvoid Go() { }\n}", []),
    ("class A : Controller {\npublic void DeleteAll(int a) { }\n}", [("cs-verbless-mutating", "LOW", 2)]),
    ("class A : Controller {\n[HttpDelete]\npublic void DeleteAll(int a) { }\n}", [("cs-antiforgery", "HIGH", 2), ("cs-controller-no-authorization", "CRITICAL", 2)]),
    ("if (File.Exists(name))\nFile.Delete(name);", [("cs-toctou-file-race", "LOW", 1)]),
    ("if (File.Exists(name))\nreturn;", []),
]
_WHOLE_SQL = "SELECT 'p' || row_id AS project, v.rule, v.severity, CAST(row_id % 7 + 1 + v.line AS INTEGER) AS line FROM report JOIN (VALUES " + ", ".join(f"({i}, '{r}', '{s}', {n})" for i, (_, found) in enumerate(WHOLE) for r, s, n in found) + f") AS v(k, rule, severity, line) ON row_id % {len(WHOLE)} = v.k"
query("native_whole_files", _WHOLE_SQL)(lambda spark, d: _rule_hits(spark, d, N.CSHARP_FILES, [t for t, _ in WHOLE], "src/AController.cs", "using A;"))
