"""The rules for .NET source, configuration, manifests and start-up code (CHK-01 to CHK-67)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritmill.functions import text as T
from gritmill.operators.rules import FileRule, LineRule, every_match, first_match, hit, redacted, scan

_CONCAT = r'(?i)"\s*\+\s*\w|\w\s*\+\s*"|\$"|string\.Format\s*\('
L = LineRule

#: Patterns, windows, severities and cases of line rules.
CSHARP = [
    L("cs-sql-concat", "SQL text built from parts", ("C-001", "C-002", "C-003"), "CRITICAL", "POSSIBLE", (89,), r"(?i)(?:new\s+(?:Sql|OleDb|Odbc|MySql|Npgsql)?Command\s*\(|\.CommandText\s*=)", (None, 3), (_CONCAT + r"|\{\w+\}",), shown=(1, 2)),
    L("cs-unsafe-deserializer", "Deserialiser that creates any type", ("J-001", "S-006", "S-008"), "CRITICAL", "LIKELY", (502,), r"\b(BinaryFormatter|LosFormatter|NetDataContractSerializer|SoapFormatter|XamlReader\s*\.\s*(?:Parse|Load))\b|(?i:\bJavaScriptSerializer\s*\(\s*\)\s*\.\s*Deserialize(?:\s*<[^>]*>)?\s*\()"),
    L("cs-typename-handling", "JSON may name the type to create", ("J-002", "S-011"), "CRITICAL", "LIKELY", (502,), r"TypeNameHandling\s*\.\s*(?!None\b)(Objects|All|Arrays|Auto)\b"),
    L("cs-cert-validation", "Certificate checks off for the whole process", ("F-001",), "CRITICAL", "LIKELY", (295,), r"(?i:ServicePointManager).*(ServerCertificateValidationCallback|ServerCertificateCustomValidationCallback|DangerousAcceptAnyServerCertificateValidator)", (None, 3), (r"=>\s*true|return\s+true\s*;|DangerousAcceptAnyServerCertificateValidator",), shown=(1, 2)),
    L("cs-cert-validation", "Certificate checks off for a handler", ("F-002",), "CRITICAL", "LIKELY", (295,), r"(ServerCertificateValidationCallback|ServerCertificateCustomValidationCallback|DangerousAcceptAnyServerCertificateValidator)", (None, 3), (r"=>\s*true|return\s+true\s*;|DangerousAcceptAnyServerCertificateValidator",), line_none_of=(r"(?i)ServicePointManager",), shown=(1, 2)),
    L("cs-response-write", "Response written from request values", ("D-001",), "CRITICAL", "POSSIBLE", (79,), r"Response\s*\.\s*Write\s*\(", (None, 2), (r"Request(\[|\.QueryString|\.Form|\.Params)|\+\s*\w+|\$\w|\{\w+\}",), shown=(1, 2)),
    L("cs-command-injection", "Process started from built text", ("C-007",), "CRITICAL", "POSSIBLE", (78,), r"Process\s*\.\s*(?:Start|StartInfo)\b", (None, 3), (r'"\s*\+\s*\w|\w\s*\+\s*"|\$"|string\.Format\s*\(|\bRequest\b',), shown=(1, 3)),
    L("cs-hardcoded-secret", "Credential in source", ("E-001", "M-001"), "CRITICAL", "CONFIRMED", (798,), r'(?i)(?:password|passwd|pwd|secret|apikey|api_key|apitoken|access_token|client_secret)\w*\s*=\s*"[^"\n]{6,}"', line_none_of=(r"^\s*//",), on="raw", shown=(0, 0), redact=(r'(?i)((?:password|passwd|pwd|secret|apikey|api_key|apitoken|access_token|client_secret)\w*\s*=\s*)"[^"\n]{6,}"', r"$1***REDACTED***")),
    L("cs-weak-crypto", "Broken hash or cipher", ("E-008", "E-006", "E-004", "E-009"), "HIGH", "LIKELY", (327,), r"new\s+(MD5|SHA1|DESCryptoServiceProvider|TripleDESCryptoServiceProvider|RC2CryptoServiceProvider)\b"),
    L("cs-weak-crypto", "ECB mode", ("E-008", "E-006", "E-004", "E-009"), "HIGH", "LIKELY", (327,), r"CipherMode\s*\.\s*ECB"),
    L("cs-weak-crypto", "Predictable random source", ("E-008", "E-006", "E-004", "E-009"), "HIGH", "POSSIBLE", (338,), r"new\s+Random\s*\(", (None, 3), (r"(?i)token|nonce|otp|password|secret|salt|key|code|ref(eren(ce|al))?|id",)),
    L("cs-jwt-validation", "Token validation switched off", ("A-011", "X-006", "X-007"), "CRITICAL", "LIKELY", (347,), r"(ValidateAudience|ValidateIssuer|ValidateLifetime|ValidateIssuerSigningKey|ValidateActor|RequireExpirationTime)\s*=\s*false"),
    L("cs-jwt-validation-nonce", "Nonce of an identity token not checked", ("X-005",), "HIGH", "POSSIBLE", (347,), r"(?=.*(?i:\bnonce\b)).*(ValidateAudience|ValidateIssuer|ValidateLifetime|ValidateIssuerSigningKey|ValidateActor|RequireExpirationTime)\s*=\s*false", (None, 3), (r"(?i)id[_-]?token|openid|oidc",)),
    L("cs-anonymous-sensitive", "Sensitive action open to anyone", ("B-010", "B-001"), "HIGH", "POSSIBLE", (862,), r"\[AllowAnonymous\]", (None, 4), (r"(?i)(admin|user|manage|account|internal|debug|config|report|payment|invoice|customer)",), (r"(?i)login|logout|register|forgot|reset|external|challenge",), shown=(1, 4)),
    L("cs-xxe", "DTDs are processed", ("J-003", "J-004"), "CRITICAL", "LIKELY", (611,), r"\bDtdProcessing\s*=\s*(?:DtdProcessing\.)?Parse\b"),
    L("cs-xxe", "DTDs are allowed", ("J-003", "J-004"), "CRITICAL", "LIKELY", (611,), r"\bProhibitDtd\s*=\s*false\b"),
    L("cs-xxe", "Resolver follows outside entities", ("J-003", "J-004"), "CRITICAL", "LIKELY", (611,), r"\.XmlResolver\s*=\s*(?!null\b)\w"),
    L("cs-open-redirect", "Redirect to a requested address", ("D-007", "X-013"), "HIGH", "POSSIBLE", (601,), r"Response\s*\.\s*Redirect\s*\(|RedirectToAction\s*\(|return\s+Redirect\s*\(|LocalRedirect\s*\(", (None, 2), (r"(?i)Request(\[|\.QueryString|\.Form)|ReturnUrl|redirect[_-]?uri",), shown=(1, 2)),
    L("cs-cors-code", "Origin of the request is echoed", ("N-001",), "CRITICAL", "LIKELY", (346,), r"""(?i)Access-Control-Allow-Origin["']?\s*(?:,|\)|=).*Request\.Headers\[["']Origin|Request\.Headers\[["']Origin["']\][^;\n]*Access-Control-Allow-Origin"""),
    L("cs-cors-code", "Any origin together with credentials", ("N-002",), "CRITICAL", "LIKELY", (942,), r"""(?i)AllowAnyOrigin\s*\(\)|Access-Control-Allow-Origin["']?\s*[,:]=?\s*["']\*""", (None, 3), (r"""AllowCredentials\s*\(\)|AllowAnyHeader|(?i:Access-Control-Allow-Credentials["']?\s*[,:]=?\s*true)""",), line_none_of=(r"""(?i)Access-Control-Allow-Origin["']?\s*(?:,|\)|=).*Request\.Headers\[["']Origin|Request\.Headers\[["']Origin["']\][^;\n]*Access-Control-Allow-Origin""",), shown=(1, 3)),
    L("cs-regex-timeout", "Regular expression without a time limit", ("P-004",), "MEDIUM", "POSSIBLE", (1333,), r"new\s+Regex\s*\(|Regex\s*\.\s*(?:Match|Matches|IsMatch|Replace)\s*\(", (None, 2), none_of=(r"TimeSpan|matchTimeout|RegexOptions\.(?:NonBacktracking)",), shown=(1, 2), category="performance"),
    L("cs-reflection-input", "Type or assembly named by input", ("S-001", "S-002", "S-003"), "CRITICAL", "POSSIBLE", (470,), r"\bType\s*\.\s*GetType\s*\(|\bActivator\s*\.\s*CreateInstance\s*\(|\bAssembly\s*\.\s*(?:Load|LoadFrom|LoadFile)\s*\(", (None, 2), (r"""(?i)\bRequest\b|\bQuery\b|\[\s*"|\[\s*'\b|\w+Param|RouteData|Form\b|Header""",), shown=(1, 2)),
    L("cs-scripting", "Code compiled at run time", ("U-002", "U-003"), "CRITICAL", "LIKELY", (94,), r"\bCSharpScript\s*\.\s*(?:Evaluate|Run)\w*\s*\(|\bCodeDomProvider\s*\.\s*Compile\w*\s*\(|\bRoslynScript\b"),
    L("cs-tls-versions", "Outdated protocol version", ("F-004",), "HIGH", "LIKELY", (327,), r"SecurityProtocol\s*=?[^;\n]*\b(Ssl3|Tls)\b(?!2|3)"),
    L("cs-connection-options", "Connection without encryption or certificate check", ("F-006",), "HIGH", "CONFIRMED", (319,), r"(Encrypt\s*=\s*(?:False|false)|TrustServerCertificate\s*=\s*(?:True|true))", on="raw", shown=(0, 0), redact=(r"""(?i)(password|pwd)=[^;"']+[^;"'\s]*""", r"$1=***REDACTED***")),
    L("cs-ssh-hostkey", "Any host key is accepted", ("LH-001",), "HIGH", "LIKELY", (322,), r"GiveUpSecurityAndAcceptAnySshHostKey\s*=\s*true|HostKeyReceived[\s\S]{0,80}(?:e\.CanTrust\s*=\s*false|return\s*;)", shown=(2, 2)),
    L("cs-ldap-plaintext", "Directory login without encryption", ("LH-002",), "HIGH", "LIKELY", (287, 319), r"ValidateCredentials\s*\(|new\s+PrincipalContext\s*\(|new\s+DirectoryEntry\s*\(", (6, 4), none_of=(r"(?i)SecureSocketLayer|LDAPS://",), shown=(2, 3)),
    L("cs-pbkdf2-iterations", "Too few iterations", ("LH-003",), "HIGH", "LIKELY", (916,), r"new\s+Rfc2898DeriveBytes\s*\(", (None, 3), number=r",\s*(\d{2,9})\s*[,)]", below=10000, shown=(1, 3)),
    L("cs-pbkdf2-iterations", "Iterations left to the default", ("LH-003",), "MEDIUM", "LIKELY", (916,), r"new\s+Rfc2898DeriveBytes\s*\(", (None, 3), none_of=(r",\s*(\d{2,9})\s*[,)]",), shown=(1, 3)),
    L("cs-static-key-iv", "Key written in source", ("LH-004",), "HIGH", "LIKELY", (321,), r'\.Key\s*=\s*(?:"([^"\n]{8,64})"|Convert\.FromBase64String\s*\(\s*"([^"\n]{8,64})"|new\s+byte\s*\[[^\]]*\])', shown=(1, 2)),
    L("cs-static-key-iv", "Initialisation vector written in source", ("LH-004",), "HIGH", "LIKELY", (329,), r'\.IV\s*=\s*(?:"([^"\n]{8,64})"|Convert\.FromBase64String\s*\(\s*"([^"\n]{8,64})"|new\s+byte\s*\[[^\]]*\])', line_none_of=(r'\.Key\s*=\s*(?:"([^"\n]{8,64})"|Convert\.FromBase64String|new\s+byte\s*\[).*\.IV\s*=',), shown=(1, 2)),
    L("cs-crm-bool-compare", "Truth compared as text", ("LH-005",), "MEDIUM", "POSSIBLE", (597,), r'\]\s*\.\s*ToString\s*\(\s*\)\s*(?:==|!=)\s*"(?:True|False|true|false)"', category="reliability"),
    L("cs-unguarded-appsettings", "Setting used without a check", ("LH-006",), "MEDIUM", "LIKELY", (476,), r'AppSettings\s*\[\s*"[^"]+"\s*\]\s*\.\s*(?:ToString|Trim|Split|ToUpper|ToLower|Substring|Replace)\s*\(', category="reliability"),
    L("cs-fail-open-catch", "Failure answered with a default", ("LH-007",), "MEDIUM", "POSSIBLE", (703,), r"catch\s*(\(|\{)", (None, 2), (r"catch\s*(?:\([^)]*\))?\s*\{\s*return\s+(?:0|0\.0|m|false|null)\s*;",), shown=(1, 3), category="reliability"),
    L("cs-culture-parse", "Number parsed in the local culture", ("LH-009",), "MEDIUM", "POSSIBLE", (682,), r"\b(?:double|decimal|int)\.Parse\s*\([^;]{0,140}?\.ToString\s*\(\s*\)", category="reliability"),
    L("cs-webroot-write", "Upload written below the web root", ("LH-010",), "HIGH", "LIKELY", (552,), r"File\.(?:WriteAllBytes|WriteAllText|WriteAllLines)\s*\(", (12, 4), (r"Convert\.FromBase64String", r"BaseDirectory|MapPath|~/|AppDomain"), shown=(6, 2)),
    L("cs-filename-collision", "File name made of the time", ("LH-011",), "MEDIUM", "POSSIBLE", (340, 362), r"File\.(?:WriteAllBytes|WriteAllText|WriteAllLines|Copy|Move)\s*\(|StreamWriter\s*\(", (10, None), (r"""DateTime\.Now(?:\.ToString\s*\(\s*)?["':]*[yYMdHs]{6,}|DateTime\.Now:|\$".*DateTime\.Now:""",), shown=(6, 2), category="reliability"),
    L("cs-denylist-validation", "Input cleaned by a list of bad words", ("LH-012",), "MEDIUM", "POSSIBLE", (184,), r"Regex\.Replace\s*\(", (6, 2), (r"<script|javascript:|eval\s*\(|onerror|alert\s*\(",), shown=(4, 1)),
    L("cs-path-combine", "Path joined from input", ("LH-013",), "MEDIUM", "POSSIBLE", (22,), r"Path\.Combine\s*\(", (None, 2), (r"(?i)\b(?:fileName|filePath|path|name|userPath|relativePath|subPath)\b",), (r"(?i)GetFullPath|\.\.\.|StartsWith\s*\(\s*base",), shown=(2, 2)),
    L("cs-exception-to-client", "Exception text sent to the caller", ("LH-014",), "LOW", "LIKELY", (209,), r"\.(?:message|Message|error|Error|detail|Detail)\s*=\s*ex(?:ception)?\.(?:Message|ToString\s*\(\s*\))"),
    L("cs-entities-zero", "First entity taken without a check", ("LH-015",), "LOW", "POSSIBLE", (476,), r"\.Entities\s*\[\s*0\s*\]", category="reliability", cap=3),
    L("cs-cleartext-url", "Address of a bare host without encryption", ("LH-016",), "MEDIUM", "LIKELY", (319,), r'^(?:(?!"http://[^"\s]+").)*"http://(?=\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![^"\s]*(?i:xmlns|schemas\.(?:microsoft|openxmlformats)|w3\.org|localhost|127\.0\.0\.1|tempuri|example\.com|wordnik|swagger\.io))[^"\s]+"', on="raw", commentless=True),
    L("cs-cleartext-url", "Address without encryption", ("LH-016",), "LOW", "LIKELY", (319,), r'^(?:(?!"http://[^"\s]+").)*"http://(?!\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![^"\s]*(?i:xmlns|schemas\.(?:microsoft|openxmlformats)|w3\.org|localhost|127\.0\.0\.1|tempuri|example\.com|wordnik|swagger\.io))[^"\s]+"', on="raw", commentless=True),
    L("cs-token-lifetime", "Token lives for hours", ("LH-018",), "MEDIUM", "CONFIRMED", (613,), r"AccessTokenExpireTimeSpan\s*=\s*TimeSpan\.FromMinutes\s*\(\s*\d+\s*\)", (None, 0), number=r"FromMinutes\s*\(\s*(\d+)", least=300, shown=(2, 2)),
    L("cs-token-lifetime", "Token lives for hours", ("LH-018",), "MEDIUM", "CONFIRMED", (613,), r"AccessTokenExpireTimeSpan\s*=\s*TimeSpan\.FromHours\s*\(\s*\d+\s*\)", (None, 0), number=r"FromHours\s*\(\s*(\d+)", least=5, shown=(2, 2)),
    L("cs-ldap-dn-injection", "Directory path built from parts", ("CH-001",), "HIGH", "POSSIBLE", (90,), r'new\s+DirectoryEntry\s*\(|\.Rename\s*\(|Invoke\s*\(\s*"SetPassword"|\.Path\s*=', (None, 2), (r'\+|\$"|string\.Format|Interpolate', r"(?i)LDAP://", '"'), on="raw", shown=(1, 2), commentless=True),
    L("cs-dataset-readxml", "Data set read with a schema from outside", ("CH-003",), "HIGH", "POSSIBLE", (502,), r"\bReadXml\s*\(", (3, 2), (r"DataSet|DataTable",), (r"XmlReadMode\.(?:ReadSchema|IgnoreSchema)|XmlReader\.Create",), shown=(2, 2)),
    L("cs-serializer-dynamic-type", "Serialiser for a type named at run time", ("CH-005",), "HIGH", "LIKELY", (502,), r"new\s+(?:XmlSerializer|JavaScriptSerializer|DataContractSerializer)\s*\(", (None, 2), (r"Type\.GetType\s*\(|GetType\s*\(\s*\w+\s*\+\s*\w|Assembly\.CreateInstance|Activator\.CreateInstance",), shown=(1, 2)),
    L("cs-shell-powershell", "Shell started with built options", ("CH-006",), "HIGH", "POSSIBLE", (78,), r"(?i)powershell(?:\.exe)?|pwsh(?:\.exe)?", (None, 3), (r'-Command|-EncodedCommand|-File\s*\+|\+\s*"-',), on="raw", shown=(1, 3), commentless=True),
]


def _code() -> Column:
    return F.array_join("code", "\n")


def _verb_line(verbs: str) -> Column:
    return F.array_position(F.transform("code", lambda c: c.rlike(rf"(?i)\[Http(?:{verbs})\]")), True)


#: Stands for a severity that the project's facts decide.
OPEN = "?"


def _antiforgery(rule) -> Column:
    """Reachable at any rate unless the controller is an ApiController; then the project's sign-in decides."""
    n = _verb_line("Post|Put|Delete|Patch")
    api = F.col("text").rlike(r":\s*ApiController\b")
    ok = F.col("path").rlike(r"(?i)Controller\.cs\z") & (n > 0) & ~F.col("text").rlike(r"(?i)ValidateAntiForgeryToken|AutoValidateAntiforgeryToken|Antiforgery")
    return F.when(ok, F.array(hit(rule, n, F.get("code", n.cast("int") - 1), severity=F.when(api, OPEN).otherwise("HIGH"))))


def _no_authorization(rule) -> Column:
    """To be dropped where the project has a filter for all controllers."""
    n, mutating = _verb_line("Post|Put|Delete|Patch|Get"), _verb_line("Post|Put|Delete|Patch") > 0
    ok = F.col("path").rlike(r"(?i)Controller\.cs\z") & _code().rlike(r":\s*(?:Api)?Controller\b") & (n > 0) & ~_code().rlike(r"(?i)\[Authorize|\[CustomAuthorize|\[ApiKey|\[BasicAuth|PrincipalPermission")
    return F.when(ok, F.array(hit(rule, n, T.snippet(F.col("code"), n, 2, 2), severity=F.when(mutating, "CRITICAL").otherwise("HIGH"))))


def settled(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Hits of the rules that depend on their project, decided by its facts. Hits are joined, never texts."""
    asks = F.col("hit.rule").isin("cs-antiforgery", "cs-controller-no-authorization")
    j = hits.where(asks).join(facts, "project").where(~((F.col("hit.rule") == "cs-controller-no-authorization") & F.col("facts.global_filter")))
    low = (F.col("hit.severity") == OPEN) & ~(F.col("facts.cookie_auth") | ~F.col("facts.token_auth"))
    decided = F.col("hit").withField("confidence", F.when(low, "POSSIBLE").otherwise(F.col("hit.confidence"))).withField("severity", F.when(low, "LOW").when(F.col("hit.severity") == OPEN, "HIGH").otherwise(F.col("hit.severity")))
    return hits.where(~asks).unionByName(j.withColumn("hit", decided).select(*hits.columns))


#: Fixed value: classes that one object serves all calls with.
_HANDLER = r"class\s+\w*(Handler|Filter|Middleware|ExceptionHandler)"


def _shared_state(rule) -> Column:
    code = _code()
    fields = F.regexp_extract_all(code, F.lit(r"(?:private|protected|internal|public)\s+(?:static\s+)?(?!readonly\s|const\s)[\w<>\[\],.?]+\s+(\w+)\s*(?:=|;)"), F.lit(1))
    written = F.concat(F.regexp_extract_all(code, F.lit(r"\bout\s+(\w+)\b"), F.lit(1)), F.regexp_extract_all(code, F.lit(r"(?:this\.)?(\w+)\s*=(?!=)"), F.lit(1)))
    n = F.greatest(F.lit(1), F.array_position(F.transform("lines", lambda x: x.rlike(_HANDLER)), True))
    return F.when(code.rlike(_HANDLER) & F.arrays_overlap(fields, written), F.array(hit(rule, n, T.snippet(F.col("lines"), n, 0, 12))))


#: Verbs of methods that change state.
_VERBS = "Create|Delete|Update|Save|Insert|Add|Cancel|Submit|Authorize|Book|Release|Clone|Assign|Upload|Approve|Reject|Register|Remove"


def _verbless(rule) -> Column:
    code = _code()
    sig = rf"(?:public|protected)\s+[\w<>\[\],.?]+\s+(?:{_VERBS})\w*\s*\("
    hits, parts = F.regexp_extract_all(code, F.lit(sig), F.lit(0)), F.split(code, sig, -1)
    before = lambda i: F.right(F.concat(F.array_join(F.slice(F.flatten(F.transform(parts, lambda p, k: F.array(p, F.coalesce(F.get(hits, k), F.lit(""))))), F.lit(1), i * 2 + 1), "")), F.lit(300))
    bare = F.filter(F.transform(hits, lambda h, i: F.when(~before(i).rlike(r"(?i)\[\s*Http(?:Post|Put|Delete)"), F.regexp_extract(h, rf"({_VERBS})\w*\s*\(\z", 1))), lambda x: x.isNotNull())
    n = F.greatest(F.lit(1), F.array_position(F.transform("lines", lambda x: x.rlike(rf"(?:{_VERBS})\w*\s*\(")), True))
    return F.when(code.rlike(r"\b(?:ApiController|Controller)\b") & (F.size(bare) > 0), F.array(hit(rule, n, F.array_join(F.slice(bare, 1, 6), ", "))))


def _toctou(rule) -> Column:
    def of(line: Column, i: Column) -> Column:
        name = F.regexp_extract(line, r"File\.Exists\s*\(\s*([A-Za-z_]\w*)\s*\)", 1)
        after = F.concat_ws(" ", line, T.window_after(F.col("code"), i + 2, 3))
        opened = F.transform(F.regexp_extract_all(after, F.lit(r"new\s+(?:StreamReader|FileStream)\s*\(([^)]*)"), F.lit(1)), lambda a: F.array_contains(F.regexp_extract_all(a, F.lit(r"\w+"), F.lit(0)), name))
        used = after.rlike(r"File\.(?:Delete|Open|Move|Copy|ReadAll|WriteAll)") | F.exists(opened, lambda x: x)
        return F.when((name != "") & used, hit(rule, i + 1, T.snippet(F.col("lines"), i + 1, 1, 4)))

    return F.when(F.col("text").contains("File.Exists"), F.filter(F.transform("code", of), lambda h: h.isNotNull()))


#: Rules of whole source files, with their severities and cases.
CSHARP_FILES = [
    FileRule("cs-antiforgery", "State-changing action without an anti-forgery check", ("D-008", "T-004"), "HIGH", "LIKELY", (352,), _antiforgery, language="csharp"),
    FileRule("cs-controller-no-authorization", "Controller without any authorisation", ("B-001", "B-010"), "HIGH", "LIKELY", (862,), _no_authorization, language="csharp"),
    FileRule("cs-shared-handler-state", "Field of a shared handler changed by calls", ("LH-008",), "MEDIUM", "LIKELY", (488, 362), _shared_state, category="reliability", language="csharp"),
    FileRule("cs-verbless-mutating", "State-changing method without a verb", ("LH-017",), "LOW", "POSSIBLE", (352,), _verbless, language="csharp"),
    FileRule("cs-toctou-file-race", "File checked and then used", ("CH-004",), "LOW", "POSSIBLE", (367,), _toctou, category="reliability", language="csharp"),
]


def _problems(rule, tag: str, *conditions: tuple[str, object]) -> Column:
    """A hit that lists what is wrong with the first element `tag`."""
    el = F.regexp_extract("text", tag, 0)
    found = F.filter(F.array(*[F.when(F.coalesce(cond(el), F.lit(False)), F.lit(what)) for what, cond in conditions]), lambda x: x.isNotNull())
    line = T.first_line(F.col("text"), tag)
    return F.when(line.isNotNull() & (F.size(found) > 0), F.array(hit(rule, line, F.concat(redacted(el), F.lit("\n"), F.array_join(found, "; ")))))


def _short(name: str, digits: int):
    def cond(el: Column) -> Column:
        k = T.attribute(el, name)
        return ~k.rlike("(?i)AutoGenerate") & (k != "") & (F.length(F.regexp_replace(k, "[^0-9A-Fa-f]", "")) < digits) & ~k.contains(",")

    return cond


def _is(name: str, *values: str):
    return lambda el: F.upper(T.attribute(el, name)).isin(*values)


def _membership(rule) -> Column:
    text = F.col("text")
    seg = F.coalesce(F.when(text.rlike(r"(?i)<providers[^>]*>[\s\S]*?</providers>"), F.regexp_extract(text, r"(?i)<providers[^>]*>([\s\S]*?)</providers>", 1)), text)
    least = F.regexp_extract(seg, r'(?i)minRequiredPasswordLength\s*=\s*"(\d+)"', 1).try_cast("int")
    strong = seg.rlike(r'(?i)passwordStrengthRegularExpression\s*=\s*"[^"]+"')
    fine = text.rlike("(?i)MicrosoftASPNETIdentity|IdentityOptions") | F.coalesce((least >= 8) & strong, F.lit(False))
    line = T.first_line(text, "(?i)<membership")
    return F.when(line.isNotNull() & ~fine, F.array(hit(rule, line, T.snippet(F.col("lines"), line, 0, 6))))


def _limits(rule) -> Column:
    p = r'(?i)<httpRuntime[^>]*\bmaxRequestLength\s*=\s*"(\d+)"[^>]*>'
    kb = F.regexp_extract("text", p, 1).try_cast("double")
    return F.when(F.coalesce(F.floor(kb / 1024 + 0.5) > 100, F.lit(False)), first_match(p, whole_line=False)(rule))


_CRED = r'(?i)(password|pwd)\s*=\s*([^;"\s][^;]*)'
#: Patterns, severities and cases of configuration rules.
CONFIG = [
    FileRule("web-debug-compilation", "Debug compilation", ("N-006",), "MEDIUM", "CONFIRMED", (11,), first_match(r'(?i)<compilation[^>]*\bdebug\s*=\s*"true"[^>]*>', redact=True), category="configuration"),
    FileRule("web-custom-errors-off", "Error details sent to all callers", ("H-002", "H-001"), "HIGH", "CONFIRMED", (209,), first_match(r'(?i)<customErrors[^>]*\bmode\s*=\s*"Off"[^>]*>'), category="configuration"),
    FileRule(
        "web-machinekey", "Weak machine key", ("A-015", "T-002"), "CRITICAL", "CONFIRMED", (321, 326),
        lambda r: _problems(r, "(?i)<machineKey[^>]*>", ("validation key too short", _short("validationKey", 64)), ("decryption key too short", _short("decryptionKey", 48)), ("SHA1", _is(r"\bvalidation", "SHA1")), ("weak algorithm", lambda el: _is(r"\bvalidation", "MD5")(el) | _is(r"\bdecryption", "DES")(el)), ("3DES", _is(r"\bvalidation", "3DES"))),
    ),
    FileRule("web-viewstate-mac", "View state not protected", ("J-006", "T-001"), "CRITICAL", "CONFIRMED", (502,), first_match(r'(?i)<pages[^>]*\b(enableViewStateMac\s*=\s*"false"|viewStateEncryptionMode\s*=\s*"Never")[^>]*>')),
    FileRule("web-request-validation", "Request validation off", ("D-004",), "HIGH", "CONFIRMED", (79,), every_match(r'(?i)<(?:pages|httpRuntime)[^>]*\b(?:validateRequest\s*=\s*"false"|requestValidationMode\s*=\s*"2\.0")[^>]*>')),
    FileRule("web-trace", "Tracing on", ("N-007",), "HIGH", "CONFIRMED", (489,), first_match(r'(?i)<trace[^>]*\benabled\s*=\s*"true"[^>]*>'), category="configuration"),
    FileRule("web-directory-browsing", "Directory listing on", ("N-009",), "MEDIUM", "CONFIRMED", (548,), first_match(r'(?i)<directoryBrowse[^>]*\benabled\s*=\s*"true"[^>]*>'), category="configuration"),
    FileRule(
        "web-forms-auth", "Weak sign-in cookie", ("T-009", "T-010", "N-005"), "HIGH", "CONFIRMED", (565,),
        lambda r: _problems(r, "(?i)<forms[^>]*>", ("ticket not fully protected", _is("protection", "NONE", "ENCRYPTION", "VALIDATION")), ("ticket in the address", _is("cookieless", "USEURI", "TRUE")), ("cookie without encryption", lambda el: T.attribute(el, "requireSSL") == "false"), ("ticket lives too long", lambda el: T.attribute(el, "timeout").try_cast("double") > 480)),
    ),
    FileRule("web-cookie-flags", "Cookie flags off", ("N-005",), "MEDIUM", "CONFIRMED", (1004,), every_match(r"(?i)<httpCookie[^>]*>", lambda el: el.rlike(r'(?i)secure\s*=\s*"false"|httpOnlyCookies\s*=\s*"false"'))),
    FileRule("V-002", "Service metadata published", ("V-002",), "MEDIUM", "CONFIRMED", (200,), first_match(r'(?i)<serviceMetadata[^>]*\bhttpGetEnabled\s*=\s*"true"[^>]*>', whole_line=False)),
    FileRule("V-003", "Exception details in faults", ("V-003",), "HIGH", "CONFIRMED", (209,), first_match(r'(?i)<serviceDebug[^>]*\bincludeExceptionDetailInFaults\s*=\s*"true"[^>]*>', whole_line=False)),
    FileRule("V-001", "Binding without security", ("V-001",), "CRITICAL", "CONFIRMED", (319,), first_match(r'(?i)<binding[^>]*\bmode\s*=\s*"None"[^>]*>', whole_line=False)),
    FileRule(
        "web-execution-limits", "Very large requests allowed", ("N-010",), "LOW", "CONFIRMED", (400,),
        lambda r: _limits(r), category="configuration",
    ),
    FileRule("web-connection-string", "Password in a connection string", ("E-001", "M-001"), "CRITICAL", "CONFIRMED", (798,), every_match(r'(?i)<add\s+[^>]*connectionString\s*=\s*"[^"]*"[^>]*>', lambda el: F.regexp_extract(el, r'(?i)connectionString\s*=\s*"([^"]*)"', 1).rlike(_CRED), lambda el: F.regexp_replace(el, r'(?i)(password|pwd)\s*=\s*[^;"\s][^;"]*', "$1=***REDACTED***"))),
    FileRule("web-security-headers", "No security headers", ("N-004",), "MEDIUM", "LIKELY", (693,), lambda r: first_match(r"(?i)<system\.webServer", ~F.col("text").contains("<customHeaders"))(r), category="configuration"),
    FileRule("web-membership-policy", "Weak password policy", ("CH-002",), "MEDIUM", "CONFIRMED", (521,), _membership, category="configuration"),
]


_SETTING = r'(?i)"(\w*(?:password|passwd|pwd|secret|apikey|api_key|token|connectionstring|connstr)\w*)"\s*:\s*"([^"]{4,})"'
#: The pattern and the cases of settings files.
SETTINGS = [
    FileRule(
        "web-appsettings-secret", "Credential in settings", ("E-001", "M-001"), "CRITICAL", "CONFIRMED", (798,),
        # an empty value alone is what the first choice of the original list excludes, and it cannot occur here
        every_match(_SETTING, lambda h: ~F.regexp_extract(h, _SETTING, 2).rlike(r"(?i)^(?:\{your|<|changeme|x+|placeholder|\*+|REDACTED)"), lambda h: F.concat(F.lit('"'), F.regexp_extract(h, _SETTING, 1), F.lit('": "***REDACTED***"'))), language="json",
    )
]

#: When support of a target framework ended.
END_OF_SUPPORT = {
    "v2.0": "2011-07-12", "v3.0": "2011-07-12", "v3.5": "2029-01-09", "v4.0": "2016-01-12", "v4.5": "2016-01-12", "v4.5.1": "2016-01-12", "v4.5.2": "2022-04-26", "v4.6": "2022-04-26", "v4.6.1": "2022-04-26",
    "netcoreapp1.0": "2019-06-27", "netcoreapp1.1": "2019-06-27", "netcoreapp2.0": "2018-10-01", "netcoreapp2.1": "2021-08-21", "netcoreapp2.2": "2019-12-23", "netcoreapp3.0": "2020-03-03", "netcoreapp3.1": "2022-12-13",
    "net5.0": "2022-05-10", "net6.0": "2024-11-12", "net7.0": "2024-05-14", "net8.0": "2026-11-10", "net9.0": "2026-05-12",
}


def manifest_rules(now: str) -> list[FileRule]:
    """Rules of project files; `now` (ISO time) decides what is out of support."""
    gone = [t for t, d in END_OF_SUPPORT.items() if now >= f"{d}T23:59:59"]
    target = r'(?i)(?:<TargetFramework(?:Version|s)?\s*>\s*([^<\s]+)\s*<|TargetFramework\s*=\s*"([^"]+)")'

    def eol(rule) -> Column:
        names = F.array_distinct(F.filter(F.concat(F.regexp_extract_all("text", F.lit(target), F.lit(1)), F.regexp_extract_all("text", F.lit(target), F.lit(2))), lambda t: F.lower(t).isin(*gone)))
        line = T.first_line(F.col("text"), r"(?i)<TargetFramework|TargetFramework\s*=")
        return F.when(F.size(names) > 0, F.array(hit(rule, line, redacted(F.get("lines", line - 1)))))

    def floating(rule) -> Column:
        patterns = (r'(?i)<package\s+[^>]*version\s*=\s*"[^"]*[\s*][^"]*"', r'(?i)<PackageReference\s+[^>]*Version\s*=\s*"[^"]*[\s*][^"]*"', r'(?i)<package\s+[^>]*version\s*=\s*""\s*/?>')
        hits = F.concat(*[T.all_matches(F.col("text"), p) for p in patterns])
        first = F.get(hits, F.lit(0))
        return F.when(F.size(hits) > 0, F.array(hit(rule, first["line"], redacted(F.array_join(F.transform(F.slice(hits, 1, 3), lambda h: h["hit"]), "\n")))))

    return [
        FileRule("manifest-eol-tfm", "Target framework out of support", ("O-005",), "HIGH", "CONFIRMED", (1104,), eol, category="dependency"),
        FileRule("manifest-floating-version", "Package version left open", ("O-003",), "MEDIUM", "CONFIRMED", (1357,), floating, category="dependency"),
        FileRule("manifest-unsafe-blocks", "Unsafe code allowed", (), "LOW", "CONFIRMED", (), first_match(r"(?i)<AllowUnsafeBlocks\s*>\s*true\s*<"), category="code-quality"),
    ]


def _at(pattern: str, lines: str = "lines") -> Column:
    return F.greatest(F.lit(1), F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True))


def _headers(rule) -> Column:
    text = F.col("text")
    ok = text.rlike(r"(Configure(?:Services)?|UseRouting|MapControllers|Application_Start)\s*\(") & ~text.rlike(r"(?i)\.UseHsts\s*\(|UseSecurityHeaders|X-Content-Type-Options|X-Frame-Options|Content-Security-Policy|UseHsts\(")
    n = _at(r"void\s+Configure|Configure\s*\(|Application_Start")
    return F.when(ok, F.array(hit(rule, n, T.snippet(F.col("lines"), n, 0, 4))))


def _cors(rule) -> Column:
    any_origin = F.exists("plain", lambda x: x.rlike(r"AllowAnyOrigin\s*\("))
    creds = F.exists("plain", lambda x: x.rlike(r"AllowCredentials\s*\("))
    n = _at(r"AllowAnyOrigin\s*\(", "plain")
    strs = lambda *x: F.array(*[F.lit(y) for y in x])
    return F.when(any_origin, F.array(hit(rule, n, T.snippet(F.col("lines"), n, 0, 4), severity=F.when(creds, "CRITICAL").otherwise("HIGH"), cases=F.when(creds, strs("N-002")).otherwise(strs("N-001", "N-003")), cwe=F.when(creds, strs("CWE-942")).otherwise(strs("CWE-346")))))


def _developer_page(rule) -> Column:
    def of(line: Column, i: Column) -> Column:
        guarded = line.rlike(r"IsDevelopment\s*\(|if\s*\(") | F.get("plain", F.greatest(F.lit(0), i - 1)).rlike(r"if\s*\(\s*\w+\.IsDevelopment")
        return F.when(line.rlike(r"\.UseDeveloperExceptionPage\s*\(") & ~guarded, hit(rule, i + 1, T.snippet(F.col("lines"), i + 1, 2, 1)))

    return F.filter(F.transform("plain", of), lambda h: h.isNotNull())


def _authz(rule) -> Column:
    text = F.col("text")
    ends = r"MapControllers\s*\(|MapRazorPages\s*\(|Map\w+Endpoints?\s*\(|MapGet\s*\(|MapPost\s*\("
    ok = text.rlike(r"app\s*\.\s*(?:Use|Map)") & text.rlike(ends) & ~text.rlike(r"UseAuthorization\s*\(|RequireAuthorization\s*\(|\[Authorize\]|FallbackPolicy|AddAuthorization") & ~text.rlike(r"UseAuthentication\s*\(|AddAuthentication")
    n = _at(r"MapControllers|MapRazorPages|Map\w+Endpoints?\s*\(|MapGet\s*\(|MapPost\s*\(", "plain")
    return F.when(ok, F.array(hit(rule, n, T.snippet(F.col("lines"), n, 0, 4))))


#: Rules of start-up files, with their severities and cases.
STARTUP = [
    FileRule("startup-security-headers", "Start-up sets no security headers", ("N-004", "F-005"), "MEDIUM", "LIKELY", (693,), _headers, category="configuration", language="csharp"),
    FileRule("startup-cors", "Any origin allowed", ("N-001", "N-002", "N-003"), "HIGH", "LIKELY", (942,), _cors, language="csharp"),
    FileRule("startup-dev-exception", "Developer error page always on", ("H-002", "H-001"), "HIGH", "LIKELY", (209,), _developer_page, category="configuration", language="csharp"),
    FileRule("startup-authz-middleware", "Endpoints without authorisation", ("B-002", "W-012"), "CRITICAL", "LIKELY", (862,), _authz, language="csharp"),
]
STARTUP_FILES = r"(?i)(?:^|[/\\])(Startup|Program|Global)\.(cs|vb)\z|(?:^|[/\\])Startup\.\w+\.(?:cs|vb)\z"
#: Folders of the tree that no rule reads, and the size from which a file is not read.
SKIPPED_DIRS = ("bin", "obj", "packages", "node_modules", "tests", "test", "migrations", ".git", ".vs", ".idea", ".svn", ".sonarqube", "testresults")
MAX_BYTES = 2 * 1024 * 1024


def project_facts(files: DataFrame) -> DataFrame:
    """TXT-14: what holds for a whole project: a global authorisation filter, sign-in by cookie, sign-in by token. Pre-aggregated before the shuffle."""
    cs, text = F.col("path").rlike(r"(?i)\.(cs|vb)\z"), F.col("text")
    has = lambda p: F.coalesce(F.bool_or(cs & text.rlike(p)), F.lit(False))
    return files.groupBy("project").agg(
        F.struct(
            has(r"(?i)Filters\s*\.\s*Add\s*\(\s*new\s+Authorize|\bAuthorizeFilter\b|\.RequireAuthorization\s*\(|FallbackPolicy\s*=|options\s*\.\s*Filters\s*\.\s*Add\s*<\s*Authorize").alias("global_filter"),
            has(r"(?i)AddCookie\s*\(|CookieAuthentication|FormsAuthentication|UseCookieAuthentication").alias("cookie_auth"),
            has(r"(?i)OAuthAuthorizationServerOptions|AddJwtBearer|UseJwtBearerAuthentication|OAuthBearerAuthentication|UseOAuthBearerTokens").alias("token_auth"),
        ).alias("facts")
    )


def prepare(files: DataFrame) -> DataFrame:
    """Files ``(project, path, text)`` with lines and stripped lines; null texts and paths are dropped. No shuffle."""
    base = named(files)
    read = base.withColumn("lines", T.lines_of(F.col("text"))).withColumn("s", T.stripped("lines"))
    return read.select("project", "path", F.array_join("lines", "\n").alias("text"), "lines", F.col("s.code").alias("code"), F.col("s.plain").alias("plain"))


def named(files: DataFrame) -> DataFrame:
    skipped = "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS)
    read = files.where("text IS NOT NULL AND path IS NOT NULL").where(~F.translate("path", "\\", "/").rlike(rf"(?i)(?:^|/)(?:{skipped})/"))
    return read.where(F.octet_length("text") <= MAX_BYTES).select(F.coalesce("project", F.lit("")).alias("project"), F.translate("path", "\\", "/").alias("path"), "text")


def missing_lockfile(files: DataFrame) -> DataFrame:
    """CHK-67: projects with package manifests and no lock file: ``(project, path)``, the first manifest by path."""
    manifest, pc = F.col("path").rlike(r"(?i)\.(csproj|vbproj|fsproj)\z"), F.col("path").rlike(r"(?i)(^|/)packages\.config\z")
    p = files.withColumn("path", F.translate("path", "\\", "/")).groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(F.min(F.when(manifest, F.col("path"))).alias("m"), F.min(F.when(pc, F.col("path"))).alias("p"), F.bool_or(F.col("path").rlike(r"(?i)packages\.lock\.json\z")).alias("locked"))
    return p.where("coalesce(m, p) IS NOT NULL AND NOT locked").select("project", F.coalesce("m", "p").alias("path"))


def native_hits(files: DataFrame, now: str) -> DataFrame:
    """Hits of all rules: ``(project, path, kind, no, hit)``."""
    # paths are filtered before lines are made and stripped
    of = lambda p: prepare(files.where(F.translate("path", "\\", "/").rlike(p)))
    parts = [
        scan(of(r"(?i)\.config\z"), CONFIG, "config"), scan(of(r"(?i)(?:^|/)appsettings(\.\w+)?\.json\z"), SETTINGS, "settings"), settled(scan(of(r"(?i)\.(cs|vb)\z"), CSHARP + CSHARP_FILES, "source"), project_facts(named(files))),
        scan(of(r"(?i)\.(csproj|vbproj|fsproj)\z"), manifest_rules(now), "manifest"), scan(of(STARTUP_FILES), STARTUP, "startup"),
    ]
    lock = FileRule("native-no-lockfile", "No lock file beside the package manifests", ("O-003",), "MEDIUM", "CONFIRMED", (1357,), None, category="dependency")
    parts.append(missing_lockfile(files).select("project", "path", F.lit(0).alias("no"), hit(lock, F.lit(1), F.lit("")).alias("hit"), F.lit("project").alias("kind")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def native_findings(files: DataFrame, now: str) -> DataFrame:
    """Hits as findings, with ``project``."""
    h = native_hits(files, now)
    note = F.when(F.col("hit.confidence") == "POSSIBLE", "a pattern without proof of data flow; read the lines first").otherwise("established from the file's own content")
    none = F.lit(None).cast("string")
    return h.select(
        "project", F.col("hit.title").alias("title"), F.col("hit.category").alias("category"), F.coalesce(F.get("hit.cases", F.lit(0)), F.lit("native")).alias("subcategory"), F.col("hit.severity").alias("severity"), F.col("hit.confidence").alias("confidence"), F.lit("OPEN").alias("status"),
        F.col("hit.cwe").alias("cwe"), F.col("hit.cases").alias("tests"), F.struct(F.col("path").alias("file"), F.col("hit.line").alias("startLine"), F.col("hit.line").alias("endLine")).alias("location"),
        F.struct(F.col("hit.snippet").alias("snippet"), F.col("hit.language").alias("language"), F.concat(F.lit("native check "), F.col("hit.rule")).alias("toolOutput")).alias("evidence"),
        F.struct(F.lit("DETERMINISTIC").alias("class"), F.array(F.struct(F.lit("native").alias("engine"), F.col("hit.rule").alias("ruleId"), F.lit("ALERT").alias("status"))).alias("rules")).alias("detection"),
        F.array(F.struct(F.lit("native").alias("tool"), none.alias("sourceFindingId"), F.lit("REPORTED").alias("status"), note.alias("note"))).alias("sources"),
    )


def applicable(stack: str) -> Column:
    """TXT-12: whether a catalog case applies to a project's stack."""
    return (F.col("stack") == "both") | (F.col("stack") == stack) | F.lit(stack in ("unknown", "mixed"))


def catalog_coverage(hits: DataFrame, catalog: DataFrame, stack: str) -> DataFrame:
    """``(caseId, tool, outcome)``: a case is checked if any check that names it gave a hit, else left to people, unless it does not apply."""
    seen = hits.select(F.explode("hit.cases").alias("caseId")).distinct().withColumn("seen", F.lit(True))
    out = catalog.join(seen, catalog.id == seen.caseId, "left")
    return out.select(F.col("id").alias("caseId"), F.lit("native").alias("tool"), F.when(~applicable(stack), "not-applicable").when(F.col("seen"), "checked").otherwise("manual-review").alias("outcome"))
