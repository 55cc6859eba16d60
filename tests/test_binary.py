"""A small assembly, built byte by byte, through the readers."""

import struct

from gritmill.operators.binaries import binary_findings, known_vulnerable
from gritmill.sources.binary import assemblies, binding_redirects, deps_targets, inspect, string_rules
from pyspark.sql import functions as F


def build(refs=(("Newtonsoft.Json", (9, 0, 0, 0)), ("Gone.Lib", (1, 0, 0, 0))), debug=True, text="Server=a;Database=b;Password=hunter22", scope="H"):
    strings, blobs = bytearray(b"\0"), bytearray(b"\0")

    def s(x):
        at = len(strings)
        strings.extend(x.encode() + b"\0")
        return at

    def b(x):
        at = len(blobs)
        blobs.extend(bytes([len(x)]) + x)
        return at

    tfm = b".NETFramework,Version=v4.5"
    rows = {
        0x00: [struct.pack("<HHHHH", 0, s("App.dll"), 1, 0, 0)],
        0x01: [struct.pack(f"<{scope}HH", 6, s("DebuggableAttribute"), s("System.Diagnostics")), struct.pack(f"<{scope}HH", 6, s("TargetFrameworkAttribute"), s("System.Runtime.Versioning"))],
        0x0A: [struct.pack("<HHH", 1 << 3 | 1, s(".ctor"), 0), struct.pack("<HHH", 2 << 3 | 1, s(".ctor"), 0)],
        0x0C: [struct.pack("<HHH", 1 << 5 | 14, 1 << 3 | 3, b(b"\x01\0" + struct.pack("<I", 0x107 if debug else 2) + b"\0\0")), struct.pack("<HHH", 1 << 5 | 14, 2 << 3 | 3, b(b"\x01\0" + bytes([len(tfm)]) + tfm + b"\0\0"))],
        0x20: [struct.pack("<IHHHHIHHH", 0x8004, 1, 2, 3, 4, 0, 0, s("App"), 0)],
        0x23: [struct.pack("<HHHHIHHHH", *v, 0, 0, s(n), 0, 0) for n, v in refs],
    }
    valid = sum(1 << t for t in rows)
    tables = struct.pack("<IBBBBQQ", 0, 2, 0, 0, 1, valid, 0) + b"".join(struct.pack("<I", len(r)) for r in rows.values()) + b"".join(b"".join(r) for r in rows.values())
    us = text.encode("utf-16-le") + b"\0"
    heaps = {"#~": tables, "#Strings": bytes(strings), "#US": b"\0" + bytes([len(us)]) + us, "#GUID": b"\0" * 16, "#Blob": bytes(blobs)}
    version = b"v4.0.30319\0\0"
    pad = lambda x: x + b"\0" * (-len(x) % 4)
    names = {k: pad(k.encode() + b"\0") for k in heaps}
    at = 16 + len(version) + 4 + sum(8 + len(n) for n in names.values())
    head, body = b"", b""
    for k, h in heaps.items():
        h = pad(h)
        head += struct.pack("<II", at + len(body), len(h)) + names[k]
        body += h
    meta = struct.pack("<IHHII", 0x424A5342, 1, 1, 0, len(version)) + version + struct.pack("<HH", 0, len(heaps)) + head + body
    cor = struct.pack("<IHHIIII", 72, 2, 5, 0x2000 + 72, len(meta), 1, 0) + b"\0" * 48
    pdb = b"RSDS" + b"\0" * 20 + b"C:\\build\\secret\\App.pdb\0"
    dbg_at = 0x200 + len(cor) + len(meta)
    dbg = struct.pack("<IIHHIIII", 0, 0, 0, 0, 2, len(pdb), 0, dbg_at + 28)
    section = cor + meta + dbg + pdb
    dirs = [(0, 0)] * 16
    dirs[14], dirs[6] = (0x2000, 72), (0x2000 + dbg_at - 0x200, 28)
    opt = struct.pack("<H", 0x10B) + b"\0" * 90 + struct.pack("<I", 16) + b"".join(struct.pack("<II", *d) for d in dirs)
    image = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, len(opt), 0) + opt + b".text\0\0\0" + struct.pack("<IIII", len(section), 0x2000, len(section), 0x200) + b"\0" * 16
    return image.ljust(0x200, b"\0") + section


def test_inspect():
    got = inspect(build())
    assert (got["managed"], got["name"], got["version"], got["target_framework"], got["debug"], got["signed"]) == (True, "App", "1.2.3.4", ".NETFramework,Version=v4.5", True, False)
    assert got["references"] == [{"name": "Newtonsoft.Json", "version": "9.0.0.0"}, {"name": "Gone.Lib", "version": "1.0.0.0"}]
    assert got["pdb_paths"] == ["C:\\build\\secret\\App.pdb"]
    assert {h["rule"] for h in got["strings"]} == {"binary-connection-string", "binary-credential-literal"} and "hunter22" not in str(got["strings"])
    assert inspect(build(debug=False))["debug"] is False
    for bad in (b"", b"MZ", b"\x7fELF", build()[:300], None):
        assert inspect(bad)["problem"]


def test_widened_columns():
    """Indices written wider than the row counts ask for are found by where the tables end and what their rows refer to."""
    plain, wide = inspect(build()), inspect(build(scope="I"))
    assert wide == plain and wide["references"]


def test_strings():
    assert string_rules("https://wiki.corp/x") == ["binary-internal-endpoint"] and string_rules("https://example.com") == []
    assert string_rules("AKIA" + "A" * 16) == ["binary-api-key-shape"] and string_rules("get_password=abc") == []


def test_findings(spark):
    df = spark.createDataFrame([("p", "bin/App.dll", bytearray(build())), ("p", "bin/Newtonsoft.Json.dll", bytearray(b"junk"))], "project string, path string, content binary")
    web = '<dependentAssembly><assemblyIdentity name="log4net" publicKeyToken="x" /><bindingRedirect oldVersion="0.0.0.0-1.2.0.0" newVersion="2.0.5.0" /></dependentAssembly>'
    red = binding_redirects(spark.createDataFrame([("p", "Web.config", web), ("p", "b", None)], "project string, path string, text string"))
    inv = assemblies(df).cache()
    got = {(r.rule, r.severity) for r in binary_findings(inv, red).collect()}
    assert {("binary-debug-build", "HIGH"), ("binary-not-strong-named", "LOW"), ("binary-pdb-path", "LOW"), ("binary-known-vulnerable-reference", "HIGH"), ("binary-missing-dependency", "LOW"), ("binary-binding-redirect", "HIGH"), ("binary-string", "HIGH"), ("binary-no-decompiler", "INFO")} == got
    assert ("binary-eol-runtime", "MEDIUM") in {(r.rule, r.severity) for r in binary_findings(inv, strict=False).collect()}


def test_versions_and_deps(spark):
    df = spark.createDataFrame([("Newtonsoft.Json", "13.0.0.1"), ("newtonsoft.json", "12.9"), ("log4net", "x.1"), ("log4net", None), ("other", "0.1")], "n string, v string")
    assert [r[0] for r in df.select(known_vulnerable(F.col("n"), F.col("v"))).collect()] == [False, True, False, False, False]
    deps = '{"runtimeTarget": {"name": "net8"}, "targets": {"net7": {"Old/1.0": {}}, "net8": {"App/1.0.0": {}, "A/B/2.0": {}}}}'
    rows = deps_targets(spark.createDataFrame([("p", "a.deps.json", deps), ("p", "b.deps.json", "{")], "project string, path string, text string")).collect()
    assert {(r.name, r.version) for r in rows} == {("App", "1.0.0"), ("A/B", "2.0")}
