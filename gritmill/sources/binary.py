"""Deployed assemblies as rows (SCAN-28 to SCAN-33): PE headers, CLI metadata by ECMA-335, strings, redirects.

One assembly is one value, read by one task; nothing of it is executed. All readers check bounds and give what they can.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values (ECMA-335 II.22): columns of the metadata tables by number. S, G, B: heaps; u2, u4; a number: a table; a name: a coded index.
TABLES = {
    0x00: "u2 S G G G", 0x01: "ResolutionScope S S", 0x02: "u4 S S TypeDefOrRef 04 06", 0x03: "04", 0x04: "u2 S B", 0x05: "06", 0x06: "u4 u2 u2 S B 08", 0x07: "08", 0x08: "u2 u2 S", 0x09: "02 TypeDefOrRef", 0x0A: "MemberRefParent S B",
    0x0B: "u2 HasConstant B", 0x0C: "HasCustomAttribute CustomAttributeType B", 0x0D: "HasFieldMarshal B", 0x0E: "u2 HasDeclSecurity B", 0x0F: "u2 u4 02", 0x10: "u4 04", 0x11: "B", 0x12: "02 14", 0x13: "14", 0x14: "u2 S TypeDefOrRef", 0x15: "02 17", 0x16: "17", 0x17: "u2 S B",
    0x18: "u2 06 HasSemantics", 0x19: "02 MethodDefOrRef MethodDefOrRef", 0x1A: "S", 0x1B: "B", 0x1C: "u2 MemberForwarded S 1A", 0x1D: "u4 04", 0x1E: "u4 u4", 0x1F: "u4", 0x20: "u4 u2 u2 u2 u2 u4 B S S", 0x21: "u4", 0x22: "u4 u4 u4", 0x23: "u2 u2 u2 u2 u4 B S S B", 0x24: "u4 23", 0x25: "u4 u4 u4 23",
    0x26: "u4 S B", 0x27: "u4 u4 S S Implementation", 0x28: "u4 u4 S Implementation", 0x29: "02 02", 0x2A: "u2 u2 TypeOrMethodDef S", 0x2B: "MethodDefOrRef B", 0x2C: "2A TypeDefOrRef",
}
#: Fixed values (II.24.2.6): tag bits and tables of coded indexes; -1 is an unused tag.
CODED = {
    "TypeDefOrRef": (2, (0x02, 0x01, 0x1B)), "HasConstant": (2, (0x04, 0x08, 0x17)), "HasCustomAttribute": (5, (0x06, 0x04, 0x01, 0x02, 0x08, 0x09, 0x0A, 0x00, 0x0E, 0x17, 0x14, 0x11, 0x1A, 0x1B, 0x20, 0x23, 0x26, 0x27, 0x28, 0x2A, 0x2C, 0x2B)),
    "HasFieldMarshal": (1, (0x04, 0x08)), "HasDeclSecurity": (2, (0x02, 0x06, 0x20)), "MemberRefParent": (3, (0x02, 0x01, 0x1A, 0x06, 0x1B)), "HasSemantics": (1, (0x14, 0x17)), "MethodDefOrRef": (1, (0x06, 0x0A)),
    "MemberForwarded": (1, (0x04, 0x06)), "Implementation": (2, (0x26, 0x23, 0x27)), "CustomAttributeType": (3, (-1, -1, 0x06, 0x0A, -1)), "ResolutionScope": (2, (0x00, 0x1A, 0x23, 0x01)), "TypeOrMethodDef": (1, (0x02, 0x06)),
}
MAX_BYTES = 200 << 20
#: Bounds of the search for widened columns: columns of a table, and choices tried.
MOST_WIDENED, MOST_STEPS = 4, 20_000
JIT_OPTIMISER_OFF = 0x100
MAX_USER_STRINGS, MAX_RAW_STRINGS, MIN_RAW = 20_000, 50_000, 8


class Pe:
    """Headers of a PE image; raises ValueError on anything else."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        try:
            if data[:2] != b"MZ":
                raise ValueError("no DOS header")
            (at,) = struct.unpack_from("<I", data, 0x3C)
            if data[at : at + 4] != b"PE\0\0":
                raise ValueError("no PE header")
            self.machine, n, self.stamp, _, _, size, _ = struct.unpack_from("<HHIIIHH", data, at + 4)
            opt = at + 24
            (magic,) = struct.unpack_from("<H", data, opt)
            if magic not in (0x10B, 0x20B):
                raise ValueError("unknown optional header")
            self.plus = magic == 0x20B
            dirs = opt + (112 if self.plus else 96)
            (count,) = struct.unpack_from("<I", data, dirs - 4)
            self.dirs = [struct.unpack_from("<II", data, dirs + 8 * i) for i in range(min(count, 16))]
            self.sections = []
            for i in range(n):
                vsize, vaddr, rsize, raw = struct.unpack_from("<IIII", data, opt + size + 40 * i + 8)
                self.sections.append((vaddr, max(vsize, rsize), raw, rsize))
        except struct.error as e:
            raise ValueError("cut off") from e

    def offset(self, rva: int) -> int:
        """Place in the file of an address; 0 if no section backs it."""
        for vaddr, size, raw, rsize in self.sections:
            if vaddr <= rva < vaddr + size:
                return raw + rva - vaddr if rva - vaddr < rsize else 0
        return 0

    def directory(self, i: int) -> tuple[int, int]:
        rva, size = self.dirs[i] if i < len(self.dirs) else (0, 0)
        return (self.offset(rva), size) if rva else (0, 0)

    def debug_paths(self) -> list[str]:
        at, size = self.directory(6)
        out = []
        for i in range(size // 28 if at else 0):
            try:
                kind, n, _, raw = struct.unpack_from("<IIII", self.data, at + 28 * i + 12)
            except struct.error:
                break
            head = self.data[raw : raw + 4]
            if kind == 2 and head in (b"RSDS", b"NB10"):
                path = self.data[raw + (24 if head == b"RSDS" else 16) : raw + n].split(b"\0")[0].decode("utf-8", "replace")
                if path:
                    out.append(path)
        return out

    def cli(self) -> dict | None:
        """The CLI header; None for an image without one."""
        at, size = self.directory(14)
        if not at or size < 72 or at + 72 > len(self.data):
            return None
        _, major, minor, mrva, msize, flags = struct.unpack_from("<IHHIII", self.data, at)
        srva, ssize = struct.unpack_from("<II", self.data, at + 32)
        place = self.offset(srva) if srva else 0
        blob = self.data[place : place + ssize] if place else b""
        il = bool(flags & 1)
        bits = "64" if self.plus else "32" if flags & 2 and not flags & 0x20000 else "32-preferred" if flags & 0x20000 else "any"
        return {"metadata": (self.offset(mrva), msize), "il_only": il, "mixed": not il, "bitness": bits, "signed_flag": bool(flags & 8), "signed": bool(flags & 8) and any(blob)}


def compressed(data: bytes, at: int) -> tuple[int, int]:
    """An unsigned compressed integer (II.23.2) and the place after it."""
    b = data[at]
    if b < 0x80:
        return b, at + 1
    if b < 0xC0:
        return (b & 0x3F) << 8 | data[at + 1], at + 2
    return int.from_bytes(bytes([b & 0x1F]) + data[at + 1 : at + 4], "big"), at + 4


class Metadata:
    """The metadata streams of an assembly and rows of its tables."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"BSJB":
            raise ValueError("no metadata")
        (n,) = struct.unpack_from("<I", data, 12)
        self.version = data[16 : 16 + n].split(b"\0")[0].decode("ascii", "replace")
        at = 16 + n
        (count,) = struct.unpack_from("<H", data, at + 2)
        at += 4
        self.streams: dict[str, bytes] = {}
        for _ in range(count):
            off, size = struct.unpack_from("<II", data, at)
            end = data.index(b"\0", at + 8)
            self.streams[data[at + 8 : end].decode("ascii", "replace")] = data[off : off + size]
            at += 8 + (end - at - 8) // 4 * 4 + 4
        t = self.streams.get("#~") or self.streams.get("#-")
        if t is None:
            raise ValueError("no tables")
        wide, valid = t[6], struct.unpack_from("<Q", t, 8)[0]
        self.rows = {}
        at = 24
        for i in range(64):
            if valid >> i & 1:
                if i not in TABLES:
                    raise ValueError(f"unknown table {i:#x}")
                (self.rows[i],) = struct.unpack_from("<I", t, at)
                at += 4
        if wide & 0x40:
            at += 4
        self.size = {"S": 4 if wide & 1 else 2, "G": 4 if wide & 2 else 2, "B": 4 if wide & 4 else 2}
        self.tables = t
        self.place: dict[int, tuple[int, list[int]]] = {}
        for i, widths in zip(self.rows, self._layout(at)):
            self.place[i] = at, widths
            at += self.rows[i] * sum(widths)

    def _layout(self, start: int) -> list[list[int]]:
        """Widths of each table's columns. Where those that the row counts ask for do not end with the stream, as some
        compilers write indices wider than they need to, the first choice of widened indices that does and whose rows
        refer to what exists; without one, the widths by the row counts."""
        order = list(self.rows)
        plain = [[self._width(c) for c in TABLES[i].split()] for i in order]
        spare = len(self.tables) - start - sum(self.rows[i] * sum(w) for i, w in zip(order, plain))
        if 0 <= spare < 4:
            return plain
        steps = [0]

        def choices(k: int) -> Iterator[list[int]]:
            cols = TABLES[order[k]].split()
            narrow = [c for c, w in enumerate(plain[k]) if w == 2 and cols[c] not in ("u2", "S", "G", "B")][:MOST_WIDENED]
            for n in range(len(narrow) + 1):
                for wider in itertools.combinations(narrow, n):
                    yield [4 if c in wider else w for c, w in enumerate(plain[k])]

        def fit(k: int, at: int, spare: int) -> list[list[int]] | None:
            if k == len(order):
                return [] if 0 <= spare < 4 else None
            for widths in choices(k):
                more = self.rows[order[k]] * (sum(widths) - sum(plain[k]))
                steps[0] += 1
                if more > spare or steps[0] > MOST_STEPS or not self._sound(order[k], at, widths):
                    continue
                rest = fit(k + 1, at + self.rows[order[k]] * sum(widths), spare - more)
                if rest is not None:
                    return [widths, *rest]
            return None

        return fit(0, start, spare) or plain

    def _sound(self, table: int, at: int, widths: list[int]) -> bool:
        """Whether the first rows of a table, read with these widths, refer to heaps and tables within their sizes."""
        self.place[table] = at, widths
        heap = {"S": "#Strings", "B": "#Blob"}
        for n in range(1, min(self.rows[table], 32) + 1):
            for c, v in zip(TABLES[table].split(), self.row(table, n)):
                if c in heap and v > len(self.streams.get(heap[c], b"")):
                    return False
                if c in CODED:
                    to, at_row = self.decode(c, v)
                    if at_row and (to < 0 or at_row > self.rows.get(to, 0)):
                        return False
                elif c not in ("u2", "u4", "S", "G", "B") and v > self.rows.get(int(c, 16), 0) + 1:
                    return False
        return True

    def _width(self, c: str) -> int:
        if c in self.size:
            return self.size[c]
        if c in ("u2", "u4"):
            return int(c[1])
        if c in CODED:
            bits, targets = CODED[c]
            return 2 if all(self.rows.get(t, 0) < 1 << (16 - bits) for t in targets) else 4
        return 2 if self.rows.get(int(c, 16), 0) < 1 << 16 else 4

    def row(self, table: int, n: int) -> list[int]:
        """Row `n`, from 1."""
        at, widths = self.place[table]
        at += (n - 1) * sum(widths)
        out = []
        for w in widths:
            out.append(int.from_bytes(self.tables[at : at + w], "little"))
            at += w
        return out

    def all_rows(self, table: int) -> Iterator[list[int]]:
        return (self.row(table, i + 1) for i in range(self.rows.get(table, 0)))

    def string(self, i: int) -> str:
        h = self.streams.get("#Strings", b"")
        return h[i : h.index(b"\0", i)].decode("utf-8", "replace") if 0 < i < len(h) else ""

    def blob(self, i: int) -> bytes:
        h = self.streams.get("#Blob", b"")
        if not 0 < i < len(h):
            return b""
        n, at = compressed(h, i)
        return h[at : at + n]

    def decode(self, kind: str, value: int) -> tuple[int, int]:
        bits, targets = CODED[kind]
        tag = value & (1 << bits) - 1
        return (targets[tag] if tag < len(targets) else -1), value >> bits

    def user_strings(self) -> list[str]:
        h, at, out = self.streams.get("#US", b""), 1, []
        while at < len(h) and len(out) < MAX_USER_STRINGS:
            try:
                n, at = compressed(h, at)
            except IndexError:
                break
            if n > 1:
                out.append(h[at : at + n - 1].decode("utf-16-le", "replace"))
            at += n
        return out

    def attribute_name(self, kind: int) -> str:
        table, n = self.decode("CustomAttributeType", kind)
        if table != 0x0A or not n or n > self.rows.get(0x0A, 0):
            return ""
        owner, k = self.decode("MemberRefParent", self.row(0x0A, n)[0])
        return self.string(self.row(0x01, k)[1]) if owner == 0x01 and 0 < k <= self.rows.get(0x01, 0) else ""

    def assembly(self) -> dict:
        out: dict = {"name": None, "version": None, "token": None, "target_framework": None, "debug": None, "module": None}
        for r in self.all_rows(0x00):
            out["module"] = self.string(r[1])
        for r in self.all_rows(0x20):
            key = self.blob(r[6])
            out |= {"name": self.string(r[7]), "version": ".".join(map(str, r[1:5])), "token": hashlib.sha1(key).digest()[-8:][::-1].hex() if key else None}
        for parent, kind, value in self.all_rows(0x0C):
            if self.decode("HasCustomAttribute", parent)[0] != 0x20:
                continue
            name, b = self.attribute_name(kind), self.blob(value)
            if b[:2] != b"\x01\0":
                continue
            if name == "TargetFrameworkAttribute" and len(b) > 3 and b[2] != 0xFF:
                n, at = compressed(b, 2)
                out["target_framework"] = b[at : at + n].decode("utf-8", "replace")
            elif name == "DebuggableAttribute":
                # (modes) has 4 bytes of argument, (tracking, optimiser off) has 2; then the number of named arguments
                out["debug"] = bool(struct.unpack_from("<I", b, 2)[0] & JIT_OPTIMISER_OFF) if len(b) >= 8 else bool(len(b) >= 4 and b[3])
        return out

    def references(self) -> list[dict]:
        return [{"name": self.string(r[6]), "version": ".".join(map(str, r[:4]))} for r in self.all_rows(0x23)]


def raw_strings(data: bytes) -> list[str]:
    """Runs of printable characters, in one byte or two each, where there is no user string heap."""
    out = [m[0].decode("ascii") for m in re.finditer(rb"[\x20-\x7e]{%d,}" % MIN_RAW, data)]
    out += [m[0].decode("utf-16-le") for m in re.finditer(rb"(?:[\x20-\x7e]\0){%d,}" % MIN_RAW, data)]
    return out[:MAX_RAW_STRINGS]


#: Shapes of strings worth a look, and framework noise.
_NOISE = re.compile(r"(?i)^(?:system|microsoft|mscorlib|get_|set_|_|http://schemas\.|http://www\.w3\.org|http://tempuri|http://microsoft|urn:)")
_TOKEN = re.compile(r"AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,64}|ghp_[A-Za-z0-9]{36,40}|gho_[A-Za-z0-9]{36,40}|AIza[0-9A-Za-z_\-]{35}|xox[baprs]-[A-Za-z0-9\-]{10,60}|sgp_[A-Za-z0-9_]{20,60}")
_CONNECTION = re.compile(r"(?i)(?:data\s*source|server|host)\s*=[^;]{1,120};\s*(?:initial\s*catalog|database)\s*=")
_CREDENTIAL = re.compile(r"(?i)(?:password|passwd|pwd|apassword)\s*[=:]\s*\S{3,}")
_HOST = re.compile(r"(?i)https?://([^/\s:@]+(?::\d+)?)")
MAX_STRING, MAX_HITS = 4096, 40


def string_rules(s: str) -> list[str]:
    """BIN-06: the rules that a string meets."""
    if not 6 <= len(s) <= MAX_STRING:
        return []
    out = ["binary-connection-string"] if _CONNECTION.search(s) else []
    if _CREDENTIAL.search(s) and not _NOISE.search(s):
        out.append("binary-credential-literal")
    if _TOKEN.search(s):
        out.append("binary-api-key-shape")
    if m := _HOST.search(s):
        host = m[1]
        inner = re.search(r"(?i)\.(?:local|internal|corp|lan|intra|priv)(?::\d+)?$|^(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)", host)
        if inner or (s.lower().startswith("https") and "." not in host and "localhost" not in host.lower()):
            out.append("binary-internal-endpoint")
    return out


def shown(s: str) -> str:
    """A string for evidence: cut, and values of credentials masked."""
    s = s[:300]
    s = _TOKEN.sub(lambda m: f"{m[0][:3]}[REDACTED len={len(m[0]) - 3}]", s)
    return re.sub(r"(?i)((?:password|passwd|pwd|user\s*id|uid|user)\s*[=:]\s*)([^;]{1,200})(;?)", lambda m: f"{m[1].rstrip()}[REDACTED len={len(m[2])}]{m[3]}", s)


def inspect(data: bytes | None) -> dict:
    """Everything that is read of one file; ``problem`` tells what could not be."""
    none = {"managed": None, "references": [], "pdb_paths": [], "strings": [], "problem": None}
    if data is None:
        return none | {"problem": "not read"}
    if len(data) > MAX_BYTES:
        return none | {"problem": "too large"}
    try:
        pe = Pe(data)
    except ValueError as e:
        return none | {"problem": str(e)}
    out = none | {"managed": False, "pdb_paths": pe.debug_paths(), "machine": pe.machine}
    cli, texts = pe.cli(), None
    if cli:
        out |= {"managed": True, "il_only": cli["il_only"], "mixed": cli["mixed"], "bitness": cli["bitness"], "signed": cli["signed"]}
        at, size = cli["metadata"]
        try:
            m = Metadata(data[at : at + size])
            out |= m.assembly() | {"references": m.references()}
            texts = m.user_strings()
        except (ValueError, IndexError, struct.error, KeyError) as e:
            out["problem"] = f"metadata: {e}"
    hits: dict[str, list[dict]] = {}
    for s in texts if texts is not None else raw_strings(data):
        for rule in string_rules(s):
            if len(hits.setdefault(rule, [])) < MAX_HITS:
                hits[rule].append({"rule": rule, "shown": shown(s)})
    out["strings"] = [h for hs in hits.values() for h in hs]
    return out


ASSEMBLY_DDL = (
    "project string, path string, managed boolean, machine int, il_only boolean, mixed boolean, bitness string, signed boolean, name string, version string, token string, module string, target_framework string, debug boolean, "
    "references array<struct<name:string, version:string>>, pdb_paths array<string>, strings array<struct<rule:string, shown:string>>, problem string"
)


def _assemblies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = lambda a, b: pa.list_(pa.struct([(a, pa.string()), (b, pa.string())]))
    kinds = {"managed": pa.bool_(), "machine": pa.int32(), "il_only": pa.bool_(), "mixed": pa.bool_(), "bitness": pa.string(), "signed": pa.bool_(), "name": pa.string(), "version": pa.string(), "token": pa.string(), "module": pa.string(), "target_framework": pa.string(), "debug": pa.bool_(), "references": pair("name", "version"), "pdb_paths": pa.list_(pa.string()), "strings": pair("rule", "shown"), "problem": pa.string()}
    schema = pa.schema([("project", pa.string()), ("path", pa.string()), *kinds.items()])
    for b in batches:
        for i in range(b.num_rows):
            project, path, content = (c[i].as_py() for c in b.columns)
            got = inspect(content)
            yield pa.RecordBatch.from_pylist([{"project": project or "", "path": path} | {k: got.get(k) for k in kinds}], schema=schema)


def assemblies(files: DataFrame) -> DataFrame:
    """One row for each of ``(project, path, content)``."""
    return files.select("project", "path", "content").mapInArrow(_assemblies, ASSEMBLY_DDL)


def _attribute(el: Column, name: str) -> Column:
    p = rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']"""
    return F.when(el.rlike(p), F.regexp_extract(el, p, 1))


def binding_redirects(files: DataFrame) -> DataFrame:
    """SCAN-32: ``(project, path, no, name, token, old_version, old_min, new_version, changes)`` of configuration files."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?i)<dependentAssembly\b[^>]*>[\s\S]*?</dependentAssembly>"), F.lit(0))
    b = files.where("text IS NOT NULL").select("project", "path", F.posexplode(blocks).alias("no", "b"))
    one = b.select("project", "path", "no", F.regexp_extract("b", r"(?i)<assemblyIdentity\b[^>]*>", 0).alias("id"), F.explode(F.regexp_extract_all("b", F.lit(r"(?i)<bindingRedirect\b[^>]*/?>"), F.lit(0))).alias("r"))
    old, new = _attribute(F.col("r"), "oldVersion"), _attribute(F.col("r"), "newVersion")
    out = one.select("project", "path", "no", _attribute(F.col("id"), "name").alias("name"), _attribute(F.col("id"), "publicKeyToken").alias("token"), old.alias("old_version"), F.trim(F.split_part(old, F.lit("-"), F.lit(1))).alias("old_min"), new.alias("new_version"))
    plain = lambda c: F.transform(F.split(c, r"\."), lambda p: F.coalesce(F.trim(p).try_cast("int"), F.lit(0)))
    return out.where("old_version <> '' AND new_version <> ''").withColumn("changes", plain(F.col("old_min")) != plain(F.col("new_version")))


def deps_targets(files: DataFrame) -> DataFrame:
    """SCAN-33: ``(project, path, target, name, version)`` of ``*.deps.json``: the runtime target, else the first; keys split at their last slash."""
    d = F.from_json("text", "struct<runtimeTarget:struct<name:string>, targets:map<string,map<string,struct<dependencies:map<string,string>>>>>")
    f = files.where(F.lower("path").endswith(".deps.json") & F.try_parse_json("text").isNotNull()).select("project", "path", d.alias("d"))
    target = F.coalesce(F.when(F.map_contains_key("d.targets", F.coalesce("d.runtimeTarget.name", F.lit(""))), F.col("d.runtimeTarget.name")), F.get(F.map_keys("d.targets"), F.lit(0)))
    f = f.withColumn("target", target).where("target IS NOT NULL")
    keys = f.select("project", "path", "target", F.explode(F.map_keys(F.element_at("d.targets", F.col("target")))).alias("k"))
    return keys.select("project", "path", "target", F.regexp_extract("k", "^(.*)/([^/]*)$", 1).alias("name"), F.regexp_extract("k", "^(.*)/([^/]*)$", 2).alias("version"))
