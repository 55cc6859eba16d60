"""NuGet manifests as tables. Parsers read line by line, so that every row has its line and malformed files still give rows.

All parsers run in one Arrow pass over ``(project, path, text)`` and give one narrow table; a kind is a filter on it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FIELDS = "name value kind text snippet framework requested resolved host".split()
FLAGS = "unbounded public credential has_hash".split()
ITEM_DDL = "project string, path string, item string, no int, line int, value_line int, " + ", ".join(f"{f} string" for f in FIELDS) + ", " + ", ".join(f"{f} boolean" for f in FLAGS)
_SECTIONS = ("packageSources", "packageSourceCredentials", "disabledPackageSources", "packageSourceMapping", "signatureValidation", "trustedSigners", "config")
#: Constructs of build files that run something, in order; the first on a line counts.
EXECUTES = (
    (r"(?i)<\s*Exec\b", "runs a command"), (r"(?i)<\s*UsingTask\b", "loads a task assembly"), (r"(?i)<\s*DownloadFile\b", "fetches a file"),
    (r"(?i)<\s*WriteCodeFragment\b", "writes code that is compiled"), (r"(?i)\.(ps1|bat|cmd|vbs)\b", "names a script"),
)


def lines_of(text: str | None) -> list[str]:
    return re.split(r"\r?\n", text or "")


def attr(line: str, name: str) -> str | None:
    """SCAN-26: an attribute in either kind of quotes; None if it is absent."""
    m = re.search(rf'\b{name}\s*=\s*"([^"]*)"', line) or re.search(rf"\b{name}\s*=\s*'([^']*)'", line)
    return m[1] if m else None


def opens(line: str, name: str) -> bool:
    return bool(re.search(rf"(?i)<{name}(\s[^>]*)?/?>", line)) and not re.search(r"/\s*>\s*$", line)


def closes(line: str, name: str) -> bool:
    return bool(re.search(rf"(?i)</\s*{name}\s*>", line))


def self_closing(line: str, name: str) -> bool:
    return bool(re.search(rf"(?i)<{name}(\s[^>]*)?/\s*>", line))


def clean(line: str, most: int = 300) -> str:
    return " ".join(line.split())[:most]


def safe_url(url: str) -> str:
    """An address without the login in it."""
    return re.sub(r"(//)[^/@\s]+@", r"\1[REDACTED]@", re.sub(r"(//)[^/@\s]+:[^/@\s]+@", r"\1[REDACTED]@", url))


def host_of(url: str) -> str:
    m = re.match(r"(?i)https?://([^/@\s]+)", url)
    return re.sub(r":\d+$", "", m[1]).lower() if m else ""


def is_public(name: str, url: str) -> bool:
    return bool(re.search(r"(?i)(^|\.)nuget\.org", url) or re.search(r"(?i)nuget\.org", name))


def version_spec(v: str | None) -> dict:
    """What a version says: missing, exact, floating or a range, perhaps without upper bound."""
    s = (v or "").strip()
    if not s:
        return {"kind": "missing", "text": v}
    if "*" in s:
        return {"kind": "floating", "text": s}
    if s[0] in "[(":
        if re.fullmatch(r"\[\s*([^\s,)]+)\s*\]", s):
            return {"kind": "exact", "text": s}
        return {"kind": "range", "text": s, "unbounded": bool(re.search(r",\s*[)\]]?\s*$|,\s*\*\s*[)\]]|,\s*\)", s))}
    return {"kind": "exact", "text": s}


def packages_config(lines: list[str]) -> Iterator[dict]:
    """SCAN-20 and SCAN-06."""
    for n, line in enumerate(lines, 1):
        if re.search(r"(?i)<package\b", line) and (name := attr(line, "id")) is not None:
            yield {"item": "config_package", "name": name, "line": n, "snippet": clean(line), "framework": attr(line, "targetFramework"), **version_spec(attr(line, "version"))}


def project_file(lines: list[str]) -> Iterator[dict]:
    """SCAN-21: references with the version in the element or within 14 lines before it closes; lock-file switches; imports from package folders."""
    for i, line in enumerate(lines):
        if re.search(r"(?i)<PackageReference\b", line):
            include, update = attr(line, "Include"), attr(line, "Update")
            name = include if include is not None else update
            if name is not None:
                version, at, shown = attr(line, "Version"), i + 1, clean(line)
                if version is None and not self_closing(line, "PackageReference"):
                    for j in range(i + 1, min(i + 15, len(lines))):
                        if closes(lines[j], "PackageReference"):
                            break
                        if m := re.search(r"(?i)<Version\s*>([^<]+)</Version\s*>", lines[j]):
                            version, at, shown = m[1], j + 1, clean(lines[j])
                            break
                yield {"item": "reference", "name": name, "value": "Include" if include is not None else "Update", "line": i + 1, "value_line": at, "snippet": shown, **version_spec(version)}
        for key, item in (("RestorePackagesWithLockFile", "lock_enabled"), ("RestoreLockedMode", "locked_mode")):
            if re.search(rf'(?i)<{key}\s*>\s*true\s*</{key}>|{key}\s*=\s*"true"', line):
                yield {"item": item, "line": i + 1}
        if re.search(r"(?i)<Import\b", line):
            target = attr(line, "Project")
            if target and re.search(r"(?i)([\\/]|^)packages([\\/])|NuGetPackageRoot|\.nuget[\\/]packages", target):
                yield {"item": "import", "name": target, "line": i + 1, "snippet": clean(line)}


def central_props(lines: list[str]) -> Iterator[dict]:
    """SCAN-22."""
    for n, line in enumerate(lines, 1):
        if m := re.search(r"(?i)<ManagePackageVersionsCentrally\b[^>]*>([^<]*)<", line):
            yield {"item": "central_managed", "value": str(m[1].strip().lower() == "true").lower(), "line": n}
        if re.search(r"(?i)<PackageVersion\b", line) and (name := attr(line, "Include") or attr(line, "Update")) is not None:
            yield {"item": "central_version", "name": name, "line": n, "snippet": clean(line), **version_spec(attr(line, "Version"))}


def nuspec(lines: list[str]) -> Iterator[dict]:
    """SCAN-23: scripts that a package declares."""
    for n, line in enumerate(lines, 1):
        if re.search(r"(?i)<file\b", line):
            src = attr(line, "src") or ""
            if re.search(r"(?i)\.ps1$|tools[\\/](install|init)\.ps1", src):
                yield {"item": "nuspec_script", "name": src, "line": n, "snippet": clean(line)}


def nuget_config(lines: list[str]) -> Iterator[dict]:
    """SCAN-24: feeds, removals, credentials (never their value), mapping and signature settings, by the sections that are open."""
    stack: list[str] = []
    feeds: list[dict] = []
    out: list[dict] = []
    owner: str | None = None
    mapped: dict | None = None
    for n, raw in enumerate(lines, 1):
        line = raw.strip()
        if not line:
            continue
        for s in _SECTIONS:
            if opens(raw, s):
                stack.append(s)
            if closes(raw, s) and s in stack:
                del stack[len(stack) - 1 - stack[::-1].index(s)]
        adds = bool(re.search(r"(?i)<add\b", line))
        if "config" in stack and adds and (attr(line, "key") or "").lower() == "signaturevalidationmode":
            out.append({"item": "signature_mode", "value": (attr(line, "value") or "").lower(), "line": n})
        if "packageSources" in stack:
            if re.search(r"(?i)<clear\s*/>", line):
                out.append({"item": "clear", "line": n})
            if m := re.search(r'(?i)<remove\b[^>]*\bkey\s*=\s*"([^"]*)"', line):
                out.append({"item": "removed", "name": m[1], "line": n})
            name, url = attr(line, "key"), attr(line, "value")
            if adds and name is not None and url is not None:
                login = bool(re.search(r"//[^/@\s]+:[^/@\s]+@", url))
                feed = {"item": "feed", "name": name, "value": safe_url(url), "line": n, "snippet": clean(safe_url(line)), "host": host_of(safe_url(url).replace("[REDACTED]@", "")), "public": is_public(name, url), "credential": login}
                feeds.append(feed)
                out.append(feed)
                if login:
                    out.append({"item": "credential", "name": name, "kind": "credentials-in-URL", "line": n, "snippet": clean(safe_url(line))})
        if "packageSourceCredentials" in stack:
            if m := re.fullmatch(r"<([A-Za-z0-9._-]+)\s*>", line):
                owner = m[1]
                continue
            if re.fullmatch(r"</[A-Za-z0-9._-]+\s*>", line):
                owner = None
                continue
            key = attr(line, "key") or ""
            if owner and adds and re.search(r"(?i)password", key):
                kind = "ClearTextPassword" if "cleartextpassword" in key.lower() else "Password"
                out.append({"item": "credential", "name": owner, "kind": kind, "line": n, "snippet": clean(re.sub(r"""(value\s*=\s*)("[^"]*"|'[^']*')""", r'\1"[REDACTED]"', line))})
                for f in feeds:
                    f["credential"] = f["credential"] or f["name"] == owner
        if "disabledPackageSources" in stack and adds and attr(line, "key") is not None and (attr(line, "value") or "").lower() != "false":
            out.append({"item": "disabled", "name": attr(line, "key"), "line": n})
        if "packageSourceMapping" in stack:
            if m := re.search(r'(?i)<packageSource\b[^>]*\bkey\s*=\s*"([^"]*)"\s*>', line):
                mapped = {"key": m[1], "patterns": []}
            if mapped and (m := re.search(r'(?i)<package\b[^>]*\bpattern\s*=\s*"([^"]*)"', line)):
                mapped["patterns"].append((m[1], n))
            if mapped and closes(raw, "packageSource"):
                out += [{"item": "mapping", "name": mapped["key"], "value": p, "line": at} for p, at in mapped["patterns"]] or [{"item": "mapping", "name": mapped["key"], "line": n}]
                mapped = None
        if re.search(r"(?i)<signatureValidation\b", line) or "signatureValidation" in stack:
            if mode := attr(line, "mode"):
                out.append({"item": "signature_mode", "value": mode.lower(), "line": n})
        if re.search(r"(?i)<certificate\b", line) and (attr(line, "allowUntrustedRoot") or "").lower() == "true":
            out.append({"item": "untrusted_root", "line": n, "snippet": clean(line)})
    yield from out


def lockfile(lines: list[str], text: str) -> Iterator[dict]:
    """SCAN-25: entries with their lines from the indentation of objects; from the JSON tree where that finds none."""
    try:
        doc = json.loads(text)
    except ValueError:
        doc = None
        yield {"item": "lock_invalid", "line": 1}
    stack: list[dict] = []
    entries: list[dict] = []
    for n, line in enumerate(lines, 1):
        if m := re.match(r'^(\s*)"((?:[^"\\]|\\.)*)"\s*:\s*\{', line):
            while stack and stack[-1]["indent"] >= len(m[1]):
                stack.pop()
            up = stack[-1] if stack else None
            stack.append({"indent": len(m[1]), "name": m[2], "line": n, "framework": m[2] if up and up["name"] == "dependencies" else up and up["framework"], "entry": None})
            continue
        m = re.match(r'^\s*"((?:[^"\\]|\\.)+)"\s*:\s*("?[^",{}]*"?)\s*,?\s*$', line)
        # a range holds commas, so its value is taken between the quotes
        q = re.match(r'^\s*"(type|requested|resolved|contentHash)"\s*:\s*"([^"]*)"\s*,?\s*$', line)
        if not (m or q) or not stack or (q or m)[1] not in ("type", "requested", "resolved", "contentHash"):
            continue
        frame = stack[-1]
        if frame["entry"] is None:
            frame["entry"] = {"item": "lock_entry", "name": frame["name"], "framework": frame["framework"], "line": frame["line"], "has_hash": False}
            entries.append(frame["entry"])
        key, value = (q or m)[1], (q or m)[2].strip('"').strip()
        if key == "contentHash":
            frame["entry"]["has_hash"] = bool(value)
        else:
            frame["entry"]["kind" if key == "type" else key] = value
    if not entries and isinstance(doc, dict) and isinstance(doc.get("dependencies"), dict):
        for framework, packages in doc["dependencies"].items():
            for name, meta in packages.items() if isinstance(packages, dict) else ():
                if isinstance(meta, dict):
                    at = next((n for n, x in enumerate(lines, 1) if f'"{name}"' in x), 1)
                    text_of = lambda k: meta[k] if isinstance(meta.get(k), str) else None
                    entries.append({"item": "lock_entry", "name": name, "framework": framework, "kind": text_of("type"), "requested": text_of("requested"), "resolved": text_of("resolved"), "has_hash": bool(text_of("contentHash")), "line": at})
    yield from entries


def build_file(lines: list[str]) -> Iterator[dict]:
    """SCAN-27."""
    yield {"item": "build_file", "line": 1}
    for n, line in enumerate(lines, 1):
        for p, why in EXECUTES:
            if re.search(p, line):
                yield {"item": "executes", "kind": why, "line": n, "snippet": clean(line, 200)}
                break


def parse_file(path: str, text: str | None) -> Iterator[dict]:
    """SCAN-03: what a path's place and name make of a file; inside ``packages`` only scripts, build files and nuspecs count."""
    parts = path.split("/")
    name, lines = parts[-1].lower(), lines_of(text)
    inside = any(p.lower() == "packages" for p in parts[:-1])
    if inside:
        if name in ("install.ps1", "init.ps1"):
            yield {"item": "install_script", "line": 1, "snippet": "\n".join([x.strip()[:160] for x in lines if x.strip()][:3])}
        elif re.search(r"\.(props|targets)$", name) and name != "directory.packages.props" and not re.fullmatch(r"directory\.build\.(props|targets)", name):
            yield from build_file(lines)
        elif name.endswith(".nuspec"):
            yield from nuspec(lines)
    elif name == "nuget.config":
        yield from nuget_config(lines)
    elif re.search(r"\.(csproj|vbproj|fsproj)$", name):
        yield {"item": "project", "line": 1}
        yield from project_file(lines)
    elif name == "packages.config":
        yield from packages_config(lines)
    elif name == "directory.packages.props":
        yield from central_props(lines)
    elif name == "packages.lock.json":
        yield {"item": "lockfile", "line": 1}
        yield from lockfile(lines, text or "")
    elif name.endswith(".nuspec"):
        yield from nuspec(lines)
    elif re.fullmatch(r"directory\.build\.(props|targets)", name) and len(parts) <= 2:
        if name.endswith("props") and re.search(r"(?i)RestorePackagesWithLockFile", text or ""):
            yield {"item": "root_lock_switch", "line": 1}


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("project", pa.string()), ("path", pa.string()), ("item", pa.string()), ("no", pa.int32()), ("line", pa.int32()), ("value_line", pa.int32()), *((f, pa.string()) for f in FIELDS), *((f, pa.bool_()) for f in FLAGS)])
    for b in batches:
        rows = []
        for project, path, text in zip(*(c.to_pylist() for c in b.columns)):
            if path:
                path = path.replace("\\", "/")
                rows += [{"project": project or "", "path": path, "no": i, **r} for i, r in enumerate(parse_file(path, text))]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def nuget_items(files: DataFrame) -> DataFrame:
    """One row for each feed, reference, version, lock entry and so on, of files ``(project, path, text)``."""
    return files.select("project", "path", "text").mapInArrow(_items, ITEM_DDL)


def nuget_inventory(items: DataFrame) -> dict[str, DataFrame]:
    kinds = "feed removed disabled clear credential mapping signature_mode untrusted_root config_package reference central_version central_managed lock_enabled locked_mode import project lockfile lock_entry lock_invalid nuspec_script install_script build_file executes root_lock_switch".split()
    return {k: items.where(items["item"] == k) for k in kinds}
