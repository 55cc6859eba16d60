"""Canonical forms of code snippets, file names and titles.

Two snippets have one canonical form if they differ only in white space, letter case, punctuation, and the order
of attributes in an XML element, of keys in a JSON object, or of ``;`` fields in a connection string. Order of
lines, and which attribute or key a value belongs to, are kept.

The scanners are forgiving: quotes may be any one kind, trailing commas and stray ``;`` or ``.`` at line ends are
noise, and text that fits no structure is taken as plain text. Pure Python over one text at a time; the callers
run it in Arrow batches.
"""

from __future__ import annotations

import re

_Q = "\"'`“”‘’„«»"
_NOT_ALNUM = re.compile(r"[\W_]+")
_ALNUM = re.compile(r"[^\W_]")
_KEY, _VAL = r"[\w .\-]+?\s*=", rf"[^;{_Q}\n<>]*"
_FIELDS = re.compile(rf"([{_Q}])\s*((?:{_KEY}{_VAL};\s*)+(?:{_KEY}{_VAL};?\s*)?)(?=[{_Q}])")
_TAG = re.compile(rf"<\s*([/!?]?)\s*([\w:.\-]+)((?:\s*[\w:.\-]+\s*=\s*([{_Q}])(?:(?!\4).)*\4)+)\s*([/?]?)\s*>", re.S)
_ATTR = re.compile(rf"([\w:.\-]+)\s*=\s*([{_Q}])((?:(?!\2).)*)\2", re.S)
_JSON_START = re.compile(rf"^\s*[{{\[][\s;,.]*(?:[{_Q}]|[{{\[])")
_JSON_TOKEN = re.compile(rf"\s*(?:([{{}}\[\]:])|([{_Q}])((?:\\.|(?!\2).)*)\2|([^\s{{}}\[\]:,;{_Q}]+)|([,;.]))", re.S)
_PUT = "\x02"

#: Words that mark a notice in place of code.
_NOTICE = re.compile(r"\b(?:withheld|hidden|removed|not shown|redacted|suppressed|omitted|masked)\b", re.I)
_CODE = re.compile(r"[;{}=<>]")
#: A notice is one line of at most so many words.
NOTICE_WORDS = 24


def plain(text: str) -> str:
    """Letters and digits alone, in one case."""
    return _NOT_ALNUM.sub("", text).casefold()


def withheld(text: str | None) -> bool:
    """True for null, blank, or a notice that the code is not shown."""
    if text is None:
        return True
    if not _ALNUM.search(text):
        return True
    s = text.strip()
    return "\n" not in s and bool(_NOTICE.search(s)) and not _CODE.search(s) and len(s.split()) <= NOTICE_WORDS


def _value(text: str) -> str:
    """A quoted value; the fields of a connection string in order of their names."""
    if ";" in text and "=" in text:
        parts = [plain(p) for p in text.split(";")]
        if sum("=" in p for p in text.split(";")) > 1:
            return ";".join(sorted(p for p in parts if p))
    return plain(text)


def _fields(m: re.Match) -> str:
    return _PUT + _value(m[2]) + _PUT


def _text(text: str) -> str:
    if ";" in text and "=" in text:
        text = _FIELDS.sub(_fields, text)
        if _PUT in text:
            parts = text.split(_PUT)
            return "".join(p if i % 2 else plain(p) for i, p in enumerate(parts))
    return plain(text)


def _xml(text: str) -> str:
    out, at = [], 0
    for m in _TAG.finditer(text):
        out.append(_text(text[at : m.start()]))
        attrs = sorted(f"{plain(a[1])}={_value(a[3])}" for a in _ATTR.finditer(m[3]))
        out.append(f"<{plain(m[2])} {' '.join(attrs)}>")
        at = m.end()
    out.append(_text(text[at:]))
    return "".join(out)


class _Bad(Exception):
    pass


def _json(text: str) -> str:
    """Canonical JSON; raises _Bad where the text has no such shape."""
    toks: list[tuple[str, str]] = []
    at, n = 0, len(text.rstrip())
    while at < n:
        m = _JSON_TOKEN.match(text, at)
        if not m:
            raise _Bad
        at = m.end()
        if m[1]:
            toks.append(("p", m[1]))
        elif m[2]:
            toks.append(("s", _value(m[3])))
        elif m[4] and plain(m[4]):
            toks.append(("w", plain(m[4])))
    pos, depth = 0, 0

    def value() -> str:
        nonlocal pos, depth
        if pos >= len(toks):
            raise _Bad
        kind, tok = toks[pos]
        pos += 1
        if kind != "p":
            return tok
        if tok not in "{[":
            raise _Bad
        depth += 1
        if depth > 200:
            raise _Bad
        items = []
        close = "}" if tok == "{" else "]"
        while pos < len(toks) and toks[pos] != ("p", close):
            if tok == "{":
                kind, key = toks[pos]
                if kind == "p":
                    raise _Bad
                pos += 1
                if pos >= len(toks) or toks[pos] != ("p", ":"):
                    raise _Bad
                pos += 1
                items.append(f"{key}:{value()}")
            else:
                items.append(value())
        pos += 1
        depth -= 1
        return "{" + ",".join(sorted(items)) + "}" if tok == "{" else "[" + ",".join(items) + "]"

    out = [value()]
    while pos < len(toks):
        out.append(value())
    return " ".join(out)


def canonical(snippet: str) -> str:
    """The canonical form of a snippet that is not withheld."""
    if _JSON_START.match(snippet):
        try:
            return _json(snippet)
        except _Bad:
            pass
    return _xml(snippet) if "<" in snippet and "=" in snippet else _text(snippet)


def record_key(snippet: str | None, file: str | None, title: str | None) -> str | None:
    """The canonical form of a whole record, or None where the snippet is null, blank or withheld. A null is not an empty text."""
    if withheld(snippet):
        return None
    return "\x1e".join((canonical(snippet), "\x00" if file is None else plain(file), "\x00" if title is None else plain(title)))
