"""Where credentials stand in code and configuration: values by their own shape and by what stands around them.

`values(text)` finds what stands in credential places, placeholders and all: keys of known issuers, key blocks, signed
tokens, and what follows a name such as ...Password, an option, a login in a URL, a header. `structured(value)` tells a
value that is built like a credential from one that is not: words, masks, hashes, references to a store, identifiers.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Found(NamedTuple):
    start: int
    end: int
    #: The value, its pieces joined.
    value: str
    #: True where the value's own shape is proof, wherever it stands.
    issued: bool


#: Shapes of credentials of known issuers.
_SHAPES = (
    r"A(?:KIA|SIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"gh[pousr]_[0-9A-Za-z]{20,255}",
    r"github_pat_[0-9A-Za-z_]{20,255}",
    r"glpat-[0-9A-Za-z_\-]{16,}",
    r"sk-(?:[a-z]+-)?[0-9A-Za-z_\-]{16,}",
    r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    r"xox[abeoprs]-[0-9A-Za-z\-]{10,}",
    r"npm_[0-9A-Za-z]{16,}",
    r"pypi-[0-9A-Za-z_\-]{30,}",
    r"AIza[0-9A-Za-z_\-]{30,}",
    r"SG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}",
    r"oy2[0-9a-z]{43}",
    r"dop_v1_[0-9a-f]{60,}",
    r"eyJ[0-9A-Za-z_\-]{8,}\.eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}",
)
_SHAPE = re.compile(r"(?<![0-9A-Za-z_\-])(?:" + "|".join(_SHAPES) + ")")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/]{24,}")

_Q = "\"'`“”‘’"
_WORDS = r"(?<!com)(?<!by)(?<!over)(?<!tres)pass(?:word|wd|phrase|code)?|pwd|secret|token|credential|(?:api|signing|shared|licen[cs]e|access|auth|private|account|encryption|storage|master|session|machine|decryption|validation|subscription|service|deploy|ssh)[_\-]?key|_key"
_OPEN = rf"[@$]{{0,2}}[{_Q}]"
#: A name that ends in one of these words tells that a credential follows, in one of these ways.
_NAME_END = re.compile(rf"(?:{_WORDS})(?![\w\-])")
_AFTER_NAME = re.compile(
    "(?:"
    # name = "value", "name": "value", config["name"] ?? "value", name => "value"
    rf"[{_Q}\]\)]*\s*(?:=>|:=|\?\?\s*=?|[:=])\s*{_OPEN}(?P<quoted>[^{_Q}\n<>]*)(?=[{_Q}])"
    # <setting name="name"><value>value</value>
    rf"|[{_Q}]\s*>\s*<\s*(?i:value)\s*>\s*(?P<setting>[^<>\n]+?)\s*<\s*/"
    # <name>value</name>
    rf"|\s*>\s*(?P<element>[^<>\s][^<>\n]*?)\s*<\s*/"
    # "key": "name", "value": "value"
    rf"|[{_Q}]\s*,?\s*[{_Q}](?i:value)[{_Q}]\s*:\s*[{_Q}](?P<pair>[^{_Q}\n]*)[{_Q}]"
    # "--name", "value"
    rf"|[{_Q}]\s*,\s*[{_Q}](?P<listed>[^{_Q}\n]*)[{_Q}]"
    # name=value, name: value
    rf"|\s*[=:]\s*(?P<bare>[^\s{_Q};,<>&|()\[\]{{}}][^\s{_Q};,<>&|()]*)(?!\()"
    # --name value
    rf"|\s+[{_Q}]?(?P<option>[^\s{_Q}\-=:][^\s{_Q}]*)"
    ")",
    re.S,
)
_OPTION = re.compile(rf"(?:^|[\s{_Q}])-{{1,2}}[\w\-]*$")
#: Without quotes, a name of the program's own: words in camel case with at most two digits, perhaps a member of it.
_VARIABLE = re.compile(r"^[a-z]+(?:[A-Z][a-z]*)+\d{0,2}(?:\.\w+)*$|^\w+(?:\.[A-Z]\w*)+$")
_NOT_NAME = re.compile(r"(?i)public_?key_?|cancellation|anti_?forgery|csrf|xsrf|request_?verification|token_?type|page_?|sync_?|_?primary_|foreign_|partition_|sort_|row_")
#: Each with what a text must contain, in lower case: one of the words that its rule cannot do without.
_RULES = tuple(
    (tuple(gate.split("|")), re.compile(p))
    for gate, p in (
        # login and password of a tool
        ("login", rf"\blogin\b[^\n]*?\s-p\s+[{_Q}]?(?P<v>[^\s{_Q}]+)"),
        ("-u", rf"(?<![\w\-])(?:-u|--user)\s+[{_Q}]?[\w.\-@]+:(?P<v>[^\s{_Q}:]+)"),
        # scheme://user:value@host
        ("://", rf"://[^\s/:@{_Q}<>]*:(?P<v>[^\s/@{_Q}<>]+)@"),
        # NetworkCredential("user", "value")
        ("credential", rf"(?i:Credentials?)\s*\(\s*{_OPEN}[^{_Q}\n]*[{_Q}]\s*,\s*{_OPEN}(?P<v>[^{_Q}\n]*)[{_Q}]"),
        # Authorization: Basic value
        ("authorization", rf"(?i:authorization)[{_Q}]?\s*[:,=]\s*[{_Q}]?\s*(?i:basic|bearer|token)\s+(?P<v>[^\s{_Q},;]+)"),
        ("bearer", r"(?<![\w\-])(?i:bearer)\s+(?P<v>[A-Za-z0-9._~+/\-]{16,}=*)"),
        # key material in base64
        ("frombase64string", rf"(?i:FromBase64String)\s*\(\s*{_OPEN}(?P<v>[A-Za-z0-9+/]{{16,}}={{0,2}})[{_Q}]\s*\)\s*;?\s*//[^\n]*\b(?i:key|secret|password)\b"),
        # echo value | tool --password-stdin
        ("echo", rf"(?i:echo)\s+[{_Q}]?(?P<v>[^\s{_Q}|]+)[{_Q}]?\s*\|[^\n]*(?i:password-stdin|passphrase-fd)"),
        ("securestring", rf"(?i:ConvertTo-SecureString)\s+(?:(?i:-String)\s+)?[{_Q}](?P<v>[^{_Q}\n]+)[{_Q}]"),
        ("basic", r"(?<![\w\-])(?i:basic)\s+(?P<v>[A-Za-z0-9+/]{16,}={0,2})"),
        # client.LogOn("user", "value")
        ("logon|login|log_on|log_in|signin|signon|sign_in|sign_on|bind|connect|authenticate|impersonate|opensession|open_session|setcredential|set_credential", rf"(?i:\b(?:log_?[oi]n|sign_?(?:in|on)|bind|connect|authenticate|impersonate|open_?session|set_?credentials?)\w*)\s*\(\s*{_OPEN}[\w.\-@\\\\]*[{_Q}]\s*,\s*{_OPEN}(?P<v>[^{_Q}\n]*)[{_Q}]"),
        # signed links
        ("sig=|signature=|access_token=|auth_token=|api_key=|apikey=|client_secret=", rf"[?&;](?i:sig|signature|access_token|auth_token|api_key|apikey|client_secret)=(?P<v>[^\s&{_Q}<>]+)"),
        # options of tools that take a password
        ("net", rf"(?i:\bnet\s+use)\s+\S+\s+\S+\s+(?P<v>[^\s/{_Q}]\S*)"),
        ("mysql", rf"(?i:\bmysql\w*)\b[^\n]*?\s-p(?P<v>[^\s{_Q}]+)"),
        ("sqlcmd|bcp|osql|isql|sshpass|plink|psftp|redis-cli|mongo|ldapsearch|rdesktop", rf"(?i:\b(?:sqlcmd|bcp|osql|isql|sshpass|plink|psftp|redis-cli|mongo\w*|ldapsearch|rdesktop))\b[^\n]*?\s-(?:pw\s+|[Ppaw]\s*)[{_Q}]?(?P<v>(?!\d+(?:\s|$))[^\s{_Q}\-][^\s{_Q}]*)"),
        # old login: user / value
        ("/", rf"(?:(?i:\b(?:login|logon|credentials?|account)\b)|(?://|#|--|/\*|<!--|')[^\n:/]*)\s*[:=]\s*[\w.\-@]+\s+/\s+(?P<v>[^\s/{_Q}]+)"),
    )
)
_TAG = re.compile(r"<[^<>]*>", re.S)
_ATTR = re.compile(rf"([\w:.\-]+)\s*=\s*([{_Q}])((?:(?!\2).)*)\2", re.S)
_NAMED = re.compile(rf"(?i:{_WORDS})$")
_BYTES = re.compile(r"(?i:\b\w*(?:key|secret|password|token))\s*=\s*(?:new\s+byte\s*\[\s*\d*\s*\]\s*)?\{\s*(?P<v>(?:0x[0-9A-Fa-f]{1,2}\s*,\s*){7,}0x[0-9A-Fa-f]{1,2})\s*,?\s*\}")
_MORE = re.compile(rf"[{_Q}]\s*(?:\+|&|\.)\s*[@$]{{0,2}}[{_Q}]([^{_Q}\n]*)")
_FRAMED = re.compile(r"^(?:<.*>|\[.*\]|\{.*\}|\$\{?\(?.*[)}]|\$\w+|%[\w.\-]+%|#\{.*\}#?|__\w+__|@@?\w+@@?|\(.*\))$", re.S)
_INNER = re.compile(r"\$\{|\$\(|\{\{|#\{|%\w+%|__[A-Z_]+__|\{\d+\}|<[\w \-]+>")
_MASK = re.compile(r"[*•●█]{2,}|\.{3,}|…|^[xX*#\-_.0]+$")
_TEXTUAL = re.compile(r"(?i)^(?:your|my|the|some|insert|enter|put|replace|change|sample|example|dummy|fake|todo|redacted|hidden|masked|removed|set|see|use|from|read|get)(?:[\s_\-:.(\[]|$)|(?:^|[\s_\-])(?:here|placeholder|goes|example|changeme)$")
_DIGEST = re.compile(r"(?i)^(?:(?:sha-?\d*|md5|hmac|bcrypt|argon2\w*|pbkdf2\w*)[:\-_=$]|\$2[aby]\$|\$argon2)")
_HEX = re.compile(r"(?i)^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$")
_GUID = re.compile(r"^\{?[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\}?$")
_SCHEME = re.compile(r"(?i)^(?:bearer|basic|token)\s+")
MIN_LENGTH = 6


def _words_alone(v: str) -> bool:
    """Letters that read as words: humps and parts of three and a half letters or more on average."""
    humps = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", v)
    return not humps or sum(map(len, humps)) / len(humps) >= 3.5


def structured(value: str | None, named: bool = False) -> bool:
    """Whether a value is built like a credential; false for null. `named`: a name says so, then plain hexadecimal is no digest."""
    if value is None:
        return False
    v = value.strip()
    if _PEM.search(v):
        return bool(_PEM_BODY.search(v))
    v = _SCHEME.sub("", v)
    if len(v) < MIN_LENGTH or re.search(r"\s", v) or len(set(v)) < 4:
        return False
    if _FRAMED.match(v) or _INNER.search(v) or _MASK.search(v) or _TEXTUAL.search(v) or _DIGEST.match(v) or _GUID.match(v):
        return False
    if _HEX.match(v) and not named:
        return False
    if not any(c.isalpha() for c in v):
        return False
    return any(c.isdigit() for c in v) or (len(v) >= 10 and (bool(_SHAPE.match(v)) or not _words_alone(v)))


def _pem(text: str) -> list[Found]:
    """Key blocks. One without its end goes to its last line of key material, so that what stands behind it is read."""
    out = []
    starts = list(_PEM.finditer(text))
    for k, m in enumerate(starts):
        limit = starts[k + 1].start() if k + 1 < len(starts) else len(text)
        end = _PEM_END.search(text, m.end(), limit)
        stop = end.end() if end else max((b.end() for b in _PEM_BODY.finditer(text, m.end(), limit)), default=m.end())
        if _PEM_BODY.search(text, m.end(), stop):
            out.append(Found(m.start(), stop, text[m.start() : stop], True))
    return out


def _lower(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def values(text: str | None) -> list[Found]:
    """Everything in a credential place, placeholders too, in order of first characters; empty for null."""
    if not text:
        return []
    low = _lower(text)
    found = _pem(text)
    found += [Found(m.start(), m.end(), m[0], True) for m in _SHAPE.finditer(text)]
    spans = [(m.start("v"), m.end("v"), m["v"]) for gate, rule in _RULES if any(g in low for g in gate) for m in rule.finditer(text)]
    for w in _NAME_END.finditer(low):
        m = _AFTER_NAME.match(text, w.end())
        before = text[max(0, w.start() - 48) : w.start()]
        if not m or _NOT_NAME.search(before):
            continue
        how = m.lastgroup
        if how in ("option", "listed") and not _OPTION.search(before):
            continue
        if how == "bare" and (m["bare"].startswith("//") or _VARIABLE.match(m["bare"])):
            continue
        spans.append((m.start(how), m.end(how), m[how]))
    for tag in _TAG.finditer(text) if "value" in low else ():
        attrs = {a[1].lower(): a for a in _ATTR.finditer(tag[0])}
        name, value = attrs.get("key") or attrs.get("name"), attrs.get("value")
        if name and value and _NAMED.search(name[3].strip()):
            spans.append((tag.start() + value.start(3), tag.start() + value.end(3), value[3]))
    for m in _BYTES.finditer(text) if "0x" in low else ():
        found.append(Found(m.start("v"), m.end("v"), m["v"], True))
    for start, end, value in spans:
        whole = value
        at = end
        while m := _MORE.match(text, at):
            whole += m[1]
            at = m.end()
        if s := _SCHEME.match(value):
            start += s.end()
        if whole.strip():
            found.append(Found(start, at, whole.strip(), False))
    return sorted(found, key=lambda f: (f.start, -f.end))


def candidates(text: str | None) -> list[Found]:
    """The structured ones among `values`, none that starts inside another."""
    out: list[Found] = []
    for f in values(text):
        if (f.issued and not _MASK.search(f.value)) or structured(f.value, named=True):
            if not out or f.start >= out[-1].end:
                out.append(f)
    return out
