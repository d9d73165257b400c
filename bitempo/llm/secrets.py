"""Credentials in source text: found through encoded layers, cut out in place.

``scan`` reads one text.  Literals that decode (base64, hex, percent, escapes)
are scanned again inside, and binary key containers are told apart by their
grammar; a find inside is reported and redacted as the literal around it, in
the same encoding, so that the code still parses and decodes.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.session import spread

MARK = "REDACTED"
#: Literals are decoded until nothing decodes: each layer is shorter than the one around it.
DEPTH = 1 << 30
#: Layers that are searched within one another; deeper ones are searched first and by themselves (``find``).
NEST = 64


class Find(NamedTuple):
    start: int
    end: int
    kind: str
    encoding: str  # '' for plain text, else the layers from outside in


# Words of names that hold credentials, in the order of the alphabet.
NAME_WORDS = {
    "apikey", "auth", "authorization", "clave", "contrasena", "cred", "credential", "credentials", "creds", "kennwort", "motdepasse",
    "pass", "passcode", "passphrase", "passwd", "password", "passwort", "pat", "pem", "pw", "pwd", "secret", "token",
}
NAME_ENDS = ("apikey", "credential", "passphrase", "passwd", "password", "secret", "token")
#: Words before "key" that make it a credential.
KEY_WORDS = {"access", "api", "auth", "client", "deploy", "encryption", "hmac", "master", "private", "secret", "service", "shared", "signing", "storage"}
#: Words that make a name one of something about a credential.
OTHER_WORDS = {
    "age", "algorithm", "column", "count", "days", "digest", "enabled", "expiry", "field", "file", "format", "hash", "header", "hint", "id", "label", "len", "length", "limit", "max", "min", "name",
    "path", "policy", "prompt", "public", "required", "reset", "rotation", "rule", "size", "ttl", "type", "uri", "url", "version",
}
#: Names of digests and identifiers.
DIGEST_WORDS = {"build", "checksum", "commit", "digest", "etag", "fingerprint", "integrity", "md5", "request", "revision", "sha", "sha1", "sha256", "sha512", "trace", "uuid"}
PLACEHOLDERS = {
    "bearer", "basic", "changeit", "changeme", "dummy", "empty", "fake", "false", "none", "not-set", "null", "pass", "passwd", "password", "placeholder", "pwd", "redacted", "sample", "secret",
    "tbd", "test", "todo", "token", "true", "undefined", "unset", "user", "xxx",
}
# Published prefixes of tokens that tell their issuer.
ISSUERS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "npm_", "pypi-", "sk_live_", "xoxb-", "xoxp-")
#: What a name of a credential, or a word that announces one, has in it.
STEMS = ("key", "pass", "pw", "secret", "token", "cred", "auth", "pat", "pem", "access", "dsn", "clave", "contrasena", "kennwort", "identified")
#: Words before a value in a sentence.
BEFORE = ("token", "key", "secret", "one", "use", "wip", "credential", "pat", "password", "passwort", "passphrase", "kennwort", "identified")

_NAME = r"[A-Za-z_][\w.\-]{0,80}"
_QUOTED = r"\"(?:\\.|[^\"\\\n])++\"|'(?:\\.|[^'\\\n])++'|`(?:\\.|[^`\\])++`"
ASSIGN = re.compile(rf"(?<![\w.\-])(?P<name>{_NAME})(?:\\?[\"'`])?\]?[ \t]{{0,4}}(?:=>|:=|=(?!=)|:(?!//)|,(?=[ \t]*[\"'`]))[ \t]{{0,4}}\(?(?P<value>{_QUOTED}|[^\s\"'`,;()\[\]{{}}<>#]{{4,}}+)")
OPTION = re.compile(rf"(?<![\w\-])--?(?P<name>{_NAME})[ =](?P<value>{_QUOTED}|[^\s\"'`]{{4,}}+)")
SAID = re.compile(r"(?i)(?:password|passwort|passphrase|kennwort|identified[ \t]+by)[ \t]+(?:is[ \t]+|was[ \t]+|=[ \t]*)?(?P<value>'[^'\n]{4,}+'|\"[^\"\n]{4,}+\"|[^\s'\",;]{4,}+)")
TOLD = re.compile(r"(?i)(?:token|key|secret|one|use|wip|credential|pat)[ \t]+(?:was[ \t]+|is[ \t]+)?(?P<value>[^\s'\",;()]{6,}+)")
#: The scheme stands before; a link ends where the next one begins.
LINK = re.compile(r"://(?P<user>[^\s:/@\"'`<>]*+):(?P<value>(?:(?!://)[^\s@\"'`<>])++)@[\w.\-\[\]${}]")
HEADER = re.compile(r"(?i)(?P<scheme>basic|bearer)[ \t]+(?P<value>[A-Za-z0-9+/_.:~\-]{8,}+={0,2})")
LOGIN = re.compile(r"(?<![\w\-])(?:-u|--user)[ =][\"']?[^\s:/@\"']++:(?P<value>[^\s\"'@/]{4,}+)")
JOINED = re.compile(rf"(?<![\w.\-])(?P<name>{_NAME})[ \t]*[=:][ \t]*\(?[ \t]*(?P<parts>(?:\"[^\"\\\n]++\"|'[^'\\\n]++')(?:[ \t]*+[+.]?+[ \t]*+\\?+\r?+\n?+[ \t]*+[+.]?+[ \t]*+(?:\"[^\"\\\n]++\"|'[^'\\\n]++'))++)")
#: Where one quoted piece meets the next: a text without has no joined literal.
_MEET = re.compile(r"[\"'](?=[ \t\\\r\n+.])[ \t]*+[+.]?+[ \t]*+\\?+\r?+\n?+[ \t]*+[+.]?+[ \t]*+[\"']")
CONTINUED = re.compile(rf"(?<![\w.\-])(?P<name>{_NAME})=(?P<value>[^\s\"'`\\]{{8,}}+(?:\\\r?\n[^\s\"'`\\]{{2,}}+)++)")
PAIR = re.compile(rf"(?m)^[ \t]*-?[ \t]*\"?name\"?:[ \t]*[\"']?(?P<name>{_NAME})[\"']?,?[ \t]*\r?\n[ \t]*\"?value\"?:[ \t]*(?P<value>{_QUOTED}|[^\s\"'`]{{4,}}+)")
KUBE = re.compile(r"(?m)^[ \t]*(?:-[ \t]+)?kind:[ \t]*Secret[ \t]*\r?$")
#: What parts the documents of a manifest.
PARTED = re.compile(r"(?m)^---[^\n]*$")
KUBE_DATA = re.compile(r"(?m)^(?P<pad>[ \t]*)(?P<part>data|stringData):[ \t]*\r?\n(?P<rows>(?:(?P=pad)[ \t]+[^\n]*(?:\n|$))+)")
KUBE_ROW = re.compile(r"(?m)^[ \t]+(?P<name>[\w.\-]+):[ \t]*(?P<value>\"[^\"\n]+\"|'[^'\n]+'|[^\s\"'|>][^\s]*)")
#: A run that may be a token or an encoded text, and one that may be percent-encoded.
RUN = re.compile(r"[A-Za-z0-9+/_\-.:~]{16,}+={0,2}")
PERCENT = re.compile(r"[\w.\-]*+(?:%[0-9A-Fa-f]{2}[\w.\-]*+){3,}+")
LITERAL = re.compile(r"(?<!\\)(?P<quote>[\"'`])(?P<inner>(?:\\.|(?!(?P=quote))[^\\\n]){12,}+)(?P=quote)")
#: The name that a value stands under, at the end of what is before it.
UNDER = re.compile(rf"(?<![\w.\-])(?P<name>{_NAME})(?:\\?[\"'`])?\]?[ \t]{{0,4}}(?:=>|:=|=|:|,)?[ \t]{{0,4}}\(?\\?[\"'`]?$")
JWT = re.compile(r"eyJ[\w\-]{10,}+\.[\w\-]{10,}+\.[\w\-]{10,}+")
ISSUED = re.compile("(?:" + "|".join(re.escape(p) for p in ISSUERS) + r")[A-Za-z0-9_+/\-]{12,}+")
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{3}=?|[A-Za-z0-9+/]{2}(?:==)?)|(?:[A-Za-z0-9_\-]{4})*(?:[A-Za-z0-9_\-]{2,4})={0,2}")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2})+")
_REFERENCE = re.compile(r"^(?:\$\{|\$\(|\$[A-Za-z_]|\$\{\{|\{\{|%\(|%[A-Z_]+%$|env[:.(]|vault[:(]|secretref|ref[:+]|op://|ssm:|arn:|file:|@|<[^>]*>$|&[a-z]|process\.env|os\.(?:environ|getenv)|getenv|System\.getenv|self\.|this\.|config[.(\[]|settings[.(\[]|args\.|!Ref|None$)")
_DIGEST = re.compile(r"^(?:(?:sha\d{1,3}|md5)[-:]|\$2[aby]?\$|\$argon2|\$[156]\$|\{SSHA\}|pbkdf2|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$)")
_WORDS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


def name_words(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(name)]


def names(name: str) -> str:
    """What a name is of: ``credential``, ``key`` (weak), ``digest``, ``other`` or nothing."""
    words = name_words(name)
    if not words:
        return ""
    if DIGEST_WORDS & set(words):
        return "digest"
    flat = "".join(words)
    good = bool(NAME_WORDS & set(words)) or flat.endswith(NAME_ENDS) or flat.endswith("motdepasse") or any(a in KEY_WORDS and b == "key" for a, b in zip(words, words[1:], strict=False))
    if OTHER_WORDS & set(words):
        return "other" if good or words[-1] in ("id", "hash", "count") else ""
    if good:
        return "credential"
    return "key" if words[-1] in ("key", "access", "credential", "dsn") or flat.endswith("key") else ""


def placeholder(value: str) -> bool:
    """Whether a value stands for nothing, or for a value kept elsewhere."""
    v = value.strip()
    low = v.lower()
    if len(v) < 4 or low in PLACEHOLDERS or _REFERENCE.match(v):
        return True
    if len(set(low)) <= 2 or re.fullmatch(r"[\W_]+|[x*.\-_?#•]+|(?:x{4,}|\*\*+|\.\.+).*", low):
        return True
    return bool(re.search(r"your[-_ ]|replace[-_ ]?me|change[-_ ]?me|placeholder|example|insert[-_ ]|redacted|<[a-z_\- ]+>|\$\{|\{\{|%\(|xxxx|\*\*\*\*", low))


def issued(v: str) -> bool:
    """Whether a value has a published form of tokens."""
    return bool(ISSUED.fullmatch(v) or JWT.fullmatch(v))


def token(v: str) -> bool:
    """Whether a run that stands alone is a token, by its structure.

    It mixes letters of both cases and digits at random, after a prefix of its
    issuer perhaps.  Only hex digits may be of a digest, so they are none here;
    plus signs and slashes are of encoded data.
    """
    if issued(v):
        return True
    if not re.fullmatch(r"[A-Za-z0-9_\-.:~]+", v):
        return False
    body = max(re.split(r"[_\-.:~]", v), key=len)
    return len(body) >= 16 and not _HEX.fullmatch(body) and random_like(body)


def random_like(v: str, least: int = 16) -> bool:
    """A run without words: issuer tokens, three-part tokens, mixed letters and digits."""
    if issued(v):
        return True
    if len(v) < least or not re.fullmatch(r"[A-Za-z0-9+/_.=~:\-]+", v):
        return False
    kinds = sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    if _HEX.fullmatch(v):
        return len(v) >= 32 and kinds >= 2 and len(set(v.lower())) >= 8
    core = re.sub(r"[^A-Za-z0-9]", "", v)
    switches = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(core, core[1:], strict=False))
    return kinds == 3 and len(set(v)) >= 10 and switches >= len(core) / 4


def password_like(v: str) -> bool:
    """A value that someone may have typed as a password: no plain word or number."""
    if len(v) < 6 or v.isdigit() or re.search(r"\s", v) or placeholder(v):
        return False
    return bool(re.search(r"\d", v) and re.search(r"[A-Za-z]", v)) or (bool(re.search(r"[a-z]", v)) and len(re.findall(r"[A-Z]", v)) >= 2) or bool(re.search(r"[!#%&*+?@^~]", v))


# --- key containers -------------------------------------------------------


def _tlv(b: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of one DER element, None if it does not fit."""
    if at + 2 > len(b):
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4 or at + k > len(b):
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= len(b) else None


def _items(b: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while at < end and len(out) < 12:
        e = _tlv(b[:end], at)
        if not e:
            return []
        out.append(e)
        at = e[2]
    return out


def container(b: bytes) -> str:
    """The kind of private key held by binary data, or nothing.

    Public keys and certificates have no private part and give nothing.
    """
    if b.startswith(b"openssh-key-v1\0"):
        return "openssh private key"
    if b[:4] in (b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce"):
        return "java key store"
    top = _tlv(b, 0)
    if not top or top[0] != 0x30 or top[2] < len(b) - 2:
        return ""
    items = _items(b, top[1], top[2])
    tags = [t for t, _, _ in items]
    if not items:
        return ""
    number = int.from_bytes(b[items[0][1] : items[0][2]], "big") if tags[0] == 0x02 else -1
    if tags[:9] == [0x02] * 9 and number in (0, 1):
        return "rsa private key"
    if tags[:6] == [0x02] * 6 and number == 0:
        return "dsa private key"
    if tags[:2] == [0x02, 0x04] and number == 1:
        return "ec private key"
    if tags[:3] == [0x02, 0x30, 0x04] and number in (0, 1):
        return "private key"
    if tags[:2] == [0x02, 0x30] and number == 3:
        return "key store"
    if tags == [0x30, 0x04] and (inner := _items(b, items[0][1], items[0][2])) and inner[0][0] == 0x06:
        return "encrypted private key"
    return ""


def public(v: str) -> bool:
    """Whether a literal is a whole DER structure that holds no private key."""
    for _, b in layers(v):
        top = _tlv(b, 0)
        if top and top[0] == 0x30 and top[2] == len(b) > 30 and _items(b, top[1], top[2]) and not container(b):
            return True
    return False


# --- encoded layers ---------------------------------------------------------


def _printable(b: bytes) -> str | None:
    try:
        s = b.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if s and sum(c.isprintable() or c in "\r\n\t" for c in s) == len(s) else None


def _unescape(s: str) -> str:
    simple = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "'": "'", "`": "`", "\\": "\\", "/": "/"}
    return re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else simple.get(m[3], m[0]), s)


def _unbase64(s: str) -> bytes | None:
    """What base64 of either alphabet, with or without its padding, decodes to."""
    bare = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4))
    except binascii.Error:
        return None


def layers(s: str) -> Iterator[tuple[str, bytes]]:
    """What a literal decodes to, by each encoding that it fits."""
    if "\\" in s and (t := _unescape(s)) != s:
        yield "escape", t.encode("utf-8", "surrogatepass")
    if s.count("%") >= 3 and re.search(r"(?:%[0-9A-Fa-f]{2}.?){3}", s):
        yield "percent", unquote_to_bytes(s)
    bare = re.sub(r"\s+|\\[nr]", "", s)
    if len(bare) >= 16 and len(bare) % 2 == 0 and _HEX.fullmatch(bare):
        yield "hex", bytes.fromhex(bare)
    elif len(bare) >= 12 and _BASE64.fullmatch(bare):
        if (b := _unbase64(bare)) is not None:
            yield "base64", b


def encoded(text: str, encoding: str) -> str:
    """``text`` in the layers of ``encoding``, innermost last."""
    before = ""
    for layer in reversed([e for e in encoding.split(">") if e]):
        if layer == "base64":
            text = base64.b64encode(text.encode()).decode()
        elif layer == "hex":
            text = text.encode().hex()
        elif layer == "percent" == before:  # signs only, else each layer has three times the length
            text = text.replace("%", "%25")
        elif layer == "percent":
            text = "".join(f"%{b:02X}" for b in text.encode())
        before = layer
    return text


def _inside(s: str, depth: int, bare_password: bool) -> tuple[str, str]:
    """(kind, layers) of a credential inside an encoded literal, or ('', '')."""
    if depth <= 0 or _DIGEST.match(s):
        return "", ""
    for layer, b in layers(s):
        if kind := container(b):
            return kind, layer
        t = _printable(b)
        if t is None or t == s:
            continue
        if layer != "escape" and bare_password and (random_like(t) or password_like(t)):
            return "encoded credential", layer
        if f := _first(t, depth - 1):
            return f.kind, layer + (">" + f.encoding if f.encoding else "")
    return "", ""


# --- one text ----------------------------------------------------------------


def _bare(m: re.Match, group: str = "value") -> tuple[int, int, str]:
    a, b = m.span(group)
    v = m[group]
    if v[:1] in "\"'`" and v[-1:] == v[:1] and len(v) > 1:
        return a + 1, b - 1, v[1:-1]
    return a, b, v


def _judge(name: str, v: str, depth: int, joined: bool = False) -> tuple[str, str]:
    """(kind, encoding) of a value under a name, ('', '') if it is no credential.

    A value that is ``joined`` from pieces needs a weaker name.
    """
    kind = names(name)
    if joined and kind == "key":
        kind = "credential"
    v = v.strip()
    if not v or placeholder(v) or _DIGEST.match(v) or kind == "digest" or (len(v) > 40 and public(v)):
        return "", ""
    if "-----BEGIN" in v or "://" in v or (m := re.match(r"(?i)(basic|bearer)\s+\S", v)) is not None and m:
        return "", ""  # these have their own patterns
    if issued(v):
        return "token", ""
    if kind == "credential":
        if random_like(v, 12) or password_like(v):
            return "assigned credential", ""
    elif kind == "key" and random_like(v, 20):
        return "assigned credential", ""
    elif kind == "other":
        return "", ""
    elif joined and token(v):
        return "token", ""
    return ("", "") if _HEX.fullmatch(v) and len(v) in (32, 40, 64) else _inside(v, depth, kind == "credential")


def _documents(text: str) -> Iterator[tuple[int, str]]:
    """(start, text) of each document of a manifest that is of a secret."""
    if "Secret" not in text or not KUBE.search(text):
        return
    marks = [0, *[m.end() for m in PARTED.finditer(text)]]
    for a, b in zip(marks, [*[m.start() for m in PARTED.finditer(text)], len(text)], strict=True):
        if KUBE.search(part := text[a:b]):
            yield a, part


class _Deeper(Exception):
    """Asks ``find`` for the first find of a text and depth."""


#: First finds of texts ``NEST`` layers down, while a text is searched.
_told: dict[tuple[str, int], Find | None] = {}


@lru_cache(maxsize=256)
def _first(text: str, depth: int) -> Find | None:
    """The first find of a decoded text, which an assignment and a literal may both ask for."""
    if depth % NEST == 0:
        if (text, depth) not in _told:
            raise _Deeper(text, depth)
        return _told[text, depth]
    return next(iter(_find(text, depth)), None)


def _spots(low: str, words: tuple[str, ...]) -> Iterator[int]:
    """Where any of the words stands in a text, each by itself."""
    for w in words:
        i = low.find(w)
        while i >= 0:
            yield i
            i = low.find(w, i + 1)


def _lines(text: str, spots: Iterator[int]) -> list[tuple[int, int]]:
    """(start, end) of the lines that hold a spot; a back-tick opened there closes further down."""
    out: list[tuple[int, int]] = []
    for i in sorted(spots):
        if out and i < out[-1][1]:
            continue
        a, b = text.rfind("\n", 0, i) + 1, text.find("\n", i)
        b = len(text) if b < 0 else b
        if text.count("`", a, b) % 2:
            b = text.find("`", b) + 1 or b
        out.append((a, b))
    return out


def _blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body) of PEM blocks of any length."""
    a = text.find("-----BEGIN ")
    while a >= 0:
        head = re.compile(r"-----BEGIN ([A-Z0-9 ]*+)-----").match(text, a)
        end = text.find(f"-----END {head[1]}-----", head.end()) if head else -1
        if end >= 0:
            last = end + len(head[1]) + 14
            yield a, last, head[1], text[head.end() : end]
            a = text.find("-----BEGIN ", last)
        else:
            a = text.find("-----BEGIN ", a + 1)


def _alone(v: str) -> bool:
    """Whether a word of a sentence is a credential: random, or letters with digits or marks as in a password.

    Keys of issues, names of files and modules, versions and dates are none.
    """
    if _DIGEST.match(v) or placeholder(v):
        return False
    if random_like(v):
        return True
    if re.fullmatch(r"\[?[A-Za-z][A-Za-z0-9]*-\d+[\]:.,]*|v?\d+(?:[.\-/:]\d+)+\w*|(?:[A-Za-z_][\w\-]*[./])+[\w\-]*", v):
        return False
    return password_like(v) and bool(re.search(r"\d", v)) and (bool(re.search(r"\d{4}|[^\w.\-/]|[A-Z]", v)) or v.count("-") > 1)


def find(text: str, depth: int = DEPTH) -> list[Find]:
    """Credentials of one text, in order and without overlaps.

    Each kind is looked for only where what it needs stands: names and words
    are found by plain search, so that the patterns read few lines.  The time
    grows with the length of the text and no length ends the search, nor does
    any number of layers.
    """
    todo = [(text, depth)]
    try:
        while True:
            try:
                finds = _find(*todo[-1])
            except _Deeper as deeper:
                todo.append(deeper.args)
                continue
            if len(todo) == 1:
                return finds
            _told[todo.pop()] = finds[0] if finds else None
    finally:
        _told.clear()


def _find(text: str, depth: int) -> list[Find]:
    found: list[Find] = []
    add = lambda a, b, kind, encoding="": found.append(Find(a, b, kind, encoding))
    low = text.lower()
    if len(low) != len(text):  # a letter that grows when lowered
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    blocks = list(_blocks(text)) if "-----BEGIN " in text else []
    for a, b, label, inside in blocks:
        body = re.sub(r"\\[nr]|[\s#*\"'+;]|//|--|[\w\-]+: [^\n]*\n", "", inside)
        if "PRIVATE KEY" in label and len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 40 and not placeholder(body[:200]):
            add(a, b, "pem private key")
    for m in LINK.finditer(text):
        v = m["value"]
        if not placeholder(v) and not placeholder(m["user"] or "user.name") or (v and not placeholder(v) and password_like(v)):
            add(*m.span("value"), "password in a link")
    for i in _spots(low, ("basic", "bearer")):
        m = HEADER.match(text, i)
        if not m or i and (text[i - 1].isalnum() or text[i - 1] == "_"):
            continue
        v = m["value"]
        if m["scheme"].lower() == "basic":
            plain = next((_printable(b) for layer, b in layers(v) if layer == "base64"), None)
            if plain and ":" in plain and not placeholder(plain.split(":", 1)[1]):
                add(*m.span("value"), "basic authorization", "base64")
        elif random_like(v) or random_like(v, 20):
            add(*m.span("value"), "bearer token")
    for m in LOGIN.finditer(text) if "-u" in text else ():
        if not placeholder(m["value"]) and (random_like(m["value"]) or password_like(m["value"])):
            add(*m.span("value"), "password of a login")
    for m in JOINED.finditer(text) if _MEET.search(text) else ():
        v = "".join(x[1:-1] for x in re.findall(r"\"[^\"\n]*\"|'[^'\n]*'", m["parts"]))
        kind, encoding = _judge(m["name"], v, depth, True)
        if kind:
            add(*m.span("parts"), "joined " + kind, encoding)
    for m in CONTINUED.finditer(text) if "\\\n" in text or "\\\r\n" in text else ():
        kind, encoding = _judge(m["name"], re.sub(r"\\\r?\n", "", m["value"]), depth, True)
        if kind:
            add(*m.span("value"), "joined " + kind, encoding)
    named = _lines(text, _spots(low, STEMS))
    tries = [(p, m) for a, b in named for p in (ASSIGN, OPTION) for m in p.finditer(text, a, b)]
    tries += [(PAIR, m) for m in PAIR.finditer(text)] if "value" in low else []
    if "-p" in text:
        tries += [(OPTION, m) for a, b in _lines(text, _spots(low, (" -p ", " -p="))) for m in OPTION.finditer(text, a, b) if m["name"] == "p"]
    for pattern, m in tries:
        a, b, v = _bare(m)
        name = m["name"]
        if pattern is OPTION and name == "p":
            name = "password" if re.search(r"login|mysql|psql|docker|-u\b|--user", text[max(0, a - 80) : a]) else "p"
        kind, encoding = _judge(name, v, depth)
        if kind:
            add(a, b, kind, encoding)
    for i in _spots(low, BEFORE):
        if i and (text[i - 1].isalnum() or text[i - 1] == "_"):
            continue
        if m := SAID.match(text, i):
            a, b, v = _bare(m)
            v = v.rstrip(".")
            if not _DIGEST.match(v) and (random_like(v) or password_like(v)):
                add(a, a + len(v), "password in words")
        elif m := TOLD.match(text, i):
            v = m["value"].rstrip(".")
            if _alone(v):
                add(m.start("value"), m.start("value") + len(v), "token in words")
    for start, document in _documents(text):
        for block in KUBE_DATA.finditer(document):
            for row in KUBE_ROW.finditer(block["rows"]):
                a, b, v = _bare(row)
                at = start + block.start("rows")
                plain = next((_printable(x) for layer, x in layers(v + "=" * (-len(v) % 4)) if layer == "base64"), None) if block["part"] == "data" else v
                if plain is None and len(v) < 12 and _BASE64.fullmatch(v):
                    plain = _printable(_unbase64(v) or b"")
                if plain and not placeholder(plain) and "-----BEGIN" not in plain and names(row["name"]) not in ("other", "digest"):
                    add(at + a, at + b, "secret of a manifest", "base64" if block["part"] == "data" else "")
    taken = sorted([(f.start, f.end) for f in found] + [(a, b) for a, b, _, _ in blocks])
    for m in RUN.finditer(text):
        _of_run(text, m, depth, taken, add)
    if depth:
        taken = sorted(taken + [(f.start, f.end) for f in found])
        spots = PERCENT.finditer(text) if text.count("%") > 2 else ()
        escaped = [m for a, b in _lines(text, _spots(text, ("\\",))) for m in LITERAL.finditer(text, a, b) if "\\" in m["inner"]] if "\\" in text else ()
        for m, group in [*[(m, 0) for m in spots], *[(m, "inner") for m in escaped]]:
            a, b = m.span(group)
            if len(m[group]) < 12 or _overlaps(taken, a, b):
                continue
            kind, encoding = _inside(m[group], depth, False)
            if kind:  # only escapes: the find itself can be cut out of the literal
                add(a, b, kind, encoding if encoding.replace("escape", "").replace(">", "") else "escape")
    found.sort(key=lambda f: (f.start, -f.end))
    out: list[Find] = []
    for f in found:
        if not out or f.start >= out[-1].end:
            out.append(f)
    return out


def _overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    i = bisect_left(taken, (b, -1))
    return any(y > a for _, y in taken[max(0, i - 8) : i])


def _of_run(text: str, m: re.Match, depth: int, taken: list[tuple[int, int]], add) -> None:
    """A run of a text by itself: a token, or something encoded."""
    a, b = m.span()
    v = text[a:b]
    while v and v[0] in ".:/+~" and len(v) >= 16:
        a, v = a + 1, v[1:]
    while v and v[-1] in ".:~-" and len(v) >= 16:
        b, v = b - 1, v[:-1]
    if len(v) < 16 or _overlaps(taken, a, b):
        return
    alone = token(v)
    coded = bool(depth) and _BASE64.fullmatch(v) is not None
    if not alone and not coded:
        return
    before = text[max(0, a - 100) : a]
    before = before[before.rfind("\n") + 1 :]
    under = UNDER.search(before)
    if before.endswith(("$", "\\", "%")) or re.search(r"(?:ssh-|ecdsa-)\S+[ \t]$", before) or under and names(under["name"]) in ("digest", "other"):
        return
    if coded and len(v) >= 16:
        kind, encoding = _inside(v, depth, False)
        if kind:
            add(a, b, kind, encoding)
            return
        if any(_printable(x) for _, x in layers(v)) or public(v):
            return
    if alone and not placeholder(v) and not _DIGEST.match(v):
        add(a, b, "token")


def redact(text: str, finds: list[Find]) -> str:
    """``text`` with each find replaced; quotes, line breaks and encodings stay."""
    parts, at = [], 0
    for f in finds:
        parts.append(text[at : f.start])
        old = text[f.start : f.end]
        if f.kind == "pem private key":
            head = re.match(r"-----BEGIN [^-]*-----", old)[0]
            tail = re.search(r"-----END [^-]*-----$", old)[0]
            parts.append(head + re.sub(r"[A-Za-z0-9+/=]{16,}", MARK, old[len(head) : -len(tail)]) + tail)
        elif f.kind.startswith("joined"):
            first = True

            def piece(m: re.Match) -> str:
                nonlocal first
                new, first = (m[0][0] + encoded(MARK, f.encoding) + m[0][0] if first else m[0][0] * 2), False  # noqa: B023
                return new

            parts.append(re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", piece, old) if old[:1] in "\"'" else encoded(MARK, f.encoding) + "".join(re.findall(r"\\\r?\n", old)))
        elif f.kind == "basic authorization":
            parts.append(encoded(f"{MARK}:{MARK}", "base64"))
        else:
            parts.append(encoded(MARK, f.encoding))
        at = f.end
    return "".join(parts) + text[at:]


def scan(df: DataFrame, keep: list[str], text: str, redacted: bool = True) -> DataFrame:
    """Finds of each text: ``(keep..., n_finds, finds, redacted)``, the last only if asked for.

    ``finds`` is an array of (line_no, start, end, kind, encoding); lines are
    parted by the line feed and counted from 1, offsets count characters.  A
    text without a find keeps its bytes; a null text has no finds and stays null.
    Rows are read where they lie: nothing is moved.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_finds int, finds array<struct<line_no: bigint, start: int, `end`: int, kind: string, encoding: string>>" + (", redacted string" if redacted else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            all_finds, cleaned = [], []
            for t in b["_text"]:
                finds = find(t) if isinstance(t, str) else []
                all_finds.append([{"line_no": t.count("\n", 0, f.start) + 1, "start": f.start, "end": f.end, "kind": f.kind, "encoding": f.encoding} for f in finds])
                if redacted:
                    cleaned.append(redact(t, finds) if isinstance(t, str) else None)
            out["n_finds"] = pd.Series([len(f) for f in all_finds], index=out.index, dtype="int32")
            out["finds"] = pd.Series(all_finds, index=out.index, dtype=object)
            if redacted:
                out["redacted"] = pd.Series(cleaned, index=out.index, dtype=object)
            yield out

    return spread(df.select(*keep, F.col(text).alias("_text"))).mapInPandas(run, schema)
