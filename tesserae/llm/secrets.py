"""Credentials embedded in source code and configuration.

Every candidate string is first judged by the subwords it falls into under a public vocabulary: words
take few, keys many. The ceiling on its characters for each subword depends on the context (the name
it is assigned to, a header, a URL, a command option, a call, a remark, or none), and only what lies
below it is held against the rules of that context: no placeholder, no reference, and nothing around it that says
that it is a checksum, an id, an image or public. Redaction keeps every offset.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.tokens import chars_per_token, count
from tesserae.plans.runtime import spread

#: A value with fewer characters for each subword than this is unnatural; words have about four or more.
UNNATURAL = 2.4
#: The most characters for each subword that a value may have by the context it stands in.
CEILING = {"none": UNNATURAL, "key block": UNNATURAL, "call": 3.5, "remark": 3.5, "name": 4.0, "header": 4.0, "url": 6.0}
#: Shortest unnatural value that counts without a context.
LONG = 18


class Finding(NamedTuple):
    start: int
    end: int
    kind: str


_SECRET_WORDS = {
    "password", "passwd", "passwort", "passphrase", "passcode", "pwd", "pw", "pass", "secret", "secrets", "token", "credential",
    "credentials", "cred", "creds", "apikey", "authkey", "accesskey", "secretkey", "privatekey", "login", "auth", "authorization",
    "bearer", "signature", "pin", "apitoken", "authtoken", "dsn",
}
_KEY_QUALIFIERS = {"api", "access", "secret", "private", "signing", "sign", "encryption", "encrypt", "master", "auth", "service", "session", "shared", "account", "client", "hmac", "jwt", "storage", "webhook", "deploy", "license", "ssh", "admin", "root", "app", "crypt", "cipher", "aes"}
#: Words that turn a name with a secret word into something about it.
_ABOUT = {
    "ttl", "length", "len", "min", "max", "hint", "template", "count", "size", "limit", "timeout", "expiry", "expires", "age", "url",
    "uri", "path", "file", "dir", "name", "field", "label", "type", "kind", "policy", "prompt", "placeholder", "example", "help",
    "message", "text", "title", "description", "enabled", "required", "public", "hash", "checksum", "digest", "env", "var", "regex",
    "pattern", "header", "prefix", "suffix", "format", "version", "rotation", "retries", "attempts", "algorithm", "encoding", "status",
    "endpoint", "issuer", "scope", "id", "ids", "index", "rules", "strength", "page", "form", "column", "list", "parser", "counter",
}
#: Words around a value that explain why it looks random.
_BENIGN = re.compile(
    r"(?i)(?:integrity|checksum|digest|sha\d{1,3}|md5|hash|revision|\brev\b|_rev\b|rev[_.\-]|commit|request.?id|trace.?id|correlation|uuid|guid|"
    r"etag|public|pubkey|certificate|ssh-(?:rsa|ed25519)|png|jpe?g|gif|icon|image|svg|font|woff|base64|fingerprint|version|build|lock|resolved|"
    r"tree|blob|ref\b|bundle|asset|cache.?key|md5|crc|nonce.?test|sample|fixture)"
)
_PLACEHOLDER = re.compile(
    r"(?i)(?:your|insert|change.?me|change.?it|replace|example|placeholder|dummy|redacted|removed|masked|hidden|todo|fixme|enter|fill.?in|"
    r"sample|not.?a.?real|fake|none\b|null\b|undefined|x{5,}|\*\*\*|\.\.\.|<[^>]*>|\$\{|\$\(|\{\{|\{\w*\}|%\(|%[sd]\b|\bfrom.?env|test.?only|my.?(?:token|secret|password|key)|(?:token|secret|password|key).?here)"
)
_REFERENCE = re.compile(r"(?:\$\w+|%\w+%|[\w.]*(?:environ|getenv|process\.env|config|settings|vault|secrets?|env|options?|args|self|this|params?|request|ctx|context)(?:\.|\[|\().*|.*\(.*\).*|@\w+|\w+(?:\.\w+)*\[.*\]|(?:ref|vault|arn|file|env|secret|keychain):.*)", re.S)
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")

_MARK = re.compile(r"-----(?:BEGIN (?P<label>[A-Z0-9 ]+)-----|END(?: [A-Z0-9 ]+-----)?)")
_PRIVATE = re.compile(r"(?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?")
#: Between marks this far apart there is a key only if nothing else stands there.
_FAR = 12_000
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=\s\\\"'`,.:()@<>\-]*+")
#: What belongs to a block that breaks off before its END mark: runs of base64, short ones only last, and header lines.
_KEY_RUN = re.compile(r"(?:(?:\\[nrt]|[\s\"'`+,\\]|(?:Proc-Type|DEK-Info|Version|Comment|Hash):[^\r\n\\]*+)*+[A-Za-z0-9+/=]{20,}+)+(?:(?:\\[nrt]|[\s\"'`+,\\]){1,8}[A-Za-z0-9+/]{1,19}+={0,2}(?=[\s\"'`\\]|\Z))?")
#: What tells a long token from data: three to five parts with a JSON header, or a prefix that names its issuer.
_LONG_TOKEN = re.compile(r"ey[JK][\w\-]++(?:\.[\w\-]*+){2,4}=*|[A-Za-z][A-Za-z0-9]{1,11}[\-_.][\w.\-+/]++=*")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{1,20}:/{1,2}(?P<user>[^\s:/@'\"<>]*+):(?P<value>[^\s/@'\"<>]{3,}+)@[\w.\-\[{$]")
_HEADER = re.compile(r"(?i)(?:authorization|auth|x-[\w\-]*(?:auth|token|key|secret)[\w\-]*)['\"]?\s{0,3}[:=,]\s{0,3}(?:\w{0,6}['\"])?\s*(?:(?:bearer|basic|token|digest|apikey|key)\s+)?(?P<value>[^\s'\"`,;)]{6,}+)")
_ASSIGN = re.compile(
    r"(?<![\w.\-$])(?P<name>[A-Za-z_$][\w.\-$]*+)(?P<mid>['\"`]?\]?(?:[ \t]*:[ \t]*[\w&'<>\[\]?* \t.]{1,40}?(?==))?[ \t]{0,8}(?::=|=>|==?|:|<-)(?:[ \t]{0,8}|\s{1,40}(?=[\"'`]))(?:[rbufRBL@$]{0,2}|String\(|new String\(|std::string\(|&)?)(?P<open>[(\[]\s{0,40}(?=[\"'`]))?"
    r"(?:(?P<q>\"\"\"|'''|[\"'`])(?P<quoted>(?:(?!(?P=q))[^\\\r\n]|\\.){3,}?)(?P=q)|(?P<bare>[^\s'\"`,;(){}\[\]<>]{4,}+))"
)
_NEXT_LITERAL = re.compile(r"\s{0,40}(?:\+|\.\.?|\\|,)?\s{0,40}(?P<q>[\"'`])(?P<value>[^\"'`\r\n]++)(?P=q)")
_OPTION = re.compile(r"(?<![\w-])--?(?P<name>[A-Za-z][\w\-]*)(?:=|\s+)(?P<q>['\"]?)(?P<value>[^\s'\"`]{4,}+)(?P=q)")
_BASIC = re.compile(r"(?:\s-u|--user)\s*[= ]?\s*['\"]?(?P<user>[\w.\-]+):(?P<value>[^\s'\"`@]{4,}+)")
_QUERY = re.compile(r"[?&;](?P<name>[\w.\-]{2,40})=(?P<value>[^\s&#'\"`<>;]{4,}+)")
_REMARK = re.compile(
    r"(?i)\b(?:pass(?:word|wd|phrase|code)?|pw|pwd|secret|token|credentials?|creds?|log[- ]?in|sign[- ]?in|(?:api |old |new |signing |access |master |private )?key|rotation|pin)\b[ :,](?P<rest>[^\n\r'\"`=(]{6,})"
)
_REMARK_VALUE = re.compile(r"(?<![^\s/:,(<])[^\s,;()<>\[\]/]{8,}+")
_NAME_REMARK = re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|pw|pwd|secret|token|credential|api[_\-]?key)[_\-](?:is|was)[_\-](?P<value>[^\s/?&]{4,}+)")
_CALL = re.compile(r"(?<![\w.:])(?P<name>[A-Za-z_][\w.:]*+)\s?\((?P<args>[^()]{4,}+)\)")
_CALL_NAMES = re.compile(r"(?i)(?:^|[._:])\w*?(?:connect|log_?in|sign(?:_?with|_?in)?|auth\w*|open_?pool|set_?header|password|credential|token|unlock|decrypt|session|pool|api_?key|set_?secret)\w*$")
_ARGUMENT = re.compile(r"(?P<q>[\"'`])(?P<value>(?:(?!(?P=q))[^\\\r\n]|\\.)+)(?P=q)")
_LITERAL_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_\-.])(?P<value>[A-Za-z0-9_][A-Za-z0-9_\-.+/]{%d,}+=*)" % (LONG - 1))
_REST_OF_LINE = re.compile(r"[^\n\r]*")
_REST_OF_WORD = re.compile(r"[^\s'\"`=(]*+")
_DIGIT = re.compile(r"\d")
_LETTERS = re.compile(r"[a-z]{16,}|[A-Z]?[a-z]+(?:[A-Z][a-z]+){2,}")
_PASSWORDS = ("password", "passwd", "passphrase", "pwd", "secret")
_PROGRESS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|\d+")


def rare(value: str, context: str) -> bool:
    """Whether a value has few enough characters for each subword for its context."""
    return chars_per_token(value) < CEILING[context]


def passphrase(name: str, value: str) -> bool:
    """Whether words without anything between them are given to a password: a run of letters that is no word, name or type."""
    words = words_of(name)
    return bool(words) and words[-1] in _PASSWORDS and _LETTERS.fullmatch(value) is not None and count(value) >= 3 and not _PLACEHOLDER.search(value) and not any(w in value.lower() for w in _PASSWORDS)


@functools.lru_cache(maxsize=1 << 16)
def names_secret(name: str) -> bool:
    """Whether a name says that its value is a credential, not something about one."""
    return _names_secret(words_of(name))


def words_of(name: str) -> list[str]:
    """Lower-case words of an identifier: ``apiToken``, ``api_token`` and ``API-TOKEN`` alike."""
    return [w.lower() for w in _PROGRESS.findall(name)]


def _names_secret(words: list[str]) -> bool:
    if not words:
        return False
    hit = [i for i, w in enumerate(words) if w in _SECRET_WORDS or (w in ("key", "keys") and i and words[i - 1] in _KEY_QUALIFIERS) or (w == "code" and i and words[i - 1] == "pin") or (w == "salt" and i)]
    if not hit:
        joined = "".join(words)
        return any(joined.endswith(w) for w in ("password", "passwd", "apikey", "secretkey", "accesskey", "authtoken", "apitoken"))
    return not any(w in _ABOUT for w in words)


def plausible(value: str, context: str = "name") -> bool:
    """Whether a value in a context can be a credential: made of rare subwords, no placeholder, reference or plain word."""
    if len(value) < 5 or not rare(value, context) or _PLACEHOLDER.search(value) or _UUID.fullmatch(value):
        return False
    body = re.sub(r"[^0-9A-Za-z]", "", value)
    if len(body) < 4 or len(set(body)) < 4 or len(set(value)) < 5:
        return False
    if re.fullmatch(r"[\d.,:_/+\-]+", value) or re.match(r"(?:/|\./|\.\./|[A-Za-z]:\\)[\w.]", value) and chars_per_token(value) > UNNATURAL:
        return False
    if re.match(r"[a-z][a-z0-9+.\-]*://", value):
        return False
    if re.fullmatch(r"(?i)(?:true|false|yes|no|on|off|enabled|disabled|default|optional|required|bearer|basic)", value):
        return False
    if re.search(r"\s", value) and chars_per_token(value) > UNNATURAL and not re.search(r"\d", value):
        return False
    digits = re.search(r"\d", value) is not None
    letters = re.search(r"[A-Za-z]", value) is not None
    return letters and digits or chars_per_token(value) < (2.8 if len(value) >= 16 else UNNATURAL)


def unnatural(value: str) -> bool:
    """Whether a value alone looks like a random key: few characters for each subword, mixed kinds."""
    if len(value) < LONG or _DIGIT.search(value) is None or not rare(value.strip("=.-_/"), "none") or _PLACEHOLDER.search(value) or _UUID.search(value):
        return False
    body = value.strip("=.-_/")
    if not (re.search(r"\d", body) and re.search(r"[A-Za-z]", body)) or len(set(body)) < 10:
        return False
    if re.fullmatch(r"0[xX][0-9a-fA-F_]+|[\d_.,\-+eE]+|\d[\w:.\-+]*\d{2}:\d{2}\S*", body):
        return False
    if re.search(r"[./\-_]", body):
        parts = [p for p in re.split(r"[./\-_]", body) if p]
        core = max(parts, key=len)
        if len(core) < 16 and not re.match(r"ey[JK][A-Za-z0-9]", body) and len(re.findall(r"[A-Z]", body)) < 4:
            return False
    return True


def _benign_context(text: str, start: int, end: int) -> bool:
    line = text[max(text.rfind("\n", 0, start), text.rfind("\r", 0, start), start - 160) + 1 : start]
    return _BENIGN.search(line) is not None or _BENIGN.match(text[start:end][:12]) is not None


def _in_prose(text: str, at: int) -> bool:
    """Whether a place lies in a comment or a line of prose, not in code."""
    line = text[max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1 : at]
    rest = _REST_OF_LINE.match(text, at)[0]
    return re.search(r"//|#|/\*|--|^\s*[;*%]|<!--", line) is not None or re.search(r"[={}()\[\];\"]", line + rest) is None and len((line + rest).split()) > 4


def _pieces(text: str, at: int, loose: bool) -> list[re.Match]:
    """Literals that continue one that ends at ``at``: joined by a sign or, inside brackets, by juxtaposition."""
    out = []
    while (n := _NEXT_LITERAL.match(text, at)) and (loose or re.search(r"[+.\\]", text[at : n.start("q")])):
        out.append(n)
        at = n.end()
    return out


def _is_path(value: str) -> bool:
    """Whether a value with slashes is made of words, as paths are."""
    parts = [p for p in re.split(r"[/.]", value) if len(p) > 3]
    return "/" in value and sum(chars_per_token(p) >= 3 for p in parts) * 2 >= len(parts)


def _bulk(text: str, start: int, end: int) -> bool:
    """Whether the value is one of many lines of such data: encoded files, not a key."""
    a, b = text.rfind("\n", 0, start), text.find("\n", end)
    above = text[text.rfind("\n", 0, max(a, 0)) + 1 : a].strip() if a > 0 else ""
    below = text[b + 1 : (text.find("\n", b + 1) + 1 or len(text) + 1) - 1].strip() if b >= 0 else ""
    run = re.compile(r"[\"'`]?[A-Za-z0-9+/=_\-]{24,}[\"'`]?[,;+\\)]*")
    return bool(run.fullmatch(above) or run.fullmatch(below))


def _blocks(text: str, label: re.Pattern) -> list[tuple[int, int, re.Match, int]]:
    """(start, end, BEGIN mark, end of the body) of armoured blocks: from a BEGIN with such a label to the next END, or to the end of the base64 that follows."""
    out, begun, open_ = [], [], []
    for m in _MARK.finditer(text) if "-----" in text else ():
        if m["label"] is not None:
            if label.fullmatch(m["label"]):
                begun.append(m)
            continue
        for i, b in enumerate(begun):
            if m.start() - b.end() <= _FAR or _KEY_BODY.fullmatch(text, b.end(), m.start()):
                out.append((b.start(), m.end(), b, m.start()))
                open_ += begun[:i]
                break
        else:
            open_ += begun
        begun = []
    for b in [*open_, *begun]:
        run = _KEY_RUN.match(text, b.end())
        if run and not any(x <= b.start() < y for x, y, *_ in out):
            out.append((b.start(), run.end(), b, run.end()))
    return sorted(out, key=lambda x: x[:2])


def find_secrets(text: str) -> list[Finding]:
    """Credentials of a text, in order, without overlaps; a value in pieces is found at its first piece."""
    found: list[Finding] = []
    blocks = [(a, b) for a, b, *_ in _blocks(text, re.compile(".+"))]

    def add(start: int, end: int, kind: str) -> None:
        if not any(a <= start < b for a, b in blocks):
            found.append(Finding(start, end, kind))

    for start, until, mark, end in _blocks(text, _PRIVATE):
        body = re.sub(r"\\[nrt]|[^A-Za-z0-9+/=]", "", text[mark.end() : end])
        if len(body) >= 40 and not _PLACEHOLDER.search(text[mark.end() : min(end, mark.end() + 200)]) and len(set(body)) > 12 and rare(body, "key block"):
            found.append(Finding(start, end + len("-----END") if until > end else end, "private key"))
    for m in _URL.finditer(text):
        value = m["value"]
        if rare(value, "url") and not _PLACEHOLDER.search(value) and not value.startswith(("$", "%", "{", "<")) and not _REFERENCE.fullmatch(value) and value.lower() not in ("password", "pass", "passwd", "secret", "token", "pw", "user", "pwd") and len(set(value)) > 2:
            add(*m.span("value"), "url")
    named = any(mark in text for mark in ("_is_", "-is-", "_was_", "-was-"))
    for pattern, kind in ((_HEADER, "header"), (_BASIC, "command"), *([(_NAME_REMARK, "remark")] if named else [])):
        for m in pattern.finditer(text):
            value = m["value"].rstrip(".") if kind != "remark" else re.sub(r"\.(?:md|txt|rst|json|ya?ml|log|csv|py|js)$", "", m["value"])
            if plausible(value, "remark" if kind == "remark" else "header") and not _REFERENCE.fullmatch(value):
                add(m.start("value"), m.start("value") + len(value), kind)
    for pattern, kind in ((_OPTION, "option"), (_QUERY, "query")):
        for m in pattern.finditer(text):
            if names_secret(m["name"]) and plausible(m["value"]) and not _REFERENCE.fullmatch(m["value"]):
                add(*m.span("value"), kind)
    for m in _ASSIGN.finditer(text):
        if not names_secret(m["name"]):
            continue
        which = "quoted" if m["quoted"] is not None else "bare"
        value, end = m[which], m.end(which)
        if which == "quoted":  # a literal cut in pieces
            for n in _pieces(text, m.end(), bool(m["open"])):
                value, end = value + n["value"], n.end("value")
        elif _REFERENCE.fullmatch(value) or re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", value) and not re.search(r"\d{2,}$", value) and not (len(value) >= 16 and chars_per_token(value) < 2.8):
            continue
        if _REFERENCE.fullmatch(value) and re.match(r"\$|%|@|ref|vault|arn|file:|env", value):
            continue
        header = re.match(r"(?i)(?:authorization:\s*)?(?:bearer|basic|token)\s+(?=\S+$)", value)
        if header:
            start = m.start(which) + header.end()
            value = value[header.end() :]
        else:
            start = m.start(which)
        if plausible(value) and not (len(value) > 600 and re.search(r"\s", value)) or which == "quoted" and passphrase(m["name"], value):  # so long with blanks is a text
            add(start, end, "assignment")
    for m in _CALL.finditer(text):
        if _CALL_NAMES.search(m["name"]):
            literals = list(_ARGUMENT.finditer(text, m.start("args"), m.end("args")))
            first = len(literals) - 1
            while first > 0 and re.fullmatch(r"\s*(?:[+.]\s*)?", text[literals[first - 1].end() : literals[first].start()]):
                first -= 1
            if literals:
                value, span = "".join(a["value"] for a in literals[first:]), (literals[first].start("value"), literals[-1].end("value"))
                if (len(value) > 7 and plausible(value, "call") and not re.search(r"\s|/", value) and re.search(r"[A-Za-z]{3}\D*\d|[\d][A-Za-z]", value) and not _REFERENCE.fullmatch(value) and not re.fullmatch(r"[\w\-]+(?:\.[\w\-]+)+(?::\d+)?", value) or unnatural(value)):
                    add(*span, "call")
                elif len(value) > 7 and plausible(value, "call") and re.fullmatch(r"[A-Za-z]{3,}[.][A-Za-z]{3,}\d{2,}", value):
                    add(*span, "call")
    for m in _REMARK.finditer(text):
        for v in _REMARK_VALUE.finditer(text, m.start("rest"), _REST_OF_WORD.match(text, m.end("rest")).end()):
            value = v[0].rstrip(".:!?")
            shaped = re.fullmatch(r"[A-Za-z]{2,}[\W_]?[A-Za-z]*\d{2,}|\S*[A-Za-z]\d\S*\d\S*", value)
            if shaped and _in_prose(text, m.start()) and plausible(value, "remark") and not _REFERENCE.fullmatch(value) and not _benign_context(text, v.start(), v.end()):
                add(v.start(), v.start() + len(value), "remark")
                break
    for m in _LITERAL_TOKEN.finditer(text):
        value = m["value"]
        if unnatural(value) and not _benign_context(text, m.start(), m.end()) and not re.fullmatch(r"(?i)[0-9a-f]+", value) and not _bulk(text, m.start(), m.end()) and not _is_path(value) and (len(value) < 200 or _LONG_TOKEN.fullmatch(value)):
            add(*m.span("value"), "unnatural")
    found.sort(key=lambda f: (f.start, -f.end))
    out: list[Finding] = []
    for f in found:
        if out and f.start < out[-1].end:
            if f.end > out[-1].end:
                out[-1] = Finding(out[-1].start, f.end, out[-1].kind)
        else:
            out.append(f)
    return out


def find_in_path(path: str) -> list[Finding]:
    """Credentials in a file path or URL: as in a text, and unnatural names of directories and files.

    A part that is a plain hexadecimal number is a content hash, as build tools and caches name files.
    """
    found = [f for f in find_secrets(path) if f.kind != "unnatural"]
    for m in re.finditer(r"[^/?&=#:@]+", path):
        stem = re.sub(r"(?:\.[A-Za-z]\w{0,9})+$", "", m[0])
        hexadecimal = re.fullmatch(r"(?i)(?:.*[.\-_])?[0-9a-f]{7,}", stem) is not None
        if unnatural(stem) and not hexadecimal and not any(f.start < m.end() and m.start() < f.end for f in found):
            found.append(Finding(m.start(), m.start() + len(stem), "unnatural"))
    return sorted(found)


def redact(text: str, found: list[Finding]) -> str:
    """``text`` with every character of the findings but white space, quotes and joining signs masked: all offsets and lines stay."""
    pieces, at = [], 0
    for f in found:
        pieces += [text[at : f.start], re.sub(r"[^\s\"'`+\\]", "*", text[f.start : f.end])]
        at = f.end
    return "".join([*pieces, text[at:]])


_LINE_END = re.compile(r"\r\n|\n|\r")


def scan(df: DataFrame, id_col: str, text_col: str, paths: bool = False) -> DataFrame:
    """``id``, ``line_no``, ``start``, ``end``, ``kind``, ``masked``: the credentials of each text and its redacted line.

    Offsets count code points, ``end`` is exclusive. A null or empty text has none; a null id is
    kept; a repeated row gives its rows again. With ``paths``, texts are
    file paths. Columns other than the two named are not read.
    """
    look = find_in_path if paths else find_secrets
    kind = df.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if not text or not (found := look(text)):
                    continue
                clean = redact(text, found)
                ends = [m.end() for m in _LINE_END.finditer(text)]
                for f in found:
                    no = bisect_right(ends, f.start)
                    a, b = ends[no - 1] if no else 0, ends[no] if no < len(ends) else len(text)
                    rows.append((key, no + 1, f.start, f.end, f.kind, clean[a:b].rstrip("\r\n")))
            columns = list(zip(*rows)) or [()] * 6
            types = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "line_no", "start", "end", "kind", "masked"])

    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(find, f"id {kind}, line_no int, start bigint, `end` bigint, kind string, masked string")


def masked(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with the credentials of ``text_col`` masked in place: same length, lines and columns; null stays null."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: redact(t, find_secrets(t)) if t else t)

    return df.withColumn(text_col, mask(F.col(text_col)))
