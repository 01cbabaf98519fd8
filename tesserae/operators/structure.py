"""Definitions of source files, found by structure: indentation in Python, brackets elsewhere.

No grammar package is needed. A text becomes tokens with their lines; a scope is cut into statements at
``;`` and behind closing braces, and each statement is looked at for what it declares. What is not
recognised is no definition and ends up in gap chunks, so every line is covered whatever the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Extensions by family of languages.
FAMILIES = {
    **dict.fromkeys(("py", "pyi"), "python"),
    **dict.fromkeys(("js", "jsx", "mjs", "cjs"), "js"),
    **dict.fromkeys(("ts", "mts", "cts", "tsx"), "ts"),
    "go": "go",
    "java": "java",
    "rs": "rust",
    **dict.fromkeys(("c", "h"), "c"),
    **dict.fromkeys(("cc", "cpp", "cxx", "hh", "hpp", "hxx"), "cpp"),
}


@dataclass
class Definition:
    """A definition on 0-based inclusive rows; containers carry their members."""

    start: int
    end: int
    name: str | None
    members: list["Definition"] = field(default_factory=list)


@dataclass
class Token:
    kind: str  # i: word, s: literal, o: sign
    text: str
    row: int
    end_row: int
    close: int = -1  # index of the closing bracket


_STRING = r"\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?"
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
_SCANNERS = {
    "c": re.compile(rf"(?P<c>{_LINE}|{_BLOCK}|^[ \t]*#(?:[^\n\\]|\\.)*)|(?P<s>R\"(?P<r>[^\s()\\]{{0,16}})\((?:.|\n)*?\)(?P=r)\"|{_STRING})|(?P<i>[\w$]+)|(?P<o>=>|->|::|[^\s\w])", re.S | re.M),
    "js": re.compile(rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>`(?:[^`\\]|\\.)*+`?|{_STRING})|(?P<i>[\w$#]+)|(?P<o>=>|[^\s\w])", re.S),
    "go": re.compile(rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>`[^`]*`?|{_STRING})|(?P<i>\w+)|(?P<o>[^\s\w])", re.S),
    "java": re.compile(rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|{_STRING})|(?P<i>[\w$]+)|(?P<o>[^\s\w])", re.S),
    "rust": re.compile(rf"(?P<c>{_LINE}|/\*)|(?P<s>b?r(?P<r>#*)\"(?:.|\n)*?\"(?P=r)|b?\"(?:[^\"\\]|\\.)*+\"?|b?'(?:[^'\\\n]|\\.[^'\n]*)')|(?P<i>'?\w+)|(?P<o>=>|->|::|[^\s\w])", re.S),
}
_PY = re.compile(r"(?P<c>#[^\n]*)|(?P<s>(?i:[rbuft]{0,3})(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+(?:\"\"\")?|'''(?:[^'\\]|\\.|'(?!''))*+(?:''')?|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?))|(?P<b>[()\[\]{}])", re.S)


def definitions(text: str, family: str) -> tuple[list[Definition], dict[int, tuple[int, int]]]:
    """Outermost definitions, and comments and attributes that may attach: by last row, their rows."""
    return _python(text) if family == "python" else _braces(text, family)


def attach(start: int, trivia: dict[int, tuple[int, int]]) -> int:
    """First row of a definition with the comments directly above it."""
    while (above := trivia.get(start - 1)) is not None:
        start = above[0]
    return start


# Python


def _python(text: str) -> tuple[list[Definition], dict[int, tuple[int, int]]]:
    lines = text.split("\n")
    starts = [0]
    for line in lines[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    inside = bytearray(len(lines))  # rows that go on with a string or bracket begun above
    trivia: dict[int, tuple[int, int]] = {}
    depth, row = 0, 0
    for m in _PY.finditer(text):
        while row + 1 < len(lines) and starts[row + 1] <= m.start():
            row += 1
            if depth:
                inside[row] = 1
        if m.lastgroup == "c":
            if not lines[row][: m.start() - starts[row]].strip() and not depth:
                trivia[row] = (row, row)
        elif m.lastgroup == "b":
            depth = depth + 1 if m[0] in "([{" else max(0, depth - 1)
        else:
            until = row
            while until + 1 < len(lines) and starts[until + 1] < m.end():
                until += 1
                inside[until] = 1
    return _python_scope(lines, inside, trivia, 0, len(lines), 0), trivia


def _python_scope(lines: list[str], inside: bytearray, trivia: dict, start: int, end: int, least: int) -> list[Definition]:
    """Outermost definitions in rows ``start`` to ``end``, whatever blocks they stand in."""
    out, row = [], start
    while row < end:
        line = lines[row]
        head = line.lstrip()
        if inside[row] or not head or row in trivia:
            row += 1
            continue
        first, at = row, row
        while lines[at].lstrip().startswith("@") and at + 1 < end:
            at += 1
            while at + 1 < end and (inside[at] or not lines[at].strip() or at in trivia):
                at += 1
        m = re.match(r"(?:(?:async\s+)?def|(class))\s+([^\W\d]\w*)", lines[at].lstrip())
        if not m:
            row += 1
            continue
        indent = len(lines[at]) - len(lines[at].lstrip())
        last, k = at, at + 1
        while k < end:
            if inside[k]:
                last = k
            elif lines[k].strip() and k not in trivia:
                if len(lines[k]) - len(lines[k].lstrip()) <= indent:
                    break
                last = k
            elif k in trivia and len(lines[k]) - len(lines[k].lstrip()) > indent and any(
                lines[j].strip() and j not in trivia and len(lines[j]) - len(lines[j].lstrip()) > indent for j in range(k + 1, min(end, k + 200))
            ):
                pass  # a comment inside the body is covered by what follows it
            k += 1
        members = _python_scope(lines, inside, trivia, at + 1, last + 1, indent) if m[1] else []
        out.append(Definition(first, last, m[2], members))
        row = last + 1
    return out


# Languages with braces


def _scan(text: str, family: str) -> tuple[list[Token], dict[int, tuple[int, int]]]:
    pattern = _SCANNERS[{"ts": "js", "cpp": "c"}.get(family, family)]
    out: list[Token] = []
    trivia: dict[int, tuple[int, int]] = {}
    stack: list[int] = []
    row, seen, at = 0, 0, 0
    while True:
        m = pattern.search(text, at)
        if m is None:
            break
        at = m.end()
        row += text.count("\n", seen, m.start())
        seen = m.start()
        if m.lastgroup == "c" and m[0] == "/*":  # Rust's nest
            depth = 1
            for e in re.compile(r"/\*|\*/").finditer(text, at):
                depth += 1 if e[0] == "/*" else -1
                at = e.end()
                if not depth:
                    break
        until = row + text.count("\n", m.start(), at)
        kind = "s" if m.lastgroup == "r" else m.lastgroup
        if kind == "c":
            begin = text.rfind("\n", 0, m.start()) + 1
            rest = text[at : text.find("\n", at) if text.find("\n", at) >= 0 else len(text)]
            if not m[0].lstrip().startswith("#") and not text[begin : m.start()].strip() and not rest.strip():
                trivia[until] = (row, until)
            row, seen = until, at
            continue
        token = Token(kind, m[0], row, until)
        if kind == "o":
            if m[0] in "([{":
                stack.append(len(out))
            elif m[0] in ")]}" and stack:
                out[stack.pop()].close = len(out)
        out.append(token)
        row, seen = until, at
    return out, trivia


def _braces(text: str, family: str) -> tuple[list[Definition], dict[int, tuple[int, int]]]:
    tokens, trivia = _scan(text, family)
    return _scope(tokens, 0, len(tokens), family, trivia, False), trivia


def _statements(tokens: list[Token], start: int, end: int, family: str):
    """(first, behind) of the statements of a scope."""
    i = begin = start
    while i < end:
        t = tokens[i]
        step = t.close + 1 if t.close >= 0 else i + 1
        follow = tokens[step] if step < end else None
        if t.text == ";" and t.kind == "o":
            yield begin, step
            begin = step
        elif t.text == "{" and t.close >= 0:
            goes_on = follow is not None and follow.text in (";", ",", ".", ")", "=", "(", "[", "else", "catch", "finally", "as", "while", "from", "&", "|", "?", ":", "::", "->", "=>")
            named = family in ("c", "cpp") and follow is not None and follow.kind == "i" and follow.row == tokens[t.close].row
            if not goes_on and not named:
                yield begin, step
                begin = step
        elif family in ("go", "js", "ts") and follow is not None and follow.row > tokens[step - 1].end_row and not _continues(tokens, step - 1, follow):
            yield begin, step
            begin = step
        i = step
    if begin < end:
        yield begin, end


def _continues(tokens: list[Token], last: int, follow: Token) -> bool:
    """Whether a statement goes on behind a line break."""
    before = tokens[last]
    if before.kind == "o" and before.text not in (")", "]", "}"):
        return True
    return follow.kind == "o" and follow.text not in ("@", "(", "[", "{", "#", "}", "*", "!", "~") or follow.text in ("{", "else", "extends", "implements", "from", "as", "catch", "finally") or before.text in ("export", "default", "async", "declare", "abstract", "static", "public", "private", "protected", "readonly", "return", "const", "let", "var")


def _scope(tokens: list[Token], start: int, end: int, family: str, trivia: dict, inside: bool) -> list[Definition]:
    """Outermost definitions of a scope; statements that are none are searched for definitions in their braces."""
    out = []
    for a, b in _statements(tokens, start, end, family):
        found = _declared(tokens, a, b, family, inside)
        if found is None:
            for i in range(a, b):
                if tokens[i].text == "{" and tokens[i].close >= 0 and not inside and family in ("c", "cpp", "js", "ts", "rust"):
                    nested = _scope(tokens, i + 1, min(tokens[i].close, b), family, trivia, False)
                    covered = {d.start for d in out}
                    out += [d for d in nested if d.start not in covered]
                    break
            continue
        kind, name, body = found
        while tokens[a].text == "#" and family == "rust" and a + 1 < b and tokens[a + 1].close >= 0:  # attributes attach as comments do
            until = tokens[tokens[a + 1].close].end_row
            trivia[until] = (tokens[a].row, until)
            a = tokens[a + 1].close + 1
        while family == "cpp" and tokens[a].text in ("public", "private", "protected") and a + 2 < b and tokens[a + 1].text == ":":
            a += 2  # an access label is no part of what follows it
        members = _scope(tokens, body + 1, tokens[body].close, family, trivia, kind != "namespace") if kind in ("container", "namespace") and body is not None and tokens[body].close >= 0 else []
        out.append(Definition(tokens[a].row, tokens[b - 1].end_row, name, members))
    return sorted(out, key=lambda d: d.start)


def _flat(tokens: list[Token], a: int, b: int) -> list[int]:
    """Indexes of the tokens of a statement outside its brackets; an opening bracket stands for its pair."""
    out, i = [], a
    while i < b:
        out.append(i)
        i = tokens[i].close + 1 if tokens[i].close >= 0 else i + 1
    return out


def _declared(tokens: list[Token], a: int, b: int, family: str, inside: bool) -> tuple[str, str | None, int | None] | None:
    """(kind, name, opening brace) of what a statement declares."""
    flat = _flat(tokens, a, b)
    words = [tokens[i].text for i in flat]
    brace = next((i for i in flat if tokens[i].text == "{" and tokens[i].kind == "o"), None)
    after = lambda k: next((words[j] for j in range(k + 1, len(words)) if tokens[flat[j]].kind == "i"), None)
    if family in ("js", "ts"):
        return _script(tokens, flat, words, brace, after, family, inside)
    if family == "go":
        if not words or inside:
            return None
        if words[0] == "func":
            k = 2 if len(words) > 1 and words[1] == "(" else 1
            return "function", words[k] if k < len(words) else None, brace
        if words[0] == "type":
            return "type", words[1] if len(words) > 1 and words[1] != "(" else (tokens[flat[1] + 1].text if len(flat) > 1 else None), brace
        return None
    if family == "java":
        for k, w in enumerate(words):
            if w in ("class", "interface", "enum") or w == "record" and k + 2 < len(words) and words[k + 2] in ("(", "<"):
                return "container", after(k), brace
            if w in ("=", "(", ";") or w == "{":
                break
        if inside and "(" in words:
            k = words.index("(")
            equal = words.index("=") if "=" in words else len(words)
            if k > 0 and k < equal and tokens[flat[k - 1]].kind == "i" and words[k - 1] not in ("if", "for", "while", "switch", "catch", "return", "new", "static"):
                if k == 1 or words[k - 2] != "@":
                    return "function", words[k - 1], brace
                rest = [j for j in range(k + 1, len(words)) if words[j] == "("]
                if rest and tokens[flat[rest[0] - 1]].kind == "i":
                    return "function", words[rest[0] - 1], brace
        return None
    if family == "rust":
        k = 0
        while k + 1 < len(words) and words[k] == "#":
            k += 2
        while k < len(words) and (words[k] in ("pub", "async", "unsafe", "default", "extern", "(") or words[k] == "const" and k + 1 < len(words) and words[k + 1] in ("fn", "unsafe", "async") or tokens[flat[k]].kind == "s"):
            k += 1
        if k >= len(words):
            return None
        w = words[k]
        if w in ("fn", "struct", "enum", "union", "type") and k + 1 < len(words) and tokens[flat[k + 1]].kind == "i":
            return "definition", words[k + 1], brace
        if w in ("trait", "mod"):
            return "container", words[k + 1] if k + 1 < len(words) else None, brace
        if w == "macro_rules":
            return "definition", after(k), brace
        if w == "impl":
            named = words[k + 1 : words.index("{", k) if "{" in words[k:] else len(words)]
            named = named[: named.index("where")] if "where" in named else named
            if named and named[0] == "<":
                named = _behind_angles(named)
            if "for" in named:
                named = named[named.index("for") + 1 :]
            return "container", "".join(named) or None, brace
        return None
    return _c_like(tokens, flat, words, brace, family, inside)


def _behind_angles(words: list[str]) -> list[str]:
    depth = 0
    for k, w in enumerate(words):
        depth += (w == "<") - (w == ">")
        if depth == 0:
            return words[k + 1 :]
    return []


def _script(tokens, flat, words, brace, after, family: str, inside: bool):
    k = 0
    while k < len(words):
        if words[k] == "@":
            k += 2
            while k < len(words) and (words[k] in (".", "(") or words[k - 1] == "."):
                k += 1
        elif words[k] in ("export", "default", "declare", "abstract", "async") or inside and words[k] in ("static", "public", "private", "protected", "readonly", "override", "get", "set", "*", "accessor") and k + 1 < len(words) and words[k + 1] not in ("(", "="):
            k += 1
        else:
            break
    if k >= len(words):
        return None
    w = words[k]
    if not inside:
        if w == "function":
            return "function", after(k), brace
        if w == "class":
            return "container", after(k), brace
        if family == "ts" and w in ("interface", "enum", "type") or family == "ts" and w == "const" and k + 1 < len(words) and words[k + 1] == "enum":
            return "type", after(k + (w == "const")), brace
        if w in ("const", "let", "var") and "=" in words[k:]:
            value = words[words.index("=", k) + 1 :]
            value = value[1:] if value[:1] == ["async"] else value
            if value and (value[0] in ("function", "class") or "=>" in value[: 1 + next((j for j, x in enumerate(value) if x in (";", ",")), len(value))]):
                return "function", after(k), None
        return None
    if "(" in words[k:]:
        p = words.index("(", k)
        equal = words.index("=", k) if "=" in words[k:] else len(words)
        if k < p < equal and brace is not None and words[p - 1] not in ("if", "for", "while", "switch", "catch"):
            return "function", words[p - 1], brace
    return None


_C_CONTROL = {"if", "for", "while", "switch", "return", "do", "else", "case", "goto", "sizeof"}


def _c_like(tokens, flat, words, brace, family: str, inside: bool):
    k = 0
    while family == "cpp" and k < len(words) and (words[k] in ("public", "private", "protected") and k + 1 < len(words) and words[k + 1] == ":"):
        k += 2
    words_, flat_ = words[k:], flat[k:]
    if not words_:
        return None
    if family == "cpp":
        if words_[0] in ("namespace",) or words_[:2] == ["inline", "namespace"]:
            name = words_[words_.index("namespace") + 1] if brace is not None else None
            return ("namespace", name if name != "{" else None, brace) if brace is not None and "=" not in words_ else None
        if words_[0] == "template":
            inner = _behind_angles(words_[1:])
            found = _c_like(tokens, flat_[len(words_) - len(inner) :], inner, brace, family, inside)
            return ("definition", found[1], None) if found else None
    if words_[0] == "typedef":
        named = [w for w, i in zip(words_, flat_) if tokens[i].kind == "i"]
        return "definition", named[-1] if named else None, None
    paren = next((j for j, w in enumerate(words_) if w == "("), None)
    body = next((j for j, w in enumerate(words_) if w == "{"), None)
    head = words_[: body if body is not None else len(words_)]
    kinds = ("struct", "union", "enum") + (("class",) if family == "cpp" else ())
    if body is not None and any(w in kinds for w in head) and (paren is None or paren > body) and "=" not in head:
        at = next(j for j, w in enumerate(head) if w in kinds)
        rest = [w for w in head[at + 1 :] if w not in ("class", "final", "struct")]
        name = rest[0] if rest and re.match(r"\w", rest[0]) else None
        return ("container" if family == "cpp" and head[at] in ("class", "struct") else "definition"), name, flat_[body]
    if body is not None and paren is not None and 0 < paren < body and "=" not in words_[:paren] and words_[paren - 1] not in _C_CONTROL and tokens[flat_[paren - 1]].kind == "i" and words_[0] not in _C_CONTROL:
        return "function", words_[paren - 1], flat_[body]
    return None
