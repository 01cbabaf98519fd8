"""Functions paired with their documentation.

Each file becomes tokens with offsets; packrat expression grammars, one for each language, find function
definitions wherever one may begin. A semantic action looks up the comment that ends directly above the
definition, or the docstring, and emits the pair; pairs whose documentation says nothing are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import syntax
from tesserae.llm.peg import Peg, Tokens
from tesserae.plans.runtime import spread

#: Tokens behind a comment that are read at first; more are read as long as a definition needs them.
WINDOW = 32
#: Words that documentation must have besides markers, tags, parameters and the function's own name.
LEAST_WORDS = 5

_KINDS = {"ID": "i", "STR": "s", "NUM": "n", "KEY": "k", "NL": "l"}

_GRAMMARS = {
    "py": """
Definition <- Decorator* core=Core
Decorator <- '@' (!NL Any)+ NL
Core <- 'async'? 'def' name=ID ([..])? params=(..) ('->' (!':' Any)+)? ':' body=Body
Body <- NL+ doc=STR+ / doc=STR+ / &Token
Any <- (..) / [..] / {..} / ID / STR / NUM / KEY / Sign
Sign <- !NL Token
""",
    "js": """
Definition <- Decorator* (Export core=Core / core=Core)
Decorator <- '@' ID ('.' ID)* (..)? / '@' (..)
Export <- 'export' 'default'? / 'declare'
Core <- Function / Assigned / Method
Function <- 'async'? 'function' '*'? name=ID Angle? params=(..) Result? {..}
Assigned <- (('const' / 'let' / 'var') &(ID) / Modifier* &((ID / KEY) ('=' / ':' / '?' / '!')) / (ID '.')+) name=Name ('?' / '!')? (Annotation? '=' / ':') 'async'? ('function' '*'? ID? Angle? params=(..) Result? {..} / Angle? params=(..) Result? '=>' Tail / params=ID '=>' Tail)
Annotation <- ':' (!'=' !';' !',' (Any / '=>'))+
Tail <- Any
Modifier <- 'static' / 'async' / 'public' / 'private' / 'protected' / 'readonly' / 'override' / 'abstract' / 'get' / 'set' / '*'
Method <- (Modifier &(Modifier / Name / '*'))* name=Name '?'? Angle? params=(..) Result? {..}
Name <- ID / Soft / '#' ID
Soft <- 'get' / 'set' / 'static' / 'async' / 'public' / 'private' / 'protected' / 'readonly' / 'override' / 'abstract' / 'declare'
Result <- ':' (({..} &({..} / '=>') / !{..} !'=>' !';' Any) / '=>' !({..}))+
Angle <- '<' (Angle / '=>' / !'>' Any)* '>'
Any <- (..) / [..] / {..} / ID / STR / NUM / KEY / Sign
Sign <- !')' !']' !'}' Token
""",
    "go": """
Definition <- core=Core
Core <- 'func' (..)? name=ID ([..])? params=(..) Result? {..}
Result <- (('interface' / 'struct') {..} / !{..} !';' !'func' Any / 'func' (..))+
Any <- (..) / [..] / ID / STR / NUM / KEY / Sign
Sign <- !')' !']' !'}' !'{' Token
""",
    "java": """
Definition <- Annotation* core=Core
Annotation <- '@' !'interface' ID ('.' ID)* (..)?
Core <- (Modifier / Annotation)* Angle? (Type name=ID params=(..) Dims Throws? {..} / name=ID params=(..) Throws? {..})
Modifier <- 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'synchronized' / 'native' / 'default' / 'strictfp'
Type <- Annotation* ID Angle? ('.' ID Angle?)* Dims
Dims <- ([..])*
Throws <- 'throws' Type (',' Type)*
Angle <- '<' (Angle / !'>' Any)* '>'
Any <- (..) / [..] / ID / STR / NUM / KEY / Sign
Sign <- !')' !']' !'}' !'{' !';' Token
""",
    "rs": """
Definition <- Attribute* core=Core
Attribute <- '#' [..]
Core <- ('pub' (..)?)? ('const' / 'async' / 'unsafe' / 'default' / 'extern' STR?)* 'fn' name=ID Angle? params=(..) (!{..} !';' Any)* {..}
Angle <- '<' (Angle / '->' / !'>' Any)* '>'
Any <- (..) / [..] / ID / STR / NUM / KEY / Sign
Sign <- !')' !']' !'}' !'{' Token
""",
    "c": """
Definition <- Attribute* core=Core
Attribute <- [..] / '__attribute__' (..)
Core <- Template* Specifier+ name=ID params=(..) Old? {..}
Template <- 'template' Angle
Old <- (!{..} !'(' !')' (ID / '*' / ',' / ';' / [..]))+
Specifier <- !(ID (..) ({..} / Old {..})) (ID / '*' / Attribute)
Angle <- '<' '>'
""",
    "cpp": """
Definition <- Attribute* core=Core
Attribute <- [..] / '__attribute__' (..) / 'alignas' (..)
Core <- (Template / Attribute)* Head
Head <- Function / Specifier Head
Function <- (ID Angle? '::')* '~'? Named params=(..) Tail* Init? {..}
Template <- 'template' Angle
Named <- name=ID / 'operator' name=Operator
Operator <- (..) / [..] / ID / Sign Sign / Sign
Sign <- !'(' !')' !']' !'}' !'{' !';' !ID Token
Specifier <- 'operator' &ID ID / !'operator' ID Angle? / '::' / '*' / '&' / Attribute / 'explicit' (..) / 'decltype' (..)
Tail <- 'const' / 'noexcept' (..)? / 'override' / 'final' / '&' / 'volatile' / 'throw' (..) / '->' (!{..} !';' (ID / Angle / '::' / '*' / '&' / [..] / (..)))+ / 'requires' (!{..} !';' Any)+ / Attribute
Init <- ':' Start (',' Start)*
Start <- ID Angle? ('::' ID Angle?)* ((..) / {..}) '...'?
Angle <- '<' (Angle / !'>' Any)* '>'
Any <- (..) / [..] / ID / STR / NUM / Inner
Inner <- !'(' !')' !']' !'}' !'{' !';' Token
""",
}

_STRING = r"\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*+\""
_CHAR = r"'(?:[^'\\\r\n]|\\(?:\r\n|.))*+'"
_NUMBER = r"(?:0[xX][\da-fA-F_']+|(?:\d[\d_']*+(?:\.(?!\.)[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?)\w*"
_TWO = r"=>|->|::|\.\.\.|[^\w\s]"
# Most tokens are words without a string behind them and signs that stand for themselves.
_IDENT, _SIGN = r"[^\W\d]\w*+(?![\"'])", r"[(){}\[\];,]"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)"



def _scanner(skipped: str, kinds: str) -> re.Pattern:
    return re.compile(rf"(?:{skipped})*+(?:{kinds}|(?P<z>\Z))", re.S)


_SCANNERS = {
    "py": _scanner(
        r"[ \t\f]+|\\\r?\n",
        rf"(?P<i>{_IDENT})|(?P<b>{_SIGN})|(?P<c>#[^\r\n]*)|(?P<l>[\r\n]\s*)"
        r"|(?P<s>(?i:[rbuft]{0,3})(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|\"(?!\"\")(?:[^\"\\\r\n]|\\(?:\r\n|.))*+\"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|.))*+'))"
        rf"|(?P<n>{_NUMBER})|(?P<j>[^\W\d]\w*)|(?P<o>{_TWO})",
    ),
    "c": _scanner(
        r"\s+|\\\r?\n",
        rf"(?P<i>{_IDENT})|(?P<b>{_SIGN})|(?P<c>//(?:[^\r\n\\]|\\(?:\r\n|.)?)*+|{_BLOCK})|(?P<p>#(?:[^\r\n\\/]|\\\r?\n|\\.|/(?![*/])|/\*(?:[^*]|\*(?!/))*+\*/)*)|(?P<s>(?:u8|u|U|L)?R\"(?P<raw>[^\s()\\]{{0,16}})\((?:.|\n)*?\)(?P=raw)\"|(?:u8|u|U|L)?{_STRING}|{_CHAR})|(?P<n>{_NUMBER})|(?P<j>[^\W\d]\w*)|(?P<o>{_TWO})",
    ),
    "go": _scanner(r"\s+", rf"(?P<i>[^\W\d]\w*+)|(?P<b>{_SIGN})|(?P<c>//[^\r\n]*|{_BLOCK})|(?P<s>{_STRING}|`[^`]*`|{_CHAR})|(?P<n>{_NUMBER})|(?P<o>{_TWO})"),
    "java": _scanner(r"\s+", rf"(?P<i>[^\W\d][\w$]*+)|(?P<b>{_SIGN})|(?P<c>//[^\r\n]*|{_BLOCK})|(?P<s>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|{_STRING}|{_CHAR})|(?P<n>{_NUMBER})|(?P<o>{_TWO})"),
    "rs": _scanner(
        r"\s+",
        rf"(?P<i>[^\W\d]\w*+(?![\"'#]))|(?P<b>{_SIGN})|(?P<c>//[^\r\n]*|/\*)|(?P<s>[bc]?r(?P<h>#*)\"(?:.|\n)*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\.)*+\"|b?'(?:[^'\\\r\n]|\\(?:x[\da-fA-F]{{2}}|u\{{[\da-fA-F_]+\}}|.))')|(?P<n>\d[\w]*(?:\.\d\w*)?)|(?P<j>(?:r#)?[^\W\d]\w*)|(?P<t>'[^\W\d]\w*)|(?P<o>{_TWO})",
    ),
    "js": _scanner(r"\s+", rf"(?P<i>(?:[^\W\d]|\$)(?:\w|\$)*+)|(?P<b>{_SIGN})|(?P<c>//[^\r\n]*|{_BLOCK})|(?P<s>{_STRING}|{_CHAR})|(?P<q>`)|(?P<n>{_NUMBER})|(?P<o>{_TWO})"),
}
_SCANNERS["cpp"] = _SCANNERS["c"]
#: Comments, strings and brackets alone; ``e`` is a slash that may begin a pattern, or a template.
_OUTLINES = {
    "c": _scanner(r"[^/\"'(){}\[\]#RuUL]+|[RuUL](?!\"|8?R?\")|/(?![/*])|(?<=[^\n\r])(?<![\n\r \t])#", rf"(?P<c>//(?:[^\r\n\\]|\\(?:\r\n|.)?)*+|{_BLOCK})|(?P<p>#(?:[^\r\n\\/]|\\\r?\n|\\.|/(?![/*])|/\*(?:[^*]|\*(?!/))*+\*/)*)|(?P<s>(?:u8|u|U|L)?R\"(?P<raw>[^\s()\\]{{0,16}})\((?:.|\n)*?\)(?P=raw)\"|(?:u8|u|U|L)?{_STRING}|{_CHAR})|(?P<b>[(){{}}\[\]])|(?P<x>.)"),
    "go": _scanner(r"[^/\"'`(){}\[\]]+|/(?![/*])", rf"(?P<c>//[^\r\n]*|{_BLOCK})|(?P<s>{_STRING}|`[^`]*`|{_CHAR})|(?P<b>[(){{}}\[\]])|(?P<x>.)"),
    "java": _scanner(r"[^/\"'(){}\[\]]+|/(?![/*])", rf"(?P<c>//[^\r\n]*|{_BLOCK})|(?P<s>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|{_STRING}|{_CHAR})|(?P<b>[(){{}}\[\]])|(?P<x>.)"),
    "js": _scanner(r"[^/\"'`(){}\[\]]+", rf"(?P<c>//[^\r\n]*|{_BLOCK})|(?P<s>{_STRING}|{_CHAR})|(?P<b>[(){{}}\[\]])|(?P<e>[/`])|(?P<x>.)"),
    "rs": _scanner(r"[^/\"'(){}\[\]rbc]+|[rbc](?![\"'#r])|/(?![/*])|'[^\W\d]\w*+(?!')", rf"(?P<c>//[^\r\n]*)|(?P<e>/\*)|(?P<s>[bc]?r(?P<h>#*)\"(?:.|\n)*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\.)*+\"|b?'(?:[^'\\\r\n]|\\(?:x[\da-fA-F]{{2}}|u\{{[\da-fA-F_]+\}}|.))')|(?P<b>[(){{}}\[\]])|(?P<x>.)"),
}
_OUTLINES["cpp"] = _OUTLINES["c"]
#: Kinds of tokens that have two groups in a pattern.
_SAME = {"j": "i"}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+(`|\$\{)", re.S)

#: Reserved words that never name a function or type.
_RESERVED = {
    "js": set("if for while switch catch with return new do else typeof void in of instanceof throw case delete await yield function class import export const let var try finally default break continue this super extends".split()),
    "java": set("if for while switch catch return new do else throw case try finally synchronized public private protected static final abstract native default strictfp throws class interface enum instanceof assert break continue this super".split()),
    "c": set("if for while switch return do else case goto sizeof break continue default".split()),
    "cpp": set("if for while switch catch return new do else throw case goto delete sizeof try co_return co_await co_yield break continue default template operator decltype alignas noexcept requires namespace using public private protected".split()),
    "py": set(),
    "go": set("if for switch select return go defer func struct interface case".split()),
    "rs": set("if for while match return loop fn impl trait struct enum mod use where".split()),
}
_FAMILY = {"py": "py", "js": "js", "mjs": "js", "ts": "js", "go": "go", "java": "java", "rs": "rs", "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp"}
_PEGS: dict[str, Peg] = {}


class Pair(NamedTuple):
    """A function and its documentation, by offsets."""

    name: str
    def_line: int
    start: int
    end: int
    doc: str
    words: int


def _peg(family: str) -> Peg:
    if family not in _PEGS:
        _PEGS[family] = Peg(_GRAMMARS[family], _KINDS)
    return _PEGS[family]


def scan(family: str, text: str) -> tuple[Tokens, list[tuple[int, int]]]:
    """Tokens of a text, and the spans of its comments; breaks of lines are tokens only in Python, outside brackets."""
    # Where no token depends on what stands before it, the pattern's matches are the tokens.
    if family in ("go", "java", "c", "cpp") or family == "rs" and "/*" not in text or family == "js" and "`" not in text:
        found = [*_SCANNERS[family].finditer(text)]
        kinds = [_SAME.get(k := m.lastgroup, k) for m in found]
        strings = [m[m.lastgroup] for m in found]
        if family != "js" or "/" not in strings:
            offsets = [m.start(m.lastgroup) for m in found]
            comments = [(o, o + len(c)) for k, c, o in zip(kinds, strings, offsets) if k == "c"]
            kept = [i for i, k in enumerate(kinds) if k != "c" and k != "z"]
            return Tokens([kinds[i] for i in kept], [strings[i] for i in kept], [offsets[i] for i in kept], _RESERVED[family]), comments
    return _scan(family, text)


def _scan(family: str, text: str) -> tuple[Tokens, list[tuple[int, int]]]:
    kinds, strings, offsets, comments = [], [], [], []
    reserved, pattern = _RESERVED[family], _SCANNERS[family]
    script = family == "js"
    depth, at, last = 0, 0, len(text)
    while at < last:
        again = None
        for m in pattern.finditer(text, at):
            kind = m.lastgroup
            s = m[kind]
            if kind == "z":
                break
            if kind == "c":
                if family == "rs" and s == "/*":
                    level, again = 1, last
                    for e in re.compile(r"/\*|\*/").finditer(text, m.end()):
                        level += 1 if e[0] == "/*" else -1
                        if not level:
                            again = e.end()
                            break
                    comments.append((m.start(kind), again))
                    break
                comments.append(m.span(kind))
                continue
            if kind == "l":
                if depth or not kinds or kinds[-1] == "l":
                    continue
            elif kind == "o" or kind == "b":
                if s in "([{":
                    depth += 1
                elif s in ")]}":
                    depth = max(0, depth - 1)
                elif script and s == "/" and (not kinds or strings[-1] in reserved or kinds[-1] in "ob" and strings[-1] not in (")", "]", "}")):
                    r = _REGEX.match(text, m.start(kind))
                    if r:
                        kinds.append("s")
                        strings.append("/")
                        offsets.append(m.start(kind))
                        again = r.end()
                        break
            elif kind == "q":
                again = _template_end(text, m.end())
                kinds.append("s")
                strings.append("`")
                offsets.append(m.start(kind))
                break
            offsets.append(m.start(kind))
            kinds.append("i" if kind == "j" else kind)
            strings.append(s)
        if again is None:
            break
        at = again
    return Tokens(kinds, strings, offsets, reserved), comments


def _template_end(text: str, at: int) -> int:
    """End of a template literal, embedded expressions and their templates included."""
    while m := _TEMPLATE.match(text, at):
        at = m.end()
        if m[1] == "`":
            return at
        depth = 1
        while depth and at < len(text):
            c = text[at]
            at += 1
            depth += (c == "{") - (c == "}")
            if c == "`":
                at = _template_end(text, at)
    return len(text)


class _Comments:
    """Comments by line: runs of comments on adjacent lines that nothing else precedes on their lines."""

    def __init__(self, text: str, spans: list[tuple[int, int]]):
        self._text = text.replace("\r\n", " \n").replace("\r", "\n") if "\r" in text else text
        self._last = 0, 1
        self._runs: dict[int, tuple[int, int]] = {}
        last = None
        for a, b in spans:
            line, until = self.line(a), self.line(max(a, b - 1))
            if self._text[self._text.rfind("\n", 0, a) + 1 : a].strip():
                last = None
                continue
            first = self._runs[last][0] if last == line - 1 and last in self._runs else a
            self._runs[until] = (first, b)
            last = until

    def line(self, offset: int) -> int:
        """The line of an offset, counted from the place asked for before."""
        at, line = self._last
        line += self._text.count("\n", at, offset) if offset >= at else -self._text.count("\n", offset, at)
        self._last = offset, line
        return line

    def ending_at(self, line: int) -> tuple[int, int] | None:
        return self._runs.get(line)


def functions(extension: str, text: str, documented: bool = False) -> Iterator[tuple[str, int, int, int, str | None, set[str]]]:
    """(name, line of the name, start, end, documentation or None, parameters) of the functions with a body; with ``documented``, only those that begin behind a comment or may have a docstring."""
    family = _FAMILY[extension]
    if family == "py":
        yield from _python(text)
        return
    if documented:
        coarse = _outline(family, text)
        if coarse is not None:
            spans, close = coarse
            comments, named = _Comments(text, spans), set()
            for n, (_, b) in enumerate(spans):
                if n + 1 < len(spans) and not text[b : spans[n + 1][0]].strip():
                    continue  # the run of comments goes on
                limit = WINDOW
                while True:  # more tokens as long as the grammar asks for them
                    tokens, whole = _window(family, text, b, close, limit)
                    made = list(_found(family, text, tokens, comments, [0], named, whole))
                    if whole or not tokens.short:
                        break
                    limit *= 4
                yield from made
            return
    tokens, spans = scan(family, text)
    behind = sorted({bisect_left(tokens.offsets, b) for _, b in spans}) if documented else None
    yield from _found(family, text, tokens, _Comments(text, spans), behind, set())


_PY_OUTLINE = re.compile(
    r"[^#\"'()\[\]{}@\w]*+(?:(?P<c>#[^\r\n]*)|(?P<s>(?i:[rbuft]{0,3})(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|\"(?!\"\")(?:[^\"\\\r\n]|\\(?:\r\n|.))*+\"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|.))*+'))"
    r"|(?P<d>(?:async|def)\b)|\w++(?:[^#\"'()\[\]{}@\w]++\w++(?![\"']))*+|(?P<b>[()\[\]{}])|(?P<a>@)|.|\Z)",
    re.S,
)
_PY_WORDS = re.compile(r"\b(?:async|def)\b")


def _python(text: str) -> Iterator[tuple[str, int, int, int, str | None, set[str]]]:
    """Python's functions: tokens from each decorator or ``def`` that begins a line to the first statement behind the header."""
    spans, strings, anchors, depth = [], [], [], 0
    for m in _PY_OUTLINE.finditer(text):
        kind = m.lastgroup
        if kind is None:  # words, of which some may define
            if not depth:
                anchors += [w.start() for w in _PY_WORDS.finditer(text, m.start(), m.end())]
            continue
        at = m.start(kind)
        if kind == "c":
            spans.append(m.span(kind))
        elif kind == "s":
            strings.append(m.span(kind))
        elif kind == "b":
            depth = depth + 1 if text[at] in "([{" else max(0, depth - 1)
        elif not depth:
            anchors.append(at)
    comments, named, begun = _Comments(text, spans), set(), [a for a, _ in strings]
    for at in anchors:
        margin = at
        while margin and text[margin - 1] in " \t\f":
            margin -= 1
        if margin and text[margin - 1] not in "\r\n;:":
            continue
        for name, line, start, end, doc, parameters in _found("py", text, _python_window(text, at), comments, [0], named):
            indent = start - (max(text.rfind("\n", 0, start), text.rfind("\r", 0, start)) + 1)
            stop = len(text)
            for m in re.compile(rf"[\r\n][ \t]{{0,{indent}}}(?=[^\s#])").finditer(text, end):
                k = bisect_right(begun, m.start()) - 1
                if k < 0 or strings[k][1] <= m.start():  # a line within a string ends no function
                    stop = m.start()
                    break
            yield name, line, start, start + len(text[start:stop].rstrip()), doc, parameters


def _python_window(text: str, at: int) -> Tokens:
    """Tokens from a decorator or ``def`` to the token behind the docstring, or to the first of the body."""
    kinds, strings, offsets = [], [], []
    depth, header, body = 0, False, False
    for m in _SCANNERS["py"].finditer(text, at):
        kind = m.lastgroup
        if kind == "c":
            continue
        if kind == "z":
            break
        s = m[kind]
        if kind == "l" and (depth or not kinds or kinds[-1] == "l"):
            continue
        kinds.append(_SAME.get(kind, kind))
        strings.append(s)
        offsets.append(m.start(kind))
        if s in ("(", "[", "{"):
            depth += 1
        elif s in (")", "]", "}"):
            depth -= 1
        if body and kind not in ("l", "s") or depth < 0:
            break
        if s == "def":
            header = True
        elif s == ":" and not depth:
            body = header
            if not header:  # a line that only begins like a definition
                break
    return Tokens(kinds, strings, offsets, _RESERVED["py"])


def _outline(family: str, text: str) -> tuple[list[tuple[int, int]], dict[int, int]] | None:
    """Spans of comments and closing offsets of brackets, without the tokens between; None where those matter (a JavaScript slash)."""
    spans, close, stack = [], {}, []
    for m in _OUTLINES[family].finditer(text):
        kind = m.lastgroup
        if kind == "b":
            at = m.end() - 1
            if text[at] in "([{":
                stack.append(at)
            elif stack:
                close[stack.pop()] = at
        elif kind == "c":
            spans.append(m.span(kind))
        elif kind == "e":
            return None
    return spans, close


def _window(family: str, text: str, at: int, close: dict[int, int], limit: int) -> tuple[Tokens, bool]:
    """Tokens from an offset to the body of what may be defined there, and whether these are all, not only the first ``limit``; a body is only its brackets."""
    kinds, strings, offsets = [], [], []
    depth, pattern, going = 0, _SCANNERS[family], True
    while going:
        going = False
        for m in pattern.finditer(text, at):
            kind = m.lastgroup
            if kind == "c":
                continue
            if kind in ("z", "q", "l"):
                break
            s = m[kind]
            if kinds and strings[-1] == "}" and not depth and s not in ("{", ",", "=>"):
                break
            kinds.append(_SAME.get(kind, kind))
            strings.append(s)
            offsets.append(m.start(kind))
            if s in ("(", "["):
                depth += 1
            elif s in (")", "]"):
                depth -= 1
            elif s == "{" and not depth:
                end = close.get(offsets[-1])
                if end is not None:
                    kinds.append(kind)
                    strings.append("}")
                    offsets.append(end)
                    at, going = end + 1, True
                break
            elif s == ";" and not depth or depth < 0:
                break
            if len(kinds) >= limit:
                return Tokens(kinds, strings, offsets, _RESERVED[family]), False
    return Tokens(kinds, strings, offsets, _RESERVED[family]), True


def _found(family: str, text: str, tokens: Tokens, comments: _Comments, behind: list[int] | None, named: set[int], whole: bool = True) -> Iterator[tuple[str, int, int, int, str | None, set[str]]]:
    """Definitions among tokens; with ``behind``, only those that begin at these. ``named`` holds the offsets of names found.

    Tokens that are not the ``whole`` give nothing where a match asked for more.
    """
    peg = _peg(family)
    strings, kinds, offsets = tokens.strings, tokens.kinds, tokens.offsets
    anywhere = {"py": {"def", "async", "@"}, "js": {"function"}, "go": {"func"}, "rs": {"fn"}}.get(family, set())
    begin = {";", "{", "}", None} | ({",", ")", "(", "=", ":", "]"} if family == "js" else {")", "]", ">", ":"} if family == "cpp" else {")", "]"} if family in ("java", "rs") else set())
    i, n = 0, len(strings)
    todo = iter(behind) if behind is not None else None
    after = 0
    while True:
        if todo is not None:
            i = next((k for k in todo if k >= after), n)
        if i >= n:
            return
        s = strings[i]
        if family in ("py", "go"):
            ready = s in anywhere
        else:
            before = strings[i - 1] if i else None
            ready = s in anywhere or (kinds[i] == "i" or s in "@#[*~") and (before in begin or kinds[i - 1] in "ps" if i else True) or s == "template"
        found = peg.match("Definition", tokens, i) if ready and kinds[i] != "s" else None
        if found is None or tokens.short and not whole:
            i += 1
            continue
        end, kept = found
        at = {label: (a, b) for label, a, b in kept}
        name = at["name"][0]
        if offsets[name] in named or "params" not in at:
            i += 1
            continue
        named.add(offsets[name])
        core = at["core"][0]
        doc = None
        if "doc" in at:
            a, b = at["doc"]
            if not re.match(r"(?i)[rut]*[bf]", strings[a]):
                doc = " ".join(re.sub(r"^(?i:[rutbf]*)(\"\"\"|'''|\"|')(.*)\1$", r"\2", x, flags=re.S) for x in strings[a:b] if x)
        if doc is None:
            starts = [core, *(k for k in range(core - 1, i - 1, -1) if k == i or comments.line(offsets[k]) != comments.line(offsets[k - 1]))]
            for k in starts:
                line = comments.line(offsets[k])
                run = comments.ending_at(line - 1) or comments.ending_at(line)
                if run and run[1] <= offsets[k] and not text[run[1] : offsets[k]].strip():
                    doc = text[run[0] : run[1]]
                    break
        last = end - 1
        shown = strings[name] if kinds[name] != "o" else "operator"
        yield shown, comments.line(offsets[name]), offsets[i], offsets[last] + len(strings[last]), doc, _parameters(family, tokens, *at["params"])
        # Functions inside others count; a C function holds none.
        i = after = end if family == "c" else name + 1


def _parameters(family: str, tokens: Tokens, a: int, b: int) -> set[str]:
    """Names of parameters, lower case."""
    strings, kinds, out = tokens.strings, tokens.kinds, set()
    for k in range(a, b):
        if kinds[k] != "i":
            continue
        before, after = strings[k - 1] if k > a else "(", strings[k + 1] if k + 1 < b else ")"
        if family in ("py", "js", "rs"):
            named = after == ":" or before in ("(", ",", "*", "...", "mut") and after in (")", ",", "=", "(", "?", ":") or b - a == 1
        elif family == "go":
            named = before in ("(", ",")
        else:
            named = after in (",", ")", "=", "[")
        if named:
            out.add(strings[k].lower())
    return out


_MARKERS = re.compile(r"^[ \t]*(?:/\*+!?<?|\*+/|\*(?!\*)|//+[!/]?<?|#+[!:]?|--+)[ \t]?|\*+/[ \t]*$", re.M)
_DIRECTIVE = re.compile(
    r"(?im)^.*\b(?:eslint|tslint|jshint|prettier|pylint|flake8|noqa|mypy|type:\s*ignore|ts-(?:ignore|nocheck|expect-error|check)|noinspection|nolint|nosonar|istanbul|c8 ignore|clang-(?:format|tidy)|cppcheck|checkstyle|suppresswarnings|rustfmt|go:\w+|\+build|@formatter|fmt:\s*(?:on|off|skip)|isort|yapf|pragma|coverage|region|endregion|todo|fixme|xxx|hack|spdx-license-identifier|webpack\w*:|@ts-\w+|@flow|@jsx|codacy|sonar|coding[:=]|vim:|jscs|biome-ignore|deno-lint-ignore|cspell|lint[: ]|nopmd|formatter:)\b.*$"
)
_TAG = re.compile(r"(?m)[@\\](?:param|arg|argument|property|prop|tparam|templatefield)(?:\[[\w,]+\])?\s+(?:\{[^}]*\}\s*)?\[?[\w.$]+\]?|[@\\][A-Za-z]+|:\w+(?:\s+[\w.,* ]+?)?:(?=\s|$)|\{@\w+|</?[A-Za-z][^<>]*>|\[`?[\w:.]+`?\]\([^)]*\)|https?://\S+")
_SECTION = re.compile(r"(?im)^\s*(?:args?|arguments?|param(?:eter)?s?|returns?|raises?|yields?|throws?|exceptions?|examples?|notes?|see also|panics?|errors?|safety|attributes|keyword args|usage|warnings?|deprecated|todo|since|author|version)\s*:?\s*$|^\s*-{3,}\s*$|^\s*#+\s*(?:arguments|returns|panics|errors|safety|examples?)\s*$")
_ITEM = re.compile(r"(?m)^\s*(?:[-*]\s+)?[`*]*([A-Za-z_]\w*)[`*]*\s*(?:\([^)\n]*\))?\s*(?::|--?)\s")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[A-Za-z_]\w*")
_CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*(?:return\b(?:\s+[\w.]+)?\s*(?:[-+*/%(\[;].*)?|\w+(?:\.\w+)*\s*(?::\w+)?\s*(?:[-+*/|&:]|<<|>>)?=[^=].*|\w+(?:\.\w+)*\([^)]*\);?|(?:if|while|elif)\b.*(?:[=!<>]=|[<>(]|\bnot\b).*[:{)]|for\b.*(?:\bin\b.*:|;.*)"
    r"|(?:def|func|fn|function|async def)\s+\w+\s*[(<].*|class\s+\w+\s*(?:[:({].*)?|(?:const|let|var|val)\s+\w+.*=.*|import\s+[\w{*\"'.]+(?:\s+from.*|\s+as.*|;)?|from\s+[\w.]+\s+import\b.*|#include.*|\}.*|[)\]]+[;,]?)\s*$"
)
_LETTER = re.compile(r"[^\W\d_]")
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def informative(doc: str, name: str, parameters: set[str], extension: str) -> int:
    """Words of a documentation that say something; 0 for disabled code."""
    body = _MARKERS.sub("", doc)
    body = _DIRECTIVE.sub("", body)
    lines = [line for line in body.splitlines() if line.strip()]
    if not lines:
        return 0
    if _disabled(lines, extension):
        return 0
    body = _SECTION.sub("", "\n".join(lines))
    if re.search(r"[@\\:<\[]", body):  # each tag has one of these
        body = _TAG.sub(" ", body)
    if parameters:
        body = _ITEM.sub(lambda m: " " if m[1].lower() in parameters else m[0], body)
    own = {w.lower() for w in _NAME_WORDS.findall(name)} | {name.lower()}
    return sum(1 for w in _WORD.findall(body) if (low := w.lower()) not in own and low not in parameters and w[0] != "_" and _LETTER.search(w))


def _disabled(lines: list[str], extension: str) -> bool:
    """Whether lines are code: most look like statements, or they parse as some with signs of code."""
    like = sum(_CODE_LINE.search(line) is not None for line in lines)
    if like * 2 > len(lines):
        return True
    joined = "\n".join(lines)
    if not like or not re.search(r"[=();]", joined):
        return False
    import textwrap

    whole = {"java": "class A { void f() {\n%s\n} }", "go": "package a\nfunc f() {\n%s\n}\n", "rs": "fn f() {\n%s\n}", "c": "void f() {\n%s\n}"}.get(_FAMILY[extension].replace("cpp", "c"), "%s")
    return bool(syntax.parses(extension, whole % textwrap.dedent(joined)))


def pairs(extension: str, text: str) -> Iterator[Pair]:
    """Documented functions of a text, without those whose documentation is trivial."""
    for name, line, start, end, doc, parameters in functions(extension, text, documented=True):
        if doc:
            words = informative(doc, name, parameters, extension)
            if words >= LEAST_WORDS:
                yield Pair(name, line, start, end, doc, words)


def extract(df: DataFrame, id_col: str = "file_id", name_col: str = "name", text_col: str = "text", texts: bool = True) -> DataFrame:
    """``id``, ``name``, ``def_line``, ``code``, ``doc``, ``words``: functions with documentation that says something.

    Without ``texts``, code and doc are null: what an Arrow function returns is not pruned by the plan.

    Files that do not parse, with another extension, or with a null name or text, give none. Lines
    count from 1, ended by CR LF, LF or CR. A repeated row gives its rows again. Only the three named
    columns are read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    extension = F.lower(F.regexp_extract(F.col(name_col), r"[^/]\.([A-Za-z]+)$", 1))
    rows = df.select(F.col(id_col).alias("id"), extension.alias("extension"), F.col(text_col).alias("text")).filter(F.col("extension").isin(*_FAMILY) & (F.length("text") > 0))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, ext, text in zip(*(batch.column(c).to_pylist() for c in ("id", "extension", "text"))):
                found = list(pairs(ext, text))
                if found and syntax.parses(ext, text):
                    out += [(key, p.name, p.def_line, *((text[p.start : p.end], p.doc) if texts else (None, None)), p.words) for p in found]
            columns = list(zip(*out)) or [()] * 6
            types = [batch.schema.field("id").type, pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "name", "def_line", "code", "doc", "words"])

    return spread(rows).mapInArrow(find, f"id {kind}, name string, def_line int, code string, doc string, words int")
