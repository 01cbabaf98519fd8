"""Notebook texts as cells: JSON files, scripts with cell markers, printed sessions."""

from __future__ import annotations

import html
import json
import re
from typing import NamedTuple

MARKDOWN, CODE, OUTPUT = "markdown", "code", "output"


class Cell(NamedTuple):
    kind: str
    text: str


_OPENING = re.compile(r"\s*+\{")
_MARKER = re.compile(r"^# ?%%(.*)$", re.M)
_PROMPT = re.compile(r"^(In|Out) ?\[(?:\d*| |None|\*)\]: ?", re.M)
_CONTINUED = re.compile(r"^ {2,}\.\.\.: ?", re.M)
_OUT_LINE = re.compile(r"^# out: ?", re.M)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>")
_IMAGE = re.compile(r"[A-Za-z0-9+/]{120,}={0,2}")
_JSON_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?', re.S)


def cells(text: str) -> list[Cell]:
    """The cells of a notebook text, whatever its form; outputs are cells of their own."""
    if _OPENING.match(text):
        return _from_json(text)
    if _MARKER.search(text):
        return _from_percent(text)
    return _from_flat(text)


def _joined(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(v for v in value if isinstance(v, str))
    return ""


def _from_json(text: str) -> list[Cell]:
    try:
        book = json.loads(text)
    except (ValueError, RecursionError):
        return _from_broken_json(text)
    if not isinstance(book, dict):
        return [Cell(MARKDOWN, text)]
    listed = book.get("cells")
    if not isinstance(listed, list):  # the older format keeps them in worksheets
        listed = [c for w in book.get("worksheets") or [] if isinstance(w, dict) for c in w.get("cells") or []]
    out = []
    for cell in listed:
        if not isinstance(cell, dict):
            continue
        kind = CODE if cell.get("cell_type") == "code" else MARKDOWN
        out.append(Cell(kind, _joined(cell.get("source", cell.get("input", "")))))
        for made in cell.get("outputs") or []:
            if isinstance(made, dict):
                data = made.get("data") if isinstance(made.get("data"), dict) else {}
                parts = [_joined(made.get("text")), *(_joined(v) for k, v in data.items() if not k.startswith("image/")), _joined(made.get("evalue")), _joined(made.get("traceback"))]
                out.append(Cell(OUTPUT, "\n".join(p for p in parts if p)))
    return out


def _from_broken_json(text: str) -> list[Cell]:
    """Strings of a file that is no JSON any more, keys left out; adjacent lines of one list stay together."""
    out, kind, lines = [], MARKDOWN, []
    for m in _JSON_STRING.finditer(text):
        if m[2]:
            if lines:
                out.append(Cell(kind, "".join(lines)))
                lines = []
            if m[1] in ("source", "text", "text/plain", "cell_type"):
                kind = OUTPUT if m[1].startswith("text") else kind
        elif m[1] in ("markdown", "code"):
            kind = m[1]
        else:
            try:
                lines.append(json.loads(f'"{m[1]}"', strict=False))
            except ValueError:
                lines.append(m[1])
    return [*out, Cell(kind, "".join(lines))] if lines else out


def _from_percent(text: str) -> list[Cell]:
    out, at, kind = [], 0, CODE
    marks = list(_MARKER.finditer(text))
    if text[: marks[0].start()].strip():
        out.append(Cell(CODE, text[: marks[0].start()]))
    for m, end in zip(marks, [*(m.start() for m in marks[1:]), len(text)]):
        kind = MARKDOWN if "[markdown]" in m[1] or "[md]" in m[1] or "[raw]" in m[1] else CODE
        body = text[m.end() : end]
        if kind == MARKDOWN:
            out.append(Cell(kind, re.sub(r"^# ?", "", body, flags=re.M)))
            continue
        made = _OUT_LINE.search(body)
        at = made.start() if made else len(body)
        out.append(Cell(CODE, body[:at]))
        if made:
            out.append(Cell(OUTPUT, re.sub(r"^# ?(?:out: ?)?", "", body[at:], flags=re.M)))
    return out


def _from_flat(text: str) -> list[Cell]:
    """Prompts begin code and results; a paragraph after a blank line without a prompt is prose again."""
    out, at = [], 0
    marks = list(_PROMPT.finditer(text))
    if not marks:
        return [Cell(MARKDOWN, text)]
    if text[: marks[0].start()].strip():
        out.append(Cell(MARKDOWN, text[: marks[0].start()]))
    for m, end in zip(marks, [*(m.start() for m in marks[1:]), len(text)]):
        body = text[m.end() : end]
        if m[1] == "In":
            stop = re.search(r"\n[ \t]*\r?\n(?! {2,}\.\.\.:)", body)
            at = stop.end() if stop else len(body)
            out.append(Cell(CODE, _CONTINUED.sub("", body[:at])))
        else:
            at = 0
            for stop in re.finditer(r"\n[ \t]*\r?\n", body):
                at = stop.end()
                line = body[at : at + 200].split("\n", 1)[0]
                if re.match(r"#+ |[^\W\d_][^\n=]*[a-zà-ÿ]{2}[^\n=]* [^\W\d_]", line) and not re.match(r"(?:\w*Error|Cell In|Traceback|---->|File |Name:|dtype|memory usage|\w+ +\d)", line) and not re.search(r"Error: |\(most recent call last\)", line):
                    break
            else:
                at = len(body)
            out.append(Cell(OUTPUT, body[:at]))
        if body[at:].strip():
            out.append(Cell(MARKDOWN, body[at:]))
    return out


def plain(text: str) -> str:
    """Text without HTML tags, entities and encoded images."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _IMAGE.sub(" ", text) if len(text) > 120 else text
