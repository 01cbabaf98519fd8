"""Packrat parsing of expression grammars over tokens with source offsets.

Grammar text: ``Name <- expression`` with sequences, ordered choice ``/``, ``?``, ``*``, ``+``, ``!`` and
``&``, parentheses, literals in quotes, token kinds in capitals, ``(..)``, ``[..]``, ``{..}`` for a balanced
bracket group, ``Token`` for any one token, and ``label=item`` to keep where an item was found. Every rule is tried at most once at
each position.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_ITEM = re.compile(r"'[^']*'|\(\.\.\)|\[\.\.\]|\{\.\.\}|[\w]+=|\w+|[/?*+!&()]")
_BRACKETS = frozenset("()[]{}")
_GROUPS = {"(..)": "(", "[..]": "[", "{..}": "{"}

#: End of a match and what it kept, as (label, from, to) triples; None if there is none.
Match = tuple[int, tuple]


class Tokens:
    """Tokens of a text: kind, string, offset; closing positions of brackets. Reserved words are of kind KEY, not ID.

    ``short`` says that a match asked for a token, or a closing bracket, behind the last one.
    """

    def __init__(self, kinds: list[str], strings: list[str], offsets: list[int], reserved: set[str] = frozenset()):
        self.kinds, self.strings, self.offsets, self.reserved = kinds, strings, offsets, reserved
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i in [i for i, s in enumerate(strings) if s in _BRACKETS]:
            if strings[i] in "([{":
                stack.append(i)
            elif stack:
                self.close[stack.pop()] = i
        self.memo: dict = {}
        self.short = False

    def behind(self) -> None:
        """What a terminal gives behind the last token."""
        self.short = True


class Peg:
    """A compiled grammar."""

    def __init__(self, text: str, kinds: dict[str, str]):
        self._kinds = kinds
        self._rules: dict[str, Callable] = {}
        for block in re.split(r"\n(?=\w+ <- )", text.strip()):
            name, body = re.match(r"(\w+) <- (.*)", block, re.S).groups()
            items = _ITEM.findall(body)
            node, at = self._choice(items, 0)
            if at != len(items):
                raise ValueError(f"{name}: {items[at:]}")
            self._rules[name] = node

    def match(self, rule: str, tokens: Tokens, at: int) -> Match | None:
        """The match of a rule at a position, from the memo if it was tried before."""
        key = (rule, at)
        if key not in tokens.memo:
            tokens.memo[key] = self._rules[rule](tokens, at)
        return tokens.memo[key]

    def _choice(self, items: list[str], at: int):
        options = []
        while True:
            node, at = self._sequence(items, at)
            options.append(node)
            if at >= len(items) or items[at] != "/":
                break
            at += 1
        if len(options) == 1:
            return options[0], at

        def choose(tokens: Tokens, i: int):
            for option in options:
                found = option(tokens, i)
                if found is not None:
                    return found
            return None

        return choose, at

    def _sequence(self, items: list[str], at: int):
        parts = []
        while at < len(items) and items[at] not in ("/", ")"):
            part, at = self._item(items, at)
            parts.append(part)
        if len(parts) == 1:
            return parts[0], at

        def follow(tokens: Tokens, i: int):
            kept: tuple = ()
            for part in parts:
                found = part(tokens, i)
                if found is None:
                    return None
                i = found[0]
                if found[1]:
                    kept += found[1]
            return i, kept

        return follow, at

    def _item(self, items: list[str], at: int):
        token = items[at]
        if token in "!&":
            inner, at = self._item(items, at + 1)
            wanted = token == "&"
            return (lambda tokens, i: (i, ()) if (inner(tokens, i) is not None) == wanted else None), at
        if token.endswith("="):
            inner, at = self._item(items, at + 1)
            label = token[:-1]

            def keep(tokens: Tokens, i: int):
                found = inner(tokens, i)
                return None if found is None else (found[0], (*found[1], (label, i, found[0])))

            return keep, at
        at += 1
        if token == "(":
            node, at = self._choice(items, at)
            at += 1
        else:
            node = self._terminal(token)
        if at < len(items) and items[at] in "?*+":
            node, at = self._repeat(node, items[at]), at + 1
        return node, at

    def _terminal(self, token: str):
        if token in _GROUPS:
            opening = _GROUPS[token]

            def group(tokens: Tokens, i: int):
                if i >= len(tokens.strings):
                    return tokens.behind()
                if tokens.strings[i] != opening:
                    return None
                end = tokens.close.get(i)
                return tokens.behind() if end is None else (end + 1, ())

            return group
        if token[0] == "'":
            wanted = token[1:-1]
            return lambda tokens, i: tokens.behind() if i >= len(tokens.strings) else (i + 1, ()) if tokens.strings[i] == wanted and tokens.kinds[i] != "s" else None
        if token == "Token":
            return lambda tokens, i: (i + 1, ()) if i < len(tokens.kinds) else tokens.behind()
        if token in ("ID", "KEY"):
            free, word = token == "ID", self._kinds["ID"]
            return lambda tokens, i: tokens.behind() if i >= len(tokens.kinds) else (i + 1, ()) if tokens.kinds[i] == word and (tokens.strings[i] not in tokens.reserved) == free else None
        if token in self._kinds:
            kind = self._kinds[token]
            return lambda tokens, i: tokens.behind() if i >= len(tokens.kinds) else (i + 1, ()) if tokens.kinds[i] == kind else None
        return lambda tokens, i: self.match(token, tokens, i)

    @staticmethod
    def _repeat(node, sign: str):
        def repeat(tokens: Tokens, i: int):
            kept: tuple = ()
            n = 0
            while sign != "?" or n == 0:
                found = node(tokens, i)
                if found is None or found[0] == i:
                    break
                i, n = found[0], n + 1
                if found[1]:
                    kept += found[1]
            return (i, kept) if n or sign != "+" else None

        return repeat
