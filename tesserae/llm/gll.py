"""A generalised LL recogniser over a graph-structured stack, with several dialects in one run.

A text is first folded along its brackets. The content of a bracket pair is recognised once for every
nonterminal that may stand between such brackets, and the pair becomes one symbol that carries which of
them fit in which dialects. Contents that fit alike fold to the same symbol, so most bracket pairs and
statements of a corpus are met again, and a bounded memo answers for them. This is exact as every rule
holds both brackets of a pair.

Grammar text: ``Name : alternative | alternative`` with ``?``, ``*``, ``+`` and parentheses; literals in
quotes, token classes in capitals, ``(:Name:)``, ``[:Name:]``, ``{:Name:}`` for a bracket pair with such a
content, ``@dialect,dialect`` before an alternative of some dialects only, ``^`` before one that does not begin
with braces. ``Name :: Item`` is a list of
items whose statements may be recognised one by one. A nonterminal ``Anything`` stands for any tokens and
brackets in every dialect; it is taken to fit without a run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

END = "\x03"
#: Characters from here on stand for folded bracket pairs.
FOLDED = "\U000f0000"
#: Entries of a memo after which it is dropped.
MEMO = 200_000
#: Tokens from which on a text is looked through for repeats of several tokens.
LONG = 160

_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|[({\[<]:\s*\w+\s*:[)}\]>]|@[\w,]+|\w+|[|?*+()^]")


class Alphabet:
    """Characters that stand for terminals and for folded bracket pairs."""

    def __init__(self):
        self.chars: dict[str, str] = {}

    def char(self, name: str) -> str:
        """The character of a literal or token class."""
        return self.chars.setdefault(name, chr(0x100 + len(self.chars)))


class Grammar:
    """A compiled grammar: recognises strings over its alphabet."""

    def __init__(self, text: str, dialects: list[str], classes: dict[str, list[str]] | None = None, ended: Iterable[str] = ()):
        """``classes``: tokens of each class. A token that the rules also name has its own character, which counts as the class too. ANY is any terminal."""
        self.alphabet = Alphabet()
        self.dialects = {d: 1 << i for i, d in enumerate(dialects)}
        self.all = (1 << len(dialects)) - 1
        self.names: dict[str, int] = {}
        self.alternatives: list[tuple] = []
        self.masks: list[int] = []
        self.bare: set[int] = set()
        self.rules: list[list[int]] = []
        self.contents: dict[str, list[int]] = {}
        self.lists: dict[int, int] = {}
        self._folded: dict[tuple, str] = {}
        self._fits: dict[str, tuple[str, dict[int, int]]] = {}
        self._memo: dict = {}
        self._seen: tuple = (None, [])
        self._parts: dict[str, list[str]] = {}
        for block in re.split(r"\n(?=\w+ ?::? )", text.strip()):
            name, kind, body = re.match(r"\s*(\w+) ?(::?) (.*)", block, re.S).groups()
            if kind == "::":
                item = self._nonterminal(body.strip())
                self.lists[self._nonterminal(name)] = self._several(item)
            else:
                tokens = _TOKEN.findall(body)
                self._alternatives(self._nonterminal(name), tokens, 0)
        missing = [n for n, i in self.names.items() if not self.rules[i] and i not in self.lists]
        if missing:
            raise ValueError(f"no rule for {missing}")
        self._predict(classes or {})
        #: Contents that know an end mark besides lists.
        self._ended = {i for n, i in self.names.items() if n in ended}
        # Of equal items with these separators, no rule of the grammars tells four from five: none counts beyond three.
        separators = "".join(re.escape(c) for t, c in self.alphabet.chars.items() if t in (",", "+", "NL"))
        self._repeats = re.compile(rf"(.[{separators}])\1{{4,}}", re.S) if separators else None
        self._long_repeats = re.compile(rf"(.{{1,24}}?[{separators}])\1{{4,}}", re.S) if separators else None

    # Compilation

    def _nonterminal(self, name: str) -> int:
        if name not in self.names:
            self.names[name] = len(self.rules)
            self.rules.append([])
        return self.names[name]

    def _fresh(self) -> int:
        return self._nonterminal(f"#{len(self.rules)}")

    def _several(self, item: int) -> int:
        made = self._fresh()
        self._add(made, [("S", item), ("T", END)], self.all)
        self._add(made, [("S", item)], self.all)
        return made

    def _add(self, rule: int, items: list, mask: int) -> None:
        self.rules[rule].append(len(self.alternatives))
        self.alternatives.append(tuple(items))
        self.masks.append(mask)

    def _alternatives(self, rule: int, tokens: list[str], at: int) -> int:
        items, mask = [], self.all
        while True:
            token = tokens[at] if at < len(tokens) else None
            if token in (None, "|", ")"):
                self._add(rule, items, mask)
                if token != "|":
                    return at
                items, mask = [], self.all
            elif token == "^":
                self.bare.add(len(self.alternatives))
            elif token[0] == "@":
                mask = sum(self.dialects[d] for d in token[1:].split(","))
            elif token in "?*+":
                last = items.pop()
                inner = last[1] if last[0] == "N" else self._wrap(last)
                if token == "?":
                    made = self._fresh()
                    self._add(made, [("N", inner)], self.all)
                    self._add(made, [], self.all)
                    items.append(("N", made))
                else:
                    items += ([("N", inner)] if token == "+" else []) + [("S", inner)]
            elif token == "(":
                made = self._fresh()
                at = self._alternatives(made, tokens, at + 1)
                items.append(("N", made))
            elif token[0] == "'":
                items.append(("T", self.alphabet.char(re.sub(r"\\(.)", r"\1", token[1:-1]))))
            elif token[1:2] == ":":
                content = self._nonterminal(token[2:-2].strip())
                known = self.contents.setdefault(token[0], [])
                if content not in known:
                    known.append(content)
                items.append(("G", (token[0], content)))
            elif token.isupper() or token == "END":
                items.append(("T", END if token == "END" else token))
            else:
                items.append(("N", self._nonterminal(token)))
            at += 1

    def _wrap(self, item: tuple) -> int:
        made = self._fresh()
        self._add(made, [item], self.all)
        return made

    def _predict(self, classes: dict[str, list[str]]) -> None:
        """Terminal sets, first sets, and the alternatives to try before each character."""
        named = lambda arg: arg if len(arg) == 1 else self.alphabet.char(arg)
        for items in self.alternatives:
            for code, arg in items:
                if code == "T":
                    named(arg)
        own = dict(self.alphabet.chars)
        unions = {name: {self.alphabet.char(name), *(own[t] for t in tokens if t in own)} for name, tokens in classes.items()}
        unions["ANY"] = {*self.alphabet.chars.values()}
        #: Characters of literal tokens.
        self.literals = {t: self.alphabet.char(c) for c, tokens in reversed(classes.items()) for t in tokens} | {t: c for t, c in own.items() if not t.isupper()}
        for i, items in enumerate(self.alternatives):
            self.alternatives[i] = tuple(("T", frozenset(unions.get(arg, {named(arg)}))) if code == "T" else (code, arg) for code, arg in items)
        first = [set() for _ in self.rules]
        empty = [False] * len(self.rules)

        def of(items: tuple) -> tuple[set, bool]:
            found: set = set()
            for code, arg in items:
                if code == "T":
                    return found | arg, False
                if code == "G":
                    return found | {arg[0]}, False
                found |= first[arg]
                if code == "N" and not empty[arg]:
                    return found, False
            return found, True

        changed = True
        while changed:
            changed = False
            for r, alts in enumerate(self.rules):
                for a in alts:
                    found, none = of(self.alternatives[a])
                    if not found <= first[r] or none and not empty[r]:
                        first[r] |= found
                        empty[r] = empty[r] or none
                        changed = True
        # What may stand anywhere in a derivation, but for the insides of brackets.
        self.reach: list[set] = [set() for _ in self.rules]
        changed = True
        while changed:
            changed = False
            for r, alts in enumerate(self.rules):
                size = len(self.reach[r])
                for a in alts:
                    for code, arg in self.alternatives[a]:
                        self.reach[r] |= arg if code == "T" else {arg[0]} if code == "G" else self.reach[arg]
                changed = changed or len(self.reach[r]) > size
        #: Derives every content: see :meth:`fold`.
        self._anything = self.names.get("Anything")
        self.predicted: list[dict] = []
        self.always: list[tuple] = []
        for alts in self.rules:
            table: dict = {}
            nullable = tuple(a for a in alts if of(self.alternatives[a])[1])
            for a in alts:
                for c in of(self.alternatives[a])[0] - ({"{"} if a in self.bare else set()):
                    table.setdefault(c, set()).add(a)
            self.predicted.append({c: tuple(sorted({*s, *nullable})) for c, s in table.items()})
            self.always.append(nullable)

    # Recognition

    def recognise(self, start: int, text: str, mask: int | None = None) -> int:
        """The dialects in which ``text`` derives from ``start``, as a mask."""
        fits, predicted, always, alternatives, masks = self._fits, self.predicted, self.always, self.alternatives, self.masks
        if text is not self._seen[0]:  # often one content is held against several nonterminals
            self._seen = text, [*[fits[c][0] if c >= FOLDED else c for c in text], ""]
        look = self._seen[1]
        n = len(text)
        # A stack node: edges to return to, positions at which it ended, dialects it began in.
        root = ({}, {}, [0])
        stack = {(start, 0): root}
        root[2][0] = mask or self.all
        begun = mask or self.all
        work = [(a, 0, root, 0, begun & masks[a]) for a in predicted[start].get(look[0], always[start])]
        seen: dict = {}
        while work:
            alt, k, node, i, m = work.pop()
            items = alternatives[alt]
            while True:
                if k == len(items):
                    new = m & ~node[1].get(i, 0)
                    if new:
                        node[1][i] = node[1].get(i, 0) | new
                        for (ra, rk, _), (parent, em) in node[0].items():
                            if em & new:
                                work.append((ra, rk, parent, i, em & new))
                    break
                code, arg = items[k]
                if code == "T":
                    if look[i] not in arg:
                        break
                    i += 1
                    k += 1
                elif code == "G":
                    if look[i] != arg[0]:
                        break
                    m &= fits[text[i]][1].get(arg[1], 0)
                    if not m:
                        break
                    i += 1
                    k += 1
                else:
                    key = (alt, k, id(node), i)
                    old = seen.get(key, 0)
                    m &= ~old
                    if not m:
                        break
                    seen[key] = old | m
                    after = k + 1
                    if code == "S":  # a repetition: go on behind it, and return to it
                        work.append((alt, k + 1, node, i, m))
                        after = k
                        tried = predicted[arg].get(look[i], ())
                    else:
                        tried = predicted[arg].get(look[i], always[arg])
                    if not tried:
                        break
                    child = stack.get((arg, i))
                    if child is None:
                        child = stack[arg, i] = ({}, {}, [0])
                    edge = (alt, after, id(node))
                    held = child[0].get(edge)
                    child[0][edge] = (node, m | (held[1] if held else 0))
                    for j, pm in list(child[1].items()):
                        if pm & m and (code == "N" or j > i):
                            work.append((alt, after, node, j, pm & m))
                    need = m & ~child[2][0]
                    if need:
                        child[2][0] |= need
                        for a in tried:
                            if need & masks[a]:
                                work.append((a, 0, child, i, need & masks[a]))
                    break
        return root[1].get(n, 0)

    def fits(self, start: int, text: str, segments) -> int:
        """As :meth:`recognise`, through the memo; a list is recognised statement by statement."""
        item = self.lists.get(start)
        if item is None:
            return self._known(start, text + END if start in self._ended else text)
        mask = self.all
        parts = self._parts.get(text)
        if parts is None:
            self._parts = {text: (parts := [*dict.fromkeys(segments(text))])}
        for part in parts:
            mask &= self._known(item, part)
            if not mask:
                break
        return mask

    def collapsed(self, text: str) -> str:
        """A text with four of any more equal items in a row; items of several tokens, as in tables of data, are looked for in long texts."""
        if self._repeats is None:
            return text
        text = self._repeats.sub(r"\1\1\1\1", text)
        return text if len(text) < LONG else self._long_repeats.sub(r"\1\1\1\1", text)

    def _known(self, start: int, text: str) -> int:
        first = text[:1]
        if first >= FOLDED:
            first = self._fits[first][0]
        if first not in self.predicted[start] and not self.always[start]:
            return 0
        key = (start, text)
        found = self._memo.get(key)
        if found is None:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            reach, fits = self.reach[start], self._fits
            possible = all((fits[c][0] if c >= FOLDED else c) in reach for c in set(text))
            found = self._memo[key] = self.recognise(start, text) if possible else 0
        return found

    def fold(self, bracket: str, content: str, segments) -> str | None:
        """The symbol of a bracket pair with this content, or None if nothing that may stand there fits."""
        content = self.collapsed(content)
        key = (bracket, content)
        found = self._memo.get(key)
        if found is None:
            fit = {c: m for c in self.contents.get(bracket, ()) if (m := self.all if c == self._anything else self.fits(c, content, segments))}
            if not fit:
                return None
            shape = (bracket, tuple(sorted(fit.items())))
            found = self._folded.get(shape)
            if found is None:
                found = self._folded[shape] = chr(0xF0000 + len(self._folded))
                self._fits[found] = (bracket, fit)
            self._memo[key] = found
        return found

    def accepts(self, start: str, tokens: str, pairs: dict[str, str], segments) -> int:
        """Dialects of a whole text: ``tokens`` with opening and closing bracket characters, ``pairs`` from opening to closing."""
        closers = set(pairs.values())
        stack: list[tuple[str, list[str]]] = []
        here: list[str] = []
        for c in tokens:
            if c in pairs:
                stack.append((c, here))
                here = []
            elif c in closers:
                if not stack or pairs[stack[-1][0]] != c:
                    return 0
                bracket, outer = stack.pop()
                symbol = self.fold(bracket, "".join(here), segments)
                if symbol is None:
                    return 0
                outer.append(symbol)
                here = outer
            else:
                here.append(c)
        if stack:
            return 0
        return self.fits(self.names[start], self.collapsed("".join(here)), segments)
