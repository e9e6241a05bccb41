"""Token stream of script-like code with its brackets paired, and the calls found in it.

Scanners ask for structure (which call, which argument, which block, what is assigned) instead of matching
windows of text. Nothing is compiled, so code that doesn't parse still yields what can be told.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<gap>\s++)
    |(?P<comment>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))
    |(?P<word>[A-Za-z_$\u0080-\U0010ffff][\w$]*+)
    |(?P<number>(?:\d[\w]*+(?:\.\d[\w]*+)?|\.\d[\w]*+)(?:(?<=[eE])[+-]\d+)?)
    |(?P<string>"(?:\\.|[^"\\\n])*+(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*+(?:'|(?=\n)|\Z))
    |(?P<template>`(?:\\.|[^`\\])*+(?:`|\Z))
    |(?P<op>\?\.(?!\d)|=>|\.\.\.|[=!]==?|<=|>=|&&=?|\|\|=?|\?\?=?|\+\+|--|\*\*=?|[-+*/%&|^]=|.)""",
    re.DOTALL | re.VERBOSE,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
#: Words after which an operand starts, so that a slash opens a regular expression and a minus is a sign.
BEFORE_OPERAND = frozenset("return typeof in of case delete void throw yield await new instanceof else do".split())
#: Words that take a parenthesis without being called.
_HEADS = frozenset("if for while switch catch with return typeof in of case delete void throw yield await new instanceof else do function super".split())
_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = frozenset(_OPEN.values())
ASSIGNING = frozenset(("=", "+=", "-=", "*=", "/=", "??=", "||=", "&&="))
BINDERS = frozenset(("const", "let", "var"))


@dataclass(slots=True)
class Call:
    """A call: its dotted callee, where it starts, and the token spans of its arguments.

    A call of a call's result (``it.each(rows)(...)``) has "()" in its callee.
    """

    parts: tuple[str, ...]
    start: int
    opening: int
    closing: int
    args: list[tuple[int, int]]
    new: bool


class Tokens:
    """Parallel lists over the tokens; ``pair`` is a bracket's partner or -1, ``up`` the opener around a token or -1."""

    def __init__(self, text: str):
        self.source = text
        self.text: list[str] = []
        self.kind: list[str] = []
        self.at: list[int] = []
        self.pair: list[int] = []
        self.up: list[int] = []
        self.comments: list[tuple[int, str]] = []
        stack: list[int] = []
        p, n = 0, len(text)
        while p < n:
            m = _TOKEN.match(text, p)
            kind, t = m.lastgroup, m[0]
            if kind == "op" and t[0] == "/" and self._operand_next() and (r := _REGEX.match(text, p)):
                kind, t = "regex", r[0]
            start, p = p, p + len(t)
            if kind == "gap":
                continue
            if kind == "comment":
                self.comments.append((start, t))
                continue
            i = len(self.text)
            pair = -1
            if kind == "op" and t in _CLOSE and stack and _OPEN[self.text[stack[-1]]] == t:
                pair = stack.pop()
                self.pair[pair] = i
            self.text.append(t)
            self.kind.append(kind)
            self.at.append(start)
            self.pair.append(pair)
            self.up.append(stack[-1] if stack else -1)
            if kind == "op" and t in _OPEN:
                stack.append(i)

    def __len__(self) -> int:
        return len(self.text)

    def _operand_next(self) -> bool:
        if not self.text:
            return True
        k, t = self.kind[-1], self.text[-1]
        return t in BEFORE_OPERAND if k == "word" else k == "op" and t not in _CLOSE and t not in ("++", "--")

    def get(self, i: int) -> str:
        """Text of token ``i``, empty outside the stream."""
        return self.text[i] if 0 <= i < len(self.text) else ""

    def end(self, i: int) -> int:
        return self.at[i] + len(self.text[i])

    def chain(self, last: int) -> tuple[int, tuple[str, ...]]:
        """The dotted name that ends at word ``last``: its first token and its parts."""
        parts = [self.text[last]]
        while self.get(last - 1) in (".", "?.") and last > 1 and self.kind[last - 2] == "word":
            last -= 2
            parts.append(self.text[last])
        return last, tuple(reversed(parts))

    def forward(self, first: int) -> tuple[int, tuple[str, ...]]:
        """The dotted name that starts at word ``first``: the token after it and its parts."""
        parts = [self.text[first]]
        i = first + 1
        while self.get(i) == "." and i + 1 < len(self.text) and self.kind[i + 1] == "word":
            parts.append(self.text[i + 1])
            i += 2
        return i, tuple(parts)

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Spans between the commas directly inside tokens a to b (exclusive); empty ones are left out."""
        out, start, i = [], a, a
        while i < b:
            if self.text[i] == "," and self.kind[i] == "op":
                out.append((start, i))
                start = i + 1
            elif self.kind[i] == "op" and self.text[i] in _OPEN and i < self.pair[i] < b:
                i = self.pair[i]
            i += 1
        out.append((start, b))
        return [(x, y) for x, y in out if x < y]

    def calls(self) -> Iterator[Call]:
        ended: dict[int, Call] = {}
        for i, t in enumerate(self.text):
            if t != "(" or self.kind[i] != "op" or not i or self.pair[i] < 0:
                continue
            if self.kind[i - 1] == "word" and (self.text[i - 1] not in _HEADS or self.get(i - 2) in (".", "?.")):
                first, parts = self.chain(i - 1)
            elif self.text[i - 1] == ")" and i - 1 in ended:
                before = ended[i - 1]
                first, parts = before.start, (*before.parts, "()")
            else:
                continue
            if self.get(first - 1) == "function":
                continue
            call = Call(parts, first, i, self.pair[i], self.split(i + 1, self.pair[i]), self.get(first - 1) == "new")
            ended[call.closing] = call
            yield call

    def one(self, span: tuple[int, int], *kinds: str) -> str | None:
        """Contents of a string or template that is the whole span."""
        a, b = span
        if b - a == 1 and self.kind[a] in (kinds or ("string", "template")) and len(self.text[a]) > 1:
            return self.text[a][1:-1]
        return None

    def members(self, brace: int) -> dict[str, tuple[int, int]]:
        """Keys of the object literal at ``brace`` with the spans of their values; spreads are left out."""
        out: dict[str, tuple[int, int]] = {}
        for a, b in self.split(brace + 1, self.pair[brace]) if self.pair[brace] > 0 else ():
            if self.kind[a] in ("word", "string"):
                key = self.text[a] if self.kind[a] == "word" else self.text[a][1:-1]
                out.setdefault(key, (a + 2, b) if self.get(a + 1) == ":" and a + 2 < b else (a, b))
        return out

    def substitutions(self, i: int) -> str:
        """Text of what the template at ``i`` substitutes."""
        out, t, p = [], self.text[i], 0
        while (p := t.find("${", p)) >= 0:
            depth, q = 1, p + 2
            while q < len(t) and depth:
                depth += (t[q] == "{") - (t[q] == "}")
                q += 1
            out.append(t[p + 2 : q - 1])
            p = q
        return " ".join(out)
