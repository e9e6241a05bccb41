"""One lexer for all text scanners: masks, balanced spans, lines and ignore pragmas."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cached_property

from sievework.functions.tokens import Call, Tokens

_QUOTED = r"\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_MASKED = re.compile(f"(?P<c>{_COMMENT})|(?P<s>{_QUOTED})", re.DOTALL)
_REGEX = r"(?P<r>(?<=[=(,;:?{\[+\-*%&|^!<>~])(?P<g>\s*)/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)"
_MASKED_REGEX = re.compile(f"{_REGEX}|(?P<c>{_COMMENT})|(?P<s>{_QUOTED})", re.DOTALL)
_NOT_NEWLINE = re.compile(r"[^\n]")
_PAIR = {"{": "}", "(": ")", "[": "]"}


def _blank(s: str) -> str:
    return _NOT_NEWLINE.sub(" ", s)


def mask(text: str, regexes: bool = False) -> str:
    """``text`` with comments, string contents and (on request) regex contents blanked, same length."""

    def sub(m: re.Match) -> str:
        s = m[0]
        if m["c"] is not None:
            return _blank(s)
        if regexes and m.groupdict().get("r") is not None:
            gap = len(m["g"])
            return s[: gap + 1] + _blank(s[gap + 1 :])
        return s[0] + _blank(s[1:-1]) + (s[-1] if len(s) > 1 else "")

    return (_MASKED_REGEX if regexes else _MASKED).sub(sub, text)


class Source:
    """A text with its masks and line index, each computed once when first needed."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def masked(self) -> str:
        """Comments, strings and regular expressions blanked, so that brackets in them don't count."""
        return mask(self.text, True)

    @cached_property
    def masked_lines(self) -> list[str]:
        return self.masked.split("\n")

    @cached_property
    def breaks(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self.text)]

    @cached_property
    def starts(self) -> list[int]:
        """Offset of each line's first character, and of the text's end."""
        return [0, *(b + 1 for b in self.breaks), len(self.text) + 1]

    @cached_property
    def tokens(self) -> Tokens:
        return Tokens(self.text)

    @cached_property
    def calls(self) -> list[Call]:
        return list(self.tokens.calls())

    @cached_property
    def lines(self) -> list[str]:
        return self.text.split("\n")

    def line(self, offset: int) -> int:
        """1-based line of an offset."""
        return bisect_left(self.breaks, offset) + 1

    def snippet(self, first: int, last: int) -> str:
        return "\n".join(self.lines[max(0, first - 1) : last])

    def close(self, opening: int) -> int:
        """Offset of the bracket that closes the one at ``opening``; -1 if none does."""
        masked, a = self.masked, self.text[opening]
        b, depth = _PAIR[a], 0
        for m in re.compile(f"[{re.escape(a)}{re.escape(b)}]").finditer(masked, opening):
            depth += 1 if m[0] == a else -1
            if depth == 0:
                return m.start()
        return -1

    def call_args(self, opening: int) -> list[tuple[int, int]] | None:
        """Spans of the top-level arguments of the call whose parenthesis is at ``opening``."""
        end = self.close(opening)
        return None if end < 0 else split_top(self.masked, opening + 1, end)

    def ignored(self, line: int, detector: str, pragma: str = "sievework:ignore-") -> bool:
        """Whether one of the five lines before carries the pragma for the detector or for all."""
        near = self.lines[max(0, line - 6) : max(0, line - 1)]
        return any(pragma + detector in x or pragma + "all" in x for x in near)


def split_top(masked: str, start: int, end: int, sep: str = ",") -> list[tuple[int, int]]:
    """Spans between the separators at depth zero in ``masked[start:end]``; blank spans are left out."""
    out, depth, p = [], 0, start
    for i in range(start, end):
        c = masked[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == sep and depth == 0:
            out.append((p, i))
            p = i + 1
    out.append((p, end))
    return [(a, b) for a, b in out if masked[a:b].strip()]


def object_entries(src: Source, start: int, end: int) -> dict[str, tuple[int, int]]:
    """Keys of the object literal in ``text[start:end]`` with the spans of their values; spreads are left out."""
    text, masked = src.text, src.masked
    a, b = masked.find("{", start, end), masked.rfind("}", start, end)
    out: dict[str, tuple[int, int]] = {}
    if a < 0 or b < 0 or masked[start:a].strip():
        return out
    for p, q in split_top(masked, a + 1, b):
        m = re.compile(r"\s*(?:([A-Za-z_$][\w$]*)|'([^'\n]*)'|\"([^\"\n]*)\")\s*(:)?").match(text, p, q)
        if m:
            key = next(x for x in m.groups()[:3] if x is not None)
            out.setdefault(key, (m.end(), q) if m[4] else (p, q))
    return out


def literal(text: str) -> str | None:
    """Value of a string or template without substitution."""
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "'\"`" and not (t[0] == "`" and "${" in t):
        return t[1:-1]
    return None


_CONTROL_HEAD = re.compile(r"\b(?:if|else|for|while|switch|try|catch|finally|do)\b\s*(?:\([^)]*\)\s*)?$")


def nesting_depth(source: str | None) -> int:
    """Deepest nesting of control blocks; the word before a brace within 20 characters decides."""
    masked = mask(source or "", True)
    depth = most = 0
    stack: list[bool] = []
    head = _CONTROL_HEAD
    for m in re.finditer(r"[{}]", masked):
        if m[0] == "{":
            control = bool(head.search(masked[max(0, m.start() - 20) : m.start()]))
            stack.append(control)
            depth += control
            most = max(most, depth)
        elif stack:
            depth -= stack.pop()
    return most
