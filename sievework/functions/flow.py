"""Mutations and races inside functions, with a small control-flow graph per function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from sievework.functions.declare import Callable_, callables, pairs, params_of
from sievework.functions.lex import Source
from sievework.functions.scan import _fact, is_code, scanner

_WORD = r"[A-Za-z_$][\w$]*"
_TARGET = rf"(?<![\w$.])({_WORD})((?:\s*\??\.\s*{_WORD}|\s*\[[^\[\]]*\])*)"
#: Array methods that change their receiver (fixed).
MUTATORS = frozenset("push pop shift unshift splice sort reverse fill copyWithin".split())
_MUTATOR = re.compile(rf"(?<![\w$.])({_WORD})\s*\.\s*({'|'.join(sorted(MUTATORS))})\s*\(")
_ASSIGN_OBJECT = re.compile(rf"\bObject\s*\.\s*assign\s*\(\s*({_WORD})\s*[,)]")
_DELETE = re.compile(rf"\bdelete\s+({_WORD}|this)((?:\s*\??\.\s*{_WORD}|\s*\[[^\[\]]*\])+)")
_ASSIGN = re.compile(rf"{_TARGET}\s*(=(?![=>])|\+=|-=|\*\*=|\*=|/=|%=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|&=|\|=|\^=)")
_READONLY = re.compile(r"^(?:Readonly<.*>|ReadonlyArray<.*>|readonly\s.*|\(\s*readonly\s.*)$", re.DOTALL)


def module_mutables(src: Source) -> set[str]:
    """Names bound by let or var outside all brackets."""
    return _bindings(src, 0, len(src.text))


def _bindings(src: Source, a: int, b: int) -> set[str]:
    masked, match = src.masked, pairs(src)
    out: set[str] = set()
    p = a
    rx = re.compile(rf"(?<![\w$.])(?:let|var)\s+({_WORD})((?:\s*,\s*{_WORD})*)|[(\[{{]")
    while m := rx.search(masked, p, b):
        if m[0] in "([{":
            p = match.get(m.start(), m.start()) + 1
        else:
            out.add(m[1])
            out |= set(re.findall(_WORD, m[2] or ""))
            p = m.end()
    return out


def _near_pragma(src: Source, at: int, tag: str) -> bool:
    return f"sievework:ignore-{tag}" in src.text[max(0, at - 200) : at]


@scanner("mutation")
def mutations(path: str, src: Source) -> Iterator[tuple]:
    """Writes to parameters and to module-level variables through members; one row per enclosing function."""
    if not is_code(path) or path.endswith(".d.ts"):
        return
    shared = module_mutables(src)
    for f in callables(src):
        a, b = f.body
        body = src.masked[a:b]
        params = {p["name"]: p["type"] for p in params_of(src, f)}
        escapes: set[str] = set()
        for m in re.finditer(r"\breturn\b([^;\n]*)|\bthis\s*\.\s*[\w$]+\s*=(?!=)([^;\n]*)", body):
            escapes |= set(re.findall(_WORD, m[1] or m[2] or ""))
        for m in re.finditer(rf"{_WORD}\s*\(", body):
            close = pairs(src).get(a + m.end() - 1)
            if close and close <= b and m[0][:-1].strip() not in ("if", "for", "while", "switch", "catch", "function"):
                escapes |= set(re.findall(_WORD, src.masked[a + m.end() : close]))
        hits = [(m.start(), m.end(), m[1], "object-assign", "Object.assign") for m in _ASSIGN_OBJECT.finditer(body)]
        hits += [(m.start(), m.end(), m[1], "array-mutator", m[2]) for m in _MUTATOR.finditer(body)]
        hits += [(m.start(), m.end(), m[1], "delete-property", "delete") for m in _DELETE.finditer(body)]
        hits += [(m.start(), m.end(), m[1], "property-assignment", m[3]) for m in _ASSIGN.finditer(body) if m[2] and m[1] != "this"]
        for s, e, name, pattern, how in sorted(hits):
            scope = "parameter" if name in params else "module-state" if name in shared else None
            if scope is None or (scope == "parameter" and _READONLY.match(params[name])) or _near_pragma(src, a + s, "mutation"):
                continue
            if scope == "module-state":
                pattern = "shared-state-write"
            out = scope == "parameter" and name in escapes
            n = src.line(a + s)
            yield _fact(src, n, src.line(a + e), name, {"pattern": pattern, "scope": scope, "escapes": int(out), "method": how, "function": f.name or ""}, around=(0, 0))


# --- control flow ---------------------------------------------------------------------------------
class Flow:
    """Basic blocks of a function body: spans of its statements with their block, and successors.

    Nodes belong to the innermost recorded statement around them; the head of a compound statement
    belongs to the block before it, and so do nested functions.
    """

    def __init__(self, src: Source, a: int, b: int):
        self.src, self.masked, self.match = src, src.masked, pairs(src)
        self.next: dict[int, set[int]] = {0: set(), -1: set()}
        self.spans: list[tuple[int, int, int]] = []
        end = self.block(a, b, 0, None, None)
        if end is not None:
            self.edge(end, -1)

    def new(self, *before: int | None) -> int:
        n = len(self.next)
        self.next[n] = set()
        for x in before:
            if x is not None:
                self.edge(x, n)
        return n

    def edge(self, a: int, b: int) -> None:
        self.next[a].add(b)

    def block(self, a: int, b: int, cur: int | None, brk: int | None, cont: int | None) -> int | None:
        p = a
        while True:
            while p < b and (self.masked[p].isspace() or self.masked[p] == ";"):
                p += 1
            if p >= b:
                return cur
            if cur is None:
                cur = self.new()  # code that can't be reached keeps a block of its own
            p, cur = self.statement(p, b, cur, brk, cont)

    def _head(self, p: int, b: int) -> int:
        """Offset after the parenthesised head that follows p."""
        q = self.masked.find("(", p, b)
        return self.match.get(q, b - 1) + 1 if q >= 0 else b

    def statement(self, p: int, b: int, cur: int, brk, cont) -> tuple[int, int | None]:
        masked = self.masked
        m = re.compile(r"(if|else|for|while|do|switch|try|return|throw|break|continue)\b|\{").match(masked, p)
        word = m[0] if m else ""
        if word == "{" and p in self.match:
            return self.match[p] + 1, self.block(p + 1, self.match[p], cur, brk, cont)
        skip = lambda q: q + len(re.compile(r"\s*").match(masked, q)[0])
        if word == "if":
            q = skip(self._head(p, b))
            self.spans.append((p, q, cur))
            q, then = self.statement(q, b, self.new(cur), brk, cont)
            e = skip(q)
            while e < b and masked[e] == ";":
                e = skip(e + 1)
            if masked.startswith("else", e) and not re.match(r"[\w$]", masked[e + 4 : e + 5]):
                q, other = self.statement(skip(e + 4), b, self.new(cur), brk, cont)
            else:
                other = cur
            return q, (None if then is None and other is None else self.new(then, other))
        if word in ("for", "while"):
            q = skip(self._head(p, b))
            head, after = self.new(cur), self.new()
            self.spans.append((p, q, cur))
            self.edge(head, after)
            q, end = self.statement(q, b, self.new(head), after, head)
            if end is not None:
                self.edge(end, head)
            return q, after
        if word == "do":
            body, after = self.new(cur), self.new()
            q, end = self.statement(skip(p + 2), b, body, after, body)
            q = self._head(skip(q), b)
            if end is not None:
                self.edge(end, body)
                self.edge(end, after)
            return q, after
        if word == "switch":
            q = skip(self._head(p, b))
            self.spans.append((p, q, cur))
            after, prev = self.new(cur), None
            close = self.match.get(q, b - 1)
            marks, i = [], q + 1
            while i < close:
                c = re.compile(r"(?<![\w$.])(?:case\b[^:]*|default\s*):").match(masked, i)
                if c:
                    marks.append((i, c.end()))
                    i = c.end()
                else:
                    i = self.match[i] + 1 if masked[i] in "([{" and i in self.match else i + 1
            for k, (_, s) in enumerate(marks):
                e = marks[k + 1][0] if k + 1 < len(marks) else close
                prev = self.block(s, e, self.new(cur, prev), after, cont)
            if prev is not None:
                self.edge(prev, after)
            return close + 1, after
        if word == "try":
            q = skip(p + 3)
            body = self.new(cur)
            q, done = self.statement(q, b, body, brk, cont)
            outs = [done]
            e = skip(q)
            if masked.startswith("catch", e):
                c = re.compile(r"catch\s*(?:\([^)]*\))?\s*").match(masked, e)
                q, caught = self.statement(c.end(), b, self.new(cur, body, done), brk, cont)
                outs.append(caught)
                e = skip(q)
            ends = [x for x in outs if x is not None]
            if masked.startswith("finally", e):
                q, last = self.statement(skip(e + 7), b, self.new(cur, *ends), brk, cont)
                return q, last
            return q, (self.new(*ends) if ends else None)
        q = p
        while q < b and masked[q] != ";":
            if masked[q] in "([{" and q in self.match:
                q = self.match[q]
            elif masked[q] == "\n" and not re.match(r"\s*[.?:+\-*/%&|=<>,)\]]", masked[q:b]) and not re.search(r"[=+\-*/%&|?:,.<>(\[]\s*$", masked[p:q]):
                break
            q += 1
        self.spans.append((p, q, cur))
        if word in ("return", "throw"):
            self.edge(cur, -1)
            return q + 1, None
        if word in ("break", "continue"):
            to = brk if word == "break" else cont
            self.edge(cur, -1 if to is None else to)
            return q + 1, None
        return q + 1, cur

    def of(self, at: int) -> int:
        """Block of the innermost statement around an offset; -1 if there is none."""
        inside = [(e - s, n) for s, e, n in self.spans if s <= at <= e]
        return min(inside)[1] if inside else -1

    def reaches(self, a: int, b: int) -> bool:
        """Whether control can get from block a to b; a block reaches itself."""
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            if x == b:
                return True
            for y in self.next.get(x, ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return False


def _shared_target(name: str, members: str, shared: set[str]) -> str | None:
    if name == "this":
        m = re.match(rf"\s*\??\.\s*({_WORD})", members)
        return f"this.{m[1]}" if m else None
    return name if name in shared else None


_DECL = re.compile(rf"(?:(?:const|let|var)\s+|,\s*)(?:{_WORD}|\{{[^}}]*\}}|\[[^\]]*\])\s*(?::[^=;]+)?=\s*{_TARGET}(?!\s*[\w$(])")
_WRITE = re.compile(rf"{_TARGET}\s*=(?![=>])")


def read_await_write(src: Source, f: Callable_, shared: set[str], strict_order: bool = False) -> Iterator[dict]:
    """Shared targets that an async function reads, then awaits, then writes along some path.

    Within one block the order of lines is not checked unless ``strict_order``.
    """
    if not f.is_async:
        return
    a, b = f.body
    body = src.masked[a:b]
    awaits = [a + m.start() for m in re.finditer(r"(?<![\w$.])await\b", body)]
    if not awaits:
        return
    writes = [(a + m.start(), a + m.end(), t) for m in _WRITE.finditer(body) if (t := _shared_target(m[1], m[2], shared)) and not re.search(r"\b(?:const|let|var)\s*$", body[: m.start()]) and not _near_pragma(src, a + m.start(), "race")]
    reads = [(a + m.start(), t) for m in _DECL.finditer(body) if (t := _shared_target(m[1], m[2], shared))]
    if not writes or not reads:
        return
    inner = (a + 1, b - 1) if src.masked[a] == "{" else (a, b)
    flow = Flow(src, *inner)

    def then(x: int, y: int) -> bool:
        p, q = flow.of(x), flow.of(y)
        if p < 0 or q < 0:
            return False
        if p == q:
            return x < y if strict_order else True
        return flow.reaches(p, q)

    for r, target in reads:
        hit = next(((w, w0, w1) for w in awaits if then(r, w) for w0, w1, t in writes if t == target and then(w, w0)), None)
        if hit:
            w, w0, w1 = hit
            yield {"target": target, "read": src.line(r), "await": src.line(w), "write": src.line(w0), "end": src.line(w1)}


_PARALLEL = re.compile(r"\bPromise\s*\.\s*(?:all|allSettled|race|any)\s*\(\s*")
_EMITTER = re.compile(r"\.\s*(?:on|once|addListener|addEventListener|subscribe)\s*\(")


@scanner("race")
def races(path: str, src: Source) -> Iterator[tuple]:
    """Read-modify-write across an await, parallel arms with one target, async emitter handlers."""
    if not is_code(path) or path.endswith(".d.ts"):
        return
    shared, match, text, masked = module_mutables(src), pairs(src), src.text, src.masked
    fs = callables(src)

    def enclosing(at: int) -> str:
        names = [f.name for f in fs if f.body[0] <= at < f.body[1] and f.name]
        return names[-1] if names else ""

    rows = []
    for f in fs:
        for r in read_await_write(src, f, shared):
            rows.append((f.name or "", r))
    for m in _EMITTER.finditer(masked):
        close = match.get(m.end() - 1)
        inner = [f for f in fs if close and m.end() <= f.start < close and f.body[1] <= close + 1]
        if not inner or not inner[-1].is_async:
            continue
        f = next((x for x in inner if x.body[1] >= close - 2 or masked[x.body[1] : close].strip() in ("", ",")), None)
        if f is None:
            continue
        outer: set[str] = set(shared)
        for a, b in match.items():
            if a < m.start() < b and masked[a] == "{":
                outer |= _bindings(src, a + 1, b)
        for r in read_await_write(src, f, outer):
            rows.append((f.name or enclosing(m.start()), r))
    seen = set()
    for name, r in sorted(rows, key=lambda x: (not x[0], x[1]["read"])):
        key = (r["target"], r["read"], r["write"])
        if key not in seen:
            seen.add(key)
            yield _fact(src, r["read"], r["end"], f"{r['target']}::{r['read']}::{r['write']}", {"pattern": "read-modify-write", "target": r["target"], "await_line": r["await"], "write_line": r["write"], "function": name}, around=(0, 0))
    for m in _PARALLEL.finditer(masked):
        close = match.get(masked.rfind("(", m.start(), m.end()))
        if close is None:
            continue
        p = m.end()
        arms: dict[str, set[int]] = {}
        if masked[p] == "[" and p in match:
            parts = _elements(src, p)
            if len(parts) < 2:
                continue
            for k, (a, b) in enumerate(parts):
                f = next((x for x in fs if a <= x.start and x.body[1] <= b + 1), None)
                if f is None or re.match(rf"\s*{_WORD}\s*\(", masked[a:b]):
                    continue
                for w in _WRITE.finditer(masked, *f.body):
                    if (t := _shared_target(w[1], w[2], shared)) and not _near_pragma(src, w.start(), "race"):
                        arms.setdefault(t, set()).add(k)
            targets = [t for t, ks in arms.items() if len(ks) > 1]
        else:
            mp = re.compile(r"\.\s*map\s*\(\s*$").search(masked[p:close])
            call = next((x for x in fs if p < x.start < close and re.search(r"\.\s*map\s*\(\s*$", masked[p : x.start])), None)
            if call is None or not call.is_async or mp:
                continue
            first = re.search(r"(?<![\w$.])await\b", masked[call.body[0] : call.body[1]])
            if not first:
                continue
            from_line = src.line(call.body[0] + first.start())
            targets = list(dict.fromkeys(t for w in _WRITE.finditer(masked, *call.body) if (t := _shared_target(w[1], w[2], shared)) and src.line(w.start()) >= from_line and not _near_pragma(src, w.start(), "race")))
        n = src.line(m.start())
        for t in targets:
            yield _fact(src, n, src.line(close), f"{t}::{n}", {"pattern": "promise-all", "target": t, "function": enclosing(m.start())}, around=(0, 0))


def _elements(src: Source, opening: int) -> list[tuple[int, int]]:
    from sievework.functions.lex import split_top

    return split_top(src.masked, opening + 1, pairs(src)[opening])
