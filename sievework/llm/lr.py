"""LALR(1) tables from grammar text, and the parser that runs them.

A grammar becomes three integer tables: actions by (state, terminal), gotos by (state, nonterminal)
and productions. Where one lookahead token leaves several actions the entry lists all of them, and the
parser follows each on a stack of its own until the tokens decide; equal stacks merge. Stacks are lists,
so nesting is bounded by memory alone. A token that no stack can shift is the first unrecoverable error:
LALR tables never shift beyond a prefix of some sentence.

Grammar text, one rule per line (continued lines are indented)::

    name = item item / item ...      # alternatives, all of them tried
    'x'  TOKEN  CLASS                # terminals; a class stands for any of its members
    x?  x*  x+  (a / b)              # expanded into plain productions
    [flag] alternative               # only in dialects that have the flag; [!flag] in the others
    %empty name ! 'a' 'b'            # derives nothing, unless one of these tokens follows
    %shift 'a' 'b'                   # shifted wherever a shift competes with a reduction
"""

from __future__ import annotations

import re
from itertools import product

_ITEM = re.compile(r"\s*('(?:[^'])+'|\[!?\w+\]|[A-Za-z_]\w*|[()/?*+])")
#: The most plain productions one alternative may expand into before its groups become rules.
_WIDE = 48


class Tables:
    """Parse tables of one grammar; plain lists and dicts, so they pickle into a broadcast."""

    def __init__(self, text: str, flags: frozenset[str] = frozenset(), classes: dict[str, frozenset[str]] | None = None, start: str = "start"):
        self._classes = classes or {}
        self._read(text, flags, start)
        self._automaton()
        self._fill(self._lookaheads())
        for name in [n for n in vars(self) if n.startswith("_")]:
            delattr(self, name)

    # --- grammar text to plain productions ------------------------------------------------
    def _read(self, text: str, flags: frozenset[str], start: str) -> None:
        text = re.sub(r"(?m)(^|\s)#.*$", "", text)
        self._barred: dict[str, set[str]] = {}
        self._prefer: set[str] = set()
        self._rules: dict[str, list[tuple[str, ...]]] = {"^": [(start, "EOF")]}
        for m in re.finditer(r"(?m)^%empty (\w+)(?: !(.*))?$", text):
            self._barred[m[1]] = {t.strip("'") for t in (m[2] or "").split()}
            self._rules[m[1]] = [()]
        for m in re.finditer(r"(?m)^%shift (.*)$", text):
            self._prefer |= {t.strip("'") for t in m[1].split()}
        for m in re.finditer(r"(?m)^(\w+)\s*=((?:.*)(?:\n[ \t]+.*)*)", text):
            self._src, self._at = _ITEM.findall(m[2]), 0
            self._rules[m[1]] = self._expand(self._alternatives(flags))
        self._rules = {n: list(dict.fromkeys(alts)) for n, alts in self._rules.items()}

    def _alternatives(self, flags: frozenset[str]) -> list[list]:
        """Alternatives up to a closing bracket: lists of (item, suffix); a group is a nested list."""
        alts: list[list] = []
        while True:
            seq, keep = [], True
            while self._at < len(self._src) and self._src[self._at] not in "/)":
                t = self._src[self._at]
                self._at += 1
                if t[0] == "[":
                    keep &= (t[2:-1] not in flags) if t[1] == "!" else (t[1:-1] in flags)
                    continue
                x = self._alternatives(flags) if t == "(" else t
                if t == "(":
                    self._at += 1
                suffix = ""
                while self._at < len(self._src) and self._src[self._at] in "?*+":
                    suffix = self._src[self._at]
                    self._at += 1
                seq.append((x, suffix))
            if keep:
                alts.append(seq)
            if self._at < len(self._src) and self._src[self._at] == "/":
                self._at += 1
                continue
            return alts

    def _expand(self, alts: list[list]) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = []
        for seq in alts:
            parts = []
            for x, suffix in seq:
                some = [(x,)] if isinstance(x, str) else self._expand(x)
                if suffix in ("*", "+"):
                    name = self._list(some)
                    some = [(name,)]
                if suffix in ("?", "*"):
                    some = [(), *some]
                parts.append(some)
            wide = 1
            for some in parts:
                wide *= len(some)
            while wide > _WIDE:  # the widest group becomes a rule of its own
                i = max(range(len(parts)), key=lambda j: len(parts[j]))
                full = [p for p in parts[i] if p]
                name = self._named(full)
                wide = wide // len(parts[i]) * (1 + (len(full) < len(parts[i])))
                parts[i] = [(), (name,)] if len(full) < len(parts[i]) else [(name,)]
            out += [sum(choice, ()) for choice in product(*parts)]
        return out

    def _named(self, alts: list[tuple[str, ...]]) -> str:
        name = "|".join(" ".join(a) for a in alts)
        self._rules.setdefault(name, alts)
        return name

    def _list(self, alts: list[tuple[str, ...]]) -> str:
        name = "+".join(("", "|".join(" ".join(a) for a in alts)))
        self._rules.setdefault(name, [a for x in alts for a in (x, (name, *x))])
        return name

    # --- LR(0) automaton ------------------------------------------------------------------
    def _automaton(self) -> None:
        used, todo = {"^"}, ["^"]
        while todo:
            for alt in self._rules[todo.pop()]:
                for x in alt:
                    if x in self._rules and x not in used:
                        used.add(x)
                        todo.append(x)
        self._prods: list[tuple[str, tuple[str, ...]]] = []
        self._of: dict[str, list[int]] = {}
        for name in self._rules:
            if name in used:
                self._of[name] = list(range(len(self._prods), len(self._prods) + len(self._rules[name])))
                self._prods += [(name, alt) for alt in self._rules[name]]
        members: dict[str, tuple[str, ...]] = {}
        for _, alt in self._prods:
            for x in alt:
                if x not in self._rules:
                    members[x] = tuple(self._classes.get(x, ())) or (x.strip("'"),)
        self._members = members
        self.kinds = {t: i for i, t in enumerate(sorted({t for ts in members.values() for t in ts}))}
        self._nt = {n: i for i, n in enumerate(self._of)}
        # items are (production, dot) numbered densely; the symbol after the dot, or None
        base, after = [], []
        for _, alt in self._prods:
            base.append(len(after))
            after += [*alt, None]
        self._base = base
        owner = [p for p, (_, alt) in enumerate(self._prods) for _ in range(len(alt) + 1)]
        self._owner = owner
        starts = {n: [base[p] for p in ps] for n, ps in self._of.items()}
        closed: dict[str, frozenset[int]] = {}

        def opened(n: str) -> frozenset[int]:
            if n not in closed:
                seen, todo, out = {n}, [n], set()
                while todo:
                    for i in starts[todo.pop()]:
                        out.add(i)
                        x = after[i]
                        if x in self._of and x not in seen:
                            seen.add(x)
                            todo.append(x)
                closed[n] = frozenset(out)
            return closed[n]

        first = (base[0],)
        ids, kernels = {first: 0}, [first]
        self._trans: list[dict] = []
        self._done: list[list[int]] = []
        i = 0
        while i < len(kernels):
            items = set(kernels[i])
            for it in kernels[i]:
                if after[it] in self._of:
                    items |= opened(after[it])
            moves: dict[object, list[int]] = {}
            done = []
            for it in sorted(items):
                x = after[it]
                if x is None:
                    done.append(owner[it])
                elif x in self._of:
                    moves.setdefault(x, []).append(it + 1)
                else:
                    for t in members[x]:
                        moves.setdefault(self.kinds[t], []).append(it + 1)
            trans = {}
            for x, kernel in moves.items():
                k = tuple(kernel)
                if k not in ids:
                    ids[k] = len(kernels)
                    kernels.append(k)
                trans[x] = ids[k]
            self._trans.append(trans)
            self._done.append(done)
            i += 1

    # --- LALR(1) lookaheads, by the relations of DeRemer and Pennello -----------------------
    def _lookaheads(self) -> dict[tuple[int, int], int]:
        nullable: set[str] = set()
        moved = True
        while moved:
            moved = False
            for name, alt in self._prods:
                if name not in nullable and all(x in nullable for x in alt):
                    nullable.add(name)
                    moved = True
        nodes = [(s, x) for s, trans in enumerate(self._trans) for x in trans if isinstance(x, str)]
        number = {n: i for i, n in enumerate(nodes)}
        sets = [0] * len(nodes)
        into: list[list[int]] = [[] for _ in nodes]  # edges along which sets flow

        def spread() -> None:
            todo = [i for i, s in enumerate(sets) if s]
            while todo:
                i = todo.pop()
                s = sets[i]
                for j in into[i]:
                    if s & ~sets[j]:
                        sets[j] |= s
                        todo.append(j)

        for i, (s, x) in enumerate(nodes):
            r = self._trans[s][x]
            for y in self._trans[r]:
                if isinstance(y, str):
                    if y in nullable:
                        into[number[r, y]].append(i)
                else:
                    sets[i] |= 1 << y
        spread()
        into = [[] for _ in nodes]
        back: dict[tuple[int, int], list[int]] = {}
        reach: dict[tuple[int, str], tuple[int, ...]] = {}
        trans = self._trans

        def step(s: int, x: str) -> tuple[int, ...]:
            if (s, x) not in reach:
                got = trans[s]
                reach[s, x] = (got[x],) if x in self._of else tuple({got[k] for t in self._members[x] if (k := self.kinds[t]) in got})
            return reach[s, x]

        for i, (s, x) in enumerate(nodes):
            for p in self._of[x]:
                alt = self._prods[p][1]
                states = {s}
                for j, y in enumerate(alt):
                    if y in self._of and all(z in nullable for z in alt[j + 1 :]):
                        for q in states:
                            into[i].append(number[q, y])
                    states = {r for q in states for r in step(q, y)}
                for q in states:
                    back.setdefault((q, p), []).append(i)
        spread()
        look: dict[tuple[int, int], int] = {}
        for (q, p), where in back.items():
            for i in where:
                look[q, p] = look.get((q, p), 0) | sets[i]
        return look

    # --- tables -----------------------------------------------------------------------------
    def _fill(self, look: dict[tuple[int, int], int]) -> None:
        """Actions: shift to s as s + 1, reduce p as -p, several as an index above ``fork``; 0 is an error."""
        width = self.width = len(self.kinds)
        n = len(self._trans)
        self.fork = n + 1
        self.forks: list[tuple[int, ...]] = []
        self.prods = [(self._nt[name], len(alt)) for name, alt in self._prods]
        self.ntw = len(self._nt)
        self.goto = {s * self.ntw + self._nt[x]: r for s, trans in enumerate(self._trans) for x, r in trans.items() if isinstance(x, str)}
        barred = {name: sum(1 << self.kinds[t] for t in ts if t in self.kinds) for name, ts in self._barred.items()}
        prefer = {self.kinds[t] for t in self._prefer if t in self.kinds}
        self.action = [0] * (n * width)
        many: dict[int, list[int]] = {}
        for s, trans in enumerate(self._trans):
            for x, r in trans.items():
                if not isinstance(x, str):
                    self.action[s * width + x] = r + 1
            for p in self._done[s]:
                ahead = look.get((s, p), 0) & ~barred.get(self._prods[p][0], 0)
                while ahead:
                    bit = ahead & -ahead
                    ahead ^= bit
                    x = bit.bit_length() - 1
                    old = self.action[s * width + x]
                    if not old:
                        self.action[s * width + x] = -p
                    elif not (old > 0 and x in prefer):
                        many.setdefault(s * width + x, [old]).append(-p)
        for at, acts in many.items():
            self.action[at] = self.fork + 1 + len(self.forks)
            self.forks.append(tuple(acts))
        self.accept = self._trans[0][self._rules["^"][0][0]]
        self.names = sorted(self.kinds, key=self.kinds.get)
        self.states = n


class Parser:
    """Runs tables over token kinds. ``insert`` names a token that may be put before an offending one."""

    def __init__(self, tables: Tables, insert: str | None = None):
        self.t = tables
        self.insert = tables.kinds[insert] if insert else -1
        self.unit: dict[int, int] = {}

    def parse(self, kinds: list[int], may: list[bool] | None = None) -> int:
        """Index of the first token that no stack can shift; -1 if all can. The last token is EOF.

        ``may[i]`` allows the inserted token before token i.
        """
        t = self.t
        action, goto, prods, width, ntw, fork, unit = t.action, t.goto, t.prods, t.width, t.ntw, t.fork, self.unit
        states = t.states
        stack = [0]
        push, top = stack.append, 0
        i, n = 0, len(kinds)
        while i < n:
            tok = kinds[i]
            if tok < 0:
                return i
            a = action[top * width + tok]
            if 0 < a < fork:
                top = a - 1
                push(top)
                i += 1
            elif a < 0:
                lhs, size = prods[-a]
                if size == 1:  # a chain of unit reductions, remembered by (below, top, token)
                    below = stack[-2]
                    key = (below * states + top) * width + tok
                    got = unit.get(key)
                    if got is None:
                        got = top
                        while a < 0 and prods[-a][1] == 1:
                            got = goto[below * ntw + prods[-a][0]]
                            a = action[got * width + tok]
                        unit[key] = got
                    stack[-1] = top = got
                else:
                    if size:
                        del stack[-size:]
                    top = goto[stack[-1] * ntw + lhs]
                    push(top)
            elif a or (may is not None and may[i]):
                i, stack = self._forked(stack, kinds, i, may)
                if stack is None:
                    return i
                push, top = stack.append, stack[-1]
            else:
                return i
        return -1

    def _forked(self, stack: list[int], kinds: list[int], i: int, may: list[bool] | None) -> tuple[int, list[int] | None]:
        """Follows several stacks from token i until one is left: (next token, it), or (the error, None)."""
        heads = [stack]
        n = len(kinds)
        while i < n:
            tok = kinds[i]
            after = self._advance(heads, tok) if tok >= 0 else []
            if not after and tok >= 0 and may is not None and may[i]:
                after = self._advance(self._advance(heads, self.insert), tok)
            if not after:
                return i, None
            heads = after
            i += 1
            if len(heads) == 1:
                return i, heads[0]
        return i, heads[0]

    def _advance(self, heads: list[list[int]], tok: int) -> list[list[int]]:
        """All stacks after ``tok`` is shifted, equal ones merged; the given stacks stay as they are."""
        t = self.t
        action, goto, prods, width, ntw, fork = t.action, t.goto, t.prods, t.width, t.ntw, t.fork
        out: dict[tuple[int, ...], list[int]] = {}
        todo = [(list(h), action[h[-1] * width + tok]) for h in reversed(heads)]
        while todo:
            st, a = todo.pop()
            while a < 0:
                lhs, size = prods[-a]
                if size:
                    del st[-size:]
                st.append(goto[st[-1] * ntw + lhs])
                a = action[st[-1] * width + tok]
            if a > fork:
                todo += [(list(st), b) for b in t.forks[a - fork - 1]]
            elif a:
                st.append(a - 1)
                out.setdefault(tuple(st), st)
        return list(out.values())
