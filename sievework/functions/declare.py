"""Declarations of TypeScript and JavaScript texts: callables, symbols and import records.

Works on the masked text of ``lex.Source`` with bracket pairs. Annotated types are exact; an
unannotated parameter has the type ``any`` and an unannotated return type is ``unknown``, as there
is no type checker here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

from sievework.functions.lex import Source, split_top

_CONTROL = frozenset("if for while switch catch with return function typeof await new delete void do else in of case throw yield import super".split())
_FUNCTION = re.compile(r"(?<![\w$.])(async\s+)?function\b\s*(\*)?\s*([A-Za-z_$][\w$]*)?\s*", re.ASCII)
_ARROW = re.compile(r"=>")
_METHOD = re.compile(r"(?<![\w$.])((?:(?:public|private|protected|static|abstract|override|readonly|async|get|set)\s+)*)(\*\s*)?(#?[A-Za-z_$][\w$]*)\s*(?=[(<])", re.ASCII)


class Callable_(NamedTuple):
    kind: str  # function, method, arrow or expression
    name: str | None
    is_async: bool
    is_generator: bool
    params: tuple[int, int]  # between the parentheses, or the lone name
    returns: str | None
    start: int
    body: tuple[int, int]  # with its braces, or the expression


def pairs(src: Source) -> dict[int, int]:
    """Offsets of matching brackets, both ways; brackets that don't match are left out."""
    got = src.__dict__.get("_pairs")
    if got is None:
        got, stack = {}, []
        for m in re.finditer(r"[()\[\]{}]", src.masked):
            c, i = m[0], m.start()
            if c in "([{":
                stack.append((c, i))
            elif stack and stack[-1][0] == {")": "(", "]": "[", "}": "{"}[c]:
                j = stack.pop()[1]
                got[i], got[j] = j, i
        src.__dict__["_pairs"] = got
    return got


def _skip_generics(masked: str, p: int) -> int:
    if p < len(masked) and masked[p] == "<":
        depth = inner = 0
        for i in range(p, len(masked)):
            c = masked[i]
            inner += (c in "([{") - (c in ")]}")
            if inner < 0 or (c == ";" and inner == 0):
                break
            depth += (c == "<") - (c == ">" and masked[i - 1] != "=")
            if depth == 0:
                return i + 1
    return p


def _back(masked: str, p: int) -> int:
    """``p`` moved back over white space."""
    while p > 0 and masked[p - 1].isspace():
        p -= 1
    return p


def _word_back(masked: str, p: int, word: str) -> int | None:
    """Start of ``word`` if it stands before ``p`` and the white space there."""
    e = _back(masked, p)
    a = e - len(word)
    return a if a >= 0 and masked.startswith(word, a) and not (a and (masked[a - 1].isalnum() or masked[a - 1] in "_$.")) else None


def _generics_start(masked: str, match: dict[int, int], p: int) -> int:
    """Start of the type parameters that end before ``p``; ``p`` if there are none."""
    i = _back(masked, p) - 1
    if i < 1 or masked[i] != ">" or masked[i - 1] == "=":
        return p
    depth = 0
    while i >= 0:
        c = masked[i]
        if c in ")]}":
            i = match.get(i, 0)
        elif c in "([{;":
            return p
        elif c == ">" and masked[i - 1] != "=":
            depth += 1
        elif c == "<":
            depth -= 1
            if depth == 0:
                return i
        i -= 1
    return p


_DECLARATOR = re.compile(r"\s*([A-Za-z_$][\w$]*)\s*!?\s*(?::|\Z)")
_GOES_ON = re.compile(r"(?:[|&<,(:?=.]|=>|\b(?:extends|keyof|typeof|infer|is|readonly|unique))\Z")


def _binding(masked: str, match: dict[int, int], begin: int) -> tuple[int, int, str] | None:
    """(keyword, name's offset, name) of the const, let or var that is given the value at ``begin``.

    Walks back from the equals sign over balanced brackets, however long the annotation is.
    """
    eq = _back(masked, begin) - 1
    if eq < 1 or masked[eq] != "=" or masked[eq - 1] in "=!<>+-*/%&|^?":
        return None
    i, angle, comma = eq - 1, 0, None
    while i >= 0:
        c = masked[i]
        if c in ")]}":
            if i not in match:
                return None
            i = match[i]
        elif c in "([{;":
            return None
        elif c == ">" and masked[i - 1] == "=":
            i -= 1
        elif c == ">" and comma is None:
            angle += 1
        elif c == "<" and comma is None:
            angle -= 1
        elif angle == 0 and c == "," and comma is None:
            comma = i
        elif angle == 0 and c == "=" and comma is None:
            return None
        elif angle == 0 and c.isspace() and (k := next((k for w in ("const", "let", "var") if (k := _word_back(masked, i, w)) is not None), None)) is not None:
            first = (i if comma is None else comma) + 1
            m = _DECLARATOR.match(masked, first, eq)
            if not m:
                return None
            # a line break in the annotation belongs to it only if the type goes on
            depth, p = 0, m.end()
            while p < eq:
                ch = masked[p]
                if ch in "([{":
                    p = match.get(p, eq)
                elif ch == ">" and masked[p - 1] == "=":
                    pass
                elif ch in "<>":
                    depth += 1 if ch == "<" else -1
                elif ch == "\n" and depth == 0 and not _GOES_ON.search(masked[m.start() : p].rstrip()) and not re.match(r"[|&?:>=]|extends\b", masked[p:eq + 1].lstrip()):
                    return None
                p += 1
            return k, m.start(1), m[1]
        i -= 1
    return None


def _space(masked: str, p: int) -> int:
    while p < len(masked) and masked[p].isspace():
        p += 1
    return p


def _type_end(masked: str, p: int, stops: str) -> int:
    """End of the type that starts at p: the first of ``stops`` at depth zero, an arrow's > not counting."""
    depth = 0
    q = p
    while q < len(masked):
        c = masked[q]
        if masked.startswith("=>", q):
            if depth == 0 and "=>" in stops and masked[p:q].strip() and not masked[p:q].rstrip().endswith(")"):
                return q
            q += 2
            continue
        if c == "{" and depth == 0 and "{" in stops and masked[p:q].strip() and masked[p:q].rstrip()[-1] not in "|&:<(,=":
            return q
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            if depth == 0:
                return q
            depth -= 1
        elif depth == 0 and c in stops.replace("=>", "").replace("{", ""):
            return q
        q += 1
    return q


def callables(src: Source) -> list[Callable_]:
    """All functions with a body, outermost and earliest first."""
    masked, match = src.masked, pairs(src)
    out: list[Callable_] = []

    def after_params(close: int) -> tuple[str | None, int]:
        p = _space(masked, close + 1)
        if p < len(masked) and masked[p] == ":":
            e = _type_end(masked, p + 1, "{;")
            return src.text[p + 1 : e].strip(), _space(masked, e)
        return None, p

    for m in _FUNCTION.finditer(masked):
        p = _space(masked, _skip_generics(masked, m.end()))
        if p < len(masked) and masked[p] == "(" and p in match:
            ret, b = after_params(match[p])
            if b in match and masked[b] == "{":
                head = masked[: m.start()].rstrip()
                declared = bool(m[3]) and (not head or head[-1] in ";}{" or re.search(r"(?:export|default|\n\s*)$", masked[: m.start()].rstrip(" \t")))
                out.append(Callable_("function" if declared else "expression", m[3], bool(m[1]), bool(m[2]), (p + 1, match[p]), ret, m.start(), (b, match[b] + 1)))
    for m in _ARROW.finditer(masked):
        q = m.start() - 1
        while q >= 0 and masked[q].isspace():
            q -= 1
        ret = None
        if q >= 0 and masked[q] != ")":
            # a return type may stand between the parameters and the arrow
            line = masked.rfind(")", 0, q + 1)
            between = masked[line + 1 : q + 1] if line >= 0 else ""
            if between.lstrip().startswith(":") and "=" not in between and "\n\n" not in between and ";" not in between:
                ret, q = src.text[line + 1 : q + 1].strip()[1:].strip(), line
        if q < 0:
            continue
        if masked[q] == ")" and q in match:
            start, params = match[q], (match[q] + 1, q)
        else:
            n = re.search(r"[A-Za-z_$][\w$]*$", masked[: q + 1])
            if not n:
                continue
            start, params = n.start(), (n.start(), n.end())
        begin = _generics_start(masked, match, start)
        a = _word_back(masked, begin, "async")
        begin = begin if a is None else a
        b = _space(masked, m.end())
        if b in match and masked[b] == "{":
            body = (b, match[b] + 1)
        else:
            e, depth = b, 0
            while e < len(masked):
                c = masked[e]
                if c in "([{":
                    e = match.get(e, len(masked) - 1)
                elif c in ")]},;" or (c == "\n" and re.match(r"\s*(?:[\w$}]|\Z)", masked[e + 1 :]) and not re.search(r"[=+\-*/%&|?:,.<>({\[]\s*$", masked[b:e])):
                    break
                e += 1
            body = (b, e)
        bound = _binding(masked, match, begin)
        out.append(Callable_("arrow", bound and bound[2], a is not None, False, params, ret, begin, body))
    for c in re.finditer(r"(?<![\w$.])class\b[^{;]*\{", masked):
        a = c.end() - 1
        if a not in match:
            continue
        p = a + 1
        while p < match[a]:
            ch = masked[p]
            m = _METHOD.match(masked, p)
            if m and m[3] not in _CONTROL:
                q = _space(masked, _skip_generics(masked, m.end()))
                if q in match and masked[q] == "(":
                    ret, b = after_params(match[q])
                    if b in match and masked[b] == "{":
                        out.append(Callable_("method", m[3], "async" in m[1].split(), bool(m[2]), (q + 1, match[q]), ret, m.start(), (b, match[b] + 1)))
                        p = match[b] + 1
                        continue
            p = match[p] + 1 if ch in "([{" and p in match else p + 1
    return sorted(out, key=lambda f: (f.start, -f.body[1]))


def params_of(src: Source, f: Callable_) -> list[dict]:
    """Parameters as fields; patterns keep their text as name."""
    out = []
    for a, b in split_top(_no_angles(src.masked, *f.params), *f.params):
        text = src.text[a:b].strip()
        text = re.sub(r"^(?:@[\w$.]+(?:\([^)]*\))?\s*)+", "", text)
        readonly = bool(re.match(r"(?:(?:public|private|protected|override)\s+)*readonly\s", text))
        text = re.sub(r"^(?:(?:public|private|protected|override|readonly)\s+)+", "", text)
        default = _top_equals(text)
        head = text if default is None else text[:default]
        m = re.match(r"(\.\.\.)?\s*([A-Za-z_$][\w$]*|\{[\s\S]*?\}|\[[\s\S]*?\])\s*(\?)?\s*(?::\s*([\s\S]+))?$", head.strip())
        if m:
            out.append({"name": m[2], "type": re.sub(r"\s+", " ", m[4] or "any").strip(), "optional": bool(m[3]) or default is not None, "readonly": readonly})
    return out


def _no_angles(masked: str, a: int, b: int) -> str:
    """``masked`` with angle brackets of generics in [a, b) turned into round ones, for splitting."""
    mid = re.sub(r"=>", "  ", masked[a:b]).replace("<", "(").replace(">", ")")
    return masked[:a] + mid + masked[b:]


def _top_equals(text: str) -> int | None:
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and text[i - 1 : i] != "="))
        if c == "=" and depth == 0 and text[i + 1 : i + 2] not in ("=", ">"):
            return i
    return None


# --- bodies --------------------------------------------------------------------------------------
#: Words kept when bodies are reduced to their shape (fixed).
KEYWORDS = frozenset(
    """if else for while do switch case default break continue return throw try catch finally new this super class extends implements
    function const let var typeof instanceof in of await async yield true false null undefined void delete as is satisfies keyof readonly
    public private protected static export import from string number boolean object never any unknown bigint symbol Date Array Map Set Promise""".split()
)
#: Utility types that the identifier-blind hash keeps too (fixed).
UTILITY_TYPES = frozenset("Record Partial Pick Omit Readonly ReadonlyArray".split())


def collapse(body: str) -> str:
    """A body without comments, white space squeezed."""
    return re.sub(r"\s+", " ", re.sub(r"(^|[^:])//[^\n]*", r"\1", re.sub(r"/\*[\s\S]*?\*/", "", body))).strip()


def shingles(collapsed: str, size: int = 4) -> list[str]:
    """Distinct runs of tokens, literals and identifiers blinded; short bodies give one run."""
    s = re.sub(r"'[^']*'", "'_'", re.sub(r'"[^"]*"', '"_"', re.sub(r"`[^`]*`", "`_`", collapsed)))
    words = re.sub(r"([{}()\[\].,;:?<>=!+\-*/%&|^~])", r" \1 ", s).split()
    toks = ["_" if re.fullmatch(r"[A-Za-z_$][\w$]*", w, re.ASCII) and w not in KEYWORDS else w for w in words]
    runs = [" ".join(toks[i : i + size]) for i in range(max(1, len(toks) - size + 1))]
    return list(dict.fromkeys(runs))


def blind(collapsed: str) -> str:
    """Every identifier but keywords and utility types as _."""
    return re.sub(r"[A-Za-z_$][\w$]*", lambda m: m[0] if m[0] in KEYWORDS or m[0] in UTILITY_TYPES else "_", collapsed, flags=re.ASCII)


# --- hashes ---------------------------------------------------------------------------------------
#: Field names that mean the same (fixed).
SYNONYMS = {
    "uid": "id", "userid": "id", "identifier": "id",
    "mail": "email", "emailaddress": "email",
    "fullname": "name", "displayname": "name", "username": "name",
    "created": "createdat", "createdon": "createdat",
    "updated": "updatedat", "modified": "updatedat", "modifiedon": "updatedat",
}


def plain_name(name: str) -> str:
    low = re.sub(r"[_-]+", "", name).lower()
    return SYNONYMS.get(low, low)


def canonical_type(t: str) -> str:
    """Type text without white space; members of a top-level union sorted, undefined dropped.

    The > of an arrow lowers the depth like any other, so a union after an arrow is not split.
    """
    s = re.sub(r"\s+", "", t or "")
    members, depth, p = [], 0, 0
    for i, c in enumerate(s):
        depth += (c in "<([{") - (c in ">)]}")
        if c == "|" and depth == 0:
            members.append(s[p:i])
            p = i + 1
    if not members:
        return s
    members = sorted(m for m in [*members, s[p:]] if m not in ("", "undefined"))
    return "|".join(members) if members else s


def short_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def type_hashes(fields: list[dict]) -> tuple[str, str, str]:
    """Strict, structural and name-normalized hash of an object type's fields, as multisets."""
    sig = lambda key, named: "{" + ",".join(sorted(f"{key(f['name']) if named else '_'}{'?' if f['optional'] else ''}:{canonical_type(f['type'])}" for f in fields)) + "}"
    return short_hash(sig(str, True)), short_hash(sig(str, False)), short_hash(sig(plain_name, True))


def function_hashes(fn: dict) -> tuple[str, str, str]:
    """Strict, structural and name-normalized hash of a function; the latter two differ in what they blind."""
    flags = ("a" if fn["is_async"] else "") + ("g" if fn["is_generator"] else "")

    def sig(name, body):
        ps = ",".join(f"{name(i, p)}{'?' if p['optional'] else ''}:{canonical_type(p['type'])}" for i, p in enumerate(fn["params"]))
        return short_hash(f"{flags}({ps})=>{canonical_type(fn['return_type'])}::{body}")

    return sig(lambda i, p: p["name"], fn["body_normalized"]), sig(lambda i, p: f"_{i}", blind(fn["body_normalized"])), sig(lambda i, p: plain_name(p["name"]), fn["body_normalized"])


# --- symbols --------------------------------------------------------------------------------------
def _members(src: Source, a: int, b: int) -> list[dict]:
    """Fields of an interface or object type between its braces."""
    masked = _no_angles(src.masked, a, b)
    cuts, depth, p = [], 0, a
    for i in range(a, b):
        c = masked[i]
        depth += (c in "([{") - (c in ")]}")
        if depth == 0 and (c in ";," or (c == "\n" and masked[p:i].strip() and not re.search(r"[|&:,(<=]\s*$", masked[p:i]) and not re.match(r"\s*[|&]", masked[i:]))):
            cuts.append((p, i))
            p = i + 1
    cuts.append((p, b))
    out = []
    for p, q in cuts:
        t = re.sub(r"/\*[\s\S]*?\*/|//[^\n]*", "", src.text[p:q]).strip()
        if not t:
            continue
        readonly = bool(re.match(r"readonly\s+(?![?:(])", t))
        t = re.sub(r"^readonly\s+(?![?:(])", "", t)
        squeeze = lambda x: re.sub(r"\s+", " ", x).strip()
        if m := re.match(r"\[\s*[\w$]+\s*:\s*([^\]]+)\]\s*:\s*([\s\S]+)$", t):
            out.append({"name": f"[{squeeze(m[1])}]", "type": squeeze(m[2]), "optional": False, "readonly": readonly})
        elif m := re.match(r"(new\b)?\s*((?:[A-Za-z_$][\w$]*|'[^']*'|\"[^\"]*\")?)(\?)?\s*(?:<[^()]*>)?\(([\s\S]*)\)\s*(?::\s*([\s\S]+))?$", t):
            ps = ",".join(re.sub(r"\s*([:?,])\s*", r"\1", squeeze(x)) for x in m[4].split(",") if x.strip())
            name = "new()" if m[1] and not m[2] else f"(){m[2]}" if m[2] else "()"
            out.append({"name": name, "type": f"({ps})=>{squeeze(m[5] or 'any')}", "optional": bool(m[3]), "readonly": False})
        elif m := re.match(r"([A-Za-z_$#][\w$]*|'[^']*'|\"[^\"]*\"|\d+)\s*([?!])?\s*(?::\s*([\s\S]+))?$", t):
            out.append({"name": m[1], "type": squeeze(m[3] or "any"), "optional": m[2] == "?", "readonly": readonly})
    return out


_TOP = re.compile(r"(?m)^[ \t]*(export\s+)?(default\s+)?(?:declare\s+)?(?:(interface)\s+([\w$]+)|(type)\s+([\w$]+)(?=\s*(?:<[^=]*>)?\s*=)|(?:abstract\s+)?(class)\s+([\w$]+))", re.ASCII)


def symbols(path: str, text: str) -> Iterator[dict]:
    """Top-level interfaces, type aliases, named functions, function-valued variables and classes."""
    src = Source(text)
    masked, match = src.masked, pairs(src)
    depth0 = _depth_zero(src)

    def row(kind: str, name: str, start: int, end: int, exported: bool, default: bool | None, tstruct=None, fstruct=None) -> dict:
        first = src.line(start)
        source = text[start:end]
        if fstruct:
            h = function_hashes(fstruct)
        elif tstruct["kind"] == "object":
            h = type_hashes(tstruct["fields"])
        else:
            h = (short_hash(tstruct.get("raw") or source),) * 3
        return {
            "id": short_hash(f"{path}:{first}:{source}"), "kind": kind, "name": name, "file": path, "line_range": {"start_line": first, "end_line": src.line(max(start, end - 1))}, "source": source,
            "exported": exported, "is_default": default, "structure_kind": "function" if fstruct else tstruct["kind"], "type_struct": tstruct, "fn_struct": fstruct,
            "hash_strict": h[0], "hash_structural": h[1], "hash_normalized": h[2],
        }

    for m in _TOP.finditer(masked):
        if not depth0(m.start()):
            continue
        kind = m[3] or m[5] or m[7]
        name = m[4] or m[6] or m[8]
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        exported, default = bool(m[1]), bool(m[2])
        if kind == "type":
            eq = masked.find("=", m.end())
            p = _space(masked, eq + 1)
            if p in match and masked[p] == "{" and re.match(r"\s*(?:;|\n|\Z)", masked[match[p] + 1 :]):
                yield row("type-alias", name, start, match[p] + 1, exported, default, {"kind": "object", "raw": None, "fields": _members(src, p + 1, match[p])})
            else:
                e = p
                while e < len(masked) and not (masked[e] == ";" or (masked[e] == "\n" and not re.match(r"\s*[|&?:]", masked[e:]) and not re.search(r"[|&=?:(,<]\s*$", masked[p:e]))):
                    e = match[e] + 1 if masked[e] in "([{" and e in match else e + 1
                raw = text[p:e].strip()
                tkind = "union" if "|" in canonical_type(raw) or raw.startswith("|") else "intersection" if "&" in raw else "literal" if re.fullmatch(r"['\"`\d].*", raw) else "unknown"
                yield row("type-alias", name, start, min(e + 1, len(text)), exported, default, {"kind": tkind, "raw": raw, "fields": None})
            continue
        b = masked.find("{", m.end())
        if b < 0 or b not in match:
            continue
        if kind == "interface":
            fields = _members(src, b + 1, match[b])
        else:
            fields = _class_fields(src, b, match[b])
        yield row("interface" if kind == "interface" else "class", name, start, match[b] + 1, exported, default, {"kind": "object", "raw": None, "fields": fields})
    for f in callables(src):
        if f.kind not in ("function", "arrow", "expression"):
            continue
        variable = f.kind != "function"
        bound = _binding(masked, match, f.start) if variable else None
        name = (bound[2] if bound else None) if variable else f.name  # a function expression goes by its variable's name
        if not name:
            continue
        begin = bound[0] if variable else f.start
        default = _word_back(masked, begin, "default")
        begin = begin if default is None else default
        export = _word_back(masked, begin, "export")
        begin = begin if export is None else export
        if not depth0(begin):
            continue
        start = bound[1] if variable else begin
        body = text[f.body[0] : f.body[1]].strip()
        norm = collapse(body)
        ret = f.returns or "unknown"
        fn = {"params": params_of(src, f), "return_type": re.sub(r"\s+", " ", ret), "is_async": f.is_async, "is_generator": f.is_generator, "body": body, "body_normalized": norm, "body_shingles": shingles(norm)}
        yield row("function", name, start, f.body[1], export is not None, None if variable else default is not None, None, fn)


def _class_fields(src: Source, a: int, b: int) -> list[dict]:
    """Instance properties and methods of a class."""
    masked, match = src.masked, pairs(src)
    props, methods, p = [], [], a + 1
    head = re.compile(r"\s*((?:@[\w$.]+(?:\([^)]*\))?\s*)*)((?:(?:public|private|protected|static|abstract|override|readonly|declare|async|get|set)\s+)*)(\*\s*)?(#?[A-Za-z_$][\w$]*)\s*([?!])?", re.ASCII)
    while p < b:
        m = head.match(masked, p)
        if not m or m.end() > b:
            p += 1
            continue
        mods = m[2].split()
        q = _space(masked, _skip_generics(masked, m.end()))
        if q in match and masked[q] == "(":
            close = match[q]
            e = _space(masked, close + 1)
            ret = "any"
            if masked[e : e + 1] == ":":
                t = _type_end(masked, e + 1, "{;")
                ret, e = re.sub(r"\s+", " ", src.text[e + 1 : t]).strip(), _space(masked, t)
            f = Callable_("method", m[4], False, False, (q + 1, close), None, p, (e, e))
            if "static" not in mods and m[4] != "constructor" and not {"get", "set"} & set(mods):
                ps = ",".join(f"{x['name']}:{x['type']}" for x in params_of(src, f))
                methods.append({"name": f"(){m[4]}", "type": f"({ps})=>{ret}", "optional": m[5] == "?", "readonly": False})
            p = match[e] + 1 if e in match and masked[e] == "{" else e + 1
            continue
        t, e = "any", q
        if masked[q : q + 1] == ":":
            e = _type_end(masked, q + 1, ";=\n")
            t = re.sub(r"\s+", " ", src.text[q + 1 : e]).strip()
        while e < b and masked[e] not in ";\n":
            e = match[e] + 1 if masked[e] in "([{" and e in match else e + 1
        if "static" not in mods:
            props.append({"name": m[4], "type": t, "optional": m[5] == "?", "readonly": "readonly" in mods})
        p = e + 1
    return props + methods


def _depth_zero(src: Source):
    """Test of whether an offset lies outside all brackets."""
    spans = sorted((a, b) for a, b in pairs(src).items() if a < b)
    top: list[tuple[int, int]] = []
    for a, b in spans:
        if not top or a > top[-1][1]:
            top.append((a, b))
    from bisect import bisect_right

    starts = [a for a, _ in top]

    def test(p: int) -> bool:
        i = bisect_right(starts, p) - 1
        return i < 0 or p > top[i][1] or p == top[i][0]

    return test


# --- imports ----------------------------------------------------------------------------------------
_IMPORT = re.compile(r"(?m)(?<![\w$.])import\s+(?:type\s+)?([^'\"();]*?)\s*from\s*(?=['\"])|(?<![\w$.])import\s*(?=['\"])")
_EXPORT = re.compile(r"(?<![\w$.])export\s+(?:type\s+)?(\*(?:\s*as\s+([\w$]+))?|\{[^}]*\})\s*from\s*(?=['\"])")
_DYNAMIC = re.compile(r"(?<![\w$.])import\s*\(\s*(?=['\"])")


def imports(path: str, text: str) -> Iterator[dict]:
    """Import declarations, re-exports and dynamic imports of literal paths, targets unresolved.

    Named imports carry the exported name; a re-export has exported and published names.
    """
    src = Source(text)

    def spec(at: int) -> str:
        q = text[at]
        return text[at + 1 : text.find(q, at + 1)]

    def base(at: int, **more) -> dict:
        return {"source": path, "specifier": spec(at), "named_imports": [], "default_import": None, "namespace_alias": None, "is_re_export": False, "is_star_re_export": False, "re_export_names": None, "re_export_local_names": None} | more

    def names(block: str) -> tuple[list[str], list[str]]:
        both = [re.sub(r"^type\s+(?=[\w$])", "", x.strip()) for x in block.strip()[1:-1].split(",") if x.strip()]
        return [re.split(r"\s+as\s+", x)[0].strip() for x in both], [re.split(r"\s+as\s+", x)[-1].strip() for x in both]

    for m in _IMPORT.finditer(src.masked):
        clause = m[1] or ""
        block = re.search(r"\{[^}]*\}", clause)
        ns = re.search(r"\*\s*as\s+([\w$]+)", clause)
        default = re.match(r"\s*([A-Za-z_$][\w$]*)\s*(?:,|$)", clause)
        yield base(m.end(), named_imports=names(block[0])[0] if block else [], default_import=default[1] if default else None, namespace_alias=ns[1] if ns else None)
    for m in _EXPORT.finditer(src.masked):
        if m[1].startswith("*"):
            yield base(m.end(), is_re_export=True, is_star_re_export=True, re_export_names=[], re_export_local_names=[])
        else:
            orig, local = names(m[1])
            yield base(m.end(), named_imports=orig, is_re_export=True, re_export_names=orig, re_export_local_names=local)
    for m in _DYNAMIC.finditer(src.masked):
        yield base(m.end(), namespace_alias="__dynamic__")
