"""Token streams for the table-driven parser: ECMAScript with JSX, Python 3 and JSON."""

from __future__ import annotations

import re

from sievework.llm.grammars import ecma, python3


class LexError(Exception):
    """A character sequence that is no token, at ``args[0]``; ``args[1]`` says what.

    ``tokens`` holds the (kinds, offsets, may) of what came before it.
    """

    tokens: tuple[list, list, list | None] = ([], [], None)


_WS = r"( (?=[\w({\[=\"'])|(?:[\s\ufeff]++|//[^\n\r\u2028\u2029]*+|/\*[\s\S]*?\*/)*+)"
_ID = r"((?:[^\W\d]|\$)[\w$]*+(?![\\\u200c\u200d])|(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*+)"
_NUM = r"((?:0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*|(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?)n?(?![\w$]))"
_STR = r"""('[^'\\\n\r]*+(?:\\(?:\r\n|[\s\S])[^'\\\n\r]*+)*+'|"[^"\\\n\r]*+(?:\\(?:\r\n|[\s\S])[^"\\\n\r]*+)*+")"""
_PUNCT = r"([(){}\[\];,:~@#`]|\.(?![.\d])|\.\.\.|=(?![=>])|=>|===|!==|\*\*=|&&=|\|\|=|\?\?=|<<=|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[<>+\-*/%&|^!?=.])"
_CODE = re.compile(_WS + "(?:" + "|".join((_ID, _PUNCT, _STR, _NUM)) + r"|\Z)").match
#: All tokens of a stretch that needs no context: (white space, word, > before > or =, punctuator, string, number, anything else).
_ALL = re.compile(_WS + "(?:" + "|".join((_ID, r"(>)(?=[>=])", _PUNCT, _STR, _NUM)) + r"|\Z|([\s\S]))").findall
_STRETCH = re.compile(rf"(?:[^/`'\"]++|{_STR})*+").match
_STRETCH_JSX = re.compile(rf"(?:[^/`'\"<]++|{_STR})*+").match
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([A-Za-z]*)").match
_TEMPLATE = re.compile(r"[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*+)*+(`|\$\{)").match
_JSX_START = re.compile(r"<\s*(?:>|[A-Za-z_$])").match
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|=(?!>)|extends\s+[^=>/\s])").match
_TAG = re.compile(r"(?:\s++|//[^\n\r]*+|/\*[\s\S]*?\*/)*+(?:([A-Za-z_$][\w$-]*)|(\"[^\"]*\"|'[^']*')|(/>|[={>.:<]))").match
_TEXT = re.compile(r"[^<{>}]+").match
_MARKER = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?:[ \r]|$)").search
_OPERAND = ecma.ID | frozenset(("NUM", "STR", "REGEX", "TPL", "TPL_TAIL", ")", "]", "this", "super", "null", "true", "false", "J>", "J/>"))
_WORDS = {w: w for w in ecma.RESERVED | ecma.CONTEXTUAL}
_CLOSE = {")": "(", "]": "[", "}": "{"}
#: Punctuators that need no further look.
_PLAIN = frozenset("... => === !== **= && || ?? &&= ||= ??= <<= == != <= ?. += -= *= %= &= |= ^= << ** ; , + - * % & | ^ ~ ? : = . @ #".split())
_HEADS = frozenset(("if", "while", "for", "with"))
#: Tokens that a line break before them, or after them, makes another kind of.
_NL_BEFORE = frozenset(("[", "++", "--", "!"))
_NL_AFTER = frozenset(("return", "break", "continue", "throw", "yield"))
#: What the list of type arguments of an expression can hold, and what can follow it.
_IN_TYPES = ecma.ID | frozenset(". , | & [ nl[ ] { } : ; ? => ( (A (C ) STR NUM typeof import extends null true false this void new - TPL in ...".split())
_OPERANDS = ecma.ID | frozenset("NUM STR REGEX null true false this super [ nl[ { + - ! nl! ~ typeof void delete ++ -- nl++ nl-- new function class import # < @ J<".split()) - {"as", "satisfies", "of", "is"}


def ecma_tokens(text: str, dialect: str, exact: bool = True) -> tuple[list, list, bytearray]:
    """Kinds, offsets (only where ``exact``), and before which tokens a semicolon may be put.

    Kinds tell what one token of lookahead can't: ``(A`` is closed before an arrow, ``(C`` before a colon,
    ``<G`` opens type arguments of an expression, ``>+`` touches a following > or =, ``nl[`` follows a line
    break, ``return0`` precedes one.
    """
    kinds: list[str] = []
    nl: list[int] = []  # the tokens that follow a line break
    at: list[int] = []
    closes: list[tuple[int, int]] = []
    less: list[int] = []
    stack: list[tuple] = []
    try:
        _ecma_tokens(text, dialect, kinds, nl, at, closes, less, stack, exact)
    except LexError as e:
        for top in stack:
            if top[0] == "(":
                kinds[top[1]] = "(C"
        e.tokens = _ecma_kinds(kinds, nl, at, closes, less)
        raise
    nl.append(len(kinds))
    kinds.append("EOF")
    at.append(len(text))
    return _ecma_kinds(kinds, nl, at, closes, less)


def _ecma_kinds(kinds: list, nl: list, at: list, closes: list, less: list) -> tuple[list, list, bytearray]:
    """Marks what depends on later tokens."""
    last = len(kinds) - 1
    may = bytearray(last + 2)  # an error can follow the last line break
    for i in nl:
        may[i] = 1
    for a, b in closes:
        if kinds[b] == "}":
            may[b] = 1
        elif b < last and kinds[a] == "(":
            if (k := kinds[b + 1]) == "=>":
                kinds[a] = "(A"
            elif k == ":":
                kinds[a] = "(C"
    for i in less:
        depth, j = 1, i + 1
        while depth and j < last:
            k = kinds[j]
            if k == "<":
                depth += 1
            elif k == ">" or k == ">+":
                depth -= 1
            elif k not in _IN_TYPES and k not in ("keyof", "infer"):
                break
            j += 1
        if not depth and ((k := kinds[j])[0] == "(" or k in ("TPL", "TPL_HEAD") or ((may[j] or k not in _OPERANDS) and k not in ("<", ">", "+", "-") and kinds[j - 1] != ">+")):
            kinds[i] = "<G"
    return kinds, at, may


def _ecma_tokens(text: str, dialect: str, kinds: list, nl: list, at: list, closes: list, less: list, stack: list, exact: bool) -> None:
    jsx, typed = dialect == "tsx", dialect != "js"
    words = _WORDS.get
    add_kind, add_nl, add_at = kinds.append, nl.append, at.append
    pos, end, prev = 0, len(text), ""
    inner = 0  # open substitutions of templates and expressions in elements
    if text.startswith("#!"):
        pos = len(re.match(r"[^\n\r]*", text)[0])

    def push(kind: str, start: int, stop: int) -> None:
        nonlocal prev, pos
        add_kind(kind)
        add_at(start)
        prev, pos = kind, stop

    def tag_mode() -> None:
        """From inside a tag up to an expression container or the end of the tag."""
        nonlocal inner
        while True:
            m = _TAG(text, pos)
            if not m:
                raise LexError(pos, "no token of a tag")
            s, e = m.start(m.lastindex), m.end()
            if m.lastindex == 1:
                top = stack[-1]
                if top[3] and (prev in ("J<", "J</", ".", ":")):
                    top[2].append(m[1] if prev in ("J<", "J</") else prev + m[1])
                else:
                    stack[-1] = (*top[:3], False)
                push("J_ID", s, e)
            elif m.lastindex == 2:
                push("J_STR", s, e)
            else:
                c = m[3]
                if c == "{":
                    inner += 1
                    stack.append(("{J", len(kinds)))
                    push("J{", s, e)
                    return
                if c == "<":
                    if prev != "J=":
                        raise LexError(s, "unexpected <")
                    push("J<", s, e)
                    stack.append(("T", "J<", [], True))
                elif c == "=":
                    push("J=", s, e)
                elif c in ".:":
                    push(c, s, e)
                elif c == "/>":
                    if stack[-1][1] != "J<":
                        raise LexError(s, "unexpected />")
                    push("J/>", s, e)
                    stack.pop()
                    if not (stack and stack[-1][0] == "T"):
                        return
                else:
                    push("J>", s, e)
                    top = stack.pop()
                    name = "".join(top[2])
                    if top[1] == "J<":
                        stack.append(("C", name))
                        return
                    if not stack or stack[-1][0] != "C" or stack[-1][1] != name:
                        raise LexError(s, "closing tag doesn't match")
                    stack.pop()
                    if not (stack and stack[-1][0] == "T"):
                        return

    def child_mode() -> None:
        nonlocal inner
        m = _TEXT(text, pos)
        if m:
            if (mm := _MARKER(m[0])) and (text[pos + mm.start() - 1] in "\n\r" or mm.start()):
                raise LexError(pos + mm.start(), "merge marker")
            push("J_TEXT", pos, m.end())
        if pos >= end:
            raise LexError(pos, "element isn't closed")
        c = text[pos]
        if c == "{":
            inner += 1
            stack.append(("{J", len(kinds)))
            push("J{", pos, pos + 1)
        elif c == "<":
            closing = re.compile(r"<\s*/").match(text, pos)
            if closing:
                stack.append(("T", "J</", [], True))
                push("J</", pos, closing.end())
            else:
                stack.append(("T", "J<", [], True))
                push("J<", pos, pos + 1)
            tag_mode()
        else:
            raise LexError(pos, f"unexpected {c} in an element")

    while True:
        while jsx and stack and stack[-1][0] in ("C", "T"):
            if stack[-1][0] == "C":
                child_mode()
            else:
                tag_mode()
        if not exact and not inner:
            stop = (_STRETCH_JSX if jsx else _STRETCH)(text, pos).end()
            newline = False
            for ws, w, close, c, quoted, number, other in _ALL(text, pos, stop):
                if ws and ws != " " and ("\n" in ws or "\r" in ws or "\u2028" in ws or "\u2029" in ws):
                    newline = True
                    add_nl(len(kinds))
                    if prev in _NL_AFTER:
                        kinds[-1] = prev + "0"
                else:
                    newline = False
                if w:
                    c = words(w, "ID")
                    if c == "function" and prev == "async" and not newline:
                        kinds[-1] = "async_fn"
                elif quoted:
                    c = "STR"
                elif number:
                    c = "NUM"
                elif close:
                    c = ">+"
                elif other:
                    raise LexError(pos, "no token")
                elif c not in _PLAIN:
                    if not c:
                        break
                    if c in "([{":
                        stack.append((c, len(kinds), c == "(" and prev in _HEADS))
                        if newline and c == "[":
                            add_kind("nl[")
                            prev = c
                            continue
                    elif c in ")]}":
                        if not stack or stack[-1][0] != _CLOSE[c]:
                            raise LexError(pos, f"unexpected {c}")
                        top = stack.pop()
                        closes.append((top[1], len(kinds)))
                        add_kind(c)
                        prev = "head)" if top[2] else c
                        continue
                    else:
                        if c == "<" and typed and prev in _OPERAND:
                            less.append(len(kinds))
                        prev = c
                        add_kind(c)
                        if newline and c in _NL_BEFORE:
                            kinds[-1] = "nl" + c
                        continue
                add_kind(c)
                prev = c
            pos = stop - len(ws)
            if newline and nl[-1] == len(kinds):
                nl.pop()
        m = _CODE(text, pos)
        if m is None:
            raise LexError(len(re.compile(_WS).match(text, pos)[0]) + pos, "no token")
        k = m.lastindex
        s, e = m.span(k)
        if k == 1:
            break  # nothing but white space is left
        newline = False
        if s != pos:
            ws = m[1]
            newline = "\n" in ws or "\r" in ws or "\u2028" in ws or "\u2029" in ws
            if newline:
                add_nl(len(kinds))
                if prev in _NL_AFTER:
                    kinds[-1] = prev + "0"
        if k != 3 or m[3] in _PLAIN:
            if k == 2:
                c = words(m[2], "ID")
                if c == "function" and prev == "async" and not newline:
                    kinds[-1] = "async_fn"
                prev = c
            else:
                prev = m[3] if k == 3 else "STR" if k == 4 else "NUM"
            add_kind(prev)
            add_at(s)
            pos = e
        else:
            c = m[3]
            if c in "([{":
                stack.append((c, len(kinds), c == "(" and prev in _HEADS))
                push(c, s, e)
                if newline and c == "[":
                    kinds[-1] = "nl["
            elif c in ")]}":
                if not stack:
                    raise LexError(s, f"unexpected {c}")
                top = stack.pop()
                if top[0] in ("`", "{J"):
                    inner -= 1
                if c == "}" and top[0] == "`":
                    m = _TEMPLATE(text, e)
                    if not m:
                        raise LexError(s, "template isn't closed")
                    if m[1] == "`":
                        push("TPL_TAIL", s, m.end())
                    else:
                        inner += 1
                        stack.append(("`", len(kinds)))
                        push("TPL_MID", s, m.end())
                elif c == "}" and top[0] == "{J":
                    push("J}", s, e)
                    if stack[-1][0] == "T":
                        tag_mode()
                else:
                    if top[0] != _CLOSE[c]:
                        raise LexError(s, f"unexpected {c}")
                    closes.append((top[1], len(kinds)))
                    push(c, s, e)
                    if top[2]:
                        prev = "head)"
            elif c == "`":
                m = _TEMPLATE(text, e)
                if not m:
                    raise LexError(s, "template isn't closed")
                if m[1] == "`":
                    push("TPL", s, m.end())
                else:
                    inner += 1
                    stack.append(("`", len(kinds)))
                    push("TPL_HEAD", s, m.end())
            elif c[0] == "/" and prev not in _OPERAND and (m := _REGEX(text, s)):
                push("REGEX", s, m.end())
            elif c == "<" and jsx and prev not in _OPERAND and _JSX_START(text, s) and not _GENERIC(text, s):
                stack.append(("T", "J<", [], True))
                push("J<", s, e)
            else:
                if c == "<" and typed and prev in _OPERAND:
                    less.append(len(kinds))
                push(c, s, e)
                if c == ">":
                    if text[e : e + 1] in (">", "="):
                        kinds[-1] = ">+"
                elif newline and c in _NL_BEFORE:
                    kinds[-1] = "nl" + c
    if stack:
        raise LexError(end, "not closed at the end")


_PY_WS = re.compile(r"(?:[ \t\f]++|\\(?:\r\n|\n|\r))*+").match
_PY_TOKEN = re.compile(
    r"([^\W\d]\w*+)"
    r"|([()\[\]{},~;]|\.(?![.\d])|:(?!=)|=(?!=)|\.\.\.|\*\*=|//=|>>=|<<=|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|[+\-*/%@&|^]=|[-+*/%@&|^<>]|\.(?!\d))"
    r"|(\r\n|\n|\r)"
    r"|((?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?=(?:and|else|for|if|in|is|not|or)\b|\W|\Z))"
    r"|(#[^\n\r]*)"
).match
_PY_STR = re.compile(r"([rRuUbB]|[bB][rR]|[rR][bB]|[fF]|[fF][rR]|[rR][fF])?('''|\"\"\"|'|\")").match
_PY_BODY = {
    "'": re.compile(r"[^'\\\n\r]*+(?:\\(?:\r\n|[\s\S])[^'\\\n\r]*+)*+'").match,
    '"': re.compile(r'[^"\\\n\r]*+(?:\\(?:\r\n|[\s\S])[^"\\\n\r]*+)*+"').match,
    "'''": re.compile(r"[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''").match,
    '"""': re.compile(r'[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""').match,
}
_PY_QUOTE = frozenset("\"'rRuUbBfF")
_PY_INDENT = re.compile(r"[ \t\f]*").match
_PY_REST = re.compile(r"[^\n\r]*").match
_PY_WORDS = {w: w for w in python3.KEYWORDS | python3.SOFT}
#: The language's own bound on formatted strings within formatted strings (fixed).
_PY_NESTED = 150
_ZEROS = re.compile(r"0[\d_]*[1-9][\d_]*\Z").match


def python_tokens(text: str) -> tuple[list, list, None]:
    kinds: list[str] = []
    at: list[int] = []
    try:
        _python_tokens(text, kinds, at)
    except LexError as e:
        e.tokens = kinds, at, None
        raise
    kinds.append("EOF")
    at.append(len(text))
    return kinds, at, None


def _python_tokens(text: str, kinds: list, at: list) -> None:
    indents: list[tuple[int, int]] = [(0, 0)]
    stack: list[str] = []
    pos, end, start_of_line = 0, len(text), True

    def push(kind: str, s: int) -> None:
        kinds.append(kind)
        at.append(s)

    def fstring(p: int, quote: str, raw: bool, spec: bool = False) -> int:
        """Literal part of a formatted string, or of a format spec, from p; the position after it."""
        nonlocal pos
        while True:
            if p >= end:
                raise LexError(p, "string isn't closed")
            c = text[p]
            if not spec and text.startswith(quote, p):
                push("FE", p)
                return p + len(quote)
            if spec and c == "}":
                return p
            if c == "\\" and not (raw and text[p + 1 : p + 2] in "{}"):
                p += 2 if not (text[p + 1 : p + 2] in "{}") else 1
            elif c in "\n\r" and len(quote) == 1:
                raise LexError(p, "string isn't closed")
            elif text.startswith("{{", p) and not spec:
                p += 2
            elif text.startswith("}}", p) and not spec:
                p += 2
            elif c == "{":
                push("F{", p)
                depth = len(stack)
                if stack.count("f") == _PY_NESTED:
                    raise LexError(p, "too many nested f-strings")
                stack.append("f")
                pos = p + 1
                while True:
                    token(depth + 1)
                    if len(stack) == depth + 1 and pos < end:
                        c = text[pos]
                        if c == "!" and text[pos + 1 : pos + 2] != "=":
                            push("F!", pos)
                            pos += 1
                        elif c == ":":
                            push("F:", pos)
                            pos = fstring(pos + 1, quote, raw, True)
                        if pos < end and text[pos] == "}":
                            push("F}", pos)
                            stack.pop()
                            break
                    if pos >= end:
                        raise LexError(pos, "string isn't closed")
                p = pos + 1
            elif c == "}":
                raise LexError(p, "single }")
            else:
                p += 1

    def token(field: int = 0) -> None:
        """One token from pos; in a replacement field it stops before what ends the expression."""
        nonlocal pos
        pos = _PY_WS(text, pos).end()
        if field and len(stack) == field and pos < end and text[pos] in ":!}" and text[pos : pos + 2] != "!=":
            return
        m = _PY_STR(text, pos) if text[pos : pos + 1] in _PY_QUOTE else None
        if m:
            s, quote, prefix = pos, m[2], (m[1] or "").lower()
            if "f" in prefix:
                push("FS", s)
                pos = fstring(m.end(), quote, "r" in prefix)
                return
            body = _PY_BODY[quote](text, m.end())
            if not body:
                raise LexError(s, "string isn't closed")
            push("STR", s)
            pos = body.end()
            return
        m = _PY_TOKEN(text, pos)
        if not m:
            if pos >= end:
                return
            raise LexError(pos, "no token")
        k, s = m.lastindex, pos
        pos = m.end()
        if k == 1:
            push(_PY_WORDS.get(m[1], "NAME"), s)
        elif k == 4:
            if _ZEROS(m[4]):
                raise LexError(s, "leading zeros")
            push("NUM", s)
        elif k == 3:
            if not stack:
                push("NEWLINE", s)
        elif k == 2:
            c = m[2]
            if c in "([{":
                stack.append(c)
            elif c in ")]}":
                if not stack or stack[-1] != _CLOSE[c]:
                    raise LexError(s, f"unexpected {c}")
                stack.pop()
            push(c, s)

    while pos < end:
        if start_of_line and not stack:
            m = _PY_INDENT(text, pos)
            rest = text[m.end() : m.end() + 1]
            if rest in ("#", "\n", "\r", ""):
                pos = m.end()
                if rest == "#":
                    pos = _PY_REST(text, pos).end()
                if pos < end:
                    pos += 2 if text.startswith("\r\n", pos) else 1
                continue
            col = alt = 0
            for c in m[0]:
                col, alt = (col // 8 * 8 + 8, alt + 1) if c == "\t" else (0, 0) if c == "\f" else (col + 1, alt + 1)
            pos = m.end()
            if col > indents[-1][0]:
                if alt <= indents[-1][1]:
                    raise LexError(pos, "tabs and spaces")
                indents.append((col, alt))
                push("INDENT", pos)
            else:
                while col < indents[-1][0]:
                    indents.pop()
                    push("DEDENT", pos)
                if col != indents[-1][0]:
                    raise LexError(pos, "dedent doesn't match")
                if alt != indents[-1][1]:
                    raise LexError(pos, "tabs and spaces")
            start_of_line = False
        n = len(kinds)
        token()
        if len(kinds) > n and kinds[-1] == "NEWLINE":
            start_of_line = True
    if stack:
        raise LexError(end, "not closed at the end")
    if kinds and kinds[-1] != "NEWLINE":
        push("NEWLINE", end)
    for _ in indents[1:]:
        push("DEDENT", end)


_JSON = re.compile(
    r"""([ \t\n\r]*+)(?:("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(true|false|null)(?!\w)|([{}\[\],:]))""", re.ASCII
).match
_JSON_WS = re.compile(r"[ \t\n\r]*").match
_JSONC_WS = re.compile(r"(?:[ \t\n\r]++|//[^\n\r]*+|/\*[\s\S]*?\*/)*+").match


def json_tokens(text: str, loose: bool) -> tuple[list, list, None]:
    kinds: list[str] = []
    at: list[int] = []
    pos, end = 0, len(text)
    while True:
        if loose:
            pos = _JSONC_WS(text, pos).end()
        m = _JSON(text, pos)
        if not m:
            pos = _JSON_WS(text, pos).end()
            if pos >= end:
                break
            e = LexError(pos, "no token")
            e.tokens = kinds, at, None
            raise e
        k = m.lastindex
        kinds.append(("STR", "NUM")[k - 2] if k < 4 else m[k])
        at.append(m.start(k))
        pos = m.end()
    kinds.append("EOF")
    at.append(end)
    return kinds, at, None
