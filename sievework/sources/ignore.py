"""Ignore files: patterns of the root and nested files, re-scoped, compiled once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

#: Always ignored (fixed).
ALWAYS = (".git", "node_modules")


def _regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.*", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.match(r"\[[!^]?\]?[^\]]*\]", pattern[i:])):
            out, i = out + m[0].replace("[!", "[^", 1), i + len(m[0])
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


@lru_cache(4096)
def compile_rule(line: str, scope: str = "") -> tuple[re.Pattern, bool, bool] | None:
    """(pattern over posix paths, negated, folders only) of a line in the ignore file of folder ``scope``."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    body = _regex(line.lstrip("/"))
    head = re.escape(scope + "/") if scope else ""
    return re.compile(head + ("" if anchored else "(?:.*/)?") + body + r"(?P<below>/.*)?\Z"), negated, folder


class Ignore:
    """Rules in order; the last that matches decides. A path ends with / if it is a folder."""

    def __init__(self, files: Iterable[tuple[str, str]] = ()):
        """``files``: (folder, text) of the ignore files, root first."""
        self.rules = [r for n in ALWAYS if (r := compile_rule(n))]
        self.rules += [r for scope, text in sorted(files, key=lambda f: f[0].count("/") + bool(f[0])) for line in text.splitlines() if (r := compile_rule(line, scope))]

    def ignores(self, path: str) -> bool:
        is_dir, p = path.endswith("/"), path.rstrip("/")
        out = False
        for rx, negated, folder in self.rules:
            m = rx.match(p)
            if m and (not folder or is_dir or m["below"]):
                out = not negated
        return out

    def keep(self, paths: Iterable[str]) -> list[str]:
        return [p for p in paths if not self.ignores(p)]


def load_ignore(root: str, names: tuple[str, ...] = (".gitignore", ".sieveworkignore"), below: str = "", deep: bool = True) -> Ignore:
    """Rules of the ignore files of ``root``, of the folder ``below``, of those between, and (``deep``) of those below."""
    found = []

    def take(rel: str, files: Iterable[str]) -> None:
        for n in names:
            if n in files and (n == names[0] or not rel):
                with open(os.path.join(root, rel, n), encoding="utf-8", errors="replace") as f:
                    found.append((rel, f.read()))

    parts = below.split("/") if below else []
    for k in range(len(parts) + (not deep)):
        take("/".join(parts[:k]), os.listdir(os.path.join(root, *parts[:k])))
    for d, subs, files in os.walk(os.path.join(root, below)) if deep else ():
        subs[:] = [s for s in subs if s not in ALWAYS]
        rel = os.path.relpath(d, root).replace(os.sep, "/")
        take("" if rel == "." else rel, files)
    return Ignore(found)


def enumerate_files(root: str, ignore: Ignore, extensions: Iterable[str] | None = None, name: str | None = None, below: str = "") -> Iterator[str]:
    """Posix paths of the files (under ``below``) that aren't ignored, ignored folders pruned before descent, in order."""
    wanted, rx = set(extensions or ()), re.compile(name) if name else None
    for d, subs, files in os.walk(os.path.join(root, below)):
        rel = os.path.relpath(d, root).replace(os.sep, "/")
        base = "" if rel == "." else rel + "/"
        subs[:] = sorted(s for s in subs if not ignore.ignores(f"{base}{s}/"))
        for f in sorted(files):
            if not ignore.ignores(base + f) and (not wanted or os.path.splitext(f)[1] in wanted) and (rx is None or rx.search(f)):
                yield base + f
