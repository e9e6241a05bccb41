"""Configuration files: a string-aware JSONC reader and the rules for compiler and linter settings."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

from sievework.functions.lex import Source
from sievework.functions.scan import _fact, scanner

_JSONC = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*[\s\S]*?\*/')


def read_jsonc(text: str) -> object | None:
    """JSON with comments and trailing commas; strings such as "@/*" stay whole. None if it can't be read."""
    bare = _JSONC.sub(lambda m: m[0] if m[0][0] == '"' else " ", text.lstrip("﻿"))
    bare = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)
    try:
        return json.loads(bare)
    except ValueError:
        return None


def merge_extends(own: dict, bases: list[dict]) -> dict:
    """A compiler configuration with the options of what it extends, nearest last and its own on top."""
    out: dict = {}
    for c in [*bases, own]:
        opts = {**out.get("compilerOptions", {}), **(c.get("compilerOptions") or {})}
        out = {**out, **c, "compilerOptions": opts}
    return out


#: (key, severity, wrong value test) of compiler options (fixed rules).
def tsconfig_rules(o: dict) -> Iterator[tuple[str, str, str]]:
    if o.get("strict") is False:
        yield "strict", "high", "strict disabled"
    elif "strict" not in o and o.get("strictNullChecks") is not True and o.get("noImplicitAny") is not True:
        yield "compilerOptions", "medium", "strict not set"
    for key, sev in (("noImplicitAny", "high"), ("strictNullChecks", "high"), ("noImplicitReturns", "low"), ("noFallthroughCasesInSwitch", "low")):
        if o.get(key) is False:
            yield key, sev, f"{key} disabled"
    for key in ("noUnusedLocals", "noUnusedParameters"):
        if o.get(key) is False:
            yield key, "low", "unused-symbol checks disabled"
            break
    if o.get("noUncheckedIndexedAccess") is False:
        yield "noUncheckedIndexedAccess", "low", "noUncheckedIndexedAccess disabled"
    if o.get("allowJs") is True and o.get("checkJs") is not True:
        yield "allowJs", "medium", "allowJs without checkJs"
    if isinstance(o.get("target"), str) and re.fullmatch(r"ES[35]", o["target"], re.IGNORECASE):
        yield "target", "low", f"target is {o['target']}"
    if isinstance(o.get("module"), str) and o["module"].lower() == "commonjs" and o.get("esModuleInterop") is not True:
        yield "module", "low", "module is CommonJS"
    for key in ("suppressImplicitAnyIndexErrors", "suppressExcessPropertyErrors"):
        if o.get(key) is True:
            yield key, "high", "error-suppression flag enabled"
            break


#: Lint rules whose switching off is reported, with severities (fixed).
ESLINT = (("@typescript-eslint/no-explicit-any", "high"), ("@typescript-eslint/no-non-null-assertion", "medium"), ("@typescript-eslint/no-unused-vars", "medium"), ("eqeqeq", "medium"))


def _off(v: object) -> bool:
    v = v[0] if isinstance(v, list) and v else v
    return v == "off" or (v == 0 and v is not False and not isinstance(v, bool))


def is_config(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    if re.fullmatch(r"tsconfig(?:\.[\w.-]+)?\.json", name):
        return "tsconfig"
    if re.fullmatch(r"\.eslintrc(?:\.json)?|\.eslintrc\.jsonc", name):
        return "eslint"
    if re.fullmatch(r"\.eslintrc\.[cm]?js|eslint\.config\.[cm]?[jt]s", name):
        return "eslint-script"
    return "biome" if re.fullmatch(r"biome\.jsonc?", name) else None


@scanner("config")
def config_rules(path: str, src: Source) -> Iterator[tuple]:
    kind = is_config(path)
    if kind is None:
        return
    found: list[tuple[str, str, str]] = []
    if kind == "eslint-script":
        for rule, sev in ESLINT:
            if re.search(rf"['\"]?{re.escape(rule)}['\"]?\s*:\s*(?:\[\s*)?(?:['\"]off['\"]|0\b)", src.text):
                found.append((rule, sev, f"{rule} disabled"))
    else:
        root = read_jsonc(src.text)
        if not isinstance(root, dict):
            return
        if kind == "tsconfig":
            if root.get("extends"):
                return  # judged with the options of its bases, see ``tsconfig``
            opts = root.get("compilerOptions")
            found = list(tsconfig_rules(opts if isinstance(opts, dict) else {}))
        elif kind == "eslint":
            rules = root.get("rules") if isinstance(root.get("rules"), dict) else {}
            found = [(n, s, f"{n} disabled") for n, s in ESLINT if n in rules and _off(rules[n])]
        else:
            linter = root.get("linter") if isinstance(root.get("linter"), dict) else {}
            rules = linter.get("rules") if isinstance(linter.get("rules"), dict) else {}
            sus, style = (rules.get(k) if isinstance(rules.get(k), dict) else {} for k in ("suspicious", "style"))
            if sus.get("noExplicitAny") == "off":
                found.append(("noExplicitAny", "high", "noExplicitAny disabled"))
            if style.get("noNonNullAssertion") == "off":
                found.append(("noNonNullAssertion", "medium", "noNonNullAssertion disabled"))
            if linter.get("enabled") is False:
                found.append(("linter.enabled", "medium", "linter disabled"))
    yield from _reported(src, kind, found)


def _reported(src: Source, kind: str, found: list[tuple[str, str, str]]) -> Iterator[tuple]:
    for key, sev, title in found:
        m = re.search(rf"['\"]?{re.escape(key.split('.')[-1])}['\"]?\s*:", src.text)
        n = src.line(m.start()) if m else 1
        yield _fact(src, n, n, key, {"severity": sev, "title": f"{kind.split('-')[0]}: {title}"}, around=(0, 1))


def base_paths(path: str, extends: object) -> list[list[str]]:
    """For each configuration that ``path`` extends, the paths it may lie at; the last base comes last."""
    out = []
    for e in extends if isinstance(extends, list) else [extends]:
        if not isinstance(e, str) or not e:
            continue
        here = posixpath.dirname(path)
        if e.startswith("."):
            t = posixpath.normpath(posixpath.join(here, e))
            out.append([t, t + ".json"])
            continue
        tries = []
        while True:  # a package, from the folder's own modules up to the root's
            t = posixpath.join(here, "node_modules", e)
            tries += [t, t + ".json", t + "/tsconfig.json"]
            if not here:
                break
            here = posixpath.dirname(here)
        out.append(tries)
    return out


@scanner("tsconfig")
def tsconfig(path: str, src: Source) -> Iterator[tuple]:
    """Compiler configurations as they are: options, and where the bases may lie, nearest last."""
    root = read_jsonc(src.text) if re.search(r"\.json$", path) else None
    if isinstance(root, dict) and ("compilerOptions" in root or "extends" in root):
        bases = base_paths(path, root.get("extends"))
        opts = root.get("compilerOptions")
        yield _fact(src, 1, 1, path, {"options": json.dumps(opts if isinstance(opts, dict) else {}), "extends": json.dumps(bases), "text": src.text if bases else ""}, around=(0, 0))


def judged(path: str, text: str, bases: list[dict]) -> Iterator[tuple]:
    """Facts of a configuration that extends others; ``bases`` are their options, farthest first."""
    root = read_jsonc(text)
    if is_config(path) == "tsconfig" and isinstance(root, dict):
        merged = merge_extends(root, [{"compilerOptions": b} for b in bases])
        yield from _reported(Source(text), "tsconfig", list(tsconfig_rules(merged["compilerOptions"])))
