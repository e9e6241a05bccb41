"""Workspaces on disk: configuration, monorepo detection, compiler settings and corpus loading."""

from __future__ import annotations

import json
import os
import posixpath
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.config_rules import merge_extends, read_jsonc
from sievework.plans.corpus import Corpus
from sievework.session import ship
from sievework.sources.ignore import enumerate_files, load_ignore

CONFIG_FILES = ("sievework.config.json", ".sievework.json")
DEFAULT_EXTENSIONS = (".ts", ".tsx")
#: Project notes that give a verdict context (fixed names), and their budget in characters.
CONVENTION_FILES = "AGENTS.md .cursorrules CONTRIBUTING.md CONVENTIONS.md STYLEGUIDE.md README.md .editorconfig".split()
CONVENTION_CHARS = 6000


@dataclass(frozen=True)
class Workspace:
    name: str
    root: str
    package_name: str | None = None


@dataclass
class Settings:
    """Persisted values over defaults."""

    detectors: dict[str, bool] = field(default_factory=dict)
    min_confidence: float = 0.0
    llm_concurrency: int = 4
    llm_auto_fp_threshold: float = 0.6

    @classmethod
    def load(cls, path: str) -> Settings:
        try:
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
        except (OSError, ValueError):
            raw = {}
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__} if isinstance(raw, dict) else {}
        return cls(**known)

    def save(self, path: str) -> None:
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump(self.__dict__, f, indent=2, sort_keys=True)
        os.replace(path + ".new", path)


def recent(store: Sequence[str], root: str, keep: int = 10) -> list[str]:
    """Most recently used roots, newest first."""
    return [root, *[r for r in store if r != root]][:keep]


def inside(root: str, path: str) -> str | None:
    """Absolute path if it lies under ``root``, else None."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    return full if full == base or full.startswith(base + os.sep) else None


def read_source(root: str, path: str) -> str | None:
    full = inside(root, path)
    try:
        with open(full, encoding="utf-8", errors="replace", newline="") as f:
            return f.read()
    except (OSError, TypeError):
        return None


def _json(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            x = read_jsonc(f.read())
    except OSError:
        x = None
    return x if isinstance(x, dict) else {}


def load_config(root: str) -> list[Workspace] | None:
    """Workspaces of the configuration file, else detected ones, else None for a single workspace.

    Unknown keys, missing folders and repeated names are errors.
    """
    for n in CONFIG_FILES:
        p = os.path.join(root, n)
        if not os.path.exists(p):
            continue
        raw = _json(p)
        if set(raw) - {"workspaces", "$schema"} or not isinstance(raw.get("workspaces"), list):
            raise ValueError(f"{n}: expected only workspaces, a list")
        out = []
        for w in raw["workspaces"]:
            if not isinstance(w, dict) or set(w) - {"name", "path", "packageName"} or not isinstance(w.get("name"), str) or not isinstance(w.get("path"), str):
                raise ValueError(f"{n}: a workspace has a name, a path and maybe a packageName")
            full = os.path.join(root, w["path"])
            if not os.path.isdir(full):
                raise ValueError(f"{n}: no such folder: {w['path']}")
            out.append(Workspace(w["name"], full, w.get("packageName") or _json(os.path.join(full, "package.json")).get("name")))
        if len({w.name for w in out}) < len(out):
            raise ValueError(f"{n}: a name occurs twice")
        return out
    return detect_monorepo(root) or None


def detect_monorepo(root: str) -> list[Workspace]:
    """Packages named by package.json, the pnpm file or the nx layout; literal folders or one trailing /*."""
    pkg = _json(os.path.join(root, "package.json")).get("workspaces")
    globs = list(pkg.get("packages", []) if isinstance(pkg, dict) else pkg or [])
    pnpm = read_source(root, "pnpm-workspace.yaml") or ""
    block = re.search(r"(?m)^packages:\s*\n((?:[ \t]*(?:-.*|#.*)?\n?)*)", pnpm)
    globs += [m[1] for m in re.finditer(r"(?m)^\s*-\s*['\"]?([^'\"\n#]+?)['\"]?\s*(?:#.*)?$", block[1] if block else "")]
    nx = _json(os.path.join(root, "nx.json")).get("workspaceLayout")
    if isinstance(nx, dict):
        globs += [f"{nx[k]}/*" for k in ("appsDir", "libsDir") if isinstance(nx.get(k), str)]
    out_of = {g[1:].strip("/") for g in globs if g.startswith("!")}
    dirs: list[str] = []
    for g in globs:
        g = g.strip("/").removeprefix("./")
        if g.startswith("!") or "*" in g[:-2] or (g.endswith("*") and not g.endswith("/*")):
            continue
        if g.endswith("/*"):
            base = os.path.join(root, g[:-2])
            dirs += [f"{g[:-2]}/{d}" for d in sorted(os.listdir(base)) if os.path.isdir(os.path.join(base, d))] if os.path.isdir(base) else []
        else:
            dirs.append(g)
    found: dict[str, Workspace] = {}
    for d in dirs:
        manifest = os.path.join(root, d, "package.json")
        if d not in out_of and os.path.isfile(manifest):
            full = _json(manifest).get("name") or posixpath.basename(d)
            name = full.split("/")[-1]
            found[name] = Workspace(name, os.path.join(root, d), full)
    return [found[k] for k in sorted(found)]


def tsconfig_aliases(root: str, depth: int = 8) -> list[tuple[str, bool, list[str]]]:
    """(prefix, wildcard, targets) of the path mappings, longest prefix first, the base folder last.

    What the file extends is merged below it, up to ``depth`` files, each at most once.
    """
    chain, seen, at = [], set(), os.path.join(root, "tsconfig.json")
    while at and len(chain) < depth and os.path.realpath(at) not in seen and os.path.isfile(at):
        seen.add(os.path.realpath(at))
        c = _json(at)
        chain.append((at, c))
        up = c.get("extends")
        if not isinstance(up, str):
            break
        up = up if up.endswith(".json") else up + ".json"
        at = os.path.normpath(os.path.join(os.path.dirname(at), up)) if up.startswith(".") else os.path.join(root, "node_modules", up)
    if not chain:
        return []
    merged = merge_extends(chain[0][1], [c for _, c in reversed(chain[1:])])
    opts = merged.get("compilerOptions") or {}
    owner = next((os.path.dirname(p) for p, c in chain if "baseUrl" in (c.get("compilerOptions") or {})), os.path.dirname(chain[0][0]))
    base = os.path.relpath(os.path.join(owner, opts.get("baseUrl", ".")), root).replace(os.sep, "/")
    join = lambda t: posixpath.normpath(posixpath.join(base, t))
    out = []
    for k, ts in (opts.get("paths") or {}).items():
        wild = k.endswith("*")
        out.append((k[:-1] if wild else k, wild, [join(t) for t in ts if isinstance(t, str)]))
    out.sort(key=lambda a: -len(a[0]))
    if "baseUrl" in opts:
        out.append(("", True, [join("*")]))
    return out


_CONFIG_NAMES = re.compile(r"^(?:package\.json|tsconfig.*\.json|\.eslintrc.*|eslint\.config\..*|biome\.jsonc?|\.env\..*|.*\.(?:example|sample|template)|Dockerfile.*|docker-compose.*\.ya?ml)$")
#: Levels of folders that the driver lists; what lies deeper is walked by the executors.
LISTED_LEVELS = 2


def _pieces(root: str) -> list[tuple[str, bool]]:
    """(folder, whole) of a workspace: folders above the listed levels give their own files only, the others all below them."""
    out, level = [], [""]
    for depth in range(LISTED_LEVELS + 1):
        out += [(d, depth == LISTED_LEVELS) for d in level]
        if depth < LISTED_LEVELS:
            level = [sub for d in level for sub in _folders(root, d)]
    return out


def _folders(root: str, d: str) -> list[str]:
    """Folders in ``d`` that aren't ignored."""
    base, ignore = f"{d}/" if d else "", load_ignore(root, below=d, deep=False)
    return sorted(base + e.name for e in os.scandir(os.path.join(root, d)) if e.is_dir(follow_symlinks=False) and not ignore.ignores(f"{base}{e.name}/"))


def _reader(wanted: tuple[str, ...], keep: frozenset[str] | None):
    """(workspace, root, folder, whole) to (workspace, path, text) of the wanted files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, root, folder, whole in zip(*(c.to_pylist() for c in b.columns)):
                ignore = load_ignore(root, below=folder, deep=whole)
                if whole:
                    paths = enumerate_files(root, ignore, below=folder)
                else:
                    base = f"{folder}/" if folder else ""
                    paths = (base + e.name for e in sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name) if e.is_file() and not ignore.ignores(base + e.name))
                held: list[tuple[str, str]] = []
                size = 0
                for p in paths:
                    if (os.path.splitext(p)[1] in wanted or _CONFIG_NAMES.match(posixpath.basename(p))) and (keep is None or p in keep) and (text := read_source(root, p)) is not None:
                        held.append((p, text))
                        size += len(text)
                        if size > 16 << 20:
                            yield _sources_batch(name, held)
                            held, size = [], 0
                if held:
                    yield _sources_batch(name, held)

    return run


def _sources_batch(name: str, held: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array([p for p, _ in held], pa.string()), pa.array([t for _, t in held], pa.string())], ["workspace", "path", "text"])


def load_sources(spark: SparkSession, workspaces: Sequence[Workspace], extensions: Iterable[str] = DEFAULT_EXTENSIONS, only: Sequence[str] | None = None) -> DataFrame:
    """``(workspace, path, text)`` of the files that aren't ignored, sources and configuration.

    The driver lists the first folders only; executors walk, filter and read what lies below, so the roots must be
    folders that all of them see. ``only`` restricts to these paths; an empty list means all.
    """
    ship(spark)
    out = None
    for w in workspaces:
        root = os.path.realpath(w.root)
        keep = frozenset(os.path.relpath(p, w.root).replace(os.sep, "/") if os.path.isabs(p) else p for p in only) if only else None
        pieces = [(w.name, root, d, whole) for d, whole in _pieces(root)]
        d = spark.createDataFrame(pieces, "workspace string, root string, folder string, whole boolean").repartition(max(1, min(len(pieces), 4 * spark.sparkContext.defaultParallelism)), "folder")
        d = d.mapInArrow(_reader(tuple(extensions), keep), "workspace string, path string, text string")
        out = d if out is None else out.unionByName(d)
    return out if out is not None else spark.createDataFrame([], "workspace string, path string, text string")


def load_corpus(spark: SparkSession, root: str, extensions: Iterable[str] = DEFAULT_EXTENSIONS, only: Sequence[str] | None = None) -> Corpus:
    """The corpus of a folder, multi-workspace where it is configured or detected."""
    ws = load_config(root)
    if ws is None:
        return Corpus(load_sources(spark, [Workspace("", root)], extensions, only).withColumn("workspace", F.lit(None).cast("string")), aliases={None: tsconfig_aliases(root)})
    packages = spark.createDataFrame([(w.name, w.package_name) for w in ws], "workspace string, package_name string")
    return Corpus(load_sources(spark, ws, extensions, only), multi=True, aliases={w.name: tsconfig_aliases(w.root) for w in ws}, packages=packages)


def conventions(root: str, path: str, names: Sequence[str] = CONVENTION_FILES, budget: int = CONVENTION_CHARS) -> str:
    """Project notes from the file's folder up to the root, deepest first, within a budget of characters."""
    out, d = [], posixpath.dirname(path)
    left = budget
    while True:
        for n in names:
            t = read_source(root, posixpath.join(d, n))
            if t and left > 0:
                out.append(t[:left])
                left -= len(out[-1])
        if not d:
            return "\n\n".join(out)
        d = posixpath.dirname(d)
