"""A corpus: sources and the tables parsed from them, each computed once and shared by all detectors."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sievework import schemas
from sievework.functions import declare
from sievework.functions.scan import SCANNERS, scan_facts
from sievework.operators.clustering import first_match
from sievework.session import ship

import sievework.functions.config_rules  # noqa: F401  registers its scanners
import sievework.functions.flow  # noqa: F401  registers its scanners

_PARSED = re.compile(r"\.(?:ts|tsx)$")


def _emit(schema: StructType, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], to_arrow_type(f.dataType)) for f in schema.fields], schema.names)


def _parser(what: str, schema: StructType, extensions: str):
    wanted = re.compile(extensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = getattr(declare, what)
        for b in batches:
            rows = []
            for ws, path, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if path and text and wanted.search(path):
                    rows += [r | {"workspace": ws} for r in fn(path, text)]
            yield _emit(schema, rows)

    return run


def _candidates(source: str, specifier: str, aliases: Sequence[tuple[str, bool, Sequence[str]]], prefix: str) -> list[str]:
    """Paths that a specifier may mean, in order: the path, its source suffixes, then aliases by longest prefix."""

    def suffixes(t: str) -> list[str]:
        out = [t, f"{t}.ts", f"{t}.tsx", f"{t}/index.ts", f"{t}/index.tsx", f"{t}.d.ts", f"{t}/index.d.ts"]
        return out + ([t[:-3] + ".ts", t[:-3] + ".tsx"] if t.endswith(".js") else [])

    if specifier.startswith("."):
        t = posixpath.normpath(posixpath.join(posixpath.dirname(source), specifier))
        return [] if t.startswith("..") else suffixes(t)
    if specifier.startswith("/"):
        return suffixes(specifier.lstrip("/"))
    out: list[str] = []
    for head, wild, targets in sorted(aliases, key=lambda a: -len(a[0])):
        if wild and specifier.startswith(head) or specifier == head:
            for t in targets:
                out += suffixes(posixpath.normpath(prefix + (t.replace("*", specifier[len(head) :], 1) if wild else t)))
    return out


def _resolver(aliases: Mapping[str | None, Sequence[tuple[str, bool, Sequence[str]]]], schema: StructType, multi: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                prefix = f"{r['workspace']}/" if multi and r["workspace"] is not None else ""
                r["candidates"] = _candidates(r["source"], r["specifier"], aliases.get(r["workspace"], ()), prefix)
            yield _emit(schema, rows)

    return run


@dataclass
class Corpus:
    """``sources`` is (workspace, path, text); with ``multi`` paths are told apart by their workspace.

    ``aliases`` are the path mappings of each workspace's compiler configuration, a small dimension
    by nature: (prefix, wildcard, targets). ``packages`` is (workspace, package_name) or None.
    """

    sources: DataFrame
    multi: bool = False
    aliases: Mapping[str | None, Sequence[tuple[str, bool, Sequence[str]]]] = field(default_factory=dict)
    packages: DataFrame | None = None
    file_mtime: DataFrame | None = None
    given_symbols: DataFrame | None = None
    shared: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.sources.sparkSession

    @cached_property
    def files(self) -> DataFrame:
        """(workspace, path, local, text); path is unique, local is as in the workspace."""
        ship(self.spark)
        local = F.regexp_replace("path", r"\\", "/")
        path = F.concat_ws("/", "workspace", local) if self.multi else local
        return self.sources.filter("path IS NOT NULL").select("workspace", path.alias("path"), local.alias("local"), "text")

    @cached_property
    def facts(self) -> DataFrame:
        """Fact rows of all scanners in one pass over the texts."""
        return scan_facts(self.files, list(SCANNERS)).persist()

    def fact(self, *kinds: str) -> DataFrame:
        """Facts of these kinds, from the shared table if several detectors run, else by one scan for them."""
        return self.facts.filter(F.col("kind").isin(*kinds)) if self.shared else self.scan(*kinds)

    def release(self) -> None:
        """Gives back the tables that were kept for this corpus."""
        for name in ("facts", "symbols", "imports", "entries"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()

    def scan(self, *kinds: str) -> DataFrame:
        """Facts of a few kinds without touching the shared table."""
        return scan_facts(self.files, kinds)

    @cached_property
    def symbols(self) -> DataFrame:
        """Declared symbols of .ts and .tsx files, or the given table."""
        if self.given_symbols is not None:
            return self.given_symbols
        schema = StructType.fromDDL(schemas.SYMBOLS)
        return self.files.select("workspace", "path", "text").mapInArrow(_parser("symbols", schema, r"\.(?:ts|tsx)$"), schema).persist()

    @cached_property
    def imports(self) -> DataFrame:
        """Import records with their targets, null where a specifier leads out of the corpus."""
        raw = StructType.fromDDL(schemas.RAW_IMPORTS)
        found = StructType.fromDDL(schemas.RAW_IMPORTS + ", candidates array<string>")
        imp = self.files.select("workspace", "path", "text").mapInArrow(_parser("imports", raw, r"\.(?:ts|tsx)$"), raw)
        imp = imp.mapInArrow(_resolver(dict(self.aliases), found, self.multi), found)
        imp = imp.withColumn("_id", F.xxhash64("source", "specifier", F.to_json(F.struct("named_imports", "default_import", "namespace_alias", "is_re_export", "is_star_re_export", "re_export_local_names")))).persist()
        target = first_match(imp.dropDuplicates(["_id"]), "candidates", self.files, "path", ["_id"])
        out = imp.drop("candidates").join(target, "_id", "left").drop("_id").withColumn("source_workspace", F.col("workspace")).withColumn("target_workspace", F.when(F.col("target").isNotNull(), F.col("workspace")))
        if self.packages is not None:
            # a sibling package by name, by equality on the npm package part of the specifier
            part = F.regexp_extract("specifier", r"^((?:@[^/]+/)?[^/]+)", 1)
            p = self.packages.filter("package_name IS NOT NULL").groupBy("package_name").agg(F.min("workspace").alias("sibling"))
            out = out.join(F.broadcast(p) if p.count() <= 100_000 else p, part == p.package_name, "left")
            rest = F.regexp_replace("specifier", r"^(?:@[^/]+/)?[^/]+/?", "")
            tries = F.when(rest == "", F.array(*[F.concat("sibling", F.lit(f"/{x}")) for x in ("src/index.ts", "src/index.tsx", "index.ts", "index.tsx")])).otherwise(
                F.array(*[F.concat("sibling", F.lit("/"), F.lit(pre), rest, F.lit(x)) for pre in ("src/", "") for x in ("", ".ts", ".tsx", "/index.ts")])
            )
            out = out.withColumn("_k", F.when(F.col("target").isNull() & F.col("sibling").isNotNull(), F.xxhash64("sibling", "specifier"))).withColumn("_t", tries)
            hit = first_match(out.filter("_k IS NOT NULL").dropDuplicates(["_k"]), "_t", self.files, "path", ["_k"]).withColumnRenamed("target", "sibling_target")
            out = out.join(hit, "_k", "left").withColumn("target_workspace", F.when(F.col("sibling_target").isNotNull(), F.col("sibling")).otherwise(F.col("target_workspace"))).withColumn("target", F.coalesce("target", "sibling_target"))
            out = out.drop("_k", "_t", "sibling", "package_name", "sibling_target")
        return out.persist()
