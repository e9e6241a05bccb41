"""Detectors over imports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.clustering import anti_chain, names_in_use, origins
from sievework.operators.graph import edges_of, forward_re_exports, in_degree, nodes_of, reach
from sievework.plans.corpus import Corpus
from sievework.plans.detectors import detector, finding, fingerprint, site
from sievework.plans.detectors.symbols import distinct_symbols
from sievework.session import Scratch

_C = F.col

#: File names and folders by which tools load files (fixed conventions).
ENTRY_NAMES = "index.ts index.tsx main.ts main.tsx cli.ts mcp-server.ts server.ts middleware.ts middleware.tsx instrumentation.ts instrumentation-client.ts mod.ts worker.ts worker.tsx".split()
ENTRY_PATTERNS = (
    r"^(?:scripts|bin)/", r"(?:^|/)(?:__tests__|__fixtures__|__mocks__|tests|test|e2e|examples|demo|benchmarks?|pages|routes|functions|handlers|lambdas?)/", r"^[^/]*\.config\.(?:ts|tsx|mts|cts)\z",
    r"\.(?:test|spec)\.(?:ts|tsx)\z", r"(?:^|/)(?:src/)?app/(?:.*/)?(?:page|route|layout|loading|error|template|not-found|head|default|global-error)\.(?:ts|tsx)\z",
    r"(?:^|/)api/.*\.(?:ts|tsx)\z", r"(?:^|/)netlify/(?:functions|edge-functions)/", r"(?:^|/)(?:bin|infra|cdk)/.*\.(?:ts|tsx)\z", r"\.stack\.(?:ts|tsx)\z",
)
HANDLERS = r"(?:^|/)(?:handlers|lambdas?|functions)/|(?:^|/)netlify/(?:functions|edge-functions)/"


def is_entry(local: Column) -> Column:
    out = F.element_at(F.split(local, "/"), -1).isin(*ENTRY_NAMES)
    for p in ENTRY_PATTERNS:
        out = out | local.rlike(p)
    return out


def _wired(c: Corpus, kind: str) -> DataFrame:
    """Files that facts of a kind name, by their candidates."""
    return c.fact(kind).select(F.explode("items").alias("path")).join(c.files.select("path"), "path", "left_semi").distinct()


def entry_points(c: Corpus) -> DataFrame:
    """Files loaded by convention, package manifests, infrastructure code or framework decorators."""
    a = c.files.filter(is_entry(_C("local"))).select("path")
    # what manifests and infrastructure name, and decorated files themselves: one pass over the texts
    f = c.fact("pkg_entry", "iac_entry", "decorated").select(F.explode(F.when(_C("kind") == "decorated", F.array("path")).otherwise(_C("items"))).alias("path"))
    return Scratch(c.spark, "entries").cut(a.union(f.distinct().join(c.files.select("path"), "path", "left_semi")).distinct())


def _parsed(c: Corpus) -> DataFrame:
    return c.files.filter(_C("path").rlike(r"\.(?:ts|tsx)\z")).select("workspace", "path", "local").distinct()


def _whole() -> Column:
    return F.array(site(_C("path"), F.lit(1), F.lit(1)))


@detector("dead-module")
def dead_module(c: Corpus) -> DataFrame:
    """Files that are no entry and that no entry reaches."""
    seeds = entry_points(c)
    d = anti_chain(_parsed(c), (seeds, ["path"]), (reach(edges_of(c.imports), seeds, nodes_of(c.imports)).withColumnRenamed("node", "path"), ["path"]))
    d = d.filter(~_C("path").rlike(r"\.d\.ts\z|\.stor(?:y|ies)\.tsx?\z"))
    return finding(d, "dead-module", "low", 0.7, F.concat(F.lit("Unreachable module: "), "path"), _whole(), fingerprint("dead-module", _C("path")), suggestion="Delete it or name it as an entry.")


def consumption(imports: DataFrame) -> DataFrame:
    """(file, name): what importers take of a file; ``*`` for all of it, ``default`` for its default."""
    i = imports.filter("target IS NOT NULL")
    every = i.filter("namespace_alias IS NOT NULL OR is_star_re_export").select(_C("target").alias("file"), F.lit("*").alias("name"))
    default = i.filter("default_import IS NOT NULL").select(_C("target").alias("file"), F.lit("\0default").alias("name"))
    named = i.select(_C("target").alias("file"), F.explode("named_imports").alias("name"))
    return every.union(default).union(named).distinct()


@detector("dead-export")
def dead_export(c: Corpus) -> DataFrame:
    """Exported symbols that nobody imports and that their own file doesn't use elsewhere."""
    used = consumption(c.imports)
    s = distinct_symbols(c.symbols).filter("exported").withColumn("path", _C("file")).filter(~_C("file").rlike(r"\.d\.ts\z|(?:^|/)__(?:fixtures|mocks)__/|\.stor(?:y|ies)\.tsx?\z"))
    all_ = used.filter("name = '*'").select(_C("file"))
    default = used.filter(_C("name") == "\0default").select(_C("file"), F.lit(True).alias("is_default"))
    d = anti_chain(s, (entry_points(c).withColumnRenamed("path", "file"), ["file"]), (all_, ["file"]), (used, ["file", "name"]), (default, ["file", "is_default"]))
    # used by another symbol of the same file, as a whole word
    words = F.array_distinct(F.concat(F.regexp_extract_all("source", F.lit("([A-Za-z0-9_]+)"), 1), F.regexp_extract_all("source", F.lit("([A-Za-z0-9_]*[$][A-Za-z0-9_$]*)"), 1)))
    others = distinct_symbols(c.symbols).filter("source IS NOT NULL").select(_C("file").alias("f2"), _C("id").alias("i2"), F.explode(words).alias("w2"))
    d = d.join(others, (_C("file") == _C("f2")) & (_C("name") == _C("w2")) & (_C("id") != _C("i2")), "left_anti")
    title = F.concat(F.lit("Unused export: "), "name", F.lit(" in "), "file")
    return finding(d, "dead-export", "low", 0.65, title, F.array(site(_C("file"), _C("line_range.start_line"), _C("line_range.end_line"))), fingerprint("dead-export", _C("file"), "::", _C("name")), suggestion="Drop the export.")


@detector("dead-api")
def dead_api(c: Corpus) -> DataFrame:
    """Exports of a workspace that no other workspace consumes, directly or through re-exports."""
    i = c.imports.filter("target IS NOT NULL")
    cross = consumption(i.filter("source_workspace IS NOT NULL AND target_workspace IS NOT NULL AND source_workspace != target_workspace"))
    re_ = i.filter("is_re_export")
    star = re_.filter("is_star_re_export").select(_C("source").alias("src"), _C("target").alias("dst"))
    named = re_.filter("NOT is_star_re_export").select(_C("source").alias("src"), _C("target").alias("dst"), F.explode(F.coalesce("re_export_names", "named_imports")).alias("name"))
    used = forward_re_exports(cross.filter(_C("name") != "\0default"), star, named)
    default = cross.filter(_C("name") == "\0default").select("file")
    s = distinct_symbols(c.symbols).filter("exported AND workspace IS NOT NULL")
    d = anti_chain(s, (used.filter("name = '*'"), ["file"]), (default, ["file"]), (used, ["file", "name"]))
    title = F.concat(F.lit("No other workspace uses "), "name", F.lit(" of "), "file")
    return finding(d, "dead-api", "low", 0.7, title, F.array(site(_C("file"), _C("line_range.start_line"), _C("line_range.end_line"))), fingerprint("dead-api", _C("workspace"), "::", _C("file"), "::", _C("name")), suggestion="Keep it internal.")


@detector("hot-hub-file")
def hot_hub_file(c: Corpus, threshold: int = 20, limit: int | None = 10) -> DataFrame:
    """Files with many importers, the most imported first."""
    g = in_degree(edges_of(c.imports), threshold, limit).withColumnRenamed("dst", "path")
    return finding(g, "hot-hub-file", "low", 1.0, F.concat(F.lit("Import hub: "), "path", F.lit(" ("), _C("n").cast("string"), F.lit(" importers)")), _whole(), fingerprint("hot-hub-file", _C("path")), suggestion="Split it.", workspace=F.lit(None))


@detector("re-export-shadow")
def re_export_shadow(c: Corpus) -> DataFrame:
    """Names that a file publishes from two origins or more; a local export is one origin."""
    i = c.imports.filter("is_re_export AND target IS NOT NULL")
    r = i.select(_C("source").alias("file"), F.explode(F.coalesce("re_export_local_names", "re_export_names")).alias("name"), _C("target").alias("origin"))
    local = distinct_symbols(c.symbols).filter("exported").select("file", "name", F.lit("\0local").alias("origin")).join(r.select("file", "name").distinct(), ["file", "name"], "left_semi")
    g = origins(r.union(local), ["file", "name"], "origin", own=F.max((_C("origin") == "\0local").cast("int"))).withColumn("path", _C("file"))
    title = F.concat(F.lit("`"), "name", F.lit("` has "), _C("n").cast("string"), F.lit(" origins in "), "file")
    return finding(g, "re-export-shadow", F.when(_C("own") == 1, "high").otherwise("medium"), 0.92, title, _whole(), fingerprint("re-export-shadow", _C("file"), "::", _C("name")), suggestion="Publish one of them.", workspace=F.lit(None))


@detector("default-export-name-drift")
def default_name_drift(c: Corpus) -> DataFrame:
    """Default exports that importers know by different names."""
    owners = distinct_symbols(c.symbols).filter("is_default").select(_C("file").alias("target")).distinct()
    d = c.imports.filter("default_import IS NOT NULL AND target IS NOT NULL").join(owners, "target", "left_semi")
    g = names_in_use(d, "target", "default_import").withColumn("path", _C("target"))
    title = F.concat(F.lit("Default export of "), "target", F.lit(" goes by "), F.array_join("ranked", ", "))
    return finding(g, "default-export-name-drift", "low", 0.95, title, _whole(), fingerprint("default-export-name-drift", _C("target")), suggestion="Agree on one name.", workspace=F.lit(None))


@detector("dead-handler")
def dead_handler(c: Corpus) -> DataFrame:
    """Handler files that neither infrastructure code nor an import names."""
    h = _parsed(c).filter(_C("path").rlike(HANDLERS) & ~_C("path").rlike(r"\.d\.ts\z|\.(?:test|spec)\.(?:ts|tsx)\z"))
    d = anti_chain(h, (_wired(c, "iac_entry"), ["path"]), (c.imports.filter("target IS NOT NULL").select(_C("target").alias("path")), ["path"]))
    return finding(d, "dead-handler", "low", 0.65, F.concat(F.lit("Handler without wiring: "), "path"), _whole(), fingerprint("dead-handler", _C("path")), suggestion="Wire it or delete it.")
