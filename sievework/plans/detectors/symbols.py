"""Detectors over the symbol table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.lex import nesting_depth
from sievework.operators.clustering import first_per, hash_edges, merge_signals
from sievework.operators.components import connected_components
from sievework.operators.similarity import scored_links, set_similarity_join
from sievework.plans.corpus import Corpus
from sievework.plans.detectors import detector, finding, fingerprint, site, steps
from sievework.session import Scratch

_C = F.col


def _first_lines(n: int = 4) -> Column:
    return F.array_join(F.slice(F.split("source", "\n"), 1, n), "\n")


def _here() -> Column:
    return F.array(site(_C("file"), _C("line_range.start_line"), _C("line_range.end_line"), _first_lines()))


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols without repeated deliveries of one id."""
    return symbols.filter("id IS NOT NULL").dropDuplicates(["id"])


@detector("long-function")
def long_function(c: Corpus, low: int = 60, med: int = 120, high: int = 200) -> DataFrame:
    n = _C("line_range.end_line") - _C("line_range.start_line") + 1
    d = distinct_symbols(c.symbols).filter((_C("kind") == "function") & ~_C("name").isin("describe", "it", "test", "suite", "context")).withColumn("n", n).withColumn("sev", steps(_C("n"), low, med, high)).filter("sev IS NOT NULL")
    title = F.concat(F.lit("Long function: `"), "name", F.lit("` ("), _C("n").cast("string"), F.lit(" lines) in "), "file")
    return finding(d, "long-function", _C("sev"), 0.98, title, _here(), fingerprint("long-function", _C("file"), ":", _C("name"), ":", _C("line_range.start_line")), suggestion="Extract helpers.")


@detector("deep-nesting")
def deep_nesting(c: Corpus, low: int = 4, med: int = 5, high: int = 6) -> DataFrame:
    @F.pandas_udf("int")
    def depth(s: pd.Series) -> pd.Series:
        return s.map(nesting_depth)

    d = distinct_symbols(c.symbols).filter("kind = 'function'").withColumn("depth", depth("source")).withColumn("sev", steps(_C("depth"), low, med, high)).filter("sev IS NOT NULL")
    title = F.concat(F.lit("Deeply nested function: `"), "name", F.lit("` (depth "), _C("depth").cast("string"), F.lit(") in "), "file")
    return finding(d, "deep-nesting", _C("sev"), 0.85, title, _here(), fingerprint("deep-nesting", _C("file"), ":", _C("name"), ":", _C("line_range.start_line")), suggestion="Return early.")


#: The word any, by ASCII word boundaries.
ANY = r"(?<![A-Za-z0-9_])any(?![A-Za-z0-9_])"


@detector("public-any")
def public_any(c: Corpus) -> DataFrame:
    bad = F.transform(F.filter("fn_struct.params", lambda p: p["type"].rlike(ANY)), lambda p: p["name"])
    d = distinct_symbols(c.symbols).filter("kind = 'function' AND exported AND fn_struct IS NOT NULL").withColumn("bad", F.coalesce(bad, F.array())).withColumn("ret", F.coalesce(_C("fn_struct.return_type").rlike(ANY), F.lit(False)))
    d = d.filter("size(bad) > 0 OR ret")
    return finding(d, "public-any", "high", 0.97, F.concat(F.lit("Public `any` in `"), "name", F.lit("` ("), "file", F.lit(")")), _here(), fingerprint("public-any", _C("file"), ":", _C("name")), suggestion="Use a narrower type.")


def _primitive(t: Column) -> Column:
    low = F.lower(F.regexp_replace(t, r"\s+", ""))
    return F.when(low.rlike(r"^(string|number|boolean|bigint|symbol|null|undefined|date)(\|.*)?\z"), F.substring_index(low, "|", 1)).otherwise("complex")


def trivial_shape(fields: Column) -> Column:
    """Shapes too plain to match by types alone."""
    kinds = F.array_distinct(F.transform(fields, lambda f: _primitive(f["type"])))
    return ~(F.array_contains(kinds, "complex") & (F.size(fields) >= 3)) & ((F.size(fields) < 4) | (F.size(kinds) < 2))


def clusters(symbols: DataFrame, edges: DataFrame, priority: list[str], hashes: dict[str, str], default: str) -> DataFrame:
    """(component members joined to symbols, primary signal, its representative hash), groups of one left out.

    The representative hash is the primary signal's most frequent one, the least of equals.
    """
    comp = connected_components(edges, "src", "dst")
    sig = merge_signals(edges, comp, priority)
    m = symbols.join(comp.withColumnRenamed("node", "id"), "id").join(sig, "component")
    h = F.coalesce(*[F.when(_C("primary") == s, _C(col)) for s, col in hashes.items()], _C(default))
    best = m.withColumn("h", h).filter("h IS NOT NULL AND h != ''").groupBy("component", "h").agg(F.count("*").alias("k"))
    best = best.groupBy("component").agg(F.max(F.struct("k", F.lit(0))).alias("top"), F.min(F.struct((-_C("k")).alias("k"), "h")).alias("b")).select("component", _C("b.h").alias("hash"))
    return m.join(best, "component", "left")


def _cluster_rows(members: DataFrame) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("file", _C("line_range.start_line").alias("s"), _C("line_range.end_line").alias("e"), "name", _first_lines().alias("snippet"), "workspace")))
    g = members.groupBy("component", "primary", "signals", "hash").agg(order.alias("rows"), F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.count_distinct("name").alias("names"), F.min("workspace").alias("workspace"))
    g = g.filter("NOT (n = 2 AND files = 1)")
    ev = F.transform("rows", lambda r: site(r.file, r.s, r.e, r.snippet))
    names = F.array_join(F.array_distinct(F.transform("rows", lambda r: r["name"])), ", ")
    title = F.when(_C("names") == 1, F.concat(F.lit("'"), names, F.lit("' is defined "), _C("n").cast("string"), F.lit(" times"))).otherwise(F.concat(_C("n").cast("string"), F.lit(" definitions appear equivalent: "), names))
    return g.withColumn("evidence", ev).withColumn("title", title)


@detector("duplicate-type")
def duplicate_type(c: Corpus) -> DataFrame:
    """Object types linked by strict, name-normalized or structural hash."""
    d = distinct_symbols(c.symbols).filter("kind IN ('interface', 'type-alias') AND type_struct.kind = 'object' AND size(type_struct.fields) > 0")
    edges = hash_edges(d, "id", "hash_strict", "strict").union(hash_edges(d, "id", "hash_normalized", "normalized-names")).union(hash_edges(d.filter(~trivial_shape(_C("type_struct.fields"))), "id", "hash_structural", "structural"))
    m = clusters(d, edges.select("src", "dst", "signal"), ["strict", "normalized-names", "structural"], {"strict": "hash_strict", "normalized-names": "hash_normalized", "structural": "hash_structural"}, "hash_structural")
    g = _cluster_rows(m)
    conf = F.when(_C("primary") == "strict", 1.0).when(_C("primary") == "structural", 0.85).otherwise(0.75)
    return finding(g, "duplicate-type", F.when(_C("n") >= 3, "high").otherwise("medium"), conf, _C("title"), _C("evidence"), F.concat_ws(":", F.lit("dup-type"), "primary", "hash"), layer=F.when(_C("primary") == "structural", 2).otherwise(1), suggestion="Keep one shared definition.")


def signature_key() -> Column:
    """Flags, parameter types and return type without white space."""
    fn = _C("fn_struct")
    types = F.array_join(F.transform(fn["params"], lambda p: F.regexp_replace(p["type"], r"\s+", "")), ",")
    return F.concat(F.when(fn["is_async"], "a").otherwise(""), F.when(fn["is_generator"], "g").otherwise(""), F.lit("("), types, F.lit(")=>"), F.regexp_replace(fn["return_type"], r"\s+", ""))


@detector("duplicate-function")
def duplicate_function(c: Corpus, threshold: float = 0.65, min_body: int = 16, min_shingles: int = 6) -> DataFrame:
    """Functions linked by a hash, or by similar bodies under one signature."""
    d = distinct_symbols(c.symbols).filter((_C("kind") == "function") & _C("fn_struct").isNotNull() & (F.length("fn_struct.body_normalized") >= min_body))
    edges = hash_edges(d, "id", "hash_strict", "strict").union(hash_edges(d, "id", "hash_normalized", "normalized-names")).union(hash_edges(d, "id", "hash_structural", "structural"))
    near = set_similarity_join(d.select("id", signature_key().alias("sig"), _C("fn_struct.body_shingles").alias("sh")).filter("sig IS NOT NULL"), "id", "sh", threshold, ["sig"], min_shingles)
    edges = edges.select("src", "dst", "signal").union(near.select(_C("a"), _C("b"), F.lit("near-dup")))
    # as a signal, similarity counts only where no hash links the two already
    hashed = edges.filter("signal != 'near-dup'")
    comp = connected_components(hashed, "src", "dst")
    j = near.join(comp.select(_C("node").alias("a"), _C("component").alias("ca")), "a", "left").join(comp.select(_C("node").alias("b"), _C("component").alias("cb")), "b", "left")
    joins = j.filter("ca IS NULL OR cb IS NULL OR ca != cb").select(_C("a").alias("src"), _C("b").alias("dst"), F.lit("near-dup").alias("signal"))
    hashes = {"strict": "hash_strict", "normalized-names": "hash_normalized", "structural": "hash_structural"}
    m = clusters(d, hashed.unionByName(joins), ["strict", "normalized-names", "structural", "near-dup"], hashes, "hash_structural")
    g = _cluster_rows(m)
    conf = F.when(_C("primary") == "strict", 0.97).when(_C("primary") == "structural", 0.82).when(_C("primary") == "normalized-names", 0.72).otherwise(0.68)
    return finding(g, "duplicate-function", F.when(_C("n") >= 3, "high").otherwise("medium"), conf, _C("title"), _C("evidence"), F.concat_ws(":", F.lit("dup-fn"), "primary", "hash"), layer=F.when(_C("primary").isin("structural", "near-dup"), 2).otherwise(1), suggestion="Keep one implementation.")


#: Suffixes and actions that don't belong to a type's noun, in order (fixed).
STEM_SUFFIXES = "dto dtos request requests response responses input inputs output outputs view views model models schema schemas type types payload payloads entity entities row rows record records".split()
STEM_ACTIONS = "create update patch put get list delete read".split()


def name_stem(name: Column) -> Column:
    """A type's noun: one leading action before a capital and the first listed suffix taken off, lower case."""
    s = F.regexp_replace(name, rf"^(?i:{'|'.join(STEM_ACTIONS)})(?=[A-Z])", "")
    out = F.lower(s)
    found = F.coalesce(*[F.when(out.endswith(x) & (F.length(out) > len(x)), F.substring(out, F.lit(1), F.length(out) - len(x))) for x in STEM_SUFFIXES], out)
    return found


@detector("schema-shape-divergence")
def schema_shape(c: Corpus, max_drift: int = 2, min_shared: float = 0.5) -> DataFrame:
    """Exported object types of one noun whose field names differ a little."""
    d = distinct_symbols(c.symbols).filter("exported AND kind IN ('interface', 'type-alias') AND type_struct.kind = 'object' AND size(type_struct.fields) >= 3")
    d = d.select("id", "workspace", "file", "name", "line_range", name_stem(_C("name")).alias("stem"), F.size("type_struct.fields").alias("n"), F.array_distinct(F.transform("type_struct.fields", lambda f: f["name"])).alias("f")).filter(F.length("stem") >= 3)
    # types that differ in at most max_drift fields share one of the first max_drift + 1 in any common order
    head = d.select("id", "stem", F.explode(F.slice(F.array_sort("f"), 1, max_drift + 1)).alias("t"))
    met = head.alias("x").join(head.alias("y"), (_C("x.stem") == _C("y.stem")) & (_C("x.t") == _C("y.t")) & (_C("x.id") < _C("y.id"))).select(_C("x.id").alias("ia"), _C("y.id").alias("ib")).distinct()
    j = met.join(d.alias("a"), _C("ia") == _C("a.id")).join(d.alias("b"), _C("ib") == _C("b.id")).drop("ia", "ib")
    j = j.withColumn("added", F.array_sort(F.array_except("b.f", "a.f"))).withColumn("removed", F.array_sort(F.array_except("a.f", "b.f"))).withColumn("drift", F.size("added") + F.size("removed"))
    low = F.least("a.n", "b.n")
    shared = low - F.greatest(F.size("added"), F.size("removed"))
    j = j.filter((_C("drift") > 0) & (_C("drift") <= max_drift) & (shared / low >= min_shared))
    key = F.array_join(F.array_sort(F.array("a.file", "a.name", "b.file", "b.name")), "::")
    title = F.concat(F.lit("Schema drift: `"), _C("a.name"), F.lit("` ("), _C("a.file"), F.lit(") vs `"), _C("b.name"), F.lit("` ("), _C("b.file"), F.lit(")"))
    desc = F.concat(title, F.lit("; adds "), F.array_join("added", ", "), F.lit("; drops "), F.array_join("removed", ", "))
    ev = F.array(*[site(_C(f"{x}.file"), _C(f"{x}.line_range.start_line"), _C(f"{x}.line_range.end_line")) for x in "ab"])
    return finding(j, "schema-shape-divergence", "medium", 0.9, title, ev, fingerprint("schema-shape-divergence", key), description=desc, suggestion="Align the types or rename one.", workspace=_C("a.workspace"))


#: Names and prefixes that say nothing about what a function does, and words left out of names (fixed).
IDIOM_PREFIXES = "register use handle on create make build init setup before after".split()
PLAIN_NAMES = "default render constructor toString toJSON valueOf index main init setup teardown beforeEach afterEach beforeAll afterAll mount unmount use noop empty".split()
STOP_WORDS = "get set fn do a an the to of for with my new old is has on off and or not".split()


def name_tokens(name: Column) -> Column:
    """Distinct lower-case words of a camel, snake or kebab name, of two letters or more, stop words left out."""
    s = F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.filter(F.transform(F.split(s, r"[\s_\-.]+"), F.lower), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS)))


@detector("similar-functions")
def similar_functions(c: Corpus, threshold: float = 0.5, name_weight: float = 0.4, min_lines: int = 5, limit: int | None = 25) -> DataFrame:
    """Functions of different files with alike names and bodies.

    A pair's score is name_weight * J(words) + (1 - name_weight) * J(shingles). Pairs without a common
    word can reach the threshold through their bodies alone only if 1 - name_weight >= threshold; those
    are sought exactly as well, so nothing is lost. ``limit`` is the
    report's length, largest groups first. The canonical pick is the newest, then longest, then
    widest function.
    """
    idiom = None
    for p in IDIOM_PREFIXES:
        x = _C("name").startswith(p)
        idiom = x if idiom is None else idiom | x
    test = _C("file").rlike(r"(?:^|/)__tests__/|(?:^|/)tests?/|\.(?:test|spec)\.(?:ts|tsx|js|jsx|mts|cts|mjs|cjs)\z")
    lines = _C("line_range.end_line") - _C("line_range.start_line") + 1
    # bodies go on as hashes, and only those of the rows that are kept
    hashes = F.array_sort(F.array_distinct(F.transform(F.coalesce("fn_struct.body_shingles", F.array()), lambda x: F.xxhash64(x))))
    d = c.symbols.select("id", "workspace", "file", "name", "line_range", "kind", _C("fn_struct").isNotNull().alias("fn"), F.size("fn_struct.params").alias("arity"), F.when(_C("kind") == "function", hashes).alias("items"))
    d = distinct_symbols(d).filter((_C("kind") == "function") & _C("fn") & ~_C("name").isin(*PLAIN_NAMES) & ~idiom & ~test & (lines >= min_lines))
    d = d.select("id", "workspace", "file", "name", "line_range", lines.alias("lines"), "arity", F.transform(name_tokens(_C("name")), lambda x: F.xxhash64(x)).alias("words"), "items")
    scratch = Scratch(d.sparkSession, "similar")
    d = scratch.cut(d)
    j = scored_links(d.select("id", "words", "items"), threshold, name_weight)
    comp = connected_components(j, "a", "b")
    best = j.join(comp.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.max("score").alias("score"))
    m = d.drop("words", "items").join(comp.withColumnRenamed("node", "id"), "id")
    if c.file_mtime is not None:
        m = m.join(c.file_mtime.select(_C("path").alias("file"), "ts"), "file", "left")
    else:
        m = m.withColumn("ts", F.lit(None).cast("long"))
    m = first_per(m, ["component", "file"], [_C("line_range.start_line"), "id"])
    order = [F.coalesce("ts", F.lit(0)).desc(), _C("lines").desc(), _C("arity").desc(), "file", _C("line_range.start_line")]
    pick = first_per(m, ["component"], order).select("component", F.concat_ws(":", "file", "name").alias("canonical"))
    row = F.struct("file", _C("line_range.start_line").alias("s"), _C("line_range.end_line").alias("e"), "name")
    g = m.groupBy("component").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count("*").alias("n"), F.min("workspace").alias("workspace")).filter("n >= 2").join(best, "component").join(pick, "component")
    if limit is not None:
        g = g.orderBy(_C("n").desc(), "component").limit(limit)
    key = F.array_join(F.array_sort(F.transform("rows", lambda r: F.concat_ws(":", r["file"], r["name"]))), "|")
    ev = F.transform("rows", lambda r: site(r.file, r.s, r.e))
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.6 + (_C("score") - threshold) * 0.5))
    return finding(g, "similar-functions", "medium", conf, F.concat(_C("n").cast("string"), F.lit(" similar functions, canonical "), _C("canonical")), ev, fingerprint("similar-functions", key), suggestion="Merge the variants.")
