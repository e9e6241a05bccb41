"""Detectors over the fact rows of the text scanners."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.config_rules import judged
from sievework.operators.clustering import anti_chain, cap_per, distinct_actor_clusters, first_per, unmet
from sievework.plans.corpus import Corpus
from sievework.plans.detectors import detector, finding, fingerprint, site, steps
from sievework.session import Scratch

_C = F.col


def _at(df: DataFrame):
    return F.array(site(_C("path"), _C("line"), _C("end_line"), _C("snippet")))


def _where(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


#: Markers that count as medium (fixed).
LOUD = ("HACK", "XXX", "WTF", "FIXME", "BUG")


@detector("todo-comments")
def todo_comments(c: Corpus, limit: int | None = 60) -> DataFrame:
    """Marker comments; ``limit`` is the report's length, in order of path and line."""
    d = c.fact("todo").withColumn("marker", _C("attrs")["marker"]).withColumn("note", _C("attrs")["note"])
    d = d if limit is None else d.orderBy("path", "line").limit(limit)
    sev = F.when(_C("marker").isin(*LOUD), "medium").otherwise("low")
    return finding(d, "todo-comments", sev, 1.0, _where(_C("marker"), " comment in ", _C("path"), ":", _C("line")), _at(d), fingerprint("todo-comments", _C("path"), ":", _C("line"), ":", _C("marker"), ":", _C("note")), suggestion="Move it to the issue tracker or delete it.")


@detector("console-log-prod")
def console_log(c: Corpus) -> DataFrame:
    d = c.fact("console")
    return finding(d, "console-log-prod", "low", 0.9, _where("console.", _C("key"), " in ", _C("path"), ":", _C("line")), _at(d), fingerprint("console-log-prod", _C("path"), ":", _C("line"), ":", _C("key")), suggestion="Use the project's logger.")


@detector("skip-tests")
def skip_tests(c: Corpus) -> DataFrame:
    d = c.fact("skipped_test")
    only = _C("attrs")["kind"] == "only"
    title = _where(F.when(only, "Test isolation: ").otherwise("Skipped test: "), _C("key"), " in ", _C("path"), ":", _C("line"))
    return finding(d, "skip-tests", F.when(only, "high").otherwise("medium"), 0.97, title, _at(d), fingerprint("skip-tests", _C("path"), ":", _C("line"), ":", _C("key")), suggestion="Enable the test or delete it.")


@detector("long-file")
def long_file(c: Corpus, low: int = 400, med: int = 700, high: int = 1200) -> DataFrame:
    d = c.fact("file_length").withColumn("loc", _C("attrs")["loc"].cast("int")).withColumn("sev", steps(_C("loc"), low, med, high)).filter("sev IS NOT NULL")
    return finding(d, "long-file", _C("sev"), 0.99, _where("Long file: ", _C("path"), " (", _C("loc"), " LOC)"), _at(d), fingerprint("long-file", _C("path")), suggestion="Split it along its concerns.")


@detector("silent-catch")
def silent_catch(c: Corpus) -> DataFrame:
    d = c.fact("catch")
    return finding(d, "silent-catch", "medium", 0.85, _where("Silent catch in ", _C("path"), ":", _C("line")), _at(d), fingerprint("silent-catch", _C("path"), ":", _C("line")), description=_where("The catch block is ", _C("attrs")["how"], "; failures are lost."), suggestion="Rethrow, report, or say why not.")


@detector("test-without-assertion")
def test_without_assertion(c: Corpus) -> DataFrame:
    d = c.fact("test_case")
    return finding(d, "test-without-assertion", "medium", 0.85, _where("Test without assertion: ", _C("key"), " in ", _C("path"), ":", _C("line")), _at(d), fingerprint("test-without-assertion", _C("path"), ":", _C("line"), ":", _C("key")), suggestion="Assert something or delete the test.")


@detector("mutable-globals")
def mutable_globals(c: Corpus) -> DataFrame:
    d = c.fact("mutable_global")
    return finding(d, "mutable-globals", "medium", 0.8, _where("Reassigned module state: ", _C("key"), " in ", _C("path"), ":", _C("line")), _at(d), fingerprint("mutable-globals", _C("path"), ":", _C("key")), suggestion="Encapsulate the state.")


@detector("magic-numbers")
def magic_numbers(c: Corpus, per_file: int | None = 5) -> DataFrame:
    """Unnamed numbers, the first ``per_file`` of each file in source order, or all."""
    d = c.fact("number").withColumn("offset", _C("attrs")["offset"].cast("long"))
    if per_file is not None:
        d = cap_per(d, ["path"], ["offset"], per_file)
    return finding(d, "magic-numbers", "low", 0.7, _where("Magic number ", _C("key"), " in ", _C("path"), ":", _C("line")), _at(d), fingerprint("magic-numbers", _C("path"), ":", _C("line"), ":", _C("key")), suggestion="Name the value.")


#: How many configurations a chain of ``extends`` may pass (fixed).
MAX_EXTENDS = 8


def _extended(c: Corpus) -> DataFrame:
    """Config facts of the compiler configurations that extend others, judged with the merged options.

    Each round follows one more base by joining on paths; a base that was met before on its chain ends it.
    """
    t = c.fact("tsconfig").select("workspace", "path", _C("attrs")["options"].alias("options"), F.from_json(_C("attrs")["extends"], "array<array<string>>").alias("bases"), _C("attrs")["text"].alias("text"))
    scratch = Scratch(c.spark, "tsconfig")
    t = scratch.cut(t)
    own = t.filter(F.size("bases") > 0)
    link = own.select("path", F.posexplode("bases").alias("i", "tries")).select("path", "i", F.posexplode("tries").alias("r", "base"))
    link = link.join(t.select(_C("path").alias("base"), _C("options").alias("base_options")), "base").groupBy("path", "i").agg(F.min(F.struct("r", "base", "base_options")).alias("b"))
    link = scratch.cut(link.select(_C("path").alias("of"), "i", "b.base", "b.base_options"))
    # (path, at, order): the farther a base and the earlier in its list, the sooner it is laid down
    front = own.select("path", _C("path").alias("at"), F.array().cast("array<int>").alias("order"), F.array("path").alias("met"))
    found = []
    for _ in range(MAX_EXTENDS):
        front = scratch.cut(front.join(link, _C("at") == _C("of")).filter(~F.array_contains("met", _C("base"))).select("path", _C("base").alias("at"), F.concat("order", F.array("i")).alias("order"), F.concat("met", F.array("base")).alias("met"), "base_options"))
        if not front.head(1):
            break
        found.append(front.select("path", "order", "base_options"))
        front = front.drop("base_options")
    laid = own.select("path", F.lit(None).cast("array<int>").alias("order"), F.lit(None).cast("string").alias("base_options")).limit(0)
    for f in found:
        laid = laid.unionByName(f)
    bases = laid.groupBy("path").agg(F.collect_list(F.struct("order", "base_options")).alias("bases"))

    def judge(batches):
        for pdf in batches:
            rows = []
            for ws, path, text, given in zip(pdf["workspace"], pdf["path"], pdf["text"], pdf["bases"]):
                chain = _in_order([(list(g["order"]), g["base_options"]) for g in given] if given is not None else [])
                rows += [(ws, path, f[1], f[2], f[3], list(f[4].items()), f[6]) for f in judged(path, text, [json.loads(o) for o in chain])]
            yield pd.DataFrame(rows, columns=["workspace", "path", "line", "end_line", "key", "attrs", "snippet"])

    d = own.select("workspace", "path", "text").join(bases, "path", "left").select("workspace", "path", "text", "bases")
    d = d.mapInPandas(judge, "workspace string, path string, line int, end_line int, key string, attrs array<struct<k:string,v:string>>, snippet string")
    return d.withColumn("attrs", F.map_from_entries("attrs"))


def _in_order(bases: list[tuple[list[int], str]]) -> list[str]:
    """Options in the order they are laid down: a base's own bases before it, the later of two bases after the earlier."""
    tree: dict[tuple, str] = {tuple(o): text for o, text in bases}

    def down(at: tuple) -> list[str]:
        out: list[str] = []
        for k in sorted(x for x in tree if len(x) == len(at) + 1 and x[: len(at)] == at):
            out += [*down(k), tree[k]]
        return out

    return down(())


@detector("bad-config")
def bad_config(c: Corpus, depth: int | None = 2) -> DataFrame:
    """Loose settings of compilers and linters; ``depth`` is how deep, in names, a configuration may lie."""
    d = c.fact("config").select("workspace", "path", "line", "end_line", "key", "attrs", "snippet").unionByName(_extended(c))
    # by default at a workspace's root or one folder below; scripts among the parsed files anywhere
    local = F.when(F.lit(c.multi) & _C("workspace").isNotNull(), F.expr("substring(path, length(workspace) + 2)")).otherwise(_C("path"))
    if depth is not None:
        d = d.filter((F.size(F.split(local, "/")) <= depth) | _C("path").rlike(r"\.tsx?\z"))
    return finding(d, "bad-config", _C("attrs")["severity"], 0.95, _where(_C("attrs")["title"], " in ", _C("path")), _at(d), fingerprint("bad-config", _C("path"), ":", _C("key")), suggestion="Set the option to its strict value.")


#: Variables that the platform sets (fixed).
BUILTIN_ENV = "NODE_ENV NODE_OPTIONS NODE_PATH PATH HOME USER PWD CI GITHUB_ACTIONS GITHUB_TOKEN GITHUB_REPOSITORY GITHUB_SHA GITHUB_REF TERM SHELL LANG LC_ALL TZ TMPDIR TMP TEMP DEBUG FORCE_COLOR NO_COLOR".split()


@detector("env-var-undeclared")
def env_var_undeclared(c: Corpus) -> DataFrame:
    """Variables read but not declared, once per file, and declared but never read, within a workspace."""
    reads = c.fact("env_read")
    decls = c.fact("env_decl")
    first = first_per(reads.filter((_C("attrs")["ignored"] == "0") & ~_C("key").isin(*BUILTIN_ENV)), ["workspace", "key", "path"], ["line"])
    lost = anti_chain(first, (decls, ["workspace", "key"]))
    a = finding(lost, "env-var-undeclared", "medium", 0.9, _where("Undeclared variable ", _C("key"), " read in ", _C("path"), ":", _C("line")), _at(lost), fingerprint("env-var-undeclared", _C("key"), "::", _C("path")), suggestion="Declare it in the example file.")
    dead = anti_chain(first_per(decls, ["workspace", "key"], ["path", "line"]), (reads, ["workspace", "key"]))
    b = finding(dead, "env-var-undeclared", "low", 0.85, _where("Variable ", _C("key"), " declared in ", _C("path"), " is never read"), F.array(site(_C("path"), F.lit(1), F.lit(1), _C("snippet"))), fingerprint("env-var-undeclared-dead", _C("key"), "::", _C("path")), suggestion="Remove the declaration.")
    return a.unionByName(b)


@detector("dead-endpoint")
def dead_endpoint(c: Corpus) -> DataFrame:
    """Routes that no client call of the corpus reaches."""
    d = first_per(c.fact("route"), ["path", "line", "key"], ["end_line"])
    d = anti_chain(d, (c.fact("client_call"), ["key"]))
    title = _where(F.upper(_C("attrs")["method"]), " ", _C("attrs")["url"], " has no caller (", _C("path"), ":", _C("line"), ")")
    return finding(d, "dead-endpoint", "medium", 0.8, title, _at(d), fingerprint("dead-endpoint", _C("path"), ":", _C("line"), ":", _C("key")), suggestion="Delete the route or mark it as public.")


@detector("producer-consumer-field-drift")
def field_drift(c: Corpus) -> DataFrame:
    """Fields that a handler reads and no client of the endpoint sends; without a client nothing is claimed."""
    d = unmet(c.fact("route_reads"), c.fact("client_body"), "key", "items")
    d = d.withColumn("m", F.array_join("missing", ","))
    d = first_per(d, ["path", "line", "key", "m"], ["end_line"])
    title = _where("Drift on ", F.upper(_C("attrs")["method"]), " ", _C("attrs")["url"], ": no client sends ", _C("m"), " (", _C("path"), ":", _C("line"), ")")
    return finding(d, "producer-consumer-field-drift", "high", 0.85, title, _at(d), fingerprint("producer-consumer-field-drift", _C("path"), ":", _C("line"), ":", _C("key"), ":", _C("m")), suggestion="Align both sides.")


@detector("unsanitized-input-to-sink")
def unsanitized(c: Corpus) -> DataFrame:
    d = first_per(c.fact("taint"), ["path", "line", "key"], ["end_line"])
    a = _C("attrs")
    return finding(d, "unsanitized-input-to-sink", "high", 0.7, _where(a["var"], " from ", a["source"], " reaches ", a["sink"], " in ", _C("path"), ":", _C("line")), _at(d), fingerprint("unsanitized-input-to-sink", _C("path"), ":", _C("line"), ":", a["sink"], ":", a["var"]), suggestion="Parse or escape the value first.")


#: Sites shown per cluster.
SITES = 8


def _sites(note):
    rows = F.array_sort(F.collect_list(F.struct("path", "line", "end_line", "snippet", note.alias("note"))))
    return F.transform(F.slice(rows, 1, SITES), lambda x: site(x.path, x.line, x.end_line, x.snippet, x.note))


def _across(c: Corpus):
    """Cluster workspace: the one all sites share, else the cross-workspace mark."""
    return F.when(F.count_distinct("workspace") > 1, F.lit("cross-ws")).otherwise(F.min("workspace"))


@detector("shared-db-write")
def shared_db_write(c: Corpus, min_files: int = 2) -> DataFrame:
    """Columns written from two files or more."""
    a = _C("attrs")
    d = c.fact("db_write").withColumn("adapter", a["adapter"])
    note = F.to_json(F.struct(a["entity"].alias("entity"), a["column"].alias("column"), a["adapter"].alias("adapter")))
    g = distinct_actor_clusters(d, ["key"], "path", min_files, evidence=_sites(note), adapters=F.array_join(F.array_sort(F.collect_set("adapter")), "+"), workspace=_across(c))
    return finding(g, "shared-db-write", "medium", 0.7, _where("`", _C("key"), "` is written from ", _C("actors"), " files (", _C("adapters"), ")"), _C("evidence"), fingerprint("shared-db-write", _C("key")), suggestion="Route the writes through one owner.")


@detector("api-race")
def api_race(c: Corpus, min_files: int = 2) -> DataFrame:
    """Writing calls to one method and path from two files or more."""
    a = _C("attrs")
    note = F.to_json(F.struct(a["method"].alias("method"), a["path_pattern"].alias("pathPattern"), a["client"].alias("client")))
    g = distinct_actor_clusters(c.fact("http_write"), ["key"], "path", min_files, evidence=_sites(note), workspace=_across(c))
    return finding(g, "api-race", "medium", 0.65, _where("`", _C("key"), "` is called from ", _C("actors"), " files"), _C("evidence"), fingerprint("api-race", _C("key")), suggestion="Use versioned updates or one caller.")


@detector("mutation")
def mutation(c: Corpus) -> DataFrame:
    a = _C("attrs")
    d = c.fact("mutation")
    escapes, module, dele = a["escapes"] == "1", a["scope"] == "module-state", a["pattern"] == "delete-property"
    d = d.withColumn("conf", F.when(escapes, 0.82).when(module, 0.78).otherwise(0.7))
    note = F.to_json(F.struct(a["pattern"].alias("pattern"), _C("key").alias("target"), a["function"].alias("enclosingName")))
    fp = F.concat(F.lit("mutation:"), a["pattern"], F.lit(":"), F.substring(F.sha2(F.concat_ws("::", "path", _C("line").cast("string"), "key"), 256), 1, 16))
    title = _where(F.when(module, "Shared module state").otherwise("Parameter"), " ", _C("key"), " changed by ", a["method"], F.when(escapes, " [ESCAPES]").otherwise(""))
    return finding(d, "mutation", F.when(escapes | module | dele, "high").otherwise("medium"), _C("conf"), title, F.array(site(_C("path"), _C("line"), _C("end_line"), _C("snippet"), note)), fp, suggestion="Copy before changing.")


@detector("race-condition")
def race_condition(c: Corpus) -> DataFrame:
    """Each race once, the site with a named function first."""
    a = _C("attrs")
    d = c.fact("race").withColumn("pattern", a["pattern"])
    d = first_per(d, ["path", "pattern", "key"], [(a["function"] == "").asc(), "line"])
    note = F.to_json(F.struct(a["target"].alias("target"), a["function"].alias("enclosingName")))
    rmw = _C("pattern") == "read-modify-write"
    title = F.when(rmw, _where("Read-modify-write across await on ", a["target"])).otherwise(_where("Parallel arms write ", a["target"]))
    fp = F.concat(F.lit("race:"), _C("pattern"), F.lit(":"), F.substring(F.sha2(F.concat_ws("::", "path", "key"), 256), 1, 16))
    return finding(d, "race-condition", "medium", F.when(rmw, 0.7).otherwise(0.75), title, F.array(site(_C("path"), _C("line"), _C("end_line"), _C("snippet"), note)), fp, suggestion="Serialize the section.")


#: Packages that are loaded by name at run time (fixed).
RUNTIME_LOADERS = "tsx ts-node tsconfig-paths @swc/register @swc-node/register esbuild-register jiti dotenv-cli concurrently rimraf cross-env".split()
#: Modules of the platform (fixed).
BUILTIN_MODULES = "fs path os http https crypto util events stream buffer child_process url querystring zlib tty net tls dns cluster worker_threads perf_hooks assert process readline string_decoder vm v8 inspector async_hooks timers dgram".split()


def npm_package(specifier):
    """Package part of a specifier; null for relative paths, node: and platform modules."""
    first = F.substring_index(specifier, "/", 1)
    scoped = F.when(F.instr(specifier, "/") > 0, F.substring_index(specifier, "/", 2))
    out = F.when(specifier.startswith("@"), scoped).otherwise(first)
    return F.when(~(specifier.startswith(".") | specifier.startswith("/") | specifier.startswith("node:") | (specifier == "") | first.isin(*BUILTIN_MODULES)), out)


@detector("unused-deps")
def unused_deps(c: Corpus) -> DataFrame:
    used = c.imports.filter("target IS NULL").select("workspace", npm_package(_C("specifier")).alias("key")).filter("key IS NOT NULL")
    d = c.fact("pkg_dep").filter(~_C("key").isin(*RUNTIME_LOADERS) & ~_C("attrs")["version"].startswith("workspace:"))
    d = anti_chain(d, (used, ["workspace", "key"]))
    return finding(d, "unused-deps", "low", 0.85, _where("Unused dependency ", _C("key"), " in ", _C("path")), _at(d), fingerprint("unused-deps", _C("key")), suggestion="Remove the dependency.")


@detector("package-export-mismatch")
def package_export_mismatch(c: Corpus) -> DataFrame:
    """Targets of a published package that are neither a file nor built from one."""
    dir_ = F.regexp_replace("path", "[^/]*$", "")
    d = c.fact("pkg_target").withColumn("dir", dir_)
    tries = d.select("path", "key", "dir", F.explode("items").alias("t")).withColumn("path2", F.concat("dir", "t"))
    hit = tries.join(c.files.select(F.col("path").alias("path2")).distinct(), "path2", "left_semi")
    d = anti_chain(d, (hit, ["path", "key"]))
    return finding(d, "package-export-mismatch", "high", 0.97, _where(_C("path"), "#", _C("attrs")["field"], " points at ", _C("attrs")["spec"]), _at(d), fingerprint("package-export-mismatch", _C("key")), suggestion="Build the target or correct the path.")
