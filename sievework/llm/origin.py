"""Problem 3: generated, minified, vendored and data files among source files.

Vendored copies: Merkle hashes are computed bottom-up over the directory trees; a subtree that
unrelated repositories share marks all files below it. Header, name and layout rules find what
tools wrote: banners of generators and libraries, lock files, compiler output, minified text and
data saved as code.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import Scratch, read

#: Repositories that must hold a subtree for it to count as third-party.
MIN_REPOS = 2
#: Characters of normalized code from which a shared file or subtree counts as third-party.
MIN_BODY = 200
#: Characters from which a lone literal is data and not a constant.
MIN_DATA = 300
#: Languages whose files can be library code; shared configuration is common and hand-written.
CODE = frozenset((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py"))
LOCKS = frozenset(("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "poetry.lock", "pipfile.lock", "cargo.lock", "gemfile.lock", "bun.lock", "deno.lock"))

_TOP = re.compile(r"(?:\s+|﻿|#![^\n\r]*|//[^\n\r]*|/\*[\s\S]*?\*/|#[^\n\r]*|['\"]use strict['\"];?)*")
#: What names a tool after "by", "from" or "with": a version, a file or package name, a quoted command, or the word itself.
_TOOL = r"(?:the )?(?!hand)(?:[\w@-]*\d[\w.-]*|[\w@-]+[./]\w\S*|[\w@]+-[\w-]+|[`'\"<]\S+|\S+ v?\d|(?:[\w-]+ ){0,3}(?:compiler|generator|tool|plugin|script|codegen))"
_END = r"\s*(?:$|[.!;:,*/)-])"
#: Banners of generators. A line of a comment has to be one; words inside a sentence don't count.
_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|^[^\w\n]*(?:this (?:file|code|module) (?:is|was|has been) )?auto-?generated\b|^[^\w\n]*code generated by\b"
    rf"|^[^\w\n]*(?:this (?:file|code|module) )?(?:(?:is|was|has been) )?(?:generated|created|produced|written|emitted) (?:by|from|with|using) {_TOOL}"
    r"|^[^\w\n]*(?:this (?:file|code|module) )?(?:(?:is|was|has been) )?automatically (?:generated|created|produced|written)\b"
    rf"|\bdo not (?:edit|modify|change)(?: (?:this|the) file| it)?(?: by hand| manually| directly)?{_END}"
    r"|(?:^[^\w\n]*|[.;:] *)(?:(?:manual|hand|local|any|all|your) )?(?:edits|changes|modifications)(?: (?:to|in) this file)? (?:are|will be|get|may be) (?:lost|overwritten|discarded)\b"
    r"|\b(?:this file|its contents?) (?:is|will be|gets) overwritten\b"
    r"|\b\d+ (?:definitions|declarations|bindings) (?:written|produced|created|emitted) by\b|^[^\w\n]*source: \S+\.(?:proto|idl|graphql|gql|thrift|avdl|fbs|xsd|wsdl)\b|^[^\w\n]*(?:protoc|compiler) version v?\d",
    re.IGNORECASE | re.MULTILINE,
)
#: Banners of libraries: name and version beside a licence, an author or where the original is; or said to be copied.
_LIBRARY = re.compile(r"@(?:license|preserve)\s+\S+\s+v?\d|^[^\w\n]*copied from \S+ v?\d|^[^\w\n]*vendored from\b", re.IGNORECASE | re.MULTILINE)
_VERSIONED = re.compile(r"^[^\w\n]*[\w@/.-]+ v?\d+\.\d+\.\d+(?:\s*$| - )", re.MULTILINE)
_ORIGIN = re.compile(r"\blicen[sc]e|\(c\)|\bcopyright\b|\bupstream\b|https?://", re.IGNORECASE)
_UMD = re.compile(r"typeof define === ['\"]function['\"] && define\.amd|typeof exports === ['\"]object['\"] && typeof module")
_VERSION = re.compile(r"\bVERSION\s*=\s*['\"]\d+\.\d+\.\d+['\"]")
_COMPILED = re.compile(r"Object\.defineProperty\(exports, ['\"]__esModule['\"]|^var __\w+ = \(this && this\.__\w+\)|_interopRequireDefault\(|__webpack_require__|//# sourceMappingURL=\S+\s*$", re.MULTILINE)
#: File names that generators give.
_SUFFIX = re.compile(r"(?:_pb2?|_pb2_grpc|\.pb|\.gen|\.g|[._]generated)\.[a-z]+$")
_NUMBER = re.compile(r"\b(?:0[xX][\da-fA-F_]+|\d[\d_.]*(?:[eE][+-]?\d+)?)")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|b?'(?:[^'\\\n]|\\.)*'")
#: Strings, the start of a line comment, and a quotation mark whose string doesn't end on the line.
_LINE_COMMENT = re.compile(rf"{_STRING.pattern}|(?P<c>//|#)|(?P<q>['\"`])")


def extension(path: str | None) -> str:
    name = re.split(r"[/\\]", path or "")[-1].lower()
    dot = name.rfind(".")
    return name[dot:] if dot > 0 else ""


def leading_comment(text: str) -> str:
    return text[: _TOP.match(text).end()]


def _outside(line: str) -> bool:
    """Whether what follows this start of a line is in neither a string nor a line comment."""
    bare = _STRING.sub("", line)
    return not any(x in bare for x in ("//", "'", '"', "`"))


def trailing_comment(code: str) -> str:
    """The comments that end the text, of any length, found backwards from its end."""
    start = len(code)
    while True:
        e = start
        while e > 0 and code[e - 1].isspace():
            e -= 1
        line = code.rfind("\n", 0, e) + 1
        line = max(line, code.rfind("\r", line, e) + 1)
        s = -1
        if code.endswith("*/", 0, e):
            past = code.rfind("*/", 0, e - 2)
            s = code.find("/*", past + 2 if past >= 0 else 0, e - 2)
            while s >= 0 and not _outside(re.split(r"[\r\n]", code[max(0, code.rfind("\n", 0, s)) : s])[-1]):
                s = code.find("/*", s + 2, e - 2)
        if s < 0:
            first = next((m for m in _LINE_COMMENT.finditer(code, line, e) if m.lastgroup), None)
            s = first.start() if first and first.lastgroup == "c" else -1
        if s < 0:
            return code[start:]
        start = s


def body_key(text: str) -> str:
    """The code without its leading comment, white space and line ends: equal for reformatted copies."""
    return re.sub(r"\s+", "", text[_TOP.match(text).end() :])


def _masked_lines(text: str) -> list[str]:
    out = []
    for line in re.split(r"[\r\n]+", text):
        line = line.strip()
        if line:
            out.append(re.sub(r"\d+", "9", re.sub(r"[A-Za-z_$][\w$]*", "a", _STRING.sub("s", line))))
    return out


#: Weight of the shared top-level parts from which a file counts as a copy, and the least part.
COPY_SHARE = 0.6
MIN_PART = 80


def parts_of(text: str) -> list[tuple[int, int]]:
    """(hash, length) of the top-level parts of a file, without white space; the lowest level of the tree."""
    code = re.sub(r"\r\n?", "\n", text[_TOP.match(text).end() :])
    parts = (re.sub(r"\s+", "", x) for x in re.split(r"\n(?=[^\s})\]])", code))
    return [(_hash(x), len(x)) for x in parts if len(x) >= MIN_PART]


def _hash(x: str) -> int:
    return int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def kind_of(path: str | None, text: str | None) -> str | None:
    """Rule that names the file's kind from its own name, header and layout; None for hand-written."""
    if not text or not text.strip():
        return None
    name = re.split(r"[/\\]", path or "")[-1].lower()
    ext = extension(path)
    if name in LOCKS:
        return "lock"
    if ext not in CODE:
        return None
    top = leading_comment(text)
    code = text[len(top) :]
    if _GENERATED.search(top) or _SUFFIX.search(name) or _GENERATED.search(trailing_comment(code)):
        return "generated"
    if _LIBRARY.search(top) or (_VERSIONED.search(top) and _ORIGIN.search(top)):
        return "vendored"
    if _UMD.search(code) and _VERSION.search(code):
        return "vendored"
    if _COMPILED.search(text) and ext in (".js", ".mjs", ".cjs"):
        return "compiled"
    lines = [x for x in re.split(r"[\r\n]+", code) if x.strip()]
    n = sum(map(len, lines))
    bare = _STRING.sub("", code)
    words = [w for w in _TOKEN.findall(_NUMBER.sub("0", bare)) if w not in ("true", "false", "null", "None", "True", "False")]
    # one literal under a name, however it is laid out; a short one is a constant
    if n >= MIN_DATA and len(words) <= 12 and sum(map(len, words)) < 0.1 * n:
        return "data"
    # long lines with hardly any white space between many short words
    spaces = sum(c.isspace() for c in bare)
    for long, share, least in ((300, 0.14, 30), (120, 0.08, 20)):
        if sum(len(x) for x in lines if len(x) > long) > 0.8 * n and len(words) > least and spaces < share * len(bare) and sum(map(len, words)) < 5 * len(words):
            return "minified"
    # a unit of several lines, repeated with other names and numbers throughout
    masks = Counter(_masked_lines(code))
    often = [c for c in masks.values() if c >= 4]
    if sum(masks.values()) >= 16 and len(often) > 1 and len(masks) <= 0.17 * sum(masks.values()):
        return "generated"
    return None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, repo, path, text) to (file_id, repo, dir, name, kind, body hash, characters of code, parts); code is null for blank texts."""
    for b in batches:
        ids, repos, dirs, names, kinds, hashes, sizes, parts_ = [], [], [], [], [], [], [], []
        for i, repo, path, text in zip(*(b.column(k).to_pylist() for k in range(4))):
            code = extension(path) in CODE
            body = body_key(text or "") if code else re.sub(r"\s+", "", text or "")
            inner = parts_of(text or "") if code else []
            parts_.append([{"h": h, "n": n} for h, n in inner])
            parts = (path or "").rsplit("/", 1)
            ids.append(i)
            repos.append(repo)
            dirs.append(parts[0] if len(parts) > 1 else "")
            names.append(parts[-1])
            kinds.append(kind_of(path, text))
            hashes.append(_hash(body))
            sizes.append((len(body) if code else 0) if (text or "").strip() else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(repos, pa.string()), pa.array(dirs, pa.string()), pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts_, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())])))],
            ["file_id", "repo", "dir", "name", "kind", "body", "code", "parts"],
        )


def related(files: DataFrame, scratch: Scratch) -> DataFrame:
    """``(repo, related)`` of the repositories of which half the code or more lies in another at the same path.

    Forks, mirrors and split repositories do; libraries are copied to a place of the copier's choice.
    """
    at = F.xxhash64("dir", "name", "body").alias("h")
    files = files.filter("repo IS NOT NULL AND code > 0").groupBy("repo", at).agg(F.max("code").alias("code"))
    twice = files.groupBy("h").agg(F.count("*").alias("repos")).filter("repos > 1").select("h", F.lit(1).alias("s"))
    size = files.join(twice, "h", "left").groupBy("repo").agg(F.sum("code").alias("code"), F.sum(F.when(F.col("s") == 1, F.col("code"))).alias("same"))
    return scratch.cut(size.filter(F.col("same") * 2 >= F.col("code")).select("repo", F.lit(1).alias("related")), 1)


def _unrelated() -> F.Column:
    """Repositories of a group, with all related ones counted once."""
    return F.count_if(F.col("related").isNull()) + F.coalesce(F.max("related"), F.lit(0))


def shared_subtrees(files: DataFrame, kin: DataFrame, scratch: Scratch, min_repos: int = MIN_REPOS) -> DataFrame:
    """``(repo, node)`` of the subtrees, files among them, that ``min_repos`` repositories share.

    ``files`` has (repo, dir, name, body, code). A directory's hash is a sum over its children's name
    and hash, so it is built by partial aggregation from the deepest level up and no directory is ever
    gathered; the directory's own name is left out, as copies are moved. Every file counts in the
    hash, short ones and configuration too; a subtree marks only if its code has MIN_BODY characters.
    Repositories related to another (``kin``) count as one together.
    """
    leaf = files.select("repo", F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), "name").alias("node"), F.col("dir").alias("parent"), "name", F.struct(F.col("body").alias("h"), F.coalesce("code", F.lit(0)).alias("code")).alias("x"))
    leaf = leaf.groupBy("repo", "node", "parent", "name").agg(F.min("x").alias("x"))
    level = scratch.cut(leaf.select("repo", "node", "parent", "name", "x.h", "x.code").withColumn("depth", F.size(F.split("node", "/"))))
    top = level.agg(F.max("depth")).first()[0] or 0
    nodes = [level.select("repo", "node", "h", "code")]
    current = level
    for d in range(top, 1, -1):
        at = current.filter(F.col("depth") == d)
        up = at.groupBy("repo", "parent").agg(
            F.sum(F.pmod(F.xxhash64("name", "h"), F.lit(1 << 40))).alias("s"), F.expr("bit_xor(xxhash64(h, name))").alias("x"), F.count("*").alias("n"), F.sum("code").alias("code")
        )
        parent = F.when(F.instr("parent", "/") > 0, F.regexp_replace("parent", "/[^/]*$", "")).otherwise(F.lit(""))
        up = up.select(
            "repo", F.col("parent").alias("node"), parent.alias("parent"), F.regexp_extract("parent", "([^/]*)$", 1).alias("name"),
            F.xxhash64("s", "x", "n").alias("h"), "code", F.lit(d - 1).alias("depth"),
        )
        up = scratch.cut(up)
        nodes.append(up.select("repo", "node", "h", "code"))
        current = current.filter(F.col("depth") < d).unionByName(up)
    every = nodes[0]
    for x in nodes[1:]:
        every = every.unionByName(x)
    every = every.filter((F.col("code") >= MIN_BODY) & F.col("repo").isNotNull())
    # two steps, so that a hash in millions of places is merged map-side
    places = every.select("h", "repo").distinct().join(kin, "repo", "left")
    spread = places.groupBy("h").agg(_unrelated().alias("repos")).filter(F.col("repos") >= min_repos).select("h")
    return every.join(spread, "h", "left_semi").select("repo", "node").distinct()


def not_hand_written(files: DataFrame, key: str = "file_id", repo: str = "repo", path: str = "path", text: str = "text", min_repos: int = MIN_REPOS) -> DataFrame:
    """``(file_id, kind)`` of every file that no member wrote by hand.

    Kinds: generated, vendored, compiled, minified, data, lock. Null or blank texts are
    hand-written; a null repository shares nothing; repeated rows come out once each; an empty
    table gives no rows; other columns are not read. Broken files are judged like others.
    """
    scratch = Scratch(files.sparkSession, "origin")
    judged = files.select(F.col(key).cast("long"), F.col(repo), F.col(path), F.col(text)).mapInArrow(_judge, "file_id long, repo string, dir string, name string, kind string, body long, code long, parts array<struct<h:long,n:int>>")
    judged = scratch.cut(judged)
    kin = related(judged, scratch)
    shared = shared_subtrees(judged, kin, scratch, min_repos).withColumnRenamed("repo", "r")
    # a file is under a shared subtree if its own node or any directory above it is one
    parts = F.split(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), "name"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    open_files = judged.filter("kind IS NULL AND code IS NOT NULL")
    marked = open_files.select("file_id", "repo", F.explode(above).alias("at")).join(shared, (F.col("repo") == F.col("r")) & (F.col("at") == F.col("node")), "left_semi").select("file_id").distinct()
    # a file whose top-level parts mostly lie in other repositories too is an altered copy
    parts = judged.filter("size(parts) > 1").select("file_id", "repo", "kind", F.explode("parts").alias("p")).select("file_id", "repo", "kind", "p.h", "p.n")
    spread = parts.filter("repo IS NOT NULL").select("h", "repo").distinct().join(kin, "repo", "left").groupBy("h").agg(_unrelated().alias("repos")).filter(F.col("repos") >= min_repos).select("h", F.lit(1).alias("s"))
    weigh = parts.filter("kind IS NULL").join(spread, "h", "left").groupBy("file_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("s") == 1, F.col("n"))).alias("shared"), F.count("s").alias("k"))
    altered = weigh.filter((F.col("k") > 1) & (F.col("shared") >= MIN_BODY) & (F.col("shared") >= COPY_SHARE * F.col("n"))).select("file_id")
    marked = marked.union(altered).distinct()
    own = judged.filter("kind IS NOT NULL").select("file_id", "kind")
    return own.unionByName(marked.withColumn("kind", F.lit("vendored")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_hand_written(read(spark, sf_dir, "sources")).select("file_id").distinct()


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and characters by repository and kind, hand-written ones among them."""
    src = read(spark, sf_dir, "sources")
    k = not_hand_written(src).groupBy("file_id").agg(F.min("kind").alias("kind"))
    j = src.select("file_id", "repo", F.length("text").alias("n")).join(k, "file_id", "left")
    return j.groupBy("repo", F.coalesce("kind", F.lit("hand-written")).alias("kind")).agg(F.count("*").alias("files"), F.sum("n").alias("chars"))


QUERIES = {"p3_found": p3_found, "p3_kinds": p3_kinds}
ORACLE: dict[str, str] = {}
