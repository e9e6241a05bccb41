"""Problem 1: source files that don't parse in the language their extension names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.grammars import ecma, json_text, python3
from sievework.llm.lexers import LexError, ecma_tokens, json_tokens, python_tokens
from sievework.llm.lr import Parser, Tables
from sievework.session import read

#: Dialect by extension.
DIALECT = {".ts": "ts", ".tsx": "tsx", ".js": "js", ".json": "json", ".py": "py"}
#: JSON files that may hold comments and trailing commas.
LOOSE_JSON = frozenset(("tsconfig.json",))
#: Text, flags and classes of each dialect's grammar.
GRAMMARS = {
    "ts": (ecma.TEXT, frozenset(("ts",)), ecma.CLASSES),
    "tsx": (ecma.TEXT, frozenset(("ts", "jsx")), ecma.CLASSES),
    "js": (ecma.TEXT, frozenset(), ecma.CLASSES),
    "json": (json_text.TEXT, frozenset(), {}),
    "jsonc": (json_text.TEXT, frozenset(("loose",)), {}),
    "py": (python3.TEXT, frozenset(), python3.CLASSES),
}


def dialect_of(path: str | None) -> str | None:
    """The dialect that the extension names; null for other files."""
    if path is None:
        return None
    name = re.split(r"[/\\]", path)[-1].lower()
    if name in LOOSE_JSON:
        return "jsonc"
    dot = name.rfind(".")
    return DIALECT.get(name[dot:]) if dot >= 0 else None


@lru_cache(None)
def tables(dialect: str) -> Tables:
    return Tables(*GRAMMARS[dialect])


@lru_cache(None)
def own_parser(dialect: str) -> Parser:
    return Parser(tables(dialect), "ASI" if dialect in ("ts", "tsx", "js") else None)


def tokens(text: str, dialect: str, exact: bool = True) -> tuple[list, list, bytearray | None]:
    if dialect == "py":
        return python_tokens(text)
    if dialect in ("json", "jsonc"):
        return json_tokens(text, dialect == "jsonc")
    return ecma_tokens(text, dialect, exact)


def first_error(text: str | None, dialect: str | None, parser: Callable[[str], Parser] = own_parser) -> tuple[int, str] | None:
    """Offset and kind of the first error from which the parse can't go on; None for a valid text.

    The error is the first token that no valid text can have after what precedes it, or characters that are
    no token. A null or blank text and one in no known dialect are valid; a leading byte-order mark counts as
    white space. Nesting is bounded by memory only.
    """
    if text is None or dialect is None:
        return None
    bom = text.startswith("\ufeff")
    body = text[1:] if bom else text
    if not body.strip():
        return None
    run = parser(dialect)
    number = run.t.kinds.get
    for exact in (False, True):  # offsets are only worked out where there is an error
        lexical = None
        try:
            kinds, at, may = tokens(body, dialect, exact)
        except LexError as e:
            lexical = e.args
            kinds, at, may = e.tokens
            if not exact:
                continue
        i = run.parse([number(k, -1) for k in kinds], may)
        if i < 0 and not lexical:
            return None
    if i >= 0 and not (lexical and at[i] >= lexical[0]):
        return at[i] + bom, f"grammar: unexpected {'end' if kinds[i] == 'EOF' else kinds[i]}"
    return lexical[0] + bom, f"token: {lexical[1]}"


def _parse(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, path, text) to (key, line, col, error) of the files that fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = lru_cache(None)(lambda d: Parser(shared.value[d], "ASI" if d in ("ts", "tsx", "js") else None))
        for batch in batches:
            out: list[tuple] = []
            for key, path, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                got = first_error(text, dialect_of(path), parser)
                if got:
                    head = text[: got[0]]
                    line = head.count("\n") + head.count("\r") - head.count("\r\n") + 1
                    out.append((key, line, got[0] - max(head.rfind("\n"), head.rfind("\r")), got[1]))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["file_id", "line", "col", "error"])

    return run


def parse_failures(files: DataFrame, key: str = "file_id", path: str = "path", text: str = "text") -> DataFrame:
    """``(file_id, line, col, error)`` of each file whose text isn't valid for its extension.

    Every token of every text is parsed; no shuffle is needed. Null or blank texts, null paths and
    unknown extensions are not failures; repeated rows come out once each; an empty table gives an
    empty result; columns beyond the three are not read. The tables are built once on the driver and
    broadcast; their size is the grammars' (about 1 MB), whatever the data.
    """
    shared = files.sparkSession.sparkContext.broadcast({d: tables(d) for d in GRAMMARS})
    return files.select(F.col(key).cast("long"), F.col(path), F.col(text)).mapInArrow(_parse(shared), "file_id long, line int, col int, error string")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "sources")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_failures(_sources(spark, sf_dir)).select("file_id").distinct()


def p1_first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each failing file fails."""
    return parse_failures(_sources(spark, sf_dir))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, failing files and their share by repository and the language of the extension."""
    src = _sources(spark, sf_dir)
    bad = parse_failures(src).select("file_id").distinct().withColumn("bad", F.lit(1))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    s = src.select("file_id", "repo", ext.alias("ext")).join(bad, "file_id", "left")
    g = s.groupBy("repo", "ext").agg(F.count("*").alias("files"), F.count("bad").alias("failing"))
    return g.withColumn("rate", F.col("failing") / F.col("files"))


def p1_json_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failing files among those of strict JSON."""
    src = _sources(spark, sf_dir)
    name = F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1))
    return parse_failures(src.filter(name.endswith(".json") & ~name.isin(*LOOSE_JSON))).select("file_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_first_errors": p1_first_errors, "p1_rates": p1_rates, "p1_json_failures": p1_json_failures}
ORACLE = {
    "p1_json_failures": "SELECT DISTINCT file_id FROM (SELECT file_id, ltrim(text, chr(65279)) AS t FROM sources WHERE lower(path) LIKE '%.json' AND NOT regexp_matches(lower(path), '(^|[/\\\\])tsconfig[.]json$')) WHERE trim(t, E' \\t\\n\\r') <> '' AND (NOT json_valid(t) OR regexp_matches(regexp_replace(t, '\"([^\"\\\\]|\\\\.)*\"', '0', 'g'), ',\\s*[}\\]]|[Nn]a[Nn]|[Ii]nf'))",
}
