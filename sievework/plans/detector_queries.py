"""One query per detector over the whole sources and symbols tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.sql import register
from sievework.plans.corpus import Corpus
from sievework.plans.detectors import REGISTRY
from sievework.session import read

_C = F.col
#: Report lengths are lifted, so that every finding comes out.
_WHOLE = {"todo-comments": {"limit": None}, "similar-functions": {"limit": None}, "hot-hub-file": {"limit": None, "threshold": 1}, "long-function": {"low": 10, "med": 40, "high": 80}, "long-file": {"low": 40, "med": 100, "high": 200}, "deep-nesting": {"low": 1, "med": 2, "high": 3}, "magic-numbers": {"per_file": None}, "bad-config": {"depth": None}}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    src = read(spark, sf_dir, "sources").select("workspace", "path", "text")
    ws = read(spark, sf_dir, "workspaces").select(_C("name").alias("workspace"), "package_name")
    mtime = read(spark, sf_dir, "sources").filter("path IS NOT NULL").groupBy("path").agg(F.max(_C("mtime").cast("timestamp").cast("long")).alias("ts"))
    return Corpus(src, packages=ws, given_symbols=read(spark, sf_dir, "symbols"), file_mtime=mtime)


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = REGISTRY[name](corpus(spark, sf_dir), **_WHOLE.get(name, {}))
        return f.select("workspace", "detector_id", "severity", "confidence", "layer", "title", "fingerprint", F.size("evidence").alias("sites"))

    return run


QUERIES = {f"detector_{n.replace('-', '_')}": _query(n) for n in REGISTRY}


def parsed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols parsed from the sources."""
    c = corpus(spark, sf_dir)
    c.given_symbols = None
    return c.symbols.select("id", "kind", "name", "file", "exported", "hash_strict", "hash_structural", "hash_normalized")


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import records with their resolved targets."""
    return corpus(spark, sf_dir).imports.select("source", "specifier", "target", "default_import", "namespace_alias", "is_re_export", F.size("named_imports").alias("n_named"))


def sql_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker comments by the table function that SQL calls."""
    register(spark)
    src = read(spark, sf_dir, "sources").select(F.regexp_replace("path", r"\\", "/").alias("path"), "text")
    return spark.sql("SELECT s.path, f.line, f.attrs['marker'] AS marker FROM {src} s, LATERAL scan_facts('todo', s.path, s.text) f", src=src)


QUERIES |= {"parsed_symbols": parsed_symbols, "import_edges": import_edges, "sql_facts": sql_facts}

_TODO = """f AS (SELECT workspace, replace(path, '\\', '/') AS path, string_split(text, chr(10)) AS ls FROM sources WHERE text <> '' AND regexp_matches(path, '\\.(ts|tsx|mts|cts|js|jsx|mjs|cjs|py|go|rs|java|kt|swift|rb|php|sql|sh|yaml|yml|toml)$')
AND NOT regexp_matches(path, '\\.d\\.ts$|(^|/)(node_modules|dist|build)/')),
l AS (SELECT workspace, path, unnest(ls) AS t, unnest(range(1, len(ls) + 1)) AS n FROM f),
m AS (SELECT workspace, path, n, upper(regexp_extract(t, '(?i)(?://|/\\*+|#)\\s*(TODO|FIXME|HACK|XXX|BUG|NOTE|REVIEW|WTF|DEPRECATED|DEPRECATE)\\b[:!\\-]?\\s*(.*)', 1)) AS marker,
substr(regexp_replace(regexp_extract(t, '(?i)(?://|/\\*+|#)\\s*(TODO|FIXME|HACK|XXX|BUG|NOTE|REVIEW|WTF|DEPRECATED|DEPRECATE)\\b[:!\\-]?\\s*(.*)', 2), '^\\s+|\\s+$', '', 'g'), 1, 160) AS note FROM l)"""
_COLS = "workspace, detector_id, severity, confidence, layer, title, fingerprint, sites"
_D = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1)"
ORACLE = {
    "detector_long_function": f"""WITH {_D}, n AS (SELECT *, line_range.end_line - line_range.start_line + 1 AS n FROM d WHERE kind = 'function' AND name NOT IN ('describe', 'it', 'test', 'suite', 'context'))
SELECT workspace, 'long-function' AS detector_id, CASE WHEN n >= 80 THEN 'high' WHEN n >= 40 THEN 'medium' ELSE 'low' END AS severity, 0.98::DOUBLE AS confidence, 1 AS layer, 'Long function: `' || name || '` (' || n || ' lines) in ' || file AS title,
'long-function:' || substr(sha256(file || ':' || name || ':' || line_range.start_line), 1, 16) AS fingerprint, 1 AS sites FROM n WHERE n >= 10""",
    "sql_facts": f"WITH {_TODO} SELECT path, n::INT AS line, marker FROM m WHERE marker <> ''",
    "detector_todo_comments": f"""WITH {_TODO} SELECT workspace, 'todo-comments' AS detector_id, CASE WHEN marker IN ('HACK', 'XXX', 'WTF', 'FIXME', 'BUG') THEN 'medium' ELSE 'low' END AS severity, 1.0::DOUBLE AS confidence, 1 AS layer, marker || ' comment in ' || path || ':' || n AS title,
'todo-comments:' || substr(sha256(path || ':' || n || ':' || marker || ':' || note), 1, 16) AS fingerprint, 1 AS sites FROM m WHERE marker <> ''""",
    "detector_public_any": f"""WITH {_D}, a AS (SELECT *, len(list_filter(fn_struct.params, lambda p: regexp_matches(p."type", '\\bany\\b'))) AS k FROM d WHERE kind = 'function' AND exported AND fn_struct IS NOT NULL)
SELECT workspace, 'public-any' AS detector_id, 'high' AS severity, 0.97::DOUBLE AS confidence, 1 AS layer, 'Public `any` in `' || name || '` (' || file || ')' AS title, 'public-any:' || substr(sha256(file || ':' || name), 1, 16) AS fingerprint, 1 AS sites
FROM a WHERE k > 0 OR regexp_matches(fn_struct.return_type, '\\bany\\b')""",
}
