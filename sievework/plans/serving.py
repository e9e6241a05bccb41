"""Read queries over scans, findings and symbols; each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators.clustering import first_per
from sievework.operators.stats import latency_stats, window_summary
from sievework.operators.trees import roll_up
from sievework.plans.verdict import split_false_positives

_C = F.col
SEVERITIES = ("high", "medium", "low")


def severity_rank(c=None):
    c = _C("severity") if c is None else c
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def _counts(findings: DataFrame, by: str) -> DataFrame:
    """Open findings by severity and false positives of each ``by``."""
    n = [F.count_if((_C("bucket") == "open") & (_C("severity") == s)).alias(s) for s in SEVERITIES]
    return findings.groupBy(by).agg(*n, F.count_if(_C("bucket") == "false-positive").alias("false_positives"))


def scans(history: DataFrame, live: DataFrame | None = None, fp_set: DataFrame | None = None, kept_open: DataFrame | None = None, newest: int = 50) -> DataFrame:
    """Live scans and the ``newest`` of the history (the page's length), with their counts.

    Findings are parted anew by the stored set and what is kept open, so a list shows today's marks. A live scan
    hides its own stored copy. Both tables hold one row per scan with its array ``findings``.
    """
    cols = ["scan_id", "workspace_root", "state", "started_at", "finished_at", "findings"]
    page = history.select(*cols)
    if live is not None:
        page = page.join(live.select("scan_id"), "scan_id", "left_anti")
    page = page.orderBy(_C("started_at").desc(), "scan_id").limit(newest)
    page = page if live is None else live.select(*cols).unionByName(page)
    none = page.sparkSession.createDataFrame([], "fingerprint string")
    each = page.select("scan_id", F.explode("findings").alias("f")).select("scan_id", "f.*")
    counts = _counts(split_false_positives(each, none if fp_set is None else fp_set, none if kept_open is None else kept_open), "scan_id")
    return page.drop("findings").join(counts, "scan_id", "left").na.fill(0, [*SEVERITIES, "false_positives"])


def scan(history: DataFrame, scan_id: str, workspace_root: str | None = None, fp_set: DataFrame | None = None, kept_open: DataFrame | None = None) -> DataFrame:
    """The findings of one scan with their buckets; nothing if it belongs to another workspace."""
    h = history.filter(_C("scan_id") == scan_id)
    h = h if workspace_root is None else h.filter(_C("workspace_root") == workspace_root)
    none = history.sparkSession.createDataFrame([], "fingerprint string")
    found = h.select("scan_id", F.explode("findings").alias("f")).select("scan_id", "f.*")
    return split_false_positives(found, none if fp_set is None else fp_set, none if kept_open is None else kept_open)


def llm_stats(verdict_log: DataFrame) -> DataFrame:
    return latency_stats(verdict_log, "detector_id", "latency_ms")


def diff(current: DataFrame, base: DataFrame) -> DataFrame:
    """(fingerprint, state) of findings added, removed or persisting between two scans."""
    a, b = current.select("fingerprint", F.lit(1).alias("x")).distinct(), base.select("fingerprint", F.lit(1).alias("y")).distinct()
    return a.join(b, "fingerprint", "full").select("fingerprint", F.when(_C("y").isNull(), "added").when(_C("x").isNull(), "removed").otherwise("persisting").alias("state"))


def previous_scan(series: DataFrame) -> DataFrame:
    """Each scan with the one before it in its workspace that had findings."""
    w = Window.partitionBy("workspace").orderBy("started_at", "scan_id").rowsBetween(Window.unboundedPreceding, -1)
    return series.withColumn("previous_scan_id", F.last(F.when(_C("total") > 0, _C("scan_id")), ignorenulls=True).over(w))


def scan_series(series: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Scans of the last days, oldest first."""
    return series.filter(_C("started_at") >= now_ms - days * 86_400_000).orderBy("started_at", "scan_id")


def series_summary(series: DataFrame) -> DataFrame:
    return window_summary(series, "workspace")


def marked_to_fix(marked: DataFrame, live: DataFrame, history: DataFrame) -> DataFrame:
    """The latest finding of each marked fingerprint: a live one first, else from the newest scan."""
    cols = ["fingerprint", "detector_id", "severity", "confidence", "title", "evidence", "suggestion"]
    a = live.select(*cols, F.lit(2**62).cast("long").alias("at"))
    b = history.select("started_at", F.explode("findings").alias("f")).select(*[f"f.{c}" for c in cols], _C("started_at").alias("at"))
    d = a.unionByName(b).join(marked.select("fingerprint").distinct(), "fingerprint", "left_semi")
    return first_per(d, ["fingerprint"], [_C("at").desc(), "title"]).drop("at")


def finding(findings: DataFrame, fingerprint: str) -> DataFrame:
    return findings.filter(_C("fingerprint") == fingerprint)


def code_window(sources: DataFrame, path: str, line: int, context: int = 8) -> DataFrame:
    """(line, text) around a line; the context is clamped to 0..60."""
    k = max(0, min(60, context))
    d = sources.filter(_C("path") == path).select(F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return d.select((_C("i") + 1).alias("line"), "text").filter(_C("line").between(line - k, line + k)).orderBy("line")


def symbol_tree(files: DataFrame, symbols: DataFrame, findings: DataFrame) -> DataFrame:
    """Files and directories with symbols and findings by severity, counts bubbling up."""
    s = symbols.groupBy(_C("file").alias("path")).agg(F.count_distinct("id").alias("symbols"))
    e = findings.select("severity", F.explode("evidence").alias("e")).groupBy(_C("e.file").alias("path")).agg(*[F.count_if(_C("severity") == x).alias(x) for x in SEVERITIES])
    d = files.select("path").distinct().join(s, "path", "left").join(e, "path", "left").na.fill(0)
    return roll_up(d, "path", ["symbols", *SEVERITIES])


def file_edges(imports: DataFrame, path: str) -> DataFrame:
    """(direction, path, names) of a file's imports and importers."""
    out = imports.filter(_C("source") == path).select(F.lit("out").alias("direction"), F.coalesce("target", "specifier").alias("path"), "named_imports")
    into = imports.filter(_C("target") == path).select(F.lit("in").alias("direction"), _C("source").alias("path"), "named_imports")
    return out.union(into).groupBy("direction", "path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("named_imports")))).alias("names"))


def symbol_callers(imports: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Files that import a symbol of this name from where it is declared."""
    s = symbols.filter((_C("name") == name) & _C("exported")).select(_C("file").alias("target"), "is_default").distinct()
    j = imports.join(s, "target")
    return j.filter(F.array_contains("named_imports", name) | _C("namespace_alias").isNotNull() | (_C("default_import").isNotNull() & _C("is_default"))).select(_C("source").alias("path"), "target").distinct()


def refresh_finding(stored: DataFrame, rescanned: DataFrame, now_ms: int) -> DataFrame:
    """Stored findings after a rescan of their files: gone ones get ``resolved_at``, others their new content."""
    r = rescanned.select("fingerprint", F.struct(*[c for c in rescanned.columns if c != "fingerprint"]).alias("n")).dropDuplicates(["fingerprint"])
    j = stored.join(r, "fingerprint", "left")
    return j.select(*[F.when(_C("n").isNull(), F.coalesce("resolved_at", F.lit(now_ms))).alias(c) if c == "resolved_at" else _C(c) if c in ("fingerprint", "llm_false_positive") else F.when(_C("n").isNull(), _C(c)).otherwise(_C(f"n.{c}")).alias(c) for c in stored.columns])


# --- dashboards -------------------------------------------------------------------------------------
def facets(findings: DataFrame, severities=None, layer=None, detector=None, directory=None, text=None) -> DataFrame:
    """Findings by severity set, layer, detector, first two folders and free text."""
    d = findings
    if severities:
        d = d.filter(_C("severity").isin(*severities))
    if layer is not None:
        d = d.filter(_C("layer") == layer)
    if detector:
        d = d.filter(_C("detector_id") == detector)
    first = _C("evidence")[0]["file"]
    if directory:
        d = d.filter(F.substring_index(first, "/", 2) == directory)
    if text:
        t = text.lower()
        d = d.filter(F.lower(F.concat_ws(" ", "title", "fingerprint", first)).contains(t))
    return d


def detector_breakdown(findings: DataFrame) -> DataFrame:
    g = findings.groupBy("detector_id").agg(*[F.count_if(_C("severity") == s).alias(s) for s in SEVERITIES])
    return g.withColumn("weight", 100 * _C("high") + 10 * _C("medium") + _C("low")).orderBy(_C("weight").desc(), "detector_id")


def top_directories(findings: DataFrame, n: int = 6) -> DataFrame:
    """Folders with the most high findings; ``n`` is the report's length."""
    d = findings.filter("severity = 'high'").select(F.substring_index(_C("evidence")[0]["file"], "/", 2).alias("directory")).filter("directory IS NOT NULL")
    return d.groupBy("directory").agg(F.count("*").alias("high")).orderBy(_C("high").desc(), "directory").limit(n)


def cluster_label():
    """What a finding is about, from its first note: method and path, entity and column, target, else the quoted title."""
    note = _C("evidence")[0]["note"]
    get = lambda k: F.get_json_object(note, f"$.{k}")
    return F.coalesce(F.when(get("method").isNotNull() & get("pathPattern").isNotNull(), F.concat_ws(" ", get("method"), get("pathPattern"))), F.when(get("entity").isNotNull() & get("column").isNotNull(), F.concat_ws(".", get("entity"), get("column"))), get("target"), F.nullif(F.regexp_extract("title", r"[`'\"]([^`'\"]+)[`'\"]", 1), F.lit("")), _C("title"))


def cluster_groups(findings: DataFrame) -> DataFrame:
    """Findings grouped by what they are about: size, worst severity, detectors."""
    d = findings.withColumn("label", cluster_label())
    g = d.groupBy("label").agg(F.count("*").alias("n"), F.min(severity_rank()).alias("r"), F.array_sort(F.collect_set("detector_id")).alias("detectors"))
    return g.select("label", "n", F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), _C("r") + 1).alias("worst"), "detectors")


def queue(findings: DataFrame) -> DataFrame:
    """Findings of a workspace in reading order with the fingerprints before and after."""
    w = Window.partitionBy("workspace").orderBy(severity_rank(), _C("confidence").desc(), "fingerprint")
    return findings.select("workspace", "fingerprint", "severity", "confidence", F.lag("fingerprint").over(w).alias("previous"), F.lead("fingerprint").over(w).alias("next"))


def cluster_queue(findings: DataFrame, page_size: int = 20) -> DataFrame:
    """Reading order with big clusters first within a severity: position, cluster size and page, per workspace."""
    d = findings.withColumn("cluster_size", F.count("*").over(Window.partitionBy("workspace", cluster_label())))
    w = Window.partitionBy("workspace").orderBy(severity_rank(), _C("cluster_size").desc(), _C("confidence").desc_nulls_last(), "fingerprint")
    at = F.row_number().over(w)
    return d.select("workspace", "fingerprint", "severity", "cluster_size", at.alias("position"), F.floor((at - 1) / page_size + 1).cast("int").alias("page"))


def page(findings: DataFrame, number: int, page_size: int = 20) -> DataFrame:
    """One page of the reading order, from 1."""
    return cluster_queue(findings, page_size).filter(_C("page") == number)


def layer_share(findings: DataFrame) -> DataFrame:
    """Share of each workspace's findings that a verdict confirmed (layer 3), in percent."""
    return findings.groupBy("workspace").agg(F.count("*").alias("findings"), F.round(100 * F.count_if(_C("layer") == 3) / F.count("*"), 1).alias("layer3_percent"))


# --- evidence and symbols ---------------------------------------------------------------------------
#: Lines per block of the range join; a symbol is listed in every block that it touches.
LINE_BLOCK = 64


def _distinct_symbols(symbols: DataFrame) -> DataFrame:
    s = symbols.filter("id IS NOT NULL AND file IS NOT NULL").select("id", "name", "file", "exported", _C("line_range.start_line").alias("first"), _C("line_range.end_line").alias("last"))
    return first_per(s, ["id"], ["file", "first", "last", "name"])


def evidence_symbols(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(fingerprint, file, line, symbol_id)``: the symbols that start where a finding's evidence does."""
    e = findings.select("fingerprint", F.explode("evidence").alias("e")).select("fingerprint", _C("e.file").alias("file"), _C("e.line_range.start_line").alias("line")).distinct()
    s = _distinct_symbols(symbols).select("file", _C("first").alias("line"), _C("id").alias("symbol_id"))
    return e.join(s, ["file", "line"]).select("fingerprint", "file", "line", "symbol_id")


def enclosing_symbols(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(file, line, symbol_id)``: the innermost symbol around each (file, line); places outside all symbols give no row.

    A range join on equal file and block of lines, so a long file with many symbols is not compared pairwise. Of
    symbols of one length the later and then the least id holds.
    """
    p = places.select("file", "line").dropna().distinct().withColumn("block", F.floor(_C("line") / LINE_BLOCK))
    s = _distinct_symbols(symbols).filter(_C("first") <= _C("last"))
    s = s.withColumn("block", F.explode(F.sequence(F.floor(_C("first") / LINE_BLOCK), F.floor(_C("last") / LINE_BLOCK))))
    j = p.join(s, ["file", "block"]).filter((_C("line") >= _C("first")) & (_C("line") <= _C("last")))
    best = F.min(F.struct((_C("last") - _C("first")).alias("span"), (-_C("first")).alias("later"), "id")).alias("m")
    return j.groupBy("file", "line").agg(best).select("file", "line", _C("m.id").alias("symbol_id"))


def triage_context(places: DataFrame, symbols: DataFrame, sources: DataFrame, siblings: int = 6, around: int = 8, conventions: str = "", published: bool = False) -> DataFrame:
    """What a triage prompt says about each (file, line): conventions, enclosing symbol, exported siblings and the lines around.

    ``siblings`` is the length of that list, in the order of the file; ``around`` the lines on either side. Of a
    ``published`` package (see the scanner of that name) the conventions say that outsiders may import anything.
    """
    if published:
        conventions = "\n".join(filter(None, (conventions, "The package is published: files outside the workspace may use its exports.")))
    p = places.select("file", "line").dropna().distinct()
    d = _distinct_symbols(symbols)
    inner = enclosing_symbols(p, symbols).join(d.select(_C("id").alias("symbol_id"), _C("name").alias("enclosing")), "symbol_id")
    first = F.array_sort(F.collect_set(F.struct("first", "id", "name")))
    exported = d.filter("exported").groupBy("file").agg(first.alias("s"))
    lines = sources.filter("path IS NOT NULL").select(_C("path").alias("file"), F.split("text", "\n").alias("ls"))
    lines = first_per(lines, ["file"], [F.size("ls").desc()])
    j = p.join(inner, ["file", "line"], "left").join(exported, "file", "left").join(lines, "file", "left")
    others = F.filter("s", lambda x: _C("symbol_id").isNull() | (x["id"] != _C("symbol_id")))
    lo = F.greatest(_C("line") - around, F.lit(1))
    window = F.array_join(F.slice("ls", lo, F.greatest(_C("line") + around - lo + 1, F.lit(0))), "\n")
    return j.select("file", "line", "symbol_id", "enclosing", F.coalesce(F.slice(F.transform(others, lambda x: x["name"]), 1, siblings), F.array()).alias("siblings"), F.coalesce(window, F.lit("")).alias("window"), F.lit(conventions).alias("conventions"))
