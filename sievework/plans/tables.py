"""Kernel queries over the driver tables, each with an independent SQL recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.clustering import anti_chain, cap_per, distinct_actor_clusters, first_per, hash_edges, names_in_use, origins, unmet
from sievework.operators.components import connected_components
from sievework.operators.graph import edges_of, in_degree, reach
from sievework.operators.similarity import set_similarity_join
from sievework.operators.stats import latency_stats, outcome_counts
from sievework.operators.trees import roll_up
from sievework.plans import serving, verdict
from sievework.functions.scan import http_paths
from sievework.plans.detectors.symbols import name_tokens
from sievework.session import Scratch, read

_C = F.col
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE[name or fn.__name__] = sql
        return fn

    return register


# --- near-duplicate documents (flagship) -----------------------------------------------------------
def _words(c: str = "text"):
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def document_shingles(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, sh): distinct runs of ``size`` words; hashed, as runs are compared only for equality."""
    # the generator keeps the words from being extracted anew for every run
    w = docs.filter("text IS NOT NULL").select("doc_id", F.explode(F.array(_words())).alias("w")).filter(F.size("w") >= size)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, size), " ")))
    return w.select("doc_id", F.array_distinct(runs).alias("sh"))


_NEAR = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS sh FROM w WHERE len(w) >= 4),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s WHERE len(sh) >= 6),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*)::DOUBLE / (a.n + b.n - count(*)) AS j FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.65)
"""


@query(
    _NEAR
    + """, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, l) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.a WHERE r.l < e.b),
g AS (SELECT a AS doc_id, min(l) AS c FROM r GROUP BY a)
SELECT c AS cluster_id, count(*) AS size, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS severity, 'near-dup:' || substr(sha256(c::VARCHAR), 1, 16) AS fingerprint FROM g GROUP BY c"""
)
def near_dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents with alike text: exact copies collapse to one set first, pairs are between sets."""
    scratch = Scratch(spark, "neardocs")
    d = scratch.cut(document_shingles(read(spark, sf_dir, "documents")).filter("size(sh) >= 6").select("doc_id", F.array_sort("sh").alias("sh")))
    d = d.withColumn("set", F.sha2(F.array_join(F.transform("sh", lambda x: x.cast("string")), ","), 256))
    rep = d.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("sh").alias("sh"))
    pairs = set_similarity_join(rep, "rep", "sh", 0.65, min_size=6).select(_C("a").alias("src"), _C("b").alias("dst"))
    copies = d.join(rep.select("set", "rep"), "set").filter("doc_id != rep").select(_C("rep").alias("src"), _C("doc_id").alias("dst"))
    g = connected_components(pairs.union(copies)).groupBy("component").agg(F.count("*").alias("size"))
    return g.select(_C("component").alias("cluster_id"), "size", F.when(_C("size") >= 3, "high").otherwise("medium").alias("severity"), F.concat(F.lit("near-dup:"), F.substring(F.sha2(_C("component").cast("string"), 256), 1, 16)).alias("fingerprint"))


@query(
    """WITH t AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS h FROM documents WHERE text IS NOT NULL AND length(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) > 0)
SELECT h AS hash, min(doc_id) AS representative, count(*) AS copies FROM t GROUP BY h HAVING count(*) > 1"""
)
def exact_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")).alias("t")).filter(F.length("t") > 0)
    e = hash_edges(d.select("doc_id", F.sha2(F.lower("t"), 256).alias("h")), "doc_id", "h", "exact")
    return e.groupBy("hash", _C("src").alias("representative")).agg((F.count("*") + 1).alias("copies"))


# --- chained anti joins ------------------------------------------------------------------------------
@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def dead_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(_C("o_custkey").alias("c_custkey"))
    return anti_chain(read(spark, sf_dir, "customer").select("c_custkey"), (hit, ["c_custkey"]))


@query(
    """SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 45)
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount >= 0.1 AND l_tax >= 0.08)"""
)
def dead_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    a = li.filter("l_returnflag = 'R' AND l_quantity >= 45").select(_C("l_partkey").alias("p_partkey"))
    b = li.filter("l_discount >= 0.1 AND l_tax >= 0.08").select(_C("l_partkey").alias("p_partkey"))
    return anti_chain(read(spark, sf_dir, "part").select("p_partkey"), (a, ["p_partkey"]), (b, ["p_partkey"]))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_partkey ORDER BY suppliers DESC, l_partkey LIMIT 10")
def hub_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten parts with the most suppliers; the length of the list is the feature."""
    e = edges_of(read(spark, sf_dir, "lineitem").select(_C("l_suppkey").alias("source"), _C("l_partkey").alias("target")))
    return in_degree(e, limit=10).select(_C("dst").alias("l_partkey"), _C("n").alias("suppliers"))


@query("SELECT p_name, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 12")
def ambiguous_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts under which many brands sell."""
    return origins(read(spark, sf_dir, "part"), ["p_name"], "p_brand", 12).withColumnRenamed("n", "brands")


@query(
    """WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT user_id, count(*) AS kinds FROM e GROUP BY user_id HAVING count(*) >= 2),
r AS (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM e)
SELECT g.user_id, kinds, event_type AS most_used FROM g JOIN r ON r.user_id = g.user_id AND rn = 1"""
)
def name_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with two kinds of events or more, and their most used kind."""
    return names_in_use(read(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", _C("names").alias("kinds"), _C("ranked")[0].alias("most_used"))


@query(
    """WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts::DATE = DATE '2024-01-01'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts::DATE = DATE '2024-01-02')
SELECT user_id, event_type FROM a WHERE user_id IN (SELECT user_id FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.event_type = a.event_type)"""
)
def field_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that a user had on the first day and lacks on the second, for users seen on both."""
    e = read(spark, sf_dir, "events").select("user_id", F.array("event_type").alias("kinds"), F.to_date("ts").alias("d"))
    return unmet(e.filter("d = DATE '2024-01-01'"), e.filter("d = DATE '2024-01-02'"), "user_id", "kinds").select("user_id", F.explode("missing").alias("event_type")).distinct()


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.09), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(n) AS (SELECT min(b) FROM e UNION SELECT u.b FROM r JOIN u ON u.a = r.n) SELECT n AS node FROM r"""
)
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that a seed supplier reaches over large discounted lines."""
    li = read(spark, sf_dir, "lineitem").filter("l_quantity >= 49 AND l_discount >= 0.09")
    e = li.select(F.concat(F.lit("p"), _C("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), _C("l_suppkey").cast("string")).alias("dst")).distinct()
    return reach(e.union(e.select("dst", "src")), e.agg(F.min("dst").alias("node")))


@query(
    """WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts::DATE = DATE '2024-01-02'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts::DATE = DATE '2024-01-01')
SELECT coalesce(a.user_id, b.user_id) || ':' || coalesce(a.event_type, b.event_type) AS fingerprint, CASE WHEN b.user_id IS NULL THEN 'added' WHEN a.user_id IS NULL THEN 'removed' ELSE 'persisting' END AS state
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), F.concat_ws(":", _C("user_id").cast("string"), "event_type").alias("fingerprint"))
    return serving.diff(e.filter("d = DATE '2024-01-02'"), e.filter("d = DATE '2024-01-01'"))


# --- scans and verdicts --------------------------------------------------------------------------------
@query(
    """SELECT detector_id, GROUPING(detector_id) AS is_total, count(*) AS calls, round(sum(latency_ms), 3) AS total_ms, round(avg(latency_ms), 0) AS mean_ms, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms
FROM verdict_log WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0 GROUP BY GROUPING SETS ((detector_id), ())"""
)
def verdict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = latency_stats(read(spark, sf_dir, "verdict_log"), "detector_id", "latency_ms")
    return d.withColumn("is_total", _C("is_total").cast("long"))


_SCANS = "s AS (SELECT DISTINCT * FROM scan_series)"


@query(
    f"""WITH {_SCANS}, w AS (SELECT *, first_value(high) OVER q AS f, last_value(high) OVER q AS l FROM s WINDOW q AS (PARTITION BY workspace ORDER BY started_at, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT workspace, count(*) AS scans, max(l) - max(f) AS high_change, round(avg(coalesce(duration_ms, 0)), 3) AS avg_duration_ms, round(avg(CASE WHEN llm_calls > 0 THEN llm_p50_ms END), 3) AS avg_p50_ms, round(avg(CASE WHEN llm_calls > 0 THEN llm_p95_ms END), 3) AS avg_p95_ms FROM w GROUP BY workspace"""
)
def scan_series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.series_summary(read(spark, sf_dir, "scan_series").distinct())


@query(
    f"""WITH {_SCANS} SELECT scan_id, workspace, started_at, last_value(CASE WHEN total > 0 THEN scan_id END IGNORE NULLS) OVER (PARTITION BY workspace ORDER BY started_at, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_scan_id FROM s"""
)
def previous_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.previous_scan(read(spark, sf_dir, "scan_series").distinct()).select("scan_id", "workspace", "started_at", "previous_scan_id")


@query(
    """SELECT detector_id, count(*) FILTER (race) AS races, count(*) FILTER (NOT race) AS safe FROM (SELECT DISTINCT verdict_id, detector_id, race FROM verdict_log) GROUP BY detector_id"""
)
def race_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "verdict_log").select("verdict_id", "detector_id", "race").distinct()
    return outcome_counts(v, "detector_id", "race")


_LATEST = """l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace, snapshot_no, fingerprint ORDER BY delivered_at DESC, to_json(evidence)::VARCHAR, title, confidence) AS rn FROM findings) WHERE rn = 1)"""


def latest_findings(spark: SparkSession, sf_dir: str, snapshot: int | None = 6) -> DataFrame:
    """The findings of a snapshot, of repeated deliveries the last."""
    f = read(spark, sf_dir, "findings")
    f = f if snapshot is None else f.filter(_C("snapshot_no") == snapshot)
    return first_per(f, ["workspace", "snapshot_no", "fingerprint"], [_C("delivered_at").desc_nulls_last(), F.to_json("evidence"), "title", "confidence"])


@query(
    f"""WITH {_LATEST}, c AS (SELECT fingerprint, min(workspace) AS workspace, max(confidence) AS confidence, min(severity) AS severity FROM l WHERE snapshot_no = 6 GROUP BY fingerprint),
v AS (SELECT fingerprint, ('x' || substr(sha256(fingerprint), 1, 2)) AS h FROM c),
w AS (SELECT c.*, substr(sha256(c.fingerprint), 1, 1) IN ('0','1','2','3','4','5','6','7') AS pos, strpos('0123456789abcdef', substr(sha256(c.fingerprint), 2, 1)) / 16.0 AS vc, split_part(c.fingerprint, ':', 1) IN ('dup-type', 'dup-fn') AS dup FROM c)
SELECT fingerprint, round(CASE WHEN pos THEN least(CASE WHEN dup THEN 0.97 ELSE 0.95 END, greatest(confidence, vc)) WHEN dup THEN least(confidence, 1 - vc) * 0.7 ELSE greatest(0, confidence * (1 - vc)) END, 9) AS confidence,
CASE WHEN pos AND NOT dup AND severity = 'medium' AND vc >= 0.85 THEN 'high' WHEN NOT pos AND (CASE WHEN dup THEN least(confidence, 1 - vc) * 0.7 ELSE confidence * (1 - vc) END) < 0.7 THEN 'low' ELSE severity END AS severity,
NOT pos AND vc >= 0.6 AS auto_fp FROM w"""
)
def verdict_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict algebra over all findings of the last snapshot; the verdicts follow from the fingerprints' hashes."""
    f = latest_findings(spark, sf_dir).groupBy("fingerprint").agg(F.min("workspace").alias("workspace"), F.max("confidence").alias("confidence"), F.min("severity").alias("severity"))
    head = F.substring_index("fingerprint", ":", 1)
    kind = F.when(head == "dup-type", "duplicate-type").when(head == "dup-fn", "duplicate-function").otherwise(head)
    f = f.select("*", kind.alias("detector_id"), F.lit(1).alias("layer"), F.lit("").alias("description"), F.lit(None).cast("struct<confidence:double,reason:string>").alias("llm_false_positive"))
    h = F.sha2("fingerprint", 256)
    v = f.select("fingerprint", (F.substring(h, 1, 1) < "8").alias("positive"), (F.instr(F.lit("0123456789abcdef"), F.substring(h, 2, 1)) / 16.0).alias("confidence"), F.lit("").alias("reason"))
    out = verdict.apply_verdicts(f, v)
    return out.select("fingerprint", F.round("confidence", 9).alias("confidence"), "severity", _C("llm_false_positive").isNotNull().alias("auto_fp"))


@query(
    f"""WITH {_LATEST} SELECT workspace, CASE WHEN substr(sha256(fingerprint), 1, 1) = '0' THEN 'open' WHEN substr(sha256(fingerprint), 1, 1) IN ('1', '2') OR llm_false_positive IS NOT NULL THEN 'false-positive' ELSE 'open' END AS bucket, count(*) AS n FROM l WHERE snapshot_no = 6 GROUP BY ALL"""
)
def fp_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept open over the stored set over the automatic mark; the sets follow from the fingerprints' hashes."""
    f = latest_findings(spark, sf_dir)
    d = F.substring(F.sha2("fingerprint", 256), 1, 1)
    return verdict.split_false_positives(f, f.filter(d.isin("0", "1", "2")), f.filter(d == "0")).groupBy("workspace", "bucket").agg(F.count("*").alias("n"))


@query(f"WITH {_LATEST} SELECT detector_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, 100 * count(*) FILTER (severity = 'high') + 10 * count(*) FILTER (severity = 'medium') + count(*) FILTER (severity = 'low') AS weight FROM l GROUP BY detector_id")
def detector_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.detector_breakdown(latest_findings(spark, sf_dir, None))


@query(
    f"""WITH {_LATEST}, d AS (SELECT CASE WHEN len(string_split(evidence[1].file, '/')) <= 2 THEN evidence[1].file ELSE split_part(evidence[1].file, '/', 1) || '/' || split_part(evidence[1].file, '/', 2) END AS directory FROM l WHERE severity = 'high')
SELECT directory, count(*) AS high FROM d WHERE directory IS NOT NULL GROUP BY directory ORDER BY high DESC, directory LIMIT 6"""
)
def top_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.top_directories(latest_findings(spark, sf_dir, None))


@query(
    f"""WITH {_LATEST} SELECT workspace, fingerprint, severity, confidence, lag(fingerprint) OVER w AS previous, lead(fingerprint) OVER w AS next FROM l WHERE snapshot_no = 6
WINDOW w AS (PARTITION BY workspace ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, confidence DESC NULLS LAST, fingerprint)"""
)
def finding_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.queue(latest_findings(spark, sf_dir))


@query(
    f"""WITH {_LATEST}, x AS (SELECT severity, unnest(evidence) AS e FROM l), f AS (SELECT e.file AS p, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM x WHERE e.file IS NOT NULL GROUP BY 1),
pp AS (SELECT p, high, medium, low, unnest(list_concat([''], list_transform(range(1, len(string_split(p, '/')) + 1), lambda k: array_to_string(string_split(p, '/')[1:k], '/')))) AS path FROM f)
SELECT path, sum(high)::BIGINT AS high, sum(medium)::BIGINT AS medium, sum(low)::BIGINT AS low FROM pp GROUP BY path"""
)
def dir_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = latest_findings(spark, sf_dir, None).select("severity", F.explode("evidence").alias("e"))
    g = e.groupBy(_C("e.file").alias("path")).agg(*[F.count_if(_C("severity") == s).alias(s) for s in serving.SEVERITIES])
    return roll_up(g, "path", list(serving.SEVERITIES)).select("path", *serving.SEVERITIES)


# --- clusters, names, thresholds --------------------------------------------------------------------------
@query("SELECT cluster_key, count(DISTINCT scan_id) AS actors, count(*) AS sites FROM verdict_log WHERE cluster_key IS NOT NULL GROUP BY cluster_key HAVING count(DISTINCT scan_id) >= 2")
def shared_cluster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster keys that two scans or more judged."""
    return distinct_actor_clusters(read(spark, sf_dir, "verdict_log").filter("cluster_key IS NOT NULL"), ["cluster_key"], "scan_id")


@query(
    """SELECT doc_id, CASE WHEN length(text) >= 8000 THEN 'high' WHEN length(text) >= 2000 THEN 'medium' ELSE 'low' END AS severity FROM documents WHERE length(text) >= 500"""
)
def severity_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.plans.detectors import steps

    d = read(spark, sf_dir, "documents").select("doc_id", steps(F.length("text"), 500, 2000, 8000).alias("severity"))
    return d.filter("severity IS NOT NULL")


@query(
    """WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, list_distinct(list_filter(list_transform(string_split_regex(p_name, '[\\s_.-]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN ('get','set','fn','do','a','an','the','to','of','for','with','my','new','old','is','has','on','off','and','or','not'))) AS w FROM n),
x AS (SELECT p_name, len(w) AS k, unnest(w) AS t FROM t)
SELECT a.p_name AS a, b.p_name AS b, round(count(*)::DOUBLE / (a.k + b.k - count(*)), 6) AS jaccard FROM x a JOIN x b ON a.t = b.t AND a.p_name < b.p_name GROUP BY a.p_name, b.p_name, a.k, b.k HAVING count(*)::DOUBLE / (a.k + b.k - count(*)) >= 0.3"""
)
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "part").select("p_name").distinct().select("p_name", name_tokens(_C("p_name")).alias("w"))
    return set_similarity_join(n, "p_name", "w", 0.3).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(
    """WITH d AS (SELECT DISTINCT id, hash_strict FROM symbols WHERE hash_strict IS NOT NULL AND hash_strict <> '' AND id IS NOT NULL)
SELECT hash_strict AS hash, min(id) AS src, count(*) AS members FROM d GROUP BY hash_strict HAVING count(*) > 1"""
)
def symbol_hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = hash_edges(read(spark, sf_dir, "symbols").filter("id IS NOT NULL"), "id", "hash_strict", "strict")
    return e.groupBy("hash", "src").agg((F.count("*") + 1).alias("members"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_quantity >= 30) WHERE rn <= 2""")
def capped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two large lines of each order; the cap is the feature."""
    return cap_per(read(spark, sf_dir, "lineitem").filter("l_quantity >= 30"), ["l_orderkey"], ["l_linenumber", "l_quantity", "l_partkey", "l_suppkey"], 2).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS r FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY r, o_totalprice DESC NULLS LAST, o_orderkey)""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading order of findings applied to orders: a customer's orders by status and price."""
    o = read(spark, sf_dir, "orders")
    rank = F.when(_C("o_orderstatus") == "F", "high").when(_C("o_orderstatus") == "O", "medium").otherwise("low")
    q = serving.queue(o.select(_C("o_custkey").alias("workspace"), _C("o_orderkey").alias("fingerprint"), rank.alias("severity"), _C("o_totalprice").alias("confidence")))
    return q.select(_C("fingerprint").alias("o_orderkey"), "previous", "next")


@query(
    """SELECT cluster_key, CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END AS path FROM (SELECT DISTINCT cluster_key, regexp_replace(regexp_replace(regexp_replace(split_part(cluster_key, ' ', 2), '\\?.*$', ''), '/+[0-9]+(/|$)', '/:id\\1', 'g'), '/+', '/', 'g') AS p FROM verdict_log WHERE cluster_key LIKE '% /%')"""
)
def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's normalisation of paths over all keys of writing calls."""
    d = read(spark, sf_dir, "verdict_log").filter("cluster_key LIKE '% /%'").select("cluster_key").distinct()
    return d.select("cluster_key", http_paths(F.split_part(_C("cluster_key"), F.lit(" "), F.lit(2))).alias("path"))


# --- evidence, symbols, scans -----------------------------------------------------------------------
_SYM = "y AS (SELECT * FROM (SELECT id, name, file, exported, line_range.start_line AS a, line_range.end_line AS b, row_number() OVER (PARTITION BY id ORDER BY file, line_range.start_line, line_range.end_line, name) AS rn FROM symbols WHERE id IS NOT NULL AND file IS NOT NULL) WHERE rn = 1)"
_PLACES = "pl AS (SELECT DISTINCT path AS file, n::INT AS line FROM (SELECT path, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM sources WHERE path IS NOT NULL) WHERE t LIKE '%return%')"


def return_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line) of all lines that return something."""
    d = read(spark, sf_dir, "sources").filter("path IS NOT NULL").select(_C("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return d.filter(_C("t").contains("return")).select("file", (_C("i") + 1).cast("int").alias("line"))


_INNER = "i AS (SELECT file, line, id AS symbol_id, name AS enclosing FROM (SELECT pl.file, pl.line, y.id, y.name, row_number() OVER (PARTITION BY pl.file, pl.line ORDER BY b - a, a DESC, id) AS r FROM pl JOIN y ON y.file = pl.file AND pl.line BETWEEN a AND b) WHERE r = 1)"


@query(f"WITH {_SYM}, {_PLACES}, {_INNER} SELECT file, line, symbol_id FROM i")
def enclosing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that return something with the innermost symbol around them."""
    return serving.enclosing_symbols(return_places(spark, sf_dir), read(spark, sf_dir, "symbols"))


@query(
    f"""WITH {_SYM}, {_PLACES}, {_INNER}, l AS (SELECT path AS file, max(string_split(text, chr(10))) AS ls FROM sources GROUP BY path)
SELECT pl.file, pl.line, i.symbol_id, i.enclosing, coalesce(array_to_string((SELECT list(name ORDER BY a, id) FROM y WHERE y.file = pl.file AND exported AND (i.symbol_id IS NULL OR y.id <> i.symbol_id))[1:6], ','), '') AS siblings,
sha256(array_to_string(l.ls[greatest(pl.line - 8, 1):pl.line + 8], chr(10))) AS shown FROM pl LEFT JOIN i ON i.file = pl.file AND i.line = pl.line JOIN l ON l.file = pl.file"""
)
def triage_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of every line that returns something: enclosing symbol, exported siblings, the lines around it."""
    t = serving.triage_context(return_places(spark, sf_dir), read(spark, sf_dir, "symbols"), read(spark, sf_dir, "sources"))
    return t.select("file", "line", "symbol_id", "enclosing", F.array_join("siblings", ",").alias("siblings"), F.sha2("window", 256).alias("shown"))


@query(
    f"""WITH {_SYM} SELECT DISTINCT 'shown:' || s.id AS fingerprint, s.file, s.line_range.start_line AS line, y.id AS symbol_id FROM symbols s JOIN y ON y.file = s.file AND y.a = s.line_range.start_line WHERE s.id IS NOT NULL AND s.file IS NOT NULL"""
)
def evidence_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on every symbol's first line, led back to the symbols that start there."""
    s = read(spark, sf_dir, "symbols").filter("id IS NOT NULL")
    e = F.array(F.struct("file", "line_range", F.lit("").alias("snippet"), F.lit(None).cast("string").alias("note")))
    return serving.evidence_symbols(s.select(F.concat(F.lit("shown:"), "id").alias("fingerprint"), e.alias("evidence")), read(spark, sf_dir, "symbols"))


_LABEL = """coalesce(CASE WHEN json_valid(note) AND note->>'method' IS NOT NULL AND note->>'pathPattern' IS NOT NULL THEN (note->>'method') || ' ' || (note->>'pathPattern') END,
CASE WHEN json_valid(note) AND note->>'entity' IS NOT NULL AND note->>'column' IS NOT NULL THEN (note->>'entity') || '.' || (note->>'column') END, CASE WHEN json_valid(note) THEN note->>'target' END, nullif(regexp_extract(title, '[`''"]([^`''"]+)[`''"]', 1), ''), title)"""


@query(
    f"""WITH {_LATEST}, d AS (SELECT *, {_LABEL} AS label FROM (SELECT *, evidence[1].note AS note FROM l WHERE snapshot_no = 6)), c AS (SELECT *, count(*) OVER (PARTITION BY workspace, label) AS cluster_size FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, cluster_size DESC, confidence DESC NULLS LAST, fingerprint) AS position FROM c)
SELECT workspace, fingerprint, severity, cluster_size, position, ((position - 1) // 20 + 1)::INT AS page FROM r"""
)
def cluster_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading order with big clusters first, and the page of each finding."""
    return serving.cluster_queue(latest_findings(spark, sf_dir)).withColumn("position", _C("position").cast("long"))


@query(f"WITH {_LATEST}, d AS (SELECT *, {_LABEL} AS label FROM (SELECT *, evidence[1].note AS note FROM l WHERE snapshot_no = 6)) SELECT label, count(*) AS n, CASE min(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS worst, array_to_string(list_sort(list(DISTINCT detector_id)), ',') AS detectors FROM d GROUP BY label")
def cluster_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.cluster_groups(latest_findings(spark, sf_dir)).withColumn("detectors", F.array_join("detectors", ","))


@query(f"WITH {_LATEST} SELECT workspace, count(*) AS findings, round(100.0 * count(*) FILTER (layer = 3) / count(*), 1) AS layer3_percent FROM l WHERE snapshot_no = 6 GROUP BY workspace")
def layer_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.layer_share(latest_findings(spark, sf_dir))


def _as_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as scans with their findings."""
    f = latest_findings(spark, sf_dir, None)
    g = f.groupBy("workspace", "snapshot_no").agg(F.max(F.unix_micros(_C("delivered_at").cast("timestamp"))).alias("started_at"), F.collect_list(F.struct("fingerprint", "detector_id", "severity", "confidence", "title", "evidence", "suggestion", "llm_false_positive")).alias("findings"))
    return g.select(F.concat_ws("#", "workspace", _C("snapshot_no").cast("string")).alias("scan_id"), _C("workspace").alias("workspace_root"), F.lit("done").alias("state"), "started_at", _C("started_at").alias("finished_at"), "findings", "snapshot_no")


def _marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored false positives and what is kept open, told by the fingerprints' hashes."""
    f = read(spark, sf_dir, "findings").select("fingerprint", F.substring(F.sha2("fingerprint", 256), 1, 1).alias("d"))
    return f.filter(_C("d").isin("0", "1", "2")), f.filter("d = '0'")


_BUCKET = "CASE WHEN substr(sha256(fingerprint), 1, 1) = '0' THEN 'open' WHEN substr(sha256(fingerprint), 1, 1) IN ('1', '2') OR llm_false_positive IS NOT NULL THEN 'false-positive' ELSE 'open' END"


@query(
    f"""WITH {_LATEST}, b AS (SELECT *, workspace || '#' || snapshot_no AS scan_id, {_BUCKET} AS bucket FROM l), s AS (SELECT scan_id, any_value(snapshot_no) AS no, epoch_us(max(delivered_at)) AS started_at FROM b GROUP BY scan_id),
h AS (SELECT scan_id FROM s WHERE no < 6 ORDER BY started_at DESC, scan_id LIMIT 50), p AS (SELECT scan_id FROM s WHERE no = 6 UNION ALL SELECT scan_id FROM h)
SELECT scan_id, count(*) FILTER (bucket = 'open' AND severity = 'high') AS high, count(*) FILTER (bucket = 'open' AND severity = 'medium') AS medium, count(*) FILTER (bucket = 'open' AND severity = 'low') AS low, count(*) FILTER (bucket = 'false-positive') AS false_positives FROM b JOIN p USING (scan_id) GROUP BY scan_id"""
)
def scan_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshots as live scans beside the 50 newest earlier ones, parted by today's marks."""
    s = _as_scans(spark, sf_dir)
    return serving.scans(s.filter("snapshot_no < 6"), s.filter("snapshot_no = 6"), *_marks(spark, sf_dir)).select("scan_id", *serving.SEVERITIES, "false_positives")


@query(f"WITH {_LATEST} SELECT fingerprint, severity, {_BUCKET} AS bucket FROM l WHERE snapshot_no = 6 AND workspace = 'atlas-core'")
def scan_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan's findings with their buckets; the scan asked for is the feature."""
    return serving.scan(_as_scans(spark, sf_dir), "atlas-core#6", "atlas-core", *_marks(spark, sf_dir)).select("fingerprint", "severity", "bucket")


@query(
    f"""WITH {_LATEST}, m AS (SELECT DISTINCT fingerprint FROM findings WHERE substr(sha256(fingerprint), 1, 1) IN ('3', '4'))
SELECT fingerprint, title, confidence FROM (SELECT l.*, row_number() OVER (PARTITION BY l.fingerprint ORDER BY CASE WHEN snapshot_no = 6 THEN 1 ELSE 0 END DESC, CASE WHEN snapshot_no = 6 THEN NULL ELSE t END DESC, title) AS r
FROM (SELECT *, max(delivered_at) OVER (PARTITION BY workspace, snapshot_no) AS t FROM l) l JOIN m USING (fingerprint)) WHERE r = 1"""
)
def marked_to_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest finding of each marked fingerprint, live ones first."""
    s = _as_scans(spark, sf_dir)
    marked = read(spark, sf_dir, "findings").filter(F.substring(F.sha2("fingerprint", 256), 1, 1).isin("3", "4"))
    return serving.marked_to_fix(marked, latest_findings(spark, sf_dir), s.filter("snapshot_no < 6")).select("fingerprint", "title", "confidence")
