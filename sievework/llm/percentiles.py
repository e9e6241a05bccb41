"""Problem 2: percentiles of very large numeric columns, per group.

Exact: distributed multi-select. Partitions hold sorted runs and propose the medians of what is
still possible; their weighted median is the pivot; runs are counted three ways against it; ruled
out ranges are cut off; this repeats per group and percentile until found. Each round answers all
percentiles of a group in one pass over its runs. Where all that is possible fits one task the rounds
go on inside it, over the same runs and with the same steps, so that they need no exchange.

Mergeable: from the multi-select's exact order statistics of one day or partition a summary of
evenly spaced ranks is kept; summaries combine with a rank error of at most eps times the count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.session import Scratch, broadcast_if_small, read

#: Values that one run holds at most, so no row and no task grows with a hot group.
RUN = 32_768
#: Values that are still possible from which the rounds of a group go on within one task.
TOGETHER = 8_192
#: Rank error of a summary, as a share of its count.
EPS = 0.005


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, v) to sorted runs (g, vals) of at most RUN values, per task."""
    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}
    total = 0

    def out(gs: list[str]):
        rows = [(g, x) for g in gs for v in [np.sort(np.concatenate(held.pop(g)))] for x in np.array_split(v, -(-len(v) // RUN))]
        for g in gs:
            size.pop(g)
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], ["g", "vals"])

    for batch in batches:
        codes = batch.column(0).dictionary_encode()
        v = batch.column(1).to_numpy(zero_copy_only=False)
        idx = codes.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(idx, kind="stable")
        ends = np.cumsum(np.bincount(idx, minlength=len(codes.dictionary)))
        for g, part in zip(codes.dictionary.to_pylist(), np.split(v[order], ends[:-1])):
            held.setdefault(g, []).append(part)
            size[g] = size.get(g, 0) + len(part)
        total += len(v)
        full = [g for g, n in size.items() if n >= RUN]
        if full:
            total -= sum(size[g] for g in full)
            yield out(full)
        if total > 64 * RUN:
            total = 0
            yield out(list(held))
    if held:
        yield out(list(held))


def _parts(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of (g, vals, ts): its row, q, pivot and values, and the bounds of what lies strictly between lo and hi.

    A null bound is open. ``ts`` are the open targets of the run's group: (q, lo, hi, pivot).
    """
    vals, ts = b.column(1), b.column(2)
    arrays, off = vals.values.to_numpy(zero_copy_only=False), vals.offsets.to_numpy()
    t = ts.values
    q, lo, hi, pivot = (np.asarray(t.field(i).to_numpy(zero_copy_only=False), np.float64) for i in range(4))
    at = ts.offsets.to_numpy()
    for i in range(b.num_rows):
        x, here = arrays[off[i] : off[i + 1]], slice(at[i], at[i + 1])
        first = np.where(np.isnan(lo[here]), 0, np.searchsorted(x, lo[here], "right"))
        last = np.where(np.isnan(hi[here]), len(x), np.searchsorted(x, hi[here], "left"))
        yield i, q[here], pivot[here], x, first, last


def _rows(b: pa.RecordBatch, found: list[tuple], names: list[str]) -> pa.RecordBatch:
    """(row, arrays) per run to one row per target, with the run's group."""
    at = np.repeat(np.array([i for i, *_ in found], np.int64), [len(x[0]) for _, *x in found])
    cols = [np.concatenate(c) if c else np.empty(0) for c in (list(zip(*[x for _, *x in found])) or [()] * len(names))]
    kinds = [np.float64 if n in ("q", "med") else np.int64 for n in names]
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *[pa.array(c.astype(k)) for c, k in zip(cols, kinds)]], ["g", *names])


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, vals, ts) to (g, q, med, n): the median of what is possible in each run, and its weight."""
    for b in batches:
        found = []
        for i, q, _, x, p, r in _parts(b):
            some = r > p
            found.append((i, q[some], x[(p[some] + r[some] - 1) // 2], r[some] - p[some]))
        yield _rows(b, found, ["q", "med", "n"])


def _three_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, vals, ts) to (g, q, less, equal), less counted above lo only."""
    for b in batches:
        found = []
        for i, q, pivot, x, p, _ in _parts(b):
            at = np.searchsorted(x, pivot, "left")
            found.append((i, q, np.maximum(0, at - p), np.searchsorted(x, pivot, "right") - at))
        yield _rows(b, found, ["q", "less", "equal"])


def _cut_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, vals, ts) to (g, q, vals): what is not ruled out."""
    for b in batches:
        rows = [(i, q[j], x[p[j] : r[j]]) for i, q, _, x, p, r in _parts(b) for j in np.flatnonzero(r > p)]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["g", "q", "vals"])


def _bound(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, above: bool) -> np.ndarray:
    """Per i the first place in v[lo[i]:hi[i]] with a value of at least (or above) x[i]."""
    lo, hi = lo.copy(), hi.copy()
    while (todo := np.flatnonzero(lo < hi)).size:
        mid = (lo[todo] + hi[todo]) // 2
        right = v[mid] <= x[todo] if above else v[mid] < x[todo]
        lo[todo] = np.where(right, mid + 1, lo[todo])
        hi[todo] = np.where(right, hi[todo], mid)
    return lo


def select_among(v: np.ndarray, runs: np.ndarray, run_of: np.ndarray, target_of: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th value of each target by the rounds of the multi-select, all targets at once.

    ``v`` holds sorted runs with offsets ``runs``; the pairs (``target_of``, ``run_of``) say which run belongs to which target.
    """
    k, value, found = k.astype(np.int64), np.full(len(k), np.nan), np.zeros(len(k), bool)
    t, p, r = target_of, runs[run_of], runs[run_of + 1]
    while len(t):
        med, weight = v[(p + r - 1) // 2], r - p
        order = np.lexsort((med, t))
        total = np.bincount(t, weight, len(k))
        upto = np.cumsum(weight[order]) - (np.cumsum(total) - total)[t[order]]
        middle = order[upto * 2 >= total[t[order]]]  # the first of each target is its weighted median
        pivot = np.full(len(k), np.nan)
        pivot[t[middle[::-1]]] = med[middle[::-1]]
        a = _bound(v, p, r, pivot[t], False)
        b = _bound(v, a, r, pivot[t], True)
        less, equal = (np.bincount(t, x, len(k)).astype(np.int64) for x in (a - p, b - a))
        here = np.zeros(len(k), bool)
        here[t] = True
        hit = here & (k > less) & (k <= less + equal)
        value[hit], found[hit] = pivot[hit], True
        above = k > less + equal
        k = np.where(here & above, k - less - equal, k)
        p, r = np.where(above[t], b, p), np.where(above[t], r, a)
        keep = ~found[t] & (r > p)
        t, p, r = t[keep], p[keep], r[keep]
    return value


def _rounds_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n, qs, ks, parts) to (g, q, value, n): the rounds of groups whose runs lie in one row."""
    for b in batches:
        qs, ks, parts = b.column(2), b.column(3), b.column(4)
        nt, nr = np.diff(qs.offsets.to_numpy()), np.diff(parts.offsets.to_numpy())
        runs = parts.values
        v, offsets = runs.values.to_numpy(zero_copy_only=False), runs.offsets.to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(b.num_rows), nt)  # the row of each target
        first_run, first_target = parts.offsets.to_numpy().astype(np.int64), np.arange(len(rows))
        reps = nr[rows]
        target_of = np.repeat(first_target, reps)
        run_of = np.repeat(first_run[:-1][rows], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        value = select_among(v, offsets, run_of, target_of, ks.values.to_numpy(zero_copy_only=False))
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), qs.values, pa.array(value), b.column(1).take(at)], ["g", "q", "value", "n"])


_FOUND = "g string, q double, value double, n long"


def _checked(df: DataFrame, text: str = "g", per_row: int = 64) -> DataFrame:
    """``df`` with a broadcast hint where its measured size allows."""
    size = df.agg(F.sum(F.octet_length(text) + F.lit(per_row))).first()[0] or 0
    return broadcast_if_small(df, size, 1)


def make_runs(values: DataFrame, scratch: Scratch) -> DataFrame:
    """Sorted runs (g, vals) of the values (g string, v double), written once."""
    return scratch.cut(values.mapInArrow(_runs, "g string, vals array<double>"))


def multi_select(runs: DataFrame, targets: DataFrame, scratch: Scratch, max_rounds: int = 80) -> DataFrame:
    """``(g, q, value, n)``: the value of rank k of each target (g, q, k, n), k from 1 among the n values of g.

    Runs of groups of up to TOGETHER values are brought together and their rounds run in place. Those of
    larger groups stay where they lie while the bounds close in; once a quarter of the data or less is
    possible its slices are written, so later rounds read only these.
    """
    ranks = F.array_sort(F.collect_list(F.struct("q", "k")))
    groups = targets.groupBy("g").agg(F.first("n").alias("n"), ranks.alias("t")).select("g", "n", F.col("t.q").alias("qs"), F.col("t.k").alias("ks"))
    wide = targets.filter(F.col("n") > TOGETHER)
    # no side of a round has more rows or longer keys than the targets of the large groups
    n_wide, key_bytes = wide.agg(F.count("*"), F.coalesce(F.max(F.octet_length("g")), F.lit(0))).first()
    large = broadcast_if_small(wide.select("g").distinct(), n_wide, key_bytes + 64)
    parts = runs.join(large, "g", "left_anti").groupBy("g").agg(F.collect_list("vals").alias("parts"))
    done = parts.join(groups, "g").select("g", "n", "qs", "ks", "parts").mapInArrow(_rounds_within, _FOUND)
    if not n_wide:
        return done
    null = F.lit(None).cast("double")
    state = scratch.cut(wide.select("g", "q", "k", "n", null.alias("lo"), null.alias("hi"), F.lit(True).alias("open"), null.alias("value")))
    data = state.groupBy("g").agg(F.first("n").alias("n")).agg(F.sum("n")).first()[0] or 0
    slices, on = runs.join(large, "g", "left_semi"), ["g"]
    for _ in range(max_rounds):
        if not state.filter("open").head(1):
            return done.unionByName(state.select("g", "q", "value", "n"))

        def bounded(live: DataFrame) -> DataFrame:
            """Each run or slice with its open targets."""
            ts = live.groupBy(*on).agg(F.collect_list(F.struct("q", "lo", "hi", "pivot")).alias("ts"))
            return slices.join(broadcast_if_small(ts, n_wide, key_bytes + 128), on).select("g", "vals", "ts")

        live = state.filter("open").select("g", "q", "lo", "hi", null.alias("pivot"))
        left = bounded(live).mapInArrow(_proposals, "g string, q double, med double, n long").groupBy("g", "q").agg(F.sum("n").alias("left"), F.expr("percentile(med, 0.5, n)").alias("pivot"))
        # between -inf and inf any finite pivot will do
        left = scratch.cut(left.withColumn("pivot", F.when(F.isnan("pivot"), 0.0).otherwise(F.col("pivot"))))
        total = left.agg(F.sum("left")).first()[0] or 0
        if len(on) == 1 and total * 4 <= data:
            slices, on = scratch.cut(bounded(live).mapInArrow(_cut_off, "g string, q double, vals array<double>")), ["g", "q"]
        # what is left fits one task: its rounds go on there
        close = state.join(left.filter(F.col("left") <= TOGETHER).select("g", "q"), ["g", "q"]).select("g", "q", "k", "n", "lo", "hi", null.alias("pivot"))
        rest = bounded(close).mapInArrow(_cut_off, "g string, q double, vals array<double>").groupBy("g", "q").agg(F.collect_list("vals").alias("parts"))
        rest = rest.join(close, ["g", "q"]).select("g", "n", F.array("q").alias("qs"), F.array("k").alias("ks"), "parts")
        rest = rest.mapInArrow(_rounds_within, _FOUND).select("g", "q", F.col("value").alias("got"))
        many = state.select("g", "q", "lo", "hi").join(left.filter(F.col("left") > TOGETHER).select("g", "q", "pivot"), ["g", "q"])
        counts = bounded(many).mapInArrow(_three_ways, "g string, q double, less long, equal long").groupBy("g", "q").agg(F.sum("less").alias("less"), F.sum("equal").alias("equal"))
        s = state.join(rest, ["g", "q"], "left").join(counts, ["g", "q"], "left").join(many.select("g", "q", "pivot"), ["g", "q"], "left")
        k, less, equal = F.col("k"), F.col("less"), F.col("equal")
        below, hit = F.col("open") & (k <= less), F.col("open") & (k > less) & (k <= less + equal)
        above = F.col("open") & (k > less + equal)
        s = s.select(
            "g", "q", "n",
            F.when(above, k - less - equal).otherwise(k).alias("k"),
            F.when(above, F.col("pivot")).otherwise(F.col("lo")).alias("lo"),
            F.when(below, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(F.col("got").isNotNull() | hit, False).otherwise(F.col("open")).alias("open"),
            F.coalesce("got", F.when(hit, F.col("pivot")), "value").alias("value"),
        )
        new = scratch.cut(s)
        scratch.drop(state, left)
        state = new
    raise RuntimeError(f"percentiles were not found in {max_rounds} rounds")


def _keyed(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(g, v): the measured values under one JSON text of the keys, in which null and "" differ."""
    v = F.col(value).cast("double")
    g = F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]), {"ignoreNullFields": "false"})
    # -0.0 and 0.0 are one value
    return rows.filter(v.isNotNull() & ~F.isnan(v) & (v != -1)).select(g.alias("g"), (v + F.lit(0.0)).alias("v"))


def _unkeyed(df: DataFrame, rows: DataFrame, keys: Sequence[str], *rest: str) -> DataFrame:
    kinds = ", ".join(f"k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keys))
    x = F.from_json("g", kinds)
    return df.select(*[x[f"k{i}"].alias(c) for i, c in enumerate(keys)], *rest)


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], scratch: Scratch | None = None) -> DataFrame:
    """``(*keys, q, value, n)`` with exact nearest-rank percentiles of each group.

    Nulls, NaN and -1 (not measured) are left out; a group without other values gives no row; null
    keys are a group like others; ties and repeated values count as often as they occur; infinite
    values are ordinary; an empty table gives no rows; other columns are not read.
    """
    scratch = scratch or Scratch(rows.sparkSession, "percentiles")
    runs = make_runs(_keyed(rows, keys, value), scratch)
    names = runs.groupBy("g").agg(F.sum(F.size("vals")).alias("n"))
    targets = names.select("g", "n", F.explode(F.array(*[F.lit(float(x)) for x in qs])).alias("q")).withColumn("k", F.greatest(F.ceil(F.col("q") * F.col("n") - 1e-9), F.lit(1)).cast("long"))
    return _unkeyed(multi_select(runs, scratch.cut(targets), scratch), rows, keys, "q", "value", "n")


def summarize(rows: DataFrame, keys: Sequence[str], part: str, value: str, eps: float = EPS) -> DataFrame:
    """One mergeable summary ``(*keys, part, n, points)`` per group and part (a day, a partition).

    ``points`` are (value, weight): the exact values at ranks r, 2r, .. and n, with r = max(1,
    floor(eps n)); each stands for the weight values since the last. A part of up to 1/eps values
    is kept whole.
    """
    scratch = Scratch(rows.sparkSession, "summaries")
    cols = [*keys, part]
    runs = make_runs(_keyed(rows, cols, value), scratch)
    names = runs.groupBy("g").agg(F.sum(F.size("vals")).alias("n"))
    step = F.greatest(F.floor(F.col("n") * F.lit(eps)), F.lit(1)).cast("long")
    ranks = names.select("g", "n", step.alias("r")).select("g", "n", F.explode(F.array_distinct(F.concat(F.sequence("r", "n", "r"), F.array("n")))).alias("k"))
    # multi-select by rank: q only names the target here
    found = multi_select(runs, scratch.cut(ranks.select("g", F.col("k").cast("double").alias("q"), "k", "n")), scratch)
    w = Window.partitionBy("g").orderBy("q")
    pts = found.withColumn("w", (F.col("q") - F.coalesce(F.lag("q").over(w), F.lit(0.0))).cast("long"))
    pts = pts.groupBy("g", "n").agg(F.array_sort(F.collect_list(F.struct("value", "w"))).alias("points"))
    return _unkeyed(pts, rows, cols, "n", "points")


def combine(summaries: DataFrame, keys: Sequence[str], qs: Sequence[float], eps: float = EPS) -> DataFrame:
    """``(*keys, q, value, n, max_rank_error)`` over all parts of each group.

    In each part every point's weight counts as lying at the point, so a part's rank is off by less
    than eps n of that part and the whole by less than eps n of the group. Weights are summed per
    value in parallel; the rank is found by a running sum over the points, not over the data.
    """
    pts = summaries.select(*keys, "n", F.explode("points").alias("p")).groupBy(*keys, F.col("p.value").alias("value")).agg(F.sum("p.w").alias("w"))
    total = summaries.groupBy(*keys).agg(F.sum("n").alias("n"))
    run = pts.withColumn("cum", F.sum("w").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    on = None
    for c in keys:
        eq = run[c].eqNullSafe(total[c])
        on = eq if on is None else on & eq
    j = run.join(total, on).select(*[run[c] for c in keys], "value", "cum", "n", F.explode(F.array(*[F.lit(float(x)) for x in qs])).alias("q"))
    k = F.greatest(F.ceil(F.col("q") * F.col("n") - 1e-9), F.lit(1))
    out = j.filter(F.col("cum") >= k).groupBy(*keys, "q", "n").agg(F.min("value").alias("value"))
    return out.select(*keys, "q", "value", "n", F.floor(F.col("n") * F.lit(eps)).alias("max_rank_error"))


QS = (0.5, 0.9, 0.95, 0.99)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log without repeated deliveries: of rows with one verdict_id the first logged holds."""
    v = read(spark, sf_dir, "verdict_log").select("verdict_id", "scan_id", "detector_id", "latency_ms", "logged_at")
    first = F.min(F.struct("logged_at", "latency_ms", "scan_id", "detector_id")).alias("x")
    return v.groupBy("verdict_id").agg(first).select("verdict_id", F.col("x.scan_id").alias("scan_id"), F.col("x.detector_id").alias("detector_id"), F.col("x.latency_ms").alias("latency_ms"), F.to_date("x.logged_at").cast("string").alias("day"))


def _by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir)
    ws = read(spark, sf_dir, "scan_series").groupBy("scan_id").agg(F.min("workspace").alias("workspace"))
    v = v.join(ws, "scan_id", "left")
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(c).alias("key")) for d, c in (("detector", "detector_id"), ("scan", "scan_id"), ("workspace", "workspace"), ("day", "day"))])
    return v.select(F.explode(dims).alias("d"), "latency_ms").select("d.dim", "d.key", "latency_ms")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the verdict latency by detector, scan, workspace and day."""
    return percentiles(_by_dimension(spark, sf_dir), ["dim", "key"], "latency_ms", QS)


def p2_scan_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile over the scans' own p50 and p95, by workspace."""
    s = read(spark, sf_dir, "scan_series").select("scan_id", "workspace", "llm_p50_ms", "llm_p95_ms").distinct()
    s = s.select("workspace", F.explode(F.array(F.struct(F.lit("llm_p50_ms").alias("measure"), F.col("llm_p50_ms").alias("v")), F.struct(F.lit("llm_p95_ms").alias("measure"), F.col("llm_p95_ms").alias("v")))).alias("m"))
    return percentiles(s.select("workspace", "m.measure", "m.v"), ["workspace", "measure"], "v", (0.5, 0.95))


def p2_combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by detector from the days' separate summaries, with the bound of their rank error."""
    return combine(summarize(verdicts(spark, sf_dir), ["detector_id"], "day", "latency_ms"), ["detector_id"], QS)


def p2_combined_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the value combined from the days lies within its stated rank error, counted over all values."""
    v = verdicts(spark, sf_dir)
    got = combine(summarize(v, ["detector_id"], "day", "latency_ms"), ["detector_id"], QS)
    g = got.groupBy("detector_id").agg(F.collect_list(F.struct("q", "value", "n", "max_rank_error")).alias("found"))
    x = F.col("latency_ms") + F.lit(0.0)
    rows = v.filter(x.isNotNull() & ~F.isnan(x) & (x != -1)).join(_checked(g, "detector_id", 256), "detector_id").select("detector_id", x.alias("x"), F.inline("found"))
    c = rows.groupBy("detector_id", "q", "value", "n", "max_rank_error").agg(F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    k = F.greatest(F.ceil(F.col("q") * F.col("n") - 1e-9), F.lit(1))
    return c.select("detector_id", "q", "n", ((k > F.col("below") - F.col("max_rank_error")) & (k <= F.col("upto") + F.col("max_rank_error"))).alias("within"))


_V = "v AS (SELECT verdict_id, unnest(x) FROM (SELECT verdict_id, min({'logged_at': logged_at, 'latency_ms': latency_ms, 'scan_id': scan_id, 'detector_id': detector_id}) AS x FROM verdict_log GROUP BY verdict_id))"
QUERIES = {"p2_percentiles": p2_percentiles, "p2_scan_medians": p2_scan_medians, "p2_combined_days": p2_combined_days, "p2_combined_error": p2_combined_error}
ORACLE = {
    "p2_combined_error": f"""WITH {_V} SELECT detector_id, q, count(*) AS n, true AS within FROM v, (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS q)
WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms <> -1 AND detector_id IS NOT NULL GROUP BY detector_id, q""",
    "p2_percentiles": f"""WITH {_V}, w AS (SELECT scan_id, min(workspace) AS workspace FROM scan_series GROUP BY scan_id),
d AS (SELECT v.*, w.workspace FROM v LEFT JOIN w USING (scan_id) WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms <> -1),
u AS (SELECT 'detector' AS dim, detector_id AS key, latency_ms AS x FROM d UNION ALL SELECT 'scan', scan_id, latency_ms FROM d UNION ALL SELECT 'workspace', workspace, latency_ms FROM d UNION ALL SELECT 'day', logged_at::DATE::VARCHAR, latency_ms FROM d),
r AS (SELECT dim, key, x, row_number() OVER (PARTITION BY dim, key ORDER BY x) AS rn, count(*) OVER (PARTITION BY dim, key) AS n FROM u)
SELECT dim, key, q, x AS value, n FROM r, (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS q) WHERE rn = greatest(ceil(q * n - 1e-9), 1)""",
    "p2_scan_medians": """WITH s AS (SELECT DISTINCT scan_id, workspace, llm_p50_ms, llm_p95_ms FROM scan_series),
u AS (SELECT workspace, 'llm_p50_ms' AS measure, llm_p50_ms AS x FROM s UNION ALL SELECT workspace, 'llm_p95_ms', llm_p95_ms FROM s),
r AS (SELECT workspace, measure, x, row_number() OVER (PARTITION BY workspace, measure ORDER BY x) AS rn, count(*) OVER (PARTITION BY workspace, measure) AS n FROM u WHERE x IS NOT NULL AND NOT isnan(x) AND x <> -1)
SELECT workspace, measure, q, x AS value, n FROM r, (SELECT unnest([0.5, 0.95])::DOUBLE AS q) WHERE rn = greatest(ceil(q * n - 1e-9), 1)""",
}
