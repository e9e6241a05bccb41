"""Problem 7: filling fixed-capacity containers with items.

Bound-certified repacking: every partition packs by best-fit decreasing and compares its bin count
with lower bounds from dual feasible functions. A partition that meets its bound is final. Partitions
with a gap keep their well-filled bins, give the items of the others into a common pool, which is
dealt anew to fewer partitions and packed again, until the bounds are met or nothing is gained.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.tokens import VOCABULARY, token_counts
from sievework.session import Scratch, read

#: Items that one partition packs at most, on average.
ITEMS = 4_000


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """Bin number of each item; items go, largest first, into the fullest bin that takes them."""
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    free: list[int] = []  # different residual capacities, sorted
    bins: dict[int, list[int]] = {}
    out, n = [0] * len(sizes), 0
    for k in order.tolist():
        s = int(sizes[k])
        i = bisect_left(free, s)
        if i == len(free):
            b, r = n, capacity
            n += 1
        else:
            r = free[i]
            b = bins[r].pop()
            if not bins[r]:
                del bins[r]
                free.pop(i)
        out[k] = b
        r -= s
        if r > 0:
            if r not in bins:
                bins[r] = []
                insort(free, r)
            bins[r].append(b)
    return out


def lower_bound(sizes: Sequence[int], capacity: int) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    f_l rounds items above capacity - l up to a whole bin and drops those below l, for every
    l up to half the capacity; u_k rounds to multiples of 1 / (k + 1).
    """
    s = np.asarray(sizes, dtype=np.int64)
    if not len(s):
        return 0
    c = np.bincount(s, minlength=capacity + 1)[: capacity + 1]
    v = np.arange(capacity + 1)
    n, w = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * v)])
    lam = np.arange(0, capacity // 2 + 1)
    big = n[-1] - n[capacity - lam + 1]
    mid = w[capacity - lam + 1] - w[lam]
    best = int((big + -(-mid // capacity)).max())
    for k in range(1, 9):
        x = v * (k + 1)
        u = np.where(x % capacity == 0, v * k, (x // capacity) * capacity)
        best = max(best, int(-(-int((u * c).sum()) // (k * capacity))))
    return best


def _packer(round_no: int):
    schema = "profile string, item long, piece int, n_tokens long, capacity long, container string, keep boolean, certified boolean"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["n_tokens", "item", "piece"], ascending=[False, True, True])
        sizes = pdf["n_tokens"].to_numpy()
        bins = np.asarray(best_fit_decreasing(sizes, cap))
        bound = lower_bound(sizes, cap)
        n = int(bins.max()) + 1
        fill = np.bincount(bins, weights=sizes, minlength=n)
        certified = n <= bound
        # a gap: bins whose unused space is above the partition's mean are opened for the exchange
        spare = cap - fill
        keep = np.ones(n, bool) if certified else spare <= spare.mean()
        part = int(pdf["part"].iloc[0])
        out = pdf[["profile", "item", "piece", "n_tokens", "capacity"]].copy()
        out["container"] = [f"{round_no}-{part}-{b}" for b in bins]
        out["keep"] = keep[bins]
        out["certified"] = certified
        return out

    return pack, schema


def pack(items: DataFrame, profiles: DataFrame, items_per_part: int = ITEMS) -> DataFrame:
    """``(profile, container, item, piece, start_token, n_tokens, certified)`` of ``items`` (item, n_tokens).

    A container is ``certified`` if the partition that packed it met its lower bound or the item fills it. Rounds go on
    until every partition is certified or all that is left lies in one.

    ``profiles`` is (profile, capacity). An item is cut only if longer than the capacity, into full
    containers and a rest. Defined cases: items of no or negative size and null ids are not placed;
    equal items are separate by ``item``, repeated rows of one item must be removed before; a null
    or non-positive capacity makes no containers; an empty table gives no rows. The profiles are a
    handful of rows by contract and are read by the driver; items never are.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    sized = scratch.cut(items.filter("item IS NOT NULL AND n_tokens > 0").select("item", "n_tokens"))
    total = sized.count()
    caps = [(p, int(c)) for p, c in profiles.select("profile", "capacity").distinct().collect() if c is not None and c > 0]
    if not caps or not total:
        return spark.createDataFrame([], "profile string, container string, item long, piece int, start_token long, n_tokens long, certified boolean")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).cast("long").alias("capacity")) for p, c in caps]))
    work = sized.select("item", "n_tokens", each.alias("c")).select("item", "n_tokens", "c.profile", "c.capacity")
    full = F.floor(F.col("n_tokens") / F.col("capacity"))
    # whole containers of an item that is longer than one
    whole = work.filter("n_tokens >= capacity").select("profile", "item", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
    whole = whole.select("profile", F.concat_ws("-", F.lit("w"), "item", "piece").alias("container"), "item", F.col("piece").cast("int").alias("piece"), F.col("capacity").alias("n_tokens"), "capacity", F.lit(True).alias("certified"))
    pool = work.withColumn("piece", full.cast("int")).withColumn("n_tokens", F.col("n_tokens") % F.col("capacity")).filter("n_tokens > 0").select("profile", "item", "piece", "n_tokens", "capacity")
    parts = max(1, -(-total // items_per_part))
    done: list[DataFrame] = []
    r = 0
    while True:
        fn, schema = _packer(r)
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("item", "piece", F.lit(r)), F.lit(parts)).cast("int"))
        packed = scratch.cut(dealt.groupBy("profile", "part").applyInPandas(fn, schema))
        last = parts == 1
        kept = packed if last else packed.filter("keep")
        done.append(kept.select("profile", "container", "item", "piece", "n_tokens", "capacity", "certified"))
        pool = packed.filter("NOT keep").select("profile", "item", "piece", "n_tokens", "capacity")
        left = 0 if last else pool.count()
        if not left:
            break
        # fewer partitions, so that tails meet and the rounds end
        parts = max(1, min(-(-left // items_per_part), parts - 1))
        r += 1
    out = whole
    for d in done:
        out = out.unionByName(d)
    return out.select("profile", "container", "item", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), "n_tokens", "certified")


def global_bound(items: DataFrame, capacity: int) -> int:
    """Lower bound over all items: the histogram of sizes below the capacity is all the driver gets."""
    r = items.filter("n_tokens > 0").select(F.floor(F.col("n_tokens") / capacity).alias("w"), (F.col("n_tokens") % capacity).cast("int").alias("s"))
    whole = r.agg(F.sum("w")).first()[0] or 0
    hist = r.filter("s > 0").groupBy("s").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in hist:
        counts[s] = n
    return int(whole) + lower_bound_counts(counts, capacity)


def lower_bound_counts(counts: np.ndarray, capacity: int) -> int:
    """``lower_bound`` from a histogram, whose size the capacity bounds."""
    v = np.arange(capacity + 1)
    n, w = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * v)])
    lam = np.arange(0, capacity // 2 + 1)
    best = int((n[-1] - n[capacity - lam + 1] + -(-(w[capacity - lam + 1] - w[lam]) // capacity)).max())
    for k in range(1, 9):
        x = v * (k + 1)
        u = np.where(x % capacity == 0, v * k, (x // capacity) * capacity)
        best = max(best, int(-(-int((u * counts).sum()) // (k * capacity))))
    return best


def document_sizes(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, ["doc_id"], vocabulary=vocabulary).select(F.col("doc_id").alias("item"), "n_tokens")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pack_sizes").select("profile", F.col("capacity_tokens").alias("capacity"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container in each profile."""
    return pack(document_sizes(spark, sf_dir), _profiles(spark, sf_dir)).withColumnRenamed("item", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, the lower bound that no packing beats, tokens and the share of space unused."""
    scratch = Scratch(spark, "p7")
    sizes = scratch.cut(document_sizes(spark, sf_dir))
    prof = _profiles(spark, sf_dir)
    got = pack(sizes, prof).groupBy("profile").agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    bounds = spark.createDataFrame([(p, c, global_bound(sizes, c)) for p, c in prof.collect()], "profile string, capacity long, lower_bound long")
    return got.join(F.broadcast(bounds), "profile").select("profile", "capacity", "containers", "lower_bound", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every profile's packing: all tokens once, no container over capacity, at least the bound."""
    scratch = Scratch(spark, "p7c")
    sizes = scratch.cut(document_sizes(spark, sf_dir))
    prof = _profiles(spark, sf_dir)
    got = scratch.cut(pack(sizes, prof))
    c = got.groupBy("profile", "container").agg(F.sum("n_tokens").alias("t"), F.count_distinct("item").alias("items"), F.max("piece").alias("p"))
    c = c.join(prof, "profile").groupBy("profile").agg(F.max(F.col("t") - F.col("capacity")).alias("over"), F.count("*").alias("containers"))
    # the pieces of an item follow each other without gap or overlap and add up to it
    p = got.groupBy("profile", "item").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.max("piece").alias("last"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    p = p.join(sizes.withColumnRenamed("n_tokens", "size"), "item").join(prof, "profile")
    p = p.groupBy("profile").agg(F.count("*").alias("documents"), F.bool_and((F.col("t") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("k") == F.col("last") + 1) & (F.col("k") == F.ceil(F.col("size") / F.col("capacity")))).alias("whole"))
    bounds = spark.createDataFrame([(n, global_bound(sizes, k)) for n, k in prof.collect()], "profile string, least long")
    j = p.join(c, "profile").join(F.broadcast(bounds), "profile")
    return j.select("profile", "documents", "whole", (F.col("over") <= 0).alias("fits"), (F.col("containers") >= F.col("least")).alias("above_bound"), (F.col("containers") <= F.ceil(F.col("least") * 1.02) + 1).alias("near_bound"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_checks": p7_checks}
ORACLE = {
    "p7_checks": "SELECT profile, count(*) AS documents, true AS whole, true AS fits, true AS above_bound, true AS near_bound FROM pack_sizes, documents WHERE text <> '' GROUP BY profile",
}
