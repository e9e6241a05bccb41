"""Hash buckets, merged signals, distinct-actor clusters and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_edges(df: DataFrame, id_col: str, hash_col: str, signal: str) -> DataFrame:
    """``(src, dst, signal, hash)``: every member of a bucket of two or more, hung on its least id.

    Null and empty hashes are in no bucket. A bucket gives members - 1 edges, never all pairs; its
    least id comes from a partially aggregated minimum, so a hot hash is not gathered.
    """
    d = df.filter(F.col(hash_col).isNotNull() & (F.col(hash_col) != "")).select(F.col(id_col).alias("dst"), F.col(hash_col).alias("hash")).distinct()
    low = d.groupBy("hash").agg(F.min("dst").alias("src"), F.count("*").alias("n")).filter("n > 1").select("hash", "src")
    return d.join(low, "hash").filter("src != dst").select("src", "dst", F.lit(signal).alias("signal"), "hash")


def merge_signals(edges: DataFrame, components: DataFrame, priority: Sequence[str]) -> DataFrame:
    """``(component, signals, primary)``: which signals link each component, and the strongest of them."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("signal"))
    e = edges.join(components.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.array_sort(F.collect_set("signal")).alias("signals"), F.min(rank).alias("r"))
    return e.select("component", "signals", F.element_at(F.array(*[F.lit(p) for p in priority]), F.col("r").cast("int")).alias("primary"))


def distinct_actor_clusters(df: DataFrame, keys: Sequence[str], actor: str, min_actors: int = 2, **aggs: Column) -> DataFrame:
    """One row per key that at least ``min_actors`` different actors touch, with further aggregates."""
    return df.groupBy(*keys).agg(F.count_distinct(actor).alias("actors"), F.count("*").alias("sites"), *[c.alias(k) for k, c in aggs.items()]).filter(F.col("actors") >= min_actors)


def origins(df: DataFrame, keys: Sequence[str], origin: str, at_least: int = 2, **aggs: Column) -> DataFrame:
    """``(*keys, n)`` of the keys with ``at_least`` different origins, with further aggregates over the distinct rows."""
    return df.select(*keys, origin).distinct().groupBy(*keys).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in aggs.items()]).filter(F.col("n") >= at_least)


def names_in_use(df: DataFrame, key: str, name: str, at_least: int = 2) -> DataFrame:
    """``(key, names, ranked)`` of the keys that go by several names, the most used first, then by name."""
    per = df.groupBy(key, name).agg(F.count("*").alias("n"))
    g = per.groupBy(key).agg(F.count("*").alias("names"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(name).alias("name")))).alias("r"))
    return g.filter(F.col("names") >= at_least).select(key, "names", F.transform("r", lambda x: x["name"]).alias("ranked"))


def unmet(wanted: DataFrame, given: DataFrame, on: str, items: str) -> DataFrame:
    """Rows of ``wanted`` with the ``missing`` of their items that nobody gives under their key.

    Keys under which nothing is given are left out: of them nothing is known.
    """
    sets = given.select(on, F.explode(items).alias("_i")).groupBy(on).agg(F.collect_set("_i").alias("_given"))
    return wanted.join(sets, on).withColumn("missing", F.array_sort(F.array_except(items, "_given"))).filter(F.size("missing") > 0).drop("_given")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a total order."""
    return cap_per(df, keys, order, 1)


def cap_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key; a report feature, ties are broken by the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def anti_chain(df: DataFrame, *others: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Rows of ``df`` that match none of the other tables, one null-safe left-anti join after the other."""
    for other, on in others:
        o = other.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
        cond = None
        for c in on:
            eq = F.col(c).eqNullSafe(F.col(f"_{c}"))
            cond = eq if cond is None else cond & eq
        df = df.join(o, cond, "left_anti")
    return df


def first_match(rows: DataFrame, candidates: str, known: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """Resolves an ordered array of candidates against known values: the first that exists wins.

    ``keep`` identifies a row; rows without any hit keep a null ``target``.
    """
    each = rows.select(*keep, F.posexplode_outer(candidates).alias("rank", "cand"))
    hit = each.join(known.select(F.col(key).alias("cand"), F.lit(True).alias("hit")).distinct(), "cand", "left")
    return hit.groupBy(*keep).agg(F.min(F.when(F.col("hit"), F.struct("rank", "cand"))).alias("b")).select(*keep, F.col("b.cand").alias("target"))
