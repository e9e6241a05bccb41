"""Problem 8: mixing sources to target weights by weighted fair queueing.

Every copy of a shuffled document gets a virtual finish time, its source's cumulative tokens
divided by the target weight. Sorted globally by that time and cut at the total budget, each
source contributes its share at every point of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.tokens import VOCABULARY, token_counts
from sievework.session import Scratch, read

#: Hash ranges per source and pass, and time ranges per mix, that keep prefix sums parallel: at least so many, and
#: one for so many documents.
RANGES, PER_RANGE = 256, 50_000
SEED = 11


def _prefix(df: DataFrame, groups: list[str], rng: str, order: list, value: str, out: str) -> DataFrame:
    """Running sum of ``value`` over (rng, order) inside ``groups``, without one task per group.

    Sums per range are few (groups times ranges); a window over them gives each range's offset, and
    windows inside the ranges do the rest.
    """
    sums = df.groupBy(*groups, rng).agg(F.sum(value).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*groups).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1))
    offs = sums.select(*groups, rng, F.coalesce(before, F.lit(0)).alias("_o"))
    inside = F.sum(value).over(Window.partitionBy(*groups, rng).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_i", inside).join(offs, [*groups, rng]).withColumn(out, F.col("_o") + F.col("_i")).drop("_o", "_i")


def mix(docs: DataFrame, weights: DataFrame, total_tokens: int | None = None, ranges: int | None = None, seed: int = SEED) -> DataFrame:
    """``(mix_name, doc_id, pass_no, source, n_tokens, finish_time, end_token)`` of each record taken.

    ``docs`` is (doc_id, source, n_tokens), ``weights`` (mix_name, source, target_share,
    max_repeats). Without ``total_tokens`` a mix is as large as its caps allow: the least of
    max_repeats * tokens / share. ``end_token`` is the record's end in the mix's order.

    Defined cases: documents of no tokens, null sources and sources without a weight are not
    taken; a source with a weight but no documents is left out and the shares of the others grow in
    proportion; a null or non-positive weight or cap takes nothing; equal texts under other ids are
    other documents; empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    d = scratch.cut(docs.filter("doc_id IS NOT NULL AND source IS NOT NULL AND n_tokens > 0").select("doc_id", "source", "n_tokens"))
    ranges = ranges or max(RANGES, -(-d.count() // PER_RANGE))
    have = d.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    w = weights.filter("target_share > 0 AND max_repeats > 0").select("mix_name", "source", "target_share", "max_repeats").distinct().join(have, "source")
    w = w.withColumn("share", F.col("target_share") / F.sum("target_share").over(Window.partitionBy("mix_name")))
    most = F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).over(Window.partitionBy("mix_name"))
    budget = F.least(most, F.lit(float(total_tokens))) if total_tokens is not None else most
    plan = w.withColumn("budget", F.floor(budget).cast("double"))
    plan = scratch.cut(plan.withColumn("passes", F.least(F.ceil(F.col("share") * F.col("budget") / F.col("tokens")), F.col("max_repeats")).cast("int")))
    # mixes times sources, fixed by contract; the size is checked all the same
    side = F.broadcast(plan) if plan.count() <= 100_000 else plan
    copies = d.join(side, "source").select(
        "mix_name", "source", "doc_id", "n_tokens", "share", "budget", "tokens", F.explode(F.sequence(F.lit(1), F.greatest("passes", F.lit(1)))).alias("pass_no")
    )
    shuffled = copies.withColumn("h", F.xxhash64("doc_id", "mix_name", "pass_no", F.lit(seed))).withColumn("r", F.pmod(F.shiftrightunsigned("h", 40), F.lit(ranges)).cast("int"))
    cum = _prefix(shuffled, ["mix_name", "source", "pass_no"], "r", ["h", "doc_id"], "n_tokens", "in_pass")
    timed = cum.withColumn("finish_time", ((F.col("pass_no") - 1) * F.col("tokens") + F.col("in_pass")) / F.col("share")).filter("finish_time <= budget")
    timed = timed.withColumn("t", F.least(F.floor(F.col("finish_time") / F.col("budget") * ranges), F.lit(ranges - 1)).cast("int"))
    timed = scratch.cut(timed.select("mix_name", "doc_id", "pass_no", "source", "n_tokens", "finish_time", "budget", "t"))
    ended = _prefix(timed, ["mix_name"], "t", ["finish_time", "source", "doc_id", "pass_no"], "n_tokens", "end_token").filter("end_token <= budget")
    return ended.select("mix_name", "doc_id", "pass_no", "source", "n_tokens", "finish_time", "end_token").repartitionByRange("mix_name", "end_token").sortWithinPartitions("mix_name", "end_token")


def shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """Target and actual share, tokens, documents and most repeats of each weighted source."""
    got = mixed.groupBy("mix_name", "source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c")).groupBy("mix_name", "source").agg(F.sum("t").alias("tokens"), F.count("*").alias("documents"), F.max("c").alias("most_repeats"))
    j = weights.select("mix_name", "source", "target_share", "max_repeats").distinct().join(got, ["mix_name", "source"], "left")
    tokens = F.coalesce("tokens", F.lit(0))
    all_tokens = F.sum(tokens).over(Window.partitionBy("mix_name"))
    return j.select("mix_name", "source", "target_share", "max_repeats", tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(tokens / all_tokens, F.lit(0.0)).alias("actual_share"))


def _docs(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id", "source"], vocabulary=vocabulary)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every mix in their order."""
    return mix(_docs(spark, sf_dir), read(spark, sf_dir, "mix_weights"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of every mix."""
    w = read(spark, sf_dir, "mix_weights")
    return shares(mix(_docs(spark, sf_dir), w), w)


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every mix: shares, caps, and records in the order of their finish times.

    A source's tokens are off its share of the budget by less than two of the largest document: one that didn't fit its
    own source's time, and one cut with the rest at the budget.
    """
    scratch = Scratch(spark, "p8c")
    docs = scratch.cut(_docs(spark, sf_dir))
    w = read(spark, sf_dir, "mix_weights").distinct()
    m = scratch.cut(mix(docs, w))
    have = docs.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("have"), F.max("n_tokens").alias("largest"))
    x = w.filter("target_share > 0 AND max_repeats > 0").join(have, "source")
    by_mix = Window.partitionBy("mix_name")
    x = x.withColumn("share", F.col("target_share") / F.sum("target_share").over(by_mix))
    x = x.withColumn("budget", F.floor(F.min(F.col("max_repeats") * F.col("have") / F.col("share")).over(by_mix))).withColumn("largest", F.max("largest").over(by_mix))
    got = m.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("t"))
    most = m.groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("k"), F.count_distinct("pass_no").alias("d")).groupBy("mix_name", "source").agg(F.max("k").alias("k"), F.bool_and(F.col("k") == F.col("d")).alias("once"))
    j = x.join(got, ["mix_name", "source"], "left").join(most, ["mix_name", "source"], "left")
    near = F.abs(F.coalesce("t", F.lit(0)) - F.col("share") * F.col("budget")) <= 2 * F.col("largest")
    return j.select("mix_name", "source", F.round("share", 9).alias("share"), near.alias("near_share"), (F.coalesce("k", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), F.coalesce("once", F.lit(True)).alias("once_a_pass"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_checks": p8_checks}
ORACLE = {
    "p8_checks": """WITH w AS (SELECT DISTINCT * FROM mix_weights), x AS (SELECT w.* FROM w WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE text <> ''))
SELECT mix_name, source, round(target_share / sum(target_share) OVER (PARTITION BY mix_name), 9) AS share, true AS near_share, true AS within_cap, true AS once_a_pass FROM x""",
}
