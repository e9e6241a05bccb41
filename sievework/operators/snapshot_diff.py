"""What changed between full snapshots, by content-defined chunks of the key-sorted rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: One key in so many starts a new chunk.
CHUNK_ROWS = 64
#: Key ranges by hash into which each group is split, so that a hot group is many tasks: at least so many, and one for
#: so many rows of the table. Rows that one task sorts.
BUCKETS, PER_BUCKET, PER_TASK = 64, 100_000, 500_000


def content_digest(cols: Sequence[Column]) -> Column:
    """SHA-256 of the columns' JSON, in which null, empty and absent stay apart."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}), 256)


def as_set(c: Column) -> Column:
    """An array compared as a set: null stays null, order and repetition don't count."""
    return F.array_sort(F.array_distinct(c))


def snapshot_changes(
    rows: DataFrame,
    group: str,
    snapshot: str,
    key: str,
    content: Sequence[Column],
    delivered: str,
    pairs: Sequence[int] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    buckets: int | None = None,
) -> DataFrame:
    """``(group, snapshot, key, change_kind)`` of each snapshot n against n - 1.

    Rows are sorted by key inside hash ranges of the key; a key whose hash falls on
    a multiple of ``chunk_rows`` starts a chunk, so an insertion shifts no other chunk. Equal
    chunk digests of neighbouring snapshots discard their rows; only rows of unmatched chunks are
    joined by key and classified ``added``, ``removed`` or ``changed``.

    Defined cases: of rows with one (group, snapshot, key) the last ``delivered`` holds, a null
    time counting as first and a tie going to the greater content digest; null groups and keys are
    values like others; rows without a snapshot number are ignored; a group that is absent from a
    snapshot had no rows then; an empty table gives no changes. ``pairs`` are the n to report, by
    default all from the table's least number plus one to its greatest.
    """
    lo, hi, total = rows.agg(F.min(snapshot), F.max(snapshot), F.count("*")).first()
    buckets = buckets or max(BUCKETS, -(-total // PER_BUCKET))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // PER_TASK))
    if pairs is None:
        pairs = range(lo + 1, hi + 1) if lo is not None else []
    pairs = [int(n) for n in pairs]
    wanted = sorted({m for n in pairs for m in (n - 1, n)}) or [-1]
    r = rows.filter(F.col(snapshot).isin(wanted)).select(
        F.col(group).alias("g"),
        F.col(snapshot).cast("int").alias("n"),
        F.col(key).alias("k"),
        F.coalesce(F.col(delivered).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("t"),
        content_digest(content).alias("d"),
        F.pmod(F.xxhash64(F.col(key), F.lit("range")), F.lit(buckets)).cast("int").alias("b"),
    )
    # one exchange on (g, b) serves the dedup, the chunking, the digests and the joins
    r = r.repartition(tasks, "g", "b").groupBy("g", "b", "n", "k").agg(F.max(F.struct("t", "d")).alias("last")).select("g", "b", "n", "k", F.col("last.d").alias("d"))
    starts = F.pmod(F.xxhash64("k"), F.lit(chunk_rows)) == 0
    order = Window.partitionBy("g", "b", "n").orderBy(F.col("k").asc_nulls_first())
    r = r.withColumn("c", F.last(F.when(starts, F.xxhash64(F.col("k"), F.lit(1))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("c", F.coalesce("c", F.lit(0)))
    # each row is the new side of its own number and the old side of the next
    sides = r.withColumn("side", F.explode(F.array(F.struct(F.col("n").alias("p"), F.lit(True).alias("new")), F.struct((F.col("n") + 1).alias("p"), F.lit(False).alias("new")))))
    sides = sides.select("g", "b", "k", "d", "c", "side.p", "side.new").filter(F.col("p").isin(pairs or [-1]))
    one = lambda seed, new: F.expr(f"bit_xor(CASE WHEN new = {new} THEN xxhash64(k, d, {seed}) ELSE 0L END)")
    chunks = sides.groupBy("g", "b", "p", "c").agg(
        *[one(s, new).alias(f"{'new' if new == 'true' else 'old'}{s}") for s in (1, 2) for new in ("true", "false")],
        F.count_if("new").alias("n_new"),
        F.count_if(~F.col("new")).alias("n_old"),
    )
    open_chunks = chunks.filter("n_new != n_old OR new1 != old1 OR new2 != old2").select(F.col("g").alias("g2"), F.col("b").alias("b2"), F.col("p").alias("p2"), F.col("c").alias("c2"))
    left = sides.join(open_chunks, F.col("g").eqNullSafe(F.col("g2")) & (F.col("b") == F.col("b2")) & (F.col("p") == F.col("p2")) & (F.col("c") == F.col("c2")), "left_semi")
    met = left.groupBy("g", "b", "p", "k").agg(F.max(F.when(F.col("new"), F.col("d"))).alias("dn"), F.max(F.when(~F.col("new"), F.col("d"))).alias("do"))
    kind = F.when(F.col("do").isNull(), "added").when(F.col("dn").isNull(), "removed").when(F.col("dn") != F.col("do"), "changed")
    return met.withColumn("change_kind", kind).filter("change_kind IS NOT NULL").select(F.col("g").alias(group), F.col("p").alias(snapshot), F.col("k").alias(key), "change_kind")
