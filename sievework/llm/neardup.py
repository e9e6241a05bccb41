"""Problem 4: near-duplicate records by many hash minima, banding, verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.components import connected_components
from sievework.session import Scratch, read

#: Minima per band and bands. The bands of a family begin with the same ``SHARED`` minima, by which its sets meet in one
#: task, so a set is sent once per family and not per band. A pair at Jaccard 0.65 meets in no family with probability
#: (1 - 0.65**3 (1 - (1 - 0.65**5)**12))**40 < 1e-4, one at 0.7 with 5e-7.
ROWS, BANDS = 8, 480
FAMILY, SHARED = 12, 3
#: One-bit minima kept as the signature: 8 x 64 of the bands' own. It travels with the set, so that a pair far below the
#: threshold ends where it arises; how many of those there are grows with the square of the sets.
SKETCH = 512
#: A signature's estimate must reach the threshold less so many standard deviations.
SLACK = 4.5
#: Members up to which the pairs of copies are made in one task.
BLOCK = 1000
#: Members up to which a bucket's pairs are made where it lies; larger ones are split in blocks.
BUCKET = 8192
#: Members up to which a family's group is held by one task; those of larger ones are sent by their whole bands.
GROUP = 400_000
#: Rows that are paired at once, and candidate pairs that are compared at once.
CHUNK, AT_ONCE = 60_000, 50_000
#: Words of a signature that are compared first, and members from which a bucket is compared as a matrix.
FIRST, MATRIX = 4, 24
#: Sets that are signed at once.
SIGNED = 1000
#: Rows of (family, set) that one task sorts and pairs; the number of tasks follows from the counted sets.
PER_TASK = 60_000
#: Candidate pairs that one task compares in full.
PAIRS_PER_TASK = 20_000


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)), rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 480) -> np.ndarray:
    """Least value of each universal hash ``a x + b mod 2**32`` over a set of 64-bit shingle hashes."""
    x = (shingles.astype(np.uint64) >> np.uint64(32)).astype(np.uint32)[:, None]
    return np.concatenate([(x * a[i : i + step] + b[i : i + step]).min(axis=0) for i in range(0, len(a), step)])


def _mix(cols: np.ndarray, band: np.ndarray) -> np.ndarray:
    """One 64-bit key per band from its minima and its number."""
    h = band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(cols.shape[1]):
        h = (h ^ cols[:, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    sets = batch.column(batch.schema.get_field_index("sh"))
    flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))])
    return (flat[ends[i] : ends[i + 1]] for i in range(batch.num_rows))


def _fresh(batch: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
    """The rows whose set the task has not met; copies within a task are signed once."""
    return batch.filter(pa.array([x not in seen and not seen.add(x) for x in batch.column(0).to_pylist()], pa.bool_()))


def _bander(rows: int, bands: int, seed: int):
    """(sid, sh) to (grp, sid, size, body), a row per family: its group, and 16 bits of its bands' keys before the signature."""
    families, own = bands // FAMILY, rows - SHARED
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _constants(families * SHARED + families * FAMILY * own, seed)
        number, seen = np.arange(families * (1 + FAMILY)), set()
        for batch in (whole.slice(q, SIGNED) for whole in batches for q in range(0, whole.num_rows, SIGNED)):
            batch = _fresh(batch, seen)
            n = batch.num_rows
            grp, size = np.empty((n, families), np.int64), np.empty(n, np.int32)
            body = np.empty((n, families, 2 * FAMILY + SKETCH // 8), np.uint8)
            for i, s in enumerate(_sets(batch)):
                m = minima(s, a, b)
                grp[i], size[i] = _mix(m[: families * SHARED].reshape(families, SHARED), number[:families]), min(len(s), 0xFFFF)
                m = m[families * SHARED :]
                keys = (_mix(m.reshape(-1, own), number[families:]).view(np.uint64) >> np.uint64(48)).astype(np.uint16)
                body[i, :, : 2 * FAMILY] = keys.reshape(families, FAMILY).view(np.uint8)
                # a high bit of the minimum's own hash, as bits of a minimum near 0 are not even
                one = (m[:SKETCH] * np.uint32(2654435761) >> np.uint32(31)).astype(np.uint64)
                body[i, :, 2 * FAMILY :] = (one.reshape(-1, 64) * bits).sum(axis=1, dtype=np.uint64).view(np.uint8)
            ends = pa.py_buffer(np.arange(n * families + 1, dtype=np.int32) * body.shape[2])
            body = pa.Array.from_buffers(pa.binary(), n * families, [None, ends, pa.py_buffer(body)])
            sid = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), families)
            yield pa.RecordBatch.from_arrays([pa.array(grp.ravel()), pa.array(sid), pa.array(np.repeat(size, families)), body], ["grp", "sid", "size", "body"])

    return band


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which signatures of 8 words differ; the words' counts lie side by side as the bytes of one number."""
    n, low = np.bitwise_count(x ^ y).view(np.uint64).ravel(), np.uint64(0x00FF00FF00FF00FF)
    return ((n & low) + (n >> np.uint64(8) & low)) * np.uint64(0x0001000100010001) >> np.uint64(48)


def _need(threshold: float, bits: int = SKETCH) -> int:
    """Equal bits that two signatures must have; their share is (1 + J) / 2 on average."""
    p = (1 + threshold) / 2
    return int(bits * (p - SLACK * (p * (1 - p) / bits) ** 0.5))


#: What pairing gives: pairs as (0, a, b, -1), members of a bucket beyond ``block`` as (its key, sid, size, number of
#: their block), members of a group beyond ``GROUP`` as (key of a band, sid, size, -2), members with their signature.
_MET = "key long, a long, b long, blk long, sig array<long>"


def _pairer(threshold: float, block: int, group: int, whole: bool):
    """Pairs the rows (grp, sid, size, body), sorted; ``whole``: (key, sid, size, sig) of whole bands, so groups are buckets."""
    family = 1 if whole else FAMILY
    few = 64 * FIRST - _need(threshold, 64 * FIRST)

    def read(batch):
        grp, sid, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
        if whole:
            sig = batch.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(grp), -1)
            return grp, sid, size, np.zeros((len(grp), 1), np.uint16), sig
        ends, data = (np.frombuffer(x, t) for x, t in zip(batch.column(3).buffers()[1:], (np.int32, np.uint8)))
        body = data[ends[batch.column(3).offset] :][: len(grp) * (2 * FAMILY + SKETCH // 8)].reshape(len(grp), -1)
        keys, sig = (np.ascontiguousarray(x).view(t) for x, t in ((body[:, : 2 * FAMILY], np.uint16), (body[:, 2 * FAMILY :], np.uint64)))
        return grp, sid, size, keys, sig

    def out(key, a, b, blk, sig=None):
        n = len(a)
        sig = pa.nulls(n, pa.list_(pa.int64())) if sig is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * sig.shape[1]), pa.array(sig.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([*(pa.array(np.broadcast_to(x, n), pa.int64()) for x in (key, a, b, blk)), sig], ["key", "a", "b", "blk", "sig"])

    def bands(grp, keys, j):
        return _mix(np.stack([grp.view(np.uint64), keys[:, j].astype(np.uint64)], axis=1), np.array([j + 1]))

    def first(w, x, y):
        """Whether the first words of the signatures leave a pair open."""
        return sum(np.bitwise_count(v[x] ^ v[y]) for v in w) <= few

    def near(rows, band, i, j):
        _, s, z, keys, sig = rows
        ok = (s[i] != s[j]) & ((np.minimum(z[i], z[j]) >= threshold * np.maximum(z[i], z[j]) - 1e-9) | (np.maximum(z[i], z[j]) >= 0xFFFF))
        i, j = i[ok], j[ok]
        ok = _differ(sig[i], sig[j]) <= SKETCH - _need(threshold)
        i, j = i[ok], j[ok]
        ok = ~(keys[i, :band] == keys[j, :band]).any(axis=1)  # else an earlier band of the family has the pair
        x, y = s[i[ok]], s[j[ok]]
        return out(0, np.minimum(x, y), np.maximum(x, y), -1)

    def runs(order, length, w):
        """Places of the pairs that the first words leave open, of all runs up to ``block``."""
        starts = np.cumsum(length) - length
        for m in np.unique(length[length <= block]):
            at = starts[length == m]
            if m < MATRIX:
                x, y = np.triu_indices(m, 1)
                step = max(1, AT_ONCE // len(x))
                for q in range(0, len(at), step):
                    p = at[q : q + step, None]
                    i, k = (p + x).ravel(), (p + y).ravel()
                    ok = first(w, i, k)
                    yield i[ok], k[ok]
                continue
            step = max(1, AT_ONCE // m)
            for p in at:
                for q in range(p, p + m, step):
                    x, y = np.divmod(np.flatnonzero(first(w, (slice(q, min(q + step, p + m)), None), (None, slice(q, p + m)))), p + m - q)
                    later = y > x
                    yield q + x[later], q + y[later]

    def closed(rows):
        """All groups of the rows, band by band."""
        grp, sid, size, _, _ = rows
        number = np.cumsum(np.concatenate([[0], grp[1:] != grp[:-1]]))
        alone = np.bincount(number) == 1
        at = np.flatnonzero(~alone[number])
        if not len(at):
            return
        if len(at) < len(grp):
            rows = tuple(x[at] for x in rows)
        grp, sid, size, keys, sig = rows
        number = number[at] << 32
        for j in range(family):
            key = number | keys[:, j]
            order = np.argsort(key, kind="stable")
            key = key[order]
            length = np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))
            order, length = order[np.repeat(length > 1, length)], length[length > 1]
            w = np.ascontiguousarray(sig[order, :FIRST].T)
            left, n = [], 0
            for x, y in runs(order, length, w):
                left.append((order[x], order[y]))
                n += len(x)
                if n > AT_ONCE:
                    yield near(rows, j, *(np.concatenate(x) for x in zip(*left)))
                    left, n = [], 0
            if n:
                yield near(rows, j, *(np.concatenate(x) for x in zip(*left)))
            for p in np.flatnonzero(length > block):
                r = order[(end := length[: p + 1].sum()) - length[p] : end]
                yield out(bands(grp[r], keys[r], j), sid[r], size[r], np.arange(len(r)) // block, sig[r])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, wait = [], 0, CHUNK
        opened, sent = None, 0  # the group that is too large, and its members so far
        last = None

        def large(rows):
            nonlocal sent
            grp, sid, size, keys, sig = rows
            if whole:
                yield out(grp, sid, size, (sent + np.arange(len(sid))) // block, sig)
            else:
                for j in range(family):
                    yield out(bands(grp, keys, j), sid, size, -2, sig)
            sent += len(sid)

        for batch in batches:
            rows = read(batch)
            grp, sid = rows[:2]
            if not len(grp):
                continue
            # copies that other tasks signed too lie side by side
            same = np.concatenate([[last == (grp[0], sid[0])], (grp[1:] == grp[:-1]) & (sid[1:] == sid[:-1])])
            last = (grp[-1], sid[-1])
            rows = tuple(x[~same] for x in rows)
            if opened is not None:
                n = int(np.searchsorted(rows[0], opened, "right"))
                if n:
                    yield from large(tuple(x[:n] for x in rows))
                rows = tuple(x[n:] for x in rows)
            if not len(rows[0]):
                continue
            opened = None
            held.append(rows)
            count += len(rows[0])
            if count < wait:
                continue
            rows, held = tuple(np.concatenate(x) for x in zip(*held)), []
            n = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from closed(tuple(x[:n] for x in rows))
            rows = tuple(x[n:] for x in rows)
            held, count = [rows], len(rows[0])
            if count > group:
                opened, sent = rows[0][0], 0
                yield from large(rows)
                held, count = [], 0
            wait = max(CHUNK, min(2 * count, group + 1))
        if held:
            rows, held = tuple(np.concatenate(x) for x in zip(*held)), []
            yield from closed(rows)

    return pairs


def _one_batch(fn):
    """Joins the many small batches that a bucket loop yields into larger ones."""

    def run(batches):
        kept, n = [], 0
        for b in fn(batches):
            kept.append(b)
            n += b.num_rows
            if n >= 50_000:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, n = [], 0
        if n:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    return run


def similar_sets(sets: DataFrame, threshold: float, min_size: int, scratch: Scratch, rows: int = ROWS, bands: int = BANDS, seed: int = 7, block: int = BUCKET, group: int = GROUP) -> DataFrame:
    """``(a, b, jaccard)``, a < b, of the different sets in ``sets`` (sid, sh) with Jaccard >= threshold.

    ``sh`` holds distinct 64-bit hashes, ``sid`` names the set's content, so copies share it. Sets
    below ``min_size`` are in no pair. Banded minima give candidates, one-bit signatures drop what
    is far below the threshold before it is written anywhere, the exact Jaccard decides. Groups beyond
    ``group`` members are sent again by whole bands, buckets beyond ``block`` are paired block by block
    over many tasks, so none is capped.
    """
    sets = sets.select("sid", "sh").filter(F.size("sh") >= min_size)
    n = sets.count()

    def paired(df: DataFrame, count: int, key: str, sid: str, whole: bool) -> DataFrame:
        df = df.repartition(max(1, -(-count // PER_TASK)), key).sortWithinPartitions(key, sid)
        return scratch.cut(df.mapInArrow(_one_batch(_pairer(threshold, block, group, whole)), _MET))

    banded = sets.mapInArrow(_bander(rows, bands, seed), "grp long, sid long, size int, body binary")
    met = paired(banded, n * (bands // FAMILY), "grp", "sid", False)
    large = met.filter("blk = -2").select("key", "a", "b", "sig")
    if found := large.count():
        met = met.union(paired(large, found, "key", "a", True))
    close = met.filter("blk = -1").select("a", "b")
    big = met.filter("blk >= 0")
    if big.head(1):
        spread = big.join(big.groupBy("key").agg((F.max("blk") + 1).alias("nb")), "key")
        left = spread.select("key", F.col("blk").alias("i"), F.explode(F.sequence("blk", F.col("nb") - 1)).alias("j"), F.col("a").alias("x"), F.col("b").alias("zx"), F.col("sig").alias("sx"))
        right = spread.select("key", F.explode(F.sequence(F.lit(0).cast("long"), "blk")).alias("i"), F.col("blk").alias("j"), F.col("a").alias("y"), F.col("b").alias("zy"), F.col("sig").alias("sy"))
        differ = sum((F.bit_count(F.col("sx")[k].bitwiseXOR(F.col("sy")[k])) for k in range(SKETCH // 64)), F.lit(0))
        fits = (F.least("zx", "zy") >= threshold * F.greatest("zx", "zy") - 1e-9) | (F.greatest("zx", "zy") >= 0xFFFF)
        both = left.join(right, ["key", "i", "j"]).filter((F.col("x") != F.col("y")) & fits & (SKETCH - differ >= _need(threshold)))
        close = close.union(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    close = scratch.cut(close.distinct())
    # the exact check reads only the sets that are left
    ids = close.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    full = scratch.cut(sets.join(ids, "sid", "left_semi").dropDuplicates(["sid"]))
    tasks = max(1, -(-close.count() // PAIRS_PER_TASK))
    j = close.repartition(tasks, "a").join(full.select(F.col("sid").alias("a"), F.col("sh").alias("sa")), "a")
    j = j.repartition(tasks, "b").join(full.select(F.col("sid").alias("b"), F.col("sh").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return j.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def shingle_sets(records: DataFrame, id_col: str, shingles: str) -> DataFrame:
    """``(id, sid, sh)``: distinct hashes of the entries that aren't null, and a hash of the whole set."""
    h = F.array_sort(F.array_distinct(F.transform(F.filter(shingles, lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))
    r = records.select(F.col(id_col).alias("id"), h.alias("sh")).filter("id IS NOT NULL AND sh IS NOT NULL")
    return r.select("id", F.xxhash64("sh", F.size("sh")).alias("sid"), "sh")


def near_duplicates(records: DataFrame, id_col: str, shingles: str, threshold: float = 0.8, min_size: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: similar pairs ``(a, b, jaccard)`` of different sets, and ``(id, sid)``.

    Records with equal sets share one ``sid``, so copies are compared once. Defined cases: a null
    list or id is in no pair; entries may repeat and come in any order, null entries are left out;
    a record delivered twice counts once; sets below ``min_size`` are in no pair and no member
    row; an empty table gives two empty results; other columns are not read.
    """
    scratch = Scratch(records.sparkSession, "neardup")
    sets = scratch.cut(shingle_sets(records, id_col, shingles).filter(F.size("sh") >= min_size))
    return similar_sets(sets.select("sid", "sh"), threshold, min_size, scratch), sets.select("id", "sid").distinct()


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "symbols").select("id", F.col("fn_struct.body_shingles").alias("shingles"))


def expand(pairs: DataFrame, members: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: all pairs of members of paired sets, and of equal ones.

    Sets with more than ``block`` members are split in blocks by a hash of the id, so that no task makes more than the
    pairs of two blocks, however many copies a set has.
    """
    size = scratch.cut(members.groupBy("sid").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"), F.count("*").alias("n")))
    blocks = members.join(size, "sid").select("sid", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("blk"), "id")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    other = pairs.select("a", "b").join(size.select(F.col("sid").alias("a"), F.col("nb").alias("na")), "a").join(size.select(F.col("sid").alias("b"), F.col("nb").alias("nb")), "b")
    other = other.select("a", "b", "nb", F.explode(numbers("na")).alias("i")).select("a", "b", "i", F.explode(numbers("nb")).alias("j"))
    same = size.filter("n > 1").select("sid", "nb", F.explode(numbers("nb")).alias("i")).select(F.col("sid").alias("a"), F.col("sid").alias("b"), "i", F.explode(F.sequence("i", F.col("nb") - 1)).alias("j"))
    x = blocks.select(F.col("sid").alias("a"), F.col("blk").alias("i"), F.col("id").alias("x"))
    y = blocks.select(F.col("sid").alias("b"), F.col("blk").alias("j"), F.col("id").alias("y"))
    met = other.unionByName(same).join(x, ["a", "i"]).join(y, ["b", "j"]).filter("x != y AND (a != b OR i != j OR x < y)")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of ids, those of equal sets among them, as the case list demands."""
    pairs, members = near_duplicates(_functions(spark, sf_dir), "id", "shingles", 0.65)
    scratch = Scratch(spark, "p4")
    return expand(scratch.cut(pairs), scratch.cut(members), scratch)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per function that has a near-duplicate or a copy: its group, by alternating stars."""
    pairs, members = near_duplicates(_functions(spark, sf_dir), "id", "shingles", 0.65)
    scratch = Scratch(spark, "p4g")
    pairs, members = scratch.cut(pairs), scratch.cut(members)
    comp = connected_components(pairs, "a", "b")
    m = members.join(comp, members.sid == comp.node, "left").select("id", F.coalesce("component", "sid").alias("c"))
    size = m.groupBy("c").agg(F.min("id").alias("group_id"), F.count_distinct("id").alias("group_size")).filter("group_size > 1")
    return m.join(size, "c").select("id", "group_id", "group_size").distinct()


_SQL = """
WITH RECURSIVE s AS (SELECT DISTINCT id, list_sort(list_distinct(fn_struct.body_shingles)) AS sh FROM symbols WHERE fn_struct.body_shingles IS NOT NULL),
k AS (SELECT * FROM s WHERE len(sh) >= 6),
x AS (SELECT id, len(sh) AS n, unnest(sh) AS t FROM k),
p AS (SELECT a.id AS id_a, b.id AS id_b FROM x a JOIN x b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.65)
"""

QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
ORACLE = {
    "p4_found": _SQL + "SELECT id_a, id_b FROM p",
    "p4_groups": _SQL
    + """, e AS (SELECT id_a AS a, id_b AS b FROM p UNION SELECT id_b, id_a FROM p),
r(a, l) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.a WHERE r.l < e.b),
g AS (SELECT a AS id, min(l) AS group_id FROM r GROUP BY a)
SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM g""",
}
