"""Exact set-similarity joins: an inverted index with prefix and length filters, and scores of two sets at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import Scratch, broadcast_if_small

#: Members of a word up to which its pairs are made in one task; beyond, blocks of it meet in several.
BLOCK = 16384
#: Found pairs of a group that are held before they are reduced to a forest.
HELD = 1 << 20
#: Bits of the bitmaps that bound common items, in a word's group and beside the prefixes of whole bodies.
WIDE, NARROW = 512, 256


def set_similarity_join(df: DataFrame, id_col: str, items: str, threshold: float, gates: Sequence[str] = (), min_size: int = 1) -> DataFrame:
    """``(a, b, jaccard)``, a < b, of all pairs with equal gates and Jaccard >= threshold; nothing is missed.

    Items are ordered rarest first; two sets that similar share an item among the first
    n - ceil(threshold n) + 1 of each, so only these prefixes are joined; pairs whose positions
    leave too few common items are dropped before the sets are fetched. Sets are compared as sets, null
    items and sets below ``min_size`` are left out; ids must be unique.
    """
    s = df.select(F.col(id_col).alias("id"), *gates, F.array_distinct(F.filter(items, lambda x: x.isNotNull())).alias("items")).filter(F.col("id").isNotNull() & (F.size("items") >= max(1, min_size)))
    freq = s.select(F.explode("items").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    ranked = s.select("id", *gates, F.size("items").alias("n"), F.explode("items").alias("t")).join(freq, "t")
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    ordered = ranked.groupBy("id", *gates, "n").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("o"))
    pre = ordered.select("id", *gates, "n", F.posexplode(F.slice("o", F.lit(1), keep.cast("int"))).alias("i", "p")).select("id", *gates, "n", "i", F.col("p.t").alias("t"))
    a, b = pre.alias("a"), pre.alias("b")
    # two sets of n and m items are similar from ceil(threshold / (1 + threshold) * (n + m)) common items on
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n") - 1e-9)
    for g in gates:
        on &= F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    met = a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), need.alias("need"), F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.col("a.n").alias("n"), F.col("b.n").alias("m"))
    # common items of the prefixes, and as many more as can come after the last of them
    met = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("need").alias("need"))
    pairs = met.filter(F.col("c") + F.least(F.col("n") - F.col("i") - 1, F.col("m") - F.col("j") - 1) >= F.col("need")).select("a", "b")
    full = s.select("id", "items")
    j = pairs.join(full.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return j.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def parity_bits(flat: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """A row of 64-bit words for each set, a bit telling whether an odd number of its items fall on it.

    Two sets differ in at least as many items as their rows differ in bits.
    """
    out = np.empty((len(sizes), bits // 64), np.uint64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(0, len(sizes), 1024):  # counts of so many sets are held at once
        j = min(i + 1024, len(sizes))
        at = np.repeat(np.arange(j - i), sizes[i:j]) * bits + (flat[ends[i] : ends[j]] & (bits - 1))
        odd = (np.bincount(at, minlength=(j - i) * bits) & 1).astype(np.uint8)
        out[i:j] = np.packbits(odd.reshape(j - i, bits), axis=1).view(np.uint64)
    return out


def _jaccard(both, either):
    return np.where(either > 0, both / np.maximum(either, 1), 0.0)


class _Pairs:
    """All pairs of a group that reach the threshold, as a spanning forest of the greatest scores."""

    def __init__(self, threshold: float, weight: float):
        self.threshold, self.weight = threshold, weight

    def reach(self, names: np.ndarray) -> np.ndarray:
        """By the names' Jaccard: the share of both sizes up to which two bodies may differ; -1 where no body is enough."""
        need = self.threshold - self.weight * names
        t = np.maximum(0.0, need / (1 - self.weight) - 1e-9) if self.weight < 1 else np.where(need <= 1e-9, 0.0, 2.0)
        return np.where(t <= 1, (1 - t) / (1 + t), -1.0) + 1e-6

    def __call__(self, table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, self.key, first = t["id"], t["k"][0].as_py(), t["block"].to_numpy() == t["x"].to_numpy()
        (w_flat, self.w), (self.flat, self.n) = [(x.flatten().to_numpy(zero_copy_only=False), x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) for x in (pa.concat_arrays(t[c].chunks) for c in ("words", "items"))]
        w, n, self.ends = self.w, self.n, np.concatenate(([0], np.cumsum(self.n)))
        self.words = np.zeros((len(w), w.max()), np.int64)
        self.there = np.arange(w.max()) < w[:, None]
        self.words[self.there] = w_flat
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0
        alone = self.copies()
        one = t["x"][0].as_py() == t["y"][0].as_py()
        left, right = (alone, alone) if one else (alone[first[alone]], alone[~first[alone]])
        bits, w_bits = parity_bits(self.flat, n, WIDE), parity_bits(w_flat, w, 64)[:, 0]
        # by the words of both names, and the bits in which these differ
        total = np.arange(2 * w.max() + 1)[:, None]
        both = np.maximum(0, (total - np.arange(65)) // 2)
        most = self.reach(_jaccard(both, total - both)).astype(np.float32).ravel()
        size, code = n.astype(np.float32) + np.float32(0.01), (w * 65).astype(np.int32)
        columns, w_columns, size_columns, code_columns = np.ascontiguousarray(bits[right].T), w_bits[right], size[right], code[right]
        for i in range(0, len(left), 128):
            rows = left[i : i + 128]
            for j in range(i if one else 0, len(right), 2048):
                cut = slice(j, j + 2048)
                apart = np.bitwise_count(bits[rows, 0, None] ^ columns[0, cut]).astype(np.uint16)
                for k in range(1, WIDE // 64):
                    apart += np.bitwise_count(bits[rows, k, None] ^ columns[k, cut])
                at = np.bitwise_count(w_bits[rows, None] ^ w_columns[cut]) + code[rows, None] + code_columns[cut]
                a, b = np.nonzero(apart <= most[at] * (size[rows, None] + size_columns[cut]))
                if one:
                    a, b = a[b + j > a + i], b[b + j > a + i]
                if len(a):
                    self.judge(rows[a], right[b + j], apart[a, b])
        a, b, score = self.reduced()
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "score": pa.array(score)})

    def copies(self) -> np.ndarray:
        """Links the rows that equal an earlier one to it; gives the others, which pair for all."""
        seen: dict[tuple[bytes, bytes], int] = {}
        of = np.array([seen.setdefault((self.words[k, : self.w[k]].tobytes(), self.flat[self.ends[k] : self.ends[k + 1]].tobytes()), k) for k in range(len(self.n))], np.int64)
        alone = of == np.arange(len(of))
        k = np.flatnonzero(~alone)
        if len(k):
            self.judge(of[k], k, np.zeros(len(k), np.int64))
        return np.flatnonzero(alone)

    def judge(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
        """Keeps those of the pairs whose score is high enough, each only under the least word that both have."""
        same = (self.words[a][:, :, None] == self.words[b][:, None, :]) & self.there[a][:, :, None] & self.there[b][:, None, :]
        both, n = same.sum((1, 2)), self.n
        names = _jaccard(both, self.w[a] + self.w[b] - both)
        mine = ~(same & (self.words[a] < self.key)[:, :, None]).any((1, 2)) & (apart <= self.reach(names) * (n[a] + n[b] + 0.02))
        a, b, names = a[mine], b[mine], names[mine]
        if not len(a):
            return
        common = common_items(a, b, self.flat, self.ends)
        score = self.weight * names + (1 - self.weight) * _jaccard(common, n[a] + n[b] - common)
        good = score >= self.threshold
        self.found.append((a[good], b[good], score[good]))
        self.held += int(good.sum())
        if self.held > HELD:
            self.found = [self.reduced()]
            self.held = 0

    def reduced(self) -> tuple[np.ndarray, ...]:
        a, b, score = (np.concatenate([np.empty(0, kind), *[f[i] for f in self.found]]) for i, kind in enumerate((np.int64, np.int64, float)))
        kept = forest(a, b, score, len(self.n))
        return a[kept], b[kept], score[kept]


def common_items(a: np.ndarray, b: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of common items of sets a[i] and b[i]; set k is the ascending flat[ends[k] : ends[k + 1]]."""
    out = np.zeros(len(a), np.int64)
    order = np.argsort(a, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        x = flat[ends[a[part[0]]] : ends[a[part[0]] + 1]]
        for i in range(0, len(part), 1024):
            ys = b[part[i : i + 1024]]
            size = ends[ys + 1] - ends[ys]
            if not len(x) or not size.any():
                continue
            starts = np.cumsum(size) - size
            y = flat[np.repeat(ends[ys] - starts, size) + np.arange(size.sum())]
            hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
            sums = np.concatenate(([0], np.cumsum(hit)))
            out[part[i : i + 1024]] = sums[starts + size] - sums[starts]
    return out


def forest(a: np.ndarray, b: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a spanning forest of the greatest scores: it joins what all edges join and has each group's best."""
    up, kept = list(range(n)), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    order = np.argsort(-score, kind="stable")
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        if (x := root(x)) != (y := root(y)):
            up[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], threshold: float, heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(t, h, id, n, four words of bits) of the rarest items of each set; ``heavy`` are the frequent ones, the most frequent last."""
    by_value = np.argsort(heavy)
    values = heavy[by_value]
    for batch in batches:
        items = batch.column("items")
        flat, n = items.flatten().to_numpy(zero_copy_only=False), np.asarray(items.value_lengths()).astype(np.int64)
        rank = np.full(len(flat), -1)
        if len(values):
            at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
            rank = np.where(values[at] == flat, by_value[at], -1)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((flat, rank, row))
        keep = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
        chosen = order[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(keep, n)]
        bits, of = parity_bits(flat, n, NARROW).view(np.int64), row[chosen]
        yield pa.RecordBatch.from_pydict({"t": flat[chosen], "h": batch.column("h").take(pa.array(of)), "id": batch.column("id").take(pa.array(of)), "n": n[of], **{f"b{k}": bits[of, k] for k in range(NARROW // 64)}})


def alike_items(s: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """``(a, b)``, a < b, by the rarest items: what links all (id, items) that pairs with a Jaccard >= threshold link.

    Rows of equal items hang on the least of them, which alone meets other sets.
    """
    spark = s.sparkSession
    s = s.filter("size(items) > 0").select("id", "items", F.xxhash64("items").alias("h"))
    counted = s.count()
    # items of more than one set in 256 come last, by frequency; their number is bounded by 256 times the mean size of a set
    freq = s.select(F.explode("items").alias("t")).groupBy("t").agg(F.count("*").alias("f")).filter(F.col("f") > max(8, counted // 256))
    heavy = np.array([r.t for r in freq.orderBy("f", "t").select("t").collect()], np.int64)
    shared = spark.sparkContext.broadcast(heavy)
    longs = [f"b{k}" for k in range(NARROW // 64)]
    schema = f"t long, h long, id string, n long, {', '.join(f'{x} long' for x in longs)}"
    pre = scratch.cut(s.mapInArrow(lambda batches: _prefixes(batches, threshold, shared.value), schema))
    low = pre.repartition("t").groupBy("t", "h").agg(F.min(F.struct("id", "n", *longs)).alias("m")).select("t", "m.*")
    a, b = low.alias("a"), low.alias("b")
    apart = sum((F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) for x in longs), F.lit(0))
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n") - 1e-9)
    on &= apart <= F.lit((1 - threshold) / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) + 1e-6
    each = s.select("h", "id")
    hung = each.join(each.groupBy("h").agg(F.min("id").alias("a")), "h").filter("a < id").select("a", F.col("id").alias("b"))
    met = scratch.cut(a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct().union(hung))
    scratch.drop(pre)
    return met


def scored_links(s: DataFrame, threshold: float, weight: float) -> DataFrame:
    """``(a, b, score)``, a < b: links that group the rows of (id, words, items) as all pairs with a score >= threshold do.

    The score of a pair is weight * J(words) + (1 - weight) * J(items). Pairs with a common word are all
    looked at under the least of them: bitmaps bound their common items from above, what may reach the
    threshold is counted, and each task passes on a spanning forest of the greatest scores, so the links are
    no more than the rows and every group has its best score among them. Pairs without a common word reach
    the threshold by their items alone and are sought by the rarest of these. Words and items are distinct
    64-bit hashes, ascending and read more than once; ids are unique strings.
    """
    scratch = Scratch(s.sparkSession, "scored")
    each = s.select("id", "words", "items", F.explode("words").alias("k"))
    hot = scratch.cut(s.select(F.explode("words").alias("k")).groupBy("k").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK).select("k", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts")))
    if many := hot.count():
        each = each.join(broadcast_if_small(hot, many, 64), "k", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        each = each.withColumn("block", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        each = each.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("id", "words", "items", "k", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    else:
        each = each.select("id", "words", "items", "k", *[F.lit(0).alias(c) for c in ("block", "x", "y")])
    pairs = _Pairs(threshold, weight)
    links = each.groupBy("k", "x", "y").applyInArrow(lambda table: pairs(table), "a string, b string, score double")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    alone = threshold / (1 - weight) if weight < 1 else 2.0
    if alone <= 1:
        met = alike_items(s, alone, scratch)
        own = s.join(broadcast_if_small(met.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * met.count(), 64), "id", "left_semi")
        j = met.join(own.select(F.col("id").alias("a"), F.col("words").alias("wa"), F.col("items").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("words").alias("wb"), F.col("items").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        score = F.lit(weight) * F.lit(0.0) + F.lit(1 - weight) * (both / (F.size("x") + F.size("y") - both))
        links = links.union(j.filter(~F.arrays_overlap("wa", "wb")).select("a", "b", score.alias("score")).filter(F.col("score") >= threshold))
    return scratch.cut(links)
