"""Percentiles, near-duplicates, groups, packing and mixing against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import groups, mixing, neardup, packing, percentiles
from sievework.session import Scratch
from tests.conftest import rows
from tests.test_kernels import labels


@pytest.mark.parametrize("finish, run", [(8, 16), (8192, 32768)])
def test_percentiles_are_exact(spark, monkeypatch, finish, run):
    monkeypatch.setattr(percentiles, "TOGETHER", finish)
    monkeypatch.setattr(percentiles, "RUN", run)
    rnd = random.Random(1)
    data = [("a", rnd.lognormvariate(5, 2)) for _ in range(700)] + [("b", float(rnd.randrange(3))) for _ in range(300)] + [(None, 5.0), ("c", None), ("c", float("nan")), ("c", -1.0), ("d", float("inf")), ("d", 0.0), ("d", -0.0), ("", 1.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5).withColumn("q", F.lit("clash"))
    got = {(r.k, r.q): (r.value, r.n) for r in percentiles.percentiles(df, ["k"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    want = {}
    for k in {k for k, _ in data}:
        vs = sorted(v for g, v in data if g == k and v is not None and v == v and v != -1)
        for q in (0.0, 0.5, 0.95, 1.0):
            if vs:
                want[k, q] = (vs[max(1, math.ceil(q * len(vs) - 1e-9)) - 1], len(vs))
    assert got == want
    assert percentiles.percentiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_infinite_values_count_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "TOGETHER", 8)
    inf = float("inf")
    values = {"a": [-inf] * 30 + [float(i) for i in range(40)] + [inf] * 30, "b": [-inf] * 50 + [inf] * 50}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").repartition(3)
    got = {(r.k, r.q): r.value for r in percentiles.percentiles(df, ["k"], "v", [0.1, 0.5, 0.9]).collect()}
    assert got == {("a", 0.1): -inf, ("a", 0.5): 19.0, ("a", 0.9): inf, ("b", 0.1): -inf, ("b", 0.5): -inf, ("b", 0.9): inf}


def test_combined_summaries_keep_their_bound(spark):
    rnd = random.Random(2)
    data = [("a", d, float(int(rnd.expovariate(0.01)))) for d in range(4) for _ in range(500 + 300 * d)] + [("b", 0, 1.0), (None, 1, 2.0)]
    df = spark.createDataFrame(data, "k string, day int, v double")
    s = percentiles.summarize(df, ["k"], "day", "v", eps=0.02)
    assert max(len(r.points) for r in s.collect()) <= 60
    for r in percentiles.combine(s, ["k"], [0.1, 0.5, 0.99], eps=0.02).collect():
        vs = sorted(v for k, _, v in data if k == r.k)
        want = max(1, math.ceil(r.q * len(vs) - 1e-9))
        low, high = np.searchsorted(vs, r.value, "left") + 1, np.searchsorted(vs, r.value, "right")
        assert low - r.max_rank_error - 1 <= want <= high + r.max_rank_error + 1 and r.n == len(vs)


def shingled(rnd, n=60):
    base = [[f"s{rnd.randrange(4000)}" for _ in range(rnd.randrange(8, 40))] for _ in range(n)]
    out = [(f"id{i:03}", b) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for k in range(rnd.randrange(3)):
            e = b[:]
            for _ in range(rnd.randrange(1, 1 + max(1, len(b) // 5))):
                e[rnd.randrange(len(e))] = f"n{rnd.randrange(10**6)}"
            rnd.shuffle(e)
            out.append((f"id{i:03}v{k}", e + e[:2]))
    return out


def brute(data, t, least):
    sets = [(i, {x for x in s if x is not None}) for i, s in data if s is not None]
    return sorted({(min(i, j), max(i, j)) for i, a in sets for j, b in sets if i != j and min(len(a), len(b)) >= least and len(a & b) / len(a | b) >= t})


@pytest.mark.parametrize("block", [1000, 3])
def test_near_duplicates_find_what_brute_force_finds(spark, block):
    rnd = random.Random(4)
    data = shingled(rnd, 40) + [("null", None), ("tiny", ["a", "b"]), ("tiny2", ["a", "b"]), ("holes", ["z%d" % i for i in range(8)] + [None])]
    data += [(f"copy{i}", data[0][1]) for i in range(5)] + [data[3], data[3]] + [(f"fam{i}", [f"f{k}" for k in range(30)] + [f"own{i}"]) for i in range(12)]
    df = spark.createDataFrame(data, "id string, sh array<string>").withColumn("sid", F.lit(1)).repartition(3)
    scratch = Scratch(spark, "t")
    sets = neardup.shingle_sets(df, "id", "sh").filter("size(sh) >= 6")
    pairs = neardup.similar_sets(sets.select("sid", "sh"), 0.65, 6, scratch, block=block)
    m = sets.select("id", "sid").distinct()
    j = pairs.join(m.select(F.col("sid").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("sid").alias("b"), F.col("id").alias("y")), "b")
    got = {(min(r.x, r.y), max(r.x, r.y)) for r in j.collect()}
    same = {}
    for r in m.collect():
        same.setdefault(r.sid, []).append(r.id)
    got |= {(a, b) for ids in same.values() for a in ids for b in ids if a < b}
    assert sorted(got) == brute(data, 0.65, 6)


@pytest.mark.parametrize("block", [1000, 4])
def test_pairs_of_sets_expand_to_all_pairs_of_members(spark, block):
    rnd = random.Random(8)
    data = shingled(rnd, 8) + [(f"copy{i:02}", [f"c{k}" for k in range(9)]) for i in range(23)] + [(f"near{i:02}", [f"c{k}" for k in range(8)]) for i in range(9)]
    df = spark.createDataFrame(data, "id string, sh array<string>")
    pairs, members = neardup.near_duplicates(df, "id", "sh", 0.65)
    assert rows(neardup.expand(pairs, members, Scratch(spark, "t"), block)) == brute(data, 0.65, 6)


@pytest.mark.parametrize("block, group", [(1000, 4), (3, 4), (3, 60), (1000, 0)])
def test_large_groups_of_sets_are_paired_whole(spark, block, group):
    rnd = random.Random(11)
    data = shingled(rnd, 30) + [(f"fam{i:02}", [f"f{k}" for k in range(30)] + [f"own{i}"]) for i in range(25)]
    data += [(f"half{i:02}", rnd.sample([f"f{k}" for k in range(30)], 24)) for i in range(25)]
    df = spark.createDataFrame(data, "id string, sh array<string>").repartition(3)
    sets = neardup.shingle_sets(df, "id", "sh").filter("size(sh) >= 6")
    scratch = Scratch(spark, "t")
    pairs = scratch.cut(neardup.similar_sets(sets.select("sid", "sh"), 0.65, 6, scratch, block=block, group=group))
    assert rows(neardup.expand(pairs, sets.select("id", "sid").distinct(), scratch)) == brute(data, 0.65, 6)


def test_sets_far_below_the_threshold_are_written_nowhere(spark):
    """Bodies of common lines resemble each other at 0.3 or so, and such pairs grow with the square of the sets."""
    rnd = random.Random(12)
    common = [f"c{k}" for k in range(60)]
    data = [(f"id{i:04}", rnd.sample(common, 28) + [f"own{i}-{k}" for k in range(3)]) for i in range(1500)]
    data += [(f"id{i:04}v", data[i][1][1:] + ["more"]) for i in range(40)]
    df = spark.createDataFrame(data, "id string, sh array<string>").repartition(3)
    sizes = []

    class Counted(Scratch):
        def cut(self, df, files=None):
            out = super().cut(df, files)
            sizes.append(out.count())
            return out

    sets = neardup.shingle_sets(df, "id", "sh")
    pairs = neardup.similar_sets(sets.select("sid", "sh"), 0.65, 6, scratch := Counted(spark, "t"))
    m = sets.select("id", "sid").distinct()
    assert rows(neardup.expand(scratch.cut(pairs), m, scratch)) == brute(data, 0.65, 6)
    assert max(sizes) < 2 * len(data)


def test_near_duplicates_of_nothing(spark):
    pairs, members = neardup.near_duplicates(spark.createDataFrame([], "id string, sh array<string>"), "id", "sh")
    assert pairs.count() == 0 and members.count() == 0


def test_bands_are_chosen_for_the_threshold():
    assert (1 - 0.65**neardup.ROWS) ** neardup.BANDS < 5e-4


def test_families_of_bands_are_chosen_for_the_threshold():
    own, families = neardup.ROWS - neardup.SHARED, neardup.BANDS // neardup.FAMILY
    assert all((1 - j**neardup.SHARED * (1 - (1 - j**own) ** neardup.FAMILY)) ** families < most for j, most in ((0.65, 1e-4), (0.7, 5e-7)))


def test_groups_of_many_shapes(spark):
    rnd = random.Random(6)
    hub = [("hub", f"leaf{i:03}") for i in range(60)]
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    ring = [(f"r{i:02}", f"r{(i + 1) % 9:02}") for i in range(9)]
    core = [(f"k{a}", f"k{b}") for a in range(6) for b in range(a)]
    tail = [("k0", "t0"), ("t0", "t1"), ("t1", "k3"), ("c005", "hub")]
    loose = [(f"x{rnd.randrange(200):03}", f"x{rnd.randrange(200):03}") for _ in range(150)]
    pairs = [(a, b) for a, b in hub + chain + ring + core + tail + loose if a != b]
    rnd.shuffle(pairs)
    data = [([a, b.upper() if i % 9 == 0 else b],) for i, (a, b) in enumerate(pairs)] + [(["solo"],), ([None, "solo"],), (None,), ([],), (["m1", "m2", None, "m3", "m1"],), (["m1", "m2"],)]
    df = spark.createDataFrame(data, "symbols array<string>").withColumn("u", F.lit(1)).withColumn("label", F.lit(2))
    got = rows(groups.reduce_and_group(groups.member_edges(df, "symbols")))
    assert got == sorted(labels(pairs + [("m1", "m2"), ("m1", "m3")]), key=str)
    assert rows(groups.reduce_and_group(groups.member_edges(df.repartition(5), "symbols"), min_shrink=0.9)) == got


def test_groups_of_nothing(spark):
    assert groups.reduce_and_group(groups.member_edges(spark.createDataFrame([], "symbols array<string>"), "symbols")).count() == 0


def optimum(sizes, cap):
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= cap:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_bounds_hold():
    rnd = random.Random(8)
    for _ in range(60):
        cap = rnd.randrange(10, 40)
        sizes = [rnd.randrange(1, cap + 1) for _ in range(rnd.randrange(1, 9))]
        bins = packing.best_fit_decreasing(sizes, cap)
        load = np.bincount(bins, weights=sizes)
        assert load.max() <= cap and packing.lower_bound(sizes, cap) <= optimum(sizes, cap) <= len(load)
    assert packing.lower_bound([], 5) == 0


def test_packing_places_every_token_once(spark):
    rnd = random.Random(9)
    items = [(i, int(rnd.paretovariate(1.1) * 20)) for i in range(700)] + [(900, 0), (901, None), (None, 4), (902, 512), (903, 1600), (904, 513)]
    df = spark.createDataFrame(items, "item long, n_tokens long").withColumn("container", F.lit("clash"))
    prof = spark.createDataFrame([("small", 512), ("large", 2048), ("none", None), ("zero", 0)], "profile string, capacity int")
    got = packing.pack(df, prof, items_per_part=150).collect()
    sizes = {i: n for i, n in items if i is not None and n}
    for p, cap in (("small", 512), ("large", 2048)):
        mine = [r for r in got if r.profile == p]
        load, parts = {}, {}
        for r in mine:
            load[r.container] = load.get(r.container, 0) + r.n_tokens
            parts.setdefault(r.item, []).append((r.start_token, r.n_tokens))
        assert max(load.values()) <= cap and set(parts) == set(sizes)
        for i, ps in parts.items():
            ps.sort()
            assert ps[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ps, ps[1:])) and sum(n for _, n in ps) == sizes[i] and (len(ps) == 1 or sizes[i] > cap)
        assert len(load) <= packing.global_bound(df, cap) * 1.02 + 2
    assert {r.profile for r in got} == {"small", "large"}
    assert packing.pack(df.limit(0), prof).count() == 0


def test_mixing_meets_shares_and_caps(spark):
    rnd = random.Random(10)
    docs = [(i, "abc"[i % 10 and (1 if i % 3 else 2)], rnd.randrange(5, 60)) for i in range(1500)] + [(5000, "a", 0), (5001, None, 9), (5002, "idle", 7)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("share", F.lit(9))
    w = spark.createDataFrame([("m", "a", 0.3, 4), ("m", "b", 0.5, 2), ("m", "c", 0.2, 1), ("m", "empty", 0.0, 2), ("n", "a", 0.5, 1), ("n", "gone", 0.5, 3)], "mix_name string, source string, target_share double, max_repeats int")
    got = mixing.mix(df, w, ranges=7).collect()
    size = {i: n for i, _, n in docs}
    tokens = {s: sum(n for _, t, n in docs if t == s and n) for s in "abc"}
    for m, shares, caps in (("m", {"a": 0.3, "b": 0.5, "c": 0.2}, {"a": 4, "b": 2, "c": 1}), ("n", {"a": 1.0}, {"a": 1})):
        mine = sorted((r for r in got if r.mix_name == m), key=lambda r: r.end_token)
        budget = min(caps[s] * tokens[s] / shares[s] for s in shares)
        total = sum(r.n_tokens for r in mine)
        assert budget * 0.98 - 200 <= total <= budget and {r.source for r in mine} == set(shares)
        end = 0
        for r in mine:
            end += r.n_tokens
            assert r.end_token == end and r.n_tokens == size[r.doc_id]
        for s, x in shares.items():
            assert abs(sum(r.n_tokens for r in mine if r.source == s) / total - x) < 0.02
            counts = {}
            for r in mine:
                if r.source == s:
                    counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
            assert max(counts.values()) <= caps[s]
    s = {(r.mix_name, r.source): r for r in mixing.shares(mixing.mix(df, w, total_tokens=2000), w).collect()}
    assert s["m", "empty"].tokens == 0 and abs(s["m", "b"].actual_share - 0.5) < 0.05 and sum(r.tokens for k, r in s.items() if k[0] == "m") <= 2000
    assert mixing.mix(df.limit(0), w).count() == 0
