"""Kernels against brute force and hand-made cases."""

import hashlib
import inspect
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.operators.clustering import anti_chain, cap_per, distinct_actor_clusters, first_match, hash_edges, merge_signals
from sievework.operators.components import connected_components
from sievework.operators.graph import edges_of, forward_re_exports, nodes_of, reach
from sievework.operators.similarity import set_similarity_join
from sievework.operators.snapshot_diff import snapshot_changes
from sievework.operators.stats import latency_stats
from sievework.operators.trees import roll_up
from sievework.plans.detectors import fingerprint
from tests.conftest import rows


def labels(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return sorted((x, find(x)) for x in parent)


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (600, None)]
    df = spark.createDataFrame(edges, "src int, dst int")
    want = labels([(a, b) for a, b in edges if b is not None])
    assert rows(connected_components(df)) == sorted(want, key=str)
    assert rows(connected_components(df.repartition(7).orderBy(F.rand(1)))) == sorted(want, key=str)
    assert connected_components(df.limit(0)).count() == 0


def test_set_similarity_join_is_exact(spark):
    rnd = random.Random(5)
    base = [[f"t{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 14))] for _ in range(60)]
    data = [(i, i % 2, b) for i, b in enumerate(base + [b + ["x"] for b in base[:20]])] + [(999, 0, None), (998, 0, []), (997, 0, ["a", None, "a"])]
    df = spark.createDataFrame(data, "id int, g int, items array<string>")
    got = {(r.a, r.b): round(r.jaccard, 6) for r in set_similarity_join(df, "id", "items", 0.5, ["g"], 2).collect()}
    sets = {i: (g, {x for x in b if x is not None}) for i, g, b in data if b}
    want = {}
    for i, (g, a) in sets.items():
        for j, (h, b) in sets.items():
            if i < j and g == h and len(a) >= 2 and len(b) >= 2 and len(a & b) / len(a | b) >= 0.5:
                want[i, j] = round(len(a & b) / len(a | b), 6)
    assert got == want


def test_hash_edges_and_signals(spark):
    df = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("d", None), ("e", ""), ("f", "x"), ("f", "x")], "id string, h string")
    e = hash_edges(df, "id", "h", "strict")
    assert rows(e, "src", "dst") == [("a", "b"), ("a", "c")]
    more = spark.createDataFrame([("c", "f", "near")], "src string, dst string, signal string")
    every = e.select("src", "dst", "signal").union(more)
    s = merge_signals(every, connected_components(every), ["strict", "near"]).collect()
    assert [(r.component, r.signals, r.primary) for r in s] == [("a", ["near", "strict"], "strict")]


def test_anti_chain_is_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    assert rows(anti_chain(a, (spark.createDataFrame([(None,)], "v string"), ["v"]), (spark.createDataFrame([(3,)], "k int"), ["k"])), "k") == [(2,)]


def test_ranking_and_actors(spark):
    d = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "k string, o int")
    assert rows(cap_per(d, ["k"], ["o"], 2)) == [("a", 1), ("a", 2), ("b", 9)]
    s = spark.createDataFrame([("k", "f1"), ("k", "f1"), ("k", "f2"), ("z", "f1")], "key string, file string")
    assert rows(distinct_actor_clusters(s, ["key"], "file")) == [("k", 2, 3)]


def test_first_match_takes_the_first_candidate(spark):
    r = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["q"]), (3, [])], "id int, c array<string>")
    known = spark.createDataFrame([("a",), ("b",)], "path string")
    assert rows(first_match(r, "c", known, "path", ["id"])) == [(1, "b"), (2, None), (3, None)]


def test_reach_with_cycle_and_foreign_seed(spark):
    imp = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("f", None)], "source string, target string")
    seeds = spark.createDataFrame([("a",), ("nowhere",), ("f",)], "node string")
    assert rows(reach(edges_of(imp), seeds, nodes_of(imp))) == [("a",), ("b",), ("c",), ("f",)]


def test_reach_never_stops_short(spark):
    chain, seed = spark.createDataFrame([(i, i + 1) for i in range(5)], "src int, dst int"), spark.createDataFrame([(0,)], "node int")
    assert reach(chain, seed).count() == 6
    with pytest.raises(RuntimeError):
        reach(chain, seed, max_rounds=3)
    assert inspect.signature(reach).parameters["max_rounds"].default is None


def test_re_exports_forward_to_a_fix_point(spark):
    used = spark.createDataFrame([("barrel", "A"), ("ns", "*")], "file string, name string")
    star = spark.createDataFrame([("barrel", "inner"), ("inner", "barrel")], "src string, dst string")
    named = spark.createDataFrame([("inner", "leaf", "A"), ("inner", "leaf", "B"), ("ns", "leaf", "C")], "src string, dst string, name string")
    assert rows(forward_re_exports(used, star, named)) == [("barrel", "A"), ("inner", "A"), ("leaf", "A"), ("leaf", "C"), ("ns", "*")]


def test_roll_up_bubbles_counts(spark):
    f = spark.createDataFrame([("a/b/x", 1), ("a/y", 2), ("a/y", 1), (None, 5)], "path string, n int")
    assert rows(roll_up(f, "path", ["n"]), "path", "kind", "n") == [("", "dir", 4), ("a", "dir", 4), ("a/b", "dir", 1), ("a/b/x", "file", 1), ("a/y", "file", 3)]


def test_latency_stats_are_nearest_rank(spark):
    d = spark.createDataFrame([("d", float(x)) for x in (1, 2, 3, 4)] + [("d", -1.0), ("d", float("nan")), ("d", None)], "k string, ms double")
    r = {x.k: x for x in latency_stats(d, "k", "ms").collect()}
    assert (r["d"].p50_ms, r["d"].p95_ms, r["d"].calls, r[None].calls) == (2.0, 4.0, 4, 4)


def test_fingerprint_is_the_sha256_prefix(spark):
    got = spark.range(1).select(fingerprint("p", F.lit("a"), ":", F.lit(3))).first()[0]
    assert got == "p:" + hashlib.sha256(b"a:3").hexdigest()[:16]


SNAP = "g string, n int, k string, v string, t timestamp"


def changes(spark, data, **more):
    df = spark.createDataFrame(data, SNAP).withColumn("extra", F.lit(1))
    return rows(snapshot_changes(df, "g", "n", "k", [F.col("v")], "t", **more))


def test_snapshot_changes_defined_cases(spark):
    from datetime import datetime

    t1, t2 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    data = [
        ("a", 1, "same", "x", t1), ("a", 2, "same", "x", t2), ("a", 1, "gone", "x", t1), ("a", 2, "new", None, t1),
        ("a", 1, "null", None, t1), ("a", 2, "null", "", t1), ("a", 1, "both", None, t1), ("a", 2, "both", None, t1),
        ("a", 2, "late", "old", t1), ("a", 2, "late", "x", t2), ("a", 1, "late", "x", t1), ("b", 1, "k", "x", t1), (None, 2, None, "x", None),
    ]
    assert changes(spark, data, chunk_rows=2, buckets=2) == [
        ("a", 2, "gone", "removed"), ("a", 2, "new", "added"), ("a", 2, "null", "changed"), ("b", 2, "k", "removed"), (None, 2, None, "added"),
    ]
    assert changes(spark, []) == []


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.text("abcdef", max_size=3), st.integers(0, 2), max_size=40), st.dictionaries(st.text("abcdef", max_size=3), st.integers(0, 2), max_size=40))
def test_snapshot_changes_equal_brute_force(spark, old, new):
    data = [("w", 1, k, str(v), None) for k, v in old.items()] + [("w", 2, k, str(v), None) for k, v in new.items()]
    want = [("w", 2, k, "removed") for k in old if k not in new] + [("w", 2, k, "added") for k in new if k not in old] + [("w", 2, k, "changed") for k in new if k in old and old[k] != new[k]]
    assert changes(spark, data, pairs=[2], chunk_rows=4, buckets=3) == sorted(want, key=str)
