"""Scored links against brute force, and what the similar functions write."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sievework.operators import similarity
from sievework.operators.similarity import scored_links
from sievework.plans.corpus import Corpus
from sievework.plans.detectors import REGISTRY
from sievework.schemas import SYMBOLS
from tests.test_kernels import labels


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def functions(seed, n=160):
    """(id, words, items): copies, near copies, bodies of common items alone, empty names and bodies."""
    rnd = random.Random(seed)
    token = lambda x: hash((1, seed, x))
    out = []
    for i in range(n):
        words = {hash((2, rnd.randrange(9))) for _ in range(rnd.choice((0, 1, 2, 3, 3, 4)))}
        items = {token(rnd.randrange(30)) for _ in range(rnd.choice((0, 5, 20, 30)))} | {token(1000 + rnd.randrange(4000)) for _ in range(rnd.choice((0, 0, 3, 10)))}
        if i % 3 == 2:
            _, w, s = out[rnd.randrange(i)]
            words, items = set(w) if rnd.random() < 0.5 else words, set(s) ^ {token(9000 + i + k) for k in range(rnd.choice((0, 1, 4)))}
        out.append((f"f{i:03}", sorted(words), sorted(items)))
    return out


def groups(edges):
    """Members of each group and its best score."""
    of = dict(labels([(a, b) for a, b, _ in edges]))
    best: dict = {}
    for a, _, s in edges:
        best[of[a]] = max(best.get(of[a], 0), s)
    return {(frozenset(x for x in of if of[x] == c), s) for c, s in best.items()}


def brute(rows, threshold, weight):
    found = []
    for i, (a, wa, sa) in enumerate(rows):
        for b, wb, sb in rows[i + 1 :]:
            score = weight * jaccard(set(wa), set(wb)) + (1 - weight) * jaccard(set(sa), set(sb))
            if score >= threshold:
                found.append((a, b, score))
    return found


@pytest.mark.parametrize(("threshold", "weight", "block"), [(0.5, 0.4, 16384), (0.5, 0.4, 7), (0.75, 0.4, 16384), (0.7, 0.1, 20), (0.6, 1, 16384)])
def test_scored_links_group_as_all_pairs_do(spark, monkeypatch, threshold, weight, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rows = functions(block)
    got = [tuple(r) for r in scored_links(spark.createDataFrame(rows, "id string, words array<long>, items array<long>").repartition(3), threshold, weight).collect()]
    want = brute(rows, threshold, weight)
    assert len(want) > 9 and {(a, b): s for a, b, s in got}.items() <= {(a, b): s for a, b, s in want}.items()
    assert groups(got) == groups(want)


def test_a_group_holds_few_pairs_and_links_the_same(monkeypatch):
    monkeypatch.setattr(similarity, "HELD", 3)
    rows = [(i, sorted({1, *w}), s) for i, w, s in functions(3, 300)]
    table = pa.table({"id": [r[0] for r in rows], "words": [r[1] for r in rows], "items": pa.array([r[2] for r in rows], pa.list_(pa.int64())), "k": np.full(300, 1), **{c: np.zeros(300, int) for c in ("block", "x", "y")}})
    # only pairs whose least common word is this one belong to the group
    words = {r[0]: set(r[1]) for r in rows}
    want = [(a, b, s) for a, b, s in brute(rows, 0.5, 0.4) if min(words[a] & words[b]) == 1]
    got = list(zip(*similarity._Pairs(0.5, 0.4)(table).to_pydict().values(), strict=True))
    assert len(got) < 300 < len(want) and groups(got) == groups(want)


def test_similar_functions_write_no_pairs(spark):
    """A common word and common idioms make every pair a candidate; that many must not be written."""
    rnd = random.Random(8)
    fn = lambda sh: ([], "void", False, False, "", "", sh)
    rows = []
    for i in range(700):
        sh = [f"common {rnd.randrange(60)} ( _" for _ in range(60)] + [f"own {i} {k}" for k in range(40)]
        rows.append((f"id{i:04}", "function", f"rank{chr(65 + i // 26)}{'x' * (i % 26 + 1)}", f"src/{i}.ts", "w", (1, 9), "", True, False, None, None, fn(sh), None, None, None))
    rows.append(("id9999", "function", "rankAx", "src/copy.ts", "w", (1, 9), "", True, False, None, None, rows[0][11], None, None, None))
    symbols = spark.createDataFrame(rows, SYMBOLS)
    corpus = Corpus(spark.createDataFrame([], "workspace string, path string, text string"), given_symbols=symbols)

    def written():
        every = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(every.apply(k).totalShuffleWrite() for k in range(every.size()))

    before = written()
    found = REGISTRY["similar-functions"](corpus, limit=None).collect()
    assert {"src/0.ts", "src/copy.ts"} <= {e.file for f in found for e in f.evidence}
    # the functions themselves take about 0.7 MB as hashes
    assert written() - before < 6 << 20
