"""Problem 5: consolidating pairwise matches into groups.

Degree-one vertices are stripped and chains of degree-two vertices are compressed by list
ranking (pointer doubling over arcs) until a round takes little away; the reduced core is solved
by alternating large-star and small-star; labels then travel back to the removed vertices.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.components import connected_components
from sievework.session import Scratch, read

#: A round that takes away less than this share of the edges hands the rest to the core solver.
MIN_SHRINK = 0.25


def member_edges(rows: DataFrame, members: str) -> DataFrame:
    """Edges ``(u, v)``, u < v, that link each row's members as a star on its least member.

    Members are lower-cased, null entries and repetitions are dropped, rows with fewer than two
    different members give nothing. A row of k members gives k - 1 edges, never all pairs.
    """
    m = rows.select(F.array_sort(F.array_distinct(F.transform(F.filter(members, lambda x: x.isNotNull()), F.lower))).alias("m")).filter(F.size("m") > 1)
    return m.select(F.col("m")[0].alias("u"), F.explode(F.slice("m", 2, 2**31 - 1)).alias("v")).distinct()


def _incident(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
    return both.groupBy("u").agg(F.count("*").alias("deg"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _without(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """``e`` less the edges in ``pairs`` (x, y), matched as whole pairs: no vertex is a hot key."""
    p = pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    return e.join(p, ["u", "v"], "left_anti")


def _rank_chains(scratch: Scratch, two: DataFrame, n_two: int) -> DataFrame:
    """``(v, end, other, cyclic)`` for each degree-two vertex: the ends of its chain.

    Each arc (from, at) into a degree-two vertex points to the arc that leaves it. Doubling the
    pointers finds the arc that ends the chain in ceil(log2 n) rounds; arcs that still have not
    ended then lie on a cycle of degree-two vertices, whose least member they have seen.
    """
    arcs = two.select(F.col("lo").alias("x"), F.col("u").alias("y"), F.col("u").alias("nx"), F.col("hi").alias("ny"))
    arcs = arcs.union(two.select(F.col("hi"), F.col("u"), F.col("u"), F.col("lo")))
    arcs = arcs.withColumn("low", F.col("y")).withColumn("done", F.lit(False))
    hop = arcs.select(F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("nx").alias("hnx"), F.col("ny").alias("hny"), F.col("low").alias("hlow"), F.col("done").alias("hdone"))
    for i in range(math.ceil(math.log2(n_two + 1)) + 2):
        # an arc that has ended meets no other and stays as it is
        met = ~F.col("done") & (F.col("nx") == F.col("hx")) & (F.col("ny") == F.col("hy"))
        new = scratch.cut(
            arcs.join(hop, met, "left").select(
                "x", "y", F.coalesce("hnx", "nx").alias("nx"), F.coalesce("hny", "ny").alias("ny"), F.least("low", F.coalesce("hlow", "low")).alias("low"),
                (F.col("done") | F.col("hx").isNull() | F.col("hdone")).alias("done"),
            )
        )
        if i:
            scratch.drop(arcs)
        arcs = new
        hop = arcs.select(F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("nx").alias("hnx"), F.col("ny").alias("hny"), F.col("low").alias("hlow"), F.col("done").alias("hdone"))
        if not arcs.filter("NOT done").head(1):
            break
    ended = F.col("done")
    per = arcs.groupBy("y").agg(
        F.min(F.when(ended, F.col("ny"))).alias("end"), F.max(F.when(ended, F.col("ny"))).alias("other"), F.min("low").alias("low"), F.bool_or(~ended).alias("cyclic")
    )
    return per.select(F.col("y").alias("v"), F.when(F.col("cyclic"), F.col("low")).otherwise(F.col("end")).alias("end"), "other", "cyclic")


def reduce_and_group(edges: DataFrame, min_shrink: float = MIN_SHRINK, max_rounds: int = 40) -> DataFrame:
    """``(node, group)`` of every endpoint of ``edges`` (u < v, distinct); group is the least node.

    Defined cases: an empty table gives no rows; repeated edges and self loops must have been
    removed by the caller (``member_edges`` does); hubs of any degree, long chains and rings are
    handled without gathering a vertex's neighbours.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "groups")
    e = scratch.cut(edges)
    n = e.count()
    removed: list[DataFrame] = []
    for _ in range(max_rounds):
        if not n:
            break
        inc = _incident(e)
        # leaves; of an edge with two leaves the greater one goes
        leaves = inc.filter("deg = 1").join(inc.filter("deg = 1").select(F.col("u").alias("lo"), F.lit(True).alias("both")), "lo", "left")
        leaves = scratch.cut(leaves.filter("both IS NULL OR u > lo").select(F.col("u").alias("node"), F.col("lo").alias("parent")))
        core = scratch.cut(_without(e, leaves.select(F.col("node").alias("x"), F.col("parent").alias("y"))))
        removed.append(leaves)
        scratch.drop(e)
        # chains of the stripped graph
        two = scratch.cut(_incident(core).filter("deg = 2"))
        n_two = two.count()
        if n_two:
            chains = _rank_chains(scratch, two, n_two)
            removed.append(chains.select(F.col("v").alias("node"), F.col("end").alias("parent")))
            gone = two.select(F.col("u").alias("x"), F.col("lo").alias("y")).union(two.select("u", "hi"))
            links = chains.filter("NOT cyclic AND end != other").select(F.least("end", "other").alias("u"), F.greatest("end", "other").alias("v"))
            e = scratch.cut(_without(core, gone.distinct()).union(links).distinct())
            scratch.drop(core)
        else:
            e = core
        scratch.drop(two)
        n, before = e.count(), n
        if before - n < min_shrink * before:
            break
    labels = connected_components(e, "u", "v").select("node", F.col("component").alias("label")) if n else None
    # restore, last removal first: a parent is in the core, in a later removal, or a root itself
    for r in reversed(removed):
        if labels is None:
            known = r.select("node", F.col("parent").alias("label"))
            extra = known.select(F.col("label").alias("node"), "label").distinct().join(r, "node", "left_anti")
            labels = scratch.cut(known.unionByName(extra))
            continue
        got = r.join(labels.withColumnRenamed("node", "parent"), "parent", "left").select("node", F.coalesce("label", "parent").alias("label"), "parent")
        lone = got.filter("parent = label").select(F.col("parent").alias("node"), "label").distinct()
        lone = lone.join(r.select("node"), "node", "left_anti").join(labels.select("node"), "node", "left_anti")
        labels = scratch.cut(labels.unionByName(got.select("node", "label")).unionByName(lone))
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("group")).limit(0)
    least = labels.groupBy("label").agg(F.min("node").alias("group"))
    return labels.join(least, "label").select("node", "group")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = member_edges(read(spark, sf_dir, "clusters"), "symbols")
    return reduce_and_group(edges).select(F.col("node").alias("symbol_id"), F.col("group").alias("group_id"))


def p5_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each group, and how many of them have a row in ``symbols``."""
    known = read(spark, sf_dir, "symbols").select(F.lower("id").alias("symbol_id")).distinct().withColumn("known", F.lit(1))
    g = p5_found(spark, sf_dir).join(known, "symbol_id", "left")
    return g.groupBy("group_id").agg(F.count("*").alias("n_symbols"), F.count("known").alias("n_known"))


_SQL = """
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, list_distinct(list_transform(list_filter(symbols, lambda x: x IS NOT NULL), lambda x: lower(x))) AS s FROM clusters),
x AS (SELECT rid, unnest(s) AS a FROM m WHERE len(s) > 1),
e AS (SELECT DISTINCT p.a AS a, q.a AS b FROM x p JOIN x q ON p.rid = q.rid AND p.a <> q.a),
r(a, l) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.a WHERE r.l < e.b),
g AS (SELECT a AS symbol_id, min(l) AS group_id FROM r GROUP BY a)
"""

QUERIES = {"p5_found": p5_found, "p5_group_sizes": p5_group_sizes}
ORACLE = {
    "p5_found": _SQL + "SELECT symbol_id, group_id FROM g",
    "p5_group_sizes": _SQL + "SELECT group_id, count(*) AS n_symbols, count(k.id) AS n_known FROM g LEFT JOIN (SELECT DISTINCT lower(id) AS id FROM symbols) k ON k.id = g.symbol_id GROUP BY group_id",
}
