"""Import graphs: edges, reachability and forwarding through re-exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import Scratch


def edges_of(imports: DataFrame) -> DataFrame:
    """Distinct resolved (src, dst) edges."""
    return imports.filter("target IS NOT NULL").select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()


def in_degree(edges: DataFrame, at_least: int = 1, limit: int | None = None) -> DataFrame:
    """``(dst, n)``: how many different sources each target has, from ``at_least`` on; ``limit`` keeps the most, by name among equals."""
    g = edges.groupBy("dst").agg(F.count_distinct("src").alias("n")).filter(F.col("n") >= at_least)
    return g if limit is None else g.orderBy(F.col("n").desc(), "dst").limit(limit)


def nodes_of(imports: DataFrame) -> DataFrame:
    """Every source, resolved or not, and every target."""
    return imports.select(F.explode(F.array("source", "target")).alias("node")).filter("node IS NOT NULL").distinct()


def reach(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """Nodes that the seeds reach, seeds included, by breadth-first frontiers.

    A seed that is no node of the graph is dropped. Each round joins the frontier only; the
    visited set is written to the shared folder, so a lost executor costs no round. It goes on
    until a frontier is empty; a graph deeper than a given ``max_rounds`` is an error.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    e = scratch.cut(edges.select("src", "dst").distinct())
    known = nodes if nodes is not None else e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    front = scratch.cut(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().join(known, "node", "left_semi"))
    seen = [front]
    done = 0
    while front.head(1):
        if done == max_rounds:
            raise RuntimeError(f"reachability did not settle in {max_rounds} rounds")
        done += 1
        visited = seen[0]
        for s in seen[1:]:
            visited = visited.union(s)
        front = scratch.cut(e.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti"))
        seen.append(front)
        if len(seen) > 16:  # keep the union's plan short
            merged = seen[0]
            for s in seen[1:]:
                merged = merged.union(s)
            merged = scratch.cut(merged)
            scratch.drop(*[s for s in seen if s is not front])
            seen = [merged]
    out = seen[0]
    for s in seen[1:]:
        out = out.union(s)
    return out


def forward_re_exports(consumed: DataFrame, star: DataFrame, named: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Fix-point of (file, name) consumption through re-exports, semi-naively.

    ``consumed`` is (file, name), name ``*`` meaning the whole namespace. ``star`` (src, dst) forwards
    everything; ``named`` (src, dst, name) forwards its name if that or the namespace is consumed.
    """
    scratch = Scratch(consumed.sparkSession, "forward")
    delta = scratch.cut(consumed.select("file", "name").distinct())
    total = delta
    star, named = scratch.cut(star.select("src", "dst").distinct()), scratch.cut(named.select("src", "dst", F.col("name").alias("n")).distinct())
    for _ in range(max_rounds):
        a = delta.join(star, delta.file == star.src).select(F.col("dst").alias("file"), "name")
        b = delta.join(named, (delta.file == named.src) & ((F.col("name") == F.col("n")) | (F.col("name") == "*"))).select(F.col("dst").alias("file"), F.col("n").alias("name"))
        delta = scratch.cut(a.union(b).distinct().join(total, ["file", "name"], "left_anti"))
        if not delta.head(1):
            return total
        total = scratch.cut(total.union(delta))
    raise RuntimeError("re-exports did not settle")
