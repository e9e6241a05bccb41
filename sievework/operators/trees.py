"""Directory roll-ups over path prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixes(path: Column) -> Column:
    """All ancestors of a path and the path itself; the root is the empty string."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def roll_up(files: DataFrame, path: str, counts: Sequence[str]) -> DataFrame:
    """``(path, parent, name, depth, kind, *sums)`` of every file and directory; counts bubble up.

    Rows of one path are added together first; null paths are left out; directories come before files
    of the same depth when sorted by (depth, kind, name).
    """
    own = files.filter(F.col(path).isNotNull()).groupBy(F.col(path).alias("p")).agg(*[F.sum(c).alias(c) for c in counts])
    spread = own.select(F.explode(prefixes(F.col("p"))).alias("path"), "p", *counts)
    kind = F.when(F.max(F.col("path") == F.col("p")), "file").otherwise("dir")
    t = spread.groupBy("path").agg(kind.alias("kind"), *[F.sum(c).alias(c) for c in counts])
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path") != "", F.lit(""))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    return t.select("path", parent.alias("parent"), name.alias("name"), depth.alias("depth"), "kind", *counts)
