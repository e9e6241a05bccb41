"""Detector registry: a detector is a plan from a corpus to findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.plans.corpus import Corpus

REGISTRY: dict[str, Callable[..., DataFrame]] = {}
#: Detectors that overlap with linters and are off unless asked for (fixed).
DEFAULT_OFF = frozenset("public-any long-function long-file deep-nesting magic-numbers console-log-prod skip-tests silent-catch todo-comments test-without-assertion".split())


def detector(name: str):
    def register(fn):
        REGISTRY[name] = fn
        return fn

    return register


def fingerprint(prefix: str, *parts: Column | str) -> Column:
    """``prefix:`` and 16 hex digits of the SHA-256 of the parts."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256), 1, 16))


def site(file: Column, first: Column, last: Column, snippet: Column | None = None, note: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        file.alias("file"), F.struct(first.cast("int").alias("start_line"), last.cast("int").alias("end_line")).alias("line_range"), (none if snippet is None else snippet).alias("snippet"), (none if note is None else note).alias("note")
    )


def finding(df: DataFrame, detector_id: str, severity: Column | str, confidence: Column | float, title: Column, evidence: Column, fp: Column, layer: Column | int = 1, description: Column | None = None, suggestion: str | None = None, workspace: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        (F.col("workspace") if workspace is None else workspace).cast("string").alias("workspace"),
        F.lit(detector_id).alias("detector_id"),
        lit(severity).alias("severity"),
        lit(confidence).cast("double").alias("confidence"),
        lit(layer).cast("int").alias("layer"),
        title.alias("title"),
        (title if description is None else description).alias("description"),
        evidence.alias("evidence"),
        F.lit(suggestion).cast("string").alias("suggestion"),
        fp.alias("fingerprint"),
        F.lit(None).cast("long").alias("resolved_at"),
        F.lit(None).cast("struct<confidence:double,reason:string>").alias("llm_false_positive"),
    )


def steps(value: Column, low: float, med: float, high: float) -> Column:
    """Severity by thresholds; null below the lowest."""
    return F.when(value >= high, "high").when(value >= med, "medium").when(value >= low, "low")


def run(corpus: Corpus, only: Iterable[str] | None = None, skip: Iterable[str] = ()) -> DataFrame:
    """Findings of the wanted detectors, by default those that are on; the others are never planned."""
    names = [n for n in (only if only is not None else [d for d in REGISTRY if d not in DEFAULT_OFF]) if n not in set(skip)]
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise ValueError(f"no such detector: {', '.join(unknown)}")
    corpus.shared |= len(names) > 1
    out = None
    for n in names:
        f = REGISTRY[n](corpus)
        out = f if out is None else out.unionByName(f)
    if out is None:
        raise ValueError("no detector asked for")
    return out


from sievework.plans.detectors import graphs, symbols, texts  # noqa: E402, F401
