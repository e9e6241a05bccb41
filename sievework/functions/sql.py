"""The scanners as table functions that SQL can call.

    register(spark)
    spark.sql("SELECT s.path, f.line, f.key FROM sources s, LATERAL scan_facts('todo', s.path, s.text) f")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

import sievework.functions.config_rules  # noqa: F401  registers its scanners
import sievework.functions.flow  # noqa: F401  registers its scanners
from sievework.functions.lex import Source
from sievework.functions.scan import SCANNERS
from sievework.session import ship


class ScanFacts:
    """Facts of one kind in a text; a null path or text gives none, an unknown kind is an error."""

    def eval(self, kind: str, path: str, text: str) -> Iterator[tuple]:
        scanner = SCANNERS[kind]
        if path is not None and text:
            for _, line, end_line, key, attrs, items, snippet in scanner(path, Source(text)):
                yield line, end_line, key, attrs, items, snippet


def register(spark: SparkSession) -> None:
    """Makes ``scan_facts(kind, path, text)`` known to the session."""
    ship(spark)
    spark.udtf.register("scan_facts", udtf(ScanFacts, returnType="line int, end_line int, key string, attrs map<string,string>, items array<string>, snippet string"))
