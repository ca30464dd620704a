"""Detection as a table function of SQL: SELECT * FROM detect(TABLE(docs), 'PHI', 'GPA').

What it returns depends on its call: doc_id has the type it has in the table, and the types wanted are checked when the query is
analysed, before anything runs.  A null text has no spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from sablespan.operators.extract import RECOGNIZERS
from sablespan.operators.literals import chooser


@dataclass
class Wanted(AnalyzeResult):
    """What analysis has found: the output's columns and the types asked for."""

    types: list[str] = field(default_factory=list)


class Detect:
    """Spans of the recognizers of some types, or of all, in a table of doc_id and text."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, *types: AnalyzeArgument) -> Wanted:
        if not rows.isTable:
            raise ValueError("detect() wants a table first: detect(TABLE(docs), ...)")
        columns = {f.name: f.dataType for f in rows.dataType.fields}
        if not {"doc_id", "text"} <= set(columns):
            raise ValueError(f"detect() wants the columns doc_id and text, not {', '.join(columns)}")
        asked = [t.value for t in types]
        if unknown := [t for t in asked if t not in RECOGNIZERS]:
            raise ValueError(f"detect() doesn't know {', '.join(map(str, unknown))}, only {', '.join(RECOGNIZERS)}")
        schema = StructType().add("doc_id", columns["doc_id"])
        for name, kind in (("entity_type", StringType()), ("pattern", StringType()), ("ordinal", IntegerType()), ("text", StringType()), *((n, IntegerType()) for n in ("start_char", "end_char", "points"))):
            schema = schema.add(name, kind)
        return Wanted(schema=schema, types=asked or list(RECOGNIZERS))

    def __init__(self, wanted: Wanted):
        self.patterns = [(p, re.compile(p.regex, re.ASCII)) for t in wanted.types for p in RECOGNIZERS[t]]
        self.may_match = chooser([p.regex for p, _ in self.patterns])

    def eval(self, row: Row, *types: str) -> Iterator[tuple]:
        text = row["text"] or ""
        for i in self.may_match(text):
            p, expression = self.patterns[i]
            for n, m in enumerate(expression.finditer(text), 1):
                yield row["doc_id"], p.entity_type, p.name, n, m[0], m.start(), m.end(), p.points


def register(spark: SparkSession) -> None:
    """Make detect() known to a session's SQL."""
    spark.udtf.register("detect", udtf(Detect))
