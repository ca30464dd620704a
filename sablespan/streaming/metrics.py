"""Metrics of detection as annotations and detections arrive, document by document.

Truth and detections of a document may come in any order and in many batches.  What has come is kept by document until
the watermark is `wait` behind the first row's time; then the document is matched, its counts are emitted once, and its state is
dropped.  Rows that come behind the watermark are late: Spark leaves them out and counts them in the
query's progress (numRowsDroppedByWatermark).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SPAN = "kind string, id string, entity_type string, text string, start_char int, end_char int"
OUT = "doc_id {key}, tp bigint, fp bigint, fn bigint"


def _form(text: str) -> str:
    return re.sub(r"[\W_]", "", (text or "").lower())


def counts_of(truth: list[tuple], found: list[tuple]) -> tuple[int, int, int]:
    """tp, fp and fn of one document's spans (id, entity_type, text, start_char, end_char), matched greedily as match_pairs() does."""
    pairs = []
    at = 0
    found = sorted(found, key=lambda r: r[3])
    longest = max((r[4] - r[3] for r in found), default=0)
    for g in sorted(truth, key=lambda r: r[3]):
        while at < len(found) and found[at][3] + longest <= g[3]:
            at += 1
        for d in found[at:]:
            if d[3] >= g[4]:
                break
            inner = min(g[4], d[4]) - max(g[3], d[3])
            if inner > 0:
                ratio = inner * 10_000 // (max(g[4], d[4]) - min(g[3], d[3]))
                same = g[1] == d[1]
                exact = same and ratio >= 9_000 and _form(g[2]) == _form(d[2])
                grade = 0 if exact else 1 if same and 3_000 < ratio <= 5_000 else 2
                pairs.append((grade, -ratio, g[3], d[3], g[0], d[0]))
    gone_g, gone_d, tp = set(), set(), 0
    for grade, *_, g, d in sorted(pairs):
        if g not in gone_g and d not in gone_d:
            gone_g.add(g)
            gone_d.add(d)
            tp += grade == 0
    return tp, len(found) - tp, len(truth) - tp


class DocumentMetrics(StatefulProcessor):
    """A document's spans until its time is up."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", SPAN)
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SPAN.split(", ")]
        for frame in rows:
            self.rows.appendList([tuple(r) for r in frame[names].astype(object).itertuples(index=False)])
            if not self.due.exists():
                due = int(frame["at"].min().timestamp() * 1000) + self.wait_ms
                self.due.update((due,))
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        truth, found = [], []
        for kind, *span in self.rows.get():
            (truth if kind == "truth" else found).append(tuple(span))
        tp, fp, fn = counts_of(truth, found)
        self.rows.clear()
        self.due.clear()
        yield pd.DataFrame({"doc_id": [key[0]], "tp": [tp], "fp": [fp], "fn": [fn]})

    def close(self) -> None:
        pass


def streamed_metrics(spans: DataFrame, wait: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """doc_id, tp, fp and fn of each document of a stream of spans (doc_id, kind of truth or found, id, entity_type, text, start_char, end_char, at).

    The session needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    amount, unit = wait.split()
    wait_ms = int(float(amount) * 1000 * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")])
    schema = OUT.format(key=spans.schema["doc_id"].dataType.simpleString())
    grouped = spans.withWatermark("at", late).groupBy("doc_id")
    return grouped.transformWithStateInPandas(DocumentMetrics(wait_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")
