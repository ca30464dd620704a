"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_STR, _INT, _LONG, _DOUBLE, _BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

ENTITY = _fields(
    doc_id=_LONG,
    span_id=_LONG,
    text=_STR,
    entity_type=_STR,
    start_char=_INT,
    end_char=_INT,
    confidence=_DOUBLE,
    page=_INT,
    sensitivity=_STR,
    detector_source=_STR,
    validation_rules=T.ArrayType(_STR),
    original_confidence=_DOUBLE,
)

LOCATION = _fields(page=_INT, x0=_DOUBLE, y0=_DOUBLE, x1=_DOUBLE, y1=_DOUBLE, start_char=_INT, end_char=_INT)

#: An annotation file: a document's entities as people marked them.
ANNOTATION_FILE = T.StructType(
    [
        T.StructField("document", T.StructType([T.StructField("file_name", _STR)])),
        T.StructField(
            "entities",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("text", _STR),
                        T.StructField("type", _STR),
                        T.StructField("should_redact", _BOOL),
                        T.StructField("location", LOCATION),
                        T.StructField("sensitivity", _STR),
                        T.StructField("instance", _INT),
                        T.StructField("needs_review", _BOOL),
                        T.StructField("review_reason", _STR),
                    ]
                )
            ),
        ),
    ]
)

WORD = _fields(doc_id=_LONG, page=_INT, word_no=_INT, x0=_DOUBLE, y0=_DOUBLE, x1=_DOUBLE, y1=_DOUBLE, text=_STR)

RUN_METRIC = _fields(run_id=_STR, test_id=_STR, scope=_STR, key=_STR, metric=_STR, value=_DOUBLE)

#: Sensitivity levels that a loader accepts.
SENSITIVITY = ("high", "medium", "low")
