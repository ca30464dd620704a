"""redaction_rate against its SQL over texts without characters, names of very many parts, and no documents at all."""

import math

import duckdb
import pytest

from sablespan.plans import base
from sablespan.plans import queries as _registered  # noqa: F401


@pytest.mark.parametrize("texts", [["", "a@b.org x", None], ["", ""], [], ["x@a" + ".b" * 20_000, "y"]], ids=["some empty", "all empty", "none", "many parts"])
def test_odd_texts(spark, tmp_path, texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    for row in enumerate(texts):
        con.execute("INSERT INTO documents VALUES (?, ?)", row)
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    rows = lambda found: sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in found), key=str)
    got = rows(base.QUERIES["redaction_rate"](spark, str(tmp_path)).select("doc_id", "chars", "masked", "rate").collect())
    assert got == rows(con.execute(f"SELECT doc_id, chars, masked, rate FROM ({base.ORACLE['redaction_rate']})").fetchall())
    assert len(got) == len(texts) + 1
