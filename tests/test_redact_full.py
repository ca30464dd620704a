"""redact_full against its SQL where words stand beside letters beyond ASCII, as 23 documents of check_l have them."""

import random

import duckdb

from sablespan.plans import base
from sablespan.plans import wider as _wider  # noqa: F401

TEXTS = ["130 die stü und 208 er st. 12", "wohnt 14 am alten Straße, 7 am st é", "é208 er st, MITé MIT", "Anna Bergé Anna Berg 123-45-6789ü", "ſuite 5, (she/her)é", "none", None]


def test_redact_full_beside_letters_beyond_ascii(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
    con.execute("CREATE TABLE customer AS SELECT 1::BIGINT AS c_custkey")
    for name in ("documents", "customer"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = {r["doc_id"]: (r["redacted"], r["masked_chars"]) for r in base.QUERIES["redact_full"](spark, str(tmp_path)).collect()}
    want = {doc: rest for doc, *rest in con.execute(f"SELECT doc_id, redacted, masked_chars FROM ({base.ORACLE['redact_full']})").fetchall()}
    assert len(got) == len(want) == len(TEXTS) + len(base.TYPES)
    assert {k: list(v) for k, v in got.items()} == want
    assert sum(n > 0 for k, (_, n) in want.items() if k >= 0) >= 3


PIECES = ["130 die st", "208 er st.", "9a West Harbor Ave", "Suite 5", "MIT", "University of Ohio", "Java School", "Anna Berg", "Berg", "Dayton, OH 89501", "+1 (212) 555-0123", "212-555-0123"]
PIECES += ["@some_one", "github.com/user", "123-45-6789", "GPA: 3.50", "3.25/4.0", "taking aspirin", "30% VA", "(she/her)", "Women in tech", "Hispanic", "community", "phone", "und", "der"]
BETWEEN = [" ", " ", " ", ", ", "\n", "", "é", "ü", "ß", "Ñ", "ſ", "\u212a", "İ", "\u00a0", "\u2028", "\x0b", "\r", "😀", "_", "7", "s"]


def test_redact_full_over_generated_texts(spark, tmp_path):
    """Pieces that the patterns look for, next to one another and to letters and white space of all kinds; keys as large as 60 times sf0.1."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) + rng.choice(BETWEEN) for _ in range(rng.randint(1, 12))) for _ in range(2_000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(len(?))) AS doc_id, unnest(?) AS text", [texts, texts])
    con.execute("CREATE TABLE customer AS SELECT 899_700 + range AS c_custkey FROM range(300)")
    for name in ("documents", "customer"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = {tuple(r) for r in base.QUERIES["redact_full"](spark, str(tmp_path)).select("doc_id", "redacted", "masked_chars").collect()}
    want = con.execute(f"SELECT doc_id, redacted, masked_chars FROM ({base.ORACLE['redact_full']})").fetchall()
    assert len(want) == len(texts) + 300 * len(base.TYPES)
    assert got ^ set(want) == set()
    assert sum(n > 0 for doc, _, n in want if doc >= 0) > 1_000
