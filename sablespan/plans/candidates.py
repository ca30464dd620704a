"""Candidate entities for the validators, derived from customers' keys.

A type's templates take turns over the keys; {k} stands for the key.  Each is an entity's text, its
document and the detector it comes from.
"""

from __future__ import annotations

TEMPLATES: dict[str, list[tuple[str, str, str]]] = {
    "EDUCATIONAL_INSTITUTION": [
        ("MIT", "She studied at MIT", "pattern"),
        ("Northfield", "From Northfield", "ner"),
        ("Lakeside Training Center", "A training center", "ner"),
        ("Department {k} of Learning", "In the department", "ner"),
        ("Lakeside College No {k}", "At the college", "ner"),
        ("École Technique {k}", "À l'école", "ner"),
    ],
    "PERSON": [
        ("J", "J", "ner"),
        ("Anna Berg", "Anna Berg, engineer {k}", "ner"),
        ("Carl B. Lind", "Signed by Carl B. Lind", "ner"),
        ("Dr. Erik Holm", "Seen by Dr. Erik Holm", "ner"),
        ("Anna Berg", "Deployed with docker by Anna Berg", "ner"),
        ("Anna Berg", "Suite {k}, street side: Anna Berg", "pattern"),
        ("BERG", "BERG", "ner"),
        ("ANNA BERG", "By ANNA BERG", "ner"),
        ("anna berg", "by anna berg", "ner"),
        ("Berg", "Mr Berg {k}", "pattern"),
    ],
    "LOCATION": [
        ("X", "X", "pattern"),
        ("lakeview", "near lakeview", "pattern"),
        ("Dayton, OH", "Dayton, OH", "pattern"),
        ("Reno, Nevada 89501", "Reno, Nevada 89501", "pattern"),
        ("Oslo, Norway", "Oslo, Norway", "pattern"),
        ("Zürich", "Zürich", "pattern"),
        ("Dallas-Fort Worth", "Dallas-Fort Worth", "pattern"),
        ("Ohio", "Ohio", "pattern"),
        ("BOSTON", "BOSTON", "pattern"),
        ("Dayton", "Dayton", "pattern"),
        ("Lake Erie Shore", "Lake Erie Shore", "pattern"),
    ],
    "ADDRESS": [
        ("9 St", "9 St", "pattern"),
        ("Harbor Street", "Harbor Street", "pattern"),
        ("{k} Harbor Place", "{k} Harbor Place", "pattern"),
        ("{k}0 Harbor Street", "{k}0 Harbor Street", "pattern"),
        ("{k}1 Harbor Rd, Apt {k}", "{k}1 Harbor Rd", "pattern"),
        ("{k}2 West Harbor Ave", "{k}2 West Harbor Ave", "pattern"),
        ("{k}3 N Harbor Blvd, Suite 5", "{k}3 N Harbor Blvd", "pattern"),
    ],
    "EMAIL_ADDRESS": [
        ("a@b", "a@b", "pattern"),
        ("user{k}.example.com", "user", "pattern"),
        (".@example.com", "write", "pattern"),
        ("user{k}.@example.com", "write", "pattern"),
        ("us..er{k}@example.com", "write", "pattern"),
        ("user{k}@example", "write", "pattern"),
        ("user{k}@example.com", "", "pattern"),
        ("user{k}@college.edu", "write to my address", "pattern"),
        ("+user{k}@example.org", "mail", "pattern"),
    ],
    "PHONE_NUMBER": [
        ("555-{k}", "call", "pattern"),
        ("+1234567890123456{k}", "call", "pattern"),
        ("(212) 555-0123", "number", "pattern"),
        ("212-555-0123 ext 7", "phone", "pattern"),
        ("+44 20 7946 0123", "", "pattern"),
        ("212-555-01234", "", "pattern"),
        ("2125550123", "call me", "pattern"),
        ("Phone: (212) 555-0123 x9", "office", "pattern"),
    ],
    "GPA": [
        ("GPA", "GPA", "pattern"),
        ("GPA: 4.7", "GPA", "pattern"),
        ("GPA: 3.1/5.0", "GPA", "pattern"),
        ("3.25/4.0", "result", "pattern"),
        ("3.25", "result", "pattern"),
        ("3.25", "cumulative result", "pattern"),
        ("GPA: 3.125", "GPA", "pattern"),
        ("GPA: 1.5", "GPA", "pattern"),
        ("GPA: 3.50", "GPA", "pattern"),
        ("GPA: -1.0", "GPA", "pattern"),
    ],
    "INTERNET_REFERENCE": [
        ("a.b", "a", "pattern"),
        ("github.com/user{k}", "code", "pattern"),
        ("https://www.example.com/{k}", "see", "pattern"),
        ("http://files.example.dev/{k}", "see", "pattern"),
        ("@user{k}", "on twitter", "pattern"),
        ("@user{k}", "hello", "pattern"),
        ("not a link {k}", "text", "pattern"),
    ],
    "PROTECTED_CLASS": [
        ("Pronouns: she/her", "bio", "ner"),
        ("(they/them)", "bio", "ner"),
        ("Hindu Students", "President of Hindu Students", "ner"),
        ("Latino", "Of Latino heritage", "ner"),
        ("transgender", "identity: transgender", "ner"),
        ("Hispanic", "food market {k}", "ner"),
        ("chess club", "member", "ner"),
    ],
    "PHI": [
        ("Disabled Vet", "status", "ner"),
        ("asthma", "has asthma", "ner"),
        ("inhaler", "prescribed inhaler", "ner"),
        ("rating", "{k}% disabled", "ner"),
        ("insulin", "after the diagnosis: insulin", "ner"),
        ("health", "health food {k}", "ner"),
    ],
    "DATE_TIME": [
        ("Class of 2021", "Class of 2021", "ner"),
        ("2019 - Present", "worked 2019 - Present", "ner"),
        ("07/2022", "since 07/2022", "ner"),
        ("March 2020", "in March 2020", "ner"),
        ("2018", "enrolled 2018", "ner"),
        ("Room 2018", "in Room 2018", "ner"),
        ("spring", "graduated in spring", "ner"),
    ],
    "OTHER_ID": [("ID-{k}", "card ID-{k}", "pattern"), ("", "nothing", "pattern")],
}


def candidates_sql(types: list[str], source: str = "customer", duck: bool = True) -> str:
    """cand_id, entity_type, t, d, source and start_char from a table of c_custkey: a row a key and type, in one scan."""
    quoted = lambda s: "'" + s.replace("'", "’") + "'"
    numbers = ", ".join(map(str, range(len(types))))
    each = f"unnest([{numbers}])" if duck else f"explode(array({numbers}))"

    def by_type(at: int) -> str:
        kinds = []
        for number, name in enumerate(types):
            rows = TEMPLATES[name]
            turns = " ".join(f"WHEN {i} THEN {quoted(r[at])}" for i, r in enumerate(rows))
            kinds.append(f"WHEN {number} THEN CASE c_custkey % {len(rows)} {turns} END")
        return f"replace(CASE kind {' '.join(kinds)} END, '{{k}}', CAST(c_custkey AS STRING))"

    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(types))
    rows = (
        f"SELECT c_custkey * 100 + kind AS cand_id, CASE kind {names} END AS entity_type, {by_type(0)} AS t, {by_type(1)} AS d, {by_type(2)} AS source "
        f"FROM (SELECT c_custkey, {each} AS kind FROM {source}) keys"
    )
    return f"SELECT *, greatest(instr(d, t) - 1, 0) AS start_char FROM ({rows}) placed"
