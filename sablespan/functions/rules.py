"""Rule tables of the validators: term lists, patterns and points (hundredths of confidence).

The values are this engine's own.  Patterns use explicit ASCII classes, so that Java's and RE2's
engines read them alike.
"""

from __future__ import annotations

UPPER = "A-ZÀ-ÖØ-Þ"

EDUCATION = {
    "acronyms": ["MIT", "UCLA", "USC", "NYU", "CMU", "ETH", "LSE", "UCSD"],
    "generic": ["training center", "online course", "learning center", "study group"],
    "core": ["university", "college", "institute", "school", "conservatory", "ecole", "polytechnique"],
}
PERSON = {
    "titles": ["dr.", "prof.", "mr.", "mrs.", "ms."],
    "technical": ["javascript", "docker", "kubernetes", "database", "dashboard", "repository"],
    "address": ["street", "avenue", "suite", "zip code", "p.o. box", "apartment"],
}
STATES = ["Alabama", "Alaska", "Arizona", "California", "Colorado", "Florida", "Georgia", "Illinois", "Michigan", "Nevada", "Ohio", "Oregon", "Texas", "Utah", "Virginia"]
LOCATION = {
    "city_state": rf"^[{UPPER}][A-Za-z. ]*, *(?:[A-Z][A-Z]\b|{'|'.join(STATES)})",
    "zip": r"[0-9]{5}",
    "international": rf"^[{UPPER}][A-Za-z ]*(?:[à-öø-ÿ][a-zà-öø-ÿ]*$|, *[A-Z][a-z]+(?: [A-Z][a-z]+)*$)",
    "metro": r"^[A-Z][a-z]+(?: [A-Z][a-z]+)*(?:-[A-Z][a-z]+(?: [A-Z][a-z]+)*)+$",
}
ADDRESS = {
    "street": ["street", "st", "road", "rd", "avenue", "ave", "boulevard", "blvd", "lane", "ln", "drive", "dr", "court", "ct"],
    "unit": ["suite", "apt", "unit", "floor", "room"],
    "direction": ["north", "south", "east", "west", "n", "s", "e", "w"],
}
EMAIL = {
    "known": r"(?:\.edu|gmail\.com|outlook\.com|yahoo\.com)$",
    "basic": r"^[^@ ]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "strict": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}$",
    "context": r"(?i)email|contact|mail|address|@",
}
PHONE = {
    "extension": r"(?i) *(?:ext|x)\.? *[0-9]{1,6}$",
    "formats": [
        r"\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}$",
        r"^(?:\+?1[-. ])?[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}$",
        r"^\+[0-9]{1,3}(?:[ -][0-9]{2,4}){2,4}$",
    ],
    "context": r"(?i)phone|call|tel|mobile|fax",
}
GPA = {"indicator": r"(?i)gpa|grade point|cumulative"}
INTERNET = {
    "url": r"^(?:https?://)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?:[:/?#][^ ]*)?$",
    "social": r"(?i)(?:github|linkedin|twitter|facebook|instagram)\.com",
    "common": r"(?i)\.(?:com|org|net|io|co\.uk)(?:[:/?#]|$)",
    "handle": r"^@[A-Za-z0-9_]{2,}$",
    "platforms": r"(?i)github|linkedin|twitter|facebook|instagram",
}
PROTECTED = {
    "pronouns": r"(?i)pronouns[:;]? *\(?[a-z]+/[a-z]+|^\((?:he|she|they|xe|ze)/[a-z/]+\)$",
    "terms": ["women", "men's", "trans", "lgbtq", "nonbinary", "muslim", "jewish", "christian", "hindu", "sikh", "buddhist", "asian", "hispanic", "latino", "african american"],
    "organizations": r"(?i)member|chair|president|founded|association|network|society|leader|leading|fellowship",
    "phrases": r"(?i)identifies as|descent|heritage|advocacy|community",
    "prefixes": r"(?i)(?:^|[^A-Za-z])(?:iden|desc|heri|advo|comm)[A-Za-z]*",
}
PHI = {
    "always": ["disabled vet", "reasonable accommodation", "medical leave", "ada request", "service connected", "accommodation needed"],
    "conditions": ["diabetes", "adhd", "anxiety disorder", "asthma", "epilepsy", "disabled veteran"],
    "context": r"(?i)(?:^|[:, ])(?:diagnosed|diabetes|medication|prescribed|treatment|disability|chronic)(?:[:, ]|$)",
    "specific": r"(?i)[0-9]{1,3}% +(?:service connected|disabled|p&t)|type [12] diabetes",
    "treatments": ["insulin", "therapy", "dialysis", "chemotherapy"],
    "diagnosis": r"(?i)condition|diagnosis|diagnosed",
}
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DATE = {
    "markers": r"(?i)graduat|class of|expected|enrolled",
    "education": rf"(?i)^(?:class of|expected|graduated)(?: {_MONTH})? +(?:19|20)[0-9]{{2}}",
    "range": r"(?i)^(?:19|20)[0-9]{2} *(?:-|–|to) *(?:present|(?:19|20)[0-9]{2})",
    "year_month": r"^(?:0?[1-9]|1[0-2])/(?:19|20)[0-9]{2}|^(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])",
    "month_year": rf"(?i)^{_MONTH} +(?:19|20)[0-9]{{2}}",
    "year": r"^(?:19|20)[0-9]{2}$",
}
