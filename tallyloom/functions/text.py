"""Text functions as Columns: names, firms, references, redaction, quotes, census."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Company endings in the order in which they go, nouns of recipients without a name, phrases of a deferred answer, labels and titles of private names.
FIRM_ENDINGS = (" pty ltd", " pty. ltd.", " pty ltd.", " ltd", " pty", " p/l")
PLACEHOLDER = r"^(respondent|tenderer|contractor|supplier|bidder|proponent|applicant|submitter|company|party|entity)\b[\s\-#:.]*\d*$"
ON_NOTICE = r"(?i)taken on notice|on notice|no response|not answered|deferred|will be provided|to be provided|provided later|will respond|responded to in writing|respond(?:ed)?\s+in\s+writing|provide[d]?.{0,20}writing|answer(?:ed)?.{0,20}writing"
NIL_HEADING = r"(?i)^confidential reports?(\s+section)?\s*-\s*nil\b"
LEFT_ROOM = r"(?i)\bleft the (meeting|room)\b"
FIELD_LABELS = ("BA/DA REFERENCE", "APPLICATION", "REFERENCE", "LANDOWNER", "OWNER", "APPLICANT", "ZONING", "USE CLASS", "LAND AREA")
PRIVATE_LABELS = ("OWNER", "LANDOWNER", "APPLICANT")
PERSONAL_TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr")
WITHHELD = "[private individual — name withheld]"


def firm_key(name: Column) -> Column:
    """Lower case, company endings gone, no full stops, commas or white space. Endings go with the space before them, so none is cut out of a word's beginning."""
    x = F.lower(F.trim(name))
    for ending in FIRM_ENDINGS:
        x = F.replace(x, F.lit(ending), F.lit(""))
    return F.regexp_replace(x, r"[.,\s]", "")


def reference_key(ref: Column) -> Column:
    return F.regexp_replace(F.lower(ref), r"[^\p{L}\p{N}]", "")


def is_placeholder(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).rlike(PLACEHOLDER), F.lit(False))


def spaces_collapsed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def letters_only(s: Column) -> Column:
    return F.regexp_replace(s, "[^a-zA-Z0-9]", "")


def slug(given: Column, family: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", given, family)), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def street_name(address: Column) -> Column:
    """What follows the house number, up to the last comma."""
    return F.regexp_extract(address, r"^\s*(?:\d+[A-Za-z]?(?:[-/]\d+[A-Za-z]?)?\s+)?(.*?)\s*(?:,[^,]*)?$", 1)


def suburb(address: Column) -> Column:
    return F.trim(F.element_at(F.split(address, ","), -1))


def _private() -> tuple[str, str]:
    """A private label with what follows it, up to the next label or the line's end; and a title with one to four names."""
    fields = "|".join(FIELD_LABELS)
    label = rf"(?i)\b(?:{'|'.join(PRIVATE_LABELS)})S?:\s*.*?(?=\n|\z|\s+(?:{fields})S?:)"
    return label, rf"\b(?:{'|'.join(PERSONAL_TITLES)})\.?\s+[A-Z][\w'-]*(?:\s+[A-Z][\w'-]*){{0,3}}"


def redacted(text: Column) -> Column:
    """Private fields, with their labels, and names after a personal title are replaced."""
    for pattern in _private():
        text = F.regexp_replace(text, pattern, WITHHELD)
    return text


def has_private_name(text: Column) -> Column:
    label, title = _private()
    return F.coalesce(text.rlike(label) | text.rlike(title), F.lit(False))


def size_bucket(chars: Column) -> Column:
    return F.when(chars < 10_000, "tiny").when(chars < 50_000, "small").when(chars < 200_000, "medium").otherwise("large")


def amount(text: Column) -> Column:
    return F.regexp_replace(text, r"[$,\s]", "").try_cast("double")


def outcome(text: Column) -> Column:
    """One of five outcomes by prefix, else null."""
    x = F.lower(F.trim(text))
    out = F.lit(None).cast("string")
    for word in ("carried", "lost", "withdrawn", "deferred", "lapsed"):
        out = F.when(x.startswith(word), word).otherwise(out)
    return out


def meeting_window(text: Column, head: int = 20_000, tail: int = 10_000) -> Column:
    """The whole text, or its first and last part where it is longer than both."""
    return F.when(F.char_length(text) > head + tail, F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(tail)))).otherwise(text)
