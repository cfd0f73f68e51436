"""What an extraction says, brought into the record's own forms: names, votes, statuses, numbers, dates, addresses.

All functions take and give Columns. Unknown words give null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TITLES = r"(?i)^\s*(Cr\.?|Councillor|Mayor|Deputy\s+Mayor|Presiding\s+Member|Mr\.?|Mrs\.?|Ms\.?|Dr\.?)\s+"
HONORIFICS = ("cr", "cr.", "councillor", "mayor", "deputy", "deputy mayor")
NO_NAMES = ("null", "name", "unknown", "none", "n/a")
PARTICLES = ("le", "van", "de", "du", "von", "la", "di", "der", "den")
CHOICES = ("for", "against", "abstain", "absent")
POSITIONS = {
    "object": ("object", "objection", "objecting", "oppose", "opposed", "opposition", "against", "objector"),
    "support": ("support", "supporting", "supporter", "in support", "in favour", "in favor", "favour", "favor"),
    "neutral": ("neutral", "neither", "informational", "information", "comment", "general comment"),
}
STATUSES = {
    "approved": ("approved", "granted", "issued", "accepted", "approval", "approved subject to conditions"),
    "refused": ("refused", "rejected", "not approved", "not supported", "refused by council"),
    "deferred": ("deferred", "deferred pending", "further consideration"),
    "withdrawn": ("withdrawn", "withdrawn by applicant"),
    "pending": ("pending", "under assessment", "not determined", "undetermined"),
    "appealed": ("appealed",),
}
INTERESTS = ("financial", "impartiality", "proximity", "other")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
LOT_AT_END = r"(?i)\s*\(Lot\s+\d+\s+on\s+Deposited\s+Plan\s+\d+\)\s*$"
NUMBER_THEN_LOT = r"(?i)^No\.?\s*(\d+[A-Za-z]?)\s+\(Lot\s+\d+\)\s+(.+)$"
LOT_THEN_NUMBERS = r"(?i)^Lot\s+\d+\s+\((Nos?\.?\s*[^)]+)\)\s+(.+)$"
LOT_ALONE = r"(?i)^Lot\s+\d+\s+(.+)$"


def _none() -> Column:
    return F.lit(None).cast("string")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _form(text: Column, forms: dict[str, tuple[str, ...]]) -> Column:
    """The key whose words hold the text, in lower case and without outer white space."""
    x, out = F.lower(F.trim(text)), _none()
    for key, words in forms.items():
        out = F.when(x.isin(*words), key).otherwise(out)
    return out


def position(text: Column) -> Column:
    return _form(text, POSITIONS)


def status(text: Column) -> Column:
    return _form(text, STATUSES)


def interest_type(text: Column) -> Column:
    """One of four kinds; any other text is ``other``, null stays null."""
    x = F.regexp_replace(F.lower(F.trim(text)), " interest$", "")
    return F.when(text.isNull(), _none()).when(x.isin(*INTERESTS), x).otherwise("other")


def integer(text: Column) -> Column:
    """A whole number with or without thousands commas."""
    return F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("long")


def vote_count(text: Column, listed: Column | None = None) -> Column:
    """The number a count says; of a list of names their number, null for an empty list."""
    said = F.trim(text).try_cast("long")
    return said if listed is None else F.when(listed.isNotNull(), F.when(F.size(listed) > 0, F.size(listed).cast("long"))).otherwise(said)


def tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")


def person(name: Column) -> Column:
    """struct(given, family) of a name with a title: the last word is the family name."""
    words = _words(F.regexp_replace(name, TITLES, ""))
    return F.struct(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("given"), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("family"))


def vote(text: Column) -> Column:
    """struct(given, family, choice) of 'Cr Smith - For'; null for other texts."""
    parts = F.transform(F.split(text, " - "), lambda t: F.trim(t))
    choice = F.lower(F.try_element_at(parts, F.lit(-1)))
    who = person(F.try_element_at(parts, F.lit(-2)))
    blank = lambda c: F.when(c != "", c)
    return F.when((F.size(parts) >= 2) & choice.isin(*CHOICES), F.struct(blank(who["given"]).alias("given"), blank(who["family"]).alias("family"), choice.alias("choice")))


def councillor_name(given: Column, family: Column) -> Column:
    """struct(given, family) without honorifics and placeholders.

    A family name that is an honorific changes places with the given one; a
    given name that is a particle belongs to the family name; a given name that
    repeats the family name goes.
    """
    g, f = F.trim(F.coalesce(given, F.lit(""))), F.trim(F.coalesce(family, F.lit("")))
    swapped = F.regexp_replace(F.lower(f), r"\.+$", "").isin(*HONORIFICS)
    g, f = F.when(swapped, f).otherwise(g), F.when(swapped, g).otherwise(f)
    g = F.regexp_replace(F.array_join(_words(g), " "), r"(?i)^((deputy mayor|cr\.*|councillor\.*|mayor\.*|deputy\.*)( |$))+", "")
    particle = F.lower(g).isin(*PARTICLES) & (f != "")
    g, f = F.when(particle, "").otherwise(g), F.when(particle, F.concat_ws(" ", g, f)).otherwise(f)
    gone = F.lower(g).isin(*NO_NAMES) | ((f != "") & (F.lower(g) == F.lower(f)))
    return F.struct(F.when(gone, "").otherwise(g).alias("given"), f.alias("family"))


def meeting_date(text: Column, window: int = 3000) -> Column:
    """The first day, month and year in the first ``window`` characters; null if there is none or it is no date."""
    names = "|".join([*MONTHS, *(m[:3] for m in MONTHS if m != "may")])
    pattern = rf"(?i)\b(\d{{1,2}})\s+({names})\s+(\d{{4}})\b"
    head = F.substring(text, 1, window)
    day, month, year = (F.regexp_extract(head, pattern, i) for i in (1, 2, 3))
    number = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.substring(F.lower(month), 1, 3))
    return F.when(day != "", F.try_to_date(F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def address(text: Column) -> Column:
    """A street address without lot and plan notes: the first house number named, then the street."""
    x = F.regexp_replace(text, LOT_AT_END, "")
    numbers, street = F.regexp_extract(x, LOT_THEN_NUMBERS, 1), F.regexp_extract(x, LOT_THEN_NUMBERS, 2)
    first = F.regexp_extract(numbers, r"(\d+[A-Za-z]?)", 1)
    return (
        F.when(x.rlike(NUMBER_THEN_LOT), F.concat_ws(" ", F.regexp_extract(x, NUMBER_THEN_LOT, 1), F.regexp_extract(x, NUMBER_THEN_LOT, 2)))
        .when(street != "", F.when(first != "", F.concat_ws(" ", first, street)).otherwise(street))
        .when(x.rlike(LOT_ALONE), F.regexp_extract(x, LOT_ALONE, 1))
        .otherwise(x)
    )


def unaddressable(text: Column) -> Column:
    """Why no geocoder should be asked for the address; null if one may."""
    bare = F.regexp_replace(text, LOT_AT_END, "")
    return F.when(text.rlike(r"(?i)\bintersection\b"), "intersection").when(text.rlike(r"(?i)\broad reserve\b"), "road_reserve").when(~bare.rlike(r"\d"), "no_street_number")


def sites(text: Column) -> Column:
    """The sites of an address, parted by semicolons or ampersands that stand in no brackets."""
    # What stands in brackets keeps its marks: they are hidden before the cut and shown again after it.
    pieces = F.regexp_extract_all(text, F.lit(r"(\([^()]*\)|[^()]+|[()])"), F.lit(1))
    hidden = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("(") & p.endswith(")"), F.replace(F.replace(p, F.lit(";"), F.lit("\x01")), F.lit(" & "), F.lit("\x02"))).otherwise(p)), "")
    shown = F.transform(F.split(hidden, ";| & "), lambda p: F.trim(F.replace(F.replace(p, F.lit("\x01"), F.lit(";")), F.lit("\x02"), F.lit(" & "))))
    return F.filter(shown, lambda p: p != "")


def suburb(text: Column) -> Column:
    """What follows the last comma; null without one."""
    tail = F.trim(F.element_at(F.split(text, ","), -1))
    return F.when(text.contains(",") & (tail != ""), tail)
