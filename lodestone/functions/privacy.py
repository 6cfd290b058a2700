"""Personal data in text: detectors, placeholders and redaction by regular expressions of the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detectors and placeholders; all are matched whatever the case.
DETECTORS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "coordinates": r"\b-?\d{1,3}\.\d{4,}[,\s]+-?\d{1,3}\.\d{4,}\b",
    "sin_ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "license_plate": r"\b[A-Z]{2,3}[-\s]?[0-9]{2,4}[-\s]?[A-Z]{0,3}\b",
    "project_number": r"\b(?:Project|Proj\.?|File|Job|Contract|Work\s*Order)[\s#:\-]*[A-Z0-9][\w\-]{2,20}\b",
    "file_number": r"\b(?:File|Ref|Reference|Invoice|PO)[\s#:\-]*[A-Z0-9][\w\-]{2,15}\b",
}
PLACEHOLDERS = {"person_name": "[PERSON]", "company_name": "[COMPANY]", "address": "[ADDRESS]", "phone": "[PHONE]", "email": "[EMAIL]", "project_number": "[PROJECT #]", "file_number": "[FILE #]", "date": "[DATE]", "location": "[LOCATION]", "coordinates": "[COORDINATES]", "license_plate": "[PLATE]", "sin_ssn": "[ID #]", "financial": "[FINANCIAL]", "custom": "[REDACTED]"}
TITLED = r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"
# Words that are no part of a name, places that names start with, titles, qualifications and signs of a name.
NO_NAMES = (
    "the and for with from this that will have been were are was has had may can per all any not "
    "tier phase stage section table figure appendix report site area zone level sample test analysis method data results standard specification assessment investigation review preliminary final draft revised updated approved fine coarse medium high low "
    "north south east west monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december province city town county municipal "
    "ltd inc corp llc eng msc bsc phd ing"
).split()
PLACES = ("new", "old", "city", "lake", "river", "mount")
BEHIND_TITLE = r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?|Eng\.?|P\.?Eng\.?|M\.?Sc\.?)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"
TWO_WORDS = r"\b([A-Z][a-z]{1,15})\s+([A-Z][a-z]{1,15})\b"
QUALIFIED = r"\b([A-Z][a-z]+\s+[A-Z][a-z]+),?\s*(?:P\.?Eng\.?|M\.?Sc\.?|Ph\.?D\.?|B\.?Sc\.?|P\.?Geo\.?|CET)\b"
TRIGGERS = ("prepared by", "reviewed by", "authored by", "contact", "attention", "attn", "signed", "approved by", "submitted by", "client:", "owner:", "property owner", "attention of", "care of", "c/o")
MEASURES = (
    r"(?i)^\s*-?\d+\.?\d*\s*(?:m|cm|mm|km|ft|in|kg|g|mg|lb|oz|%|°|deg|psi|kPa|MPa)\s*$", r"^\s*-?\d+\.?\d*\s*$", r"(?i)^\s*-?\d+\.?\d*\s*[-–—to]+\s*-?\d+\.?\d*\s*(?:m|cm|mm|km|ft|in)?\s*$",
)
#: Whatever the case, with letters and digits of all scripts in words.
ANY_CASE = "(?iU)"
SCRUBBED = ("email", "phone", "sin_ssn")


def found(text: Column, kind: str) -> Column:
    """All that a detector finds, in order."""
    return F.regexp_extract_all(text, F.lit(ANY_CASE + DETECTORS[kind]), 0)


def names(text: Column) -> Column:
    """Names behind a title (written with its capitals)."""
    return F.regexp_extract_all(text, F.lit("(?U)" + TITLED), 0)


def redacted(text: Column, kinds=tuple(DETECTORS)) -> Column:
    """Text with placeholders, detectors taken in their order."""
    for kind in kinds:
        text = F.regexp_replace(text, ANY_CASE + DETECTORS[kind], PLACEHOLDERS[kind].replace("$", r"\$"))
    return text


def redacted_terms(text: Column, terms: list[str]) -> Column:
    """Text with a user's own terms replaced, longest first, whatever their case."""
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        text = F.regexp_replace(text, r"(?i)\Q" + term + r"\E", PLACEHOLDERS["custom"])
    return text


def people(text: Column) -> Column:
    """array<struct<name, confidence>>: likely names of people: behind a title, before a qualification, after words such as
    "prepared by", and two capitalised words in a row that aren't common ones or a place."""
    named = lambda found, sure: F.transform(found, lambda x: F.struct(x.alias("name"), F.lit(sure).alias("confidence")))
    pair = F.filter(F.regexp_extract_all(text, F.lit("(?U)" + TWO_WORDS), 0), lambda x: _no_common_word(x))
    after = [F.regexp_extract_all(text, F.lit(ANY_CASE + r"\b\Q" + t + r"\E\s*:?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"), 1) for t in TRIGGERS]
    after = F.filter(F.concat(*after), lambda x: ~F.lower(x).isin(*NO_NAMES))
    return F.concat(named(F.regexp_extract_all(text, F.lit("(?U)" + BEHIND_TITLE), 0), 0.9), named(pair, 0.7), named(F.regexp_extract_all(text, F.lit("(?U)" + QUALIFIED), 0), 0.9), named(after, 0.85))


def _no_common_word(pair: Column) -> Column:
    first, last = (F.lower(F.element_at(F.split(pair, r"\s+"), k)) for k in (1, 2))
    return ~first.isin(*NO_NAMES, *PLACES) & ~last.isin(*NO_NAMES)


def is_measure(text: Column) -> Column:
    """Whether a text is a number, a measure or a range of these, and so no personal data."""
    out = F.lit(False)
    for pattern in MEASURES:
        out = out | text.rlike(pattern)
    return out


def replaced(text: Column, terms: list[str], placeholder: str = PLACEHOLDERS["custom"]) -> Column:
    """struct(text, n): a text with terms replaced one after another, whatever their case, and how many places that were."""
    n = F.lit(0)
    for term in terms:
        pattern = r"(?i)\Q" + term + r"\E"
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, placeholder)
    return F.struct(text.alias("text"), n.alias("n"))
