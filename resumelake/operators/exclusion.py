"""Names that aren't names: words of a technology or city lexicon, places in lists of technologies, parts of addresses.

A lexicon is an array column of lower-case terms, of a size that fits in a plan (a literal), for use inside a row;
identity.lexicon_filter joins with a table of any size instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from resumelake.functions import spans, text

# Headings of lists of technologies; the first seven count around a span, all of them around a candidate.
LIST_HEADS = (
    r"used\s+tech", r"technologies", r"tech\s+stack", r"skills", r"tools", r"eingesetzte\s+technologien", r"technologien", r"verwendete\s+technologien", r"technologien\s+und\s+werkzeuge", r"verwendete\s+technik",
    r"werkzeuge", r"software", r"frameworks?", r"bibliotheken", r"programmiersprachen?", r"kenntnisse", r"fähigkeiten", r"technologies?\s+and\s+tools", r"programming\s+languages?",
)
SPAN_HEADS = 7


def address_marked(x: Column) -> Column:
    """Whether a text has a word for a street or a postal code."""
    return x.rlike(r"(?i)(?:street|straße|strasse|str\.)\b|\b[0-9]{5}\b")


def lexicon(*terms: str) -> Column:
    return F.array(*[F.lit(t.lower()) for t in terms]).cast("array<string>")


def in_lexicon(x: Column, terms: Column) -> Column:
    """Whether the lexicon holds x or a word of it."""
    key = text.casefold(text.trimmed(x))
    return F.array_contains(terms, key) | F.arrays_overlap(terms, F.split(key, r"[\s\-_]+"))


def is_technology(x: Column, terms: Column, context: Column | None = None) -> Column:
    """Whether x is a technology, or a part (two letters or more) of one that the context names; without context: the beginning of one two letters longer."""
    key = text.casefold(text.trimmed(x))
    if context is None:
        part = F.exists(terms, lambda t: t.startswith(key) & (F.length(t) >= F.length(key) + 2))
    else:
        around = text.casefold(context)
        part = F.exists(terms, lambda t: t.contains(key) & (F.length(t) > F.length(key)) & around.contains(t))
    return in_lexicon(x, terms) | ((F.length(key) >= 2) & part)


def around(x: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The text from before characters ahead of start to after characters past end (half-open)."""
    first = F.greatest(start - before, F.lit(0))
    return x.substr(first + 1, end + after - first)


def _heads(n: int) -> str:
    return rf"(?iu)(?:{'|'.join(LIST_HEADS[:n])})[:\s]"


def without_technologies(x: Column, found: Column, technologies: Column, cities: Column) -> Column:
    """Spans of a text, but for persons that are a city or technology or stand within 50 characters of a heading of technologies, and places that are a technology."""

    def goes(s: Column) -> Column:
        value, near = text.norm_space(spans.slice_of(x, s)), around(x, s["start"], s["end"], 50, 50)
        technology = is_technology(value, technologies, near)
        person = in_lexicon(value, cities) | technology | near.rlike(_heads(SPAN_HEADS))
        return F.when(s["entity_type"] == "PERSON", person).when(s["entity_type"] == "LOCATION", technology).otherwise(False)

    return F.filter(found, lambda s: ~goes(s))


def outside(found: Column, others: Column) -> Column:
    """Spans that overlap none of the others (persons outside addresses)."""
    return F.filter(found, lambda s: ~F.exists(others, lambda o: spans.overlaps(s, o)))


def in_technology_list(x: Column, name: Column) -> Column:
    """Whether name, at any place where the text has it as a word, stands 100 characters or less after a heading of technologies, or between two commas or more within 50."""
    pattern = F.concat(F.lit(r"(?iu)\b\Q"), name, F.lit(r"\E\b"))
    pieces, hits = F.split(x, pattern, -1), F.regexp_extract_all(x, pattern, F.lit(0))
    ends = F.aggregate(
        F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda g, m: F.length(g) + F.length(m)), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))
    )
    starts = F.transform(F.slice(ends, F.lit(2), F.size(hits)), lambda e: e - F.length(name))
    listed = lambda a: F.regexp_count(around(x, a, a + F.length(name), 50, 50), F.lit(",")) >= 2
    headed = lambda a: around(x, a, a + F.length(name), 100, 50).rlike(_heads(len(LIST_HEADS)))
    return (F.size(hits) > 0) & F.exists(starts, lambda a: listed(a) | headed(a))


def touching_merged(found: Column) -> Column:
    """Spans of a type that overlap or touch, as one, when they follow each other in the text."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score"))))

    def step(out: Column, s: Column) -> Column:
        last, n = F.try_element_at(out, F.lit(-1)), F.size(out)
        both = F.struct(s["entity_type"], last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.greatest(last["score"], s["score"]).alias("score"))
        joins = (n > 0) & (last["entity_type"] == s["entity_type"]) & (s["start"] <= last["end"])
        return F.when(joins, F.concat(F.slice(out, F.lit(1), n - 1), F.array(both))).otherwise(F.concat(out, F.array(F.struct(s["entity_type"], s["start"], s["end"], s["score"]))))

    return F.aggregate(order, F.array().cast(f"array<{spans.SPAN}>"), step)
