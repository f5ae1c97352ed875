"""Entity spans (type, start, end, score; half-open, in characters), found and rewritten inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from resumelake.functions.text import bound

SPAN = "struct<entity_type:string,start:int,end:int,score:double>"
# Patterns of entities, and which of two overlapping types is kept.
PATTERNS = {
    "EMAIL_ADDRESS": (r"\b[a-zA-Z0-9](?:[a-zA-Z0-9_.+-]*[a-zA-Z0-9])?@[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.[a-zA-Z0-9](?:[a-zA-Z0-9-.]*[a-zA-Z0-9])?\b", 0.95),
    "PHONE_NUMBER": (r"\b(?:\+?[0-9]{1,4}[\s().-]?)?(?:\(?[0-9]{2,5}\)?[\s().-]?)?[0-9]{2,4}[\s().-]?[0-9]{2,4}[\s().-]?[0-9]{2,6}\b", 0.85),
    "ADDRESS": (r"\b[0-9]{5}\s+[A-ZÄÖÜ][\wÄÖÜäöüß\- ]{2,}\b", 0.5),
    "LINKEDIN_PROFILE": (r"\b(?:https?://)?(?:[a-z]{2,3}\.)?linkedin\.com/(?:in|pub)/[A-Za-z0-9\-_%/]+/?\b", 0.95),
    "URL": (r"\bhttps?://[^\s<>()\[\]\"']{6,}\b", 0.85),
}
PRIORITY = {"ADDRESS": 100, "LINKEDIN_PROFILE": 95, "EMAIL_ADDRESS": 90, "PHONE_NUMBER": 80, "URL": 75, "PERSON": 70, "LOCATION": 10}
DATES = (r"\b[0-9]{1,2}[/.]\s*(?:19|20)[0-9]{2}\b", r"\b(?:19|20)[0-9]{2}[/.]\s*[0-9]{1,2}\b", r"\b(?:19|20)[0-9]{2}\s*[-–]\s*(?:19|20)[0-9]{2}\b", r"\b(?:19|20)[0-9]{2}\b")


# Further forms of the same entities, with their scores. As in all of these, case doesn't count.
OBFUSCATED = r"(?iu)\b[a-z0-9](?:[a-z0-9_.+-]*[a-z0-9])?\s*(?:\(|\[)?\s*\b(?:at|@)\b\s*(?:\)|\])?\s+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\s*(?:\(|\[)?\s*\b(?:dot|punkt|\.)\b\s*(?:\)|\])?\s+[a-z0-9](?:[a-z0-9-.]*[a-z0-9])?\b"
STREET = "(?:straße|strasse|str\\.|weg|allee|gasse|platz|ring|damm|ufer)"
FULL_ADDRESS = rf"(?iU)\b[A-ZÄÖÜ][\wÄÖÜäöüß\.\- ]{{2,}}?{STREET}\s+[0-9]{{1,4}}[a-zA-Z]?\s*,?\s*[0-9]{{5}}\s+[A-ZÄÖÜ][\wÄÖÜäöüß\.\- ]{{1,}}\b"
BARE_URL = r"\b(?:www\.)?[a-zA-Z0-9-]+\.[a-zA-Z]{2,}(?:/[^\s<>()\[\]\"']*)?\b"
HANDLE = r"(?i)linkedin\.com/(?:in|pub)/([^/?#\s]+)"
#: Type, pattern, score, and what any match holds (a cheap test that spares most texts the pattern; null: none).
RECOGNIZERS = (
    ("EMAIL_ADDRESS", *PATTERNS["EMAIL_ADDRESS"], "@"),
    ("EMAIL_ADDRESS", OBFUSCATED, 0.75, r"(?i)\b(?:dot|punkt)\b"),
    ("PHONE_NUMBER", *PATTERNS["PHONE_NUMBER"], "[0-9]"),
    ("ADDRESS", FULL_ADDRESS, 0.85, "[0-9]{5}"),
    ("ADDRESS", *PATTERNS["ADDRESS"], "[0-9]{5}"),
    ("LINKEDIN_PROFILE", *PATTERNS["LINKEDIN_PROFILE"], r"linkedin\.com/"),
    ("URL", *PATTERNS["URL"], "http"),
    ("URL", BARE_URL, 0.70, r"[a-zA-Z0-9-]\.[a-zA-Z]{2}"),
)
#: A sign of no script that marks where matches begin and end; a text that has it itself is cut without it.
_MARK = "\ufdd0"
_BLOCK = 256


def _cut(text: Column, pattern: str) -> Column:
    """text in pieces: at even places (from 0) what is between matches, at odd places a match. One scan."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m)))
    return F.when(text.contains(_MARK), F.flatten(pairs)).otherwise(F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK))


def _sums(n: Column) -> Column:
    """What comes before each of some numbers, added up, block by block: no array grows with all of them."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(n) - 1, F.lit(0)), F.lit(_BLOCK)), lambda i: F.slice(n, i + 1, F.lit(_BLOCK)))
    before = lambda xs, first: F.slice(F.aggregate(xs, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 1, F.size(xs))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    return bound(blocks, lambda bs: F.flatten(F.zip_with(bs, before(F.transform(bs, total), F.lit(0)), before)))


def found(text: Column, pattern: str, entity: str, score: float, needed: str | None = None) -> Column:
    """All matches of pattern (which must not match the empty text) in text; needed: what every match holds."""
    none = F.array().cast(f"array<{SPAN}>")

    def spans_of(pieces: Column) -> Column:
        def of(size: Column) -> Column:
            ends = lambda s, n: F.struct(F.lit(entity).alias("entity_type"), s.alias("start"), (s + n).alias("end"), F.lit(score).alias("score"))
            return F.filter(F.zip_with(_sums(size), F.transform(size, lambda n, i: F.when(i % 2 == 1, n)), lambda s, n: F.when(n.isNotNull(), ends(s, n))), lambda x: x.isNotNull())

        return F.when(F.size(pieces) > 1, bound(F.transform(pieces, lambda p: F.length(p)), of)).otherwise(none)

    got = bound(_cut(text, pattern), spans_of)
    return got if needed is None else F.when(text.rlike(needed), got).otherwise(F.when(text.isNotNull(), none))


def detected(text: Column, recognizers=RECOGNIZERS) -> Column:
    """All matches of the recognizers (type, pattern, score, needed) in text."""
    return F.concat(*[found(text, p, k, s, n) for k, p, s, n in recognizers])


def slice_of(text: Column, span: Column) -> Column:
    return text.substr(span["start"] + 1, span["end"] - span["start"])


def without_dates(text: Column, spans: Column) -> Column:
    """Spans, but for phone numbers that hold a date or a year."""
    dated = lambda s: slice_of(text, s).rlike("|".join(DATES))
    return F.filter(spans, lambda s: ~((s["entity_type"] == "PHONE_NUMBER") & dated(s)))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def collapsed(text: Column, spans: Column, longest: int = 160) -> Column:
    """Disjoint spans: of spans that overlap or touch, the better by type, then score, then length; spans over longest or with a line end go."""
    rank = F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv])
    kept = F.filter(spans, lambda s: (s["end"] - s["start"] <= longest) & ~slice_of(text, s).contains("\n"))
    order = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-s["score"]).alias("c"), s["entity_type"].alias("d"), s.alias("s"))))
    worth = lambda s: F.struct(F.coalesce(F.try_element_at(rank, s["entity_type"]), F.lit(0)).alias("p"), s["score"].alias("s"), (s["end"] - s["start"]).alias("n"))

    def step(out: Column, x: Column) -> Column:
        s, n = x["s"], F.size(out)
        last = F.try_element_at(out, F.lit(-1))
        return F.when((n > 0) & (s["start"] <= last["end"]), F.when(worth(s) > worth(last), F.concat(F.slice(out, F.lit(1), n - 1), F.array(s))).otherwise(out)).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(order, F.array().cast(f"array<{SPAN}>"), step)


def numbered(text: Column, spans: Column) -> Column:
    """struct<text, mapping: array<struct<key, value>>>: spans (disjoint) replaced by <TYPEn>, numbered by type from the end of the text."""

    def put(order: Column) -> Column:
        after = lambda s, i: F.size(F.filter(F.slice(order, i + 1, F.size(order)), lambda t: t["entity_type"] == s["entity_type"]))
        token = lambda s, i: F.concat(F.lit("<"), s["entity_type"], after(s, i).cast("string"), F.lit(">"))
        end = lambda i: F.when(i == 0, 0).otherwise(F.element_at(order, F.greatest(i, F.lit(1)))["end"])
        value = lambda s: F.trim(F.regexp_replace(slice_of(text, s), r"(?U)\s+", " "))
        cut = F.transform(order, lambda s, i: F.struct(text.substr(end(i) + 1, s["start"] - end(i)).alias("gap"), token(s, i).alias("key"), value(s).alias("value")))

        def joined(xs: Column) -> Column:
            last = F.coalesce(F.try_element_at(order, F.lit(-1))["end"], F.lit(0))
            out = F.concat(F.array_join(F.transform(xs, lambda x: F.concat(x["gap"], x["key"])), ""), text.substr(last + 1, F.length(text)))
            return F.struct(out.alias("text"), F.transform(F.reverse(xs), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("mapping"))

        return bound(cut, joined)

    by_start = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("at"), s.alias("s")))), lambda x: x["s"])
    return bound(by_start, put)


def tidied(text: Column) -> Column:
    """After replacement: repeated tokens to the first, spaces before and after punctuation, blank lines."""
    x = F.regexp_replace(text, r"(<[A-Z_]+[0-9]+>)(?:\s+<[A-Z_]+[0-9]+>)+\s*", "$1 ")
    for pattern, put in ((r"[ \t]+\n", "\n"), (r"\s+([,.;:!?])", "$1"), (r"([,.;:!?])([A-Za-z0-9<])", "$1 $2"), (r"\(\s+(<[^>]+>)\s+\)", "($1)"), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, put)
    return F.concat(F.trim(x), F.lit("\n"))
