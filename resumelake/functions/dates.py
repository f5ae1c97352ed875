"""Month arithmetic: a month is the number 12 * year + month, an instant is always given (asof), never taken from the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from resumelake.functions.text import bound

# Month names in English and German, with short forms.
MONTHS = {
    "january": 1, "jan": 1, "januar": 1, "february": 2, "feb": 2, "februar": 2, "march": 3, "mar": 3, "maerz": 3, "märz": 3, "mrz": 3, "april": 4, "apr": 4, "may": 5, "mai": 5,
    "june": 6, "jun": 6, "juni": 6, "july": 7, "jul": 7, "juli": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "oktober": 10, "okt": 10,
    "november": 11, "nov": 11, "december": 12, "dec": 12, "dezember": 12, "dez": 12,
}
# Years, dashes and words between two dates, words for now.
YEAR = "(?:19|20)[0-9]{2}"
MONTH = "(?:0?[1-9]|1[0-2])"
GLUE = r"\s*(?:–|—|-|to|bis|until)\s*"
GLUE_IN_LINE = r"\s*(?:–|—|−|-|bis|to|until)\s*"
SINCE = r"^(?i:since|seit|ab)\s+"
PRESENT = r"(?i)\b(?:heute|aktuell|present|current)\b"


def month_number(ym: Column) -> Column:
    """12 * year + month of a YYYY-MM (or YYYY-M) string; null for anything else."""
    ok = ym.rlike(r"^[0-9]{4}-(0?[1-9]|1[0-2])$")
    return F.when(ok, F.split_part(ym, F.lit("-"), F.lit(1)).try_cast("int") * 12 + F.split_part(ym, F.lit("-"), F.lit(2)).try_cast("int"))


def month_text(n: Column) -> Column:
    return F.concat(F.lpad(F.floor((n - 1) / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad(((n - 1) % 12 + 1).cast("string"), 2, "0"))


def month_before(ym: Column) -> Column:
    return month_text(month_number(ym) - 1)


def months_inclusive(start: Column, end: Column) -> Column:
    """Months from start to end, both counted; 0 if end is before start."""
    return F.greatest(F.lit(0), month_number(end) - month_number(start) + 1)


def end_number(end: Column, asof: str) -> Column:
    """The month of an end: of asof if it is missing, empty or 'present'; null if it can't be read."""
    now = F.lit(int(asof[:4]) * 12 + int(asof[5:7]))
    return F.when(end.isNull() | (end == "") | (F.lower(end) == "present"), now).otherwise(month_number(end))


def months_exclusive(start: Column, end: Column, asof: str) -> Column:
    """Months between two month starts; 0 without a start or if end is before it; one more for an open end if asof's day is after the first."""
    late = int(len(asof) > 7 and int(asof[8:10]) > 1)
    s, e = month_number(start), F.coalesce(end_number(end, asof), end_number(F.lit(None).cast("string"), asof))
    is_open = F.coalesce(end.isNull() | (F.lower(end) == "present") | month_number(end).isNull(), F.lit(True))
    return F.when(s.isNull() | (e < s), 0).otherwise(e - s + F.when(is_open, late).otherwise(0))


def date_token(x: Column) -> Column:
    """YYYY-MM of MM/YYYY, MM.YYYY, YYYY-MM, a month's name with a year, or a year (its January); else null."""
    t = F.trim(F.regexp_replace(F.replace(F.lower(F.trim(x)), F.lit(","), F.lit(" ")), r"\s{2,}", " "))
    months = F.create_map(*[F.lit(v) for kv in MONTHS.items() for v in kv])

    def of(t: Column) -> Column:
        # one test of all shapes; what a shape holds stands at fixed places
        year, n = F.right(t, F.lit(4)), F.length(t)
        month = F.when(F.substring(t, 5, 1) == "-", F.substring(t, 6, 2)).when(F.substring(t, 1, 1) < ":", t.substr(F.lit(1), n - 5)).otherwise(F.try_element_at(months, t.substr(F.lit(1), n - 5)).cast("string"))
        year = F.when(F.substring(t, 5, 1) == "-", F.substring(t, 1, 4)).otherwise(year)
        full = F.when(n == 4, F.concat(t, F.lit("-01"))).otherwise(F.concat(year, F.lit("-"), F.lpad(month, 2, "0")))
        return F.when(t.rlike(rf"^(?:{MONTH}[./]{YEAR}|{YEAR}(?:-{MONTH})?|[a-zäöüß]+\s{YEAR})\z"), full)

    return bound(F.rtrim(t, F.lit("\n\r\u0085\u2028\u2029")), of)


def _pair(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def date_range(x: Column, asof: str | None = None) -> Column:
    """struct<start, end> of since/seit/ab a date, a date to now, or two dates; the words between are found anywhere, also inside a month's name."""
    now = lambda d: F.lit(asof) if asof else d
    parts = rf"(?is)^(.*?){GLUE}(.*?)(?:{GLUE}|\z)"

    def of(s: Column) -> Column:
        texts = F.array(F.when(s.rlike(SINCE), F.regexp_replace(s, SINCE, "")), F.regexp_extract(s, parts, 1), F.regexp_extract(s, parts, 2))
        pairs = lambda r: F.coalesce(_pair(r[0], now(r[0])), F.when(s.rlike(PRESENT), _pair(r[1], now(r[1]))), _pair(r[1], r[2]))
        return bound(F.transform(texts, date_token), pairs)

    return bound(F.trim(x), of)


def date_anchor(x: Column) -> Column:
    """struct<start, end, end_missing> of the first kind of date in a line: month range, year range, (year), one month, a year alone."""
    two = lambda m: F.lpad(m, 2, "0")
    months = rf"(?i)\b({MONTH})[./]({YEAR}){GLUE_IN_LINE}({MONTH})[./]({YEAR})\b"
    years, alone, one = rf"(?i)\b({YEAR}){GLUE_IN_LINE}({YEAR})\b", rf"\(({YEAR})\)", rf"\b({MONTH})[./]({YEAR})\b"
    ym = lambda y, m: F.concat(y, F.lit("-"), m)
    out = lambda a, b, missing: F.struct(a.alias("start"), b.alias("end"), F.lit(missing).alias("end_missing"))

    def of(s: Column) -> Column:
        g = lambda p, k: F.regexp_extract(s, p, k)
        return (
            F.when(s.rlike(months), out(ym(g(months, 2), two(g(months, 1))), ym(g(months, 4), two(g(months, 3))), False))
            .when(s.rlike(years), out(ym(g(years, 1), F.lit("01")), ym(g(years, 2), F.lit("12")), False))
            .when(s.rlike(alone), bound(g(alone, 1), lambda y: out(ym(y, F.lit("01")), ym(y, F.lit("12")), False)))
            .when(s.rlike(one), bound(ym(g(one, 2), two(g(one, 1))), lambda d: out(d, d, True)))
            .when(s.rlike(f"^{YEAR}$"), out(ym(s, F.lit("01")), ym(s, F.lit("01")), True))
        )

    return bound(F.trim(x), of)


def range_start(x: Column) -> Column:
    """struct<start, open> of a line that begins a range (07/2024 bis, seit 03/2020)."""
    p = r"(?i)^(.+?)\s+(?:bis|to|until|–|-|—)\s*(.*)$"

    def of(s: Column) -> Column:
        since = s.rlike(SINCE)
        start = date_token(F.when(since, F.regexp_replace(s, SINCE, "")).otherwise(F.regexp_extract(s, p, 1)))
        return bound(start, lambda d: F.when(d.isNotNull(), F.struct(d.alias("start"), (since | F.regexp_extract(s, p, 2).rlike(PRESENT)).alias("open"))))

    return bound(F.trim(x), of)
