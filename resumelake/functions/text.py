"""String normal forms, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aliases of technology names.
ALIASES = {"js": "JavaScript", "ts": "TypeScript", "py": "Python", "k8s": "Kubernetes", "otel": "OpenTelemetry", "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "mysql": "MySQL", "mariadb": "MariaDB"}

# Spellings of legal forms, in the order in which they are set right; labels that aren't part of a name; tools listed without a comma.
LEGAL_FORMS = ((r"G\s*m\s*b\s*H", "GmbH"), (r"Gmb\s*H", "GmbH"), (r"A\s*G", "AG"), (r"K\s*G", "KG"), (r"G\s*b\s*R", "GbR"), (r"S\s*E", "SE"))
NAME_LABELS = ("office", "mobile", "phone", "email", "address", "contact", "tel", "fax", "büro", "mobil", "telefon", "e-mail", "adresse", "kontakt")
LAST_TOOLS = ("Ant", "Maven", "Gradle", "Jira", "Jenkins", "GitHub")
PAGE = r"(?i)^\s*---\s*Page\s+[0-9]+\s*---\s*$"
DATED_LINE = r"^\s*(?:[0-9]{1,2}/[0-9]{4}|[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})\b"
BULLET = r"^\s*[-–]\s+\S"


def trimmed(x: Column) -> Column:
    """Without white space of any kind (Unicode) at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def norm_space(x: Column) -> Column:
    return trimmed(F.regexp_replace(x, r"(?U)\s+", " "))


def casefold(x: Column) -> Column:
    """Case-insensitive key; equal to full case folding for German and English."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def norm_matching(x: Column) -> Column:
    """Dashes to -, unusual spaces to a space, curly apostrophes to '; one character for one, so offsets stay."""
    return F.translate(x, "\u2010\u2011\u2012\u2013\u2014\u2212\u00a0\u202f\u2007\u2019\u2018", "------   ''")


def strip_name_token(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[^\w\-']", "")


def page_signature(x: Column) -> Column:
    """What makes repeated headers and footers equal: page counts and digits masked, lower case."""
    x = norm_space(F.translate(x, "\u00a0", " "))
    x = F.regexp_replace(x, r"(?i)page\s*[0-9]+\s*of\s*[0-9]+", "page # of #")
    return F.lower(F.regexp_replace(x, r"[0-9]+", "#"))


def timeline_text(x: Column) -> Column:
    """Line ends, private-use glyphs, hyphenation (dropped at line ends and before white space), bullets, blanks."""
    x = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    x = F.regexp_replace(x, r"[\x{F000}-\x{F8FF}]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2"), r"(?U)(\w)-\s+(\w)", "$1$2")
    x = F.regexp_replace(x, r"(?m)^[ \t]*[•·▪●‣∙]\s*", "- ")
    return trimmed(F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}|\t", " "), r"\n{4,}", "\n\n\n"))


def extracted_text(x: Column) -> Column:
    """Clean-up of text taken from pages."""
    for pattern, put in ((r"(?U)(\w)-\n(\w)", "$1$2"), (r"(?m)[ \t]+$", ""), (r"(?mU)^[^\w\n]{1,6}$\n?", ""), (r"(?m)^[\x{E000}-\x{F8FF}\s]+$\n?", ""), (r"(?m)^[ \t]*[•·▪●][ \t]*", "- "), (r"(?m)^[ \t]+", ""), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        x = F.regexp_replace(x, pattern, put)
    return F.concat(trimmed(x), F.lit("\n"))


def soft_clean(x: Column) -> Column:
    """Soft hyphens dropped, zero-width and no-break spaces and tabs to spaces, runs of spaces to one."""
    x = F.replace(x, F.lit("\u00ad"), F.lit(""))
    return F.regexp_replace(F.translate(x, "\u200b\u200c\u200d\u00a0\ufeff\t", "      "), " {2,}", " ")


def block_clean(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    return trimmed(F.regexp_replace(x, r"(?m)[ \t]+$", ""))


def split_bullets(x: Column) -> Column:
    """An inline list (● • ;) as lines, what stands before a colon kept as its heading; text with bullets stays."""
    flat = ~x.rlike(r"(?m)^\s*[-•●]\s") & x.rlike("[●•;]")
    items = F.filter(F.transform(F.split(F.regexp_replace(x, r"^[^:●•;]*:\s*", ""), "[●•;]"), trimmed), lambda t: t != "")
    intro = F.regexp_extract(x, r"^([^:●•;]*:)", 1)
    return F.when(flat, trimmed(F.concat(F.when(intro != "", F.concat(intro, F.lit("\n"))).otherwise(""), F.array_join(F.transform(items, lambda t: F.concat(F.lit("- "), t)), "\n")))).otherwise(x)


def label_key(x: Column) -> Column:
    """An entity label as part of an id: lower case, words joined by _; pii if nothing is left."""
    y = F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(y == "", "pii").otherwise(y)


def phone_digits(x: Column) -> Column:
    """Digits and plus signs; null if there are fewer than seven digits."""
    y = F.regexp_replace(x, r"[^0-9+]", "")
    return F.when(F.length(F.replace(y, F.lit("+"), F.lit(""))) >= 7, y)


def technology_key(x: Column) -> Column:
    return F.lower(trimmed(x))


def technology_name(x: Column) -> Column:
    """A technology as listed, cleaned and with its usual name."""
    y = F.regexp_replace(trimmed(x), r"(?i)^(?:und|and)\s+", "")
    y = F.rtrim(F.regexp_replace(y, r"\s{2,}", " "))
    y = F.regexp_replace(y, r"[.,:]+$", "")
    names = F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])
    return bound(y, lambda y: F.coalesce(F.try_element_at(names, F.regexp_replace(F.lower(y), r"[^a-z0-9+.#-]", "")), y))


def snippet(x: Column, n: int = 150) -> Column:
    return F.concat(F.substring(x, 1, n), F.lit("..."))


def bound(x: Column, f) -> Column:
    """f(x), x computed once: an expression used often inside a lambda is else computed as often."""
    return F.element_at(F.transform(F.array(x), f), 1)


def ordered_distinct(xs: Column, key=lambda x: x) -> Column:
    """Items whose key (not null) hasn't come before, in order. Keys are sorted, not compared with all others."""

    def first(s: Column) -> Column:
        new = lambda e, j: e["k"].isNotNull() & ((j == 0) | (e["k"] != F.element_at(s, F.greatest(j, F.lit(1)))["k"]))
        return F.array_sort(F.transform(F.filter(s, lambda e, j: F.coalesce(new(e, j), F.lit(True))), lambda e: e["i"]))

    def of(ys: Column) -> Column:
        keyed = F.filter(F.transform(ys, lambda y, i: F.struct(key(y).alias("k"), i.alias("i"))), lambda e: e["k"].isNotNull())
        return F.transform(bound(F.array_sort(keyed), first), lambda i: F.element_at(ys, i + 1))

    return F.when(xs.isNotNull(), bound(xs, of))


def url_domain(x: Column) -> Column:
    """Lower-case authority without www.; null if there is none."""
    full = F.when(x.rlike("(?i)^[a-z][a-z0-9+.-]*://"), x).otherwise(F.concat(F.lit("http://"), x))
    host = F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def url_has_path(x: Column) -> Column:
    rest = F.regexp_extract(F.when(x.rlike("(?i)^[a-z][a-z0-9+.-]*://"), x).otherwise(F.concat(F.lit("http://"), x)), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    return rest.rlike(r"^/[^?#]") | rest.rlike(r"\?[^#]")


def is_heading(x: Column) -> Column:
    """A line that ends in a colon or begins a list of technologies, or of four characters or more without a lower-case letter."""
    s = trimmed(x)
    return s.endswith(":") | s.rlike(r"(?i)^Eingesetzte Technologien\s*:") | ((F.length(s) >= 4) & s.rlike(r"\p{Lu}") & ~s.rlike(r"\p{Ll}"))


def _line_fixed(x: Column) -> Column:
    """Spaces, a letter split off an e-mail address, and legal forms of one line."""
    s = F.regexp_replace(soft_clean(x), r"([\p{L}0-9])\s+([A-Za-z0-9._%+\-]{1,32}@)", "$1$2")
    for pattern, form in LEGAL_FORMS:
        s = F.regexp_replace(s, rf"(?iU)\b{pattern}\b", form)
    return F.when(x.rlike(PAGE), x).otherwise(s)


def _dashes_kept_with_text(lines: Column) -> Column:
    """A line of one dash goes to the next line with text, over blank lines; page marks stay where they are. One with no text after it goes."""
    start = F.struct(F.lit(False).alias("dash"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        blank, page = trimmed(s) == "", s.rlike(PAGE)
        lone = ~a["dash"] & s.rlike(r"^\s*[-–]\s*$")
        put = F.when(a["dash"] & ~page, F.concat(F.lit("- "), trimmed(s))).otherwise(s)
        return F.struct((lone | (a["dash"] & (blank | page))).alias("dash"), F.when(lone | (a["dash"] & blank), a["out"]).otherwise(F.concat(a["out"], F.array(put))).alias("out"))

    return F.aggregate(lines, start, step, lambda a: a["out"])


def _wraps_joined(lines: Column) -> Column:
    """Lines that the layout broke, joined again; never over blank lines, page marks, dates and headings."""
    start = F.array().cast("array<string>")

    def step(out: Column, raw: Column) -> Column:
        s, last, n = trimmed(soft_clean(raw)), F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit("")), F.size(out)
        stop = (s == "") | s.rlike(PAGE) | s.rlike(DATED_LINE) | is_heading(s) | (last == "") | last.rlike(PAGE) | last.rlike(DATED_LINE) | last.endswith(":")
        listed, lower = last.rlike(BULLET), s.rlike(r"^\p{Ll}")
        stop = stop | (s.rlike(BULLET) & ~listed)
        word = last.endswith("-") & lower
        goes_on = ~last.rlike(r"[.!?]$") & ((listed & ~s.rlike(BULLET)) | lower | last.rlike(r"[,/(–-]$"))
        joined = F.when(word, F.concat(last.substr(F.lit(1), F.length(last) - 1), s)).otherwise(F.concat(last, F.lit(" "), s))
        return F.when(~stop & (word | goes_on), F.concat(F.slice(out, F.lit(1), n - 1), F.array(joined))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(lines, start, step)


def layout_text(x: Column) -> Column:
    """Text of pages without traces of their layout: bullets, hyphens at line ends (kept), icons, page numbers, lone dashes, split addresses and legal forms, wrapped lines.

    Null and empty texts give an empty text.
    """
    t = F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), "[●•▪‣◦∙·]", "\n- ")
    t = F.regexp_replace(t, r"([\p{L}0-9])-\n\s*([\p{L}0-9])", "$1-$2")
    t = F.regexp_replace(t, r"(?i)([\p{L}0-9])-\n(?:---\s*Page\s+[0-9]+\s*---\n)+\s*([\p{L}0-9])", "$1-$2")
    lines = F.transform(F.split(t, "\n"), lambda s: F.regexp_replace(s, r"(?U)\s+$", ""))
    lines = F.filter(lines, lambda s: ~s.rlike(r"^\s*[\x{E000}-\x{F8FF}]+\s*$"))
    lines = F.transform(lines, lambda s: F.when(s.rlike(r"^\s*[0-9]{1,3}\s*$"), "").otherwise(s))
    lines = F.transform(_dashes_kept_with_text(lines), _line_fixed)
    lines = F.transform(_wraps_joined(lines), _line_fixed)
    out = F.concat(trimmed(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")), F.lit("\n"))
    return F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(out)


def clean_name(x: Column) -> Column:
    """A name without labels before, after or in it."""
    labels = "|".join(NAME_LABELS)
    s = F.regexp_replace(F.regexp_replace(x, rf"(?iu)^(?:{labels})[:\s]*", ""), rf"(?iu)[:\s]*(?:{labels})$", "")
    words = F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")
    kept = F.filter(F.transform(words, strip_name_token), lambda w: (w != "") & ~casefold(w).isin(*NAME_LABELS))
    return F.when(F.size(kept) < F.size(words), F.array_join(kept, " ")).otherwise(trimmed(s))


def technologies_split(xs: Column) -> Column:
    """Technologies cleaned, a tool that follows another without a comma on its own, each once (case counts)."""
    clean = F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda t: trimmed(soft_clean(F.coalesce(t, F.lit(""))))), lambda t: t != "")
    pattern = rf"(?i)^(.+?)\s+({'|'.join(LAST_TOOLS)})$"

    def parts(t: Column) -> Column:
        first = F.regexp_extract(t, pattern, 1)
        return F.when((first != "") & ~first.contains(","), F.array(first, F.regexp_extract(t, pattern, 2))).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(clean, parts)))
