"""Timeline chunks of a CV text: dated lines open chunks, a fold over each document's lines collects them; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resumelake.functions import dates, spans, text

# Parts of words that no technology in a list has.
REJECTED = ("beruflicher", "werdegang", "bildung", "ausbildung", "studium", "kenntnisse", "fähigkeiten", "sprachen", "zertifikate", "profil", "experience", "education", "skills", "languages", "certifications", "profile", "summary")
# Headings that end the timeline, headings of technology lists, words of descriptions and legal forms.
BREAK = r"(?iu)^(?:beruflicher\s+werdegang|bildung|ausbildung|studium|kenntnisse|fähigkeiten|skills?|zertifikate|certifications?|sprachen|languages?|profile|profil|summary|zusammenfassung|publications?|publikationen|interests?|interessen|awards?|auszeichnungen|weitere\s+kenntnisse)\b"
TECH_HEAD = r"(?iu)^(?:eingesetzte\s+technologien|technologien|tech(?:nologies)?\s+stack|tech\s*stack|stack|tools)\s*"
TECH_STOP = r"(?iu)^(?:-\s+|aufgabe|verantwort|tätig|entwicklung|implement|migration|role|responsibil|project|kunde|customer|---\s*page)"
TECH_WORDS = r"(?iu)\b(?:java|spring|aws|azure|kubernetes|k8s|docker|terraform|python|typescript|javascript|postgres|sql|kafka|grafana|prometheus|keycloak|junit|maven|gradle|git|helm|wiremock|testcontainers|liquibase|flyway|datadog|splunk|vault|nginx|react|angular|node)\b"
INLINE = r"(?iu)\b(?:java|python|javascript|js|typescript|ts|spring(?:\s+(?:boot|cloud|batch))?|docker|kubernetes|k8s|aws|amazon web services|azure|terraform|postgres(?:ql)?|sql|kafka|rabbitmq)\b"
DESCRIPTION = r"(?iu)\b(?:beratung|entwicklung|implement|migration|aufbau|konzeption|analyse|development|implementation|design|architecture|monitoring|testing|automatisierung|einführung|weiterentwicklung|optimierung)\b|^(?:Integration|Implementierung|Entwicklung|Migration|Aufbau|Konzeption|Optimierung|Einführung|Weiterentwicklung)\b"
LEGAL = r"\b(?:GmbH|AG|SE|KG|UG|Inc|Ltd|LLC)\b"
PLACE = r"(?U)^[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\-]{2,40}$"
#: What the fold carries: where the open chunk's lines begin, and the chunks before it as ranges of lines.
RANGE = "struct<start:string,end:string,page:int,from:int,to:int>"
STATE = f"struct<mode:int,page:int,open:{RANGE},closed:array<{RANGE}>>"
LEAST = 20


def is_description(s: Column) -> Column:
    return (F.length(s) >= 60) | (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) >= 7) | s.rlike(DESCRIPTION)


def is_company(s: Column) -> Column:
    short = (F.length(s) <= 50) & (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) <= 6) & ~is_description(s)
    return ~s.rlike(PLACE) & (s.rlike(LEGAL) | short)


def is_skipped(s: Column) -> Column:
    """Lines of dashes and bullets alone, and of one word that may be a place."""
    return s.rlike(r"(?U)^(?:[-•·▪–—− \t\n\x0B\f\r]*|[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\-]{2,40})$")


def lines_of(x: Column, asof: str | None) -> Column:
    """The lines of a text with what the fold needs to know of each: its place, marks, and what it says of dates. Patterns are tried only on lines that can match."""

    def dated(s: Column) -> Column:
        out = lambda start, end, missing, until: F.struct(start.alias("start"), end.alias("end"), missing.alias("missing"), until.alias("until"))
        none = F.lit(None).cast("string")

        def otherwise(d: Column) -> Column:
            span, begin = d["span"], d["begin"]
            end = F.coalesce(span["end"], F.when(begin["open"], F.lit(asof)), begin["start"])
            return out(F.coalesce(span["start"], begin["start"]), end, F.when(span.isNotNull(), F.lit(False)).when(begin.isNotNull(), ~begin["open"]), d["until"])

        more = F.struct(dates.date_range(s, asof).alias("span"), dates.range_start(s).alias("begin"), dates.date_token(s).alias("until"))
        return spans.bound(dates.date_anchor(s), lambda f: F.when(f.isNotNull(), out(f["start"], f["end"], f["end_missing"], none)).otherwise(spans.bound(more, otherwise)))

    def line(raw: Column, i: Column) -> Column:
        s = F.when(raw.startswith("["), F.trim(F.regexp_replace(raw, r"^\[(?:LEFT_COLUMN|RIGHT_COLUMN|HEADER_AREA)\]\s*", ""))).otherwise(F.trim(raw))
        page = F.when(raw.startswith("---") & raw.rlike(r"(?i)^---\s*Page\s+[0-9]+\s*---\s*$"), F.regexp_extract(raw, "([0-9]+)", 1).cast("int"))
        has_year = (raw.contains("19") | raw.contains("20")) & raw.rlike(dates.YEAR)
        return F.struct(i.alias("i"), s.alias("s"), raw.startswith("[RIGHT_COLUMN]").alias("right"), page.alias("page"), F.when(has_year, spans.bound(s, dated)).alias("date"))

    return F.transform(F.split(text.timeline_text(x), "\n"), line)


def _state(a: Column, **new: Column) -> Column:
    return F.struct(*[new.get(f, a[f]).alias(f) for f in ("mode", "page", "open", "closed")])


def chunks_of(x: Column, asof: str | None = None) -> Column:
    """array of chunks of a text. Modes: 0 seeking, 1 waiting for an end date, 2 collecting, 3 done.

    The fold carries ranges of lines only, so that it is linear in them, and most lines leave its state as it is; each chunk's lines are cut out afterwards.
    """
    seek, wait, collect, done = (F.lit(k) for k in range(4))

    def closed(a: Column, at: Column) -> Column:
        return F.when(a["mode"] == 2, F.concat(a["closed"], F.array(a["open"].withField("to", at)))).otherwise(a["closed"])

    def step(a: Column, ln: Column) -> Column:
        date, at = ln["date"], ln["i"]
        new = F.struct(date["start"].alias("start"), date["end"].alias("end"), a["page"].alias("page"), (at + 1).alias("from"), F.lit(0).alias("to"))
        until = F.coalesce(date["until"], F.when(ln["s"].rlike(dates.PRESENT), F.lit(asof)))
        ends = lambda u: F.when(u.isNotNull(), _state(a, mode=collect, open=a["open"].withField("end", u).withField("from", at + 1))).otherwise(a)
        return (
            F.when(a["mode"] == 3, a)
            .when(ln["page"].isNotNull(), _state(a, page=F.when(a["mode"] == 1, a["page"]).otherwise(ln["page"])))
            .when(ln["right"] & (a["mode"] < 2), a)
            .when(ln["s"].rlike(BREAK), _state(a, mode=done, closed=closed(a, at)))
            .when(date["start"].isNotNull() & ln["right"], _state(a, mode=seek, closed=closed(a, at)))
            .when(date["start"].isNotNull(), _state(a, mode=F.when(date["missing"], wait).otherwise(collect), open=new, closed=closed(a, at)))
            .when(a["mode"] == 1, spans.bound(until, ends))
            .otherwise(a)
        )

    def chunk(lines: Column, r: Column) -> Column:
        def of(part: Column) -> Column:
            own = F.transform(F.filter(part, lambda ln: ln["page"].isNull() & ~ln["right"] & ~is_skipped(ln["s"])), lambda ln: ln["s"])
            first = F.when(r["page"] > 0, F.array(r["page"])).otherwise(F.array().cast("array<int>"))
            pages = F.array_distinct(F.concat(first, F.filter(F.transform(part, lambda ln: ln["page"]), lambda p: p.isNotNull())))
            return F.struct(r["start"].alias("start_date"), r["end"].alias("end_date"), own.alias("lines"), pages.alias("pages"))

        return spans.bound(F.slice(lines, r["from"] + 1, F.greatest(r["to"] - r["from"], F.lit(0))), of)

    def whole(lines: Column) -> Column:
        start = F.from_json(F.lit('{"mode":0,"page":0,"open":{"page":0,"from":0,"to":0},"closed":[]}'), STATE)
        full = lambda c: F.aggregate(c["lines"], F.lit(0), lambda n, s: n + F.length(s)) >= LEAST
        return F.filter(F.transform(F.aggregate(lines, start, step, lambda a: closed(a, F.size(lines))), lambda r: chunk(lines, r)), full)

    return spans.bound(lines_of(x, asof), whole)


def header_and_body(lines: Column) -> Column:
    """struct<header, body>: the first company-like line and, if it is the chunk's first, a short line after it; all else is body."""
    none = F.array().cast("array<string>")
    bullet = lambda s: s.startswith("-") | s.rlike(TECH_HEAD + ":?")

    def split(x: Column) -> Column:
        all_, first = x["lines"], x["first"]
        second = F.try_element_at(all_, F.lit(2))
        both = (first == 0) & F.coalesce(~bullet(second) & (F.length(second) <= 80) & ~is_description(second), F.lit(False))
        n = F.when(first < 0, 0).when(both, 2).otherwise(1)
        return spans.bound(n, lambda n: F.struct(F.when(n > 0, F.slice(all_, F.greatest(first, F.lit(0)) + 1, n)).otherwise(none).alias("header"), F.filter(all_, lambda _, i: (n == 0) | (i < first) | (i >= first + n)).alias("body")))

    counted = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("first"))
    step = lambda a, s: F.struct((a["i"] + 1).alias("i"), F.when(a["first"] >= 0, a["first"]).when(~bullet(s) & is_company(s), a["i"]).otherwise(-1).alias("first"))
    return spans.bound(F.struct(lines.alias("lines"), F.aggregate(lines, counted, step, lambda a: a["first"]).alias("first")), split)


def technologies_of(lines: Column) -> Column:
    """Technologies listed in lines: after a heading or in a comma-heavy line, up to a line that stops the list; else those named in running text."""
    none = F.array().cast("array<string>")

    def step(a: Column, s: Column) -> Column:
        commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
        opens = s.rlike(TECH_HEAD + r"(?::|$)") | (~s.startswith("-") & (commas >= 3) & s.rlike(TECH_WORDS))
        goes = a["on"] & (s != "") & ~s.rlike(TECH_STOP) & dates.range_start(F.when(s.rlike(dates.YEAR), s)).isNull()
        rest = F.regexp_replace(s, TECH_HEAD + r":?\s*", "")
        more = lambda k: F.when(k == 2, F.concat(a["got"], F.array(rest))).when(k == 1, F.concat(a["got"], F.array(s))).otherwise(a["got"])
        return spans.bound(F.when(opens, 2).when(goes, 1).otherwise(0), lambda k: F.struct((k > 0).alias("on"), more(k).alias("got")))

    blocks = F.aggregate(lines, F.struct(F.lit(False).alias("on"), none.alias("got")), step, lambda a: a["got"])
    # by one plain sign, for which nothing is compiled row by row
    listed = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(F.regexp_replace(b, r"\s*[,;|/]\s*", ","), ","), text.technology_name)))
    listed = F.filter(listed, lambda t: t.rlike(r"^[A-Za-z0-9][A-Za-z0-9+.#()\-\s]{1,80}$") & ~F.lower(t).rlike("|".join(REJECTED)))
    named = F.transform(F.regexp_extract_all(F.array_join(lines, " "), F.lit(INLINE), F.lit(0)), text.technology_name)
    return spans.bound(listed, lambda xs: spans.bound(F.when(F.size(xs) > 0, xs).otherwise(named), lambda ys: text.ordered_distinct(ys, F.lower)))


def timeline(docs: DataFrame, asof: str | None = None) -> DataFrame:
    """doc_id, seq, start_date, end_date, months, header_lines, body_lines, technologies, source_pages of each chunk of docs (doc_id, text)."""
    rows = docs.select("doc_id", F.posexplode(chunks_of(F.col("text"), asof)).alias("seq", "c")).withColumn("hb", header_and_body(F.col("c.lines")))
    hb = F.col("hb")
    return rows.select(
        "doc_id", "seq", "c.start_date", "c.end_date", dates.months_inclusive(F.col("c.start_date"), F.col("c.end_date")).alias("months"),
        hb["header"].alias("header_lines"), hb["body"].alias("body_lines"), technologies_of(F.col("c.lines")).alias("technologies"), F.col("c.pages").alias("source_pages"),
    )
