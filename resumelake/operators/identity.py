"""Who a document is about: name candidates, their scores, and the forms that a name takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resumelake.functions import spans, text
from resumelake.operators import exclusion

# Mailboxes that aren't a person's, words that aren't names; points by source.
MAILBOXES = ("info", "contact", "kontakt", "office", "admin", "support", "hello", "mail", "jobs", "hr", "team", "noreply", "no-reply", "sales", "service")
LABELS = ("name", "curriculum", "vitae", "lebenslauf", "resume", "contact", "kontakt", "profile", "profil", "address", "adresse", "email", "phone", "telefon")
SOURCE_POINTS = {"header": 40, "intro": 60, "linkedin": 18, "email": 14, "ner": 60, "email_weak": 6}
# Words of documents, jobs, companies and titles that aren't names.
STOPWORDS = (
    "curriculum", "vitae", "lebenslauf", "profil", "profile", "summary", "kontakt", "contact", "information", "info", "adresse", "address", "telefon", "phone", "email", "e-mail", "linkedin", "github", "portfolio", "website", "webseite", "blog",
    "senior", "junior", "engineer", "developer", "architect", "consultant", "principal", "platform", "cloud", "data", "services", "entwickler", "ingenieur", "berater", "architekt", "leitender", "führender", "haupt",
    "gmbh", "ag", "inc", "ltd", "llc", "company", "university", "universität", "unternehmen", "firma", "gesellschaft", "prof", "prof.", "dr", "dr.", "mr", "mrs", "ms", "herr", "frau", "doktor", "professor",
)
INTRO = r"(?iu)\b(?:mein Name ist|my name is|Name:)\s+(\p{L}[\p{L}'’-]+(?:\s+\p{L}[\p{L}'’-]+)?)"


def from_email(docs: DataFrame) -> DataFrame:
    """doc_id, start, name, source: a name from each e-mail address's local part (two parts or more: a name, one: weak)."""
    found = docs.select("doc_id", F.col("text"), F.explode(spans.found(F.col("text"), *_email())).alias("s"))
    local = F.substring_index(spans.slice_of(F.col("text"), F.col("s")), "@", 1)
    parts = F.filter(F.split(local, r"[._\-+]+"), lambda p: (F.length(p) >= 2) & ~p.rlike("^[0-9]+$"))
    rows = found.where(~F.lower(local).isin(*MAILBOXES)).select("doc_id", F.col("s.start").alias("start"), parts.alias("p")).where(F.size("p") > 0)
    name = F.array_join(F.transform(F.slice("p", 1, 2), lambda p: F.initcap(p)), " ")
    return rows.select("doc_id", "start", name.alias("name"), F.when(F.size("p") >= 2, "email").otherwise("email_weak").alias("source"))


def _email() -> tuple[str, str, float]:
    pattern, score = spans.PATTERNS["EMAIL_ADDRESS"]
    return pattern, "EMAIL_ADDRESS", score


def from_header(docs: DataFrame, lines: int = 20, most: int = 4) -> DataFrame:
    """doc_id, start (the line), name, source: short lines of two or more capitalised words before the contact details."""
    every = F.transform(F.slice(F.split("text", "\n"), 1, lines), lambda s: text.norm_space(s))
    stop = F.coalesce(F.array_position(F.transform(every, lambda s: s.rlike(r"(?iu)\b(contact|kontakt|address|adresse|email|e-mail|phone|telefon)\b")), F.lit(True)), F.lit(0))
    zone = F.when(stop > 0, F.slice(every, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(every)
    like = lambda s: (F.length(s) <= 70) & s.rlike(r"(?U)^(?:\p{Lu}\p{Ll}+(?:[-']\p{L}+)?)(?: \p{Lu}\p{Ll}+(?:[-']\p{L}+)?)+$")
    hits = F.slice(F.filter(F.transform(zone, lambda s, i: F.struct(i.alias("start"), s.alias("name"))), lambda h: like(h["name"])), 1, most)
    return docs.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.start", "h.name", F.lit("header").alias("source"))


def from_linkedin(docs: DataFrame) -> DataFrame:
    """doc_id, start, name, source: a name from each profile address's handle, without the digits at its end."""
    pattern, points = spans.PATTERNS["LINKEDIN_PROFILE"]
    found = docs.select("doc_id", F.col("text"), F.explode(spans.found(F.col("text"), pattern, "LINKEDIN_PROFILE", points, r"linkedin\.com/")).alias("s"))
    handle = F.regexp_replace(F.regexp_extract(spans.slice_of(F.col("text"), F.col("s")), spans.HANDLE, 1), "[0-9]+$", "")
    parts = F.slice(F.filter(F.split(handle, "[-_]+"), lambda p: F.length(p) >= 2), 1, 2)
    rows = found.select("doc_id", F.col("s.start").alias("start"), parts.alias("p")).where(F.size("p") > 0)
    return rows.select("doc_id", "start", F.array_join(F.transform("p", F.initcap), " ").alias("name"), F.lit("linkedin").alias("source"))


def from_intro(docs: DataFrame) -> DataFrame:
    """doc_id, start, name, source: what follows an introduction (my name is, mein Name ist, Name:)."""
    name = F.regexp_extract("text", INTRO, 1)
    return docs.where(F.col("text").rlike(INTRO)).select("doc_id", F.lit(0).alias("start"), F.initcap(text.norm_space(name)).alias("name"), F.lit("intro").alias("source"))


def from_ner(docs: DataFrame, ner) -> DataFrame:
    """doc_id, start, name, source, sure: persons that a recognizer (a column function to spans) finds outside addresses, without labels, of three letters or more."""
    d = docs.select("doc_id", "text", ner(F.col("text")).alias("s"))
    pattern, points = spans.PATTERNS["ADDRESS"]
    places = spans.detected(F.col("text"), [("ADDRESS", spans.FULL_ADDRESS, 0.85, "[0-9]{5}"), ("ADDRESS", pattern, points, "[0-9]{5}")])
    persons = exclusion.outside(F.filter("s", lambda x: x["entity_type"] == "PERSON"), places)
    rows = d.select("doc_id", "text", F.explode(persons).alias("s")).select("doc_id", F.col("s.start").alias("start"), text.norm_space(spans.slice_of(F.col("text"), F.col("s"))).alias("raw"), F.col("s.score").alias("sure"))
    rows = rows.where((F.length("raw") >= 3) & ~exclusion.address_marked(F.col("raw"))).withColumn("name", text.clean_name(F.col("raw")))
    return rows.where(F.length("name") >= 3).select("doc_id", "start", "name", F.lit("ner").alias("source"), "sure")


def resolved(docs: DataFrame, ner=None) -> DataFrame:
    """doc_id, name, score: the primary identity of each of docs (doc_id, text): candidates from header, introduction, e-mail, profile address and recognizer,
    but for those in lists of technologies, scored; the best. Documents without a candidate are left out."""
    every = from_header(docs).unionByName(from_intro(docs)).unionByName(from_email(docs)).unionByName(from_linkedin(docs))
    if ner is not None:
        every = every.unionByName(from_ner(docs, ner), allowMissingColumns=True)
    held = every.join(docs.select("doc_id", "text"), "doc_id")
    held = held.where(~F.coalesce(exclusion.in_technology_list(F.col("text"), F.col("name")), F.lit(False))).drop("text")
    return primary(scored(held, docs))


def score(source: Column, name: Column, line: Column, uses: Column, sure: Column | None = None) -> Column:
    """Points of a candidate: its source, its number of words, its line, how often its words come, stop words, digits and labels, and how sure a recognizer is of it."""
    words = F.split(name, " ")
    n = F.size(words)
    points = F.coalesce(*[F.when(source == k, F.lit(v)) for k, v in SOURCE_POINTS.items()], F.lit(0))
    points = points + F.when(n.between(2, 4), 25).when(n == 1, 5).otherwise(-10)
    points = points + F.when(source == "header", F.when(line <= 6, F.greatest(F.lit(0), 25 - 3 * line)).otherwise(-15)).otherwise(0)
    points = points + F.least(F.lit(20), 5 * uses)
    points = points - 25 * F.size(F.filter(words, lambda w: text.casefold(text.strip_name_token(w)).isin(*[s.replace("ß", "ss") for s in STOPWORDS])))
    if sure is not None:
        points = points + F.when(source == "ner", F.least(F.lit(20.0), 20 * F.coalesce(sure, F.lit(0.0)))).otherwise(0.0)
    points = points - F.when(name.rlike("[0-9]"), 30).otherwise(0) - F.when(F.arrays_overlap(F.transform(words, F.lower), F.array(*map(F.lit, LABELS))), 40).otherwise(0)
    return points + F.when(name.rlike(r"^(?U)\p{Lu}\p{Ll}+( \p{Lu}\p{Ll}+)+$"), 15).otherwise(0)


def scored(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, name, source, score: the best of each name's candidates (the first of equals)."""
    held = candidates.join(docs.select("doc_id", "text"), "doc_id")
    quoted = lambda w: F.concat(F.lit(r"(?iu)\b\Q"), w, F.lit(r"\E\b"))
    uses = F.aggregate(F.split("name", " "), F.lit(0), lambda a, w: a + F.when(F.regexp_count("text", quoted(w)) >= 2, 1).otherwise(0))
    sure = F.col("sure") if "sure" in candidates.columns else None
    points = held.select("doc_id", "start", "name", "source", score(F.col("source"), F.col("name"), F.col("start"), uses, sure).alias("score"))
    best = points.groupBy("doc_id", text.casefold(F.col("name")).alias("key")).agg(F.max_by(F.struct("name", "source", "score", "start"), F.struct("score", -F.col("start"), "source")).alias("b"))
    return best.select("doc_id", "b.name", "b.source", "b.score", "b.start")


def top_candidates(scores: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, rank, name, source, score: each document's best candidates, for inspection."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "start", F.desc("name"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("doc_id", "rank", "name", "source", "score")


def primary(scores: DataFrame) -> DataFrame:
    """doc_id, name, score of the candidate with most points (the first of equals)."""
    best = scores.groupBy("doc_id").agg(F.max_by(F.struct("name", "score"), F.struct("score", -F.col("start"), "name")).alias("b"))
    return best.select("doc_id", "b.name", "b.score")


def variants(name: Column, doc: Column) -> Column:
    """Forms of a name: whole, its parts (three letters or more), parts of double names, last and first, beginnings of the first name that the text holds."""
    parts = F.filter(F.split(text.norm_space(name), " "), lambda p: F.length(text.strip_name_token(p)) >= 3)
    first, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    double = F.flatten(F.transform(parts, lambda p: F.when(p.contains("-"), F.filter(F.split(p, "-"), lambda q: F.length(q) >= 3)).otherwise(F.array().cast("array<string>"))))
    starts = F.when(F.length(first) > 4, F.transform(F.sequence(F.lit(4), F.length(first) - 1), lambda n: first.substr(F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    starts = F.filter(starts, lambda s: F.regexp_like(doc, F.concat(F.lit(r"(?iu)\b\Q"), s, F.lit(r"\E\b"))))
    turned = F.when(F.size(parts) >= 2, F.array(F.concat_ws(" ", last, first))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(text.norm_space(name)), parts, double, turned, F.coalesce(starts, F.array().cast("array<string>"))), lambda v: v != ""))


def initials(name: Column) -> Column:
    """Patterns for initials of a first and last name (A. B., A.B., AB, A. Last)."""
    parts = F.split(text.norm_space(name), " ")
    a, b, last = F.substring(F.element_at(parts, 1), 1, 1), F.substring(F.element_at(parts, -1), 1, 1), F.element_at(parts, -1)
    quoted = lambda *xs: F.concat(F.lit(r"\b"), *xs)
    return F.when(F.size(parts) >= 2, F.array(quoted(a, F.lit(r"\.\s?"), b, F.lit(r"\.")), quoted(a, b, F.lit(r"(?=\s|$)")), quoted(a, F.lit(r"\.\s?"), last, F.lit(r"\b")), quoted(last, F.lit(r",\s?"), a, F.lit(r"\.")))).otherwise(F.array().cast("array<string>"))


def lexicon_filter(values: DataFrame, lexicon: DataFrame, how: str = "word") -> DataFrame:
    """values (id, value) without those that the lexicon (term) holds: word (all of it, or a word of it), prefix or substring of a longer term.

    Words are matched by an equi-join on each word; a prefix by one on the value and each beginning of a term.
    """
    v, t = F.lower(F.trim(F.col("value"))), F.lower("term")
    if how == "word":
        keys = values.select("id", F.explode(F.array_distinct(F.concat(F.array(v), F.split(v, r"[\s\-_]+")))).alias("k"))
        terms = lexicon.select(t.alias("k")).distinct()
    elif how == "prefix":
        keys = values.where(F.length(v) >= 2).select("id", v.alias("k"))
        terms = lexicon.where(F.length(t) > 2).select(F.explode(F.transform(F.sequence(F.lit(2), F.length(t) - 1), lambda n: t.substr(F.lit(1), n))).alias("k")).distinct()
    else:
        keys = values.where(F.length(v) >= 2).select("id", v.alias("k"))
        every = F.flatten(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda a: F.transform(F.sequence(F.lit(2), F.greatest(F.length(t) - a + 1, F.lit(2))), lambda n: t.substr(a, n))))
        terms = lexicon.where(F.length(t) > 2).select(t.alias("t"), F.explode(every).alias("k")).where("k <> t").select("k").distinct()
    return values.join(keys.join(terms, "k", "left_semi").select("id").distinct(), "id", "left_anti")
