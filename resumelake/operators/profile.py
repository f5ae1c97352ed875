"""Profile of a CV text: contacts, links, sections, skills, education, certificates and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resumelake.functions import dates, text
from resumelake.operators import timeline

# Section headings, signals, domains and their endings.
HEADING = r"(?iu)^\s*(?:##\s*)?((?:profil|summary|zusammenfassung|kurzprofil|profile|work\s+experience|professional\s+experience|experience|employment|berufserfahrung|werdegang|skills?|kenntnisse|fähigkeiten|technologien|technologies|tech\s*stack|stack|education|ausbildung|studium|bildung|certifications?|certificates?|zertifikate|qualifikationen|languages?|sprachen))\s*:?\s*$"
KEYS = (("skill|kennt|fäh", "skills"), ("educ|ausbild|stud|bildung", "education"), ("cert|zert|qualifik", "certifications"), ("lang|sprach", "languages"), ("experience|employment|beruf|werdegang", "experience"), ("project|projekt", "projects"), ("summary|profil", "profile"))
EDUCATION = r"(?iu)\b(?:bachelor|master|msc|bsc|phd|doktor|diplom|magister|degree|studium|university|universität|hochschule|institute|institut)\b"
YEARS = r"\b(?:19|20)[0-9]{2}\b"
CERTIFICATE = r"(?iu)\b(?:certified|certificate|certification|zertifikat|zertifizierung|ihk|itil|scrum|aws|azure|oracle)\b"
SKILL = r"(?iu)\b(?:java|python|spring|kubernetes|docker|aws|azure|linux|sql|postgres|mysql|react|angular|terraform)\b"
ENDINGS = ("de", "com", "net", "org", "io", "dev", "me", "info", "eu", "at", "ch", "uk")
NO_DOMAINS = ("node.js", "next.js", "nuxt.js", "react.js", "vue.js", "deno.land")
EMAIL = r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
URL = r"(?i)\bhttps?://[^\s)>\]]+\b"
DOMAIN = r"(?i)\b(?:www\.)?(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+(?:[a-z]{2,24})(?:/[^\s)>\]]*)?\b"
PHONE = r"(?<!\w)(?:\+?[0-9]{1,3}[\s\-/]?)?(?:\(?[0-9]{2,5}\)?[\s\-/]?)?[0-9]{2,5}[\s\-/]?[0-9]{2,5}[\s\-/]?[0-9]{0,6}(?!\w)"

NO_NAMES = ("lebenslauf", "curriculum", "vitae", "cv", "resume", "profil", "profile", "summary", "freiberufliche", "projektmitarbeit", "berufserfahrung", "experience")
NO_PLACES = ("diplom", "master", "bachelor", "msc", "b.sc", "m.sc")
PLACE_LINE = r"^[A-ZÄÖÜ][A-Za-zÄÖÜäöüß.\- ]{2,60}$"
COUNTRY = r"(?iu)\b(?:Germany|Deutschland)\b"
SURE = "struct<value:string,confidence:double>"


def is_domain(x: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(x)), r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")
    host = F.substring_index(s, "/", 1)
    return ~s.contains("@") & ~s.isin(*NO_DOMAINS) & host.rlike(r"^[a-z0-9.\-]+$") & host.contains(".") & F.substring_index(host, ".", -1).isin(*ENDINGS) & (F.length(host) >= 6)


def link_class(url: Column) -> Column:
    u = F.lower(url)
    return F.when(u.contains("linkedin."), "linkedin").when(u.contains("xing."), "xing").when(u.contains("github."), "github").when(u.contains("gitlab."), "gitlab").when(u.rlike(r"stackoverflow\.|medium\.|kaggle\."), "other").otherwise("personal")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, pos, line of each line that isn't blank or a heading; what stands before any heading is unknown."""
    return docs.select("doc_id", F.explode(section_lines(F.col("text"))).alias("r")).select("doc_id", "r.section", "r.pos", "r.line")


def section_lines(x: Column) -> Column:
    """array<struct<section, pos, line>> of a text: each heading's range of lines is cut out, linear in them; nothing is shuffled."""

    def read(raw: Column, i: Column) -> Column:
        return F.struct(F.trim(raw).alias("line"), i.alias("pos"), F.lower(F.trim(F.regexp_extract(raw, HEADING, 1))).alias("h"))

    def headed(e: Column, i: Column) -> Column:
        key = F.coalesce(*[F.when(e["h"].rlike(p), F.lit(k)) for p, k in KEYS], e["h"])
        return F.when(e["h"] != "", F.struct(key.alias("key"), (i + 1).alias("at")))

    def of(lines: Column) -> Column:
        def part(heads: Column, h: Column, j: Column) -> Column:
            end = F.coalesce(F.try_element_at(heads, j + 2)["at"] - 1, F.size(lines))
            return F.transform(F.slice(lines, h["at"] + 1, end - h["at"]), lambda e: F.struct(h["key"].alias("section"), e["pos"].alias("pos"), e["line"].alias("line")))

        first = F.array(F.struct(F.lit("unknown").alias("key"), F.lit(0).alias("at")))
        heads = F.concat(first, F.filter(F.transform(lines, headed), lambda h: h.isNotNull()))
        return text.bound(heads, lambda heads: F.flatten(F.transform(heads, lambda h, j: part(heads, h, j))))

    return text.bound(F.filter(F.transform(F.split(x, "\n"), read), lambda e: e["line"] != ""), of)


def skills(lines: Column) -> Column:
    """Tokens (2 to 60 characters) of the first 200 lines that hold two commas or semicolons, or name a skill."""
    some = F.filter(F.slice(lines, 1, 200), lambda s: (F.regexp_count(s, F.lit("[,;]")) >= 2) | s.rlike(SKILL))
    tokens = F.flatten(F.transform(some, lambda s: F.transform(F.split(F.translate(s, ";|", ",,"), ","), text.norm_space)))
    return text.ordered_distinct(F.filter(tokens, lambda t: F.length(t).between(2, 60)), F.lower)


def certificates(lines: Column) -> Column:
    return text.ordered_distinct(F.filter(F.transform(F.slice(lines, 1, 200), text.norm_space), lambda s: s.rlike(CERTIFICATE)), F.lower)


def education(lines: Column) -> Column:
    """Blocks of lines, a new one at each line with a range of years; those with two signals or more stay."""
    none = F.array().cast("array<string>")
    new = lambda s: s.rlike(rf"{YEARS}\s*[-–]\s*{YEARS}")

    def step(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        return F.when((F.size(a) == 0) | new(s), F.concat(a, F.array(s))).otherwise(F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(last, F.lit(" "), s))))

    blocks = F.aggregate(F.slice(lines, 1, 250), none, step)
    return F.filter(blocks, lambda b: F.regexp_count(b, F.lit(EDUCATION)) + F.regexp_count(b, F.lit(YEARS)) >= 2)


def contacts(docs: DataFrame) -> DataFrame:
    """doc_id, email, phones, links, and how sure of each: from the first 140 lines that aren't blank."""
    head = F.array_join(F.slice(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != ""), 1, 140), " ")
    return _contacts(docs.select("doc_id", "text"), head).drop("text")


def _contacts(docs: DataFrame, head: Column) -> DataFrame:
    d = docs.withColumn("h", head)
    email = F.nullif(F.regexp_extract("h", EMAIL, 0), F.lit(""))
    phones = text.ordered_distinct(F.filter(F.transform(F.regexp_extract_all("h", F.lit(PHONE), F.lit(0)), text.phone_digits), lambda p: p.isNotNull()))
    bare = F.transform(F.filter(F.regexp_extract_all("h", F.lit(DOMAIN), F.lit(0)), is_domain), lambda u: F.concat(F.lit("https://"), u))
    links = text.ordered_distinct(F.concat(F.regexp_extract_all("h", F.lit(URL), F.lit(0)), bare))
    out = d.select(*docs.columns, email.alias("email"), phones.alias("phones"), links.alias("links"))
    sure = lambda c, v: F.when(c, v).otherwise(0.0)
    return out.select("*", sure(F.col("email").isNotNull(), 0.99).alias("email_confidence"), sure(F.size("phones") > 0, 0.9).alias("phone_confidence"), sure(F.size("links") > 0, 0.9).alias("link_confidence"))


def quality(profile: DataFrame) -> DataFrame:
    """Flags of what a profile holds; has_links is true whatever the links are."""
    return profile.select("doc_id", F.col("email").isNotNull().alias("has_email"), (F.size("phones") > 0).alias("has_phone"), F.lit(True).alias("has_links"))


def header_name(lines: Column, file_name: Column | None = None) -> Column:
    """struct<value, confidence>: the first of 30 lines that is two to four words of letters; else the file's name without its ending."""
    words = r"[A-Za-zÄÖÜäöüß\-]{2,}"
    like = lambda s: (F.length(s) <= 60) & s.rlike(rf"^{words}(?:\s+{words}){{1,3}}$") & ~F.lower(s).rlike("|".join(NO_NAMES)) & ~F.lower(s).contains("http")
    name = F.try_element_at(F.filter(F.transform(F.slice(lines, 1, 30), text.trimmed), like), F.lit(1))
    name = F.array_join(F.transform(F.split(name, r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")
    found = F.when(name.isNotNull(), F.struct(name.alias("value"), F.lit(0.75).alias("confidence")))
    if file_name is None:
        return F.coalesce(found, F.lit(None).cast(SURE))
    stem = text.norm_space(F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), "[_-]+", " "))
    return F.coalesce(found, F.when(stem != "", F.struct(stem.alias("value"), F.lit(0.55).alias("confidence"))))


def header_place(lines: Column) -> Column:
    """struct<value, confidence>: the first of 60 lines that names the country or looks like a place; a line that is a name looks like one, too."""
    short = lambda s: (s != "") & (F.length(s) <= 40) & ~s.contains("@") & ~s.rlike("[0-9]") & ~F.lower(s).rlike("http|" + "|".join(p.replace(".", "[.]") for p in NO_PLACES))
    like = F.filter(F.transform(F.slice(lines, 1, 60), text.trimmed), lambda s: short(s) & (s.rlike(COUNTRY) | s.rlike(PLACE_LINE)))
    place = F.try_element_at(like, F.lit(1))
    return F.when(place.isNotNull(), F.struct(place.alias("value"), F.when(place.rlike(COUNTRY), 0.75).otherwise(0.6).alias("confidence")))


def links_by_class(links: Column) -> Column:
    """struct<linkedin, xing, github, gitlab, other, personal>: the first of the first two, all of the others."""
    of = lambda k: F.filter(links, lambda u: link_class(u) == k)
    return F.struct(*[F.try_element_at(of(k), F.lit(1)).alias(k) for k in ("linkedin", "xing")], *[of(k).alias(k) for k in ("github", "gitlab", "other", "personal")])


def months_by_technology(chunks: Column) -> Column:
    """array<struct<technology, months, years>> of chunks (technologies, months), most months first, equals by name."""
    names = F.array_distinct(F.flatten(F.transform(chunks, lambda c: c["technologies"])))
    total = lambda t: F.aggregate(F.filter(chunks, lambda c: F.array_contains(c["technologies"], t)), F.lit(0), lambda a, c: a + F.coalesce(c["months"].cast("int"), F.lit(0)))
    order = F.array_sort(F.transform(names, lambda t: F.struct((-total(t)).alias("n"), F.lower(t).alias("k"), t.alias("technology"))))
    return F.transform(order, lambda s: F.struct(s["technology"], (-s["n"]).alias("months"), F.round(-s["n"] / 12.0, 2).alias("years")))


def converted(docs: DataFrame, asof: str, raw_chars: int = 0) -> DataFrame:
    """A profile of each document (doc_id, text, and file_name if there is one), by rules alone: one projection, no shuffle.

    doc_id, asof_used, core_profile, timeline_chunks, technology_months, skills, education, certifications, quality_report,
    and the first raw_chars characters of the text if that is over zero. A null text gives empty lists.
    """
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    head = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    d = d.select("*", F.slice(head, 1, 140).alias("_head"), section_lines(F.col("text")).alias("_lines"), timeline.chunks_of(F.col("text"), asof).alias("_chunks"))
    name = header_name(F.col("_head"), F.col("file_name") if "file_name" in docs.columns else None)
    d = _contacts(d, F.array_join("_head", " ")).select("*", name.alias("_name"), header_place(F.col("_head")).alias("_place"))

    def chunk(c: Column) -> Column:
        hb = timeline.header_and_body(c["lines"])
        return F.struct(
            c["start_date"].alias("start_date"), c["end_date"].alias("end_date"), dates.months_inclusive(c["start_date"], c["end_date"]).alias("months"), hb["header"].alias("header_lines"), hb["body"].alias("body_lines"),
            timeline.technologies_of(c["lines"]).alias("technologies"), c["pages"].alias("source_pages"),
        )

    of = lambda k: F.transform(F.filter("_lines", lambda r: r["section"] == k), lambda r: r["line"])
    d = d.select("*", F.transform("_chunks", chunk).alias("timeline_chunks"), skills(of("skills")).alias("skills"), education(of("education")).alias("education"), certificates(of("certifications")).alias("certifications"))
    d = d.withColumn("technology_months", months_by_technology(F.col("timeline_chunks")))
    has = lambda k: F.exists("_lines", lambda r: r["section"] == k)
    flags = F.struct(
        (F.size("timeline_chunks") > 0).alias("has_timeline_chunks"), (F.size("technology_months") > 0).alias("has_tech_months"), F.col("email").isNotNull().alias("has_email"), (F.size("phones") > 0).alias("has_phone"),
        F.lit(True).alias("has_links"), has("skills").alias("has_skills_section"), has("education").alias("has_education_section"), has("certifications").alias("has_certs_section"),
    )
    some = lambda c, v: F.when(F.size(c) > 0, v).otherwise(0.0)
    confidence = F.struct(
        "email_confidence", "phone_confidence", "link_confidence", F.coalesce("_name.confidence", F.lit(0.0)).alias("name_confidence"), F.coalesce("_place.confidence", F.lit(0.0)).alias("place_confidence"),
        some("skills", 0.6).alias("skills"), some("education", 0.6).alias("education"), some("certifications", 0.7).alias("certifications"),
    )
    core = F.struct(F.col("_name.value").alias("name"), F.col("_place.value").alias("place"), "email", "phones", "links", links_by_class(F.col("links")).alias("links_by_class"))
    raw = [F.when(F.length("text") > raw_chars, F.concat(F.substring("text", 1, raw_chars), F.lit("\n... [TRIMMED]\n"))).otherwise(F.col("text")).alias("raw_text")] if raw_chars else []
    return d.select("doc_id", F.lit(asof).alias("asof_used"), core.alias("core_profile"), "timeline_chunks", "technology_months", "skills", "education", "certifications", F.struct(flags.alias("flags"), confidence.alias("confidence")).alias("quality_report"), *raw)
