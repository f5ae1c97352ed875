"""Structured CVs (schema.CV): repair after extraction, and the rows of the search index."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resumelake.functions import text
from resumelake.operators import experience
from resumelake.schema import TECHNOLOGY

Encoder = Callable[[list[str]], np.ndarray]


def _block(x: Column) -> Column:
    return text.block_clean(F.coalesce(x, F.lit("")))


def _word(x: Column) -> Column:
    return text.trimmed(text.soft_clean(F.coalesce(x, F.lit(""))))


def _each(xs: Column, **fields: Callable[[Column], Column]) -> Column:
    """An array of structs with fields set anew; a null array stays null."""

    def one(x: Column) -> Column:
        for name, f in fields.items():
            x = x.withField(name, f(x))
        return x

    return F.transform(xs, one)


def description(x: Column) -> Column:
    """An entry's description as text or list; if it has none: its role, its evidence, or role and company."""
    role, company, evidence = _word(x["role"]), _word(x["company"]), _block(x["evidence"])
    heading = F.array_join(F.filter(F.array(role, company), lambda s: s != ""), " | ")
    given = text.split_bullets(_block(x["description"]))
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (given, role, evidence, heading)], F.lit(""))


def polished(cv: Column) -> Column:
    """A CV with clean text, no empty description, technologies taken apart, and lists without repeats; a null CV stays null."""
    words = lambda xs: F.array_distinct(F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), _word), lambda s: s != ""))
    skills = F.struct(*[words(cv["skills"][k]).alias(k) for k in ("programming_languages", "technologies", "soft_skills")])
    same = lambda f, *names: {n: (lambda x, n=n: f(x[n])) for n in names}
    out = cv.withField("summary", _block(cv["summary"]))
    out = out.withField("experience", _each(cv["experience"], description=description, technologies=lambda x: text.technologies_split(x["technologies"])))
    out = out.withField("skills", F.when(cv["skills"].isNotNull(), skills))
    out = out.withField("education", _each(cv["education"], **same(_block, "degree", "institution", "location"), **same(_word, "start_date", "end_date")))
    out = out.withField("certifications", _each(cv["certifications"], title=lambda x: _block(x["title"]), evidence=lambda x: F.when(x["evidence"].isNotNull(), _block(x["evidence"]))))
    out = out.withField("languages", _each(cv["languages"], **same(_block, "language", "proficiency")))
    return F.when(cv.isNotNull(), out)


def entries(docs: DataFrame) -> DataFrame:
    """doc_id, seq, kind, start_date, end_date, is_current, technologies of docs (doc_id, cv): jobs, then projects."""
    row = lambda x, kind, current: F.struct(F.lit(kind).alias("kind"), x["start_date"].alias("start_date"), x["end_date"].alias("end_date"), current.alias("is_current"), x["technologies"].alias("technologies"))
    none = F.array().cast("array<struct<kind:string,start_date:string,end_date:string,is_current:boolean,technologies:array<string>>>")
    jobs = F.coalesce(F.transform("cv.experience", lambda x: row(x, "experience", F.coalesce(x["is_current"], F.lit(False)))), none)
    projects = F.coalesce(F.transform("cv.projects", lambda x: row(x, "project", F.lit(False))), none)
    return docs.select("doc_id", F.posexplode(F.concat(jobs, projects)).alias("seq", "e")).select("doc_id", "seq", "e.*")


def hashed_words(size: int = 384) -> Encoder:
    """A stand-in for a sentence model: signed counts of hashed words, of length one."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                row[h % size] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embedder(load: Callable[[], Encoder] = hashed_words, size: int = 384):
    """A column function: the vector of a text by the encoder that load gives, loaded once a worker; zeros for null and blank texts."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            texts = s.fillna("")
            some = texts.str.strip() != ""
            out = np.zeros((len(s), size), dtype=np.float32)
            if some.any():
                out[some.to_numpy()] = encode(texts[some].tolist())
            yield pd.Series(list(out), index=s.index)

    return embed


def _joined(xs: Column) -> Column:
    return F.array_join(F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")) != ""), " ")


def index_documents(docs: DataFrame, asof: str, indexed_at: str, load: Callable[[], Encoder] = hashed_words, size: int = 384) -> DataFrame:
    """The index row of each of docs (doc_id, file_name, cv); rows without a cv go.

    The technologies' rows are dealt by doc_id once; their aggregation, the list of each document and the join reuse that.
    """
    good = docs.where("cv is not null").select("doc_id", "file_name", "cv")
    t = experience.technology_experience(entries(good).repartition("doc_id"), asof)
    first = F.struct((-F.col("total_months")).alias("n"), "technology", F.struct("technology", F.col("total_months").cast("int").alias("total_months"), "experience_count", "project_count", "last_used_date", "is_current").alias("t"))
    listed = t.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(first)), lambda x: x["t"]).cast(f"array<{TECHNOLOGY}>").alias("technology_experience"))
    embed = embedder(load, size)
    texts = {"summary": F.coalesce("cv.summary", F.lit("")), "experience_combined": _joined(F.col("cv.experience.description")), "projects_combined": _joined(F.col("cv.projects.role_description"))}
    rows = good.join(listed, "doc_id", "left")
    return rows.select(
        "doc_id", "file_name", F.lit(indexed_at).alias("indexed_at"), F.to_json("cv").alias("full_json"), F.coalesce("cv.summary", F.lit("")).alias("summary"), *[F.col(f"cv.{k}").alias(k) for k in ("experience", "projects", "skills", "education", "certifications", "languages")],
        F.coalesce("technology_experience", F.array().cast(f"array<{TECHNOLOGY}>")).alias("technology_experience"), *[embed(x).alias(f"{k}_embedding") for k, x in texts.items()],
    )
