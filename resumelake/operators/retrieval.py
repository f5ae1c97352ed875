"""Lexical (BM25), vector (cosine) and hybrid (reciprocal rank fusion) search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

K1, B, FUSION = 1.2, 0.75, 60


def tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def fuzziness(term: str) -> int:
    """Edits allowed in a term: none up to 2 letters, one up to 5, else two."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def bm25(docs: DataFrame, terms: list[str], field: str = "text") -> DataFrame:
    """doc_id, score (9 digits) of documents with any of the terms.

    One pass counts the terms in each row; only document and length totals are aggregated. Nothing is exploded.
    """
    t = tokens(F.col(field))
    times = lambda w: F.size(F.filter("_t", lambda x: x == w))
    tf = [times(w).alias(f"tf{k}") for k, w in enumerate(terms)]
    rows = docs.select("doc_id", t.alias("_t")).select("doc_id", F.size("_t").alias("dl"), *tf)
    total = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    both = rows.where(" or ".join(f"tf{k} > 0" for k in range(len(terms)))).crossJoin(F.broadcast(total))  # total is one row
    one = lambda k: F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)) * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + K1 * (1 - B + B * F.col("dl") / F.col("avg")))
    return both.select("doc_id", F.round(sum((one(k) for k in range(1, len(terms))), one(0)), 9).alias("score"))


def best_fields(docs: DataFrame, terms: list[str], fields: list[str]) -> DataFrame:
    """doc_id, score: the best of the fields' scores."""
    scores = [bm25(docs, terms, f) for f in fields]
    every = scores[0]
    for s in scores[1:]:
        every = every.unionByName(s)
    return every.groupBy("doc_id").agg(F.max("score").alias("score"))


def top(scores: DataFrame, k: int, start: int = 0) -> DataFrame:
    return scores.orderBy(F.desc("score"), "doc_id").offset(start).limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """doc_id, score (6 digits) of the k nearest rows of vectors (doc_id, embedding) that pass where; exact."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if where is None else vectors.where(where)
    return top(rows.select("doc_id", F.round(cosine(F.col("embedding"), q), 6).alias("score")).where("score is not null"), k)


def fused(first: DataFrame, second: DataFrame, size: int, start: int = 0) -> DataFrame:
    """doc_id, score (9 digits): sum of 1 / (60 + rank) over two lists cut at 2 * size."""
    w = Window.orderBy(F.desc("score"), "doc_id")  # over 2 * size rows
    a, b = (top(x, 2 * size).select("doc_id", F.row_number().over(w).alias(n)) for x, n in ((first, "r1"), (second, "r2")))
    part = lambda r: F.coalesce(F.lit(1.0) / (FUSION + F.col(r)), F.lit(0.0))
    return top(a.join(b, "doc_id", "full_outer").select("doc_id", F.round(part("r1") + part("r2"), 9).alias("score")), size, start)


# English words that a text field's analyzer leaves out.
STOP = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
#: Fields of a CV that a text search looks at (paths of an index row), unless others are given.
FIELDS = ("summary", "experience.description", "experience.company", "experience.role", "projects.role_description", "projects.project_name", "projects.customer", "education.degree", "education.institution", "certifications.title")


def analyzed(x: Column) -> Column:
    """The tokens of a text field: lower case, without stop words. Words aren't stemmed."""
    return F.filter(tokens(x), lambda t: ~t.isin(*STOP))


def flat(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """doc_id and a text column for each field, named by its path; a field inside an array is the text of all its elements."""

    def of(path: str) -> Column:
        value, name = F.col(path), path
        kind = docs.select(value).schema[0].dataType
        return (F.array_join(value, " ") if isinstance(kind, ArrayType) else value).alias(name)

    return docs.select("doc_id", *map(of, fields))


def postings(texts: DataFrame) -> DataFrame:
    """An inverted index of texts (doc_id, and a column for each field): field, term, doc_id, tf, dl, df, n, av, to be kept as a table, sorted by term.

    A query reads the rows of its terms only; n and av are the field's number of documents and mean length.
    """
    fields = [c for c in texts.columns if c != "doc_id"]
    rows = texts.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), analyzed(F.col(f"`{f}`")).alias("t")) for f in fields])).alias("r")).select("doc_id", "r.field", "r.t").withColumn("dl", F.size("t"))
    totals = rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("av"))  # a row for each field
    tf = rows.select("doc_id", "field", "dl", F.explode("t").alias("term")).groupBy("field", "term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    return tf.join(df, ["field", "term"]).join(F.broadcast(totals), "field")


def matched(index: DataFrame, query: str, fuzzy: bool = True) -> DataFrame:
    """doc_id, score of the documents that have any word of a query, in the best of the fields: BM25 over postings.

    fuzzy: a word stands for all terms within its fuzziness in edits, too; each counts less by its edits' share of the
    shorter word. The vocabulary is filtered by length before edits are counted.
    """
    words = list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", query.lower()) if w not in STOP))
    if not words:
        return index.select("doc_id", F.lit(0.0).alias("score")).where("false")
    length = F.length("term")

    def near(w: str) -> Column:
        far = fuzziness(w) if fuzzy else 0
        edits = F.when(F.abs(length - len(w)) <= far, F.levenshtein("term", F.lit(w))) if far else F.when(F.col("term") == w, 0)
        return F.struct(F.lit(w).alias("word"), F.when(edits <= far, 1 - edits / F.least(length, F.lit(len(w)))).alias("boost"))

    hits = F.filter(F.array(*map(near, words)), lambda h: h["boost"] > 0)
    rows = index.where(F.col("term").isin(words) if not fuzzy else F.size(hits) > 0).select("*", F.explode(hits).alias("h"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = F.col("h.boost") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("av")))
    best = rows.select("doc_id", "field", "h.word", one.alias("s")).groupBy("doc_id", "field", "word").agg(F.max("s").alias("s"))
    return best.groupBy("doc_id", "field").agg(F.sum("s").alias("s")).groupBy("doc_id").agg(F.round(F.max("s"), 9).alias("score"))
