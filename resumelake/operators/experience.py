"""Months of experience with each technology, and searches on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resumelake.functions.dates import end_number, months_exclusive, months_inclusive
from resumelake.functions.text import technology_key


def mentions(entries: DataFrame) -> DataFrame:
    """A row for each technology of each entry (doc_id, seq, kind, start_date, end_date, is_current, technologies)."""
    return entries.withColumn("technology", F.explode("technologies")).withColumn("technology", technology_key(F.col("technology"))).where("technology <> ''")


def technology_experience(entries: DataFrame, asof: str) -> DataFrame:
    """doc_id, technology, total_months, experience_count, project_count, last_used_date, is_current.

    Months are exclusive; entries that overlap count each; a technology named twice in an entry counts
    twice. Only work experience makes a technology current. The last date is the first of the latest ends.
    """
    m = mentions(entries).withColumn("months", months_exclusive(F.col("start_date"), F.col("end_date"), asof))
    work = F.col("kind") == "experience"
    until = F.when((F.col("end_date") != "") & end_number(F.col("end_date"), asof).isNotNull() & F.col("end_date").isNotNull(), F.struct(end_number(F.col("end_date"), asof).alias("n"), (-F.col("seq")).alias("s")))
    return (
        m.withColumn("until", until)
        .groupBy("doc_id", "technology")
        .agg(
            F.sum("months").cast("long").alias("total_months"),
            F.count_if(work).alias("experience_count"),
            F.count_if(~work).alias("project_count"),
            F.coalesce(F.max_by("end_date", "until"), F.lit("")).alias("last_used_date"),
            F.coalesce(F.bool_or(work & F.col("is_current")), F.lit(False)).alias("is_current"),
        )
    )


def technology_months(chunks: DataFrame) -> DataFrame:
    """doc_id, technology, months, years: inclusive months of chunks (doc_id, start_date, end_date, technologies), in no order."""
    once = F.array_distinct("technologies")
    m = chunks.withColumn("technology", F.explode(once)).groupBy("doc_id", "technology").agg(F.sum(months_inclusive(F.col("start_date"), F.col("end_date"))).alias("months"))
    return m.withColumn("years", F.round(F.col("months") / 12.0, 2))


def months_wanted(min_months: int | None, min_years: float | None) -> int | None:
    """Least months; years, if given, take the place of months."""
    return int(min_years * 12) if min_years is not None else min_months


def technology_filter(experience: Column, technologies: list[str] | None = None, min_months: int | None = None, min_years: float | None = None) -> Column:
    """Whether one and the same element names a technology and has the months."""
    names, least = [t.strip().lower() for t in technologies or []], months_wanted(min_months, min_years)
    if not names and least is None:
        return F.lit(True)
    return F.exists(experience, lambda x: (x["technology"].isin(names) if names else F.lit(True)) & (x["total_months"] >= least if least is not None else F.lit(True)))


def search(index: DataFrame, technologies: list[str], min_months: int | None = None, min_years: float | None = None, size: int = 10, start: int = 0) -> DataFrame:
    """doc_id, months of the documents that pass technology_filter, by their most months with a wanted technology."""
    names, least = [t.strip().lower() for t in technologies], months_wanted(min_months, min_years) or 0
    best = F.array_max(F.transform(F.filter("technology_experience", lambda x: x["technology"].isin(names) & (x["total_months"] >= least)), lambda x: x["total_months"]))
    hits = index.where(technology_filter(F.col("technology_experience"), technologies, min_months, min_years))  # before the top-k
    return hits.select("doc_id", best.alias("months")).orderBy(F.desc("months"), "doc_id").offset(start).limit(size)
