"""Sources and sinks: text, JSON and binary documents in; an index table kept by key out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resumelake.schema import CV


def binary_documents(spark: SparkSession, path: str, extract: Callable[[bytes, str], str], glob: str = "*") -> DataFrame:
    """path, text of files, by a given extractor (PDF and DOCX readers aren't part of this package); a file it can't read has null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for content, name in zip(pdf["content"], pdf["path"], strict=True):
                try:
                    out.append(extract(bytes(content), name))
                except Exception:  # whatever a reader raises on a file that it can't read
                    out.append(None)
            yield pd.DataFrame({"path": pdf["path"], "text": pd.Series(out, index=pdf.index, dtype=object)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string")


def cv_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name without its ending), file_name, cv of *.json files: the whole file, or its llm_json; cv is null if neither can be read."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path).withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    enveloped = F.get_json_object("value", "$.llm_json")
    cv = F.from_json(F.coalesce(enveloped, F.col("value")), CV)
    readable = F.get_json_object("value", "$").isNotNull()
    return files.select(F.regexp_replace("file_name", r"\.json$", "").alias("doc_id"), "file_name", F.when(readable, cv).alias("cv"))


def upserted(table: DataFrame, changes: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """table with changes: the row with the largest order of each key; of several with one order, the one with the larger hash of all its columns."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.xxhash64(*[F.to_json(F.struct(c)) for c in table.columns])))
    return table.unionByName(changes).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def deleted(table: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def by_id(table: DataFrame, value, key: str = "doc_id") -> DataFrame:
    return table.where(F.col(key) == value)


def create_index(spark: SparkSession, name: str, schema: str, force: bool = False) -> bool:
    """False if the table exists; force drops it first."""
    if force:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if spark.catalog.tableExists(name):
        return False
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet")
    return True


def indexed(spark: SparkSession, path: str) -> DataFrame | None:
    """The index that index_batch wrote last; None if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = sorted(p.getName() for p in done if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None


def index_batch(docs: DataFrame, path: str, key: str = "doc_id", shown: int = 100) -> dict:
    """Upserts documents with a cv by their key; {indexed, failed, errors}: errors are the keys of up to `shown` documents without a cv.

    A new version of the index is written beside the old one and counts once it is whole: a batch that fails, or is run again, changes nothing else.
    """
    spark = docs.sparkSession
    held = indexed(spark, path)
    good = docs.where("cv is not null").dropDuplicates([key])
    failed = docs.where("cv is null")
    merged = good if held is None else held.join(good.select(key), key, "left_anti").unionByName(good)
    number = 0 if held is None else int(held.inputFiles()[0].split("/version=")[1].split("/")[0]) + 1
    merged.write.mode("overwrite").parquet(f"{path}/version={number:08d}")
    return {"indexed": good.count(), "failed": failed.count(), "errors": [r[0] for r in failed.select(key).limit(shown).collect()]}


def to_json_lines(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def refresh(spark: SparkSession, name: str) -> None:
    spark.catalog.refreshTable(name)
