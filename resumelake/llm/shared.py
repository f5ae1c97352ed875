"""What the operators of this subpackage share: the shared folder, checkpoints and small column helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z only, in UTF-8 bytes.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


#: Rows that go to a Python worker at a time: whole texts are long.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def lean(spark: SparkSession) -> SparkSession:
    """spark, with batches of whole texts that stay small (for its session); a size set by the user, whatever it is, stays."""
    name, ours = ARROW_ROWS
    if name not in spark.conf.getAll:
        spark.conf.set(name, ours)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (on a local master only) a temporary one that is then set."""
    lean(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="resumelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return lean(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def plain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns of df (any other column, whatever its name, stays out of the way)."""
    return df.select(*columns)


#: A key with more rows than this many, and than one row in HOT_SHARE, is met apart: at most HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 100_000, 10_000


def met_again(rows: DataFrame, keyed: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows joined with keyed (a row for each key, with the number of its rows in `rows`); frequent keys are sent to all tasks instead of all their rows to one.

    Frequent keys are HOT_SHARE at most, whatever the tables' sizes.
    """
    total = keyed.agg(F.sum("rows")).first()[0] or 0
    bound = max(HOT_ROWS, total // HOT_SHARE)
    hot = keyed.where(F.col("rows") > bound)
    if not hot.limit(1).count():
        return rows.join(keyed, list(key))
    apart = rows.join(F.broadcast(hot.select(*key)), list(key), "left_anti").join(keyed.where(F.col("rows") <= bound), list(key))
    return rows.join(F.broadcast(hot), list(key)).unionByName(apart)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and 09-0D of the text, A-Z in lower case; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
