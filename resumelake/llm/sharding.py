"""Sharding by sampled splitters: shards of nearly equal bytes over the order of (hash of the text, doc_id).

A size-weighted sample of keys gives quantile boundaries; every row is put in
the range between two of them; ranges that turn out overfull are subdivided
with a sample of their own rows until none is. Exact sums of each range's
bytes and rows then place each row on the line of all bytes, and the line is
cut in equal lengths. Equal texts are neighbours on it, so that a group of
them is in one shard, or in neighbouring ones where a cut falls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resumelake.llm.shared import plain, settled

#: Ranges at least for each shard, rows' bytes aimed at in a range, ranges beyond which ranges grow instead, sampled keys for each range:
#: so that what the driver holds doesn't grow with the table.
RANGES_PER_SHARD, RANGE_BYTES, RANGES, SAMPLES = 4, 64 << 20, 4096, 40
#: A range is overfull beyond this many times the mean; rounds of subdivision at most (a single key can't be split).
OVERFULL, ROUNDS = 2.0, 6


def _placed(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """rows with `range`: the number of boundaries (h, doc_id) that are not above the row's key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = np.rec.fromarrays([pdf["h"].to_numpy(np.int64), pdf["doc_key"].to_numpy(np.int64)], names="h,d")
            at = np.searchsorted(bounds["h"], keys["h"], side="left")
            end = np.searchsorted(bounds["h"], keys["h"], side="right")
            for i in np.flatnonzero(end > at):  # equal hashes: doc_id decides
                at[i] += np.searchsorted(bounds["d"][at[i] : end[i]], keys["d"][i], side="right")
            pdf["range"] = at.astype(np.int64)
            yield pdf

    return rows.mapInPandas(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", range long")


def _sampled(rows: DataFrame, total: int, want: int, ranges: list[int] | None) -> np.ndarray:
    """Keys drawn with a chance in proportion to size; about want of them, by a hash of the row's key."""
    if ranges is not None:
        rows = rows.where(F.col("range").isin(ranges))
    u = F.pmod(F.xxhash64("h", "doc_key", F.lit(len(ranges or []))), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(u < F.col("size") * float(want) / max(total, 1)).select("h", "doc_key").collect()
    out = np.array([(r["h"], r["doc_key"]) for r in got], dtype=[("h", "<i8"), ("d", "<i8")])
    return np.sort(out, order=["h", "d"])


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) of each row of docs (doc_id, text).

    size: UTF-8 bytes of the text and 16; a null text has none and counts as
    the empty one. Rows repeated with one doc_id are placed one by one; a
    null doc_id comes first among its equals. With fewer rows than shards,
    some shards are empty; an empty table gives an empty result. Other columns are left aside.
    """
    text = F.coalesce("text", F.lit(""))
    rows = settled(
        plain(docs, ["doc_id", "text"]).select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc_key"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = max(RANGES_PER_SHARD * shards, min(RANGES, total // RANGE_BYTES))
    keys = _sampled(rows, total, ranges * SAMPLES, None)
    bounds = np.unique(keys[[len(keys) * k // ranges for k in range(1, ranges)]]) if len(keys) else keys
    for _ in range(ROUNDS):
        placed = _placed(rows, bounds)
        sums = {r["range"]: r["size"] for r in placed.groupBy("range").agg(F.sum("size").alias("size")).collect()}
        over = [k for k, v in sums.items() if v > OVERFULL * total / ranges]
        if not over:
            break
        heavy = sum(sums[k] for k in over)
        more = _sampled(placed, heavy, SAMPLES * -(-heavy * ranges // total), over)
        finer = np.unique(np.concatenate([bounds, more[SAMPLES // 2 :: SAMPLES]]))
        if len(finer) == len(bounds):
            break
        bounds = finer
    placed = _placed(rows, bounds)
    base, spans = [0, 0], []
    for r in placed.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("range").collect():
        spans.append((r["range"], *base))
        base = [base[0] + r["size"], base[1] + r["n"]]
    at = rows.sparkSession.createDataFrame(spans, "range long, bytes_before long, rows_before long")
    w = Window.partitionBy("range").orderBy("h", "doc_key", "size", "text_crc32")
    line = placed.join(F.broadcast(at), "range")  # a row for each range: at most ranges and what they were subdivided into
    line = line.withColumn("rank", F.row_number().over(w) - 1 + F.col("rows_before"))
    line = line.withColumn("mid", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2 + F.col("bytes_before"))
    line = settled(line.select("doc_id", "size", "text_crc32", F.least(F.floor(F.col("mid") * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard"), "rank"))
    first = line.groupBy("shard").agg(F.min("rank").alias("first"))
    return line.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
