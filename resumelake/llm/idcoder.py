"""A binary format for token ids: adaptive context mixing drives a range coder, in independent, checksummed blocks.

A segment holds whole documents. Its ids are ranked by frequency (the dictionary
in its header) and cut into blocks of BLOCK ids, whose models all start afresh,
so that any block can be decoded alone. In a block, each id is coded as one symbol of
these: it is what the two ids before it predict (order 2); what the id
before it predicts (order 1); or a bucket of ranks and a place in it (order 0).
The symbol's chances mix adaptive counts under the confidences of both predictions with
the block's order-0 counts; how much each of the two weighs follows from how often it gave the
symbols that came the better chance, in each block by itself. The range coder has 64-bit state and no carries.

All blocks of a segment are coded in step, a numpy operation at a time, which is what
makes an adaptive coder bearable in Python; a block's bytes don't depend on the others.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resumelake.llm.shared import plain, shared_dir
from resumelake.llm.wordpiece import Encoder, vocabulary_path

MAGIC, VERSION = b"RLID", 2
#: Ids in a block, blocks that a segment aims at, slots of a prediction table, bits of all chances of a symbol.
BLOCK, LANES, SLOTS, BITS = 4096, 2048, 4096, 15
#: Added to a count when its symbol comes; the models' tables follow their counts at these steps, then each EVERY.
STEP, EARLY, EVERY = 24, frozenset((8, 16, 32, 64, 128)), 256
#: All weights of the two kinds of counts; each has one at least. Bits of a chance in whole numbers.
WEIGHTS, FINE = 16, 16
_HEAD = struct.Struct("<4sBIIIIQI")
_U = np.uint64


def buckets(size: int) -> np.ndarray:
    """First ranks of the order-0 buckets, and the end: widths grow by about an eighth of the rank."""
    edges = [0]
    while edges[-1] < size:
        edges.append(edges[-1] + max(1, edges[-1] // 5))
    return np.array([*edges[:-1], size] if len(edges) > 1 else [0, 1], dtype=np.int64)


class _Models:
    """The models of all lanes, and the steps that coder and decoder share."""

    def __init__(self, lanes: int, size: int):
        self.lanes, self.edges = lanes, buckets(size)
        self.width = np.diff(self.edges)
        self.symbols = len(self.width) + 2
        zipf = np.log((self.edges[1:] + 8.0) / (self.edges[:-1] + 8.0))
        start = np.concatenate([[2, 2], np.maximum(1, (zipf / zipf.sum() * 200).astype(np.int64))])
        self.count = np.tile(start, (lanes, 9, 1)).astype(np.int32)
        self.all = np.tile(start, (lanes, 1)).astype(np.int32)
        self.cum = np.zeros((lanes * 9, self.symbols + 1), dtype=np.uint16)
        self.table1 = np.zeros(lanes * SLOTS, dtype=np.uint32)  # rank << 4 | confidence; 0: none
        self.table2 = np.zeros(lanes * SLOTS, dtype=np.uint32)
        self.lane = np.arange(lanes, dtype=np.int64)
        self.base = self.lane * SLOTS
        self.before = np.zeros((2, lanes), dtype=np.int64)
        self.level = np.array([0, 1, 1, *[2] * 13], dtype=np.int64)
        self.room = (1 << BITS) - self.symbols
        self.rank_of = np.repeat(np.arange(len(self.width)), self.width)
        self.order = np.arange(1, self.symbols + 1)
        self.wins, self.since = np.zeros((2, lanes), dtype=np.int64), []
        self.follow()

    def follow(self) -> None:
        """Chances from the counts: those in the context and the block's own, weighed by which of them did better before. Whole numbers, under 2 ** 47 before a division, so floors of quotients in double precision are exact: the same on any machine."""
        if self.since:
            at, symbol = (np.concatenate(x) for x in zip(*self.since, strict=True))
            better = (self.own.reshape(-1)[at] > self.general.reshape(-1)[symbol]).reshape(len(self.since), -1).sum(0)
            self.wins[0] = (self.wins[0] + 1 >> 1) + better
            self.wins[1] = (self.wins[1] + 1 >> 1) + len(self.since)
            self.since = []
        weight = np.clip((self.wins[0] * WEIGHTS + (self.wins[1] >> 1)) // np.maximum(self.wins[1], 1), 1, WEIGHTS - 1)
        weight[self.wins[1] == 0] = WEIGHTS * 3 // 4
        self.own, self.general = (np.floor(x * float(1 << FINE) / x.sum(-1, dtype=np.int64)[..., None]) for x in (self.count, self.all))
        mixed = self.own * weight[:, None, None] + (self.general * (WEIGHTS - weight)[:, None])[:, None]
        total = np.cumsum(mixed.reshape(-1, self.symbols), axis=1)
        total *= self.room
        total /= total[:, -1:] / self.room
        self.cum[:, 1:] = np.floor(total) + self.order

    def predict(self) -> None:
        one, two = self.before
        self.at1 = self.base + (one & (SLOTS - 1))
        self.at2 = self.base + ((one * 0x9E5 + two * 0x3B1 + 1) & (SLOTS - 1))
        self.seen1, self.seen2 = self.table1.take(self.at1).astype(np.int64), self.table2.take(self.at2).astype(np.int64)
        self.context = self.lane * 9 + self.level.take(self.seen2 & 15) * 3 + self.level.take(self.seen1 & 15)
        self.guess1, self.guess2 = self.seen1 >> 4, self.seen2 >> 4

    def symbol_of(self, rank: np.ndarray) -> np.ndarray:
        hit2 = (self.guess2 == rank) & (self.seen2 > 0)
        hit1 = (self.guess1 == rank) & (self.seen1 > 0)
        return np.where(hit2, 0, np.where(hit1, 1, self.rank_of.take(rank) + 2))

    def learn(self, rank: np.ndarray, symbol: np.ndarray, step: int) -> None:
        own, general = self.context * self.symbols + symbol, self.lane * self.symbols + symbol
        self.since.append((own, general))
        self.count.reshape(-1)[own] += STEP
        self.all.reshape(-1)[general] += STEP
        for table, at, seen, guess in ((self.table1, self.at1, self.seen1, self.guess1), (self.table2, self.at2, self.seen2, self.guess2)):
            sure = seen & 15
            table[at] = np.where((guess == rank) & (sure > 0), seen + (sure < 15), np.where(sure > 1, seen - (sure + 1 >> 1), rank << 4 | 1))
        self.before[1] = self.before[0]
        self.before[0] = rank
        if step in EARLY or step % EVERY == EVERY - 1:
            self.follow()


_TOP, _BOTTOM = _U(1 << 48), _U(1 << 32)


def _shift(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose upper 16 bits are settled; a span too small is cut so that they are."""
    settled = (low ^ (low + span)) < _TOP
    small = ~settled & (span < _BOTTOM)
    if small.any():
        span[small] = (_U(0) - low[small]) & (_BOTTOM - _U(1))
        settled |= small
    return np.flatnonzero(settled)


def code(ranks: np.ndarray, size: int) -> list[bytes]:
    """The bytes of each block (a row of ranks under size)."""
    lanes, steps = ranks.shape
    models = _Models(lanes, size)
    low, span = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    out, fill = np.zeros((lanes, 2 * steps + 16), np.uint16), np.zeros(lanes, np.int64)
    columns = np.ascontiguousarray(ranks.T).astype(np.int64)
    width = models.cum.shape[1]
    flat = models.cum.reshape(-1)
    for step in range(steps):
        rank = columns[step]
        models.predict()
        symbol = models.symbol_of(rank)
        at = models.context * width + symbol
        start = flat.take(at)
        r = span >> _U(BITS)
        low += start.astype(_U) * r
        span = (flat.take(at + 1) - start).astype(_U) * r
        b = np.maximum(symbol - 2, 0)
        wide = np.where(symbol > 1, models.width[b], 1)
        r = span // wide.astype(_U)
        low += np.where(symbol > 1, rank - models.edges[b], 0).astype(_U) * r
        span = r
        while len(i := _shift(low, span)):
            out[i, fill[i]] = (low[i] >> _U(48)).astype(np.uint16)
            fill[i] += 1
            low[i] <<= _U(16)
            span[i] <<= _U(16)
        models.learn(rank, symbol, step)
    for _ in range(4):
        out[np.arange(lanes), fill] = (low >> _U(48)).astype(np.uint16)
        fill += 1
        low <<= _U(16)
    out = out.astype("<u2")
    return [out[k, : fill[k]].tobytes() for k in range(lanes)]


def decode(blocks: list[bytes], size: int, steps: int) -> np.ndarray:
    """The ranks of each block, steps of them in a row."""
    lanes = len(blocks)
    models = _Models(lanes, size)
    words = np.zeros((lanes, max(map(len, blocks)) // 2 + 8), np.uint16)
    for k, b in enumerate(blocks):
        words[k, : len(b) // 2] = np.frombuffer(b, dtype="<u2")
    low, span, value, fill = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U), np.zeros(lanes, _U), np.full(lanes, 4)
    for k in range(4):
        value = value << _U(16) | words[:, k].astype(_U)
    out = np.zeros((steps, lanes), np.int64)
    most, width = _U((1 << BITS) - 1), models.cum.shape[1]
    for step in range(steps):
        models.predict()
        r = span >> _U(BITS)
        v = np.minimum((value - low) // r, most).astype(np.uint16)
        rows = models.cum.take(models.context, axis=0)
        symbol = (rows[:, 1:] > v[:, None]).argmax(1)
        at = models.lane * width + symbol
        start, stop = rows.reshape(-1).take(at), rows.reshape(-1).take(at + 1)
        low += start.astype(_U) * r
        span = (stop - start).astype(_U) * r
        b = np.maximum(symbol - 2, 0)
        wide = np.where(symbol > 1, models.width[b], 1).astype(_U)
        r = span // wide
        place = np.minimum((value - low) // r, wide - _U(1))
        low += place * r
        span = r
        rank = np.where(symbol == 0, models.guess2, np.where(symbol == 1, models.guess1, models.edges[b] + place.astype(np.int64)))
        out[step] = rank
        while len(i := _shift(low, span)):
            value[i] = value[i] << _U(16) | words[i, np.minimum(fill[i], words.shape[1] - 1)].astype(_U)
            fill[i] += 1
            low[i] <<= _U(16)
            span[i] <<= _U(16)
        models.learn(rank, symbol, step)
    return out.T


def pack_segment(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A segment's bytes: header, documents, dictionary, block table, blocks; each part with a crc32."""
    freq = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    used = np.flatnonzero(freq)
    used = used[np.lexsort((used, -freq[used]))]
    place = np.zeros(len(freq), np.int64)
    place[used] = np.arange(len(used))
    steps = min(BLOCK, max(len(ids), 1))
    lanes = -(-len(ids) // steps)
    ranks = np.zeros(lanes * steps, np.int64)
    ranks[: len(ids)] = place[ids]
    blocks = code(ranks.reshape(lanes, steps), max(len(used), 1)) if lanes else []
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "<u1").tobytes() + np.array(sizes, "<u4").tobytes()
    meta = zlib.compress(docs + used.astype("<u4").tobytes(), 6)
    raw = ids.astype("<u4")
    rows = b"".join(struct.pack("<III", len(part := raw[k * steps : (k + 1) * steps]), len(b), zlib.crc32(part.tobytes())) for k, b in enumerate(blocks))
    head = _HEAD.pack(MAGIC, VERSION, len(doc_ids), len(used), lanes, steps, len(ids), len(meta))
    body = head + meta + rows
    return body + struct.pack("<I", zlib.crc32(body)) + b"".join(blocks)


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, and all ids of a segment; ValueError if any checksum fails."""
    magic, version, n_docs, n_used, lanes, steps, n_ids, n_meta = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this version")
    end = _HEAD.size + n_meta + 12 * lanes
    if struct.unpack_from("<I", data, end)[0] != zlib.crc32(data[:end]):
        raise ValueError("a segment's header is damaged")
    meta = zlib.decompress(data[_HEAD.size : _HEAD.size + n_meta])
    numbers = np.frombuffer(meta, "<i8", n_docs).tolist()
    none = np.frombuffer(meta, "<u1", n_docs, 8 * n_docs)
    sizes = np.frombuffer(meta, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    used = np.frombuffer(meta, "<u4", n_used, 13 * n_docs)
    rows = np.frombuffer(data, "<u4", 3 * lanes, _HEAD.size + n_meta).reshape(lanes, 3)
    at = end + 4 + np.concatenate([[0], np.cumsum(rows[:, 1])]).astype(np.int64)
    ids = np.zeros(0, "<u4")
    if lanes:
        ranks = decode([data[at[k] : at[k + 1]] for k in range(lanes)], max(n_used, 1), steps)
        ids = used[np.minimum(ranks.reshape(-1)[:n_ids], n_used - 1)]
    for k in range(lanes):
        if zlib.crc32(ids[k * steps : k * steps + rows[k, 0]].tobytes()) != rows[k, 2]:
            raise ValueError(f"block {k} is damaged")
    return [None if x else d for d, x in zip(numbers, none, strict=True)], sizes, ids


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Writes the ids of docs (doc_id, text), each text's followed by end_id, to path, in ascending order of doc_id.

    The files are Parquet with a segment in each row: part, segment, before (ids before it in its
    part), n_ids, data. Null texts count as empty; a null doc_id comes first; rows repeated are written each;
    an empty table gives files without segments. Other columns are left aside.
    """
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), Encoder(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        doc_ids, sizes, ids, waiting, before, number = [], [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            data = pack_segment(doc_ids, sizes, np.frombuffer(b"".join(ids), "<u4"))
            cols = [pa.array([x], pa.int64()) for x in (part, number, before, waiting)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([data], pa.binary())], names=["part", "segment", "before", "n_ids", "data"])

        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                for doc_id, got in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist()), strict=True):
                    doc_ids.append(doc_id)
                    sizes.append(len(got) // 4 + 1)
                    ids += (got, end)
                    waiting += sizes[-1]
                    if waiting >= LANES * BLOCK:
                        yield out()
                        doc_ids, sizes, ids, before, number, waiting = [], [], [], before + waiting, number + 1, 0
        if doc_ids:
            yield out()

    rows = plain(docs, ["doc_id", "text"]).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(run, "part long, segment long, before long, n_ids long, data binary").write.mode("overwrite").parquet(path)


def read(spark, path: str, keep: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (keep: and ids, little-endian unsigned 32-bit) of each document in files that write() made."""
    files = spark.read.parquet(path)
    total, bases = 0, []
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each task that wrote
        bases.append((r["part"], total))
        total += r["n"]
    base = spark.createDataFrame(bases, "part long, base long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data in zip(b.column("first").to_pylist(), b.column("data").to_pylist(), strict=True):
                doc_ids, sizes, ids = unpack_segment(data)
                ends = np.cumsum(sizes)
                parts = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * keep, names=[c.split()[0] for c in schema.split(", ")])

    return files.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("first"), "data").mapInArrow(run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """docs' ids, written to the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, path)
    return read(spark, path)
