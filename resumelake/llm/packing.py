"""Bounded-space online packing of token ids into sequences of a fixed length.

Each partition keeps a fixed number of open windows and takes documents as they
come: whole windows are cut off a long document at once; what is left goes into
the window that it fills best. If it fits in none, the fullest window is
emitted, topped up with a cut from the piece unless the gap is under min_piece.
Windows still open at the end are merged over groups of partitions, level by
level; the last rest of all becomes sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resumelake.llm.shared import plain, settled
from resumelake.llm.wordpiece import Encoder, vocabulary_path

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long, open boolean"
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in PIECE.split(", "))])
#: Partitions, or groups of them, that a merge puts together.
FAN_IN = 64
_LEVEL, _PART = 1 << 56, 1 << 26


class Packer:
    """Places pieces (doc_id, start, doc_tokens, ids as bytes) in windows of size ids; full ones go to self.out."""

    def __init__(self, size: int, windows: int, min_piece: int, first_id: int):
        self.size, self.windows, self.min_piece, self.next_id = size, windows, min_piece, first_id
        self.gaps: list[tuple[int, int]] = []  # (gap, window), in order
        self.open: dict[int, list] = {}
        self.out: list[tuple[int, list]] = []
        self.serial = 0

    def emit(self, pieces: list) -> None:
        self.out.append((self.next_id, pieces))
        self.next_id += 1

    def add(self, doc_id, start: int, total: int, ids: bytes) -> None:
        n = len(ids) // 4
        while n >= self.size:
            self.emit([(doc_id, start, total, ids[: 4 * self.size])])
            start, ids, n = start + self.size, ids[4 * self.size :], n - self.size
        if not n:
            return
        at = bisect_left(self.gaps, (n, -1))
        if at < len(self.gaps):  # the smallest gap that takes it
            gap, w = self.gaps.pop(at)
            self._put(w, gap, doc_id, start, total, ids)
            return
        if len(self.gaps) >= self.windows:
            gap, w = self.gaps.pop(0)  # the fullest
            pieces = self.open.pop(w)
            if gap >= self.min_piece:
                pieces.append((doc_id, start, total, ids[: 4 * gap]))
                start, ids = start + gap, ids[4 * gap :]
            self.emit(pieces)
        self.serial += 1
        self.open[self.serial] = []
        self._put(self.serial, self.size, doc_id, start, total, ids)

    def _put(self, w: int, gap: int, doc_id, start: int, total: int, ids: bytes) -> None:
        self.open[w].append((doc_id, start, total, ids))
        gap -= len(ids) // 4
        if gap:
            insort(self.gaps, (gap, w))
        else:
            self.emit(self.open.pop(w))

    def finish(self) -> None:
        """What is open becomes sequences whose lengths are powers of two."""
        for pieces in self.open.values():
            left = sum(len(p[3]) // 4 for p in pieces)
            while left:
                room = 1 << (left.bit_length() - 1)
                left -= room
                taken = []
                while room:
                    doc_id, start, total, ids = pieces.pop(0)
                    n = min(room, len(ids) // 4)
                    taken.append((doc_id, start, total, ids[: 4 * n]))
                    if 4 * n < len(ids):
                        pieces.insert(0, (doc_id, start + n, total, ids[4 * n :]))
                    room -= n
                self.emit(taken)
        self.open, self.gaps = {}, []

    def rows(self, part: int, keep_ids: bool, last: bool) -> pa.RecordBatch:
        """Rows of the sequences emitted since the last call and, if last, of the open windows, with their ids."""
        cols: dict[str, list] = {c.split()[0]: [] for c in PIECE.split(", ")}
        todo = [(s, p, False) for s, p in self.out] + [(w, p, True) for w, p in self.open.items() if last]
        self.out = []
        for seq, pieces, still in todo:
            at = 0
            for doc_id, start, total, ids in pieces:
                n = len(ids) // 4
                for c, v in zip(cols, (doc_id, start, n, zlib.crc32(ids), total, seq, at, ids if keep_ids or still else None, part, still), strict=True):
                    cols[c].append(v)
                at += n
        return pa.RecordBatch.from_pydict(cols, schema=_ARROW)


def _merge(size: int, base: int, keep_ids: bool, final: bool):
    """Fills sequences from a group's open windows; what is left stays open, or is finished."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        packer = Packer(size, 1, 1, base + part * _PART)
        for r in rows.sort_by([(c, "ascending") for c in ("from", "sequence_id", "offset")]).to_pylist():
            packer.add(r["doc_id"], r["start"], r["doc_tokens"], r["ids"])
        if final:
            packer.finish()
        return pa.Table.from_batches([packer.rows(part, keep_ids, not final)])

    return merge


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = 2048, end_id: int = 1, windows: int = 32, min_piece: int = 8, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null unless keep_ids).

    A document is its text's ids and end_id; a null or empty text is end_id
    alone. A row repeated is a document of its own, and a null doc_id stays
    null. An empty table gives no pieces. Other columns of docs are left aside.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, packer = Encoder(path), Packer(size, windows, min_piece, part * _PART)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text").to_pylist()), strict=True):
                    ids += end
                    packer.add(doc_id, 0, len(ids) // 4, ids)
            yield packer.rows(part, keep_ids, False)
        yield packer.rows(part, keep_ids, True)

    pieces = settled(plain(docs, ["doc_id", "text"]).mapInArrow(run, PIECE))
    done, left = pieces.where("not open"), pieces.where("open")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level, groups = level + 1, -(-parts // FAN_IN)
        final = groups == 1
        merged = left.withColumn("from", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(_merge(size, level * _LEVEL, keep_ids, final), PIECE)
        if final:
            return done.unionByName(merged).drop("part", "open")
        merged = settled(merged)
        done, left, parts = done.unionByName(merged.where("not open")), merged.where("open"), groups


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (all ids of the sequence, little-endian unsigned 32-bit), doc_ids of packed pieces that kept their ids."""
    return pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p")).select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> a || x)").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
