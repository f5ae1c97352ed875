"""Exact top-k by inner product, with a KD-tree for each shard of the vectors.

Shards are the leaves of a tree of median splits, fitted on a bounded sample, so that each holds neighbours; the
tight box of every shard is known to all tasks. A shard's own tree splits at the median of its widest dimension and
keeps the tight box of each node. A query visits nodes best first: the bound of a node is
the largest inner product that any point of its box could have; a node under
the k-th best score so far is not opened, and none after it. Each query first
searches the shard that it is in; with its k-th score from there it goes on to those
shards only whose box could hold a better one, and that score goes along.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resumelake.llm.shared import plain, settled

#: Vectors in a shard, or in a part of one; shards of a length at most (2 to the power of this); sampled vectors for each; queries that meet a part in one task; points in a leaf.
SHARD, DEPTH, SAMPLES, BLOCK, LEAF = 16384, 11, 32, 4096, 128
FOUND = "query long, query_id long, vec_id long, score long"


class Tree:
    """points: one row each (whole numbers); ids: their ids; numbers: their rows' numbers."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, numbers: np.ndarray):
        self.points, self.ids, self.numbers = points, ids, numbers
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.kids: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        if len(points):
            self._build(np.arange(len(points)))
            self.low_, self.high_ = np.array(self.low), np.array(self.high)

    def _build(self, rows: np.ndarray) -> int:
        p = self.points[rows]
        node, low, high = len(self.low), p.min(0), p.max(0)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.rows.append(rows)
        spread = high - low
        if len(rows) > LEAF and len(spread) and spread.max() > 0:
            k = int(spread.argmax())
            half = len(rows) // 2
            order = np.argpartition(p[:, k], half)
            self.rows[node] = rows[:0]
            self.kids[node] = (self._build(rows[order[:half]]), self._build(rows[order[half:]]))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high_.T + np.minimum(queries, 0) @ self.low_.T

    def search(self, query: np.ndarray, bound: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """Up to k (score, id), best first, ties to the smaller id; only scores of floor or more, and not the row own."""
        best_s, best_i = np.zeros(0, self.points.dtype), np.zeros(0, np.int64)
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < floor:
                break
            if self.kids[node] is not None:
                for kid in self.kids[node]:
                    if bound[kid] >= floor:
                        heapq.heappush(heap, (-bound[kid], kid))
                continue
            rows = self.rows[node]
            score = self.points[rows] @ query
            keep = (score >= floor) & (self.numbers[rows] != own)
            if not keep.any():
                continue
            s, i = np.concatenate([best_s, score[keep]]), np.concatenate([best_i, self.ids[rows][keep]])
            order = np.lexsort((i, -s))[:k]
            best_s, best_i = s[order], i[order]
            if len(best_s) == k:
                floor = max(floor, best_s[-1])
        return list(zip(best_s.tolist(), best_i.tolist(), strict=True))


def _matrix(t: pa.Table) -> np.ndarray:
    n = t.num_rows
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _searched(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in FOUND.split(", ")}
        if left.num_rows and right.num_rows:
            points, queries = _matrix(left), _matrix(right)
            top = max(map(abs, (int(points.max(initial=0)), int(points.min(initial=0)), 1))) * max(map(abs, (int(queries.max(initial=0)), int(queries.min(initial=0)), 1))) * max(points.shape[1], 1)
            kind = np.float64 if top < 1 << 52 else object  # whole numbers are exact in either
            points, queries = points.astype(kind), queries.astype(kind)
            tree = Tree(points, left.column("vec_id").to_numpy(), left.column("row").to_numpy())
            bounds = tree.bounds(queries)
            for q, b, row, own, floor in zip(queries, bounds, *(right.column(c).to_pylist() for c in ("row", "vec_id", "floor")), strict=True):
                for s, i in tree.search(q, b, row, k, -np.inf if floor is None else floor):
                    out["query"].append(row)
                    out["query_id"].append(own)
                    out["vec_id"].append(i)
                    out["score"].append(int(s))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return search


class Splits:
    """A tree of median splits of the widest dimension, depth levels of them; its leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1, dtype=sample.dtype)
        held = {0: np.arange(len(sample))}
        for node in range(len(self.axis)):
            rows = held.pop(node)
            p = sample[rows]
            if len(rows):
                self.axis[node] = int((p.max(0) - p.min(0)).argmax()) if p.shape[1] else 0
                self.cut[node] = np.partition(p[:, self.axis[node]], len(rows) // 2)[len(rows) // 2] if p.shape[1] else 0
            right = p[:, self.axis[node]] >= self.cut[node] if p.shape[1] else np.zeros(len(rows), dtype=bool)
            held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] >= self.cut[node])
        return node - len(self.axis)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """A batch's rows by the length of their vectors."""
    dims = b.column("dim").to_numpy()
    for d in np.unique(dims):
        part = pa.Table.from_batches([b]).filter(pa.array(dims == d))
        yield int(d), _matrix(part), part


def _placed(rows: DataFrame, splits: dict[int, Splits]) -> DataFrame:
    """rows with their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, x, part in _by_dim(b):
                yield from part.append_column("shard", pa.array(splits[d].leaf(x).astype(np.int32))).to_batches()

    return rows.mapInArrow(run, "row long, vec_id long, v array<long>, dim int, shard int")


def _boxes(placed: DataFrame) -> list:
    """dim, shard, n, low, high of each shard: a row for each, whatever it holds."""
    schema = "dim int, shard int, n long, low array<long>, high array<long>"
    names = [c.split()[0] for c in schema.split(", ")]

    def table(rows: list) -> pa.Table:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(names, kinds, strict=True))})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for d, x, rows in _by_dim(b):
                shard = rows.column("shard").to_numpy()
                for k in np.unique(shard):
                    y = x[shard == k]
                    n, low, high = held.get((d, int(k)), (0, y[0], y[0]))
                    held[d, int(k)] = n + len(y), np.minimum(low, y.min(0)), np.maximum(high, y.max(0))
        yield from table([(*at, n, low.tolist(), high.tolist()) for at, (n, low, high) in held.items()]).to_batches()

    def whole(t: pa.Table) -> pa.Table:
        low, high = (np.stack([np.array(x) for x in t.column(c).to_pylist()]) for c in ("low", "high"))
        return table([(t.column("dim")[0].as_py(), t.column("shard")[0].as_py(), int(t.column("n").to_numpy().sum()), low.min(0).tolist(), high.max(0).tolist())])

    return placed.mapInArrow(part, schema).groupBy("dim", "shard").applyInArrow(whole, schema).collect()


def _sent(queries: DataFrame, boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Each query once for every shard other than its own whose box could hold a score of its floor or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, x, part in _by_dim(b):
                shard, low, high = boxes[d]
                x, own = x.astype(np.float64), part.column("shard").to_numpy()
                floor = part.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                bound = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T
                slack = 1e-9 * (np.abs(x) @ np.maximum(np.abs(low), np.abs(high)).T + 1)
                i, j = np.nonzero(((bound + slack >= floor[:, None]) | np.isnan(floor)[:, None]) & (shard[None] != own[:, None]))
                out = part.take(pa.array(i))
                yield from out.set_column(out.column_names.index("shard"), "shard", pa.array(shard[j].astype(np.int32))).to_batches()

    return queries.mapInArrow(run, "row long, vec_id long, v array<long>, dim int, shard int, floor long")


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id, v: floor(factor * x) of each component x as a double; vectors that are null or hold null or non-finite components are left out."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return plain(vectors, ["vec_id", "embedding"]).where(F.col("embedding").isNotNull() & ~odd & F.col("vec_id").isNotNull()).select("vec_id", F.transform(e, lambda x: F.floor(x * factor)).alias("v"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best others of each query, by inner product, ties to the smaller vec_id.

    Queries: rows of vectors (vec_id, v: array<long>) whose vec_id is divisible by every. All rows but the query's own
    are candidates; only vectors of the same length are compared. Of rows with one vec_id each is a query with ranks of its
    own, and a candidate for the others. A query with fewer others gets all. An empty table gives an empty result.
    """
    rows = settled(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim")))
    splits = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect():  # a row for each length
        depth = min(DEPTH, max(0, (-(-r["n"] // SHARD) - 1).bit_length()))
        share = min(1.0, (SAMPLES << depth) / r["n"])
        few = rows.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share * (1 << 30))).select("v").toArrow() if depth else None
        splits[r["dim"]] = Splits(_matrix(few) if few is not None else np.zeros((0, r["dim"]), dtype=np.int64), depth)
    placed = settled(_placed(rows, splits))
    boxes = _boxes(placed)
    by_dim = {d: tuple(np.array([b[c] for b in boxes if b["dim"] == d], dtype=kind) for c, kind in (("shard", np.int64), ("low", np.float64), ("high", np.float64))) for d in splits}
    sizes = rows.sparkSession.createDataFrame([(b["dim"], b["shard"], -(-b["n"] // SHARD)) for b in boxes], "dim int, shard int, parts int")
    placed = placed.join(F.broadcast(sizes), ["dim", "shard"])  # a row for each shard: 2 to the power of DEPTH at most for each length
    queries = placed.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v", "dim", "shard", F.lit(None).cast("long").alias("floor"))

    def searched(asked: DataFrame) -> DataFrame:
        blocks = settled(asked.groupBy("dim", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
        held = placed.join(F.broadcast(blocks), ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asks = asked.join(F.broadcast(blocks.join(sizes, ["dim", "shard"])), ["dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        by = ["dim", "shard", "part", "block"]
        own = lambda df, *more: df.select(*[F.col(c).alias(c) for c in ("row", "vec_id", "v", *more, *by)])
        return settled(own(held).groupBy(*by).cogroup(own(asks, "floor").groupBy(*by)).applyInArrow(_searched(k), FOUND))

    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")  # at most k rows from each part searched
    found = searched(queries)
    if any(s.depth for s in splits.values()):
        best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        kth = best.groupBy(F.col("query").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        away = queries.drop("floor").join(kth, "row", "left").select("row", "vec_id", "v", "dim", "shard", F.col("kth").alias("floor"))
        found = found.unionByName(searched(settled(_sent(away, by_dim))))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
