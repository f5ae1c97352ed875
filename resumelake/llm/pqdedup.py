"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

Unit vectors go to the nearest of the coarse centroids; what is left is coded by
the nearest codeword in each subspace, and the length of what the code misses
is kept. Two vectors with a cosine of c are r = sqrt(2 - 2c) apart, so a vector
probes every list whose border with its own is within r (sufficient probes:
no pair is missed). In a list, the table-lookup distance less what the code
misses is a lower bound; pairs that it leaves are compared exactly.

Centroids and codewords are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resumelake.llm.graph import components
from resumelake.llm.shared import plain, settled

#: Vectors of one label aimed at in a list, lists at most, vectors in the sample for each list (and at least), subspaces, codewords.
LIST, LISTS, PER_LIST, LEAST, SUBSPACES, CODES = 2048, 4096, 32, 8192, 8, 256
#: Vectors of a list, or probes of it, that meet in one task.
BLOCK = 2048


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids of x (fewer if x has fewer rows), by Lloyd's algorithm from evenly spaced rows."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


@dataclass
class Index:
    dim: int
    coarse: np.ndarray
    books: list[np.ndarray]
    cuts: list[slice]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Index:
        """x: unit vectors, one a row."""
        coarse = _means(x, lists)
        rest = x - coarse[_nearest(x, coarse)]
        edges = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return cls(x.shape[1], coarse, [_means(rest[:, c], CODES) for c in cuts], cuts)

    def code(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row, and the length of what they miss."""
        rest = x - self.coarse[at]
        codes = np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        seen = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - seen) ** 2).sum(1))

    def probes(self, x: np.ndarray, at: np.ndarray, r: float) -> np.ndarray:
        """For each row, which lists can hold a vector within r of it."""
        far = ((x[:, None, :] - self.coarse[None]) ** 2).sum(2) if len(self.coarse) < 8 else np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1)[None])
        own = far[np.arange(len(x)), at][:, None]
        between = np.sqrt(((self.coarse[at][:, None, :] - self.coarse[None]) ** 2).sum(2)) if len(self.coarse) * len(x) * self.dim < 5e7 else np.sqrt(np.maximum(0, (self.coarse**2).sum(1)[at][:, None] + (self.coarse**2).sum(1)[None] - 2 * self.coarse[at] @ self.coarse.T))
        return (far - own) <= 2 * between * r + 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(column: pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


PLACED = "rep long, mult long, label string, v array<{}>, role int, list int, home boolean, code binary, miss double"
FOUND = "id long, n long, link long"


def _placer(index: Index, r: float):
    """Data rows in their lists, and probe rows in every list to search; other lengths get list -1, without codes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                x = _unit(_rows(b.column("v"), b.num_rows)) if index.dim else np.zeros((b.num_rows, 0))
                at = _nearest(x, index.coarse)
                codes, miss = index.code(x, at)
                i, c = np.nonzero(index.probes(x, at, r) & (np.arange(len(index.coarse))[None] >= at[:, None]))
                n, take = b.num_rows, pa.array(np.concatenate([np.arange(b.num_rows), i]))
                codes_ = [*(bytes(k) for k in codes), *([None] * len(i))]
                cols = [b.column(k).take(take) for k in ("rep", "mult", "label", "v")]
                cols += [pa.array(np.repeat([0, 1], [n, len(i)]), pa.int32()), pa.array(np.concatenate([at, c]), pa.int32()), pa.array(np.concatenate([np.ones(n, bool), at[i] == c])), pa.array(codes_, pa.binary()), pa.array(np.concatenate([miss, np.zeros(len(i))]))]
                yield pa.RecordBatch.from_arrays(cols, names=[k.split()[0] for k in PLACED.split(", ")])

    return place


def _linker(index: Index, least: float, r: float):
    def link(key: tuple, t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        ids, mult, x = t.column("rep").to_numpy(), t.column("mult").to_numpy(), _rows(t.column("v"), t.num_rows)
        unit, at, home = _unit(x), key[2].as_py(), t.column("home").to_numpy()
        data, probe = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        codes, miss = None, None
        if at >= 0 and len(data):
            codes = np.frombuffer(b"".join(t.column("code").take(pa.array(data)).to_pylist()), dtype=np.uint8).reshape(len(data), -1)
            miss = t.column("miss").to_numpy()[data]
        n: dict[int, int] = {}
        root: dict[int, int] = {}
        edges: list[tuple[int, int]] = []

        def find(a: int) -> int:
            root.setdefault(a, a)
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for chunk in (probe[i : i + 64] for i in range(0, len(probe), 64)):
            maybe = ~home[chunk][:, None] | (ids[chunk][:, None] > ids[data][None])  # in a probe's own list each pair meets twice
            if codes is not None:
                rest = unit[chunk] - index.coarse[at]
                far = np.zeros((len(chunk), len(data)), dtype=np.float32)
                for m, (cut, book) in enumerate(zip(index.cuts, index.books, strict=True)):
                    table = ((rest[:, cut][:, None, :] - book[None]) ** 2).sum(2).astype(np.float32)
                    far += table[:, codes[:, m]]
                maybe &= np.sqrt(far) - miss[None] <= r + 1e-4  # more than floats round off: no pair is lost
            p, d = np.nonzero(maybe)
            if not len(p):
                continue
            p, d = chunk[p], data[d]
            cosine = (unit[p] * unit[d]).sum(1)
            for a, b in zip(p[cosine >= least], d[cosine >= least], strict=True):
                i, j = int(ids[a]), int(ids[b])
                n[i] = n.get(i, 0) + int(mult[b])
                n[j] = n.get(j, 0) + int(mult[a])
                u, v = find(i), find(j)
                if u != v:
                    root[max(u, v)] = min(u, v)
                    edges.append((i, j))
        rows = [(i, k, None) for i, k in n.items()] + [(i, 0, j) for i, j in edges]
        return pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("id", "n", "link"))})

    return link


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label).

    Two rows link if their labels are equal and the cosine of their vectors, in doubles, is at
    least `least` (over 0). Null labels, and vectors that are null, empty, zero or hold null or non-finite components,
    link with nothing; only vectors of the same length are compared. Equal vectors are compared once and
    count as often as they come. An empty table gives an empty result. Other columns are left aside.
    """
    r = math.sqrt(max(0.0, 2 - 2 * least))
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = settled(plain(vectors, ["vec_id", "embedding", "label"]).select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("v")))
    good = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    nodes = settled(rows.where(good).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("dim", F.size("v")))
    dims = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if dims is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    usual, n = dims["dim"], dims["n"]
    mean = nodes.where(F.col("dim") == usual).groupBy("label").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]  # of the label that a vector has
    lists = max(1, min(LISTS, int(mean) // LIST))
    share = min(1.0, max(LEAST, PER_LIST * lists) / n)
    drawn = nodes.where((F.col("dim") == usual) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < share * (1 << 20))).select("rep", "v").toPandas().sort_values("rep")
    x = np.stack(drawn["v"].tolist()) if len(drawn) else np.eye(usual)[:1]
    index = Index.fit(_unit(x), lists)

    placed = nodes.where(F.col("dim") == usual).select("rep", "mult", "label", "v").mapInArrow(_placer(index, r), PLACED.format(kind))
    role = F.explode(F.array(F.lit(0), F.lit(1))).alias("role")
    other = nodes.where(F.col("dim") != usual).select("rep", "mult", "label", "v", role, (-F.col("dim")).alias("list"), F.lit(True).alias("home"), F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("miss"))
    placed = settled(placed.unionByName(other))
    cell = ["label", "list"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count_if(F.col("role") == 0) / BLOCK).cast("int").alias("nd"), F.ceil(F.count_if(F.col("role") == 1) / BLOCK).cast("int").alias("np")).where("nd > 0 and np > 0")
    dealt = placed.join(sizes, cell)
    side, spread = (lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")), (lambda c: F.sequence(F.lit(0), F.col(c) - 1))
    dealt = dealt.withColumn("i", F.explode(F.when(F.col("role") == 0, F.array(side("nd"))).otherwise(spread("nd")))).withColumn("j", F.explode(F.when(F.col("role") == 1, F.array(side("np"))).otherwise(spread("np"))))
    dealt = dealt.withColumn("at", F.greatest("list", F.lit(-1)))
    found = settled(dealt.groupBy("label", "list", "at", "i", "j").applyInArrow(_linker(index, least, r), FOUND))
    degree = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("far"))
    group = components(found.where("link is not null").select(F.col("id").alias("src"), F.col("link").alias("dst")))
    named = nodes.join(degree, nodes["rep"] == degree["id"], "left").join(group, nodes["rep"] == group["node"], "left")
    named = named.select("label", "v", (F.col("mult") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where(good).join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
