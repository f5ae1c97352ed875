"""Pairs of fingerprints within a Hamming radius, by the generalised pigeonhole principle (Qin et al., 2018).

Bits that go together are put into the same part, so that the parts are nearly
independent. Part i gets a threshold T_i of its own, with the sum of T_i + 1
over the parts equal to radius + 1: then any two fingerprints within the
radius differ by at most T_i in some part. Thresholds and part limits come
from a dynamic programme over the estimated cost: probes sent, and candidates
met. A fingerprint probes every key within T_i of its own, and what it meets
is verified on all bits.

All statistics are taken over all distinct fingerprints; a 4096-number matrix
and a histogram for each 4-bit block reach the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resumelake.llm.shared import settled

#: Bits of a block, the unit that parts are made of.
BLOCK = 4
#: Relative costs of sending a probe and of verifying a candidate.
PROBE, CANDIDATE = 1.0, 0.05
#: A bucket with more fingerprints than this is compared in blocks of BATCH, not by a join.
HEAVY, BATCH = 64, 2048
#: Such a comparison links nearer pairs first, in steps of this many bits beyond the radius.
BAND = 2
#: A key's bits from here on number its part, which so has fewer bits than this.
PART_AT = 58


def _bits(pdf: pd.DataFrame, words: int) -> np.ndarray:
    """One row of 0/1 for each fingerprint, bit b of word w in column 64 w + b."""
    raw = np.ascontiguousarray(pdf[[f"f{w}" for w in range(words)]].to_numpy(dtype="<i8"))
    return np.unpackbits(raw.view(np.uint8).reshape(len(pdf), 8 * words), axis=1, bitorder="little")


def _sums(fps: DataFrame, words: int, order: list[int] | None) -> dict[int, int]:
    """Co-occurrence counts of all bit pairs (order None), or counts of each block's values in the given order."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            bits = _bits(pdf, words)
            if order is None:
                x = bits.astype(np.float32)
                part = (x.T @ x).astype(np.int64).ravel()
            else:
                blocks = bits[:, order].reshape(len(pdf), -1, BLOCK) @ (1 << np.arange(BLOCK)).astype(np.uint8)
                width = 1 << BLOCK
                part = np.bincount((blocks + width * np.arange(blocks.shape[1])).ravel(), minlength=width * blocks.shape[1])
            total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total)
            yield pd.DataFrame({"at": at, "n": total[at]})

    rows = fps.select([f"f{w}" for w in range(words)]).mapInPandas(gather, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    return {r["at"]: r["n"] for r in rows}


def grouped_bits(both: dict[int, int], size: int, n: int) -> list[int]:
    """Bits in an order in which correlated ones are neighbours: each block starts with the first bit left and takes those most correlated with it."""
    c = np.zeros(size * size)
    c[list(both)] = list(both.values())
    c = c.reshape(size, size) / max(n, 1)
    p = np.diag(c)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(c - np.outer(p, p)) / np.outer(spread, spread)
    left, order = list(range(size)), []
    while left:
        block = [left.pop(0)]
        while len(block) < BLOCK:
            best = max(left, key=lambda b: (corr[b, block].sum(), -b))
            left.remove(best)
            block.append(best)
        order += block
    return order


def allocate(hist: np.ndarray, n: int, radius: int) -> list[tuple[int, int, int]]:
    """(first block, end block, threshold) of each part, at the least estimated cost.

    hist: a row of value counts for each block. The chance that two
    fingerprints differ by d in a block is exact; over a part it is the
    convolution of its blocks' chances.
    """
    count, width = hist.shape
    values = np.arange(width)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    p = hist / np.maximum(hist.sum(1, keepdims=True), 1)
    chance = [np.bincount(apart.ravel(), weights=np.outer(r, r).ravel(), minlength=BLOCK + 1) for r in p]

    def cost(dist: np.ndarray, bits: int, t: int) -> float:
        probes = sum(math.comb(bits, d) for d in range(t + 1))
        return n * probes * PROBE + n * n * float(dist[: t + 1].sum()) * CANDIDATE

    best: dict[tuple[int, int], tuple[float, list]] = {(0, radius + 1): (0.0, [])}
    for i in range(count):
        dist = np.ones(1)
        for j in range(i + 1, count + 1):
            dist = np.convolve(dist, chance[j - 1])
            if BLOCK * (j - i) >= PART_AT:
                break
            for need in range(1, radius + 2):
                if (i, need) not in best:
                    continue
                so_far, parts = best[i, need]
                for t in range(min(need, 3)):
                    c = so_far + cost(dist, BLOCK * (j - i), t)
                    at = (j, need - t - 1)
                    if at not in best or c < best[at][0]:
                        best[at] = (c, [*parts, (i, j, t)])
    return min((v for (_, need), v in best.items() if need == 0), key=lambda v: v[0])[1]


def _key(bits: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(F.col(f"f{b // 64}"), b % 64).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def _masks(bits: int, t: int) -> list[int]:
    return [sum(1 << b for b in flip) for d in range(t + 1) for flip in itertools.combinations(range(bits), d)]


def _apart(words: int) -> Column:
    return sum((F.bit_count(F.col(f"a.f{w}").bitwiseXOR(F.col(f"b.f{w}"))) for w in range(1, words)), F.bit_count(F.col("a.f0").bitwiseXOR(F.col("b.f0"))))


def _spanning(words: int, radius: int, accept: int):
    """Links enough to connect what the two sides of a block connect: first those within radius, then by distance, BAND bits at a time, up to accept.

    As near links come first, those that a later check of the texts drops are mostly ones that no nearer path replaces.
    """
    bands = [(-1, radius), *((low, min(low + BAND, accept)) for low in range(radius, accept, BAND))]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = pdf[[f"f{w}" for w in range(words)]].to_numpy(dtype="<i8").view(np.uint64)
        ids, at = np.unique(pdf["rep"].to_numpy(), return_inverse=True)
        data, probe = np.flatnonzero(pdf["role"].to_numpy() == 0), np.flatnonzero(pdf["role"].to_numpy() == 1)
        far = np.zeros((len(probe), len(data)), dtype=np.uint8)
        for row, i in zip(far, probe, strict=True):
            for w in range(words):
                row += np.bitwise_count(raw[data, w] ^ raw[i, w])
        group, src, dst, bits = np.arange(len(ids)), [], [], []
        for low, high in bands:
            for row, i in zip(far, probe, strict=True):
                hits = at[data[(row > low) & (row <= high)] if low >= 0 else data[row <= high]]
                for other, k in zip(*np.unique(group[hits], return_index=True), strict=True):
                    mine = group[at[i]]
                    if other != mine:
                        group[group == max(mine, other)] = min(mine, other)
                        src.append(ids[at[i]])
                        dst.append(ids[hits[k]])
                        bits.append(high)
        return pd.DataFrame({"src": np.array(src, dtype=np.int64), "dst": np.array(dst, dtype=np.int64), "bits": np.array(bits, dtype=np.int32)})

    return link


def links(fps: DataFrame, words: int, radius: int, accept: int | None = None) -> DataFrame:
    """(src, dst, bits) links that connect all fingerprints within the radius of each other, and how far apart they are (in large buckets: at most).

    fps: rep (long, unique), f0..f{words-1} (long); equal fingerprints are linked like any within the radius.
    accept: pairs that are met are linked up to this distance (radius by
    default); below the radius none is missed. Pairs in small buckets are
    all returned, larger buckets return links that span the same components.
    """
    accept = radius if accept is None else accept
    n = fps.count()
    size = 64 * words
    order = grouped_bits(_sums(fps, words, None), size, n)
    hist = np.zeros((size // BLOCK, 1 << BLOCK))
    for at, k in _sums(fps, words, order).items():
        hist[at >> BLOCK, at & ((1 << BLOCK) - 1)] = k
    parts = [(order[BLOCK * i : BLOCK * j], t) for i, j, t in allocate(hist, n, radius)]

    own = [f"f{w}" for w in range(words)]
    keys = F.array(*[_key(bits).bitwiseOR(F.lit(k << PART_AT)) for k, (bits, _) in enumerate(parts)])
    data = fps.select("rep", *own, F.explode(keys).alias("key"))
    flips = F.array(*[F.array(*[F.lit(m).cast("long") for m in _masks(len(bits), t)]) for bits, t in parts])
    near = F.explode(F.element_at(flips, F.shiftright("key", PART_AT).cast("int") + 1))
    probes = data.withColumn("flip", near).withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).drop("flip")

    counts = settled(data.groupBy("key").agg(F.count("*").alias("n")))
    heavy = counts.where(F.col("n") > HEAVY)
    crowded = bool(heavy.limit(1).count())
    light = data.join(heavy, "key", "left_anti") if crowded else data
    cond = (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") > F.col("b.rep")) & (_apart(words) <= accept)
    out = probes.alias("a").join(light.alias("b"), cond).select(F.col("a.rep").alias("src"), F.col("b.rep").alias("dst"), _apart(words).cast("int").alias("bits"))
    if crowded:
        around = heavy.select("key", F.col("n").alias("n_data"), near.alias("flip")).withColumn("other", F.col("key").bitwiseXOR(F.col("flip")))
        around = around.join(counts.select(F.col("key").alias("other"), "n"), "other").groupBy("key", "n_data").agg(F.sum("n").alias("n_probe"))
        around = settled(around)
        blocks = lambda c: F.ceil(F.col(c) / BATCH).cast("int")
        side = lambda c: F.pmod(F.xxhash64("rep"), blocks(c)).cast("int")
        spread = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
        cols = ["key", "i", "j", "role", "rep", *own]
        d = data.join(around, "key").withColumn("i", side("n_data")).withColumn("j", spread("n_probe")).withColumn("role", F.lit(0)).select(cols)
        q = probes.join(around, "key").withColumn("j", side("n_probe")).withColumn("i", spread("n_data")).withColumn("role", F.lit(1)).select(cols)
        out = out.unionByName(d.unionByName(q).groupBy("key", "i", "j").applyInPandas(_spanning(words, radius, accept), "src long, dst long, bits int"))
    return out
