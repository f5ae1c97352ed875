"""SimHash near-duplicate groups, found by the generalised pigeonhole principle (pigeonhole.py).

With a similarity to verify, links between fingerprints count only if the texts' sets of shingles are that similar
(Jaccard), and a second, exact way connects the pairs that are so similar though their fingerprints are far apart:
each set's shingles are put in one order, rare ones first, and two sets of a similarity s share a shingle among the
first 1 - s of each. Sets that meet so, and aren't connected yet, are compared unless their sizes, the places of
the shingle, or small maps of the sets rule the pair out. One pass over the texts gives all that this needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resumelake.llm.graph import components
from resumelake.llm.pigeonhole import links
from resumelake.llm.shared import met_again, plain, settled, words_of

#: Shingles hashed at a time.
CHUNK = 1 << 15
#: Frequent shingles are put last, by counts of shingles that fall on one of so many places, in so many texts (expected number)
#: or one text in so many, whichever are more; on this order the cost depends, not the result.
ORDER_PLACES, ORDER_TEXTS, ORDER_SHARE = 1 << 20, 4_000, 4
#: Places of a row of counts.
_ROW = 1 << 12
#: Bits of a set's map for each shingle (up to twice as many), one of which is set if a shingle falls on it.
MAP_BITS = 4
#: Up to so many ids (16 bytes each) go to the tasks, so that no text is shuffled for them; more meet the texts in a shuffle.
SENT = 1_000_000
#: Up to so many links (16 bytes each) of sets are put together at the driver; more are in the rounds of graph.py.
FEW = 200_000
#: Shingles of prefixes that one task holds (expected number).
TASK = 1 << 20
#: A shingle that more sets than this share in their prefixes is dealt in blocks of so many sets, a pair of blocks to a task.
CROWD = 64


def _shingles(words: list[bytes], k: int) -> Iterator[bytes]:
    if len(words) < k:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))


def _print(text: str | None, k: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint's words, and the distinct shingles (the first 64 bits of their hashes) in rising order."""
    h = partial(xxhash.xxh64_digest, seed=42) if words == 1 else xxhash.xxh3_128_digest
    tokens = words_of(text)
    total, n, seen = np.zeros(64 * words, dtype=np.int64), 0, []
    for at in range(0, max(len(tokens) - k + 1, 1), CHUNK):
        raw = b"".join(map(h, _shingles(tokens[at : at + CHUNK + k - 1], k)))
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8 * words), axis=1)
        total += bits.sum(0, dtype=np.int64)
        n += len(bits)
        seen.append(np.frombuffer(raw, dtype="<i8")[::words])
    packed = np.packbits(total * 2 > n) if n else np.zeros(8 * words, dtype=np.uint8)
    return packed.view(">i8").astype("<i8"), np.concatenate(seen)


def fingerprint(text: str | None, k: int = 3, words: int = 1) -> tuple[int, ...]:
    """64 * words bits (as signed 64-bit numbers) of the text's k-word shingles, repeats included.

    A bit is 1 if it is set in over half the shingle hashes; hashes are XXH64
    (seed 42) for one word and XXH3-128 for two. A text of fewer than k words
    has itself as its only shingle; without words the fingerprint is zero.
    """
    return tuple(int(x) for x in _print(text, k, words)[0])


def fingerprints(docs: DataFrame, k: int = 3, words: int = 1) -> DataFrame:
    """doc_id, f0 (, f1) of each row of docs (doc_id, text; other columns are left aside)."""

    own = [f"f{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t, k, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array([p[w] for p in prints], pa.int64()) for w in range(words))], names=["doc_id", *own])

    return plain(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in own))


def _map_of(s: np.ndarray) -> bytes:
    """The bits, MAP_BITS or more for each shingle, on which a set's shingles fall; their number is a power of two."""
    bits = np.zeros(1 << max(6, (MAP_BITS * len(s) - 1).bit_length()), dtype=np.uint8)
    bits[s & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _alike(n: int | np.ndarray, a: np.ndarray, m: int | np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sizes n, m and maps a, b (one a row) of sets allow that they are as similar as least: each bit that only one has stands for a shingle at least that the other lacks."""
    size = min(a.shape[-1], b.shape[-1])

    def folded(x: np.ndarray) -> np.ndarray:
        while x.shape[-1] > size:
            x = x[..., : x.shape[-1] // 2] | x[..., x.shape[-1] // 2 :]
        return x

    x, y = folded(a), folded(b)
    most = np.minimum(n - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))
    return most >= (n + m - most) * least


def _whole_prints(docs: DataFrame, k: int, words: int, least: float) -> DataFrame:
    """doc_id, t (XXH64 of the text), f0 (, f1), h0, h1 (a hash of the set of shingles), n (its size), map, prefix of each row.

    prefix: the first n - ceil(least * n) + 1 shingles, rare ones first. Two sets with a similarity of `least` share
    ceil(least * n) shingles at least, of either's n: so the prefixes of both have one in common, without exception.
    """
    own = ["t", *(f"f{w}" for w in range(words)), "h0", "h1", "n"]
    count = _frequent(docs, k, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, prefixes, maps = [], [], []
            for text in b.column("text").to_pylist():
                f, s = _print(text, k, words)
                s = np.unique(s)
                maps.append(_map_of(s))
                need = len(s) - math.ceil(least * len(s) - 1e-9) + 1
                prefixes.append(s[np.lexsort((s, count[s & (len(count) - 1)]))[:need]].tobytes())
                rows.append((*f, *np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8"), len(s)))
            numbers = np.array(rows, dtype="<i8").reshape(b.num_rows, words + 3)
            cols = [pa.array(np.ascontiguousarray(x)) for x in numbers.T]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), *cols, pa.array(maps, pa.binary()), pa.array(prefixes, pa.binary())], names=["doc_id", *own, "map", "prefix"])

    rows = plain(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in own) + ", map binary, prefix binary")


def _frequent(docs: DataFrame, k: int, words: int) -> np.ndarray:
    """How many of a share of texts have a shingle on each of ORDER_PLACES places (up to 65,535; 2 MB in all, so that the driver holds little)."""
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(ORDER_PLACES, dtype=np.int32)
        for b in batches:
            sets = [np.unique(_print(t, k, words)[1]) for t in b.column("text").to_pylist()]
            np.add.at(got, np.concatenate([np.zeros(0, dtype="<i8"), *sets]) & (ORDER_PLACES - 1), 1)
        rows = got.reshape(-1, _ROW)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([_planes(x, 4) for x in rows[some]], pa.binary())], names=["row", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(_numbers(x, 4).astype(np.int64) for x in t.column("n").to_pylist())
        return pa.table({"row": t.column("row").slice(0, 1), "n": pa.array([np.minimum(total, 65_535).astype("<u2").tobytes()], pa.binary())})

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(min(max(n // ORDER_TEXTS, 1), ORDER_SHARE))) == 0)
    rows = some.select("text").mapInArrow(run, "row long, n binary").groupBy("row").applyInArrow(add, "row long, n binary").toArrow()  # 2 * ORDER_PLACES bytes at most
    count = np.zeros((ORDER_PLACES // _ROW, _ROW), dtype="<u2")
    for row, x in zip(rows.column("row").to_pylist(), rows.column("n").to_pylist(), strict=True):
        count[row] = np.frombuffer(x, dtype="<u2")
    return count.ravel()


def _shingle_sets(rows: DataFrame, k: int, words: int) -> DataFrame:
    """node, s: the distinct shingles of each text, 48 bits of their hashes, in rising order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                sets = [_planes(np.unique(_print(t, k, words)[1].view("<u8") >> np.uint64(16)), 6) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "s"])

    return rows.mapInArrow(run, "node long, s binary")


def _sent(df: DataFrame) -> DataFrame:
    """df, a written table, which goes to all tasks if it has no more than SENT rows."""
    return F.broadcast(df) if df.count() <= SENT else df


def _kept_pairs(pairs: DataFrame, sides: DataFrame, columns: list[str], test) -> DataFrame:
    """Those of pairs (src, dst; a written table) for which test(src's columns, dst's columns) holds; sides: node and these columns."""
    side = lambda a: sides.select(F.col("node").alias(a), *(F.col(c).alias(f"{a}_{c}") for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = (zip(*(b.column(f"{x}_{c}").to_pylist() for c in columns), strict=True) for x in ("src", "dst"))
            yield b.select(["src", "dst"]).filter(pa.array([test(*x, *y) for x, y in zip(a, z, strict=True)], pa.bool_()))

    pairs, to = pairs.select("src", "dst"), side("dst")
    if pairs.count() <= SENT:  # of the sides only those of a pair are shuffled
        to = to.join(F.broadcast(pairs.select("dst").distinct()), "dst", "left_semi")
        pairs = F.broadcast(pairs)
    return pairs.join(side("src"), "src").join(to, "dst").mapInArrow(run, "src long, dst long")


def _sets_of(some: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, words: int) -> DataFrame:
    """node, s (_shingle_sets) of the nodes in some (node, repeated or not); of rows repeated with one id, each."""
    some = settled(some.distinct())
    ends = settled(_sent(some).join(nodes.select("node", "doc_id", "t"), "node").select("node", F.col("doc_id").alias("_id"), F.col("t").alias("_t")))
    held = plain(docs, ["doc_id", "text"])
    one = F.xxhash64("text").eqNullSafe(F.col("_t")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    held = held.join(_sent(ends), one).select("node", "text")
    return settled(_shingle_sets(held, k, words))


def similar(edges: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, words: int, least: float) -> DataFrame:
    """Those of edges (src, dst: nodes) whose texts' sets of k-word shingles have a Jaccard similarity of at least `least`.

    nodes: node, doc_id, t of a row of each; only the texts at the ends of edges are read into sets. Texts without words are similar to each other.
    """
    sets = _sets_of(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))), nodes, docs, k, words)

    def near(a: bytes, b: bytes) -> bool:
        x, y = _numbers(a, 6), _numbers(b, 6)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= (len(x) + len(y) - both) * least

    return _kept_pairs(edges, sets, ["s"], near)


def _possible(edges: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those of edges (src, dst) that sizes and maps allow to be as similar as `least`: none that is as similar is left out."""
    return _kept_pairs(edges, nodes, ["n", "map"], lambda n, a, m, b: bool(_alike(n, np.frombuffer(a, dtype="<u8"), m, np.frombuffer(b, dtype="<u8"), least)))


def _planes(x: np.ndarray, n: int) -> bytes:
    """The low n bytes of numbers, all first bytes before all second ones (so that equal ones compress)."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), dtype=np.uint8)
    out[:, :n] = np.frombuffer(raw, dtype=np.uint8).reshape(n, -1).T
    return out.view("<u8").ravel()


def _fits(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n and m shingles, of which number at of one is number to of the other and none before is shared, can be as similar as least."""
    need = np.ceil(least / (1 + least) * (n + m) - 1e-9)
    return np.minimum(n - at, m - to) >= need


def _met(nodes: DataFrame, parts: int, least: float, all_pairs: bool) -> DataFrame:
    """kind, key, src, dst, n, at of what nodes (node, c, n, prefix) share: pairs of nodes of unlike c (kind 0: src, dst), and members of crowds (node src, dst: its c; kind 2 if that isn't the crowd's most frequent).

    Without all_pairs, each node meets its next in the order of all that share a shingle, and there are no crowds.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, c, n = (b.column(x).to_numpy() for x in ("node", "c", "n"))
            found = [np.frombuffer(p, dtype="<u8") for p in b.column("prefix").to_pylist()]
            size = np.array([len(x) for x in found], dtype=np.int64)
            row = np.repeat(np.arange(len(found)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            keys = np.concatenate([np.zeros(0, dtype="<u8"), *found])
            part = (keys & np.uint64(0xFFFFFF)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            keys, row, at, part = keys[order], row[order], at[order], part[order]
            p, start = np.unique(part, return_index=True)
            ends = np.append(start, len(part))[1:]
            cut = lambda x, k: pa.array([_planes(x[i:j], k) for i, j in zip(start, ends, strict=True)], pa.binary())
            cols = [pa.array(p.astype(np.int32)), cut(keys >> np.uint64(24), 5), cut(node[row], 8), cut(c[row] ^ node[row], 8), cut(n[row], 4), cut(at, 4)]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "keys", "node", "c", "n", "at"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        key, node, c, n, at = (np.concatenate([_numbers(x, k) for x in pdf[name]]).view("<i8") for name, k in (("keys", 5), ("node", 8), ("c", 8), ("n", 4), ("at", 4)))
        c ^= node
        order = np.argsort(key, kind="stable")
        key, node, c, n, at = (x[order] for x in (key, node, c, n, at))
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        own = np.repeat(size, size)
        out: list[tuple] = []
        small = np.flatnonzero((own > 1) & (own <= (CROWD if all_pairs else len(key))))
        key_, node_, c_, n_, at_ = (x[small] for x in (key, node, c, n, at))
        names, number = np.unique(node, return_inverse=True)
        number_ = number[small]
        for d in range(1, CROWD if all_pairs else 2):
            i = np.flatnonzero(key_[d:] == key_[:-d])
            if not len(i):
                break
            i = i[c_[i] != c_[i + d]]
            i = i[_fits(n_[i], at_[i], n_[i + d], at_[i + d], least)]
            if len(i):
                a, b = number_[i], number_[i + d]
                out.append(np.unique(np.maximum(a, b) * len(names) + np.minimum(a, b)))
                if sum(map(len, out)) > TASK:
                    out = [np.unique(np.concatenate(out))]
        pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *out]))
        zero = np.zeros(len(pairs), dtype=np.int64)
        rows = [pd.DataFrame({"kind": zero.astype(np.int32), "key": zero, "src": names[pairs // len(names)], "dst": names[pairs % len(names)], "n": zero, "at": zero})]
        for i, m in zip(start[size > CROWD], size[size > CROWD], strict=True) if all_pairs else ():
            crowd = slice(i, i + m)
            groups, count = np.unique(c[crowd], return_counts=True)
            if len(groups) > 1:
                kind = np.where(c[crowd] == groups[count.argmax()], 1, 2).astype(np.int32)
                rows.append(pd.DataFrame({"kind": kind, "key": key[crowd] | int(pdf["part"].iloc[0]) << 40, "src": node[crowd], "dst": c[crowd], "n": n[crowd], "at": at[crowd]}))
        return pd.concat(rows)

    return nodes.select("node", "c", "n", "prefix").mapInArrow(deal, "part int, keys binary, node binary, c binary, n binary, at binary").groupBy("part").applyInPandas(meet, "kind int, key long, src long, dst long, n long, at long")


def _by_maps(maps: list[np.ndarray], size: np.ndarray, data: np.ndarray, least: float):
    """A function from a row and some of data to those of these that sizes and maps allow to be as similar as least to the row."""
    width, place, held = np.array([len(m) for m in maps], dtype=np.int64), np.zeros(len(maps), dtype=np.int64), {}
    for w in np.unique(width[data]):
        of = data[width[data] == w]
        place[of], held[int(w)] = np.arange(len(of)), np.stack([maps[d] for d in of])

    def allowed(p: int, d: np.ndarray) -> np.ndarray:
        return np.concatenate([d[:0], *(of[_alike(size[p], maps[p], size[of], held[int(w)][place[of]], least)] for w in np.unique(width[d]) for of in (d[width[d] == w],))])

    return allowed


def _with_partner(c: np.ndarray, probes: np.ndarray, data: np.ndarray, n: np.ndarray, at: np.ndarray, maps: list[np.ndarray], least: float) -> np.ndarray:
    """Whether places, sizes and maps allow that a row is as similar as least to one of unlike c, of probes and data: no row that is as similar is left out."""
    allowed, found = _by_maps(maps, n, data, least), np.zeros(len(c), dtype=bool)
    for p in probes:
        d = data[c[data] != c[p]]
        d = allowed(p, d[_fits(n[p], at[p], n[d], at[d], least)])
        found[d] = True
        found[p] |= len(d) > 0
    return found


def _spanning(c: np.ndarray, probes: np.ndarray, data: np.ndarray, n: np.ndarray, at: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (probe, other) between rows of unlike c whose sets are as similar as least: with them, and rows of one c being connected, all such pairs of probes and data are.

    A set that has a link to one of a group needs none to the rest of it, so there are fewer links than groups.
    """
    _, group = np.unique(c, return_inverse=True)
    size, out = np.array([len(s) for s in sets]), []
    allowed = _by_maps([np.frombuffer(_map_of(s.view("<i8")), dtype="<u8") for s in sets], size, data, least)

    def near(p: int, others: np.ndarray) -> np.ndarray:
        mine, theirs = sets[p], np.concatenate([sets[q] for q in others])
        hit = mine[np.minimum(np.searchsorted(mine, theirs), size[p] - 1)] == theirs
        both = np.add.reduceat(hit, np.cumsum(size[others]) - size[others], dtype=np.int64)
        return both >= (size[p] + size[others] - both) * least

    for p in probes:
        d = data[group[data] != group[p]]
        left = allowed(p, d[_fits(n[p], at[p], n[d], at[d], least)])
        step = 1  # of each group so many are compared at once, four times as many next
        while len(left):
            order = np.argsort(group[left], kind="stable")
            left = left[order]
            start = np.flatnonzero(np.append(True, group[left][1:] != group[left][:-1]))
            nth = np.arange(len(left)) - np.repeat(start, np.diff(np.append(start, len(left))))
            now = left[nth < step]
            for q in now[near(p, now)]:
                if group[q] != group[p]:
                    out.append((p, q))
                    group[group == group[q]] = group[p]
            left = left[nth >= step]
            left, step = left[group[left] != group[p]], 4 * step
    return out


def _dealt(crowd: DataFrame, held: DataFrame, block: int) -> DataFrame:
    """key, i, j, probe, src, c, n, at, x: the members of each crowd with their x (held: src, x), a pair of blocks of about `block` members for each i, j."""
    sizes = crowd.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("nd"), F.ceil(F.count_if(F.col("kind") == 2) / block).cast("int").alias("np"))
    side, spread = (lambda c: F.pmod(F.xxhash64("src"), F.col(c)).cast("int")), (lambda c: F.sequence(F.lit(0), F.col(c) - 1))
    rows = crowd.join(sizes, "key").where("np > 0").join(held, "src")
    data = rows.withColumn("i", side("nd")).withColumn("j", F.explode(spread("np"))).withColumn("probe", F.lit(False))
    probes = rows.where("kind = 2").withColumn("j", side("np")).withColumn("i", F.explode(spread("nd"))).withColumn("probe", F.lit(True))
    return data.unionByName(probes).select("key", "i", "j", "probe", "src", F.col("dst").alias("c"), "n", "at", "x")


def _in_crowds(crowd: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, words: int, least: float) -> DataFrame:
    """Links (src, dst) that connect all pairs in crowds, of unlike c, that are as similar as least.

    Blocks of maps tell which members can have a partner at all; the sets of these alone are dealt then, as they are many times longer.
    Blocks hold the sets themselves, so only similar pairs come out, of each block fewer than it has sets, however many pairs are similar.
    """

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        node, c, n, at, is_probe = (pdf[x].to_numpy() for x in ("src", "c", "n", "at", "probe"))
        found = _with_partner(c, np.flatnonzero(is_probe), np.flatnonzero(~is_probe), n, at, [np.frombuffer(m, dtype="<u8") for m in pdf["x"]], least)
        node = np.unique(node[found])
        return pd.DataFrame({"key": np.full(len(node), pdf["key"].iloc[0]), "src": node})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        node, c, n, at, is_probe = (pdf[x].to_numpy() for x in ("src", "c", "n", "at", "probe"))
        found = _spanning(c, np.flatnonzero(is_probe), np.flatnonzero(~is_probe), n, at, [_numbers(s, 6) for s in pdf["x"]], least)
        a, b = node[[p for p, _ in found]], node[[q for _, q in found]]
        return pd.DataFrame({"src": np.maximum(a, b), "dst": np.minimum(a, b)})

    ends = settled(crowd.select(F.col("src").alias("node")).distinct())
    maps = nodes.select("node", "map").join(_sent(ends), "node", "left_semi").select(F.col("node").alias("src"), F.col("map").alias("x"))
    able = _dealt(crowd, maps, 32 * CROWD).groupBy("key", "i", "j").applyInPandas(some, "key long, src long")
    crowd = settled(crowd.join(able.distinct(), ["key", "src"], "left_semi"))
    sets = _sets_of(crowd.select(F.col("src").alias("node")), nodes, docs, k, words).groupBy("node").agg(F.first("s").alias("x"))
    return _dealt(crowd, sets.withColumnRenamed("node", "src"), 8 * CROWD).groupBy("key", "i", "j").applyInPandas(compare, "src long, dst long")


def _rest(nodes: DataFrame, edges: DataFrame, docs: DataFrame, k: int, words: int, least: float) -> DataFrame:
    """Links (src, dst) that edges lack: with them, each pair of texts of a similarity of `least` or more is connected.

    Pairs within one component of edges are left out; all others that can be so similar are compared: first each set with
    its next among those that share a shingle, as many as there are sets, then all pairs of those still apart.
    """
    total = nodes.agg(F.sum(F.length("prefix"))).first()[0] or 0
    parts, new = max(total // 8 // TASK, 16), None
    for all_pairs in (False, True):
        found = settled(components(edges, FEW))
        placed = nodes.join(_sent(found), "node", "left").withColumn("c", F.coalesce("component", "node"))
        met = settled(_met(placed, parts, least, all_pairs))
        pairs, crowd = met.where("kind = 0").select("src", "dst"), met.where("kind > 0")
        pairs = settled(_possible(settled(pairs.distinct()), nodes, least))
        more = settled(similar(pairs, nodes, docs, k, words, least)) if pairs.limit(1).count() else pairs
        if crowd.limit(1).count():
            more = more.unionByName(settled(_in_crowds(crowd, nodes, docs, k, words, least).distinct()))
        new = more if new is None else new.unionByName(more)
        edges = edges.unionByName(more)
    return new


def near_groups(docs: DataFrame, k: int = 3, words: int = 1, radius: int = 2, accept: int | None = None, verify: float | None = None) -> DataFrame:
    """doc_id, f0 (, f1), component_id (smallest doc_id reachable by links) of each row of docs.

    Fingerprints within radius bits are linked, and so are those met up to
    accept bits; with verify, links whose texts' shingle sets are less similar
    than that (Jaccard) don't count, all pairs of texts that similar are
    connected, however far apart their fingerprints are, and only texts of equal sets are one without such a link.
    Two columns more then come: t, a hash of the text (with doc_id, it tells which row this is), and group, the same in all rows of a group.
    Null and empty texts have fingerprint zero and link like any other; rows repeated with one doc_id are returned as often as they come; rows
    without a doc_id link like any other, too, but their null is never a group's id unless all of the group have none; an
    empty table gives an empty result.
    """
    own = [f"f{w}" for w in range(words)]
    whole = verify is not None
    if whole:
        prints = settled(_whole_prints(docs, k, words, verify))
        key, first = ["h0", "h1"], F.min(F.struct("doc_id", "t", *own))
        same = prints.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), first.alias("a"), *[F.first(c).alias(c) for c in ("n", "map", "prefix")])
        nodes = settled(same.select(F.monotonically_increasing_id().alias("node"), *key, "rep", "rows", "a.*", "n", "map", "prefix"))
    else:
        prints, key = settled(fingerprints(docs, k, words)), own
        same = prints.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
        nodes = settled(same.select(F.monotonically_increasing_id().alias("node"), *key, "rep", "rows"))  # numbers of a written table: they stay
    edges = links(nodes.select(F.col("node").alias("rep"), *own), words, radius, accept)
    if whole:
        # Of each node's links the nearest is checked; the exact way meets all others.
        edges = settled(edges.groupBy(F.greatest("src", "dst").alias("src")).agg(F.min_by(F.least("src", "dst"), F.struct("bits", F.least("src", "dst"))).alias("dst")))
        edges = settled(similar(_possible(edges, nodes, verify), nodes, docs, k, words, verify))
        edges = settled(edges.unionByName(_rest(nodes, edges, docs, k, words, verify)))
    found = settled(components(edges.select("src", "dst"), FEW if whole else 0))
    linked = settled(nodes.select("node", *key, "rep", "rows").join(_sent(found) if whole else found, "node", "left").withColumn("group", F.coalesce("component", "node")))
    least = linked.where("component is not null").groupBy("group").agg(F.min("rep").alias("least"))
    named = settled(linked.join(least, "group", "left").select(*key, "rows", "group", F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")))
    return met_again(prints.select("doc_id", *own, *(["t", *key] if whole else [])), named, key).select("doc_id", *own, "component_id", *(["t", "group"] if whole else []))


def one_of_each(docs: DataFrame, k: int, words: int, radius: int, accept: int, verify: float) -> DataFrame:
    """Of each group of near copies (near_groups) the row with the smallest doc_id, and of its texts, if the id has several, one; repeated rows once.

    Rows are told apart by doc_id and text: rows of one id in two groups each stay if they are their group's. Rows without an id stay.
    """
    groups = settled(near_groups(docs, k, words, radius, accept, verify).where("doc_id is not null").groupBy("group", "doc_id", "t").agg(F.count("*").alias("rows")))
    kept = groups.groupBy("group").agg(F.min(F.struct("doc_id", "t")).alias("k")).select("k.*")
    gone = settled(groups.select("doc_id", "t").join(kept, ["doc_id", "t"], "left_anti"))
    again = settled(groups.where("rows > 1").select("doc_id", "t").join(kept, ["doc_id", "t"], "left_semi"))
    rows = docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"))
    rows = rows.join(_sent(gone), ["doc_id", "t"], "left_anti")
    if again.limit(1).count():
        once = rows.join(_sent(again), ["doc_id", "t"], "left_semi").groupBy("doc_id", "t").agg(F.first("d").alias("d")).select("d", "doc_id", "t")
        rows = rows.join(_sent(again), ["doc_id", "t"], "left_anti").select("d", "doc_id", "t").unionByName(once)
    return rows.select("d.*")
