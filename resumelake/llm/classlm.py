"""Class-based bigram language model: exchange clustering, class transitions and word emissions (Brown et al., 1992).

P(w | before) = P(class(w) | class(before)) * P(w | class(w)), both smoothed.

Every training word has a count and a class. The UNITS most frequent words, and all rare words' endings (BUCKETS
groups by a hash of the last letters), are clustered by the exchange algorithm: a unit moves to the class that raises
the likelihood of the class bigrams most, by the counts of its neighbours alone, until no unit moves or PASSES are done.
The other known words - with a share of at least 1 / KNOWN_SHARE of the tokens, KNOWN_SHARE at most - start in the class
of their ending and are moved, each by the counts of its own neighbours' classes, in MOVERS tasks. Known words (a few MB) go to
the tasks with their counts; rarer ones, however many, are moved in the same way in tables, and meet their counts and classes in a
join on the word. A word seen fewer than SEEN times stays with its ending: its neighbours tell too little.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resumelake.llm.shared import crc_of_id, plain, settled, words_of

UNITS, KNOWN_SHARE, BUCKETS, CLASSES, PASSES, MOVERS, SEEN = 4_096, 250_000, 512, 64, 12, 32, 10
#: Added to a word's count in its class; weight of the class's own share against its share after a class.
EMIT, BACK = 1.0, 16.0
#: Bits that tell which of the words that aren't known may have a class of their own; words moved in a task have so many tokens (expected number).
MARKS, TASK = 1 << 24, 1 << 20
#: Up to so many classes of such words are looked up at the driver at once, by Model.class_of alone.
LOOKED_UP = 1_000_000
#: Words that a task counts before it hands the counts on.
FLUSH = 600_000
#: Texts whose words are numbered at once.
GROUP = 32
END = b""  # the token that ends a text; words are never empty
_SUFFIX = 3


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-_SUFFIX:]) % BUCKETS


def _bucket(word: str) -> Column:
    """bucket_of, of a binary column."""
    return F.crc32(F.expr(f"substring({word}, greatest(length({word}) - {_SUFFIX - 1}, 1), {_SUFFIX})")) % BUCKETS


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


class _Classes:
    """Counts of class pairs, and the moves of units between classes."""

    def __init__(self, joint: np.ndarray):
        size = len(joint)
        self.size, self.d = size, np.arange(size)
        self.both = np.concatenate([joint, joint.T])  # by the class before, then by the class after
        self.joint, self.after = self.both[:size], self.both[size:]
        self.f = _f(self.both)

    def _put(self, at: int, left: np.ndarray, right: np.ndarray, own: float) -> None:
        size, f, lines = self.size, self.f, (self.joint[at], self.after[at])
        lines[0][:] += right
        lines[1][:] += left
        lines[0][at] = lines[1][at] = lines[0][at] + left[at] + own
        self.joint[:, at], self.after[:, at] = lines[1], lines[0]
        f[at], f[size + at] = _f(np.stack(lines))
        f[:size, at], f[size:, at] = f[size + at], f[at]

    def moved(self, a: int, left: np.ndarray, right: np.ndarray, own: float) -> int:
        """The best class of a unit of class a, which it is moved to; left, right: how often units of each class stand before and after it, own: how often it does itself."""
        self._put(a, -left, -right, -own)
        size, d, sides = self.size, self.d, np.concatenate([left, right])
        i = np.flatnonzero(sides)
        cls = i % size
        more = _f(self.both[i] + sides[i, None]) - self.f[i]
        gain = more.sum(0) - np.bincount(cls, more[np.arange(len(i)), cls], size)
        sums = self.both.sum(1) + sides  # the neighbours' sums, wherever the unit goes
        own_pair = self.joint[d, d]
        f = _f(np.stack([own_pair + left + right + own, sums[:size], sums[:size] + (right.sum() + own), sums[size:], sums[size:] + (left.sum() + own)]))
        gain += f[0] - self.f[d, d] + f[1] - f[2] + f[3] - f[4]
        b = int(gain.argmax())
        if gain[b] <= gain[a] + 1e-9:
            b = a
        self._put(b, left, right, own)
        return b


def exchange(before: np.ndarray, after: np.ndarray, count: np.ndarray, size: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each of size units, from the counts of pairs of units that are neighbours."""
    freq = np.bincount(before, count, size) + np.bincount(after, count, size)
    order = np.argsort(-freq, kind="stable")
    cls = np.zeros(size, dtype=np.int64)
    cls[order] = np.arange(size) % classes
    self_ = before == after
    own = np.bincount(before[self_], count[self_], size)
    state = _Classes(np.bincount(cls[before] * classes + cls[after], count, classes * classes).reshape(classes, classes))
    before, after, count = before[~self_], after[~self_], count[~self_]

    def neighbours(key: np.ndarray, other: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        at = np.argsort(key, kind="stable")
        cut = np.searchsorted(key[at], np.arange(size + 1))
        other, n = other[at], count[at]
        return [(other[i:j], n[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]

    lefts, rights = neighbours(after, before), neighbours(before, after)
    for _ in range(passes):
        moved = 0
        for u in order:
            if freq[u]:
                (l, n), (r, m) = lefts[u], rights[u]
                b = state.moved(cls[u], np.bincount(cls[l], n, classes), np.bincount(cls[r], m, classes), own[u])
                moved += b != cls[u]
                cls[u] = b
        if not moved:
            break
    return cls


def _counted(train: DataFrame) -> DataFrame:
    """word, n of all training words and the end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.int64())], names=["word", "n"])

        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                for text in b.column("text").to_pylist():
                    got.update(words_of(text))
                got[END] += b.num_rows
                if len(got) > FLUSH:
                    yield out()
                    got.clear()
        if got:
            yield out()

    return settled(train.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def _flat(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The words of texts one after another, an end before, between and after them, and the places of the ends."""
    words, ends = [END], [0]
    for text in texts:
        words += words_of(text)
        ends.append(len(words))
        words.append(END)
    return words, np.array(ends)


def _codes(known: dict[bytes, int], words: list[bytes], ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The numbers of _flat's words, -1 - bucket for a word that isn't known, `end` for an end; and the places of words that aren't known, and these words."""
    code = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
    code[ends] = end
    at = np.flatnonzero(code < 0)
    rare = [words[i] for i in at.tolist()]
    code[at] = -1 - _crc([w[-_SUFFIX:] for w in rare]) % BUCKETS
    return code, at, rare


def _crc(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def _groups(column: pa.Array) -> Iterator[list[str | None]]:
    for i in range(0, len(column), GROUP):
        yield column.slice(i, GROUP).to_pylist()


def _summed(train: DataFrame, known: dict[bytes, int], pairs) -> DataFrame:
    """at, n: how often pairs(codes of some texts, ends around each) gives each number, over all texts; summed before anything is shuffled."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(known)  # KNOWN_SHARE words at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, waiting = shared.value, [], 0

        def out() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["at", "n"])

        for b in batches:
            for texts in _groups(b.column("text")):
                held.append(pairs(_codes(known, *_flat(texts), known[END])[0]))
                waiting += len(held[-1])
                if waiting > 8 * FLUSH:
                    yield out()
                    held, waiting = [], 0
        if held:
            yield out()

    return train.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


def _unit_pairs(train: DataFrame, unit: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units before and after, and counts, of neighbouring units; buckets come after the words."""
    size, base = len(unit) + BUCKETS, len(unit)

    def pairs(code: np.ndarray) -> np.ndarray:
        at = np.where(code < 0, base - 1 - code, code)
        return at[:-1] * size + at[1:]

    rows = _summed(train, unit, pairs).toArrow()  # (UNITS + BUCKETS) ** 2 rows at most
    at = rows.column("at").to_numpy()
    return at // size, at % size, rows.column("n").to_numpy().astype(float)


def _moved_words(train: DataFrame, known: dict[bytes, int], units: int, own: int, cls: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of known words, those from number units to own moved, and the counts of class pairs: each word is moved once, by its neighbours' classes.

    cls: classes of all known words, then of the buckets. A task moves its words in turn, by counts that follow its own moves.
    """
    base = len(known)

    def pairs(code: np.ndarray) -> np.ndarray:
        c = cls[np.where(code < 0, base - 1 - code, code)]
        here = np.flatnonzero((code[1:-1] >= units) & (code[1:-1] < own)) + 1
        word = (code[here] - units) * 2
        return np.concatenate([word * CLASSES + c[here - 1], (word + 1) * CLASSES + c[here + 1]])

    def move(t: pa.Table) -> pa.Table:
        at, n = t.column("at").to_numpy(), t.column("n").to_numpy().astype(float)
        word = at // (2 * CLASSES)
        order = np.argsort(word, kind="stable")
        at, n, word = at[order], n[order], word[order]
        names, start = np.unique(word, return_index=True)
        state, rows = _Classes(joint.copy()), []
        for w, i, j in zip(names.tolist(), start, np.append(start, len(word))[1:], strict=True):
            side = np.bincount(at[i:j] % (2 * CLASSES), n[i:j], 2 * CLASSES)
            rows.append((w, state.moved(int(cls[units + w]), side[:CLASSES], side[CLASSES:], 0.0)))
        change = (state.joint - joint).tobytes()
        return pa.table({"word": pa.array([w for w, _ in rows] + [-1], pa.int64()), "cls": pa.array([c for _, c in rows] + [-1], pa.int64()), "change": pa.array([None] * len(rows) + [change], pa.binary())})

    counts = _summed(train, known, pairs).withColumn("mover", F.pmod(F.xxhash64(F.floor(F.col("at") / (2 * CLASSES))), F.lit(MOVERS)))
    got = counts.groupBy("mover").applyInArrow(move, "word long, cls long, change binary").toArrow()  # a row for each word and task
    word, new = got.column("word").to_numpy(), got.column("cls").to_numpy()
    out = cls.copy()
    out[units + word[word >= 0]] = new[word >= 0]
    for change in got.column("change").drop_null().to_pylist():
        joint = joint + np.frombuffer(change).reshape(CLASSES, CLASSES)
    return out, np.maximum(joint, 0)


def _marks(rest: DataFrame) -> bytes:
    """MARKS bits, of which those of the words of rest (word) are set."""
    bit = F.crc32("word") % MARKS
    rows = rest.select(F.floor(bit / 32768).alias("row"), (bit % 32768).alias("at")).groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits")).collect()  # MARKS / 8 bytes at most
    out = bytearray(MARKS // 8)
    for r in rows:
        out[r["row"] * 4096 : (r["row"] + 1) * 4096] = r["bits"]
    return bytes(out)


def _marked(marks: bytes, words: list[bytes]) -> np.ndarray:
    """Whether each word's bit is set."""
    at = _crc(words) % MARKS
    return (np.frombuffer(marks, dtype=np.uint8)[at >> 3] >> (at & 7) & 1).astype(bool)


def _moved_rest(train: DataFrame, rest: DataFrame, tokens: int, marks: bytes, known: dict[bytes, int], cls: np.ndarray, joint: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """word, n, cls of the words of rest (word, n), which have `tokens` tokens, and the counts of class pairs: _moved_words for words that are too many to be sent to all tasks."""
    spark, base = train.sparkSession, len(known)
    shared = spark.sparkContext.broadcast((known, marks))  # KNOWN_SHARE words at most

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marks = shared.value
        for b in batches:
            for texts in _groups(b.column("text")):
                words, ends = _flat(texts)
                code, at, rare = _codes(known, words, ends, known[END])
                c = cls[np.where(code < 0, base - 1 - code, code)].astype(np.int16)
                there = _marked(marks, rare)
                at = at[there]
                yield pa.RecordBatch.from_arrays([pa.array(list(compress(rare, there)), pa.binary()), pa.array(c[at - 1]), pa.array(c[at + 1])], names=["word", "l", "r"])

    def move(t: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by([("n", "descending"), ("word", "ascending")])
        words = own.column("word").combine_chunks()
        at = pc.index_in(t.column("word"), value_set=words)
        there = at.is_valid().to_numpy()
        at, size = at.drop_null().to_numpy().astype(np.int64) * CLASSES, len(words) * CLASSES
        left, right = (np.bincount(at + t.column(x).to_numpy()[there], minlength=size).reshape(-1, CLASSES).astype(np.int32) for x in ("l", "r"))
        state, bucket = _Classes(joint.copy()), cls[base:]
        new = [state.moved(int(bucket[bucket_of(w)]), l.astype(float), r.astype(float), 0.0) for w, l, r in zip(words.to_pylist(), left, right, strict=True)]
        change = (state.joint - joint).tobytes()
        return pa.table({"word": pa.array([*words.to_pylist(), None], pa.binary()), "n": pa.array([*own.column("n").to_pylist(), 0], pa.int64()), "cls": pa.array([*new, -1], pa.int32()), "change": pa.array([None] * len(new) + [change], pa.binary())})

    mover = F.pmod(F.xxhash64("word"), F.lit(max(MOVERS, tokens // TASK))).alias("mover")
    met = train.mapInArrow(meet, "word binary, l short, r short").select("*", mover).groupBy("mover")
    got = settled(met.cogroup(rest.select("word", "n", mover).groupBy("mover")).applyInArrow(move, "word binary, n long, cls int, change binary"))
    for r in got.where("word is null").select("change").toLocalIterator():  # a row for each task
        joint = joint + np.frombuffer(r["change"]).reshape(CLASSES, CLASSES)
    return got.where("word is not null").select("word", "n", "cls"), np.maximum(joint, 0)


def _placed(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """For each text a row with what the known words and classes give, and a row for each of its rare words, which have the classes of their endings so far.

    With marks, rows of marked words have their places in the text, and texts with any have all classes.
    """
    known, cls, emit, base = model["known"], model["cls"], model["emit"], model["base"]
    step, end_known, marks = model["step"], model["end_known"], model["marks"]
    of_code = np.concatenate([cls, model["bucket_cls"][::-1]])  # a number below zero counts from the end
    emit, base = (np.concatenate([x, np.zeros(BUCKETS)]) for x in (emit, base))
    serial = TaskContext.get().partitionId() << 33
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
    for b in batches:
        for first in range(0, b.num_rows, GROUP):
            docs = b.slice(first, GROUP)
            words, ends = _flat(docs.column("text").to_pylist())
            code, at, rare = _codes(known, words, ends, 0)
            size, chain, starts = docs.num_rows, of_code[code], ends[:-1]
            doc = np.searchsorted(ends, at) - 1
            # Each text's distinct rare words, and which of them each place has.
            key: list[bytes] = []
            of, cut = np.empty(len(at), np.int64), np.searchsorted(at, ends).tolist()
            for i, j in zip(cut, cut[1:], strict=False):
                found: dict[bytes, int] = {}
                of[i:j] = np.array([found.setdefault(w, len(found)) for w in rare[i:j]], np.int64) + len(key)
                key += found
            tf = np.bincount(of, minlength=len(key))
            owner = np.zeros(len(key), np.int64)
            owner[of] = doc
            spots = _marked(marks, key) if marks else np.zeros(len(key), bool)
            order = np.argsort(of, kind="stable")
            order = order[spots[of[order]]]
            bounds = np.concatenate([[0], np.cumsum(np.where(spots, tf, 0))]).astype("<i4") * 4
            places = pa.BinaryArray.from_buffers(pa.binary(), len(key), [pa.py_buffer(np.packbits(spots, bitorder="little").tobytes()), pa.py_buffer(bounds.tobytes()), pa.py_buffer((at - ends[doc])[order].astype("<i4").tobytes())])
            raw, has = chain.astype(np.uint8).tobytes(), np.bincount(owner[spots], minlength=size) > 0
            classes = [raw[i : j + 1] if x else None for i, j, x in zip(ends.tolist(), ends[1:].tolist(), has.tolist(), strict=False)]
            rid = serial + np.arange(size)
            serial += size
            heads = [
                [b" " + r.to_bytes(8, "big") for r in rid.tolist()], rid, np.zeros(size, np.int32), docs.column("doc_id"), docs.column("held_out"),  # no word holds a space
                np.diff(ends), np.diff(ends) - 1 - np.diff(cut) + end_known,
                np.add.reduceat(base[code[:-1]], starts), np.add.reduceat(emit[code[:-1]], starts) + np.add.reduceat(step[chain[:-1], chain[1:]], starts),
                None, classes,
            ]
            rows = {0: pa.array(key, pa.binary()), 1: rid[owner], 2: tf.astype(np.int32), 9: places}
            column = lambda x, kind, n: x if isinstance(x, pa.Array) else pa.nulls(n, kind) if x is None else pa.array(x, kind)
            both = [pa.concat_arrays([column(x, kind, size), column(rows.get(k), kind, len(key))]) for k, (x, kind) in enumerate(zip(heads, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(both, names=PLACED_NAMES)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after another (null: none), and where each row's begin, and the end."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), dtype=np.uint8), at


def _with_moved(batches: Iterator[pa.RecordBatch], step: np.ndarray) -> Iterator[pa.RecordBatch]:
    """score follows from the classes of moved words (moved: places and cls of each) in the place of their endings' (classes)."""
    for b in batches:
        was, start = _joined(b.column("classes"))
        moved = b.column("moved")
        values = moved.flatten()
        places, at = _joined(values.field("places"))
        times = np.diff(at) // 4
        row = np.repeat(np.repeat(np.arange(b.num_rows), pc.list_value_length(moved).to_numpy()), times)
        now = was.copy()
        now[start[row] + places.view("<i4")] = np.repeat(values.field("cls").to_numpy(), times)
        change = np.concatenate([[0.0], np.cumsum(step[now[:-1], now[1:]] - step[was[:-1], was[1:]])])
        first, last = start[:-1], np.maximum(start[1:] - 1, start[:-1])
        there = last > first
        more = np.zeros(b.num_rows)
        more[there] = change[last[there]] - change[first[there]]
        score = b.column("score").to_numpy() + more
        yield b.set_column(b.schema.names.index("score"), "score", pa.array(score)).drop_columns(["classes", "moved"])


PLACED = "word binary, rid long, tf int, doc_id long, held_out boolean, n_tokens long, n_known long, low double, high double, places binary, classes binary"
PLACED_NAMES = [c.split()[0] for c in PLACED.split(", ")]


@dataclass
class Model:
    """known: words by number, the end first; cls, count: of the known words; bucket_cls: of endings; step: log10 chances of a class after a class; below: what a class's counts are divided by; n, v: tokens, distinct.

    rest: word, n, cls of the other words that have a class of their own, whose bits are set in marks; None if there are none.
    """

    known: dict[bytes, int]
    cls: np.ndarray
    count: np.ndarray
    bucket_cls: np.ndarray
    step: np.ndarray
    below: np.ndarray
    n: int
    v: int
    rest: DataFrame | None = None
    marks: bytes | None = None

    @cached_property
    def _few(self) -> dict[bytes, int] | None:
        rows = self.rest.select("word", "cls").limit(LOOKED_UP + 1).collect()
        return {bytes(r["word"]): r["cls"] for r in rows} if len(rows) <= LOOKED_UP else None

    def class_of(self, word: bytes) -> int:
        k = self.known.get(word)
        if k is not None:
            return int(self.cls[k])
        own = None
        if self.marks and _marked(self.marks, [word])[0]:
            if self._few is not None:
                own = self._few.get(word)
            elif r := self.rest.where(F.col("word") == F.lit(word)).first():
                own = r["cls"]
        return int(self.bucket_cls[bucket_of(word)] if own is None else own)


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts of train (text), and word, n, cls of all its words, in the shared folder (cls is null for known words, and for those that have their ending's)."""
    counts = _counted(train)
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = size["n"] or 0, size["v"]
    top = counts.where((F.col("n") * KNOWN_SHARE >= n) | (F.col("word") == END)).orderBy(F.col("word") != END, F.desc("n"), "word").collect()  # KNOWN_SHARE + 1 rows at most
    known = {bytes(r["word"]): k for k, r in enumerate(top)} or {END: 0}
    count = np.array([r["n"] for r in top] or [0], dtype=float)
    own = max(1, int((count >= SEEN).sum()))  # the end comes first, then the words by count
    units = min(UNITS, own)
    before, after, times = _unit_pairs(train, {w: k for w, k in known.items() if k < units})
    classes = exchange(before, after, times, units + BUCKETS)
    joint = np.bincount(classes[before] * CLASSES + classes[after], times, CLASSES * CLASSES).reshape(CLASSES, CLASSES)
    bucket_cls = classes[units:]
    cls = np.concatenate([classes[:units], [bucket_cls[bucket_of(w)] for w, k in known.items() if k >= units]]).astype(np.int64)
    if own > units:
        moved, joint = _moved_words(train, known, units, own, np.concatenate([cls, bucket_cls]), joint)
        cls = moved[: len(known)]

    rare, often = counts.where((F.col("n") * KNOWN_SHARE < n) & (F.col("word") != END)), F.col("n") >= SEEN
    rest = marks = None
    tokens = rare.where(often).agg(F.sum("n")).first()[0]
    if tokens:
        marks = _marks(rare.where(often))
        rest, joint = _moved_rest(train, rare.where(often), tokens, marks, known, np.concatenate([cls, bucket_cls]), joint)
    by_bucket = np.zeros((2, BUCKETS))  # kinds and tokens of rare words
    for r in (rare.where(~often) if rest else rare).groupBy(_bucket("word").alias("b")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect():
        by_bucket[:, r["b"]] = r["kinds"], r["n"]
    kinds = np.bincount(cls, count > 0, CLASSES) + np.bincount(bucket_cls, by_bucket[0], CLASSES)
    total = np.bincount(cls, count, CLASSES) + np.bincount(bucket_cls, by_bucket[1], CLASSES)
    if rest:
        for r in rest.groupBy("cls").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect():
            kinds[r["cls"]] += r["kinds"]
            total[r["cls"]] += r["n"]
    share = (total + 1) / (total.sum() + CLASSES)
    step = np.log10((joint + BACK * share[None]) / (joint.sum(1, keepdims=True) + BACK))
    others = counts.where(~often | (F.col("n") * KNOWN_SHARE >= n) | (F.col("word") == END)) if rest else counts
    classed = others.withColumn("cls", F.lit(None).cast("int"))
    return Model(known, cls, count, bucket_cls, step, total + EMIT * (kinds + 1), n, v, rest, marks), classed.unionByName(rest) if rest else classed


def scored(docs: DataFrame, held_out: int = 2, folds: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row of docs (doc_id, text).

    The model learns from rows whose crc32(doc_id) modulo folds is not held_out (a null doc_id is
    never held out). Null texts count as empty: their only token is the end. base_score: add-one unigrams; score:
    log10 probability by the class model, in which each class has one unknown word. Repeated rows are scored
    each; an empty table gives an empty result; without training rows, chances are even. Other columns are left aside.
    """
    docs = plain(docs, ["doc_id", "text"]).withColumn("held_out", F.coalesce(crc_of_id(F.col("doc_id"), folds) == held_out, F.lit(False)))
    m, counts = fit(docs.where("not held_out").select("text"))
    n, v, bucket_cls, below = m.n, m.v, m.bucket_cls, m.below
    emit, base = np.log10((m.count + EMIT) / below[m.cls]), np.log10((m.count + 1) / (n + v + 1))
    known = {w: k for w, k in m.known.items() if k}
    model = {"known": known, "cls": m.cls, "emit": emit, "base": base, "bucket_cls": bucket_cls, "step": m.step, "end_known": int(m.count[0] > 0), "marks": m.marks}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # KNOWN_SHARE words at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _placed(batches, shared.value)

    rows = docs.mapInArrow(place, PLACED)
    met = rows.join(counts.withColumnRenamed("n", "c"), "word", "left")
    rare, c = F.col("tf") > 0, F.coalesce("c", F.lit(0))
    of_ending = F.element_at(F.array(*[F.lit(int(k)) for k in bucket_cls]), _bucket("word").cast("int") + 1)
    own = F.coalesce("cls", of_ending)
    under = F.element_at(F.array(*[F.lit(float(x)) for x in below]), own + 1)
    met = met.select(
        "rid", "doc_id", "held_out", "n_tokens",
        F.when(rare, F.when(c > 0, F.col("tf")).otherwise(0)).otherwise(F.col("n_known")).cast("long").alias("n_known"),
        F.when(rare, F.col("tf") * F.log10((c + 1) / F.lit(float(n + v + 1)))).otherwise(F.col("low")).alias("low"),
        F.when(rare, F.col("tf") * F.log10((c + EMIT) / under)).otherwise(F.col("high")).alias("high"),
        "classes", F.when(F.col("cls") != of_ending, F.struct("places", "cls")).alias("moved"),
    )
    sums = [F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("low").alias("base_score"), F.sum("high").alias("score")]
    if m.rest is None:
        out = met.groupBy("rid").agg(*sums)
    else:
        step = m.step
        out = met.groupBy("rid").agg(*sums, F.max("classes").alias("classes"), F.collect_list("moved").alias("moved")).drop("rid")
        out = out.mapInArrow(lambda batches: _with_moved(batches, step), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
