"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon (whole words and word beginnings, with their log odds), the trees
and the calibration are learned from three disjoint samples of the labelled
training rows, so that a feature never has seen the row that a tree is grown on.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resumelake.llm.shared import crc_of_id, plain

#: Labelled rows (expected number) that each of lexicon, trees and calibration is fitted on.
LEXICON_ROWS, TREE_ROWS, CALIBRATION_ROWS = 12_000, 12_000, 6_000
#: Terms in the lexicon, documents of the toxic class that a term needs, least log odds.
TERMS, SUPPORT, LEAST = 4096, 4, 1.5
PREFIXES = (4, 5, 6)
# Words of the second person, in English, French, German and Spanish.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú ti tuyo vos usted ustedes vosotros".split())
# Signs commonly put for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
WORD = re.compile(r"[^\W_]+", re.UNICODE)
MASKED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[0-9@$!*.\-])\S{3,24}(?<![!.,;:?])(?!\S*://)", re.UNICODE)
STRETCHED = re.compile(r"([^\W\d_])\1\1", re.UNICODE)
SIGNS = str.maketrans({c: None for c in "!?.,;:'\"()-"})
FEATURES = (
    "hits_per_word", "odds_per_word", "max_odds", "distinct_hits", "log_hits", "hidden_hits", "near_second", "second_per_word", "capitals", "shouted_words",
    "exclamations", "questions", "signs", "masked_words", "stretched", "digits", "log_words", "mean_word",
)


def terms_of(word: str) -> list[str]:
    """A lower-case word, and its beginnings (marked with *)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The dense features of a text, in the order of FEATURES; null counts as empty."""
    text = text or ""
    words = WORD.findall(text)
    n = max(len(words), 1)
    hit: dict[str, float] = {}
    get = lexicon.get
    lower = [w.lower() for w in words]
    count = Counter(lower)
    for w in count:
        odds = max(get(w, 0.0), *[get(w[:k] + "*", 0.0) for k in PREFIXES if len(w) > k], 0.0)
        if odds:
            hit[w] = odds
    hits = sum(count[w] for w in hit)
    hidden = 0
    masked = MASKED.findall(text) if any(c in text for c in "0134570@$*") or "-" in text else []
    for m in masked:
        s = re.sub(r"[^\w]", "", m.lower().translate(LEET))
        hidden += s not in count and any(get(t, 0.0) > 0 for t in terms_of(s))
    near = 0
    if hit and (seconds := [i for i, w in enumerate(lower) if w in SECOND]):
        at = np.array(seconds)
        for i in [i for i, w in enumerate(lower) if w in hit]:
            k = np.searchsorted(at, i)
            near += min(abs(int(at[j]) - i) for j in (k - 1, k) if 0 <= j < len(at)) <= 3
    upper, chars = sum(map(str.isupper, words)), max(len(text), 1)
    letters = max(sum(map(len, words)), 1)
    capitals = sum(1 for c in text if c.isupper()) if upper else sum(1 for w in words if w[0].isupper())
    plain_signs = len(text) - len(text.translate(SIGNS))
    spaces = len(text) - len("".join(text.split()))
    return [
        hits / n, sum(hit[w] * count[w] for w in hit) / n, max(hit.values(), default=0.0), float(len(hit)), math.log1p(hits), float(hidden), float(near), sum(count[w] for w in SECOND if w in count) / n, capitals / letters, upper / n,
        text.count("!") / chars, text.count("?") / chars, max(0, len(text) - letters - spaces - plain_signs) / chars, len(masked) / n, len(STRETCHED.findall(text)) / n, sum(1 for w in words if w.isdigit()) / n, math.log1p(len(words)), letters / n,
    ]


@dataclass
class Trees:
    """Boosted regression trees for the logistic loss, on features cut into quantile bins."""

    rounds: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    penalty: float = 1.0
    least_rows: int = 10
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.base = math.log(rate / (1 - rate))
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
        b, score = self._binned(x), np.full(len(y), self.base)
        if not 0 < y.sum() < len(y):
            return self
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            score = score + self._grow(b, p - y, p * (1 - p))
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Adds a tree; its values for the rows. A node k has children 2k+1 and 2k+2."""
        size = (1 << (self.depth + 1)) - 1
        feat, cut, value = np.full(size, -1), np.zeros(size, dtype=int), np.zeros(size)
        at = np.zeros(len(g), dtype=int)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -self.rate * gs / (hs + self.penalty)
            if 2 * node + 2 >= size or len(rows) < 2 * self.least_rows:
                continue
            best = (1e-6, -1, 0)
            for k in range(b.shape[1]):
                col = b[rows, k]
                gl, hl, nl = (np.cumsum(np.bincount(col, weights=w, minlength=self.bins + 1))[:-1] for w in (g[rows], h[rows], None))
                gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                gain[(nl < self.least_rows) | (len(rows) - nl < self.least_rows)] = 0
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], k, i)
            if best[1] >= 0:
                feat[node], cut[node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (b[rows, best[1]] > best[2])
        self.trees.append((feat, cut, value))
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, score = self._binned(x), np.full(len(x), self.base)
        for feat, cut, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = feat[at]
                at = np.where(f < 0, at, 2 * at + 1 + (b[np.arange(len(x)), np.maximum(f, 0)] > cut[at]))
            score += value[at]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and rising chances (pool adjacent violators); chances between them are interpolated."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        pools.append([float(v), 1.0, float(s), float(s)])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
    xs = np.array([v for p in pools for v in p[2:]]) if pools else np.zeros(1)
    ys = np.array([v for p in pools for v in [p[0] / p[1]] * 2]) if pools else np.zeros(1)
    return xs, ys


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    xs: np.ndarray
    ys: np.ndarray

    def score(self, texts) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(FEATURES))
        return np.clip(np.interp(self.trees.raw(x), self.xs, self.ys), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4) -> Model:
    """A model learned from the labelled rows of docs whose crc32(doc_id) modulo folds is not held_out.

    Rows without a label or id don't count. With one class only, or no row, scores are the class's rate.
    """
    known = plain(labels, ["doc_id", "toxic"]).where(F.col("toxic").isNotNull() & (crc_of_id(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    known = known.withColumn("u", share)
    edges = (0.0, 0.4, 0.8, 1.0)
    wants = (LEXICON_ROWS, TREE_ROWS, CALIBRATION_ROWS)
    texts = plain(docs, ["doc_id", "text"])

    def sample(k: int) -> DataFrame:
        width = min(edges[k + 1] - edges[k], wants[k] / max(n, 1))
        return texts.join(F.broadcast(known.where((F.col("u") >= edges[k]) & (F.col("u") < edges[k] + width))), "doc_id").select("text", "y")  # at most about wants[k] labels

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                (pos if y else neg).update({"", *(t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w))})  # "" counts the texts
        terms = list(pos.keys() | neg.keys())
        cols = [pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["term", "pos", "neg"])

    counts = sample(0).mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.where((F.col("term") == "") | (F.col("pos") >= SUPPORT)).persist()
    whole = counts.where("term = ''").first()
    lexicon = {}
    if whole and whole["pos"] and whole["neg"]:
        odds = F.log((F.col("pos") + 0.5) / (whole["pos"] + 1.0)) - F.log((F.col("neg") + 0.5) / (whole["neg"] + 1.0))
        top = counts.where("term <> ''").withColumn("odds", odds).where(F.col("odds") >= LEAST).orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "term").limit(TERMS)
        lexicon = {r["term"]: r["odds"] for r in top.collect()}
    counts.unpersist()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, lexicon) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y")], names=["x", "y"])

    def data(k: int) -> tuple[np.ndarray, np.ndarray]:
        got = sample(k).mapInArrow(measure, "x array<double>, y double").toArrow()
        rows = sorted(zip(got.column("y").to_pylist(), got.column("x").to_pylist(), strict=True))  # whatever order tasks end in
        return np.array([x for _, x in rows]).reshape(len(rows), len(FEATURES)), np.array([y for y, _ in rows])

    trees = Trees().fit(*data(1))
    x, y = data(2)
    xs, ys = isotonic(trees.raw(x), y) if len(y) else (np.array([-50.0, 0.0, 50.0]), np.array([0.0, 0.5, 1.0]))
    return Model(lexicon, trees, xs, ys)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column toxicity (0 to 1; higher: likelier toxic); null and empty texts get a score too.

    A column of that name in docs is replaced. Rows, repeated or not, are scored one by one.
    """
    docs = docs.drop("toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.score(b.column("text").to_pylist()) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, "toxicity"])

    return docs.mapInArrow(run, schema)
