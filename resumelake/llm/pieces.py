"""SentencePiece encoding and decoding with shared prefixes: distinct marked words are sorted and walked as a trie.

A text is cut into marked words (its spaces become the mark, which begins a
word). The distinct words that a worker hasn't seen are sorted, so that each
follows those it shares a beginning with, and walked depth first: forward
scores of the common beginning are kept, and only the rest is computed.

For a unigram model the forward score of a position is the best sum of piece
scores up to it (Viterbi). For a byte-pair model sums of scores don't give the
model's result, whose pieces depend on the order of merges; there the forward
state is the last piece of the prefix's encoding, which is the one piece that is
compatible with the last piece where it starts: two neighbours are compatible if
merging their joined text gives them back. Unknown characters fall back to bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from resumelake.llm.shared import plain

MARK = "▁"
_WORD = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Words kept by a worker; when more are needed the cache starts afresh.
CACHE = 1_000_000


class Model:
    """Pieces with their scores; kind: 1 unigram, 2 byte pairs (as in the model file)."""

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], byte_ids: list[int], kind: int, names: list[str], controls: set[int]):
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces that go on over a mark aren't supported")
        self.ids, self.scores, self.bytes_, self.kind = pieces, scores, byte_ids, kind
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10
        self.fits: dict[tuple[str, str], bool] = {}
        byte_of = {b: i for i, b in enumerate(byte_ids)}
        self.raw = [bytes([byte_of[k]]) if k in byte_of else b"" if k in controls else n.replace(MARK, " ").encode() for k, n in enumerate(names)]
        self.known: dict[str, bytes] = {}

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(k) for k in range(n)]
        byte_ids = [k for k in range(n) if sp.is_byte(k)]
        odd = {k for k in range(n) if sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)}
        plain_ids = [k for k in range(n) if k not in odd and not sp.is_byte(k)]
        # byte pairs: scores fall by 1 from piece to piece; unigram scores are log probabilities
        scores = {names[k]: sp.get_score(k) for k in plain_ids}
        falls = sorted(scores.values(), reverse=True)
        kind = 2 if len(falls) > 2 and all(float(s).is_integer() for s in falls) else 1
        return cls({names[k]: k for k in plain_ids}, scores, byte_ids, kind, names, odd)

    def _merged(self, text: str) -> list[str]:
        """The byte-pair encoding of a short text: the best pair (the leftmost of equals) is merged until none can be."""
        parts, score = list(text), self.scores
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, a: str, b: str) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            got = self.fits[a, b] = self._merged(a + b) == [a, b]
        return got

    def _whole(self, piece: str) -> bool:
        """Whether merging the piece's characters gives the piece."""
        got = self.fits.get((piece, ""))
        if got is None:
            got = self.fits[piece, ""] = self._merged(piece) == [piece]
        return got

    def _step(self, word: str, end: int, state: list) -> tuple[str, float]:
        """The state of word[:end]: its last piece and forward score; longer pieces are tried first."""
        scores = self.scores
        best, most = word[end - 1], -np.inf
        for start in range(max(0, end - self.longest), end):
            piece = word[start:end]
            if piece not in scores and start < end - 1:
                continue
            if self.kind == 2:
                if self._whole(piece) and (not start or self._fit(state[start][0], piece)):
                    return piece, 0.0
            else:
                total = state[start][1] + scores.get(piece, self.unknown)
                if total > most:
                    best, most = piece, total
        return best, most

    def learn(self, words: set[str]) -> None:
        """Encodes words, in sorted order, depth first along their common beginnings."""
        state: list = [("", 0.0)]
        before = ""
        ids, byte_ids = self.ids, self.bytes_
        for word in sorted(words):
            common = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                common += 1
            del state[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                state.append(self._step(word, end, state))
            out, end = [], len(word)
            while end:
                piece = state[end][0]
                k = ids.get(piece)
                out[:0] = [k] if k is not None else [byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
                end -= len(piece)
            self.known[word] = np.array(out, dtype="<u4").tobytes()
            before = word

    def encode(self, texts) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers; null and empty texts have none."""
        cut = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        need = {w for ws in cut for w in ws}
        if len(self.known) > CACHE:
            self.known = {}
        self.learn(need.difference(self.known))
        known = self.known.__getitem__
        return [b"".join(map(known, ws)) for ws in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that encoding puts first goes."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw[1 if raw[:1] == b" " else 0 :].decode("utf-8", "replace")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_crc32, same (decoding gives the text back) of each row of docs (doc_id, text).

    keep: with columns ids (little-endian unsigned 32-bit) and decoded. Null texts count as empty and have
    no pieces; a text's own marks (U+2581) decode to spaces, and only then same is false. Rows repeated are encoded each;
    an empty table gives an empty result; other columns are left aside.
    """
    path = path or model_path()
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, same boolean" + ", ids binary, decoded string" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(path)
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                texts = b.column("text").to_pylist()
                ids = model.encode(texts)
                back = [model.decode(i) for i in ids]
                cols = [b.column("doc_id").cast(pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64())]
                cols += [pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()), pa.array([t == (o or "") for t, o in zip(back, texts, strict=True)], pa.bool_())]
                cols += [pa.array(ids, pa.binary()), pa.array(back)] if keep else []
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return plain(docs, ["doc_id", "text"]).mapInArrow(run, schema)
