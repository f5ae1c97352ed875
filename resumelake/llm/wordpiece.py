"""Token ids of the public word-level BPE vocabulary, equal to the tokenizers library's, with each distinct word encoded once.

The vocabulary's pre-tokenizer drops white space and never joins what stands
on either side of it, and its normaliser (NFC, lower case) acts within words;
so a text's ids are those of its words in turn. A word is looked up in a
bounded cache. One that is not there is cut into the pre-tokenizer's pieces
here, if it is of ASCII and Latin letters, and the library's model encodes
these; any other goes to the library as it is. A text that may hold a special
token's string goes to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from unicodedata import category, normalize

import numpy as np

#: Words kept by a worker; when more are needed the cache starts afresh.
CACHE = 250_000
#: A worker's words by vocabulary; its later tasks find them too.
_KNOWN: dict[str, _Words] = {}
#: Words of characters before this one are cut here, unless they hold white space beyond ASCII.
_END, _SPACES = "ɐ", frozenset("\x85\xa0")
_LETTERS, _NUMBERS = ("".join(re.escape(c) for c in map(chr, range(ord(_END))) if category(c)[0] == kind) for kind in "LN")
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The vocabulary's letter for each byte: the byte's own, or, for those that aren't shown, the next from 256 on.
_LETTER = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Words(dict):
    """The ids of words (A-Z in lower case), as bytes; a word that is missing is encoded and kept."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.number = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def library_ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of what the pre-tokenizer keeps together."""
        raw = piece.encode()
        ids = self.get(raw)
        if ids is None:
            number = self.number
            ids = b"".join([number[t.id] for t in self.model.tokenize(raw.decode("latin-1").translate(_LETTER))])
            if not piece.isalpha():
                self[raw] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # A-Z only, of bytes
            number = self.number
            ids = b"".join([number[t.id] for t in self.model.tokenize(word.decode())])
        else:
            text = word.decode("utf-8", "surrogatepass")
            low = text if word.isascii() else normalize("NFC", text).lower()
            if max(low) < _END and _SPACES.isdisjoint(low):
                ids = b"".join(map(self._piece, _CUT.findall(low)))
            else:
                ids = self.library_ids(text)
        self[word] = ids
        return ids


class Encoder:
    """Encodes lists of texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        if path not in _KNOWN:
            _KNOWN[path] = _Words(_library(path))
        self.known = _KNOWN[path]

    def encode(self, texts) -> list[bytes]:
        """The ids of each text; null is empty."""
        known, out = self.known, []
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass").lower()  # lowers A-Z only
            if b"<|" in raw:
                out.append(known.library_ids(t))
                continue
            if len(known) > CACHE:
                known.clear()
            out.append(b"".join(map(known.__getitem__, raw.split())))
        return out


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
