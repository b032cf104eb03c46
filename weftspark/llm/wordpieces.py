"""Token ids of whole texts by the tokenizers library, as bytes.

The tokenizer's pre-tokenizer discards white space and no normalisation step works across it, so the ids
of a text are the ids of its parts between ASCII white space, in order. Each part is encoded by the library
once and kept in a bounded store; parts of letters, or letters and then punctuation, are encoded many at a time and
cut again where a token ends a word. A text with "<|", which may hold a special token's literal, is encoded as
a whole. Pure ASCII texts are lower-cased first, as the normaliser would; others are left to the library.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

#: Parts kept before the store is emptied; about 200 bytes each.
STORE = 1_200_000
#: Longer parts are encoded but not kept.
LONGEST = 64
#: Parts that the library gets in one text, and the mark of tokens that end a word.
JOINED, WORD_END = 128, "</w>"
#: Signs that the pre-tokenizer keeps together, apart from letters before them.
SIGNS = "!#$%&()*+,-./:;?@[]^_{}~"


class Encoder:
    def __init__(self, path: str, store: int = STORE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.most = store
        self.store: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word of letters, or of letters and then signs: one or two pieces of the pre-tokenizer.

        A word that it cuts further gives more ends; then the library encodes each word on its own.
        """
        ids = array("I")
        for e in self.tokenizer.encode_batch_fast([" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)], add_special_tokens=False):
            ids.extend(e.ids)
        pieces = np.cumsum(np.fromiter((1 if w.isalpha() else 2 for w in words), np.int64, len(words)))
        ends = (np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1) * 4
        if not words or len(ends) != pieces[-1]:
            return self._library(words)
        raw, cuts = ids.tobytes(), ends[pieces - 1].tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as native unsigned 32-bit integers; null counts as empty."""
        parts: list[list[bytes] | None] = []
        new: set[bytes] = set()
        store = self.store
        if len(store) > self.most:
            store.clear()
        for t in texts:
            t = t or ""
            if "<|" in t:
                parts.append(None)
                continue
            words = (t.lower() if t.isascii() else t).encode().split()
            parts.append(words)
            new.update(words)
        new.difference_update(store.keys())
        extra = {}
        plain, other = [], []
        for w in new:
            t = w.decode()
            (plain if t.rstrip(SIGNS).isalpha() else other).append(t)
        for fresh, by in ((plain, self._words), (other, self._library)):
            for t, ids in zip(fresh, by(fresh)):
                w = t.encode()
                (store if len(w) <= LONGEST else extra)[w] = ids
        if extra:
            get = lambda w: store.get(w) if w in store else extra[w]
        else:
            get = store.__getitem__
        return [self._library([t])[0] if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
