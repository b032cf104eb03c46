"""Token ids of whole texts by a byte-level tokenizer of the tokenizers library, as 16-bit integers, and their terms.

The pre-tokenizer's pieces never end with white space that more text follows, and a piece holds white space only at its
start, so a text whose white space is single blanks and line ends can be cut before each of them: its ids are those of
its parts. Each part is encoded once and numbered; the ids of a batch are then gathered by the numbers. New parts go
through byte-pair merges by rank (tiktoken), if the tokenizer's merges stand in the order of its ids, which is checked; a
test holds the result against the library. All other texts, and those with "<|", which may hold a special token, go to the
library whole.

A term is what stands between blanks or line ends, without its case and without tokens that hold other signs than letters
and digits, as a 64-bit hash of its tokens; so terms can be found again from ids alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np

#: Parts and ids kept before the store is emptied. Longer parts than `LONGEST` are not kept.
STORE, TABLE, LONGEST = 1_000_000, 1 << 24, 64
#: Parts that are encoded in one text.
JOINED = 4096
#: White space before a blank or line end: cutting there could change a piece.
_RUN = re.compile(r"\s[ \n]")
#: Stands for the end of a document among parts, none of which is a lone blank.
END = " "
# fixed value: pieces of the byte-level pre-tokenizer
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Terms:
    """What the tokens of a vocabulary say about terms."""

    def __init__(self, vocabulary: dict[str, int]):
        size, of = max(vocabulary.values()) + 1, byte_letters()
        self.begins, self.letters, self.hash = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, np.uint64)
        for token, i in vocabulary.items():
            raw = bytes(of.get(c, 0) for c in token)
            self.begins[i] = raw[:1] in (b" ", b"\n")
            word = raw.strip(b" \n").lower()
            self.letters[i] = bool(word) and all(c >= 128 or chr(c).isalnum() for c in word)
            self.hash[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self.place = np.array([int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "little") | 1 for k in range(32)], np.uint64)

    def of(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, hash, tokens) of each group of ids; groups begin at the given positions and wherever a token does. Groups
        without letters have hash 0."""
        begin = self.begins[ids]
        begin[first] = True
        at, letter = np.flatnonzero(begin), self.letters[ids]
        count = np.cumsum(letter)
        n = np.add.reduceat(letter, at, dtype=np.int64)
        before = np.repeat(count[at] - letter[at], np.diff(np.append(at, len(ids))))
        value = np.where(letter, self.hash[ids] * self.place[(count - before) & 31], np.uint64(0))
        h = np.add.reduceat(value, at)
        return at, np.where(n > 0, h | np.uint64(1), np.uint64(0)), n


class _Numbers(dict):
    """Numbers of parts; an unknown part gets the next one and waits in `new`."""

    def __init__(self):
        self.new: list[str] = []
        self.next = 0

    def __missing__(self, part: str) -> int:
        self[part] = n = self.next
        self.next = n + 1
        self.new.append(part)
        return n


class Encoded:
    """Ids of a batch of texts: `ids[bounds[i] : bounds[i + 1]]` are those of text i with its end id; and the terms' hashes,
    texts and numbers of tokens."""

    def __init__(self, ids, bounds, terms, texts, tokens):
        self.ids, self.bounds, self.terms, self.texts, self.tokens = ids, bounds, terms, texts, tokens


class ByteEncoder:
    def __init__(self, path: str, end_id: int, store: int = STORE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab()
        if max(self.vocabulary.values()) >= 1 << 16:
            raise ValueError("ids of this tokenizer do not fit 16 bits")
        self.lexicon = Terms(self.vocabulary)
        self.merges = self._by_rank(path)
        self.end_id, self.most = end_id, store
        self._empty()

    def _by_rank(self, path: str):
        """An encoder by ranks with the same ids, or None if the merges do not follow the ids."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        of = byte_letters()
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in special and all(c in of for c in token)}
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        in_order = [model["vocab"].get(m, -1) for m in made] == list(range(256, 256 + len(made))) and len(ranks) == 256 + len(made)
        return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def _empty(self) -> None:
        self.numbers = _Numbers()
        self.numbers[END], self.numbers.next = 0, 1
        self.table = np.full(1024, self.end_id, np.uint16)
        self.ends = np.ones(1024, np.int64)  # of each number's ids in the table
        self.term, self.token = np.zeros(1024, np.uint64), np.zeros(1024, np.int64)
        self.used = 1

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, first: int, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tokens: np.ndarray) -> None:
        """Enter parts with numbers from `first` on."""
        need, n = self.used + len(ids), first + len(sizes)
        if need > len(self.table):
            self.table = np.resize(self.table, max(need, 2 * len(self.table)))
        if n > len(self.ends):
            size = max(n, 2 * len(self.ends))
            self.ends, self.term, self.token = (np.resize(x, size) for x in (self.ends, self.term, self.token))
        self.table[self.used : need] = ids
        self.ends[first:n] = self.used + np.cumsum(sizes)
        self.term[first:n], self.token[first:n] = terms, tokens
        self.used = need

    def _learn(self, first: int, new: list[str]) -> None:
        """Encode parts, which have numbers from `first` on."""
        for i in range(0, len(new), JOINED):
            parts = [w if w[0] == "\n" else " " + w for w in new[i : i + JOINED]]
            ids = np.array(self.merges.encode_ordinary("".join(parts)), np.uint16) if self.merges else self._library(["".join(parts)])[0]
            at, terms, n = self.lexicon.of(ids, np.zeros(1, np.int64))
            if len(at) != len(parts):
                raise ValueError("a part's ids do not begin with its white space")
            self._keep(first + i, ids, np.diff(np.append(at, len(ids))), terms, n)

    def encode(self, texts: list[str | None]) -> Encoded:
        """Ids and terms of each text with its end id; null counts as empty."""
        if len(self.numbers) > self.most or self.used > TABLE:
            self._empty()
        numbers, get, first = self.numbers, self.numbers.__getitem__, self.numbers.next
        found: list[np.ndarray | None] = []
        for t in texts:
            if not t:
                found.append(np.zeros(1, np.int64))
            elif "<|" in t or t[0].isspace() or t[-1].isspace() or _RUN.search(t):
                found.append(None)
            else:
                # a line end is set before the first part and its id left out below
                parts = f"\n{t}".replace("\n", " \n").split(" ")
                del parts[0]
                parts.append(END)
                found.append(np.fromiter(map(get, parts), np.int64, len(parts)))
        new, numbers.new = numbers.new, []
        self._learn(first, new)
        for w in new:
            if len(w) > LONGEST:
                del numbers[w]
        whole = [i for i, f in enumerate(found) if f is None]
        other_terms, other_texts, other_tokens = [], [], []
        for i, ids in zip(whole, self._library([texts[i] for i in whole])) if whole else ():
            n = numbers.next
            numbers.next = n + 1
            self._keep(n, ids, np.array([len(ids)]), np.zeros(1, np.uint64), np.zeros(1, np.int64))
            found[i] = np.array([n, 0])
            if len(ids):
                _, terms, tokens = self.lexicon.of(ids, np.zeros(1, np.int64))
                other_terms.append(terms), other_texts.append(np.full(len(terms), i)), other_tokens.append(tokens)
        return self._gather(texts, found, set(whole), other_terms, other_texts, other_tokens)

    def _gather(self, texts, found, whole, other_terms, other_texts, other_tokens) -> Encoded:
        if not found:
            none = np.zeros(0, np.int64)
            return Encoded(np.zeros(0, np.uint16), np.zeros(1, np.int64), none.astype(np.uint64), none, none)
        part = np.concatenate(found)
        n_parts = np.array([len(f) for f in found])
        first = np.cumsum(n_parts) - n_parts
        start = self.ends[np.maximum(part, 1) - 1]
        start[part == 0] = 0
        size = self.ends[part] - start
        cut = first[[bool(t) and i not in whole for i, t in enumerate(texts)]]
        start[cut] += 1
        size[cut] -= 1
        ends = np.cumsum(size)
        ids = self.table[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends[first + n_parts - 1]])
        term, doc = self.term[part], np.repeat(np.arange(len(found)), n_parts)
        at = np.flatnonzero(term)
        other = [(t[k], d[k], n[k]) for t, d, n in zip(other_terms, other_texts, other_tokens) for k in [np.flatnonzero(t)]]
        return Encoded(ids, bounds, *(np.concatenate([own, *more]) for own, more in zip((term[at], doc[at], self.token[part[at]]), zip(*other) if other else ((), (), ()))))


_encoders: dict[tuple[str, int], ByteEncoder] = {}


def byte_encoder(path: str, end_id: int) -> ByteEncoder:
    """One encoder for each tokenizer file, end id and Python worker."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = ByteEncoder(path, end_id)
    return _encoders[path, end_id]
