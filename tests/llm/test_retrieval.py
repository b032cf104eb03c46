"""Retrieval packing: ids against the library, scores against BM25's formula, and whole placements."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from weftspark.llm import retrieval
from weftspark.llm.bytepieces import ByteEncoder
from weftspark.llm.queries import QUERIES
from weftspark.llm.wordpieces import tokenizer_path

DATA, PATH = "/root/testdata/sf0.001", tokenizer_path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "Hello, WORLD. don't", "J̌ İ  x\x1cy", "<|endoftext|> a <|ENDOFTEXT|>", "é ́a ..a.. ,b 'S 12", "x" * 300, " a　b", "a\nb c\n d", "a\n\nb", "a b\n", "tab\tx y\r\nz", "'s 't we'll 'LL",
    "１２ ³ ½a", "a\x85b c d", "\x00 a\x00b", "🙂 🙂🙂 e", "x　 y", "x 　y", "q " + "y" * 70 + " z", "\n", "a\n\n\n b",
]


@pytest.fixture(scope="module")
def encoder():
    return ByteEncoder(PATH, 1)


def ids(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_library(encoder):
    texts = ODD + [r["text"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    small = ByteEncoder(PATH, 1, store=3)
    small.merges = None  # through the library
    for e in (encoder, encoder, small, small):
        got = e.encode(texts)
        assert [got.ids[a:b].tolist() for a, b in zip(got.bounds, got.bounds[1:])] == [ids(encoder, t) for t in texts]
    assert len(encoder.encode([]).ids) == 0


def test_terms_come_from_ids_alone(encoder):
    texts = [t for t in ODD if t] + ["The end. of THE-end, the\nend"]
    got = encoder.encode(texts)
    at, terms, tokens = encoder.lexicon.of(got.ids, got.bounds[:-1])
    doc = np.searchsorted(got.bounds, at, "right") - 1
    for i in range(len(texts)):
        own = Counter(zip(terms[(doc == i) & (terms > 0)].tolist(), tokens[(doc == i) & (terms > 0)].tolist()))
        mine = Counter(zip(got.terms[got.texts == i].tolist(), got.tokens[got.texts == i].tolist()))
        # the end id is a token without white space: it may only add to the last term
        assert sum((mine - own).values()) <= 1
    words = encoder.encode(["The end of\nthe End the"])
    assert words.terms[0] == words.terms[3] == words.terms[5] and words.terms[1] == words.terms[4]


def test_scores_are_bm25():
    rng = np.random.default_rng(0)
    bags = [rng.integers(1, 40, rng.integers(0, 30)).tolist() for _ in range(60)]
    hashes = rng.integers(1, 2**63, 40, np.uint64)
    texts = np.concatenate([np.full(len(b), i) for i, b in enumerate(bags)])
    terms = hashes[np.concatenate(bags).astype(int)]
    df = Counter(t for b in bags for t in set(b))
    mean = sum(map(len, bags)) / len(bags)
    idf = np.zeros(retrieval.SLOTS)
    for t, n in df.items():
        idf[retrieval.slots(hashes[[t]])] = math.log(1 + (60 - n + 0.5) / (n + 0.5))
    index = retrieval.Index(60, texts, terms, idf, mean)
    for seed in range(60):
        want = [sum(math.log(1 + (60 - df[t] + 0.5) / (df[t] + 0.5)) * b.count(t) * 2.2 / (b.count(t) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for t in set(bags[seed]) if t in b) for b in bags]
        assert np.allclose(index.scores(seed), want)
        unused = rng.random(60) < 0.7
        best = sorted((i for i in range(60) if unused[i] and i != seed and want[i] > 0), key=lambda i: (-round(index.scores(seed)[i], 12), i))
        assert list(index.nearest(seed, unused)) == best


def whole(rows, texts, encoder, capacity=2048):
    """Pieces cover every text; sequences are gapless, and full or of a power of two."""
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and at & (at - 1) == 0
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(ids(encoder, t))
    assert of.keys() == want.keys()
    for i, pieces in of.items():
        assert sum(n for _, n, _, _ in pieces) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            own, at = want[i][0], 0
            for start, n, crc, total in sorted(pieces):
                assert (start, total) == (at, len(own)) and crc == zlib.crc32(np.array(own[at : at + n], "<u4").tobytes())
                at += n
    return sequences


def test_query_places_every_id(spark, encoder):
    texts = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    got = QUERIES["op12_retrieval_packing"](spark, DATA).collect()
    sequences = whole(got, texts, encoder)
    total = sum(len(ids(encoder, t)) for _, t in texts)
    assert len(sequences) <= total // 2048 + 11


def test_odd_rows(spark, encoder):
    rows = [*enumerate(ODD), (3, "again"), (None, "no id"), (None, None), (99, "many words " * 9000), *((100 + i, "copy of one text " * 50) for i in range(40))]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, key string, start int")
    for shard in (2048, 7):
        whole(retrieval.pack(df, PATH, shard=shard).collect(), rows, encoder)
    assert retrieval.pack(df.limit(0), PATH).count() == 0
    assert whole(retrieval.pack(df, PATH, capacity=64).collect(), rows, encoder, 64)


def test_windows_hold_neighbours(spark):
    """Texts of twelve vocabularies: nearly all of a window's pieces share the vocabulary of its first one."""
    rng = np.random.default_rng(3)
    topics = [["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(60)] for _ in range(12)]
    rows = [(i, " ".join(rng.choice(topics[i % 12], 70))) for i in range(600)]
    got = retrieval.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).toPandas()
    same = got.sort_values("offset").groupby("sequence_id").doc_id.apply(lambda d: (d % 12 == d.iloc[0] % 12).mean())
    assert same.mean() > 0.8
