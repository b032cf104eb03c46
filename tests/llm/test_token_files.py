"""Token files of whole texts against the library itself, over several shards, with an id of many rows and odd rows."""

import zlib

import duckdb
import numpy as np
from tokenizers import Tokenizer

from weftspark.llm import token_files
from weftspark.llm.wordpieces import tokenizer_path


def library(texts):
    found = Tokenizer.from_file(tokenizer_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, 2], "<u4").tobytes() for e in found]


def places(index):
    return sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(index).collect())


def test_whole_table_equals_the_library(spark):
    folder = "/root/testdata/sf0.001/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from read_parquet('{folder}') order by doc_id").fetchall()
    at, want = 0, []
    for (i, _), raw in zip(rows, library([t for _, t in rows])):
        want.append((at, i, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert places(token_files.write_tokens(spark.read.parquet(folder), tokenizer_path())) == want


def test_an_id_of_many_rows_fills_several_shards(spark):
    rows = [(7, f"word {i} again") for i in range(400)] + [(i, f"text {i}") for i in range(5)] + [(9, "the end"), (None, None), (None, "no id"), (7, "word 3 again")]
    # the other columns have the names that the operator uses itself
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, shard int, ids string").repartition(3)
    index = token_files.write_tokens(frame, tokenizer_path())
    assert index.filter("doc_id = 7").select("shard").distinct().count() > 1
    got = places(index)
    ids = [-1 if r[1] is None else r[1] for r in got]
    assert ids == sorted(ids)
    assert [r[0] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    want = sorted((-1 if i is None else i, zlib.crc32(raw)) for (i, _), raw in zip(rows, library([t for _, t in rows])))
    assert sorted((i, r[3]) for i, r in zip(ids, got)) == want
    assert places(token_files.write_tokens(frame.repartition(5), tokenizer_path())) == got
