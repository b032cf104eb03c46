"""The queries op1 to op13 over their whole tables, with the operators' production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, html_text, jaccard, mixing, neardup_vectors, packing, periodic, retrieval, token_files, topk, toxicity, urlgraph, warc
from .common import materialize, table
from .wordpieces import tokenizer_path


def op1_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    found = materialize(warc.read(archives, payloads=False), "warc-records")
    warc.discard(archives)
    warc.quarantine(found)
    return found.filter("reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=4, threshold=85)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_tokens(token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_vector_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topk.quantised(topk.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return topk.top_k(v, v.filter("vec_id % 50 = 0"), 5)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.compress(table(spark, sf_dir, "embeddings"))
    checksum = F.lit(None if books is None else codebooks.checksum(books)).cast("string").alias("codebooks_sha256")
    return codebooks.with_label_errors(coded).select("vec_id", "code", "error", "label_error", checksum)


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.runs(periodic.with_planted_runs(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_url_graph, op2_warc_salvage, op3_best_fit_packing, op4_html_text, op5_toxicity, op6_jaccard_join, op7_mix_sources, op8_token_files, op9_vector_near_dup, op10_exact_top_k, op11_vector_codes, op12_retrieval_packing, op13_periodic_runs)}
