"""Registered queries of the operators: one thin query each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprism.llm import (alignment, exact, line_rules, mixing, multiset_hash, nbsvm, packing, repeats, semicrf, simhash, sql, url_rules,
                          warc, whitening)
from tabprism.sources.scratch import scratch_path
from tabprism.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: (host, path, verdict)
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A small list in ad-block form; a deployment passes its own.
PATTERN_RULES = ["||adult-x.", "||ads-track.", "||casino-win.", "||cheap-pills.", "||free-bets.", "||spam-farm.",
                 "/banner/ads/", "&affid=*&clickid=", "@@||spam-farm.example.org/es/"]


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return keep


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary, the byte-level BPE one by default."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_line_frequency", sql.op1(max_docs_per_host=20, min_kept_share=0.3))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the cross-document line frequency verdict of every document."""
    return line_rules.judge_documents(read_table(spark, sf_dir, "documents"))


@register("op2_semi_markov_crf")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document: base patterns and those the semi-Markov field adds."""
    docs = read_table(spark, sf_dir, "documents")
    found = semicrf.find_personal_data(docs, semicrf.fit(docs), keep=["doc_id"])
    return found.select("doc_id", *[f"n_{k}" for k in semicrf.BASE_KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


@register("op3_simhash_index")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@register("op4_hilbert_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed along a Hilbert curve into sequences of 2048 tokens."""
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op5_warc_transactions", sql.op5())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records, read back and assembled to one row per capture."""
    path = warc.write_warc(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.resolve_revisits(warc.assemble(warc.read_warc(spark, path)))


@register("op6_bwt_intervals")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 50-byte strings of documents with smaller ids, removed."""
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"), length=50)


def held_out(doc_id):
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def quality_model(docs: DataFrame, labels: DataFrame) -> nbsvm.Model:
    return nbsvm.fit(docs, labels.where(~held_out(F.col("doc_id"))), label="quality")


@register("op7_nb_svm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality_model(docs, read_table(spark, sf_dir, "labels"))
    scored = nbsvm.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op8_multiset_hash", sql.op8())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, window = multiset_hash.with_next(docs, "doc_id", "text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("_next", F.lead("text").over(window))
    rows = multiset_hash.with_fingerprint(rows, "text", "_own_print")
    rows = rows.withColumn("_next_print", F.lead("_own_print").over(window)).where("_own")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "_edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half)))
    rows = multiset_hash.with_fingerprint(rows.drop("text", "_next"), "_edited", "_edited_print")
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        multiset_hash.as_text(F.col("_own_print")).alias("fingerprint"),
        multiset_hash.as_text(F.col("_edited_print")).alias("edited_fingerprint"),
        multiset_hash.likeness(F.col("_own_print"), F.col("_edited_print")).alias("near_edited"),
        multiset_hash.likeness(F.col("_own_print"), F.col("_next_print")).alias("near_next"))


@register("op9_temperature_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a mix whose source weights are flattened to 98 % of the largest entropy, repeated twice at most."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).drop("text")


@register("op10_url_rules", sql.op10(HOST_RULES, PATTERN_RULES))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host rule and verdict of every page's URL."""
    return url_rules.judge_urls(read_table(spark, sf_dir, "pages"), "page_id", "url", HOST_RULES, PATTERN_RULES).drop("pattern")


@register("op11_csr_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and overlap links of every document under two tokenizers."""
    return alignment.align(read_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


@register("op12_weighted_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every usable vector."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=4, weights="one")


@register("op13_grace_dedup", sql.op13())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document, and whether it stays."""
    return exact.find_groups(read_table(spark, sf_dir, "documents"))
