"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import SQL as COLLOCATIONS
from .common import table
from .divergence import SQL as DIVERGENCE


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces_crc32 (little-endian 32-bit numbers), n_chars of the decoded text, whether it is the text."""
    from .wfst import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores, trained

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, trained(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op5_lattice_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op8_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import page_languages

    return page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores, trained

    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, trained(docs, table(spark, sf_dir, "labels")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_quality, op3_token_counts, op4_substring_dedup, op5_lattice_near_vectors, op6_hmm_scores, op7_mixture_packing, op8_multi_index_search, op9_language_evidence, op10_minhash_near_duplicates, op11_phrase_collocations, op12_toxicity, op13_source_divergence)}

#: The others have no form in SQL; tests/llm holds them against brute force, a library or held-out labels.
ORACLES: dict[str, str] = {"op11_phrase_collocations": COLLOCATIONS, "op13_source_divergence": DIVERGENCE}
