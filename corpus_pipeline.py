"""From documents to training sequences in five stages, each written as a table and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import kept, small_batches, table
from flowloom.llm.langid import document_languages
from flowloom.llm.minhash import near_duplicates
from flowloom.llm.packing import pack
from flowloom.llm.quality import quality_scores, trained
from flowloom.llm.queries import vocabulary
from flowloom.llm.substrings import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = ("text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; every row is judged by its text alone."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = trained(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, model, keep=REST).where("predicted = 1").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear (probability of 0.5 or more) and is the declared one, if one of the four is declared."""
    small_batches(spark)
    found = document_languages(docs.select(*COLUMNS), keep=REST)
    declared = F.lower("lang")
    fits = F.coalesce(~declared.isin("de", "en", "es", "fr"), F.lit(True)) | (F.col("found") == declared)
    return found.where((F.col("probability") >= 0.5) & fits).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document of smallest id, once.

    Rows without an id and texts without words stay.  Of an id with several
    texts each is judged by itself.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS).withColumn("_mark", F.xxhash64("text"))
    gone = near_duplicates(docs).where("not stays").select("doc_id", F.col("mark").alias("_mark")).distinct()
    left = docs.where("doc_id is not null").join(gone, ["doc_id", "_mark"], "left_anti").dropDuplicates(["doc_id", "_mark", "text"])
    return left.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that an earlier one has; those that nothing is left of go."""
    small_batches(spark)
    cut = dedup_substrings(docs.select(*COLUMNS), keep=("lang", "source"))
    left = cut.where("n_removed = 0 or length(trim(text)) > 0")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4,096 tokens, mixed by source."""
    small_batches(spark)
    pieces = pack(docs.select(*COLUMNS), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("language ID", language), ("MinHash near-dedup", near_duplicate), ("substring dedup", substring), ("packing", packing)]

#: SQL has no form of the classifier, the language model or the tokenizer; the operators are held against brute force and libraries in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
