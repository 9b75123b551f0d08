"""A corpus pipeline of five stages, each of which applies one operator to all that the stage before it kept.

Stages take (spark, docs, sf_dir); each result is written as Parquet to the shared folder and read again as the next
stage's documents. All but the last return the columns of ``documents``. Joins of documents with what a stage found
are sort-merge joins at every size, since both sides grow with the corpus.

1. language_id: documents in no learned language, or without a letter, go.
2. simhash_near_dedup: of each class of near copies (five-word shingles, similarity 0.8 or more, exact) the document with
   the smallest id stays.
3. decontaminate: documents that contain a benchmark item go.
4. mix_sources: documents are taken as often as their source's budget says; the last one taken is cut to fit.
5. token_output: documents are encoded into wavelet shards and described as read back.

No stage tells documents apart by doc_id alone, so null and repeated ids lose or keep nothing: stages 1 and 3 judge each
text, stage 2 keeps one row of a class whatever its ids (the smallest, null last; rows alike in all columns are one), and
stage 4 numbers its rows. A null or empty text has no letter and goes in stage 1; stages called alone on such rows keep
one of them in stage 2, all in stage 3, and take none in stage 4. Empty tables give empty results; columns beside those
of ``documents`` are carried through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import common, decontam, langid, mix, near, wavelet
from geoloom.llm.queries import table, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accept(docs, langid.train(docs.where(~langid.held_out(F.col("doc_id")))))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed_rows(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wavelet.token_output(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]
#: N-gram filters, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        given, docs = docs, common.materialize(stage(spark, docs, sf_dir))
        common.release(given)  # only the last stage's rows stay
    return docs
