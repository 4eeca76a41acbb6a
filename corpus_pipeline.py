"""From raw documents to packed sequences: five stages, each written as Parquet and read again as the next one's input.

Every stage takes documents (doc_id, text, source and any others) and, but for the last, returns their columns.  An empty table
passes as an empty table.  A null text counts as empty, and stays null where its row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomworks.llm import mixing, ngram_join, packing, secret_scan
from loomworks.llm import toxicity as grammar
from loomworks.llm._store import fresh_path, scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go.

    Learned from the training rows of labels only.  A null or empty text has the score of a text without clauses; rows that repeat
    go or stay together; a score of exactly 0.5 goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(grammar.remainder() != 0)
    return grammar.keep_clean(docs, grammar.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    A null doc_id is larger than any; of rows equal in doc_id and text one stays; of rows that tie in doc_id only, the one of the
    smaller text hash.  Texts without words are no copies of each other: one row for each doc_id and text stays.
    """
    return ngram_join.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; spans of secrets are replaced.

    A document is a repository and its source the owner (a null one counts as one owner); rows that repeat are one repository.
    n_chars, if there is one, is counted anew where a text has changed.
    """
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's budget's end is cut there.

    Texts without words are taken no times, and so are gone.  A null source is a source.  Rows that repeat are taken each, in an
    order that depends on doc_id, words and text only.
    """
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their place in sequences.  Repeats of a document are pieces of their own.

    A null or empty text is one piece, the end id.  A null doc_id stays null.
    """
    return packing.pack_documents(docs, with_ids=True)


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("secret_scan", secrets), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None  # a trained grammar and a tokenizer are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        with scratch(spark):
            docs = table(stage(spark, docs, sf_dir), name, path=path)
    return docs
