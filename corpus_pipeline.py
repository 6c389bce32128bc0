"""A corpus pipeline of five stages: toxicity, near-duplicates, personal data, mixing, packing.

Every stage works on all rows that the one before it kept, read back from Parquet. All but the last return the columns of
``documents``, further columns of any name included, unchanged but for what the stage is for. Null texts count as empty, rows
with null or repeated ids are rows like any other (each stage says below what that means), and an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from branchline.llm import mixing, packing, pii, simhash, toxicity
from branchline.llm.common import discard, fold, free_names, materialize, table
from branchline.llm.queries import vocabulary


def clean_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject (operator 8); repeated rows and null ids are judged by their texts."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels, fold(labels["doc_id"], 4) == 2))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id (operator 5).

    Texts without words are one group. A row of null id stays where its group has no other; rows that share an id each stand
    for their own text's group, and of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def without_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, and n_chars by the new length (operator 6); a null text stays null."""
    return pii.redact_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights by Poisson replication, in shuffled order (operator 4).

    A null source is a source of its own, null ids draw like the text 'null', and rows of equal ids have equal counts. The
    number of a copy and the key of the order are not handed on, and have names that no column has.
    """
    return mixing.mix(docs, names=tuple(free_names(docs.columns, "copy", "key"))).select(*(f"`{c}`" for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 4096 tokens (operator 1): their pieces with all token ids, in the order of the sequence.

    Every copy of a document is packed; an empty one is its end id alone.
    """
    return packing.pack_documents(docs, vocabulary())


STAGES = [("toxicity", clean_only), ("near_dedup", one_of_each), ("personal_data", without_personal), ("mixing", mixed), ("packing", packed)]

#: The toxicity model and the tokenizer have no form in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder, read again, and deleted after the next."""
    docs, written = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
            if written is not None:
                discard(written)
            written = docs
    return docs
