"""From raw documents to packed training sequences; counted as a part of the subpackage ``veripaper.llm``.

Each stage takes (spark, docs, folder of the tables) and works on all rows its predecessor kept; all but
the last return the columns of ``documents``. The result is written as Parquet and read again between
stages, so a lost executor repeats at most one stage's tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veripaper.llm.exact_dedup import exact_dedup
from veripaper.llm.language_id import UNKNOWN, labelled_samples, language_id
from veripaper.llm.near_dedup import near_dedup
from veripaper.llm.packing import packed
from veripaper.llm.shared import table, written
from veripaper.llm.substring_dedup import substring_dedup


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, which have no language, go."""
    found = language_id(docs, labelled_samples(docs), carry=True)
    return found.where(F.col("lang_pred") != UNKNOWN).select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal up to white space the longest stays."""
    return exact_dedup(docs, carry=True).where("kept").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest identifier stays."""
    gone = near_dedup(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has are cut out; a document without any other word goes."""
    found = substring_dedup(docs, carry=True).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    columns = [
        (F.when(changed, new[c]).otherwise(F.col("row")[c]) if c in new else F.col("row")[c]).alias(c) for c in docs.columns
    ]
    return found.select(columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("packing", sequences),
]

#: Trained models and tokenizers are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``.

    A null or empty text has no letter and goes in the first stage; a row without identifier goes only as an exact
    copy; repeated rows are copies, of which one stays; an empty table gives no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
