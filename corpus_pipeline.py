"""The corpus pipeline: language, near duplicates, benchmark leaks, source mix, token files.

Every stage but the last returns rows of its input, with all their columns, as
they were. Columns are packed while others are computed, so extra ones keep any
name. An empty table gives an empty result at every stage. Each stage's result
is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbra.llm import decontam, langid, mixing, nearcopies, tokenbin
from umbra.llm._shared import written
from umbra.llm.queries import END_ID, table, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, repeated rows each.

    Null and empty texts, and those without a letter, are rejected; so are texts
    near no learned language. Rows without lang train nothing; a table without any
    lang keeps nothing. A text of any length is read whole.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8 or more.

    The least doc_id stays, a null one last; of equal rows any one. Texts without
    words are duplicates of each other.
    """
    return nearcopies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, repeated rows each.

    Null and empty texts hold none; an item without words is in none.
    """
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, up to three times.

    A null source is one of its own; texts without words have size 0 and go as
    their source's rate says. Rows of one doc_id draw alike.
    """
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and a row a document read back from them.

    A null or empty text is the end id alone; null doc_ids stand first, repeated
    rows are written repeatedly.
    """
    return tokenbin.token_output(docs, tokenizer_path(), END_ID)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_files", token_files),
]

#: The classifier, the tokenizer and the hashed draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
