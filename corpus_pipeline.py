"""Documents made ready for training in five stages, each calling one operator of ``fieldcast.llm``.

Every stage works on all rows its predecessor kept and returns the columns it was given; the last returns the pieces of the packed
sequences.  Rows may hold nulls, repeats and further columns, also such with names that the operators use; they pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm import decontamination, packing, pii, quality, simhash
from fieldcast.llm.common import cut, table
from fieldcast.llm.tokens import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    found, name = quality.annotate(docs, table(spark, sf_dir, "labels"))
    return found.where(F.col(name)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a noticeable share of benchmark windows."""
    found, name = decontamination.annotate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col(name)["contaminated"]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` is counted anew."""
    found, (_, text) = pii.annotate(docs, clean_text=True)
    new = {"text": F.col(text)} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer=vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Likelihood ratios, components and dynamic programming have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
