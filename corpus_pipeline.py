"""A corpus from quality filter to packed sequences.

Each stage takes ``(spark, docs, sf_dir)``; its result is written to the folder
that all executors share and read again as the next stage's ``docs``.  A stage
reads ``doc_id`` and ``text``, the first one ``lang``, ``source`` and
``n_chars`` too where they exist; it carries all columns along, whatever their
names, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm.exact import keep_exact
from tideweave.llm.packing import pack_documents
from tideweave.llm.privacy import pseudonymise_texts
from tideweave.llm.quality import fit_quality, score_quality
from tideweave.llm.similar import keep_one_per_similar
from tideweave.plans.lineage import drop_made, made_so_far, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    A null text counts as empty; null or missing ``lang``, ``source`` and
    ``n_chars`` are values of their own.  Repeated rows are judged alike, a
    score at the threshold is accepted, and without enough labels all stay.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = score_quality(docs, model, docs.columns, prefix="__quality_")
    return judged.where("__quality_accepted").select(*_own(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays.

    A null text equals an empty one.  Rows that repeat the id and text that
    stay are kept as they are, and rows without an id always stay.
    """
    return keep_exact(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words, 0.8) stays.

    That is the one with the smallest id.  Texts without words, null ones
    included, are one class; rows without an id always stay.
    """
    return keep_one_per_similar(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data pseudonymised; ``n_chars``, if there is one, follows the text.

    A null text stays null, and so does a null ``n_chars``.
    """
    out = pseudonymise_texts(docs, prefix="__pii_")
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", size)
    return out.select(*_own(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2048 tokens.

    A null text packs as its end id alone; every row is packed, repeated or
    without an id.
    """
    return pack_documents(docs)


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: SQL can't express the classifier, the fingerprints or the pseudonyms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = made_so_far()
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # The stage's own tables and its input have been read for the last time.
        drop_made(spark, before, keep=docs)
    return docs
