"""A corpus pipeline from documents to packed training sequences; five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, langid, mixing, neardup, packing
from larkspur.llm.tables import load, materialise

#: Least probability of its language with which a document stays.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null, has no letter, or speaks for no learned language.

    The model is learned from the labelled documents of ``docs`` that are not held out.
    """
    model = langid.train(docs.filter(~langid.held_out() & F.col("lang").isNotNull()))
    lang, score = (_free(name, docs.columns) for name in ("lang_pred", "score"))
    found = langid.identify(docs, model, lang_out=lang, score_out=score)
    return found.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints, the one with the smallest id stays."""
    return neardup.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as the mix takes them: not at all, or up to three times."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("source_mixing", source_mix),
    ("best_fit_packing", packed),
]

#: Naive Bayes, XXH64 and subword ids have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
