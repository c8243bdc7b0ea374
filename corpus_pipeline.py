"""The corpus pipeline: stages that each take all documents which their predecessor kept.

Language identification drops documents without a language; near-duplicates go, but for one document of each group; personal data is
replaced by its kind; the sources are mixed to their target weights; and what is left is packed into training sequences.

Edge cases, by stage: null and empty texts, and texts without a letter, have no language and go; repeated rows are near-duplicates of each other, so one stays, and where ids are null or
repeat it is any one of them; a null source is mixed as a source of its own; very long texts are handled whole; columns beside those of ``documents`` are carried
through all stages but the last, whatever their names; an empty table, or one of which nothing is kept, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language_id, mixing, packing, pii, simhash
from tessera.llm.common import discard, scratch, table

#: A document whose language scores less than this is rejected; clean texts of a few words score above it.
LEAST_SCORE = 0.2
#: Texts of this Jaccard similarity of five-word shingles are near-duplicates.
SIMILARITY = 0.8

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text has a language; the model learns from the labelled rows of ``docs``."""
    return language_id.keep_languages(docs, language_id.train(docs), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of near-duplicates: fingerprints of at most 4 bits apart, or five-word similarity of 0.8 or more."""
    return simhash.keep_one(docs, similarity=SIMILARITY)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; the model is fitted on ``docs``."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or parts of them, that the mix of sources takes, as often as it takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. What a stage writes on its way goes when its result is written, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            docs, path = keep(stage(spark, docs, sf_dir), f"stage{number}")
        discard(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
