"""A training corpus from `documents`: stages that each call one operator of lodestone.llm.

Every stage works on all rows that its predecessor kept and its decisions take effect; all but the last return the
columns of their input. Null and empty texts are low quality or have no language, unless labels say otherwise; further
columns pass through, whatever their names; very long texts are taken whole; of repeated rows and ties the first stays; an
empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, langid, packing, quality, simhash
from lodestone.llm.common import fresh, table, written

QUALITY_THRESHOLD = 0.3
LIKENESS_FLOOR = 0.1  # of the nearest language profile; whole texts in a learned language have 0.4 or more


def _kept(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[f"`{c}`" for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    score = fresh("score", docs.columns)
    return _kept(quality.predict(docs, model, docs.columns, score).filter(F.col(score) >= QUALITY_THRESHOLD), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents like a learned language stay; those without a letter, or hardly like the nearest profile, go."""
    profiles = langid.learn(docs)
    lang, score, like = (fresh(c, docs.columns) for c in ("lang_pred", "share", "likeness"))
    said = langid.predict(docs, profiles, keep=docs.columns, out=(lang, score), likeness=like)
    return _kept(said.filter((F.col(lang) != langid.UND) & (F.col(like) >= LIKENESS_FLOOR)), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of similar texts stays: five-word shingles, similarity of 0.8 or more."""
    return simhash.first_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
