"""The corpus pipeline: five stages over ``documents``, each of which works on all that the one before it kept.

``run`` applies the stages; between them each result is written as Parquet in the shared folder and read again, which cuts the lineage.
Null texts count as empty and fall to the quality rules; null ids pass near-duplicate removal; extra columns pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrane.llm import mixing, near_dedup, quality_classifier, quality_rules, unigram
from kestrane.llm.common import Scratch, crc_mod, free, table
from kestrane.llm.queries import PIECES

#: Share of the tokens that the mixture keeps: documents of overrepresented cells go, by calibrated probabilities.
MIX_FRACTION = 0.8


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule."""
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's own input, scores 0.5 or more."""
    names = docs.columns
    learn = crc_mod(F.col("doc_id"), 3) != 1
    model = quality_classifier.fit(docs.filter(learn).select("doc_id", "text"), table(spark, sf_dir, "labels").filter(learn))
    return quality_classifier.scored(docs, model).filter(F.col(free(names, "_score")) >= 0.5).select(*names)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow tempered source, language and topic marginals."""
    return mixing.sample(docs, fraction=MIX_FRACTION)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, and whether they decode to its text."""
    out = unigram.encoded(docs.select("doc_id", "text"), unigram.load(spark, PIECES))
    same = F.col("_decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_pieces"), F.col("_ids").alias("piece_ids"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Fitted weights, 64-bit hashes and Viterbi have no SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        kept = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
