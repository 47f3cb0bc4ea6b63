"""The corpus pipeline: language, quality, near copies, packing, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import language, packing, quality, simhash
from palimpsest.llm.common import checkpointed, read
from palimpsest.llm.queries import tokenizer_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from the stage's own labelled documents.

    Null, empty and letterless texts aren't recognised and go; null languages teach nothing; repeated rows are judged alike;
    other columns stay, whatever their names; without any labelled text no language is known and all go; an
    empty table stays empty.
    """
    found = language.identify(docs, language.learn(docs))
    return found.where(~F.col("lang_rejected")).select(*docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject.

    A null text counts as empty, other nulls as unknown; repeated rows are judged alike; scores equal to the threshold stay; of
    contradicting labels the lower counts; other columns stay, whatever their names; with too few labels a
    warning is given and all stay; an empty table stays empty.
    """
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("quality_keep").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest id stays, a null one only if there is no other; null and empty texts are copies of each other, as are repeated
    rows, of which one stays; other columns stay, whatever their names; an empty table stays empty.
    """
    return simhash.one_of_each_group(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 1024 tokens.

    A null or empty text is one token; null ids stay null; repeated rows are packed each; further columns are not read; an
    empty table gives none.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("quality_classifier", keep_good_quality),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("packing", pack_sequences),
]

#: No stage can be expressed in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next reads them."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
