"""The corpus pipeline: five stages, each over all that the stage before it kept.

Stages one to three drop documents, the fourth gives each its place in the mix, the last turns their texts into piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, langid, mixing, pieces, quality_cnn
from lodestone.llm.common import lean, materialise, table

PLACE = ["slot", "place_in_block"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the convolutional network does not reject, with all their columns.

    A null text is scored like an empty one; texts are scored whole, however long; a score equal to the threshold stays.
    Repeated rows are all kept or all dropped; without labels every score is the same; an empty table stays empty.
    """
    lean(spark)
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_cnn.score_column(F.col("text"), net) >= quality_cnn.THRESHOLD)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language; those without letters or with a narrow margin go, nulls and empty texts
    among them. The languages are those of the column lang, null ones left out; without any, all documents go. Texts
    are judged whole, however long; a tie of two languages has no margin and goes; repeated rows go or stay together;
    an empty table stays empty."""
    lean(spark)
    return docs.where(~langid.language_column(F.col("text"), langid.fit(docs)).rejected)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that with the least doc_id (null last), and all other rows:
    null, empty and blank texts are near nothing and stay. Of rows equal in id and text one stays; texts are compared
    whole, however long; an empty table stays empty; all columns stay as they are."""
    lean(spark)
    return jaccard.survivors(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and place_in_block: any prefix in their order follows the target weights of the sources. Null is a
    source of its own; sources without a weight have the default; rows of equal id keep a place each; columns of the
    same names are replaced; an empty table stays empty."""
    lean(spark)
    return mixing.schedule(docs, mixing.WEIGHTS).select(*[c for c in docs.columns if c not in PLACE], *PLACE)


def sentencepiece_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids beside the place in the mix, which written files do not keep by their order. A null text has null ids,
    an empty one none; texts are encoded whole, however long; repeated rows have equal ids; an empty table stays empty."""
    lean(spark)
    return pieces.encode_texts(docs, ["doc_id", "lang", "source", *[c for c in PLACE if c in docs.columns]])


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sentencepiece_encode),
]

#: No SQL: networks, compression and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
