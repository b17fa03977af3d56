"""The corpus pipeline: quality, near-duplicates, repeated strings, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; ``docs`` has the columns of
``documents``, and all but the last stage return those. ``run`` writes each stage's result to the shared folder and reads
it back, so that a lost executor costs one stage's tasks and no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import near_dedup, packing, pii, quality, suffix_dedup
from gridloom.llm.queries import table, vocabulary
from gridloom.session import settle

#: Documents that score below are rejected.
QUALITY_AT = 0.3
#: Bytes of the repeated strings that are cut out (passages of some 50 words and more, in words of any length), and of the grams
#: that anchor them.
REPEAT_BYTES, REPEAT_GRAM = 200, 48


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject; it learns from the labels of ``documents`` that aren't held out.

    Every row is judged by its own whole text, whatever its length: repeated rows alike, null and empty texts as a text without
    words. Null ids and other columns, whatever their names, play no part. An empty table gives an empty result.
    """
    model = quality.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, QUALITY_AT)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-copies, the one with the least id; rows that link with nothing stay.

    Null and empty texts and rows without an id link with nothing. Of rows that repeat an id (or have none) and a text, one
    stays. Texts are compared in whole; other columns may have any name; an empty table gives an empty result.
    """
    return near_dedup.keep_first(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with every repeated string of ``REPEAT_BYTES`` bytes cut out of their text; ``n_chars`` follows the text.

    All occurrences go, also in one and the same text and at any length of it; a character is never split. Null texts stay null,
    a text may become empty, rows stay. Other columns may have any name; an empty table gives an empty result.
    """
    return _counted(suffix_dedup.cut_repeats(docs, width=REPEAT_BYTES, gram=REPEAT_GRAM), docs)


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with personal data replaced by its kind in brackets; ``n_chars`` follows the text.

    Row by row: null texts stay null, empty ones empty, repeated rows are treated alike, long texts in whole; other columns may
    have any name; an empty table gives an empty result.
    """
    return _counted(pii.redact(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence of at most 2048 tokens.

    Null and empty texts are a piece of one token; longer ones than a sequence are cut; ids may be null or repeat; pieces of equal
    length are told apart by where their rows stand. Other columns are left out; an empty table gives an empty result.
    """
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeated_strings),
    ("PII", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: Hashing, a fitted model and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other; odd rows are treated as each stage says."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
