"""A corpus pipeline of five operators; each stage reads what the one before it kept.

Every function takes the session, the documents of the stage before and the folder of the source tables, and returns
a frame; all but the last return the columns of ``documents`` (doc_id, text, lang, source, n_chars), and any other that
the user's table has.

Every stage takes null and empty texts, repeated rows and empty tables: no row is lost that the stage does not decide
upon, a null text stays null up to the last stage, an empty table gives an empty one. What a column is named beyond
doc_id, text, source and n_chars changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import common, lines, packing, simhash, suffixes, tokens, toxicity

#: Passages of so many words go if they stand elsewhere too.
REPEAT_WORDS = 51


def _as_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the length of what is now the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model does not call toxic; null and empty texts have nothing that is. Equal texts share
    their verdict."""
    lexicon = toxicity.fit_from_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, lexicon).filter("predicted = 0").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites; the first occurrence of each stays, by doc_id and line. A null
    source is no site. A document all of whose lines go stays, with an empty text."""
    return _as_documents(lines.clean(docs), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group: texts whose SimHash fingerprints differ by three
    bits at most, found over deletion variants as in op5, and those that fingerprints lose, with 0.8 of all their shingles in
    common. Null and empty texts are equal, and of rows that are equal one stays."""
    return simhash.keep_first(docs, bits=simhash.BITS)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of over 50 words, or of 400 bytes, that start elsewhere too. All occurrences go;
    a document that is nothing else stays, with an empty text."""
    return _as_documents(suffixes.remove_repeats(docs, with_text=True, words=REPEAT_WORDS), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, tokens.default_vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("packing", packing_stage),
]

#: Model fitting, near-duplicate groups and tokenisation have no SQL form; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs, name)
    return docs
