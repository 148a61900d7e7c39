"""The corpus pipeline: quality rules, near and exact duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of documents (the last one
token ids). A stage works on all rows it is given, nulls and repeated rows included: rows with null
or empty texts have too few words and go in the first stage; repeated rows count as near-duplicates
and one of them stays; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethogrid.llm import mixing, neardup, pieces, quality, suffixes
from ethogrid.session import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the ratio keep."""
    judged = quality.quality_rules(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return judged.where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates by five-word shingles.

    Of rows with one doc_id the one with the smallest text stays (then by lang, source and n_chars), whatever order they
    come in; rows without a doc_id stay.
    """
    docs = docs.select(*COLUMNS)
    kept = neardup.near_duplicates(docs, neardup.Params(words=5)).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return named.select("doc_id", "row.*").unionByName(docs.where("doc_id is null"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that earlier ones hold; those of which no word is left go."""
    left = suffixes.substring_dedup(docs.select(*COLUMNS), carry=("lang", "source"), with_text=True)
    return left.where(F.regexp_like("text", F.lit(mixing.WORD))).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the mix takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and whether decoding them gives the text back."""
    return pieces.encode_pieces(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", substring_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", token_stage),
]
#: Estimates, sketches and Viterbi scores have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the checkpoint folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
