"""Stages of the corpus pipeline: each takes documents and keeps what its operator accepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincart.llm import decontaminate, langid, packing, simhash
from graincart.llm import toxicity as toxicity_op
from graincart.llm.common import TOKENIZER, configure, read_table


def _boxed(docs: DataFrame) -> DataFrame:
    """(row, text): the whole row as one column, so that no operator's column meets one of the caller's, whatever its name."""
    return docs.select(F.struct(F.col("*")).alias("row"), F.col("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognisable language; null and empty texts and texts without a letter go.

    The trees are learned from a sample of all labelled rows: a stage holds no fold out. Repeated rows
    and ties are judged alike; an empty table stays empty; all columns are kept, of any name.
    """
    configure(spark)
    model = langid.train(read_table(spark, sf_dir, "documents"), F.lit(False))
    return langid.identify(_boxed(docs), model).where("lang_pred != 'und'").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7; the lexicon is learned from every labelled document.

    Null and empty texts hold no term and stay. Repeated rows are judged alike; an empty table stays
    empty; all columns are kept, of any name.
    """
    configure(spark)
    model = toxicity_op.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), F.lit(False))
    return toxicity_op.score(_boxed(docs), model).where("score < 0.7").select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Links are SimHash fingerprints at two or fewer differing bits, as in query 7, and five-word
    similarity of 0.8 or more, which SimHash at two bits misses; groups are what both together reach. Texts without a word are copies of each other; of rows that share an id and a group any one stays;
    rows without an id stay only where their whole group has none; an empty table stays empty; all
    columns are kept, of any name.
    """
    configure(spark)
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover half of any benchmark item.

    Null and empty texts cover nothing and stay. Repeated rows are judged alike; an empty table, or an
    empty benchmark, changes nothing; all columns are kept, of any name.
    """
    configure(spark)
    return decontaminate.judge(_boxed(docs), read_table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places.

    Null and empty texts are one piece, the end id; repeated rows are pieces of their own; null ids are
    carried along; an empty table gives no piece; columns but the id are not returned.
    """
    configure(spark)
    return packing.pack(packing.pieces(docs, TOKENIZER))
