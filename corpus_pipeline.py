"""The corpus pipeline: stages that each read, as Parquet, what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import decontaminate, near, packing, substrings, toxicity
from pathloom.llm._shared import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, rejects (score of 0.5 or more) go.

    Null and empty texts have the bias's score and repeated rows the same score each; without a label nothing goes. A
    score of exactly 0.5 is a rejection. Rows without id stay or go like others. All columns pass through, whatever their
    names and types; an empty table stays empty.
    """
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the least id stays.

    Null and empty texts are no copies of anything, nor are rows without id: all of them stay. A text of fewer than five
    words is one shingle. Rows that share an id stay or go together. A similarity of exactly 0.8 is a link. All columns
    pass through, whatever their names and types; an empty table stays empty.
    """
    return near.keep_one(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that stand earlier in the corpus go; a text that is emptied goes with its row.

    Earlier is a smaller id (null: least), or an earlier place in one document; equal windows at one place of rows that
    share an id don't remove each other. Null, empty and short texts stay as they are, and so does a text, to the byte, that
    repeats nothing; what is left of others is joined by single spaces, and n_chars follows. All other columns pass through,
    whatever their names and types; an empty table stays empty.
    """
    return substrings.remove_repeats(docs, window=20)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go; of a shorter item, with all of its words in a row.

    Null and empty texts have no words and stay, as do all if the benchmark is empty. Items that are null or have no words
    say nothing, items without id count like others; repeated rows stay or go alike. All columns pass through, whatever
    their names and types.
    """
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest is packed: doc_id, piece, n_words, bin_id and start.

    A null or empty text is one piece of no words. A null source conflicts with nothing. Repeated rows are pieces of their
    own and of one cluster, so no two of them share a bin. Of equally tight bins the one that was opened first is taken. No
    rows, no bins.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL has no classifier and no packing; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
