"""From documents to token ids: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of the
next. All stages but the last return the columns of documents, the rows' order aside as they came; the last returns the
token ids of each document.

Every stage takes rows with null or repeated ids as documents of their own, null and empty texts, empty tables and extra
columns, which pass through all stages but the last. An empty table stays empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm import decontaminate, exact_dedup, merge_dropout, near_dedup, toxicity
from strandlab.llm.common import documents, per_row, stage
from strandlab.llm.queries import vocabulary


def _kept(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs whose doc_id decide() keeps; rows without an id of their own are told apart by per_row."""

    def run(d: DataFrame) -> DataFrame:
        keep = decide(d).where("kept").select(F.col("doc_id").alias("__kept"))
        return d.join(keep, d["doc_id"] == keep["__kept"], "left_semi")

    return per_row(docs, run)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier predicts to be toxic. It is fitted on labelled rows of docs outside the held-out fold; without any
    toxic and other label it has no ground to reject a document. Null and empty texts stay, unless an empty text scores as
    toxic; of repeated rows all go or stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.accepted(docs, toxicity.train(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space stays, the longest as given, then the one with
    the smallest id; so one of all null and empty texts stays."""
    return _kept(docs, exact_dedup.exact_duplicates)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id (five-word shingles, similarity 0.8). Null
    and empty texts are near copies of nothing and stay."""
    return _kept(docs, near_dedup.near_duplicates)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its id, its token ids and what encode_decode() says of them. Null and empty texts have no
    ids; repeated rows are encoded each; other columns are not looked at."""
    return merge_dropout.encode_decode(docs, vocabulary("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: SQL can express neither the classifier nor the encoding; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
