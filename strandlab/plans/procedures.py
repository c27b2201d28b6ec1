"""Queries that SQL can't express; tests hold them against other forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.operators import learning, mechanism
from strandlab.operators import procedures as P
from strandlab.plans.dialect import WIDE, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in WIDE else rows


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.features(_table(spark, sf_dir, "documents")).join(_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


def ncd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item with its successor."""
    b = _table(spark, sf_dir, "benchmark")
    pairs = b.select(F.col("item_id").alias("a_id"), F.col("text").alias("a")).join(b.select(F.col("item_id").alias("b_id"), F.col("text").alias("b")), F.col("b_id") == F.col("a_id") + 1)
    return P.compression_distances(pairs)


QUERIES = {
    "mechanism_study": mechanism.study,
    "compression_ratio": lambda s, d: P.compression_ratio(_table(s, d, "documents")),
    "compression_shuffle_gain": lambda s, d: P.compression_shuffle_gain(_table(s, d, "documents")),
    "length_pattern_shuffle_gain": lambda s, d: P.compression_shuffle_gain(_table(s, d, "documents"), mode="length"),
    "ncd_pairs": ncd_pairs,
    "length_low_freq_power": lambda s, d: P.low_frequency_power(_table(s, d, "documents")),
    "null_copy_mutate": lambda s, d: P.copy_mutate(_table(s, d, "documents")),
    "null_markov": lambda s, d: P.markov(_table(s, d, "documents")),
    "adfgx_order_search": lambda s, d: P.order_search(_table(s, d, "benchmark")),
    "order2_gain": lambda s, d: P.second_order_gain(_table(s, d, "benchmark")),
    "bpe_merge_first": lambda s, d: s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(P.fit_merges(_table(s, d, "documents"), 4))], "merge_id int, a string, b string"),
    "learned_units_apply": lambda s, d: P.apply_merges(_table(s, d, "documents"), P.fit_merges(_table(s, d, "documents"), 4)),
    "logistic_transfer": lambda s, d: learning.summary(learning.out_of_family(_labelled(s, d), "lang", (0,)), by=("family",)),
    "forest_transfer": lambda s, d: learning.summary(learning.out_of_family(_labelled(s, d), "lang", (1,)), by=("family",)),
    "robust_logistic_transfer": lambda s, d: learning.summary(learning.out_of_family(_labelled(s, d), "lang", (2,)), by=("family",)),
    "logistic_out_of_fold": lambda s, d: learning.summary(learning.out_of_fold(_labelled(s, d), (0,))),
    "oof_group_kfold": lambda s, d: learning.out_of_fold(_labelled(s, d)),
}
