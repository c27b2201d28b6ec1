"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm.chat import read_back, windows
from strandlab.llm.common import documents, small_table, stage
from strandlab.llm.decontaminate import contaminated
from strandlab.llm.exact_dedup import exact_duplicates
from strandlab.llm.merge_dropout import encode_decode
from strandlab.llm.near_dedup import near_duplicates
from strandlab.llm.pii import find
from strandlab.llm.records import token_records
from strandlab.llm.sharding import shards
from strandlab.llm.substring_dedup import remove_repeats
from strandlab.llm.toxicity import held_out, score, train


def vocabulary(name: str) -> str:
    """A public vocabulary file's place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = "</s>[INST] ok [/INST]"
    own = small_table(spark, [(-7, 0, "user", tag), (-7, 1, "assistant", tag)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(stage(windows(rows.unionByName(own)), "formatted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir), 8)


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_records": op4_token_records,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_chat_windows": op7_chat_windows,
    "op8_pii": op8_pii,
    "op9_kd_shards": op9_kd_shards,
    "op10_merge_dropout": op10_merge_dropout,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(t) >= 4 THEN list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' ')))
                      WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS g
  FROM w
), x AS (SELECT doc_id, unnest(g) AS h, len(g) AS n FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (SELECT u, v FROM p WHERE 100 * c >= 80 * (na + nb - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v AS u, u AS v FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.v, r.root FROM r JOIN e ON r.doc_id = e.u)
SELECT s.doc_id, CAST(any_value(len(g)) AS BIGINT) AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept
FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id
""",
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(t) - 18)) AS p, unnest(list_transform(range(1, len(t) - 18), lambda i: array_to_string(t[i:i + 19], ' '))) AS s FROM w WHERE len(t) >= 20),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM g),
gone AS (SELECT DISTINCT doc_id, p + o AS q FROM r CROSS JOIN (SELECT unnest(range(0, 20)) AS o) WHERE k > 1),
words AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS q, unnest(t) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(len(t) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*)::BIGINT AS group_size, arg_min(doc_id, struct_pack(a := -points, b := doc_id)) AS keep_id
  FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
""",
}
