"""Exact duplicates by deterministic block naming.

The normalised text (UTF-8) is cut into blocks of fixed size. Equal blocks get one integer name: blocks are sorted, and
the name is the number of the block's first occurrence (doc_id * 2**32 + position, as a decimal). Then adjacent names are
paired and each distinct pair gets the number of its own first occurrence, again and again, until every document has one
name. Blocks and pairs are compared themselves, never by a hash, so two documents have one name if and only if their
texts are equal. A text of n blocks takes log2(n) rounds, and each round has half the rows of the one before.

The blocks are shuffled once. Blocks that very many rows have (found by a count of block hashes, combined on the map
side) are sorted in salted parts, whose few first occurrences are then named together; no task gets all their rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.llm.common import BLANKS, per_row, stage

BLOCK_BYTES = 4096
#: A block with more rows than this is sorted in salted parts.
HOT_ROWS = 20_000
SALTS = 64


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def _number(doc: Column, at: Column) -> Column:
    return doc.cast("decimal(38,0)") * F.lit(2**32).cast("decimal(12,0)") + at.cast("decimal(12,0)")


def _named_blocks(docs: DataFrame, block: int, hot_rows: int, salts: int) -> DataFrame:
    """doc_id, i, name of every block."""
    raw = F.encode(normalised(F.col("text")), "UTF-8")
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("raw") - 1) / block)).cast("int"))
    blocks = docs.select("doc_id", raw.alias("raw")).select("doc_id", F.posexplode(F.transform(cuts, lambda i: F.substring("raw", i * block + 1, F.lit(block)))).alias("i", "block"))
    blocks = blocks.withColumn("h", F.xxhash64("block"))
    hot = blocks.groupBy("h").count().where(F.col("count") > hot_rows).select("h", F.lit(True).alias("hot"))
    hot = stage(hot, "hot")
    n_hot = hot.count()
    number = _number(F.col("doc_id"), F.col("i"))
    if n_hot:
        salted = blocks.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "h", "left")
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "i"), F.lit(salts))).otherwise(F.lit(0))
    else:
        salted, salt = blocks.withColumn("hot", F.lit(False)), F.lit(0).cast("long")
    rows = salted.select("doc_id", "i", "block", F.coalesce("hot", F.lit(False)).alias("hot"), salt.alias("salt"), number.alias("number"))
    own = Window.partitionBy("block", "salt").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("name", F.first("number").over(own))
    if not n_hot:
        return stage(rows.select("doc_id", "i", "name"), "names0")
    keep = F.when(F.col("hot") & (F.col("name") == F.col("number")), F.col("block"))
    named = stage(rows.select("doc_id", "i", "name", "hot", keep.alias("block")), "names0")
    firsts = named.where("block is not null")
    whole = firsts.groupBy("block").agg(F.min("name").alias("least"))
    merge = firsts.join(whole, "block").select(F.col("name").alias("part"), "least")
    return named.join(merge, named["name"] == merge["part"], "left").select("doc_id", "i", F.coalesce("least", "name").alias("name"))


def identities(docs: DataFrame, block: int = BLOCK_BYTES, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """doc_id, blocks, name: two documents agree in (blocks, name) if and only if their normalised texts are equal."""
    names = _named_blocks(docs, block, hot_rows, salts)
    sizes = names.groupBy("doc_id").agg(F.max("i").alias("last"))
    cur = names.join(sizes, "doc_id").select("doc_id", "i", "name", (F.col("last") + 1).alias("blocks"))
    single = cur.where("blocks = 1").select("doc_id", "blocks", "name")
    cur = stage(cur.where("blocks > 1"), "names")
    most = cur.agg(F.max("blocks")).first()[0] or 1
    for level in range(math.ceil(math.log2(most))):
        left, right = (F.max(F.when(F.col("i") % 2 == k, F.col("name"))) for k in (0, 1))
        pairs = cur.groupBy("doc_id", "blocks", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(left.alias("a"), F.coalesce(right, F.lit(-1).cast("decimal(38,0)")).alias("b"))
        pairs = stage(pairs.withColumn("number", _number(F.col("doc_id"), F.col("i"))), f"pairs{level}")
        firsts = pairs.groupBy("a", "b").agg(F.min("number").alias("name"))
        cur = pairs.select("doc_id", "blocks", "i", "a", "b").join(firsts, ["a", "b"]).select("doc_id", "i", "name", "blocks")
    return single.unionByName(cur.select("doc_id", "blocks", "name"))


def exact_duplicates(docs: DataFrame, block: int = BLOCK_BYTES, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, dropped ones too.

    Texts are equal when identical without white space (space, \\t, \\n, \\v, \\f, \\r); null counts as empty, and all
    empty texts are equal. Of equal texts the one with the most code points as given stays, then the smallest doc_id.
    Rows with a null or repeated doc_id count as documents of their own (see per_row): exactly one row of a group is
    kept. An empty table gives an empty result; other columns are not looked at."""
    return per_row(docs, lambda d: _exact_duplicates(d, block, hot_rows, salts), ("doc_id", "keep_id"))


def _exact_duplicates(docs: DataFrame, block: int, hot_rows: int, salts: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    rows = stage(identities(docs, block, hot_rows, salts).join(own, "doc_id"), "identities")
    groups = rows.groupBy("blocks", "name").agg(F.min(F.struct(-F.col("points"), F.col("doc_id"))).alias("best"), F.count("*").alias("group_size"))
    out = rows.join(groups, ["blocks", "name"]).withColumn("keep_id", F.col("best.doc_id"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
