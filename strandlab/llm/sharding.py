"""Shards of near-equal bytes by a k-d tree over metadata; DataFrame operations only.

Points are the distinct texts: copies of a text go together. A node is split along the dimension in which its points
spread widest (relative to all points), at the weighted median of its bytes, until it holds one shard's bytes. The
medians of all nodes of a level are found together by refining histograms: each pass sums bytes by node and bin, and
the driver sees the sums of at most BINS bins for each node. Equal coordinates are told apart by a hash of the text, so
a split can fall between any two points.

All copies of a text lie in one shard. A text whose copies together have more bytes than an even share of what is left
fills a shard of its own (the largest first), and the tree deals the other texts evenly over the other shards."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.common import per_row, small_table, stage

DIMENSIONS = ("doc", "bytes", "lang", "source")
BINS = 2048
_SCALE = 2**30


def _has(docs: DataFrame, name: str):
    return F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")


def shards(docs: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 1), text_crc32, law ("bytes"), shard (0 to n-1), slot (from 0
    without gaps, by doc_id within the shard), grown_shard (null under this law).

    Null metadata counts as the empty string, missing metadata as well; of copies the smallest metadata count. Rows with a
    null or repeated doc_id count as documents of their own (see per_row); an empty table gives an empty result; columns but
    doc_id, text, lang and source are not looked at."""
    return per_row(docs, lambda d: _shards(d, n))


def _shards(docs: DataFrame, n: int) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.crc32(F.coalesce(_has(docs, "lang"), F.lit(""))).alias("lang"),
        F.crc32(F.coalesce(_has(docs, "source"), F.lit(""))).alias("source"),
    )
    rows = stage(own, "sizes")
    points = rows.groupBy("h").agg(F.sum("size").alias("w"), F.min("doc_id").alias("doc"), F.max("size").alias("bytes"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    points = stage(points, "points")
    left = points.agg(F.sum("w")).first()[0] or 0
    alone = []
    for r in points.orderBy(F.desc("w"), "h").select("h", "w").limit(n).collect():  # at most n texts are that large
        if n - len(alone) == 1 or r["w"] * (n - len(alone)) <= left:
            break
        alone.append((r["h"], n - 1 - len(alone)))
        left -= r["w"]
    own_shard = F.broadcast(small_table(spark, alone, "h bigint, shard int"))
    points = points.join(own_shard.select("h"), "h", "left_anti")
    low = points.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in DIMENSIONS for f in (F.min, F.max))).first()
    scaled = [F.floor((F.col(c).cast("double") - F.lit(float(low[f"min_{c}"] or 0))) / max(1.0, float(low[f"max_{c}"] or 0) - float(low[f"min_{c}"] or 0)) * (_SCALE - 1)).cast("long").alias(c) for c in DIMENSIONS]
    points = stage(points.select("h", "w", *scaled, F.xxhash64("h").bitwiseAND(2**32 - 1).alias("tie")), "scaled")
    leaves = _tree(points, n - len(alone)).unionByName(own_shard)
    placed = rows.select("doc_id", "size", "text_crc32", "h").join(leaves, "h").drop("h")
    parts = placed.repartitionByRange("shard", "doc_id").sortWithinPartitions("shard", "doc_id").withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    parts = stage(parts, "slots")
    counts = parts.groupBy("p", "shard").agg(F.min("i").alias("first"), F.count("*").alias("c")).collect()  # a row for each partition, and n more
    before: dict[int, int] = {}
    offsets = []
    for r in sorted(counts, key=lambda r: (r["shard"], r["p"])):
        offsets.append((r["p"], r["shard"], before.get(r["shard"], 0) - r["first"]))
        before[r["shard"]] = before.get(r["shard"], 0) + r["c"]
    table = small_table(spark, offsets, "p int, shard int, offset bigint")
    out = parts.join(F.broadcast(table), ["p", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("i") + F.col("offset")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _tree(points: DataFrame, n: int) -> DataFrame:
    """h, shard: the leaf of every point."""
    spark = points.sparkSession
    cur = points.withColumn("node", F.lit(0))
    todo = {0: (0, n)}  # node: its first shard and how many it holds
    names = 1
    while any(k > 1 for _, k in todo.values()):
        spread = cur.groupBy("node").agg(F.sum("w").alias("w"), *(F.struct((F.max(c) - F.min(c)).alias("x"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in DIMENSIONS)).collect()
        splits = {}
        for r in spread:
            first, k = todo[r["node"]]
            if k > 1:
                dim = max(DIMENSIONS, key=lambda c: r[c]["x"])
                splits[r["node"]] = {"dim": dim, "low": r[dim]["low"] << 32, "high": (r[dim]["high"] + 1) << 32, "below": 0, "goal": r["w"] * (k // 2) / k, "all": r["w"]}
        while work := {v: s for v, s in splits.items() if s["high"] - s["low"] > 1 and s.get("inside", s["all"]) > s["all"] * 1e-5}:
            table = small_table(spark, [(v, s["dim"], s["low"], s["high"], max(1, math.ceil((s["high"] - s["low"]) / BINS))) for v, s in work.items()], "node int, dim string, low bigint, high bigint, step bigint")
            sums = _keyed(cur.join(F.broadcast(table), "node")).where("key >= low and key < high")
            sums = sums.groupBy("node", F.floor((F.col("key") - F.col("low")) / F.col("step")).cast("int").alias("bin")).agg(F.sum("w").alias("w")).collect()
            bins: dict[int, list] = {}
            for r in sums:
                bins.setdefault(r["node"], []).append((r["bin"], r["w"]))
            for v, s in work.items():
                step, below = max(1, math.ceil((s["high"] - s["low"]) / BINS)), s["below"]
                for b, w in sorted(bins.get(v, [])):
                    if below + w >= s["goal"]:
                        s |= {"low": s["low"] + b * step, "high": min(s["high"], s["low"] + (b + 1) * step), "below": below, "inside": w}
                        break
                    below += w
                else:
                    s |= {"low": s["high"], "below": below}
        done = {}
        cuts = []
        for v, (first, k) in todo.items():
            if v in splits:
                s = splits[v]
                # the last bin goes to the side that it fits better
                at = s["low"] if s["goal"] - s["below"] < s["below"] + s.get("inside", 0) - s["goal"] else s["high"]
                cuts.append((v, s["dim"], at, names, names + 1))
                done[names], done[names + 1] = (first, k // 2), (first + k // 2, k - k // 2)
                names += 2
            else:
                cuts.append((v, DIMENSIONS[0], 0, names, names))
                done[names] = (first, 1)  # a leaf, or without points
                names += 1
        table = small_table(spark, cuts, "node int, dim string, at bigint, a int, b int")
        moved = _keyed(cur.join(F.broadcast(table), "node")).withColumn("node", F.when(F.col("key") < F.col("at"), F.col("a")).otherwise(F.col("b")))
        cur = stage(moved.select(*points.columns, "node"), "nodes")
        todo = done
    table = small_table(spark, [(v, first) for v, (first, _) in todo.items()], "node int, shard int")
    return cur.join(F.broadcast(table), "node").select("h", "shard")


def _keyed(rows: DataFrame) -> DataFrame:
    """With key: the coordinate in the node's dimension, then the tie-breaking hash."""
    value = F.coalesce(*(F.when(F.col("dim") == c, F.col(c)) for c in DIMENSIONS))
    return rows.withColumn("key", value * F.lit(2**32) + F.col("tie"))
