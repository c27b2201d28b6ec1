"""Helpers that the training-data operators share: scratch tables, row keys, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.functions.workers import mapped as mapped

#: White space of all word rules: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


#: Shuffle files of an execution go when it has ended (a setting of Spark's).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir of the session. Where that is unset, a run on one
    machine (as in tests) gets a new local folder; on a cluster that is an error, as machines don't see each other's."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='strandlab-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and a lost executor costs no more
    than the tasks that it ran. Unlike checkpoint(), it computes df once and compresses what it writes; the shuffle files
    that it took go as soon as the table is there."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.strandlab_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of stage() that nothing will read again."""
    for t in tables:
        place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.strandlab_folder)
        place.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(x)


def small_table(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """A few rows of numbers and strings as literals of the plan, which needs no Python to run. kind: "a int, b string"."""
    columns = [c.split() for c in kind.split(",")]
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS `{c}`" for c, k in columns) + " WHERE false")
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return spark.sql("SELECT " + ", ".join(f"CAST(v{i} AS {k}) AS `{c}`" for i, (c, k) in enumerate(columns)) + f" FROM VALUES {values} AS t(" + ", ".join(f"v{i}" for i in range(len(columns))) + ")")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def has_unique_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether every row has an id of its own. Reads the id column alone."""
    odd = docs.groupBy(F.col(id_col).cast("long").alias("k")).count().where((F.col("count") > 1) | F.col("k").isNull())
    return odd.isEmpty()


def row_numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with the rows' gapless positions (from 0) in the given order, without sorting in one task: a range
    partitioning, each partition's own numbers, and the offsets of the partitions (one row each)."""
    parts = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "numbered")
    # monotonically_increasing_id counts within a partition in its lower 33 bits
    sizes = parts.groupBy("__p").count().collect()
    before, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r["__p"]):
        offsets.append((r["__p"], before))
        before += r["count"]
    table = small_table(df.sparkSession, offsets, "__p int, __before long")
    return parts.join(F.broadcast(table), "__p").withColumn(out, F.col("__before") + F.col("__i").bitwiseAND((1 << 33) - 1)).drop("__p", "__i", "__before")


def per_row(docs: DataFrame, run: Callable[[DataFrame], DataFrame], ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """run(docs), where run needs docs to have unique ids that aren't null.

    Tables that meet this go straight through. In others each row counts as a document of its own: rows are numbered
    by (doc_id, nulls last; text), run sees the numbers as doc_id, and the columns `ids` of its result are turned back
    into doc_id (null where it was null)."""
    if has_unique_ids(docs):
        return run(docs)
    spare = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__last", F.col("__id").isNull())
    text = [c for c in ("text",) if c in docs.columns]
    rows = stage(row_numbered(spare, ["__last", "__id", *text], "__row"), "rows")
    out = run(rows.withColumn("doc_id", F.col("__row")).drop("__id", "__last", "__row"))
    for c in ids:
        names = rows.select(F.col("__row").alias("__k"), F.col("__id").alias("__v"))
        order = out.columns
        out = out.join(names, out[c] == names["__k"], "left").withColumn(c, F.col("__v")).select(*order)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the links (u, v) reaches.

    Alternates large-star and small-star steps on distributed tables until no link changes. Every step is two
    aggregations with map-side combining and two joins on a node; links of a hub are split by adaptive skew joins.
    Nothing is collected but two sums."""
    cur = stage(edges.select("u", "v").where("u <> v").distinct(), "links")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(cur)
    while before[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        cur = stage(small.where("u <> v").distinct(), "links")
        now = state(cur)
        if now == before:
            break
        before = now
    return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
