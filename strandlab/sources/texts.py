"""Text files as sources, tables as sinks: framed bodies, words, passages, source lists with hash gates; immutable JSON lines,
manifests and receipts."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.functions.workers import mapped

#: Lines that frame the body of an e-book file (fixed patterns).
OPENS = r"\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"
CLOSES = r"\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"
#: Words: letters of any script, joined by an apostrophe or a hyphen.
WORD = r"\p{L}+(?:['-]\p{L}+)*"


def framed_body(text: Column) -> Column:
    """What stands between the line that opens the body and the one that closes it; null where a frame is missing."""
    return F.nullif(F.regexp_extract(text, rf"(?is){OPENS}[^\n]*\n(.*?){CLOSES}", 1), F.lit(""))


def letters_25(body: Column) -> Column:
    """A-Z alone, in capitals, J as I."""
    return F.translate(F.upper(F.regexp_replace(body, "[^A-Za-z]", "")), "J", "I")


def folded_words(docs: DataFrame, column: str = "text", out: str = "words") -> DataFrame:
    """docs with the words of a column under NFKC and case folding (ß as ss), curly apostrophes as straight ones. These two
    have no JVM form, so this runs in Arrow batches; the words themselves are cut in the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(column)
            own = [None if t is None else unicodedata.normalize("NFKC", t).replace("’", "'").casefold() for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], names=[*batch.schema.names, "__folded"])

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "__folded string"])
    return mapped(docs, run, kind).withColumn(out, F.regexp_extract_all("__folded", F.lit(WORD), F.lit(0))).drop("__folded")


def passages(docs: DataFrame, most: int = 1800) -> DataFrame:
    """path, ord, heading, text, passage_id (first 16 hex digits of the SHA-256 of path, heading and text) of Markdown files
    (path, text): paragraphs under one heading are put together while they have `most` characters at most; a longer
    paragraph is a passage of its own. Files without text have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"path": [], "ord": [], "heading": [], "text": []}
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                heading, held, n = "", "", 0
                blocks: list[tuple[str, str]] = []
                for line in (text or "").replace("\r\n", "\n").split("\n") + [""]:
                    if line.startswith("#"):
                        blocks.append((heading, held.strip()))
                        heading, held = line.lstrip("#").strip(), ""
                    elif line.strip():
                        held += line.rstrip() + "\n"
                    else:
                        blocks.append((heading, held.strip()))
                        held = ""
                own: list[tuple[str, str]] = []
                for h, block in blocks:
                    if block and own and own[-1][0] == h and len(own[-1][1]) + len(block) + 2 <= most:
                        own[-1] = (h, f"{own[-1][1]}\n\n{block}")
                    elif block:
                        own.append((h, block))
                for h, block in own:
                    for k, v in (("path", path), ("ord", n), ("heading", h), ("text", block)):
                        rows[k].append(v)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows["path"], pa.string()), pa.array(rows["ord"], pa.int32()), pa.array(rows["heading"], pa.string()), pa.array(rows["text"], pa.string())], names=list(rows))

    out = mapped(docs.select("path", "text"), run, "path string, ord int, heading string, text string")
    return out.withColumn("passage_id", F.substring(F.sha2(F.concat_ws("\n", "path", "heading", "text"), 256), 1, 16))


def gated(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Of a source list (path, sha256, media_type) the plain texts, with the content of files (path, content, as of Spark's
    binaryFile) and status: ok, missing or hash."""
    rows = sources.where(F.col("media_type") == "text/plain").join(files.select(F.col("path"), F.col("content")), "path", "left")
    status = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.lower("sha256"), "hash").otherwise("ok")
    return rows.withColumn("status", status).withColumn("text", F.when(F.col("status") == "ok", F.decode("content", "UTF-8"))).drop("content")


def manifest(files: DataFrame, root: str) -> DataFrame:
    """path (below root), sha256, bytes, media_type of files (path, content)."""
    name = F.expr(f"substring(path, length('{root}') + 2)")
    kind = F.when(F.col("path").rlike(r"\.json$"), "application/json").when(F.col("path").rlike(r"\.jsonl$"), "application/x-ndjson").when(F.col("path").rlike(r"\.(txt|md)$"), "text/plain").otherwise("application/octet-stream")
    return files.select(name.alias("path"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"), kind.alias("media_type"))


def verified(declared: DataFrame, found: DataFrame) -> DataFrame:
    """path, status of every declared file (path, sha256, bytes): outside-root, missing, size, hash, or ok, the first that
    holds."""
    own = found.select("path", F.col("sha256").alias("s"), F.col("bytes").alias("b"))
    status = F.when(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"), "outside-root").when(F.col("s").isNull(), "missing").when(F.col("b") != F.col("bytes"), "size").when(F.col("s") != F.col("sha256"), "hash").otherwise("ok")
    return declared.join(own, "path", "left").select("path", status.alias("status"))


def upserted(receipts: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Receipts by path, each the one with the largest `order`; of equal ones the new one."""
    both = receipts.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    at = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(order), F.desc("__new")))
    return both.withColumn("__at", at).where("__at = 1").drop("__at", "__new")


def write_immutable(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; an error if the place exists already."""
    columns = sorted(df.columns)
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("errorifexists").text(path)


def write_record(spark, path: str, record: dict) -> None:
    """One record as canonical JSON (sorted keys, no blanks, a line feed at the end); an error if the file exists already."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = store.create(place, False)
    try:
        out.write((json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n").encode())
    finally:
        out.close()
