"""Page-and-line transcription files (IVTFF 2.x): lossless physical lines, page headers, logical lines and their typed units.

Files are read whole by Spark, cut into physical lines with their own endings, and numbered; wrapped lines ("/" at the end,
"/" at the start of the next) are joined by a running count of line starts within their file."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandlab.functions.workers import ship

#: Formats of the file type (fixed values).
HEADER = r"^#=IVTFF\s+(\S+)\s+2\.\d+"
PAGE = r"^<(f[^.>,\s]+)>\s*(?:<!\s*(.*?)>)?\s*$"
LOCUS = r"^<(f[^.>,\s]+)\.(\d+),([^>;]+)(?:;([^>]+))?>\s*(.*)$"

UNIT_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("alternatives", T.ArrayType(T.StringType()))]))
_UNIT = re.compile(
    r"(?P<comment><![^>]*>)|(?P<paragraph_start><%>)|(?P<paragraph_end><\$>)|(?P<drawing><->)|(?P<uncertain_drawing><~>)|(?P<tag><@[^>]*>)"
    r"|(?P<ligature>\{[^{}]*\})|(?P<alternative>\[[^\[\]:]*(?::[^\[\]:]*){1,2}\])|(?P<code>@(?:12[89]|1[3-9]\d|2[0-4]\d|25[0-5]);)"
    r"|(?P<unknown_run>\?\?\?)|(?P<unknown>\?)|(?P<space>\.)|(?P<uncertain_space>,)|(?P<glyph>[A-Za-z0-9'*+&$%!^_=-]+)|(?P<invalid>.)",
    re.S,
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """source, number (from 1), content, ending: together they are the file again, byte for byte (Latin-1 keeps every byte)."""
    text = F.decode("content", "ISO-8859-1")
    cut = F.regexp_extract_all(text, F.lit(r"([^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$)"), F.lit(1))
    rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.posexplode(cut).alias("at", "raw"))
    content = F.regexp_replace("raw", r"[\r\n]+$", "")
    return rows.select("source", (F.col("at") + 1).alias("number"), content.alias("content"), F.substring("raw", F.length(content) + 1, F.lit(2)).alias("ending"))


def rendered(lines_: DataFrame) -> DataFrame:
    """source, text: the inverse of lines()."""
    parts = F.sort_array(F.collect_list(F.struct("number", F.concat("content", "ending").alias("t"))))
    return lines_.groupBy("source").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"))


def pages(lines_: DataFrame) -> DataFrame:
    """source, page, ord (order of headers), fields (the $K=V of the header)."""
    rows = lines_.where(F.col("content").rlike(PAGE))
    body = F.regexp_extract("content", PAGE, 2)
    fields = F.map_from_entries(F.transform(F.regexp_extract_all(body, F.lit(r"(\$\w+=\S+)"), F.lit(1)), lambda x: F.struct(F.substring_index(F.substring(x, 2, 100), "=", 1).alias("k"), F.substring_index(x, "=", -1).alias("v"))))
    order = F.row_number().over(Window.partitionBy("source").orderBy("number")) - 1
    return rows.select("source", F.regexp_extract("content", PAGE, 1).alias("page"), order.alias("ord"), fields.alias("fields"))


def loci(lines_: DataFrame) -> DataFrame:
    """source, page, number, locator, transcriber, text (wrapped lines joined), line_numbers, issue (null where sound)."""
    w = Window.partitionBy("source").orderBy("number")
    body = lines_.where(~F.col("content").rlike(r"^(#|\s*$)") & ~F.col("content").rlike(PAGE))
    starts = F.col("content").rlike(LOCUS)
    group = F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    piece = F.when(starts, F.regexp_extract("content", LOCUS, 5)).otherwise(F.regexp_replace("content", r"^/ ?", ""))
    opens = F.regexp_replace(piece, r" ?/$", "")
    rows = body.select("source", "number", "content", starts.alias("starts"), group.alias("g"), piece.alias("piece"), opens.alias("open"), (piece.rlike(r"/$")).alias("wraps"), F.lag(piece.rlike(r"/$")).over(w).alias("wrapped"))
    wrong = F.when(~F.col("starts") & ~F.coalesce("wrapped", F.lit(False)), "orphan continuation").when(F.col("starts") & F.coalesce("wrapped", F.lit(False)), "missing continuation")
    parts = F.sort_array(F.collect_list(F.struct("number", "open")))
    first = F.min_by("content", "number")
    out = rows.withColumn("wrong", wrong).groupBy("source", "g").agg(first.alias("head"), F.array_join(F.transform(parts, lambda x: x["open"]), "").alias("text"), F.transform(parts, lambda x: x["number"]).alias("line_numbers"), F.max("wrong").alias("issue"))
    get = lambda k: F.regexp_extract("head", LOCUS, k)
    return out.select("source", get(1).alias("page"), get(2).try_cast("int").alias("number"), get(3).alias("locator"), get(4).alias("transcriber"), "text", "line_numbers", "issue")


def header_issues(lines_: DataFrame) -> DataFrame:
    """Files whose first line isn't a 2.x header."""
    return lines_.where((F.col("number") == 1) & ~F.col("content").rlike(HEADER)).select("source", F.lit("not a version 2 header").alias("issue"))


def split_units(surface: str | None) -> list[dict]:
    out = []
    for m in _UNIT.finditer(surface or ""):
        raw = m.group()
        out.append({"kind": m.lastgroup, "raw": raw, "start": m.start(), "end": m.end(), "alternatives": raw[1:-1].split(":") if m.lastgroup == "alternative" else []})
    return out


def units(df: DataFrame, column: str = "text") -> DataFrame:
    """df with units: kind, raw, start, end, alternatives of each span; the spans are the whole surface."""
    ship(df.sparkSession)

    @F.pandas_udf(UNIT_TYPE)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(split_units)

    return df.withColumn("units", run(column))


def reading_surface(units_: Column) -> Column:
    """The text without editorial marks."""
    editorial = ("comment", "paragraph_start", "paragraph_end", "drawing", "uncertain_drawing", "tag")
    return F.array_join(F.transform(F.filter(units_, lambda u: ~u["kind"].isin(*editorial)), lambda u: u["raw"]), "")


def stable_groups(text: Column) -> tuple[Column, Column]:
    """Groups of plain letters, and the number of groups left out as uncertain."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"<!.*?>", ""), r"<[%$]>", ""), r"<->", "")
    groups = F.filter(F.split(plain, r"[.,]+"), lambda x: x != "")
    good = F.filter(groups, lambda x: x.rlike(r"^[A-Za-z']+$"))
    return good, F.size(groups) - F.size(good)


def view_groups(units_: Column, alternative: str = "first", uncertain_space: str = "split") -> Column:
    """Groups under one reading policy: alternative is first, last or opaque; uncertain_space is split or join. Unknown
    glyphs, ligatures and codes are atoms of their own; drawing marks split."""
    chosen = {"first": lambda u: F.get(u["alternatives"], F.lit(0)), "last": lambda u: F.element_at(u["alternatives"], -1), "opaque": lambda u: F.lit("[?]")}[alternative]
    parting = ["space", "drawing", "uncertain_drawing", *["uncertain_space"] * (uncertain_space == "split")]
    dropped = ["comment", "paragraph_start", "paragraph_end", "tag", *["uncertain_space"] * (uncertain_space == "join")]
    piece = lambda u: F.when(u["kind"].isin(*parting), F.lit("\x01")).when(u["kind"] == "alternative", chosen(u)).when(u["kind"].isin("ligature", "code", "unknown", "unknown_run"), F.concat(F.lit("("), u["raw"], F.lit(")"))).otherwise(u["raw"])
    text = F.array_join(F.transform(F.filter(units_, lambda u: ~u["kind"].isin(*dropped)), piece), "")
    return F.filter(F.split(text, "\x01"), lambda x: x != "")


def corpus(spark: SparkSession, path: str, paragraphs_only: bool = True) -> DataFrame:
    """source, page, ord, fields, groups: stable groups of the pages in header order; pages without any drop out."""
    all_lines = lines(spark, path)
    rows = loci(all_lines)
    if paragraphs_only:
        rows = rows.where(F.contains("locator", F.lit("P")))
    good, _ = stable_groups(F.col("text"))
    own = rows.select("source", "page", "number", good.alias("g")).groupBy("source", "page").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("number", "g"))), lambda x: x["g"])).alias("groups"))
    return pages(all_lines).join(own, ["source", "page"]).where(F.size("groups") > 0)


def canvases(spark: SparkSession, path: str) -> DataFrame:
    """Image canvases of a IIIF Presentation 3 manifest, in order, with the folio names in their labels."""
    kind = "items array<struct<id string, label map<string, array<string>>, height int, width int>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m")).select(F.posexplode("m.items").alias("ord", "c"))
    label = F.coalesce(F.get(F.get(F.map_values("c.label"), F.lit(0)), F.lit(0)), F.col("c.id"))
    return rows.select("ord", "c.id", label.alias("label"), F.regexp_extract_all(label, F.lit(r"(\d+[rv]\d?)"), F.lit(1)).alias("folios"))


def folios_of_page(page: Column) -> Column:
    """Physical folios of a page name; the rosettes page (fRos) lies on two."""
    return F.when(page == "fRos", F.array(F.lit("85v"), F.lit("86r"))).otherwise(F.array(F.regexp_extract(page, r"^f(\d+[rv])", 1)))


def link_canvases(pages_: DataFrame, canvases_: DataFrame) -> DataFrame:
    """page, canvas id: many to many over the folios, once for each pair."""
    a = pages_.select("page", F.explode(folios_of_page(F.col("page"))).alias("folio"))
    b = canvases_.select("id", "ord", F.explode("folios").alias("folio"))
    return a.join(b, "folio").select("page", "id", "ord").dropDuplicates(["page", "id"])


def archive_documents(spark: SparkSession, path: str) -> DataFrame:
    """Members of tar archives without unpacking them to disk: document_id (of the name), name, text."""
    import hashlib
    import io
    import tarfile

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column("content").to_pylist():
                with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                    for m in tar:
                        if m.isfile():
                            rows.append({"document_id": hashlib.sha256(m.name.encode()).hexdigest()[:20], "name": m.name, "text": tar.extractfile(m).read().decode("utf-8", "replace")})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("document_id", pa.string()), ("name", pa.string()), ("text", pa.string())]))

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "document_id string, name string, text string")


def test_reports(spark: SparkSession, path: str) -> DataFrame:
    """Passed, failed and skipped cases of JUnit XML, by file."""
    kind = "_classname string, _file string, failure string, error string, skipped string"
    rows = spark.read.format("xml").option("rowTag", "testcase").schema(kind).load(path)
    bad, skipped = F.coalesce("failure", "error").isNotNull(), F.col("skipped").isNotNull()
    return rows.groupBy(F.coalesce("_file", "_classname").alias("file")).agg(F.count(F.when(~bad & ~skipped, 1)).alias("passed"), F.count(F.when(bad, 1)).alias("failed"), F.count(F.when(skipped, 1)).alias("skipped"))
