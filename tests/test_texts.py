from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandlab.sources import texts as T

BOOK = "Title\n*** START OF THIS PROJECT GUTENBERG EBOOK X ***\nJust a Jolly body; 12.\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nlicence"


def test_framed_bodies_and_words(spark):
    rows = spark.createDataFrame([(1, BOOK), (2, "no frame"), (3, None), (4, "Straße ﬁn don’t Über-all Éa 7")], "k int, text string")
    got = {r.k: (r.b, r.l) for r in rows.select("k", T.framed_body(F.col("text")).alias("b"), T.letters_25(T.framed_body(F.col("text"))).alias("l")).collect()}
    assert got[1] == ("Just a Jolly body; 12.\n", "IUSTAIOLLYBODY") and got[2] == got[3] == (None, None)
    words = {r.k: r.words for r in T.folded_words(rows).collect()}
    assert words[4] == ["strasse", "fin", "don't", "über-all", "éa"] and words[3] is None and T.folded_words(rows.limit(0)).collect() == []


def test_passages(spark):
    text = "intro\n\n# One\npara a\nline\n\npara b\n\n## Two\n" + "x" * 50 + "\n\n" + "y" * 10
    rows = T.passages(spark.createDataFrame([("p", text), ("q", None)], "path string, text string"), most=40).orderBy("ord").collect()
    assert [(r.ord, r.heading, r.text) for r in rows] == [(0, "", "intro"), (1, "One", "para a\nline\n\npara b"), (2, "Two", "x" * 50), (3, "Two", "y" * 10)]
    assert rows[1].passage_id == hashlib.sha256(b"p\nOne\npara a\nline\n\npara b").hexdigest()[:16]


def test_manifests_gates_and_receipts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("alpha")
    (tmp_path / "in/b.json").write_text("{}")
    files = spark.read.format("binaryFile").load(f"{tmp_path}/in")
    own = T.manifest(files, f"file:{tmp_path}/in")
    rows = {r.path: r for r in own.collect()}
    assert rows["a.txt"].sha256 == hashlib.sha256(b"alpha").hexdigest() and rows["a.txt"].bytes == 5 and rows["b.json"].media_type == "application/json"
    said = [("a.txt", rows["a.txt"].sha256, 5), ("b.json", "0" * 64, 2), ("b.json", "0" * 64, 9), ("c", "0", 1), ("../a.txt", "0", 1)]
    status = [r.status for r in T.verified(spark.createDataFrame(said, "path string, sha256 string, bytes long"), own).orderBy("path", "bytes").collect()]
    assert sorted(status) == sorted(["ok", "hash", "size", "missing", "outside-root"])
    listed = spark.createDataFrame([(f"file:{tmp_path}/in/a.txt", rows["a.txt"].sha256, "text/plain"), ("gone", "0", "text/plain"), (f"file:{tmp_path}/in/b.json", "0", "application/json")], "path string, sha256 string, media_type string")
    assert sorted((r.status, r.text) for r in T.gated(listed, files).collect() if r.text) == [("ok", "alpha")] and T.gated(listed, files).count() == 2
    old, new = (spark.createDataFrame(x, "path string, at int, v string") for x in ([("a", 1, "old"), ("b", 5, "old")], [("a", 1, "new"), ("b", 2, "new"), ("c", 1, "new")]))
    assert {r.path: r.v for r in T.upserted(old, new, "at").collect()} == {"a": "new", "b": "old", "c": "new"}


def test_immutable_writes(spark, tmp_path):
    df = spark.createDataFrame([(2, "x"), (1, None)], "b int, a string").coalesce(1)
    T.write_immutable(df, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"a":"x","b":2}', '{"b":1}']
    T.write_record(spark, f"{tmp_path}/one.json", {"b": 1, "a": "é"})
    assert (tmp_path / "one.json").read_bytes() == '{"a":"é","b":1}\n'.encode() and json.loads((tmp_path / "one.json").read_text())["b"] == 1
    for again in (lambda: T.write_immutable(df, f"{tmp_path}/out"), lambda: T.write_record(spark, f"{tmp_path}/one.json", {})):
        with pytest.raises(Exception, match="(?i)exist"):
            again()
