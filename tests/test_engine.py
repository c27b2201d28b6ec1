"""The queries against DuckDB, and operators against known answers, inverses and invariances."""

from __future__ import annotations

import math
import re
import sys
from itertools import pairwise
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from strandlab.functions import columns as C  # noqa: E402
from strandlab.operators import ledger, procedures  # noqa: E402
from strandlab.plans import catalogue  # noqa: E402
from strandlab.plans.dialect import TABLES  # noqa: E402
from strandlab.sources import transcription as S  # noqa: E402
from strandlab.streaming import growth  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda v: None if v is None or v != v else round(v, 8) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    own = plain(tuple(r) for r in df.select(*cols).collect())
    rel = duck.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == cols
    assert own == plain(duck.sql(f"select {', '.join(cols)} from ({catalogue.SQL[name]})").fetchall()) and own


def test_helpers(spark):
    df = spark.createDataFrame([("a", 0.01, 1), ("b", 0.03, 2), ("c", 0.02, 3)], "name string, p double, ord int")
    got = {r.name: round(r.p_holm, 9) for r in C.holm(df, "p", ["ord"]).collect()}
    assert got == {"a": 0.03, "b": 0.04, "c": 0.04}
    one = spark.createDataFrame([(1, x) for x in [0, 0, 1, 1]], "k int, x int")
    assert C.entropy(one, ["k"], "x").first()["bits"] == 1.0
    assert set(spark.range(1).select(C.deletions(F.lit("abc")).alias("d")).first()["d"]) == {"abc", "bc", "ac", "ab"}
    rank = spark.createDataFrame([(3,), (1,), (3,), (2,), (3,), (1,)], "v int").withColumn("k", F.lit(1)).withColumn("r", C.average_rank(["k"], "v"))
    assert sorted((r.v, r.r) for r in rank.collect()) == [(1, 1.5), (1, 1.5), (2, 3.0), (3, 5.0), (3, 5.0), (3, 5.0)]
    assert spark.range(1).select(C.correlation(F.lit(1.0), F.col("id")).alias("r")).first()["r"] is None
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b c d".split())], "d int, i int, w string")
    assert [r.g for r in C.ngrams(words, ["d"], "i", "w", 3).orderBy("i").collect()] == [["a", "b", "c"], ["b", "c", "d"]]
    a, b = (sorted(map(tuple, C.permuted(words.repartition(n), ["d"], "s", ["i"]).collect())) for n in (1, 3))
    assert a == b and sorted(r[2] for r in a) == ["a", "b", "c", "d"]
    import hashlib

    assert int(spark.range(1).select(C.stable_seed(F.lit("x"), F.lit("7")).alias("s")).first()["s"]) == int.from_bytes(hashlib.sha256(b"x:7").digest()[:8], "big")
    starts = [spark.range(1).select(C.chunk_starts(F.lit(n), 10, 3).alias("s")).first()["s"] for n in (5, 10, 19, 40)]
    assert starts == [[], [0], [4], [0, 15, 30]]


def test_ciphers_and_search(spark):
    for n in range(1, 23):
        order = (2, 0, 3, 1)
        assert procedures.restored(procedures.columnar(list(range(n)), order), order) == list(range(n))
    rows = procedures.order_search(spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert all(r.true_score == 1.0 and r.best_score == 1.0 for r in rows)
    assert sum(r.true_rank < 3 for r in rows) > 0.8 * len(rows)


def test_compression_knows_order(spark):
    docs = spark.createDataFrame([(1, "aaaa " * 60 + "bbbb " * 60), (2, ""), (3, None)], "doc_id long, text string")
    gain = {r.doc_id: r.gain for r in procedures.compression_shuffle_gain(docs).collect()}
    assert gain[1] > 0.1 and gain[2] is None
    renamed = spark.createDataFrame([(1, "xx " * 60 + "y " * 60)], "doc_id long, text string")
    assert math.isclose(procedures.compression_shuffle_gain(renamed).first()["gain"], gain[1])
    ncd = spark.createDataFrame([(1, 1, "same text " * 9, "same text " * 9), (1, 2, "same text " * 9, "quite other words in here 12345")], "a_id long, b_id long, a string, b string")
    got = {(r.b_id, r.compressor): r.ncd for r in procedures.compression_distances(ncd).collect()}
    assert all(got[1, c] < got[2, c] for c in procedures.COMPRESSORS)


def test_merges(spark):
    docs = spark.createDataFrame([(1, "abab abab abc"), (2, "ab")], "doc_id long, text string")
    merges = procedures.fit_merges(docs, 2)
    assert merges == [("a", "b"), ("ab", "ab")]
    assert procedures.apply_merge([*"aaa"], ("a", "a")) == ["aa", "a"]
    rows = {r.doc_id: r for r in procedures.apply_merges(docs, merges).collect()}
    assert rows[1].units == 4 and rows[1].restored and rows[2].units == 1


TEXT = (
    "#=IVTFF Eva- 2.0 M 5\r\n<f1r>   <! $L=A $H=1 $I=H>\n<f1r.1,@P0;H>   <%>ab.cd,ef<->gh /\r\n/ ij{ct}[k:t:s]????<!x>@221;<$>\n"
    "<f1r.2,+P0;H> a.b?.c\n<f1v> <! $L=B>\n<f1v.1,@L0> label\n# end"
)


def test_transcription(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(TEXT.encode("latin-1"))
    lines = S.lines(spark, str(path))
    assert S.rendered(lines).first()["text"].encode("latin-1") == TEXT.encode("latin-1")
    loci = {(r.page, r.number): r for r in S.loci(lines).collect()}
    assert loci["f1r", 1].text == "<%>ab.cd,ef<->ghij{ct}[k:t:s]????<!x>@221;<$>" and loci["f1r", 1].line_numbers == [3, 4] and loci["f1r", 1].issue is None
    assert [(r.page, r.ord, dict(r.fields)) for r in S.pages(lines).orderBy("ord").collect()] == [("f1r", 0, {"L": "A", "H": "1", "I": "H"}), ("f1v", 1, {"L": "B"})]
    units = S.units(S.loci(lines)).where("page = 'f1r' and number = 1")
    row = units.select("text", "units", S.reading_surface(F.col("units")).alias("read"), *(S.view_groups(F.col("units"), a, s).alias(f"{a}_{s}") for a in ("first", "last", "opaque") for s in ("split", "join"))).first()
    assert "".join(u.raw for u in row.units) == row.text and all(a.end == b.start for a, b in pairwise(row.units))
    assert [u.kind for u in row.units if u.kind in ("alternative", "ligature", "code", "unknown_run", "unknown")] == ["ligature", "alternative", "unknown_run", "unknown", "code"]
    assert row.read == "ab.cd,efghij{ct}[k:t:s]????@221;"
    assert row.first_split == ["ab", "cd", "ef", "ghij({ct})k(???)(?)(@221;)"] and row.last_join[1] == "cdef" and "[?]" in row.opaque_split[-1]
    corpus = S.corpus(spark, str(path)).collect()
    assert [r.page for r in corpus] == ["f1r"] and corpus[0].groups[-2:] == ["a", "c"]
    assert S.header_issues(lines).isEmpty()
    bad = tmp_path / "b.txt"
    bad.write_text("#=IVTFF Eva- 1.5\n/ orphan\n<f1r.1,@P0> x")
    assert S.header_issues(S.lines(spark, str(bad))).count() == 1


def test_ledger(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "events"))
    book.register("E-1", {"a": 1})
    book.transition("E-1", "RUNNING")
    book.heartbeat("E-1", "me")
    with pytest.raises(ValueError):
        book.register("E-1", {})
    with pytest.raises(ValueError):
        book.transition("E-1", "REJECTED")
    with pytest.raises(ValueError):
        book.transition("E-1", "COMPLETE", {"actor": "x"})
    assert book.errors().isEmpty() and book.states().first()["status"] == "RUNNING" and book.stale(-5).count() == 1
    rows = [r.asDict() for r in book.events().collect()]
    for column, value in (("details", '{"x": 1}'), ("previous_hash", "0" * 64)):
        bad = [r | ({column: value} if r["event_seq"] == 1 else {}) for r in rows]
        assert [r.event_seq for r in ledger.chain_errors(spark.createDataFrame(bad, ledger.KIND)).collect()] == [1]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    out = growth.run_once(growth.repeats(growth.stream(spark, SF)), "repeats_t", "update", str(tmp_path / "a"))
    got = {r.user_id: r.events for r in out.groupBy("user_id").agg(F.max("events").alias("events")).collect()}
    assert got == {r.user_id: r["count"] for r in batch.groupBy("user_id").count().collect()}
    out = growth.run_once(growth.windowed_counts(growth.stream(spark, SF)), "windows_t", "complete", str(tmp_path / "b"))
    assert out.agg(F.sum("n")).first()[0] == batch.count()


def test_learning_keeps_groups_apart(spark):
    rows = catalogue.QUERIES["oof_group_kfold"](spark, SF).collect()
    folds = {}
    for r in rows:
        folds.setdefault(r.doc_id, set()).add(r.fold)
        assert 0 <= r.score <= 1
    assert all(len(f) == 1 for f in folds.values())


def drawn(key, tot):
    from hashlib import md5

    return math.floor(int(md5(key.encode()).hexdigest()[:13], 16) / 2**52 * tot)


def test_global_nulls_draw_for_every_position(spark):
    """Against draws made one by one from the exact cumulative counts."""
    from bisect import bisect_right
    from collections import Counter
    from itertools import accumulate

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tokens = {(r.doc_id, i): t for r in docs for i, t in enumerate(x for x in re.split("[ \\t\\r\\n]+", (r.text or "").lower()) if x)}
    counts = sorted(Counter(tokens.values()).items(), key=lambda x: (-x[1], x[0].encode()))
    ends = list(accumulate(n for _, n in counts))
    want = {k: counts[bisect_right(ends, drawn(f"resample:{k[0]}:{k[1]}", len(tokens)))][0] for k in tokens}
    rows = catalogue.QUERIES["null_global_resample"](spark, SF).collect()
    assert len(rows) == len(tokens) and {(r.doc_id, r.pos): r.tok for r in rows} == want
    single = {t for t, n in counts if n == 1}
    assert len(set(want.values()) & single) > 0.5 * len(single)

    chars = {(*k, i): c for k, t in tokens.items() for i, c in enumerate(t)}
    symbols = sorted(Counter(chars.values()).items(), key=lambda x: x[0].encode())
    ends = list(accumulate(n for _, n in symbols))
    rows = catalogue.QUERIES["null_iid_symbol"](spark, SF).collect()
    want: dict = {}
    for doc, pos, i in chars:
        key = doc, symbols[bisect_right(ends, drawn(f"iid:{doc}:{pos}:{i}", len(chars)))][0]
        n, places = want.get(key, (0, 0))
        want[key] = n + 1, places + pos + 1
    assert {(r.doc_id, r.c): (r.n, r.place_sum) for r in rows} == want


def growth_of(tokens):
    at, n = {1 << e for e in range(40)} | {len(tokens), len(tokens) // 2}, len(tokens)
    return {(k, len(set(tokens[:k]))) for k in at if 0 < k <= n}


def test_vocabulary_growth_to_the_end(spark, tmp_path):
    texts = {1: " ".join(f"w{i % 9001}" for i in range(33_000)), 2: "a b a", 3: "one", 4: "w1 w2 a new b"}
    spark.createDataFrame([(k, "en", "x", t) for k, t in texts.items()], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue.QUERIES["vocabulary_growth_pooled"](spark, str(tmp_path)).collect()
    got = {k: {(r.prefix, r.types) for r in rows if r.doc_id == k} for k in (*texts, None)}
    assert got == {k: growth_of(t.split()) for k, t in texts.items()} | {None: growth_of(" ".join(texts.values()).split())}
    assert len(rows) == sum(map(len, got.values()))


def test_global_family_draws_from_the_corpus(spark, tmp_path):
    """Documents of one repeated word each: shuffles within them change nothing, draws from all of them do."""
    rows = [(k, "en", "x", " ".join([w * 5] * 60)) for k, w in enumerate("abcdefgh")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.family, r.metric): r for r in catalogue.QUERIES["mechanism_study"](spark, str(tmp_path)).collect()}
    page, drawn_ = got["page_shuffle", "local_copy_rate"], got["global_resample", "local_copy_rate"]
    assert page.observed == page.null_mean == drawn_.observed == 1 and page.p == 1
    assert drawn_.null_mean < 1 and drawn_.p < 0.15 and len(got) == 15


def test_order_search_scores_whole_items(spark):
    """The first 400 letters are one letter, for which most orders tie; the rest tells them apart."""
    rank = lambda x: procedures.order_search(spark.createDataFrame([(1, x)], "item_id long, text string")).first()["true_rank"]
    assert rank("a" * 400) > rank("a" * 400 + "the quick brown fox jumps over lazy dogs " * 20)


def exchanges(df):
    """What the plan shuffles, without exchanges that are one and the same."""
    return [x.strip(" :+-*") for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if re.search(r"\bExchange ", x)]


@pytest.mark.parametrize("name", ["battery_panel", "higher_order_panel", "null_symbol_shuffle", "page_panel_full", "sequence_panel"])
def test_only_texts_are_shuffled(spark, name):
    """Of what is measured document by document nothing passes a shuffle but the documents, dealt once by doc_id."""
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        got = exchanges(catalogue.QUERIES[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert got and all(re.match(r"Exchange hashpartitioning\(doc_id#\d+L?, \d+\), REPARTITION_BY_NUM", x) for x in got)


def test_links_are_not_shuffled(spark, duck, tmp_path):
    """Ids are made distinct before the join, so no pair passes a shuffle; repeated ids and null ones give the rows of the SQL."""
    tables = {"documents": "doc_id", "pages": "page_id"}
    for t, key in tables.items():
        spark.createDataFrame([(i,) for i in [*range(-150, 150), 7, 7, 104, None]], f"{key} long").write.parquet(str(tmp_path / f"{t}.parquet"))
    df = catalogue.QUERIES["many_to_many_links"](spark, str(tmp_path))
    assert not [x for x in exchanges(df) if "doc_id" in x and "page_id" in x]
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, df.select("doc_id", "page_id").collect())) == sorted(con.sql(f"select doc_id, page_id from ({catalogue.SQL['many_to_many_links']})").fetchall())


@pytest.mark.parametrize("name", ["retrieval_metrics_rectangular", "rrf_hybrid"])
def test_no_list_of_all_documents(spark, name):
    """What items have in common with documents is counted where the documents are: nothing is shuffled by item but sums."""
    got = exchanges(catalogue.QUERIES[name](spark, SF))
    assert not [x for x in got if re.search(r"hashpartitioning\((doc_id#\d+L?, )?tok#", x)]
