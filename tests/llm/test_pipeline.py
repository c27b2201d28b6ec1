from __future__ import annotations

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from strandlab.llm import decontaminate, toxicity
from strandlab.llm.common import documents
from strandlab.llm.queries import QUERIES, vocabulary
from tests.llm.cases import ODD, SF, table
from tests.llm.test_dedup import brute_components, brute_exact

#: The smallest tables with labels enough for the classifier to reject anything.
LARGER = "/root/testdata/sf0.01"


def test_run_against_a_brute_force_chain(spark):
    """Each stage's brute-force version on what the one before it kept; the classifier's weights are the stage's own."""
    from sentencepiece import SentencePieceProcessor

    docs = documents(spark, LARGER)
    weights, bias = toxicity.train(docs, spark.read.parquet(f"{LARGER}/labels.parquet").where(~toxicity.held_out(F.col("doc_id"))))
    rows = {r.doc_id: r.text for r in docs.collect()}
    score = lambda t: 1 / (1 + np.exp(-(bias + weights[toxicity._slot_sets([t or ""])[0]].sum())))
    left = {i: t for i, t in rows.items() if score(t) < toxicity.THRESHOLD}
    assert 0 < len(left) < len(rows)
    left = {i: left[i] for i, v in brute_exact(list(left.items())).items() if v[0] == i}
    left = {i: left[i] for i, v in brute_components(list(left.items()), 5).items() if v[1] == i}
    bench = spark.read.parquet(f"{LARGER}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contaminated(table(spark, list(left.items())), bench).collect()}
    low = lambda t: " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()) + " "
    assert {i for i, t in left.items() if any(low(r.text) in low(t) for r in bench.collect())} <= bad
    left = {i: t for i, t in left.items() if i not in bad}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, LARGER).collect()}
    assert set(out) == set(left)
    model = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    for i, r in out.items():
        assert r.lossless and r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert "▁" in (left[i] or "") or model.decode(list(r.ids)) == (left[i] or "")


def test_encoding_stage_on_odd_rows(spark):
    out = corpus_pipeline.encode(spark, table(spark, [*ODD, (None, "x y"), (6, "one")]), SF).collect()
    assert len(out) == len(ODD) + 2 and all(r.lossless for r in out) and [r.ids for r in out if r.n_bytes == 0] == [[], []]
    assert corpus_pipeline.encode(spark, table(spark, []), SF).collect() == []


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in ("pipeline", "op1_minhash_near_dedup", "op3_substring_dedup", "op6_exact_dedup")])
def test_queries_return_a_row_for_each_key(spark, name):
    out = QUERIES[name](spark, SF)
    if name == "op7_chat_windows":
        want = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
        assert out.count() == out.select("conv_id").distinct().count() == want
    elif name == "op5_decontamination":
        assert out.count() == out.select("doc_id", "item_id").distinct().count() > 0
    else:
        assert out.count() == out.select("doc_id").distinct().count() == documents(spark, SF).count()
