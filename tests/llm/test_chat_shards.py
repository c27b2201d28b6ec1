from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from strandlab.llm import chat, sharding
from strandlab.llm.common import documents
from tests.llm.cases import MESSY, ODD, SF, table

KIND = "conv_id long, turn long, role string, text string, tokens int, repeated string"


def brute(rows):
    by = defaultdict(list)
    for i, (c, t, r, x, *_) in enumerate(rows):
        by[c if c is not None else f"null {i}"].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        out[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return sorted(((None if isinstance(c, str) else c, *v) for c, v in out.items()), key=repr)


def got(df, **kw):
    return sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.windows(df, **kw)).collect()), key=repr)


def test_chat_round_trip(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in df.collect()]
    for kw in ({}, {"budget": 120, "history": 50}, {"budget": 10, "history": 0}):
        assert got(df, **kw) == brute(rows)


ROWS = [
    (1, 0, "system", "be \\ good"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "\\</s> <<SYS>> <s> \\\\[INST]"), (1, 3, "assistant", None),
    (2, 0, None, "x"), (2, 0, None, "x"), (2, None, "assistant", "😀 first"), (None, 1, "assistant", "n"), (None, 2, "user", "m"), (None, 1, "assistant", "n"), (3, 5, "system", None), (4, 1, "[INST]", "<</SYS>>\n"),
    *((5, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 9)) for i in range(300)), (6, 0, "assistant", "long " * 5000),
]


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(*r, 7, "z") for r in ROWS], KIND)
    for kw in ({}, {"budget": 60, "history": 20}):
        assert got(df, **kw) == brute(ROWS)
    rows = chat.windows(df, budget=60, history=20).collect()
    long = [r for r in rows if r.conv_id == 5]
    assert len(long) > 20 and all(r.tokens <= 60 or r.formatted.count("<s>") - r.repeated == 1 for r in long) and any(r.repeated for r in long)
    one = [r for r in rows if r.conv_id == 1]
    assert all(r.formatted.startswith("<s>[INST]system[/INST]") for r in one)
    assert got(spark.createDataFrame([], KIND)) == []


def sharded(df, n=8):
    return [r.asDict() for r in sharding.shards(df, n).collect()]


def law(rows, n, most):
    sizes = defaultdict(int)
    slots = defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append((r["slot"], r["doc_id"] or 0))
    assert all(sorted(s)[i][0] == i for s in slots.values() for i in range(len(s)))
    assert set(sizes) <= set(range(n))
    assert max(sizes.values()) - (min(sizes.values()) if len(sizes) == n else 0) <= most


def test_shards_are_even_and_keep_copies(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs = documents(spark, sf)
        text = {r.doc_id: r.text for r in docs.collect()}
        rows = sharded(docs)
        assert len(rows) == len(text)
        for r in rows:
            raw = (text[r["doc_id"]] or "").encode()
            assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        law(rows, 8, 2 * max(r["size"] for r in rows))
        where = defaultdict(set)
        for r in rows:
            where[text[r["doc_id"]]].add(r["shard"])
        assert all(len(v) == 1 for v in where.values())


def test_shards_odd_rows(spark):
    rows = sharded(table(spark, ODD), 3)
    assert len(rows) == len(ODD)
    law(rows, 3, sum(r["size"] for r in rows))
    hot = [(i, "the same text") for i in range(4000)] + [(5000 + i, f"text {i} " + "z" * (i % 50)) for i in range(4000)]
    rows = sharded(table(spark, hot), 8)
    own = {r["shard"] for r in rows if r["doc_id"] < 4000}
    assert len(own) == 1 and not own & {r["shard"] for r in rows if r["doc_id"] >= 5000}
    rest = [r for r in rows if r["shard"] not in own]
    law([r | {"shard": sorted({x["shard"] for x in rest}).index(r["shard"])} for r in rest], 7, 0.05 * sum(r["size"] for r in rest) / 7)
    same = sharded(table(spark, hot[:50]), 8)
    assert len({r["shard"] for r in same}) == 1 and sorted(r["slot"] for r in same) == list(range(50))
    clash = sharded(table(spark, [(1, "same text"), (None, "same text"), (1, "same text"), *((i, f"other {i}") for i in range(2, 40))]), 4)
    assert len({r["shard"] for r in clash if r["size"] == 10 and r["text_crc32"] == zlib.crc32(b"same text")}) == 1 and len(clash) == 41
    assert len(sharded(table(spark, MESSY))) == len(MESSY)
    assert sharded(table(spark, [])) == []
