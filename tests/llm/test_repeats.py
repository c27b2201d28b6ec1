from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa

from strandlab.llm import substring_dedup
from strandlab.llm.common import documents
from tests.llm.cases import MESSY, ODD, SF, table


def brute(rows, k=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        keep = [True] * len(w)
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            if g in seen:
                keep[s : s + k] = [False] * k
            seen.add(g)
        out[i] = (len(w), keep.count(False), hashlib.sha256(" ".join(x for x, y in zip(w, keep, strict=True) if y).encode()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect()}


def test_against_brute_force(spark):
    docs = documents(spark, SF)
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(docs) == want
    assert got(docs.repartition(9)) == want  # copies meet in the shuffle, not in one slice


def test_factors(spark):
    """Each factor equals its source, which is earlier; factors end where the source goes on otherwise."""
    docs = documents(spark, SF).repartition(5)
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()}
    rows = substring_dedup.factors(docs).collect()
    assert len(rows) > 20
    for r in rows:
        own, source = words[r.doc_id], words[r.source]
        assert r.length >= 20 and (r.source, r.source_start) < (r.doc_id, r.start)
        assert own[r.start : r.start + r.length] == source[r.source_start : r.source_start + r.length]
        assert r.head == substring_dedup._digest([w.encode() for w in own[r.start : r.start + 20]])
    wrong = [{"start": 0, "length": 20, "head": b"x" * 16, "tail": b"x" * 16}]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join("abcdefghijklmnopqrstuvwxyz")], "factors": [wrong]})
    assert next(substring_dedup._cut(20, False)(iter([batch]))).to_pylist()[0]["n_removed"] == 0


def test_passages_periods_and_odd_rows(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(500)}"
    passages = [[word() for _ in range(rng.choice([19, 20, 21, 25, 60]))] for _ in range(12)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randrange(1, 6)):
            text += [word() for _ in range(rng.randrange(0, 30))] + (rng.choice(passages) if rng.random() < 0.7 else [])
        rows.append((1000 - i, " ".join(text)))
    rows += [(2000 + n, "a " * n) for n in (19, 20, 21, 22, 33, 34, 60)] + [(3000 + p, " ".join(str(i % p) for i in range(45))) for p in (1, 2, 3, 7, 12, 13, 14, 20, 25)]
    rows += [(i + 5000, t) for i, t in ODD]
    assert got(table(spark, rows)) == brute(rows)
    assert got(table(spark, rows).repartition(11)) == brute(rows)


def test_messy_and_empty(spark):
    assert len(substring_dedup.remove_repeats(table(spark, MESSY)).collect()) == len(MESSY)
    assert got(table(spark, [])) == {}
