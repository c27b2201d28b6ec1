"""The mechanism study against plain Python, one symbol at a time."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from strandlab.operators import mechanism as M


def plain_entropy(train, test, order):
    vocabulary = {u for s in train for u in s} | {"<unk>", "<end>"}

    def seen(s):
        padded = ["<begin>"] * order + [u if u in vocabulary else "<unk>" for u in s] + ["<end>"]
        return [(tuple(padded[i - order : i]), padded[i]) for i in range(order, len(padded))]

    pairs = Counter(x for s in train for x in seen(s))
    contexts = Counter(c for s in train for c, _ in seen(s))
    rows = [x for s in test for x in seen(s)]
    return -sum(math.log2((pairs[x] + M.ALPHA) / (contexts[x[0]] + M.ALPHA * len(vocabulary))) for x in rows) / len(rows)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_metrics(pages):
    train, test = ([g for g, held in pages if held is side] for side in (False, True))
    chars = lambda rows: [tuple(w) for p in rows for w in p]
    gains = {
        "char_trigram_gain": plain_entropy(chars(train), chars(test), 0) - plain_entropy(chars(train), chars(test), 2),
        "group_bigram_gain": plain_entropy(train, test, 0) - plain_entropy(train, test, 1),
    }
    hits = [any(distance(p[i], q) <= 1 for q in p[max(0, i - M.WINDOW) : i]) for p in test for i in range(1, len(p))]
    return gains | {"local_copy_rate": sum(hits) / len(hits)}


def pages_for(n=30, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé😀") for _ in range(rng.randrange(1, 6)))
    return [([word() for _ in range(rng.randrange(1, 60))], i % 3 == 0) for i in range(n)]


def frame(spark, pages):
    return spark.createDataFrame([(i, g, h) for i, (g, h) in enumerate(pages)], "doc_id long, groups array<string>, held boolean")


def test_near_recent_against_edit_distance():
    for groups, _ in pages_for(12, 7):
        for window in (1, 5, 20):
            got = M.near_recent(M._flat([groups]), window)
            assert got.tolist() == [any(distance(g, q) <= 1 for q in groups[max(0, i - window) : i]) for i, g in enumerate(groups)]


def test_metrics_against_plain_python(spark):
    pages = pages_for()
    observed, *replicates = M.measured(frame(spark, pages).repartition(3), 2, seed=5)
    assert observed == pytest.approx(plain_metrics(pages), abs=1e-9)
    assert len(replicates) == 2 * len(M.FAMILIES)
    counts = Counter(w for p, _ in pages for w in p)
    symbols = Counter(c for w in counts.elements() for c in w)
    types, chars = sorted(counts), sorted(symbols)
    draws = M.Draws(types, np.cumsum([counts[t] for t in types]), np.array([ord(c) for c in chars]), np.cumsum([symbols[c] for c in chars]))
    own, ids = [p for p, _ in pages], list(range(len(pages)))
    for f, family in enumerate(M.FAMILIES):
        for rep in range(2):
            g = M.variant_of(own, ids, family, rep, 5, draws)
            words = ["".join(map(chr, g.chars[a:b].tolist())) for a, b in zip(g.first[:-1], g.first[1:])]
            made = [[w for w, p in zip(words, g.page.tolist()) if p == i] for i in ids]
            assert replicates[2 * f + rep] == pytest.approx(plain_metrics([(m, h) for m, (_, h) in zip(made, pages)]), abs=1e-9), family
            assert [len(m) for m in made] == [len(p) for p in own] and made != own
            if family == "page_shuffle":
                assert [sorted(m) for m in made] == [sorted(p) for p in own]
            if family == "symbol_shuffle":
                assert [[sorted(w) for w in m] for m in made] == [[sorted(w) for w in p] for p in own]
            if family == "iid_symbol":
                assert [[len(w) for w in m] for m in made] == [[len(w) for w in p] for p in own]
            if family == "global_resample":
                assert set(words) <= set(types) and sum(w in p for m, p in zip(made, own) for w in m) < len(words)


def test_draws_looked_up_by_join_are_the_same(spark):
    pages = frame(spark, pages_for(20, 4))
    assert M.measured(pages, 1, sent_types=0) == [pytest.approx(m, abs=1e-9) for m in M.measured(pages, 1)]


def test_families_tell_mechanisms_apart(spark):
    """Pages of words that hang together are unlike their shuffles; pages of copies are like the copying family."""
    rng = random.Random(1)
    successor = {f"w{i}": f"w{i + 1}" for i in range(0, 60, 2)}
    first = sorted(successor)
    pages = [([x for w in rng.choices(first, k=60) for x in (w, successor[w])], i % 3 == 0) for i in range(24)]
    observed, *rest = M.measured(frame(spark, pages), 3)
    assert all(observed["group_bigram_gain"] > r["group_bigram_gain"] + 0.5 for r in rest)


def test_empty_and_odd_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, groups int"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert M.study(spark, f"{tmp_path}/a").collect() == []
    rows = [(1, None, "en", None, 1), (2, "  ", "en", None, 1), (3, "one two", None, None, 1), (4, "one one one", None, None, 1), (5, "two", None, None, 1)]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = M.study(spark, f"{tmp_path}/b", replicates=2).collect()
    assert len(got) == len(M.FAMILIES) * len(M.METRICS) and all(0 < r.p <= 1 and r.p <= r.p_holm <= 1 for r in got)
    held = {r.doc_id: r.held for r in M.pages_of(spark.read.parquet(f"{tmp_path}/b/documents.parquet")).collect()}
    assert set(held) == {3, 4, 5} and set(held.values()) == {True, False}


def shuffled_rows(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark._jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_n_grams_travel_in_few_rows(spark):
    """Rows that are shuffled follow tasks and ranges of keys, not the n-grams: 30,000 groups in 11 corpora have over 300,000 pairs."""
    rng = random.Random(3)
    pages = [(["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)], i % 3 == 0) for i in range(60)]
    rows = frame(spark, pages)
    before = shuffled_rows(spark)
    M.measured(rows, 2)
    assert sum(n for k, n in shuffled_rows(spark).items() if k not in before) < 60_000


def test_results_do_not_depend_on_chunks_rounds_and_tables(spark, monkeypatch):
    pages = frame(spark, pages_for(24, 6))
    whole = M.measured(pages, 2, seed=3)
    for name, value in (("CHUNK", 64), ("ROUND", 1), ("RANGE", 100), ("CELLS", 0)):
        monkeypatch.setattr(M, name, value)
    assert M.measured(pages, 2, seed=3) == [pytest.approx(m, abs=1e-9) for m in whole]


def test_one_edit_of_long_groups_in_any_width():
    rng = random.Random(5)
    for letters in ("ab", "aé", "aж", "a😀"):
        groups = ["".join(rng.choices(letters, k=rng.randrange(6, 20)))]
        while len(groups) < 150:
            w = list(groups[-rng.randrange(1, min(6, len(groups) + 1))])
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
                w = w or ["a"]
            groups.append("".join(w))
        got = M.near_recent(M._flat([groups]), 7)
        assert got.tolist() == [any(distance(g, q) <= 1 for q in groups[max(0, i - 7) : i]) for i, g in enumerate(groups)]


def test_packed_keys_come_back():
    for keys in ([], [7], [0, 1], [3, 2**63, 2**64 - 1], [5, 260, 70_000, 2**40]):
        assert M._unpacked(M._packed(np.array(keys, np.uint64))).tolist() == keys
