from __future__ import annotations

import hashlib
import random
import re

import pytest

from strandlab.llm import exact_dedup, near_dedup
from strandlab.llm.common import components, documents
from tests.llm.cases import MESSY, ODD, SF, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, per_cent=80):
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near(df, k):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, width=k).collect()}


def test_near_against_brute_force(spark):
    docs = documents(spark, SF)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert near(docs, 4) == brute_components(rows, 4)


@pytest.mark.parametrize("fan, sent", [(2_000, 2_000_000), (2, 0)])
def test_near_chains_and_clusters(spark, monkeypatch, fan, sent):
    """Links between texts whose bucket's head is not similar to either; also with heads dealt out and nothing sent."""
    monkeypatch.setattr(near_dedup, "FAN", fan)
    monkeypatch.setattr(near_dedup, "SENT_IDS", sent)
    rng = random.Random(3)
    rows, base = [], [f"v{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(60):
        words = base[:]
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        base = words if rng.random() < 0.3 else base
    assert near(table(spark, rows), 5) == brute_components(rows, 5)


def test_near_odd_rows(spark):
    got = near(table(spark, ODD), 4)
    assert got == brute_components(ODD, 4)
    assert got[5] == (0, 5) and got[6] == (1, 1) and got[12][1] == 10 and got[9][1] == 8


def test_near_messy_and_empty(spark):
    out = near_dedup.near_duplicates(table(spark, MESSY), width=4)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(MESSY) and sum(r[3] for r in rows if r[1] == 1) == 2
    assert {r[2] for r in rows if r[1] == 1} >= {1}
    assert near_dedup.near_duplicates(table(spark, []), width=4).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 7] + [(100, 103), (103, 101), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got[6] == 1 and got[7] == 1 and got[14] == 8 and got[103] == 100 and got[101] == 100 and got[201] == 200


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}


def exact(df, **kw):
    return {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_duplicates(df, **kw).collect()}


@pytest.mark.parametrize("kw", [{}, {"block": 7, "hot_rows": 3, "salts": 3}])
def test_exact_against_brute_force(spark, kw):
    docs = documents(spark, SF)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert exact(docs, **kw) == brute_exact(rows)


@pytest.mark.parametrize("kw", [{}, {"block": 5, "hot_rows": 2, "salts": 2}])
def test_exact_odd_rows(spark, kw):
    rows = [*ODD, *((100 + i, "abc def " * 9 + " " * (i % 3)) for i in range(12)), (200, "abc def " * 8), (201, "abcdef" * 9 + "a")]
    assert exact(table(spark, rows), **kw) == brute_exact(rows)
    messy = exact_dedup.exact_duplicates(table(spark, MESSY), **kw).collect()
    assert len(messy) == len(MESSY) and sum(r.kept for r in messy) == 3
    assert exact(table(spark, []), **kw) == {}
