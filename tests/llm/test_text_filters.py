from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strandlab.llm import decontaminate, toxicity, words
from strandlab.llm.common import documents
from tests.llm.cases import MESSY, ODD, SF, table
from tests.llm.test_dedup import brute_components, brute_exact

BENCH = [
    (1, "A train leaves Boston at 9 am and travels 60 miles per hour for 3 hours toward the old harbour town"),
    (2, "What is the name of the little river that runs under the seven bridges of the grey city"),
    (3, "Add 12 and 12 then subtract 5 from the sum and write down what you have got at the end"),
    (4, None), (5, ""), (6, "two words"),
]


def pairs(spark, rows):
    bench = spark.createDataFrame([(i, t, 1) for i, t in BENCH], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r.same_fillers for r in decontaminate.contaminated(table(spark, rows), bench).collect()}


def test_templates_catch_other_fillers(spark):
    rows = [
        (1, "noise before. " + BENCH[0][1].upper().lower() + " noise after"),
        (2, "Then: A train leaves Denver at 7 am and travels 85 miles per hour for 4 hours toward the old harbour town. More."),
        (3, "Well, add 30 and 30 then subtract 8 from the sum and write down what you have got at the end!"),
        (4, "Well, add 30 and 31 then subtract 8 from the sum and write down what you have got at the end!"),
        (5, "what is the name of the little, river (that runs) under the seven bridges of the grey city?"),
        (6, "What is the name of the little river? It runs under nothing."),
        (7, "We met two, words in there."),
        (8, None), (9, ""), (10, "clean " * 3000),
    ]
    got = pairs(spark, rows)
    assert {k for k in got if k[1] != 6} == {(1, 1), (2, 1), (3, 3), (5, 2)} and got[(5, 2)] and not got[(2, 1)] and not got[(3, 3)]
    assert (7, 6) in got
    assert pairs(spark, []) == {}
    assert pairs(spark, MESSY + ODD) == {}


def test_planted_items(spark):
    docs, bench = documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    low = lambda t: " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()) + " "
    text = {r.doc_id: low(r.text or "") for r in docs.collect()}
    whole = {(d, r.item_id) for r in bench.collect() for d, t in text.items() if low(r.text) in t}
    for words in (decontaminate.BLOCK_WORDS, 60):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, block_words=words).collect()}
        assert whole <= got and len(got - whole) <= 2
    assert decontaminate.clean(docs, bench).count() == docs.count() - len({d for d, _ in got})


def labelled(spark, n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(40)] + (["vilebad", "nastyword"] if bad else [])
        if rng.random() < (0.6 if bad else 0.1):
            words.append("muslim")
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_classifier_and_neutral_mentions(spark):
    rows, labels = labelled(spark)
    docs = table(spark, rows)
    probe = table(spark, [(1, "muslim people live here w1 w2 w3"), (2, "christian people live here w1 w2 w3"), (3, "vilebad nastyword w1 w2"), (4, None), (5, "")])
    gap = {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.train(docs, labels, penalty=penalty)
        got = {r.doc_id: r for r in toxicity.score(probe, model).collect()}
        gap[penalty] = abs(got[1].score - got[2].score)
        assert got[3].predicted == 1 and got[4].score == got[5].score and all(0 <= r.score <= 1 for r in got.values())
        assert got[1].predicted == got[2].predicted == 0
    assert gap[toxicity.PENALTY] < 0.5 * gap[0.0]
    assert len(toxicity.score(table(spark, MESSY), model).collect()) == len(MESSY)
    assert toxicity.score(table(spark, []), model).collect() == [] and toxicity.accepted(table(spark, []), model).collect() == []
    empty = toxicity.train(table(spark, []), labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(probe, empty).collect())


def test_counterfactual_copies():
    swaps = toxicity.Swaps(toxicity.IDENTITY)
    named, (copy,) = swaps.copies("Some Black cats and women's hats, black", 5, 8)
    assert named and copy.split()[2:4] == ["cats", "and"] and "women" not in copy and "lack" not in copy and copy.endswith(copy.split()[1])
    named, copies = swaps.copies("nobody is named here", 16, 8)
    assert not named and len(copies) == 2 and copies[0] != copies[1]
    assert all(len(set(c.split()) - set("nobody is named here".split())) == 1 for c in copies)
    assert swaps.copies("nobody is named here", 17, 8) == (False, []) and toxicity.Swaps(()).copies("women", 16, 8) == (False, [])


def plain_features(text):
    """The definition, one word at a time."""

    def h(raw):
        return words.word_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), lower=True)

    top = lambda x: int((x >> np.uint64(64 - toxicity.BITS))[0])
    all_words = re.sub(r"[!-/:-@\[-`{-~\x7f]", " ", text).encode().split()
    low = {bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in all_words}
    out = {top(h(w)) for w in low}
    for size in toxicity.PREFIXES:
        many = collections.Counter(w[:size] for w in low if len(w) > size)
        for start, n in many.items():
            own = top(words.mix(h(start) + np.uint64(size)))
            tags = [k for k in toxicity.COUNTS if n >= k] + [100 + i for i, s in enumerate(toxicity.SHARES) if n >= 2 and n / len(all_words) >= s]
            out |= {top(words.mix(np.array([own], np.uint64) + np.uint64((t << 40) + (size << 48)))) for t in tags}
    return out


def test_scores_against_brute_force(spark):
    docs = documents(spark, SF)
    weights, bias = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, (weights, bias)).collect()}
    for i, text in rows.items():
        score = 1 / (1 + np.exp(-(bias + sum(weights[s] for s in plain_features(text or "")))))
        assert abs(score - got[i][0]) < 1e-6 and got[i][1] == int(got[i][0] >= toxicity.THRESHOLD)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.85 * sum(r.toxic for r in rows) and hit >= 0.95 * sum(r.predicted for r in rows)


def test_pipeline_stages(spark):
    docs = documents(spark, SF)
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r.text for r in docs.collect()}
    own = {k: {r.doc_id for r in f(spark, docs, SF).collect()} for k, f in corpus_pipeline.STAGES}
    assert own["exact dedup"] == {k for k, v in brute_exact(list(rows.items())).items() if v[0] == k}
    assert own["near dedup"] == {k for k, v in brute_components(list(rows.items()), 5).items() if v[1] == k}
    assert all(f(spark, docs, SF).columns == docs.columns for k, f in corpus_pipeline.STAGES[:-1])
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out(F.col("doc_id"))))
    assert own["toxicity"] == {r.doc_id for r in toxicity.score(docs, model).collect() if not r.predicted}
    for rows in (ODD, MESSY, []):
        df = table(spark, rows)
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, df, SF)
            assert out.columns == df.columns and out.count() <= len(rows), name
    assert stages["exact dedup"](spark, table(spark, MESSY), SF).count() == 3
    assert stages["near dedup"](spark, table(spark, MESSY), SF).count() == 4


def test_names_that_open_sentences_runs_and_joined_units(spark):
    item = "Tom has 12 apples and gives 5 apples to Anna. Tom then buys 7 apples. How many apples does Tom have now?"
    trip = "A parcel of 5 kg is sent from Paris to the old mill and comes back to Paris after 3 days with a note"
    rows = [
        (1, "Maria has 30 apples and gives 8 apples to Ben. Maria then buys 9 apples. How many apples does Maria have now?"),
        (2, "Maria has 30 apples and gives 8 apples to Ben. Peter then buys 9 apples. How many apples does Carl have now?"),
        (3, "A parcel of 7kg is sent from New York to the old mill and comes back to New York after 4 days with a note"),
        (4, "A parcel of 7kg is sent from New York to the old mill and comes back to San Jose after 4 days with a note"),
        (5, item), (6, trip),
    ]
    bench = spark.createDataFrame([(1, item), (2, trip)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.same_fillers for r in decontaminate.contaminated(table(spark, rows), bench).collect()}
    assert got == {(1, 1): False, (3, 2): False, (5, 1): True, (6, 2): True}


def test_slots_both_ways_number_words_and_long_texts(spark):
    item = "Yesterday Anna gave Bella 12 red marbles and then Bella gave Anna 15 of the small green marbles that she had found"
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))
    rows = [
        (1, "Yesterday Carla gave Diana 7 red marbles and then Diana gave Carla 7 of the small green marbles that she had found"),
        (2, "Yesterday Carla gave Carla 7 red marbles and then Carla gave Carla 9 of the small green marbles that she had found"),
        (3, "Yesterday Carla gave Diana seven red marbles and then Diana gave Carla twenty of the small green marbles that she had found"),
        (4, f"{long} {item} {long}"),
    ]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.same_fillers for r in decontaminate.contaminated(table(spark, rows), bench).collect()}
    assert got == {(1, 1): False, (3, 1): False, (4, 1): True}


def test_literal_items_against_brute_force(spark):
    """Items without slots: a document has one if and only if SHARE of its windows are among the document's, in place."""
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghijklmnopq") + rng.choice("aeiou") + rng.choice("rstn")
    items = [(i, " ".join(word() for _ in range(rng.randrange(3, 25)))) for i in range(30)]
    rows = []
    for d in range(200):
        parts = [word() for _ in range(rng.randrange(0, 30))]
        if rng.random() < 0.7:
            own = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = word()
            parts += own
        rows.append((d, " ".join(parts + [word() for _ in range(rng.randrange(0, 9))])))
    want = set()
    for d, text in rows:
        w = text.split()
        for i, item in items:
            t = item.split()
            k = min(decontaminate.WINDOW, len(t))
            windows = [tuple(t[a : a + k]) for a in range(len(t) - k + 1)]
            there = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
            if sum(x in there for x in windows) >= decontaminate.SHARE * len(windows):
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, rows), bench).collect()} == want and len(want) > 50
