"""Toxicity by a counterfactually regularised classifier.

Features are the distinct lower-cased words of the whole text, and the beginnings that several of these words share,
by how many have them and how large their share is (languages build slurs by compounding), hashed into a fixed number of
weights; the score is the logistic of their sum plus a bias.

Counterfactuals are texts: of a labelled sentence that names a group, a copy in which the identity terms stand for other
ones; of a part of the other sentences (one in INJECT, by a hash of the id), a copy that mentions one group and a copy that
mentions another at the same place. Copies run through the same features, join the fit with the sentence's label, and a
penalty on the squared difference of the two copies' logits (and, for mentions put in, of the copy's and the sentence's)
keeps the score from depending on which group is named: a neutral mention can't raise it. Training minimises log loss +
ridge + that penalty by full-batch Adam on a bounded sample of labelled rows (SAMPLE rows at most, chosen by a hash of the
id); scoring is one pass over all texts with the weights as the only thing sent to the workers (8 bytes * WEIGHTS,
whatever the corpus)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm import words as W
from strandlab.llm.common import mapped

BITS = 20
WEIGHTS = 1 << BITS
#: Bytes of the word beginnings that are features; the numbers of distinct words with one, and the shares of all words
#: (two such words at least), that are.
PREFIXES, COUNTS, SHARES = (4, 5, 6, 7, 8), (1, 2, 3, 5), (1 / 160, 1 / 100, 1 / 64)
#: Most labelled rows that a fit looks at; most features that it keeps, and how clearly they must tell the labels apart.
SAMPLE, FEATURES, CLEAR = 12_000, 40_000, 4.0
#: Of the sentences without an identity term, one in so many gets two copies with one.
INJECT = 8
#: Weight of the counterfactual term, of the squared weights, of a toxic row; steps of the fit.
PENALTY, RIDGE, POSITIVE, STEPS = 4.0, 0.3, 4.0, 200
THRESHOLD = 0.7

#: Identity terms that stand for each other (fixed word list).
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"),
    ("musulman", "chrétien", "juif"), ("femme", "homme"), ("femmes", "hommes"),
    ("frauen", "männer"), ("frau", "mann"), ("mujeres", "hombres"), ("mujer", "hombre"),
)


def _bare(data: np.ndarray) -> np.ndarray:
    """ASCII punctuation counts as a blank, so that "word," is "word"."""
    table = np.arange(256, dtype=np.uint8)
    for c in range(33, 128):
        if not chr(c).isalnum():
            table[c] = 32
    return table[data]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _features(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch: first row, end row, and the rows (from the first) and slots of their features."""
    for a, b, data, offsets in W.texts(batch):
        data = _bare(data)
        starts, ends, first = W.spans(data, offsets)
        n_words = np.maximum(np.diff(first), 1)
        row_of = np.repeat(np.arange(b - a), np.diff(first))
        own = row_of * WEIGHTS + _slots(W.word_hashes(data, starts, ends, lower=True))
        distinct, one = np.unique(own, return_index=True)
        starts, ends, row_of = starts[one], ends[one], row_of[one]
        rows, slots = [row_of.astype(np.int32)], [(distinct % WEIGHTS).astype(np.int32)]
        for size in PREFIXES:
            long = ends - starts > size
            hashes = W.mix(W.word_hashes(data, starts[long], starts[long] + size, lower=True) + np.uint64(size))
            own, count = np.unique(row_of[long] * WEIGHTS + _slots(hashes), return_counts=True)
            share = np.where(count >= 2, count / n_words[own // WEIGHTS], 0)
            tests = [(least, count >= least) for least in COUNTS] + [(100 + i, share >= least) for i, least in enumerate(SHARES)]
            for tag, ok in tests:
                got = own[ok]
                rows.append((got // WEIGHTS).astype(np.int32))
                slots.append(_slots(W.mix((got % WEIGHTS).astype(np.uint64) + np.uint64((tag << 40) + (size << 48)))).astype(np.int32))
        yield a, b, np.concatenate(rows), np.concatenate(slots)


def _slot_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's features."""
    out = []
    for a, b, rows, slots in _features(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})):
        order = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[order], np.arange(1, b - a))
        out += [np.unique(x).astype("<i4") for x in np.split(slots[order], cuts)]
    return out


class Swaps:
    """Counterfactual copies of texts for groups of identity terms."""

    def __init__(self, identity: tuple[tuple[str, ...], ...]):
        self.groups = [tuple(w.lower() for w in g) for g in identity if len(g) > 1]
        self.of = {w: g for g in self.groups for w in g}
        self.find = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, self.of), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE) if self.of else None

    def _other(self, word: str, k: int) -> str:
        g = self.of[word]
        return g[(g.index(word) + 1 + k % (len(g) - 1)) % len(g)]

    def copies(self, text: str, key: int, inject: int) -> tuple[bool, list[str]]:
        """Whether the text itself names a group; its copies: one with other terms, or (for one key in `inject`) two with a
        mention put in, or none."""
        if self.find is None:
            return False, []
        if self.find.search(text):
            return True, [self.find.sub(lambda m: self._other(m[0].lower(), key), text)]
        if key % inject:
            return False, []
        group = self.groups[key // inject % len(self.groups)]
        word = group[key // 64 % len(group)]
        parts = text.split(" ")
        at = key // 4096 % (len(parts) + 1)
        return False, [" ".join([*parts[:at], w, *parts[at:]]) for w in (word, self._other(word, key // 512))]


def _extract(swaps: Swaps, inject: int):
    """y, the text's features, and of each of its pairs of texts (counterfactual pairs) both sides' features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = part.column("text").to_pylist()
                made, pairs = [], []
                for key, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    named, copies = swaps.copies(text, crc32(str(key).encode()), inject)
                    at = [len(texts) + len(made) + i for i in range(len(copies))]
                    made += copies
                    own = len(pairs)
                    pairs.append([(own, at[0])] if named else [(at[0], at[1]), (own, at[0])] if copies else [])
                sets = [x.tobytes() for x in _slot_sets(texts + made)]
                columns = [part.column("y"), pa.array(sets[: len(texts)], pa.binary()), pa.array([[sets[i] for pair in own for i in pair] for own in pairs], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["y", "slots", "pairs"])

    return run


def _kept(sets: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """Slots that tell the labels apart: whose count among toxic rows is CLEAR standard deviations from the expected one (the
    `most` clearest). What a few rows happen to share stays out, so that it can't stand in for what makes a text toxic."""
    every, toxic = np.zeros(WEIGHTS, np.int64), np.zeros(WEIGHTS, np.int64)
    for own, label in zip(sets, y, strict=True):
        every[own] += 1
        if label:
            toxic[own] += 1
    share = y.mean() if len(y) else 0.0
    z = np.abs(toxic - every * share) / np.sqrt(every * share * (1 - share) + 0.5)
    places = np.flatnonzero(z >= CLEAR)
    return places if len(places) <= most else np.sort(places[np.argsort(-z[places], kind="stable")[:most]])


def _fit(rows: list[tuple[float, bytes, list[bytes]]], penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias."""
    base = [np.frombuffer(r[1], "<i4") for r in rows]
    named = [np.setxor1d(np.frombuffer(a, "<i4"), np.frombuffer(b, "<i4")) for _, _, pairs in rows for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
    named, often = np.unique(np.concatenate([*named, np.zeros(0, np.int32)]), return_counts=True)
    # what a swap changes is under the penalty, whether or not it tells the labels apart
    places = np.union1d(_kept(base, np.array([r[0] for r in rows]), FEATURES), named[often >= 3]).astype(np.int64)
    index = np.full(WEIGHTS, len(places), np.int32)  # the last weight stands for the slots that stay 0
    index[places] = np.arange(len(places))

    def known(raw: bytes) -> np.ndarray:
        own = index[np.frombuffer(raw, "<i4")]
        return own[own < len(places)]

    sets, y = [known(r[1]) for r in rows], [r[0] for r in rows]
    left, right = [], []
    for label, _, pairs in rows:
        for a, b in zip(pairs[::2], pairs[1::2], strict=True):
            left.append(len(sets))
            right.append(len(sets) + 1)
            sets += [known(a), known(b)]
            y += [label, label]
    n, k, of = max(1, len(sets)), len(places), np.array(y, float)
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    at = np.repeat(np.arange(len(sets), dtype=np.int64), [len(x) for x in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.int32)])
    weight = np.where(of > 0, POSITIVE, 1.0) / n
    w, bias, m, v = np.zeros(k), 0.0, np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, STEPS + 1 if len(sets) else 1):
        z = bias + np.bincount(at, w[flat], n)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - of) * weight
        slope = d.sum()
        moved = (z[left] - z[right]) * (2 * penalty / n)
        np.add.at(d, left, moved)
        np.add.at(d, right, -moved)
        full = np.append(np.bincount(flat, d[at], k) + RIDGE / n * w, slope)
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full * full
        step = 0.1 * min(1.0, 2 - 2 * t / STEPS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    out = np.zeros(WEIGHTS)
    out[places] = w
    return out, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY, identity: tuple[tuple[str, ...], ...] = IDENTITY, inject: int = INJECT) -> tuple[np.ndarray, float]:
    """Weights and bias from labels (doc_id, toxic) and the texts of docs. At most `sample` labelled rows, those with the
    smallest hash of the id, are looked at; rows without a label, id or text don't count, and of a repeated id the larger
    label does. identity: groups of terms that stand for each other. Empty tables give weights of 0."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    got = mapped(rows.select("doc_id", "y", "text"), _extract(Swaps(identity), inject), "y double, slots binary, pairs array<binary>").collect()  # `sample` rows at most
    return _fit(sorted((r.y, bytes(r.slots), [bytes(x) for x in r.pairs]) for r in got), penalty)


def _scores(batch: pa.RecordBatch, weights: np.ndarray, bias: float) -> np.ndarray:
    parts = [1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, weights[slots], b - a), -30, 30))) for a, b, rows, slots in _features(batch)]
    return np.concatenate([*parts, np.zeros(0)])


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic), predicted (1 where score >= threshold) for every row of docs.

    Null and empty texts have the score of a text without words. Repeated rows and null ids are scored like others; an
    empty table gives an empty result; no other column is looked at."""
    weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(batch, sent.value, bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold; scored as in score()."""
    weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, sent.value, bias) < threshold))

    return mapped(docs, run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The fold that no fit may see: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1
