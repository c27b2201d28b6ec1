"""Operators without a relational form: compression, Fourier power, sequential generators, exhaustive order search and pair
merges. Each works on one document (or item) at a time, in Arrow batches."""

from __future__ import annotations

import bz2
import hashlib
import itertools
import lzma
import random
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions.columns import tokens
from strandlab.functions.workers import mapped

COMPRESSORS: dict[str, Callable[[bytes], bytes]] = {"zlib": lambda b: zlib.compress(b, 9), "bz2": lambda b: bz2.compress(b, 9), "lzma": lambda b: lzma.compress(b, preset=6)}


def stable_seed(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big")


def per_row(fn: Callable[[dict], list[dict]], kind: str):
    """A mapInArrow function from a function of a row that gives rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in fn(row)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def rows_of(df: DataFrame, fn: Callable[[dict], list[dict]], kind: str) -> DataFrame:
    return mapped(df, per_row(fn, kind), kind)


def canonical(seq: list) -> bytes:
    """First-occurrence numbers, four bytes each: the same for any renaming of the symbols."""
    ids: dict = {}
    return b"".join(ids.setdefault(x, len(ids)).to_bytes(4, "little") for x in seq)


def compression_ratio(docs: DataFrame) -> DataFrame:
    """Compressed over plain bytes of the tokens joined by one space; null without tokens."""

    def one(r: dict) -> list[dict]:
        raw = " ".join(r["t"]).encode()
        return [{"doc_id": r["doc_id"], "ratio": len(zlib.compress(raw, 9)) / len(raw) if raw else None}]

    return rows_of(docs.select("doc_id", tokens(F.col("text")).alias("t")), one, "doc_id long, ratio double")


def compression_shuffle_gain(docs: DataFrame, replicates: int = 4, mode: str = "token") -> DataFrame:
    """Mean compressed size of shuffled sequences minus the observed one: of tokens (mode "token", by first occurrence), for
    each token; of token lengths as they are (mode "length", 4 bytes each), for each byte."""

    def one(r: dict) -> list[dict]:
        lengths = mode == "length"
        seq = [len(x) for x in r["t"]] if lengths else r["t"]
        if not seq:
            return [{"doc_id": r["doc_id"], "gain": None}]
        raw = lambda x: np.array(x, "<u4").tobytes() if lengths else canonical(x)
        seen, total = len(zlib.compress(raw(seq), 9)), 0
        for k in range(replicates):
            own = list(seq)
            random.Random(stable_seed("gain", r["doc_id"], k)).shuffle(own)
            total += len(zlib.compress(raw(own), 9))
        return [{"doc_id": r["doc_id"], "gain": (total / replicates - seen) / (len(seq) * (4 if lengths else 1))}]

    return rows_of(docs.select("doc_id", tokens(F.col("text")).alias("t")), one, "doc_id long, gain double")


def compression_distances(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, a, b) -> normalised compression distance and relative length difference under each compressor."""

    def one(r: dict) -> list[dict]:
        a, b = (r["a"] or "").encode(), (r["b"] or "").encode()
        out = []
        for name, c in COMPRESSORS.items():
            x, y = len(c(a)), len(c(b))
            joint = min(len(c(a + b)), len(c(b + a)))
            out.append({"a_id": r["a_id"], "b_id": r["b_id"], "compressor": name, "ncd": (joint - min(x, y)) / max(x, y), "d_len": abs(len(a) - len(b)) / max(1, len(a), len(b))})
        return out

    return rows_of(pairs.select("a_id", "b_id", "a", "b"), one, "a_id long, b_id long, compressor string, ncd double, d_len double")


def low_frequency_power(docs: DataFrame) -> DataFrame:
    """Share of the power of token lengths (mean removed) in the lowest quarter of the frequencies, rounded up; 0 without
    power."""

    def one(r: dict) -> list[dict]:
        x = np.array([len(t) for t in r["t"]], float)
        if len(x) < 2:
            return [{"doc_id": r["doc_id"], "low_power": 0.0}]
        p = np.abs(np.fft.rfft(x - x.mean())[1:]) ** 2
        total = p.sum()
        return [{"doc_id": r["doc_id"], "low_power": float(p[: max(1, -(-len(p) // 4))].sum() / total) if total > 0 else 0.0}]

    return rows_of(docs.select("doc_id", tokens(F.col("text")).alias("t")), one, "doc_id long, low_power double")


def copy_mutate(docs: DataFrame, replicates: int = 2, window: int = 20, copy: float = 0.75, mutation: float = 0.18) -> DataFrame:
    """Null family: each token copies one of the last `window` (then perhaps changes, loses or gains a letter), or is drawn from
    the document's tokens. Gives the share of repeats of the neighbour, by replicate."""

    def one(r: dict) -> list[dict]:
        own = r["t"]
        letters = sorted({c for t in own for c in t})
        out = []
        for k in range(replicates):
            rng, made = random.Random(stable_seed("copy", r["doc_id"], k)), []
            for _ in own:
                if made and rng.random() < copy:
                    t = rng.choice(made[-window:])
                    if rng.random() < mutation:
                        at, kind = rng.randrange(len(t)), rng.randrange(3)
                        t = t[:at] + ("" if kind == 1 and len(t) > 1 else rng.choice(letters)) + t[at + (kind != 2) :]
                else:
                    t = rng.choice(own)
                made.append(t)
            same = sum(a == b for a, b in itertools.pairwise(made))
            out.append({"doc_id": r["doc_id"], "rep": k, "repeat_rate": same / (len(made) - 1) if len(made) > 1 else None, "n": len(made)})
        return out

    return rows_of(docs.select("doc_id", tokens(F.col("text")).alias("t")), one, "doc_id long, rep int, repeat_rate double, n long")


def markov(docs: DataFrame, replicates: int = 1) -> DataFrame:
    """Null family: first-order chain of a document's tokens, with a draw from all where a token has no follower."""

    def one(r: dict) -> list[dict]:
        own, after = r["t"], {}
        for a, b in itertools.pairwise(own):
            after.setdefault(a, []).append(b)
        out = []
        for k in range(replicates):
            rng, made = random.Random(stable_seed("markov", r["doc_id"], k)), []
            for _ in own:
                made.append(rng.choice(after.get(made[-1], own)) if made else rng.choice(own))
            out.append({"doc_id": r["doc_id"], "rep": k, "types": len(set(made)), "n": len(made)})
        return out

    return rows_of(docs.select("doc_id", tokens(F.col("text")).alias("t")), one, "doc_id long, rep int, types long, n long")


ALPHABET = "abcdefghiklmnopqrstuvwxyz"


def letters(text: str) -> list[int]:
    return [ALPHABET.index(c) for c in text.lower().replace("j", "i") if c in ALPHABET]


def columnar(seq: list, order: tuple[int, ...]) -> list:
    """Columns of a grid as wide as the order is long, read in that order."""
    return [x for c in order for x in seq[c :: len(order)]]


def restored(cipher: list, order: tuple[int, ...]) -> list:
    """Inverse of columnar(), also for ragged grids."""
    w, n = len(order), len(cipher)
    out, at = [None] * n, 0
    for c in order:
        size = len(range(c, n, w))
        out[c::w] = cipher[at : at + size]
        at += size
    return out


def modal_consistency(plain: np.ndarray, pairs: np.ndarray) -> float:
    """Mean share of the most frequent partner, from both sides."""
    table = np.zeros((25, 25), int)
    np.add.at(table, (plain, pairs), 1)
    return float((table.max(0).sum() + table.max(1).sum()) / (2 * max(1, len(plain))))


def order_search(items: DataFrame, width: int = 4) -> DataFrame:
    """Encipher each item (fractionation over a 5 x 5 square, then columns in a hash-chosen order), try every order of the width
    and rank them by modal consistency with the plain text: the true order's place among all."""

    def one(r: dict) -> list[dict]:
        plain = letters(r["text"] or "")
        if not plain:
            return []
        square = list(range(25))
        random.Random(stable_seed("square", r["item_id"])).shuffle(square)
        stream = [d for x in plain for d in divmod(square[x], 5)]
        orders = list(itertools.permutations(range(width)))
        true = orders[stable_seed("order", r["item_id"]) % len(orders)]
        cipher = columnar(stream, true)
        scores = []
        for o in orders:
            back = restored(cipher, o)
            scores.append(modal_consistency(np.array(plain), np.array(back[::2]) * 5 + np.array(back[1::2])))
        own = scores[orders.index(true)]
        rank = 1 + sum(s > own + 1e-12 for s in scores) + 0.5 * (sum(abs(s - own) <= 1e-12 for s in scores) - 1)
        return [{"item_id": r["item_id"], "orders": len(orders), "true_score": own, "best_score": max(scores), "true_rank": rank}]

    return rows_of(items.select("item_id", "text"), one, "item_id long, orders int, true_score double, best_score double, true_rank double")


def second_order_gain(items: DataFrame, train: float = 0.7, alpha: float = 0.1, backoff: float = 5.0) -> DataFrame:
    """Mean bits by which an order-2 model predicts the rest of a text better than an order-1 model, both fitted on its
    beginning (`train` of its letters, 3 at least). Each is additively smoothed over 25 symbols; the order-2 estimate is mixed
    with the order-1 one by n / (n + backoff), n the number of its context. Null where nothing is left to predict."""

    def one(r: dict) -> list[dict]:
        seq = letters(r["text"] or "")
        cut = max(3, int(len(seq) * train))
        if cut >= len(seq):
            return [{"item_id": r["item_id"], "gain_bits": None}]
        x = np.array(seq)
        one_, two = np.zeros((25, 25)), np.zeros((25, 25, 25))
        np.add.at(one_, (x[: cut - 1], x[1:cut]), 1)
        np.add.at(two, (x[: cut - 2], x[1 : cut - 1], x[2:cut]), 1)
        a, b, c = x[cut - 2 : -2], x[cut - 1 : -1], x[cut:]
        low = (one_[b, c] + alpha) / (one_[b].sum(1) + 25 * alpha)
        n = two[a, b].sum(1)
        high = (two[a, b, c] + alpha) / (n + 25 * alpha)
        mixed = (n * high + backoff * low) / (n + backoff)
        return [{"item_id": r["item_id"], "gain_bits": float(np.log2(mixed / low).mean())}]

    return rows_of(items.select("item_id", "text"), one, "item_id long, gain_bits double")


def fit_merges(docs: DataFrame, count: int) -> list[tuple[str, str]]:
    """The most frequent adjacent pair of units, again and again (ties: the pair that sorts first). Distinct words are counted
    once; each round is one aggregation of their pairs, of which the driver sees the winner."""
    words = docs.select(F.explode(tokens(F.col("text"))).alias("w")).groupBy("w").count().persist()
    merges: list[tuple[str, str]] = []
    try:
        for _ in range(count):

            def pairs(r: dict, merges: tuple = tuple(merges)) -> list[dict]:
                units = [*r["w"]]
                for m in merges:
                    units = apply_merge(units, m)
                return [{"a": a, "b": b, "n": r["count"]} for a, b in itertools.pairwise(units)]

            best = rows_of(words, pairs, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").first()
            if best is None:
                break
            merges.append((best["a"], best["b"]))
    finally:
        words.unpersist()
    return merges


def apply_merge(units: list[str], pair: tuple[str, str]) -> list[str]:
    """Greedy, left to right, without overlaps."""
    out, i = [], 0
    while i < len(units):
        if i + 1 < len(units) and (units[i], units[i + 1]) == pair:
            out.append(units[i] + units[i + 1])
            i += 2
        else:
            out.append(units[i])
            i += 1
    return out


def apply_merges(docs: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """Units of each document under the merges: their number, mean width, and whether they spell the text again."""

    def one(r: dict) -> list[dict]:
        n = width = 0
        same = True
        for t in r["t"]:
            units = [*t]
            for m in merges:
                units = apply_merge(units, m)
            n, width, same = n + len(units), width + len(t), same and "".join(units) == t
        return [{"doc_id": r["doc_id"], "units": n, "mean_width": width / n if n else None, "restored": same}]

    return rows_of(docs.select("doc_id", tokens(F.col("text")).alias("t")), one, "doc_id long, units long, mean_width double, restored boolean")
