"""Removal of repeated passages by a relative Lempel-Ziv parse.

Reference of a word's place is all text before it: smaller doc_ids, and the same document up to there. A document is
parsed into factors (start, length, source document, source place) and literals: each factor equals the reference's words
at its source, word for word, and follows this source as far as it goes. Factors of WINDOW words or more are the duplicate
spans. As a new factor may begin before the last one ends, the windows across factor boundaries are looked at like all
others.

Reference blocks are set by the content: each window of WINDOW words belongs to its least 8-word hash (its anchor), and
neighbouring windows with one anchor form a block. A copied window has its source's anchor wherever it stands, so blocks
are indexed by anchor, every block of every document. (1) Anchors are indexed and those of one block alone drop out: there
nothing is copied. (2) The other blocks are looked up whole: equal blocks get the first one as their source. (3) First
blocks whose anchor has other first blocks are looked up window by window, so that factors are exact to the word. (4) What
was found is strung together: pieces that follow each other in the text and in one source are one factor. (5) At the
boundaries of every factor, its first and its last WINDOW words, digests (BLAKE2b, 128 bits) of the words themselves are
held against the source's; a factor that differs is dropped. (6) Factors are cut from the texts.

What one slice (about half a megabyte of text) has more than once is settled in it: only its first occurrence goes to the
shuffle. All else that meets by key is combined before the shuffle, or is a join that adaptive execution splits, so a passage
that very many documents have fills no task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.llm import words as W
from strandlab.llm.common import discard, mapped, per_row, stage

WINDOW, GRAM = 20, 8


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i that has so many."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :]) if have < width else out


class Blocks:
    """Windows of the rows of a slice: row, place (word in the row), anchor and block number of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        starts, ends, first = W.spans(data, offsets)
        self.words = W.word_hashes(data, starts, ends, lower=False)
        n = len(self.words)
        none = np.zeros(0, np.int64)
        self.at = self.row = self.place = self.block = none
        self.anchor = np.zeros(0, np.uint64)
        if n < window:
            return
        grams = W.gram_hashes(self.words, gram)
        anchors = _least(grams, window - gram + 1)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        at = np.flatnonzero(np.arange(n - window + 1) + window <= first[row[: n - window + 1] + 1])
        if not len(at):
            return
        self.at, self.row, self.anchor = at, row[at], anchors[at]
        self.place = at - first[self.row]
        new = np.ones(len(at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (at[1:] != at[:-1] + 1) | (self.row[1:] != self.row[:-1])
        self.block = np.cumsum(new) - 1
        self.heads = np.flatnonzero(new)
        again = np.zeros(len(grams), np.int64)  # a gram that comes back so soon may repeat within one block
        for d in range(1, window - gram + 2):
            if d < len(grams):
                again[:-d] |= grams[:-d] == grams[d:]
        total = np.concatenate([[0], np.cumsum(again)])
        tails = np.append(self.heads[1:], len(at)) - 1
        self.inside = total[np.minimum(at[tails] + window - gram + 1, len(grams))] > total[at[self.heads]]


def _firsts(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether it is the first in the order of (doc, place), and whether it isn't alone."""
    order = np.lexsort((place, doc, key))
    sorted_ = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    alone = new.copy()
    alone[:-1] &= new[1:]
    first, single = np.empty(len(key), bool), np.empty(len(key), bool)
    first[order], single[order] = new, alone
    return first, ~single


def _index(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, _, data, offsets in W.texts(batch):
                b = Blocks(data, offsets, window, gram)
                if not len(b.at):
                    continue
                anchor, doc = b.anchor[b.heads], ids[a + b.row[b.heads]]
                first, many = _firsts(anchor, doc, b.place[b.heads])
                salt = np.where(first, 0, 1 + (np.arange(len(first)) & 1023))
                columns = [pa.array(anchor.view(np.int64)), pa.array(salt, pa.int32()), pa.array(doc), pa.array(many | b.inside)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "salt", "doc_id", "sure"])

    return run


def _row_key(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix(h + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _earliest(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each entry: the entry with its key that is the first in the order of (doc, place)."""
    order = np.lexsort((place, doc, key))
    sorted_ = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


_BLOCK = "doc_id long, place int, k int, h long, anchor long, inside boolean, source long, source_place int, windows array<long>"


def _shared_blocks(window: int, gram: int):
    """The blocks whose anchor is in the row's list. source and source_place: of blocks that the slice has before; all
    others have the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            shared = batch.column("shared")
            for a, e, data, offsets in W.texts(batch):
                b = Blocks(data, offsets, window, gram)
                own = shared.slice(a, e - a)
                wanted = _row_key(np.repeat(np.arange(e - a), own.value_lengths().to_numpy(zero_copy_only=False)), own.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                if not len(b.at):
                    continue
                got = np.flatnonzero(np.isin(_row_key(b.row[b.heads], b.anchor[b.heads]), wanted))
                if not len(got):
                    continue
                heads = b.heads[got]
                k = np.diff(np.append(b.heads, len(b.at)))[got]
                h = W.run_hashes(b.words, b.at[heads], b.at[heads] + k + window - 1)
                doc, place = ids[a + b.row[heads]], b.place[heads]
                source = _earliest(h, doc, place)
                first = source == np.arange(len(h))
                every = W.gram_hashes(b.words, window)
                sizes = np.where(first, k, 0)
                ends = np.cumsum(sizes)
                flat = every[np.repeat(b.at[heads] - (ends - sizes), sizes) + np.arange(ends[-1])]
                columns = [
                    pa.array(doc), pa.array(place, pa.int32()), pa.array(k, pa.int32()), pa.array(h.view(np.int64)), pa.array(b.anchor[heads].view(np.int64)), pa.array(b.inside[got]),
                    pa.array(doc[source], mask=first), pa.array(place[source], pa.int32(), mask=first), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "k", "h", "anchor", "inside", "source", "source_place", "windows"])

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _digests(window: int):
    """source, source_place, digest of the windows at the places in the row's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            raw = data.tobytes()
            for i, (doc, places) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("places").to_pylist(), strict=True)):
                words = raw[offsets[i] : offsets[i + 1]].split()
                got = [_digest(words[p : p + window]) for p in places]
                yield pa.RecordBatch.from_pydict({"source": pa.array([doc] * len(got), pa.int64()), "source_place": pa.array(places, pa.int32()), "digest": pa.array(got, pa.binary())})

    return run


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            raw = data.tobytes()
            size, removed, digest, kept_text = [], [], [], []
            for i, factors in enumerate(batch.column("factors").to_pylist()):
                words = raw[offsets[i] : offsets[i + 1]].split()
                size.append(len(words))
                gone = 0
                if factors:
                    change = np.zeros(len(words) + 1, np.int64)
                    for f in factors:
                        start, end = f["start"], f["start"] + f["length"]
                        if _digest(words[start : start + window]) == f["head"] and _digest(words[end - window : end]) == f["tail"]:
                            change[start] += 1
                            change[end] -= 1
                    keep = np.cumsum(change[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    words = list(compress(words, keep.tolist()))
                removed.append(gone)
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_text.append(kept.decode())
            columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                columns.append(pa.array(kept_text, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _pieces(blocks: DataFrame) -> DataFrame:
    """doc_id, place, k (windows from there on), source, source_place: what repeats, in pieces."""
    at = F.struct("doc_id", "place")
    alone = blocks.where("source is null")
    firsts = stage(alone.groupBy("h").agg(F.min(at).alias("first"), F.min("anchor").alias("anchor"), F.max("inside").alias("inside"), F.count("*").alias("n")), "firsts")
    repeated = firsts.where("n > 1").select("h", "first")
    several = firsts.groupBy("anchor").agg((F.max("inside") | (F.count("*") > 1)).alias("open")).where("open").select("anchor")
    open_ = firsts.join(several, "anchor").select(F.col("first.doc_id").alias("doc_id"), F.col("first.place").alias("place"))
    windows = alone.join(open_, ["doc_id", "place"]).select("doc_id", F.posexplode("windows").alias("i", "h"), "place").select("doc_id", (F.col("place") + F.col("i")).alias("place"), "h")
    windows = stage(windows, "windows")
    again = windows.groupBy("h").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")

    def found(rows: DataFrame, k: Column, first: DataFrame) -> DataFrame:
        got = rows.join(first, "h").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("place") != F.col("first.place")))
        return got.select("doc_id", "place", k.alias("k"), F.col("first.doc_id").alias("source"), F.col("first.place").alias("source_place"))

    inside = blocks.where("source is not null").select("doc_id", "place", "k", "source", "source_place")
    return inside.unionByName(found(alone.select("doc_id", "place", "k", "h"), F.col("k"), repeated)).unionByName(found(windows, F.lit(1), again))


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The parse of docs, whose doc_ids are unique: doc_id, start, length (words), source, source_start, and head and tail,
    digests of the source's first and last `window` words of the factor. All factors of `window` words or more."""
    texts = _texts(docs)
    index = mapped(texts, _index(window, gram), "h long, salt int, doc_id long, sure boolean")
    others = F.count("*").over(Window.partitionBy("h", "salt")) > 1
    shared = stage(index.withColumn("sure", F.col("sure") | others).where("sure").select("doc_id", "h"), "shared")
    wanted = shared.groupBy("doc_id").agg(F.collect_set("h").alias("shared"))
    blocks = stage(mapped(texts.join(wanted, "doc_id"), _shared_blocks(window, gram), _BLOCK), "blocks")
    pieces = _pieces(blocks)
    order = Window.partitionBy("doc_id").orderBy("place")
    goes_on = (F.lag(F.col("place") + F.col("k")).over(order) == F.col("place")) & (F.lag("source").over(order) == F.col("source")) & (F.lag(F.col("place") - F.col("source_place")).over(order) == F.col("place") - F.col("source_place"))
    strung = pieces.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("number", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parsed = strung.groupBy("doc_id", "number").agg(F.min("place").alias("start"), (F.sum("k") + window - 1).cast("int").alias("length"), F.min("source").alias("source"), F.min("source_place").alias("source_start"))
    parsed = stage(parsed.drop("number"), "parsed")
    discard(shared, blocks)
    ends = parsed.select("source", F.explode(F.array(F.col("source_start"), F.col("source_start") + F.col("length") - window)).alias("place")).distinct()
    asked = ends.groupBy(F.col("source").alias("doc_id")).agg(F.collect_list("place").alias("places"))
    digests = stage(mapped(texts.join(asked, "doc_id"), _digests(window), "source long, source_place int, digest binary"), "digests")
    head = digests.select("source", F.col("source_place").alias("source_start"), F.col("digest").alias("head"))
    tail = digests.select("source", F.col("source_place").alias("source_end"), F.col("digest").alias("tail"))
    out = parsed.withColumn("source_end", F.col("source_start") + F.col("length") - window).join(head, ["source", "source_start"]).join(tail, ["source", "source_end"])
    return stage(out.select("doc_id", "start", "length", "source", "source_start", "head", "tail"), "factors")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and with with_text kept_text.

    A word goes when some window of `window` consecutive words that covers it has an equal one that starts earlier
    (smaller doc_id, or same document and earlier place); windows are those of the input. Null, empty and short texts lose
    nothing. Rows with a null or repeated doc_id count as documents of their own, in the order of per_row; an empty table
    gives an empty result; other columns are not looked at."""
    return per_row(docs, lambda d: _remove_repeats(d, window, gram, with_text))


def _remove_repeats(docs: DataFrame, window: int, gram: int, with_text: bool) -> DataFrame:
    own = factors(docs, window, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "head", "tail")).alias("factors"))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return mapped(_texts(docs).join(own, "doc_id", "left"), _cut(window, with_text), kind)
