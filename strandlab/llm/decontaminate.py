"""Benchmark decontamination by template canonicalisation.

Words are runs of characters that are neither white space nor ASCII punctuation (a point, comma or colon between digits
belongs to the number), A-Z lower-cased. They become templates: a number, in digits or one of the words in NUMBERS, turns
into <num>, a unit after a number into
<unit> (also one joined to its number), a capitalised word that doesn't begin a sentence into <name>; other words stay. In
the wide form a capitalised word that begins a sentence is a <name> too unless it is in COMMON, and names with only a
blank between them are one. Windows of WINDOW template words
of the benchmark items are looked up among the windows of all documents. A document has an item when at least SHARE of
the item's windows agree along alignments whose slots are consistent: within one alignment a filler of the item goes
with one filler of the document. So a question with other numbers or names is caught, and a text of the same shape whose
fillers contradict each other is not. An item with fewer literal words than WINDOW must agree in its fillers too, and
one with fewer words than WINDOW is one window.

A document that has SHARE of an item's windows has one of any (1 - SHARE) * n + 1 of them, so only that many, the rarest
among the items, are looked up (probes); items with slots are looked up word by word as well, so that one in small letters
is found; documents with a hit are then compared with the item's whole template. This is a hash join whose small side is
broadcast: items go to the workers in blocks of BLOCK_WORDS words at most (about 100 MB), one pass over the documents for
each block; a benchmark of 20 million words costs ten passes, about 60 CPU seconds a GB each, and no shuffle."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm import words as W
from strandlab.llm.common import mapped, small_table

WINDOW, SHARE = 5, 0.8
#: Most words of benchmark items that a pass sends to the workers (about 50 bytes each).
BLOCK_WORDS = 2_000_000
#: Units that count as such after a number (fixed word list).
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres "
    "dollar dollars euro euros cent cents percent kmh mph hz khz mhz ghz w kw v a j kj cal kcal degree degrees"
).split()
#: Words that are numbers (fixed word list; "one" is more often none).
NUMBERS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty "
    "seventy eighty ninety hundred thousand million dozen"
).split()
#: Words that are no names where they begin a sentence (fixed word list).
COMMON = (
    "a about after all also although an and another any are as at because before both but by can could did do does during each either every few find finally "
    "first for four five from give given had has have he her here his how i if in instead is it its last later let many more most my new next no not now of on "
    "once one only or other our over second she should since so some such ten than that the their them then there these they third this those though three "
    "through to today two under until up was we well were what when where whether which while who whose why will with without would yes you your"
).split()


def _hash_of(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return W.word_hashes(raw, np.array([0]), np.array([len(raw)]), lower=True)[0]


_UNITS = np.sort(np.array([_hash_of(u) for u in UNITS], np.uint64))
_NUMBERS = np.sort(np.array([_hash_of(u) for u in NUMBERS], np.uint64))
_COMMON = np.sort(np.array([_hash_of(u) for u in COMMON], np.uint64))
_NUM, _UNIT, _NAME = W.mix(np.array([11, 12, 13], np.uint64))
_PLAIN = np.ones(256, bool)
_PLAIN[:128] = [chr(c).isalnum() for c in range(128)]


@dataclass
class Templates:
    """Of rows after another: template hash, filler hash and slot flag of each word, and each row's first word."""

    words: np.ndarray
    fillers: np.ndarray
    slots: np.ndarray
    first: np.ndarray


def _among(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[Templates, Templates]:
    """Strict and wide form."""
    n = len(data)
    digit = (data >= 48) & (data <= 57)
    inner = np.zeros(n, bool)
    if n > 2:
        inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44) | (data[1:-1] == 58)) & digit[:-2] & digit[2:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        inner[edges] = inner[edges - 1] = False
    solid = _PLAIN[data] | inner
    starts, ends, first = W.spans(np.where(solid, data, np.uint8(32)), offsets)
    if not len(starts):
        none = Templates(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), first)
        return none, none
    stops = np.append(np.flatnonzero(~(digit | inner)), n)
    cut = stops[np.searchsorted(stops, starts)]
    joined = np.flatnonzero(digit[starts] & (cut < ends))
    if len(joined):
        joined = joined[_among(W.word_hashes(data, cut[joined], ends[joined], lower=True), _UNITS)]
        cut = cut[joined]
        starts, ends, first = np.insert(starts, joined + 1, cut), np.insert(ends, joined, cut), first + np.searchsorted(joined, first)
    raw = W.word_hashes(data, starts, ends, lower=True)
    strange = np.concatenate([[0], np.cumsum(~(digit | inner))])
    number = (strange[ends] == strange[starts]) | _among(raw, _NUMBERS)
    row_start = np.zeros(len(starts), bool)
    row_start[first[:-1][first[:-1] < first[1:]]] = True
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1] & ~row_start[1:]
    unit = after & _among(raw, _UNITS)
    upper = (data[starts] >= 65) & (data[starts] <= 90) & (ends - starts > 1)
    seen = (data != 32) & ((data < 9) | (data > 13)) & (data != 34) & (data != 39) & (data != 40)
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(seen, np.arange(n), -1))])
    before = data[np.maximum(last[starts], 0)]
    opens = row_start | (before == 46) | (before == 33) | (before == 63) | (before == 58)
    name = upper & ~opens
    words = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, raw)))
    strict = Templates(words, raw, number | unit | name, first)
    more = name | (upper & opens & ~_among(raw, _COMMON))
    goes_on = np.zeros(len(starts), bool)
    goes_on[1:] = more[1:] & more[:-1] & ~opens[1:] & (starts[1:] == ends[:-1] + 1) & (data[ends[:-1]] == 32)
    heads = np.flatnonzero(~goes_on)
    if len(heads) < len(starts):
        # of a run: the sum of its words' hashes, each turned by its place in the run
        place = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
        fillers = np.add.reduceat(np.where(place > 0, W.mix(raw + place.astype(np.uint64)), raw), heads)
    else:
        fillers = raw[heads]
    wide = Templates(np.where(more, _NAME, words)[heads], fillers, (strict.slots | more)[heads], np.searchsorted(heads, first))
    return strict, wide


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    return W.gram_hashes(words, min(width, len(words))) if len(words) else np.zeros(0, np.uint64)


class Items:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str]], width: int, share: float):
        self.width, self.share, self.items = width, share, []
        self.is_wide: list[bool] = []
        for item, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            t, wide = templates(data, np.array([0, len(data)]))
            if len(t.words):
                plain = Templates(t.fillers, t.fillers, np.zeros(len(t.words), bool), t.first)
                for form in (t, plain) if t.slots.any() else (t,):
                    self.items.append((item, form, _windows(form.words, width)))
                    self.is_wide.append(False)
                if wide.slots.any():
                    self.items.append((item, wide, _windows(wide.words, width)))
                    self.is_wide.append(True)
        shared = Counter(int(h) for _, _, hs in self.items for h in set(hs.tolist()))
        self.probes: dict[int, list[int]] = defaultdict(list)
        for i, (_, _, hs) in enumerate(self.items):
            own = sorted(hs.tolist(), key=lambda h: (shared[h], h))
            # places of the windows count: as many may be missing as a match can do without
            for h in set(own[: len(own) - math.ceil(share * len(own)) + 1]):
                self.probes[h].append(i)
        self.sizes = sorted({min(width, len(t.words)) for _, t, _ in self.items})
        self.keys = np.sort(np.array(list(self.probes), np.uint64))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places in h of probes."""
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        return maybe[self.keys[at] == h[maybe]]

    def match(self, words: np.ndarray, fillers: np.ndarray, i: int) -> tuple[int, bool] | None:
        """Windows of item i that the document's template has, and whether an alignment with the same fillers has SHARE
        of them; None if there are too few."""
        _, t, hs = self.items[i]
        k = min(self.width, len(t.words))
        own = W.gram_hashes(words, k) if len(words) >= k else np.zeros(0, np.uint64)
        at_of = defaultdict(list)
        for a, h in enumerate(hs.tolist()):
            at_of[h].append(a)
        along: dict[int, set[int]] = defaultdict(set)
        keys = np.sort(hs)
        for p in np.flatnonzero(keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own).tolist():
            for a in at_of[int(own[p])]:
                along[p - a].add(a)
        found, same = set(), set()
        exact_only = int((~t.slots).sum()) < self.width
        for shift, ats in along.items():
            goes, back, agrees = {}, {}, True
            equal = True
            for w in sorted({a + j for a in ats for j in range(k)}):
                if t.slots[w]:
                    mine, theirs = int(t.fillers[w]), int(fillers[w + shift])
                    equal &= mine == theirs
                    agrees &= goes.setdefault(mine, theirs) == theirs
                    if t.words[w] == _NAME:
                        agrees &= back.setdefault(theirs, mine) == mine
            if agrees and (equal or not exact_only):
                found |= ats
                if equal:
                    same |= ats
        need = math.ceil(self.share * len(hs))
        return (len(found), len(same) >= need) if len(found) >= need else None


_KIND = "doc_id long, item_id long, matched long, windows long, same_fillers boolean"


def _matches(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[int, int, tuple[int, bool]]]:
    """Row, item and match of what the rows of a batch have."""
    for a, _, data, offsets in W.texts(batch):
        t, wide = templates(data, offsets)
        found = defaultdict(set)
        for k in items.sizes:
            for words, first in ((t.words, t.first), (t.fillers, t.first), (wide.words, wide.first)):
                h = W.gram_hashes(words, k)
                places = items.hits(h)
                rows = np.searchsorted(first, places, "right") - 1
                inside = places + k <= first[rows + 1]
                for p, r in zip(places[inside].tolist(), rows[inside].tolist(), strict=True):
                    found[r].update(items.probes[int(h[p])])
        for r, own in found.items():
            cut, wide_cut = slice(t.first[r], t.first[r + 1]), slice(wide.first[r], wide.first[r + 1])
            best: dict[int, tuple] = {}
            for i in sorted(own):
                item, form, _ = items.items[i]
                got = items.match(wide.words[wide_cut], wide.fillers[wide_cut], i) if items.is_wide[i] else items.match((t.words if form.slots.any() else t.fillers)[cut], t.fillers[cut], i)
                if got:
                    old = best.get(item, (i, (0, False)))
                    best[item] = (i, (max(got[0], old[1][0]), got[1] or old[1][1]))
            for i, got in best.values():
                yield a + r, i, got


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        for batch in batches:
            ids = batch.column("doc_id")
            out = [(ids[r].as_py(), items.items[i][0], n, len(items.items[i][2]), same) for r, i, (n, same) in _matches(batch, items)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "matched", "windows", "same_fillers"])

    return run


def _drop(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for r, _, _ in _matches(batch, sent.value):
                keep[r] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, width: int, share: float, block_words: int) -> Iterator:
    """The items, a broadcast block of them at a time."""
    spark = benchmark.sparkSession
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        n = text.count(" ") + 1
        if block and size + n > block_words:
            yield spark.sparkContext.broadcast(Items(block, width, share))
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield spark.sparkContext.broadcast(Items(block, width, share))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and item that it has: doc_id, item_id, matched (windows found), windows (of the item),
    same_fillers (found as it is, not only re-parameterised).

    Null and empty texts and items have no window and match nothing; of repeated rows each gives its own rows; null ids
    are carried as null; empty tables give an empty result; other columns are not looked at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = small_table(docs.sparkSession, [], _KIND.replace("long", "bigint"))
    for sent in _blocks(benchmark, width, share, block_words):
        out = out.unionByName(mapped(rows, _search(sent), _KIND))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that have no item; see contaminated()."""
    for sent in _blocks(benchmark, width, share, block_words):
        docs = mapped(docs, _drop(sent), docs.schema)
    return docs
