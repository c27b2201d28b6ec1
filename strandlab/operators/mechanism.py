"""Mechanism study: does a simple generator give a corpus's held-out structure?

Pages (documents) are sequences of groups (words). Each is on one side of a split, training or held out. The observed corpus
and every replicate of every null family are measured alike: by the held-out gain of a character trigram over a unigram
model, of a group bigram over a unigram model (bits, additive smoothing, a closing symbol after each sequence), and by the
share of held-out groups within one edit of one of the last WINDOW groups of their page.

Pages are written once as numbers: each chunk has its distinct groups and the sequence of them. Replicates are generated
from the chunks where these are; a page's draws depend on (seed, family, replicate, doc_id) alone. Characters of a group that
occurs many times are counted once, with its weight; those of page_shuffle are those of the observed corpus. What travels are
sorted 64-bit keys of n-grams with their counts, in one value for each task, kind and range of keys, a few replicates in each
round, so that no more than a round's keys lie on disk. To the driver come, for each replicate and kind, how many held-out
n-grams have each training count: cross entropies are sums over these, whatever the smoothing."""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.functions.columns import holm
from strandlab.functions.workers import mapped

#: Null families and metrics.
FAMILIES = ("page_shuffle", "symbol_shuffle", "global_resample", "iid_symbol", "copy_mutate")
METRICS = ("char_trigram_gain", "group_bigram_gain", "local_copy_rate")
#: Smoothing, window of recent groups, and of the copying family the chances to copy and to change a group (fixed values).
ALPHA, WINDOW, COPY, MUTATION = 0.1, 20, 0.75, 0.18
HELD_OUT = 0.3
#: Most distinct groups that are sent to all workers; with more, each draw is looked up by a join.
SENT_TYPES = 4_000_000
#: Most strata of pages that are sent to all workers.
SENT_STRATA = 10_000
#: Groups of a chunk, of a task and of all replicates of a round (one replicate may have more); keys of a range.
CHUNK, TASK, ROUND, RANGE = 1 << 16, 1 << 21, 1 << 25, 1 << 21
#: Most cells of a table of all trigrams; of larger alphabets, keys are sorted.
CELLS = 1 << 22
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
#: Kinds of keys: character, its two predecessors with it and without it, group, pair of groups.
_CHAR, _TRIGRAM, _CONTEXT, _GROUP, _PAIR, _COPIES = range(6)
_DRAWING = ("global_resample", "copy_mutate")


def _mix(x: np.ndarray) -> np.ndarray:
    high = x >> _U(32)
    x = x ^ high
    with np.errstate(over="ignore"):
        for _ in range(2):
            x *= _U(0xD6E8FEB86659FD93)
            np.right_shift(x, _U(32), out=high)
            x ^= high
    return x


def _starts(size: np.ndarray) -> np.ndarray:
    """Where each of some consecutive pieces starts, and the end of all."""
    return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def _places_in(size: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of some consecutive pieces."""
    first = _starts(size)
    return np.arange(first[-1]) - np.repeat(first[:-1], size)


class Words:
    """Groups by where each starts in a buffer of symbol codes (over 0) and its size. codes has room for eight more bytes."""

    def __init__(self, codes: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.codes, self.at, self.size = codes, at, size

    @classmethod
    def flat(cls, codes: np.ndarray, size: np.ndarray) -> Words:
        return cls(_padded(codes), _starts(size)[:-1], size)

    def load(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The symbols from each place on as one number: as many as eight bytes hold, and n at most."""
        width = self.codes.itemsize
        every = np.ndarray((len(self.codes) - 8 // width + 1,), "<u8", self.codes, strides=(width,))
        bits = np.clip(n * (8 * width), 0, 64).astype(np.uint64)
        return np.where(bits > 0, every[at] << (_U(64) - np.maximum(bits, _U(1))) >> (_U(64) - np.maximum(bits, _U(1))), _U(0))

    @cached_property
    def head(self) -> np.ndarray:
        return self.load(self.at, self.size)

    @cached_property
    def hash(self) -> np.ndarray:
        step = 8 // self.codes.itemsize
        with np.errstate(over="ignore"):
            out = _mix(self.head + self.size.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
            rest = np.flatnonzero(self.size > step)
            done = step
            while len(rest):
                out[rest] = _mix(out[rest] * _GOLD + self.load(self.at[rest] + done, self.size[rest] - done))
                done += step
                rest = rest[self.size[rest] > done]
        return out

    @cached_property
    def letters(self) -> np.ndarray:
        """A bit for each symbol (modulo 64) that occurs an odd number of times. One edit changes two bits at most."""
        if not len(self.size):
            return np.zeros(0, np.uint64)
        codes = self.codes[: len(self.codes) - 8 // self.codes.itemsize] if self.dense else self.symbols()
        return np.bitwise_xor.reduceat(_U(1) << (codes.astype(np.uint64) & _U(63)), _starts(self.size)[:-1])

    @cached_property
    def dense(self) -> bool:
        """Whether the groups fill the buffer, one after the other."""
        return len(self.codes) - 8 // self.codes.itemsize == int(self.size.sum()) and bool((self.at == _starts(self.size)[:-1]).all())

    def symbols(self) -> np.ndarray:
        return self.codes[np.repeat(self.at - _starts(self.size)[:-1], self.size) + np.arange(int(self.size.sum()))]

    def known(self) -> Words:
        _ = self.head, self.hash, self.letters
        return self

    def pick(self, which: np.ndarray, names: tuple[str, ...] = ("at", "size")) -> Words:
        """Some of the groups; names: what is taken over (the rest is not there, or found anew from places and sizes)."""
        out = Words(self.codes, None, None)
        out.__dict__ |= {k: getattr(self, k)[which] for k in names}
        return out


def _padded(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([codes, np.zeros(8 // codes.itemsize, codes.dtype)])


def _kind_of(most: int) -> type:
    return np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32


def _one_edit(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the groups a and b, unequal and of sizes that differ by one at most, are within one edit."""
    swap = w.size[a] < w.size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    bits, step = _U(8 * w.codes.itemsize), 8 // w.codes.itemsize
    out = np.zeros(len(a), bool)
    todo, done = np.arange(len(a)), 0
    # the first place at which they differ; what follows there must be equal
    same = np.zeros(len(a), np.int64)
    while len(todo):
        i, j = a[todo], b[todo]
        x = (w.head[i] ^ w.head[j]) if not done else w.load(w.at[i] + done, w.size[i] - done) ^ w.load(w.at[j] + done, w.size[j] - done)
        low = x & (~x + _U(1))
        place = np.where(x > 0, np.bitwise_count(low - _U(1)).astype(np.int64) // int(bits), step)
        same[todo] = done + place
        done += step
        todo = todo[(x == 0) & (w.size[i] > done)]
    same = np.minimum(same, w.size[b])
    skip = (w.size[a] == w.size[b]).astype(np.int64)
    p, q, left = w.at[a] + same + 1, w.at[b] + same + skip, w.size[a] - same - 1
    ok = np.ones(len(a), bool)
    todo = np.flatnonzero(left > 0)
    while len(todo):
        eq = w.load(p[todo], left[todo]) == w.load(q[todo], left[todo])
        ok[todo[~eq]] = False
        todo = todo[eq]
        p, q, left = p + step, q + step, left - step
        todo = todo[left[todo] > 0]
    return out | ok


def _near(w: Words, place: np.ndarray, window: int) -> np.ndarray:
    """Of each group: whether one of the last `window` groups of its page is within one edit. place: in its page."""
    n = len(w.size)
    found = np.zeros(n, bool)
    for k in range(1, min(window, n - 1) + 1):
        i = np.flatnonzero(np.bitwise_count(w.letters[k:] ^ w.letters[:-k]) <= 2) + k
        i = i[~found[i] & (place[i] >= k)]
        equal = w.hash[i] == w.hash[i - k]
        found[i[equal]] = True
        i = i[~equal]
        i = i[np.abs(w.size[i] - w.size[i - k]) <= 1]
        found[i[_one_edit(w, i, i - k)]] = True
    return found


class Groups:
    """Groups of consecutive pages: characters, each group's first (one more than groups) and its page."""

    def __init__(self, chars: np.ndarray, first: np.ndarray, page: np.ndarray):
        self.chars, self.first, self.page = chars, first, page


def _flat(pages: list[list[str]]) -> Groups:
    own = [g for p in pages for g in p]
    chars = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4")
    return Groups(chars, _starts(np.fromiter(map(len, own), np.int64, len(own))), np.repeat(np.arange(len(pages)), [len(p) for p in pages]))


def near_recent(g: Groups, window: int = WINDOW) -> np.ndarray:
    """Of each group: whether one of the last `window` groups of its page is within one edit: a substitution, an insertion
    or a deletion, or none."""
    codes = g.chars.astype(np.int64) + 1
    first = np.append(True, g.page[1:] != g.page[:-1])
    at = np.arange(len(g.page))
    return _near(Words.flat(codes.astype(_kind_of(int(codes.max(initial=0)))), np.diff(g.first)), at - np.maximum.accumulate(np.where(first, at, 0)), window)


class Draws:
    """Distributions of all groups and of all symbols: values and cumulative counts. Symbols have codes from 1 on."""

    def __init__(self, types: list[str] | pa.Array, upto: np.ndarray, symbols: np.ndarray, symbols_upto: np.ndarray):
        self.upto, self.symbols, self.symbols_upto = np.asarray(upto, np.int64), np.asarray(symbols, np.int64), np.asarray(symbols_upto, np.int64)
        #: the opening symbol is 0, the closing one the last
        self.width = len(self.symbols) + 2
        self.kind = _kind_of(self.width)
        self.codes, self.size = self.coded(types if isinstance(types, pa.Array) else pa.array(types, pa.large_string()))

    def __getstate__(self) -> tuple[int, bytes]:
        """Compressed: what is sent lies on the disk of every executor."""
        state = {k: v for k, v in self.__dict__.items() if k not in ("words", "cells", "symbol_cells", "upto")} | {"counts": np.diff(self.upto, prepend=0)}
        blob = pickle.dumps(state | {"size": self.size.astype(_kind_of(int(self.size.max(initial=0))))}, 5)
        return len(blob), pa.compress(blob, "zstd", asbytes=True)

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        self.__dict__ |= pickle.loads(pa.decompress(state[1], state[0], "zstd"))
        self.upto, self.size = np.cumsum(self.__dict__.pop("counts")), self.size.astype(np.int64)

    def coded(self, groups: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The symbols' codes, one group after the other, and the groups' sizes."""
        table = np.zeros(0x110000, self.kind)
        table[self.symbols] = np.arange(1, len(self.symbols) + 1)
        groups = groups.cast(pa.large_string())
        offsets = np.frombuffer(groups.buffers()[1], np.int64)[groups.offset : groups.offset + len(groups) + 1] if len(groups) else np.zeros(1, np.int64)
        data = groups.buffers()[2]
        text = bytes(memoryview(data)[offsets[0] : offsets[-1]]).decode() if data is not None else ""
        return table[np.frombuffer(text.encode("utf-32-le"), "<u4")], pc.utf8_length(groups).to_numpy(zero_copy_only=False).astype(np.int32)

    @cached_property
    def words(self) -> Words:
        return Words.flat(self.codes, self.size).known()

    @staticmethod
    def _cells(upto: np.ndarray) -> tuple[int, np.ndarray]:
        shift = max(0, int(upto[-1]).bit_length() - 20)
        return shift, np.searchsorted(upto, np.arange((int(upto[-1]) >> shift) + 1) << shift, "right").astype(np.int32)

    @cached_property
    def cells(self) -> tuple[int, np.ndarray]:
        return self._cells(self.upto)

    @cached_property
    def symbol_cells(self) -> tuple[int, np.ndarray]:
        return self._cells(self.symbols_upto)

    @staticmethod
    def _find(x: np.ndarray, upto: np.ndarray, cells: tuple[int, np.ndarray]) -> np.ndarray:
        """searchsorted(upto, x, "right"), from the cell that x is in."""
        out = cells[1][x >> cells[0]]
        late = np.flatnonzero(upto[out] <= x)
        for _ in range(6):
            out[late] += 1
            late = late[upto[out[late]] <= x[late]]
        out[late] = np.searchsorted(upto, x[late], "right")
        return out

    def groups(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the groups that are drawn by places in the sorted corpus."""
        return self._find(x, self.upto, self.cells)

    def chars(self, random: np.ndarray) -> np.ndarray:
        return (self._find(_below(random, int(self.symbols_upto[-1])), self.symbols_upto, self.symbol_cells) + 1).astype(self.kind)


def _below(random: np.ndarray, n: int) -> np.ndarray:
    """Even whole numbers under n."""
    return np.minimum(((random >> _U(11)).astype(np.float64) * (2.0**-53 * n)).astype(np.int64), n - 1)


def _whose(doc_ids: pa.Array) -> np.ndarray:
    """A number for each page, by its id alone; null has one too."""
    ids = pc.fill_null(doc_ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return np.where(pc.is_null(doc_ids).to_numpy(zero_copy_only=False), _mix(ids + _U(1)), _mix(ids ^ _GOLD))


def _random(seed: int, family: int, rep: int, stream: int, whose: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 random bits for each of `size` places of each page."""
    salt = seed
    with np.errstate(over="ignore"):
        for part in (family, rep, stream):
            salt = int(_mix(np.array([(salt * 0x9FB21C651E98DF25 + part + 1) & _ALL], np.uint64))[0])
        first = _starts(size)
        return _mix(np.repeat(_mix(whose ^ _U(salt)) - first[:-1].astype(np.uint64) * _GOLD, size) + np.arange(first[-1]).astype(np.uint64) * _GOLD)


def _places(seed: int, family: int, rep: int, whose: np.ndarray, size: np.ndarray, total: int) -> np.ndarray:
    """Of each group of each page, the number (of all groups of the corpus, sorted) that is drawn for it."""
    return _below(_random(seed, family, rep, 9, whose, size), total)


class Chunk:
    """Some pages of one side: their distinct groups, the sequence of these, groups of each page, whose draws they have."""

    def __init__(self, codes: np.ndarray, size: np.ndarray, ids: np.ndarray, per_page: np.ndarray, whose: np.ndarray, held: bool, drawn: dict[int, np.ndarray]):
        self.types, self.ids, self.per_page, self.whose, self.held, self.drawn = Words.flat(codes, size.astype(np.int64)).known(), ids.astype(np.int64), per_page, whose, held, drawn
        #: what is needed of a replicate's groups; only held-out ones are compared
        self.names = ("at", "size", "head", "hash", "letters") if held else ("hash",)

    @cached_property
    def place(self) -> np.ndarray:
        return _places_in(self.per_page)

    def symbols(self) -> np.ndarray:
        """Of the groups as they stand."""
        return self.types.pick(self.ids).symbols()


class Made:
    """A replicate of a chunk: its groups; which of them are of a known list (ids; -1: of none) and of which list; of others,
    the distinct ones with the number of times that each occurs."""

    def __init__(self, words: Words, listed: Words | None = None, ids: np.ndarray | None = None, new: Words | None = None, times: np.ndarray | None = None, fresh: np.ndarray | None = None):
        self.words, self.listed, self.ids, self.new, self.times, self.fresh = words, listed, ids, new, times, fresh


def _mutated(base: Words, change: np.ndarray, drop: np.ndarray, insert: np.ndarray, random: np.ndarray, symbols: int) -> Words:
    """Each group with a symbol replaced, one left out, and one put in, where flagged."""
    with np.errstate(over="ignore"):
        at = [(_mix(random + _U(k) * _GOLD) >> _U(32)).astype(np.int64) for k in range(1, 6)]
    size, far = base.size.astype(np.int64), 1 << 40
    changed, dropped = at[0] * size >> 32, np.where(drop & (size > 1), at[1] * size >> 32, far)
    less = size - (dropped < far)
    put = np.where(insert, at[2] * (less + 1) >> 32, far)
    full = less + insert
    q = _places_in(full)
    e = np.repeat(put, full)
    q -= q > e
    q += q >= np.repeat(dropped, full)
    codes = base.codes[np.repeat(base.at, full) + np.minimum(q, np.repeat(size, full) - 1)]
    first = _starts(full)[:-1]
    where = changed - (changed > dropped)
    where += where >= put
    c = change & (changed != dropped)
    codes[(first + where)[c]] = (1 + (at[3][c] * symbols >> 32)).astype(codes.dtype)
    codes[(first + put)[insert]] = (1 + (at[4][insert] * symbols >> 32)).astype(codes.dtype)
    return Words.flat(codes, full)


def _copied(c: Chunk, known: Words, drawn: np.ndarray, seed: int, f: int, rep: int, symbols: int, window: int) -> Made:
    """Pages of the copying family: each group is one of the last `window` with chance COPY, else the drawn one; then one
    symbol may be replaced, one left out, one put in. Of groups that are copied unchanged, the source is looked up."""
    n = len(c.ids)
    x, y = (_random(seed, f, rep, k, c.whose, c.per_page) for k in (0, 1))
    copy = ((x & _U(0xFFFFFFFF)).astype(np.float64) < COPY * 2.0**32) & (c.place > 0)
    at = np.arange(n)
    back = ((x >> _U(32)) * np.minimum(c.place, window).astype(np.uint64) >> _U(32)).astype(np.int64)
    parent = at - (1 + back) * copy
    change, drop, insert = ((y >> _U(21 * k) & _U(0x1FFFFF)) < _U(round(p * 2**21)) for k, p in enumerate((MUTATION, MUTATION / 3, MUTATION / 3)))
    touched = change | drop | insert
    source = np.where(touched, at, parent)
    late = np.flatnonzero(copy & ~touched)
    while len(late):
        nearer = source[late]
        further = source[nearer]
        source[late] = further
        late = late[further != nearer]
    new = np.flatnonzero(touched)
    number = np.full(n, -1)
    number[new] = np.arange(len(new))
    # a changed group's base is a drawn one, or another changed one: generation by generation
    base = np.where(copy[new], source[parent[new]], new)
    from_new = copy[new] & touched[base]
    depth = np.zeros(len(new), np.int64)
    late = np.flatnonzero(from_new)
    up = number[base[late]]
    ready = ~from_new
    while len(late):  # bases come before
        now = ready[up]
        depth[late[now]] = depth[up[now]] + 1
        ready[late[now]] = True
        late, up = late[~now], up[~now]
    buffers, where, size, offset = [], np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), 0
    order = np.argsort(depth, kind="stable")
    cuts = _starts(np.bincount(depth)) if len(new) else [0]
    last, begins = known, 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        before = last.pick(drawn[base[own]]) if not a else Words(last.codes, where[number[base[own]]] - begins, size[number[base[own]]])
        word = new[own]
        last, begins = _mutated(before, change[word], drop[word], insert[word], _mix(x[word] ^ y[word]), symbols), offset
        where[own], size[own] = last.at + begins, last.size
        buffers.append(last.codes[: len(last.codes) - 8 // last.codes.itemsize])
        offset += len(buffers[-1])
    which = number[source]
    ours = np.flatnonzero(which >= 0)
    which, ids = which[ours], drawn[source].astype(np.int64)
    codes = _padded(np.concatenate([*buffers, np.zeros(0, known.codes.dtype)]))
    fresh = Words(codes, where, size)
    words = known.pick(ids, c.names)
    words.hash[ours] = again = fresh.hash[which]
    if c.held:  # what is compared stands in one buffer
        listed = known.pick(ids, ("at", "size"))
        listed.size[ours] = 0
        words.codes = _padded(np.concatenate([listed.symbols(), codes[: offset]]))
        words.at = _starts(listed.size)[:-1]
        words.at[ours] = where[which] + len(words.codes) - len(codes)
        for k in ("size", "head", "letters"):
            getattr(words, k)[ours] = getattr(fresh, k)[which]
    ids[ours] = -1
    # the changed groups as they stand in the buffer, generation by generation
    return Made(words, known, ids, Words.flat(codes[:offset], size[order]), np.bincount(which, minlength=len(new))[order], again)


def made(c: Chunk, family: str | None, rep: int, v: int, seed: int, draws: Draws, window: int = WINDOW) -> Made:
    """One replicate of a family, of which v is the number (of no family: the pages themselves)."""
    if family is None:
        return Made(c.types.pick(c.ids, c.names), c.types, c.ids)
    f, n = FAMILIES.index(family), len(c.ids)
    if family == "page_shuffle":
        # page, 28 random bits, place in the chunk: a chunk has CHUNK groups at most, or one page
        index = max(1, (n - 1).bit_length())
        key = _random(seed, f, rep, 0, c.whose, c.per_page) >> _U(36) << _U(index) | np.arange(n).astype(np.uint64)
        key |= np.repeat(np.arange(len(c.per_page)).astype(np.uint64) << _U(28 + index), c.per_page)
        ids = c.ids[(np.sort(key) & _U((1 << index) - 1)).astype(np.int64)]
        return Made(c.types.pick(ids, c.names), c.types, ids)
    if family in ("symbol_shuffle", "iid_symbol"):
        size = c.types.size[c.ids]
        per_page = np.add.reduceat(size, _starts(c.per_page)[:-1]).astype(np.int64)
        random = _random(seed, f, rep, 0, c.whose, per_page)
        if family == "iid_symbol":
            words = Words.flat(draws.chars(random), size)
        else:
            codes = c.symbols()
            own = np.repeat(np.arange(n), size)
            if codes.itemsize == 1 and n < 1 << 24:
                codes = (np.sort(own.astype(np.uint64) << _U(40) | random >> _U(32) << _U(8) | codes, kind="stable") & _U(255)).astype(codes.dtype)
            else:
                codes = codes[np.lexsort((random, own))]
            words = Words.flat(codes, size)
        return Made(words, new=words, fresh=words.hash)
    known = c.types if c.drawn else draws.words
    drawn = c.drawn[v] if c.drawn else draws.groups(_places(seed, f, rep, c.whose, c.per_page, int(draws.upto[-1])))
    if family == "global_resample":
        return Made(known.pick(drawn, c.names), known, drawn)
    return _copied(c, known, drawn, seed, f, rep, len(draws.symbols), window)


def _flat_made(g: Made, draws: Draws, c: Chunk) -> Groups:
    return Groups(draws.symbols[g.words.symbols().astype(np.int64) - 1], _starts(g.words.size), np.repeat(np.arange(len(c.per_page)), c.per_page))


def _chunk(groups: pa.Array, per_page: np.ndarray, whose: np.ndarray, held: bool, draws: Draws, drawn: dict[int, pa.Array] | None = None) -> Chunk:
    parts = [groups, *(drawn or {}).values()]
    every = pa.concat_arrays([p.cast(pa.large_string()) for p in parts]).dictionary_encode()
    ids = np.split(every.indices.to_numpy(zero_copy_only=False).astype(np.int32), _starts(np.array([len(p) for p in parts]))[1:-1])
    return Chunk(*draws.coded(every.dictionary), ids[0], per_page, whose, held, dict(zip(drawn or {}, ids[1:], strict=True)))


def variant_of(pages: list[list[str]], ids: list, family: str, rep: int, seed: int, draws: Draws, window: int = WINDOW) -> Groups:
    """One replicate of a family for some pages."""
    c = _chunk(pa.array([g for p in pages for g in p], pa.large_string()), np.array([len(p) for p in pages]), _whose(pa.array(ids, pa.int64())), True, draws)
    return _flat_made(made(c, family, rep, 0, seed, draws, window), draws, c)


def _encode(sent, most: int, looked_up: bool):
    """Chunks of pages: of one side each, of `most` groups at most or of one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws: Draws = sent.value
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("groups")), 0))
            for held in (False, True):
                part = batch.filter(pc.equal(batch.column("held"), held))
                size = pc.list_value_length(part.column("groups")).to_numpy(zero_copy_only=False).astype(np.int64)
                a = 0
                upto = np.cumsum(size)
                while a < len(size):
                    b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
                    own = part.slice(a, b - a)
                    drawn = None
                    if looked_up:
                        maps = [dict(m) for m in own.column("drawn").to_pylist()]
                        drawn = {v: pa.array([g for m in maps for g in m[v]], pa.large_string()) for v in maps[0]}
                    c = _chunk(own.column("groups").flatten(), size[a:b], _whose(own.column("doc_id")), held, draws, drawn)
                    blob = pickle.dumps((c.types.codes[: int(c.types.size.sum())], c.types.size.astype(_kind_of(int(c.types.size.max()))), c.ids.astype(_kind_of(len(c.types.size))), c.per_page, c.whose, c.held, c.drawn), 5)
                    yield pa.RecordBatch.from_arrays([pa.array([len(blob)], pa.int64()), pa.array([pa.compress(blob, "zstd", asbytes=True)], pa.binary())], names=["n", "chunk"])
                    a = b

    return run


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys start."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _summed(single: list[np.ndarray], keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts: of keys that each occur once, and of keys with counts."""
    one = np.concatenate([np.zeros(0, np.uint64), *single])
    one.sort()
    at = _runs(one)
    one, n = one[at], np.diff(np.append(at, len(one)))
    if not keys:
        return one, n
    key = np.concatenate([one, *keys])
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate([n, *counts])[order]
    at = _runs(key)
    return key[at], np.add.reduceat(n, at) if len(at) else n


class Tally:
    """Keys of a replicate, of a task: twice the key, and one more on held-out pages."""

    def __init__(self, draws: Draws):
        self.draws, self.width = draws, draws.width
        self.dense = self.width**3 <= CELLS
        self.cells = np.zeros((2, self.width**3 if self.dense else 0), np.int64)
        self.types = np.zeros((2, 0), np.int64)
        self.single: dict[int, list] = defaultdict(list)
        self.keys: dict[int, list] = defaultdict(list)
        self.counts: dict[int, list] = defaultdict(list)
        self.edges = np.zeros(4, np.int64)

    def _counted(self, kind: int, keys: np.ndarray, counts: np.ndarray, side: int) -> None:
        some = np.flatnonzero(counts)
        self.keys[kind].append(keys[some] << _U(1) | _U(side))
        self.counts[kind].append(np.asarray(counts)[some].astype(np.int64))

    def trigrams(self, w: Words, times: np.ndarray | None, side: int) -> None:
        """w: groups that fill their buffer."""
        n, width = len(w.size), self.width
        if not n:
            return
        first = _starts(w.size)
        codes = w.codes[: first[-1]]
        one, two = np.zeros(len(codes), codes.dtype), np.zeros(len(codes), codes.dtype)
        one[1:], two[2:] = codes[:-1], codes[:-2]
        one[first[:-1]] = 0
        two[first[:-1]] = 0
        two[(first[:-1] + 1)[w.size > 1]] = 0
        end = first[1:] - 1
        closing = (one[end].astype(np.int64) * width + codes[end]) * width + width - 1
        key = two.astype(np.int64)
        for x in (one, codes):
            key *= width
            key += x
        for keys, weights in ((key, None if times is None else np.repeat(times, w.size)), (closing, times)):
            if self.dense:
                self.cells[side] += np.bincount(keys, weights, width**3).astype(np.int64, copy=False)
            elif weights is None:
                self.single[_TRIGRAM].append(keys.astype(np.uint64) << _U(1) | _U(side))
            else:
                self._counted(_TRIGRAM, keys.astype(np.uint64), weights, side)

    def _listed(self, w: Words, times: np.ndarray, side: int) -> None:
        some = np.flatnonzero(times)
        own = w.pick(some)
        self.trigrams(Words.flat(own.symbols(), own.size), times[some], side)
        self._counted(_GROUP, w.hash[some], times[some], side)

    def add(self, c: Chunk, g: Made, window: int, chars: bool) -> None:
        """chars: whether to count characters and groups, too."""
        side, n = int(c.held), len(c.ids)
        first = _starts(c.per_page)
        bos, eos = _mix(np.array([0x110000, 0x110001], np.uint64))
        with np.errstate(over="ignore"):
            h = g.words.hash * _U(0x9FB21C651E98DF25)
            before = np.append(_U(0), h[:-1])
            before[first[:-1]] = bos * _U(0x9FB21C651E98DF25)
            pairs = np.concatenate([_mix(before + g.words.hash), _mix(h[first[1:] - 1] + eos)])
        self.single[_PAIR].append(pairs << _U(1) | _U(side))
        self.edges[side] += len(c.per_page)
        if c.held:
            self.edges[2] += n - len(c.per_page)
            self.edges[3] += int(_near(g.words, c.place, window).sum())
        if not chars:
            return
        if g.listed is not None:
            ids = g.ids if g.new is None else g.ids[g.ids >= 0]
            times = np.bincount(ids, minlength=len(g.listed.size))
            if g.listed is c.types:
                self._listed(g.listed, times, side)
            elif self.types.shape[1]:
                self.types[side] += times
            else:
                self.types = np.stack([times * (side == s) for s in (0, 1)])
        if g.new is not None:
            self.trigrams(g.new, g.times, side)
            self.single[_GROUP].append(g.fresh << _U(1) | _U(side))

    def done(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """kind, sorted keys, counts."""
        for side in (0, 1):
            if self.types.shape[1]:
                self._listed(self.draws.words, self.types[side], side)
        if self.dense:
            for side in (0, 1):
                some = np.flatnonzero(self.cells[side])
                self._counted(_TRIGRAM, some.astype(np.uint64), self.cells[side][some], side)
        for kind in (_TRIGRAM, _GROUP, _PAIR):
            keys, counts = _summed(self.single.pop(kind, []), self.keys.pop(kind, []), self.counts.pop(kind, []))
            yield kind, keys, counts
            if kind == _TRIGRAM:
                last = ((keys >> _U(1)) % _U(self.width)) << _U(1) | keys & _U(1)
                yield _CHAR, *_summed([], [last], [counts])
        yield _COPIES, np.arange(4).astype(np.uint64), self.edges


_TALLY = "bucket int, variant int, kind int, single binary, keys binary, counts binary"
_SUMS = "variant int, kind int, types long, train long, test long, trained binary, times binary"


def _bucket(kind: int, keys: np.ndarray, width: int, buckets: int) -> np.ndarray:
    """The range of a key; trigrams go with their context."""
    if kind in (_CHAR, _COPIES):
        return np.zeros(len(keys), np.int64)
    x = _mix((keys >> _U(1)) // _U(width)) if kind == _TRIGRAM else keys
    return ((x >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _measure(sent, variants: list[int], seed: int, replicates: int, window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws: Draws = sent.value
        chunks = [x for batch in batches for x in zip(batch.column("n").to_pylist(), batch.column("chunk").to_pylist(), strict=True)]
        for v in variants if chunks else ():
            family, rep = (FAMILIES[(v - 1) // replicates], (v - 1) % replicates) if v else (None, 0)
            tally = Tally(draws)
            for size, blob in chunks:
                c = Chunk(*pickle.loads(pa.decompress(blob, size, "zstd")))
                tally.add(c, made(c, family, rep, v, seed, draws, window), window, family != "page_shuffle")
            rows = []
            for kind, keys, counts in tally.done():
                place = _bucket(kind, keys, draws.width, buckets)
                if kind == _TRIGRAM:
                    order = np.argsort(place, kind="stable")
                    place, keys, counts = place[order], keys[order], counts[order]
                cuts = np.searchsorted(place, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    k, n = keys[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]].astype(np.int64)
                    once = n == 1
                    rows.append((int(b), v, kind, _packed(k[once]), _packed(k[~once]), n[~once].tobytes()))
                del place, keys, counts
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32()] * 3 + [pa.binary()] * 3, strict=True)], names=["bucket", "variant", "kind", "single", "keys", "counts"])

    return run


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys: the bytes of each difference, the first key, the differences in as many bytes."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = -(-int(steps.max(initial=0)).bit_length() // 8)
    return bytes([width]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width, rest = blob[0], np.frombuffer(blob, np.uint8, offset=9)
    steps = np.zeros((1 + (len(rest) // width if width else 0), 8), np.uint8)
    steps[0] = np.frombuffer(blob, np.uint8, 8, 1)
    steps[1:, :width] = rest.reshape(-1, width) if width else 0
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _sides(keys: np.ndarray, counts: np.ndarray) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Of sorted keys with their sides: how many are in training, their count there and on held-out pages; of held-out ones,
    the training counts, and how many have each."""
    held = (keys & _U(1)) == 1
    test = np.flatnonzero(held)
    before = np.maximum(test - 1, 0)
    trained = np.where((test > 0) & (keys[before] == (keys[test] ^ _U(1))), counts[before], 0)
    values, which = np.unique(trained, return_inverse=True)
    times = np.zeros(len(values), np.int64)
    np.add.at(times, which, counts[test])
    return int((~held).sum()), int(counts[~held].sum()), int(counts[held].sum()), values.astype(np.int64), times


def _gather(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int], list] = defaultdict(list)
        for batch in batches:
            for v, kind, *parts in zip(*(batch.column(k).to_pylist() for k in ("variant", "kind", "single", "keys", "counts")), strict=True):
                got[v, kind].append(parts)
        rows = []
        for v, kind in sorted(got):
            single, several, counts = zip(*got.pop((v, kind)), strict=True)
            keys, counts = _summed([*map(_unpacked, single)], [*map(_unpacked, several)], [np.frombuffer(n, np.int64) for n in counts])
            if kind == _COPIES:
                rows.append((v, kind, 0, 0, 0, keys.astype(np.int64), counts))
                continue
            if kind == _CHAR:  # the closing symbol is no type
                types = int(((keys & _U(1) == 0) & (keys >> _U(1) != width - 1)).sum())
                rows.append((v, kind, types, *_sides(keys, counts)[1:]))
                continue
            rows.append((v, kind, *_sides(keys, counts)))
            if kind == _TRIGRAM:
                context = ((keys >> _U(1)) // _U(width)) << _U(1) | keys & _U(1)
                rows.append((v, _CONTEXT, *_sides(*_summed([], [context], [counts]))))
        if rows:
            columns = [*zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns[:5], [pa.int32()] * 2 + [pa.int64()] * 3, strict=True)), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in columns[5:])], names=[c.split()[0] for c in _SUMS.split(", ")])

    return run


def pages_of(documents: DataFrame, fraction: float = HELD_OUT, seed: int = 0) -> DataFrame:
    """doc_id, groups, held: words (white space between them, in small letters) of all documents that have one. Of each
    stratum (lang, source) about `fraction` of the documents are held out, by a hash of the id: at least one, and not all,
    of two or more; the one document of a stratum is not held out."""
    blanks = " \t\r\n"
    groups = F.split(F.btrim(F.lower("text"), F.lit(blanks)), f"[{blanks}]+")
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = documents.select("doc_id", "lang", "source", "text", order.alias("o")).where(F.col("text").rlike(f"[^{blanks}]"))
    strata = rows.groupBy("lang", "source").agg(F.min("o").alias("least"), F.max("o").alias("most"))
    # as a rule there are few strata, and the texts stay where they are
    few = len(strata.limit(SENT_STRATA + 1).select("least").collect()) <= SENT_STRATA
    rows = rows.join(F.broadcast(strata) if few else strata, rows["lang"].eqNullSafe(strata["lang"]) & rows["source"].eqNullSafe(strata["source"]))
    chosen = (F.pmod(F.shiftright("o", 11), F.lit(1_000_000)) < int(fraction * 1_000_000)) | (F.col("o") == F.col("least"))
    return rows.select("doc_id", groups.alias("groups"), (chosen & (F.col("o") != F.col("most"))).alias("held"))


def _looked_up(pages: DataFrame, types: DataFrame, total: int, seed: int, replicates: int) -> DataFrame:
    """pages with drawn: of each variant that draws groups, the drawn ones. Draws meet the types by ranges of numbers that are
    cut at multiples of STEP."""
    step = 64
    numbered = types.repartitionByRange("g").sortWithinPartitions("g").withColumn("p", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    before, offsets = 0, []
    for r in sorted(numbered.groupBy("p").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["p"]):
        offsets.append((r["p"], before))
        before += r["n"]
    from pyspark.sql.window import Window

    own = Window.partitionBy("p").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    spark = pages.sparkSession
    spans = numbered.withColumn("upto", F.sum("n").over(own)).join(F.broadcast(spark.createDataFrame(offsets, "p int, before long")), "p").select("g", (F.col("upto") + F.col("before")).alias("hi"), "n")
    spans = spans.select("g", (F.col("hi") - F.col("n")).alias("lo"), "hi").select("g", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))).alias("cell"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, n, who in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), _whose(batch.column("doc_id")), strict=True):
                for family in _DRAWING:
                    f = FAMILIES.index(family)
                    for r in range(replicates):
                        x = _places(seed, f, r, np.array([who]), np.array([n]), total)
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d] * n, pa.int64()), "variant": pa.array([1 + f * replicates + r] * n, pa.int32()), "i": pa.array(np.arange(n), pa.int32()), "x": pa.array(x)})

    asked = mapped(pages.select("doc_id", F.size("groups").alias("n")), places, "doc_id long, variant int, i int, x long").withColumn("cell", F.floor(F.col("x") / step))
    got = asked.join(spans, "cell").where("x >= lo and x < hi")
    lists = got.groupBy("doc_id", "variant").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "g"))), lambda s: s["g"]).alias("g"))
    return pages.join(lists.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("variant", "g"))).alias("drawn")), "doc_id")


#: Shuffle files of an execution go when it has ended (a setting of Spark's).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def measured(pages: DataFrame, replicates: int, seed: int = 1, window: int = WINDOW, sent_types: int = SENT_TYPES) -> list[dict[str, float]]:
    """The metrics of the observed corpus (first) and of every replicate, by family. pages: doc_id (unique), groups, held."""
    spark = pages.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    kept: list[DataFrame] = []
    try:
        return _measured(spark, pages.select("doc_id", "groups", "held"), replicates, seed, window, sent_types, kept)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
        for df in kept:
            df.unpersist()


def _measured(spark: SparkSession, pages: DataFrame, replicates: int, seed: int, window: int, sent_types: int, kept: list[DataFrame]) -> list[dict[str, float]]:
    cores = spark.sparkContext.defaultParallelism
    if pages.rdd.getNumPartitions() < cores:
        pages = pages.repartition(cores, "doc_id")
    types = pages.select(F.explode("groups").alias("g")).groupBy("g").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
    kept.append(types)
    n_types, total = types.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return []
    symbols = types.select("n", F.explode(F.split("g", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))
    symbols = sorted((ord(r["c"]), r["n"]) for r in symbols.collect())  # as many as there are characters at most
    few = n_types <= sent_types
    own = types.toArrow() if few else pa.table({"g": [""], "n": [0]})
    own = own.take(pc.sort_indices(own.column("g").cast(pa.large_string()))).combine_chunks()  # by code point
    one = lambda x: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    draws = Draws(one(own.column("g")), np.cumsum(one(own.column("n")).to_numpy()), np.array([c for c, _ in symbols], np.int64), np.cumsum([n for _, n in symbols]))
    sent = spark.sparkContext.broadcast(draws)
    tasks = max(2 * cores, -(-total // TASK))
    most = min(CHUNK, max(CHUNK >> 4, total // (4 * tasks)))
    rows = pages if few else _looked_up(pages, types, total, seed, replicates)
    # replicates cost far more than the chunks' way to all cores
    chunks = mapped(rows, _encode(sent, most, not few), "n long, chunk binary").repartition(tasks).persist(StorageLevel.DISK_ONLY)
    kept.append(chunks)
    chunks.count()
    if few:
        types.unpersist()
    variants = [*range(1 + replicates * len(FAMILIES))]
    each = max(1, ROUND // total)
    stats: dict[tuple[int, int], list] = {}
    spark.conf.set(_CLEANUP, "true")
    for a in range(0, len(variants), each):
        own_variants = variants[a : a + each]
        words = len(own_variants) * total
        buckets = max(min(2 * cores, -(-words // (1 << 14))), -(-2 * words // RANGE))
        keys = mapped(chunks, _measure(sent, own_variants, seed, replicates, window, buckets), _TALLY).repartitionById(buckets, F.col("bucket"))
        for r in mapped(keys, _gather(draws.width), _SUMS).collect():
            stats.setdefault((r["variant"], r["kind"]), []).append((r["types"], r["train"], r["test"], np.frombuffer(r["trained"], np.int64), np.frombuffer(r["times"], np.int64)))
    sent.unpersist()
    for v in variants[1 : 1 + replicates]:  # within pages, groups are moved as they are
        for kind in (_CHAR, _TRIGRAM, _CONTEXT, _GROUP):
            if (0, kind) in stats:
                stats[v, kind] = stats[0, kind]
    return [_metrics(v, stats) for v in variants]


def _metrics(v: int, stats: dict[tuple[int, int], list]) -> dict[str, float]:
    def bits(units: float, contexts: float, n: int) -> float:
        return (contexts - units) / n if n else 0.0

    def logs(kind: int, smoothing: float) -> float:
        """Sum of the logarithms of the training counts of held-out n-grams."""
        return math.fsum(float((n * np.log2(t + smoothing)).sum()) for *_, t, n in stats.get((v, kind), ()))

    def size(kind: int) -> tuple[int, int, int]:
        return tuple(sum(r[i] for r in stats.get((v, kind), ())) for i in range(3))

    types, trained, n = size(_CHAR)
    width = (types + 2) * ALPHA
    char_0 = bits(logs(_CHAR, ALPHA), n * math.log2(trained + width), n)
    char_2 = bits(logs(_TRIGRAM, ALPHA), logs(_CONTEXT, width), n)
    edges = dict(zip(stats[v, _COPIES][0][3].tolist(), stats[v, _COPIES][0][4].tolist(), strict=True))
    pages_in, pages_out, compared, copies = (edges[k] for k in range(4))
    types, trained, n = size(_GROUP)
    width, n, trained = (types + 2) * ALPHA, n + pages_out, trained + pages_in
    group_0 = bits(logs(_GROUP, ALPHA) + pages_out * math.log2(pages_in + ALPHA), n * math.log2(trained + width), n)
    group_1 = bits(logs(_PAIR, ALPHA), logs(_GROUP, width) + pages_out * math.log2(pages_in + width), n)
    return {"char_trigram_gain": char_0 - char_2, "group_bigram_gain": group_0 - group_1, "local_copy_rate": copies / compared if compared else 0.0}


def study(spark: SparkSession, sf_dir: str, replicates: int = 6, seed: int = 1) -> DataFrame:
    """family, metric, observed, null_mean, null_sd, p (share of replicates that reach the observed value, one more counted
    on both sides), p_holm (over all families and metrics). No row for a corpus without words."""
    kind = "family string, metric string, observed double, null_mean double, null_sd double, p double"
    got = measured(pages_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), replicates, seed)
    rows = []
    for f, family in enumerate(FAMILIES):
        own = got[1 + f * replicates : 1 + (f + 1) * replicates]
        for m in METRICS if got else ():
            x = np.array([r[m] for r in own])
            rows.append((family, m, got[0][m], float(x.mean()), float(x.std(ddof=1)) if len(x) > 1 else 0.0, (1 + int((x >= got[0][m]).sum())) / (1 + len(x))))
    return holm(spark.createDataFrame(rows, kind), "p", ["family", "metric"])
