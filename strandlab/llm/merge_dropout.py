"""Encoding with the merges of a SentencePiece model, some of them skipped by a keyed hash, and lossless decoding.

An agenda holds the adjacent pairs whose concatenation is a piece, best score first, then leftmost. Each pair that comes
up is skipped, for good, with the dropout rate as its chance; else it is merged and its new neighbours join the agenda.
What is left are pieces, or bytes of characters that the model lacks. Merges never cross the start of a chunk (up to the
next blank).

Every occurrence of a chunk draws anew: its key is a hash of (seed, doc_id, number of the chunk in the text), and hashes
of the key give, by the inverse geometric law, how many pairs come up before the next that is skipped. Many chunks are
merged at once in numpy grids, one agenda step of all of them at a time. What a chunk becomes without skipped pairs is worked
out once in a slice of text; an occurrence with skipped pairs always by itself.

The character U+2581, which stands for the blank within pieces, is encoded by its bytes where a text has it; so decoding
gives every text back."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.common import mapped, per_row

MARK = "▁"
#: Characters that are encoded together, rounded up to whole texts.
SLICE_CHARS = 1 << 18
#: Chunks of so many characters at most are merged in one grid; longer ones than the last by themselves.
WIDTHS, GRID_ROWS = (6, 9, 12, 16, 24, 40), 10_000


#: Chunks of so many characters at most have a list as their agenda, others a heap; both give the same pieces.
SHORT = 40


_MASK, _STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _mix(x):
    """The finaliser of splitmix64, of a number or an array of uint64."""
    if isinstance(x, int):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
        return x ^ x >> 31
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(8)
def _gaps(below: int) -> list[int]:
    """Ascending; a uniform number of 32 bits has as many pairs before the next skipped one as there are entries over it."""
    kept, cut = 1 - below / 2**32, []
    share = kept
    while share * 2**32 >= 1:
        cut.append(int(share * 2**32))
        share *= kept
    return cut[::-1]


def _gap(key: int, k: int, cuts: list[int]) -> int:
    """Pairs before the next skipped one, after k skipped ones."""
    return len(cuts) - bisect_right(cuts, (_mix((key + k * _STEP) & _MASK) if k else key) >> 32)


class Model:
    """Pieces and scores of a SentencePiece BPE model with byte fallback and a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids, self.score, self.bytes_of, self.byte_id = {}, {}, [b""] * n, [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on over a blank: chunks would not be independent")
        self.kind, self.code = (np.dtype("<u2"), "H") if n <= 1 << 16 else (np.dtype("<u4"), "I")
        sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.sizes, self.places = sizes, np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def segment(self, chunk: str, key: int, below: int) -> list[int]:
        """Ids of one chunk (blanks as such). key: of the occurrence (64 bits); below: share of skipped pairs, times 2**32."""
        return self.drawn(chunk, key, below)[0]

    def drawn(self, chunk: str, key: int, below: int) -> tuple[list[int], int, tuple[int, ...]]:
        """Ids as in segment(), how many pairs came up, and the numbers of the skipped ones among them."""
        cuts = _gaps(below) if below else []
        skip, came, skips = _gap(key, 0, cuts) if below else -1, 0, []
        own = [MARK if c == " " else c for c in chunk]
        n = len(own)
        if n <= SHORT and MARK not in chunk:
            score, none = self.score.get, -math.inf
            piece, agenda = own, [score(a + b, none) for a, b in zip(own, own[1:], strict=False)]
            while agenda:
                best = max(agenda)
                if best == none:
                    break
                i = agenda.index(best)
                came += 1
                if came - 1 == skip:
                    skips.append(skip)
                    skip = came + _gap(key, len(skips), cuts)
                    agenda[i] = none
                    continue
                both = piece[i] = piece[i] + piece[i + 1]
                del piece[i + 1], agenda[i]
                if i < len(agenda):
                    agenda[i] = score(both + piece[i + 1], none)
                if i:
                    agenda[i - 1] = score(piece[i - 1] + both, none)
            out = []
            for p in piece:
                got = self.ids.get(p)
                if got is not None:
                    out.append(got)
                else:
                    out += [self.byte_id[b] for b in p.encode()]
            return out, came, tuple(skips)
        literal = {i for i, c in enumerate(chunk) if c == MARK} if MARK in chunk else ()
        score, piece = self.score, own[:]
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            both = own[i] + own[i + 1]
            if both in score and not (i in literal or i + 1 in literal):
                agenda.append((-score[both], i, both))
        heapify(agenda)
        while agenda:
            _, i, both = heappop(agenda)
            j = after[i]
            if piece[i] is None or j >= n or piece[i] + piece[j] != both or i in literal or j in literal:
                continue
            came += 1
            if came - 1 == skip:
                skips.append(skip)
                skip = came + _gap(key, len(skips), cuts)
                continue
            piece[i], piece[j] = both, None
            k = after[i] = after[j]
            if k < n:
                ahead[k] = i
                more = both + piece[k]
                if more in score and k not in literal:
                    heappush(agenda, (-score[more], i, more))
            h = ahead[i]
            if h >= 0:
                more = piece[h] + both
                if more in score and h not in literal:
                    heappush(agenda, (-score[more], h, more))
        out: list[int] = []
        for i, p in enumerate(piece):
            if p is None:
                continue
            got = None if i in literal else self.ids.get(p)
            if got is not None:
                out.append(got)
            else:
                out += [self.byte_id[b] for b in p.encode()]
        return out, came, tuple(skips)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text; the dummy prefix goes."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.places[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.flat[at].tobytes()[1:]


_NONE = np.iinfo(np.int32).max


class Pairs:
    """The pairs of symbols whose concatenation is a piece: their order (best score first) and the piece, by hashing of the
    two ids. A symbol is a piece's id, or -1 for a character that the model lacks."""

    def __init__(self, model: Model):
        rows = [(model.ids[p[:i]], model.ids[p[i:]], -model.score[p], model.ids[p]) for p in model.ids for i in range(1, len(p)) if p[:i] in model.ids and p[i:] in model.ids]
        left, right, cost, piece = (np.array(c) for c in zip(*rows, strict=True))
        _, order = np.unique(cost, return_inverse=True)
        keys = (left.astype(np.int64) << 32) | right
        self.bits = max(8, int(len(keys) * 8).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.order = np.full(len(self.keys), _NONE, np.int32)
        self.piece = np.zeros(len(self.keys), np.int32)
        for k, at, o, x in zip(keys.tolist(), self._at(keys).tolist(), order.tolist(), piece.tolist(), strict=True):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.order[at], self.piece[at] = k, o, x
        #: Ids of single characters; a blank is the piece that stands for it, and that piece's own character is lacking.
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in model.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[32], self.char[ord(MARK)] = model.ids.get(MARK, -1), -1

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order (_NONE: no such pair) and piece."""
        keys = (left.astype(np.int64) << 32) | right
        ok = (left >= 0) & (right >= 0)
        at = self._at(np.where(ok, keys, 0))
        own = self.keys[at]
        todo = np.flatnonzero(ok & (own != keys) & (own >= 0))
        while len(todo):
            at[todo] += 1
            own[todo] = self.keys[at[todo]]
            todo = todo[(own[todo] != keys[todo]) & (own[todo] >= 0)]
        ok &= own == keys
        return np.where(ok, self.order[at], _NONE), self.piece[at]

    def merged(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None, ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agenda processing of many chunks at once. symbols: a row for each, sizes: how many of the row count. keys: of the
        occurrences, where pairs are to be skipped. Of each row: which of its places still hold a symbol (that place's
        symbol, changed in place, is the merged one), and how many pairs came up."""
        n, width = symbols.shape
        alive = np.arange(width) < sizes[:, None]
        came = np.zeros(n, np.int32)
        after = np.minimum(np.arange(1, width + 1), sizes[:, None]).astype(np.int32)
        after[after >= sizes[:, None]] = width
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
        order = np.full((n, width), _NONE, np.int32)
        piece = np.zeros((n, width), np.int32)
        for j in range(width - 1):
            o, p = self.find(symbols[:, j], np.where(alive[:, j + 1], symbols[:, j + 1], -1))
            order[:, j], piece[:, j] = o, p
        rows = np.arange(n)
        count = np.zeros(n, np.int64)
        skip = _gaps_of(keys, ascending) if keys is not None else None
        t = 0
        while len(rows):
            best = order[rows].argmin(1) if len(rows) < n else order.argmin(1)
            live = order[rows, best] < _NONE
            came[rows[~live]] = t
            rows, best = rows[live], best[live]
            if not len(rows):
                break
            r, j = rows, best
            if skip is not None:
                hit = skip[rows] == t
                if hit.any():
                    own = rows[hit]
                    order[own, best[hit]] = _NONE
                    count[own] += 1
                    with np.errstate(over="ignore"):
                        skip[own] = t + 1 + _gaps_of(_mix(keys[own] + count[own].astype(np.uint64) * np.uint64(_STEP)), ascending)
                    r, j = rows[~hit], best[~hit]
            k = after[r, j]
            symbols[r, j] = piece[r, j]
            alive[r, k] = False
            order[r, k] = _NONE
            nxt = after[r, k]
            after[r, j] = nxt
            inside = nxt < width
            before[r[inside], nxt[inside]] = j[inside]
            order[r, j], piece[r, j] = self.find(symbols[r, j], np.where(inside, symbols[r, np.minimum(nxt, width - 1)], -1))
            h = before[r, j]
            ok = h >= 0
            r, j, h = r[ok], j[ok], h[ok]
            order[r, h], piece[r, h] = self.find(symbols[r, h], symbols[r, j])
            t += 1
        return alive, came


def _gaps_of(keys: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Of each key (a hash), the pairs before the next skipped one, as _gap()."""
    return len(ascending) - np.searchsorted(ascending, keys >> np.uint64(32), "right")


class Encoder:
    """Ids of texts, many chunks at a time: the distinct ones of a slice without skipped pairs, and each occurrence of which
    some pair is skipped by itself. Nothing is remembered between slices."""

    def __init__(self, path: str, dropout: float, seed: int):
        self.model = Model(path)
        self.pairs = Pairs(self.model)
        self.below, self.seed = int(dropout * 2**32), seed
        self.ascending = np.array(_gaps(self.below) if self.below else [], np.uint64)

    def encode(self, doc_id: int | None, text: str) -> np.ndarray:
        return self.encode_many([doc_id], [text])[0]

    def encode_many(self, doc_ids: list, texts: list[str]) -> list[np.ndarray]:
        out, a = [], 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= SLICE_CHARS):
                size += len(texts[b])
                b += 1
            out += self._slice(doc_ids[a:b], texts[a:b])
            a = b
        return out

    def _slice(self, doc_ids: list, texts: list[str]) -> list[np.ndarray]:
        some = [i for i, t in enumerate(texts) if t]
        out = [np.zeros(0, self.model.kind)] * len(texts)
        if not some:
            return out
        own = [" " + texts[i] for i in some]
        cp = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4")
        doc_start = np.cumsum([0, *map(len, own)])
        blank = cp == 32
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens[doc_start[:-1]] = True
        start = np.flatnonzero(opens)
        first = np.searchsorted(start, doc_start)
        length = np.diff(np.append(start, len(cp)))
        doc = np.repeat(np.arange(len(some)), np.diff(first))
        number = np.arange(len(start)) - first[doc] + 1
        base = np.array([int.from_bytes(blake2b(f"{self.seed}:{doc_ids[i]}".encode(), digest_size=8).digest()) for i in some], np.uint64)
        with np.errstate(over="ignore"):
            keys = _mix(base[doc] + number.astype(np.uint64) * np.uint64(_STEP))
            # two sums of the characters by their places tell chunks apart (128 bits)
            at = np.arange(len(cp)) - np.repeat(start, length)
            x = cp.astype(np.uint64) + np.uint64(1)
            one, two = (np.add.reduceat(_mix(x * np.uint64(m) + at.astype(np.uint64) * np.uint64(k)), start) for m, k in ((0x9FB21C651E98DF25, 0xD6E8FEB86659FD93), (0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F)))
        pair = np.empty(len(start), [("a", np.uint64), ("b", np.uint64)])
        pair["a"], pair["b"] = one, two
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        heads = order[new]
        parts = _Parts(self, cp, start, length)
        came = parts.add(heads, None)
        result = which.copy()  # of each chunk, the entry with its ids
        if self.below:
            skipped = np.flatnonzero(_gaps_of(keys, self.ascending) < came[which])
            result[skipped] = len(heads) + np.arange(len(skipped))
            parts.add(skipped, keys[skipped])
        flat, begin, sizes = parts.joined()
        own_sizes = sizes[result]
        ends = np.cumsum(own_sizes)
        ids = flat[np.repeat(begin[result] - (ends - own_sizes), own_sizes) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.append(0, ends)[first]
        for k, i in enumerate(some):
            out[i] = ids[cuts[k] : cuts[k + 1]]
        return out


class _Parts:
    """Ids of chunks, entry after entry."""

    def __init__(self, encoder: Encoder, cp: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.encoder, self.cp, self.start, self.length = encoder, cp, start, length
        self.flat: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, chunks: np.ndarray, keys: np.ndarray | None) -> np.ndarray:
        """An entry for each of the chunks (numbers). Gives how many pairs came up."""
        own, pairs = self.encoder, self.encoder.pairs
        came = np.zeros(len(chunks), np.int64)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # entries, their sizes, their ids
        size, low = self.length[chunks], 0
        for width in WIDTHS:
            mine = np.flatnonzero((size > low) & (size <= width))
            low = width
            for a in range(0, len(mine), GRID_ROWS):
                at = mine[a : a + GRID_ROWS]
                grid = np.minimum(self.start[chunks[at]][:, None] + np.arange(width), len(self.cp) - 1)
                raw = self.cp[grid]
                symbols = pairs.char[raw]
                alive, n = pairs.merged(symbols, size[at], None if keys is None else keys[at], own.ascending)
                came[at] = n
                ids, counts = self._spelled(symbols, raw, alive)
                got.append((at, counts, ids))
        for at in np.flatnonzero(size > low).tolist():
            a = self.start[chunks[at]]
            text = self.cp[a : a + size[at]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            ids, n, _ = own.model.drawn(text, 0 if keys is None else int(keys[at]), 0 if keys is None else own.below)
            came[at] = n
            got.append((np.array([at]), np.array([len(ids)]), np.array(ids, own.model.kind)))
        if got:
            entries, sizes = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            flat = np.concatenate([g[2] for g in got]).astype(own.model.kind)
            begin = np.cumsum(sizes) - sizes
            back = np.argsort(entries)
            wanted = sizes[back]
            ends = np.cumsum(wanted)
            self.flat.append(flat[np.repeat(begin[back] - (ends - wanted), wanted) + np.arange(ends[-1])])
            self.sizes.append(wanted)
        return came

    def _spelled(self, symbols: np.ndarray, raw: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols that are left, row after row, and their number in each row; characters as bytes where the model
        lacks them."""
        ids, counts = symbols[alive], alive.sum(1)
        lacking = np.flatnonzero(ids < 0)
        if not len(lacking):
            return ids, counts
        model = self.encoder.model
        bytes_of = [[model.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in raw[alive][lacking].tolist()]
        more = np.ones(len(ids), np.int64)
        more[lacking] = [len(b) for b in bytes_of]
        row = np.repeat(np.arange(len(counts)), counts)
        out = np.repeat(ids, more)
        ends = np.cumsum(more)
        for k, b in zip(lacking.tolist(), bytes_of, strict=True):
            out[ends[k] - len(b) : ends[k]] = b
        return out, np.bincount(row, more, len(counts)).astype(np.int64)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, sizes = np.concatenate(self.flat), np.concatenate(self.sizes)
        return flat, np.cumsum(sizes) - sizes, sizes


@lru_cache(2)
def encoder_of(path: str, dropout: float, seed: int) -> Encoder:
    """A worker keeps its encoder for its later tasks."""
    return Encoder(path, dropout, seed)


def _run(path: str, dropout: float, seed: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or encoder_of(path, dropout, seed)
            docs, column = batch.column("doc_id"), batch.column("text")
            for a in range(0, batch.num_rows, 500):
                own = docs.slice(a, 500)
                rows: dict[str, list] = {"n_pieces": [], "ids_crc32": [], "n_bytes": [], "decoded_crc32": [], "lossless": []}
                all_ids = []
                texts = [t or "" for t in column.slice(a, 500).to_pylist()]
                for text, ids in zip(texts, encoder.encode_many(own.to_pylist(), texts), strict=True):
                    raw, back = text.encode(), encoder.model.decode(ids)
                    rows["n_pieces"].append(len(ids))
                    rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    rows["n_bytes"].append(len(raw))
                    rows["decoded_crc32"].append(zlib.crc32(back))
                    rows["lossless"].append(raw == back)
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                columns = [own, *(pa.array(rows[k], pa.bool_() if k == "lossless" else pa.int64()) for k in rows)]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *rows, *["ids"] * with_ids])

    return run


def encode_decode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 17, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as unsigned 32-bit numbers), n_bytes (UTF-8), decoded_crc32, lossless, and with
    with_ids the ids themselves. One pass over the texts without a shuffle.

    With dropout 0 the ids are the model's own (but for texts with U+2581). Null and empty texts have no ids and decode to
    the empty text. Rows with a null or repeated doc_id are encoded like others, by their doc_id (null as a key of its
    own); an empty table gives an empty result; other columns are not looked at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, decoded_crc32 long, lossless boolean" + ", ids array<int>" * with_ids
    return mapped(rows, _run(model, dropout, seed, with_ids), kind)
