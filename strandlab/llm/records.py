"""Token ids in files of length-delimited binary records.

A shard has two files. Records: for each document an 8-byte length, a 4-byte masked CRC-32 of these 8 bytes, the payload,
and a 4-byte masked CRC-32 of the payload; all numbers little-endian. Payload: doc_id (8 bytes, signed), bytes per id (1
byte: 2 where every id of the vocabulary fits, else 4), then the ids. Offsets: for each record its place and length in the
records file (8 bytes each), so that a reader can take records in any order. Shards follow each other in ascending
doc_id order.

A task writes files under names that no other attempt uses and reports them; the table of reported shards, written
once the tasks have ended, names the files that count. A repeated or lost task so leaves nothing but an unread file."""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.common import mapped, new_folder, per_row, stage

#: Bytes of chunks, and of what they become, that a worker remembers. When there are so many, they become the
#: old ones, of which those that come up again are kept: twice as many bytes are held at most.
CACHED_BYTES = 80 << 20
#: Bytes of one remembered entry besides its text and its ids; longer chunks than LONGEST are not remembered.
_ENTRY, LONGEST = 220, 200
#: Texts that are encoded together.
ROWS = 4_000
END_ID = 0
#: What sets a text apart: blanks next to other white space, or white space beyond ASCII.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII, _OTHER = ("".join(c for c in _SPACES if c.isascii() is plain) for plain in (True, False))
_APART = rf"\A\x20|\x20\z|<\||\x20[{_ASCII}]|[{_ASCII}]\x20|[{_OTHER}]"
_MASK = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    """CRC-32, rotated by 15 bits plus a constant, so that a checksum of data that holds checksums stays a good one."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


class Encoder:
    """Ids of whole texts. A single blank between two characters that aren't white space always starts a new piece of the
    pre-tokenizer, so what lies between such blanks is encoded by itself and remembered; texts with other blanks or with
    what may be a special token are encoded in one go. Chunks are told apart in Arrow: Python sees each one once in a batch,
    and the tokenizer those that are new."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        n = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        #: Ids of chunks with the blank before them.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        blank = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]  # how the vocabulary writes a blank
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(blank) for i in range(n)])

    def _raw(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of new chunks, each with the blank before it. One after another they are split again as they are, so a
        thousand of them are encoded as one text and told apart by the blank that only a chunk's first id has."""
        out, width = [], self.kind.itemsize
        blocks = [chunks[a : a + 1000] for a in range(0, len(chunks), 1000)]
        for block, raw in zip(blocks, self._raw(["".join(b) for b in blocks]), strict=True):
            cuts = np.append(np.flatnonzero(self.opens[np.frombuffer(raw, self.kind)]) * width, len(raw))
            if len(cuts) != len(block) + 1:
                out += self._raw(block)
                continue
            at = cuts.tolist()
            out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def _remember(self, chunks: list[str], ids: list[bytes]) -> None:
        own = {p: x for p, x in zip(chunks, ids, strict=True) if len(p) <= LONGEST}
        self.known.update(own)
        self.held += _ENTRY * len(own) + sum(map(len, own)) + sum(map(len, own.values()))

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, each with the blank before it."""
        if self.held > CACHED_BYTES:
            self.known, self.old, self.held = {}, self.known, 0
        got = list(map(self.known.get, chunks))
        for find, old in ((lambda x: list(map(self.old.get, x)), True), (self._learn, False)):
            rest = [i for i, ids in enumerate(got) if ids is None]
            if not rest or (old and not self.old):
                continue
            names = [chunks[i] for i in rest]
            ids = find(names)
            for i, x in zip(rest, ids, strict=True):
                got[i] = x
            if old:
                names, ids = [p for p, x in zip(names, ids, strict=True) if x is not None], [x for x in ids if x is not None]
            self._remember(names, ids)
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, _APART).to_numpy(zero_copy_only=False)
        apart, plain = np.flatnonzero(odd).tolist(), np.flatnonzero(~odd).tolist()
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(apart, self._raw([texts[i] for i in apart]), strict=True):
            out[i] = ids
        if not plain:
            return out
        lists = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        first = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = self._raw([texts[i].split(" ", 1)[0] for i in plain])  # a text's first chunk has no blank before it
        rest = np.ones(len(at), bool)
        rest[first[:-1]] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[at[rest]] = True
        number = np.cumsum(used) - 1
        at[rest] = number[at[rest]]
        at[first[:-1]] = int(used.sum()) + np.arange(len(plain))
        none, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        chunks = pc.binary_join_element_wise(none, coded.dictionary.filter(pa.array(used)), blank)
        ids = self._known(chunks.to_pylist()) + heads
        width = self.kind.itemsize
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        places = np.cumsum(sizes) - sizes
        own = sizes[at]
        ends = np.cumsum(own)
        flat = np.frombuffer(b"".join(ids), self.kind)[np.repeat(places[at] - (ends - own), own) + np.arange(ends[-1])]
        raw, cuts = flat.tobytes(), (np.append(0, ends)[first] * width).tolist()
        for i, a, b in zip(plain, cuts[:-1], cuts[1:], strict=True):
            out[i] = raw[a:b]
        return out


@lru_cache(2)
def encoder_of(vocabulary: str) -> Encoder:
    """A worker keeps its encoder, and what it has learnt, for its later tasks."""
    return Encoder(vocabulary)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store, base = _filesystem(folder)
        shard = TaskContext.get().partitionId()
        name = f"{shard:08d}-{uuid.uuid4().hex}"
        encoder, end, places, at, tokens, out = None, b"", [], 0, 0, None
        for batch in batches:
            if encoder is None:
                encoder = encoder_of(vocabulary)
                end = np.array([end_id], encoder.kind).tobytes()
                out = store.open_output_stream(f"{base}/{name}.records")
            ids = batch.column("doc_id").to_pylist()
            column = batch.column("text")
            for a in range(0, len(ids), ROWS):
                for doc, raw in zip(ids[a : a + ROWS], encoder.encode(column.slice(a, ROWS).to_pylist()), strict=True):
                    payload = doc.to_bytes(8, "little", signed=True) + bytes([encoder.kind.itemsize]) + raw + end
                    size = len(payload).to_bytes(8, "little")
                    frame = b"".join((size, masked_crc(size).to_bytes(4, "little"), payload, masked_crc(payload).to_bytes(4, "little")))
                    out.write(frame)
                    places.append((at, len(frame)))
                    at += len(frame)
                    tokens += (len(payload) - 9) // encoder.kind.itemsize
        if out is not None:
            out.close()
            with store.open_output_stream(f"{base}/{name}.offsets") as f:
                f.write(np.array(places, "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "records": [len(places)], "tokens": [tokens]})

    return run


def write_records(docs: DataFrame, folder: str, vocabulary: str, shards: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode whole texts (null: empty) and write them, each followed by end_id, in ascending doc_id order. Gives the
    table of shards: shard, name, records, tokens. docs must have unique ids."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    store, base = _filesystem(folder)
    store.create_dir(base, recursive=True)
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return stage(mapped(ordered, _writer(folder, vocabulary, end_id), "shard long, name string, records long, tokens long"), "shards")


def read_record(folder: str, name: str, i: int) -> tuple[int, np.ndarray]:
    """Record i of a shard, by its entry in the offset file: doc_id and ids."""
    store, base = _filesystem(folder)
    with store.open_input_file(f"{base}/{name}.offsets") as f:
        f.seek(16 * i)
        at, size = np.frombuffer(f.read(16), "<i8")
    with store.open_input_file(f"{base}/{name}.records") as f:
        f.seek(int(at))
        return _payload(f.read(int(size)))


def _payload(frame: bytes) -> tuple[int, np.ndarray]:
    size, payload = frame[:8], frame[12:-4]
    if int.from_bytes(size, "little") != len(payload) or masked_crc(size).to_bytes(4, "little") != frame[8:12] or masked_crc(payload).to_bytes(4, "little") != frame[-4:]:
        raise ValueError("a record's checksum doesn't hold")
    return int.from_bytes(payload[:8], "little", signed=True), np.frombuffer(payload[9:], f"<u{payload[8]}")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{name}.offsets") as f:
                    places = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
                with store.open_input_stream(f"{base}/{name}.records") as f:
                    for a in range(0, len(places), 5000):
                        docs, starts, sizes, sums = [], [], [], []
                        for _, size in places[a : a + 5000]:
                            doc, ids = _payload(f.read(int(size)))
                            docs.append(doc)
                            starts.append(before)
                            sizes.append(len(ids))
                            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                            before += len(ids)
                        yield pa.RecordBatch.from_pydict({"doc_id": docs, "start": starts, "n_tokens": sizes, "ids_crc32": sums})

    return run


def read_records(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, checksums verified; one task reads a shard from its start. The
    shards' starts come from their token counts (one row for each shard)."""
    spark = shards.sparkSession
    before, rows = 0, []
    for r in sorted(shards.collect(), key=lambda r: r["shard"]):
        rows.append((r["shard"], r["name"], before))
        before += r["tokens"]
    table = spark.createDataFrame(rows, "shard long, name string, before long").repartitionByRange(max(1, len(rows)), "shard")
    return mapped(table, _reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, vocabulary: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write docs' ids in a new folder of the shared scratch folder and read them back: doc_id, start (ids of all
    documents before it), n_tokens (with the end id), ids_crc32 (of the ids as unsigned 32-bit numbers).

    A null or empty text has the end id alone. Rows with a null or repeated doc_id count as documents of their own, after
    the others where it is null (see per_row); an empty table gives an empty result; other columns are not looked at."""

    def run(d: DataFrame) -> DataFrame:
        folder = new_folder(d.sparkSession, "records")
        return read_records(write_records(d, folder, vocabulary, shards, end_id), folder)

    return per_row(docs, run)
