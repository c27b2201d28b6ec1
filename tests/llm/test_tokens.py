from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from strandlab.llm import merge_dropout, records
from strandlab.llm.common import documents, new_folder
from tests.llm.cases import MESSY, ODD, SF, table

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [(50, "a  b"), (51, " x y "), (52, "p \n q\n\n r"), (53, "it's <|endoftext|> here"), (54, "nbsp\xa0 x \xa0y"), (55, "tab\t z"), (56, "<s> <0x41> </s>"), (57, "▁ ▁▁ a▁b")]


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    out, at = {}, 0
    for i, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def got(df):
    return {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in records.token_records(df, BPE).collect()}


def test_records_round_trip(spark):
    docs = documents(spark, SF)
    assert got(docs) == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(table(spark, ODD + HARD)) == expected(ODD + HARD)


def test_records_messy_and_empty(spark):
    rows = records.token_records(table(spark, MESSY), BPE).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in MESSY)
    assert sorted(r.start for r in rows)[0] == 0 and len({r.start for r in rows}) == len(MESSY)
    assert got(table(spark, [])) == {}


def test_random_reads_and_damage(spark):
    folder = new_folder(spark, "t")
    shards = records.write_records(table(spark, ODD), folder, BPE, shards=2).collect()
    one = next(s for s in shards if s.records > 2)
    doc, ids = records.read_record(folder, one.name, 2)
    assert doc in dict(ODD) and ids[-1] == 0
    path = f"{folder.removeprefix('file://')}/{one.name}.records"
    raw = bytearray(open(path, "rb").read())
    raw[25] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        records.read_record(folder, one.name, 0)


def test_no_dropout_is_the_models_own():
    from sentencepiece import SentencePieceProcessor

    model, own = SentencePieceProcessor(model_file=PIECES), merge_dropout.Encoder(PIECES, 0.0, 1)
    for _, text in ODD + HARD:
        if text and "▁" not in text:
            text = text[:5000]
            assert own.encode(1, text).tolist() == model.encode(text), text[:50]


def test_dropout_varies_and_decodes(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    docs = documents(spark, SF)
    for df in (docs, table(spark, ODD + HARD), table(spark, MESSY)):
        rows = merge_dropout.encode_decode(df, PIECES, with_ids=True).collect()
        assert len(rows) == df.count() and all(r.lossless for r in rows)
        for r, text in zip(rows, [x.text or "" for x in df.select("text").collect()], strict=True):
            if "▁" not in text and r.ids:
                assert model.decode(list(r.ids)) == text
    a, b = (merge_dropout.encode_decode(docs, PIECES, seed=s) for s in (1, 2))
    plain = merge_dropout.encode_decode(docs, PIECES, dropout=0.0)
    n = [sum(r.n_pieces for r in x.collect()) for x in (a, b, plain)]
    assert n[0] != n[1] and n[2] < min(n[:2]) < 1.6 * n[2]
    assert a.collect() == merge_dropout.encode_decode(docs, PIECES, seed=1).collect()
    assert merge_dropout.encode_decode(table(spark, []), PIECES).collect() == []


def test_both_agendas_agree(monkeypatch):
    model = merge_dropout.Model(PIECES)
    words = [" " + w for _, t in ODD + HARD if t for w in t[:3000].split(" ")] + [" internationalisation's", " Donaudampfschifffahrt..", " été—ça"]
    for below in (0, 2**30, 2**31):
        short = [model.segment(w, 99, below) for w in words]
        monkeypatch.setattr(merge_dropout, "SHORT", 0)
        assert short == [model.segment(w, 99, below) for w in words]
        monkeypatch.setattr(merge_dropout, "SHORT", 40)


def naive(model, chunk, key, below):
    """Agenda by definition: all adjacent pairs looked at for each merge."""
    cuts = merge_dropout._gaps(below)
    skip, skipped, came = merge_dropout._gap(key, 0, cuts), 0, 0
    piece, banned = [merge_dropout.MARK if c == " " else c for c in chunk], set()
    own = list(range(len(piece)))  # a name for each symbol, a new one after each merge
    while True:
        pairs = [(-model.score[piece[i] + piece[i + 1]], i) for i in range(len(piece) - 1) if piece[i] + piece[i + 1] in model.score and (own[i], own[i + 1]) not in banned]
        if not pairs:
            break
        i = min(pairs)[1]
        came += 1
        if came - 1 == skip:
            skipped += 1
            skip = came + merge_dropout._gap(key, skipped, cuts)
            banned.add((own[i], own[i + 1]))
            continue
        piece[i : i + 2], own[i : i + 2] = [piece[i] + piece[i + 1]], [max(own) + len(chunk)]
    return [x for p in piece for x in ([model.ids[p]] if p in model.ids else [model.byte_id[b] for b in p.encode()])]


def test_dropout_against_brute_force(spark):
    model = merge_dropout.Model(PIECES)
    words = sorted({w for r in documents(spark, SF).limit(40).collect() for w in (r.text or "").split()})[:1500]
    for k, word in enumerate(words):
        if merge_dropout.MARK not in word:
            for below in (2**28, 2**31):
                assert model.segment(" " + word, 1234567 * k, below) == naive(model, " " + word, 1234567 * k, below), word


def test_grids_against_one_chunk_at_a_time(spark, monkeypatch):
    texts = [t or "" for _, t in ODD + HARD] + [r.text or "" for r in documents(spark, SF).limit(30).collect()] + [" ", "  a  b ", "▁x ▁", "a" * 45 + " é" * 3]
    ids = [None if i == 3 else i * 7 for i in range(len(texts))]
    for dropout in (0.1, 0.6):
        own = merge_dropout.Encoder(PIECES, dropout, 17)
        want = []
        for doc, text in zip(ids, texts, strict=True):
            first = int.from_bytes(merge_dropout.blake2b(f"17:{doc}".encode(), digest_size=8).digest())
            chunks = re.findall(" *[^ ]+| +", " " + text) if text else []
            want.append([x for k, c in enumerate(chunks) for x in own.model.segment(c, merge_dropout._mix((first + (k + 1) * merge_dropout._STEP) & merge_dropout._MASK), own.below)])
        assert [x.tolist() for x in own.encode_many(ids, texts)] == want
        monkeypatch.setattr(merge_dropout, "SLICE_CHARS", 3000)
        assert [x.tolist() for x in own.encode_many(ids, texts)] == want


def test_each_occurrence_draws_anew():
    word = "internationalisation"
    text = " ".join([word] * 3000)
    rows = {}
    for doc in (1, 2, None):
        own = merge_dropout.Encoder(PIECES, 0.1, 17)
        drawn = [own.encode(doc, text).tobytes() for _ in range(2)]
        assert drawn[0] == drawn[1] == merge_dropout.Encoder(PIECES, 0.1, 17).encode_many([5, doc], ["before", text])[1].tobytes()
        rows[doc] = drawn[0]
    assert len(set(rows.values())) == 3
    # what is remembered equals segmentation of each occurrence by itself; pairs are skipped at the dropout rate
    own, ids, came, skipped = merge_dropout.Encoder(PIECES, 0.1, 17), [], 0, 0
    first = int.from_bytes(merge_dropout.blake2b(b"17:1", digest_size=8).digest())
    for k in range(3000):
        got = own.model.drawn(" " + word, merge_dropout._mix((first + (k + 1) * merge_dropout._STEP) & merge_dropout._MASK), own.below)
        ids += got[0]
        came, skipped = came + got[1], skipped + len(got[2])
    assert np.array(ids, own.model.kind).tobytes() == rows[1] and abs(skipped / came - 0.1) < 0.01
