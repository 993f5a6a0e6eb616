"""Token shards and media columns: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import media, tokenbin
from tessera.llm.queries import QUERIES

from .helpers import SF, edge_docs, edge_table, empty_table

# ---- token ids ------------------------------------------------------------------------


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], list(range(70_000)), [5] * 9])
def test_values_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = tokenbin.encode_values(v)
    assert len(control) == -(-len(v) // 4)
    assert len(data) == sum(1 if x < 1 << 8 else 2 if x < 1 << 16 else 3 if x < 1 << 24 else 4 for x in values)
    assert tokenbin.decode_values(control, data, len(v)).tolist() == values


def test_shard_round_trip_and_ranks():
    ids = np.array([9, 9, 9, 40_000, 2, 9, 40_000, 2], np.uint32)
    shard = tokenbin.pack([3, None, -5], np.array([5, 0, 3]), ids)
    names, sizes, back = tokenbin.unpack(shard)
    assert (names, sizes.tolist(), back.tolist()) == ([3, None, -5], [5, 0, 3], ids.tolist())
    assert np.frombuffer(shard, "<u4", 3, 28).tolist() == [9, 2, 40_000]
    assert tokenbin.unpack(tokenbin.pack([], np.zeros(0, int), np.zeros(0, np.uint32)))[0] == []
    with pytest.raises(ValueError):
        tokenbin.unpack(b"XXXX" + shard[4:])


def _want_tokens(rows):
    tok, at, out = Tokenizer.from_file(tokenbin.default_tokenizer()), 0, []
    for doc_id, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def _got_tokens(df):
    return sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in df.collect())


def test_token_query_equals_the_tokenizer(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert _got_tokens(QUERIES["op6_token_shards"](spark, SF)) == sorted((s, d, n, c) for d, s, n, c in _want_tokens(docs))


def _whole(texts, path=None):
    tok = Tokenizer.from_file(path or tokenbin.default_tokenizer())
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def _by_piece(texts, encoder):
    ids, n = encoder.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


ODD_TEXTS = [
    "It's 3.5% of  don't we'll\tI'm X'S", "A<|endoftext|>b", "ÀÉß Ünï ÿ×÷", "\U0001f600 中文 ok", "'sss ''t a'", "...!!! --a--b_c", "", None, "x" * 5000, "İstanbul ſ", "naïve space", "1234567890",
    "<|startoftext|>", "a'", "s b'", "'", "ll", "'É's", "\x00a \x7f<|", "<", "|endoftext|>", "<|ENDOFTEXT|> <|endoftext|>", "¹²½ª", "9's 9'ss", "don''t", "it’s", "é ́ x́",
]


def test_pieces_equal_the_whole_text(monkeypatch):
    encoder = tokenbin.Encoder(tokenbin.default_tokenizer())
    assert encoder.by_word and _by_piece(ODD_TEXTS, encoder) == _whole(ODD_TEXTS)
    r = random.Random(1)
    letters = "aAsStTreEvVlLmMdD'''' \t\n019.,!-<|>éÉ×÷ßÿ€中́"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)]
    want = _whole(texts)
    assert _by_piece(texts, encoder) == want
    forgetful = tokenbin.Encoder(tokenbin.default_tokenizer(), most=5)
    assert [_by_piece(texts[i : i + 100], forgetful) for i in range(0, 3000, 100)] == [want[i : i + 100] for i in range(0, 3000, 100)]
    monkeypatch.setattr(tokenbin, "CHUNK", 64)
    assert _by_piece(texts, encoder) == want


def test_other_tokenizers_get_whole_texts():
    path = tokenbin.default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    encoder = tokenbin.Encoder(path)
    assert not encoder.by_word and _by_piece(ODD_TEXTS, encoder) == _whole(ODD_TEXTS, path)


def test_token_edges(spark):
    rows = sorted(edge_docs(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = _got_tokens(tokenbin.token_table(edge_table(spark), shard=50))
    assert [(d, n) for _, d, n, _ in got if d not in (None,)] == [(d, n) for d, _, n, _ in _want_tokens([r[:2] for r in rows]) if d is not None]
    assert sorted((n, c) for _, _, n, c in got) == sorted((n, c) for _, _, n, c in _want_tokens([r[:2] for r in rows]))
    starts, sizes = [g[0] for g in got], [g[2] for g in got]
    assert starts == [sum(sizes[:i]) for i in range(len(sizes))]
    assert tokenbin.token_table(empty_table(spark)).count() == 0


# ---- media ----------------------------------------------------------------------------


def test_frames_round_trip():
    r = np.random.default_rng(1)
    samples = np.concatenate([r.integers(0, 256, media.UNITS * 3), np.tile([0, 255], media.UNITS // 2), np.full(media.UNITS, 255), np.zeros(media.UNITS)]).astype(np.uint8)
    images = media.encode_frames(samples)
    assert media.decode_frames(images).ravel().tolist() == samples.tolist()
    video = media.read_avi(media.write_avi(images, 10))
    assert video.fps == 10 and video.images == images


@pytest.mark.parametrize("spoil", [lambda d: b"", lambda d: d[:40], lambda d: d.replace(b"AVI ", b"WAVE", 1), lambda d: d.replace(b"idx1", b"idxx"), lambda d: d.replace(b"MJPG", b"H264"), lambda d: d.replace(b"\xff\xd8", b"\xff\xd7"), None])
def test_damaged_files_give_a_reason(spark, spoil):
    good = media.store([b"abc"])[0]
    rows = spark.createDataFrame([(1, None if spoil is None else bytearray(spoil(good)), "x"), (2, bytearray(good), "y")], "id int, media binary, clip string")
    out = {r.id: r for r in media.clips(rows).collect()}
    assert out[1].status != "ok" and out[1].clip is None and out[2].status == "ok" and out[2].n_frames == 1


def test_shots_are_found():
    dark, mid, light = (np.full((8, media.UNITS), v, np.uint8) for v in (10, 120, 240))
    assert media.cuts(np.concatenate([dark, light, mid])) == [0, 8, 16]
    assert media.cuts(dark) == [0] and media.cuts(dark[:0]) == []


def test_clips_are_timed(spark):
    frames = np.concatenate([np.full(media.UNITS * 50, 10), np.full(media.UNITS * 25, 240)]).astype(np.uint8)
    file = media.write_avi(media.encode_frames(frames))
    out = sorted(map(tuple, media.clips(spark.createDataFrame([(1, bytearray(file))], "id bigint, media binary")).collect()))
    assert out == [(1, 0, 0, 50, 0.0, 2.0, 10.0, "ok"), (1, 1, 50, 25, 2.0, 3.0, 240.0, "ok")]


def _check_media(rows, got):
    def one(text):
        raw = (text or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        return len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])

    head = lambda r: (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)
    assert sorted(map(head, got), key=str) == sorted(((r[0], *one(r[1])) for r in rows), key=str)
    assert len({(r.payload_sha256, r.media_bytes, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_media_query_round_trips(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    _check_media(docs, QUERIES["op9_media_avi"](spark, SF).collect())


def test_media_edges(spark):
    _check_media(edge_docs(), media.media_digest(edge_table(spark)).collect())
    assert media.media_digest(empty_table(spark)).count() == 0
    column = media.media_column(edge_table(spark))
    assert column.count() == len(edge_docs()) and media.clips(column).where("status <> 'ok'").count() == 0
    files, _ = media.fetch(media.store([b"", "é".encode()]))
    assert [f.size for f in files] == [576, 576] and pa.array([1]).type == pa.int64()
