"""Baseline JPEG and AVI files of other encoders, built by hand here."""

import random
import struct

import numpy as np
import pytest

from tessera.llm import jpeg, media


def _codes(table):
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[table[at]] = format(code, f"0{length}b")
            code, at = code + 1, at + 1
        code *= 2
    return out


def _bits(v, size):
    return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def _block(c, before, dc, ac):
    d = int(c[0]) - before
    out, run = dc[abs(d).bit_length()] + _bits(d, abs(d).bit_length()), 0
    last = max((i for i in range(1, 64) if c[i]), default=0)
    for v in map(int, c[1 : last + 1]):
        if not v:
            run += 1
            continue
        while run > 15:
            out, run = out + ac[0xF0], run - 16
        size = abs(v).bit_length()
        out, run = out + ac[run << 4 | size] + _bits(v, size), 0
    return out + (ac[0] if last < 63 else "")


def encode(width, height, comps, quants, tables=None, restart=0):
    """comps: (across, down, quantiser, table, coefficients by block row and column)."""
    segment = lambda kind, body: struct.pack(">BBH", 255, kind, len(body) + 2) + body
    known = jpeg.standard_tables() | (tables or {})
    out = b"\xff\xd8" + segment(0xE0, b"AVI1") + b"".join(segment(0xDB, bytes([k]) + bytes(q)) for k, q in quants.items())
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(comps)) + b"".join(bytes([i + 1, c[0] << 4 | c[1], c[2]]) for i, c in enumerate(comps)))
    out += b"".join(segment(0xC4, bytes([k]) + t) for k, t in (tables or {}).items()) + (segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    out += segment(0xDA, bytes([len(comps)]) + b"".join(bytes([i + 1, c[3] << 4 | c[3]]) for i, c in enumerate(comps)) + b"\0\x3f\0")
    # A component alone is in the scan block by block, whatever its factors.
    comps = [(1, 1, *comps[0][2:])] if len(comps) == 1 else comps
    per_row, rows = -(-width // (8 * max(c[0] for c in comps))), -(-height // (8 * max(c[1] for c in comps)))
    bits, before, marker = "", [0] * len(comps), 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\0")

    for u in range(per_row * rows):
        if restart and u and u % restart == 0:
            out, bits, before, marker = out + flush(bits) + bytes([255, 0xD0 + marker % 8]), "", [0] * len(comps), marker + 1
        for k, (h, v, _, t, coefs) in enumerate(comps):
            for y in range(v):
                for x in range(h):
                    c = coefs[u // per_row * v + y, u % per_row * h + x]
                    bits += _block(c, before[k], _codes(known[t]), _codes(known[16 + t]))
                    before[k] = int(c[0])
    return out + flush(bits) + b"\xff\xd9"


def _pixels(coefs, quant):
    """The plain sum of cosines."""
    at = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
    out = np.zeros((8 * coefs.shape[0], 8 * coefs.shape[1]))
    y, x = np.mgrid[0:8, 0:8]
    for r in range(coefs.shape[0]):
        for c in range(coefs.shape[1]):
            for i in np.flatnonzero(coefs[r, c]):
                v, u = divmod(at[i], 8)
                scale = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                out[8 * r : 8 * r + 8, 8 * c : 8 * c + 8] += scale * coefs[r, c, i] * quant[i] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    return np.clip(np.round(out + 128), 0, 255)


def _random(seed, rows, cols):
    r = np.random.default_rng(seed)
    c = np.zeros((rows, cols, 64), int)
    c[..., 0] = r.integers(-60, 60, (rows, cols))
    for _ in range(6):
        c[np.arange(rows)[:, None], np.arange(cols), r.integers(1, 64, (rows, cols))] = r.integers(-9, 10, (rows, cols))
    c[0, 0, 63] = 5
    return c


Q = {0: [3 + i // 9 for i in range(64)], 1: [16 - i // 8 for i in range(64)]}
#: A table of its own for the first component: every DC size has four bits, every AC value eight.
FOUR = {0: bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12)), 16: bytes([*[0] * 7, 162, *[0] * 8]) + bytes(sorted({0, 240, *(r << 4 | s for r in range(16) for s in range(1, 11))}))}


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("tables", [None, FOUR])
def test_pixels_of_frames_with_other_tables(restart, tables):
    luma, blue, red = _random(1, 4, 6), _random(2, 2, 3), _random(3, 2, 3)
    image = encode(43, 29, [(2, 2, 0, 0, luma), (1, 1, 1, 1, blue), (1, 1, 1, 1, red)], Q, tables, restart)
    y, cb, cr = jpeg.planes(image)
    assert y.shape == (29, 43) and cb.shape == cr.shape == (15, 22)
    for got, coefs, q in ((y, luma, Q[0]), (cb, blue, Q[1]), (cr, red, Q[1])):
        want = _pixels(coefs, q)[: got.shape[0], : got.shape[1]]
        assert np.abs(got - want).max() <= 1 and (got == want).mean() > 0.99
    assert np.array_equal(jpeg.block_means(image), np.clip(np.round(luma[..., 0].ravel() * 3 / 8 + 128), 0, 255))
    grey = encode(20, 9, [(2, 1, 1, 1, _random(4, 2, 3))], Q, None, restart)
    assert np.abs(jpeg.planes(grey)[0] - _pixels(_random(4, 2, 3), Q[1])[:9, :20]).max() <= 1


def test_frames_of_this_library_are_ordinary_ones():
    samples = np.random.default_rng(5).integers(0, 256, 2 * media.UNITS).astype(np.uint8)
    for image, frame in zip(media.encode_frames(samples), samples.reshape(2, -1), strict=True):
        assert np.array_equal(jpeg.block_means(image), frame)
        assert np.array_equal(jpeg.planes(image)[0][::8, ::8].ravel(), frame)


def _avi(images, absolute=False, opendml=False, stream=1):
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    strh = lambda kind, code, scale, rate: chunk(b"strh", struct.pack("<4s4sIHHIIII", kind, code, 0, 0, 0, 0, scale, rate, 0) + bytes(24))
    supers = lambda at: chunk(b"indx", struct.pack("<HBBI4s12x", 4, 0, 0, 1, b"01dc") + struct.pack("<QII", at, 0, len(images))) if opendml else b""
    head = lambda at: chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(56)) + chunk(b"LIST", b"strl" + strh(b"auds", b"\0" * 4, 1, 8000)) + chunk(b"LIST", b"strl" + strh(b"vids", b"mjpg", 2, 25) + supers(at)))
    movi_at, parts, places = 12 + len(head(0)) + 8, b"", []
    for i in images:
        parts += chunk(b"00wb", b"sound")
        places.append((movi_at + 4 + len(parts), len(i)))
        parts += chunk(b"%02ddc" % stream, i)
    index_at = movi_at + 4 + len(parts)
    if opendml:
        parts += chunk(b"ix01", struct.pack("<HBBI4sQ4x", 2, 0, 1, len(images), b"01dc", 0) + b"".join(struct.pack("<II", a + 8, n | 1 << 31) for a, n in places))
    rows = b"".join(struct.pack("<4sIII4sIII", b"00wb", 0, a - 14 - base, 5, b"%02ddc" % stream, 16, a - base, n) for base in [0 if absolute else movi_at] for a, n in places)
    body = b"AVI " + head(index_at) + chunk(b"LIST", b"movi" + parts) + (b"" if opendml else chunk(b"idx1", rows))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _shade(v):
    c = np.zeros((2, 3, 64), int)
    c[..., 0] = (v - 128) * 8 // 3
    c[..., 5] = 7
    return encode(24, 16, [(1, 1, 0, 0, c)], Q)


@pytest.mark.parametrize("kind", [{}, {"absolute": True}, {"opendml": True}])
def test_clips_of_a_camera_file(spark, kind):
    images = [_shade(20)] * 25 + [_shade(200)] * 10
    file = _avi(images, **kind)
    assert media.read_avi(file).images == images
    cut = file.replace(_shade(200)[-40:], b"\xff" * 40)
    rows = spark.createDataFrame([(1, bytearray(file)), (2, bytearray(cut)), (3, bytearray(_avi([_shade(9)], stream=7, **kind)))], "id bigint, media binary")
    out = sorted(map(tuple, media.clips(rows).collect()), key=str)
    assert [r[:6] for r in out[:2]] == [(1, 0, 0, 25, 0.0, 2.0), (1, 1, 25, 10, 2.0, 2.8)] and [round(r[6]) for r in out[:2]] == [20, 200]
    assert out[2][0] == 2 and out[2][1] is None and out[2][7] != "ok"


@pytest.mark.parametrize("spoil", [lambda i: i[:-30], lambda i: i[:30], lambda i: i.replace(b"\xff\xc0", b"\xff\xc2"), lambda i: i.replace(b"\xff\xdb", b"\xff\xfe", 1), lambda i: b""])
def test_damaged_frames_give_a_reason(spoil):
    with pytest.raises(ValueError):
        jpeg.planes(spoil(_shade(50)))


@pytest.mark.parametrize("kind", [{}, {"absolute": True}, {"opendml": True}])
def test_repeated_frames_keep_the_time(spark, kind):
    """An entry of size 0 shows the frame before once more."""
    file = _avi(([_shade(20)] + [b""]) * 10 + ([_shade(200)] + [b"", b""]) * 5, **kind)
    first = _avi([b"", b"", _shade(20)], **kind)
    rows = spark.createDataFrame([(1, bytearray(file)), (2, bytearray(first))], "id bigint, media binary")
    out = sorted(map(tuple, media.clips(rows).collect()))
    assert [r[:6] for r in out] == [(1, 0, 0, 20, 0.0, 1.6), (1, 1, 20, 15, 1.6, 2.8), (2, 0, 0, 3, 0.0, 0.24)] and {r[7] for r in out} == {"ok"}


def test_files_that_claim_what_they_lack(spark):
    """No rate, a frame of 65,535 by 65,535, only repeats: a reason each, and the job goes on."""
    file = _avi([_shade(20)] * 3)
    at = file.index(b"vids") + 24
    sof = file.index(b"\xff\xc0")
    huge = _avi([_shade(20)[: (s := _shade(20).index(b"\xff\xc0")) + 5] + b"\xff" * 4 + _shade(20)[s + 9 :]])
    bad = [file[:at] + bytes(4) + file[at + 4 :], file[: at - 4] + bytes(4) + file[at:], huge, _avi([b"", b""]), file[: sof + 12]]
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate([*bad, file])], "id bigint, media binary")
    out = sorted(map(tuple, media.clips(rows).collect()))
    assert [r[0] for r in out] == [0, 1, 2, 3, 4, 5] and all(r[1] is None and r[7] != "ok" for r in out[:5]) and out[5][7] == "ok"


def test_no_damage_fails_the_job(spark):
    """Bytes of a valid file are changed, cut out and doubled at random."""
    r, files = random.Random(8), []
    for kind in ({}, {"absolute": True}, {"opendml": True}):
        whole = _avi([_shade(20), b"", _shade(90), _shade(200)], **kind)
        for _ in range(400):
            file = bytearray(whole)
            for _ in range(r.choice([1, 2, 8])):
                a = r.randrange(len(file))
                kind_ = r.randrange(4)
                if kind_ == 0:
                    file[a] = r.choice([0, 255, r.randrange(256)])
                elif kind_ == 1:
                    file[a : a + 4] = r.choice([b"\xff" * 4, bytes(4), b"\xff\xff\xff\x7f"])
                elif kind_ == 2:
                    del file[a : a + r.randrange(9)]
                else:
                    file[a:a] = file[a : a + r.randrange(40)]
            files.append(bytes(file))
    rows = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(files)], "id bigint, media binary").repartition(4)
    assert {x.id for x in media.clips(rows).select("id").collect()} == set(range(len(files)))


def test_clips_query_equals_plain_shots(spark):
    from tessera.llm.queries import QUERIES

    from .helpers import SF

    got = {(r.doc_id, r.clip): (r.first_frame, r.n_frames, r.status) for r in QUERIES["media_clips"](spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        frames = np.frombuffer(media.payload(r.text.encode()), np.uint8).reshape(-1, 576)
        hist = np.stack([np.bincount(f >> 3, minlength=32) for f in frames]) / 576
        steps, starts = [np.abs(a - b).sum() / 2 for a, b in zip(hist[:-1], hist[1:], strict=True)], [0]
        for i, s in enumerate(steps):
            past = steps[max(starts[-1], i - 12) : i]
            if s > 0.25 and (not past or s > np.mean(past) + 3 * np.std(past) + 1e-12):
                starts.append(i + 1)
        for k, a in enumerate(starts):
            want[r.doc_id, k] = (a, ([*starts, len(frames)][k + 1]) - a, "ok")
    assert got == want
