"""Media columns: AVI motion-JPEG, frames that carry bytes without loss, timed shots."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, utf8
from .common import small_batches
from .jpeg import block_means

#: A frame has 24 x 24 blocks of 8 x 8 pixels; the format's unit is a block's DC coefficient, which holds a byte.
SIDE = 24
UNITS = SIDE * SIDE
FPS = 25
#: Bins of a frame's histogram, frames before a cut that set its threshold, deviations above their mean, least difference.
BINS, LOOK_BACK, DEVIATIONS, LEAST = 32, 12, 3.0, 0.25
_PIXELS = SIDE * 8

# ---- frames ---------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache
def _frame_head() -> bytes:
    """Tables for which every block takes ten bits.

    The code for a DC difference of n bits has 9 - n bits, which leaves only the code of
    ones unused; the one AC code, a single 0 bit, ends the block. The quantiser of DC is 8,
    so that a block whose pixels are all v has coefficient v - 128.
    """
    dc = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    ac = bytes([1] + [0] * 15) + b"\0"
    return b"".join((
        b"\xff\xd8", _segment(0xDB, b"\0" + bytes([8] * 64)), _segment(0xC0, struct.pack(">BHHBBBB", 8, _PIXELS, _PIXELS, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\0" + dc + b"\x10" + ac), _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ))


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The ten bits of each difference from -255 to 255, as numbers; and back."""
    diff = np.arange(-255, 256)
    size = np.array([int(abs(d)).bit_length() for d in diff])
    prefix = (1 << (9 - size)) - 2
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    code = ((prefix << size) | extra) << 1
    back = np.full(1024, 999, np.int16)
    back[code] = diff
    return code.astype(np.uint16), back


_CODE, _DIFF = _codes()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG images of frames of UNITS bytes each; all frames are coded at once."""
    frames = samples.reshape(-1, UNITS).astype(np.int16)
    diff = np.diff(frames, axis=1, prepend=np.int16(128))
    code = _CODE[diff + 255]
    # Four blocks of ten bits make five bytes.
    q = code.reshape(len(frames), -1, 4).astype(np.uint64)
    five = q[..., 0] << np.uint64(30) | q[..., 1] << np.uint64(20) | q[..., 2] << np.uint64(10) | q[..., 3]
    scan = five[..., None] >> np.array([32, 24, 16, 8, 0], np.uint64) & np.uint64(255)
    scan = scan.astype(np.uint8).reshape(len(frames), -1)
    head, tail = _frame_head(), b"\xff\xd9"
    return [b"".join((head, row.tobytes().replace(b"\xff", b"\xff\0"), tail)) for row in scan]


def decode_frames(images: list[bytes]) -> np.ndarray:
    """The bytes of this module's frames, from their DC coefficients; ValueError if a frame is damaged or of another kind.

    All codes have ten bits there, so all blocks of all frames are decoded at once.
    """
    bits, head = UNITS * 10 // 8, _frame_head()
    scans = []
    for image in images:
        if not image.startswith(head) or image[-2:] != b"\xff\xd9":
            raise ValueError("not a frame of this kind")
        scan = image[len(head) : -2].replace(b"\xff\0", b"\xff")
        if len(scan) != bits:
            raise ValueError("a scan of another length")
        scans.append(scan)
    five = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 5).astype(np.uint64)
    joined = five[:, 0] << np.uint64(32) | five[:, 1] << np.uint64(24) | five[:, 2] << np.uint64(16) | five[:, 3] << np.uint64(8) | five[:, 4]
    code = joined[:, None] >> np.array([30, 20, 10, 0], np.uint64) & np.uint64(1023)
    diff = _DIFF[code.astype(np.int64)].reshape(len(images), UNITS)
    if (diff == 999).any():
        raise ValueError("a code that no block has")
    return (np.cumsum(diff, axis=1) + 128).astype(np.uint8)


# ---- container ------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(images: list[bytes], fps: int = FPS) -> bytes:
    """An AVI file with one MJPG stream and an index."""
    most = max(map(len, images), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(images), 0, 1, most, _PIXELS, _PIXELS, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(images), most, 0xFFFFFFFF, 0, 0, 0, _PIXELS, _PIXELS)
    strf = struct.pack("<IiiHH4sIiiII", 40, _PIXELS, _PIXELS, 1, 24, b"MJPG", _PIXELS * _PIXELS * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    parts, index, at = [], [], 4
    for image in images:
        parts.append(c := _chunk(b"00dc", image))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        at += len(c)
    body = _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


@dataclass
class Video:
    fps: float
    images: list[bytes]


def _parts(data: bytes, at: int, end: int) -> list[tuple[bytes, int, int]]:
    """Name, place and size of the chunks in a stretch of a file; a list has its kind for a name."""
    out = []
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        inner = name in (b"LIST", b"RIFF")
        out.append((data[at + 8 : at + 12], at + 12, size - 4) if inner else (name, at + 8, size))
        at += 8 + size + size % 2
    return out


def _indexed(data: bytes, stream: int, movi: int, idx1: tuple[int, int] | None, supers: list[tuple[int, int]]) -> list[bytes]:
    """The frames that the file's index lists, empty where it repeats the one before: an OpenDML one, else idx1, whose offsets count from ``movi`` or from the file's start."""
    out = []
    for at, _ in supers:
        for entries, base in _standard(data, at):
            out += [data[base + where : base + where + (size & 0x7FFFFFFF)] for where, size in entries]
    if out or idx1 is None:
        return out
    names = (b"%02ddc" % stream, b"%02ddb" % stream)
    rows = [r for r in struct.iter_unpack("<4sIII", data[idx1[0] : idx1[0] + idx1[1] // 16 * 16]) if r[0] in names]
    base = 0 if rows and data[rows[0][2] : rows[0][2] + 4] == rows[0][0] else movi
    for name, _, offset, size in rows:
        start = base + offset
        if data[start : start + 4] != name or start + 8 + size > len(data):
            raise ValueError("an index that points elsewhere")
        out.append(data[start + 8 : start + 8 + size])
    return out


def _standard(data: bytes, at: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The entries of each standard index that a super index names, and where they count from."""
    _, _, kind, used = struct.unpack_from("<HBBI", data, at)
    places = [at] if kind == 1 else [struct.unpack_from("<Q", data, at + 24 + 16 * k)[0] + 8 for k in range(used)]
    out = []
    for p in places:
        n, base = struct.unpack_from("<I", data, p + 4)[0], struct.unpack_from("<Q", data, p + 12)[0]
        out.append(([struct.unpack_from("<II", data, p + 24 + 8 * k) for k in range(n)], base))
    return out


def read_avi(data: bytes) -> Video:
    """The frames that the index of an AVI file lists; ValueError if it is none or lacks parts."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found = {name: (at, size) for name, at, size in reversed(_parts(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])))}
    if not {b"hdrl", b"movi"} <= found.keys():
        raise ValueError("an AVI file without header or frames")
    h, size = found[b"hdrl"]
    streams = [_parts(data, at, at + n) for name, at, n in _parts(data, h, h + size) if name == b"strl"]
    for k, parts in enumerate(streams):
        at = next((a for name, a, _ in parts if name == b"strh"), None)
        if at is None or data[at : at + 4] != b"vids":
            continue
        scale, rate = struct.unpack_from("<II", data, at + 20)
        if not rate:
            raise ValueError("a stream without a rate")
        if data[at + 4 : at + 8].upper() != b"MJPG" or not scale:
            break
        supers = [(a, n) for name, a, n in parts if name == b"indx"]
        if b"idx1" not in found and not supers:
            raise ValueError("an AVI file without index")
        return Video(rate / scale, _indexed(data, k, found[b"movi"][0] - 4, found.get(b"idx1"), supers))
    raise ValueError("not motion JPEG")


def brightness(video: Video) -> np.ndarray:
    """The mean brightness of each frame's blocks, a row for each frame; ValueError if a frame is damaged or of another size.

    An empty frame is the one before it once more, or the first one if none is before it.
    """
    images = [i for i in video.images if i]
    if not images:
        return np.zeros((0, UNITS), np.uint8)
    if all(i.startswith(_frame_head()) for i in images):
        frames = decode_frames(images)
    else:
        rows = [block_means(i) for i in images]
        if len({len(r) for r in rows}) > 1:
            raise ValueError("frames of several sizes")
        frames = np.stack(rows)
    return frames[np.maximum(np.cumsum([bool(i) for i in video.images]) - 1, 0)]


# ---- shots ----------------------------------------------------------------------------


def histograms(frames: np.ndarray) -> np.ndarray:
    """Shares of each frame's blocks in BINS bins of brightness."""
    key = np.arange(len(frames))[:, None] * BINS + (frames >> 3)
    return np.bincount(key.ravel(), minlength=len(frames) * BINS).reshape(-1, BINS) / frames.shape[1]


def cuts(frames: np.ndarray) -> list[int]:
    """Frames at which a shot begins, 0 first.

    A cut is a histogram difference above LEAST and above the mean of those since the last
    cut, LOOK_BACK at most, by DEVIATIONS of their standard deviations.
    """
    if not len(frames):
        return []
    h = histograms(frames)
    step = np.abs(np.diff(h, axis=0)).sum(1) / 2
    out = [0]
    for i in np.flatnonzero(step > LEAST) if len(step) else ():
        past = step[max(out[-1], i - LOOK_BACK) : i]
        if not len(past) or step[i] > past.mean() + DEVIATIONS * past.std() + 1e-12:
            out.append(int(i) + 1)
    return out


# ---- tables ---------------------------------------------------------------------------


def payload(text: bytes) -> bytes:
    """The bytes padded with 255 to a positive multiple of a frame."""
    return text + b"\xff" * (-len(text) % UNITS or (0 if text else UNITS))


def store(texts: list[bytes]) -> list[bytes]:
    """An AVI file for each byte string; the frames of all are coded together."""
    padded = [payload(t) for t in texts]
    images = encode_frames(np.frombuffer(b"".join(padded), np.uint8))
    out, at = [], 0
    for p in padded:
        n = len(p) // UNITS
        out.append(write_avi(images[at : at + n]))
        at += n
    return out


def fetch(files: list[bytes]) -> tuple[list[np.ndarray], list[Video]]:
    """The frames of each file as bytes, decoded together."""
    videos = [read_avi(f) for f in files]
    sizes = [len(v.images) for v in videos]
    frames = decode_frames([i for v in videos for i in v.images])
    return np.split(frames, np.cumsum(sizes)[:-1]) if files else [], videos


def _texts(b: pa.RecordBatch) -> list[bytes]:
    data, off = utf8(b.column("text"))
    raw = data.tobytes()
    return [raw[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: an AVI file for each text, a null as an empty one."""

    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text", 1 << 19):
                t = _texts(b)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in t], pa.int64()), pa.array(store(t), pa.large_binary()).cast(pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary")


def clips(media: DataFrame, *, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row for each shot: ``id, clip, first_frame, n_frames, start_s, end_s, brightness, status``.

    Any baseline frames are read, with the tables of the file or, where it has none, the
    standard's; brightness is that of the first component's blocks, from their first
    coefficients. A null, a damaged file, one without frames or another kind of file gives
    one row with the reason in ``status`` and nulls; others have ``ok``. An entry of size 0
    in a file's index is the frame before once more. Rows that repeat an id give theirs
    each, an empty table none.
    """

    def run(batches):
        for b in batches:
            rows = []
            for name, data in zip(b.column("id").to_pylist(), b.column("media").to_pylist(), strict=True):
                try:
                    video = read_avi(data or b"")
                    frames = brightness(video)
                    if not len(frames):
                        raise ValueError("a file without frames")
                except (ValueError, LookupError, ArithmeticError, MemoryError, struct.error) as e:
                    rows.append((name, None, None, None, None, None, None, str(e) or type(e).__name__))
                    continue
                starts = cuts(frames)
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True)):
                    rows.append((name, k, a, z - a, a / video.fps, z / video.fps, float(frames[a:z].mean()), "ok"))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (b.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "clip", "first_frame", "n_frames", "start_s", "end_s", "brightness", "status"])

    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"id {kind}, clip int, first_frame bigint, n_frames bigint, start_s double, end_s double, brightness double, status string")


def media_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back and describe them, without keeping the files.

    ``feature`` has the frames, the shots' first frames and the mean brightness in
    thousandths; equal texts have equal values. Each text's file lives only in its task.
    """

    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text", 1 << 19):
                t = _texts(b)
                files = store(t)
                frames, _ = fetch(files)
                back = [f.tobytes() for f in frames]
                digest = lambda v: pa.array([hashlib.sha256(x).hexdigest() for x in v])
                feature = [f"frames={len(f)};cuts={','.join(map(str, cuts(f)))};mean={int(f.sum(dtype=np.int64)) * 1000 // f.size}" for f in frames]
                yield pa.RecordBatch.from_arrays([
                    b.column("id"), pa.array([len(x) for x in t], pa.int64()), pa.array([len(x) for x in back], pa.int64()), digest(back), pa.array([zlib.crc32(x[-32:]) for x in back], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()), digest(files), pa.array(feature),
                ], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)
