"""Numpy views of Arrow text columns, for functions that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes, so that memory follows this and not the batch.
CHUNK = 1 << 21
_U = np.uint64


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, or one row."""
    if not batch.num_rows:
        return
    _, off = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and where each begins and ends; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    off = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if off else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Keeps the first so many bytes of a little-endian number of eight.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, off: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of other bytes than those between, and the first word of each text (with the total last).

    between: for each of the 256 bytes, whether it separates words; white space if not given.
    """
    solid = ~between[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = bool(len(data)) and solid[0], bool(len(data)) and solid[-1]
    edge[1:-1] = solid[1:] != solid[:-1]
    # A text that ends inside a word and one that begins with a word are two words.
    cut = off[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[solid[cut] & solid[cut - 1]] if len(cut) else cut
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, taken eight at a time; A-Z count as a-z if lower."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix64(size.astype(_U) + _U(0x9E3779B97F4A7C15))
    out = mix64(out ^ (eights[starts] & _KEEP[np.minimum(size, 8)]))
    rest, done = np.flatnonzero(size > 8), 8
    while len(rest):
        out[rest] = mix64(out[rest] * _U(0xD6E8FEB86659FD93) ^ (eights[starts[rest] + done] & _KEEP[np.minimum(size[rest] - done, 8)]))
        done += 8
        rest = rest[size[rest] > done]
    return out


def byte_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often each text has each of the 256 bytes."""
    return np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]) if len(off) > 1 else np.zeros((0, 256), np.int64)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's range of positions."""
    run = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return run[first[1:]] - run[first[:-1]]
