"""Baseline JPEG frames as motion-JPEG files hold them: small helpers of the media operators."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# The tables that the JPEG standard gives as examples and motion-JPEG frames
# without tables mean. Codes of each length, and the values; the AC values that are not
# listed follow in ascending order.
_DC = {0: ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), bytes(range(12))), 1: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), bytes(range(12)))}
_AC = {
    0: ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    1: ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


def standard_tables() -> dict[int, bytes]:
    """Huffman tables by class and number, each as a file states it: sixteen counts and the values."""
    out = {k: bytes(bits) + values for k, (bits, values) in _DC.items()}
    every = {0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))}
    for k, (bits, head) in _AC.items():
        first = bytes.fromhex(head)
        out[16 + k] = bytes(bits) + first + bytes(sorted(every - set(first)))
    return out


def zigzag() -> np.ndarray:
    """Where in a block of 8 x 8 each coefficient of a scan lies."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> list[int]:
    """For each sixteen bits, the length of the code they begin with and its value, as length * 256 + value; 0 for none."""
    out, code, at = [0] * (1 << 16), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            lo, hi = code << 16 - length, code + 1 << 16 - length
            if hi > 1 << 16 or at >= len(table):
                raise ValueError("a code table that is too full")
            out[lo:hi] = [length << 8 | table[at]] * (hi - lo)
            code, at = code + 1, at + 1
        code <<= 1
    return out


@dataclass
class Component:
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Frame:
    """What a frame's segments say."""

    width: int = 0
    height: int = 0
    restart: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, bytes] = field(default_factory=standard_tables)
    scan: bytes = b""

    def size(self, c: Component) -> tuple[int, int]:
        """Blocks down and across that the scan has of a component."""
        most_h, most_v = max(x.across for x in self.components.values()), max(x.down for x in self.components.values())
        return -(-self.height // (8 * most_v)) * c.down, -(-self.width // (8 * most_h)) * c.across


def parse(image: bytes) -> Frame:
    """Read a frame's segments; ValueError if it is none, is damaged or is not baseline with one scan."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    f, at = Frame(), 2
    while True:
        while at < len(image) and image[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(image) or image[at] != 0xFF:
            raise ValueError("not a JPEG segment")
        kind, size = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        body = image[at + 4 : at + 2 + size]
        if len(body) < size - 2:
            raise ValueError("a segment that ends early")
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                f.quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                f.codes[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1):
            bits, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not f.height or not f.width:
                raise ValueError("a frame without size or of other than eight bits")
            f.components = {body[6 + 3 * k]: Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
        elif kind == 0xDD:
            f.restart = struct.unpack(">H", body)[0]
        elif kind in range(0xC2, 0xD0) and kind not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif kind == 0xDA:
            if body[0] != len(f.components) or not f.components:
                raise ValueError("not one scan of all components")
            for k in range(body[0]):
                c = f.components.get(body[1 + 2 * k])
                if c is None or c.quant not in f.quants or not c.across or not c.down:
                    raise ValueError("a component without tables")
                c.dc, c.ac = body[2 + 2 * k] >> 4, 16 + (body[2 + 2 * k] & 15)
            end = image.rfind(b"\xff\xd9")
            f.scan = image[at : end if end >= at else len(image)]
            return f


def _units(f: Frame) -> list[tuple[int, int, int]]:
    """Component, block row and column (within a unit) of the blocks of a unit of the scan, in order."""
    if len(f.components) == 1:
        return [(0, 0, 0)]
    return [(k, v, h) for k, c in enumerate(f.components.values()) for v in range(c.down) for h in range(c.across)]


def coefficients(f: Frame, keep: int = 64) -> list[np.ndarray]:
    """Each component's first coefficients in the scan's order, not yet scaled: (blocks down, blocks across, keep).

    ValueError if the scan has too few bits for the frame's blocks, before room for them is made.
    """
    comps = list(f.components.values())
    if len(comps) == 1:
        comps[0].across = comps[0].down = 1
    # A block has two codes at least, of a bit each.
    if sum(a * b for a, b in map(f.size, comps)) > 4 * len(f.scan):
        raise ValueError("a scan that ends early")
    out = [np.zeros((*f.size(c), keep), np.int32) for c in comps]
    unit, per_row = _units(f), -(-f.width // (8 * max(c.across for c in comps)))
    total = per_row * -(-f.height // (8 * max(c.down for c in comps)))
    tables = [(_lookup(f.codes[c.dc]), _lookup(f.codes[c.ac])) if c.dc in f.codes and c.ac in f.codes else None for c in comps]
    if None in tables:
        raise ValueError("a component without tables")
    # Restart markers cut the scan; a stuffed zero after 255 is none of its bytes.
    parts, at = [], 0
    for k in range(len(f.scan) - 1):
        if f.scan[k] == 0xFF and 0xD0 <= f.scan[k + 1] <= 0xD7:
            parts.append(f.scan[at:k])
            at = k + 2
    parts.append(f.scan[at:])
    done = 0
    for part in parts:
        raw = part.replace(b"\xff\0", b"\xff")
        bits, raw = 8 * len(raw), np.frombuffer(raw + bytes(4), np.uint8).astype(np.int64)
        window = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]).tolist()
        p, before = 0, [0] * len(comps)
        for _ in range(min(f.restart or total, total - done)):
            row, col = divmod(done, per_row)
            for k, v, h in unit:
                block = out[k][row * comps[k].down + v, col * comps[k].across + h]
                dc, ac = tables[k]
                i = 0
                while i < 64:
                    if p >= bits:
                        raise ValueError("a scan that ends early")
                    hit = (dc if i == 0 else ac)[window[p >> 3] >> 8 - (p & 7) & 0xFFFF]
                    if not hit:
                        raise ValueError("a code that no table has")
                    p += hit >> 8
                    run, size = (0, hit & 255) if i == 0 else (hit >> 4 & 15, hit & 15)
                    if i and not size:
                        if run != 15:
                            break
                        i += 16
                        continue
                    i += run
                    if i > 63 or size > 15 or p + size > bits:
                        raise ValueError("a scan that ends early" if p + size > bits else "a coefficient past its block")
                    value = (window[p >> 3] >> 8 - (p & 7) & 0xFFFF) >> 16 - size
                    p += size
                    if size and not value >> size - 1:
                        value -= (1 << size) - 1
                    if i == 0:
                        before[k] += value
                        value = before[k]
                    if i < keep:
                        block[i] = value
                    i += 1
            done += 1
    if done < total:
        raise ValueError("a scan that ends early")
    return out


def planes(image: bytes) -> list[np.ndarray]:
    """The pixels of each component, 0 to 255, at the component's own resolution."""
    f = parse(image)
    n, x = np.arange(8)[:, None], np.arange(8)
    basis = np.where(n == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * n * np.pi / 16)
    out, order = [], zigzag()
    comps = list(f.components.values())
    for c, k in zip(comps, coefficients(f), strict=True):
        block = np.zeros(k.shape)
        block[..., order] = k * f.quants[c.quant]
        pixels = basis.T @ block.reshape(*k.shape[:2], 8, 8) @ basis
        full = np.clip(np.round(pixels + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * k.shape[0], -1)
        most_h, most_v = max(x.across for x in comps), max(x.down for x in comps)
        out.append(full[: -(-f.height * c.down // most_v), : -(-f.width * c.across // most_h)])
    return out


def block_means(image: bytes) -> np.ndarray:
    """The mean brightness of the first component's blocks, from their first coefficients."""
    f = parse(image)
    first = next(iter(f.components.values()))
    dc = coefficients(f, 1)[0][..., 0] * f.quants[first.quant][0]
    return np.clip(np.round(dc / 8 + 128), 0, 255).astype(np.uint8).ravel()
