"""Parts of the lossy bitstream: the boolean coder, frame headers up to the coefficient probabilities, 4 x 4 prediction, loop filters, trellis.

Whole frames are vp8_frames's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from rasterloom.functions.formulas import AC_STEPS, DC_STEPS
from rasterloom.sources.webp import broken, image_size, short


class BoolReader:
    """Reads decisions of given probabilities, of 256, for 0."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.value, self.bits, self.range = data, 0, 0, -8, 255
        self._fill()

    def _fill(self) -> None:
        while self.bits < 0:
            self.value = self.value << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.bits += 8

    def bit(self, prob: int = 128) -> int:
        split = 1 + ((self.range - 1) * prob >> 8)
        if self.value >> self.bits >= split:
            self.value -= split << self.bits
            self.range -= split
            out = 1
        else:
            self.range, out = split, 0
        shift = 8 - self.range.bit_length()
        self.range <<= shift
        self.bits -= shift
        self._fill()
        return out

    def number(self, bits: int) -> int:
        out = 0
        for _ in range(bits):
            out = out << 1 | self.bit()
        return out

    def signed(self, bits: int) -> int:
        v = self.number(bits)
        return -v if self.bit() else v

    def optional(self, bits: int) -> int:
        return self.signed(bits) if self.bit() else 0

    def over(self) -> bool:
        """More has been read than there was."""
        return self.at > len(self.data) + 1


class BoolWriter:
    """Writes decisions: the low end of an interval, of which only the last bytes, which a carry can still change often, are one number."""

    WINDOW = 512

    def __init__(self) -> None:
        self.out, self.low, self.range, self.shift = bytearray(), 0, 255, 0

    def bit(self, value: int, prob: int = 128) -> None:
        split = 1 + ((self.range - 1) * prob >> 8)
        if value:
            self.low += split
            self.range -= split
        else:
            self.range = split
        n = 8 - self.range.bit_length()
        self.low <<= n
        self.range <<= n
        self.shift += n
        if self.shift >= self.WINDOW:
            self._give(self.shift // 8)

    def _give(self, size: int) -> None:
        """Moves the number's first bytes out, and its carry into those before."""
        kept = 8 + self.shift - 8 * size
        top, self.low, self.shift = self.low >> kept, self.low & ((1 << kept) - 1), self.shift - 8 * size
        if top >> 8 * size:
            k = len(self.out) - 1
            while self.out[k] == 255:
                self.out[k] = 0
                k -= 1
            self.out[k] += 1
        self.out += (top & ((1 << 8 * size) - 1)).to_bytes(size, "big")

    def number(self, value: int, bits: int) -> None:
        for k in reversed(range(bits)):
            self.bit(value >> k & 1)

    def optional(self, value: int, bits: int) -> None:
        self.bit(int(value != 0))
        if value:
            self.number(abs(value), bits)
            self.bit(int(value < 0))

    def done(self) -> bytes:
        """The interval's low end in whole bytes: the first eight bits decided it before anything was shifted."""
        pad = -self.shift % 8
        self.low <<= pad
        self.shift += pad
        self._give(self.shift // 8 + 1)
        return bytes(self.out)


@dataclass
class Header:
    width: int = 1
    height: int = 1
    profile: int = 0
    partition_size: int = 0
    colour_space: int = 0
    clamping: int = 0
    segments: bool = False
    update_map: bool = False
    absolute: bool = False
    segment_quantizers: list[int] = field(default_factory=lambda: [0] * 4)
    segment_filters: list[int] = field(default_factory=lambda: [0] * 4)
    segment_probs: list[int] = field(default_factory=lambda: [255] * 3)
    simple_filter: bool = False
    filter_level: int = 0
    sharpness: int = 0
    filter_deltas: bool = False
    ref_deltas: list[int] = field(default_factory=lambda: [0] * 4)
    mode_deltas: list[int] = field(default_factory=lambda: [0] * 4)
    partitions: int = 1
    quantizer: int = 0
    quantizer_deltas: list[int] = field(default_factory=lambda: [0] * 5)  # y1 dc, y2 dc, y2 ac, uv dc, uv ac

    def matrices(self) -> list[dict[str, tuple[int, int]]]:
        """DC and AC steps of y1, y2 and uv for each segment."""
        out = []
        for k in range(4):
            q = self.quantizer if not self.segments else self.segment_quantizers[k] + (0 if self.absolute else self.quantizer)
            y1, y2d, y2a, uvd, uva = self.quantizer_deltas
            at = lambda d, most=127, q=q: max(0, min(most, q + d))
            out.append({"y1": (DC_STEPS[at(y1)], AC_STEPS[at(0)]), "y2": (2 * DC_STEPS[at(y2d)], max(8, AC_STEPS[at(y2a)] * 101581 >> 16)), "uv": (DC_STEPS[at(uvd, 117)], AC_STEPS[at(uva)])})
        return out


def read_header(payload: bytes) -> Header:
    """The frame header of a VP8 payload, as far as the quantizers."""
    return open_header(payload)[0]


def open_header(payload: bytes) -> tuple[Header, BoolReader]:
    """read_header(), and the first partition's reader behind it."""
    h = Header(*image_size(b"VP8 ", payload)[:2])
    tag = int.from_bytes(payload[:3], "little")
    h.profile, h.partition_size = tag >> 1 & 7, tag >> 5
    if len(payload) < 10 + h.partition_size:
        raise short("VP8 first partition")
    r = BoolReader(payload[10 : 10 + h.partition_size])
    h.colour_space, h.clamping, h.segments = r.bit(), r.bit(), bool(r.bit())
    if h.segments:
        h.update_map, data = bool(r.bit()), r.bit()
        if data:
            h.absolute = bool(r.bit())
            h.segment_quantizers = [r.optional(7) for _ in range(4)]
            h.segment_filters = [r.optional(6) for _ in range(4)]
        if h.update_map:
            h.segment_probs = [r.number(8) if r.bit() else 255 for _ in range(3)]
    h.simple_filter, h.filter_level, h.sharpness, h.filter_deltas = bool(r.bit()), r.number(6), r.number(3), bool(r.bit())
    if h.filter_deltas and r.bit():
        h.ref_deltas = [r.optional(6) for _ in range(4)]
        h.mode_deltas = [r.optional(6) for _ in range(4)]
    h.partitions = 1 << r.number(2)
    h.quantizer = r.number(7)
    h.quantizer_deltas = [r.optional(4) for _ in range(5)]
    if r.over():
        raise broken("VP8 ends within its frame header")
    return h, r


def write_header(h: Header) -> bytes:
    """A payload that ends after the quantizers, with what one more byte of its first partition needs."""
    w = BoolWriter()
    put_header(w, h)
    body = w.done() + b"\0"
    return frame_tag(h, len(body)) + body


def frame_tag(h: Header, size: int) -> bytes:
    """What stands before the first partition of size bytes."""
    tag = (size << 5 | 1 << 4 | h.profile << 1).to_bytes(3, "little")
    return tag + b"\x9d\x01\x2a" + h.width.to_bytes(2, "little") + h.height.to_bytes(2, "little")


def put_header(w: BoolWriter, h: Header) -> None:
    for v in (h.colour_space, h.clamping, int(h.segments)):
        w.bit(v)
    if h.segments:
        w.bit(int(h.update_map))
        w.bit(1)
        w.bit(int(h.absolute))
        for v, n in [*((v, 7) for v in h.segment_quantizers), *((v, 6) for v in h.segment_filters)]:
            w.optional(v, n)
        for v in h.segment_probs if h.update_map else ():
            w.bit(int(v != 255))
            if v != 255:
                w.number(v, 8)
    w.bit(int(h.simple_filter))
    w.number(h.filter_level, 6)
    w.number(h.sharpness, 3)
    w.bit(int(h.filter_deltas))
    if h.filter_deltas:
        w.bit(1)
        for v in h.ref_deltas + h.mode_deltas:
            w.optional(v, 6)
    w.number(h.partitions.bit_length() - 1, 2)
    w.number(h.quantizer, 7)
    for v in h.quantizer_deltas:
        w.optional(v, 4)


def subblock(mode: str, above: np.ndarray, left: np.ndarray, corner: int) -> np.ndarray:
    """A 4 x 4 block predicted from the 8 samples above (4 of them to the right), 4 to the left and the corner. Modes: dc, tm, ve, he, ld,
    rd, vr, vl, hd, hu. Directional ones smooth the edge that runs from the lower left, by the corner, to the upper right."""
    a, l = above.astype(np.int64), left.astype(np.int64)
    if mode == "dc":
        return np.full((4, 4), (a[:4].sum() + l.sum() + 4) >> 3)
    if mode == "tm":
        return np.clip(l[:, None] + a[None, :4] - corner, 0, 255)
    e = np.concatenate([l[::-1], [corner], a])  # e[4] is the corner, e[5:] above, e[3::-1] left
    two = (e[:-1] + e[1:] + 1) >> 1  # of e[i] and e[i + 1]
    three = np.concatenate([[0], (e[:-2] + 2 * e[1:-1] + e[2:] + 2) >> 2, [(e[-2] + 3 * e[-1] + 2) >> 2]])  # about e[i]
    y, x = np.mgrid[0:4, 0:4]
    if mode == "ve":
        return three[5 + x]
    if mode == "he":
        low = (l[2] + 3 * l[3] + 2) >> 2
        return np.where(y == 3, low, three[3 - y])
    if mode == "ld":
        return three[6 + x + y]
    if mode == "rd":
        return three[4 + x - y]
    if mode == "vr":
        z = 2 * x - y
        return np.where(z >= 0, np.where(z % 2 == 0, two[np.clip(4 + (z + 1) // 2, 0, 11)], three[np.clip(4 + z // 2 + z % 2, 0, 12)]), np.where(z == -1, three[4], three[np.clip(5 - y, 0, 12)]))
    if mode == "hd":
        z = 2 * y - x
        return np.where(z >= 0, np.where(z % 2 == 0, two[np.clip(3 - z // 2, 0, 11)], three[np.clip(4 - z // 2 - z % 2, 0, 12)]), np.where(z == -1, three[4], three[np.clip(3 + x, 0, 12)]))
    if mode == "vl":
        out = np.where(y % 2 == 0, two[5 + x + y // 2], three[6 + x + y // 2])
        out[2, 3], out[3, 3] = three[10], three[11]
        return out
    z = x + 2 * y  # hu
    last = l[3]
    out = np.where(z % 2 == 0, two[np.clip(2 - z // 2, 0, 11)], three[np.clip(2 - z // 2, 0, 12)])
    return np.where(z > 5, last, np.where(z == 5, (l[2] + 3 * last + 2) >> 2, out))


def _wide(v: np.ndarray) -> np.ndarray:
    return np.clip(v, -128, 127)


def filtered_edge(px: np.ndarray, limit: int, inner: int, high: int, border: bool) -> np.ndarray:
    """The normal loop filter on rows of 8 samples, four on either side of an edge; border: one between macroblocks."""
    p3, p2, p1, p0, q0, q1, q2, q3 = (px[:, k].astype(np.int64) for k in range(8))
    near = np.abs(p0 - q0) * 2 + (np.abs(p1 - q1) >> 1) <= limit
    for a, b in ((p3, p2), (p2, p1), (p1, p0), (q3, q2), (q2, q1), (q1, q0)):
        near &= np.abs(a - b) <= inner
    varied = (np.abs(p1 - p0) > high) | (np.abs(q1 - q0) > high)
    out = px.astype(np.int64).copy()
    step = _wide(np.where(varied | border, _wide(p1 - q1), 0) + 3 * (q0 - p0))
    up, down = _wide(step + 4) >> 3, _wide(step + 3) >> 3
    put = lambda k, v, ok: out.__setitem__((slice(None), k), np.where(ok, np.clip(v, 0, 255), out[:, k]))
    if not border:
        put(4, q0 - up, near)
        put(3, p0 + down, near)
        more = (up + 1) >> 1
        put(5, q1 - more, near & ~varied)
        put(2, p1 + more, near & ~varied)
        return out.astype(np.uint8)
    put(4, q0 - up, near & varied)
    put(3, p0 + down, near & varied)
    for k, weight in enumerate((27, 18, 9)):
        move = _wide((step * weight + 63) >> 7)
        put(4 + k, (q0, q1, q2)[k] - move, near & ~varied)
        put(3 - k, (p0, p1, p2)[k] + move, near & ~varied)
    return out.astype(np.uint8)


def trellis(coefficients: list[int], steps: list[int], rate, weight: int) -> list[int]:
    """Levels of least 256 * squared error + weight * rate. A coefficient is rounded down or up; rate(place, level, context) is in bits and
    context is 0, 1 or 2 by the level before. Paths that end in the same context are compared, so it is linear in the places."""
    best: dict[int, tuple[int, list[int]]] = {0: (0, [])}
    for k, (c, q) in enumerate(zip(coefficients, steps, strict=True)):
        down = abs(c) // q
        then: dict[int, tuple[int, list[int]]] = {}
        for before, (cost, path) in sorted(best.items()):
            for level in (down, down + 1):
                level = min(2047, level)
                error = abs(c) - level * q
                total = cost + 256 * error * error + weight * rate(k, level, before)
                after = min(2, level)
                if after not in then or total < then[after][0]:
                    then[after] = (total, [*path, level if c >= 0 else -level])
        best = then
    return min(best.values(), key=lambda x: x[0])[1]
