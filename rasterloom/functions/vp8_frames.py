"""Whole key frames of the lossy bitstream: macroblock modes, coefficient tokens, prediction, loop filter, and an encoder of them.

The format's probability tables are a parameter, a file of numbers in the format's own order that Tables.read() takes: 1,056 default
coefficient probabilities (type, band, context, node), 1,056 probabilities that one of them is updated, and 900 of sub-block modes (mode
above, mode to the left, node). Everything else is here. Samples are decoded one macroblock after the other, as each is predicted from what
stands above and to the left of it; within one, transforms and predictions are array operations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from rasterloom.functions import formulas as f
from rasterloom.functions import vp8
from rasterloom.operators.statistics import BANDS, MODE_TREES
from rasterloom.sources.webp import broken, short

CHROMA_MODES = ("dc", "vertical", "horizontal", "motion")
#: Sub-block modes in the order in which the tables have them, and the ways to them as (node, branch): fixed values of the format.
SUB_MODES = ("dc", "tm", "ve", "he", "ld", "rd", "vr", "vl", "hd", "hu")
SUB_WAYS = {
    "dc": ((0, 0),), "tm": ((0, 1), (1, 0)), "ve": ((0, 1), (1, 1), (2, 0)),
    "he": ((0, 1), (1, 1), (2, 1), (3, 0), (4, 0)), "rd": ((0, 1), (1, 1), (2, 1), (3, 0), (4, 1), (5, 0)), "vr": ((0, 1), (1, 1), (2, 1), (3, 0), (4, 1), (5, 1)),
    "ld": ((0, 1), (1, 1), (2, 1), (3, 1), (6, 0)), "vl": ((0, 1), (1, 1), (2, 1), (3, 1), (6, 1), (7, 0)),
    "hd": ((0, 1), (1, 1), (2, 1), (3, 1), (6, 1), (7, 1), (8, 0)), "hu": ((0, 1), (1, 1), (2, 1), (3, 1), (6, 1), (7, 1), (8, 1)),
}
#: Sub-block modes that a whole block's mode stands for as a context.
IMPLIED = {"dc": "dc", "vertical": "ve", "horizontal": "he", "motion": "tm"}
#: Least value and probabilities of the extra bits of the six large categories: fixed values of the format.
LARGE = ((5, (159,)), (7, (165, 145)), (11, (173, 148, 140)), (19, (176, 155, 140, 135)), (35, (180, 157, 141, 134, 130)), (67, (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129)))
#: Ways to the sizes of a coefficient from node 2 on; large categories are numbered from 5.
SIZES = {
    1: ((2, 0),), 2: ((2, 1), (3, 0), (4, 0)), 3: ((2, 1), (3, 0), (4, 1), (5, 0)), 4: ((2, 1), (3, 0), (4, 1), (5, 1)), 5: ((2, 1), (3, 1), (6, 0), (7, 0)), 6: ((2, 1), (3, 1), (6, 0), (7, 1)),
    7: ((2, 1), (3, 1), (6, 1), (8, 0), (9, 0)), 8: ((2, 1), (3, 1), (6, 1), (8, 0), (9, 1)), 9: ((2, 1), (3, 1), (6, 1), (8, 1), (10, 0)), 10: ((2, 1), (3, 1), (6, 1), (8, 1), (10, 1)),
}
#: Kinds of blocks: luma without its DC, the luma DCs, chroma, luma with its DC.
AFTER_DC, DCS, CHROMA, WHOLE = range(4)


@dataclass
class Tables:
    coefficients: np.ndarray  # (4, 8, 3, 11)
    updates: np.ndarray
    modes: np.ndarray  # (10, 10, 9)

    @classmethod
    def read(cls, path: str) -> Tables:
        with open(path) as file:
            n = np.array([int(x) for x in re.findall(r"\d+", file.read())])
        if len(n) != 3012 or n.min() < 0 or n.max() > 255:
            raise ValueError("3012 probabilities from 0 to 255 are needed")
        return cls(n[:1056].reshape(4, 8, 3, 11), n[1056:2112].reshape(4, 8, 3, 11), n[2112:].reshape(10, 10, 9))


def _follow(ways: dict, read) -> object:
    """The name whose way is taken, read(node) giving each decision."""
    left, depth = list(ways.items()), 0
    while len(left) > 1 or depth < len(left[0][1]):
        taken = read(left[0][1][depth][0])
        left = [(n, w) for n, w in left if w[depth][1] == taken]
        depth += 1
    return left[0][0]


# transforms ------------------------------------------------------------------------------------------------------------------------------

_SIGNS = np.array([[1 if f._cosine(k, i) > 0 else -1 for i in range(4)] for k in range(4)])


def inverse_dct(c: np.ndarray) -> np.ndarray:
    """Residuals (n, 4, 4) of coefficients (n, 4, 4)."""

    def turn(v: np.ndarray, add: int) -> np.ndarray:
        large, small = (v * f.LARGE >> 16) + v, v * f.SMALL >> 16
        rows = [add + sum(_SIGNS[k, i] * (v[:, k] if k % 2 == 0 else large[:, k] if abs(f._cosine(k, i)) > 0.5 else small[:, k]) for k in range(4)) for i in range(4)]
        return np.stack(rows, axis=1)

    return turn(turn(c, 0).transpose(0, 2, 1), 4).transpose(0, 2, 1) >> 3


def forward_dct(p: np.ndarray) -> np.ndarray:
    """Coefficients (n, 4, 4) of residuals (n, 4, 4)."""

    def turn(v: np.ndarray, passes: tuple, scale: int) -> list[np.ndarray]:
        out = []
        for k, (add, cut) in enumerate(passes):
            w = [scale * _SIGNS[k, i] if k % 2 == 0 else round(4096 * 2**0.5 * f._cosine(k, i)) for i in range(4)]
            out.append(sum(w[i] * v[:, :, i] for i in range(4)) + add >> cut)
        return out

    rows = np.stack(turn(p, f.FIRST_PASS, 8), axis=2)
    down = rows.transpose(0, 2, 1)
    cols = turn(down, f.SECOND_PASS, 1)
    cols[1] = cols[1] + (down[:, :, 0] != down[:, :, 3])
    return np.stack(cols, axis=1)


def inverse_wht(c: np.ndarray) -> np.ndarray:
    return (_SIGNS @ c @ _SIGNS + 3) >> 3


def forward_wht(d: np.ndarray) -> np.ndarray:
    return _SIGNS @ d @ _SIGNS >> 1


# the frame, as decoder and encoder hold it -------------------------------------------------------------------------------------------------


class Frame:
    """Planes with a row above and a column to the left of the picture, as the format has them, and contexts of modes and tokens."""

    def __init__(self, header: vp8.Header) -> None:
        self.h, self.w16, self.h16 = header, -(-header.width // 16), -(-header.height // 16)
        self.planes = []
        for size in (16, 8, 8):
            p = np.full((self.h16 * size + 1, self.w16 * size + 1), 129, np.int64)
            p[0] = 127
            self.planes.append(p)
        self.filters: dict[tuple[int, int], tuple[int, bool, bool]] = {}  # segment, sub-blocks, coefficients of each macroblock
        self.above_modes, self.left_modes = ["dc"] * (4 * self.w16), ["dc"] * 4
        self.above = np.zeros((self.w16, 9), np.int64)  # four of luma, two and two of chroma, one of luma's DCs
        self.left = np.zeros(9, np.int64)

    def predicted(self, plane: int, x: int, y: int, mode: str) -> np.ndarray:
        """A whole block predicted from its edges."""
        size, p = (16 if plane == 0 else 8), self.planes[plane]
        r, c = y * size, x * size
        top, left, corner = p[r, c + 1 : c + 1 + size], p[r + 1 : r + 1 + size, c], p[r, c]
        if mode == "vertical":
            return np.broadcast_to(top, (size, size)).copy()
        if mode == "horizontal":
            return np.broadcast_to(left[:, None], (size, size)).copy()
        if mode == "motion":
            return np.clip(left[:, None] + top[None] - corner, 0, 255)
        known = [e for e, there in ((top, y > 0), (left, x > 0)) if there]
        n = size * len(known)
        return np.full((size, size), (sum(int(e.sum()) for e in known) + n // 2) // n if n else 128)

    def put(self, plane: int, x: int, y: int, block: np.ndarray) -> None:
        size = 16 if plane == 0 else 8
        self.planes[plane][y * size + 1 : y * size + 1 + size, x * size + 1 : x * size + 1 + size] = block

    def sub_edges(self, x: int, y: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Eight samples above sub-block k, four to its left, and the corner. Right of a macroblock's last column stands the row above the
        macroblock, for all its sub-blocks, and beyond the picture that row's last sample."""
        p = self.planes[0]
        r, c = 16 * y + 4 * (k // 4), 16 * x + 4 * (k % 4)
        if k % 4 < 3:
            right = p[r, c + 5 : c + 9]
        elif y and x == self.w16 - 1:
            right = np.full(4, p[16 * y, 16 * x + 16])
        else:
            right = p[16 * y, c + 5 : c + 9] if y else np.full(4, 127)
        return np.concatenate([p[r, c + 1 : c + 5], right]), p[r + 1 : r + 5, c], int(p[r, c])

    def put_sub(self, x: int, y: int, k: int, block: np.ndarray) -> None:
        r, c = 16 * y + 4 * (k // 4) + 1, 16 * x + 4 * (k % 4) + 1
        self.planes[0][r : r + 4, c : c + 4] = block

    def level(self, segment: int, sub_blocks: bool) -> int:
        h = self.h
        level = h.filter_level if not h.segments else h.segment_filters[segment] + (0 if h.absolute else h.filter_level)
        if h.filter_deltas:
            level += h.ref_deltas[0] + (h.mode_deltas[0] if sub_blocks else 0)
        return max(0, min(63, level))

    def finished(self) -> list[np.ndarray]:
        """The planes, filtered, in the picture's size."""
        planes = [p[1:, 1:].copy() for p in self.planes]
        if self.h.filter_level:
            for (y, x), (segment, sub_blocks, coded) in sorted(self.filters.items()):
                if level := self.level(segment, sub_blocks):
                    self._filter(planes, x, y, level, sub_blocks or coded)
        w, h = self.h.width, self.h.height
        return [p[:b, :a].astype(np.uint8) for p, (a, b) in zip(planes, ((w, h), ((w + 1) // 2, (h + 1) // 2), ((w + 1) // 2, (h + 1) // 2)), strict=True)]

    def _filter(self, planes: list[np.ndarray], x: int, y: int, level: int, inside: bool) -> None:
        sharp = self.h.sharpness
        inner = max(1, level if not sharp else min(9 - sharp, level >> (2 if sharp > 4 else 1)))
        high = 2 if level >= 40 else 1 if level >= 15 else 0
        some = planes[:1] if self.h.simple_filter else planes
        for upright in (True, False):
            for p in some:
                size = 16 if p is planes[0] else 8
                view = p if upright else p.T
                line, at = (y, x) if upright else (x, y)
                lines = slice(line * size, line * size + size)
                for k in range(0, size, 4):
                    if (k or at) and (not k or inside):
                        c, border = at * size + k, not k
                        limit = 2 * level + inner + (4 if border else 0)
                        if self.h.simple_filter:
                            view[lines, c - 2 : c + 2] = simple_edge(view[lines, c - 2 : c + 2], limit)
                        else:
                            view[lines, c - 4 : c + 4] = vp8.filtered_edge(view[lines, c - 4 : c + 4], limit, inner, high, border)


def simple_edge(px: np.ndarray, limit: int) -> np.ndarray:
    """The simple loop filter on rows of four samples, two on either side of an edge."""
    p1, p0, q0, q1 = px.T
    step = vp8._wide(vp8._wide(p1 - q1) + 3 * (q0 - p0))
    near = np.abs(p0 - q0) * 2 + (np.abs(p1 - q1) >> 1) <= limit
    out = px.copy()
    out[:, 1] = np.where(near, np.clip(p0 + (vp8._wide(step + 3) >> 3), 0, 255), p0)
    out[:, 2] = np.where(near, np.clip(q0 - (vp8._wide(step + 4) >> 3), 0, 255), q0)
    return out


def _rebuilt(frame: Frame, x: int, y: int, luma: str, chroma: str, subs: list[str], blocks: np.ndarray, step) -> None:
    """Predicts a macroblock and adds its residuals. blocks: 24 blocks of dequantized coefficients; step(k) is called before sub-block k is
    predicted, so that an encoder can choose its mode and coefficients then."""
    if luma == "sub-blocks":
        for k in range(16):
            if step is not None:
                step(k)
            guess = vp8.subblock(subs[k], *frame.sub_edges(x, y, k))
            frame.put_sub(x, y, k, np.clip(guess + inverse_dct(blocks[k][None])[0], 0, 255))
    else:
        residual = inverse_dct(blocks[:16]).reshape(4, 4, 4, 4).transpose(0, 2, 1, 3).reshape(16, 16)
        frame.put(0, x, y, np.clip(frame.predicted(0, x, y, luma) + residual, 0, 255))
    for plane, first in ((1, 16), (2, 20)):
        residual = inverse_dct(blocks[first : first + 4]).reshape(2, 2, 4, 4).transpose(0, 2, 1, 3).reshape(8, 8)
        frame.put(plane, x, y, np.clip(frame.predicted(plane, x, y, chroma) + residual, 0, 255))


#: Of a macroblock's 25 blocks, places of their contexts above and to the left; the last is that of the luma DCs.
_CONTEXTS = [(k % 4, k // 4) for k in range(16)] + [(4 + k % 2, 4 + k // 2) for k in range(4)] + [(6 + k % 2, 6 + k // 2) for k in range(4)] + [(8, 8)]


# decoding ----------------------------------------------------------------------------------------------------------------------------------


def _block(r: vp8.BoolReader, probs: np.ndarray, context: int, first: int, steps: tuple[int, int]) -> tuple[list[int], bool]:
    """Dequantized coefficients of a block in their places, and whether any token but the end was read."""
    out, i = [0] * 16, first
    if not r.bit(probs[BANDS[i]][context][0]):
        return out, False
    while i < 16:
        p = probs[BANDS[i]][context]
        if not r.bit(p[1]):
            i, context = i + 1, 0
            continue
        size = _follow(SIZES, lambda n, p=p: r.bit(p[n]))
        context = 1 if size == 1 else 2
        if size >= 5:
            least, extra = LARGE[size - 5]
            v = 0
            for q in extra:
                v = 2 * v + r.bit(q)
            size = least + v
        out[f.ZIGZAG[i]] = (-size if r.bit() else size) * steps[min(1, i)]
        i += 1
        if i < 16 and not r.bit(probs[BANDS[i]][context][0]):
            break
    return out, i > first


def _partitions(payload: bytes, h: vp8.Header) -> list[vp8.BoolReader]:
    at = 10 + h.partition_size
    sizes = payload[at : at + 3 * (h.partitions - 1)]
    if len(sizes) < 3 * (h.partitions - 1):
        raise short("VP8 ends before its partitions' sizes")
    at += len(sizes)
    out = []
    for k in range(h.partitions):
        n = int.from_bytes(sizes[3 * k : 3 * k + 3], "little") if k < h.partitions - 1 else max(0, len(payload) - at)
        if at + n > len(payload):
            raise short("VP8 ends within a partition")
        out.append(vp8.BoolReader(payload[at : at + n]))
        at += n
    return out


def decode_planes(payload: bytes, tables: Tables) -> list[np.ndarray]:
    """Luma and two half-size chroma planes, of limited range, of a VP8 payload."""
    h, r = vp8.open_header(payload)
    r.bit()  # whether probabilities last beyond this frame
    probs = tables.coefficients.copy()
    for at in np.ndindex(probs.shape):
        if r.bit(int(tables.updates[at])):
            probs[at] = r.number(8)
    probs = probs.tolist()
    modes = tables.modes.tolist()
    skip_prob = r.number(8) if r.bit() else None
    frame, steps, parts = Frame(h), h.matrices(), _partitions(payload, h)
    for y in range(frame.h16):
        tokens = parts[y % h.partitions]
        frame.left[:], frame.left_modes[:] = 0, ["dc"] * 4
        for x in range(frame.w16):
            segment = 0
            if h.update_map:
                segment = 2 + r.bit(h.segment_probs[2]) if r.bit(h.segment_probs[0]) else r.bit(h.segment_probs[1])
            skipped = bool(r.bit(skip_prob)) if skip_prob is not None else False
            luma = _follow(MODE_TREES["luma"], r.bit)
            subs = [IMPLIED.get(luma, "dc")] * 16
            for k in range(16) if luma == "sub-blocks" else ():
                above = frame.above_modes[4 * x + k % 4] if k < 4 else subs[k - 4]
                left = frame.left_modes[k // 4] if k % 4 == 0 else subs[k - 1]
                p = modes[SUB_MODES.index(above)][SUB_MODES.index(left)]
                subs[k] = _follow(SUB_WAYS, lambda n, p=p: r.bit(p[n]))
            frame.above_modes[4 * x : 4 * x + 4], frame.left_modes[:] = subs[12:], subs[3::4]
            chroma = _follow(MODE_TREES["chroma"], r.bit)
            blocks = np.zeros((24, 16), np.int64)
            above, q = frame.above[x], steps[segment]
            if skipped:
                keep = above[8], frame.left[8]
                above[:] = frame.left[:] = 0
                if luma == "sub-blocks":
                    above[8], frame.left[8] = keep
            else:
                kind, first, dcs = WHOLE, 0, None
                if luma != "sub-blocks":
                    dcs, some = _block(tokens, probs[DCS], int(above[8] + frame.left[8]), 0, q["y2"])
                    above[8] = frame.left[8] = some
                    kind, first = AFTER_DC, 1
                for k in range(24):
                    a, b = _CONTEXTS[k]
                    own, some = _block(tokens, probs[kind if k < 16 else CHROMA], int(above[a] + frame.left[b]), first if k < 16 else 0, q["y1" if k < 16 else "uv"])
                    above[a] = frame.left[b] = some
                    blocks[k] = own
                if dcs is not None:
                    blocks[:16, 0] = inverse_wht(np.array(dcs).reshape(4, 4)).ravel()
            frame.filters[y, x] = (segment, luma == "sub-blocks", bool(blocks.any()))
            _rebuilt(frame, x, y, luma, chroma, subs, blocks.reshape(24, 4, 4), None)
        if r.over() or tokens.over():
            raise broken("VP8 data end before the picture does")
    return frame.finished()


def upsampled(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """A chroma plane at full size, by the four samples around each place in about the ratio 9 : 3 : 3 : 1."""
    e = np.pad(plane.astype(np.int64), 1, mode="edge")
    out = np.zeros((2 * plane.shape[0], 2 * plane.shape[1]), np.int64)
    own = e[1:-1, 1:-1]
    for dy in (0, 1):
        for dx in (0, 1):
            across, along = e[1:-1, 2 * dx : e.shape[1] - 2 + 2 * dx], e[2 * dy : e.shape[0] - 2 + 2 * dy, 1:-1]
            corner = e[2 * dy : e.shape[0] - 2 + 2 * dy, 2 * dx : e.shape[1] - 2 + 2 * dx]
            out[dy::2, dx::2] = ((own + corner + 8 + 3 * (across + along) >> 3) + own) >> 1
    return out[:height, :width]


def rgba_of(planes: list[np.ndarray]) -> np.ndarray:
    """(h, w, 4) opaque pixels of limited-range planes."""
    y = planes[0].astype(np.int64)
    u, v = (upsampled(p, y.shape[1], y.shape[0]) for p in planes[1:])
    hi = lambda a, k: a * k >> 8
    r, g, b = hi(y, 19077) + hi(v, 26149) - 14234, hi(y, 19077) - hi(u, 6419) - hi(v, 13320) + 8708, hi(y, 19077) + hi(u, 33050) - 17685
    return np.stack([*(np.clip(c >> 6, 0, 255) for c in (r, g, b)), np.full_like(y, 255)], axis=2).astype(np.uint8)


# encoding ----------------------------------------------------------------------------------------------------------------------------------


def planes_of(px: np.ndarray) -> list[np.ndarray]:
    """Limited-range planes of (h, w, 4) pixels, chroma from the sums of 2 x 2 quads, of whose missing pixels the nearest stand in."""
    c = px[..., :3].astype(np.int64)
    y = (16839 * c[..., 0] + 33059 * c[..., 1] + 6420 * c[..., 2] + 32768 + 1048576) >> 16
    e = np.pad(c, ((0, c.shape[0] % 2), (0, c.shape[1] % 2), (0, 0)), mode="edge")
    r, g, b = (e[0::2, 0::2] + e[0::2, 1::2] + e[1::2, 0::2] + e[1::2, 1::2]).transpose(2, 0, 1)
    half = 131072 + 33554432
    return [y, np.clip((28800 * b - 9719 * r - 19081 * g + half) >> 18, 0, 255), np.clip((28800 * r - 24116 * g - 4684 * b + half) >> 18, 0, 255)]


def base_quantizer(quality: float) -> int:
    part = quality / 100
    linear = part * 2 / 3 if part < 0.75 else 2 * part - 1
    return max(0, min(127, int(127 * (1 - round(linear ** (1 / 3), 12)))))


def _levels(c: np.ndarray, steps: tuple[int, int], first: int = 0) -> np.ndarray:
    """Quantized coefficients (n, 16), each rounded to the nearest level, 2047 at most."""
    q = np.array([steps[0], *[steps[1]] * 15])
    out = np.sign(c) * np.minimum(2047, (np.abs(c) + q // 2) // q)
    out[:, :first] = 0
    return out


def _write_block(w: vp8.BoolWriter, probs: list, context: int, first: int, levels: np.ndarray) -> bool:
    scan = [int(levels[k]) for k in f.ZIGZAG]
    end = max((i + 1 for i in range(first, 16) if scan[i]), default=first)
    i, ask = first, True
    while i < 16:
        p = probs[BANDS[i]][context]
        if ask:
            w.bit(int(i < end), p[0])
            if i >= end:
                break
        size = abs(scan[i])
        w.bit(int(size > 0), p[1])
        i += 1
        context, ask = min(2, size), size > 0
        if size:
            kind = size if size < 5 else 5 + max(k for k, (least, _) in enumerate(LARGE) if least <= size)
            for node, taken in SIZES[kind]:
                w.bit(taken, p[node])
            if kind >= 5:
                least, extra = LARGE[kind - 5]
                for k, q in enumerate(extra):
                    w.bit((size - least) >> (len(extra) - 1 - k) & 1, q)
            w.bit(int(scan[i - 1] < 0))
    return end > first


def encode_planes(planes: list[np.ndarray], tables: Tables, quality: float = 90, sub_blocks: bool = True, filter_level: int | None = None) -> bytes:
    """A VP8 payload of limited-range planes: each macroblock by the modes of least squared error of prediction, the default probabilities.

    sub_blocks: luma may be predicted in sub-blocks, where the best whole prediction errs by more than a step's square a sample."""
    height, width = planes[0].shape
    if not 1 <= width < 1 << 14 or not 1 <= height < 1 << 14:
        raise ValueError("width and height must be from 1 to 16383")
    q = base_quantizer(quality)
    h = vp8.Header(width=width, height=height, quantizer=q, filter_level=(0 if q <= 10 else min(63, (3 * q + 2) // 4)) if filter_level is None else filter_level)
    frame, steps, probs, modes = Frame(h), h.matrices()[0], tables.coefficients.tolist(), tables.modes.tolist()
    full = [np.pad(p.astype(np.int64), ((0, n * frame.h16 - p.shape[0]), (0, n * frame.w16 - p.shape[1])), mode="edge") for p, n in zip(planes, (16, 8, 8), strict=True)]
    head, tokens = vp8.BoolWriter(), vp8.BoolWriter()
    vp8.put_header(head, h)
    head.bit(1)
    for at in np.ndindex(tables.updates.shape):
        head.bit(0, int(tables.updates[at]))
    head.bit(0)
    cut = lambda b, n: b.reshape(n, 4, n, 4).transpose(0, 2, 1, 3).reshape(n * n, 4, 4)
    error = lambda a, b: int(((a - b) ** 2).sum())
    for y in range(frame.h16):
        frame.left[:], frame.left_modes[:] = 0, ["dc"] * 4
        for x in range(frame.w16):
            own = [p[y * n : y * n + n, x * n : x * n + n] for p, n in zip(full, (16, 8, 8), strict=True)]
            luma = min(CHROMA_MODES, key=lambda m: error(own[0], frame.predicted(0, x, y, m)))
            chroma = min(CHROMA_MODES, key=lambda m: sum(error(own[k], frame.predicted(k, x, y, m)) for k in (1, 2)))
            levels, blocks, dcs = np.zeros((24, 16), np.int64), np.zeros((24, 4, 4), np.int64), None
            for k, first in ((1, 16), (2, 20)):
                levels[first : first + 4] = _levels(forward_dct(cut(own[k] - frame.predicted(k, x, y, chroma), 2)).reshape(4, 16), steps["uv"])
            guess = frame.predicted(0, x, y, luma)
            subs = [IMPLIED[luma]] * 16
            source = cut(own[0], 4)

            def choose(k: int, x=x, y=y, subs=subs, source=source, levels=levels, blocks=blocks) -> None:
                edges = frame.sub_edges(x, y, k)
                subs[k] = min(SUB_MODES, key=lambda m: error(source[k], vp8.subblock(m, *edges)))
                levels[k] = _levels(forward_dct((source[k] - vp8.subblock(subs[k], *edges))[None]).reshape(1, 16), steps["y1"])[0]
                blocks[k] = (levels[k] * [steps["y1"][0], *[steps["y1"][1]] * 15]).reshape(4, 4)

            varied = error(own[0], guess)
            if sub_blocks and varied > 256 * steps["y1"][1] ** 2:
                luma = "sub-blocks"
            else:
                coefficients = forward_dct(cut(own[0] - guess, 4)).reshape(16, 16)
                dcs = _levels(forward_wht(coefficients[:, 0].reshape(4, 4)).reshape(1, 16), steps["y2"])[0]
                levels[:16] = _levels(coefficients, steps["y1"], 1)
                blocks[:16] = (levels[:16] * [0, *[steps["y1"][1]] * 15]).reshape(16, 4, 4)
                back = inverse_wht((dcs * [steps["y2"][0], *[steps["y2"][1]] * 15]).reshape(4, 4))
                blocks[:16, 0, 0] = back.ravel()
            blocks[16:] = (levels[16:] * [steps["uv"][0], *[steps["uv"][1]] * 15]).reshape(8, 4, 4)
            _rebuilt(frame, x, y, luma, chroma, subs, blocks, choose)
            frame.filters[y, x] = (0, luma == "sub-blocks", bool(blocks.any()))
            for p, taken in MODE_TREES["luma"][luma]:
                head.bit(taken, p)
            for k in range(16) if luma == "sub-blocks" else ():
                above = frame.above_modes[4 * x + k % 4] if k < 4 else subs[k - 4]
                left = frame.left_modes[k // 4] if k % 4 == 0 else subs[k - 1]
                p = modes[SUB_MODES.index(above)][SUB_MODES.index(left)]
                for node, taken in SUB_WAYS[subs[k]]:
                    head.bit(taken, p[node])
            frame.above_modes[4 * x : 4 * x + 4], frame.left_modes[:] = subs[12:], subs[3::4]
            for p, taken in MODE_TREES["chroma"][chroma]:
                head.bit(taken, p)
            above, kind, first = frame.above[x], WHOLE, 0
            if dcs is not None:
                above[8] = frame.left[8] = _write_block(tokens, probs[DCS], int(above[8] + frame.left[8]), 0, dcs)
                kind, first = AFTER_DC, 1
            for k in range(24):
                a, b = _CONTEXTS[k]
                above[a] = frame.left[b] = _write_block(tokens, probs[kind if k < 16 else CHROMA], int(above[a] + frame.left[b]), first if k < 16 else 0, levels[k])
    body = head.done() + b"\0"
    if len(body) >= 1 << 19:
        raise ValueError("the first partition is too long for this format")
    return vp8.frame_tag(h, len(body)) + body + tokens.done() + b"\0"


def encode(px: np.ndarray, tables: Tables, quality: float = 90, **options) -> bytes:
    """A VP8 payload of opaque (h, w, 4) pixels."""
    if (px[..., 3] != 255).any():
        raise ValueError("lossy frames have no transparency of their own")
    return encode_planes(planes_of(px), tables, quality, **options)
