"""The lossless bitstream, decoded and encoded: one image a call, pixels as a numpy array of packed ARGB.

Bits are read in Python, as each depends on those before it; all else is numpy. Predictions are undone along slanted lines of pixels that
don't depend on each other. The encoder subtracts green, predicts by the cheapest mode of each tile, fits colours to each other, takes
a palette where there are few, finds matches along chains of equal pixels, keeps recent colours in a cache and codes groups of tiles with
length-limited Huffman codes of their own; it keeps the smallest of its candidates.
"""

from __future__ import annotations

import heapq

import numpy as np

from rasterloom.sources.webp import WebpError, broken, short

#: Order in which code length code lengths are stored: fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Extra bits of repeat codes 16 to 18, and the repeats that 0 stands for: fixed values of the format.
REPEAT_BITS, REPEAT_BASE = (2, 3, 7), (3, 3, 11)
MAX_BITS, BLACK = 15, 0xFF000000


def _near() -> tuple[tuple[int, int], ...]:
    """(x, y) of the 120 short distance codes: places up to 8 to the left, 7 to the right and 7 rows up, nearest first; of equally
    near ones the higher rows first, and left before right."""
    at = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return tuple(sorted(at, key=lambda p: (p[0] * p[0] + p[1] * p[1], -p[1], p[0] < 0)))


NEAR = _near()
_CODE_OF = {p: k + 1 for k, p in enumerate(NEAR)}


def code_to_distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def distance_to_code(distance: int, width: int) -> int:
    y, x = divmod(distance, width)
    if x <= 8 and (x, y) in _CODE_OF:
        return _CODE_OF[x, y]
    if (x - width, y + 1) in _CODE_OF and x - width > -8:
        return _CODE_OF[x - width, y + 1]
    return distance + 120


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def need(self, k: int) -> None:
        while self.n < k:
            if self.at + 8 <= len(self.data):
                self.acc |= int.from_bytes(self.data[self.at : self.at + 8], "little") << self.n
                self.at += 8
                self.n += 64
            elif self.at < len(self.data) + 8:  # zeros behind the end, noticed by check()
                self.acc |= (self.data[self.at] if self.at < len(self.data) else 0) << self.n
                self.at += 1
                self.n += 8
            else:
                raise short("VP8L bits")

    def read(self, k: int) -> int:
        self.need(k)
        v = self.acc & ((1 << k) - 1)
        self.acc >>= k
        self.n -= k
        return v

    def check(self) -> None:
        if self.at * 8 - self.n > len(self.data) * 8:
            raise short("VP8L bits")


class Code:
    """A canonical prefix code as a table over the next bits."""

    def __init__(self, lengths: list[int]) -> None:
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            raise broken("empty prefix code")
        if len(used) == 1:
            self.bits, self.table = 0, [(0, used[0][1])]
            return
        if sum(1 << (MAX_BITS - n) for n, _ in used) != 1 << MAX_BITS:
            raise broken("prefix code is not complete")
        self.bits = max(used)[0]
        self.table = [(0, 0)] * (1 << self.bits)
        for s, (value, n) in canonical(lengths).items():
            for k in range(value, 1 << self.bits, 1 << n):
                self.table[k] = (n, s)

    def read(self, r: Reader) -> int:
        r.need(self.bits)
        n, s = self.table[r.acc & ((1 << self.bits) - 1)]
        r.acc >>= n
        r.n -= n
        return s


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol, bits as they are stored, the first one lowest."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


def _read_lengths(r: Reader, size: int) -> list[int]:
    lengths = [0] * size
    if r.read(1):
        n, wide = r.read(1) + 1, r.read(1)
        for k in range(n):
            s = r.read(8 if k or wide else 1)
            if s >= size:
                raise broken("symbol beyond its alphabet")
            lengths[s] = 1
        return lengths
    own = [0] * 19
    for k in range(r.read(4) + 4):
        own[LENGTH_ORDER[k]] = r.read(3)
    left = r.read(2 + 2 * r.read(3)) + 2 if r.read(1) else size
    if left > size:
        raise broken("too many code lengths")
    code, at, last = Code(own), 0, 8
    while at < size and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
            continue
        n = r.read(REPEAT_BITS[s - 16]) + REPEAT_BASE[s - 16]
        if at + n > size:
            raise broken("code lengths run over")
        lengths[at : at + n] = [last if s == 16 else 0] * n
        at += n
    r.check()
    return lengths


def _prefix_value(r: Reader, s: int) -> int:
    """The length or distance of a prefix symbol."""
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + r.read(extra) + 1


def _stream(r: Reader, width: int, height: int, top: bool) -> list[int]:
    """Pixels of an entropy-coded image; top: one that may have several groups of codes."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise broken("colour cache is too large")
    groups, tile, meta, across = 1, 0, None, 1
    if top and r.read(1):
        tile = r.read(3) + 2
        across = -(-width // (1 << tile))
        meta = [p >> 8 & 0xFFFF for p in _stream(r, across, -(-height // (1 << tile)), False)]
        groups = max(meta) + 1
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[Code(_read_lengths(r, n)) for n in sizes] for _ in range(groups)]
    tables = [[(c.table, (1 << c.bits) - 1) for c in g] for g in codes]
    out: list[int] = []
    cache, kept, total, length = [0] * (1 << cache_bits), 0, width * height, 0
    data, at, acc, n = r.data, r.at, r.acc, r.n  # reads are written out, as calls would cost more than they do
    end = len(data) + 8
    (t0, m0), (t1, m1), (t2, m2), (t3, m3), _ = tables[0]
    while length < total:
        if n < 64:
            if at > end:
                raise short("VP8L bits")
            acc |= int.from_bytes(data[at : at + 8], "little") << n
            at += 8
            n += 64
        if meta:
            (t0, m0), (t1, m1), (t2, m2), (t3, m3), _ = tables[meta[(length // width >> tile) * across + (length % width >> tile)]]
        k, s = t0[acc & m0]
        acc >>= k
        if s < 256:
            k1, red = t1[acc & m1]
            acc >>= k1
            k2, blue = t2[acc & m2]
            acc >>= k2
            k3, alpha = t3[acc & m3]
            acc >>= k3
            n -= k + k1 + k2 + k3
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
            length += 1
        elif s < 280:
            r.at, r.acc, r.n = at, acc, n - k
            g = codes[meta[(length // width >> tile) * across + (length % width >> tile)]] if meta else codes[0]
            run = _prefix_value(r, s - 256)
            d = code_to_distance(_prefix_value(r, g[4].read(r)), width)
            at, acc, n = r.at, r.acc, r.n
            if d > length or length + run > total:
                raise broken("match runs over")
            piece = out[length - d : length - d + run]
            out += (piece * (run // d + 1))[:run] if d < run else piece
            length += run
        else:
            n -= k
            for p in out[kept:length]:
                cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            kept = length
            out.append(cache[s - 280])
            length += 1
    r.at, r.acc, r.n = at, acc, n
    r.check()
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) of a, r, g, b as int64."""
    return (argb[..., None].astype(np.int64) >> np.array([24, 16, 8, 0])) & 255


def _joined(c: np.ndarray) -> np.ndarray:
    return ((c & 255) << np.array([24, 16, 8, 0])).sum(axis=-1)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _modes(left: np.ndarray, top: np.ndarray, tl: np.ndarray, tr: np.ndarray, wanted=range(14)) -> np.ndarray:
    """(len(wanted), ..., 4): what each mode wanted predicts from the neighbours, (..., 4) each."""

    def mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + b) >> 1

    def nearer() -> np.ndarray:
        less = np.abs(left - tl).sum(axis=-1) <= np.abs(top - tl).sum(axis=-1)
        return np.where(less[..., None], top, left)

    def bent() -> np.ndarray:
        base = mean(left, top)
        off = base - tl
        return np.clip(base + np.where(off < 0, -(-off // 2), off // 2), 0, 255)

    each = (
        lambda: np.broadcast_to(np.array([255, 0, 0, 0], left.dtype), left.shape), lambda: left, lambda: top, lambda: tr, lambda: tl,
        lambda: mean(mean(left, tr), top), lambda: mean(left, tl), lambda: mean(left, top), lambda: mean(tl, top), lambda: mean(top, tr),
        lambda: mean(mean(left, tl), mean(top, tr)), nearer, lambda: np.clip(left + top - tl, 0, 255), bent,
    )
    return np.stack([each[m]() for m in wanted])


def predictions(c: np.ndarray) -> np.ndarray:
    """(14, h, w, 4): what each mode predicts from the neighbours in c, (h, w, 4), itself."""
    h, w, _ = c.shape
    flat = np.concatenate([np.zeros((w + 1, 4), c.dtype), c.reshape(-1, 4)])
    at = lambda back: flat[w + 1 - back : w + 1 - back + h * w].reshape(h, w, 4)
    left, top, tl, tr = at(1), at(w), at(w + 1), at(w - 1) if w > 1 else at(0)
    out = _modes(left, top, tl, tr)
    out[:, 0], out[:, :, 0] = left[0], top[:, 0]
    out[:, 0, 0] = [255, 0, 0, 0]
    return out


def _undo_prediction(argb: np.ndarray, modes: list[int], bits: int, width: int, height: int) -> np.ndarray:
    """Pixels (x, y) of one x + 2 y need only such of lesser ones, the right one above being one less; so these are done at once."""
    across = -(-width // (1 << bits))
    tiles = (np.array(modes, np.int64) >> 8 & 15).reshape(-1, across)
    mode = np.repeat(np.repeat(tiles, 1 << bits, 0), 1 << bits, 1)[:height, :width].copy()
    mode[mode > 13] = 0
    mode[0], mode[:, 0], mode[0, 0] = 1, 2, 0
    wanted, mode = np.unique(mode, return_inverse=True)
    mode, wanted = mode.ravel(), wanted.tolist()
    c = np.zeros(((height + 1) * width + 1, 4), np.int16)
    c[width + 1 :] = _channels(argb)
    for t in range(width + 2 * height - 2):
        y = np.arange(max(0, (t - width + 2) // 2), min(height - 1, t // 2) + 1)
        i = t + y * (width - 2)
        here = i + width + 1
        guess = _modes(c[here - 1], c[here - width], c[here - width - 1], c[here - width + 1], wanted)
        c[here] = (c[here] + guess[mode[i], np.arange(len(i))]) & 255
    return _joined(c[width + 1 :].astype(np.int64))


def _undo_cross(argb: np.ndarray, tiles: list[int], bits: int, width: int, height: int) -> np.ndarray:
    across = -(-width // (1 << bits))
    y, x = np.divmod(np.arange(width * height), width)
    t = np.array(tiles, np.int64)[(y >> bits) * across + (x >> bits)]
    c = _channels(argb)
    delta = lambda shift, v: (_signed(t >> shift) * _signed(v)) >> 5
    c[:, 1] = (c[:, 1] + delta(0, c[:, 2])) & 255
    c[:, 3] = (c[:, 3] + delta(8, c[:, 2]) + delta(16, c[:, 1])) & 255
    return _joined(c)


def decode_stream(data: bytes, width: int, height: int) -> np.ndarray:
    """(h, w) packed ARGB of a stream without its frame header, as alpha planes have it."""
    return _decode(Reader(data), width, height)


def _decode(r: Reader, width: int, height: int) -> np.ndarray:
    steps, seen, wide = [], set(), width
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise broken("transform given twice")
        seen.add(kind)
        if kind == 2:
            steps.append((kind, 0, [], wide))
        elif kind == 3:
            n = r.read(8) + 1
            colours = np.cumsum(_channels(np.array(_stream(r, n, 1, False))), axis=0)
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, bits, _joined(colours).tolist(), wide))
            wide = -(-wide // (1 << bits))
        else:
            bits = r.read(3) + 2
            steps.append((kind, bits, _stream(r, -(-wide // (1 << bits)), -(-height // (1 << bits)), False), wide))
    argb = np.array(_stream(r, wide, height, True), np.int64)
    for kind, bits, own, wide in reversed(steps):
        if kind == 0:
            argb = _undo_prediction(argb, own, bits, wide, height)
        elif kind == 1:
            argb = _undo_cross(argb, own, bits, wide, height)
        elif kind == 2:
            c = _channels(argb)
            c[:, [1, 3]] += c[:, [2]]
            argb = _joined(c)
        else:
            depth = 8 >> bits
            x = np.arange(wide)
            packed = (argb.reshape(height, -1) >> 8 & 255)[:, x >> bits]
            index = packed >> ((x & ((1 << bits) - 1)) * depth) & ((1 << depth) - 1)
            argb = np.append(np.array(own, np.int64), np.zeros(256, np.int64))[index].ravel()
    return argb.reshape(height, width)


def decode(payload: bytes) -> np.ndarray:
    """(h, w) packed ARGB of a VP8L payload."""
    from rasterloom.sources.webp import image_size

    width, height, has_alpha = image_size(b"VP8L", payload)
    try:
        out = _decode(Reader(payload[5:]), width, height)
    except IndexError as e:
        raise broken("symbol beyond its table") from e
    return out if has_alpha else out | BLACK


# encoding ------------------------------------------------------------------------------------------------------------------------------------


class Writer:
    def __init__(self) -> None:
        self.acc, self.n = 0, 0
        self.parts: list[bytes] = []

    def put(self, value: int, bits: int) -> None:
        self.acc |= value << self.n
        self.n += bits
        if self.n >= 4096:
            k = self.n // 8
            self.parts.append((self.acc & ((1 << 8 * k) - 1)).to_bytes(k, "little"))
            self.acc >>= 8 * k
            self.n -= 8 * k

    def put_all(self, values: np.ndarray, bits: np.ndarray) -> None:
        for k in range(0, len(bits), 1 << 18):  # a bounded number at once, each bit being a byte here
            v, n = values[k : k + (1 << 18)], bits[k : k + (1 << 18)]
            ends = np.cumsum(n)
            place = np.arange(ends[-1]) - np.repeat(ends - n, n)
            flags = (np.repeat(v, n) >> place & 1).astype(np.uint8)
            self.put(int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little"), int(ends[-1]))

    def done(self) -> bytes:
        return b"".join(self.parts) + self.acc.to_bytes(-(-self.n // 8), "little")


def code_lengths(counts: list[int], most: int = MAX_BITS) -> list[int]:
    """Huffman code lengths of at most most bits: small counts are raised until the tree is flat enough."""
    used = [s for s, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            out[s] = 1
        return out
    floor = 1
    while True:
        heap = [(max(counts[s], floor), k, (s,)) for k, s in enumerate(used)]
        heapq.heapify(heap)
        depth, k = dict.fromkeys(used, 0), len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
            k += 1
        if max(depth.values()) <= most:
            for s, n in depth.items():
                out[s] = n
            return out
        floor *= 2


def _put_code(w: Writer, counts: list[int]) -> dict[int, tuple[int, int]]:
    """Writes a code for the counts; its (bits, length) by symbol."""
    used = [s for s, n in enumerate(counts) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(int(used[0] > 1), 1)
        w.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
            return {used[0]: (0, 1), used[1]: (1, 1)}
        return {used[0]: (0, 0)}
    lengths = code_lengths(counts)
    while lengths[-1] == 0 and len(lengths) > 1 and sum(map(bool, lengths)) > 1:
        lengths.pop()
    tokens, k, last = [], 0, 8
    while k < len(lengths):
        v, run = lengths[k], 1
        while k + run < len(lengths) and lengths[k + run] == v:
            run += 1
        k += run
        if v and v != last:
            tokens.append((v, 0, 0))
            run, last = run - 1, v
        while run >= 3:
            if v:
                n = min(6, run)
                tokens.append((16, n - 3, 2))
            elif run <= 10:
                n = run
                tokens.append((17, n - 3, 3))
            else:
                n = min(138, run)
                tokens.append((18, n - 11, 7))
            run -= n
        tokens += [(v, 0, 0)] * run
    own = [0] * 19
    for t in tokens:
        own[t[0]] += 1
    if sum(map(bool, own)) == 1:  # one symbol alone would be read without bits by others and with one here
        own[0 if not own[0] else 1] += 1
    own = code_lengths(own, 7)
    stored = max(4, *(k + 1 for k, s in enumerate(LENGTH_ORDER) if own[s]))
    w.put(0, 1)
    w.put(stored - 4, 4)
    for s in LENGTH_ORDER[:stored]:
        w.put(own[s], 3)
    if len(tokens) == len(counts) or len(tokens) < 2:
        w.put(0, 1)
        tokens += [(0, 0, 0)] * 0
    else:
        bits = max(2, (len(tokens) - 2).bit_length())
        bits += bits & 1
        w.put(1, 1)
        w.put((bits - 2) // 2, 3)
        w.put(len(tokens) - 2, bits)
    code = canonical(own)
    for s, extra, n in tokens:
        w.put(*code[s])
        w.put(extra, n)
    return {s: c for s, c in canonical(lengths).items()} if len(used) > 1 else {used[0]: (0, 0)}


def _prefix(v: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their value) of a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    high = v.bit_length() - 1
    return 2 * high + (v >> (high - 1) & 1), high - 1, v & ((1 << (high - 1)) - 1)


#: Places a chain is followed for, by effort.
CHAINS = (0, 4, 8, 8, 16, 16, 24, 32, 48, 64)
#: Farthest and longest matches: what the largest distance and length codes can say.
FAR, LONG = (1 << 20) - 120, 4096


def _alike(raw: bytes, p: int, i: int, most: int) -> int:
    """How many pixels, up to most, are the same from p and from i on: in steps that double, and halve from the first difference on."""
    k, step, met = 0, 4, False
    while k < most:
        n = min(step, most - k)
        if raw[4 * (p + k) : 4 * (p + k + n)] == raw[4 * (i + k) : 4 * (i + k + n)]:
            k += n
            step = max(1, step >> 1) if met else 2 * step
        elif n == 1:
            break
        else:
            met, step = True, n >> 1
    return k


def _matches(argb: np.ndarray, width: int, chain: int, lazy: bool) -> np.ndarray:
    """(start, length, distance) of matches, found along chains of places whose three pixels are the same, chain places at most, and in
    the row above; lazy: a match gives way to a longer one that begins a pixel later."""
    n = len(argb)
    if not chain or n < 4:
        return np.zeros((0, 3), np.int64)
    key = ((argb[:-2] * 0x9E3779B1) ^ argb[1:-1]) * 0x85EBCA6B ^ argb[2:]  # equal keys of other pixels are found out when compared
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    back, raw, px = before.tolist(), argb.astype("<u4").tobytes(), argb.tolist()

    def longest(i: int) -> tuple[int, int]:
        most, k, d = min(LONG, n - i), 0, 0
        if width <= i and width <= FAR and px[i - width] == px[i]:
            k, d = _alike(raw, i - width, i, most), width
        p = back[i]
        for _ in range(chain):
            if p < 0 or i - p > FAR or k >= min(most, 1024):
                break
            if px[p + k] == px[i + k]:  # else it can't be longer
                own = _alike(raw, p, i, most)
                if own > k:
                    k, d = own, i - p
            p = back[p]
        return k, d

    out, done, ahead = [], 0, (-1, (0, 0))
    for i in np.flatnonzero(before >= 0).tolist():
        if i < done:
            continue
        k, d = ahead[1] if ahead[0] == i else longest(i)
        if k < 3:
            continue
        if lazy and k < 16 and back[i + 1] >= 0:
            ahead = i + 1, longest(i + 1)
            if ahead[1][0] > k + 1:
                continue
        out.append((i, k, d))
        done = i + k
    return np.array(out, np.int64).reshape(-1, 3)


def _cached(argb: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each pixel: its place in a cache of so many bits, and whether it is there already, put by the pixels before it."""
    place = ((argb * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - bits)).astype(np.uint16)
    order = np.argsort(place, kind="stable")
    there = np.zeros(len(argb), bool)
    there[order[1:]] = argb[order[1:]] == argb[order[:-1]]  # the same colour has the same place
    return place.astype(np.int64), there


def _bits_of(counts: np.ndarray) -> np.ndarray:
    """Estimated bits of symbols so often used and of their code, by the last axis."""
    n = counts.astype(np.float64)
    total, used = n.sum(axis=-1), (counts > 0).sum(axis=-1)
    code = np.where(used > 2, 50 + 5 * used, 12)
    return total * np.log2(np.maximum(total, 1)) - (n * np.log2(np.maximum(n, 1))).sum(axis=-1) + code


def _best_cache(argb: np.ndarray, lone: np.ndarray) -> int:
    """The cache size that makes the lone pixels cheapest, 0 for none; no more bits than there are colours for."""
    own = argb[lone]
    green, others = own >> 8 & 255, [own >> 16 & 255, own & 255, own >> 24 & 255]
    best, out = sum(float(_bits_of(np.bincount(x, minlength=256))) for x in (green, *others)), 0
    for bits in range(1, min(10, max(1, (len(np.unique(own)) - 1).bit_length())) + 1):
        place, there = (x[lone] for x in _cached(argb, bits))
        cost = float(_bits_of(np.concatenate([np.bincount(green[~there], minlength=256), np.bincount(place[there], minlength=1 << bits)])))
        cost += sum(float(_bits_of(np.bincount(x[~there], minlength=256))) for x in others)
        if cost < best:
            best, out = cost, bits
    return out


def _code_groups(tile: np.ndarray, symbols: np.ndarray, tiles: int, base: list[int]) -> np.ndarray | None:
    """Of each tile the group whose codes it is written with; None where one group is as cheap.

    Tiles start in up to eight groups by what a symbol of theirs costs with common codes; then each goes to the group whose codes make
    it cheapest, a few times; then the two groups that gain most by being one become one, as long as any do."""
    size = base[-1]
    rows, cols = np.nonzero(symbols >= 0)
    hist = np.bincount(tile[rows] * size + symbols[rows, cols], minlength=tiles * size).reshape(tiles, size)
    parts = [slice(a, b) for a, b in zip(base[:-1], base[1:], strict=True)]
    price = lambda h: np.concatenate([-np.log2((h[..., p] + 0.1) / (h[..., p] + 0.1).sum(axis=-1, keepdims=True)) for p in parts], axis=-1)
    cost = lambda h: sum(_bits_of(h[..., p]) for p in parts)
    summed = lambda of: np.stack([hist[of == g].sum(axis=0) for g in np.unique(of)])
    each = hist @ price(hist.sum(axis=0)) / np.maximum(hist.sum(axis=1), 1)
    groups = min(8, tiles)
    of = np.empty(tiles, np.int64)
    of[np.argsort(each, kind="stable")] = np.arange(tiles) * groups // tiles
    for _ in range(4):
        of = np.argmin(hist @ price(summed(of)).T, axis=1)
    of = np.unique(of, return_inverse=True)[1]
    while (h := summed(of)).shape[0] > 1:
        own = cost(h)
        gains = {(a, b): own[a] + own[b] - float(cost(h[a] + h[b])) for b in range(len(h)) for a in range(b)}
        a, b = max(gains, key=gains.get)
        if gains[a, b] <= 0:
            break
        of = np.unique(np.where(of == b, a, of), return_inverse=True)[1]
    return of if len(h) > 1 and own.sum() + 2 * tiles + 200 < float(cost(hist.sum(axis=0))) else None


def _each(f, values: np.ndarray) -> np.ndarray:
    """f's results, three numbers each, worked out once a distinct value."""
    own, at = np.unique(values, return_inverse=True)
    return np.array([f(v) for v in own.tolist()], np.int64).reshape(-1, 3)[at]


def _put_stream(w: Writer, argb, width: int, top: bool, effort: int) -> None:
    argb = np.asarray(argb, np.int64)
    found = _matches(argb, width, CHAINS[effort], effort >= 5)
    begins, depth = np.zeros(len(argb), bool), np.zeros(len(argb) + 1, np.int64)
    begins[found[:, 0]] = True
    depth[found[:, 0]] += 1
    np.subtract.at(depth, found[:, 0] + found[:, 1], 1)
    lone = np.cumsum(depth)[:-1] == 0
    starts = np.flatnonzero(lone | begins)
    match = begins[starts]
    cache = _best_cache(argb, lone) if top and effort >= 3 else 0
    sizes = (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)
    base = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    # four codes a token at most: of a symbol, or where that is -1, of so many bits as they are
    symbols, plain, wide = np.full((len(starts), 4), -1), np.zeros((len(starts), 4), np.int64), np.zeros((len(starts), 4), np.int64)
    p = argb[starts[~match]]
    symbols[~match] = np.stack([p >> 8 & 255, base[1] + (p >> 16 & 255), base[2] + (p & 255), base[3] + (p >> 24 & 255)], axis=1)
    if cache:
        place, there = (x[starts] for x in _cached(argb, cache))
        symbols[there & ~match] = -1
        symbols[there & ~match, 0] = 280 + place[there & ~match]
    a, b = _each(_prefix, found[:, 1]), _each(lambda d: _prefix(distance_to_code(d, width)), found[:, 2])
    symbols[match, 0], wide[match, 1], plain[match, 1] = 256 + a[:, 0], a[:, 1], a[:, 2]
    symbols[match, 2], wide[match, 3], plain[match, 3] = base[4] + b[:, 0], b[:, 1], b[:, 2]
    w.put(int(cache > 0), 1)
    if cache:
        w.put(cache, 4)
    group, of = np.zeros(len(starts), np.int64), None
    if top:
        height, bits = len(argb) // width, 4
        while -(-width >> bits) * -(-height >> bits) > 1024:
            bits += 1
        across = -(-width >> bits)
        tile = (starts // width >> bits) * across + (starts % width >> bits)
        of = _code_groups(tile, symbols, across * -(-height >> bits), base) if effort >= 4 and bits <= 9 else None
        w.put(int(of is not None), 1)
        if of is not None:
            w.put(bits - 2, 3)
            _put_stream(w, BLACK | of << 8, across, False, effort)
            group = of[tile]
    n_groups = 1 if of is None else int(of.max()) + 1
    value, length = np.zeros((n_groups, base[-1]), np.int64), np.zeros((n_groups, base[-1]), np.int64)
    for g in range(n_groups):
        used = symbols[group == g]
        counts = np.bincount(used[used >= 0], minlength=base[-1])
        for begin, end in zip(base[:-1], base[1:], strict=True):
            for s, (v, n) in _put_code(w, counts[begin:end].tolist()).items():
                value[g, begin + s], length[g, begin + s] = v, n
    coded = symbols >= 0
    g, s = np.broadcast_to(group[:, None], symbols.shape)[coded], symbols[coded]
    plain[coded], wide[coded] = value[g, s], length[g, s]
    w.put_all(plain.ravel(), wide.ravel())


def _entropy(c: np.ndarray) -> float:
    total = 0.0
    for k in range(4):
        n = np.bincount((c[..., k] & 255).ravel(), minlength=256)
        n = n[n > 0]
        total += float((n * np.log2(n.sum() / n)).sum())
    return total


def _by_tile(x: np.ndarray, bits: int) -> np.ndarray:
    """Sums over tiles of the last two axes."""
    h, w = x.shape[-2:]
    th, tw, side = -(-h // (1 << bits)), -(-w // (1 << bits)), 1 << bits
    padded = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(0, th * side - h), (0, tw * side - w)])
    return padded.reshape(*x.shape[:-2], th, side, tw, side).sum(axis=(-3, -1))


def _to_pixels(x: np.ndarray, bits: int, h: int, w: int) -> np.ndarray:
    return np.repeat(np.repeat(x, 1 << bits, 0), 1 << bits, 1)[:h, :w]


def _cross(c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each tile's multipliers, as pixels, and what they leave: red fitted to green, blue to green and red at once, by least squares."""
    red, green, blue = (_signed(c[..., k]) for k in (1, 2, 3))
    gg, gr, rr, gb, rb = _by_tile(np.stack([green * green, green * red, red * red, green * blue, red * blue]), bits).astype(np.float64)
    det = gg * rr - gr * gr
    solved = lambda x, y: np.divide(x, y, out=np.zeros_like(x), where=y != 0)
    alone = solved(gb, gg)
    fits = solved(gr, gg), np.where(det == 0, alone, solved(gb * rr - rb * gr, det)), solved(rb * gg - gb * gr, det)
    m = [np.clip(np.rint(32 * x), -128, 127).astype(np.int64) for x in fits]
    to_red, to_blue, red_to_blue = (_to_pixels(x, bits, *red.shape) for x in m)
    rest = c.copy()
    rest[..., 1] -= (to_red * green) >> 5
    rest[..., 3] -= ((to_blue * green) >> 5) + ((red_to_blue * red) >> 5)
    return BLACK | (m[2] & 255) << 16 | (m[1] & 255) << 8 | (m[0] & 255), rest & 255


def _plans(argb: np.ndarray, effort: int) -> list[tuple[float, list, np.ndarray]]:
    """(estimated bits, transforms, pixels) of the candidates; a transform is (kind, bits, its image or None)."""
    own = _channels(argb)
    green = own.copy()
    green[..., [1, 3]] -= green[..., [2]]
    green &= 255
    out = [(_entropy(own), [], own)]
    if effort >= 1 and not np.array_equal(own, green):
        out.append((_entropy(green), [(2, 0, None)], green))
    if effort >= 2:
        bits = 4
        for steps, c in [(list(x[1]), x[2]) for x in out]:
            guess = predictions(c.astype(np.int16))
            off = np.abs(c.astype(np.int16) - guess)
            cost = np.minimum(off, 256 - off).sum(axis=3)
            mode = _by_tile(cost, bits).argmin(axis=0)
            rest = (c - np.take_along_axis(guess, _to_pixels(mode, bits, *argb.shape)[None, :, :, None], 0)[0]) & 255
            image = (BLACK | mode << 8).ravel()
            out.append((_entropy(rest) + 4.0 * mode.size, [*steps, (0, bits, image)], rest))
    if effort >= 3:
        for steps, c in [(list(x[1]), x[2]) for x in out if all(t[0] != 2 for t in x[1])]:
            image, rest = _cross(c, 5)
            out.append((_entropy(rest) + 12.0 * image.size, [*steps, (1, 5, image.ravel())], rest))
    return sorted(out, key=lambda x: x[0])


def encode(argb: np.ndarray, effort: int = 6) -> bytes:
    """The VP8L payload of (h, w) packed ARGB."""
    if not 0 <= effort <= 9:
        raise WebpError("invalid_param", "effort must be from 0 to 9")
    h, w = argb.shape
    if not 1 <= w <= 16384 or not 1 <= h <= 16384:
        raise WebpError("invalid_param", "image dimensions must be from 1 to 16384")
    argb = argb.astype(np.int64)
    has_alpha = bool((argb >> 24 != 255).any())
    head = b"\x2f" + (w - 1 | (h - 1) << 14 | has_alpha << 28).to_bytes(4, "little")
    done = []
    colours = np.unique(argb)
    if len(colours) <= 256:
        out, n = Writer(), len(colours)
        out.put(1, 1)
        out.put(3, 2)
        out.put(n - 1, 8)
        steps = _channels(colours)
        _put_stream(out, _joined(np.diff(steps, axis=0, prepend=0)), n, False, 0)
        bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        wide = -(-w // (1 << bits))
        index = np.pad(np.searchsorted(colours, argb), ((0, 0), (0, (wide << bits) - w))).reshape(h, wide, 1 << bits)
        packed = (index << (np.arange(1 << bits) * (8 >> bits))).sum(axis=2)
        out.put(0, 1)
        _put_stream(out, (BLACK | packed << 8).ravel(), wide, True, effort)
        done.append(out.done())
    plans = _plans(argb, min(effort, 3))
    best = plans[0][0]
    for cost, steps, c in plans[: 1 + (effort >= 3)]:
        if done and cost * 100 >= best * 101 and cost != best:
            break
        out = Writer()
        for kind, bits, image in steps:
            out.put(1, 1)
            out.put(kind, 2)
            if image is not None:
                out.put(bits - 2, 3)
                _put_stream(out, image, -(-w // (1 << bits)), False, effort)
        out.put(0, 1)
        _put_stream(out, _joined(c).ravel(), w, True, effort)
        done.append(out.done())
    return head + min(done, key=len)
