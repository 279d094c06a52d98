import itertools
import random

import numpy as np
import pytest

from rasterloom.functions import vp8
from rasterloom.sources import webp


def test_boolean_coder():
    r = random.Random(2)
    for n in (0, 1, 7, 200, 3000):
        told = [(int(r.random() < 0.3), r.randint(1, 255)) for _ in range(n)]
        w = vp8.BoolWriter()
        for v, p in told:
            w.bit(v, p)
        back = vp8.BoolReader(w.done())
        assert [back.bit(p) for _, p in told] == [v for v, _ in told]


def test_skewed_decisions_cost_little():
    w = vp8.BoolWriter()
    for _ in range(8000):
        w.bit(0, 254)
    assert len(w.done()) < 20


def test_headers():
    r = random.Random(3)
    for _ in range(50):
        h = vp8.Header(
            r.randint(1, 16383), r.randint(1, 16383), r.randint(0, 3), 0, 0, r.randint(0, 1), r.random() < 0.6, r.random() < 0.5, r.random() < 0.5, [r.randint(-127, 127) for _ in range(4)], [r.randint(-63, 63) for _ in range(4)],
            [r.randint(0, 255) for _ in range(3)], r.random() < 0.5, r.randint(0, 63), r.randint(0, 7), r.random() < 0.5, [r.randint(-63, 63) for _ in range(4)], [r.randint(-63, 63) for _ in range(4)], 1 << r.randint(0, 3), r.randint(0, 127), [r.randint(-15, 15) for _ in range(5)],
        )
        if not h.segments:
            h.update_map = h.absolute = False
            h.segment_quantizers, h.segment_filters = [0] * 4, [0] * 4
        if not h.update_map:
            h.segment_probs = [255] * 3
        if not h.filter_deltas:
            h.ref_deltas, h.mode_deltas = [0] * 4, [0] * 4
        got = vp8.read_header(vp8.write_header(h))
        h.partition_size = got.partition_size
        assert got == h
        assert all(m["y2"][1] >= 8 for m in got.matrices())
    data = webp.wrapped(b"VP8 ", vp8.write_header(h), h.width, h.height)
    f = webp.features(data)
    assert (f.width, f.height, f.format) == (h.width, h.height, "lossy")
    for bad in (data[:20], data[:25]):
        with pytest.raises(webp.WebpError):
            webp.features(bad)


def slow(mode, a, l, c):
    """The formats' own formulas, sample by sample, over the edge from l[3] up to the corner and along a."""
    e = [*l[::-1], c, *a]
    avg2 = lambda i, j: (e[i] + e[j] + 1) >> 1
    avg3 = lambda i: (e[i - 1] + 2 * e[i] + e[i + 1] + 2) >> 2
    out = {}
    if mode == "rd":
        out = {(y, x): avg3(4 - y + x) for y in range(4) for x in range(4)}
    if mode == "vr":
        for (y, x), v in {(3, 0): avg3(2), (2, 0): avg3(3), (1, 0): avg3(4), (0, 0): avg2(4, 5), (1, 1): avg3(5), (0, 1): avg2(5, 6), (1, 2): avg3(6), (0, 2): avg2(6, 7), (1, 3): avg3(7), (0, 3): avg2(7, 8)}.items():
            out[y, x] = v
        for y, x in ((3, 1), (2, 1), (3, 2), (2, 2), (3, 3), (2, 3)):
            out[y, x] = out[y - 2, x - 1]
    if mode == "hd":
        for (y, x), v in {(3, 0): avg2(0, 1), (3, 1): avg3(1), (2, 0): avg2(1, 2), (2, 1): avg3(2), (1, 0): avg2(2, 3), (1, 1): avg3(3), (0, 0): avg2(3, 4), (0, 1): avg3(4), (0, 2): avg3(5), (0, 3): avg3(6)}.items():
            out[y, x] = v
        for y, x in ((3, 2), (3, 3), (2, 2), (2, 3), (1, 2), (1, 3)):
            out[y, x] = out[y - 1, x - 2]
    if mode == "ld":
        ext = [*a, a[7]]
        out = {(y, x): (ext[x + y] + 2 * ext[x + y + 1] + ext[x + y + 2] + 2) >> 2 for y in range(4) for x in range(4)}
    if mode == "vl":
        f2, f3 = (lambda i: (a[i] + a[i + 1] + 1) >> 1), (lambda i: (a[i] + 2 * a[i + 1] + a[i + 2] + 2) >> 2)
        out = {(0, 0): f2(0), (1, 0): f3(0), (0, 1): f2(1), (2, 0): f2(1), (1, 1): f3(1), (3, 0): f3(1), (0, 2): f2(2), (2, 1): f2(2), (1, 2): f3(2), (3, 1): f3(2), (0, 3): f2(3), (2, 2): f2(3), (1, 3): f3(3), (3, 2): f3(3), (2, 3): f3(4), (3, 3): f3(5)}
    if mode == "hu":
        out = {(0, 0): (l[0] + l[1] + 1) >> 1, (0, 1): (l[0] + 2 * l[1] + l[2] + 2) >> 2, (0, 2): (l[1] + l[2] + 1) >> 1, (1, 0): (l[1] + l[2] + 1) >> 1, (0, 3): (l[1] + 2 * l[2] + l[3] + 2) >> 2, (1, 1): (l[1] + 2 * l[2] + l[3] + 2) >> 2,
               (1, 2): (l[2] + l[3] + 1) >> 1, (2, 0): (l[2] + l[3] + 1) >> 1, (1, 3): (l[2] + 3 * l[3] + 2) >> 2, (2, 1): (l[2] + 3 * l[3] + 2) >> 2}
        out |= {p: l[3] for p in ((2, 2), (2, 3), (3, 0), (3, 1), (3, 2), (3, 3))}
    if mode == "ve":
        out = {(y, x): ((c if x == 0 else a[x - 1]) + 2 * a[x] + a[x + 1] + 2) >> 2 for y in range(4) for x in range(4)}
    if mode == "he":
        up = [c, *l]
        out = {(y, x): (up[y] + 2 * l[y] + (l[y + 1] if y < 3 else l[3]) + 2) >> 2 for y in range(4) for x in range(4)}
    return out


@pytest.mark.parametrize("mode", ["ve", "he", "ld", "rd", "vr", "vl", "hd", "hu"])
def test_subblock_modes(mode):
    r = random.Random(mode)
    for _ in range(30):
        a, l, c = [r.randrange(256) for _ in range(8)], [r.randrange(256) for _ in range(4)], r.randrange(256)
        got = vp8.subblock(mode, np.array(a), np.array(l), c)
        assert {(y, x): int(got[y, x]) for y in range(4) for x in range(4)} == slow(mode, a, l, c)


def test_flat_edges_predict_flat_blocks():
    for mode in ("dc", "tm", "ve", "he", "ld", "rd", "vr", "vl", "hd", "hu"):
        assert (vp8.subblock(mode, np.full(8, 77), np.full(4, 77), 77) == 77).all()


def test_loop_filter_leaves_flat_and_steep_alone():
    flat = np.full((5, 8), 90, np.uint8)
    steep = np.array([[10] * 4 + [240] * 4], np.uint8)
    soft = np.array([[100] * 4 + [108] * 4], np.uint8)
    for border in (False, True):
        assert np.array_equal(vp8.filtered_edge(flat, 40, 10, 1, border), flat)
        assert np.array_equal(vp8.filtered_edge(steep, 40, 10, 1, border), steep)
        out = vp8.filtered_edge(soft, 40, 10, 1, border).astype(int)
        assert (np.diff(out[0]) >= 0).all() and out[0, 3] > 100 and out[0, 4] < 108


def test_trellis_finds_the_least_cost():
    r = random.Random(7)
    for _ in range(200):
        n = r.randint(1, 6)
        c, q, weight = [r.randint(-60, 60) for _ in range(n)], [r.randint(4, 20) for _ in range(n)], r.randint(0, 4000)
        table = {(k, v, b): r.randint(1, 12) for k in range(n) for v in range(20) for b in range(3)}
        rate = lambda k, v, b, table=table: table[k, v, b]

        def cost(levels):
            total, before = 0, 0
            for k, v in enumerate(levels):
                total += 256 * (abs(c[k]) - v * q[k]) ** 2 + weight * rate(k, v, before)
                before = min(2, v)
            return total

        least = min(cost(p) for p in itertools.product(*[(abs(x) // y, abs(x) // y + 1) for x, y in zip(c, q, strict=True)]))
        assert cost([abs(v) for v in vp8.trellis(c, q, rate, weight)]) == least
