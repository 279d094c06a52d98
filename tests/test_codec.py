import random
import struct
import zlib

import numpy as np
import pytest

from rasterloom.functions import raster_kernels as k
from rasterloom.functions import vp8l
from rasterloom.operators import images
from rasterloom.sources import bitmaps, webp


def gradient(w, h):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([4 * x & 255, 5 * y & 255, 3 * (x ^ y) & 255, np.full_like(x, 255)], axis=2).astype(np.uint8)


def some_images():
    r = np.random.default_rng(1)
    for w, h in [(1, 1), (2, 1), (1, 3), (3, 2), (17, 13), (64, 64), (40, 9)]:
        yield gradient(w, h)
        yield r.integers(0, 256, (h, w, 4)).astype(np.uint8)
        yield np.broadcast_to(np.array([0x12, 0x34, 0x56, 0xFF], np.uint8), (h, w, 4)).copy()
        yield r.integers(0, 256, (5, 4)).astype(np.uint8)[r.integers(0, 5, (h, w))]
        yield r.integers(0, 256, (200, 4)).astype(np.uint8)[r.integers(0, 200, (h, w))]


@pytest.mark.parametrize("effort", [0, 1, 2, 3, 6, 9])
def test_lossless_round_trip(effort):
    for px in some_images():
        data = k.encode(px, effort)
        assert np.array_equal(k.decode(data), px)
        f = webp.features(data)
        assert (f.width, f.height, f.has_alpha, f.format) == (px.shape[1], px.shape[0], bool((px[..., 3] != 255).any()), "lossless")


def test_sizes_follow_effort_and_flat_images_are_small():
    assert len(k.encode(np.full((64, 64, 4), 0x12, np.uint8))) < 200
    assert len(k.encode(gradient(64, 64), 6)) < len(k.encode(gradient(64, 64), 0))


def test_lossless_choices(monkeypatch):
    """The cache, groups of codes and fits of colours are used where they help, and read back; matches are no farther than can be said."""
    r = np.random.default_rng(5)
    few = r.integers(0, 1 << 24, 900)
    cached = few[(np.cumsum(r.integers(0, 7, (96, 96)) - 3) % 900).reshape(96, 96)] | 0xFF000000
    v = r.integers(0, 256, (128, 128))
    halves = 0xFF000000 | np.where(np.arange(128) < 64, v << 16 | v << 8, (v & 7) << 8 | 0x301020)
    green = r.integers(0, 256, (64, 64))
    fitted = 0xFF000000 | ((green >> 2) + 7) << 16 | green << 8 | ((green * 3) >> 3)
    groups, caches, kinds = [], [], []
    one, of, plans = vp8l._best_cache, vp8l._code_groups, vp8l._plans
    monkeypatch.setattr(vp8l, "_best_cache", lambda *x: caches.append(one(*x)) or caches[-1])
    monkeypatch.setattr(vp8l, "_code_groups", lambda *x: groups.append(of(*x)) or groups[-1])
    monkeypatch.setattr(vp8l, "_plans", lambda *x: kinds.append(plans(*x)) or kinds[-1])
    for image in (cached, halves, fitted):
        assert np.array_equal(vp8l.decode(vp8l.encode(image, 6)), image)
    assert any(caches) and any(g is not None for g in groups)
    assert 1 in [t[0] for t in kinds[2][0][1]]  # the cheapest plan of the last image has a fit
    monkeypatch.setattr(vp8l, "FAR", 40)
    found = vp8l._matches(np.tile(r.integers(0, 1 << 32, 64), 8), 8, 64, True)
    assert not len(found)
    found = vp8l._matches(np.tile(r.integers(0, 1 << 32, 32), 8), 8, 64, True)
    assert found[:, 2].max() <= 40 and found[0].tolist() == [32, 224, 32]


def test_minimal_lossless_file():
    data = b"RIFF" + struct.pack("<I", 18) + b"WEBPVP8L" + struct.pack("<I", 5) + bytes([0x2F, 0, 0, 0, 0x10, 0])
    f = webp.features(data)
    assert (f.width, f.height, f.has_alpha, f.has_animation, f.format) == (1, 1, True, False, "lossless")


def test_animated_header_without_frames():
    data = b"RIFF" + struct.pack("<I", 22) + b"WEBPVP8X" + struct.pack("<I", 10) + bytes([2, 0, 0, 0, 2, 0, 0, 3, 0, 0])
    f = webp.features(data)
    assert (f.width, f.height, f.has_animation, f.format) == (3, 4, True, "undefined")
    with pytest.raises(webp.WebpError):
        webp.animation(data)
    with pytest.raises(webp.WebpError) as e:
        k.decode(data)
    assert e.value.kind == "animated"


def test_alpha_header_and_planes():
    assert webp.alpha_header(bytes([0b00011001])) == (1, 2, 1)
    for bad in (b"", b"\x40", b"\x02", b"\x30"):
        with pytest.raises(webp.WebpError):
            webp.alpha_header(bad)
    plane = np.random.default_rng(2).integers(0, 256, (6, 5))
    for kind in range(4):
        out = np.zeros_like(plane)
        for y in range(6):
            for x in range(5):
                left, top = plane[y, x - 1] if x else 0, plane[y - 1, x] if y else 0
                corner = plane[y - 1, x - 1] if x and y else 0
                if kind == 1:
                    guess = left if x else top
                elif kind == 2:
                    guess = top if y else left
                else:
                    guess = left if not y else top if not x else min(255, max(0, left + top - corner))
                out[y, x] = plane[y, x] - (guess if kind else 0) & 255
        raw = bytes([kind << 2]) + out.astype(np.uint8).tobytes()
        assert np.array_equal(k.alpha_plane(raw, 5, 6), plane)
        packed = bytes([kind << 2 | 1]) + vp8l.encode(0xFF000000 | out << 8)[5:]
        assert np.array_equal(k.alpha_plane(packed, 5, 6), plane)


def test_exif_and_chunks():
    data = k.encode(gradient(5, 4), exif=b"Exif!")
    assert [c.fourcc for c in webp.chunks(data)] == [b"VP8X", b"VP8L", b"EXIF"]
    assert [c.payload(data) for c in webp.chunks(data)][2] == b"Exif!" and data[20] == 0x08
    assert np.array_equal(k.decode(data), gradient(5, 4))


def test_animation_blending_and_disposal():
    r = np.random.default_rng(3)
    px = [r.integers(0, 256, (4, 6, 4)).astype(np.uint8) for _ in range(3)]
    whole = k.encode_animation([(10 * i, p) for i, p in enumerate(px)])
    assert [(ms, np.array_equal(c, p)) for (ms, c), p in zip(k.decode_animation(whole), px, strict=True)] == [(0, True), (10, True), (20, True)]
    part = lambda p, x, y, blend, dispose: webp.Frame(x, y, p.shape[1], p.shape[0], 5, blend, dispose, b"VP8L", vp8l.encode(k.rgba_to_argb(p)))
    data = webp.animated(8, 8, [part(px[0], 0, 0, False, True), part(px[1], 2, 4, True, False), part(px[2], 2, 2, True, False)], background=0x01020304)
    canvas, seen = np.broadcast_to(np.array([2, 3, 4, 1], np.uint8), (8, 8, 4)).copy(), [c for _, c in k.decode_animation(data)]
    first = canvas.copy()
    first[:4, :6] = px[0]
    assert np.array_equal(seen[0], first)
    canvas[4:8, 2:8] = k.blended(px[1], canvas[4:8, 2:8])
    assert np.array_equal(seen[1], canvas)
    canvas[2:6, 2:8] = k.blended(px[2], canvas[2:6, 2:8])
    assert np.array_equal(seen[2], canvas)


def test_damaged_files_end_in_errors():
    r, whole = random.Random(1), [k.encode(p) for p in some_images()]
    for _ in range(400):
        data = bytearray(r.choice(whole))
        if r.random() < 0.5:
            del data[r.randrange(len(data)) :]
        for _ in range(r.randint(0, 3)):
            if data:
                data[r.randrange(len(data))] ^= 1 << r.randrange(8)
        try:
            k.decode(bytes(data))
        except webp.WebpError as e:
            assert e.kind in ("not_enough_data", "bitstream", "unsupported", "animated")


def test_bitmaps():
    px = gradient(7, 5)
    assert np.array_equal(bitmaps.read_bmp(bitmaps.write_bmp(px)), px)
    top_down = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, -5, 1, 32, 0, 0, 0, 0, 0, 0) + px[..., [2, 1, 0, 3]].tobytes()
    assert np.array_equal(bitmaps.read_bmp(top_down), px)
    noise = np.random.default_rng(5).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    assert np.array_equal(bitmaps.read_png(bitmaps.write_png(noise)), noise)
    with pytest.raises(webp.WebpError):
        bitmaps.read_bmp(b"BM" + bytes(60))


def png(samples, depth, colour, woven=False, **chunks):
    """A PNG of (h, w, k) samples, whose lines take the five filters in turn, done byte by byte."""
    h, w, k = samples.shape
    step, body = max(1, k * depth // 8), b""
    for x, y, across, down in bitmaps.WOVEN if woven else ((0, 0, 1, 1),):
        part = samples[y::down, x::across]
        if not part.size:
            continue
        bits = (part[..., None] >> np.arange(depth)[::-1] & 1).astype(np.uint8).reshape(len(part), -1)
        rows, before = np.packbits(bits, axis=1), None
        for n, row in enumerate(rows):
            line, above = row.tolist(), [0] * len(row) if before is None else before
            out = [n % 5]
            for i, v in enumerate(line):
                a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                near = min((a, b, c), key=lambda q: abs(a + b - c - q))
                out.append((v - (0, a, b, (a + b) // 2, near)[n % 5]) & 255)
            body, before = body + bytes(out), line
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, woven)
    parts = [(b"IHDR", head), *[(n.encode(), v) for n, v in chunks.items()], (b"IDAT", zlib.compress(body)), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(bitmaps._png_chunk(n, v) for n, v in parts)


@pytest.mark.parametrize("woven", [False, True])
@pytest.mark.parametrize("size", [(1, 1), (3, 2), (11, 13), (1, 9)])
def test_png_kinds(size, woven):
    r, (h, w) = np.random.default_rng(7), size
    opaque = lambda c: np.concatenate([c, np.full((h, w, 1), 255)], axis=2)
    for colour, (k, depths) in bitmaps.COLOURS.items():
        for depth in depths:
            s = r.integers(0, 1 << depth, (h, w, k))
            if colour == 3:
                own = r.integers(0, 256, (1 << depth, 4)).astype(np.uint8)
                data, want = png(s, depth, 3, woven, PLTE=own[:, :3].tobytes(), tRNS=own[:, 3].tobytes()), own[s[..., 0]]
            else:
                v = s >> 8 if depth == 16 else s * 255 // ((1 << depth) - 1)
                data = png(s, depth, colour, woven)
                want = {1: lambda: opaque(v.repeat(3, 2)), 2: lambda: v[..., [0, 0, 0, 1]], 3: lambda: opaque(v), 4: lambda: v}[k]()
            assert np.array_equal(bitmaps.read_png(data), want), (colour, depth)
            if colour in (0, 2):
                clear = want.copy()
                clear[(s == s[0, 0]).all(axis=2), 3] = 0
                assert np.array_equal(bitmaps.read_png(png(s, depth, colour, woven, tRNS=s[0, 0].astype(">u2").tobytes())), clear)


def test_damaged_png():
    s = np.zeros((2, 3, 1), int)
    for data in (png(s, 8, 0)[:20], png(s + 4, 8, 3, PLTE=bytes(12)), png(s, 8, 0).replace(zlib.compress(bytes([0, 0, 0, 0, 1, 0, 0, 0])), b"x"), png(s, 3, 0)):
        with pytest.raises(webp.WebpError):
            bitmaps.read_png(data)


def test_files_to_frames_and_back(spark, tmp_path):
    made = {f"a{i}.webp": k.encode(p) for i, p in enumerate(list(some_images())[:12])}
    made |= {"anim.webp": k.encode_animation([(7, gradient(4, 4)), (9, gradient(4, 4)[::-1])]), "bad.webp": b"RIFF....", "text.webp": b"not an image at all"}
    for n, data in made.items():
        (tmp_path / n).write_bytes(data)
    files = images.read_files(spark, str(tmp_path)).selectExpr("substring_index(path, '/', -1) as name", "content")
    f = {r.name: r for r in images.features(files).collect()}
    assert f["anim.webp"].has_animation and f["bad.webp"].error_kind == "not_enough_data" and f["text.webp"].width is None
    d = {r.name: r for r in images.decoded(files).collect()}
    assert all(bytes(d[f"a{i}.webp"].rgba) == p.tobytes() for i, p in enumerate(list(some_images())[:12]))
    assert d["anim.webp"].error_kind == "animated"
    assert [(r.frame_idx, r.duration_ms) for r in images.frames(files.where("name = 'anim.webp'")).orderBy("frame_idx").collect()] == [(0, 7), (1, 9)]
    assert images.chunks(files.where("name = 'a0.webp'")).collect()[0].fourcc == "VP8L"
    good = images.decoded(files.where("name like 'a%' and name <> 'anim.webp'")).select("name", "width", "height", "rgba")
    again = images.decoded(images.encoded(good, effort=2).select("name", "content"))
    assert {r.name: bytes(r.rgba) for r in again.collect()} == {r.name: bytes(r.rgba) for r in good.collect()}
    px = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in images.pixels(good.where("name = 'a10.webp'"), "name").collect()}
    want = list(some_images())[10]
    assert px == {(x, y): tuple(want[y, x].tolist()) for y in range(want.shape[0]) for x in range(want.shape[1])}
    with pytest.raises(Exception, match="RIFF|bitstream|enough"):
        images.features(files, strict=True).collect()


def test_photos(spark, tmp_path):
    px = np.random.default_rng(0).integers(0, 256, (3, 5, 4)).astype(np.uint8)
    (tmp_path / "b.png").write_bytes(bitmaps.write_png(px))
    (tmp_path / "C.PNG").write_bytes(b"not a picture")
    (tmp_path / "note.txt").write_bytes(b"text")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.png").write_bytes(bitmaps.write_png(px))
    jvm = spark._jvm
    flat = jvm.java.awt.image.BufferedImage(16, 8, 1)
    grey = jvm.java.awt.image.BufferedImage(2, 1, 10)
    grey.getRaster().setSample(1, 0, 0, 77)
    assert jvm.javax.imageio.ImageIO.write(flat, "jpg", jvm.java.io.File(str(tmp_path / "a.jpeg")))
    assert jvm.javax.imageio.ImageIO.write(grey, "png", jvm.java.io.File(str(tmp_path / "g.png")))
    assert [r.name for r in images.listing(spark, str(tmp_path)).collect()] == ["C.PNG", "a.jpeg", "b.png", "g.png"]
    got = {r.path.rsplit("/", 1)[1]: r for r in images.photos(spark, str(tmp_path)).collect()}
    assert bytes(got["b.png"].rgba) == px.tobytes() and (got["b.png"].width, got["b.png"].height) == (5, 3)
    assert bytes(got["a.jpeg"].rgba) == bytes([0, 0, 0, 255]) * 128 and bytes(got["g.png"].rgba) == bytes([0, 0, 0, 255, 77, 77, 77, 255])
    assert got["C.PNG"].rgba is None and got["C.PNG"].error_kind == "bitstream" and len(got) == 4


def test_pixel_tables_of_several_batches(spark, monkeypatch):
    px = gradient(7, 5)
    rows = spark.createDataFrame([("p", 7, 5, bytearray(px.tobytes())), ("none", None, None, None)], "id string, width int, height int, rgba binary")
    monkeypatch.setattr(images, "PIXELS", 8)
    got = {(r.img, r.x, r.y): (r.r, r.g, r.b, r.a) for r in images.pixels(rows, "id").collect()}
    assert got == {("p", x, y): tuple(px[y, x].tolist()) for y in range(5) for x in range(7)}


def test_sql_functions(spark):
    images.register(spark)
    px = gradient(6, 5)
    spark.createDataFrame([(bytearray(k.encode(px)),), (bytearray(b"junk"),)], "content binary").createOrReplaceTempView("files")
    got = spark.sql("SELECT webp_features(content).width AS w, webp_decode_rgba(content) AS d FROM files").collect()
    assert got[0].w == 6 and bytes(got[0].d.rgba) == px.tobytes() and got[1].w is None
    spark.sql("SELECT d.width AS w, d.height AS h, d.rgba AS v FROM (SELECT webp_decode_rgba(content) AS d FROM files) WHERE d.width IS NOT NULL").createOrReplaceTempView("px")
    r = spark.sql("SELECT webp_encode_lossless(w, h, v, 3) AS c, psnr_rgb(w, h, v, v) AS p FROM px").first()
    assert r.p == float("inf") and np.array_equal(k.decode(bytes(r.c)), px)


def test_command_line(tmp_path, capsys):
    from rasterloom.__main__ import main

    px = gradient(9, 8)
    (tmp_path / "a.png").write_bytes(bitmaps.write_png(px))
    main(["encode", "-in", str(tmp_path / "a.png"), "-out", str(tmp_path / "a.webp")])
    main(["decode", "-in", str(tmp_path / "a.webp"), "-out", str(tmp_path / "a.bmp")])
    assert np.array_equal(bitmaps.read_bmp((tmp_path / "a.bmp").read_bytes()), px) and "9x8" in capsys.readouterr().out
