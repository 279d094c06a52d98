import numpy as np
import pytest

from rasterloom.functions import vp8
from rasterloom.functions import vp8_frames as v
from rasterloom.sources import webp


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Made-up probabilities, by a file as the parameter wants it."""
    r = np.random.default_rng(7)
    numbers = np.concatenate([r.integers(20, 236, 1056), r.integers(200, 256, 1056), r.integers(20, 236, 900)])
    at = tmp_path_factory.mktemp("tables") / "numbers.txt"
    at.write_text(", ".join(map(str, numbers)))
    return v.Tables.read(str(at))


def picture(w, h, seed=1):
    y, x = np.mgrid[0:h, 0:w]
    noise = np.random.default_rng(seed).integers(0, 90, (h, w, 3)) * ((x // 24 + y // 24) % 2)[..., None]
    c = np.stack([np.minimum(255, 5 * x), np.minimum(255, 4 * y), (x * y) % 256 // 2], axis=2) // 2 + noise
    return np.concatenate([np.clip(c, 0, 255), np.full((h, w, 1), 255)], axis=2).astype(np.uint8)


def psnr(a, b):
    return 10 * np.log10(65025 / max(1e-9, ((a.astype(float) - b) ** 2).mean()))


@pytest.mark.parametrize("size", [(1, 1), (16, 16), (19, 17), (50, 33)])
@pytest.mark.parametrize("options", [{"quality": 95}, {"quality": 40}, {"quality": 60, "sub_blocks": False, "filter_level": 0}, {"quality": 10, "filter_level": 63}])
def test_decoder_follows_the_encoder(tables, monkeypatch, size, options):
    planes, frames = v.planes_of(picture(*size)), []
    begin = v.Frame.__init__
    monkeypatch.setattr(v.Frame, "__init__", lambda self, h: (begin(self, h), frames.append(self))[0])
    got = v.decode_planes(v.encode_planes(planes, tables, **options), tables)
    for a, b in zip(got, frames[0].finished(), strict=True):
        assert np.array_equal(a, b)
    if options["quality"] >= 95:
        assert psnr(got[0], planes[0]) > 30


def test_quality_moves_size_and_error(tables):
    px = picture(48, 48)
    some = {q: v.encode(px, tables, q) for q in (10, 50, 90)}
    assert len(some[10]) < len(some[50]) < len(some[90])
    error = {q: psnr(v.rgba_of(v.decode_planes(d, tables))[..., :3], px[..., :3]) for q, d in some.items()}
    assert error[10] < error[50] < error[90]


def test_flat_pictures_come_back(tables):
    for value in (0, 128, 255):
        px = np.full((32, 40, 4), value, np.uint8)
        px[..., 3] = 255
        got = v.rgba_of(v.decode_planes(v.encode(px, tables, 100), tables))
        assert np.abs(got.astype(int) - px).max() <= 2


def test_transforms_and_their_sql_agree(spark):
    import duckdb

    from rasterloom.functions import formulas as f

    r = np.random.default_rng(3)
    p = r.integers(-255, 256, (40, 4, 4))
    names = [f"c{k}" for k in range(16)]

    def by_sql(m, *stages):
        out = "SELECT * FROM t"
        for s in stages:
            out = f"SELECT i, {', '.join(f'{e} AS {n}' for e, n in zip(s, names, strict=True))} FROM ({out})"
        con = duckdb.connect()
        con.execute(f"CREATE TABLE t (i BIGINT, {', '.join(f'{n} BIGINT' for n in names)})")
        con.executemany(f"INSERT INTO t VALUES ({', '.join('?' * 17)})", [(i, *x.ravel().tolist()) for i, x in enumerate(m)])
        return np.array(con.execute(out + " ORDER BY i").fetchall())[:, 1:].reshape(-1, 4, 4)

    c = v.forward_dct(p)
    assert np.array_equal(by_sql(p, f.dct_rows(names), f.dct_columns(names)), c)
    assert np.array_equal(by_sql(c, f.idct_columns(names), f.idct_rows(names)), v.inverse_dct(c))
    assert np.array_equal(by_sql(p, f.wht_inverse_columns(names), f.wht_inverse_rows(names)), v.inverse_wht(p))


def test_boolean_coder_over_many_windows():
    r = np.random.default_rng(5)
    bits, probs = r.integers(0, 2, 60_000), r.integers(1, 256, 60_000)
    for some in (bits, np.ones_like(bits), np.zeros_like(bits)):
        w = vp8.BoolWriter()
        for b, p in zip(some.tolist(), probs.tolist(), strict=True):
            w.bit(b, p)
        reader = vp8.BoolReader(w.done() + b"\0")
        assert [reader.bit(p) for p in probs.tolist()] == some.tolist()


def test_segments_skips_partitions_and_updates(tables):
    """A frame written by hand: four segments, three of four macroblocks skipped, four partitions, one probability updated."""
    h = vp8.Header(width=32, height=32, segments=True, update_map=True, absolute=True, segment_quantizers=[4, 40, 80, 120], segment_filters=[0, 10, 20, 30], segment_probs=[100, 120, 140], partitions=4, quantizer=9)
    w = vp8.BoolWriter()
    vp8.put_header(w, h)
    w.bit(1)
    probs = tables.coefficients.copy()
    for at in np.ndindex(probs.shape):
        w.bit(int(at == (1, 0, 0, 0)), int(tables.updates[at]))
        if at == (1, 0, 0, 0):
            w.number(77, 8)
            probs[at] = 77
    w.bit(1)
    w.number(90, 8)
    parts = [vp8.BoolWriter() for _ in range(4)]
    for k in range(4):
        w.bit(k >> 1, 100)
        w.bit(k & 1, 140 if k >> 1 else 120)
        w.bit(int(k != 2), 90)
        for tree in ("luma", "chroma"):
            for p, taken in v.MODE_TREES[tree]["dc"]:
                w.bit(taken, p)
        if k == 2:
            levels = np.zeros(16, np.int64)
            levels[0] = 3
            v._write_block(parts[1], probs[v.DCS].tolist(), 0, 0, levels)
            for i in range(24):
                v._write_block(parts[1], probs[v.AFTER_DC if i < 16 else v.CHROMA].tolist(), 0, int(i < 16), np.zeros(16, np.int64))
    body, data = w.done() + b"\0", [p.done() + b"\0" for p in parts]
    payload = vp8.frame_tag(h, len(body)) + body + b"".join(len(d).to_bytes(3, "little") for d in data[:3]) + b"".join(data)
    y, u, _ = v.decode_planes(payload, tables)
    assert (y[:16] == 128).all() and (u == 128).all() and (y[24:, 4:12] == y[28, 8]).all() and y[28, 8] > 128
    for cut in (20, len(payload) - len(data[3]) - len(data[2]) - 1):
        with pytest.raises(webp.WebpError):
            v.decode_planes(payload[:cut], tables)


def test_lossy_files(spark, tables, tmp_path):
    from rasterloom.__main__ import main
    from rasterloom.functions import raster_kernels as k
    from rasterloom.operators import images
    from rasterloom.sources import bitmaps

    at = str(tmp_path / "tables.txt")
    with open(at, "w") as file:
        file.write("\n".join(map(str, np.concatenate([t.ravel() for t in (tables.coefficients, tables.updates, tables.modes)]))))
    px = picture(20, 18)
    data = k.encode_lossy(px, tables, 95)
    plane = bytes([0]) + bytes(range(180)) * 2
    with_alpha = webp.file_of(webp.vp8x(20, 18, webp.ALPHA) + webp.chunk(b"ALPH", plane) + data[12:])
    made = spark.createDataFrame([("still", bytearray(data)), ("alpha", bytearray(with_alpha)), ("lossless", bytearray(k.encode(px)))], "name string, content binary")
    got = {r.name: r for r in images.decoded(made, tables=at).collect()}
    assert bytes(got["lossless"].rgba) == px.tobytes() and psnr(np.frombuffer(bytes(got["still"].rgba), np.uint8), px.ravel()) > 25
    assert bytes(got["alpha"].rgba)[3::4] == plane[1:]
    assert {r.name: r.error_kind for r in images.decoded(made).collect()} == {"still": "unsupported", "alpha": "unsupported", "lossless": None}
    own = {r.name: r for r in images.planes(made, at).collect()}
    assert own["lossless"].error_kind == "unsupported" and own["still"].a is None and bytes(own["alpha"].a) == plane[1:] and len(own["still"].u) == 90
    back = images.encoded(spark.createDataFrame([(20, 18, bytearray(px.tobytes()))], "width int, height int, rgba binary"), "lossy", quality=95, tables=at).first()
    assert bytes(back.content) == data
    (tmp_path / "a.png").write_bytes(bitmaps.write_png(px))
    main(["encode", "-in", str(tmp_path / "a.png"), "-out", str(tmp_path / "a.webp"), "-quality", "95", "-tables", at])
    assert (tmp_path / "a.webp").read_bytes() == data
    main(["decode", "-in", str(tmp_path / "a.webp"), "-out", str(tmp_path / "b.png"), "-tables", at])
    assert bitmaps.read_png((tmp_path / "b.png").read_bytes()).tobytes() == bytes(got["still"].rgba)


def test_settings():
    from rasterloom.functions.raster_kernels import settings

    assert settings() == (90, 4) and settings(50, -1) == (50, 0) and settings(1, 9) == (1, 9)
    for bad in ((-1, 0), (101, 0), (5, 10), (5, -2)):
        with pytest.raises(webp.WebpError):
            settings(*bad)
