"""BMP and PNG files, read from and written to bytes; pixels are (h, w, 4) arrays of straight RGBA."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from rasterloom.sources.webp import WebpError, broken, short


def read_bmp(data: bytes) -> np.ndarray:
    """24 or 32 bits a pixel, uncompressed, bottom-up or top-down."""
    if len(data) < 54:
        raise short("BMP header")
    if data[:2] != b"BM":
        raise broken("not a BMP file")
    at, size, width, height, planes, depth, packing = struct.unpack("<IIiiHHI", data[10:34])
    if size < 40 or planes != 1 or packing or depth not in (24, 32):
        raise WebpError("unsupported", "BMP must be uncompressed with 24 or 32 bits a pixel")
    if len(data) < 14 + size:
        raise short("BMP header")
    if width <= 0 or not height:
        raise broken("BMP size must not be zero")
    k, rows = depth // 8, abs(height)
    stride = -(-width * k // 4) * 4
    if at + stride * rows > len(data):
        raise short("BMP pixels")
    px = np.frombuffer(data, np.uint8, stride * rows, at).reshape(rows, stride)[:, : width * k].reshape(rows, width, k)
    px = px if height < 0 else px[::-1]
    out = np.full((rows, width, 4), 255, np.uint8)
    out[..., :3] = px[..., 2::-1]
    if k == 4:
        out[..., 3] = px[..., 3]
    return out


def write_bmp(rgba: np.ndarray) -> bytes:
    """24 bits a pixel, bottom-up, 3780 pixels a metre; alpha is dropped."""
    h, w, _ = rgba.shape
    stride = -(-w * 3 // 4) * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = rgba[::-1, :, 2::-1].reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 3780, 3780, 0, 0) + rows.tobytes()


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(rgba: np.ndarray) -> bytes:
    """8-bit RGBA."""
    h, w, _ = rgba.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _png_chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _png_chunk(b"IEND", b"")


#: Where interlaced images' seven parts begin and how far their pixels are apart (x, y, across, down): fixed values of the format.
WOVEN = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Channels and depths of each colour type: fixed values of the format.
COLOURS = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}


def _unfiltered(lines: np.ndarray, k: int) -> np.ndarray:
    """(h, n, k) bytes of lines, each a filter's number and n times k bytes. What lies on one slant from lower left to upper right needs
    only what lies before it, so it is undone at once."""
    h, n, kinds = len(lines), (lines.shape[1] - 1) // k, lines[:, 0]
    if kinds.max() > 4:
        raise broken("PNG filter")
    px = np.zeros((h + 1, n + 1, k), np.int16)
    px[1:, 1:] = lines[:, 1:].reshape(h, n, k)
    flat = px.reshape(-1, k)
    for t in range(n + h - 1 if kinds.any() else 0):
        y = np.arange(max(0, t - n + 1), min(h - 1, t) + 1)
        here = (y + 1) * (n + 1) + t - y + 1
        left, top, corner = flat[here - 1], flat[here - n - 1], flat[here - n - 2]
        to_left, to_top, to_corner = np.abs(top - corner), np.abs(left - corner), np.abs(left + top - 2 * corner)
        nearest = np.where((to_left <= to_top) & (to_left <= to_corner), left, np.where(to_top <= to_corner, top, corner))
        guess = np.stack([np.zeros_like(left), left, top, (left + top) >> 1, nearest])
        flat[here] = (flat[here] + guess[kinds[y], np.arange(len(y))]) & 255
    return px[1:, 1:].astype(np.uint8)


def _samples(lines: np.ndarray, w: int, depth: int, k: int) -> np.ndarray:
    """(h, w, k) samples of filtered lines."""
    rows = _unfiltered(lines, max(1, k * depth // 8)).reshape(len(lines), -1)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        return (bits @ (1 << np.arange(depth)[::-1]))[:, :w, None]
    return rows.reshape(len(rows), w, k) if depth == 8 else rows.view(">u2").reshape(len(rows), w, k)


def read_png(data: bytes) -> np.ndarray:
    """Grey, RGB and palette, with alpha or a transparent colour, of all depths, interlaced or not; 16 bits are cut to the upper 8."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise broken("not a PNG file")
    at, parts = 8, {}
    while at + 8 <= len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        parts.setdefault(data[at + 4 : at + 8], []).append(data[at + 8 : at + 8 + n])
        at += 12 + n
    if b"IHDR" not in parts or len(parts[b"IHDR"][0]) < 13:
        raise short("PNG header")
    w, h, depth, colour, _, _, woven = struct.unpack(">IIBBBBB", parts[b"IHDR"][0][:13])
    if colour not in COLOURS or depth not in COLOURS[colour][1] or woven > 1 or not w or not h:
        raise broken("PNG header")
    k, key = COLOURS[colour][0], parts.get(b"tRNS", [b""])[0]
    px = np.zeros((h, w, k), np.int64)
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts.get(b"IDAT", []))), np.uint8)
        for x, y, across, down in WOVEN if woven else ((0, 0, 1, 1),):
            wide, high = -(-(w - x) // across), -(-(h - y) // down)
            if wide > 0 and high > 0:
                stride = 1 + -(-wide * k * depth // 8)
                lines, raw = raw[: high * stride].reshape(high, stride), raw[high * stride :]
                px[y::down, x::across] = _samples(lines, wide, depth, k)
    except (zlib.error, ValueError) as e:
        raise e if isinstance(e, WebpError) else broken("PNG pixels") from e
    out = np.full((h, w, 4), 255, np.uint8)
    if colour == 3:
        own = np.frombuffer(parts.get(b"PLTE", [b""])[0], np.uint8).reshape(-1, 3)
        if px.max() >= len(own):
            raise broken("PNG palette")
        alpha = np.full(len(own), 255, np.uint8)
        alpha[: len(key)] = list(key[: len(own)])
        out[..., :3], out[..., 3] = own[px[..., 0]], alpha[px[..., 0]]
        return out
    if key and colour in (0, 2):
        out[..., 3] = np.where((px == np.frombuffer(key[: 2 * k], ">u2")).all(axis=2), 0, 255)
    px = px >> 8 if depth == 16 else px * (255 // ((1 << depth) - 1))
    out[..., :3] = px[..., :3] if k > 2 else px[..., :1]
    if k in (2, 4):
        out[..., 3] = px[..., -1]
    return out
