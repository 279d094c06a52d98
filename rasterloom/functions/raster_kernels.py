"""Whole images in numpy: alpha planes, decoding of lossless stills and animations, compositing, PSNR."""

from __future__ import annotations

import numpy as np

from rasterloom.functions import vp8_frames, vp8l
from rasterloom.sources import webp


def argb_to_rgba(argb: np.ndarray) -> np.ndarray:
    return ((argb[..., None] >> np.array([16, 8, 0, 24])) & 255).astype(np.uint8)


def rgba_to_argb(rgba: np.ndarray) -> np.ndarray:
    return (rgba.astype(np.int64) << np.array([16, 8, 0, 24])).sum(axis=-1)


def unfilter(plane: np.ndarray, kind: int) -> np.ndarray:
    """Undoes an alpha plane's filter: 0 none, 1 horizontal, 2 vertical, 3 gradient."""
    p = plane.astype(np.int64)
    if kind == 0:
        return p.astype(np.uint8)
    if kind == 1:
        p[:, 0] = np.cumsum(p[:, 0])
        return (np.cumsum(p, axis=1) & 255).astype(np.uint8)
    if kind == 2:
        p[0] = np.cumsum(p[0])
        return (np.cumsum(p, axis=0) & 255).astype(np.uint8)
    h, w = p.shape
    p[0] = np.cumsum(p[0]) & 255
    for y in range(1, h):
        above = p[y - 1].tolist()
        left, row, corner = above[0], p[y].tolist(), above[0]
        for x in range(w):
            guess = above[0] if not x else min(255, max(0, left + above[x] - corner))
            left = row[x] = (row[x] + guess) & 255
            corner = above[x]
        p[y] = row
    return p.astype(np.uint8)


def alpha_plane(payload: bytes, width: int, height: int) -> np.ndarray:
    packing, kind, _ = webp.alpha_header(payload)
    if packing == 0:
        if len(payload) - 1 < width * height:
            raise webp.short("ALPH raw payload")
        plane = np.frombuffer(payload, np.uint8, width * height, 1).reshape(height, width)
    else:
        plane = (vp8l.decode_stream(payload[1:], width, height) >> 8 & 255).astype(np.uint8)
    return unfilter(plane, kind)


def _pixels(kind: bytes, payload: bytes, alpha: bytes | None, width: int, height: int, tables: vp8_frames.Tables | None = None) -> np.ndarray:
    if kind == b"VP8L":
        out = argb_to_rgba(vp8l.decode(payload))
    elif tables is None:
        raise webp.WebpError("unsupported", "lossy frames need the format's probability tables")
    else:
        out = vp8_frames.rgba_of(vp8_frames.decode_planes(payload, tables))
    if out.shape[:2] != (height, width):
        raise webp.broken("image size does not match its frame")
    if alpha is not None:
        out[..., 3] = alpha_plane(alpha, width, height)
    return out


def decode(data: bytes, tables: vp8_frames.Tables | None = None) -> np.ndarray:
    """(h, w, 4) straight RGBA of a still image; lossy ones need tables."""
    info, kind, payload, alpha = webp.still(data)
    return _pixels(kind, payload, alpha if kind == b"VP8 " else None, info.width, info.height, tables)


def decode_planes(data: bytes, tables: vp8_frames.Tables) -> tuple[list[np.ndarray], np.ndarray | None]:
    """Limited-range planes of a lossy still image, and its alpha plane if it has one."""
    info, kind, payload, alpha = webp.still(data)
    if kind != b"VP8 ":
        raise webp.WebpError("unsupported", "only lossy images are made of planes")
    return vp8_frames.decode_planes(payload, tables), alpha_plane(alpha, info.width, info.height) if alpha is not None else None


def blended(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Non-premultiplied source over target."""
    s, t = source.astype(np.int64), target.astype(np.int64)
    sa, ta = s[..., 3:], t[..., 3:]
    factor = (ta * (256 - sa)) >> 8
    alpha = sa + factor
    mixed = (((s[..., :3] * sa + t[..., :3] * factor) * ((1 << 24) // np.maximum(alpha, 1))) >> 24) & 255
    out = np.concatenate([mixed, alpha], axis=-1)
    return np.where(sa == 0, t, np.where(sa == 255, s, out)).astype(np.uint8)


def decode_animation(data: bytes, tables: vp8_frames.Tables | None = None):
    """(duration, whole canvas) of each frame, in order; one canvas is held at a time."""
    a = webp.animation(data)
    back = np.array([(a.background >> s) & 255 for s in (16, 8, 0, 24)], np.uint8)
    canvas, last = np.broadcast_to(back, (a.height, a.width, 4)).copy(), None
    for f in a.frames:
        if last is not None and last.dispose:
            canvas[last.y : last.y + last.height, last.x : last.x + last.width] = back
        if f.kind == b"VP8L" and f.alpha is not None:
            raise webp.broken("lossless frames must not have an ALPH chunk")
        own = _pixels(f.kind, f.image, f.alpha, f.width, f.height, tables)
        at = canvas[f.y : f.y + f.height, f.x : f.x + f.width]
        at[:] = blended(own, at) if f.blend else own
        yield f.duration, canvas.copy()
        last = f


def encode(rgba: np.ndarray, effort: int = 6, exif: bytes | None = None) -> bytes:
    """A lossless file of (h, w, 4) straight RGBA."""
    h, w, _ = rgba.shape
    return webp.wrapped(b"VP8L", vp8l.encode(rgba_to_argb(rgba), effort), w, h, bool((rgba[..., 3] != 255).any()), exif)


def settings(quality: float = 0, effort: int = 0, fallback: int = 4) -> tuple[float, int]:
    """Quality and effort of an encoder's options: 0 means their defaults, 90 and fallback, and an effort of -1 means none."""
    if not 0 <= quality <= 100 or not -1 <= effort <= 9:
        raise webp.WebpError("invalid_param", "quality is from 0 to 100, effort from -1 to 9")
    return quality or 90, {0: fallback, -1: 0}.get(effort, effort)


def encode_lossy(rgba: np.ndarray, tables: vp8_frames.Tables, quality: float = 90, exif: bytes | None = None) -> bytes:
    """A lossy file of opaque (h, w, 4) pixels."""
    if (rgba[..., 3] != 255).any():
        raise webp.WebpError("unsupported", "lossy files are made of opaque images only")
    return encode_planes(vp8_frames.planes_of(rgba), tables, quality, exif)


def encode_planes(planes: list[np.ndarray], tables: vp8_frames.Tables, quality: float = 90, exif: bytes | None = None) -> bytes:
    """A lossy file of limited-range planes, chroma at half size."""
    (h, w), half = planes[0].shape, tuple((n + 1) // 2 for n in planes[0].shape)
    if planes[1].shape != half or planes[2].shape != half:
        raise webp.WebpError("invalid_param", "chroma planes are half as large as luma, rounded up")
    return webp.wrapped(b"VP8 ", vp8_frames.encode_planes(planes, tables, settings(quality)[0]), w, h, False, exif)


def encode_animation(frames: list[tuple[int, np.ndarray]], effort: int = 6, loops: int = 0) -> bytes:
    """An animation of whole canvases with their durations."""
    h, w, _ = frames[0][1].shape
    return webp.animated(w, h, [webp.Frame(0, 0, w, h, ms, False, False, b"VP8L", vp8l.encode(rgba_to_argb(px), effort)) for ms, px in frames], loops=loops)


def psnr(a: np.ndarray, b: np.ndarray) -> float | None:
    """Of the colour channels, in dB; infinite for equal images, null for different sizes."""
    if a.shape != b.shape:
        return None
    d = a[..., :3].astype(np.int64) - b[..., :3]
    mse = float((d * d).mean())
    return float("inf") if mse == 0 else 10 * float(np.log10(65025 / mse))
