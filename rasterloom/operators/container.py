"""Container headers as column expressions over bytes: no Python, so that a scan of files can be filtered by size or kind.

They read what stands at fixed places. Chunk walks, animations and damaged files are rasterloom.sources.webp's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte(content: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("long")


def read_le(content: Column, at: int, size: int) -> Column:
    """A little-endian number."""
    out = byte(content, at)
    for k in range(1, size):
        out = out + byte(content, at + k) * (1 << (8 * k))
    return out


def le(value: Column, size: int) -> Column:
    """A number as little-endian bytes."""
    parts = [F.unhex(F.lpad(F.hex(F.floor(value / (1 << (8 * k))).cast("long").bitwiseAND(F.lit(255))), 2, "0")) for k in range(size)]
    return F.concat(*parts) if size > 1 else parts[0]


def tag(text: str) -> Column:
    return F.lit(bytearray(text.encode()))


def is_webp(content: Column) -> Column:
    """The magic RIFF????WEBPVP8."""
    at = lambda i, t: F.substring(content, i, len(t)) == tag(t)
    return F.coalesce(at(1, "RIFF") & at(9, "WEBPVP8"), F.lit(False))


def chunk(fourcc: str, payload: Column, size: int) -> Column:
    return F.concat(tag(fourcc), le(F.lit(size), 4), payload, F.lit(bytearray(b"\0" * (size & 1))))


def lossless_header(width: Column, height: Column, alpha: Column) -> Column:
    """A RIFF file that ends after its VP8L frame header."""
    bits = (width - 1) + (height - 1) * (1 << 14) + alpha.cast("long") * (1 << 28)
    body = chunk("VP8L", F.concat(F.lit(bytearray(b"\x2f")), le(bits, 4)), 5)
    return F.concat(tag("RIFF"), le(F.lit(18), 4), tag("WEBP"), body)


def with_features(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds is_webp, width, height, has_alpha, has_animation and format of a file whose first chunk is VP8, VP8L or VP8X; null sizes if it isn't one."""
    c = F.col(content)
    kind = F.substring(c, 13, 4)
    lossy, lossless, extended = (is_webp(c) & (kind == tag(t)) for t in ("VP8 ", "VP8L", "VP8X"))
    lossy = lossy & (F.substring(c, 24, 3) == F.lit(bytearray(b"\x9d\x01\x2a")))
    lossless = lossless & (byte(c, 20) == 0x2F) & (byte(c, 24) < 32)
    bits = read_le(c, 21, 4)
    low14 = lambda v: v.bitwiseAND(F.lit(0x3FFF))
    return files.withColumns({
        "is_webp": is_webp(c),
        "width": F.when(lossy, low14(read_le(c, 26, 2))).when(lossless, low14(bits) + 1).when(extended, read_le(c, 24, 3) + 1),
        "height": F.when(lossy, low14(read_le(c, 28, 2))).when(lossless, low14(F.shiftright(bits, 14)) + 1).when(extended, read_le(c, 27, 3) + 1),
        "has_alpha": F.when(lossy, F.lit(False)).when(lossless, F.shiftright(bits, 28).bitwiseAND(F.lit(1)) == 1).when(extended, byte(c, 20).bitwiseAND(F.lit(16)) != 0),
        "has_animation": F.when(lossy | lossless, F.lit(False)).when(extended, byte(c, 20).bitwiseAND(F.lit(2)) != 0),
        "format": F.when(lossy, "lossy").when(lossless, "lossless").otherwise("undefined"),
    })


def vp8x_payload(flags: Column, width: Column, height: Column) -> Column:
    return F.concat(le(flags, 4), le(width - 1, 3), le(height - 1, 3))


def read_vp8x(payload: Column) -> list[Column]:
    return [read_le(payload, 0, 4).alias("flags"), (read_le(payload, 4, 3) + 1).alias("canvas_width"), (read_le(payload, 7, 3) + 1).alias("canvas_height")]


def read_alph(payload: Column) -> list[Column]:
    """The alpha header's fields, and whether they are ones that the format knows."""
    b = byte(payload, 0)
    part = lambda s: F.shiftright(b, s).bitwiseAND(F.lit(3))
    return [part(0).alias("compression"), part(2).alias("filter"), part(4).alias("preprocessing"), ((part(0) <= 1) & (part(4) <= 2) & (F.shiftright(b, 6) == 0)).alias("valid")]


#: The greatest payload of a chunk that a container can hold.
MOST = 2**32 - 10


def riff_header(size: Column, form: Column) -> Column:
    return F.concat(tag("RIFF"), le(size, 4), form)


def with_first_chunk(files: DataFrame, content: str = "content", length: str = "length") -> DataFrame:
    """Adds what the RIFF header and the first chunk's header tell: is_riff (bare chunks have none), riff_end, chunk (its name), chunk_size,
    chunk_end with padding, and problem: the first rule that the headers break, null if none. missing: what the headers promise isn't all there."""
    c, n = F.col(content), F.col(length)
    riff = F.substring(c, 1, 4) == tag("RIFF")
    at = F.when(riff, 12).otherwise(0)
    rows = files.withColumns({"is_riff": riff, "riff_end": F.when(riff, read_le(c, 4, 4) + 8), "_form": F.substring(c, 9, 4) == tag("WEBP"), "_at": at})
    rows = rows.withColumns({"chunk": F.when(n >= at + 8, F.when(riff, F.substring(c, 13, 4)).otherwise(F.substring(c, 1, 4)).cast("string")), "chunk_size": F.when(n >= at + 8, F.when(riff, read_le(c, 16, 4)).otherwise(read_le(c, 4, 4)))})
    rows = rows.withColumn("chunk_end", F.expr("_at + 8 + chunk_size + chunk_size % 2"))
    problem = (
        F.when(n < 12, "no header").when(riff & ~F.col("_form"), "another form").when(riff & ~(F.col("riff_end") - 8).between(12, MOST), "size out of bounds")
        .when(n < F.col("_at") + 8, "no chunk").when(F.col("chunk_size") > MOST, "chunk too large").when(F.col("chunk_end") > F.col("riff_end"), "chunk beyond its container")
    )
    return rows.withColumns({"problem": problem, "missing": F.coalesce(F.greatest("riff_end", "chunk_end") > n, F.lit(True))}).drop("_form", "_at")


def lossy_header(width: Column, height: Column, bits: Column) -> Column:
    """A VP8 frame header; bits: key frame (0), profile, shown, size of the first partition."""
    return F.concat(le(bits, 3), F.lit(bytearray(b"\x9d\x01\x2a")), le(width, 2), le(height, 2))


def read_lossy(payload: Column, size: Column) -> list[Column]:
    """Width, height and whether a decoder takes the frame: a shown key frame of a known profile, with pixels, its first partition smaller than
    the chunk."""
    bits = read_le(payload, 0, 3)
    part = lambda at, mask: F.shiftright(bits, at).bitwiseAND(F.lit(mask))
    low14 = lambda at: read_le(payload, at, 2).bitwiseAND(F.lit(0x3FFF))
    good = (part(0, 1) == 0) & (part(1, 7) <= 3) & (part(4, 1) == 1) & (F.shiftright(bits, 5) < size) & (low14(6) > 0) & (low14(8) > 0) & (F.substring(payload, 4, 3) == F.lit(bytearray(b"\x9d\x01\x2a")))
    return [low14(6).alias("width"), low14(8).alias("height"), good.alias("valid")]


def anmf_payload(x: Column, y: Column, width: Column, height: Column, duration: Column, flags: Column) -> Column:
    return F.concat(le(x, 3), le(y, 3), le(width - 1, 3), le(height - 1, 3), le(duration, 3), le(flags, 1))


def read_anmf(payload: Column, canvas_width: Column, canvas_height: Column) -> list[Column]:
    """A frame's place, size, duration, whether it is blended and disposed of, and whether it is valid: inside its canvas, reserved bits zero."""
    x, y, w, h = 2 * read_le(payload, 0, 3), 2 * read_le(payload, 3, 3), read_le(payload, 6, 3) + 1, read_le(payload, 9, 3) + 1
    flags = byte(payload, 15)
    bit = lambda k: F.shiftright(flags, k).bitwiseAND(F.lit(1)) == 1
    valid = (x + w <= canvas_width) & (y + h <= canvas_height) & (flags < 4)
    return [x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), read_le(payload, 12, 3).alias("duration"), (~bit(1)).alias("blend"), bit(0).alias("dispose"), valid.alias("valid")]


def colour_model(form: Column, has_alpha: Column, has_animation: Column) -> Column:
    """What a decoder gives of a file: planes of lossy stills, with alpha if there is any, else straight RGBA."""
    return F.when(has_animation | (form != "lossy"), "nrgba").when(has_alpha, "nycbcra").otherwise("ycbcr")
