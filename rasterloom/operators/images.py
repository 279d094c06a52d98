"""Images as DataFrames: files to features, pixels and frames, and back. One image a kernel call, parallel over images.

Sequential bitstreams run in Python over Arrow batches; failures are columns (error_kind, error_msg) in permissive mode, the default, and
raise in strict mode. Rows carry whole images: read_files() sets the records of an Arrow batch to BATCH where the session has the
default, and each image's result is a batch of its own, so that a task holds few images at a time. Lossy images need the format's
probability tables, a file that every worker finds at the path given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import raster_kernels as k
from rasterloom.sources import bitmaps, webp

FEATURES = "width int, height int, has_alpha boolean, has_animation boolean, format string"
IMAGE = "width int, height int, rgba binary"
ERRORS = "error_kind string, error_msg string"


#: Records of an Arrow batch of images.
BATCH = 16
#: Pixels of an Arrow batch of the pixel table.
PIXELS = 1 << 16
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_files(spark: SparkSession, path: str, glob: str = "*.webp") -> DataFrame:
    """path, length and content of files; content is read only where it is selected."""
    if spark.conf.get(_RECORDS) == "10000":
        spark.conf.set(_RECORDS, str(BATCH))
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def listing(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """path, name and length of a folder's own files of the kinds given, in any letter case, in order of their names; no content is read."""
    found = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return found.where(F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(*kinds)).orderBy("name")


def photos(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png,JPG,JPEG,PNG}", strict: bool = False) -> DataFrame:
    """path, width, height and straight RGBA of JPEG and PNG files of every kind that Java's decoders read, by Spark's image source."""
    import numpy as np

    def of(v) -> tuple:
        if v["height"] < 0:
            raise webp.WebpError("bitstream", "not an image that can be read")
        bgr = np.frombuffer(bytes(v["data"]), np.uint8).reshape(v["height"], v["width"], v["nChannels"])
        px = np.full((*bgr.shape[:2], 4), 255, np.uint8)
        px[..., :3] = bgr if v["nChannels"] == 1 else bgr[..., 2::-1]
        if v["nChannels"] == 4:
            px[..., 3] = bgr[..., 3]
        return v["width"], v["height"], px.tobytes()

    found = spark.read.format("image").option("pathGlobFilter", glob).load(path)
    return _mapped(found.select(F.col("image.origin").alias("path"), "image"), IMAGE, of, "image", strict)


def _mapped(df: DataFrame, schema: str, of: Callable, column: str, strict: bool, many: bool = False) -> DataFrame:
    """df's other columns with those that of() makes of column's value: a tuple, or several where many."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    keep = [c for c in df.columns if c != column]
    whole = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], schema, ERRORS])

    made_of = [c.strip().split(" ") for c in f"{schema}, {ERRORS}".split(",")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
        for batch in batches:
            held = batch.select(keep)
            values = batch.column(batch.schema.get_field_index(column))
            for r in range(batch.num_rows):
                try:
                    value = values[r].as_py()
                    if value is None:
                        raise webp.short("no content")
                    made = [(*m, None, None) for m in (of(value) if many else [of(value)])]
                except (ValueError, IndexError, KeyError, OverflowError) as e:
                    if strict:
                        raise
                    made = [(*[None] * len(names), getattr(e, "kind", "bitstream"), str(e))]
                own = [pa.concat_arrays([c] * len(made)) if len(made) != 1 else c for c in held.slice(r, 1).columns]
                cells = [pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*made, strict=True), made_of, strict=True)]
                if made:
                    yield pa.RecordBatch.from_arrays([*own, *cells], [*keep, *[n for n, _ in made_of]])

    return df.mapInArrow(run, whole)


def _tables(path: str | None) -> Callable:
    """A function that gives the probability tables, read once by each task that needs them."""
    held: list = []

    def read():
        if path and not held:
            from rasterloom.functions.vp8_frames import Tables

            held.append(Tables.read(path))
        return held[0] if held else None

    return read


def features(files: DataFrame, content: str = "content", strict: bool = False) -> DataFrame:
    def of(data: bytes) -> tuple:
        f = webp.features(data)
        return f.width, f.height, f.has_alpha, f.has_animation, f.format

    return _mapped(files, FEATURES, of, content, strict)


def chunks(files: DataFrame, content: str = "content", strict: bool = False) -> DataFrame:
    """A row for each chunk of each file."""
    def of(data: bytes) -> Iterator[tuple]:
        for n, c in enumerate(webp.chunks(data)):
            yield n, c.fourcc.decode("latin-1"), c.offset, c.size, c.padded, c.start

    return _mapped(files, "ordinal int, fourcc string, offset long, size long, padded_size long, data_offset long", of, content, strict, True)


_READERS = {"webp": k.decode, "bmp": bitmaps.read_bmp, "png": bitmaps.read_png}


def decoded(files: DataFrame, content: str = "content", kind: str = "webp", strict: bool = False, tables: str | None = None) -> DataFrame:
    """width, height and straight RGBA, row by row, of webp, bmp or png files; tables: the path of the probability tables."""
    read, own = _READERS[kind], _tables(tables)

    def of(data: bytes) -> tuple:
        px = read(data, own()) if kind == "webp" else read(data)
        return px.shape[1], px.shape[0], px.tobytes()

    return _mapped(files, IMAGE, of, content, strict)


def planes(files: DataFrame, tables: str, content: str = "content", strict: bool = False) -> DataFrame:
    """width, height and limited-range planes of lossy files; a is null without an alpha plane."""
    own = _tables(tables)

    def of(data: bytes) -> tuple:
        (y, u, v), a = k.decode_planes(data, own())
        return y.shape[1], y.shape[0], y.tobytes(), u.tobytes(), v.tobytes(), None if a is None else a.tobytes()

    return _mapped(files, "width int, height int, y binary, u binary, v binary, a binary", of, content, strict)


def frames(files: DataFrame, content: str = "content", strict: bool = False, tables: str | None = None) -> DataFrame:
    """A row for each frame: its duration and the whole canvas; a still image is one frame of no duration."""
    own = _tables(tables)

    def of(data: bytes) -> Iterator[tuple]:
        if webp.features(data).has_animation:
            for n, (ms, px) in enumerate(k.decode_animation(data, own())):
                yield n, ms, px.shape[1], px.shape[0], px.tobytes()
        else:
            px = k.decode(data, own())
            yield 0, 0, px.shape[1], px.shape[0], px.tobytes()

    return _mapped(files, "frame_idx int, duration_ms int, " + IMAGE, of, content, strict, True)


def encoded(images: DataFrame, kind: str = "webp", effort: int = 6, exif: bytes | None = None, strict: bool = False, quality: float = 90, tables: str | None = None) -> DataFrame:
    """content of images (width, height, rgba), as webp (lossless), lossy (which needs tables), bmp or png."""
    import numpy as np

    own = _tables(tables)

    def of(v: dict) -> tuple:
        v = v.asDict() if hasattr(v, "asDict") else v
        if not v["width"] or not v["height"] or v["width"] < 0 or len(v["rgba"] or b"") != v["width"] * v["height"] * 4:
            raise webp.WebpError("invalid_param", "pixels do not match the image size")
        px = np.frombuffer(bytes(v["rgba"]), np.uint8).reshape(v["height"], v["width"], 4)
        return ({"webp": lambda: k.encode(px, effort, exif), "lossy": lambda: k.encode_lossy(px, own(), quality, exif), "bmp": lambda: bitmaps.write_bmp(px), "png": lambda: bitmaps.write_png(px)}[kind](),)

    packed = images.select(*[c for c in images.columns if c not in ("width", "height", "rgba")], F.struct("width", "height", "rgba").alias("_image"))
    return _mapped(packed, "content binary", of, "_image", strict)


def pixels(images: DataFrame, key: str) -> DataFrame:
    """The pixel table (img, x, y, r, g, b, a) of decoded images, in batches of PIXELS; images without pixels have no rows."""
    held = images.select(F.col(key).alias("img"), "width", "rgba").where("width > 0 and rgba is not null")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            img, width, rgba = batch.columns
            for r in range(batch.num_rows):
                raw, w = np.frombuffer(rgba[r].as_buffer(), np.uint8).reshape(-1, 4), width[r].as_py()
                for begin in range(0, len(raw), PIXELS):
                    part = raw[begin : begin + PIXELS].astype(np.int64)
                    y, x = np.divmod(np.arange(begin, begin + len(part)), w)
                    yield pa.RecordBatch.from_arrays([pa.repeat(img[r], len(part)), *map(pa.array, (x, y, *part.T))], ["img", "x", "y", *"rgba"])

    return held.mapInArrow(run, f"img {held.schema['img'].dataType.simpleString()}, x long, y long, r long, g long, b long, a long")


def register(spark: SparkSession) -> None:
    """SQL functions webp_features(content), webp_decode_rgba(content), webp_encode_lossless(width, height, rgba, effort) and psnr_rgb(width, height, a, b)."""
    import numpy as np

    def safe(of):
        def run(*args):
            try:
                return None if any(a is None for a in args) else of(*args)
            except (ValueError, IndexError, KeyError):
                return None

        return run

    read = safe(lambda c: (lambda f: {"width": f.width, "height": f.height, "has_alpha": f.has_alpha, "has_animation": f.has_animation, "format": f.format})(webp.features(bytes(c))))
    pix = safe(lambda c: (lambda px: {"width": px.shape[1], "height": px.shape[0], "rgba": px.tobytes()})(k.decode(bytes(c))))
    plane = lambda w, h, v: np.frombuffer(bytes(v), np.uint8).reshape(h, w, 4)
    put = safe(lambda w, h, v, e: k.encode(plane(w, h, v), int(e)))
    db = safe(lambda w, h, a, b: k.psnr(plane(w, h, a), plane(w, h, b)))

    @F.pandas_udf(FEATURES)
    def webp_features(c: pd.Series) -> pd.DataFrame:
        names = [n.strip().split(" ")[0] for n in FEATURES.split(",")]
        return pd.DataFrame([read(x) or dict.fromkeys(names) for x in c], columns=names)

    @F.pandas_udf(IMAGE)
    def webp_decode_rgba(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pix(x) or dict.fromkeys(("width", "height", "rgba")) for x in c], columns=["width", "height", "rgba"])

    @F.pandas_udf("binary")
    def webp_encode_lossless(w: pd.Series, h: pd.Series, v: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([put(*x) for x in zip(w, h, v, e, strict=True)], dtype=object)

    @F.pandas_udf("double")
    def psnr_rgb(w: pd.Series, h: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([db(*x) for x in zip(w, h, a, b, strict=True)], dtype=float)

    for f in (webp_features, webp_decode_rgba, webp_encode_lossless, psnr_rgb):
        spark.udf.register(f.__name__ if hasattr(f, "__name__") else f.func.__name__, f)
