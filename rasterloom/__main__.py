"""python -m rasterloom encode|decode -in FILE -out FILE [-lossless] [-quality Q] [-optimize N] [-tables FILE]: one image, on this machine.

Lossy files are written with -tables, the format's probability tables, unless -lossless is given, and read with -tables only.

Input to encode is PNG or BMP, output of decode PNG or BMP, by the file's name."""

from __future__ import annotations

import argparse
from pathlib import Path

from rasterloom.functions import raster_kernels, vp8_frames
from rasterloom.sources import bitmaps


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rasterloom", description=__doc__)
    parser.add_argument("what", choices=("encode", "decode"))
    parser.add_argument("-in", dest="source", type=Path, required=True)
    parser.add_argument("-out", dest="target", type=Path, required=True)
    parser.add_argument("-lossless", action="store_true")
    parser.add_argument("-quality", type=float, default=90)
    parser.add_argument("-optimize", type=int, default=4)
    parser.add_argument("-tables", type=Path)
    own = parser.parse_args(args)
    tables = vp8_frames.Tables.read(str(own.tables)) if own.tables else None
    data = own.source.read_bytes()
    if own.what == "encode":
        px = (bitmaps.read_bmp if own.source.suffix.lower() == ".bmp" else bitmaps.read_png)(data)
        out = raster_kernels.encode(px, own.optimize) if own.lossless or tables is None else raster_kernels.encode_lossy(px, tables, own.quality)
    else:
        px = raster_kernels.decode(data, tables)
        out = (bitmaps.write_bmp if own.target.suffix.lower() == ".bmp" else bitmaps.write_png)(px)
    own.target.write_bytes(out)
    print(f"{own.what}d {own.source} ({px.shape[1]}x{px.shape[0]}) -> {own.target} ({len(out)} bytes)")


if __name__ == "__main__":
    main()
