"""Animations: compositing frames onto a canvas, blending, frame paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import formulas as f


def composited(frames: DataFrame, width: int, height: int, background: int = 0) -> DataFrame:
    """(anim, k, x, y, v) of opaque frames (anim, k from 0 on without gaps, x0, y0, w, h, v, dispose): the whole canvas after each.

    Before a frame is drawn, the rectangle of the one before it is cleared if that asked for it. Only places that a frame draws or clears
    become rows, and the whole canvas once; a window over a place's rows tells how long each value stays, and it is repeated for as long."""
    by_frame = Window.partitionBy("anim").orderBy("k")
    names, empty = ("x0", "y0", "w", "h", "v"), F.lit(background)
    rect = lambda *values: F.struct(*[v.cast("long").alias(n) for n, v in zip(names, values, strict=True)])
    place = [F.col(c) for c in names[:4]]
    drawn, cleared = rect(*place, F.col("v")), F.lag(F.when(F.col("dispose"), rect(*place, empty))).over(by_frame)
    canvas = F.when(F.col("k") == 0, rect(F.lit(0), F.lit(0), F.lit(width), F.lit(height), empty))
    ends = F.max("k").over(Window.partitionBy("anim")) + 1
    told = frames.select("anim", "k", ends.alias("n"), F.array(canvas, cleared, drawn).alias("r"))
    rects = told.select("anim", "k", "n", F.posexplode("r").alias("o", "r")).where("r is not null and r.w > 0 and r.h > 0")
    at = rects.select("anim", "k", "n", "o", "r", F.explode(F.expr("sequence(0L, r.w * r.h - 1)")).alias("p"))
    at = at.select("anim", "k", "n", "o", F.expr("r.x0 + p % r.w").alias("x"), F.expr("r.y0 + p div r.w").alias("y"), F.expr("r.v").alias("v")).where(f"x between 0 and {width - 1} and y between 0 and {height - 1}")
    until = F.coalesce(F.lead("k").over(Window.partitionBy("anim", "x", "y").orderBy("k", "o")), F.col("n"))
    stays = at.withColumn("until", until).where("until > k")
    return stays.select("anim", F.explode(F.expr("sequence(cast(k as long), cast(until as long) - 1)")).alias("k"), "x", "y", "v")


def blend(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pixels of source, with straight alpha, over those of target."""
    both = source.join(target.select("img", "x", "y", *[F.col(c).alias(f"q{c}") for c in "rgba"]), ["img", "x", "y"])
    colour = [F.expr(f.blended(c, f"q{c}", "a", "qa")).cast("long").alias(c) for c in "rgb"]
    return both.select("img", "x", "y", *colour, F.expr(f.blended_alpha("a", "qa")).cast("long").alias("a"))


def frame_path(stem: Column, k: Column) -> Column:
    return F.format_string("%s_%04d.bmp", stem, k)
