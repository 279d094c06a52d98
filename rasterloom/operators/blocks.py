"""Block operators on samples (img, x, y, s): errors, transforms and quantization of 4 x 4 blocks.

A block is a row of 16 columns, made by one aggregate; transforms are then column expressions in whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import formulas as f

#: A column of a block's 16 values.
C = [f"c{k}" for k in range(16)]


def pivoted(samples: DataFrame, value: str = "s") -> DataFrame:
    """(img, bi, bj, c0..c15): the 4 x 4 blocks of a plane, row by row."""
    at = samples.select("img", F.shiftright("x", 2).alias("bi"), F.shiftright("y", 2).alias("bj"), F.expr("(y & 3) * 4 + (x & 3)").alias("k"), F.col(value).alias("v"))
    return at.groupBy("img", "bi", "bj").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(C[k]) for k in range(16)])


def stage(blocks: DataFrame, formulas: list[str]) -> DataFrame:
    """The blocks with each of their columns replaced by a formula over them."""
    return blocks.select("img", "bi", "bj", *[F.expr(e).alias(c) for e, c in zip(formulas, C, strict=True)])


def forward_dct(blocks: DataFrame) -> DataFrame:
    return stage(stage(blocks, f.dct_rows(C)), f.dct_columns(C))


def inverse_dct(blocks: DataFrame) -> DataFrame:
    return stage(stage(blocks, f.idct_columns(C)), f.idct_rows(C))


def forward_wht(blocks: DataFrame) -> DataFrame:
    half = [f"({x} >> 1)" for x in f.transposed(f.hadamard(f.transposed(C)))]
    return stage(stage(blocks, f.hadamard(C)), half)


def inverse_wht(blocks: DataFrame) -> DataFrame:
    return stage(stage(blocks, f.wht_inverse_columns(C)), f.wht_inverse_rows(C))


def satd(blocks: DataFrame) -> DataFrame:
    """(img, bi, bj, satd) of residual blocks: weighted sums of absolute Hadamard coefficients."""
    done = stage(stage(blocks, f.hadamard(C)), f.transposed(f.hadamard(f.transposed(C))))
    return done.select("img", "bi", "bj", F.expr("(" + " + ".join(f"{w} * abs({c})" for w, c in zip(f.SATD_WEIGHTS, C, strict=True)) + ") >> 5").alias("satd"))


def quantize(blocks: DataFrame, dc: int, ac: int) -> DataFrame:
    return stage(blocks, [f.quantized(c, str(dc if k == 0 else ac)) for k, c in enumerate(C)])


def dequantize(blocks: DataFrame, dc: int, ac: int) -> DataFrame:
    return stage(blocks, [f"{c} * {dc if k == 0 else ac}" for k, c in enumerate(C)])


def scanned(blocks: DataFrame) -> DataFrame:
    """(img, bi, bj, levels, last): coefficients in coding order and the place after the last that isn't zero."""
    order = F.array(*[F.col(C[k]) for k in f.ZIGZAG])
    rows = blocks.select("img", "bi", "bj", order.alias("levels"))
    last = F.array_max(F.transform("levels", lambda v, i: F.when(v != 0, i + 1).otherwise(0)))
    return rows.withColumn("last", last.cast("long"))


def unpivoted(blocks: DataFrame) -> DataFrame:
    """(img, x, y, s) of blocks."""
    cells = F.posexplode(F.array(*C)).alias("k", "s")
    return blocks.select("img", "bi", "bj", cells).select("img", F.expr("bi * 4 + k % 4").alias("x"), F.expr("bj * 4 + k div 4").alias("y"), "s")


def squared_error(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("img",)) -> DataFrame:
    """Per keys of two planes: squared and absolute error and the number of samples."""
    both = a.join(b.withColumnRenamed("s", "t"), ["img", "x", "y"])
    d = F.col("s") - F.col("t")
    return both.groupBy(*keys).agg(F.sum(d * d).alias("sse"), F.sum(F.abs(d)).alias("sad"), F.count(F.lit(1)).alias("n"))


def psnr(errors: DataFrame) -> DataFrame:
    """Adds the two conventions' PSNR: infinite for identical planes as null, and 99; and the mean absolute difference."""
    db = F.expr("round(10 * log10(65025 / (sse / n)), 6)")
    return errors.withColumns({"psnr": F.when(F.col("sse") > 0, db), "psnr_99": F.when(F.col("sse") > 0, db).otherwise(99.0), "mean_abs": F.round(F.col("sad") / F.col("n"), 6)})


def satd_grid(blocks: DataFrame) -> DataFrame:
    """Per image the sum of its blocks' weighted Hadamard errors."""
    return satd(blocks).groupBy("img").agg(F.sum("satd").alias("satd"), F.count(F.lit(1)).alias("blocks"))


def frame_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per image of two tables of samples (img, plane, x, y, v): squared error over all planes, samples, and those only one of them has."""
    both = a.select("img", "plane", "x", "y", "v").join(b.select("img", "plane", "x", "y", F.col("v").alias("w")), ["img", "plane", "x", "y"], "full")
    d = F.col("v") - F.col("w")
    return both.groupBy("img").agg(F.coalesce(F.sum(d * d), F.lit(0)).alias("sse"), F.count(d).alias("n"), F.sum((F.col("v").isNull() | F.col("w").isNull()).cast("long")).alias("unmatched"))


def quality(errors: DataFrame) -> DataFrame:
    """frame_error()'s rows by three conventions: psnr is null without an error or where samples are missing, psnr_99 is 99 and -1 there, told
    is "-", null, or the value in two places."""
    db, whole = F.expr("10 * log10(65025 / (sse / n))"), F.col("unmatched") == 0
    differ = whole & (F.col("sse") > 0)
    return errors.withColumns({
        "psnr": F.when(differ, F.round(db, 6)), "psnr_99": F.when(~whole, -1.0).when(differ, F.round(db, 6)).otherwise(99.0), "told": F.when(differ, F.format_string("%.2f", F.round(db, 6))).when(whole, "-"),
    })
