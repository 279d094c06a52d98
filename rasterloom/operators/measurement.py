"""Comparing codec measurements (machine, engine, mode, file, effort, bytes, ms, psnr): ordinary relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("machine", "engine", "mode", "file", "effort")
ROUND = 6


def merged(rows: DataFrame, order: str) -> DataFrame:
    """One row a key: of each column the last value, by order, that is there and positive. PSNR need only be there."""
    pick = lambda c, ok: F.max(F.when(ok, F.struct(F.col(order), F.col(c))))[c].alias(c)
    return rows.groupBy(*KEY).agg(pick("bytes", F.col("bytes") > 0), pick("ms", F.col("ms") > 0), pick("psnr", F.col("psnr").isNotNull()))


def first_effort(rows: DataFrame) -> DataFrame:
    """The row of the least effort of each machine, engine, mode and file."""
    keys = ("machine", "engine", "mode", "file")
    return rows.groupBy(*keys).agg(F.min(F.struct("effort", "bytes", "ms", "psnr")).alias("m")).select(*keys, "m.*")


def against_baseline(rows: DataFrame, baseline: str, other: str) -> DataFrame:
    """Size ratio and PSNR difference of other to baseline, by machine, mode and file, where both have a PSNR."""
    keys = ["machine", "mode", "file"]
    base = rows.where((F.col("engine") == baseline) & F.col("psnr").isNotNull()).select(*keys, F.col("bytes").alias("base_bytes"), F.col("psnr").alias("base_psnr"))
    own = rows.where((F.col("engine") == other) & F.col("psnr").isNotNull()).select(*keys, "bytes", "psnr")
    both = own.join(base, keys)
    return both.select(*keys, F.round(F.col("bytes") / F.col("base_bytes"), ROUND).alias("size_ratio"), F.round(F.col("psnr") - F.col("base_psnr"), ROUND).alias("psnr_diff"))


def extents(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Padded axis bounds of baseline points."""
    out = points.groupBy(*keys).agg(F.min("size_ratio").alias("a"), F.max("size_ratio").alias("b"), F.min("psnr_diff").alias("c"), F.max("psnr_diff").alias("d"))
    return out.select(*keys, *[F.round(e, ROUND).alias(n) for e, n in ((F.least("a", F.lit(1.0)) - 0.06, "x_min"), (F.greatest("b", F.lit(1.0)) + 0.06, "x_max"), (F.floor("c") - 0.4, "y_min"), (F.greatest("d", F.lit(0.0)) + 0.5, "y_max"))])


def geometric_mean(rows: DataFrame, value: str, keys: tuple[str, ...] = ("machine", "mode", "engine")) -> DataFrame:
    """exp of the mean logarithm of the positive values; keys without any are left out."""
    return rows.where(F.col(value) > 0).groupBy(*keys).agg(F.round(F.exp(F.avg(F.log(F.col(value).cast("double")))), ROUND).alias("gmean"), F.count(F.lit(1)).alias("n"))


def clipped(means: DataFrame) -> DataFrame:
    """Per machine and mode the scale of a bar chart: the greatest mean, but the runner-up if in this mode, on any machine, the
    greatest is more than twice the runner-up."""
    w = Window.partitionBy("machine", "mode").orderBy(F.desc("gmean"), "engine")
    two = means.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("machine", "mode").agg(F.max(F.when(F.col("k") == 1, F.col("gmean"))).alias("top"), F.max(F.when(F.col("k") == 2, F.col("gmean"))).alias("second"))
    clip = F.coalesce(F.bool_or(F.col("top") > 2 * F.col("second")).over(Window.partitionBy("mode")), F.lit(False))
    out = two.withColumn("clip", clip)
    return out.select("machine", "mode", "clip", F.when(F.col("clip") & F.col("second").isNotNull(), F.col("second")).otherwise(F.col("top")).alias("scale"))


def sweep(rows: DataFrame) -> DataFrame:
    """Totals by effort over the files measured at every effort of their machine, engine and mode; PSNR is a mean over those that have one."""
    keys = ["machine", "engine", "mode"]
    good = rows.where("ms > 0 and bytes > 0")
    efforts = good.select(*keys, "effort").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("efforts"))
    full = good.groupBy(*keys, "file").agg(F.count(F.lit(1)).alias("c")).join(efforts, keys).where("c = efforts").select(*keys, "file")
    whole = good.join(full, [*keys, "file"], "left_semi")
    return whole.groupBy(*keys, "effort").agg(
        F.round(F.sum("ms") / 1000, ROUND).alias("seconds"), F.round(F.sum("bytes") / 1048576, ROUND).alias("mib"), F.round(F.avg("psnr"), ROUND).alias("psnr"), F.count("psnr").alias("images")
    )


def moving_settings(curve: DataFrame, value: str, step: float) -> DataFrame:
    """The efforts at which a curve's value has moved by at least step of the last kept one. The first is always kept.

    A fold over each curve's few points in order: what is kept depends on what was kept before, which lag() doesn't know."""
    keys = ["machine", "engine", "mode"]
    points = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("effort", F.col(value).alias("v")))).alias("points"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.expr("cast(array() as array<bigint>)").alias("kept"))

    def fold(acc: Column, p: Column) -> Column:
        moved = acc["last"].isNull() | (F.abs(p["v"] - acc["last"]) >= step * acc["last"])
        return F.when(moved, F.struct(p["v"].alias("last"), F.concat(acc["kept"], F.array(p["effort"])).alias("kept"))).otherwise(acc)

    return points.select(*keys, F.explode(F.aggregate("points", start, fold, lambda acc: acc["kept"])).alias("effort"))


def outlier_top(values: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """The value below the widest gap, on a log axis, if that is at least 0.25 wide, three times any other and in the upper half of at
    least four distinct values; else the greatest."""
    logs = values.where(F.col(value) > 0).select(*keys, F.round(F.log10(F.col(value).cast("double")), 9).alias("v")).distinct()
    w = Window.partitionBy(*keys)
    rows = logs.withColumns({"i": F.row_number().over(w.orderBy("v")) - 1, "n": F.count(F.lit(1)).over(w), "below": F.lag("v").over(w.orderBy("v"))}).withColumn("gap", F.round(F.col("v") - F.col("below"), 9))
    ranked = rows.withColumn("g", F.row_number().over(w.orderBy(F.desc_nulls_last("gap"), "i")))
    out = ranked.groupBy(*keys).agg(
        F.max("v").alias("top"), F.max("n").alias("n"), F.max(F.when(F.col("g") == 1, F.col("gap"))).alias("widest"), F.max(F.when(F.col("g") == 2, F.col("gap"))).alias("runner"),
        F.max(F.when(F.col("g") == 1, F.col("i"))).alias("at"), F.max(F.when(F.col("g") == 1, F.col("below"))).alias("under"),
    )
    jump = "n >= 4 and widest >= 0.25 and widest >= 3 * coalesce(runner, 0) and at >= n div 2"
    return out.select(*keys, F.round(F.pow(F.lit(10.0), F.expr(f"CASE WHEN {jump} THEN under ELSE top END")), 3).alias("limit"), F.expr(f"coalesce({jump}, false)").alias("jumps"))


def short_name(file: Column) -> Column:
    """The subject of a photo's file name: without extension and "pexels-", up to its first number; all of it if it begins with one."""
    name = F.regexp_replace(F.regexp_replace(file, r"\.[^./]*$", ""), "^pexels-", "")
    words = F.regexp_replace(name, r"(^|-)[+-]?[0-9]+(-.*)?$", "")
    return F.when(words == "", name).otherwise(words)


def duration(ms: Column) -> Column:
    return F.when(ms >= 10000, F.format_string("%.0f s", ms / 1000)).when(ms >= 1000, F.format_string("%.1f s", ms / 1000)).otherwise(F.format_string("%.0f ms", ms))


def parsed(lines: DataFrame) -> DataFrame:
    """Measurement rows of a result file's lines (path, n, line): fenced blocks under "## " headings, whose caption, the last line of text
    before the fence, tells what they hold. Commas and blanks both part fields, and either column order will do.

    The heading and the caption are carried down by windows in line order; a result file is small, and one window's input."""
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"fence": F.col("line").startswith("```"), "head": F.col("line").startswith("## ")})
    rows = rows.withColumns({"fences": F.sum(F.col("fence").cast("int")).over(w), "heading": F.last(F.when(F.col("head"), F.trim(F.expr("substring(line, 4)"))), True).over(w)})
    text = ~F.col("fence") & ~F.col("head") & (F.col("fences") % 2 == 0) & (F.trim("line") != "")
    # a heading or a fence ends a caption
    state = F.when(text, F.trim("line")).when(F.col("head") | F.col("fence"), F.lit(""))
    rows = rows.withColumn("caption", F.last(state, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("caption", F.last(F.when(F.col("fence") & (F.col("fences") % 2 == 1), F.coalesce("caption", F.lit(""))), True).over(w))
    body = rows.where((F.col("fences") % 2 == 1) & ~F.col("fence"))
    p = F.split(F.trim(F.regexp_replace("line", r"[,\s]+", " ")), " ")
    body = body.withColumns({"p": p, "decode": F.col("caption").startswith("Decode"), "sweep": F.col("caption").startswith("Effort sweep")}).where(~F.get("p", F.lit(0)).isin("file", "engine", ""))
    at = lambda i: F.get("p", F.lit(i))
    number = lambda c, kind: F.expr(f"try_cast({c} as {kind})")
    swap = F.when(F.col("sweep"), at(2).rlike(r"^[+-]?[0-9]+$")).otherwise(at(2).startswith("loss"))
    size = F.size("p")
    out = body.withColumns({"swap": swap, "size": size}).where(F.when(F.col("sweep"), F.col("size") == 10).otherwise(F.col("size").isin(8, 9)))
    return out.select(
        "path", "n", "heading",
        F.when(F.col("swap"), at(0)).otherwise(at(2)).alias("engine"),
        F.concat(F.when(F.col("sweep"), "sweep-").when(F.col("decode"), "decode-").otherwise(""), at(1)).alias("mode"),
        F.when(F.col("swap") & F.col("sweep"), at(3)).when(F.col("swap"), at(2)).otherwise(at(0)).alias("file"),
        F.when(F.col("sweep"), F.when(F.col("swap"), number("get(p, 2)", "bigint")).otherwise(number("get(p, 3)", "bigint"))).alias("effort"),
        F.when(F.col("sweep"), number("get(p, 6)", "bigint")).when((F.col("size") == 9) & ~F.col("decode"), number("get(p, 5)", "bigint")).alias("bytes"),
        F.when(F.col("sweep"), number("get(p, 7)", "double")).when((F.col("size") == 9) & ~F.col("decode"), number("get(p, 6)", "double")).alias("psnr"),
        F.when(F.col("sweep"), number("get(p, 9)", "double")).when(F.col("decode"), number("get(p, size - 1)", "double")).when(F.col("size") == 9, number("get(p, 8)", "double")).alias("ms"),
        F.when(~F.col("sweep") & ~F.col("decode") & (F.col("size") == 8), number("get(p, 7)", "double")).alias("mib_per_mp"),
    ).where("coalesce(bytes, ms, mib_per_mp) is not null")


def aligned(rows: DataFrame, columns: tuple[str, ...], order: tuple[str, ...] = ("engine", "mode", "file", "effort")) -> DataFrame:
    """(n, line): the rows as lines of comma-separated columns, and each one's number in the order given, from 1 on.

    A range partitioning sorts the rows; each partition's numbers go on from the rows before it, so that no task holds them all."""
    held = rows.select(*columns, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    by = [f"_o{i}" for i in range(len(order))] + list(columns)
    parted = held.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = parted.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("c"))
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return parted.join(F.broadcast(before), part == F.col("_p")).select((F.col("before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("n"), line.alias("line"))


def csv_sink(rows: DataFrame, path: str, columns: tuple[str, ...], order: tuple[str, ...] = ("engine", "mode", "file", "effort")) -> None:
    """Writes columns of rows as comma-separated files, in order over the files taken by name."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns).write.mode("error").csv(path, header=True)


def files(rows: DataFrame) -> DataFrame:
    """The distinct files of each machine, and their numbers by name."""
    own = rows.select("machine", "file").distinct()
    return own.withColumn("n", F.row_number().over(Window.partitionBy("machine").orderBy("file")).cast("long"))


def cases(images: DataFrame, knobs: list[tuple[str, str, int, int]], engines: tuple[str, ...] = ()) -> DataFrame:
    """(file, engine, mode, effort): every effort of each (engine, mode, least, most) for each image; engines, if any, are the ones wanted.

    The knobs are a short list, so they are exploded in each image's row."""
    kept = [k for k in knobs if not engines or k[0] in engines]
    rows = [F.struct(F.lit(e).alias("engine"), F.lit(m).alias("mode"), F.lit(x).cast("long").alias("effort")) for e, m, low, high in kept for x in range(low, high + 1)]
    return images.select("file", F.explode(F.array(*rows)).alias("c")).select("file", "c.*") if rows else images.selectExpr("file", "'' as engine", "'' as mode", "0L as effort").limit(0)


def ticks(extents: DataFrame, keys: tuple[str, ...], steps: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """The marks of a log axis from low to high: steps times the powers of ten."""
    powers = F.sequence(F.floor(F.log10("low")).cast("int"), F.ceil(F.log10("high")).cast("int"))
    marks = F.flatten(F.transform(powers, lambda e: F.array(*[F.round(F.pow(F.lit(10.0), e) * s, 9) for s in steps])))
    return extents.select(*keys, "low", "high", F.explode(marks).alias("tick")).where("tick >= low - 1e-9 and tick <= high + 1e-9").select(*keys, "tick")


def mib_per_megapixel(peak_kib: Column, base_kib: Column, width: Column, height: Column) -> Column:
    """Memory beyond what an idle process takes, by the image's size; none below zero."""
    return F.round(F.greatest(F.lit(0.0), (peak_kib - base_kib) / 1024.0) / (width * height / 1e6), ROUND)


def timed(of, seconds: float = 1.0, least: int = 3) -> tuple[int, float]:
    """(runs, least milliseconds of a run) of calling of() until seconds are over, least times at least, after one call that doesn't count."""
    import time

    of()
    runs, best, began = 0, float("inf"), time.perf_counter()
    while runs < least or time.perf_counter() - began < seconds:
        at = time.perf_counter()
        of()
        runs, best = runs + 1, min(best, 1000 * (time.perf_counter() - at))
    return runs, best
