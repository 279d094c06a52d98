"""Neighbour operators: lossless predictors, residuals, and the filters whose inverse is a running sum.

All neighbours of a pixel come from one sort of its image: the windows share partition and order, so it is one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import formulas as f
from rasterloom.operators.pixels import beside

MODES = 14


def _near(pixels: DataFrame, width: int) -> DataFrame:
    """Adds _l, _t, _tl, _tr, the packed neighbours. A pixel's four bytes are one number, so that a window carries one value a neighbour and not four."""
    w = Window.partitionBy("img").orderBy("y", "x")
    whole = pixels.withColumn("_argb", F.expr("shiftleft(a, 24) | shiftleft(r, 16) | shiftleft(g, 8) | b"))
    return whole.withColumns({f"_{p}": F.lag("_argb", back).over(w) for p, back in (("l", 1), ("t", width), ("tl", width + 1), ("tr", width - 1))}).drop("_argb")


def _apart(near: DataFrame) -> DataFrame:
    """l_, t_, tl_, tr_ of each channel, of packed neighbours."""
    cols = {f"{p}_{c}": F.expr(f"shiftright(_{p}, {shift}) & 255") for c, shift in (("r", 16), ("g", 8), ("b", 0), ("a", 24)) for p in ("l", "t", "tl", "tr")}
    return near.withColumns(cols).drop("_l", "_t", "_tl", "_tr")


def with_neighbours(pixels: DataFrame, width: int) -> DataFrame:
    """Adds l_, t_, tl_, tr_ of each channel, of images width pixels wide. To the right of the last column stands the row's own first pixel."""
    return _apart(_near(pixels, width))


def guess(mode: int, c: str, d: f.Dialect = f.SPARK) -> str:
    """The prediction with the borders' rules: black, then left along the first row, top along the first column."""
    return f"(CASE WHEN y = 0 AND x = 0 THEN {f.predicted(0, c)} WHEN y = 0 THEN l_{c} WHEN x = 0 THEN t_{c} ELSE {f.predicted(mode, c, d)} END)"


def error(mode: int, d: f.Dialect = f.SPARK) -> str:
    return " + ".join(f.wrapped_error(c, guess(mode, c, d)) for c in f.CHANNELS)


def _inner(c: str = "") -> list[str]:
    """The fourteen predictions of a pixel with all its neighbours, over columns l, t, tl, tr, the means lt, ltl, ttr, and nearer."""
    l, t, tl, tr, lt, ltl, ttr = (f"{p}{c}" for p in ("l", "t", "tl", "tr", "lt", "ltl", "ttr"))
    mean = f.average
    return [
        f"black{c}", l, t, tr, tl, mean(mean(l, tr), t), ltl, lt, mean(tl, t), ttr, mean(ltl, ttr),
        f"CASE WHEN nearer THEN {t} ELSE {l} END", f.clip(f"({l} + {t} - {tl})"), f.clip(f"({lt} + (({lt} - {tl}) div 2))"),
    ]


_NEARER = "({}) - ({}) <= 0".format(*(" + ".join(f"abs({p}_{c} - tl_{c})" for c in f.CHANNELS) for p in ("l", "t")))


def costs(pixels: DataFrame, width: int, bits: int = 3) -> DataFrame:
    """(img, tx, ty, mode, cost) of each predictor mode on each tile of 2^bits pixels a side.

    Channels are taken apart into rows first: fourteen errors of one channel make a method that the JIT compiles, all four don't. What
    needs all channels at once, which neighbour is nearer, is worked out before."""
    near = with_neighbours(pixels, width).withColumns({"nearer": F.expr(_NEARER), "edge": F.expr("CASE WHEN y = 0 AND x = 0 THEN 1 WHEN y = 0 THEN 2 WHEN x = 0 THEN 3 ELSE 0 END")})
    parts = F.explode(F.array(*[F.struct(F.col(c).alias("v"), *[F.col(f"{p}_{c}").alias(p) for p in ("l", "t", "tl", "tr")], F.lit(255 if c == "a" else 0).alias("black")) for c in f.CHANNELS]))
    rows = near.select("img", F.shiftright("x", bits).alias("tx"), F.shiftright("y", bits).alias("ty"), "nearer", "edge", parts.alias("c")).select("img", "tx", "ty", "nearer", "edge", "c.*")
    rows = rows.withColumns({"lt": F.expr(f.average("l", "t")), "ltl": F.expr(f.average("l", "tl")), "ttr": F.expr(f.average("t", "tr"))})
    rows = rows.select("img", "tx", "ty", "v", F.expr("CASE edge WHEN 1 THEN black WHEN 2 THEN l WHEN 3 THEN t END").alias("fixed"), *[F.expr(e).alias(f"g{m}") for m, e in enumerate(_inner())])
    sums = rows.groupBy("img", "tx", "ty").agg(*[F.expr(f"sum(128 - abs(128 - abs(v - coalesce(fixed, g{m}))))").alias(f"e{m}") for m in range(MODES)])
    cells = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("mode"), F.col(f"e{m}").alias("cost")) for m in range(MODES)]))
    return sums.select("img", "tx", "ty", cells.alias("c")).select("img", "tx", "ty", "c.*")


def best_modes(pixels: DataFrame, width: int, bits: int = 3) -> DataFrame:
    """(img, tx, ty, mode, cost): the cheapest mode of each tile, of equal ones the lowest."""
    return costs(pixels, width, bits).groupBy("img", "tx", "ty").agg(F.min(F.struct("cost", "mode")).alias("m")).select("img", "tx", "ty", "m.mode", "m.cost")


def residuals(pixels: DataFrame, modes: DataFrame, width: int, bits: int = 3) -> DataFrame:
    """Pixels less their prediction under their tile's mode, channel by channel modulo 256.

    The borders' rules are modes 0, 1 and 2 themselves, so a pixel's own mode settles its prediction."""
    tiled = _near(pixels, width).withColumns({"tx": F.shiftright("x", bits), "ty": F.shiftright("y", bits)})
    rows = _apart(beside(tiled, modes.select("img", "tx", "ty", "mode"), ("img", "tx", "ty")))
    cols = {"nearer": F.expr(_NEARER), "mode": F.expr("CASE WHEN y = 0 AND x = 0 THEN 0 WHEN y = 0 THEN 1 WHEN x = 0 THEN 2 ELSE mode END")}
    for c in f.CHANNELS:
        cols |= {f"lt_{c}": F.expr(f.average(f"l_{c}", f"t_{c}")), f"ltl_{c}": F.expr(f.average(f"l_{c}", f"tl_{c}")), f"ttr_{c}": F.expr(f.average(f"t_{c}", f"tr_{c}")), f"black_{c}": F.lit(255 if c == "a" else 0)}
    rows = rows.withColumns(cols)
    pick = lambda c: "CASE mode " + " ".join(f"WHEN {m} THEN {e}" for m, e in enumerate(_inner(f"_{c}"))) + " END"
    return rows.select("img", "x", "y", *[F.expr(f"({c} - ({pick(c)})) & 255").alias(c) for c in "rgba"])


def filtered(samples: DataFrame, kind: str) -> DataFrame:
    """An alpha plane (img, x, y, s) less its horizontal or vertical neighbour; a row's first sample is predicted from the row
    above, the first row from the left."""
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    left, top = F.coalesce(F.lag("s").over(row), F.lit(0)), F.coalesce(F.lag("s").over(column), F.lit(0))
    if kind == "horizontal":
        near = F.when(F.col("x") == 0, top).otherwise(left)
    else:
        near = F.when(F.col("y") == 0, left).otherwise(top)
    return samples.select("img", "x", "y", (F.col("s") - near).bitwiseAND(F.lit(255)).alias("s"))


def unfiltered(samples: DataFrame, kind: str) -> DataFrame:
    """The inverse of filtered(): running sums modulo 256, the edge's own sum first."""
    edge, line = ("x", "y") if kind == "horizontal" else ("y", "x")
    along = Window.partitionBy("img").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    first = samples.where(F.col(edge) == 0).select("img", F.col(line).alias("k"), F.sum("s").over(along).alias("base"))
    own = Window.partitionBy("img", line).orderBy(edge).rowsBetween(Window.unboundedPreceding, 0)
    rest = samples.withColumn("run", F.sum(F.when(F.col(edge) > 0, F.col("s")).otherwise(0)).over(own))
    return rest.join(first, (rest["img"] == first["img"]) & (rest[line] == first["k"])).select(rest["img"], "x", "y", (F.col("run") + F.col("base")).bitwiseAND(F.lit(255)).alias("s"))


def palette_deltas(colours: DataFrame) -> DataFrame:
    """A palette (img, idx, argb) as differences of neighbouring colours, channel by channel."""
    w = Window.partitionBy("img").orderBy("idx")
    own = colours.select("img", "idx", *[F.expr(f.channel("argb", s)).alias(c) for c, s in zip("argb", (24, 16, 8, 0), strict=True)])
    return own.select("img", "idx", *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).bitwiseAND(F.lit(255)).alias(c) for c in "argb"])


def palette_sums(deltas: DataFrame) -> DataFrame:
    """The palette of its differences: running sums modulo 256."""
    w = Window.partitionBy("img").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sums = deltas.select("img", "idx", *[F.sum(c).over(w).bitwiseAND(F.lit(255)).alias(c) for c in "argb"])
    return sums.select("img", "idx", F.expr(f.packed()).alias("argb"))


def activity(luma: DataFrame) -> DataFrame:
    """Per 16 x 16 macroblock (img, mx, my) of luma samples (img, x, y, s): the sum of differences to the left and upper neighbour in it."""
    rows = luma.selectExpr("img", "shiftright(x, 4) as mx", "shiftright(y, 4) as my", "x", "y", "s")
    across, down = Window.partitionBy("img", "mx", "my").orderBy("y", "x"), Window.partitionBy("img", "mx", "my").orderBy("x", "y")
    left = F.when(F.col("x") % 16 > 0, F.abs(F.col("s") - F.lag("s").over(across))).otherwise(0)
    up = F.when(F.col("y") % 16 > 0, F.abs(F.col("s") - F.lag("s").over(down))).otherwise(0)
    return rows.withColumn("d", left + up).groupBy("img", "mx", "my").agg(F.sum("d").alias("activity"))


def intra_costs(samples: DataFrame, size: int = 4) -> DataFrame:
    """(img, bi, bj, mode, sad) of DC, vertical, horizontal and true-motion prediction of each block from the row above and the column to
    its left; above the image stands 127, left of it 129, and DC counts only the sides that are there, 128 without any.

    The sides are two narrow tables of a quarter of the samples each, joined by coordinates."""
    half = size.bit_length() - 1
    rows = samples.select("img", "x", "y", "s", F.shiftright("x", half).alias("bi"), F.shiftright("y", half).alias("bj"))
    above = rows.where(F.col("y") % size == size - 1).select("img", F.col("x").alias("x"), (F.col("bj") + 1).alias("bj"), F.col("s").alias("t"))
    left = rows.where(F.col("x") % size == size - 1).select("img", F.col("y").alias("y"), (F.col("bi") + 1).alias("bi"), F.col("s").alias("l"))
    corner = rows.where((F.col("x") % size == size - 1) & (F.col("y") % size == size - 1)).select("img", (F.col("bi") + 1).alias("bi"), (F.col("bj") + 1).alias("bj"), F.col("s").alias("c"))
    tops = above.groupBy("img", F.shiftright("x", half).alias("bi"), "bj").agg(F.sum("t").alias("st"))
    lefts = left.groupBy("img", "bi", F.shiftright("y", half).alias("bj")).agg(F.sum("l").alias("sl"))
    all_ = rows.join(above, ["img", "x", "bj"], "left").join(left, ["img", "y", "bi"], "left").join(corner, ["img", "bi", "bj"], "left").join(tops, ["img", "bi", "bj"], "left").join(lefts, ["img", "bi", "bj"], "left")
    dc = f"CASE WHEN st IS NOT NULL AND sl IS NOT NULL THEN (st + sl + {size}) >> {half + 1} WHEN st IS NOT NULL THEN (st + {size // 2}) >> {half} WHEN sl IS NOT NULL THEN (sl + {size // 2}) >> {half} ELSE 128 END"
    edge = "CASE WHEN c IS NOT NULL THEN c WHEN bj = 0 THEN 127 ELSE 129 END"
    guess = [dc, "coalesce(t, 127)", "coalesce(l, 129)", f.clip(f"coalesce(t, 127) + coalesce(l, 129) - {edge}")]
    sums = all_.groupBy("img", "bi", "bj").agg(*[F.expr(f"sum(abs(s - ({g})))").alias(f"m{k}") for k, g in enumerate(guess)])
    cells = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("mode"), F.col(f"m{k}").alias("sad")) for k in range(4)]))
    return sums.select("img", "bi", "bj", cells.alias("c")).select("img", "bi", "bj", "c.*")


def smoothed_edges(samples: DataFrame, limit: int, size: int = 4) -> DataFrame:
    """The simple loop filter over the inner vertical edges of a plane: the two samples at an edge move towards each other where the step
    across it is within the limit. Edges lie apart, so each is one row of four samples."""
    w = Window.partitionBy("img", "y").orderBy("x")
    rows = samples.select("img", "x", "y", "s", F.lag("s", 2).over(w).alias("b2"), F.lag("s", 1).over(w).alias("b1"), F.lead("s", 1).over(w).alias("a1"), F.lead("s", 2).over(w).alias("a2"))
    names = {"q": ("b2", "b1", "s", "a1"), "p": ("b1", "s", "a1", "a2")}
    wide = lambda v: f.clip(v, -128, 127)

    def moved(side: str) -> str:
        p1, p0, q0, q1 = names[side]
        step = wide(f"({wide(f'({p1} - {q1})')} + 3 * ({q0} - {p0}))")
        near = f"abs({p0} - {q0}) * 2 + (abs({p1} - {q1}) >> 1) <= {limit}"
        change = f"- ({wide(f'({step} + 4)')} >> 3)" if side == "q" else f"+ ({wide(f'({step} + 3)')} >> 3)"
        return f"CASE WHEN {near} THEN {f.clip(f'(s {change})')} ELSE s END"

    at = f"CASE WHEN x > 0 AND x % {size} = 0 THEN {moved('q')} WHEN x % {size} = {size - 1} AND a1 IS NOT NULL THEN {moved('p')} ELSE s END"
    return rows.select("img", "x", "y", F.expr(at).alias("s"))
