"""Toxicity: a linear classifier over the presence of character n-grams, scaled by naive Bayes log-count ratios.

N-grams of 4 to 7 characters (code points) of the text with A-Z lower-cased are hashed to 2^19 cells; a text has a cell or not, so a few
words tell in a long text as well as in a short one. From labelled documents each cell gets its smoothed log-count ratio r of the two
classes. Of the cells that MIN_DOCS sampled documents have, the model's features are the MAX_CELLS whose presence tells most, by the
G-test. A logistic regression is fitted on r-scaled presences.

The labelled sample is bounded by MAX_ROWS and the model by MAX_CELLS, at every input size, and so is what comes to the driver: a row
of as many bits as the model has features for each sampled document. Counts are summed by Spark from one row a cell and task. Scoring is one narrow pass
over all whole texts, long ones taken in slices that overlap.

Cases: null and empty texts have no cells and get the intercept's score; a very long text is gone through whole, a slice at a time; repeated
rows are scored alike, and of rows of one doc_id one is learnt from, that of the least text hash; cells of equal gain are taken in their
order; an empty table gives an empty result; with one class or none among the labels every score is the share of that class; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import labelled_sample, stored

ORDERS, BITS = (4, 5, 6, 7), 19
MAX_ROWS, MAX_CELLS, MIN_DOCS, SEED, SLICE = 16_000, 4000, 3, 13, 1 << 20
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))
_MIX = {n: np.uint64(m) for n, m in zip(ORDERS, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5), strict=True)}


#: What a hash is multiplied by before the next character is added.
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def cells(text: str | None) -> Iterator[np.ndarray]:
    """Cells of a text's n-grams, repeats included, a slice and order at a time."""
    raw = np.frombuffer(b" ".join([b"", (text or "").encode().translate(_LOWER), b""]).decode().encode("utf-32-le"), np.uint32)
    if len(raw) == 2:
        return
    for a in range(0, max(1, len(raw) - min(ORDERS) + 1), SLICE):
        b = raw[a : a + SLICE + max(ORDERS) - 1].astype(np.uint64)
        h = b
        for n in range(2, max(ORDERS) + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * _NEXT + b[n - 1 :]
            if n in ORDERS:
                yield ((h * _MIX[n]) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(parts: Iterator[np.ndarray]) -> np.ndarray:
    """The distinct numbers of all parts, held one part and as many as there are different ones at a time."""
    out = np.zeros(0, np.int64)
    for first, *rest in iter(lambda it=iter(parts): [x for _, x in zip(range(len(ORDERS)), it)], []):  # a slice's orders together
        out = np.union1d(out, np.concatenate([first, *rest]))
    return out


def present(text: str | None, chosen: np.ndarray) -> np.ndarray:
    """Distinct numbers of the chosen cells that a text has; chosen maps each cell to its number or -1."""
    return distinct(x[x >= 0] for x in (chosen[c] for c in cells(text)))


@dataclass(frozen=True)
class Model:
    chosen: np.ndarray
    weights: np.ndarray  # ratio times fitted weight of each chosen cell
    bias: float

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[present(text, self.chosen)].sum(), -30, 30))))


def packed(numbers: np.ndarray, size: int) -> bytes:
    """Which of size cells a text has, a bit each."""
    has = np.zeros(size, bool)
    has[numbers] = True
    return np.packbits(has).tobytes()


def fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, rounds: int = 200, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on presences times ratio: full-batch Nesterov steps under a bound of the curvature."""
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    scale = ratio[col]
    heaviest = np.bincount(row, weights=scale * scale, minlength=len(rows)).mean() + 1
    w, b, ow, ob, rate = np.zeros(len(ratio)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), np.zeros(len(ratio)), 0.0, 4 / heaviest
    ob = b
    for k in range(rounds):
        push = k / (k + 3)
        lw, lb = w + push * (w - ow), b + push * (b - ob)
        err = 1 / (1 + np.exp(-np.clip(lb + np.bincount(row, weights=scale * lw[col], minlength=len(rows)), -30, 30))) - y
        ow, ob = w, b
        w = lw - rate * (np.bincount(col, weights=scale * err[row], minlength=len(ratio)) / len(y) + decay * lw)
        b = lb - rate * err.mean()
    return ratio * w, float(b)


def _counts(sample: DataFrame) -> DataFrame:
    """(cell, pos, neg): sampled documents of each class that have the cell; a row a cell and task, then summed."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                n[int(y > 0)][distinct(cells(text.as_py()))] += 1
        at = np.nonzero(n.sum(axis=0))[0]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1][at]), pa.array(n[0][at])], ["cell", "pos", "neg"])

    parts = sample.select("text", "label").mapInArrow(run, "cell long, pos long, neg long")
    return parts.groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None, max_rows: int = MAX_ROWS, max_cells: int = MAX_CELLS, seed: int = SEED) -> Model:
    """The model from at most max_rows labelled documents; keep, a condition on doc_id, says which may be learnt from."""
    ids = labelled_sample(labels, label, max_rows, seed, keep)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    one = known.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    sample = stored(one.select("doc_id", "label", "x.text"), "labelled")
    total = {r.label > 0: r.n for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = total.get(True, 0), total.get(False, 0)
    blank = np.full(1 << BITS, -1, np.int32)
    if not pos or not neg:
        return Model(blank, np.zeros(0), 0.0 if not pos + neg else 30.0 if pos else -30.0)
    # smoothed log-count ratio, and twice the log-likelihood gain of telling the classes apart by the cell
    r = F.log((F.col("pos") + 1) / (pos + 2.0)) - F.log((F.col("neg") + 1) / (neg + 2.0))
    g = lambda o, s, of: F.when(o > 0, o * F.log(o * float(pos + neg) / (s * float(of)))).otherwise(0.0)
    p, n = F.col("pos"), F.col("neg")
    gain = g(p, p + n, pos) + g(n, p + n, neg) + g(F.lit(pos) - p, F.lit(pos + neg) - p - n, pos) + g(F.lit(neg) - n, F.lit(pos + neg) - p - n, neg)
    top = _counts(sample).where(F.col("pos") + F.col("neg") >= MIN_DOCS).select("cell", r.alias("r"), gain.alias("gain")).orderBy(F.desc("gain"), "cell").limit(max_cells).collect()
    for k, x in enumerate(top):
        blank[x.cell] = k
    ratio, size, sent = np.array([x.r for x in top]), len(top), docs.sparkSession.sparkContext.broadcast(blank)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packed(present(t.as_py(), sent.value), size) for t in b.column(2)], pa.binary())], ["doc_id", "label", "has"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, has binary").collect()
    rows = sorted((r.doc_id, r.label, bytes(r.has)) for r in rows)
    w, b = fit([np.flatnonzero(np.unpackbits(np.frombuffer(x[2], np.uint8))).astype(np.int32) for x in rows], np.array([float(x[1] > 0) for x in rows]), ratio)
    return Model(blank, w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sent.value.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
