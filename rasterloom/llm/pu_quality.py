"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk with an estimated class prior.

Only trusted positives and unlabelled documents are learnt from; negative labels are never read. A first classifier of
positives against unlabelled text ranks held-back rows of both; the prior is the least ratio of the two samples' upper
tails, with a margin for chance (best-bin estimation). The scorer is then an additive model over quantile bins of text
statistics, fitted by mini-batch Adam to prior * R_p+ + max(0, R_u- - prior * R_p-) under logistic loss; where the second
part turns negative its gradient is taken back, as in the non-negative estimator.

Both samples are bounded by parameters (MAX_POSITIVE, MAX_UNLABELLED) at every input size, so what is broadcast (ids, weights)
and collected (a few thousand rows of statistics) is bounded; scoring is one narrow pass over all whole texts.

Cases: null and empty texts have all statistics 0 and a score like any other; a very long text is measured whole, in memory of a few
times its size; repeated rows are scored alike, and of rows of one doc_id one is learnt from, that of the least statistics; ids of
equal hash are taken in order of the id; an empty table gives an empty result; without positives or unlabelled rows every score is 0.5;
further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import labelled_sample, least_hashed

MAX_POSITIVE, MAX_UNLABELLED, SEED = 6000, 16000, 11
BINS = 16
#: Unlabelled rows of a step; of the epochs' weights those of the second half are averaged.
BATCH = 512
NAMES = (
    "log_chars", "log_words", "upper", "lower", "digit", "blank", "newline", "bang", "symbol", "stop", "other_punctuation", "beyond_ascii",
    "word_length", "distinct", "top_word", "shouted", "short_words", "distinct_triples", "dup_lines", "line_words", "entropy", "long_words",
)


def _classes() -> np.ndarray:
    """The class of each byte, by the names' order from "upper" to "beyond_ascii"."""
    out = np.full(256, 8, np.int64)
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", "\n", "!?", "#*$%&|<>", ".,;:")):
        out[[ord(c) for c in chars]] = k
    out[128:] = 9
    return out


_CLASS = _classes()


def statistics(text: str | None) -> list[float]:
    """NAMES of one whole text."""
    from collections import Counter

    raw = (text or "").encode()
    w = raw.split()
    if not w:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(NAMES) - 1)
    n, size = len(w), len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / size
    often = Counter(w)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, w), np.int64, n)
    return [
        float(np.log1p(size)), float(np.log1p(n)), *(np.bincount(_CLASS, weights=counts, minlength=10) / size).tolist(),
        float(lengths.mean()), len(often) / n, max(often.values()) / n, sum(c for x, c in often.items() if x.isupper()) / n, float((lengths <= 3).mean()),
        len(set(zip(w, w[1:], w[2:], strict=False))) / (n - 2) if n > 2 else 1.0,
        1 - len(set(lines)) / len(lines), n / len(lines), float(-(share * np.log2(share)).sum()), float((lengths > 20).mean()),
    ]


@dataclass(frozen=True)
class Model:
    cuts: np.ndarray  # a row of ascending bin edges for each statistic
    weights: np.ndarray  # statistic x bin
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f in range(x.shape[1]):
            z += self.weights[f][np.searchsorted(self.cuts[f], x[:, f], "left")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _onehot(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Column numbers of the bins of each row's statistics."""
    return np.stack([f * BINS + np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)


def _adam(columns: int):
    m, v, t = np.zeros(columns + 1), np.zeros(columns + 1), [0]

    def step(w: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        t[0] += 1
        m[:] = 0.9 * m + 0.1 * g
        v[:] = 0.999 * v + 0.001 * g * g
        return w - rate * (m / (1 - 0.9 ** t[0])) / (np.sqrt(v / (1 - 0.999 ** t[0])) + 1e-8)

    return step


def _pull(cells: np.ndarray, err: np.ndarray, columns: int) -> np.ndarray:
    """Gradient of a mean loss, err being its derivative by each row's margin."""
    g = np.bincount(cells.ravel(), weights=np.repeat(err, cells.shape[1]), minlength=columns)
    return np.append(g, err.sum()) / max(1, len(err))


def _margin(w: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return w[cells].sum(axis=1) + w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(p: np.ndarray, u: np.ndarray, epochs: int = 120, rate: float = 0.1, decay: float = 1e-5, seed: int = SEED) -> Model:
    """The model from the statistics of positives and of unlabelled rows."""
    if not len(p) or not len(u):
        return Model(np.zeros((len(NAMES), BINS - 1)), np.zeros((len(NAMES), BINS)), 0.0, 0.5)
    both = np.concatenate([p, u])
    cuts = np.quantile(both, np.arange(1, BINS) / BINS, axis=0).T
    columns = len(NAMES) * BINS
    cp, cu, order = _onehot(p, cuts), _onehot(u, cuts), np.random.default_rng(seed)

    def run(cp: np.ndarray, cu: np.ndarray, prior: float | None) -> np.ndarray:
        """prior None: plain classification of p against u."""
        w, step, mean = np.zeros(columns + 1), _adam(columns), np.zeros(columns + 1)
        parts = max(1, len(cu) // BATCH)
        for epoch in range(epochs):
            slower = rate * min(1.0, 2 * (1 - epoch / epochs))  # the second half slows down to a stop
            for a, b in zip(np.array_split(order.permutation(len(cp)), parts), np.array_split(order.permutation(len(cu)), parts), strict=True):
                if not len(a) or not len(b):
                    continue
                zp, zu = _margin(w, cp[a]), _margin(w, cu[b])
                up, un = _pull(cp[a], -_sigmoid(-zp), columns), _pull(cu[b], _sigmoid(zu), columns)
                if prior is None:
                    g = up + un
                else:
                    pn = _pull(cp[a], _sigmoid(zp), columns)
                    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                    g = prior * up + un - prior * pn if negative >= 0 else -(un - prior * pn)
                g[:-1] += decay * w[:-1]
                w = step(w, g, slower)
            if 2 * epoch >= epochs:
                mean += w / (epochs - (epochs + 1) // 2)
        return mean

    half_p, half_u = order.permutation(len(cp)), order.permutation(len(cu))
    fit_p, see_p = half_p[: max(1, len(cp) // 2)], half_p[len(cp) // 2 :]
    fit_u, see_u = half_u[: max(1, len(cu) // 2)], half_u[len(cu) // 2 :]
    first = run(cp[fit_p], cu[fit_u], None)
    prior = class_prior(_margin(first, cp[see_p]), _margin(first, cu[see_u]))
    w = run(cp, cu, prior)
    return Model(cuts, w[:-1].reshape(len(NAMES), BINS), float(w[-1]), prior)


def class_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """The least ratio of upper tails, unlabelled to positive, at the threshold where the ratio's upper bound is least."""
    at = np.unique(p)
    qp = 1 - np.searchsorted(np.sort(p), at, "left") / len(p)
    qu = 1 - np.searchsorted(np.sort(u), at, "left") / len(u)
    slack = np.sqrt(np.log(4 / delta) / (2 * len(p))) + np.sqrt(np.log(4 / delta) / (2 * len(u)))
    best = int(np.argmin((qu + slack) / qp))
    return float(np.clip(qu[best] / qp[best], 0.05, 0.95))


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id and statistics x of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, seed: int = SEED) -> Model:
    """The model from at most max_positive documents of label 1 and max_unlabelled documents whatever their label; keep, a
    condition on doc_id, says which rows may be learnt from."""
    trusted = labels.where(F.col(label) == 1)
    positive = labelled_sample(trusted, label, max_positive, seed, keep).select("doc_id", F.lit(1).alias("p"))
    pool = docs.select("doc_id").where("doc_id is not null")
    pool = least_hashed(pool.where(keep) if keep is not None else pool, max_unlabelled, seed + 1)
    ids = positive.unionByName(pool.select("doc_id", F.lit(0).alias("p"))).groupBy("doc_id").agg(F.max("p").alias("p"), (F.min("p") == 0).alias("u"))
    found = _measured(docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi"))
    # of rows with one id the least statistics count, so that no more than the sample's ids come to the driver
    rows = found.groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(ids), "doc_id").collect()
    rows = sorted((r.doc_id, r.p, r.u, tuple(r.x)) for r in rows)
    x = lambda test: np.array([r[3] for r in rows if test(r)], float).reshape(-1, len(NAMES))
    return fit(x(lambda r: r[1] == 1), x(lambda r: r[2]), seed=seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(x), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
