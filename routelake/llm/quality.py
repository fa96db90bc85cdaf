"""Quality classifier by Bradley-Terry pairwise ranking.

Every document has a latent score w . x over features of its whole text. Preference pairs (a document labelled 1 over one labelled 0)
give w by the logistic loss on feature differences, fitted with Newton's method. The score at the quantile that leaves the
labelled share of 0 below it is the threshold: it maps to 0.5.

All labelled documents are learned from. They are dealt into blocks, within which every document meets ``OPPONENTS`` of the other label;
each step of Newton's method is a Spark job that sums the loss, its gradient and its curvature over the blocks' pairs, and the threshold
is found among all scores by counting. The driver holds sums, and scores of a narrow range at most.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from routelake.llm.common import group_bounds, whole_groups
from routelake.session import cut_lineage

BLOCK_ROWS = 6000   # labelled documents in a block, about
RANGE_ROWS = 20_000 # scores that the driver looks at one by one
BINS = 512          # parts that a range of scores is cut into for counting
OPPONENTS = 12      # documents of the other label that each of them is compared with, at least
RIDGE = 1e-3        # weight of the squared norm in the loss
ROUNDS = 25         # Newton steps at most
CLIP = 6.0          # standardised features lie within this

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
NAMES = ["log_words", "word_length", "distinct_words", "commonest_word", "distinct_triples", "log_lines", "distinct_lines", "words_per_line",
         "closed_lines", "short_words", "odd_ends", "letters", "capitals", "digits", "spaces", "newlines", "controls", "beyond_ascii",
         *(f"share_{chr(b)}" for b in _PUNCTUATION)]
_PLAIN_ENDS = frozenset(".,;:?")


def features(text: str | None) -> np.ndarray:
    """Feature vector of a whole text (zeros for a null or wordless one): shares of kinds of bytes, repetition of words, word triples and
    lines, and shapes of words and lines."""
    out = np.zeros(len(NAMES))
    words = text.split() if text else []
    if not words:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    n = len(words)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    triples = max(1, n - 2)
    ends = Counter(w[-1] for w in words)
    odd = sum(k for c, k in ends.items() if not c.isalnum() and c not in _PLAIN_ENDS)
    out[:11] = (np.log1p(n), len(text) / n, len(seen) / n, max(seen.values()) / n, len(set(zip(words, words[1:], words[2:]))) / triples if n > 2 else 1.0,
                np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
                sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)), sum(k for w, k in seen.items() if len(w) < 4) / n, odd / n)
    capitals, digits = share[65:91].sum(), share[48:58].sum()
    beyond = share[128:].sum()
    out[11:18] = (share[97:123].sum() + capitals + beyond, capitals, digits, share[32], share[10], share[:32].sum() - share[10], beyond)
    out[18:] = share[_PUNCTUATION]
    return out


def _difference_pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row indexes of preference pairs: every document meets at least ``OPPONENTS`` of the other label (all, if fewer)."""
    n = max(len(high), len(low))
    rounds = min(OPPONENTS, n)
    i = np.arange(n)
    steps = np.linspace(0, n, rounds, endpoint=False).astype(np.int64)
    pairs = np.unique(np.concatenate([(i % len(high)) * len(low) + (i + s) % len(low) for s in steps]))
    return pairs // len(low), pairs % len(low)


def _sums(high: np.ndarray, low: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs, loss, gradient and curvature at w, summed over a block's pairs, in one row."""
    k = len(w)
    if not len(high) or not len(low):
        return np.zeros(2 + k + k * k)
    a, b = _difference_pairs(high, low)
    d = high[a] - low[b]
    margin = d @ w
    p = 1.0 / (1.0 + np.exp(np.clip(margin, -500, 500)))  # chance that the pair is taken the wrong way round
    curve = (d * (p * (1 - p))[:, None]).T @ d
    return np.concatenate([[len(d), np.logaddexp(0.0, -margin).sum()], -(d * p[:, None]).sum(axis=0), curve.ravel()])


def newton(sums, k: int) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w . (x_i - x_j))) + RIDGE |w|^2 over all pairs, of which ``sums(w)`` gives ``_sums``."""
    def at(w):
        s = sums(w)
        n = s[0]
        return (n, s[1] / n + RIDGE * (w @ w), s[2:2 + k] / n + 2 * RIDGE * w, s[2 + k:].reshape(k, k) / n + 2 * RIDGE * np.eye(k)) if n else (0, 0, 0, 0)

    w = np.zeros(k)
    n, now, gradient, curve = at(w)
    for _ in range(ROUNDS if n else 0):
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-4 and (after := at(w - size * step))[1] > now:
            size /= 2
        if size <= 1e-4:
            break
        done = now - after[1] < 1e-10
        w, (_, now, gradient, curve) = w - size * step, after
        if done:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``newton`` over the pairs of one block: features x, labels y (0 or 1)."""
    high, low = x[y == 1], x[y == 0]
    return newton(lambda w: _sums(high, low, w), x.shape[1])


def quantile_threshold(scores: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The middle between the neighbouring scores where the weight below reaches ``share`` of all."""
    order = np.argsort(scores, kind="stable")
    s, below = scores[order], np.cumsum(weights[order]) / weights.sum()
    k = min(int(np.searchsorted(below, share - 1e-12, side="left")), len(s) - 1)
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


class Model:
    """Standardisation, weights and threshold; small (a few numbers per feature)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        self.weights, self.threshold = np.zeros(len(mean)), 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(np.clip(self.threshold - self.raw(x), -700, 700)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array([features(t.as_py()).tobytes() for t in b.column("text")], pa.binary())], names=["doc_id", "h", "x"])


def _rows(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist())).reshape(-1, len(NAMES))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the features ``x`` of all rows: each task's, merged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _rows(b.column("x"))
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.mean(axis=0).tobytes()], pa.binary()), pa.array([x.var(axis=0).tobytes()], pa.binary())], names=["n", "mean", "var"])

    parts = [(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["var"])) for r in rows.select("x").mapInArrow(run, "n long, mean binary, var binary").collect()]
    if not parts:
        return np.zeros(len(NAMES)), np.ones(len(NAMES))
    n = sum(p[0] for p in parts)
    mean = sum(p[1] * (p[0] / n) for p in parts)
    var = sum((p[2] + (p[1] - mean) ** 2) * (p[0] / n) for p in parts)
    return mean, np.maximum(np.sqrt(var), 1e-6)


def _blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rows(doc_id, quality, x)`` dealt into blocks of about ``BLOCK_ROWS`` by a hash of doc_id, sorted within partitions. A label with fewer than
    a few times ``OPPONENTS`` rows a block has its rows in as many blocks as it takes."""
    n = max(1, math.ceil(sum(counts.values()) / BLOCK_ROWS))
    copies = F.lit(1)
    for label, k in counts.items():
        copies = F.when(F.col("quality") == label, F.lit(min(n, max(1, math.ceil(4 * OPPONENTS * n / k))))).otherwise(copies)
    dealt = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    dealt = dealt.select(F.pmod(F.xxhash64("doc_id") + F.col("copy"), F.lit(n)).cast("int").alias("block"), "quality", "doc_id", "x")
    return dealt.repartition(n, "block").sortWithinPartitions("block", "quality", "doc_id")


def _fitted(blocks: DataFrame, model: Model) -> np.ndarray:
    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for t in whole_groups(batches, ["block"]):
                bounds = group_bounds(t, ["block"])
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    x, y = model.standard(_rows(t.column("x").slice(s, e - s))), t.column("quality").slice(s, e - s).to_numpy()
                    mine = _sums(x[y == 1], x[y == 0], w)
                    total = mine if total is None else total + mine
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        k = len(w)
        return sum((np.frombuffer(r["sums"]) for r in blocks.mapInArrow(run, "sums binary").collect()), np.zeros(2 + k + k * k))

    return newton(sums, len(model.mean))


def scores_threshold(scores: DataFrame, weights: tuple[float, float], share: float) -> float:
    """``quantile_threshold`` of all ``scores(quality, raw)``, a row weighing ``weights[quality]``: the range that holds the quantile is cut into
    bins and counted, until it holds few enough scores to look at."""
    n0, n1, lo, hi = scores.agg(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1), F.min("raw"), F.max("raw")).first()
    w0, w1 = weights
    target = (share - 1e-12) * (n0 * w0 + n1 * w1)
    before, after = 0.0, None
    while n0 + n1 > RANGE_ROWS and lo < hi:
        part = F.least(F.floor((F.col("raw") - lo) / F.lit((hi - lo) / BINS)), F.lit(BINS - 1)).cast("int")
        bins = (scores.where(F.col("raw").between(lo, hi)).groupBy(part.alias("bin"))
                .agg(F.count_if(F.col("quality") == 0).alias("n0"), F.count_if(F.col("quality") == 1).alias("n1"), F.min("raw").alias("lo"), F.max("raw").alias("hi"))
                .orderBy("bin").collect())
        at = 0
        while at < len(bins) - 1 and before + bins[at]["n0"] * w0 + bins[at]["n1"] * w1 < target:
            before += bins[at]["n0"] * w0 + bins[at]["n1"] * w1
            at += 1
        if at + 1 < len(bins):
            after = bins[at + 1]["lo"]
        if (bins[at]["lo"], bins[at]["hi"]) == (lo, hi):  # a range of neighbouring doubles
            break
        n0, n1, lo, hi = bins[at]["n0"], bins[at]["n1"], bins[at]["lo"], bins[at]["hi"]
    kept = (scores.where(F.col("raw").between(lo, hi)).groupBy("raw").agg(F.count_if(F.col("quality") == 0).alias("n0"), F.count_if(F.col("quality") == 1).alias("n1"))
            .orderBy("raw").collect())
    values = [r["raw"] for r in kept] + ([] if after is None else [after])
    for i, r in enumerate(kept):
        size = r["n0"] * w0 + r["n1"] * w1
        if before + size >= target or i == len(kept) - 1:
            last = before + size - (w1 if r["n1"] else w0) < target  # the last of the equal scores: the next one is larger
            return float((values[i] + values[min(i + last, len(values) - 1)]) / 2)
        before += size


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits a model on the texts of ``docs(doc_id, text)`` that ``labels(doc_id, quality)`` marks 0 or 1: all of them.

    Features are computed where the texts lie; only these (not texts) are shuffled to their labels. Label shares count all labels. Labels that
    are null, no 0 or 1, without doc_id or that contradict one another for a document don't count; of rows that repeat a doc_id the
    text with the least hash is learned."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
             .where("quality = high").select("doc_id", "quality"))
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").withColumn("h", F.xxhash64("text"))
    seen = text.mapInArrow(_featured, "doc_id long, h long, x binary").join(known, "doc_id")
    rows = cut_lineage(seen.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "x")).alias("t")).select("doc_id", "quality", "t.x"))
    model = Model(*_moments(rows))
    counts = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) == 2:
        model.weights = _fitted(cut_lineage(_blocks(rows, counts)), model)
    if not model.weights.any():  # one label only, or none: the labelled share of 1
        model.threshold = float(np.log((n0 + 1) / (n1 + 1)))
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(model.raw(_rows(b.column("x"))))], names=["quality", "raw"])

    scores = cut_lineage(rows.select("quality", "x").mapInArrow(run, "quality int, raw double"))
    model.threshold = scores_threshold(scores, (n0 / counts[0], n1 / counts[1]), n0 / (n0 + n1))
    return model


def classify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on) to the columns ``keep`` (all, if None) of
    ``docs(text, ...)``; a scan without shuffle.

    Defined cases: a text that is null or has no word has zero features and the score these get; any length is read whole; rows are
    judged one by one, so repeated rows agree; without labels of both kinds every score is the labelled share of 1 ((n1 + 1) /
    (n + 2)); an empty table gives an empty result. Columns named score or predicted are replaced; no other name clashes."""
    cols = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                score = shared.value.score(np.array([features(t.as_py()) for t in b.column(len(cols))]))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(cols))), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                                 names=[*cols, "score", "predicted"])

    free = next(n for n in (f"_text{i}" for i in range(len(cols) + 1)) if n not in cols)
    src = docs.select(*[F.col(f"`{c}`") for c in cols], F.col("text").cast("string").alias(free))
    schema = StructType([*src.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return src.mapInArrow(run, schema)
