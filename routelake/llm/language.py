"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum over
*all* its segmentations into pieces, by the forward algorithm; a text's score adds its words' log likelihoods and
the language's prior. The piece probabilities are fitted with EM (forward-backward expected counts) on a bounded, documented
sample of labelled documents; every text is scored whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from routelake.llm.common import CACHE_BYTES, worker_state

TRAIN_DOCS = 400        # labelled documents per language (expected number) that the model is fitted on
EM_ROUNDS = 3
SCALED_CHARS = 40       # words up to this length are summed in scaled numbers, many at a time; longer ones in logarithms
UNKNOWN = 1e-7          # probability of a character that is no piece, or of an unseen piece's mass
WORD_CACHE = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"       # the vocabulary's mark of a word start
_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters (Unicode categories L*), of any length."""
    out = _LETTERS.findall(text.lower()) if text else []
    if not all(map(str.isalpha, out)):  # the pattern also takes numeric characters that are no digits
        out = [x for w in out for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    return out


def vocabulary(path: str) -> list[str]:
    """Letter pieces of a sentencepiece model (with or without the word-start mark), lower-cased, distinct, sorted."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p and (p.removeprefix(_START) or "a").isalpha())


def _piece_hash(p: str) -> int:
    h = 0
    for c in p:
        h = (h * int(_B) + ord(c) + 1) % 2**64
    return h


class PieceTable:
    """Looks up every substring of a batch of words among the pieces, vectorised over the words."""

    def __init__(self, pieces: list[str]):
        hashes = np.array([_piece_hash(p) for p in pieces], dtype=_U)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.n = hashes[order], order, len(pieces)
        self.longest = max(map(len, pieces), default=1)

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, positions, lengths) piece index of each substring that ends at a position (n: no piece; n + 1: an
        unknown single character), and the words' lengths with the start mark."""
        size = np.array([len(w) + 1 for w in words])
        width = int(size.max())
        chars = np.zeros((len(words), width), dtype=_U)
        for i, w in enumerate(words):
            chars[i, :len(w) + 1] = np.frombuffer((_START + w).encode("utf-32-le", "surrogatepass"), "<u4")
        chars += _U(1)
        out = np.full((len(words), width, self.longest), self.n, dtype=np.int32)
        h = np.zeros((len(words), width), dtype=_U)
        for k in range(self.longest):  # h[:, t]: hash of the k + 1 characters from t on
            if k >= width:
                break
            h = h[:, :width - k] * _B + chars[:, k:]
            at = np.minimum(np.searchsorted(self.hashes, h.ravel()), max(0, len(self.hashes) - 1)).reshape(h.shape)
            found = self.hashes[at] == h if self.n else np.zeros(h.shape, bool)
            out[:, k:, k] = np.where(found, self.ids[at] if self.n else 0, self.n + 1 if k == 0 else self.n)
        return out, size


    def endings(self, chars: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """(positions lo..hi-1, lengths) piece index of each substring of one word's character codes that ends there, as in ``lattice``."""
        first = max(0, lo - self.longest + 1)
        part = chars[first:hi]
        out = np.full((hi - lo, self.longest), self.n, dtype=np.int32)
        h = np.zeros(len(part), dtype=_U)
        for k in range(min(self.longest, len(part))):
            h = h[:len(part) - k] * _B + part[k:]
            if self.n:
                at = np.minimum(np.searchsorted(self.hashes, h), self.n - 1)
                ids = np.where(self.hashes[at] == h, self.ids[at], self.n + 1 if k == 0 else self.n)
            else:
                ids = np.full(len(h), 1 if k == 0 else 0)
            ends = first + k + np.arange(len(h))  # where they end
            out[ends[ends >= lo] - lo, k] = ids[ends >= lo]
        return out


def _probabilities(counts: np.ndarray, smooth: float = 0.01) -> np.ndarray:
    """(languages, n + 2): smoothed piece probabilities, then 0 for no piece, then the unknown character's."""
    p = counts + smooth
    p = p / p.sum(axis=1, keepdims=True) * (1 - UNKNOWN)
    k = np.zeros((len(p), 2))
    k[:, 1] = UNKNOWN
    return np.hstack([p, k])


def forward(lattice: np.ndarray, size: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha (languages, words, positions + 1), each position scaled by 16 to stay in range, and the words' log likelihoods."""
    n, width, longest = lattice.shape
    alpha = np.zeros((len(probs), n, width + 1))
    alpha[:, :, 0] = 1.0
    for t in range(width):
        for k in range(min(longest, t + 1)):
            alpha[:, :, t + 1] += alpha[:, :, t - k] * probs[:, lattice[:, t, k]] * 16.0 ** (k + 1)
    end = alpha[:, np.arange(n), size]
    return alpha, np.log(np.maximum(end, 1e-300)) - size * np.log(16.0)


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp over the last axis."""
    top = x.max(axis=-1, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=-1)) + top[..., 0]


def long_forward(table: PieceTable, word: str, probs: np.ndarray) -> np.ndarray:
    """Log likelihoods (languages) of one word of any length, over all its segmentations, position by position in logarithms. Piece
    look-ups go in windows, so memory doesn't grow with the word beyond its characters."""
    logs = np.log(np.maximum(probs, 1e-300))
    logs[:, table.n] = -np.inf
    chars = np.frombuffer((_START + word).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U) + _U(1)
    recent = np.full((len(probs), table.longest), -np.inf)  # log alpha of the last positions, the latest first
    recent[:, 0] = 0.0
    for lo in range(0, len(chars), 4096):
        for ids in table.endings(chars, lo, min(lo + 4096, len(chars))):
            now = _log_sum(recent + logs[:, ids])
            recent[:, 1:] = recent[:, :-1]
            recent[:, 0] = now
    return recent[:, 0]


def _long_soft(table: PieceTable, word: str, probs: np.ndarray, weight: float, soft: np.ndarray) -> None:
    """Adds the expected piece counts of one long word to ``soft``."""
    logs = np.log(np.maximum(probs[0], 1e-300))
    logs[table.n] = -np.inf
    chars = np.frombuffer((_START + word).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U) + _U(1)
    ids, m, longest = table.endings(chars, 0, len(chars)), len(chars), table.longest
    alpha = np.full(m + longest, -np.inf)  # alpha[t + longest - 1]: after t characters
    alpha[longest - 1] = 0.0
    for t in range(m):
        alpha[t + longest] = _log_sum(alpha[t:t + longest][::-1] + logs[ids[t]])
    beta = np.full(m + longest, -np.inf)
    beta[m] = 0.0
    for t in range(m - 1, -1, -1):  # pieces of k + 1 characters that begin at t end at t + k
        k = np.arange(min(longest, m - t))
        beta[t] = _log_sum(beta[t + 1 + k] + logs[ids[t + k, k]])
    for t in range(m):
        k = np.flatnonzero(ids[t] < table.n)
        k = k[k <= t]
        share = alpha[t - k + longest - 1] + logs[ids[t, k]] + beta[t + 1] - beta[0]
        np.add.at(soft, ids[t, k], np.exp(share) * weight)


def fit(table: PieceTable, words: list[str], counts: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Expected piece counts of one language after ``rounds`` of EM from a uniform start."""
    soft = np.full((1, table.n), 1.0)
    is_short = np.array([len(w) <= SCALED_CHARS for w in words], bool)
    short, times = [w for w, s in zip(words, is_short) if s], counts[is_short]
    for _ in range(rounds):
        probs = _probabilities(soft)
        soft = np.zeros((1, table.n))
        for w, c in zip(words, counts):
            if len(w) > SCALED_CHARS:
                _long_soft(table, w, probs, c, soft[0])
        for lo in range(0, len(short), 4000):
            lattice, size = table.lattice(short[lo:lo + 4000])
            alpha, _ = forward(lattice, size, probs)
            a, n, width = alpha[0], len(size), lattice.shape[1]
            beta = np.zeros((n, width + 1))
            rows = np.arange(n)
            beta[rows, size] = 1.0
            end = np.maximum(a[rows, size], 1e-300)
            weight = times[lo:lo + 4000] / end
            for t in range(width - 1, -1, -1):  # the last character of a piece
                for k in range(min(table.longest, t + 1)):
                    ids = lattice[:, t, k]
                    step = probs[0, ids] * 16.0 ** (k + 1) * beta[:, t + 1]
                    beta[:, t - k] += np.where(beta[:, t + 1] > 0, step, 0.0)
                    inside = ids < table.n
                    np.add.at(soft[0], ids[inside], (a[:, t - k] * step * weight)[inside])
    return soft


class Model:
    """Scores texts; a worker remembers the likelihoods of the words it has seen."""

    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray, prior: np.ndarray):
        self.langs, self.probs, self.prior = langs, probs, prior
        self.table = PieceTable(pieces)
        self.known: dict[str, int] = {}
        self.chars = 0
        self.rows = np.zeros((1024, len(langs)))

    def _learn(self, words: list[str]) -> None:
        for w in words:
            if len(w) > SCALED_CHARS:
                self._add([w], long_forward(self.table, w, self.probs)[:, None])
        words = [w for w in words if len(w) <= SCALED_CHARS]
        for lo in range(0, len(words), 4000):
            part = sorted(words[lo:lo + 4000], key=len)
            for s in range(0, len(part), 500):
                some = part[s:s + 500]
                self._add(some, forward(*self.table.lattice(some), self.probs)[1])

    def _add(self, words: list[str], logs: np.ndarray) -> None:
        base = len(self.known)
        while base + len(words) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[base:base + len(words)] = logs.T
        self.chars += sum(map(len, words))
        self.known.update(zip(words, range(base, base + len(words))))

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lists = [words_of(t) for t in texts]
        if len(self.known) > WORD_CACHE or self.chars > CACHE_BYTES // 16:
            self.known, self.chars = {}, 0
        if self.langs:
            self._learn(list({w for ws in lists for w in ws if w not in self.known}))
        lang, score = [], []
        for ws in lists:
            if not ws or not self.langs:
                lang.append("und")
                score.append(0.0)
                continue
            total = self.prior + self.rows[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            best = int(np.argmax(total))
            lang.append(self.langs[best])
            score.append(float(1.0 / np.exp(total - total[best]).sum()))
        return lang, score


def train(labelled: DataFrame, path: str, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit a model on ``labelled(doc_id, text, lang)``.

    Of each language about ``train_docs`` documents are used (all, if it has fewer), chosen by a hash of
    doc_id and text; this bounds the fitting and is the operator's documented sample. Priors use all labelled rows. Expected
    piece counts come from one bounded group per language; the model is bounded by vocabulary times languages."""
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(totals)
    pieces = vocabulary(path)
    if not langs:
        return Model([], pieces, _probabilities(np.zeros((0, len(pieces)))), np.zeros(0))
    share = F.lit(0.0)
    for name, n in totals.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, train_docs / n))).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict = {}
            for name, t in zip(b.column("lang").to_pylist(), b.column("text")):
                for w in words_of(t.as_py()):
                    rows[name, w] = rows.get((name, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()),
                                              pa.array(list(rows.values()), pa.int64())], names=["lang", "word", "n"])

    def em(group: pa.Table) -> pa.Table:
        table = PieceTable(pieces)
        words, n = group.column("word").to_pylist(), group.column("n").to_numpy().astype(float)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        soft = fit(table, [words[i] for i in order], n[order])[0]
        return pa.table({"lang": pa.array([group.column("lang")[0].as_py()]), "counts": pa.array([soft.astype("<f4").tobytes()], pa.binary())})

    words = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = {r["lang"]: np.frombuffer(r["counts"], "<f4").astype(float)
              for r in words.groupBy("lang").applyInArrow(em, "lang string, counts binary").collect()}
    counts = np.array([fitted.get(k, np.zeros(len(pieces))) for k in langs])
    n = np.array([totals[k] for k in langs], float)
    return Model(langs, pieces, _probabilities(counts), np.log(n / n.sum()))


def classify(docs: DataFrame, model: Model, keep: list[str] | None = None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language (column ``pred``) and its score to the columns ``keep`` (all, if None) of ``docs(text, ...)``; a scan
    without shuffle.

    Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was
    labelled; any length is scored whole; ties go to the alphabetically first language. ``score`` is the posterior
    of the predicted language. Columns with the names of ``pred`` and ``score`` are replaced; no other name clashes. An empty table
    gives an empty result; repeated rows agree."""
    cols = [c for c in (keep if keep is not None else docs.columns) if c not in (pred, score)]
    broadcast = docs.sparkSession.sparkContext.broadcast((model.langs, model.probs, model.prior, model.table))
    name = uuid.uuid4().hex

    def make() -> Model:
        names, p, pri, table = broadcast.value
        scorer = Model(names, [], p, pri)
        scorer.table = table
        return scorer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(("language", name), make)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                lang, share = scorer.classify(b.column(len(cols)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(cols))), pa.array(lang, pa.string()), pa.array(share, pa.float64())],
                                                 names=[*cols, pred, score])

    free = next(n for n in (f"_text{i}" for i in range(len(cols) + 1)) if n not in cols)
    src = docs.select(*[F.col(f"`{c}`") for c in cols], F.col("text").cast("string").alias(free))
    schema = StructType([*src.schema.fields[:-1], StructField(pred, StringType()), StructField(score, DoubleType())])
    return src.mapInArrow(run, schema)
