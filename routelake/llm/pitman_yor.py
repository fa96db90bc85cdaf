"""Hierarchical Pitman-Yor language model over words.

A token is drawn from the restaurant of its context: the previous word or the text start. Every context seen in training
has a restaurant of its own. All of them share one parent, the unigram restaurant, whose base is uniform over the vocabulary and
one unknown word. Every training token is a customer. Seatings are sampled by blocked Gibbs sweeps: all customers of a
(word, context) are seated anew, one by one, given everyone else's tables; tables are the customers of the parent, which is seated
next. Sweeps run on all pairs at once, given the last sweep's totals per restaurant.

Words are numbered over the whole corpus by their training counts, summed over all blocks of documents. The corpus's pairs (word, context) are kept sparse in a
grid of cells, dealt by word and by context, so that neither a frequent word nor a frequent context lies in one cell. Cells
send the tables of their words and contexts to groups of words, which sum them, seat the parent and answer with the totals.
Predictive probabilities are averaged over the samples after burn-in.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import discard, written

UNKNOWN, START = 0, 1   # numbers of a word not seen in training, and of the text start as a context
FIRST = 2               # of the numbered words
SWEEPS, BURN_IN = 3, 1
DISCOUNT, STRENGTH = 0.75, 1.0          # of context restaurants
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
BLOCK_CHARS = 14_000_000  # text of one block of documents with a vocabulary of its own
END = b""               # the end token as a word: no word is empty
BUCKET_TOKENS = 16_000_000  # tokens of the corpus for each bucket of the vocabulary
CELL_TOKENS = 4_000_000     # tokens of the corpus for each cell of the grid
SINGLE_STEPS = 48       # customers of a word seated one by one; later ones in runs of a sixteenth of those seated

_BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("size", pa.list_(pa.int32())),
                    ("vocab", pa.binary()), ("tokens", pa.int64()), ("ids", pa.binary()), ("train", pa.binary())])
_BLOCK_SQL = "block long, doc_id array<bigint>, held array<boolean>, size array<int>, vocab binary, tokens long, ids binary, train binary"


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.astype("<u4").tobytes())


def _expand(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "<u4")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in blocks: token ids into the block's own vocabulary (0 is the end token), and training counts."""
    at, seq = TaskContext.get().partitionId(), 0
    counter, docs, held, parts, chars = count(1), [], [], [], 0
    vocab: dict = defaultdict(counter.__next__)

    def block() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        size = [len(p) for p in parts]
        train = np.bincount(ids[np.repeat(~np.array(held), size)], minlength=len(vocab) + 1)
        row = {"block": (at << 32) + seq, "doc_id": docs, "held": held, "size": size, "vocab": zstandard.ZstdCompressor(level=1).compress(b"\n".join(vocab)), "tokens": len(ids),
               "ids": _squeeze(ids), "train": _squeeze(train)}
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    for b in batches:
        for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("held").to_pylist(), b.column("text")):
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
            ids = np.zeros(len(words) + 1, np.uint32)
            ids[:-1] = np.fromiter(map(vocab.__getitem__, words), np.uint32, len(words))
            docs.append(i)
            held.append(h)
            parts.append(ids)
            chars += len(t.as_py() or "") + 1
            if chars >= BLOCK_CHARS:
                yield block()
                seq, counter, docs, held, parts, chars = seq + 1, count(1), [], [], [], 0
                vocab = defaultdict(counter.__next__)
    if parts:
        yield block()


def _vocab(row: dict) -> list[bytes]:
    words = zstandard.ZstdDecompressor().decompress(row["vocab"])
    return [END, *(words.split(b"\n") if words else [])]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _packed(*values) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(values, protocol=5))


def _unpacked(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16) if x.max(initial=0) < 1 << 16 else x.astype(np.uint32) if x.max() < 1 << 32 else x.astype(np.int64)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers: they compress better."""
    return _small(np.diff(x, prepend=x.dtype.type(0)))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int64)


def _word_counts(buckets: int):
    """What a block sends to each bucket of the vocabulary: its words there and their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            train, words = _expand(row["train"]), _vocab(row)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                lids = order[cuts[k]:cuts[k + 1]]
                blob = _packed(_steps(lids), b"\n".join([words[i] for i in lids]), _small(train[lids]))
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([row["block"]]), pa.array([blob], pa.binary())], names=["bucket", "block", "data"])

    return run


def _numbers(buckets: int):
    """Rows sorted by bucket: the counts of a bucket's words over all blocks, and from them the words' numbers (frequent words first), which
    go back to each block."""
    def done(at: int, index: dict[bytes, int], asked: list) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(index), np.int64)
        for _, _, where, counts in asked:
            n[where] += counts
        number, words = np.full(len(index), UNKNOWN, np.int64), list(index)
        known = sorted(np.flatnonzero(n).tolist(), key=lambda i: (-n[i], words[i]))
        number[known] = FIRST + at + buckets * np.arange(len(known))
        for block, lids, where, _ in asked:
            data = _packed(lids, number[where].astype(np.uint32), _small(n[where]))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at], pa.int32()), pa.array([data], pa.binary())], names=["block", "part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, asked, at = {}, [], None
        for b in batches:
            for bucket, block, blob in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), b.column("data")):
                if bucket != at:
                    if asked:
                        yield from done(at, index, asked)
                    index, asked, at = {}, [], bucket
                lids, words, counts = _unpacked(blob.as_py())
                where = np.fromiter((index.setdefault(w, len(index)) for w in words.split(b"\n")), np.int32, len(lids))
                asked.append((block, lids, where, counts))
        if asked:
            yield from done(at, index, asked)

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([-1], pa.int32()), pa.array([pickle.dumps(row)], pa.binary())], names=["block", "part", "data"])


def _with_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple[int, tuple]]]]:
    """Rows (block, part, data) sorted by both: each block (part -1) with its parts."""
    row, parts = None, []
    for b in batches:
        for part, data in zip(b.column("part").to_pylist(), b.column("data")):
            if part >= 0:
                parts.append((part, data.as_py()))
                continue
            if row is not None:
                yield row, parts
            row, parts = pickle.loads(data.as_py()), []
    if row is not None:
        yield row, parts


_NUMBERED = pa.schema([*(f for f in _BLOCK if f.name not in ("vocab", "train", "tokens")), ("number", pa.binary()), ("n", pa.binary())])
_NUMBERED_SQL = "block long, doc_id array<bigint>, held array<boolean>, size array<int>, ids binary, number binary, n binary"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the numbers and the corpus's training counts of their words in place of the vocabulary."""
    for row, parts in _with_parts(batches):
        parts = [_unpacked(data) for _, data in parts]
        number, n = np.zeros(sum(len(p[0]) for p in parts), np.int64), np.zeros(sum(len(p[0]) for p in parts), np.int64)
        for steps, numbers, counts in parts:
            lids = _sums(steps)
            number[lids], n[lids] = numbers, counts
        yield pa.RecordBatch.from_pylist([{**row, "number": _squeeze(number), "n": _packed(n)}], schema=_NUMBERED)


def _pair_codes(row: dict) -> np.ndarray:
    """Word and context of each token, as one number (up to 2 ** 31 words)."""
    word = _expand(row["number"])[_expand(row["ids"])].astype(np.int64)
    context = np.empty(len(word), np.int64)
    context[1:] = word[:-1]
    context[np.concatenate([[0], np.cumsum(row["size"])[:-1]])] = START
    return word << 32 | context


def _split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return codes >> 32, codes & 0xFFFFFFFF


def _dealt(codes: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes in the order of their cells, and where each cell's begin."""
    word, context = _split(codes)
    cell = word % grid * grid + context % grid
    order = np.argsort(cell, kind="stable")
    return order, np.searchsorted(cell[order], np.arange(grid * grid + 1))


#: ``kind`` of a row at a cell: words' totals, contexts' totals, the cell's state, a block's request; at a group: its state, tables of words and of contexts.
_GROUP, _WORDS, _CONTEXTS, _CELL, _BY_WORD, _BY_CONTEXT, _REQUEST = -1, -3, -2, 0, 1, 2, 3
_MESSAGE_SQL = "at int, kind int, source long, data binary"


def _message(at: int, kind: int, source: int, data: bytes, **more) -> pa.RecordBatch:
    cols = {"at": pa.array([at], pa.int32()), "kind": pa.array([kind], pa.int32()), "source": pa.array([source], pa.int64()), "data": pa.array([data], pa.binary())}
    return pa.RecordBatch.from_pydict(cols | {k: pa.array([int(v)], pa.int64()) for k, v in more.items()})


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, tuple]]:
    for b in batches:
        for at, kind, source, data in zip(*(b.column(c).to_pylist() for c in ("at", "kind", "source")), b.column("data")):
            yield at, kind, source, data.as_py()


def _requests(grid: int, counted: bool):
    """What a block sends to each cell: its distinct pairs there, with ``counted`` also their training customers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            tokens = _pair_codes(row)
            codes = np.unique(tokens)
            if counted:
                trained, count = np.unique(tokens[np.repeat(~np.array(row["held"]), row["size"])], return_counts=True)
                n = np.zeros(len(codes), np.int64)
                n[np.searchsorted(codes, trained)] = count
            order, cuts = _dealt(codes, grid)
            for k in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[k]:cuts[k + 1]]
                word, context = _split(codes[mine])
                yield _message(int(k), _REQUEST, row["block"], _packed(_steps(word), context.astype(np.uint32), *([_small(n[mine])] if counted else [])))

    return run


def _cell(at: int, grid: int, codes: np.ndarray, c: np.ndarray, t: np.ndarray, seatings: list, first: bool) -> Iterator[pa.RecordBatch]:
    """A cell's pairs with their customers, tables and recorded seatings, and the tables of its words and contexts for their groups."""
    word, context = _split(codes)
    yield _message(at, _CELL, at, _packed(_steps(word), context.astype(np.uint32), _small(c), _small(t), seatings))
    for kind, key, group in ((_BY_WORD, word, at // grid), (_BY_CONTEXT, context, at % grid)):
        keys, of = np.unique(key, return_inverse=True)
        sums = [np.bincount(of, weights=x, minlength=len(keys)).astype(np.int64) for x in ([t, c] if first else [t])]
        yield _message(group, kind, at, _packed(_steps(keys // grid), *map(_small, sums)))


def _seats(grid: int):
    """Requests sorted by cell to the cells' first seating: one table per pair with customers."""
    def done(at: int, codes: list, counts: list) -> Iterator[pa.RecordBatch]:
        code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        c = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)
        yield from _cell(at, grid, code, c, (c > 0).astype(np.int64), [], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, last = [], [], None
        for at, _, _, data in _messages(batches):
            if at != last:
                if codes:
                    yield from done(last, codes, counts)
                codes, counts, last = [], [], at
            steps, context, n = _unpacked(data)
            codes.append(_sums(steps) << 32 | context)
            counts.append(n)
        if codes:
            yield from done(last, codes, counts)

    return run


@dataclass
class Totals:
    """Sums over all restaurants."""
    tables: float
    root_tables: float
    vocabulary: int

    def base(self) -> float:
        return (ROOT_STRENGTH + ROOT_DISCOUNT * self.root_tables) / (self.vocabulary + 1)

    def root(self, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        """Predictive probability of words in the parent."""
        return (c0 - ROOT_DISCOUNT * t0 + self.base()) / (ROOT_STRENGTH + self.tables)


def seat(rng: np.random.Generator, n: np.ndarray, new: np.ndarray, discount: float) -> np.ndarray:
    """Tables of words with ``n`` customers, seated one by one: at a new table with weight ``new``, at the word's present tables
    with weight customers - discount * tables."""
    order = np.argsort(-n, kind="stable")
    n, new = n[order], new[order]
    t = (n > 0).astype(np.float64)
    i = 1
    while True:
        live = int(np.searchsorted(-n, -i, side="left"))  # those with more than i customers
        if not live:
            break
        step = 1 if i < SINGLE_STEPS else i // 16
        p = new[:live] / (new[:live] + i - discount * t[:live])
        t[:live] += rng.random(live) < p if step == 1 else rng.binomial(np.minimum(step, n[:live] - i), np.minimum(p, 1.0))
        i += step
    out = np.empty_like(t)
    out[order] = t
    return out


_GROUPS_SQL = _MESSAGE_SQL + ", words long, customers long, tables long, root_tables long"


def _group(totals: Totals | None, number: int, grid: int, record: bool, last: bool):
    """Rows sorted by group and kind: a group's state and the tables in its cells. Sums them, seats the parent (without ``totals`` one table
    per word) and answers each cell: customers and tables of its words in the parent, tables of its contexts; with ``last`` all recorded ones, and the
    contexts' customers."""
    def add(total: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        if len(at) and at[-1] >= len(total):
            total = np.concatenate([total, np.zeros(int(at[-1]) + 1 - len(total), np.int64)])
        total[at] += x
        return total

    def done(group: int, customers: np.ndarray, records: list, asked: list) -> Iterator[pa.RecordBatch]:
        none = np.zeros(1, np.int64)
        c0, tables = none.copy(), none.copy()
        for kind, _, data in asked:
            steps, t, *c = _unpacked(data)
            at = _sums(steps)
            if kind == _BY_WORD:
                c0 = add(c0, at, t)
            else:
                tables = add(tables, at, t)
                if c:
                    customers = add(customers, at, c[0])
        t0 = (c0 > 0).astype(np.int64)
        if totals is not None:
            t0 = seat(np.random.default_rng([number, group, 1]), c0, np.full(len(c0), totals.base()), ROOT_DISCOUNT).astype(np.int64)
        if record:
            records = [*records, (_small(c0), _small(t0), _small(tables))]
        yield _message(group, _GROUP, group, b"" if last else _packed(_small(customers), records), words=(c0 > 0).sum(), customers=customers.sum(), tables=c0.sum(), root_tables=t0.sum())
        for kind, cell, data in asked:
            at = _sums(_unpacked(data)[0])
            if kind == _BY_WORD:
                answer = [(_small(x[at]), _small(y[at])) for x, y, _ in (records if last else [(c0, t0, None)])]
            else:
                answer = [_small(x[at]) for x in ([customers, *(r[2] for r in records)] if last else [tables])]
            yield _message(cell, _WORDS if kind == _BY_WORD else _CONTEXTS, group, _packed(answer), words=0, customers=0, tables=0, root_tables=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers, records, asked, before = np.empty(0, np.int64), [], [], None
        for at, kind, source, data in _messages(batches):
            if at != before:
                if asked:
                    yield from done(before, customers, records, asked)
                customers, records, asked, before = np.empty(0, np.int64), [], [], at
            if kind == _GROUP:
                customers, records = _unpacked(data)
            else:
                asked.append((kind, source, data))
        if asked:
            yield from done(before, customers, records, asked)

    return run


def _state(data: bytes) -> tuple:
    """Codes, customers, tables and recorded seatings of a cell; places of its pairs among its distinct words and contexts."""
    steps, context, c, t, seatings = _unpacked(data)
    word = _sums(steps)
    return word << 32 | context, c.astype(np.int64), t.astype(np.int64), seatings, *(np.unique(x, return_inverse=True)[1] for x in (word, context))


def _sweep(totals: Totals, number: int, grid: int, record: bool):
    """One Gibbs sweep over the cells, from rows sorted by cell and kind; ``record`` keeps the new seating."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, kind, _, data in _messages(batches):
            if kind == _WORDS:
                ((c0, t0),), = _unpacked(data)
            elif kind == _CONTEXTS:
                (tables,), = _unpacked(data)
            else:
                codes, c, t, seatings, word, context = _state(data)
                rng = np.random.default_rng([number, at, 0])
                others = np.maximum(tables[context].astype(np.int64) - t, 0)
                t = seat(rng, c, (STRENGTH + DISCOUNT * others) * totals.root(c0, t0)[word], DISCOUNT).astype(np.int64)
                yield from _cell(at, grid, codes, c, t, [*seatings, _small(t)] if record else seatings, False)

    return run


def _answers(samples: list[Totals]):
    """Rows sorted by cell and kind: totals, a cell's state, then the blocks' requests, each answered with the pairs' probabilities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, kind, source, data in _messages(batches):
            if kind == _WORDS:
                parent, = _unpacked(data)
            elif kind == _CONTEXTS:
                (customers, *tables), = _unpacked(data)
            elif kind == _CELL:
                codes, c, _, seatings, word, context = _state(data)
                p, total = np.zeros(len(codes)), STRENGTH + customers[context].astype(np.int64)
                for s, (c0, t0), among, t in zip(samples, parent, tables, seatings):
                    p += (c - DISCOUNT * t) / total + (STRENGTH + DISCOUNT * among.astype(np.int64)[context]) / total * s.root(c0, t0)[word]
                p = (p / len(samples)).astype(np.float32)
            else:
                steps, asked = _unpacked(data)
                answer = p[np.searchsorted(codes, _sums(steps) << 32 | asked)]
                yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([at], pa.int32()), pa.array([_packed(answer)], pa.binary())], names=["block", "part", "data"])

    return run


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(vocabulary: int, train_tokens: int, grid: int):
    """Rows (block, part, data) sorted by block and part: the block itself, then the answers of the cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, answers in _with_parts(batches):
            codes, of = np.unique(_pair_codes(row), return_inverse=True)
            order, cuts = _dealt(codes, grid)
            logs = np.empty(len(codes))
            for cell, data in answers:
                logs[order[cuts[cell]:cuts[cell + 1]]] = np.log10(_unpacked(data)[0].astype(np.float64))
            ids, size, n = _expand(row["ids"]), np.array(row["size"]), _unpacked(row["n"])[0]
            base = np.log10((n + 1) / (train_tokens + vocabulary + 1))
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(size, pa.int64()),
                 pa.array(np.add.reduceat((n[ids] > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base[ids], starts)),
                 pa.array(np.add.reduceat(logs[of], starts))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _met(*parts: DataFrame) -> DataFrame:
    """Rows for the same cell or group in one task, by kind and source."""
    out = parts[0].select("at", "kind", "source", "data")
    for p in parts[1:]:
        out = out.unionByName(p.select("at", "kind", "source", "data"))
    return out.repartition("at").sortWithinPartitions("at", "kind", "source")


def score(docs: DataFrame, held_out) -> DataFrame:
    """Learns from the rows of ``docs(doc_id, text)`` where the Column ``held_out`` is false and scores all: doc_id, held_out,
    n_tokens (words and one end token), n_known, train_tokens, base_score (add-one unigram) and score (the model), both log10
    probabilities of the text. Perplexity is 10 ** (-score / n_tokens).

    Defined cases: a null or wordless text has the end token only; rows for which ``held_out`` is null (null doc_id) are not learned from
    and count as held out; repeated rows are separate texts; without training rows every word is unknown and the scores are 0
    (a vocabulary of one unknown word); other columns are ignored."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held"))
    blocks = written(src.mapInArrow(_blocks, _BLOCK_SQL), "blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    grid, buckets = max(1, math.isqrt(max(0, tokens - 1) // CELL_TOKENS) + 1), 1 + tokens // BUCKET_TOKENS
    numbers = (blocks.select("block", "vocab", "train").mapInArrow(_word_counts(buckets), "bucket int, block long, data binary")
               .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_numbers(buckets), "block long, part int, data binary"))
    heads = blocks.select("block", "doc_id", "held", "size", "ids").mapInArrow(_heads, "block long, part int, data binary")
    numbered = written(heads.unionByName(numbers).repartition("block").sortWithinPartitions("block", "part").mapInArrow(_numbered, _NUMBERED_SQL), "numbered")
    discard(blocks)
    cells = written(_met(numbered.mapInArrow(_requests(grid, True), _MESSAGE_SQL)).mapInArrow(_seats(grid), _MESSAGE_SQL), "seating")
    groups, totals, samples = None, None, []  # samples: the totals of each recorded seating
    for k in range(SWEEPS + 1):  # seatings after k sweeps
        record, last = k > BURN_IN, k == SWEEPS
        told = cells.where(F.col("kind") > _CELL)
        old, groups = groups, written(_met(told, *([groups.where(F.col("kind") == _GROUP)] if groups else []))
                                      .mapInArrow(_group(totals, k, grid, record, last), _GROUPS_SQL), "groups")
        if old:
            discard(old)
        one = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "customers", "tables", "root_tables")]).first()
        vocabulary, train_tokens, totals = int(one[0]), int(one[1]), Totals(float(one[2]), float(one[3]), int(one[0]))
        if record:
            samples.append(totals)
        if not last:
            met = _met(cells.where(F.col("kind") == _CELL), groups.where(F.col("kind") < _GROUP))
            old, cells = cells, written(met.mapInArrow(_sweep(totals, k, grid, k + 1 > BURN_IN), _MESSAGE_SQL), "seating")
            discard(old)
    asked = _met(cells.where(F.col("kind") == _CELL), groups.where(F.col("kind") < _GROUP), numbered.mapInArrow(_requests(grid, False), _MESSAGE_SQL))
    answers = asked.mapInArrow(_answers(samples), "block long, part int, data binary")
    scored = (numbered.mapInArrow(_heads, "block long, part int, data binary").unionByName(answers).repartition("block").sortWithinPartitions("block", "part")
              .mapInArrow(_score(vocabulary, train_tokens, grid), _SCORE))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
