"""Benchmark decontamination by greedy string tiling.

Texts become words (ASCII letters lower-cased; ASCII letters, digits and all non-ASCII characters count). Running
Karp-Rabin hashes of ``MIN_MATCH`` words are the seeds: document windows meet benchmark windows with the same hash.
Along each diagonal, consecutive seeds form maximal matches; the longest one that is still free is marked again
and again (greedy string tiling), so passages are found in any order. An item leaks into a document if the marked
tiles cover at least ``MIN_COVER`` of its words, or if the longest of them has ``MIN_PASSAGE`` words, whatever share of a long item that is.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import worker_state, written

MIN_MATCH = 5       # words of the shortest tile
MIN_COVER = 0.5     # share of a benchmark item's words in tiles that makes it a leak
MIN_PASSAGE = 50    # words of a single tile that make a leak of an item of any length
BLOCK_BYTES = 4_000_000  # benchmark text that goes to the tasks at once

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def _powers(n: int) -> np.ndarray:
    return np.array([pow(_BASE, k, 2**64) for k in range(n)], dtype=_U)


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of each window of ``n`` words."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, _U)
    h = np.zeros(m, dtype=_U)
    for k, p in enumerate(_powers(n)):
        h += ids[k:k + m] * p
    return h


class BenchmarkIndex:
    """Seeds of one bounded block of benchmark items: (window hash -> item, position), by seed length. Items shorter than
    ``min_match`` words are seeds of their own length; wordless items match nothing."""

    def __init__(self, items: list[tuple[int, str | None]], min_match: int = MIN_MATCH):
        self.min_match, self.items, self.vocab = min_match, [], {}
        by_length: dict[int, list] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocab.setdefault(w, xxhash.xxh3_64_intdigest(w) | 1) for w in words], dtype=_U)
            n = min(min_match, len(ids))
            h = _windows(ids, n)
            k = len(self.items)
            self.items.append((item_id, ids, n))
            by_length.setdefault(n, []).append((h, np.full(len(h), k), np.arange(len(h))))
        self.seeds = {}
        for n, parts in by_length.items():
            h, k, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.seeds[n] = h[order], k[order], at[order]

    def leaks(self, text: str | None, min_cover: float = MIN_COVER) -> list[tuple[int, float, int]]:
        """(item_id, share of its words in tiles, number of tiles) of each item that leaks into the text."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words_of(text)], dtype=_U)
        out = []
        for n, (hashes, item_of, at) in self.seeds.items():
            known = np.cumsum(np.concatenate([[0], ids != 0]))
            places = np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else np.empty(0, np.int64)
            if not len(places):
                continue
            h = _windows(ids, n)[places]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = hi > lo
            places, lo, count = places[hit], lo[hit], (hi - lo)[hit]
            if not len(places):
                continue
            seed = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            place, item, pos = np.repeat(places, count), item_of[seed], at[seed]
            order = np.argsort(item, kind="stable")
            place, item, pos = place[order], item[order], pos[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(item)) + 1, [len(item)]])
            for s, e in zip(cuts[:-1], cuts[1:]):
                item_id, want, _ = self.items[item[s]]
                reach = np.zeros(len(want) + 1, np.int64)  # words that any tile could cover: an upper bound
                starts = np.unique(pos[s:e])
                np.add.at(reach, starts, 1)
                np.add.at(reach, np.minimum(starts + n, len(want)), -1)
                if (np.cumsum(reach[:-1]) > 0).sum() < min(min_cover * len(want), MIN_PASSAGE):
                    continue
                cover, tiles, longest = tile(ids, want, place[s:e], pos[s:e], n)
                if cover >= min_cover * len(want) or longest >= MIN_PASSAGE:
                    out.append((item_id, cover / len(want), tiles))
        return out


def tile(doc: np.ndarray, item: np.ndarray, place: np.ndarray, pos: np.ndarray, n: int) -> tuple[int, int, int]:
    """Greedy string tiling from seed matches (document place, item position): covered item words, tiles, words of the longest tile."""
    order = np.lexsort((place, place - pos))
    place, pos = place[order], pos[order]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (np.diff(place) != 1) | (np.diff(pos) != 1)
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(place))) + n - 1
    heap = [(-int(m), int(pos[i]), int(place[i])) for i, m in zip(starts, lengths)]
    heapq.heapify(heap)
    doc_free, item_free = np.ones(len(doc), bool), np.ones(len(item), bool)
    cover = tiles = longest = 0
    while heap:
        m, j, i = heapq.heappop(heap)
        m = -m
        free = doc_free[i:i + m] & item_free[j:j + m] & (doc[i:i + m] == item[j:j + m])
        if free.all():
            doc_free[i:i + m] = False
            item_free[j:j + m] = False
            cover += m
            tiles += 1
            longest = max(longest, m)
            if cover == len(item):  # nothing left to mark: passages of repeated words have many more seeds
                break
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= n:
                heapq.heappush(heap, (a - b, j + a, i + a))
    return cover, tiles, longest


def benchmark_blocks(benchmark: DataFrame, block_bytes: int | None = None) -> Iterator[tuple[list[tuple[int, str | None]], int]]:
    """The benchmark in blocks of about ``block_bytes`` of text, each read when it is asked for."""
    block_bytes = block_bytes or BLOCK_BYTES
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-size // block_bytes) or 1
    for p in range(parts):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        yield [(r.item_id, r.text) for r in block.collect()], parts


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER) -> DataFrame:
    """Leaks of ``benchmark(item_id, text)`` into ``docs(doc_id, text)``: one row per document and item (doc_id,
    item_id, coverage, tiles). Documents are only scanned, never shuffled, once for each benchmark block; of a benchmark of several
    blocks each one's leaks are written before the next block is read, so the driver and the tasks hold one block at a time.

    Defined cases: null or wordless documents and items match nothing; an item with fewer than ``min_match`` words
    must occur whole; a null doc_id is kept as null; repeated rows give repeated results; texts of any length are searched whole; an empty
    side gives an empty result; other columns are ignored."""
    out = None
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items, parts in benchmark_blocks(benchmark):
        def run(batches: Iterator[pa.RecordBatch], items=items, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = worker_state(("decontaminate", name), lambda: BenchmarkIndex(items, min_match))
            for b in batches:
                rows = [(d.as_py(), *leak) for d, t in zip(b.column("doc_id"), b.column("text")) for leak in index.leaks(t.as_py(), min_cover)]
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                                                 names=["doc_id", "item_id", "coverage", "tiles"])

        part = docs.mapInArrow(run, "doc_id long, item_id long, coverage double, tiles long")
        part = written(part, "leaks") if parts > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER) -> DataFrame:
    """``docs`` without the rows whose text holds a leak; all columns stay. One scan and no shuffle for each benchmark block; of several blocks,
    what each leaves is written before the next one is read."""
    for items, parts in benchmark_blocks(benchmark):
        def run(batches: Iterator[pa.RecordBatch], items=items, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = worker_state(("decontaminate", name), lambda: BenchmarkIndex(items, min_match))
            for b in batches:
                yield b.filter(pa.array([not index.leaks(t.as_py(), min_cover) for t in b.column("text")], pa.bool_()))

        left = docs.mapInArrow(run, docs.schema)
        docs = written(left, "decontaminated") if parts > 1 else left
    return docs
