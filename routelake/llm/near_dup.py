"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct 5-word shingles. Its signature has ``SYMBOLS`` b-bit MinHash values; two documents
whose signatures differ in at most ``distance`` of them are candidates. By the pigeonhole principle such a
pair has one of the signature's chunks with at most one differing symbol if there are more than distance / 2 chunks, so
indexing every chunk with each one of its symbols left out (which also covers zero errors) finds *all* pairs within
the distance. At similarity s a symbol differs with probability 1 - s: ``plan`` takes the least distance that a link at the
threshold is past with a probability of at most ``MISS``, and the chunks that it needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import CACHE_BYTES, Cache, UnionFind, components, group_bounds, tiled, whole_groups, worker_state, written

WORDS = 5
SYMBOLS = 40        # b-bit MinHash values in a signature, b = 16
MISS = 1e-5         # chance that a pair at the very threshold is past the signature distance
MIN_CHUNK = 3       # symbols of the shortest chunk that is indexed
KEY_TILE = 256      # members of one index key that meet in one task step
FEW = 16            # members of one index key whose pairs are listed one by one
SET_TILE = 192      # documents whose whole sets meet in one task step

_U = np.uint64
_rng = np.random.RandomState(20240501)
_MULT = _rng.randint(1, 2**63 - 1, SYMBOLS, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_ADD = _rng.randint(1, 2**63 - 1, SYMBOLS, dtype=np.int64).astype(_U)
_PLACE = _rng.randint(1, 2**63 - 1, WORDS, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def plan(percent: int) -> tuple[int, int]:
    """(signature distance, chunks) for links from ``percent`` on: the least distance with P(more symbols differ) <= ``MISS`` at the
    threshold (binomial), and the chunks that leave one of them with at most one of so many errors. Fewer than two symbols a chunk
    would index nothing, so similarities that need that (below about 0.72) are refused."""
    differ, past, distance = 1 - percent / 100, 1.0, -1
    while past > MISS and distance < SYMBOLS:
        distance += 1
        past = sum(math.comb(SYMBOLS, k) * differ**k * (1 - differ)**(SYMBOLS - k) for k in range(distance + 1, SYMBOLS + 1))
    chunks = distance // 2 + 1
    if SYMBOLS // chunks < MIN_CHUNK:
        raise ValueError(f"links from {percent} % on need {distance} differing symbols of {SYMBOLS}: more than this index serves")
    return distance, chunks


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hash(words: Cache, w: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(w)
    words.put(w, h, len(w) + 32)
    return h


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles (of the whole word sequence if shorter; empty
    without words). Words are runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased: exactly what ``bytes.split`` and ``bytes.lower`` do."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, _U)
    known = worker_state("near_dup", lambda: Cache(CACHE_BYTES // 2))
    get = known.get
    h = np.array([get(w) or _word_hash(known, w) for w in words], dtype=_U)
    n = max(1, len(h) - WORDS + 1)
    s = np.full(n, min(len(h), WORDS), dtype=_U)
    for i in range(min(WORDS, len(h))):
        s += h[i:i + n] * _PLACE[i]
    return np.unique(_mix(s))


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, SYMBOLS) uint16 MinHash symbols of non-empty sets."""
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = np.concatenate(sets)
    for k in range(SYMBOLS):
        low = np.minimum.reduceat((flat * _MULT[k] + _ADD[k]) >> _U(8), starts)
        out[:, k] = (_mix(low) & _U(0xFFFF)).astype(np.uint16)
    return out


_SIG_SCHEMA = "doc_id long, n_shingles long, fp binary, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text")
        at = 0
        while at < b.num_rows:  # slices of about 2 million shingles
            sets, size, begin = [], 0, at
            while at < b.num_rows and size < 2_000_000:
                sets.append(shingle_set(texts[at].as_py()))
                size += len(sets[-1])
                at += 1
            full = [i for i, s in enumerate(sets) if len(s)]
            sigs: list = [None] * len(sets)
            if full:
                for i, row in zip(full, _signatures([sets[i] for i in full])):
                    sigs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(begin, at - begin), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "fp", "sig"])


def _index_keys(sigs: np.ndarray, chunks: int) -> np.ndarray:
    """(rows, SYMBOLS) 64-bit keys: for each chunk and each of its symbols, the chunk without that symbol."""
    keys = []
    for c, idx in enumerate(np.array_split(np.arange(SYMBOLS), chunks)):
        terms = sigs[:, idx].astype(_U) + _U(1)
        terms = terms * _PLACE[0] * (np.arange(len(idx), dtype=_U) * _U(2) + _U(0x9E3779B97F4A7C15))
        terms = _mix(terms)
        total = terms.sum(axis=1, dtype=_U)
        for j in range(len(idx)):
            keys.append(_mix(total - terms[:, j] + _U((c * 64 + j + 1) * 0xD6E8FEB86659FD93 % 2**64)))
    return np.stack(keys, axis=1)


def _sig_matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _keys(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = _index_keys(_sig_matrix(b.column("sig")), chunks)
                rep = np.repeat(b.column("rep").to_numpy(), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(rep)], names=["key", "rep"])

    return run


def _pairs_of(spans: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row index pairs of every (start, end), in slices of at most about 200,000 pairs."""
    left, right, size = [], [], 0
    for s, e in spans:
        a, b = np.triu_indices(e - s, 1)
        left.append(a + s)
        right.append(b + s)
        size += len(a)
        if size > 200_000:
            yield np.concatenate(left), np.concatenate(right)
            left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row that it reaches."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _spanning(ids: np.ndarray, own: np.ndarray, ti: int, tj: int, linked) -> np.ndarray:
    """Id pairs that connect what the links of two tiles connect; ``linked(x, y)`` is the matrix of links between rows. Within a tile every
    row is tied to the smallest id that it reaches, and between tiles only these ids are, so tiles that are alike add the same few
    pairs however many of them meet."""
    if ti == tj:
        order = np.argsort(ids, kind="stable")
        return np.stack([ids[order][_roots(linked(order, order))], ids[order]], axis=1)
    x, y = (i[np.argsort(ids[i], kind="stable")] for i in (np.flatnonzero(own == ti), np.flatnonzero(own == tj)))
    i, j = np.nonzero(linked(x, y))
    if not len(i):
        return np.empty((0, 2), np.int64)
    return np.unique(np.stack([ids[x][_roots(linked(x, x))[i]], ids[y][_roots(linked(y, y))[j]]], axis=1), axis=0)


_TILE = ["key", "ti", "tj"]


def _hamming_edges(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task, spanning links of the pairs within the signature distance."""
        sets = UnionFind()
        for t in whole_groups(batches, _TILE):
            reps, sigs = t.column("rep").to_numpy(), _sig_matrix(t.column("sig"))
            own, ti, tj = (t.column(c).to_numpy() for c in ("own", "ti", "tj"))
            bounds = group_bounds(t, _TILE)
            spans, found = list(zip(bounds[:-1].tolist(), bounds[1:].tolist())), []
            few = [ti[s] == tj[s] and e - s <= FEW for s, e in spans]
            for a, b in _pairs_of([x for x, small in zip(spans, few) if small]):
                near = (sigs[a] != sigs[b]).sum(axis=1) <= distance
                pairs = np.unique(np.stack([reps[a[near]], reps[b[near]]], axis=1), axis=0)
                found += [p for p in pairs.tolist() if sets.union(*p)]
            for s, e in (x for x, small in zip(spans, few) if not small):
                mine = sigs[s:e]
                pairs = _spanning(reps[s:e], own[s:e], ti[s], tj[s], lambda x, y: (mine[x][:, None] != mine[y][None]).sum(axis=2) <= distance)
                found += [p for p in pairs.tolist() if sets.union(*p)]
            if found:
                f = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1])], names=["a", "b"])

    return run


def _links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of 100 * |A & B| >= percent * |A | B|, from whole sets. Only shingles that two or more of the
    sets hold count towards intersections, so their 0/1 matrix is small; it is multiplied in column slices."""
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], place[col[keep]]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        inter += m @ m.T
    inter = np.rint(inter).astype(np.int64)
    return 100 * inter >= percent * (n[:, None] + n[None, :] - inter)


_COMP = ["component", "ti", "tj"]


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, _COMP):
            reps, texts, fps, own, ti, tj = (t.column(c) for c in ("rep", "text", "fp", "own", "ti", "tj"))
            bounds, found = group_bounds(t, _COMP), []
            for s, e in zip(bounds[:-1], bounds[1:]):
                forest = UnionFind()
                sets, at = [], []
                for i in range(s, e):
                    x = shingle_set(texts[i].as_py())
                    if xxhash.xxh3_128_digest(x.tobytes()) == fps[i].as_py():  # a repeated doc_id may carry another text
                        sets.append(x)
                        at.append(i)
                if len(sets) > 1:
                    links = _links(sets, percent)
                    pairs = _spanning(reps.take(at).to_numpy(), own.take(at).to_numpy(), ti[s].as_py(), tj[s].as_py(), lambda x, y: links[np.ix_(x, y)])
                    found += [p for p in pairs.tolist() if forest.union(*p)]
            if found:
                f = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1])], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| over their shingle sets. Documents with equal
    sets form one class (collapsed by a map-side aggregate, however large); the Hamming join runs over class
    representatives, its candidate components are confirmed on whole sets in tiles of bounded size, and only spanning links
    are written.

    Defined cases: a null or wordless text has an empty set and is linked with nothing. A null doc_id takes no part:
    component_id null, kept. Rows that repeat a doc_id are judged row by row; equal ones agree. Other columns are
    ignored."""
    distance, chunks = plan(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.mapInArrow(_sign, _SIG_SCHEMA), "signatures")
    classes = written(signed.where("n_shingles > 0 and doc_id is not null").groupBy("fp")
                      .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    keys = classes.select("rep", "sig").mapInArrow(_keys(chunks), "key long, rep long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keys.join(shared, "key").join(classes.select("rep", "sig"), "rep")
    edges = (tiled(rows, "n", "rep", KEY_TILE).select(*_TILE, "own", "rep", "sig")
             .repartition(*_TILE).sortWithinPartitions(*_TILE).mapInArrow(_hamming_edges(distance), "a long, b long"))
    coarse = written(components(edges), "candidates")
    sizes = coarse.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = (coarse.join(sizes, "component").withColumnRenamed("id", "rep")
               .join(classes.select("rep", "fp"), "rep"))
    texts = docs.where("doc_id is not null").join(members.withColumn("doc_id", F.col("rep")), "doc_id")
    links = (tiled(texts, "n", "rep", SET_TILE).select(*_COMP, "own", "rep", "fp", "text")
             .repartition(*_COMP).sortWithinPartitions(*_COMP).mapInArrow(_confirm(percent), "a long, b long"))
    linked = components(links).withColumnRenamed("id", "rep")
    known = classes.select("fp", "rep").join(linked, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return (signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp"))
            .join(known, "fp", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
