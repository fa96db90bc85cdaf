"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte pieces. A bucket per merge rank holds the list positions whose pair has
that rank; a three-level bitmap over the ranks finds the lowest non-empty bucket by find-first-set; entries whose pair has
changed are stale and skipped. A pre-token of n bytes takes O(n) queue steps, each O(log n) within its bucket, however long it is.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import CACHE_BYTES, Cache, worker_state

CACHED_CHARS = 64      # longer pre-tokens are encoded anew each time
SPACED_BYTES = CACHE_BYTES * 6 // 5  # of pre-tokens and pieces that begin with a space; this operator keeps little else
DECODED_AT_ONCE = 1 << 26  # bytes of ids
TOKEN_BYTES = CACHE_BYTES // 10      # and of other pre-tokens


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = {r: b for b, r in ranks.items()}
        self.entries = pa.array([self.pieces.get(r) for r in range(max(self.pieces, default=0) + 1)], pa.large_binary())
        self.longest = max(map(len, ranks), default=1)
        self.find = regex.compile(pattern).findall
        size = max(ranks.values(), default=0) + 1
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.buckets: dict[int, list[int]] = {}
        self.two = [ranks.get(bytes((i >> 8, i & 255)), -1) for i in range(65536)]  # rank of each pair of bytes
        self.splits = pattern == public_tokenizers.PATTERN  # a space before a non-space always begins a match
        self.spaced = Cache(SPACED_BYTES)  # without the space: ids of a space and the key, be it one pre-token or more
        self.tokens = Cache(TOKEN_BYTES)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        """The coder of a worker for a rank file (lines of base64 token, space, rank)."""
        def make():
            with open(path, "rb") as f:
                return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

        return worker_state(("byte_bpe", path, pattern), make)

    def merge(self, b: bytes) -> list[int]:
        """Token ids of one pre-token: the lowest rank merges first, the leftmost pair on ties."""
        get, longest = self.ranks.get, self.longest
        if (whole := get(b)) is not None:
            return [whole]
        n = len(b)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        two = self.two
        pair = [two[x << 8 | y] for x, y in zip(b, b[1:])]  # rank of the pair that begins here
        new = [i for i, r in enumerate(pair) if r >= 0]  # positions that go to the bucket of their pair's rank
        pair += (-1, -1)
        buckets, low, mid, top = self.buckets, self.low, self.mid, 0
        while True:
            for i in new:
                rank = pair[i]
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    w = rank >> 6
                    t = w >> 6
                    low[w] |= 1 << (rank & 63)
                    mid[t] |= 1 << (w & 63)
                    top |= 1 << t
            if not top:
                break
            t = (top & -top).bit_length() - 1  # find first set, level by level
            m = mid[t]
            w = (t << 6) + (m & -m).bit_length() - 1
            x = low[w]
            rank = (w << 6) + (x & -x).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                low[w] = x = x & (x - 1)
                if not x:
                    mid[t] = m = m & (m - 1)
                    if not m:
                        top &= top - 1
            new = []
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            after[i] = end = after[gone]
            before[end] = i
            pair[gone] = pair[i] = -1
            if end < n:
                stop = after[end]
                if stop - i <= longest and (r := get(b[i:stop])) is not None:
                    pair[i] = r
                    new.append(i)
            p = before[i]
            if p >= 0:
                pair[p] = r = get(b[p:end], -1) if end - p <= longest else -1
                if r >= 0:
                    new.append(p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[b[i:after[i]]])
            i = after[i]
        return out

    def _token(self, t: str) -> bytes:
        """Ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        cache, key = (self.spaced, t[1:]) if t[0] == " " else (self.tokens, t)
        ids = cache.get(key)
        if ids is None:
            merged = self.merge(t.encode("utf-8", "surrogatepass"))
            ids = struct.pack(f"<{len(merged)}I", *merged)
            if len(t) <= CACHED_CHARS:
                cache.put(key, ids, len(t) + len(ids))
        return ids

    def _piece(self, p: str) -> bytes | None:
        """Ids of a space and the piece after it; None if the piece is empty or begins with white space."""
        if not p or p[0].isspace():
            return None
        found = self.find(" " + p)
        if len(found) == 1:
            return self._token(found[0])
        ids = b"".join(map(self._token, found))
        if len(p) <= CACHED_CHARS:
            self.spaced.put(p, ids, len(p) + len(ids))
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text. A space before a non-space always begins a match of the public pattern, so under it a text without
        runs of white space before or after a space is encoded piece by piece; under another pattern it is taken whole."""
        if not self.splits:
            return b"".join(map(self._token, self.find(text)))
        pieces, get = text.split(" "), self.spaced.get
        out = list(map(get, pieces))
        out[0] = b"".join(map(self._token, self.find(pieces[0])))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    p = pieces[i]
                    if (ids := get(p)) is None and (ids := self._piece(p)) is None:
                        return b"".join(map(self._token, self.find(text)))
                    out[i] = ids
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_all(self, ids: list[bytes]) -> pa.Array:
        """The decoded bytes of every document. The entries of all their ids, taken in order, lie one after the other."""
        if sum(map(len, ids)) > DECODED_AT_ONCE:
            return pa.array(list(map(self.decode, ids)), pa.binary())
        taken = self.entries.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        ends = np.cumsum([0] + [len(x) // 4 for x in ids])
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:taken.offset + len(taken) + 1][ends]
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), taken.buffers()[2]]).cast(pa.binary())


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token ids of ``docs(doc_id, text)``: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (the
    bytes the ids decode to). A null text is empty and has no tokens; rows are judged one by one (null and repeated
    doc_ids stay); an empty table gives an empty result; texts of any length are taken whole; other columns are ignored. ``path`` must be
    readable on every executor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBPE.load(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids = [coder.encode(t.as_py() or "") for t in b.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     coder.decode_all(ids)], names=["doc_id", "n_tokens", "ids", "decoded"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary"))

