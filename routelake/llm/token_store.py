"""Token ids in directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level k stores the k-th chunks of the ids that have one; a
continuation bitmap says which of them go on to level k + 1, and a rank directory (set bits before each 64-bit word)
gives their place there. Any token is read with one look-up per level, without decoding its neighbours. A file
is a Parquet table of segments of whole documents in ascending doc_id order.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelake.llm.alignment import byte_alphabet
from routelake.llm.common import CACHE_BYTES, Cache, worker_state, written

SEGMENT_TOKENS = 65_536  # a segment ends with the document that reaches this; a longer document is a segment of its own
CACHED_CHARS = 64
JOINED = 50              # pieces that are encoded in one string

SEGMENT = ("shard int, seq int, first long, n_tokens long, doc_ids array<bigint>, starts array<bigint>, "
           "chunks array<binary>, more array<binary>, ranks array<binary>")


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(chunks, continuation bitmaps, rank directories) by level."""
    chunks, more, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        chunks.append((rest & 255).astype(np.uint8).tobytes())
        rest = rest >> 8
        goes_on = rest > 0
        if not goes_on.any():
            return chunks, more, ranks
        bits = np.packbits(goes_on, bitorder="little")
        words = np.frombuffer(bits.tobytes().ljust(-(-len(bits) // 8) * 8, b"\0"), "<u8")
        more.append(words.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint32)[:-1]]).astype("<u4").tobytes())
        rest = rest[goes_on]


class Segment:
    """Random access to the ids of one segment."""

    def __init__(self, chunks: list[bytes], more: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(c, np.uint8) for c in chunks]
        self.more = [np.frombuffer(m, "<u8") for m in more]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    def get(self, at: np.ndarray) -> np.ndarray:
        """Ids at the given places, in any order."""
        out = self.chunks[0][at].astype(np.uint32)
        places, at = np.arange(len(at)), at.astype(np.uint64)
        for k, (words, ranks) in enumerate(zip(self.more, self.ranks)):
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            w = words[word]
            goes_on = (w >> bit) & np.uint64(1) == 1
            places, word, bit, w = places[goes_on], word[goes_on], bit[goes_on], w[goes_on]
            if not len(places):
                break
            at = ranks[word] + np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.uint64)
            out[places] |= self.chunks[k + 1][at.astype(np.int64)].astype(np.uint32) << np.uint32(8 * (k + 1))
        return out


class PieceEncoder:
    """Encodes texts with a file of the tokenizers library, whose pre-tokenizer begins a token at every space before a
    non-space: texts without other white space around spaces are encoded by their space-separated pieces, each distinct one once."""

    def __init__(self, path: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [] if special_as_text else added  # a text with one of them is encoded whole
        self.known = Cache(CACHE_BYTES * 2)  # this operator keeps little else
        byte = byte_alphabet()
        vocab = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token
        for token, i in vocab.items():
            self.size[i] = len(token) if all(c in byte for c in token) else len(token.encode())

    @classmethod
    def load(cls, path: str, special_as_text: bool) -> PieceEncoder:
        return worker_state(("token_store", path, special_as_text), lambda: cls(path, special_as_text))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of a space and each piece. ``JOINED`` pieces at a time are encoded as they stand in a text, a space before each, and cut where
        the tokens' bytes reach the pieces' ends."""
        texts = [" " + " ".join(pieces[i:i + JOINED]) for i in range(0, len(pieces), JOINED)]
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
        whole = np.frombuffer("".join(texts).encode(), np.uint8)
        ends = np.append(np.flatnonzero(whole == 32)[1:], len(whole))  # a piece ends where the next one's space begins
        at = np.cumsum(self.size[ids])
        last = np.searchsorted(at, ends)
        if not len(ids) or at[-1] != ends[-1] or (at[last] != ends).any():
            return self._ids([" " + p for p in pieces])
        raw, cuts = ids.astype("<u4").tobytes(), [0, *((last + 1) * 4).tolist()]
        return [raw[s:e] for s, e in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.split(" ") for t in texts]
        special = [any(s in t for s in self.special) for t in texts]
        split = [[""] if s else pieces for s, pieces in zip(special, split)]
        known = self.known
        split = [(pieces[0], pieces[1:]) for pieces in split]
        found = [list(map(known.get, rest)) for _, rest in split]
        new = {p for (_, rest), ids in zip(split, found) if None in ids for p, x in zip(rest, ids) if x is None}
        odd = {p for p in new if not p or p[0].isspace() or p[0] == "\u180e"}
        fresh = list(new - odd)
        fresh = dict(zip(fresh, self._pieces(fresh))) if fresh else {}
        whole = [s or bool(odd) and not odd.isdisjoint(rest) for s, (_, rest) in zip(special, split)]
        heads = self._ids([t if w else head for t, (head, _), w in zip(texts, split, whole)])
        out = [head if w else head + b"".join([x or fresh[p] for p, x in zip(rest, ids)] if None in ids else ids)
               for head, (_, rest), ids, w in zip(heads, split, found, whole)]
        for p, ids in fresh.items():
            if len(p) <= CACHED_CHARS:
                known.put(p, ids, len(p) + len(ids))
        return out


def _encode(path: str, end_id: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = PieceEncoder.load(path, special_as_text), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        first = seq = size = 0
        doc_ids, parts = [], []

        def segment():
            lengths = [len(p) // 4 for p in parts]
            chunks, more, ranks = pack(np.frombuffer(b"".join(parts), "<u4"))
            row = {"shard": shard, "seq": seq, "first": first, "n_tokens": size, "doc_ids": list(doc_ids),
                   "starts": np.concatenate([[0], np.cumsum(lengths)]).tolist(), "chunks": chunks, "more": more, "ranks": ranks}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for i, ids in zip(part.column("doc_id").to_pylist(), encoder.encode([t.as_py() or "" for t in part.column("text")])):
                    doc_ids.append(i)
                    parts.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT_TOKENS:
                        yield segment()
                        first, seq, size = first + size, seq + 1, 0
                        doc_ids.clear()
                        parts.clear()
        if parts:
            yield segment()

    return run


_ARROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("starts", pa.list_(pa.int64())), ("chunks", pa.list_(pa.binary())), ("more", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def write_tokens(docs: DataFrame, path: str, end_id: int, special_as_text: bool = False) -> DataFrame:
    """Encodes ``docs(doc_id, text)``, appends ``end_id`` to each, and writes the segments in ascending doc_id order into the
    shared folder; returns the files as a table. Only the documents are shuffled, once, by ranges of doc_id (and of the
    text's hash, so that rows which repeat a doc_id can be split).

    The strings of the file's special tokens in a text become these tokens, as the tokenizers library does by default;
    with ``special_as_text`` they are ordinary text. Defined cases: a null text is empty and has the end id only; a null doc_id comes first; rows that repeat a doc_id
    follow one another in the order of their texts' hashes; an empty table gives no file rows; a text longer than a segment is a
    segment of its own; other columns are ignored."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.withColumn("h", F.xxhash64("text"))
    ordered = src.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(_encode(path, end_id, special_as_text), SEGMENT), "tokens")


def read_tokens(files: DataFrame, fn, schema: str) -> DataFrame:
    """Applies ``fn(doc_id, start, ids)`` to every document of the files, the ids read back by random access; ``start`` counts
    the tokens of all documents before it. Only the shards' totals (a row per writing task) are broadcast."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                store, starts = Segment(row["chunks"], row["more"], row["ranks"]), row["starts"]
                base = row["base"] + row["first"]
                rows = [fn(d, base + s, store.get(np.arange(s, e))) for d, s, e in zip(row["doc_ids"], starts, starts[1:])]
                yield pa.RecordBatch.from_pylist(rows)

    return files.join(F.broadcast(shards), "shard").mapInArrow(run, schema)
