"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the same bytes (a space and the text) into tokens A and B. All tokens are lexsorted by their start; the running
maximum of their ends (``maximum.accumulate``) breaks them into groups wherever a start reaches it; within a group every
overlapping A-B pair is a link. Pairs of ids are counted over the corpus by documents, and a link is best if no other
partner of its A id is linked in more documents.

Both tokenizers begin a token at every space before a non-space, so a text is aligned by its space-separated units, each
distinct one once (``Aligner``); a text with other white space around spaces is one unit. Tasks work in blocks: a block
lists its distinct id pairs with their document counts and, per document, its units. Only these pairs are shuffled, added up and
answered to their blocks; texts and links never are.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import worker_state, written

BLOCK_CHARS = 6_000_000    # characters of the documents of a block (a longer document is a block of its own)
TASK_BLOCKS = 4            # blocks that one task answers, about
UNITS = 220_000            # units a worker remembers; a block ends where they are forgotten
UNIT_CHARS = 64            # longer units are forgotten with their document slice
SLICE_CHARS = 1_000_000    # characters encoded at a time
JOINED = 50                # units that are encoded in one string
_SPACE = "▁"          # the second tokenizer's mark of a space
_NOT_SPLIT = re.compile("(?:^| )(?:[\\s\u180e]|$)")  # a piece between spaces that is empty or begins with white space


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the other
    bytes, in order, for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers of a worker, and their tokens' bytes."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        byte = byte_alphabet()
        size = max(self.a.get_vocab().values()) + 1
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        #: A unit's tokens don't depend on its neighbours if no piece goes on past a word into a space.
        self.splits = not any(_SPACE in p.lstrip(_SPACE) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        #: Texts of the ids with what follows them in a group list: A id and comma, A id and bar, B id and comma, B id and semicolon, B id.
        self.texts = np.array([f"{i}{after}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), (",", ";", ""))) for after in ends for i in range(n)],
                              dtype=object)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids of a space and each unit, one unit after the other, and their number by unit; then B's. None where the joined bytes differ
        from the space and the unit. Units are encoded ``JOINED`` at a time, a space between them, as they stand in a text."""
        groups: list[list[str]] = []
        room = 0
        for u in units:
            if not room or _NOT_SPLIT.search(u) or not self.splits:
                groups.append([u])
                room = 0 if _NOT_SPLIT.search(u) or not self.splits else JOINED - 1
            else:
                groups[-1].append(u)
                room -= 1
        texts = [" ".join(g) for g in groups]
        whole = b"".join([(" " + t).encode() for t in texts])
        ends = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units)))
        out = []
        for ids, tokens, size in ((flattened([e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]), self.a_bytes, self.a_size),
                                  (flattened(self.b.encode(texts, num_threads=1)), self.b_bytes, self.b_size)):
            at = np.cumsum(size[ids])
            last = np.searchsorted(at, ends)
            if not len(at) or at[-1] != ends[-1] or (at[last] != ends).any() or b"".join(map(tokens.__getitem__, ids.tolist())) != whole:
                if len(units) > 1:  # some unit is at fault: look for it in halves
                    return tuple(np.concatenate(x) for x in zip(self.encode(units[:len(units) // 2]), self.encode(units[len(units) // 2:])))
                none = np.zeros(0, np.int64)
                return none, np.zeros(1, np.int64), none, np.zeros(1, np.int64)
            out += [ids, np.diff(last + 1, prepend=0)]
        return tuple(out)


def flattened(rows: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(rows), np.int64, sum(map(len, rows)))


def coalesce(a_start, a_end, b_start, b_end):
    """(group of each A token, group of each B token, first and past-the-last overlapping B token of each A token), for tokens given
    by byte offsets in ascending order that cut the same bytes."""
    start = np.concatenate([a_start, b_start])
    end = np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    lo = np.searchsorted(b_end, a_start, side="right")
    hi = np.searchsorted(b_start, a_end, side="left")
    return group[:len(a_start)], group[len(a_start):], lo, hi


class Aligner:
    """Aligns units and remembers them: token, group and link counts, groups in text form, and linked id pairs."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.long: list[str] = []
        self.groups: list[str] = []
        self.counts = np.zeros((1024, 4), np.int64)       # n_a, n_b, n_groups, n_links
        self.sizes: list[np.ndarray] = []                 # by slice of units: distinct pairs of each unit,
        self.pairs: list[np.ndarray] = []                 # these pairs (a << 32 | b), one unit after the other,
        self.times: list[np.ndarray] = []                 # and how often each is linked

    def learn(self, units: list[str]) -> None:
        """Aligns new units, in slices."""
        at = 0
        while at < len(units):
            end, size = at, 0
            while end < len(units) and size < SLICE_CHARS:
                size += len(units[end]) + 1
                end += 1
            self._learn(units[at:end])
            at = end

    def _learn(self, units: list[str]) -> None:
        a, n_a, b, n_b = self.t.encode(units)
        a_end, b_end = np.cumsum(self.t.a_size[a]), np.cumsum(self.t.b_size[b])
        a_group, b_group, lo, hi = coalesce(a_end - self.t.a_size[a], a_end, b_end - self.t.b_size[b], b_end)
        links = hi - lo
        # Links, expanded: A token and B token of each.
        left = np.repeat(np.arange(len(a)), links)
        right = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links) + np.repeat(lo, links)
        unit = np.repeat(np.arange(len(units)), n_a)
        code = a[left] << 32 | b[right]
        order = np.lexsort((code, unit[left]))
        owner, code = unit[left][order], code[order]
        new = np.ones(len(code), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
        first = np.flatnonzero(new)
        base = len(self.groups)
        while base + len(units) > len(self.counts):
            self.counts = np.vstack([self.counts, np.zeros_like(self.counts)])
        block = self.counts[base:base + len(units)]
        block[:, 0], block[:, 1] = n_a, n_b
        block[:, 3] = np.bincount(unit, weights=links, minlength=len(units)).astype(np.int64)
        first_of = np.ones(len(a), bool)
        first_of[1:] = a_group[1:] != a_group[:-1]
        block[:, 2] = np.bincount(unit[first_of], minlength=len(units))
        self.sizes.append(np.bincount(owner[first], minlength=len(units)))
        self.pairs.append(code[first])
        self.times.append(np.diff(np.append(first, len(code))))
        self.groups += self._texts(a, b, n_a, n_b, a_group, b_group)
        self.index.update(zip(units, range(base, base + len(units))))
        self.long += [u for u in units if len(u) > UNIT_CHARS]

    def _texts(self, a, b, n_a, n_b, a_group, b_group) -> list[str]:
        """``a1,a2|b1;a3|b2`` of every unit."""
        side = np.repeat([0, 1], [len(a), len(b)])
        group = np.concatenate([a_group, b_group])
        order = np.lexsort((side, group))
        side, group = side[order], group[order]
        ends = np.ones(len(order), bool)  # the last token of its side in its group
        ends[:-1] = (side[1:] != side[:-1]) | (group[1:] != group[:-1])
        edges = np.concatenate([[0], np.cumsum(n_a + n_b)])
        after = ends.astype(np.int64)
        last = edges[1:][n_a > 0] - 1
        after[last] = 2  # a unit's last token: nothing
        sizes = np.array([len(self.t.a_bytes), len(self.t.b_bytes)])
        place = np.concatenate([a, b])[order] + after * sizes[side] + side * 2 * sizes[0]
        parts = self.t.texts[place].tolist()
        edges = edges.tolist()
        return ["".join(parts[s:e]) for s, e in zip(edges, edges[1:])]

    def units_of(self, text: str | None) -> list[str]:
        """The units of a text: its space-separated pieces, or all of it if one of them is empty or begins with white space."""
        if not text:
            return []
        return text.split(" ") if self.t.splits and not _NOT_SPLIT.search(text) else [text]

    def documents(self, texts: list[str | None]) -> list[np.ndarray]:
        """Unit indexes of each text (in order); none for a text without tokens."""
        units = [self.units_of(t) for t in texts]
        self.learn(list({u for us in units for u in us if u not in self.index}))
        out = []
        for text, us in zip(texts, units):
            found = np.fromiter(map(self.index.__getitem__, us), np.int64, len(us))
            if not self.counts[found, 0].all():
                # One unit's bytes differ: the text counts if its whole does not.
                if text not in self.index:
                    self.learn([text])
                found = np.array([self.index[text]])
                found = found[self.counts[found, 0] > 0]
            out.append(found)
        return out

    def forget_long(self) -> None:
        """Drops the texts of long units (their alignment stays until ``forget``)."""
        for u in self.long:
            del self.index[u]
        self.long = []


def _load(a_path: str, b_path: str) -> Tokenizers:
    return worker_state(("alignment", a_path, b_path), lambda: Tokenizers(a_path, b_path))


# ---------------------------------------------------------------------------------------------------------------------
# Blocks: what a task keeps of its documents

_BLOCK = ("block long, doc_ids array<bigint>, counts binary, digests array<string>, doc_sizes binary, doc_units binary, doc_times binary, "
          "unit_sizes binary, unit_pairs binary, unit_times binary, pairs binary, pair_docs binary")
_FIELDS = [f.split(" ")[0] for f in _BLOCK.split(", ")]
_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("digests", pa.list_(pa.string())),
                          *((f, pa.binary()) for f in _FIELDS[4:])])


def _packed(x: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width that holds them all, which the first byte tells."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


class _Block:
    """Documents of a block, as they come."""

    def __init__(self, aligner: Aligner, keep_groups: bool):
        self.aligner, self.keep_groups = aligner, keep_groups
        self.doc_ids, self.digests, self.units, self.times, self.sums, self.chars = [], [], [], [], [], 0

    def add(self, doc_ids: list, texts: list[str | None]) -> None:
        a = self.aligner
        for i, text, found in zip(doc_ids, texts, a.documents(texts)):
            groups = ";".join(map(a.groups.__getitem__, found.tolist()))
            unit, times = np.unique(found, return_counts=True)
            self.doc_ids.append(i)
            self.digests.append(groups if self.keep_groups else hashlib.sha256(groups.encode()).hexdigest() if len(found) else "")
            self.units.append(unit.astype(np.uint32))
            self.times.append(times.astype(np.uint32))
            self.sums.append(times @ a.counts[unit])
            self.chars += len(text or "")

    def row(self, block: int) -> pa.RecordBatch:
        a = self.aligner
        sizes = np.array([len(u) for u in self.units], np.int64)
        flat = np.concatenate(self.units) if self.units else np.empty(0, np.uint32)
        used, place = np.unique(flat, return_inverse=True)
        nothing = [np.empty(0, np.int64)]
        known = np.concatenate(a.sizes or nothing)
        keep = np.zeros(len(known), bool)
        keep[used] = True
        unit_sizes, keep = known[used], np.repeat(keep, known)
        codes, unit_times = (np.concatenate(x or nothing)[keep] for x in (a.pairs, a.times))
        pairs, unit_pairs = np.unique(codes, return_inverse=True)
        starts = np.cumsum(unit_sizes) - unit_sizes
        docs = np.zeros(len(pairs), np.int64)  # documents of the block that hold each pair
        at = 0
        for n in sizes.tolist():
            u = place[at:at + n]
            at += n
            if n:
                k = unit_sizes[u]
                linked = unit_pairs[np.repeat(starts[u] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))]
                docs[np.unique(linked)] += 1
        row = {"block": block, "doc_ids": self.doc_ids, "counts": np.array(self.sums, np.int64).reshape(-1, 4).tobytes(), "digests": self.digests,
               "doc_sizes": _packed(sizes), "doc_units": _packed(place), "doc_times": _packed(np.concatenate(self.times or nothing)),
               "unit_sizes": _packed(unit_sizes), "unit_pairs": _packed(unit_pairs), "unit_times": _packed(unit_times),
               "pairs": pairs.tobytes(), "pair_docs": docs.tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)


def _blocks(a_path: str, b_path: str, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_load(a_path, b_path))
        number, block = TaskContext.get().partitionId() << 40, _Block(aligner, keep_groups)
        for b in batches:
            ids, column, at = b.column("doc_id").to_pylist(), b.column("text"), 0
            while at < b.num_rows:
                texts, size, begin = [], 0, at
                while at < b.num_rows and size < SLICE_CHARS:
                    texts.append(column[at].as_py())
                    size += len(texts[-1] or "")
                    at += 1
                block.add(ids[begin:at], texts)
                aligner.forget_long()
                if block.chars >= BLOCK_CHARS or len(aligner.groups) > UNITS:
                    yield block.row(number)
                    number += 1
                    if len(aligner.groups) > UNITS:
                        aligner.forget()
                    block = _Block(aligner, keep_groups)
        if block.doc_ids:
            yield block.row(number)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(whole.num_rows):
            code = np.frombuffer(whole.column("pairs")[i].as_py(), np.int64)
            docs = np.frombuffer(whole.column("pair_docs")[i].as_py(), np.int64)
            block = np.full(len(code), whole.column("block")[i].as_py(), np.int64)
            for lo in range(0, len(code), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(block[part]), pa.array(np.arange(len(code), dtype=np.int32)[part]),
                                                  pa.array((code[part] >> 32).astype(np.int32)), pa.array((code[part] & 0xFFFFFFFF).astype(np.int32)),
                                                  pa.array(docs[part])], names=["block", "place", "a", "b", "docs"])


_RESULT_ARROW = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups", pa.string())])


def _answered(block: pa.Table, answers: pa.Table) -> pa.Table:
    """Per document of one block, its counts with the corpus-wide ones of its links."""
    row = {f: block.column(f)[0].as_py() for f in _FIELDS if f not in ("pairs", "pair_docs")}
    n = answers.num_rows
    total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = answers.column("place").to_numpy()
    total[at], best[at] = answers.column("total").to_numpy(), answers.column("best").to_numpy()
    pair, times = (_unpacked(row[k]) for k in ("unit_pairs", "unit_times"))

    def sums(values, sizes):
        edge = np.concatenate([[0], np.cumsum(values)])
        end = np.cumsum(sizes)
        return edge[end] - edge[end - sizes]

    unit_sizes, doc_sizes, units, doc_times = (_unpacked(row[k]) for k in ("unit_sizes", "doc_sizes", "doc_units", "doc_times"))
    unit_total, unit_best = (sums(x[pair] * times, unit_sizes) for x in (total, best))
    counts = np.frombuffer(row["counts"], np.int64).reshape(-1, 4)
    return pa.table([pa.array(row["doc_ids"], pa.int64()), *(pa.array(counts[:, k]) for k in range(4)),
                     pa.array(sums(unit_best[units] * doc_times, doc_sizes)), pa.array(sums(unit_total[units] * doc_times, doc_sizes)),
                     pa.array(row["digests"], pa.string())], schema=_RESULT_ARROW)


def blocks(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """The written blocks of ``docs(doc_id, text)``."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(src.mapInArrow(_blocks(a_path, b_path, keep_groups), _BLOCK), "alignment")


def pair_counts(parts: DataFrame) -> DataFrame:
    """For every linked id pair of ``blocks``: a, b, total (documents that hold it linked), best (no pair of this a has more)."""
    rows = parts.select("block", "pairs", "pair_docs").mapInArrow(_pairs, "block long, place int, a int, b int, docs long")
    total = written(rows.groupBy("a", "b").agg(F.sum("docs").alias("total")), "pairs")
    most = total.groupBy("a").agg(F.max("total").alias("most"))
    return total.join(most, "a").select("a", "b", "total", (F.col("total") == F.col("most")).cast("int").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """Alignment of each of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (their sha256 unless
    ``keep_groups``).

    Defined cases: a text that is null, empty, or whose tokens' bytes are not a space and the text has no tokens (zeros, groups '');
    special tokens' strings are plain text; each row is a document (null and repeated doc_ids too); ties for the highest count are
    all best; texts of any length are taken whole (a long one is a block of its own); an empty table gives an empty result; other
    columns are ignored. The tokenizer files must be readable on every executor."""
    parts = blocks(docs, a_path, b_path, keep_groups)
    rows = parts.select("block", "pairs", "pair_docs").mapInArrow(_pairs, "block long, place int, a int, b int, docs long")
    answers = rows.drop("docs").join(pair_counts(parts), ["a", "b"]).select("block", "place", "total", "best")
    tasks = max(1, -(-parts.count() // TASK_BLOCKS))  # grows with the corpus, so a task's share doesn't
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return (parts.drop("pairs", "pair_docs").repartition(tasks, "block").groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block"))
            .applyInArrow(_answered, schema))
