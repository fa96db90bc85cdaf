"""Conversation structure repair by a Hirschberg divide-and-conquer over a four-state cost vector.

A repaired conversation's role initials match ``(s?(ua)+)?``. The states are: nothing kept yet, after the system row, after a
user row, after an assistant row (the first and the last accept). Every row is kept (0), re-roled to what the state expects (1)
or deleted (2); an empty row may be inserted before any row or at the end (5); a truncated row that stays adds 5; blank and
duplicate rows must go. ``solve`` computes forward and backward cost vectors that meet in the middle of a run of rows, chooses the
cheapest crossing state (the one with the ASCII-least edits on a tie) and recurses, so it keeps four costs a side, not
a table.

Conversations of any length are spread: rows are sorted by range into chunks of at most ``CHUNK_ROWS`` rows; a chunk is a step of
the same kind as a row (its 4 x 4 least costs and the order of its least edits), so the same divide-and-conquer over
a conversation's chunks fixes the states between them, and each chunk is rebuilt on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import written

CHUNK_ROWS = 512            # rows of a conversation that one step holds
CHUNK_CHARS = 4_000_000     # or characters; a longer text is a chunk of its own
PREFIX = 200                # characters of a text that order rows of the same turn and role, before its hash
DELETE, INSERT, TRUNCATED, REROLE = 2, 5, 5, 1

START, SYSTEM, USER, ASSISTANT = range(4)
_EXPECTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAME = {USER: "user", ASSISTANT: "assistant"}
_FREE, _TRUNCATED, _MUST_GO = "", "t", "x"   # what a row's fault means for its edits
_ASCII_SPACE = " \t\n\v\f\r"


def _row_edges(initial: str, fault: str) -> list[list[tuple[int, int, str]]]:
    """For each state, what one row allows: (cost, next state, edits). Inserts come before the row's own edit; two of them
    reach every state that inserts can reach."""
    out: list[list[tuple[int, int, str]]] = []
    for state in range(4):
        edges, cost, at, edits = [], 0, state, ""
        for inserted in range(3):
            edges.append((cost + DELETE, at, edits + "D"))
            if fault != _MUST_GO:
                stay = cost + (TRUNCATED if fault == _TRUNCATED else 0)
                kept = SYSTEM if initial == "s" and at == START else _EXPECTED[at] if initial and initial == _NAME[_EXPECTED[at]][0] else None
                if kept is not None:
                    edges.append((stay, kept, edits + "K"))
                edges.append((stay + REROLE, _EXPECTED[at], edits + "R"))
            cost, at, edits = cost + INSERT, _EXPECTED[at], edits + "I"
        out.append(edges)
    return out


_EDGES = {(i, f): _row_edges(i, f) for i in ("s", "u", "a", "") for f in (_FREE, _TRUNCATED, _MUST_GO)}

#: Edits that end a conversation from each state: (cost, edits).
_CLOSE = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def row_step(initial: str, fault: str) -> list[list[tuple]]:
    """The step of one row: by start state, (cost, end state, order), ``order`` ranking the edits of that start state."""
    return _EDGES[initial if initial in ("s", "u", "a") else "", fault]


def forward(steps: list, lo: int, hi: int, state: int) -> dict[int, tuple[int, int]]:
    """State -> (least cost, rank of its ASCII-least cheapest edits among the states') after steps lo..hi-1.

    The edits that lead to different states differ, and none is a prefix of another (each ends with the same row's
    edit), so their order after one more step follows from the order before it and the step's own."""
    vector = {state: (0, 0)}
    for i in range(lo, hi):
        best: dict[int, tuple] = {}
        for s, (cost, rank) in vector.items():
            for c, to, order in steps[i][s]:
                found = (cost + c, rank, order)
                if to not in best or found < best[to]:
                    best[to] = found
        by_edits = sorted(best, key=lambda s: best[s][1:])
        vector = {s: (best[s][0], r) for r, s in enumerate(by_edits)}
    return vector


def backward(steps: list, lo: int, hi: int, ends: dict[int, int]) -> dict[int, int]:
    """State before step lo -> least cost to reach an end state (with the cost given for it) after step hi - 1."""
    vector = dict(ends)
    for i in range(hi - 1, lo - 1, -1):
        vector = {s: min(costs) for s in range(4) if (costs := [c + vector[to] for c, to, _ in steps[i][s] if to in vector])}
    return vector


def solve(steps: list, lo: int, hi: int, state: int, ends: dict[int, int], out: list[int]) -> int:
    """Appends the state after each of the steps lo..hi-1 on the cheapest, then ASCII-least, way; returns the last."""
    if hi - lo == 0:
        return state
    mid = (lo + hi) // 2 if hi - lo > 1 else hi
    before, after = forward(steps, lo, mid, state), backward(steps, mid, hi, ends)
    crossing = min((c + after[s], rank, s) for s, (c, rank) in before.items() if s in after)[2]
    if hi - lo == 1:
        out.append(crossing)
        return crossing
    solve(steps, lo, mid, state, {crossing: 0}, out)
    return solve(steps, mid, hi, crossing, ends, out)


_END_COSTS = {s: c for s, (c, _) in _CLOSE.items()}


def rebuild(rows: list[tuple[str, str, str]], state: int, end: int | None) -> tuple[str, list[str], int]:
    """(edits, repaired ``role:text`` lines, cost) of ``rows`` (role, text, fault) from ``state`` to ``end`` (None: the end of
    the conversation, whose closing inserts are added)."""
    steps = [row_step(role[:1], fault) for role, _, fault in rows]
    path: list[int] = []
    last = solve(steps, 0, len(steps), state, _END_COSTS if end is None else {end: 0}, path)
    audit, lines, total, at = [], [], 0, state

    def insert(n: int):
        nonlocal at
        for _ in range(n):
            at = _EXPECTED[at]
            lines.append(_NAME[at] + ":")

    for (role, text, _), edges, to in zip(rows, steps, path):
        cost, _, edits = min((e for e in edges[at] if e[1] == to), key=lambda e: (e[0], e[2]))
        insert(len(edits) - 1)
        if edits[-1] == "K":
            lines.append(f"{role}:{text}")
        elif edits[-1] == "R":
            lines.append(f"{_NAME[_EXPECTED[at]]}:{text}")
        audit.append(edits)
        total, at = total + cost, to
    if end is None:
        cost, edits = _CLOSE[last]
        insert(len(edits))
        audit.append(edits)
        total += cost
    return "".join(audit), lines, total


def _truncated(text: str) -> bool:
    return text.rstrip(_ASCII_SPACE)[-1:] not in (".", "!", "?")


def _blank(text: str) -> bool:
    return not text.strip(_ASCII_SPACE)


def _key(role: str, text: str) -> bytes:
    r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(len(r).to_bytes(4, "little") + r + t, digest_size=16).digest()


# ---------------------------------------------------------------------------------------------------------------------
# Chunks

_CHUNK = ("chunk long, conv string, conv_id long, roles array<string>, texts array<string>, keys array<binary>, "
          "first_turn long, last_turn long, turns long")
_CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("conv", pa.string()), ("conv_id", pa.int64()), ("roles", pa.list_(pa.string())),
                          ("texts", pa.list_(pa.string())), ("keys", pa.list_(pa.binary())), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
                          ("turns", pa.int64())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sorted rows into chunks of one conversation each; every conversation has one, if only an empty one."""
    base, seq = TaskContext.get().partitionId() << 40, 0
    conv, rows, size, ready = None, [], 0, []

    def close():
        nonlocal rows, size, seq
        stay = [r for r in rows if r["times"]]
        turns = [r["turn"] for r in stay if r["turn"] is not None]
        roles = [r["role"] for r in stay for _ in range(r["times"])]
        texts = [r["text"] for r in stay for _ in range(r["times"])]
        ready.append({"chunk": base + seq, "conv": rows[0]["conv"], "conv_id": rows[0]["conv_id"], "roles": roles, "texts": texts,
                      "keys": list({_key(*x) for x in zip(roles, texts)}), "first_turn": turns[0] if turns else None,
                      "last_turn": turns[-1] if turns else None, "turns": len(set(turns))})
        rows, size, seq = [], 0, seq + 1

    def flush():
        batch = pa.RecordBatch.from_pylist(ready, schema=_CHUNK_ARROW)
        ready.clear()
        return batch

    held = 0
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            for row in whole.slice(at, 1000).to_pylist():
                if rows and (row["conv"] != conv or len(rows) >= CHUNK_ROWS or size >= CHUNK_CHARS):
                    close()
                    held += 1
                conv = row["conv"]
                rows.append(row)
                size += len(row["text"])
            if held >= 1000 or sum(len(t) for r in ready for t in r["texts"]) > CHUNK_CHARS:
                yield flush()
                held = 0
    if rows:
        close()
    if ready:
        yield flush()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` after damage by crc32(`conv_id:turn`) % 20 (nulls: one space): 0 drops a row,
    1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it, 4 makes it a user's. Columns conv (the text of conv_id),
    conv_id, turn, role, text, times (0: dropped, 2: repeated)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    kind = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = rows.withColumn("kind", kind)
    return rows.select("conv", "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                       .otherwise(F.col("text")).alias("text"),
                       F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` as they are, in the form ``repair`` takes."""
    return conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("conv"),
                                F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(1).alias("times"))


# ---------------------------------------------------------------------------------------------------------------------
# A chunk as one step

_PROFILE = ("chunk long, conv string, conv_id long, n long, first string, last string, faults string, blank long, duplicate long, "
            "truncated long, illegal long, first_turn long, last_turn long, turns long, step array<array<long>>")


def _legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def _faults(roles: list[str], texts: list[str], seen: set[bytes]) -> str:
    """One letter a row: b(lank), d(uplicate), t(runcated) or a dot, the first that holds."""
    out = []
    for role, text in zip(roles, texts):
        key = _key(role, text)
        out.append("b" if _blank(text) else "d" if key in seen else "t" if _truncated(text) else ".")
        seen.add(key)
    return "".join(out)


_FAULT = {"b": _MUST_GO, "d": _MUST_GO, "t": _TRUNCATED, ".": _FREE}


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            out = []
            for r in whole.slice(at, 200).to_pylist():
                faults = _faults(r["roles"], r["texts"], set(r["seen"] or ()))
                initials = [x[:1] for x in r["roles"]]
                steps = [row_step(i, _FAULT[f]) for i, f in zip(initials, faults)]
                step = []
                if steps:
                    for s in range(4):
                        for to, (cost, rank) in forward(steps, 0, len(steps), s).items():
                            step.append([s, cost, to, rank])
                out.append({"chunk": r["chunk"], "conv": r["conv"], "conv_id": r["conv_id"], "n": len(steps), "first": initials[0] if steps else "",
                            "last": initials[-1] if steps else "", "faults": faults, "blank": faults.count("b"), "duplicate": faults.count("d"),
                            "truncated": faults.count("t"), "illegal": sum(not _legal(a + b) for a, b in zip(initials, initials[1:])),
                            "first_turn": r["first_turn"], "last_turn": r["last_turn"], "turns": r["turns"], "step": step})
            yield pa.RecordBatch.from_pylist(out, schema=_PROFILE_ARROW)


_PROFILE_ARROW = pa.schema([("chunk", pa.int64()), ("conv", pa.string()), ("conv_id", pa.int64()), ("n", pa.int64()), ("first", pa.string()),
                            ("last", pa.string()), ("faults", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                            ("illegal", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()),
                            ("step", pa.list_(pa.list_(pa.int64())))])

_CROSSING = ("chunk long, conv string, conv_id long, last_chunk boolean, start int, stop int, faults string, gaps long, blank long, duplicate long, "
             "truncated long, illegal long, cost long")
_CROSSING_ARROW = pa.schema([("chunk", pa.int64()), ("conv", pa.string()), ("conv_id", pa.int64()), ("last_chunk", pa.bool_()), ("start", pa.int32()),
                             ("stop", pa.int32()), ("faults", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                             ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64())])


def _cross(chunks: list[dict]) -> list[dict]:
    """The states between a conversation's chunks, and its counts (on the last chunk)."""
    steps = []
    for c in chunks:
        by: list[list] = [[] for _ in range(4)]
        for s, cost, to, rank in c["step"]:
            by[s].append((cost, to, rank))
        steps.append(by if c["step"] else [[(0, s, 0)] for s in range(4)])
    path: list[int] = []
    solve(steps, 0, len(steps), START, _END_COSTS, path)
    states = [START, *path]
    cost = backward(steps, 0, len(steps), _END_COSTS)[START]
    illegal, turns, low, high, last, edge = 0, 0, None, None, None, None
    for c in chunks:
        illegal += c["illegal"]
        if c["n"]:
            illegal += last is not None and not _legal(last + c["first"])
            last = c["last"]
        if c["turns"]:
            turns += c["turns"] - (edge is not None and edge == c["first_turn"])
            low, high, edge = c["first_turn"] if low is None else low, c["last_turn"], c["last_turn"]
    total = {"gaps": 0 if low is None else high - low + 1 - turns, "illegal": illegal, "cost": cost,
             **{k: sum(c[k] for c in chunks) for k in ("blank", "duplicate", "truncated")}}
    return [{"chunk": c["chunk"], "conv": c["conv"], "conv_id": c["conv_id"], "last_chunk": i == len(chunks) - 1, "start": states[i], "stop": states[i + 1],
             "faults": c["faults"], **total} for i, c in enumerate(chunks)]


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group: list[dict] = []
    for whole in batches:
        out = []
        for r in whole.to_pylist():
            if group and r["conv"] != group[-1]["conv"]:
                out += _cross(group)
                group = []
            group.append(r)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_CROSSING_ARROW)
    if group:
        yield pa.RecordBatch.from_pylist(_cross(group), schema=_CROSSING_ARROW)


# ---------------------------------------------------------------------------------------------------------------------
# Repaired pieces

_PIECE = ("chunk long, conv string, conv_id long, last_chunk boolean, audit string, repaired array<string>, gaps long, blank long, duplicate long, "
          "truncated long, illegal long, cost long")
_PIECE_ARROW = pa.schema([*( _CROSSING_ARROW.field(n) for n in ("chunk", "conv", "conv_id", "last_chunk")), ("audit", pa.string()),
                          ("repaired", pa.list_(pa.string())), *(_CROSSING_ARROW.field(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            out = []
            for r in whole.slice(at, 200).to_pylist():
                rows = [(role, text, _FAULT[f]) for role, text, f in zip(r["roles"], r["texts"], r["faults"])]
                audit, lines, _ = rebuild(rows, r["start"], None if r["last_chunk"] else r["stop"])
                out.append({**{k: r[k] for k in ("chunk", "conv", "conv_id", "last_chunk", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")},
                            "audit": audit, "repaired": lines})
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE_ARROW)


def repair(rows: DataFrame) -> DataFrame:
    """Repairs the conversations of ``rows`` (conv, conv_id, turn, role, text, times: see ``damaged`` and ``undamaged``).

    One row per chunk of a conversation, chunks being in order by ``chunk``: conv, conv_id, last_chunk, audit (edits' initials), repaired
    (``role:text`` lines), and the conversation's gaps, blank, duplicate, truncated, illegal and cost.

    A conversation's rows come by turn (null first), rows of one turn by role, text (its first 200 characters, then its hash).
    Only whole conversations' chunk profiles (one small row for up to 512 rows) meet in one task; texts are read chunk by
    chunk. Defined cases: a null role or text is one space; an empty role has no initial and cannot be kept; a null conv_id is a
    conversation of its own; rows equal in every column are repetitions, hence duplicates; a conversation without rows has
    one empty chunk; an empty table gives an empty result; other columns are ignored; texts of any length are taken whole."""
    # Rows that agree in everything are interchangeable: their place in the input only spreads them over tasks.
    keys = ["conv", "turn", "role", "prefix", "hash", "place"]
    spread = (rows.withColumn("prefix", F.substring("text", 1, PREFIX)).withColumn("hash", F.xxhash64("text"))
              .withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys))
    chunks = written(spread.select("conv", "conv_id", "turn", "role", "text", "times").mapInArrow(_chunks, _CHUNK), "chunks")
    # Rows seen in an earlier chunk: distinct (role, text) per chunk, so a text that fills a conversation is one row a chunk.
    keyed = chunks.select("chunk", "conv", F.explode("keys").alias("key"))
    first = keyed.groupBy("conv", "key").agg(F.min("chunk").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = keyed.join(first.select("conv", "key", "first"), ["conv", "key"]).where("chunk > first")
    seen = again.groupBy("chunk").agg(F.collect_list("key").alias("seen"))
    profiles = chunks.drop("keys").join(seen, "chunk", "left").mapInArrow(_profiles, _PROFILE)
    crossings = written(profiles.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_crossings, _CROSSING), "crossings")
    return chunks.select("chunk", "roles", "texts").join(crossings, "chunk").mapInArrow(_pieces, _PIECE)


_DIGEST = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s result: its counts, the whole audit and the sha256 of the newline-joined
    repaired lines. Chunks stream through a task in order, a hash state and the audit (a letter per row) being all that is held of
    a conversation, however long; a sha256 has to be taken in sequence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, digest, lines = [], hashlib.sha256(), 0
        for whole in batches:
            out: dict[str, list] = {"conv_id": [], **{c: [] for c in _COUNTS}, "audit": [], "repaired_sha256": []}
            for at in range(0, whole.num_rows, 200):
                for r in whole.slice(at, 200).to_pylist():
                    audit.append(r["audit"])
                    for line in r["repaired"]:
                        digest.update((b"\n" if lines else b"") + line.encode("utf-8", "surrogatepass"))
                        lines += 1
                    if r["last_chunk"]:
                        out["conv_id"].append(r["conv_id"])
                        for c in _COUNTS:
                            out[c].append(r[c])
                        out["audit"].append("".join(audit))
                        out["repaired_sha256"].append(digest.hexdigest())
                        audit, digest, lines = [], hashlib.sha256(), 0
            if out["conv_id"]:
                yield pa.RecordBatch.from_arrays([pa.array(out["conv_id"], pa.int64()), *(pa.array(out[c], pa.int64()) for c in _COUNTS),
                                                  pa.array(out["audit"], pa.string()), pa.array(out["repaired_sha256"], pa.string())],
                                                 names=list(out))

    return repaired.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(run, _DIGEST)
