"""Conversation repair against an exhaustive search over edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from routelake.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    """The damaged rows of each conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        group = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        group += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def search(rows):
    """(cost, audit, lines) of the best repair by trying every word over D, I, K, R with at most two inserts."""
    faults, seen = [], set()
    for _, role, text in rows:
        shown = re.search(r"[^\x20\x09-\x0D]", text)
        if not shown:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))
    best = None
    for edits in itertools.product("DKRr", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for e, f in zip(edits, faults)):
            continue
        for slots in [(), *itertools.combinations_with_replacement(range(len(rows) + 1), 1), *itertools.combinations_with_replacement(range(len(rows) + 1), 2)]:
            for names in itertools.product(("user", "assistant"), repeat=len(slots)):
                cost, audit, lines = 0, "", []
                for i in range(len(rows) + 1):
                    for s, n in zip(slots, names):
                        if s == i:
                            cost, audit, lines = cost + 5, audit + "I", [*lines, (n, "")]
                    if i < len(rows):
                        e, (_, role, text), f = edits[i], rows[i], faults[i]
                        audit += e.upper()
                        if e == "D":
                            cost += 2
                            continue
                        cost += 5 * (f == "truncated") + (e != "K")
                        lines.append((role if e == "K" else "user" if e == "R" else "assistant", text))
                if all(r for r, _ in lines) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, [f"{r}:{t}" for r, t in lines]
    return faults, best


def expected(rows):
    out = {}
    for conv, group in damage(rows).items():
        faults, (cost, audit, lines) = search(group)
        turns = [t for t, _, _ in group if t is not None]
        initials = [r[:1] for _, r, _ in group]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_rows(seed, conversations, longest):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(r.randrange(longest + 1)):
            rows.append((conv, r.choice([turn, turn, turn, None, turn + 1]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]),
                         r.choice(["Hi.", "Hi.", "So what?", "cut off", "", None, " \t", "Ends! \n", "é…"])))
    return rows


def got(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("chunk", [512, 2])
def test_against_exhaustive_search(spark, monkeypatch, chunk):
    """Also with chunks of two rows, so that conversations are put together from several."""
    monkeypatch.setattr(C, "CHUNK_ROWS", chunk)
    rows = some_rows(chunk, 60, 5)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("x")).withColumn("chunk", F.lit(1)).repartition(5)
    assert got(C.digests(C.repair(C.damaged(df)))) == expected(rows)


def test_crossings_meet_the_least_edits():
    """solve against a walk over all paths of longer random rows (costs, then edits)."""
    r = random.Random(5)
    for _ in range(200):
        rows = [(r.choice(["system", "user", "assistant", "x"]), f"t{i}", r.choice(["", "", "t", "x"])) for i in range(r.randrange(1, 12))]
        best = {C.START: (0, "")}
        for role, _, fault in rows:
            after = {}
            for s, (cost, edits) in best.items():
                for c, to, e in C.row_step(role[:1], fault)[s]:
                    after[to] = min(after.get(to, (1e9, "")), (cost + c, edits + e))
            best = after
        want = min((c + C._CLOSE[s][0], e + C._CLOSE[s][1]) for s, (c, e) in best.items())
        audit, lines, cost = C.rebuild(rows, C.START, None)
        assert (cost, audit) == want
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))


def test_a_conversation_of_many_chunks(spark, monkeypatch):
    """A third of all rows in one conversation, with texts repeated over its chunks."""
    monkeypatch.setattr(C, "CHUNK_ROWS", 16)
    rows = [(1, i, ["user", "assistant"][i % 2], f"text {i % 97}.") for i in range(800)] + [(c, i, ["user", "assistant"][i % 2], "a.") for c in range(2, 400) for i in range(4)]
    out = got(C.digests(C.repair(C.undamaged(spark.createDataFrame(rows, SCHEMA).repartition(7)))))
    faults = C._faults(*zip(*[(["user", "assistant"][i % 2], f"text {i % 97}.") for i in range(800)]), set())
    audit, lines, cost = C.rebuild([(x[2], x[3], C._FAULT[f]) for x, f in zip(rows, faults)], C.START, None)
    assert out[1] == (0, 0, faults.count("d"), 0, 0, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert faults.count("d") == 800 - 194 and out[2][6] == "KKDD"


def test_an_empty_table_and_an_emptied_conversation(spark):
    assert got(C.digests(C.repair(C.damaged(spark.createDataFrame([], SCHEMA))))) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    out = got(C.digests(C.repair(C.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)))))
    assert out == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_texts_are_chunks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_CHARS", 1000)
    rows = [(7, i, ["user", "assistant"][i % 2], "y" * 5000 + f"{i}.") for i in range(6)]
    out = got(C.digests(C.repair(C.undamaged(spark.createDataFrame(rows, SCHEMA)))))
    lines = "\n".join(f"{r}:{t}" for _, _, r, t in rows)
    assert out[7][5:] == (0, "KKKKKK", hashlib.sha256(lines.encode()).hexdigest())
