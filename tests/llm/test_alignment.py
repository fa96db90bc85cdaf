"""Cross-tokenizer alignment against token-by-token brute force."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from routelake.llm import alignment
from routelake.llm.queries import BPE_JSON, PIECES

TEXTS = ["Hello world, hello again", "naïve café ½ ²", "", None, "a  b", "a\n b\n", " lead", "trail ", "▁ x", "日本語 テスト 🙂 é́", "x <|endoftext|> y", "<s> </s> <0x41>",
         "Hello world, hello again", "x\x00y", "word " * 300, "unbroken" * 900, "d́ ́e", "the cat the cat\tthe"]


def spans(sizes):
    out, at = [], 0
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


@pytest.fixture(scope="module")
def coder():
    a = Tokenizer.from_file(BPE_JSON)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    byte, extra = {chr(c): c for c in shown}, 256
    for c in range(256):
        if c not in shown:
            byte[chr(extra)] = c
            extra += 1

    def tokens(text):
        if not text:
            return [], []
        raw = (" " + text).encode()
        x = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return (x, y) if b"".join(t for _, t in x) == raw == b"".join(t for _, t in y) else ([], [])

    return tokens


def brute(texts, tokens):
    docs, held = [], Counter()
    for t in texts:
        x, y = tokens(t)
        xs, ys = spans([len(s) for _, s in x]), spans([len(s) for _, s in y])
        links = [(i, j) for (i, _), (s, e) in zip(x, xs) for (j, _), (u, v) in zip(y, ys) if s < v and u < e]
        held.update(set(links))
        groups, at = [], 0
        for cut in sorted({e for _, e in xs} & {e for _, e in ys}):
            groups.append("|".join(",".join(str(i) for (i, _), (s, e) in zip(k, ks) if s >= at and e <= cut) for k, ks in ((x, xs), (y, ys))))
            at = cut
        docs.append((len(x), len(y), len(groups), links, ";".join(groups)))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    return [(na, nb, ng, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if na else "") for na, nb, ng, links, g in docs]


def rows(df):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in df.collect()}


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, coder, small):
    """Also with blocks of a few documents and a worker that keeps forgetting."""
    if small:
        monkeypatch.setattr(alignment, "BLOCK_CHARS", 40)
        monkeypatch.setattr(alignment, "SLICE_CHARS", 20)
        monkeypatch.setattr(alignment, "UNITS", 5)
    docs = (spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("block", F.lit(0)).withColumn("groups", F.lit("")).repartition(3))
    assert [rows(alignment.align(docs, BPE_JSON, PIECES))[i] for i in range(len(TEXTS))] == brute(TEXTS, coder)


def test_documents_of_the_test_data(spark, coder, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 1500)
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    found = rows(alignment.align(docs, BPE_JSON, PIECES))
    assert [found[i] for i, _ in texts] == brute([t for _, t in texts], coder)


def test_whole_groups_repeated_rows_and_empty_tables(spark, coder):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one"), (2, "three")], "doc_id long, text string")
    out = alignment.align(docs, BPE_JSON, PIECES, keep_groups=True).collect()
    assert len(out) == 4 and sorted(r["count_sum"] for r in out) == sorted(x[5] for x in brute(["one two", "one two", "one", "three"], coder))
    assert all(r["groups"].count(";") == r["n_groups"] - 1 and "|" in r["groups"] for r in out)
    assert alignment.align(docs.where("false"), BPE_JSON, PIECES).count() == 0


def test_groups_break_where_a_start_reaches_the_running_end():
    import numpy as np

    a, b, lo, hi = alignment.coalesce(np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 5]), np.array([3, 5, 6]))
    assert a.tolist() == [0, 0, 1] and b.tolist() == [0, 0, 1] and list(zip(lo.tolist(), hi.tolist())) == [(0, 1), (0, 2), (2, 3)]


def test_byte_alphabet_is_whole():
    assert sorted(alignment.byte_alphabet().values()) == list(range(256))
    assert public_tokenizers.path("byte_bpe_50k.json") == BPE_JSON
