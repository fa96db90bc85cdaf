"""Licences, languages, token codes, BPE, decontamination, LM scores and counts on small texts and odd rows."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from routelake.llm import byte_bpe, decontaminate, language, license_scan, pitman_yor, queries, token_counts, token_store

ODD = [(None, "the quick brown fox"), (3, None), (4, ""), (5, " \n\t "), (6, "one  two   three \n four "), (6, "one  two   three \n four "), (7, "x" * 5000 + " " + "ab" * 2000),
       (8, "<|endoftext|> don't stop\x85 it's \x1c 1234 مرحبا \U0001f600"), (9, "a " * 3000), (1, "Ünïcode   text.\n\n  indented  ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "l", "s", 1, "q") for i, t in ODD], "doc_id long, text string, lang string, source string, n_tokens int, ids string").repartition(3)


@pytest.fixture(scope="module")
def tik():
    with open(queries.BPE_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_tiktoken(spark, odd, tik):
    got = collections.Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.encode_documents(odd, queries.BPE_RANKS, P.PATTERN).collect())
    want = collections.Counter()
    for i, t in ODD:
        ids = tik.encode_ordinary(t or "")
        want[i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()] += 1
    assert got == want


def test_rank_queue_on_random_bytes(tik):
    coder, rnd = byte_bpe.ByteBPE.load(queries.BPE_RANKS, P.PATTERN), random.Random(2)
    for _ in range(300):
        t = "".join(rnd.choice("aabtheing \n.0é") for _ in range(rnd.randint(0, 200)))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == tik.encode_ordinary(t)
    assert not coder.buckets and not any(coder.low) and not any(coder.mid)


def test_token_store_round_trip(spark, odd):
    files = token_store.write_tokens(odd, queries.BPE_JSON, end_id=2)
    got = token_store.read_tokens(files, lambda d, s, x: {"doc_id": d, "start": s, "ids": x.tolist()}, "doc_id long, start long, ids array<long>").collect()
    t = Tokenizer.from_file(queries.BPE_JSON)
    want = collections.Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x in ODD)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    assert token_store.read_tokens(token_store.write_tokens(odd.where("false"), queries.BPE_JSON, 2), lambda *a: {}, "doc_id long").collect() == []


def test_special_tokens_as_the_library_takes_them(spark):
    docs = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, "a<|endoftext|>b c"), (3, "x y")], "doc_id long, text string")

    def ids(**options):
        files = token_store.write_tokens(docs, queries.BPE_JSON, 2, **options)
        return {r.doc_id: r.ids for r in token_store.read_tokens(files, lambda d, s, x: {"doc_id": d, "ids": x.tolist()}, "doc_id long, ids array<long>").collect()}

    plain = ids()
    assert plain[1] == [87, 220, 50256, 331, 2] and 50256 in plain[2] and plain[3] == [87, 331, 2]
    assert all(50256 not in x for x in ids(special_as_text=True).values())


def test_any_token_is_addressable():
    rng = np.random.RandomState(0)
    for ids in (rng.randint(0, 50000, 1000), rng.randint(0, 200, 65), np.array([2]), np.array([0, 2**32 - 1, 255, 256, 65536] * 77), np.empty(0, int)):
        ids = ids.astype(np.uint32)
        store = token_store.Segment(*token_store.pack(ids))
        at = rng.permutation(len(ids))
        assert store.get(at).tolist() == ids[at].tolist()


def test_token_counts(spark, odd, tik):
    counts = token_counts.count_tokens(odd, queries.BPE_RANKS, P.PATTERN, "t").cache()
    assert sorted(r.n_tokens for r in counts.collect()) == sorted(len(tik.encode_ordinary(t or "")) for _, t in ODD)
    from routelake.session import scratch_path
    rollup = token_counts.Rollup(spark, scratch_path(spark, f"rollup-test-{random.getrandbits(60)}"))
    assert rollup.totals().collect() == []
    assert rollup.commit("a", token_counts.inserts(counts)) and not rollup.commit("a", token_counts.inserts(counts))
    one = counts.where("doc_id = 1")
    assert rollup.commit("b", token_counts.revisions(one, one.withColumn("n_tokens", F.lit(1000))))
    assert rollup.commit("c", token_counts.deletes(counts.where("doc_id = 7")))
    (r,) = rollup.totals().collect()
    n = {i: len(tik.encode_ordinary(t or "")) for i, t in ODD}
    total = sum(len(tik.encode_ordinary(t or "")) for _, t in ODD)
    assert (r.docs, r.tokens) == (len(ODD) - 1, total - n[1] + 1000 - n[7])


def test_maintained_rollup_equals_distinct_texts(spark, odd, tik):
    from routelake.session import scratch_path
    counts = token_counts.count_tokens(odd, queries.BPE_RANKS, P.PATTERN, "t").cache()
    (r,) = token_counts.maintain(counts, token_counts.Rollup(spark, scratch_path(spark, f"rollup-test-{random.getrandbits(60)}"))).collect()
    texts = {t or "" for _, t in ODD}
    assert (r.docs, r.tokens) == (len(texts), sum(len(tik.encode_ordinary(t)) + 1 for t in texts))


def test_licences_on_odd_rows(spark, odd):
    got = license_scan.scan(odd).collect()
    assert len(got) == len(ODD) and all(r.labels == "" and r.score == 0.0 and r.n_base == 0 and r.first_word is None for r in got)
    rows = [(1, "Under the MIT-license, under THE mit license; CC BY-NC."), (2, "This work is licensed under the GNU General Public License, version 2"),
            (3, "general public gnu license this work is licensed"), (4, "cc by by nc apache license version 2")]
    r = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (r[1].n_words, r[1].n_base, r[1].first_word, r[1].last_word, r[1].base_labels, r[1].score) == (11, 3, 0, 8, "cc-by-nc,mit", 1.0)
    assert r[2].labels == "gpl-3" and r[2].base_labels == "" and r[2].score == pytest.approx(11 / 12)
    assert r[3].labels == "" and r[4].labels == "apache-2"
    assert license_scan.scan(odd.where("false")).collect() == []


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "aba", "▁ab"]
    table = language.PieceTable(pieces)
    probs = language._probabilities(np.array([[1.0, 2, 3, 1, 4, 1, 2, 5]]))
    p = dict(zip(pieces, probs[0]))

    def total(s):
        return 1.0 if not s else sum((p.get(s[:k], language.UNKNOWN if k == 1 else 0.0)) * total(s[k:]) for k in range(1, len(s) + 1))

    words = ["a", "ab", "abab", "babba", "axb", "é"]
    _, logs = language.forward(*table.lattice(words), probs)
    assert np.allclose(logs[0], [math.log(total("▁" + w)) for w in words])


def test_long_runs_are_summed_whole():
    """Words beyond the scaled numbers' range: the same sums in logarithms, over window borders, with the same expected counts."""
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "aba", "▁ab", "abbabababbabab"]
    table = language.PieceTable(pieces)
    probs = language._probabilities(np.array([[1.0, 2, 3, 1, 4, 1, 2, 5, 2], [2.0, 1, 1, 5, 1, 2, 9, 1, 1]]))
    rnd = random.Random(3)
    for n in (1, 5, 39, 41):
        w = "".join(rnd.choice("abx") for _ in range(n))
        _, logs = language.forward(*table.lattice([w]), probs)
        assert np.allclose(language.long_forward(table, w, probs), logs[:, 0])
    w = "".join(rnd.choice("ab") for _ in range(9000))
    alpha = [0.0] + [-math.inf] * 9001
    s = "▁" + w
    p = dict(zip(pieces, np.log(probs[0])))
    for t in range(1, 9002):
        ways = [alpha[t - k] + p.get(s[t - k:t], math.log(language.UNKNOWN) if k == 1 else -math.inf) for k in range(1, min(14, t) + 1)]
        top = max(ways)
        alpha[t] = top + math.log(sum(math.exp(x - top) for x in ways))
    assert language.long_forward(table, w, probs)[0] == pytest.approx(alpha[-1], rel=1e-9)
    words, counts = ["abbaab", "xab", "babbababbabababb"], np.array([2.0, 1.0, 3.0])
    want = language.fit(table, words, counts)
    soft = np.zeros((1, table.n))
    for w, c in zip(words, counts):
        language._long_soft(table, w, language._probabilities(np.full((1, table.n), 1.0)), c, soft[0])
    assert np.allclose(soft, language.fit(table, words, counts, rounds=1)) and want.shape == soft.shape


def test_pieces_of_any_length_and_letters_only():
    assert max(map(len, language.vocabulary(queries.PIECES))) > 12
    assert language.words_of("½ ² ① Ⅷ 12_") == [] and language.words_of("aⅧb Été½x") == ["a", "b", "été", "x"]
    assert language.words_of("y" * 5000) == ["y" * 5000]


def test_language_id(spark, odd):
    rnd = random.Random(4)
    words = {"en": "the of and house water stone".split(), "de": "der und nicht haus wasser stein".split(), "fr": "le et une maison eau pierre".split()}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["en", "de", "fr"] * 20)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), queries.PIECES)
    new = [(i, " ".join(rnd.choice(words[k]) for _ in range(8)), k) for i, k in enumerate(["en", "de", "fr"] * 10)]
    got = language.classify(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    got = language.classify(odd.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == len(ODD) and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    none = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"), queries.PIECES)
    assert {r.lang_pred for r in language.classify(odd, none).collect()} == {"und"}


def test_lm_scores(spark, odd):
    assert pitman_yor.score(odd.where("false"), queries.bucket(7) == 2).collect() == []
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(vocab[int(rnd.paretovariate(0.7)) % 200] for _ in range(rnd.randint(0, 60)))) for i in range(300)] + ODD
    got = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), queries.bucket(7) == 2).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), 0]
    c = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 10]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in got)


def test_every_context_has_its_own_restaurant(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "CELL_TOKENS", 700, raising=False)  # many cells and groups
    train = [(i, f"c{i % 300} d{i % 300}", False) for i in range(3000)]
    new = [(10_000 + 2 * i + k, f"c{i} d{(i + k) % 300}", True) for i in range(300) for k in (0, 1)]
    df = spark.createDataFrame(train + new, "doc_id long, text string, held boolean").repartition(3)
    got = {r.doc_id: r.score for r in pitman_yor.score(df, F.col("doc_id") >= 10_000).collect()}
    assert all(got[10_000 + 2 * i] - got[10_001 + 2 * i] > 1 for i in range(300))
    assert all(-3.2 < got[10_000 + 2 * i] < -2 for i in range(300))  # about 1 / 300 for the first word, the rest is known


def test_word_counts_are_summed_over_all_blocks(spark):
    """More than 496 words a block, each source with its own frequent ones: the cut of the blocks must not show in the scores."""
    rnd = random.Random(8)
    rows = [(i, " ".join(f"{'ab'[i // 200]}{int(rnd.paretovariate(0.4)) % 900}" for _ in range(20))) for i in range(400)]
    got = [{r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(n, "doc_id"), queries.bucket(7) == 2).collect()}
           for n in (1, 2, 5)]
    assert len(got[0]) == 400 and got[0] == pytest.approx(got[1], rel=1e-9) and got[0] == pytest.approx(got[2], rel=1e-9)


def test_seating():
    rng = np.random.default_rng(1)
    n = np.array([0, 1, 2, 5, 100, 10_000, 1])
    t = pitman_yor.seat(rng, n, np.full(7, 0.5), 0.5)
    assert t[0] == 0 and t[1] == t[6] == 1 and (t <= n).all() and (t[1:] >= 1).all()
    assert (pitman_yor.seat(rng, n, np.zeros(7), 0.5) == (n > 0)).all()


def test_long_passage_of_a_longer_item_leaks():
    item = [f"i{k}" for k in range(1000)]
    index = decontaminate.BenchmarkIndex([(1, " ".join(item))])
    assert index.leaks(" ".join(["x", *item[300:790], "y"])) == [(1, 0.49, 1)]
    assert index.leaks(" ".join(["x", *item[300:350], "y"])) == [(1, 0.05, 1)] and not index.leaks(" ".join(["x", *item[300:349], "y"]))
    assert not index.leaks(" ".join(f"{' '.join(item[k:k + 20])} x{k}" for k in range(0, 800, 100)))  # scattered short tiles: the share decides


def brute_tiles(doc, item, n):
    free_d, free_t, cover = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and free_d[i + k] and free_t[j + k] and doc[i + k] == item[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, j, i)
        k, j, i = best
        if k < n:
            return cover
        free_d[i:i + k] = [False] * k
        free_t[j:j + k] = [False] * k
        cover += k


def test_greedy_tiling_equals_brute_force():
    rnd = random.Random(8)
    for _ in range(150):
        item = [rnd.choice("abcd") * 2 for _ in range(rnd.randint(1, 25))]
        doc = [rnd.choice("abcdx") * 2 for _ in range(rnd.randint(0, 20))] + item[len(item) // 2:] + ["zz"] + item[:len(item) // 2]
        index = decontaminate.BenchmarkIndex([(1, " ".join(item))], 3)
        got = index.leaks(" ".join(doc), 0.01)
        cover = brute_tiles(doc, item, min(3, len(item)))
        assert (got[0][1] if got else 0.0) == pytest.approx(cover / len(item))


def test_contaminated_documents(spark, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    half = "zeta eta theta iota kappa lambda mu"
    rows = [(1, "Intro. " + item.upper() + " end"), (2, half + " !! alpha beta gamma delta epsilon"), (3, "alpha beta gamma delta and more"), (4, None), (None, item), (5, "hi there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([(10, item), (11, None), (12, " "), (13, "hi there")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted(((r.doc_id, r.item_id, r.coverage) for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    assert got == [(1, 10, 1.0), (2, 10, 1.0), (5, 13, 1.0), (None, 10, 1.0)]
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]
    assert decontaminate.contaminated(odd, bench).collect() == [] and decontaminate.contaminated(docs, bench.where("false")).collect() == []


def test_a_benchmark_of_many_blocks(spark, monkeypatch):
    """Block after block: the same leaks and the same rows left as with a single block."""
    items = [(i, " ".join(f"b{i}w{k}" for k in range(12))) for i in range(30)]
    docs = spark.createDataFrame([(i, f"start {items[i % 40][1] if i % 40 < 30 else 'clean text'} end") for i in range(80)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    assert sum(1 for _ in decontaminate.benchmark_blocks(bench)) > 3
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole and len(whole) == 60
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()) == [*range(30, 40), *range(70, 80)]


def test_decoding_together_is_decoding_one_by_one(monkeypatch):
    import public_tokenizers

    from routelake.llm import byte_bpe

    coder = byte_bpe.ByteBPE.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["", "Plain words, twice: plain words.", "", "é中\U0001f600 mixed  runs\n\n", " " * 50, "new1 new2 new1 new2 " * 40]
    ids = [coder.encode(t) for t in texts]
    assert coder.decode_all(ids).to_pylist() == [coder.decode(x) for x in ids] == [t.encode() for t in texts]
    assert coder.decode_all([]).to_pylist() == []
    monkeypatch.setattr(byte_bpe, "DECODED_AT_ONCE", 10)
    assert coder.decode_all(ids).to_pylist() == [t.encode() for t in texts]
