import collections
import random

import numpy as np
import pytest
from pyspark.sql import Row

from routelake.llm import near_dup
from routelake.llm.near_dup import near_duplicates, shingle_set


def brute(rows):
    """component and set size of (doc_id, text) rows with distinct doc_ids, from all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(k for x in s for k in holders[x]).items():
            if j < i and 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rnd, words, base, rate):
    return " ".join(w if rnd.random() > rate else rnd.choice(words) for w in base)


@pytest.mark.parametrize("tile", [None, 8])
def test_equals_all_pairs(spark, monkeypatch, tile):
    if tile:  # groups over many tiles
        monkeypatch.setattr(near_dup, "KEY_TILE", tile)
        monkeypatch.setattr(near_dup, "SET_TILE", tile)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for size, rate in ((60, 0.01), (40, 0.02), (30, 0.003), (2, 0.005)):
        base = [rnd.choice(words) for _ in range(rnd.randint(80, 400))]
        for _ in range(size):
            rows.append((n, family(rnd, words, base, rate)))
            n += 1
    rows += [(n + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(100)]
    rows += [(n + 100 + i, "The  same\tTEXT here") for i in range(20)] + [(n + 120, "the same text HERE"), (n + 121, None), (n + 122, ""), (n + 123, " \n")]
    rnd.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([Row(doc_id=None, text=text, fp=1, rep=2, component=3, key=4), Row(doc_id=5, text=text, fp=1, rep=2, component=3, key=4),
                                Row(doc_id=5, text=text, fp=1, rep=2, component=3, key=4), Row(doc_id=9, text=text, fp=1, rep=2, component=3, key=4)])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == [(5, 5, True), (5, 5, True), (9, 5, False), (None, None, True)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("percent", [95, 85, 80, 75])
def test_every_pair_within_the_distance_shares_a_key(percent):
    rng = np.random.RandomState(1)
    distance, chunks = near_dup.plan(percent)
    for _ in range(200):
        a = rng.randint(0, 65536, near_dup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        for i in rng.choice(near_dup.SYMBOLS, distance, replace=False):
            b[i] ^= 1 + rng.randint(0, 65535)
        ka, kb = near_dup._index_keys(np.stack([a, b]), chunks)
        assert (ka == kb).any()


def test_the_distance_follows_the_similarity():
    assert near_dup.plan(85) == (17, 9) and near_dup.plan(80)[0] > 17 > near_dup.plan(90)[0]
    with pytest.raises(ValueError):
        near_dup.plan(40)


@pytest.mark.parametrize("percent", [85, 80])
def test_planted_pairs_at_the_very_threshold_are_linked(spark, percent):
    """Pairs of two sets of n shingles that share just enough of them: words are changed at the end."""
    rows, n, union = [], 0, 400
    shared = union * percent // 100
    for p in range(300):
        size = (union + shared) // 2  # shingles of each: union = 2 * size - shared
        base = [f"p{p}w{i}" for i in range(size + 4)]
        other = base[:shared + 4] + [f"q{p}w{i}" for i in range(size - shared)]
        rows += [(n, " ".join(base)), (n + 1, " ".join(other))]
        n += 2
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent).collect()
    assert all(r.component_id == r.doc_id - r.doc_id % 2 for r in got)


def test_sets_follow_byte_rules():
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a b")) == 1 and len(shingle_set(" \x0b")) == 0
    assert shingle_set("É A").tolist() == shingle_set("É a").tolist() != shingle_set("é a").tolist()
    assert len(shingle_set("a b c d e f")) == 1  # a no-break space is no separator


def test_alike_tiles_add_few_links():
    """1,000 members that are all linked, in 10 tiles: a link a member and a link a pair of tiles, not a link a member and pair of tiles."""
    import numpy as np

    from routelake.llm import near_dup

    r = np.random.RandomState(3)
    ids, own = r.permutation(1000), np.arange(1000) % 10
    links = set()
    for ti in range(10):
        for tj in range(ti, 10):
            at = np.flatnonzero((own == ti) | (own == tj))
            found = near_dup._spanning(ids[at], own[at], ti, tj, lambda x, y: np.ones((len(x), len(y)), bool))
            links |= {tuple(sorted(p)) for p in found.tolist() if p[0] != p[1]}
    assert len(links) <= 1000 + 45
    sets = near_dup.UnionFind()
    assert sum(sets.union(*p) for p in links) == 999


def test_spanning_links_connect_what_the_links_connect():
    import numpy as np

    from routelake.llm import near_dup

    r = np.random.RandomState(4)
    for _ in range(20):
        n = 60
        full = r.rand(n, n) < 0.02
        full |= full.T
        ids, own = r.permutation(1000)[:n], r.randint(0, 3, n)
        want, got = near_dup.UnionFind(), near_dup.UnionFind()
        for a, b in zip(*np.nonzero(full)):
            want.union(int(ids[a]), int(ids[b]))
        for ti in range(3):
            for tj in range(ti, 3):
                at = np.flatnonzero((own == ti) | (own == tj))
                for p in near_dup._spanning(ids[at], own[at], ti, tj, lambda x, y: full[np.ix_(at[x], at[y])]).tolist():
                    got.union(*p)
        assert [want.find(int(i)) for i in ids] == [got.find(int(i)) for i in ids]
