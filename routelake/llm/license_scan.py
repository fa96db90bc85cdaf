"""Licence scan with a positional rare-token index.

Every document is tokenised once; what is kept are the places of words that occur in a licence template (the *hits*).
Document frequencies of those words give their IDF. A template's highest-IDF words are its look-up tokens, just as many
as it takes for one of them to be in place wherever enough of the template is: each of their places in a file proposes a start (place minus the word's position in the template), the neighbouring hits are
intersected with the template's words at the same relative positions, and mandatory key phrases are verified
word by word. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SHARE = 0.75    # share of a template's words that must stand at their relative positions
_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence text and the part of it (``key``) that must occur word by word."""
    label: str
    text: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i:i + len(k)] == k)


#: Phrases that are counted at every place.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

TEMPLATES = (
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person"),
    Template("mit", "released under the mit license", "under the mit license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)


def _hits(words: Column, vocab: list[str]) -> Column:
    """(p, w): place and lower-cased word of each template word of a document, in order."""
    def hit(w: Column, i: Column) -> Column:
        low = F.translate(w, UPPER, LOWER)
        return F.when(F.lower(w).isin(vocab) & low.isin(vocab), F.struct(i.alias("p"), low.alias("w")))

    return F.filter(F.transform(words, hit), lambda x: x.isNotNull())


def _consecutive(hits: Column, k: Column, first: Column, words: list[str], at: int) -> Column:
    """The template words stand one after the other, word ``at`` being hit ``k`` (their places are then consecutive
    hits, as all of them are template words); ``first``: the place of word ``at``."""
    test = F.lit(True)
    for j, w in enumerate(words):
        x = F.get(hits, k + F.lit(j - at))
        test = test & (x["w"] == w) & (x["p"] == first + F.lit(j - at))
    return F.coalesce(test, F.lit(False))


def _numbered(hits: Column, rare: list[str]) -> Column:
    """(p, w, k) of the hits that are look-up tokens; k: index among all hits."""
    return F.filter(F.transform(hits, lambda x, k: F.when(x["w"].isin(rare), F.struct(x["p"].alias("p"), x["w"].alias("w"), k.alias("k")))),
                    lambda x: x.isNotNull())


def _starts(hits: Column, phrase: list[str], df: dict[str, int]) -> Column:
    """Every place where the phrase's words stand consecutively, looked up by its highest-IDF word."""
    at = min(range(len(phrase)), key=lambda i: (df.get(phrase[i], 0), i))
    found = F.filter(_numbered(hits, [phrase[at]]), lambda x: _consecutive(hits, x["k"], x["p"], phrase, at))
    return F.transform(found, lambda x: x["p"] - at)


def _share(hits: Column, t: Template, df: dict[str, int]) -> Column:
    """The best share of the template's words at their relative positions over the starts that its highest-IDF words
    propose and that have the key phrase in place; 0 without one."""
    words, key, n = t.words, t.key.split(), len(t.words)
    rare, missing = [], int(n * (1 - MIN_SHARE))
    for w in sorted(set(words), key=lambda w: (df.get(w, 0), w)):
        if sum(words.count(x) for x in rare) <= missing:
            rare.append(w)
    text = F.array(*map(F.lit, words))
    lo, hi = t.key_at, t.key_at + len(key)

    def shares(w: str, at: int) -> Column:
        def share(x: Column) -> Column:
            start = x["p"] - at
            near = F.slice(hits, F.greatest(x["k"] + 1 - n, F.lit(0)) + 1, 2 * n)
            in_place = F.filter(near, lambda h: F.coalesce(F.get(text, h["p"] - start) == h["w"], F.lit(False)))
            whole_key = F.size(F.filter(in_place, lambda h: (h["p"] >= start + lo) & (h["p"] < start + hi))) == len(key)
            return F.when(whole_key, F.size(in_place) / F.lit(float(n))).otherwise(0.0)

        return F.coalesce(F.array_max(F.transform(_numbered(hits, [w]), share)), F.lit(0.0))

    best = F.lit(0.0)
    for w in rare:
        for at in (i for i, x in enumerate(words) if x == w):
            best = F.greatest(best, shares(w, at))
    return best


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Licence labels of ``docs(doc_id, text)``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``base_labels`` come from ``phrases`` at every place where their words stand consecutively (n_base of them;
    first_word and last_word: smallest and largest start); ``labels`` adds templates of which at least ``MIN_SHARE`` of
    the words are in place. score: 1 with a base place, else the best template share.

    Defined cases: a null text is empty (no words, empty labels, score 0, null places); rows are judged one by one, so
    null and repeated doc_ids stay; other columns are ignored."""
    vocab = sorted({w for _, p in phrases for w in p.split()} | {w for t in templates for w in t.words})
    if any(re.search("[^0-9a-z]", w) for w in vocab):
        raise ValueError("licence words must be lower-case ASCII letters and digits")
    split = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), _NO_WORD)
    read = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(split, lambda w: w != "").alias("words"))
            .select("doc_id", F.size("words").cast("long").alias("n_words"), _hits(F.col("words"), vocab).alias("hits")))
    hits = written(read, "licence-hits")
    counts = hits.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    df = {r["w"]: r["n"] for r in counts.collect()}  # at most one row per template word
    h = F.col("hits")
    found = hits.select("doc_id", "n_words", *[_starts(h, p.split(), df).alias(f"s{i}") for i, (_, p) in enumerate(phrases)],
                        *[_share(h, t, df).alias(f"t{i}") for i, t in enumerate(templates)])
    places = F.flatten(F.array(*[F.col(f"s{i}") for i in range(len(phrases))]))
    base = [F.when(F.size(f"s{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(phrases)]
    more = [F.when(F.col(f"t{i}") >= MIN_SHARE, F.lit(t.label)) for i, t in enumerate(templates)]

    def joined(labels: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*labels), lambda x: x.isNotNull()))), ",")

    shares = [F.when(F.col(f"t{i}") >= MIN_SHARE, F.col(f"t{i}")).otherwise(0.0) for i in range(len(templates))]
    return found.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), joined(base).alias("base_labels"), joined(base + more).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.greatest(*shares, F.lit(0.0))).alias("score"))
