"""URL filter by a Bloom filter cascade.

A rule (verdict, host, path) fits a url whose host is the rule's or a subdomain of it and whose path starts with the
rule's; so each url has a small set of candidate keys (host suffix + path prefix), and a rule fits iff its key is
among them. The *universe* is every candidate key of the corpus. Level 1 of the cascade encodes the listed keys,
level 2 the unlisted universe keys that pass level 1, level 3 the listed keys that pass level 2, and so on until
no key passes wrongly: membership is then exact for every key of the universe, without a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelake.llm.common import written

FIRST_RATE = 0.01       # false-positive rate of level 1
NEXT_RATE = 0.5         # and of the later ones
MAX_LIST_BITS = 1 << 26  # a larger first level is not put into the plan: the keys are then joined
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    pattern = r"://([^/?#]*)([^?#]*)"
    return (F.coalesce(F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.lit("")),
            F.coalesce(F.regexp_extract(url, pattern, 2), F.lit("")))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Distinct (key, n) of every host suffix at a label bound with every path prefix of one of ``lengths``."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.array_distinct(keys)


class Level:
    """A Bloom filter whose words are a literal of the plan; bounded by ``MAX_LIST_BITS``."""

    def __init__(self, keys: DataFrame, n: int, rate: float, salt: int):
        self.bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.hashes, self.salt = max(1, round(-math.log2(rate))), salt
        at = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("at"))
        rows = (at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).collect())
        words = ["0"] * (self.bits // 64 + 1)
        for r in rows:
            words[r["w"]] = str(r["b"])
        self.words = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")

    def _places(self, key: Column) -> list[Column]:
        h, step = (F.pmod(F.xxhash64(*x), F.lit(self.bits)) for x in ((key, F.lit(self.salt)), (F.lit(self.salt), key)))
        return [F.pmod(h + F.lit(i) * step, F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        test = F.lit(True)
        for at in self._places(key):
            word = F.get(self.words, F.floor(at / 64).cast("int"))
            test = test & (F.call_function("shiftright", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(1) == 1)
        return test


class Cascade:
    """Exact membership in ``listed(key)`` for every key of ``universe(key)``."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = written(listed.select("key").where("key is not null").distinct(), "listed")
        n = listed.count()
        self.levels: list[Level] = []
        if not n:
            return
        self.levels.append(Level(listed, n, FIRST_RATE, 1))
        inside, outside = listed, written(universe.where(self.levels[0].holds(F.col("key"))).distinct().join(listed, "key", "left_anti"), "passing")
        while n := outside.count():
            level = Level(outside, n, NEXT_RATE, len(self.levels) + 1)
            self.levels.append(level)
            inside, outside = outside, written(inside.where(level.holds(F.col("key"))), "passing")

    def holds(self, key: Column) -> Column:
        """A key that passes every level belongs to the last one; otherwise the first level that refuses it decides."""
        test = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            test = F.when(self.levels[k].holds(key), test).otherwise(F.lit(k % 2 == 1))
        return test


def parse_rules(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, "host/path") pairs as rules(verdict, host, path)."""
    rows = [(v, r.partition("/")[0].translate(str.maketrans(UPPER, LOWER)), "/" + r.partition("/")[2]) for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judges every url of ``pages(page_id, url)`` by ``rules(verdict, host, path)``: page_id, host, path, rule, verdict.

    The longest fitting rule (host + path) wins; of equal texts ``block`` wins. A url that no rule fits is on no list
    and gets ``default``. Lists whose first level would pass ``MAX_LIST_BITS`` are matched by a join on the distinct
    candidate keys instead, with the same result.

    Defined cases: a null url, or one without ``://``, has an empty host and path; an empty path starts with no
    rule's path. Rules with a null field are ignored, empty rule tables fit nothing, repeated rows are
    judged alike, and other columns of either table are ignored."""
    rules = rules.select("verdict", "host", "path").where("verdict in ('allow', 'block') and host is not null and path is not null").distinct()
    rules = written(rules.select("verdict", F.concat("host", "path").alias("key"), F.length("path").alias("n")), "rules")
    lengths = sorted(r["n"] for r in rules.select("n").distinct().collect())
    host, path = url_parts(F.col("url").cast("string"))
    judged = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if not lengths:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = judged.select(F.explode(keys).alias("key"))
    if rules.count() * -math.log(FIRST_RATE) / math.log(2) ** 2 > MAX_LIST_BITS:
        best = rules.groupBy("key").agg(F.max("verdict").alias("verdict"))
        per_url = (judged.select("host", "path").distinct().withColumn("key", F.explode(keys)).join(best, "key")
                   .groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best")))
        return (judged.join(per_url, ["host", "path"], "left")
                .select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
    allow, block = (Cascade(rules.where(F.col("verdict") == v).select("key"), universe) for v in ("allow", "block"))

    def judge(key: Column) -> Column:
        verdict = F.when(block.holds(key), F.lit("block")).when(allow.holds(key), F.lit("allow"))
        return F.struct(F.length(key).alias("n"), key.alias("key"), verdict.alias("verdict"))

    best = F.array_max(F.filter(F.transform(keys, judge), lambda x: x["verdict"].isNotNull()))
    return (judged.withColumn("best", best)
            .select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
