"""Operator 8: URL filtering by rules held in cascades of Bloom filters.

A rule is a host with a path prefix. A url can only be fitted by keys made of one of its host's domain suffixes and one of its
path's prefixes; all such keys of all urls are the universe. A cascade holds a rule list exactly over that universe: level 1
encodes the listed keys, level 2 the universe's keys that level 1 lets pass wrongly, level 3 the listed keys that level 2
catches wrongly, and so on until a level catches nothing wrong. A key is listed if the first level that lacks it is an even
one. Urls are then judged row by row without a join: among a url's keys the longest listed one wins.

Only suffixes with as many labels, and prefixes with as many characters, as some rule has are made into keys, so a long url
makes no more keys than a short one. Level 1 lets pass about as many of the universe's keys wrongly as there are listed ones,
so all levels' sizes follow the list: level 1 takes about 1.44 * log2(universe / list) bits a listed key, further levels six.
Filters are constants of the query's plan. A list whose first filter would be larger than LARGEST_FILTER isn't put into one;
its rules are joined to the exploded keys instead.

Defined cases: a null url, or one without `://`, has empty host and path and no rule; a url without a rule gets `default`.
A rule in both lists counts as allowed. A null id stays; rows are independent; only the id and url columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of wrong keys that a further level lets pass.
RATE = 1 / 16
#: Bits of the largest filter of a level (2 MB), which bounds what a plan carries.
LARGEST_FILTER = 1 << 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse_host(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    found = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.when(F.instr(url, "://") > 0, found).otherwise("")


def parse_path(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def candidate_keys(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """All keys (host suffix + path prefix) by which some rule of such a shape could fit, the longest first."""
    labels = sorted({h.count(".") + 1 for h, _ in rules}, reverse=True)
    lengths = sorted({len(p) for _, p in rules}, reverse=True)
    parts = [F.when(F.size(F.split(host, r"\.")) >= n, F.substring_index(host, ".", -n)) for n in labels]
    keys = [F.when(F.length(path) >= m, F.concat(h, F.substring(path, 1, m))) for h in parts for m in lengths]
    found = F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")
    return F.array_sort(found, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))


def filter_shape(n: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter of n keys that lets pass that share of others."""
    return max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64)), max(1, round(-math.log2(rate)))


class Level:
    """One Bloom filter: its bit set as 64-bit words."""

    def __init__(self, keys: DataFrame, level: int, rate: float):
        n = keys.count()
        self.level, self.empty = level, n == 0
        self.bits, self.hashes = filter_shape(n, rate)
        at = keys.select(F.explode(F.array(*[self._at(F.col("key"), k) for k in range(self.hashes)])).alias("at"))
        words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(self._mask(F.col("at"))).alias("mask"))
        self.words = [0] * (self.bits // 64)
        for r in words.collect():  # no more rows than the filter has words
            self.words[r["word"]] = r["mask"]

    def _at(self, key: Column, k: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.level), F.lit(k)), F.lit(self.bits))

    @staticmethod
    def _mask(at: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))

    def has(self, key: Column) -> Column:
        """The bits of a key are looked up in the bit set, here a constant of the plan."""
        if self.empty:
            return F.lit(False)
        words = F.lit(self.words).cast(T.ArrayType(T.LongType()))
        hit = F.lit(True)
        for k in range(self.hashes):
            at = self._at(key, k)
            hit = hit & (F.element_at(words, F.floor(at / 64).cast("int") + 1).bitwiseAND(self._mask(at)) != 0)
        return hit


def first_rate(listed: int, universe: int) -> float:
    """The share of wrong keys that level 1 may let pass, so that they are about as many as the listed ones."""
    return min(RATE, max(1, listed) / max(1, universe))


class Cascade:
    """Exact membership of a universe's keys in a list."""

    def __init__(self, listed: DataFrame, universe: DataFrame, rate: float = RATE):
        """Both have one column, key. The universe must be re-readable; it is filtered by the first level, and what passes
        wrongly is about as much as the list. Each further level leaves a share RATE of the level before."""
        listed = listed.distinct()
        self.levels = [Level(listed, 1, rate)]
        inside, outside = listed, universe.distinct().join(listed, "key", "left_anti")
        wrong = outside.where(self.levels[-1].has(F.col("key")))
        while not (level := Level(wrong, len(self.levels) + 1, RATE)).empty:
            self.levels.append(level)
            inside, outside = wrong, inside
            wrong = outside.where(level.has(F.col("key")))

    def has(self, key: Column) -> Column:
        found = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            found = F.when(~self.levels[k - 1].has(key), F.lit(k % 2 == 0)).otherwise(found)
        return found


def _rule_by_join(keyed: DataFrame, rules: DataFrame, id_cols: list[str]) -> DataFrame:
    """keyed with rule, by an equi-join of its keys; the longest key of a row wins. For lists too large for a filter."""
    rows = keyed.select(*id_cols, F.explode("keys").alias("key")).distinct()
    best = rows.join(rules.distinct(), "key").groupBy(*id_cols).agg(F.max_by("key", F.struct(F.length("key"), "key")).alias("rule"))
    return keyed.join(best, id_cols, "left")


def judge_urls(pages: DataFrame, allow: Iterable[tuple[str, str]], block: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule (host and path prefix of the rule that wins, or null), verdict. Rules are (host, path prefix)."""
    allow, block = sorted(set(allow)), sorted(set(block))
    spark, rules = pages.sparkSession, [*allow, *block]
    url = F.coalesce(F.col(url_col), F.lit(""))
    parsed = pages.select(F.col(id_col), parse_host(url).alias("host"), parse_path(url).alias("path"))
    keyed = parsed.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("keys").alias("key"))
    allowed_keys, all_keys = (spark.createDataFrame([(h + p,) for h, p in x], "key string") for x in (allow, rules))
    rate = first_rate(len(rules), universe.distinct().count())
    if filter_shape(len(rules), rate)[0] > LARGEST_FILTER:
        found = _rule_by_join(keyed, all_keys, ["host", "path"])
        is_allowed = found.join(allowed_keys.distinct().select(F.col("key").alias("rule"), F.lit(True).alias("ok")), "rule", "left")
        found, allowed = is_allowed.withColumn("ok", F.coalesce("ok", F.lit(False))), F.col("ok")
    else:
        listed, allow_list = Cascade(all_keys, universe, rate), Cascade(allowed_keys, universe, rate)
        found = keyed.withColumn("rule", F.try_element_at(F.filter("keys", listed.has), F.lit(1)))
        allowed = allow_list.has(F.col("rule"))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(allowed, F.lit("allow")).otherwise("block")
    return found.select(id_col, "host", "path", "rule", verdict.alias("verdict"))
