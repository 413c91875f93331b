"""URL filters by a Bloom filter cascade, in DataFrame functions only.

A cascade holds a listed set exactly with respect to a complete universe of keys: level 0 encodes
the listed keys, level 1 the keys of the universe that level 0 takes wrongly, level 2 the listed
keys that level 1 takes, and so on until a level takes nothing wrongly. A key is listed if the
first level that lacks it is odd, or if it passes all and the last level is even.

The universe of a table of URLs is every (host suffix, path prefix) that has the shape of some rule:
as many labels and as long a path. So membership of these keys says which rules fit a URL, and
neither scoring nor its plan has a join.

A null URL, or one without "://", has an empty host and path and fits no rule. Rows are
independent: repeated rows, ties and empty tables need no rule; of rules that fit, the longest
wins, and of an allow and a block rule with the same key, the block rule. Only id and url are read,
whatever further columns are named.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import lower_ascii


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Every key of a URL that has the shape of a rule; whatever the URL's length, as many as there are shapes."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    listed = F.array(*(F.struct(F.lit(n).alias("labels"), F.lit(m).alias("chars")) for n, m in shapes))
    full = F.filter(listed, lambda s: (F.char_length(path) >= s["chars"]) & (F.size(F.split(host, "\\.")) >= s["labels"]))
    suffix = lambda s: F.array_join(F.slice(F.split(host, "\\."), -s["labels"], s["labels"]), ".")
    return F.transform(full, lambda s: F.concat(suffix(s), F.substring(path, F.lit(1), s["chars"])))


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    hashes: int
    salt: int

    def bits(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.salt + j)), F.lit(64 * len(self.words))) for j in range(self.hashes)]

    def takes(self, key: Column) -> Column:
        held = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # foldable: one constant in the plan
        out = F.lit(True)
        for bit in self.bits(key):
            word = F.element_at(held, (F.floor(bit / 64) + 1).cast("int"))
            out = out & (F.call_function("getbit", word, (bit % 64).cast("int")) == 1)
        return out


class TooLarge(ValueError):
    """The listed keys need a larger filter than may be sent to all executors."""


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, error: float = 0.01, most_bits: int = 1 << 23) -> Cascade:
        """listed, universe: one column `key`. Only the filters' words, most_bits at most, come to the driver."""
        levels: list[Level] = []
        ours, theirs = listed.where("key is not null").distinct(), universe.where("key is not null")
        while n := ours.count():
            size = -64 * (-math.ceil(n * math.log2(1 / error) / math.log(2)) // 64)
            if size > most_bits:
                raise TooLarge(f"{n} keys need {size} bits")
            level = Level((0,) * (size // 64), max(1, round(math.log2(1 / error))), 1000 * (len(levels) + 1))
            bits = ours.select(F.explode(F.array(*level.bits(F.col("key")))).alias("bit"))
            rows = bits.groupBy(F.floor(F.col("bit") / 64).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("word")).collect()
            words = [0] * (size // 64)
            for r in rows:
                words[r["at"]] = r["word"]
            levels.append(level := Level(tuple(words), level.hashes, level.salt))
            taken = theirs.where(level.takes(F.col("key"))).distinct()
            if len(levels) == 1:
                taken = taken.join(ours, "key", "left_anti")
            ours, theirs, error = taken, ours, 0.5
        return cls(tuple(levels))

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].takes(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", most_bits: int = 1 << 23) -> DataFrame:
    """id, host, path, rule (its host and path; null if none fits), verdict."""
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("keys").alias("key"))
    held = {}
    for action in ("block", "allow"):
        own = sorted({r.key for r in rules if r.action == action})
        listed = pages.sparkSession.createDataFrame([(k,) for k in own], "key string")
        try:
            held[action] = Cascade.build(listed, universe, most_bits=most_bits)
        except TooLarge:
            return _by_join(keyed, rules, default, id_col)
    fits = lambda k: F.when(held["block"].holds(k), F.lit("block")).when(held["allow"].holds(k), F.lit("allow"))
    judged = F.filter(F.transform("keys", lambda k: F.struct(F.char_length(k).alias("n"), k.alias("key"), fits(k).alias("action"))), lambda x: x["action"].isNotNull())
    best = F.array_max(judged)
    return keyed.withColumn("best", best).select(id_col, "host", "path", F.col("best.key").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))


def _by_join(keyed: DataFrame, rules: list[Rule], default: str, id_col: str) -> DataFrame:
    """For lists too large for a filter: the same result by an ordinary join on the keys."""
    table = keyed.sparkSession.createDataFrame([(r.key, r.action) for r in rules], "key string, action string").groupBy("key").agg(F.max("action").alias("action"))
    rows = keyed.withColumn("row", F.monotonically_increasing_id())
    fits = rows.select("row", F.explode("keys").alias("key")).join(table, "key").groupBy("row").agg(F.max(F.struct(F.char_length("key").alias("n"), "key", "action")).alias("best"))
    return rows.join(fits, "row", "left").select(id_col, "host", "path", F.col("best.key").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
