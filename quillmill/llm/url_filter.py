"""URL filters: a Bloom filter cascade over the corpus's complete key universe (DataFrame functions only).

A URL's keys are every suffix of its host with the leading parts of its path that rules may name, and
every label of its host. Level 1 of a cascade encodes the listed keys; level 2 encodes the keys of the
corpus that pass level 1 but are not listed; level 3 the listed keys that pass level 2; and so on until no
false positive is left. As the levels were built over all keys that occur, membership is exact and the
pages need no join.

Nulls, empty urls and urls without "://": host and path are empty, no rule fits, the verdict is the
default. Repeated rows are judged each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import materialize

#: (rule, verdict); a rule is host + "/" + start of the path
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: labels of hosts that are blocked where no rule fits
BLOCKED_LABELS = ("spam-farm", "cheap-pills")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    bits: bytes
    n_bits: int
    n_hashes: int
    seed: int


def _positions(key: Column, level_bits: int, n_hashes: int, seed: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(2 * seed)), F.xxhash64(key, F.lit(2 * seed + 1))
    m = F.lit(level_bits).cast("long")
    return [F.pmod(F.pmod(a, m) + F.lit(i).cast("long") * F.pmod(b, m), m) for i in range(n_hashes)]


def _passes(level: Level, key: Column) -> Column:
    """Whether all of the key's bits are set; the bits are one binary literal."""
    out = F.lit(True)
    bits = F.lit(bytearray(level.bits))
    for p in _positions(key, level.n_bits, level.n_hashes, level.seed):
        byte = F.conv(F.hex(F.substring(bits, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(p, F.lit(8)))), F.lit(2)) == 1)
    return out


def _encode(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    n_hashes = max(1, min(12, round(math.log2(1 / rate))))
    n_bits = max(64, 8 * math.ceil(n * math.log(1 / rate) / math.log(2) ** 2 / 8))
    rows = keys.select(F.explode(F.array(*_positions(F.col("key"), n_bits, n_hashes, seed))).alias("p")).groupBy(F.shiftright("p", 3).alias("byte")).agg(F.bit_or(F.pow(F.lit(2.0), F.pmod("p", F.lit(8))).cast("int")).alias("v")).collect()  # n_bits / 8 rows at most
    out = bytearray(n_bits // 8)
    for r in rows:
        out[r["byte"]] = r["v"]
    return Level(bytes(out), n_bits, n_hashes, seed)


class BloomCascade:
    """Exact membership of the keys of a known universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, n_universe: int, max_bits: int = 1 << 27) -> BloomCascade:
        """listed, universe: one column key; the universe's keys may repeat. More listed keys than max_bits can hold are an error: split the list by a hash of the key."""
        listed = listed.distinct()
        n = listed.count()
        levels: list[Level] = []
        if not n:
            return cls(levels)
        rate = min(0.5, max(1e-6, n * math.sqrt(2) / max(1, n_universe - n)))
        inside, outside, passed = listed, universe.join(F.broadcast(listed), "key", "left_anti") if n <= 10_000 else universe.join(listed, "key", "left_anti"), n
        while passed:
            if passed * math.log(1 / rate) / math.log(2) ** 2 > max_bits:
                raise ValueError("the listed keys need more bits than max_bits")
            levels.append(_encode(inside, passed, rate, len(levels)))
            # only what passes is made distinct and kept, so the universe is scanned once and never shuffled
            through = materialize(outside.where(_passes(levels[-1], F.col("key"))).distinct(), "passed")
            inside, outside = through, inside
            passed, rate = through.count(), 0.5
        return cls(levels)

    def contains(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(self.levels):
            out = _passes(level, key) & ~out
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def url_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every suffix of the host at a label, with the path's first n characters for each n of path_lengths."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))

    def with_start(n: int) -> Column:
        return F.when(F.length(path) >= n, F.transform(suffixes, lambda s: F.concat(s, F.substring(path, 1, n)))).otherwise(F.array().cast("array<string>"))

    fit = [with_start(n) for n in path_lengths]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(*fit))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, blocked_labels: tuple[str, ...] = BLOCKED_LABELS, default: str = "allow", url: str = "url") -> DataFrame:
    """The rows of pages (id columns page_id) with host, path, rule and verdict; see the module's text for edge cases."""
    spark: SparkSession = pages.sparkSession
    host, path = host_and_path(F.col(url))
    lengths = sorted({len(r) - r.index("/") for r, _ in rules})
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = rows.select(url_keys(F.col("host"), F.col("path"), lengths).alias("ks"), F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("label:"), x)).alias("ls"))
    universe = keyed.select(F.explode(F.concat("ks", "ls")).alias("key"))
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0]
    of = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    block = BloomCascade.build(of([r for r, v in rules if v == "block"]), universe, n_universe)
    allow = BloomCascade.build(of([r for r, v in rules if v == "allow"]), universe, n_universe)
    label = BloomCascade.build(of([f"label:{x}" for x in blocked_labels]), universe, n_universe)
    longest = lambda cascade: F.array_max(F.transform(F.filter(F.col("ks"), cascade.contains), lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))
    out = rows.withColumn("ks", url_keys(F.col("host"), F.col("path"), lengths)).withColumn("b", longest(block)).withColumn("a", longest(allow))
    n = lambda c: F.coalesce(F.col(c)["n"], F.lit(0))
    listed = F.exists(F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("label:"), x)), label.contains)
    verdict = F.when(n("a") + n("b") == 0, F.when(listed, "block").otherwise(default)).when(n("a") > n("b"), "allow").otherwise("block")
    return out.select("page_id", "host", "path", F.when(n("a") > n("b"), F.col("a")["k"]).otherwise(F.col("b")["k"]).alias("rule"), verdict.alias("verdict"))
