"""URL filters: path rules, and exact membership in a host list by a cascade of Bloom filters.

The key universe is every host of the corpus with all its parent domains. Level 1 of the cascade
encodes the listed keys; level 2 the other keys of the universe that level 1 lets through by
mistake; level 3 the listed keys that level 2 lets through, and so on until nothing is left. A key
is looked up level by level until one rejects it; whether that level is odd or even is the answer,
exact for every key of the universe, and pages need no join with the list.

Size: the first level's false-positive rate is set so that about as many other keys pass as there
are listed ones, so that all levels together take some tens of bits per listed key that occurs.
``MAX_BITS`` bounds them; a longer list raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.storage import bitmap, has_bit, stored
from fleetlens.llm.text import mix, widened

# (verdict, host, path), as the task gives them.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LISTED = tuple(
    f"{name}.example.{end}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for end in ("com", "net", "org")
)
MAX_BITS = 1 << 31
MAX_LEVELS = 64
LATER_HASHES = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null where none fits."""
    name = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def domains(host: Column, most: int) -> Column:
    """The host and its parent domains of at most ``most`` labels; none for an empty host.

    A listed key of k labels can only equal one of these with k labels, so longer ones need no look-up, and a host of
    very many labels costs no more than others.
    """
    if most < 1:
        return F.array().cast("array<string>")
    ends = F.array_distinct(F.array(*[F.call_function("substring_index", host, F.lit("."), F.lit(-i)) for i in range(1, most + 1)]))
    return F.filter(ends, lambda d: d != "")


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("cascade"), key)


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    a = mix(h1.view(np.uint64) + np.uint64(level))
    step = mix(h2.view(np.uint64) ^ np.uint64(level)) | np.uint64(1)
    turns = np.arange(hashes, dtype=np.uint64)[:, None]
    return ((a + turns * step) % np.uint64(bits)).astype(np.int64)


@dataclass
class Cascade:
    """Levels as (number of hashes, bits, bitmap)."""

    levels: list[tuple[int, int, np.ndarray]]

    def passed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """How many levels let each key through before one rejects it."""
        out = np.zeros(len(h1), np.int64)
        alive = np.arange(len(h1))
        for number, (hashes, bits, level) in enumerate(self.levels):
            at = _positions(h1[alive], h2[alive], number, hashes, bits)
            hit = has_bit(level, at).all(axis=0)
            alive = alive[hit]
            out[alive] = number + 1
        return out

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self.passed(h1, h2) % 2 == 1


def build(universe: DataFrame, listed: DataFrame, *, max_bits: int = MAX_BITS) -> Cascade:
    """A cascade that is exact for all ``key`` of ``universe``; keys of ``listed`` outside of it do not matter.

    Null keys are ignored, repeated ones count once. One pass over the distinct keys for each level;
    their number falls by a constant factor from level to level.
    """
    spark: SparkSession = universe.sparkSession
    every = universe.select("key").where("key is not null").distinct()
    marked = every.join(listed.select("key").where("key is not null").distinct().withColumn("listed", F.lit(True)), "key", "left")
    h1, h2 = key_hashes(F.col("key"))
    keys = stored(marked.select(h1.alias("h1"), h2.alias("h2"), F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    counts = {r.listed: r["count"] for r in keys.groupBy("listed").count().collect()}
    levels: list[tuple[int, int, np.ndarray]] = []
    count, total = counts.get(True, 0), 0
    while count:
        number = len(levels)
        if number == MAX_LEVELS:
            raise RuntimeError("keys that share a hash of 128 bits")
        hashes = LATER_HASHES if number else max(1, min(20, math.ceil(math.log2(max(2.0, counts.get(False, 0) / count)))))
        bits = 64 + math.ceil(count * hashes / math.log(2))
        total += bits
        if total > max_bits:
            raise ValueError(f"the list needs more than {max_bits} bits")
        so_far = spark.sparkContext.broadcast(list(levels))  # bounded by max_bits

        def placed(batches: Iterator[pa.RecordBatch], number=number, hashes=hashes, bits=bits, so_far=so_far):
            for batch in batches:
                a, b, on_list = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                due = (on_list == (number % 2 == 0)) & (Cascade(so_far.value).passed(a, b) == number)
                yield pa.RecordBatch.from_arrays([pa.array(_positions(a[due], b[due], number, hashes, bits).ravel())], ["at"])

        found = bitmap(keys.mapInArrow(placed, "at long"), "at", bits)
        levels.append((hashes, bits, found))
        through = spark.sparkContext.broadcast(list(levels))

        def left(batches: Iterator[pa.RecordBatch], number=number, through=through):
            for batch in batches:
                a, b, on_list = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                due = (on_list != (number % 2 == 0)) & (Cascade(through.value).passed(a, b) == number + 1)
                yield pa.RecordBatch.from_arrays([pa.array([int(due.sum())])], ["n"])

        count = keys.mapInArrow(left, "n long").agg(F.sum("n")).first()[0] or 0
    return Cascade(levels)


def judge(
    pages: DataFrame, listed: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``listed`` and ``verdict`` of each URL.

    The longest rule that fits decides; else a page is blocked if its host or a parent domain of it is
    in ``listed`` (column ``key``), and allowed if not. Null URLs, and those without ``://``, have an
    empty host and path and are allowed. Columns of these five names are replaced; repeated rows stay. A list whose filters
    would take more than ``MAX_BITS`` bits ends the job with an error.
    """
    new = ("host", "path", "rule", "verdict", "listed")
    rest = pages.drop(*new)
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    most = listed.agg(F.max(F.size(F.split("key", r"\."))).alias("n")).first().n or 0
    universe = pages.select(host.alias("host")).distinct().select(F.explode(domains(F.col("host"), most)).alias("key"))
    levels = rest.sparkSession.sparkContext.broadcast(build(universe, listed).levels)  # bounded by MAX_BITS
    parts = rest.select("*", host.alias("host"), path.alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    pairs = F.transform(domains(F.col("host"), most), lambda d: F.struct(*[h.alias(n) for n, h in zip("ab", key_hashes(d))]))
    ready = parts.select("*", name.alias("rule"), verdict.alias("verdict"), pairs.alias("__keys"))
    columns = ready.columns[:-1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(levels.value)
        for batch in batches:
            keys = batch.column("__keys")
            flat = keys.flatten()
            hits = cascade.contains(*(flat.field(i).to_numpy(zero_copy_only=False) for i in range(2)))
            row = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy(zero_copy_only=False))
            found = np.bincount(row, hits, len(keys)) > 0 if len(row) else np.zeros(len(keys), bool)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(found)], [*columns, "listed"])

    done = ready.mapInArrow(look_up, widened(ready.drop("__keys"), "listed boolean"))
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return done.withColumn("verdict", F.coalesce("verdict", own))
