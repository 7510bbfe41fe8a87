"""URL filters: exact membership by a cascade of Bloom filters, without joins.

Level 1 encodes the listed keys.  Over the corpus's complete key universe its
false positives are known; level 2 encodes them.  Level 3 encodes the listed
keys that level 2 wrongly claims, and so on until a level errs on nothing.
A key is listed iff the first level that rejects it has an even number (or
none rejects it and the number of levels is odd): exact for every key of the
universe.  Only native expressions run on the rows.

Size: level 1 takes ``bits_per_key`` bits a listed key, later levels less, as
they hold the few false positives.  ``max_filter_bytes`` bounds what the plan
carries; beyond it :func:`judge_urls` answers the same question by shuffled
joins on the keys instead.

Nulls and urls without ``://`` have empty host and path; no rule fits them.
Empty tables give empty results; repeated rows are judged each on its own.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathframe.llm.common import ascii_lower, bit_words, bits_set, cut, words_literal


@dataclass(frozen=True)
class UrlRule:
    """``host`` and its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    action: str  # allow or block


@dataclass(frozen=True)
class Cascade:
    """Filters of the levels, first to last; ``bits[i]`` bits and ``probes[i]`` hashes."""

    words: tuple[dict[int, int], ...]
    bits: tuple[int, ...]
    probes: tuple[int, ...]
    name: str

    def contains(self, key: Column) -> Column:
        answer = F.lit(len(self.bits) % 2 == 1)
        for i in reversed(range(len(self.bits))):
            inside = bits_set(words_literal(self.words[i], self.bits[i]), _hashes(key, self.name, i, self.probes[i]), self.bits[i])
            answer = F.when(inside, answer).otherwise(F.lit(i % 2 == 1))
        return answer

    @property
    def size_bytes(self) -> int:
        return sum(self.bits) // 8


class FilterTooLarge(Exception):
    """The cascade would pass ``max_filter_bytes``."""


def _hashes(key: Column, name: str, level: int, probes: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(f"{name}/{level}/{i}")) for i in range(probes)]


def build_cascade(
    listed: DataFrame,
    universe: DataFrame,
    name: str = "listed",
    bits_per_key: int = 16,
    max_filter_bytes: int = 8 << 20,
    max_levels: int = 24,
) -> Cascade:
    """A cascade for ``listed(key)``, exact over ``universe(key)``.

    One pass over the universe keeps what level 1 wrongly claims; the further
    levels only see those keys and the listed ones.  An empty list gives a
    cascade that holds nothing.
    """
    probes = max(1, round(bits_per_key * math.log(2) / 2))
    inside = cut(listed.where("key is not null").select("key").distinct())
    outside: DataFrame | None = None
    words: list[dict[int, int]] = []
    bits: list[int] = []
    taken: list[int] = []
    for level in range(max_levels):
        count = inside.count()
        if count == 0:
            break
        size = max(64, 64 * math.ceil(count * bits_per_key / 64))
        if (sum(bits) + size) // 8 > max_filter_bytes:
            raise FilterTooLarge(f"{name}: over {max_filter_bytes} bytes at level {level + 1}")
        hashes = _hashes(F.col("key"), name, level, probes)
        words.append(bit_words(inside, hashes, size))
        bits.append(size)
        taken.append(probes)
        claimed = bits_set(words_literal(words[-1], size), hashes, size)
        if outside is None:
            wrong = universe.where("key is not null").where(claimed).select("key").distinct()
            wrong = wrong.join(inside, "key", "left_anti")
        else:
            wrong = outside.where(claimed)
        inside, outside = cut(wrong), inside
    else:
        raise FilterTooLarge(f"{name}: no end after {max_levels} levels")
    return Cascade(tuple(words), tuple(bits), tuple(taken), name)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """A key for each (labels, path length) that occurs in the rules; longest first."""
    labels = F.size(F.split(host, r"\."))
    found = [
        F.when(
            (host != "") & (labels >= n) & (F.length(path) >= length),
            F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, length)),
        )
        for n, length in shapes
    ]
    return F.array_compact(F.array(*found))


def judge_urls(
    pages: DataFrame,
    rules: list[UrlRule],
    url: str = "url",
    default: str = "allow",
    max_filter_bytes: int = 8 << 20,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The rule with the longest ``host + path`` that fits wins; without one
    ``rule`` is null and the verdict is ``default`` (the key is not listed).
    Of two actions for the same key, block wins.  Columns of ``pages`` that
    have the names of the results are replaced.
    """
    spark = pages.sparkSession
    actions: dict[str, str] = {}
    for r in rules:
        key = r.host.lower() + r.path
        actions[key] = "block" if "block" in (r.action, actions.get(key)) else "allow"
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}, reverse=True)
    made = ("host", "path", "rule", "verdict", "_pf_keys")
    # The keys are cut from the host as rules name it, lower case.
    full = pages.drop(*made).withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    if not shapes:
        return full.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    full = full.withColumn("_pf_keys", _keys(F.col("host"), F.col("path"), shapes))
    universe = (
        pages.select(F.col(url).alias("u"))
        .select(url_host(F.col("u")).alias("h"), url_path(F.col("u")).alias("p"))
        .select(F.explode(_keys(F.col("h"), F.col("p"), shapes)).alias("key"))
    )
    # One constant: rows from Python would start workers.
    text = json.dumps([{"key": k, "action": a} for k, a in actions.items()])
    listed = spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<key:string,action:string>>")))
    longest = lambda fits: F.element_at(
        F.array_sort(fits, lambda x, y: F.when(F.length(x) > F.length(y), -1).when(F.length(x) < F.length(y), 1).otherwise(0)), 1
    )
    try:
        named = build_cascade(listed, universe, "rules", max_filter_bytes=max_filter_bytes)
        blocked = build_cascade(listed.where("action = 'block'"), listed, "block", max_filter_bytes=max_filter_bytes)
    except FilterTooLarge:
        return _judge_by_join(full, listed, default)
    return (
        full.withColumn("_pf_keys", F.filter("_pf_keys", named.contains))
        .withColumn("rule", F.when(F.size("_pf_keys") > 0, longest(F.col("_pf_keys"))))
        .withColumn(
            "verdict",
            F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.contains(F.col("rule")), "block").otherwise("allow"),
        )
        .drop("_pf_keys")
    )


def _judge_by_join(full: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """The same verdicts for lists whose filters are too large to carry: one shuffled join on distinct keys."""
    keyed = full.withColumn("_pf_row", F.monotonically_increasing_id())
    keyed = cut(keyed)
    hits = (
        keyed.select("_pf_row", F.explode("_pf_keys").alias("key"))
        .join(listed, "key")
        .groupBy("_pf_row")
        .agg(F.max_by(F.struct("key", "action"), F.length("key")).alias("_pf_hit"))
    )
    return (
        keyed.join(hits, "_pf_row", "left")
        .withColumn("rule", F.col("_pf_hit.key"))
        .withColumn("verdict", F.coalesce("_pf_hit.action", F.lit(default)))
        .drop("_pf_row", "_pf_hit", "_pf_keys")
    )
