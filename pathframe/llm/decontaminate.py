"""Benchmark decontamination: windows of test items looked up in whole documents.

The windows of all items make a hash set that the plan carries as constants: a
Bloom filter that nearly every document window fails at its first probe, and
buckets of the window texts, in which the rest are verified word by word.  So
a document is scanned in one pass over its row: no shuffle, no join, no Python.
Words are ASCII-lower-cased runs of letters, digits and non-ASCII characters;
an item of fewer words than a window is one window of its own length.

Size: the constants hold the distinct windows of the benchmark, and are built
only while their measured size is under ``max_carried_bytes``.  A larger
benchmark takes a shuffled join on window hashes, verified in the same way.

Null or empty text has no words and is never hit; items without words have no
windows; null item ids count as items with the id ``""``.  Repeated items or
documents are each treated on their own.  Empty tables give empty results or
no hits.  Columns of the documents named like results are replaced.
"""

from __future__ import annotations

import math


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathframe.llm.common import ascii_lower, bit_words, bits_set, cut, let, words_literal

#: What a word is, in ASCII-lower-cased text and in any text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_HITS = "array<struct<start:bigint,length:bigint,items:string>>"
_END, _TAB = "\n", "\t"  # neither can be in a word
#: Signs of item ids that part ids, windows and buckets, and what they are written as; the escape first.
_SIGNS = {"%": "%25", ",": "%2C", _TAB: "%09", _END: "%0A", "\r": "%0D"}


def _escaped(item: Column) -> Column:
    for sign, code in _SIGNS.items():
        item = F.replace(item, F.lit(sign), F.lit(code))
    return item


def _unescaped(item: Column) -> Column:
    for sign, code in reversed(_SIGNS.items()):
        item = F.replace(item, F.lit(code), F.lit(sign))
    return item


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # Plain lower() is exact and fast where all characters are ASCII.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _starts(words: Column, length: int) -> Column:
    n = F.size(words)
    return F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))


def _hash(gram: Column, salt: int) -> Column:
    return F.xxhash64(gram, F.lit(salt))


def item_windows(benchmark: DataFrame, window: int, item: str, text: str) -> DataFrame:
    """Distinct ``(length, gram, item)``: gram is the window's words."""
    items = benchmark.select(_escaped(F.coalesce(F.col(item).cast("string"), F.lit(""))).alias("item"), words_of(F.col(text)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    grams = items.select("item", "length", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("length")))).alias("gram"))
    return grams.distinct()


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    max_carried_bytes: int = 16 << 20,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``hit_spans`` (word ranges, 1-based, end inclusive)."""
    grams = item_windows(benchmark, window, item, item_text)
    grams = cut(grams.groupBy("length", "gram").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items")))
    stats = grams.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("gram", " ")) + F.octet_length("items") + 2).alias("bytes")).first()
    docs = docs.drop("n_words", "n_hit", "items", "hit_spans", "_pf_found", "_pf_words")
    if (stats.bytes or 0) + 16 * stats.n > max_carried_bytes:
        return _measured(_by_join(docs, grams, text))
    lengths = [r.length for r in grams.select("length").distinct().orderBy("length").collect()]
    tables = {n: _Table(grams.where(F.col("length") == n), n) for n in lengths}

    def found(words: Column) -> Column:
        hits = [t.hits(words) for t in tables.values()]
        if not hits:
            return F.array().cast(_HITS)
        return hits[0] if len(hits) == 1 else F.array_sort(F.concat(*hits))

    one = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), found(w).alias("hits")))
    return _measured(docs.withColumn("_pf_found", one))


class _Table:
    """The carried hash set of the windows of one length."""

    def __init__(self, grams: DataFrame, length: int):
        rows = grams.select(F.array_join("gram", " ").alias("g"), "items", _hash(F.col("gram"), 0).alias("h")).collect()
        self.length = length
        self.bits = max(64, 64 * math.ceil(len(rows) * 24 / 64))
        self.filter = words_literal(bit_words(grams.select("gram"), [_hash(F.col("gram"), s) for s in (1, 2)], self.bits), self.bits)
        n = max(1, len(rows))
        buckets: list[list[str]] = [[] for _ in range(n)]
        for r in rows:
            buckets[r.h % n].append(f"{r.g}{_TAB}{r['items']}{_END}")
        self.n = n
        self.buckets = F.split(F.lit("\r".join(_END + "".join(b) for b in buckets)), "\r")

    def hits(self, words: Column) -> Column:
        """Verified windows of one document, by start."""

        def verified(start: Column) -> Column:
            gram = F.slice(words, start, self.length)
            bucket = F.element_at(self.buckets, (F.pmod(_hash(gram, 0), F.lit(self.n)) + 1).cast("int"))
            key = F.concat(F.lit(_END), F.array_join(gram, " "), F.lit(_TAB))
            items = let(
                F.struct(bucket.alias("b"), key.alias("k")),
                lambda x: F.when(
                    F.contains(x["b"], x["k"]),
                    F.substring_index(F.substring(x["b"], F.call_function("instr", x["b"], x["k"]) + F.length(x["k"]), F.length(x["b"])), _END, 1),
                ),
            )
            return F.struct(start.cast("bigint").alias("start"), F.lit(self.length).cast("bigint").alias("length"), items.alias("items"))

        maybe = F.filter(
            _starts(words, self.length),
            lambda i: bits_set(self.filter, [_hash(F.slice(words, i, self.length), s) for s in (1, 2)], self.bits),
        )
        return F.filter(F.transform(maybe, verified), lambda x: x["items"].isNotNull())


def _by_join(docs: DataFrame, grams: DataFrame, text: str) -> DataFrame:
    """The hits by a shuffled join on window hashes, for benchmarks too large to carry."""
    rows = cut(docs.withColumn("_pf_row", F.monotonically_increasing_id()))
    lengths = [r.length for r in grams.select("length").distinct().collect()]
    words = rows.select("_pf_row", words_of(F.col(text)).alias("w"))

    def cut_windows(n: int) -> DataFrame:
        found = words.select("_pf_row", F.posexplode(F.transform(_starts(F.col("w"), n), lambda i: F.slice("w", i, n))).alias("p", "gram"))
        return found.select("_pf_row", (F.col("p") + 1).cast("bigint").alias("start"), F.lit(n).alias("length"), "gram")

    parts = [cut_windows(n) for n in lengths]
    windows = parts[0]
    for p in parts[1:]:
        windows = windows.unionByName(p)
    keyed = grams.withColumn("h", _hash(F.col("gram"), 0))
    hits = (
        windows.withColumn("h", _hash(F.col("gram"), 0))
        .join(keyed, ["h", "length", "gram"])
        .groupBy("_pf_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", F.col("length").cast("bigint").alias("length"), "items"))).alias("hits"))
    )
    counted = rows.join(hits, "_pf_row", "left")
    return counted.withColumn(
        "_pf_found", F.struct(F.size(words_of(F.col(text))).cast("bigint").alias("n"), F.coalesce("hits", F.array().cast(_HITS)).alias("hits"))
    ).drop("_pf_row", "hits")


def _measured(found: DataFrame) -> DataFrame:
    hits = F.col("_pf_found.hits")
    spans = F.aggregate(
        hits,
        F.array().cast("array<struct<first:bigint,last:bigint>>"),
        lambda acc, x: let(
            F.struct(F.try_element_at(acc, F.lit(-1)).alias("e"), (x["start"] + x["length"] - 1).alias("last")),
            lambda s: F.when(
                s["e"].isNotNull() & (x["start"] <= s["e"]["last"] + 1),
                F.concat(
                    F.slice(acc, 1, F.size(acc) - 1),
                    F.array(F.struct(s["e"]["first"].alias("first"), F.greatest(s["e"]["last"], s["last"]).alias("last"))),
                ),
            ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("first"), s["last"].alias("last"))))),
        ),
    )
    items = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(hits, lambda x: F.split(x["items"], ","))), _unescaped)))
    return (
        found.withColumn("hit_spans", spans)
        .withColumn("n_words", F.col("_pf_found.n"))
        .withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"] + 1))
        .withColumn("items", items)
        .drop("_pf_found")
    )


def remove_documents(scanned: DataFrame, max_hit_words: int = 0) -> DataFrame:
    """The documents of :func:`scan` with at most so many hit words, without its columns."""
    return scanned.where(F.col("n_hit") <= max_hit_words).drop("n_words", "n_hit", "items", "hit_spans")


def keep_clean(docs: DataFrame, benchmark: DataFrame, max_hit_words: int = 0, text: str = "text", **options) -> DataFrame:
    """The documents with at most so many hit words, all their columns kept, those named like results too."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    kept = scan(rows, benchmark, text="text", **options).where(F.col("n_hit") <= max_hit_words)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def remove_spans(scanned: DataFrame, text: str = "text") -> DataFrame:
    """The documents of :func:`scan` with hit words cut from ``text``; what stands between words stays."""
    value = F.coalesce(F.col(text), F.lit(""))
    pair = F.struct(F.regexp_extract_all(value, F.lit(ANY_WORD), F.lit(0)).alias("w"), F.split(value, ANY_WORD, -1).alias("gap"))
    kept = lambda w: F.transform(
        w, lambda x, i: F.when(F.exists("hit_spans", lambda s: (i + 1 >= s["first"]) & (i + 1 <= s["last"])), F.lit("")).otherwise(x)
    )
    clean = let(pair, lambda p: F.array_join(F.zip_with(p["gap"], kept(p["w"]), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), ""))
    return scanned.withColumn(text, F.when(F.col("n_hit") > 0, clean).otherwise(F.col(text))).drop("n_words", "n_hit", "items", "hit_spans")
