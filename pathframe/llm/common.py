"""Shared pieces of the corpus operators: checkpoints, bit sets, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the GNU C library; others have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

#: A-Z and a-z, for lower-casing ASCII only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only on one machine, where ``spark.checkpoint.dir`` is unset, a temporary
    folder takes its place; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pathframe-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage: later stages survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once a row.

    A column that is named twice may be inlined twice by the optimizer, and
    inside a lambda once an element; a lambda variable never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def tidy() -> None:
    """Give back what Arrow's allocator and the C library hold unused: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def release(spark: SparkSession) -> None:
    """Free the disk of passes that are over.

    Shuffle and checkpoint files go when the driver collects the objects that
    stand for them, which else may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Have executors return the heap that passes before left empty.

    A heap grows towards its limit with every pass and stays so large, beside
    the memory of Python workers and native code; a full collection returns
    what is empty.  A task a core reaches each executor that is idle, so most
    heaps are collected more than once, at about 0.1 s each.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


# -- bit sets ---------------------------------------------------------------


def bit_words(keys: DataFrame, hashes: list[Column], bits: int) -> dict[int, int]:
    """Non-zero 64-bit words of a Bloom filter over ``keys``.

    At most ``bits / 64`` rows reach the driver; the caller bounds ``bits``.
    """
    at = keys.select(F.explode(F.array(*[F.pmod(h, F.lit(bits)) for h in hashes])).alias("b"))
    words = at.groupBy(F.shiftright("b", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("b") % 64).cast("int"))).alias("v")
    )
    return {r.w: r.v for r in words.collect()}


def words_literal(words: dict[int, int], bits: int) -> Column:
    """The filter as one constant array: the optimizer folds the cast once."""
    text = ",".join(str(words.get(i, 0)) for i in range(bits // 64))
    return F.split(F.lit(text), ",").cast("array<bigint>")


def bits_set(filter_words: Column, hashes: list[Column], bits: int) -> Column:
    """Whether all bits of the hashes are set; later ones only if earlier are."""
    hit = F.lit(True)
    for h in reversed(hashes):
        one = let(
            F.pmod(h, F.lit(bits)),
            lambda b: F.call_function(
                "shiftright", F.element_at(filter_words, F.shiftright(b, 6).cast("int") + 1), (b % 64).cast("int")
            ).bitwiseAND(F.lit(1))
            == 1,
        )
        hit = F.when(one, hit).otherwise(F.lit(False))
    return hit


# -- connected components -----------------------------------------------------


def connected_components(edges: DataFrame, rounds: int = 60, small_heaps: bool = False) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``: the smallest node reachable.

    Large-star and small-star rounds: every round replaces a node's edges by
    edges to its smallest neighbour, so the edge count never grows, and the
    number of rounds is logarithmic in the longest path.  Minima are combined
    before the shuffle and the joins have plain keys, so a hub is split.
    Each round is checkpointed and the files of its shuffles are freed, so disk
    does not grow with rounds; with ``small_heaps`` executors' heaps do not grow
    either.  Loops and repeated edges are allowed; nulls are dropped.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    spark = e.sparkSession
    state = None
    for _ in range(rounds):
        if e.isEmpty():
            return spark.createDataFrame([], "node bigint, component bigint")
        # Large star: each larger neighbour of a node goes to the smallest one around it.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        # Small star: smaller neighbours of a node, and it, go to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = new
        release(spark)
        if small_heaps:
            give_back(spark)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
