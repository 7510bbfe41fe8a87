"""Repeated substrings by a depth-limited radix sort of suffixes.

A string of ``window`` bytes that starts in two places is a pair of suffixes
that agree to that depth.  Suffixes are split by most significant digit first,
a digit being a hash of a stretch of their bytes, and a group of one is done;
after the passes that reach the depth, equal groups are the repeated windows.

To sort few suffixes, each window is represented by an anchor in it: the
leftmost position whose ``gram`` of bytes hashes least.  Equal windows have
equal anchors at equal offsets.  Consecutive windows with one anchor are an
interval, about one in 140 bytes.  The passes:

1. the anchor's gram: an interval whose gram is nowhere else is done;
2. all bytes of the interval's windows: equal ones are repeated as a whole;
3. per block of 16 offsets, the bytes that its windows share (else done) and
   all bytes of its windows (equal: repeated);
4. the windows of blocks that are left, one by one.

From pass to pass a group of equal stretches is carried by one member, so hot
groups stay small; groups are counted, never gathered.  Each pass is an
aggregation over hashes, combined before the shuffle.  Hashes are of 64 bits
beside a 64-bit gram.

Matches never cross documents.  Null text is empty; documents shorter than a
window keep all bytes; repeated rows are repeats of each other.  Rows with a
null id are treated like any other.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathframe.llm.common import cut, release, tidy

#: Offsets per block, pass by pass; the last must be 1.
STEPS = (16, 1)
#: Positions that one call orders; longer texts are cut with an overlap of a window.
CHUNK = 1 << 22
#: Document keys up to which a broadcast narrows the texts that are shuffled, at 24 bytes each.
MAX_BROADCAST_KEYS = 1_000_000

# Odd 64-bit multipliers with well-mixed bits.
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_SHIFTS = [np.uint64(x) for x in (29, 31, 30, 32)]
_PLACE = np.uint64((1 << 24) - 1)


def gram_words(window: int) -> int:
    """Eight-byte words of a gram."""
    if window < 16:
        raise ValueError("a window has 16 bytes at least")
    return max(1, min(4, window // 16))


def _gram_hashes(buf: np.ndarray, words: int) -> np.ndarray:
    n = len(buf) - 8 * words + 1
    at = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    h = np.zeros(n, np.uint64)
    for k in range(words):
        h += at[8 * k : 8 * k + n]
        h *= _MULTIPLIERS[k]
        h ^= h >> _SHIFTS[k]
    return h


def _sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: prefix and suffix minima of blocks."""
    n = len(g)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = g
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def intervals(text: bytes, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last window, anchor and gram of each interval of ``text``."""
    words = gram_words(window)
    for base in range(0, max(0, len(text) - window + 1), CHUNK):
        buf = np.frombuffer(text, np.uint8, min(len(text) - base, CHUNK + window - 1), base)
        h = _gram_hashes(buf, words)
        # The place in the low bits makes the leftmost of equals least, and is read back from the minimum.
        least = _sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), window - 8 * words + 1)
        anchor = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        anchor = anchor[first]
        yield first + base, last + base, anchor + base, h[anchor].view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _digest(piece: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(piece))


def _bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


#: A range of windows: the first; how many more, in the low 32 bits of ``place``, and how far the anchor is, above them.
_INTERVALS = "k1 bigint, k2 bigint, lo bigint, place bigint, gram bigint, c bigint"


def _classes(place: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A hash of what equal ranges share: the offsets and all bytes."""
    with np.errstate(over="ignore"):
        h = (place.astype(np.uint64) + _MULTIPLIERS[3]) * _MULTIPLIERS[0]
        h ^= h >> _SHIFTS[0]
        h = (h ^ whole.view(np.uint64)) * _MULTIPLIERS[1]
        return (h ^ (h >> _SHIFTS[1])).view(np.int64)


def _scan(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for k1, k2, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = _bytes(value)
                for lo, hi, a, gram in intervals(text, window):
                    whole = np.fromiter((_digest(text[x : y + window]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)), np.int64, len(lo))
                    place = (hi - lo) | (a - lo) << 32
                    for c, x in zip(columns, (np.full(len(lo), k1), np.full(len(lo), k2), lo, place, gram, _classes(place, whole)), strict=True):
                        c.append(x)
            if columns[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in columns], names=["k1", "k2", "lo", "place", "gram", "c"])
                tidy()

    return run


_BLOCKS = "k1 bigint, k2 bigint, single boolean, lo bigint, place bigint, gram bigint, core bigint, c bigint"


def _split(window: int, step: int):
    """Blocks of ``step`` offsets of the given windows.

    ``core`` is a hash of the gram, the block and the bytes that all its
    windows share; ``c`` adds which windows there are and all their bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, value, ranges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                text = _bytes(value)
                out = []
                for r in ranges:
                    first, gram = r["lo"], r["gram"]
                    last, a = first + (r["place"] & 0xFFFFFFFF), first + (r["place"] >> 32)
                    for q in range((a - last) // step, (a - first) // step + 1):
                        # Offsets from q * step: a window is at the anchor less its offset.
                        lo, hi = max(first, a - q * step - step + 1), min(last, a - q * step)
                        shared = xxhash.xxh3_64_intdigest(text[a - q * step : a - q * step - step + 1 + window], q & 0xFFFFFFFF)
                        core = _signed(xxhash.xxh3_64_intdigest(shared.to_bytes(8, "little"), gram & 0xFFFFFFFFFFFFFFFF))
                        whole = core if step == 1 else _digest(text[lo : hi + window])
                        out.append((k1, k2, r["single"], lo, (hi - lo) | (a - lo) << 32, gram, core, whole))
                if out:
                    columns = [np.array(c, bool if i == 2 else np.int64) for i, c in enumerate(zip(*out, strict=True))]
                    columns[7] = _classes(columns[4], columns[7])
                    yield pa.record_batch([pa.array(c) for c in columns], names=["k1", "k2", "single", "lo", "place", "gram", "core", "c"])

    return run


def _texts(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row a document key in ``ranges``, with its text and its ranges."""
    lists = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("single", "lo", "place", "gram")).alias("ranges"))
    lists = cut(lists)
    if lists.count() <= MAX_BROADCAST_KEYS:
        docs = docs.join(F.broadcast(lists.select("k1", "k2")), ["k1", "k2"], "left_semi")
    # Copies of a text are one key: its text is taken once.
    texts = docs.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    return texts.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "ranges")


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """``(k1, k2, lo, more)``: of each text key, windows ``lo`` to ``lo + more`` occur more than once.

    ``docs(k1, k2, text)``; a range may be given in parts and more than once.
    """
    spark = docs.sparkSession
    long = docs.where(F.octet_length("text") >= window)
    found = long.select("k1", "k2", "text").mapInArrow(_scan(window), _INTERVALS)
    groups = found.groupBy("gram", "c").agg(F.count("*").alias("n"))
    left = _kept(found, groups, "gram")
    place = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("more")
    repeated = [left.where("n > 1").select("k1", "k2", "lo", place)]
    ranges = _next(left.withColumn("single", F.lit(True)), "gram")
    for step in STEPS:
        texts = _texts(docs, ranges)
        del found, groups, left, ranges
        release(spark)
        found = cut(texts.mapInArrow(_split(window, step), _BLOCKS))
        # A member that stands for a group counts as the two that it had at least.
        groups = found.groupBy("core", "c").agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("n"))
        del texts
        release(spark)
        if step == 1:
            left = found.where("single").join(groups.where("n > 1").select("core", "c"), ["core", "c"])
            repeated.append(cut(left.select("k1", "k2", "lo", place)))
            break
        left = _kept(found, groups, "core")
        repeated.append(left.where("single and n > 1").select("k1", "k2", "lo", place))
        ranges = _next(left, "core")
    out = repeated[0]
    for r in repeated[1:]:
        out = out.unionByName(r)
    return out


def _kept(rows: DataFrame, groups: DataFrame, digit: str) -> DataFrame:
    """Rows whose digit occurs again, with ``n`` of their class and whether the digit has a class of one."""
    # None is null; but the join would say so to one of both uses, and the shuffle under them not be shared.
    groups = groups.where(F.col(digit).isNotNull() & F.col("c").isNotNull())
    digits = groups.groupBy(digit).agg(F.sum("n").alias("in_all"), (F.min("n") == 1).alias("has_single")).where("in_all > 1")
    return cut(rows.join(groups.join(digits, digit).select(digit, "c", "n", "has_single"), [digit, "c"]))


def _next(left: DataFrame, digit: str) -> DataFrame:
    """What the next pass splits: classes of one, and one member of each class that may meet them."""
    fields = ("k1", "k2", "single", "lo", "place", "gram")
    one = left.where("n > 1 and has_single").groupBy(digit, "c").agg(F.min(F.struct("k1", "k2", "lo", "place", "gram")).alias("m"))
    stand = one.select("m.k1", "m.k2", F.lit(False).alias("single"), "m.lo", "m.place", "m.gram")
    return left.where("n = 1").select(*fields).unionByName(stand)


def merge_ranges(ranges: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Bytes that the windows ``lo`` to ``hi`` of each range cover, as maximal runs."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + window)
        else:
            out.append([lo, hi + window])
    return [(a, b) for a, b in out]


def _remove(window: int):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, spans, kept = [], [], []
            for value, ranges in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                text = _bytes(value)
                gone = merge_ranges([(r["lo"], r["lo"] + r["more"]) for r in ranges or ()], window)
                edges = [0, *(x for s in gone for x in s), len(text)]
                sizes.append(len(text))
                spans.append([{"start": x, "end": y} for x, y in gone])
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.record_batch(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
            )
            tidy()

    return run


def remove_repeats(docs: DataFrame, window: int = 400, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: removed byte ranges and the bytes that are left, for every row of ``docs``."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id).cast("bigint").alias("doc_id"), F.xxhash64(value).alias("k1"), F.xxhash64(F.lit(1), value).alias("k2"), value.alias("text")
    )
    lists = cut(repeated_windows(rows, window).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "more")).alias("ranges")))
    release(docs.sparkSession)
    joined = rows.join(lists, ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_remove(window), "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
