"""SimHash near-dedup through a Gray-order hierarchical index.

A fingerprint bit is 1 where over half of a document's shingle hashes have it.
Equal fingerprints are one class.  Two classes within ``max_bits`` differing
bits agree in at least one of ``max_bits + 1`` bit segments, so every class is
put into one cell a segment, keyed by the segment's bits; with more classes
the segments get shorter and cells are keyed by several of them, each choice
once, so that cells stay small while no pair is lost.

In a cell the search goes through the index: classes are sorted by Gray rank,
runs of ``FAN`` neighbours make nodes that hold the bits all members share,
and nodes of nodes hold the bits shared further up.  From the root down a
query adds the differences in the bits that a node factors out beyond those of
its parent; a node whose sum passes ``max_bits`` is pruned with all below it.
Cells of any size are dealt in bounded groups (:mod:`pathframe.llm.tiles`),
and a group returns a spanning forest of its links, not all pairs.

Null or empty text has no shingles: fingerprint zero, linked like any other.
Rows with a null id get a fingerprint, connect like any other, and have the
component of their class, which is null if all ids of it are.  Repeated rows are in one class.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathframe.llm.common import LOWER, UPPER, connected_components, cut, give_back, release, tidy
from pathframe.llm.tiles import deal, each_group, spanning

FAN = 8
TILE_ROWS = 4096
#: Shingles in a tile of texts that are compared, on average, and bytes of them that a task holds.
TILE_SHINGLES, HELD_BYTES = 1 << 20, 32 << 20
#: Text keys up to which a broadcast narrows the texts that are verified, at 8 bytes each.
MAX_BROADCAST_KEYS = 1_000_000
#: Bands of least hashes, and orders in a band: of pairs with Jaccard similarity 0.8, (1 - 0.8 ** 6) ** 32 share no band.
BANDS, BAND_ORDERS = 32, 6
_ORDERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND_ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, words: int) -> int:
    """The fingerprint as an unsigned number."""
    return int(_fingerprint((text or "").encode(), words))


def _fingerprint(text: bytes, words: int) -> np.uint64:
    parts = text.translate(_LOW).split()
    return _majority(_hashes(parts, words)) if parts else np.uint64(0)


def _hashes(parts: list[bytes], words: int) -> np.ndarray:
    """A hash of each run of ``words`` parts; of all of them where they are fewer."""
    whole = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(whole, 42)], "<u8")
    ends, at = [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    begins = [0, *(e + 1 for e in ends)]
    return np.array([digest(whole[a:b], 42) for a, b in zip(begins, ends[words - 1 :])], "<u8")  # noqa: B905


def _majority(hashes: np.ndarray, chunk: int = 1 << 16) -> np.uint64:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), chunk):
        some = hashes[k : k + chunk]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<u8")[0]


def band_keys(hashes: np.ndarray, chunk: int = 1 << 9) -> np.ndarray:
    """A key for each of ``BANDS`` bands: the least of the hashes in ``BAND_ORDERS`` orders.

    Two sets of Jaccard similarity ``J`` agree on an order's least hash with
    probability ``J``.
    """
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), chunk):
        np.minimum(least, np.multiply.outer(_ORDERS, hashes[k : k + chunk]).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ORDERS).T:
        keys = (keys ^ column) * _ORDERS[0]
        keys ^= keys >> np.uint64(29)
    return keys


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, id_type: str = "bigint") -> DataFrame:
    """``(doc_id, f)``, ``f`` being the fingerprint's 64 bits as a bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_fingerprint((t.as_buffer().to_pybytes() if t.is_valid else b""), words) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(np.array(found, "<u8").view("<i8"))], names=["doc_id", "f"])
            tidy()

    return docs.select(F.col(id).cast(id_type).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, f bigint")


def segment_choices(classes: int, max_bits: int, cell_rows: int = TILE_ROWS) -> list[list[tuple[int, int]]]:
    """Choices of ``(shift, width)`` segments, so that close fingerprints agree on all of one choice.

    With ``m`` segments at most ``max_bits`` differ, so ``m - max_bits`` agree.
    ``m`` is the least for which random fingerprints fill cells up to
    ``cell_rows``.
    """
    for m in range(max_bits + 1, max_bits + 5):
        edges = [64 * k // m for k in range(m + 1)]
        segments = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        fixed = min(sum(sorted(w for _, w in segments)[: m - max_bits]), 62)
        if classes >> fixed <= cell_rows:
            break
    return [list(c) for c in combinations(segments, m - max_bits)]


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Rank of a code word in Gray order: the number whose Gray code it is."""
    rank = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Nodes over fingerprints that are sorted by group and Gray rank; one root a group."""

    def __init__(self, f: np.ndarray, starts: np.ndarray):
        n = len(f)
        ends = np.append(starts[1:], n)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        both, some = f, f
        first, last = starts, ends  # of each group, in the level below
        while True:
            counts = -(-(last - first) // FAN)
            total = int(counts.sum())
            group = np.repeat(np.arange(len(first)), counts)
            top = np.cumsum(counts) - counts
            child = first[group] + FAN * (np.arange(total) - top[group])
            stop = np.minimum(child + FAN, last[group])
            both, some = np.bitwise_and.reduceat(both, child), np.bitwise_or.reduceat(some, child)
            self.levels.append((~(both ^ some), both, child, stop))
            first, last = top, top + counts
            if (counts <= 1).all():
                break
        self.f = f

    def pairs(self, queries: np.ndarray, groups: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions ``(query, member)`` within ``max_bits``, members after their query."""
        q, node = queries, groups
        shared, pattern, child, stop = self.levels[-1]
        upper = np.zeros(len(q), np.uint64)
        sums = np.zeros(len(q), np.uint8)
        for k in range(len(self.levels) - 1, -1, -1):
            shared, pattern, child, stop = self.levels[k]
            own = shared[node] & ~upper
            sums = sums + np.bitwise_count((self.f[q] ^ pattern[node]) & own)
            # Members before the query are found from the other side.
            keep = sums <= max_bits
            q, node, sums = q[keep], node[keep], sums[keep]
            width = stop[node] - child[node]
            at = np.repeat(np.cumsum(width) - width, width)
            below = np.arange(int(width.sum())) - at + np.repeat(child[node], width)
            q, sums, upper = np.repeat(q, width), np.repeat(sums, width), np.repeat(shared[node], width)
            node = below
        after = node > q
        q, node, sums, upper = q[after], node[after], sums[after], upper[after]
        near = sums + np.bitwise_count((self.f[q] ^ self.f[node]) & ~upper) <= max_bits
        return q[near], node[near]


def _links(max_bits: int, at_once: int = 1024):
    def body(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        f = table.column("f").to_numpy().view("<u8")
        rep = table.column("rep").to_numpy()
        n = len(f)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        order = np.lexsort((gray_rank(f), group))
        f, rep = f[order], rep[order]
        index = GrayIndex(f, starts)
        labels = np.arange(n)
        for k in range(0, n, at_once):
            queries = np.arange(k, min(n, k + at_once))
            i, j = spanning(labels, *index.pairs(queries, group[queries], max_bits))
            yield pa.record_batch([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

    return body


def near_links(nodes: DataFrame, count: int, max_bits: int) -> DataFrame:
    """``(a, b)``: links between ``nodes(f, rep)``, enough of them to connect whatever is linked."""
    choices = segment_choices(count, max_bits)
    cells = []
    for i, choice in enumerate(choices):
        parts = [F.shiftrightunsigned("f", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in choice]
        cells.append(F.xxhash64(F.lit(i), *parts))
    members = nodes.select("f", "rep", F.explode(F.array(*cells)).alias("cell"), F.xxhash64("f").alias("spread"))
    dealt = deal(members, "cell", "spread", TILE_ROWS).select("g", "f", "rep")
    return each_group(dealt, _links(max_bits), "a bigint, b bigint")


def near_classes(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(f, component)`` for ``prints(doc_id, f)``: the smallest id of all classes reachable, null without one."""
    classes = cut(prints.groupBy("f").agg(F.min("doc_id").alias("low")))
    found = connected_components(near_links(classes.select("f", F.col("f").alias("rep")), classes.count(), max_bits))
    # Stored, so that the join deals both sides anew and can split a large component.
    joined = cut(classes.join(found, classes.f == found.node, "left").select("f", "low", F.coalesce("component", "f").alias("c")))
    lows = cut(joined.groupBy("c").agg(F.min("low").alias("component"), F.count("*").alias("n")).where("n > 1").select("c", "component"))
    return joined.join(lows, "c", "left").select("f", F.coalesce("component", "low").alias("component"))


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    prints = cut(fingerprints(docs, id, text, words))
    return (
        prints.join(near_classes(prints, max_bits), "f")
        .select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
    )


def text_key(text: Column) -> Column:
    """Equal texts have one key."""
    return F.xxhash64(text)


def _prints(keyed: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """``(id, h, f, bands)`` from the word shingles of lower-cased texts; ``h`` is ``_pf_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [_hashes(_parts(t), words) for t in b.column(2)]
            f = np.array([_majority(x) for x in hashes], "<u8").view("<i8")
            bands = np.concatenate([band_keys(x) for x in hashes] or [np.empty(0, np.uint64)]).view("<i8")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS), pa.int32()), pa.array(bands))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(f), lists], names=["id", "h", "f", "bands"])
            tidy()

    rows = keyed.select(F.col(id).cast("bigint").alias("id"), F.col("_pf_text").alias("h"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "id bigint, h bigint, f bigint, bands array<bigint>")


def _parts(text: pa.Scalar) -> list[bytes]:
    return text.as_buffer().to_pybytes().decode(errors="replace").lower().encode().split() if text.is_valid else []


def band_links(nodes: DataFrame) -> DataFrame:
    """``(a, b)`` for ``nodes(h, bands)``: the smallest member of each band's cell with each other one."""
    members = nodes.select("h", F.explode("bands").alias("cell"))
    # Stored, so that the join deals both sides anew and can split a large cell.
    heads = cut(members.groupBy("cell").agg(F.min("h").alias("a"), F.count("*").alias("n")).where("n > 1").select("cell", "a"))
    return members.join(heads, "cell").where("a < h").select("a", F.col("h").alias("b"))


def _sets(found: DataFrame, words: int) -> DataFrame:
    """``(h, s, n)`` for ``found(h, t)``: the different shingle hashes and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(_hashes(_parts(t), words)).view("<i8") for t in b.column(1)]
            sizes = np.array([len(x) for x in sets], np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets or [np.empty(0, np.int64)])))
            yield pa.record_batch([b.column(0), lists, pa.array(sizes)], names=["h", "s", "n"])
            tidy()

    return found.mapInArrow(run, "h bigint, s array<bigint>, n bigint")


def similar_sets(values: np.ndarray, offsets: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that connect all sets linked by a Jaccard similarity of at least ``similarity``.

    Set ``i`` is ``values[offsets[i]:offsets[i + 1]]``, without repeats.  A set
    that was reached is compared with all that were not, so every pair is
    compared or already connected.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    member = np.repeat(np.arange(n), sizes)
    _, word, times = np.unique(values[offsets[0] : offsets[-1]], return_inverse=True, return_counts=True)
    shared = times[word] > 1
    word, member = word[shared], member[shared]
    own = np.searchsorted(member, np.arange(n + 1))
    left = np.ones(n, bool)
    count, posted = n, 2 * n + 1  # sets not reached, now and when the postings were made
    postings = at = np.empty(0, np.int64)
    reached: list[int] = []
    first = 0
    taken_i, taken_j = [], []
    while count:
        if reached:
            q = reached.pop()
        else:
            first += int(left[first:].argmax())
            q = first
            left[q] = False
            count -= 1
        if 2 * count < posted:
            open_ = left[member]
            order = np.argsort(word[open_], kind="stable")
            postings, posted = member[open_][order], count
            at = np.searchsorted(word[open_][order], np.arange(len(times) + 1))
        w = word[own[q] : own[q + 1]]
        width = at[w + 1] - at[w]
        total = int(width.sum())
        if not total:
            continue
        where = np.repeat(at[w] - (np.cumsum(width) - width), width) + np.arange(total)
        both = np.bincount(postings[where], minlength=n)
        # The tolerance is for products that are whole but not in floating point.
        near = np.flatnonzero(left & (both > 0) & (both + 1e-9 >= similarity * (sizes + sizes[q] - both)))
        left[near] = False
        count -= len(near)
        reached += near.tolist()
        taken_i.append(np.full(len(near), q))
        taken_j.append(near)
    empty = np.empty(0, np.int64)
    return (np.concatenate(taken_i), np.concatenate(taken_j)) if taken_i else (empty, empty)


def _verified(similarity: float):
    def body(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        h = table.column("h").to_numpy()
        sets = table.column("s").combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        for a, b in zip(starts, np.append(starts[1:], len(h)), strict=True):
            i, j = similar_sets(values, offsets[a : b + 1].astype(np.int64), similarity)
            yield pa.record_batch([pa.array(h[a + i]), pa.array(h[a + j])], names=["a", "b"])
        tidy()

    return body


def similar_links(members: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links between ``members(h, s, n, block)`` of one block that are similar, enough to connect whatever is linked.

    Every two members of a block meet in a tile and are compared there, or
    known to be connected.
    """
    dealt = deal(members.withColumn("spread", F.xxhash64("h")), "block", "spread", TILE_ROWS, "n", TILE_SHINGLES)
    return each_group(dealt.select("g", "h", "s"), _verified(similarity), "a bigint, b bigint", held_bytes=HELD_BYTES)


def drop_near_copies(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, max_bits: int = 8, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one document of each group of near copies, all columns kept.

    Texts whose fingerprints are within ``max_bits``, or that share a band of
    least shingle hashes, are candidates.  What candidates connect is a block,
    and in it all are compared: only texts whose sets of word shingles have a
    Jaccard similarity of at least ``similarity`` are joined.  Groups are what
    such pairs and equal texts connect; the document with the smallest id
    stays.  Rows with one id and equal texts are one document, whatever else
    they hold; rows with a null id come after all others of their group.  Null,
    empty and blank texts have no word: they are one group, with no other text.
    """
    keyed = docs.withColumn("_pf_text", text_key(F.col(text))).withColumn("_pf_check", F.xxhash64(F.lit(1), F.col(text)))
    # Different texts of one key, of which there may be a few in 10^10, get a key from both hashes.
    sums = keyed.groupBy(F.col("_pf_text").alias("_pf_key")).agg(F.min("_pf_check").alias("low"), F.max("_pf_check").alias("high"))
    clashes = cut(sums.where("low <> high").select("_pf_key", "low"))
    if not clashes.isEmpty():
        again = F.when(F.col("_pf_check") != F.col("low"), F.xxhash64("_pf_text", "_pf_check")).otherwise(F.col("_pf_text"))
        keyed = keyed.join(clashes, F.col("_pf_text") == F.col("_pf_key"), "left").withColumn("_pf_text", again).drop("_pf_key", "low")
    keyed = keyed.drop("_pf_check")
    prints = cut(_prints(keyed, id, text, words))
    nodes = cut(prints.groupBy("h").agg(F.first("f").alias("f"), F.first("bands").alias("bands")))
    links = near_links(nodes.select("f", F.col("h").alias("rep")), nodes.count(), max_bits).unionByName(band_links(nodes))
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release(docs.sparkSession)
    give_back(docs.sparkSession)
    blocks = cut(connected_components(links, small_heaps=True))
    wanted = blocks.select(F.col("node").alias("_pf_text"))
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_KEYS else wanted
    found = keyed.join(wanted, "_pf_text", "left_semi").groupBy(F.col("_pf_text").alias("h")).agg(F.first(text).alias("t"))
    sets = cut(_sets(found, words))
    members = sets.join(blocks, sets.h == blocks.node).select("h", "s", "n", F.col("component").alias("block"))
    near = cut(similar_links(members, similarity))
    release(docs.sparkSession)
    give_back(docs.sparkSession)
    parts = connected_components(near, small_heaps=True)
    rows = prints.join(parts, prints.h == parts.node, "left").select("id", "h", F.coalesce("component", "h").alias("g"))
    order = F.struct(F.col("id").isNull().alias("z"), "id", "h")
    # Stored, so that the join deals both sides anew and can split a large group.
    groups = cut(rows.groupBy("g").agg(F.min(order).alias("m"), F.count("*").alias("n")).where("n > 1"))
    gone = rows.join(groups, "g").where(~(F.col("id").eqNullSafe(F.col("m.id")) & (F.col("h") == F.col("m.h"))))
    gone = cut(gone.select(F.col("id").alias("_pf_id"), F.col("h").alias("_pf_h")).distinct())
    kept = keyed.join(gone, keyed[id].cast("bigint").eqNullSafe(gone["_pf_id"]) & (keyed["_pf_text"] == gone["_pf_h"]), "left_anti")
    if not prints.groupBy("id", "h").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id, "_pf_text"])
    return kept.drop("_pf_text")
