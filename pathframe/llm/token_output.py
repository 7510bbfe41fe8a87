"""Token ids as Arrow stream files of fixed-size-list batches.

The ids of all documents, in ascending id order, make one long stream, cut
into sequences of equal length.  A file holds the sequences of one range of
documents as an Arrow IPC stream: record batches of ``batch_rows`` rows with
``ids: fixed_size_list<uint16|uint32>[length]`` and ``mask:
fixed_size_list<bool>[length]`` (bit-packed; false on the padding that ends
a file).  All batches but the last have the same number of bytes, so the
place of a sequence follows from its number, and :class:`SequenceFile` maps a
file and returns views without copying.  Beside it a second stream file lists
the file's documents: id, first token, number of tokens.

Tasks write under names of their own attempt and the returned manifest, which
is checkpointed, names the files that count: a task that runs again leaves at
most files that nothing names.  Files go to a folder that driver and
executors share, through ``pyarrow.fs``.

Null text is empty and gets the end id alone; null ids come first; repeated
rows are each written.  An empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathframe.llm.common import cut, shared_dir, tidy

#: Words whose ids a worker keeps; a longer word is encoded each time.
CACHE_WORDS, CACHE_CHARS = 600_000, 48
#: Text that is split and looked up at once.
PIECE_BYTES = 1 << 20
_RUNS = re.compile(r"[^\W\d_]+|[0-9]|[\W_]+")
#: Latin letters and ASCII signs: what these classes and the tokenizer's agree on.
_SIMPLE = re.compile(r"[\x21-\x7EÀ-ÖØ-öø-įı-ſ]+")
#: New words that are encoded as one text.
TOGETHER = 2000


class Encoder:
    """Ids of texts, as little-endian uint32 bytes.

    ``by_words`` is for tokenizers that lower-case, drop white space and never
    join over it: then a text's ids are those of its words, most of which
    repeat.  New words go to the tokenizer as one text, and where its
    vocabulary marks word ends the ids are cut at the marks.
    """

    def __init__(self, path: str, by_words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words
        self.cache: dict[str, bytes] = {"": b""}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.plain = self.tokenizer
        if by_words:
            known = json.loads(self.tokenizer.to_str())
            if suffix := known["model"].get("end_of_word_suffix"):
                self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
            # The same model for words that are normal already: nothing is folded, only blanks divide.
            steps = known["pre_tokenizer"] or {}
            levels = [x for x in steps.get("pretokenizers", [steps]) if x.get("type") == "ByteLevel"]
            known |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *levels]}}
            self.plain = Tokenizer.from_str(json.dumps(known))

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return self._ids(self.tokenizer, texts)

    def _encode_words(self, words: list[str], tokenizer) -> list[bytes]:
        """Ids of words of letters only, many at a time."""
        out: list[bytes] = []
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            ids = self._ids(tokenizer, [" ".join(some)])[0]
            stops = (4 * np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 4).tolist()
            # Each word ends at least once: as many ends as words are one each.
            if len(stops) == len(some) and stops[-1] == len(ids):
                out += (ids[a:b] for a, b in zip([0, *stops], stops, strict=False))
            else:
                out += self._encode(some)
        return out

    def _learn(self, words: set[str]) -> None:
        cache = self.cache
        plain = [w for w in words if w.isalpha()]
        # Between letters and other signs a word always ends, but for contractions.
        mixed = {w: _RUNS.findall(w) for w in words.difference(plain) if "'" not in w and "<|" not in w and _SIMPLE.fullmatch(w)}
        parts = set(chain.from_iterable(mixed.values())).difference(cache, plain)
        plain += [p for p in parts if p.isalpha()]
        other = [*parts.difference(plain), *words.difference(plain, mixed)]
        normal = [w for w in plain if w.islower() and (w.isascii() or _SIMPLE.fullmatch(w))]
        rest = list(set(plain).difference(normal)) if len(normal) < len(plain) else []
        cache.update(zip(normal, self._encode_words(normal, self.plain), strict=True))
        cache.update(zip(rest, self._encode_words(rest, self.tokenizer), strict=True))
        cache.update(zip(other, self._encode(other), strict=True))
        cache.update([(w, b"".join(map(cache.__getitem__, runs))) for w, runs in mixed.items()])

    @staticmethod
    def _split(text: str) -> list[str]:
        """Parts whose ids add up to the text's: nothing that the tokenizer joins is cut."""
        try:
            text.encode("latin-1")
            text = text.lower()  # as the tokenizer does, letter by letter here
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._encode(texts)
        cache = self.cache
        split = [self._split(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(cache)
        kept = len(cache)
        self._learn(new)
        found = [b"".join(map(cache.__getitem__, words)) for words in split]
        if kept >= CACHE_WORDS:
            # Frequent words come early; once the cache is full, later ones stay for one call.
            while len(cache) > kept:
                cache.popitem()
        else:
            for w in new:
                if len(w) > CACHE_CHARS:
                    del cache[w]
        return found


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, by_words: bool) -> Encoder:
    if (path, by_words) not in _encoders:
        _encoders[path, by_words] = Encoder(path, by_words)
    return _encoders[path, by_words]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``PIECE_BYTES``, a row at least."""
    first, size = 0, 0
    for i, v in enumerate(batch.column(1)):
        size += v.as_buffer().size if v.is_valid else 0
        if size >= PIECE_BYTES:
            yield batch.slice(first, i + 1 - first)
            first, size = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def sequence_schema(length: int, dtype: str) -> pa.Schema:
    kind = pa.uint16() if dtype == "uint16" else pa.uint32()
    made = {"length": str(length), "dtype": dtype}
    return pa.schema([("ids", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))], metadata=made)


DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Packs ids into sequences and writes full batches as they come."""

    def __init__(self, system: fs.FileSystem, path: str, length: int, dtype: str, batch_rows: int):
        self.length, self.rows, self.np = length, batch_rows, np.dtype(dtype)
        self.schema = sequence_schema(length, dtype)
        self.sink = system.open_output_stream(path)
        self.docs_sink = system.open_output_stream(path + ".docs")
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.docs_out = pa.ipc.new_stream(self.docs_sink, DOC_SCHEMA)
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_tokens = self.n_docs = 0
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n_tokens, len(ids)))
        self.n_tokens += len(ids)
        self.n_docs += 1
        self.pending.append(ids.astype(self.np))
        self.n_pending += len(ids)
        if self.n_pending >= self.length * self.rows:
            self._flush(False)
        if len(self.docs) >= 10_000:
            self._flush_docs()

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, self.np)
        full = self.length * self.rows
        at = 0
        while len(ids) - at >= full:
            self._batch(ids[at : at + full], full)
            at += full
        rest = ids[at:]
        if last and len(rest):
            n = -(-len(rest) // self.length) * self.length
            self._batch(np.concatenate([rest, np.zeros(n - len(rest), self.np)]), len(rest))
            rest = rest[:0]
        self.pending, self.n_pending = [rest.copy()], len(rest)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema, strict=True)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def _flush_docs(self) -> None:
        if self.docs:
            self.docs_out.write_batch(pa.record_batch([pa.array(c, t) for c, t in zip(zip(*self.docs), DOC_SCHEMA.types, strict=True)], schema=DOC_SCHEMA))
            self.docs = []

    def close(self) -> None:
        self._flush(True)
        self._flush_docs()
        for x in (self.out, self.docs_out, self.sink, self.docs_sink):
            x.close()


class SequenceFile:
    """Random access to the sequences of one file, without copying where the file can be mapped."""

    def __init__(self, path: str, folder: str | None = None):
        system, at = _open(path)
        self.source = pa.memory_map(at) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(at)
        reader = pa.ipc.open_stream(self.source)
        self.schema = reader.schema
        self.length = int(self.schema.metadata[b"length"])
        self.dtype = np.dtype(self.schema.metadata[b"dtype"].decode())
        self.head = self.source.tell()
        first = pa.ipc.read_message(self.source) if self.head < self.source.size() else None
        self.stride = self.source.tell() - self.head
        self.rows = pa.ipc.read_record_batch(first, self.schema).num_rows if first and first.type == "record batch" else 0

    def batch(self, k: int) -> pa.RecordBatch:
        """Record batch ``k``: its place is ``head + k * stride``."""
        self.source.seek(self.head + k * self.stride)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i``."""
        batch, at = self.batch(i // self.rows), i % self.rows
        ids, mask = (batch.column(c).values.slice(at * self.length, self.length) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def batches(self) -> Iterator[tuple[np.ndarray, int]]:
        """Ids of each batch, flat, and how many of them are real."""
        self.source.seek(0)
        for batch in pa.ipc.open_stream(self.source):
            yield batch.column(0).values.to_numpy(), batch.column(1).values.true_count

    def close(self) -> None:
        self.source.close()


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    end_id: int | None = None,
    by_words: bool = False,
    length: int = 1024,
    batch_rows: int = 256,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write the files; the manifest ``(part, path, n_docs, n_tokens, base)``, ``base`` being the ids of all files before.

    ``tokenizer`` is the path of a tokenizer file that every worker has.
    Documents are dealt by ranges of their id, so each file holds one range.
    """
    spark = docs.sparkSession
    folder = f"{(folder or shared_dir(spark)).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    with open(tokenizer) as f:
        known = json.load(f)
    top = max([*known["model"]["vocab"].values(), *(t["id"] for t in known.get("added_tokens", [])), end_id or 0])
    dtype = "uint16" if top < 1 << 16 else "uint32"
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder = _encoder(tokenizer, by_words)
        system, at = _open(folder)
        system.create_dir(at)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.arrows"
        out = None
        for b in batches:
            for part in _pieces(b):
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                out = out or SequenceWriter(system, f"{at}/{name}", length, dtype, batch_rows)
                for doc_id, found in zip(part.column(0).to_pylist(), ids, strict=True):
                    out.add(doc_id, np.frombuffer(found + end, "<u4"))
            tidy()
        if out:
            out.close()
            yield pa.record_batch([[task.partitionId()], [f"{folder}/{name}"], [out.n_docs], [out.n_tokens]], names=["part", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    files = cut(ordered.mapInArrow(write, "part bigint, path string, n_docs bigint, n_tokens bigint"))
    return files.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` in the whole stream, ``n_tokens`` and ``ids_crc32``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _documents(path, base)

    n = max(1, manifest.count())
    return manifest.select("path", "base").repartition(n, "path").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _documents(path: str, base: int) -> Iterator[pa.RecordBatch]:
    file = SequenceFile(path)
    system, at = _open(path)
    ids = file.batches()
    have = np.empty(0, file.dtype)
    with system.open_input_stream(at + ".docs") as source:
        for docs in pa.ipc.open_stream(source):
            sums = []
            for n in docs.column(2).to_pylist():
                parts = []
                while n:
                    if not len(have):
                        batch, real = next(ids)
                        have = batch[:real]
                    parts.append(have[:n])
                    have = have[n:]
                    n -= len(parts[-1])
                crc = 0
                for p in parts:
                    crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                sums.append(crc)
            starts = np.asarray(docs.column(1)) + base
            yield pa.record_batch([docs.column(0), pa.array(starts), docs.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    file.close()
