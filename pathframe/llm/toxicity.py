"""Toxicity: a learned lexicon found through a Levenshtein automaton, scored in context.

Lexicon.  Words and word beginnings, once or repeated, are counted over
labelled documents, each different text once; all whose likelihood ratio is
more than chance are candidates, and greedy choice keeps few terms that
together explain label 1.  What training holds is bounded by its rows alone.  A term is a word, or a
beginning that stands for any word with it, and has a weight for one hit in a
document and another for more.

Matching.  The trie of all terms is intersected with an automaton that allows
a budget of edits: a look-alike sign for a letter costs 1, any other
substitution, insertion, deletion or swap of neighbours costs 2, and a term
has budget 1, or 2 from ``FUZZY_LETTERS`` letters on; beginnings allow look-alikes only.
The product is determinised as words are read, so a word costs a few table
steps, and most die in their first letters.

Score.  Hits within ``WINDOW`` words of each other add up, the strongest whole
and the others in part.  A hit in quotation marks or after a reporting word
counts for ``QUOTED`` of its weight, so a lone quotation stays under 0.5 while
abuse beside it does not.  The best window and the rate of label 1 among
documents without hits give the probability.

Null or empty text has no hits and gets the base probability; documents
without an id are held out of training; repeated rows score alike.  Without
labels of both kinds the lexicon is empty and every score is the rate of label
1, or 0.5 where nothing is labelled.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathframe.llm.common import cut, tidy

#: Labelled rows that training takes at most, the first by a hash of their id.
MAX_TRAINING_ROWS = 20_000
#: Different features that a training task counts before it sends them on.
HELD_FEATURES = 60_000
#: Labels up to which they are sent to every task for the join, at 20 bytes each.
MAX_BROADCAST_LABELS = 1_000_000
#: Lengths of word beginnings.
STEMS = (3, 4, 5, 6, 7, 8)
FUZZY_LETTERS = 5
WINDOW, QUOTED = 12, 0.3

# Signs that stand for letters.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou", "€": "e", "£": "l"}
# Words that report what someone else said.
REPORTING = frozenset("said says say called calls call wrote writes quoted quote word term slur insult insulted dit dijo sagte sagt mot palabra wort".split())
# An opening mark ends the search of one before it, so that a text is passed once.
_QUOTES = re.compile(r"\"[^\"\n]+\"|“[^“”\n]+”|«[^«»\n]+»|„[^„“\n]+“|‘[^‘’\n]+’")
_SPOKEN = re.compile(r"\S+")
_STRIP = ".,;:?()[]{}<>\"“”«»„‘’'`~#%&^/\\=_-…¡¿"
_RUN = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"(?<=\w)[.\-_'’·~]+(?=\w)")


# -- the automaton -------------------------------------------------------------


class TermMatcher:
    """The terms' trie times the edit automaton, determinised lazily.

    With ``first`` a word's first letter may be edited as any other.
    """

    #: States that are kept; then the automaton starts anew.
    LIMIT = 200_000

    def __init__(self, terms: list[tuple[str, bool]], first: bool = False):
        self.first = first
        #: Node: children, term that ends here, and the largest budget below.
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.budgets = []
        self.stem = [s for _, s in terms]
        for k, (word, stem) in enumerate(terms):
            node = 0
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
            if self.ends[node] is None or not stem:
                self.ends[node] = k
            self.budgets.append(1 if stem or len(word) < FUZZY_LETTERS else 2)
        self.most = [0] * len(self.children)
        for k, (word, _) in enumerate(terms):
            node = 0
            for c in word:
                self.most[node] = max(self.most[node], self.budgets[k])
                node = self.children[node][c]
            self.most[node] = max(self.most[node], self.budgets[k])
        self._reset()

    def _reset(self) -> None:
        # A state is a set of (trie node, cost, letter expected after a swap); 0 is the start, -1 dead.
        self.states: list[frozenset] = []
        self.known: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[tuple[int, int] | None] = []
        self._state(self._close({(0, 0, ""): 0}))

    def _close(self, costs: dict[tuple[int, int, str], int]) -> frozenset:
        """With deletions of the next letters of a term; only the cheapest of each."""
        best: dict[tuple[int, str], int] = {}
        todo = [(n, c, w) for n, c, w in costs]
        while todo:
            n, c, w = todo.pop()
            if c > self.most[n] or best.get((n, w), 9) <= c:
                continue
            best[n, w] = c
            if not w and (n or self.first):
                todo += ((m, c + 2, "") for m in self.children[n].values())
        return frozenset((n, c, w) for (n, w), c in best.items())

    def _state(self, s: frozenset) -> int:
        if not s:
            return -1
        if s not in self.known:
            self.known[s] = len(self.states)
            self.states.append(s)
            self.steps.append({})
            ends = sorted((c, self.ends[n]) for n, c, w in s if not w and self.ends[n] is not None and c <= self.budgets[self.ends[n]])
            self.accepts.append(ends[0][::-1] if ends else None)
            stems = [(c, k) for c, k in ends if self.stem[k] and c < 2]
            self.stems.append(stems[0][::-1] if stems else None)
        return self.known[s]

    def _step(self, state: int, x: str) -> int:
        to: dict[tuple[int, int, str], int] = {}
        for n, c, w in self.states[state]:
            if w:
                if x == w[0]:
                    to[int(w[1:]), c, ""] = 0
                continue
            edits = n or self.first
            for y, m in self.children[n].items():
                if x == y:
                    to[m, c, ""] = 0
                elif y in SIGNS.get(x, ""):
                    to[m, c + 1, ""] = 0
                elif edits:
                    to[m, c + 2, ""] = 0
                # Neighbours swapped: x is the letter after y, then y must follow.
                if edits and x != y and x in self.children[m]:
                    to[n, c + 2, y + str(self.children[m][x])] = 0
            if edits:
                to[n, c + 2, ""] = 0
        return self._state(self._close(to))

    def match(self, word: str) -> tuple[int, int] | None:
        """``(term, cost)`` of the best match of the whole word, or of its beginning by a stem."""
        if len(self.states) > self.LIMIT:
            self._reset()
        state, stem = 0, None
        for x in word:
            steps = self.steps[state]
            to = steps.get(x)
            if to is None:
                to = steps[x] = self._step(state, x)
            if to < 0:
                return stem
            state = to
            if self.stems[state] is not None and (stem is None or self.stems[state][1] < stem[1]):
                stem = self.stems[state]
        done = self.accepts[state]
        return min((x for x in (done, stem) if x is not None), key=lambda x: x[1], default=None)


# -- the model -------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    word: str
    stem: bool
    #: For a document's only hit of this term, and for each of more.
    once: float
    more: float


@dataclass
class ToxicityModel:
    """Terms with their weights over ``base``, the log-odds of a document without hits."""

    terms: list[Term]
    base: float
    #: Words near a term that label 0 uses too: no misspellings.
    innocent: frozenset[str] = frozenset()
    _cache: dict | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_cache": None}

    def _lookup(self) -> _Words:
        if self._cache is None:
            self._cache = _Words(self)
        return self._cache

    def hits(self, text: str) -> list[tuple[int, Term, float]]:
        """``(word number, term, weight)``: the weight is less for an inexact match and a quoted one."""
        words = text.lower().split()
        found = [(i, h) for i, h in enumerate(map(self._lookup().__getitem__, words)) if h is not None]
        if not found:
            return []
        quoted: set[int] = set()
        if any(q in text for q in "\"“«„‘"):
            begins = [m.start() for m in _SPOKEN.finditer(text)]
            for m in _QUOTES.finditer(text):
                quoted.update(range(bisect_right(begins, m.start()) - 1, bisect_right(begins, m.end() - 1)))
        out = []
        times = Counter(k for _, (k, _) in found)
        for i, (k, cost) in found:
            term = self.terms[k]
            weight = (term.more if times[k] > 1 else term.once) * (1 - 0.1 * cost)
            told = any(w.strip(_STRIP) in REPORTING for w in words[max(0, i - 2) : i])
            out.append((i, term, weight * QUOTED if i in quoted or told and words[i][:1] in "\"“«„‘'" else weight))
        return out

    def score(self, text: str | None) -> float:
        hits = self.hits(text or "")
        best, first = 0.0, 0
        for last in range(len(hits)):
            while hits[last][0] - hits[first][0] > WINDOW:
                first += 1
            near = sorted((w for _, _, w in hits[first : last + 1]), reverse=True)
            best = max(best, near[0] + 0.25 * sum(near[1:]))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.base + best))))


class _Words(dict):
    """What a word matches; filled as words come, emptied when large.  Longer words are matched each time."""

    LIMIT, KEPT_LETTERS = 150_000, 64

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.matcher = TermMatcher([(t.word, t.stem) for t in model.terms], first=True)
        self.innocent = model.innocent
        self.exact = {(t.word, t.stem): k for k, t in enumerate(model.terms)}

    def __missing__(self, word: str) -> tuple[int, int] | None:
        if len(self) > self.LIMIT:
            self.clear()
        core = word.strip(_STRIP)
        tail = core.rstrip("!|+*$")
        found = None
        if tail in self.innocent or core in self.innocent:
            pass
        elif (tail, False) in self.exact:
            found = self.exact[tail, False], 0
        else:
            forms = dict.fromkeys(x for x in (core, tail, _INNER.sub("", core), _RUN.sub(r"\1", core), _RUN.sub(r"\1\1", core)) if len(x) > 2)
            for x in forms:
                m = self.matcher.match(x)
                if m is not None and (found is None or m[1] < found[1]):
                    found = m
        if len(word) <= self.KEPT_LETTERS:
            self[word] = found
        return found


def _words(text: str) -> Counter:
    return Counter(w.strip(_STRIP + "!|+*$") for w in text.lower().split())


def _features(words: Counter) -> set[tuple[str, bool, bool]]:
    """``(word or beginning, whether it is a beginning, whether it comes more than once)``."""
    out = {(w, False, False) for w in words if w.isalpha() and len(w) >= 3}
    out |= {(w, False, True) for w, n in words.items() if n > 1 and w.isalpha() and len(w) >= 3}
    stems: Counter = Counter()
    for w, times in words.items():
        for n in STEMS:
            if len(w) > n and w[:n].isalpha():
                stems[w[:n]] += times
    out |= {(w, True, False) for w in stems}
    return out | {(w, True, True) for w, n in stems.items() if n > 1}


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_training_rows: int = MAX_TRAINING_ROWS,
) -> ToxicityModel:
    """Learn from ``labels(id, label)``; no other column is looked at.

    At most ``max_training_rows`` labelled rows are taken, the first in the
    order of a hash of the id.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(label).alias("y"))
    n = known.count()
    if n > max_training_rows:
        share = int(max_training_rows / n * (1 << 48))
        known = known.where(F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1 << 48)) < share)
    known = F.broadcast(known) if n <= MAX_BROADCAST_LABELS or max_training_rows <= MAX_BROADCAST_LABELS else known
    sample = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(known, "id")
    # Each different text counts once.
    sample = cut(sample.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").cast("int").alias("y")).select("text", "y"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        ones: Counter = Counter()
        for b in batches:
            for value, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = _features(_words(value.as_py() or ""))
                seen.update(found)
                if y:
                    ones.update(found)
                if len(seen) > HELD_FEATURES:
                    yield _counts(seen, ones)
                    seen.clear()
                    ones.clear()
        yield _counts(seen, ones)

    ys = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = ys.get(1, 0), ys.get(0, 0)
    if not pos or not neg:
        return ToxicityModel([], 0.0 if not pos + neg else math.log((pos + 0.5) / (neg + 0.5)))
    features = sample.mapInArrow(counted, "word string, stem boolean, more boolean, n bigint, t bigint").groupBy("word", "stem", "more")
    telling = cut(features.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where("t >= 3 and 2 * t > n"))
    # So many were tried that the best of them would gain this by chance.
    least = 2 * math.log(max(20, telling.count()))
    rate = pos / (pos + neg)
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0))
    gain = 2 * (part(F.col("t"), F.col("n") * rate) + part(F.col("n") - F.col("t"), F.col("n") * (1 - rate)))
    # As many as the training rows' words give, each found in three documents of label 1 at least.
    names = sorted((r.word, r.stem, r.more) for r in telling.where(gain >= least - 1e-6).select("word", "stem", "more").collect())
    wanted = {k: i for i, k in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(wanted[f] for f in _features(_words(v.as_py() or "")) if f in wanted) for v in b.column(0)]
            yield pa.record_batch([b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["y", "f"])

    rows = [(r.y, r.f) for r in sample.mapInArrow(present, "y int, f array<int>").where(F.size("f") > 0).collect()] if names else []
    table = _Postings(rows, names, pos, neg)
    chosen, open_ones, open_all = _choose(table, least)
    base = math.log((open_ones + 0.5) / (open_all - open_ones + 0.5))
    weights: dict[tuple[str, bool], dict[bool, float]] = {}
    for (w, stem, more), (t, n) in chosen.items():
        weights.setdefault((w, stem), {})[more] = math.log((t + 0.5) / (n - t + 0.5)) - base
    for (w, stem, more), (t, n) in _companions(table, chosen, least).items():
        weights.setdefault((w, stem), {}).setdefault(more, math.log((t + 0.5) / (n - t + 0.5)) - base)
    terms = [Term(w, s, v.get(False, 0.0), max(v.values())) for (w, s), v in weights.items()]
    model = ToxicityModel(terms, base)
    return ToxicityModel(terms, base, _innocent(sample, model))


def _counts(seen: Counter, ones: Counter) -> pa.RecordBatch:
    keys = list(seen)
    kinds = (pa.string(), pa.bool_(), pa.bool_())
    columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
    return pa.record_batch([*columns, pa.array([seen[k] for k in keys], pa.int64()), pa.array([ones[k] for k in keys], pa.int64())], names=["word", "stem", "more", "n", "t"])


class _Postings:
    """Which document has which feature, both ways, in flat arrays."""

    def __init__(self, rows: list[tuple[int, list[int]]], names: list[tuple[str, bool, bool]], pos: int, neg: int):
        self.names, self.pos, self.neg = names, pos, neg
        self.y = np.array([y for y, _ in rows], np.int64)
        widths = np.array([len(f) for _, f in rows], np.int64)
        self.at = np.concatenate([[0], np.cumsum(widths)])
        self.features = np.fromiter((f for _, fs in rows for f in fs), np.int32, int(self.at[-1]))
        docs = np.repeat(np.arange(len(rows), dtype=np.int32), widths)
        order = np.argsort(self.features, kind="stable")
        self.docs = docs[order]
        self.starts = np.searchsorted(self.features[order], np.arange(len(names) + 1))
        self.n = np.diff(self.starts)
        self.t = np.bincount(self.features, np.repeat(self.y, widths), len(names)).astype(np.int64)

    def of(self, feature: int) -> np.ndarray:
        """The documents that have it."""
        return self.docs[self.starts[feature] : self.starts[feature + 1]]

    def within(self, docs: np.ndarray) -> np.ndarray:
        """Positions of the features of ``docs``, document by document."""
        widths = self.at[docs + 1] - self.at[docs]
        return np.repeat(self.at[docs] - (np.cumsum(widths) - widths), widths) + np.arange(int(widths.sum()))

    def gains(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Twice the log likelihood ratio of label 1 among ``n`` documents, ``t`` of them 1, against the rate of all; to six digits."""
        rate = self.pos / (self.pos + self.neg)
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = [np.where(a > 0, a * np.log(a / (n * p)), 0.0) for a, p in ((t, rate), (n - t, 1 - rate))]
        return np.round(2 * (parts[0] + parts[1]), 6)


def _choose(table: _Postings, least: float) -> tuple[dict[tuple[str, bool, bool], tuple[int, int]], int, int]:
    """Greedy cover: the feature with the largest gain over the documents that no chosen one is in.

    With each its documents then, of label 1 and all; and those that are left.
    """
    names, t, n = table.names, table.t.copy(), table.n.copy()
    left = np.ones(len(table.y), bool)
    chosen: dict[tuple[str, bool, bool], tuple[int, int]] = {}
    ones, every = table.pos, table.pos + table.neg
    while len(n):
        gains = np.where(2 * t > n, table.gains(t, n), 0.0)
        best = gains.max()
        if best < least:
            break
        # Of equal gains the longest, and a whole word before a beginning.
        f = max(np.flatnonzero(gains == best).tolist(), key=lambda f: (len(names[f][0]), not names[f][1], not names[f][2], f))
        chosen[names[f]] = (int(t[f]), int(n[f]))
        docs = table.of(f)
        docs = docs[left[docs]]
        left[docs] = False
        ones, every = ones - int(table.y[docs].sum()), every - len(docs)
        at = table.within(docs)
        of_doc = np.repeat(table.y[docs], table.at[docs + 1] - table.at[docs])
        n -= np.bincount(table.features[at], minlength=len(n))
        t -= np.bincount(table.features[at], of_doc, len(n)).astype(np.int64)
    return chosen, ones, every


def _companions(
    table: _Postings,
    chosen: dict[tuple[str, bool, bool], tuple[int, int]],
    least: float,
    precision: float = 0.8,
    common: float = 0.3,
    alike: float = 0.7,
) -> dict[tuple[str, bool, bool], tuple[int, int]]:
    """Features as telling as the chosen ones, that a cover could spare: each may be a document's only hit.

    They must be about as common as chosen ones of their kind.  Words whose
    documents are nearly those of three other words come from copies of one
    text, and are left out.
    """
    names, t, n = table.names, table.t, table.n
    gains = table.gains(t, n)
    number = {name: f for f, name in enumerate(names)}
    typical = {}
    for stem in (False, True):
        of = sorted(int(t[number[c]]) for c in chosen if c[1] == stem)
        typical[stem] = of[len(of) // 2] if of else table.pos
    order = sorted(range(len(names)), key=lambda f: (-gains[f], names[f][1], names[f][2], -len(names[f][0]), names[f][0]))
    good = [f for f in order if gains[f] >= least and (t[f] + 0.5) / (n[f] + 1) >= precision and t[f] >= common * typical[names[f][1]]]
    words = np.zeros(len(names), bool)
    words[[f for f in good if not names[f][1]]] = True

    def twins(f: int) -> int:
        both = np.bincount(table.features[table.within(table.of(f))], minlength=len(names))
        near = np.flatnonzero(words & (both > 0) & (both >= alike * np.maximum(1, n[f] + n - both)))
        return sum(names[g][0] != names[f][0] for g in near.tolist())

    kept = {(w, stem) for w, stem, _ in chosen}
    out: dict[tuple[str, bool, bool], tuple[int, int]] = {}
    for f in good:
        w, stem, more = names[f]
        # A beginning of, or with, one that is kept says the same.
        if (w, stem) not in kept and any((s and w.startswith(v)) or (stem and v.startswith(w)) for v, s in kept):
            continue
        if not stem and twins(f) >= 3:
            continue
        kept.add((w, stem))
        out[w, stem, more] = (int(t[f]), int(n[f]))
    return out


def _innocent(sample: DataFrame, model: ToxicityModel) -> frozenset[str]:
    """Inexact matches that documents with label 0 hold: ordinary words near a term."""
    if not model.terms:
        return frozenset()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = model._lookup()
        for b in batches:
            words = {w for v in b.column(0) for w in _words(v.as_py() or "") if (m := lookup[w]) is not None and m[1]}
            yield pa.record_batch([pa.array(sorted(words), pa.string())], names=["word"])

    found = sample.where("y = 0").select("text").mapInArrow(near, "word string").distinct()
    return frozenset(r.word for r in found.collect())


def score_documents(docs: DataFrame, model: ToxicityModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(v.as_py()) for v in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])
            tidy()

    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score under ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            yield b.filter(pa.array([model.score(v.as_py()) < threshold for v in b.column(at)], pa.bool_()))
            tidy()

    return docs.mapInArrow(run, docs.schema)
