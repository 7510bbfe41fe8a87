"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import os
import time

import numpy as np
import pytest

from pathframe.llm import chat_format, common, decontaminate, embed_dedup, mixing, pii, simhash_dedup, suffix_dedup, token_output, toxicity, url_filter
from pathframe.llm.common import connected_components

LONG = "word " * 30_000
ROWS = [(1, "a b c d e f g h i j k", "en", "s1"), (1, "a b c d e f g h i j k", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (None, "x y", "fr", None), (4, LONG, "en", "s2"), (5, LONG, "en", "s2"), (6, "é È ñ", "es", "s2")]
CLASH = "size long, k1 long, rule string, h long, w string, spans string, f long, n_hit long, items string, start long, score double, key string, extra long, row string, text_ string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for name, kind in (c.split() for c in CLASH.split(", ")):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_suffix(docs, none):
    got = {(r.doc_id, r.n_bytes): sum(s.end - s.start for s in r.spans) for r in suffix_dedup.remove_repeats(docs, 400).collect()}
    assert got[4, 150_000] == got[5, 150_000] == 150_000 and got[2, 0] == 0 and got[1, 21] == 0
    assert suffix_dedup.remove_repeats(docs, 16).where("doc_id = 1").collect()[0].spans[0].asDict() == {"start": 0, "end": 21}
    assert suffix_dedup.remove_repeats(none, 400).count() == 0


@pytest.mark.parametrize("window", [16, 40, 64])
def test_suffix_on_few_letters(spark, window):
    import random

    from test_queries import covered

    random.seed(window)
    base = ["".join(random.choices("ab", k=200)) for _ in range(4)] + ["a" * 300, "abc" * 90]
    texts = ["".join(random.choice(base)[a : a + random.randint(0, 120)] for a in random.choices(range(150), k=random.randint(0, 5))) for _ in range(40)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window).collect()}
    for i, m in enumerate(covered([t.encode() for t in texts], window)):
        assert sum(s.end - s.start for s in got[i].spans) == m.sum()


def test_long_texts_are_cut_with_an_overlap(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    text = np.random.default_rng(1).integers(97, 123, 5000).astype(np.uint8).tobytes()
    parts = list(suffix_dedup.intervals(text, 64))
    windows = [x for lo, hi, _, _ in parts for a, b in zip(lo, hi, strict=True) for x in range(a, b + 1)]
    assert windows == list(range(5000 - 64 + 1))


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, "B C d e f g h i j k"), (2, "x. Y"), (None, None), (3, "")], "item_id long, text string")
    carried = decontaminate.scan(docs, bench)
    joined = decontaminate.scan(docs, bench, max_carried_bytes=0)
    key = lambda df: sorted((r.doc_id or -1, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect())
    assert key(carried) == key(joined)
    assert (1, 11, 10, ("1",)) in key(carried) and (-1, 2, 2, ("2",)) in key(carried) and (2, 0, 0, ()) in key(carried)
    clean = {r.doc_id: r.text for r in decontaminate.remove_spans(carried).collect()}
    assert clean[1] == "a" + " " * 10 and clean[6] == "é È ñ"
    assert decontaminate.remove_documents(carried).count() == len(ROWS) - 3
    assert decontaminate.scan(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.scan(none, bench).count() == 0


def test_mixing(docs, none, monkeypatch):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in rows)
    monkeypatch.setattr(mixing, "BIN_ROWS", 0)
    again = mixing.mix_sources(docs).collect()
    for s in {r.source for r in rows}:
        assert sum(r.taken for r in rows if r.source == s) == sum(r.taken for r in again if r.source == s)
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns


def test_urls(spark):
    rows = [(1, "http://a.com/x", "r"), (1, "http://a.com/x", "r"), (2, None, None), (3, "", None), (4, "HTTPS://A.COM", None), (5, "x://b.a.com/y?z", None), (6, "a" * 50_000 + "://q.com/" + "y" * 50_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = [url_filter.UrlRule("a.com", "/", "block"), url_filter.UrlRule("b.a.com", "/y", "allow")]
    got = sorted((r.page_id, r.host[:9], r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect())
    joined = sorted((r.page_id, r.host[:9], r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, max_filter_bytes=0).collect())
    key = [(1, "a.com", "a.com/", "block")] * 2 + [(2, "", None, "allow"), (3, "", None, "allow"), (4, "a.com", None, "allow"), (5, "b.a.com", "b.a.com/y", "allow"), (6, "q.com", None, "allow")]
    assert got == joined == key
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0
    assert url_filter.judge_urls(pages, []).where("verdict = 'allow'").count() == len(rows)


def test_cascade_is_exact_over_its_universe(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    listed = keys.where("cast(key as long) % 7 = 0")
    c = url_filter.build_cascade(listed, keys, bits_per_key=4)
    assert len(c.bits) > 2
    assert keys.where(c.contains(F.col("key"))).count() == listed.count()
    assert keys.where(c.contains(F.col("key")) != (F.col("key").cast("long") % 7 == 0)).count() == 0


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    v = np.concatenate([base, base[:20] + 0.05 * rng.normal(size=(20, 8)), base[:3]])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] * 4), (None, rows[0][1]), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {}
    good = [(i, np.array(x)) for i, x in rows if i is not None and x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    for a, (i, x) in enumerate(good):
        exact[i] = sum(len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95 for b, (_, y) in enumerate(good) if a != b)
    for values, rows_in_tile, pivots in ((embed_dedup.TILE_VALUES, embed_dedup.TILE_ROWS, 1024), (16 * 8, (1, 16), 8)):
        monkeypatch.setattr(embed_dedup, "TILE_VALUES", values)
        monkeypatch.setattr(embed_dedup, "TILE_ROWS", rows_in_tile)
        got = embed_dedup.near_vectors(df, 0.95, max_pivots=pivots).collect()
        assert len(got) == len(rows)
        assert {r.vec_id: r.n_links for r in got if r.vec_id in exact} == exact
        assert all(r.n_links == 0 for r in got if r.vec_id in (None, 900, 901, 902, 903))
        assert {r.component_id for r in got if r.vec_id == 905} == {904}
    assert embed_dedup.near_vectors(df.where("false")).count() == 0
    from pyspark.sql import functions as F

    clash = df.select("*", *[F.lit("x").alias(c) for c in ("k1", "k2", "ok", "v", "rep", "n", "dim", "spread", "cell", "component_id", "n_links", "node")])
    assert {r.vec_id: r.n_links for r in embed_dedup.near_vectors(clash).collect() if r.vec_id in exact} == exact


def test_quantisation_bound_holds():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2000))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embed_dedup.quantise(u)
    near = embed_dedup.tile_products(q, q) * s[:, None] * s[None]
    assert (np.abs(near - u @ u.T) <= e[:, None] + (1 + e[:, None]) * e[None] + 1e-9).all()


def test_simhash(docs, none):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect())
    by = {i: (f, c) for i, f, c in got}
    assert len(got) == len(ROWS) and by[4] == by[5] and by[2][0] == "0" * 16 and by[2][1] == by[3][1] == 2
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    # Null and empty texts are alike.
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 4, 6]
    assert simhash_dedup.drop_near_copies(none).count() == 0


def test_a_class_without_ids_connects(spark):
    """Fingerprints 0, 15 and 255: the middle one has no id."""
    prints = spark.createDataFrame([(5, 0), (None, 15), (3, 255), (9, 1 << 40), (None, -1)], "doc_id long, f long")
    got = {r.f: r.component for r in simhash_dedup.near_classes(prints, 4).collect()}
    assert got == {0: 3, 15: 3, 255: 3, 1 << 40: 3, -1: None}


def test_texts_of_one_key_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash_dedup, "text_key", lambda text: F.length(text).cast("bigint"))
    rows = [(1, "one two three four five six"), (2, "six five four three two one"), (3, "one two three four five six"), (4, "other"), (5, "hello"), (6, "other")]
    kept = simhash_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]


def near_components(texts, similarity, words=5):
    """The smallest index that pairs of at least ``similarity`` lead to, by comparing all."""
    sets = [frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) for w in map(str.split, texts)]
    parts = list(range(len(texts)))
    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if parts[i] != parts[j] and len(x & y) >= similarity * len(x | y):
                low, high = sorted((parts[i], parts[j]))
                parts = [low if p == high else p for p in parts]
    return parts


def varied(rnd, text, changes):
    words = text.split()
    for k in rnd.sample(range(len(words)), changes):
        words[k] = f"x{rnd.random()}"
    return " ".join(words)


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9, 0.95])
def test_near_copies_equal_brute_force(spark, similarity):
    import random

    rnd = random.Random(similarity)
    texts = []
    for _ in range(150):
        base = " ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(40, 200)))
        texts += [base, varied(rnd, base, rnd.randint(0, 4))]
    want = near_components(texts, similarity)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash_dedup.drop_near_copies(df, similarity=similarity).collect())
    assert kept == sorted(set(want)) and len(kept) < len(texts)


def families(rnd):
    """Texts of dense families, many pairs of a family under 0.8 and many over."""
    texts = []
    for _ in range(12):
        base = " ".join(f"w{rnd.randrange(3000)}" for _ in range(100))
        family = [varied(rnd, base, 3) for _ in range(5)]
        texts += family + [varied(rnd, t, rnd.randint(1, 4)) for t in family for _ in range(3)]
    return texts


@pytest.mark.parametrize("tile", [4096, 100])
def test_dense_families_equal_brute_force(spark, monkeypatch, tile):
    import random

    monkeypatch.setattr(simhash_dedup, "TILE_ROWS", tile)
    rnd = random.Random(2)
    base = " ".join(f"w{rnd.randrange(3000)}" for _ in range(100))
    crowd = [varied(rnd, base, 2) for _ in range(300)]
    texts = families(rnd) + crowd + [varied(rnd, t, 1) for t in crowd]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash_dedup.drop_near_copies(df, similarity=0.9).collect())
    assert kept == sorted(set(near_components(texts, 0.9)))


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9])
def test_similar_sets_connect_all_similar_pairs(similarity):
    import random

    rnd = random.Random(6)
    texts = [*families(rnd), "lone words", "lone words", "other"]
    rnd.shuffle(texts)
    sets = [np.unique(simhash_dedup._hashes(t.encode().split(), 5)) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    parts = list(range(len(texts)))
    for i, j in zip(*simhash_dedup.similar_sets(np.concatenate(sets), offsets, similarity), strict=True):
        low, high = sorted((parts[i], parts[j]))
        parts = [low if p == high else p for p in parts]
    assert parts == near_components(texts, similarity)


@pytest.mark.parametrize("bits", [0, 1, 4, 6])
def test_gray_index_finds_all_pairs(bits):
    rng = np.random.default_rng(bits)
    f = rng.integers(0, 2**64, 300, dtype=np.uint64)
    f[100:200] = f[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    group = np.repeat([0, 1, 2], [150, 1, 149])
    order = np.lexsort((simhash_dedup.gray_rank(f), group))
    f = f[order]
    index = simhash_dedup.GrayIndex(f, np.array([0, 150, 151]))
    i, j = index.pairs(np.arange(300), group, bits)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if group[a] == group[b] and int(f[a] ^ f[b]).bit_count() <= bits}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("classes", [10, 10**7, 10**10])
def test_close_fingerprints_share_a_cell(classes):
    rng = np.random.default_rng(0)
    choices = simhash_dedup.segment_choices(classes, 4)
    for _ in range(200):
        x = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(all(x >> s & ((1 << w) - 1) == 0 for s, w in c) for c in choices)


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (2, 0), (77, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert not model.terms
    assert toxicity.score_documents(docs, model).count() == len(ROWS)
    texts = [(i, f"some plain words here number{i}", 0) for i in range(200)] + [(200 + i, f"you are a vile blockhead person{i}", 1) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int"))
    score = {w: model.score(f"just a {w} in town") for w in ("blockhead", "bl0ckhead", "blokchead", "b.l.o.c.k.h.e.a.d", "blockhat", '"blockhead"')}
    assert score["blockhead"] > 0.5 and score["bl0ckhead"] > 0.5 and score["blokchead"] > 0.5 and score["b.l.o.c.k.h.e.a.d"] > 0.5
    assert score["blockhat"] < 0.5 and score['"blockhead"'] < score["blockhead"]
    assert model.score(None) == model.score("") < 0.5
    assert toxicity.fit(none, labels).score("x") == 0.5 and toxicity.score_documents(none, model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def cost(word, term):
    """Least cost of edits between them: a look-alike sign 1, all else 2, swaps of neighbours included."""
    d = {}
    for i in range(len(word) + 1):
        for j in range(len(term) + 1):
            if not i or not j:
                d[i, j] = 2 * max(i, j)
                continue
            x, y = word[i - 1], term[j - 1]
            v = min(d[i - 1, j] + 2, d[i, j - 1] + 2, d[i - 1, j - 1] + (0 if x == y else 1 if y in toxicity.SIGNS.get(x, "") else 2))
            if i > 1 and j > 1 and x == term[j - 2] and word[i - 2] == y and x != y:
                v = min(v, d[i - 2, j - 2] + 2)
            d[i, j] = v
    return d[len(word), len(term)]


def matched(model, word):
    """``(term, cost)`` of a word by comparing every form of it with every term."""
    core = word.strip(toxicity._STRIP)
    tail = core.rstrip("!|+*$")
    if tail in model.innocent or core in model.innocent:
        return None
    for k, t in enumerate(model.terms):
        if t.word == tail and not t.stem:
            return k, 0
    best = None
    for form in dict.fromkeys((core, tail, toxicity._INNER.sub("", core), toxicity._RUN.sub(r"\1", core), toxicity._RUN.sub(r"\1\1", core))):
        if len(form) < 3:
            continue
        found = []
        for k, t in enumerate(model.terms):
            c = cost(form, t.word)
            if c <= (2 if len(t.word) >= toxicity.FUZZY_LETTERS and not t.stem else 1):
                found.append((c, 0, 0, k))
            if t.stem and len(t.word) <= len(form):
                head = form[: len(t.word)]
                signs = [0 if x == y else 1 if y in toxicity.SIGNS.get(x, "") else 9 for x, y in zip(head, t.word, strict=True)]
                if sum(signs) < 2:
                    found.append((sum(signs), 1, len(head), k))
        if found and (best is None or min(found)[0] < best[1]):
            best = min(found)[3], min(found)[0]
    return best


def scored(model, text):
    """The score by all pairs of words and terms, and all windows."""
    import math
    import re

    words = text.lower().split()
    found = {i: m for i, m in enumerate(matched(model, w) for w in words) if m is not None}
    quoted, at = set(), 0
    spoken = [m.span() for m in re.finditer(r"\S+", text)]
    for m in re.finditer(r"\"[^\"\n]+\"|“[^“”\n]+”|«[^«»\n]+»", text):
        quoted |= {i for i, (a, b) in enumerate(spoken) if a < m.end() and m.start() < b}
    weights = {}
    for i, (k, c) in found.items():
        term = model.terms[k]
        w = (term.more if sum(x[0] == k for x in found.values()) > 1 else term.once) * (1 - 0.1 * c)
        told = any(x.strip(toxicity._STRIP) in toxicity.REPORTING for x in words[max(0, i - 2) : i])
        weights[i] = w * toxicity.QUOTED if i in quoted or told and words[i][0] in "\"“«„‘'" else w
    best = 0.0
    for last in weights:
        near = sorted((w for i, w in weights.items() if 0 <= last - i <= toxicity.WINDOW), reverse=True)
        best = max(best, near[0] + 0.25 * sum(near[1:]))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, model.base + best))))


def test_scores_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    plain = [f"{a}{b}{c}" for a in ("lo", "ma", "ter", "sun", "pi") for b in ("ra", "mon", "del", "v") for c in ("el", "ta", "ido", "sk")]
    bad = ["idiot", "blockhead", "scum", "wretched", "moronic"]
    rows = []
    for i in range(400):
        words = rnd.choices(plain, k=rnd.randint(3, 30))
        if i % 4 == 0:
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert {t.word for t in model.terms if not t.stem} >= {"idiot", "blockhead"}
    texts = [t for _, t, _ in rows[:40]] + ["", "idiot " * 14, "“" + "idiot " * 60 + "”", "she said \"idiot\" and left", "x" * 5000 + " 1diot", "i-d-i-o-t!!! blokchead", "«scum» " * 9]
    for _ in range(200):
        words = rnd.choices(plain, k=25)
        for _ in range(rnd.randint(1, 16)):
            w = list(rnd.choice(bad))
            for _ in range(rnd.randint(0, 2)):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randint(0, 2)] = rnd.choice(["", "x", "1", "$", "oi", "i"])
            words[rnd.randrange(25)] = rnd.choice(["{}", "\"{}\"", "said \"{}", "{}!!", "({})"]).format("".join(w))
        texts.append(" ".join(words))
    for t in texts:
        assert model.score(t) == pytest.approx(scored(model, t), abs=1e-12), t


def test_nothing_is_capped(spark):
    """Long words are features, and quotations of any length are quotations."""
    long = "abominable" * 5
    rows = [(i, f"plain words number{i}", 0) for i in range(200)] + [(200 + i, f"you {long} person{i}", 1) for i in range(40)]
    model = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert model.score(long) > 0.5 and model.score("\"" + "so " * 200 + long + "\"") < 0.5


def test_automaton_equals_edit_distance():
    import random

    random.seed(4)
    terms = ["idiot", "moron", "scum", "disgusting"]
    m = toxicity.TermMatcher([(t, False) for t in terms])

    def distance(a, b):
        d = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                v = max(i, j) if min(i, j) == 0 else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    v = min(v, d[i - 2, j - 2] + 1)
                d[i, j] = v
        return d[len(a), len(b)]

    for _ in range(3000):
        w = list(random.choice(terms))
        for _ in range(random.randint(0, 2)):
            k, how = random.randrange(len(w)), random.randint(0, 2)
            if how == 0 and len(w) > 1:
                w.pop(k)
            elif how == 1:
                w.insert(k, random.choice("abcdimorst"))
            else:
                w[k] = random.choice("abcdimorst")
        w = "".join(w)
        want = any(w == t or len(t) >= 5 and w[0] == t[0] and distance(w, t) <= 1 for t in terms)
        assert bool(m.match(w)) == want, w


def test_first_letters_are_edited_too():
    from itertools import product

    term = "idiot"
    m = toxicity.TermMatcher([(term, False), ("scum", False), ("disgust", True)], first=True)
    letters = "abdiostx"
    once = {term[:k] + term[k + 1 :] for k in range(5)} | {term[:k] + x + term[k + 1 :] for k, x in product(range(5), letters)}
    once |= {term[:k] + x + term[k:] for k, x in product(range(6), letters)} | {term[:k] + term[k + 1] + term[k] + term[k + 2 :] for k in range(4)}
    assert {"diiot", "xidiot", "diot", "xdiot"} <= once
    assert all(m.match(w) is not None for w in once)
    assert not any(m.match(w) for w in ("xxidiot", "iot", "xdiox", "xscum", "cum", "csum", "isgusting", "xdisgusting"))
    model = toxicity.ToxicityModel([toxicity.Term("blockhead", False, 6.0, 6.0)], -3.0)
    assert all(model.score(f"just a {w} in town") > 0.5 for w in ("blockhead", "lbockhead", "lockhead", "xblockhead", "clockhead"))
    assert toxicity.ToxicityModel(model.terms, -3.0, frozenset({"clockhead"})).score("a clockhead") < 0.5


def test_tokens(spark, docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    files = token_output.write_token_files(docs, path, folder=str(tmp_path), end_id=2, by_words=True, length=16, batch_rows=4)
    rows = sorted(token_output.read_documents(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6]
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [1, 1]
    plain = Tokenizer.from_file(path)
    texts = {r[0]: r[1] or "" for r in ROWS}
    stream = [i for r in rows for i in [*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]]
    at = 0
    for f in sorted(files.collect(), key=lambda r: r.part):
        one = token_output.SequenceFile(f.path)
        for k in range(-(-f.n_tokens // 16)):
            ids, mask = one.sequence(k)
            real = min(16, f.n_tokens - 16 * k)
            assert ids[:real].tolist() == stream[at : at + real] and mask.true_count == real
            at += real
    assert at == len(stream)
    assert token_output.read_documents(token_output.write_token_files(none, path, folder=str(tmp_path), end_id=2)).count() == 0
    whole = token_output.write_token_files(docs, path, folder=str(tmp_path), end_id=2, by_words=False)
    assert sorted(r.ids_crc32 for r in token_output.read_documents(whole).collect()) == sorted(r.ids_crc32 for r in rows)


def test_words_encode_as_texts():
    import random

    import public_tokenizers

    e = token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"), True)
    random.seed(3)
    signs = ["a", "B", "É", "é", "İ", "Σ", "ß", "'s", "don't", "1", "2.", ".", ",", "!", "…", "<|endoftext|>", "ª", "日本", "\u0301", "\u00a0", " ", " ", "\n", "\t", "Ǆ", "x.y", "😀", "they're.", "_."]
    texts = ["".join(random.choices(signs, k=random.randint(0, 25))) for _ in range(4000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want


def test_pii(docs, none):
    rows = pii.find_pii(docs).collect()
    assert len(rows) == len(ROWS) and all(r.spans == [] for r in rows)
    assert pii.find_pii(none).count() == 0


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write mmp.98 [at] mail2 [dot] example [dot] com now", [("email", "mmp.98 [at] mail2 [dot] example [dot] com")]),
        ("joe at example dot com", [("email", "joe at example dot com")]),
        ("look at example.com please", []),
        ("mаrу@ехаmple.com", [("email", "mаrу@ехаmple.com")]),
        ("ｍary＠example.com", [("email", "ｍary＠example.com")]),
        ("call plus one eight three six five five five nine three three one ok", [("phone", "plus one eight three six five five five nine three three one")]),
        ("192[.]168[.]1[.]20 host", [("ip", "192[.]168[.]1[.]20")]),
        ("one nine two dot one six eight dot one dot seven", [("ip", "one nine two dot one six eight dot one dot seven")]),
        ("pay 4１11 1111 1111 11１1 now", [("card", "4１11 1111 1111 11１1")]),
        ("+1 (836) 555-9331 4913187196670932 end", [("card", "4913187196670932"), ("phone", "+1 (836) 555-9331")]),
        ("un un un un un un un un un un un", []),
        ("the cat at the door. It was dot", []),
    ],
)
def test_disguises(text, found):
    assert [(k, text[a:b]) for k, a, b in pii.find_spans(text)[1]] == found


@pytest.mark.parametrize(
    "text",
    [
        "call +1 555 one two 34567 now",
        '"double five six seven one two three four nine": x',
        "joe.b at\texample.com",
        "joe.b\nat example.com",
        "joe\t@\texample.com",
        "joe@\nexample.com",
        "joe-AT-example-dot-com",
        "call +1 555-one (two) 34567",
        "plus one ſix two three ſeven eight nine one two",
    ],
)
def test_hidden_from_the_hints(text, monkeypatch):
    gated = pii.find_spans(text)
    assert gated[1]
    monkeypatch.setattr(pii, "_disguised", lambda *_: True)
    assert gated == pii.find_spans(text)


def test_hints_hide_nothing(monkeypatch):
    import random

    random.seed(8)
    tokens = ["joe.b", "mary7", "x_y", "example", "com", "at", "AT", "arroba", "@", ".", "dot", "punkt", "(a)", "[at]", "{dot}", "_at_", "-at-", "example.com", "a.b.org", "+1", "plus", "555", "34567", "O1l0", "one", "two", "Three", "double", "fünf", "sİx", "ſeven", "zéro", "4111", "1111", "192", "168", "the", "call", ":", '"']
    gaps = [" ", " ", " ", "", "\t", "\n", "  ", ",", "-", ".", "/", "(", ")", "\u00a0", "_"]
    texts = ["".join(random.choice(tokens) + random.choice(gaps) for _ in range(random.randint(1, 14))) for _ in range(20_000)]
    gated = [pii.find_spans(t) for t in texts]
    monkeypatch.setattr(pii, "_disguised", lambda *_: True)
    assert [t for t, g in zip(texts, gated, strict=True) if g != pii.find_spans(t)] == []


def test_redact():
    _, spans = pii.find_spans("a@b.co or 1.2.3.4")
    assert pii.redact("a@b.co or 1.2.3.4", spans) == "<email> or <ip>"


def test_chat(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no <|im_end|>"), (1, 1, "assistant", "no <|im_end|>"), (2, 0, None, None), (4, 0, "user", "x"), (5, 0, "user", "x"), (None, 1, "user", "z"), (6, None, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.pair_id, r.part, r.turn): r for r in chat_format.format_neighbours(turns).collect()}
    assert set(got) == {(0, "prompt", 0), (0, "chosen", 1), (0, "rejected", 1), (1, "chosen", 0), (2, "prompt", 0)}
    chosen = got[0, "chosen", 1]
    assert chosen.rendered[chosen.masked_chars :][: chosen.trained_chars] == "yes<|im_end|>"
    assert "no < |im_end|><|im_end|>" in got[0, "rejected", 1].rendered
    assert not got[1, "chosen", 0].paired and got[2, "prompt", 0].paired and got[0, "prompt", 0].trained_chars == 0
    pairs = spark.createDataFrame([(9, 1, 0), (8, 77, 2)], "pair_id long, chosen long, rejected long")
    named = {(r.pair_id, r.part, r.turn) for r in chat_format.format_preferences(turns, pairs).collect()}
    assert named == {(9, "prompt", 0), (9, "chosen", 1), (9, "rejected", 1), (8, "rejected", 0)}
    assert chat_format.format_neighbours(turns.where("false")).count() == 0


def test_components(spark):
    import random

    random.seed(1)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(350)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5200)]
    parts = {}

    def root(x):
        while parts.setdefault(x, x) != x:
            x = parts[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parts[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame([*edges, (None, 1), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {x: root(x) for x in {y for e in edges for y in e if e[0] != e[1]}}
    assert connected_components(df.where("false")).count() == 0


def test_ids_of_items_hold_any_sign(spark):
    ids = ["a,b", "a", "b", "t\tx", "l\nx", "r\rx", "50%2C", None]
    bench = spark.createDataFrame([(i, "one two three") for i in ids], "item_id string, text string")
    docs = spark.createDataFrame([(1, "say one two three four")], "doc_id long, text string")
    for limit in (1 << 20, 0):
        assert decontaminate.scan(docs, bench, max_carried_bytes=limit).first()["items"] == sorted(i or "" for i in ids)


def test_spans_that_meet_are_decided_in_time(monkeypatch):
    import time

    text = ("call 5 5 5 one two three four five six seven, " * 3000) + "a@b.co " * 3000
    began = time.process_time()
    plain, spans = pii.find_spans(text)
    assert len(plain) == 3000 and len(spans) >= 3000 and time.process_time() - began < 20


def test_mixing_cuts_rows_without_ids(spark):
    rows = [(None, f"w{i} x", "s") for i in range(200)] + [(7, f"v{i} x y", "t") for i in range(100)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_epochs=1.5)
    assert {r.extra for r in got.where("source = 's'").collect()} >= {0, 2}
    taken = {r.source: (r.t, r.target) for r in got.groupBy("source").agg({"taken": "sum", "target": "max"}).toDF("source", "t", "target").collect()}
    assert all(abs(a - b) <= 1 for a, b in taken.values())


@pytest.mark.parametrize("most", [0, 100_000])
def test_weights_go_by_turns_over_many_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", most)
    sources = [None, *{f"s{k * 7919 % 1000}" for k in range(500)}, "é", "Z", "", "😀", "\uffee"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame([(s,) for s in sources], "source string").repartition(3)
        got = {r.source: r.weight for r in mixing.cyclic_weights(table).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = [*sorted(s for s in sources if s is not None), None]
    assert got == {s: 1.0 + k % 3 for k, s in enumerate(order)}


def test_pipeline_stages_hold_edge_rows(spark, docs, none, small):
    """Null, empty, long and repeated rows go through every stage; empty tables give empty ones."""
    import corpus_pipeline as P

    for table in (docs, none):
        rows = table
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, rows, small)
            assert out.columns == table.columns, name
            rows = spark.createDataFrame(out.collect(), out.schema)
        index = P.STAGES[-1][1](spark, rows, small).collect()
        assert len(index) == rows.count()
        assert (rows.count() == 0) == (table is none)


@pytest.mark.parametrize("size", [50_000])
def test_chat_of_long_turns(spark, size):
    rows = [(0, 0, "user", "q " * size), (0, 1, "assistant", "yes " * size), (1, 0, "user", "q " * size), (1, 1, "assistant", "no " * size)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    clash = df.select("*", *[F.lit("x").alias(c) for c in ("pair", "side", "segment", "rendered", "mask", "k", "h")])
    a, b = (sorted(map(str, chat_format.format_neighbours(t).collect())) for t in (df, clash))
    assert a == b and len(a) >= 3


def test_pipeline_stages_begin_with_collected_heaps(spark, docs, small):
    """What a stage leaves in the executors' heaps, here the driver's own, doesn't add up through the stages."""
    import corpus_pipeline as P

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    for name, stage in P.STAGES:
        before = full()
        stage(spark, docs, small)
        assert full() > before, name


def test_near_copies_collect_heaps_between_rounds(spark, monkeypatch):
    """Both component passes of the near-dedup keep the executors' heaps small while they go on."""
    called = []
    monkeypatch.setattr(common, "give_back", lambda session: called.append(session))
    words = " ".join(f"w{i}" for i in range(100))
    near = spark.createDataFrame([(1, words), (2, words + " more"), (3, words + " and more")], "doc_id long, text string")
    assert [r.doc_id for r in simhash_dedup.drop_near_copies(near).collect()] == [1]
    assert len(called) >= 2


def test_components_free_the_shuffles_of_rounds(spark, monkeypatch):
    """Disk holds the shuffle files of a round or two, not of all rounds."""
    context = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    tops = [d.getPath() for d in context.blockManager().diskBlockManager().localDirs()]
    there = lambda: {f for top in tops for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    common.release(spark)
    time.sleep(2)
    seen, made, old, cut = [], set(), there(), common.cut

    def watched(df):
        out = cut(df)
        time.sleep(1)  # files go a little after the objects
        seen.append(len(now := there() - old))
        made.update(now)
        return out

    monkeypatch.setattr(common, "cut", watched)
    path = spark.range(400).selectExpr("id a", "id + 1 b")
    rows = common.connected_components(path).collect()
    assert {r.component for r in rows} == {0} and len(rows) == 401
    assert len(seen) > 5 and max(seen) < 0.5 * len(made), (seen, len(made))
