"""Each query against its SQL, or against a brute-force version, over small tables."""

import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import rows_of, sql_rows

from pathframe.llm import queries as Q


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, small, name):
    assert rows_of(Q.QUERIES[name](spark, small)) == sql_rows(small, Q.ORACLES[name])


def covered(texts, window):
    """Bytes of each text under a window that starts in two places."""
    seen, twice = set(), set()
    for t in texts:
        for x in range(len(t) - window + 1):
            w = t[x : x + window]
            (twice if w in seen else seen).add(w)
    out = []
    for t in texts:
        c = np.zeros(len(t) + 1, int)
        for x in range(len(t) - window + 1):
            if t[x : x + window] in twice:
                c[x] += 1
                c[x + window] -= 1
        out.append(np.cumsum(c)[:-1] > 0)
    return out


def test_op1(spark, small, docs):
    ids = sorted(docs)
    texts = [(docs[i].text or "").encode() for i in ids]
    got = {r.doc_id: r for r in Q.op1_suffix_dedup(spark, small).collect()}
    assert len(got) == len(ids)
    for i, t, m in zip(ids, texts, covered(texts, 400), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~m]) if t else b""
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(m.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_op3(spark, small, docs):
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    sources = sorted({d.source for d in docs.values() if d.source is not None})
    sources += [None] * any(d.source is None for d in docs.values())
    weight = {s: 1.0 + k % 3 for k, s in enumerate(sources)}
    of = {s: sum(n for i, n in sizes.items() if docs[i].source == s) for s in sources}
    target, free, left = {}, set(sources), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * of[s]}
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * of[s]
            left -= target[s]
        free -= over
    rows = Q.op3_mix_sources(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    taken = dict.fromkeys(sources, 0)
    for r in rows:
        s = docs[r.doc_id].source
        assert r["size"] == sizes[r.doc_id] and r.source_size == of[s]
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources)
    again = {r.doc_id: r.taken for r in Q.op3_mix_sources(spark, small).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_op7(spark, small, docs):
    f = {}
    for i, d in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        f[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(f)
    parts = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min(parts[j] for j in ids if (f[i] ^ f[j]).bit_count() <= 4)
            if low < parts[i]:
                parts[i], changed = low, True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op7_simhash_dedup(spark, small).collect()}
    assert got == {i: (f"{f[i]:016x}", parts[i]) for i in ids}


def test_op8(spark, small):
    rows = Q.op8_toxicity(spark, small).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_op8_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in Q.op8_toxicity(spark, folder).where("held_out").collect() if r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows)
    assert right / len(rows) > 0.96
    found = sum(r.predicted for r in rows if labels[r.doc_id])
    assert found / sum(labels[r.doc_id] for r in rows) > 0.85


def test_op9(spark, small, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in Q.op9_token_output(spark, small).collect()}
    start = 0
    for i in sorted(docs):
        ids = np.array([*tokenizer.encode(docs[i].text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op10(spark, small, docs):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(d[::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[1::2]) % 10

    def n(s):
        return sum(c.isdigit() for c in s)

    got = {r.doc_id: r for r in Q.op10_pii(spark, small).collect()}
    for i, d in docs.items():
        t = d.text or ""
        base = [
            ("email", [m.span() for m in email.finditer(t)]),
            ("ip", [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]),
            ("card", [m.span() for m in card.finditer(t) if 13 <= n(m[0]) <= 19 and luhn(m[0])]),
            ("phone", [m.span() for m in phone.finditer(t) if 9 <= n(m[0]) <= 15]),
        ]
        text = [f"{k}:{a}:{b}" for k, spans in base for a, b in spans]
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(s) for _, s in base)
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest()
        assert set(text) <= set(r.spans.split(",")) | {""}


def test_pipeline(spark, small, docs):
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{small}/documents.parquet")
    clean = P.drop_toxic(spark, table, small)
    assert clean.columns == table.columns
    once = P.drop_near_copies(spark, clean, small)
    assert once.columns == table.columns and once.count() == once.select("text").distinct().count()
    kept = P.drop_contaminated(spark, once, small)
    from pathframe.llm.decontaminate import scan

    hit = scan(once, spark.read.parquet(f"{small}/benchmark.parquet")).where("n_hit > 0").count()
    assert kept.columns == table.columns and kept.count() == once.count() - hit
    mixed = P.mix(spark, kept, small)
    assert mixed.columns == table.columns
    assert mixed.join(kept.select("doc_id", F.col("text").alias("t")), "doc_id").where("text <> t").count() == 0
    rows = P.run(spark, small).collect()
    assert len(rows) == mixed.count() and sum(r.n_tokens for r in rows) > 0


def test_pipeline_equals_brute_force(spark, small, docs):
    """All rows of the pipeline, from the predictions of op8 on, in plain Python."""
    import corpus_pipeline as P
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    left = sorted(r.doc_id for r in Q.op8_toxicity(spark, small).where("predicted = 0").collect())
    shingles = {}
    for i in left:
        words = (docs[i].text or "").lower().split()
        shingles[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    parts = {i: i for i in left}

    def root(i):
        while parts[i] != i:
            i = parts[i]
        return i

    for n, i in enumerate(left):
        for j in left[:n]:
            if 10 * len(shingles[i] & shingles[j]) >= 8 * len(shingles[i] | shingles[j]):
                a, b = root(i), root(j)
                parts[max(a, b)] = min(a, b)
    left = [i for i in left if root(i) == i]
    assert len(left) < len(parts)

    def words_of(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        words = words_of(r.text)
        windows |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9)) if words}
    lengths = {len(w) for w in windows}
    hit = {i for i in left for w in [words_of(docs[i].text)] for n in lengths if any(tuple(w[k : k + n]) in windows for k in range(len(w) - n + 1))}
    left = [i for i in left if i not in hit]

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", docs[i].text or "")) for i in left}
    sources = sorted({docs[i].source for i in left if docs[i].source is not None}) + [None] * any(docs[i].source is None for i in left)
    of = {s: sum(size[i] for i in left if docs[i].source == s) for s in sources}
    target, free, total = {}, {s: 1.0 + k % 3 for k, s in enumerate(sources)}, float(sum(size.values()))
    while free:
        over = [s for s in free if total * free[s] / sum(free.values()) > 3 * of[s]]
        if not over:
            target |= {s: total * free[s] / sum(free.values()) for s in free}
            break
        for s in over:
            target[s] = 3.0 * of[s]
            total -= target[s]
            del free[s]
    table = spark.read.parquet(f"{small}/documents.parquet")
    order = {r.doc_id: r.h for r in table.select("doc_id", F.pmod(F.xxhash64(F.lit(42), "doc_id", "text"), F.lit(1 << 48)).alias("h")).collect()}
    times = {}
    for s in sources:
        whole = int(target[s] / of[s] + 1e-9) if of[s] else 0
        rest = round(target[s] - whole * of[s])
        for i in sorted((i for i in left if docs[i].source == s), key=lambda i: (order[i], i)):
            extra = max(0, min(size[i], rest))
            rest -= size[i]
            times[i] = whole + (extra > 0 and 2 * extra >= size[i])

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, start = [], 0
    for i in left:
        ids = np.array([*tokenizer.encode(docs[i].text or "", add_special_tokens=False).ids, 2], "<u4")
        for _ in range(times[i]):
            expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in P.run(spark, small).collect())
    assert got == expected
