"""The operators over the standard tables: one thin query each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathframe.llm import (
    chat_format,
    decontaminate,
    embed_dedup,
    mixing,
    pii,
    simhash_dedup,
    suffix_dedup,
    token_output,
    toxicity,
    url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of op4, fixed by its contract.
URL_RULES = [
    url_filter.UrlRule("com", "/", "allow"),
    url_filter.UrlRule("example.com", "/en/", "block"),
    url_filter.UrlRule("www.example.com", "/en/", "allow"),
    url_filter.UrlRule("net", "/es/", "block"),
    url_filter.UrlRule("net", "/fr/", "block"),
]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=400)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"), max_epochs=3.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation ``2 k`` is chosen over ``2 k + 1``."""
    return chat_format.format_neighbours(_table(spark, sf_dir, "conversations"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, max_bits=4)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_output.write_token_files(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_words=True
    )
    return token_output.read_documents(files)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ``base_sha256`` are of the plain spans, ``spans`` of all; ``n_disguised`` counts what the method adds."""
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(
        F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )

    def count(kind: str) -> Column:
        return F.size(F.filter("plain", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(listed("plain"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        (F.size("spans") - F.size("plain")).cast("bigint").alias("n_disguised"),
    )


def _held_out() -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~_held_out())
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", "predicted")


_OP1_SQL = """
with d as (select row_number() over () rid, doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (
  select rid, i, md5(substring(h, 2 * i + 1, 800)) k
  from (select rid, h, unnest(range(0, len(h) // 2 - 399)) i from d where len(h) >= 800)),
p as (select rid, i from w where k in (select k from w group by k having count(*) > 1)),
s as (select rid, i, case when i <= lag(i) over (partition by rid order by i) + 400 then 0 else 1 end fresh from p),
r as (
  select rid, min(i) a, max(i) + 400 b
  from (select rid, i, sum(fresh) over (partition by rid order by i rows unbounded preceding) run from s) group by rid, run),
g as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) e from r),
k as (
  select rid, string_agg(substring(h, 2 * e + 1, 2 * (a - e)), '' order by a) kept, max(b) b, sum(b - a) n_removed, count(*) n_spans
  from g join d using (rid) group by rid)
select doc_id, cast(len(h) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans,
  sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(b, 0) + 1))) kept_sha256
from d left join k using (rid)
"""

_OP2_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark),
bw as (
  select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, ns where len(w) >= n)),
hits as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw using (n, g)),
hw as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + n)) k from hits) group by 1),
hi as (
  select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) items
  from hits group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit,
  cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hw using (doc_id) left join hi using (doc_id)
"""

_OP5_SQL = """
with recursive e as (
  select vec_id, cast(embedding as double[]) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id a, b.vec_id b from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.95),
r(n, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join l on l.a = r.n),
m as (select n, min(c) c from r group by 1),
k as (select a, count(*) n from l group by 1)
select vec_id, cast(coalesce(k.n, 0) as bigint) n_links, m.c component_id, vec_id = m.c kept
from embeddings left join m on m.n = vec_id left join k on k.a = vec_id
"""

_OP6_SQL = """
with t as (
  select distinct conv_id, cast(turn as bigint) turn, coalesce(role, 'unknown') role, coalesce(text, '') text,
    cast(floor(conv_id / 2) as bigint) pair_id, case when conv_id % 2 = 0 then 'chosen' else 'rejected' end side
  from conversations where conv_id is not null and turn is not null),
s as (select pair_id, side, turn, list([role, text] order by role, text) sig from t group by all),
c as (select pair_id, turn, count(*) n, min(sig) a, max(sig) b from s group by all),
f as (select pair_id, min(turn) filter (n < 2 or a <> b) cut from c group by all),
p as (select pair_id, count(distinct side) = 2 paired from t group by all),
x as (
  select t.*, paired, cut is null or turn < cut shared,
    '<|im_start|>' || replace(replace(role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10) head,
    replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' body
  from t join f using (pair_id) join p using (pair_id)),
y as (select *, not shared and role = 'assistant' trained from x where not shared or side = 'chosen')
select pair_id, paired, case when shared then 'prompt' else side end part, turn, role, head || body || chr(10) rendered,
  cast(case when trained then length(head) else length(head || body || chr(10)) end as bigint) masked_chars,
  cast(case when trained then length(body) else 0 end as bigint) trained_chars
from y
"""

_OP4_SQL = r"""
with p as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path
  from pages),
r as (select * from (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, q, a)),
f as (
  select page_id, host, path, (select h || q from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, q)
    order by length(h || q) desc limit 1) rule
  from p)
select page_id, host, path, rule, coalesce((select a from r where h || q = rule), 'allow') verdict from f
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_mix_sources": op3_mix_sources,
    "op4_url_filter": op4_url_filter,
    "op5_embed_dedup": op5_embed_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_token_output": op9_token_output,
    "op10_pii": op10_pii,
}

ORACLES: dict[str, str] = {"op1_suffix_dedup": _OP1_SQL, "op2_decontaminate": _OP2_SQL, "op4_url_filter": _OP4_SQL, "op5_embed_dedup": _OP5_SQL, "op6_chat_format": _OP6_SQL}
