"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm import bpe, decontaminate, hostrep, lexsearch, linededup, merkle, ogg, pagediff, rlz, shards, simhash, sql, token_scan, toxicity
from orgweave.llm.shared import materialise
from orgweave.llm.tokens import Vocabulary

#: Verdicts by host and path that go before reputation.
URL_RULES = [
    hostrep.Rule("com", "/en/", "block"),
    hostrep.Rule("example.com", "/en/7", "allow"),
    hostrep.Rule("net", "/de/", "allow"),
    hostrep.Rule("example.net", "/de/8", "block"),
    hostrep.Rule("org", "/es/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> Vocabulary:
    return Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def encode_and_decode(docs: DataFrame) -> DataFrame:
    vocabulary = _vocabulary()
    return bpe.decode(bpe.encode(docs, vocabulary), vocabulary, with_bytes=False)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(_table(spark, sf_dir, "documents"))


def op2_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shards.write_training_order(_table(spark, sf_dir, "documents"), _vocabulary(), key=20240229)
    return shards.read_records(written).drop("tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = materialise(token_scan.flat_blocks(_table(spark, sf_dir, "documents"), _vocabulary()), "flat-tokens")
    counted = token_scan.count_tokens(blocks.select("file", "block", "payload"))
    named = blocks.select("file", "block", F.posexplode("doc_ids").alias("nth", "doc_id"))
    return counted.join(named, ["file", "block", "nth"]).select("doc_id", "n_tokens")


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short_items=True)


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read(ogg.store(_table(spark, sf_dir, "documents")))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    # a page shows the document whose number its path ends in
    shown = pages.select("url", F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) as bigint)").alias("doc_id"))
    # (one known fault is enough, whatever the other label; without one both must be known)
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.expr("cast(toxic = 1 or quality = 0 as int)").alias("bad"))
    return hostrep.judge_urls(pages, shown.join(labels, "doc_id").select("url", "bad"), URL_RULES)


def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.remove_duplicate_spans(_table(spark, sf_dir, "documents"), with_text=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(_table(spark, sf_dir, "pages"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_SUFFIXES = ", ".join(f"'{s}'" for s in hostrep.TWO_LABEL_SUFFIXES)
OP6_SQL = f"""
with cut as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (
  select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
q as (select page_id, coalesce(host, '') as host, coalesce(path, '') as path, try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) as bigint) as doc_id from p),
o as (select host, cast(toxic = 1 or quality = 0 as int) as bad from q join labels using (doc_id) where host <> '' and (toxic = 1 or quality = 0) is not null),
bare as (select distinct host, regexp_replace(host, ':[0-9]*$', '') as b from q),
cuts as (select host, b, regexp_matches(b, '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$|^\\[') as address, array_to_string(list_slice(string_split(b, '.'), -2, -1), '.') as two,
                array_to_string(list_slice(string_split(b, '.'), -3, -1), '.') as three, list_extract(string_split(b, '.'), -1) as one from bare),
names as (select host, case when address then b when two in ({_SUFFIXES}) then three else two end as domain,
                 case when address then '{hostrep.ADDRESSES}' when two in ({_SUFFIXES}) then two else one end as suffix from cuts),
h as (select host, any_value(domain) as domain, any_value(suffix) as suffix, cast(count(*) as double) as n, cast(sum(bad) as double) as k from o join names using (host) group by host),
d as (select domain, any_value(suffix) as suffix, sum(n) as n, sum(k) as k from h group by domain),
s as (select suffix, sum(n) as n, sum(k) as k from d group by suffix),
t as (select round(coalesce(sum(k) / nullif(sum(n), 0), 0), 9) as m0 from s),
v0 as (select greatest((sum(n * (k / n - m0) * (k / n - m0)) - (count(*) - 1) * any_value(m0) * (1 - any_value(m0))) / nullif(sum(n) - sum(n * n) / sum(n), 0), 0) as v,
              count(*) as c, any_value(m0) as m from s, t),
s0 as (select round(least(greatest(case when c < 2 or v <= 0 or v is null then 200.0 else m * (1 - m) / v - 1 end, 2.0), 200.0), 9) as strength from v0),
s1 as (select suffix, round((k + strength * m0) / (n + strength), 9) as m from s, t, s0),
dj as (select d.*, s1.m from d join s1 using (suffix)),
v1 as (select suffix, greatest((sum(n * (k / n - m) * (k / n - m)) - (count(*) - 1) * any_value(m) * (1 - any_value(m))) / nullif(sum(n) - sum(n * n) / sum(n), 0), 0) as v,
              count(*) as c, any_value(m) as m from dj group by suffix),
s2 as (select suffix, m, round(least(greatest(case when c < 2 or v <= 0 or v is null then 200.0 else m * (1 - m) / v - 1 end, 2.0), 200.0), 9) as strength from v1),
d1 as (select domain, round((dj.k + s2.strength * dj.m) / (dj.n + s2.strength), 9) as m from dj join s2 using (suffix)),
hj as (select h.*, d1.m from h join d1 using (domain)),
v2 as (select domain, greatest((sum(n * (k / n - m) * (k / n - m)) - (count(*) - 1) * any_value(m) * (1 - any_value(m))) / nullif(sum(n) - sum(n * n) / sum(n), 0), 0) as v,
              count(*) as c, any_value(m) as m from hj group by domain),
d2 as (select domain, m, round(least(greatest(case when c < 2 or v <= 0 or v is null then 200.0 else m * (1 - m) / v - 1 end, 2.0), 200.0), 9) as strength from v2),
x as (select a.host, coalesce(h.n, 0) as n, coalesce(h.k, 0) as k, coalesce(d2.m, s2.m, t.m0) as mean, coalesce(d2.strength, s2.strength, 2.0) as strength
      from names a left join h using (host) left join d2 on d2.domain = a.domain left join s2 on s2.suffix = a.suffix, t),
b as (select host, k + strength * mean as al, n - k + strength * (1 - mean) as be from x),
r as (select host, round(greatest(al / (al + be) - 1.645 * sqrt(al * be / ((al + be) * (al + be) * (al + be + 1))), 0), 6) as low from b),
rules(rh, rp, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fit as (select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as v
        from q, rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select q.page_id, q.host, q.path, fit.rule as rule, coalesce(fit.v, case when r.low > 0.25 then 'block' else 'allow' end) as verdict, r.low as low
from q join r using (host) left join fit using (page_id)
"""

OP7_SQL = """
with rows as (select doc_id, text, substr(md5(text), 1, 16) as t, string_split(text, chr(10)) as lines from documents),
l as (select distinct doc_id, t, lines from rows where doc_id is not null and text is not null),
w as (select doc_id, t, i as pos, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] as key from l, unnest(generate_series(1, len(lines) - 2)) as u(i)),
r as (select doc_id, t, pos, row_number() over (partition by key order by doc_id, t, pos) as n from w),
g as (select distinct doc_id, t, pos + j as line from r, unnest([0, 1, 2]) as u(j) where n > 1),
x as (select doc_id, t, i, lines[i] as line from l, unnest(generate_series(1, len(lines))) as u(i)),
k as (select x.doc_id, x.t, string_agg(x.line, chr(10) order by i) as kept from x left join g on g.doc_id = x.doc_id and g.t = x.t and g.line = x.i where g.line is null group by x.doc_id, x.t),
c as (select doc_id, t, count(*) as n from g group by doc_id, t)
select rows.doc_id, cast(coalesce(len(rows.lines), 0) as bigint) as n_lines, cast(coalesce(c.n, 0) as bigint) as n_removed,
       sha256(coalesce(case when c.n is null then rows.text else k.kept end, '')) as kept_sha256
from rows left join c on c.doc_id = rows.doc_id and c.t = rows.t left join k on k.doc_id = rows.doc_id and k.t = rows.t
"""

OP8_SQL = """
with rows as (select doc_id, md5(coalesce(text, '')) as t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
d as (select distinct doc_id, t, words from rows),
w as (select doc_id, t, i as pos, md5(array_to_string(list_slice(words, i, i + 49), ' ')) as key from d, unnest(generate_series(1, len(words) - 49)) as u(i)),
m as (select key, min(doc_id) as first_doc from w group by key),
g as (select distinct doc_id, t, pos + j as word from w join m using (key), unnest(generate_series(0, 49)) as u(j) where doc_id > first_doc),
x as (select doc_id, t, i, words[i] as word from d, unnest(generate_series(1, len(words))) as u(i)),
k as (select x.doc_id, x.t, string_agg(x.word, ' ' order by i) as kept from x left join g on g.doc_id is not distinct from x.doc_id and g.t = x.t and g.word = x.i where g.word is null group by x.doc_id, x.t),
c as (select doc_id, t, count(*) as n from g group by doc_id, t)
select rows.doc_id, cast(len(rows.words) as bigint) as n_words, cast(coalesce(c.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from rows left join c on c.doc_id = rows.doc_id and c.t = rows.t left join k on k.doc_id is not distinct from rows.doc_id and k.t = rows.t
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_byte_bpe, op2_training_shards, op3_token_counts, op4_benchmark_leaks, op5_ogg_media, op6_url_reputation, op7_line_windows, op8_substring_dedup, op9_toxicity, op10_simhash,
        op11_merkle_manifest, op12_page_text, op13_ranked_search,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_reputation": OP6_SQL, "op7_line_windows": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op11_merkle_manifest": sql.MERKLE, "op13_ranked_search": sql.SEARCH}
