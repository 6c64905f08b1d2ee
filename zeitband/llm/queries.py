"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zeitband.shared import new_folder

from . import decontaminate, host_rules, jaccard, language_id, lexical, packing, repeats, resample, secrets, simhash, token_counts, token_files, warc
from .common import with_checksums

VOCABULARY = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), limit=2048)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), share=0.6, least_overlap=0.6)


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.quality_report(documents(spark, sf_dir), host="source", reject_rate=0.5, block_rate=0.9)


OP4_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, chr(1)) as host from documents),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, t, host from d),
w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from l),
g as (select doc_id, i, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o as g from w window o as (partition by doc_id order by i)),
r as (select doc_id, i from g where g is not null qualify count(*) over (partition by doc_id, g) > 1),
c as (select doc_id, count(distinct i + k) as n from r, (values (0), (1), (2)) as s(k) group by doc_id),
m as (select l.doc_id, host, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, cast(len(ls) as bigint) as n_lines,
  cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words from l left join c using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  10 * n_symbols > word_chars or 10 * n_dup_lines > 3 * n_lines or word_chars < 2 * n_words or word_chars > 20 * n_words as soft from m),
h as (select host, count(*) as n, sum(cast(base_failed or soft as int)) as f from f group by host),
p as (select avg(f / n) as m, var_pop(f / n) as v from h),
k as (select m, case when v > 0 then least(10000.0, greatest(1.0, m * (1 - m) / v - 1)) else 10000.0 end as k from p),
s as (select host, (f + k * m) / (n + k) as rate from h, k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ((rate > 0.5 and soft) or rate > 0.9) as kept from f join s using (host)
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.repeated_spans(documents(spark, sf_dir), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("left_sha256").alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path(VOCABULARY), end_id=2)
    placed, sums = token_files.read_metadata(spark, path), token_files.read_checksums(spark, path)
    return placed.join(sums, ["file", "position"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), k=5, percent=75)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_checksums(packing.pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), end_id=1, longest=2048))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), rows=3000, chars=1500, hidden=12, steps=400)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=1, buckets=10_000, least_words=20, percent=10, seed=2024)


#: CRC-32 from its definition: the table of 256 remainders, then a fold over the bytes of each distinct word.
OP11_SQL = r"""
with recursive r as (select range as i, cast(range as bigint) as c, 0 as k from range(256)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from r where k < 8),
crc as (select list(c order by i) as t from r where k = 8),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
dw as (select doc_id, w, count(*) as n from (select doc_id, unnest(ws) as w from d) group by all),
bw as (select w, count(*) as n from (select unnest(ws) as w from b) group by all),
u as (select w, hex(encode(w)) as h from (select w from dw union select w from bw)),
f as (select w, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(0, length(h) // 2), lambda i: cast('0x' || substr(h, cast(2 * i + 1 as int), 2) as bigint))),
  lambda a, x: xor(a >> 8, t[cast((xor(a, x) & 255) as int) + 1])), 4294967295) % 10000 as k from u, crc),
s as (select k, sum(n) as s from dw join f using (w) group by k),
t as (select k, sum(n) as t from bw join f using (w) group by k),
z as (select cast((select coalesce(sum(s), 0) from s) as double) + 10000 as zs, cast((select coalesce(sum(t), 0) from t) as double) + 10000 as zt),
g as (select k, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * zs / ((s + 1.0::double) * zt))) as g from s left join t using (k), z),
x as (select doc_id, sum(n) as n_features, sum(n * g) as weight from dw join f using (w) join g using (k) group by doc_id),
y as (select doc_id, cast(coalesce(n_features, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
  cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) as h from d left join x using (doc_id)),
v as (select *, cast(weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))) as bigint) as score from y),
o as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as r from v)
select doc_id, n_features, weight, score, case when r <= 10 * (select count(*) from v where n_features >= 20) // 100 then r end as rank from o
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10, b=90, k1=8)


OP12_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark),
c as (select cast(count(*) as bigint) as docs, cast(sum(len(ws)) as bigint) as words from d where len(ws) > 0),
tf as (select doc_id, n, w, count(*) as tf from (select doc_id, cast(len(ws) as bigint) as n, unnest(ws) as w from d) where w in (select w from q) group by all),
wt as (select w, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double)) as bigint) as wt from (select w, count(*) as df from tf group by w), c),
s as (select item_id, doc_id, cast(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) as bigint) as score
  from q join tf using (w) join wt using (w), c group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir), k=3, seed=42)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_secret_scan, op3_decontamination, op4_host_rules, op5_suffix_dedup, op6_token_files, op7_jaccard_join, op8_packing, op9_warc, op10_language_id, op11_resample, op12_lexical_search, op13_simhash)}
ORACLES: dict[str, str] = {"op4_host_rules": OP4_SQL, "op11_resample": OP11_SQL, "op12_lexical_search": OP12_SQL}
