"""The corpus operators as registered queries, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, jaccard, kdshard, packing, quality, records, secrets, toxicity, urlfilter
from .support import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(documents(spark, sf_dir))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshard.assign_shards(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

#: Shared by the quality query and the pipeline: t(doc_id, text) to the judged table.
QUALITY_SQL = f"""
base as (select doc_id, coalesce(text, '') t from {{docs}}),
words as (
  select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls
  from base),
win as (
  select doc_id, i, array_to_string(ws[i:i+4], ' ') g
  from (select doc_id, ws, unnest(range(1, len(ws) - 3)) i from words where len(ws) >= 5)),
dup as (select doc_id, g from win group by 1, 2 having count(*) > 1),
covered as (
  select w.doc_id, count(distinct w.i + k) n
  from win w join dup using (doc_id, g), range(5) r(k) group by 1),
counts as (
  select w.doc_id, cast(len(ws) as bigint) n_words,
    cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) as bigint) n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines, cast(len(ls) as bigint) n_lines,
    cast(len(list_filter(ws, lambda x: lower(x) in ({_STOP}))) as bigint) n_stop,
    cast(coalesce(c.n, 0) as bigint) n_repeat_words
  from words w left join covered c on w.doc_id = c.doc_id),
judged as (
  select *, n_words < 10 or n_repeat_words * 100 > n_words * 20 base_failed,
    case when n_words > 0 and not (word_chars * 100 >= n_words * 200 and word_chars * 100 <= n_words * 1200) then 'mean_word_length'
      when n_words > 0 and n_symbols * 100 > n_words * 10 then 'symbol_ratio'
      when n_words >= 50 and n_stop * 100 < n_words * 2 then 'stop_word_ratio'
      when n_lines > 0 and n_dup_lines * 100 > n_lines * 40 then 'dup_line_ratio'
      when n_words >= 50 and n_lines * 100 > n_words * 60 then 'line_length' end failed_rule
  from counts)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": f"""with {QUALITY_SQL.format(docs="documents")}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and failed_rule is null kept, failed_rule from judged""",
        "op4_url_filter": r"""
with recursive urls as (
  select url, html from pages where url is not null and position('://' in url) > 0),
links as (
  select url, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*>')) tag from urls),
declared as (
  select url, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?\s*([A-Za-z]+://[^"''\s>]+)', 1) target from links where regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical')
  union select url, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?\s*([A-Za-z]+://[^"''\s>]+)', 1) from (
    select url, unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*>')) tag from urls) where regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh')),
known as (select url from urls union select target from declared where target <> ''),
rests as (select url, substr(url, position('://' in url) + 3) rest from known),
parts as (
  select url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) query from rests),
forms as (
  select url, host, path, host || path || query node, regexp_replace(host, '^(?:www|m)\.([^.]+\.)', '\1') || regexp_replace(path, '/+$', '')
    || regexp_replace(regexp_replace(query, '[?&](?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^[?&]+(.)', '?\1') form from parts),
edges as (
  select node a, form b from forms where node <> form
  union select form, node from forms where node <> form
  union select f.node, g.node from declared d join forms f using (url) join forms g on g.url = d.target
  union select g.node, f.node from declared d join forms f using (url) join forms g on g.url = d.target),
reach(a, b) as (select a, a from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
rules(verdict, rh, rp) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
places as (
  select a x, regexp_extract(a, '^[^/?#]*') host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) path from edges
  union select b, regexp_extract(b, '^[^/?#]*'), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) from edges),
judged as (
  select x, arg_max(verdict, length(rh || rp)) verdict
  from places join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1),
blocked as (select distinct r.a from reach r join judged j on r.b = j.x where j.verdict = 'block'),
hits as (
  select f.url, arg_max(rh || rp, length(rh || rp)) rule, arg_max(verdict, length(rh || rp)) verdict
  from forms f join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1)
select page_id, coalesce(f.host, '') host, coalesce(f.path, '') path, rule,
  coalesce(verdict, case when b.a is not null then 'block' else 'allow' end) verdict, b.a is not null alias_blocked
from pages p left join forms f using (url) left join hits h using (url) left join blocked b on b.a = f.node""",
        "op6_exact_dedup": """
with g as (select coalesce(text, '') t, max(doc_id) keep_id, count(*) n from documents group by 1)
select doc_id, keep_id, cast(n as bigint) group_size, doc_id = keep_id kept, sha256(g.t) text_sha256
from documents d join g on coalesce(d.text, '') = g.t""",
        "op7_jaccard_join": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
shingles as materialized (
  select distinct doc_id, array_to_string(ws[i:i+3], ' ') g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) i from words where len(ws) > 0)),
sizes as materialized (select doc_id, count(*) n from shingles group by 1),
both_ as (select a.doc_id x, b.doc_id y, count(*) c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as materialized (
  select x, y from both_ join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
edges as (select x, y from links union all select y, x from links),
reach(x, y) as (select x, x from edges union select r.x, e.y from reach r join edges e on r.y = e.x),
least_ as (select x, min(y) least from reach group by 1)
select w.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, coalesce(least, w.doc_id) component_id
from words w left join sizes s on s.doc_id = w.doc_id left join least_ l on l.x = w.doc_id""",
    }
