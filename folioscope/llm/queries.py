"""The registered queries of the training-data operators, by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import asof_join, bpe, group_matrix, language_crf, license_scan, line_spread, perplexity, positional_index, quality_classifier, source_divergence, toxicity, training_order, word_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(table(spark, sf_dir, "documents"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return training_order.materialise(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, key=2024)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_matrix.jaccard_components(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(table(spark, sf_dir, "documents"))


def op8_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.line_dedup(table(spark, sf_dir, "documents"))


def op9_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return word_bpe.digests(word_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op13_tolerant_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_join.match_orders(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


QUERIES = {
    "op1_positional_index": op1_positional_index,
    "op2_perplexity_rules": op2_perplexity_rules,
    "op3_training_order": op3_training_order,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_group_matrix": op5_group_matrix,
    "op6_toxicity": op6_toxicity,
    "op7_language_crf": op7_language_crf,
    "op8_site_spread": op8_site_spread,
    "op9_license_join": op9_license_join,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_word_bpe": op12_word_bpe,
    "op13_tolerant_asof": op13_tolerant_asof,
}

#: Words of ops 1 and 9, as a DuckDB expression over the column text.
_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
with dw as (select doc_id, {_ALNUM} w from documents),
iw as (select item_id, {_ALNUM} w from benchmark),
wins as (
  select distinct item_id, least(13, len(w)) n, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) j from iw where len(w) > 0)),
sizes as (select distinct n from wins),
places as (
  select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from dw, sizes where len(w) >= n)),
hits as (select doc_id, item_id, p, places.n from places join wins on places.g = wins.g and places.n = wins.n),
per_word as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from hits) group by 1),
per_item as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) items from hits group by 1)
select dw.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from dw left join per_word using (doc_id) left join per_item using (doc_id)
"""

_OP5 = r"""
with recursive dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sh as (
  select distinct doc_id, len(w) >= 5 whole, array_to_string(w[p:p + 4], ' ') s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) p from dw where len(w) > 0)),
sizes as (select doc_id, count(*) n from sh group by 1),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.s = b.s and a.whole = b.whole and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from pairs join sizes sx on x = sx.doc_id join sizes sy on y = sy.doc_id where 100 * c >= 75 * (sx.n + sy.n - c)),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select x doc_id, min(y) component_id from reach group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id from least left join sizes using (doc_id)
"""

_OP8 = f"""
with split as (select doc_id, source, text, string_split(text, chr(10)) ls from documents),
lines as (select doc_id, source, unnest(ls) l, unnest(range(len(ls))) i from split where text is not null),
common as (select trim(l) c from lines where trim(l) <> '' and source is not null group by 1 having count(distinct source) >= {line_spread.MIN_SITES}),
marked as (select doc_id, l, i, c is not null gone from lines left join common on trim(l) = c),
done as (
  select doc_id, count(*) n_lines, count(*) filter (gone) n_removed,
    sha256(coalesce(string_agg(l, chr(10) order by i) filter (not gone), '')) text_sha256
  from marked group by 1)
select doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed, text_sha256
from documents left join done using (doc_id)
"""

_TEMPLATES = ", ".join(f"('{label}', {tokens}, {need}, {size})" for label, tokens, need, size in license_scan.template_rows(license_scan.TEMPLATES))
_PHRASES = ", ".join(f"('{label}', {phrase.split()})" for phrase, label in license_scan.PHRASES.items())
_OP9 = f"""
with dw as (select doc_id, {_ALNUM} w from documents),
phrases(label, ph) as (values {_PHRASES}),
places as (
  select doc_id, label, p - 1 p
  from (select doc_id, w, label, ph, unnest(range(1, len(w) - len(ph) + 2)) p from dw, phrases where len(w) >= len(ph))
  where w[p:p + len(ph) - 1] = ph),
base as (select doc_id, count(*) n_base, min(p) first_word, max(p) last_word, list_sort(list(distinct label)) bl from places group by 1),
templates(label, t, need, size) as (values {_TEMPLATES}),
near as (select doc_id, w, label, t, need, size from dw, templates where len(list_intersect(w, t)) >= need),
blocks as (
  select doc_id, label, t, need, len(list_intersect(w[p:p + size - 1], t)) held
  from (select *, unnest(range(1, greatest(len(w) - size + 1, 1) + 1)) p from near)),
matched as (select doc_id, label, held::double / len(t) c from blocks where held >= need),
best as (select doc_id, max(c) c, list(distinct label) ml from matched group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(array_to_string(bl, ','), '') base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ','), '') labels,
  case when n_base > 0 then 1.0::double else coalesce(round(c, 6), 0.0)::double end score
from dw left join base using (doc_id) left join best using (doc_id)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_OP11 = f"""
with dw as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, {_TERMS} w from documents),
occ as (select r, lang, source, unnest(w) t from dw),
kept as (select lang, t from occ group by 1, 2 having count(distinct r) >= {source_divergence.MIN_DOCS}),
size as (select lang, count(*) v from kept group by 1),
groups as (select distinct lang, source from dw),
c as (select lang, source, t, count(*) c from occ join kept using (lang, t) group by 1, 2, 3),
gn as (select lang, source, coalesce(sum(c), 0)::bigint n from groups left join c using (lang, source) group by 1, 2),
ln as (select lang, sum(c)::bigint n from c group by 1),
p as (
  select lang, gn.source, t, coalesce(c, 0) c, 1 + (1000000000 * (coalesce(c, 0) + 2)) // (n + 2 * v) p
  from gn join kept using (lang) join size using (lang) left join c using (lang, source, t)),
lp as (
  select lang, t, 1 + (1000000000 * (sum(c) + 2)::bigint) // (n + 2 * v) q
  from c join ln using (lang) join size using (lang) group by lang, t, n, v),
pairs as (
  select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint value
  from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by 1, 2, 3),
allp as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0) value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source),
terms as (select lang, source, 'term' part, t item, (p - q) * (p - q) // (p + q) value from p join lp using (lang, t) where c > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) rank
  from (select * from allp union all select * from terms))
select lang, source, part, item, value::bigint value, rank::integer rank from ranked where part = 'pair' or rank <= {source_divergence.TOP_TERMS}
"""


def _crc_table() -> list[int]:
    """What each byte does to a CRC-32 (reflected polynomial EDB88320)."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ 0xEDB88320 * (x & 1) for x in out]
    return out


def _crc(number: str) -> str:
    """CRC-32 of the decimal digits of a DuckDB expression; null of null."""
    digits = f"[4294967295::bigint] || list_transform(string_split({number}::varchar, ''), lambda x: ascii(x)::bigint)"
    step = f"xor(({_crc_table()}::bigint[])[(xor(a, b) & 255) + 1], a >> 8)"
    return f"(case when {number} is not null then xor(list_reduce({digits}, lambda a, b: {step}), 4294967295::bigint) end)"


_OP13 = f"""
with c0 as (select click_id, min(client_id) client_id, min(epoch_us(ts)) us from clicks group by 1),
c1 as (select *, {_crc("click_id")} h from c0),
c as (select click_id, client_id, case when h % 2 = 1 then us - ((us % {asof_join.COARSE_US}) + {asof_join.COARSE_US}) % {asof_join.COARSE_US} else us end us from c1),
s0 as (
  select sale_id, client_id, epoch_us(sold_at) us, case when isfinite(total) then floor(100 * total + 0.5)::bigint end cents, {_crc("sale_id")} h
  from sales),
s1 as (select sale_id, client_id, h, cents, case when h % 2 = 1 then us - ((us % {asof_join.COARSE_US}) + {asof_join.COARSE_US}) % {asof_join.COARSE_US} else us end us from s0),
s as (select sale_id, client_id, us, cents from s1 union all select -1 - sale_id, client_id, us, cents from s1 where h % 3 <> 0),
best as (
  select client_id, us, count(*) n, first(sale_id order by cents desc nulls last, sale_id desc nulls last) sale_id,
    first(cents order by cents desc nulls last, sale_id desc nulls last) cents
  from s where client_id is not null and us is not null group by 1, 2),
found as (select click_id, c.client_id, c.us ts_us, sale_id, c.us - best.us lag_us, cents, n from c asof left join best on c.client_id = best.client_id and c.us >= best.us)
select click_id, client_id, ts_us, case when lag_us <= {asof_join.TOLERANCE_US} then sale_id end sale_id,
  case when lag_us <= {asof_join.TOLERANCE_US} then lag_us end lag_us, case when lag_us <= {asof_join.TOLERANCE_US} then cents end total_cents,
  case when lag_us <= {asof_join.TOLERANCE_US} then n else 0 end::bigint n_tied
from found
"""

ORACLES: dict[str, str] = {
    "op1_positional_index": _OP1,
    "op5_group_matrix": _OP5,
    "op8_site_spread": _OP8,
    "op9_license_join": _OP9,
    "op11_source_divergence": _OP11,
    "op13_tolerant_asof": _OP13,
}
