"""Queries of the library and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import entities as E
from ..operators import library as L
from ..operators import ordered as O
from ..operators import stats as A
from ..storage import stored
from . import form_queries
from . import inputs as I


TEXT_KINDS = {"text_segment": "segment", "text_word_shingle": "shingle"}


def _text_library(spark, d):
    """Text entities of all documents with their organisation, words and characters, stored once, and the candidates among them."""
    rows = stored(E.measured_entities(E.segments(I.whole_docs(spark, d)), T.binary_hash), "measured")
    return rows, L.candidates(rows)


def _recurring_library(spark, d, hashed=T.binary_hash):
    """_text_library() of the text entities that recur alone: the others are not stored, and no candidate needs them."""
    docs = I.table_docs(spark, d)
    rows = L.recurring_entities(E.measured_entities(E.segments(I.whole_docs(spark, d)), hashed), docs, parts=I.pieces(docs))
    return rows, L.candidates(rows, whole=L.with_text(docs))


def recurring_candidates(spark, d):
    return _recurring_library(spark, d)[1].drop("org_count").withColumn("entity_hash", T.hex_of(F.col("entity_hash")))


def org_distinctiveness(spark, d):
    found = _recurring_library(spark, d, I.short_hash)[1]
    return found.groupBy("section", "org_class", "candidate_class", "candidate_status").agg(F.count("*").alias("candidates"), F.sum("document_count").alias("documents"))


def evidence_sampling(spark, d):
    rows, found = _recurring_library(spark, d)
    return L.evidence(rows, found, 6)


def _text_coverage(spark, d):
    rows = I.table_docs(spark, d)
    return L.text_coverage(rows, I.whole_docs(spark, d), TEXT_KINDS, I.pieces(rows))


def coverage_report(spark, d):
    return _text_coverage(spark, d)


def coverage_medians(spark, d):
    """Medians over the measured documents of each section and organisation."""
    rows = _text_coverage(spark, d).where("coverage_status = 'measured'")
    return rows.groupBy("section", "org").agg(F.count("*").alias("documents"), *[F.round(F.median(c) + 1e-9, 4).alias(c) for c in ("segment_ratio", "segment_residual", "conformance")])


def _combined(spark, d):
    """Coverage of the documents by forms of their tables against coverage by text."""
    return L.combined_report(form_queries.document_forms(spark, d), _text_coverage(spark, d))


def combined_report(spark, d):
    return _combined(spark, d)


def combined_medians(spark, d):
    """Medians over all documents of each section and organisation, measured or not, and how many are to be reviewed."""
    out = _combined(spark, d).groupBy("section", "org")
    return out.agg(F.count("*").alias("documents"), F.round(F.median("table_ratio") + 1e-9, 4).alias("table_ratio"), F.round(F.median("text_ratio") + 1e-9, 4).alias("text_ratio"), F.count_if(F.col("priority") == "review_high").alias("review_high"))


def _order_metrics(spark, d):
    return I.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent")).join(
        I.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey", "c_acctbal"), "o_custkey"
    )


def average_rank(spark, d):
    rows = stored(_order_metrics(spark, d).select("o_custkey", "c_mktsegment", "n_orders"), "order-metrics")
    return O.with_places(rows, ["c_mktsegment"], "n_orders", rank=O.AVERAGE_RANK).drop("n_orders")


def spearman_matrix(spark, d):
    """Attributes against metrics of customers in each market segment, both unpivoted, with the number of orders as control."""
    rows = _order_metrics(spark, d).withColumn("control", F.col("n_orders").cast("double"))
    rows = rows.select("c_mktsegment", "control", "spent", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    long = rows.unpivot(["c_mktsegment", "control", "spent"], ["balance", "nation"], "attribute", "x")
    return A.spearman(long, ["c_mktsegment", "attribute"], "x", "spent", "control")


def _correlations(spark, d):
    rows = _order_metrics(spark, d).select("c_nationkey", F.col("c_acctbal").alias("x"), F.col("spent").alias("y"))
    return A.spearman(rows, ["c_nationkey"], "x", "y")


def bh_q(spark, d):
    """False-discovery q of each nation's p value."""
    out = O.false_discovery(stored(_correlations(spark, d).withColumn("all", F.lit(1)), "correlations"), ["all"], "p")
    return out.select("c_nationkey", "p", "q", "significant")


def p_values(spark, d):
    return _correlations(spark, d).select("c_nationkey", "n", "spearman", "direction", "p")


def replication(spark, d):
    """Whether a segment's correlation keeps its sign and strength in both halves of the customers."""
    rows = _order_metrics(spark, d).select("c_mktsegment", (F.col("o_custkey") % 2).alias("half"), F.col("n_orders").cast("double").alias("x"), "spent")
    both = A.spearman(rows, ["c_mktsegment", "half"], "x", "spent").groupBy("c_mktsegment").agg(F.max(F.when(F.col("half") == 0, F.col("spearman"))).alias("first"), F.max(F.when(F.col("half") == 1, F.col("spearman"))).alias("added"))
    same = (F.sign("first") == F.sign("added")) & (F.least(F.abs("first"), F.abs("added")) >= 0.45)
    return both.select("c_mktsegment", "first", "added", F.when(same, "replicated").otherwise("not_replicated").alias("status"))


def quartile_buckets(spark, d):
    rows = _order_metrics(spark, d)
    limits = A.order_quartiles(rows, ["c_mktsegment"], "spent")
    name = F.when(F.col("spent") <= F.col("q1"), "low").when(F.col("spent") >= F.col("q3"), "high").otherwise("middle")
    return rows.join(F.broadcast(limits), "c_mktsegment").groupBy("c_mktsegment", name.alias("bucket")).agg(F.count("*").alias("customers"), F.round(F.median("spent"), 4).alias("median_spent"))


#: Parts of a block of the left side of z_distance. The right side goes to as many blocks as its group has, so few large ones keep the shuffle near the input.
BLOCK = 4096


def z_distance(spark, d):
    """Root mean square distance of all pairs of parts of a brand and type in size and price, in standard deviations of all parts.

    Pairs grow with the square of a group, so blocks of a group's parts are dealt out, by a fixed number: the planner would
    join tasks by the size of the parts, not of the pairs.
    """
    by, v = ["p_brand", "p_type"], ["size", "price"]
    rows = I.table(spark, d, "part").select(*by, "p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    sd = rows.agg(*[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"sd_{c}") for c in v])
    cut = rows.join(rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("cuts")), by)
    dealt = lambda x, block: cut.select(*by, block.alias("block"), *[F.col(c).alias(f"{x}_{c}") for c in ("p_partkey", *v)]).repartition(O.ranges(rows), *by, "block")
    pairs = dealt("left", F.pmod(F.xxhash64("p_partkey"), "cuts")).join(dealt("right", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1))).hint("merge"), [*by, "block"])
    pairs = pairs.where("left_p_partkey < right_p_partkey").crossJoin(F.broadcast(sd))
    distance = S.z_distance_of(*[[F.col(f"{x}_{c}") for c in v] for x in ("left", "right", "sd")])
    return pairs.select(F.col("left_p_partkey").alias("left_part"), F.col("right_p_partkey").alias("right_part"), F.round(distance, 4).alias("distance"))


def midrank_difficulty(spark, d):
    rows = stored(_order_metrics(spark, d).select("o_custkey", "c_mktsegment", "n_orders"), "order-metrics")
    p = F.col("p")
    return O.with_places(rows, ["c_mktsegment"], "n_orders", p=O.MIDRANK).select("o_custkey", F.round(p, 4).alias("difficulty"), A.band(p).alias("band"))


def normalized_entropy(spark, d):
    kinds = ["click", "view", "error", "purchase", "signup"]
    counts = I.table(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).cast("double").alias(k) for k in kinds])
    return counts.select("user_id", F.round(A.entropy([F.col(k) for k in kinds]), 4).alias("entropy"))


QUERIES = {f.__name__: f for f in (
    recurring_candidates, org_distinctiveness, evidence_sampling, coverage_report, coverage_medians, combined_report, combined_medians, average_rank, spearman_matrix, bh_q, p_values, replication,
    quartile_buckets, z_distance, midrank_difficulty, normalized_entropy,
)}

_W = I.with_
_MEAS = I.SEGS + r""",
toks as (select norm.*, docs.org, list_filter(regexp_extract_all(normalized, '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) w from norm join docs using (doc_id)),
shin as (select doc_id, section, object_id, org, array_to_string(w[i:i + 4], ' ') v from (select *, unnest(range(1, len(w) - 3)) i from toks where len(w) >= 5)),
meas as (
  select doc_id, section, object_id, org, 'text_segment' entity_kind, sha1(normalized) entity_hash, count(*) n, max(len(w))::int tokens, max(length(normalized))::int chars from toks group by doc_id, section, object_id, org, normalized
  union all select doc_id, section, object_id, org, 'text_word_shingle', sha1(v), count(*), 5, length(v)::int from shin group by doc_id, section, object_id, org, v)"""
_R4 = lambda x: f"round({x} + 1e-9::double, 4)"


def _cand(src: str, name: str) -> str:
    return f"""{name}_sz as (select section, org, count(distinct object_id) org_objects from {src} group by all),
{name}_sd as (select section, count(distinct object_id) section_objects, count(distinct doc_id) section_documents from {src} group by 1),
{name}_bo as (select section, entity_kind, entity_hash, org, count(distinct object_id) objects, count(*) docs, sum(n)::bigint occ, max(tokens) tokens, max(chars) chars, count(distinct object_id) / any_value(org_objects) ratio from {src} join {name}_sz using (section, org) group by section, entity_kind, entity_hash, org),
{name}_rk as (select *, row_number() over (partition by section, entity_kind, entity_hash order by ratio desc, org desc) k from {name}_bo),
{name}_ag as (
  select section, entity_kind, entity_hash, sum(objects)::bigint object_count, sum(docs)::bigint document_count, sum(occ)::bigint occurrence_count, count(*) org_count, max(tokens) token_count, max(chars) char_count, max(ratio) filter (k = 1) r1, coalesce(max(ratio) filter (k = 2), 0) r2,
    max(org) filter (k = 1) dominant_org, max(objects) filter (k = 1) dominant_objects, string_agg(org || ':' || objects, '|' order by org) org_object_counts, string_agg(org || ':' || occ, '|' order by org) org_occurrence_counts
  from {name}_rk group by all having sum(objects) >= 3),
{name}_cl as (select *, document_count / section_documents share, case when org_count = 1 then 'org_specific' when r1 - r2 >= 0.25 then 'org_distinctive' else 'cross_org_common' end org_class, case when org_count > 1 then 'cross_org' else 'single_org' end org_scope from {name}_ag join {name}_sd using (section)),
{name}_cc as (select *, case when org_count = 1 then 'org_text_pattern' when org_class = 'cross_org_common' or share > 0.25 then 'normative_text' else 'cross_org_text_bridge' end candidate_class,
  case when entity_kind <> 'text_segment' then '' else array_to_string(list_filter([case when token_count < 3 then 'token_count<3' end, case when char_count < 12 then 'char_count<12' end], lambda x: x is not null), '|') end triviality_reason from {name}_cl),
{name} as (
  select 'txtc_v0_' || substr(sha1('text_element_candidate_v0|' || section || '|' || entity_kind || '|' || entity_hash), 1, 16) candidate_id, section, entity_kind, entity_hash, candidate_class, object_count, document_count, occurrence_count, section_objects, section_documents,
    {_R4('object_count / section_objects')} object_ratio, {_R4('share')} document_ratio, round(ln((section_documents + 1) / (document_count + 1)) + 1, 4) section_idf, org_scope, org_class, dominant_org, dominant_objects, {_R4('r1')} dominant_ratio, {_R4('r2')} second_ratio, {_R4('r1 - r2')} delta,
    org_object_counts, org_occurrence_counts, case candidate_class when 'cross_org_text_bridge' then 'copy_review_needed' when 'normative_text' then 'normative_or_boilerplate' else 'org_pattern' end signal, token_count, char_count, triviality_reason,
    case when triviality_reason = '' then 'candidate' else 'diagnostic_trivial' end candidate_status, org_count from {name}_cc)"""


def _cov(docs: str, src: str, cand: str, name: str, kinds: dict[str, str]) -> str:
    sums = ", ".join(f"coalesce(sum(n) filter (entity_kind = '{k}'), 0)::bigint {p}_total, coalesce(sum(n) filter (m and entity_kind = '{k}'), 0)::bigint {p}_matched, coalesce(sum(n) filter (x and entity_kind = '{k}'), 0)::bigint {p}_expected" for k, p in kinds.items())
    named = ", ".join(f"coalesce({p}_{c}, 0) {p}_{c}" for p in kinds.values() for c in ("total", "matched", "expected"))
    parts = ", ".join(f"{p}_total, {p}_matched, {_R4(f'coalesce({p}_matched / nullif({p}_total, 0), 0)')} {p}_ratio, {p}_total - {p}_matched {p}_residual, {_R4(f'coalesce({p}_expected / nullif({p}_matched, 0), 0)')} {p}_conformance" for p in kinds.values())
    return f"""{name}_j as (
  select e.*, c.candidate_id, c.candidate_id is not null m, c.candidate_id is not null and e.org not in ('', 'UNKNOWN') and (org_class = 'cross_org_common' or dominant_org = e.org) x, c.candidate_id is not null and e.org not in ('', 'UNKNOWN') and org_class <> 'cross_org_common' and dominant_org <> e.org f, signal
  from {src} e left join (select * from {cand} where candidate_status = 'candidate') c on c.section = e.section and c.entity_kind = e.entity_kind and c.entity_hash = e.entity_hash),
{name}_s as (
  select doc_id, {sums}, sum(n)::bigint all_total, coalesce(sum(n) filter (m), 0)::bigint all_matched, coalesce(sum(n) filter (x), 0)::bigint expected, coalesce(sum(n) filter (f), 0)::bigint "foreign",
    coalesce(sum(n) filter (m and signal = 'copy_review_needed'), 0)::bigint copy_review, count(distinct candidate_id) candidates from {name}_j group by 1),
{name}_d as (select d.doc_id, d.section, d.org, {named}, {', '.join(f'coalesce("{c}", 0) "{c}"' for c in ('all_total', 'all_matched', 'expected', 'foreign', 'copy_review', 'candidates'))} from {docs} d left join {name}_s using (doc_id)),
{name} as (
  select doc_id, section, org, all_total, all_matched, expected, "foreign", copy_review, candidates, {parts}, {_R4('coalesce(all_matched / nullif(all_total, 0), 0)')} all_ratio, {_R4('coalesce(expected / nullif(all_matched, 0), 0)')} conformance,
    {_R4('coalesce("foreign" / nullif(all_matched, 0), 0)')} foreign_ratio, {_R4('coalesce(copy_review / nullif(all_total, 0), 0)')} copy_review_ratio, case when all_total = 0 then 'no_text' else 'measured' end coverage_status from {name}_d)"""


_CAND = _MEAS + ",\n" + _cand("meas", "cand")
_COVER = _CAND + ",\n" + _cov("docs", "meas", "cand", "cover", TEXT_KINDS)
_BAND = lambda c: f"case when {c} >= 0.75 then 'high' when {c} >= 0.40 then 'medium' else 'low' end"
_COMB = _COVER + form_queries.DOCUMENT_FORMS[len(I.SEGS):] + f""",
comb0 as (
  select doc_id, section, org, coalesce(l.coverage_ratio, 0.0) table_ratio, coalesce(l.borrowing, 0) table_borrowing, coalesce(l.coverage_status, 'missing') table_status, coalesce(r.all_ratio, 0.0) text_ratio, coalesce(r.foreign_ratio, 0.0) foreign_ratio,
    coalesce(r.copy_review_ratio, 0.0) copy_review_ratio, coalesce(r.coverage_status, 'missing') text_status from fcov l full outer join cover r using (doc_id, section, org)),
comb as (select *, {_BAND('table_ratio')} table_band, {_BAND('text_ratio')} text_band, case when table_borrowing > 0 or copy_review_ratio >= 0.05 then 'review_high' when foreign_ratio >= 0.05 or copy_review_ratio >= 0.005 then 'review_watch' else 'review_clear' end priority from comb0)"""
_OM = """om as (select o_custkey, c_mktsegment, c_nationkey, c_acctbal, n_orders, spent from (select o_custkey, count(*) n_orders, sum(o_totalprice::decimal(18,2))::double spent from orders group by 1) join customer on c_custkey = o_custkey)"""
_AR = lambda by, x, src: f"(rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2)"
_DIR = lambda x: f"case when round({x}, 12) > 0 then 'positive' when round({x}, 12) < 0 then 'negative' when round({x}, 12) = 0 then 'zero' end"
# erfc by the gamma series of erf: sum of x^(2n+1) e^(-x^2) / gamma(n + 3/2)
_ERFC = lambda x: f"case when {x} <= 0 then 1.0 when {x} > 6 then 0.0 else greatest(0.0, 1 - list_sum(list_transform(range(0, 161), lambda i: exp((2 * i + 1) * ln({x}) - {x} * {x} - lgamma(i + 1.5))))) end"
_P = lambda r, n: f"case when {n} < 4 then null when abs({r}) >= 1 - 1e-12 then 0.0 else round({_ERFC(f'(abs({r}) * sqrt({n} - 1) / sqrt(2.0))')}, 6) end"
_NAT = _OM + f""",
rk as (select c_nationkey, {_AR('c_nationkey', 'c_acctbal', 'om')} x, {_AR('c_nationkey', 'spent', 'om')} y from om),
co as (select c_nationkey, count(*) n, corr(x, y) c from rk group by 1 having count(*) >= 4 and corr(x, y) is not null and not isnan(corr(x, y))),
cp as (select c_nationkey, n, round(c, 4) spearman, {_DIR('c')} direction, {_P('c', 'n')} p from co)"""
_KINDS = ["click", "view", "error", "purchase", "signup"]

ORACLES = {
    "recurring_candidates": _W(_CAND, "select * exclude (org_count) from cand"),
    "org_distinctiveness": _W(_CAND, "select section, org_class, candidate_class, candidate_status, count(*) candidates, sum(document_count)::bigint documents from cand group by all"),
    "evidence_sampling": _W(_CAND, """select candidate_id, org, doc_id, n, place from (
  select *, row_number() over (partition by candidate_id order by case when in_org <= greatest(1, (6 // org_count) // 2) then 0 else 1 end, org, doc_id) place from (
    select candidate_id, org_count, org, doc_id, n, row_number() over (partition by candidate_id, org order by doc_id) in_org from meas join cand using (section, entity_kind, entity_hash))) where place <= 6"""),
    "coverage_report": _W(_COVER, "select * from cover"),
    "coverage_medians": _W(_COVER, "select section, org, count(*) documents, " + ", ".join(f"{_R4(f'median({c})')} {c}" for c in ("segment_ratio", "segment_residual", "conformance")) + " from cover where coverage_status = 'measured' group by all"),
    "combined_report": _W(_COMB, "select * from comb"),
    "combined_medians": _W(_COMB, f"select section, org, count(*) documents, {_R4('median(table_ratio)')} table_ratio, {_R4('median(text_ratio)')} text_ratio, count(*) filter (priority = 'review_high') review_high from comb group by all"),
    "average_rank": _W(_OM, f"select o_custkey, c_mktsegment, {_AR('c_mktsegment', 'n_orders', 'om')} rank from om"),
    "spearman_matrix": _W(_OM + f""",
lg as (select c_mktsegment, n_orders::double control, spent, 'balance' attribute, c_acctbal x from om union all select c_mktsegment, n_orders::double, spent, 'nation', c_nationkey::double from om),
rk as (select c_mktsegment, attribute, {_AR('c_mktsegment, attribute', 'x', '')} rx, {_AR('c_mktsegment, attribute', 'spent', '')} ry, {_AR('c_mktsegment, attribute', 'control', '')} rz from lg),
co as (select c_mktsegment, attribute, count(*) n, corr(rx, ry) xy, corr(rx, rz) xz, corr(ry, rz) yz from rk group by all),
pt as (select *, case when abs(xz) < 1 - 1e-12 and abs(yz) < 1 - 1e-12 and n >= 4 then (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) end pr from co where n >= 4)""",
        f"select c_mktsegment, attribute, n, round(xy, 4) spearman, {_DIR('xy')} direction, {_P('xy', 'n')} p, round(pr, 4) partial, {_DIR('pr')} partial_direction from pt"),
    "bh_q": _W(_NAT, """select c_nationkey, p, round(least(1.0, min(raw) over (order by p, c_nationkey rows between current row and unbounded following)), 6) q,
  round(least(1.0, min(raw) over (order by p, c_nationkey rows between current row and unbounded following)), 6) <= 0.10 significant from (select *, p * count(*) over () / row_number() over (order by p, c_nationkey) raw from cp)"""),
    "replication": _W(_OM + f""",
rk as (select c_mktsegment, o_custkey % 2 half, {_AR('c_mktsegment, o_custkey % 2', 'n_orders', '')} x, {_AR('c_mktsegment, o_custkey % 2', 'spent', '')} y from om),
co as (select c_mktsegment, half, round(corr(x, y), 4) s from rk group by all having count(*) >= 4),
bo as (select c_mktsegment, max(s) filter (half = 0) "first", max(s) filter (half = 1) added from co group by 1)""",
        """select c_mktsegment, "first", added, case when sign("first") = sign(added) and least(abs("first"), abs(added)) >= 0.45 then 'replicated' else 'not_replicated' end status from bo"""),
    "p_values": _W(_NAT, "select c_nationkey, n, spearman, direction, p from cp"),
    "quartile_buckets": _W(_OM + """,
qs as (select c_mktsegment, list_sort(list(spent))[count(*) // 4 + 1] q1, list_sort(list(spent))[3 * count(*) // 4 + 1] q3 from om group by 1)""",
        "select c_mktsegment, case when spent <= q1 then 'low' when spent >= q3 then 'high' else 'middle' end bucket, count(*) customers, round(median(spent), 4) median_spent from om join qs using (c_mktsegment) group by all"),
    "z_distance": """with sd as (select stddev_pop(p_size::double) s1, stddev_pop(p_retailprice) s2 from part)
select l.p_partkey left_part, r.p_partkey right_part, round(sqrt((pow((l.p_size - r.p_size) / case when s1 > 0 then s1 else 1 end, 2) + pow((l.p_retailprice - r.p_retailprice) / case when s2 > 0 then s2 else 1 end, 2)) / 2), 4) distance
from part l join part r on l.p_brand = r.p_brand and l.p_type = r.p_type and l.p_partkey < r.p_partkey, sd""",
    "midrank_difficulty": _W(_OM + f""",
pc as (select o_custkey, case when count(*) over (partition by c_mktsegment) > 1 then ({_AR('c_mktsegment', 'n_orders', '')} - 1) / (count(*) over (partition by c_mktsegment) - 1) else 0.5 end p from om)""",
        "select o_custkey, round(p, 4) difficulty, case when p < 1/3 then 'low' when p < 2/3 then 'medium' else 'high' end band from pc"),
    "normalized_entropy": "with c as (select user_id, " + ", ".join(f"count(*) filter (event_type = '{k}')::double {k}" for k in _KINDS) + " from events group by 1), t as (select *, " + " + ".join(_KINDS) + " total from c) select user_id, round(case when total > 0 then ("
        + " + ".join(f"case when {k} > 0 then -({k} / total) * ln({k} / total) else 0 end" for k in _KINDS) + ") / ln(5) else 0 end, 4) entropy from t",
}
