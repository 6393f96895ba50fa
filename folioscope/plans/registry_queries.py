"""Queries of the registry, reviewer-quality, organisation-graph and streaming-style operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import golden as K
from ..operators import registry as R
from ..operators import review as V
from . import inputs as I


def linkage(spark, d):
    """Documents of even and odd ids as two registers, linked by the hash of their text."""
    docs = I.docs(spark, d).select("doc_id", T.text_hash(F.col("text")).alias("content"))
    sources = docs.where("doc_id % 2 = 0").select("content", F.col("doc_id").alias("source_doc"))
    exports = docs.where("doc_id % 2 = 1").select("content", F.col("doc_id").alias("export_doc"))
    return R.linkage(sources, exports, "content").select("content", "source_doc", "export_doc", "link_status", "source_match_count", "export_match_count")


def priority_pick(spark, d):
    """One order of each customer: the most urgent, then the newest, then the lowest key."""
    return R.first_by(I.table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderpriority"), F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


def alias_resolution(spark, d):
    """Suppliers to regions through the alias of their nation's name, with the nation's number as the second chance."""
    n, r = I.table(spark, d, "nation"), I.table(spark, d, "region")
    names = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.upper("n_name").alias("alias"), F.col("r_name").alias("canonical"))
    numbers = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("alias"), F.col("r_name").alias("canonical"))
    rows = I.table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "?").otherwise(F.upper("n_name")).alias("name"), F.col("n_nationkey").cast("string").alias("number"))
    return R.resolve_alias(rows, names.unionByName(numbers), ["name", "number"]).select("s_suppkey", "canonical")


def name_variants(spark, d):
    """The commonest brand of each part type, the first seen on a tie."""
    return R.first_seen_mode(I.table(spark, d, "part"), ["p_type"], "p_brand", "p_partkey")


def eligible_cells(spark, d):
    rows = I.table(spark, d, "lineitem").join(I.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select("l_returnflag", "l_linestatus", "l_linenumber", F.col("s_nationkey").alias("organization"), F.col("l_suppkey").alias("lead"), F.col("l_orderkey").alias("object_id"))
    return R.eligible_cells(rows, ["l_returnflag", "l_linestatus", "l_linenumber"])


def selection_dedup(spark, d):
    """One document of each content (lowest id), with all sources that hold it."""
    docs = I.table_docs(spark, d).select("doc_id", "org", T.text_hash(F.col("text")).alias("content"))
    return docs.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.array_join(F.array_sort(F.collect_set("org")), "|").alias("sources"))


def reconcile(spark, d):
    """Part names against the name of the next part, by edit distance and containment."""
    p = I.table(spark, d, "part")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(other, "p_partkey", "left").select("p_partkey", R.reconcile(F.col("p_name"), F.col("other")).alias("status"))


def label_upsert(spark, d):
    """A label store updated with the labels of the quality table."""
    store = I.docs(spark, d).select("doc_id", F.col("section").alias("review_label"))
    new = I.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "bad").otherwise("").alias("review_label"))
    return R.upsert_labels(store, new, "doc_id", ["review_label"])


def file_selection(spark, d):
    """Pages kept or left out by the first rule that their address matches."""
    rules = [("paged", r"[?&]page="), ("anchored", r"#"), ("mobile", r"//m\."), ("organization", r"\.org/")]
    return I.table(spark, d, "pages").select("page_id", R.classify(F.col("url"), rules, "selected").alias("reason"))


def resume_filter(spark, d):
    """Orders without any line: what a resumed run has still to do."""
    return I.table(spark, d, "orders").join(I.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


def _outcomes(spark, d):
    """Events as review records of a user, day and object: purchases and sign-ups pass clean, errors are remarks."""
    kind = F.col("event_type")
    rows = I.table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.expr("cast(get_json_object(props, '$.k') as int)").alias("object_id"), kind.isin("purchase", "signup").alias("clean"), (kind == "error").alias("remark"))
    return V.outcomes(rows, ["user_id", "day", "object_id"])


def review_records(spark, d):
    return _outcomes(spark, d)


def sessions(spark, d):
    return V.sessions(_outcomes(spark, d), ["user_id", "day"])


def expert_variance(spark, d):
    return V.expert_variance(V.sessions(_outcomes(spark, d), ["user_id", "day"]), "user_id")


def remark_categories(spark, d):
    """Remark features of every turn's whole text."""
    rows = I.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return V.remark_features(rows).select("conv_id", "turn", "remark_hash", "char_count", "word_count", "primary_category", "depth_class")


def remark_recurrence(spark, d):
    """Texts that whole turns of two or more conversations have in common."""
    rows = V.remark_features(I.table(spark, d, "conversations").select("conv_id", "role", "text"))
    out = rows.groupBy("remark_hash").agg(F.countDistinct("conv_id").alias("documents"), F.array_join(F.array_sort(F.collect_set("role")), "|").alias("roles"))
    return out.where("documents >= 2")


def recall_pivot(spark, d):
    """Share of urgent orders by customer segment and status, as one column a status."""
    rows = I.table(spark, d, "orders").join(I.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)
    out = rows.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg(urgent), 4))
    return out.select("c_mktsegment", *[F.col(s).alias(f"recall_{s.lower()}") for s in "FOP"])


def confusion(spark, d):
    """Labelled quality against a rule: texts of 50 words or more without symbols are good."""
    docs = I.table(spark, d, "documents").join(I.table(spark, d, "labels"), "doc_id")
    guess = ((F.size(F.split("text", " ")) >= 50) & ~F.col("text").rlike(r"[#$%&|]")).cast("int")
    return V.confusion(docs.select("quality", guess.alias("guess")), "quality", "guess")


def quarter_activity(spark, d):
    """Orders of every customer by quarter."""
    return I.table(spark, d, "orders").groupBy("o_custkey", T.quarter_label(F.to_date("o_orderdate")).alias("quarter")).agg(F.count("*").alias("orders"))


def quality_counts(spark, d):
    """How many remarks each role has of each depth and category."""
    rows = V.remark_features(I.table(spark, d, "conversations").select("role", "text"))
    return rows.groupBy("role", "depth_class", "primary_category").agg(F.count("*").alias("remarks"))


def mismatch_list(spark, d):
    """Nations whose registers disagree."""
    return QUERIES["register_agreement"](spark, d).where(F.contains("status", F.lit("mismatch")))


def forbidden_names(spark, d):
    """Canonical names that hold what no name may hold; none if all is well, as here for half of the patterns."""
    bad = ("Customer#00000000", "unknown", "n/a")
    return I.table(spark, d, "customer").where(F.lower("c_name").rlike("|".join(b.lower() for b in bad))).select("c_custkey", "c_name")


def event_windows(spark, d):
    """Events by day and type: the batch form of the tumbling-window stream."""
    return I.table(spark, d, "events").groupBy(F.date_format(F.window("ts", "1 day")["start"], "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


def register_agreement(spark, d):
    """Registers in agreement: each nation's customers and suppliers, and whether both are there."""
    c = I.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = I.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    status = F.when(F.col("customers").isNull(), "mismatch_supplier_only").when(F.col("suppliers").isNull(), "mismatch_customer_only").otherwise("agree")
    return c.join(s, "nation", "full_outer").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), status.alias("status"))


#: Anchors of the summary of orders, one for each operator and two that are errors.
ANCHORS = [
    {"anchor_id": "orders_floor", "artifact": "orders", "json_path": ["orders"], "operator": "at_least", "minimum": 1},
    {"anchor_id": "open_share", "artifact": "orders", "filter": {"list_path": ["by_status"], "where": {"status": "O"}, "value_path": ["share"]}, "operator": "between", "minimum": 0.2, "maximum": 0.6},
    {"anchor_id": "done_share", "artifact": "orders", "filter": {"list_path": ["by_status"], "where": {"status": "F"}, "value_path": ["share"]}, "operator": "approx", "expected": 0.33, "tolerance": 0.02},
    {"anchor_id": "kind_of_count", "artifact": "orders", "json_path": ["orders"], "operator": "equal", "expected": 1.0},
    {"anchor_id": "no_order_without_status", "artifact": "orders", "operands": [{"name": "nameless", "json_path": ["nameless"]}], "operator": "sum_equal", "expected": 0},
    {"anchor_id": "orders_over_customers", "artifact": "orders", "operands": ["orders", "customers"], "operator": "difference_at_least", "minimum_difference": 0},
    {"anchor_id": "no_such_status", "artifact": "orders", "filter": {"list_path": ["by_status"], "where": {"status": "Z"}, "value_path": ["share"]}, "operator": "at_least", "minimum": 0},
    {"anchor_id": "text_is_no_number", "artifact": "orders", "json_path": ["commonest"], "operator": "at_least", "minimum": 0},
]


def golden_checks(spark, d):
    """Anchors held against a summary of all orders."""
    o = I.table(spark, d, "orders")
    by = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    total = o.agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus").isNull()).alias("nameless"))
    listed = by.crossJoin(F.broadcast(total)).groupBy("orders", "customers", "nameless").agg(  # a row a status
        F.array_sort(F.collect_list(F.struct("status", "n", (F.col("n") / F.col("orders")).alias("share")))).alias("by_status"), F.min(F.struct((-F.col("n")).alias("n"), "status"))["status"].alias("commonest")
    )
    return K.run(spark, ANCHORS, {"orders": listed}).select("anchor_id", "operator", "status")


QUERIES = {f.__name__: f for f in (
    golden_checks,
    linkage, priority_pick, alias_resolution, name_variants, eligible_cells, selection_dedup, reconcile, label_upsert, file_selection, resume_filter, review_records, sessions, expert_variance,
    remark_categories, remark_recurrence, recall_pivot, confusion, quarter_activity, quality_counts, mismatch_list, forbidden_names, event_windows, register_agreement,
)}

_W = I.with_
_SESS = """ev as (select user_id, strftime(ts::date, '%Y-%m-%d') "day", (props->>'$.k')::int object_id, event_type in ('purchase', 'signup') clean, event_type = 'error' remark from events),
oc as (select user_id, "day", object_id, bool_or(clean) clean, bool_or(remark) remark, count(*) source_rows from ev group by all),
s0 as (select user_id, "day", count(*) items, count(distinct object_id) objects, count(*) filter (clean) clean, count(*) filter (remark) remarks, count(*) filter (clean or remark) classified from oc group by all),
se as (
  select *, items - classified unresolved, round(classified / items + 1e-9::double, 4) classified_share, round(clean / items + 1e-9::double, 4) clean_share, round(remarks / items + 1e-9::double, 4) remark_share, round(clean / nullif(classified, 0) + 1e-9::double, 4) clean_share_classified,
    round(remarks / nullif(classified, 0) + 1e-9::double, 4) remark_share_classified, case when objects > 1 then 'multi_object_batch' else 'single_object_session' end kind from s0)"""
_R = lambda x: f"round({x} + 1e-9::double, 4)"
_FOUND = "list_filter([" + ", ".join(f"case when regexp_matches(n, '{p}') then '{name}' end" for name, p in [(name, p.replace(r"\bтэп\b", r"(^|[^\p{L}\p{N}_])тэп([^\p{L}\p{N}_]|$)").replace(r"\b", r"(^|[^\p{L}\p{N}_])", 1).replace(r"\b", r"([^\p{L}\p{N}_]|$)") if name != "technical_economic_indicators" else p.replace(r"\bтэп\b", r"(^|[^\p{L}\p{N}_])тэп([^\p{L}\p{N}_]|$)")) for name, p in V.CATEGORIES]) + "], lambda x: x is not null)"
_NAMES = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_REM = "rm0 as (select conv_id, turn, role, " + I._NORM.format("text") + r""" n from conversations),
rm1 as (select *, """ + _FOUND + r""" found, len(regexp_extract_all(n, '[\p{L}\p{N}_]+')) w from rm0),
rm2 as (select *, case when len(found) > 0 then found else ['other'] end cats from rm1),
rm as (
  select *, cats[1] primary_category, list_filter(cats, lambda x: x <> 'regulatory') kinds from rm2),
rmd as (
  select *, case when list_has_any(kinds, """ + _NAMES(V.ENGINEERING) + """) and (w >= 25 or len(kinds) >= 2) then 'substantial_candidate' when len(list_filter(kinds, lambda x: not list_contains(""" + _NAMES(V.SIMPLE) + """, x))) = 0 and w <= 22 then 'simple_candidate' else 'review_needed' end depth_class from rm)"""

ORACLES = {
    "golden_checks": """with o as (select count(*) n, count(distinct o_custkey) c, count(*) filter (o_orderstatus is null) z, count(*) filter (o_orderstatus = 'O') / count(*) so, count(*) filter (o_orderstatus = 'F') / count(*) sf from orders),
t(anchor_id, operator, ok) as (
  select 'orders_floor', 'at_least', n >= 1 from o union all select 'open_share', 'between', so between 0.2 and 0.6 from o union all select 'done_share', 'approx', abs(sf - 0.33) <= 0.02 from o
  union all select 'kind_of_count', 'equal', false union all select 'no_order_without_status', 'sum_equal', z = 0 from o union all select 'orders_over_customers', 'difference_at_least', n - c >= 0 from o
  union all select 'no_such_status', 'at_least', null union all select 'text_is_no_number', 'at_least', null)
select anchor_id, operator, case when ok then 'pass' when not ok then 'fail' else 'error' end status from t""",
    "linkage": """with x as (select doc_id, sha1(text) content from documents), s as (select content, doc_id source_doc, count(*) over (partition by content) n from x where doc_id % 2 = 0),
e as (select content, doc_id export_doc, count(*) over (partition by content) n from x where doc_id % 2 = 1)
select content, source_doc, export_doc, case when s.n is null then 'export_only' when e.n is null then 'source_only' else 'matched' end link_status, coalesce(s.n, 0) source_match_count, coalesce(e.n, 0) export_match_count from s full outer join e using (content)""",
    "priority_pick": "select o_custkey, o_orderkey, o_orderpriority from orders qualify row_number() over (partition by o_custkey order by o_orderpriority, o_orderdate desc, o_orderkey) = 1",
    "alias_resolution": "select s_suppkey, r_name canonical from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "name_variants": "select p_type, p_brand, n from (select p_type, p_brand, count(*) n, min(p_partkey) seen from part group by all) qualify row_number() over (partition by p_type order by n desc, seen) = 1",
    "eligible_cells": """select *, leads >= 2 and objects >= 3 h1, organizations >= 2 and objects >= 2 h2 from (select l_returnflag, l_linestatus, l_linenumber, count(distinct l_suppkey) leads, count(distinct s_nationkey) organizations, count(distinct l_orderkey) objects
from lineitem join supplier on l_suppkey = s_suppkey group by all)""",
    "selection_dedup": "select sha1(text) content, min(doc_id) doc_id, count(*) copies, string_agg(distinct source, '|' order by source) sources from documents group by 1",
    "reconcile": """select p.p_partkey, case when o.p_name is null or o.p_name = '' then 'missing' when p.p_name = o.p_name then 'match' when levenshtein(p.p_name, o.p_name) <= 1 then 'near_match'
  when contains(p.p_name, o.p_name) or contains(o.p_name, p.p_name) then 'contained' else 'mismatch' end status from part p left join part o on o.p_partkey - 1 = p.p_partkey""",
    "label_upsert": "select doc_id, case when quality = 0 then 'bad' else lang end review_label from documents left join labels using (doc_id)",
    "file_selection": "select page_id, case when regexp_matches(url, '[?&]page=') then 'paged' when contains(url, '#') then 'anchored' when contains(url, '//m.') then 'mobile' when contains(url, '.org/') then 'organization' else 'selected' end reason from pages",
    "resume_filter": "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "review_records": _W(_SESS, "select * from oc"),
    "sessions": _W(_SESS, "select * from se"),
    "expert_variance": _W(_SESS, "select user_id, count(*) sessions, " + ", ".join(f"{_R(e)} \"{n}\"" for n, e in {
        "mean": "avg(clean_share)", "median": "median(clean_share)", "variance": "var_pop(clean_share)", "deviation": "stddev_pop(clean_share)", "min": "min(clean_share)", "p10": "quantile_cont(clean_share, 0.1)", "p90": "quantile_cont(clean_share, 0.9)",
        "max": "max(clean_share)", "range": "max(clean_share) - min(clean_share)", "low_share": "avg((clean_share <= 0.25)::int)", "high_share": "avg((clean_share >= 0.75)::int)", "remark_variance": "var_pop(remark_share)",
        "classified_mean": "avg(classified_share)", "weighted_clean": "sum(clean) / sum(items)", "weighted_remarks": "sum(remarks) / sum(items)",
    }.items()) + ", case when count(*) >= 2 then 'measured_across_sessions' else 'insufficient_single_session' end status from se group by 1"),
    "remark_categories": _W(_REM, "select conv_id, turn, sha1(n) remark_hash, length(n)::bigint char_count, w::bigint word_count, primary_category, depth_class from rmd"),
    "remark_recurrence": _W(_REM, "select sha1(n) remark_hash, count(distinct conv_id) documents, string_agg(distinct role, '|' order by role) roles from rm0 group by 1 having count(distinct conv_id) >= 2"),
    "quality_counts": _W(_REM, "select role, depth_class, primary_category, count(*) remarks from rmd group by all"),
    "recall_pivot": "select c_mktsegment, " + ", ".join(f"round(avg(case when o_orderpriority = '1-URGENT' then 1.0::double else 0.0 end) filter (o_orderstatus = '{s}'), 4) recall_{s.lower()}" for s in "FOP") + " from orders join customer on o_custkey = c_custkey group by 1",
    "confusion": """with g as (select quality, (len(string_split(text, ' ')) >= 50 and not regexp_matches(text, '[#$%&|]'))::int guess from documents join labels using (doc_id)), n as (select quality, guess, count(*) n from g group by all)
select quality, guess, n, round(sum(n * (quality = guess)::int) over (partition by guess) / sum(n) over (partition by guess), 4) "precision", round(sum(n * (quality = guess)::int) over (partition by quality) / sum(n) over (partition by quality), 4) recall from n""",
    "quarter_activity": "select o_custkey, year(o_orderdate)::varchar || '-Q' || quarter(o_orderdate)::varchar as quarter, count(*) orders from orders group by all",
    "event_windows": "select strftime(ts::date, '%Y-%m-%d') \"day\", event_type, count(*) events, round(sum(value::decimal(18,2))::double, 2) total from events group by all",
    "register_agreement": """with c as (select c_nationkey nation, count(*) customers from customer group by 1), s as (select s_nationkey nation, count(*) suppliers from supplier group by 1)
select nation, coalesce(customers, 0) customers, coalesce(suppliers, 0) suppliers, case when customers is null then 'mismatch_supplier_only' when suppliers is null then 'mismatch_customer_only' else 'agree' end status from c full outer join s using (nation)""",
    "mismatch_list": """select * from (with c as (select c_nationkey nation, count(*) customers from customer group by 1), s as (select s_nationkey nation, count(*) suppliers from supplier group by 1)
select nation, coalesce(customers, 0) customers, coalesce(suppliers, 0) suppliers, case when customers is null then 'mismatch_supplier_only' when suppliers is null then 'mismatch_customer_only' else 'agree' end status from c full outer join s using (nation)) where contains(status, 'mismatch')""",
    "forbidden_names": "select c_custkey, c_name from customer where regexp_matches(lower(c_name), 'customer#00000000|unknown|n/a')",
}
