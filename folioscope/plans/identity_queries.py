"""Queries of organisation similarity: summaries, cells, retention, organisation matrix, typed graph, clusters, distance buckets, title profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import cells as L
from ..operators import components as C
from ..operators import entities as E
from ..operators import identity as D
from ..operators import ordered as O
from ..operators import scores as W
from ..operators import stats as A
from ..operators import titles as Z
from ..storage import stored
from . import inputs as I
from . import pair_queries as P

CHANNELS = ("style", "shingle", "strong")
ORGS = 20


def _scores(spark, d):
    """Pairs with their IDF similarity as value."""
    return P.idf_pair_similarity(spark, d).withColumnRenamed("idf_similarity", "value")


def org_similarity_summary(spark, d):
    kind = F.when(F.col("left_org") == F.col("right_org"), "within").otherwise("cross")
    rows = stored(_scores(spark, d).select(kind.alias("pair_type"), "section", "value"), "pair-values")
    return A.summary(rows, ["pair_type", "section"], "value")


def separation_gap(spark, d):
    """Median within less median across organisations, for each section that has both."""
    rows = stored(_scores(spark, d).select("section", (F.col("left_org") == F.col("right_org")).alias("same"), "value"), "pair-values")
    found = O.quantiles(rows, ["section", "same"], "value", {"middle": 0.5})
    out = found.groupBy("section").agg(F.max(F.when(F.col("same"), F.col("middle"))).alias("inside"), F.max(F.when(~F.col("same"), F.col("middle"))).alias("across"))
    rounded = [F.round(c + 1e-9, 4).alias(n) for n, c in (("inside", F.col("inside")), ("across", F.col("across")), ("gap", F.col("inside") - F.col("across")))]
    return out.where("inside is not null and across is not null").select("section", *rounded)


def cross_neighbors(spark, d):
    """The 3 best partners of other organisations for each document, with the axes of their likeness."""
    rows = _scores(spark, d).where("left_org <> right_org")
    keep = ["section", "value", "text_segment_idf", "text_word_shingle_idf", "table_cell_text_idf"]
    both = rows.select(F.col("left_doc").alias("query_doc"), F.col("right_doc").alias("neighbor_doc"), *keep).unionByName(
        rows.select(F.col("right_doc").alias("query_doc"), F.col("left_doc").alias("neighbor_doc"), *keep)
    )
    place = F.row_number().over(Window.partitionBy("query_doc").orderBy(F.desc("value"), "neighbor_doc")).cast("bigint")
    return both.withColumn("neighbor_rank", place).where("neighbor_rank <= 3").withColumnRenamed("value", "score")


def top_pairs(spark, d):
    """The 20 best cross-organisation pairs of each section."""
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("value"), "left_doc", "right_doc")).cast("bigint")
    return _scores(spark, d).where("left_org <> right_org").withColumn("place", place).where("place <= 20").select("section", "left_doc", "right_doc", F.col("value").alias("score"), "place")


def section_percentile(spark, d):
    """The share of a section's pairs that score no higher."""
    rows = stored(_scores(spark, d).select("pair_id", "section", "value"), "pair-values")
    return O.with_places(rows, ["section"], "value", share=O.UP_TO).select("pair_id", F.round(F.col("share") + 1e-9, 4).alias("percentile"))


THRESHOLDS = (0.75, 0.60, 0.45)


def _clusters(spark, d, scores):
    """section-and-threshold, member, cluster_id: components of the canonical documents of each section at each threshold."""
    docs = I.canonical(spark, d).select("doc_id", "section")
    out = None
    for t in THRESHOLDS:
        edges = scores.where(F.col("value") >= t).select(F.col("left_doc").alias("a"), F.col("right_doc").alias("b"))
        part = C.components(edges, docs.select(F.col("doc_id").alias("member"))).withColumn("threshold", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out.join(docs.select(F.col("doc_id").alias("member"), "section"), "member")


def clusters(spark, d):
    """Components at the three thresholds; documents without such a partner stand alone."""
    return _clusters(spark, d, stored(_scores(spark, d), "scores")).select("section", "threshold", "member", "component_id")


def cluster_summary(spark, d):
    """Per section and threshold: components, those of two or more, the largest."""
    sizes = clusters(spark, d).groupBy("section", "threshold", "component_id").agg(F.count("*").alias("n"))
    return sizes.groupBy("section", "threshold").agg(F.sum("n").alias("documents"), F.count("*").alias("components"), F.count_if(F.col("n") > 1).alias("shared"), F.max("n").alias("largest"))


def cluster_medians(spark, d):
    """Medians of score and axes over the pairs inside each component of the lowest threshold."""
    scores = stored(_scores(spark, d), "scores")
    found = _clusters(spark, d, scores).where(F.col("threshold") == THRESHOLDS[-1]).select("member", F.col("component_id").alias("cluster_id"))
    pairs = scores.select(F.col("left_doc").alias("left"), F.col("right_doc").alias("right"), F.col("value").alias("score"), F.col("text_segment_idf").alias("segment"), F.col("page_signature_idf").alias("page"))
    return L.cluster_medians(found, pairs, ["score", "segment", "page"]).where("size > 1")


def pair_explanations(spark, d):
    """Where shared segments stand in both documents of pairs that are alike."""
    segs = E.normalized_segments(E.segments(I.canonical(spark, d))).select("doc_id", "seg_no", T.text_hash(F.col("normalized")).alias("h"))
    pairs = _scores(spark, d).where("value >= 0.3 and left_org <> right_org").select("left_doc", "right_doc")
    l = segs.select(F.col("doc_id").alias("left_doc"), F.col("seg_no").cast("bigint").alias("left_seg"), "h")
    r = segs.select(F.col("doc_id").alias("right_doc"), F.col("seg_no").cast("bigint").alias("right_seg"), "h")
    return pairs.join(l, "left_doc").join(r, ["right_doc", "h"]).select("left_doc", "right_doc", "left_seg", "right_seg", F.col("h").alias("entity_hash"))


def _channels(spark, d):
    """Pairs by section (the cell) with the three channels: style composition, shingles, and whole segments."""
    styled = P._styled(spark, d).select("pair_id", "style_composition")
    rows = P.axes(spark, d).join(styled, "pair_id")
    value = {"style": "style_composition", "shingle": "raw_text_word_shingle", "strong": "raw_text_segment"}
    return rows.select("pair_id", F.col("section").alias("cell"), "left_org", "right_org", *[F.round(F.col(c) + 1e-9, 4).alias(k) for k, c in value.items()])


def _cell_orgs(spark, d):
    rows = _channels(spark, d).groupBy("cell", F.least("left_org", "right_org").alias("left_org"), F.greatest("left_org", "right_org").alias("right_org"))
    rows = rows.agg(F.count("*").alias("pairs"), *[F.round(F.median(c) + 1e-9, 4).alias(c) for c in CHANNELS])
    return D.self_baselines(rows, list(CHANNELS))


def retention_medians(spark, d):
    """Per cell and pair of organisations: medians of the channels over the mean of both organisations' own, where they have one."""
    return _cell_orgs(spark, d)


def cell_summary(spark, d):
    """The median of the cells' medians."""
    rows = _channels(spark, d).withColumn("relation", F.when(F.col("left_org") == F.col("right_org"), "same_org").otherwise("cross_org"))
    return L.median_of_medians(L.cell_medians(rows, list(CHANNELS)), list(CHANNELS))


def _org(key):
    return F.concat(F.lit("src"), (F.col(key) % ORGS).cast("string"))


def _activity(spark, d):
    o = I.table(spark, d, "orders").groupBy(_org("o_custkey").alias("org"), T.quarter_label(F.to_date("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n"))
    o = stored(o, "activity")
    orgs, quarters = o.select("org").distinct(), o.select("quarter").distinct()
    pairs = orgs.select(F.col("org").alias("a")).join(orgs.select(F.col("org").alias("b")), F.col("a") < F.col("b")).crossJoin(quarters)  # organisations and quarters are few
    for x in ("a", "b"):
        pairs = pairs.join(o.select(F.col("org").alias(x), "quarter", F.col("n").alias(f"n{x}")), [x, "quarter"], "left").withColumn(f"n{x}", F.coalesce(f"n{x}", F.lit(0)))
    return pairs


def temporal_handoff(spark, d):
    """When one organisation's orders give way to another's, by quarter, and how their activities correlate."""
    return D.activity(_activity(spark, d))


def _matrix(spark, d):
    cells = stored(_cell_orgs(spark, d), "cells").where("left_org <> right_org")
    supported = F.col("baselines") >= 1
    limits = cells.where(supported).agg(F.percentile("shingle", 0.95).alias("p_shingle"), F.percentile("strong", 0.95).alias("p_strong"))
    median = lambda c: F.round(F.median(F.when(supported, F.col(c))) + 1e-9, 4)
    rows = cells.groupBy(F.col("left_org").alias("a"), F.col("right_org").alias("b")).agg(
        F.count("*").alias("compared_cells"), F.count_if(supported).alias("supported_cells"), F.sum("pairs").alias("pairs"),
        *[median(f"{c}_retention").alias(f"{c}_retention") for c in CHANNELS], *[median(c).alias(f"{c}_median") for c in CHANNELS],
    )
    rows = rows.withColumn("link_class", D.link_class(F.col("style_retention"), F.col("shingle_retention"))).crossJoin(F.broadcast(limits))  # one row
    customers = I.table(spark, d, "customer").where("c_acctbal > 9000").select(_org("c_custkey").alias("org"), F.col("c_nationkey").alias("gip")).distinct()
    shared = customers.select(F.col("org").alias("a"), "gip").join(customers.select(F.col("org").alias("b"), "gip"), "gip").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared_gips"))
    titles = I.table(spark, d, "orders").where("o_totalprice > 499000").select(_org("o_custkey").alias("x"), _org("o_orderkey").alias("y")).where("x <> y")
    titles = titles.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("disclosed"))
    rows = rows.join(shared, ["a", "b"], "left").join(titles, ["a", "b"], "left").join(D.activity(_activity(spark, d)).select("a", "b", "correlation", "handoff_score"), ["a", "b"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("shared_gips", "disclosed")}).withColumn("handoff_score", F.coalesce("handoff_score", F.lit(0.0)))
    rare = (F.coalesce("shingle_median", F.lit(0.0)) >= F.col("p_shingle")) & (F.coalesce("strong_median", F.lit(0.0)) >= F.col("p_strong"))
    return rows.withColumn("handwriting", (F.col("supported_cells") >= 2) & rare).drop("p_shingle", "p_strong")


def org_matrix(spark, d):
    """Pairs of organisations: retention, shared leads, disclosed networks, handoff, and whether their handwriting links them."""
    return _matrix(spark, d)


def _edges(spark, d):
    sizes = I.table(spark, d, "customer").where("c_acctbal > 5000").groupBy(_org("c_custkey").alias("org")).agg(F.count("*").alias("n"))
    return D.typed_edges(_matrix(spark, d), sizes)


def typed_edges(spark, d):
    return _edges(spark, d).select("a", "b", "edge_type", "basis", "a_objects", "b_objects", "large_orgs", "template_risk", "policy")


def typed_components(spark, d):
    return D.typed_components(stored(_edges(spark, d), "typed"))


def core_attachments(spark, d):
    """Edges of likeness alone that touch a component of stronger evidence."""
    edges = stored(_edges(spark, d), "typed")
    return D.attachments(edges, D.typed_components(edges)).select("a", "b", "edge_type", "a_core", "b_core", "attachment_status", "template_risk")


def tail_edges(spark, d):
    """Organisation pairs whose style median is at or above the 95th percentile of their cell, and the components they form."""
    rows = stored(_cell_orgs(spark, d), "cells").where("left_org <> right_org")
    limits = rows.groupBy("cell").agg(F.percentile("style", 0.95).alias("p95"))
    return C.components(rows.join(limits, "cell").where("style >= p95").select(F.col("left_org").alias("a"), F.col("right_org").alias("b")).distinct())


def evaluation_buckets(spark, d):
    """Pairs by the distance of their objects' attributes (two features in deviations), an address, and their score's place in the section.

    An object's attributes are the mean length and number of lines of its canonical documents; its address is its number.
    """
    rows = stored(I.profiles(I.canonical(spark, d)).select("doc_id", "words", "text_ratio"), "profiles")
    sd = rows.agg(*[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"sd_{c}") for c in ("words", "text_ratio")])
    from ..operators import features as V

    pairs = V.sides(_scores(spark, d), rows, ["words", "text_ratio"]).crossJoin(F.broadcast(sd))  # one row
    known = F.col("left_doc") % 5 != 0
    vector = lambda x: F.when(known, F.array(f"{x}_words", f"{x}_text_ratio"))
    distance = F.round(S.z_distance(vector("left"), vector("right"), F.array("sd_words", "sd_text_ratio")), 9)
    same = F.element_at(F.split("left_object", "/"), -1) == F.element_at(F.split("right_object", "/"), -1)
    pairs = stored(pairs.withColumns({"distance": distance, "same_address": same}).select("pair_id", "section", "value", "distance", "same_address"), "distances")
    limits = A.order_quartiles(pairs.where("not same_address").withColumn("one", F.lit(1)), ["one"], "distance").select("q1", "q3")
    pairs = O.with_places(pairs, ["section"], "value", share=O.UP_TO)
    out = pairs.crossJoin(F.broadcast(limits)).withColumn("bucket", L.distance_bucket(F.col("same_address"), F.col("distance"), F.col("q1"), F.col("q3")))
    return out.select("pair_id", F.round(F.col("distance") + 1e-9, 4).alias("distance"), "same_address", "bucket", F.round(F.col("share") + 1e-9, 4).alias("percentile"))


COUNTS = ["texts", "bars", "blank", "chars"]


def _profiles(spark, d):
    """Title profiles of canonical documents: page 0 is the title, pages 0 and 1 the cover, the rest the body."""
    docs = I.canonical(spark, d)
    segs = E.segments(docs)
    n = T.normalize_text(F.col("text"))
    pages = segs.groupBy("doc_id", "section", "org", F.floor(F.col("seg_no") / E.PAGE_LINES).cast("int").alias("page_no")).agg(
        F.count_if(~F.contains("text", F.lit("|")) & (n != "")).alias("texts"), F.count_if(F.contains("text", F.lit("|"))).alias("bars"), F.count_if(n == "").alias("blank"), F.sum(F.length(n)).alias("chars"), F.count("*").alias("lines")
    )
    pages = pages.withColumns({"size": F.concat(F.lit("size:"), F.col("lines").cast("string")), "signature": F.concat_ws("|", "lines", "bars", "blank")})
    rows = Z.profiles(Z.scope_pages(pages, [0], [0, 1]), COUNTS, ["doc_id", "section", "org"])
    content = docs.select("doc_id", T.text_hash(F.col("text")).alias("content"))
    return rows.join(content, "doc_id")


def title_profiles(spark, d):
    rows = _profiles(spark, d)
    return rows.select("scope", "doc_id", "pages", *[F.round(F.col("ratios")[k] + 1e-9, 4).alias(c) for k, c in enumerate(COUNTS)], F.size("signatures").cast("bigint").alias("signatures"))


def _title_pairs(spark, d, directed):
    return Z.pair_scores(Z.all_pairs(stored(_profiles(spark, d), "profiles"), directed))


def title_score(spark, d):
    """Likeness of all pairs of profiles of a scope, with and without the page size."""
    return _title_pairs(spark, d, False).select("scope", F.col("left_doc_id").alias("left"), F.col("right_doc_id").alias("right"), "pair_type", "section_relation", "ratio", "composition", "page_size", "exact_page", "with_size", "no_size")


def title_summary(spark, d):
    """p10, median and p90 of both scores by scope, pair type and section relation."""
    by, names = ["scope", "pair_type", "section_relation"], {"p10": 0.1, "median": 0.5, "p90": 0.9}
    rows = stored(_title_pairs(spark, d, False).select(*by, "with_size", "no_size"), "title-pairs")
    out = rows.groupBy(*by).agg(F.count("*").alias("pairs"))
    for m in ("with_size", "no_size"):
        out = out.join(O.quantiles(rows, by, m, names).select(*by, *[F.round(F.col(n) + 1e-9, 4).alias(f"{m}_{n}") for n in names]), by)
    return out


def title_nearest(spark, d):
    """The nearest profile of another content for each profile, by either score."""
    return Z.nearest(_title_pairs(spark, d, True)).select("scope", "metric", "doc_id", "nearest", "pair_type", "section_relation", "score")


def nearest_counts(spark, d):
    return title_nearest(spark, d).groupBy("scope", "metric", "pair_type").agg(F.count("*").alias("profiles"))


QUERIES = {f.__name__: f for f in (
    org_similarity_summary, separation_gap, cross_neighbors, top_pairs, section_percentile, clusters, cluster_summary, cluster_medians, pair_explanations, retention_medians, cell_summary,
    temporal_handoff, org_matrix, typed_edges, typed_components, core_attachments, tail_edges, evaluation_buckets, title_profiles, title_score, title_summary, title_nearest, nearest_counts,
)}

_W, _R4 = I.with_, P.R4
_SC = P._SIMQ + f""",
sco as (select pair_id, section, left_doc, right_doc, left_object, right_object, left_org, right_org, {_R4('score')} "value", {_R4('idf_text_segment')} text_segment_idf, {_R4('idf_text_word_shingle')} text_word_shingle_idf, {_R4('idf_table_cell_text')} table_cell_text_idf, {_R4('idf_page_signature')} page_signature_idf from sims)"""
_SUM = """count("value") n, round(avg("value"), 4) mean, round(quantile_cont("value", 0.1), 4) p10, round(quantile_cont("value", 0.5), 4) median, round(quantile_cont("value", 0.9), 4) p90, round(min("value"), 4) min, round(max("value"), 4) max"""
_CL = _SC + """,
th(threshold) as (values """ + ", ".join(f"({t}::double)" for t in THRESHOLDS) + """),
lk as (select threshold, left_doc a, right_doc b from sco, th where "value" >= threshold union all select threshold, right_doc, left_doc from sco, th where "value" >= threshold),
reach(threshold, x, y) as (select threshold, doc_id, doc_id from canon, th union select r.threshold, r.x, l.b from reach r join lk l on r.y = l.a and r.threshold = l.threshold),
clu as (select section, threshold, x member, min(y) component_id from reach join canon on canon.doc_id = x group by all)"""
_CH = P._AXES_F + f""",
sty as (select pair_id, {P._STYLE['style_ratio']} style_ratio, {P._STYLE['style_composition']} style_composition{P._FJ}),
ch as (select pair_id, section cell, left_org, right_org, {_R4('style_composition')} style, {_R4('raw_text_word_shingle')} shingle, {_R4('raw_text_segment')} strong from axs join sty using (pair_id))"""
_CO = _CH + """,
co as (select cell, least(left_org, right_org) left_org, greatest(left_org, right_org) right_org, count(*) pairs, """ + ", ".join(f"{_R4(f'median({c})')} {c}" for c in CHANNELS) + """ from ch group by all),
se0 as (
  select co.*, (l.cell is not null)::int + (r.cell is not null)::int baselines, """ + ", ".join(f"(coalesce(l.{c}, 0) + coalesce(r.{c}, 0)) / nullif((l.cell is not null)::int + (r.cell is not null)::int, 0) f_{c}" for c in CHANNELS) + """
  from co left join co l on l.cell = co.cell and l.left_org = co.left_org and l.right_org = co.left_org left join co r on r.cell = co.cell and r.left_org = co.right_org and r.right_org = co.right_org),
se as (select cell, left_org, right_org, pairs, """ + ", ".join(CHANNELS) + ", baselines, " + ", ".join(f"{_R4(f'f_{c}')} {c}_reference, {_R4(f'case when f_{c} <> 0 then {c} / f_{c} end')} {c}_retention" for c in CHANNELS) + " from se0)"
_ACT = f"""qn as (select 'src' || (o_custkey % {ORGS})::varchar org, year(o_orderdate)::varchar || '-Q' || quarter(o_orderdate)::varchar q, count(*) n from orders group by all),
pq as (
  select x.org a, y.org b, z.q, coalesce(l.n, 0) na, coalesce(r.n, 0) nb from (select distinct org from qn) x join (select distinct org from qn) y on x.org < y.org cross join (select distinct q from qn) z
  left join qn l on l.org = x.org and l.q = z.q left join qn r on r.org = y.org and r.q = z.q where coalesce(l.n, 0) + coalesce(r.n, 0) > 0),
pk as (
  select *, row_number() over (partition by a, b order by q) place, coalesce(sum(na) over (partition by a, b order by q rows between unbounded preceding and 1 preceding) / nullif(sum(na) over (partition by a, b), 0), 0.0) xa,
    coalesce(sum(nb) over (partition by a, b order by q rows between unbounded preceding and 1 preceding) / nullif(sum(nb) over (partition by a, b), 0), 0.0) xb, sum(na) over (partition by a, b) ta, sum(nb) over (partition by a, b) tb from pq),
pf2 as (select *, xa * (case when tb > 0 then 1 - xb else 0.0 end) f, xb * (case when ta > 0 then 1 - xa else 0.0 end) g from pk),
ph as (select *, case when place > 1 then round(greatest(f, g), 12) else 0.0 end score from pf2),
pb as (select * from ph qualify row_number() over (partition by a, b order by score desc, place) = 1),
pr as (select a, b, count(*) "quarters", covar_pop(na, nb) / nullif(stddev_pop(na) * stddev_pop(nb), 0) r from pq group by all),
act as (
  select pr.a, pr.b, "quarters", round(r, 4) correlation, round(score, 4) handoff_score, case when score > 0 then case when f >= g then pr.a || ' -> ' || pr.b else pr.b || ' -> ' || pr.a end else '' end direction, case when score > 0 then q else '' end boundary
  from pr join pb using (a, b))"""
_MX = _CO + ",\n" + _ACT + f""",
lim as (select quantile_cont(shingle, 0.95) p_shingle, quantile_cont(strong, 0.95) p_strong from se where left_org <> right_org and baselines >= 1),
mx0 as (
  select left_org a, right_org b, count(*) compared_cells, count(*) filter (baselines >= 1) supported_cells, sum(pairs)::bigint pairs, """ + ", ".join(f"{_R4(f'median({c}_retention) filter (baselines >= 1)')} {c}_retention, {_R4(f'median({c}) filter (baselines >= 1)')} {c}_median" for c in CHANNELS) + f""" from se where left_org <> right_org group by all),
gp as (select distinct 'src' || (c_custkey % {ORGS})::varchar org, c_nationkey gip from customer where c_acctbal > 9000),
sg as (select x.org a, y.org b, count(*) shared_gips from gp x join gp y on x.gip = y.gip and x.org < y.org group by all),
tt as (select 'src' || (o_custkey % {ORGS})::varchar x, 'src' || (o_orderkey % {ORGS})::varchar y from orders where o_totalprice > 499000),
td as (select least(x, y) a, greatest(x, y) b, count(*) disclosed from tt where x <> y group by all),
mx as (
  select mx0.*, case when coalesce(style_retention, 0) >= 0.75 and coalesce(shingle_retention, 0) >= 0.40 then 'handwriting_transfer_both' when coalesce(style_retention, 0) >= 0.75 then 'handwriting_structure_led' when coalesce(shingle_retention, 0) >= 0.40 then 'handwriting_content_led' else 'no_transfer_at_v0_thresholds' end link_class,
    coalesce(shared_gips, 0) shared_gips, coalesce(disclosed, 0) disclosed, correlation, coalesce(handoff_score, 0.0) handoff_score, supported_cells >= 2 and coalesce(shingle_median, 0) >= p_shingle and coalesce(strong_median, 0) >= p_strong handwriting
  from mx0 cross join lim left join sg using (a, b) left join td using (a, b) left join act using (a, b)),
og as (select 'src' || (c_custkey % {ORGS})::varchar org, count(*) n from customer where c_acctbal > 5000 group by 1),
te as (
  select mx.*, case when disclosed > 0 then 'disclosed_subcontract_network' when handwriting and shared_gips > 0 and handoff_score >= 0.40 then 'rename_candidate' when handwriting and shared_gips > 0 then 'shared_gip_handwriting' when handwriting then 'owner_or_template_candidate' else 'not_in_identity_graph' end edge_type,
    coalesce(l.n, 0) a_objects, coalesce(r.n, 0) b_objects, (select quantile_cont(n, 0.9) from og) lm from mx left join og l on l.org = a left join og r on r.org = b),
ed as (
  select *, case when a_objects >= lm then a || case when b_objects >= lm then '|' || b else '' end when b_objects >= lm then b else '' end large_orgs from te where edge_type <> 'not_in_identity_graph'),
edg as (select *, edge_type = 'owner_or_template_candidate' and large_orgs <> '' template_risk from ed)"""
_TC = _MX + """,
bo as (select edge_type, a, b from edg union all select edge_type, b, a from edg),
rc(edge_type, x, y) as (select edge_type, a, a from bo union select r.edge_type, r.x, e.b from rc r join bo e on r.y = e.a and r.edge_type = e.edge_type),
tcm as (select edge_type, x member, min(y) component_id from rc group by all)"""
_CELLS = _CH + """,
cm0 as (
  select cell, count(*) filter (left_org = right_org) same_org_pairs, count(*) filter (left_org <> right_org) cross_org_pairs, """ + ", ".join(f"median({c}) filter (left_org = right_org) s_{c}, median({c}) filter (left_org <> right_org) x_{c}" for c in CHANNELS) + """ from ch group by 1),
cm as (
  select cell, same_org_pairs, cross_org_pairs, case when same_org_pairs > 0 and cross_org_pairs > 0 then 'matched_same_and_cross' when cross_org_pairs > 0 then 'cross_only_no_same_org_baseline' else 'same_only_no_cross_org_test' end comparison_status, """ + ", ".join(
    f"{_R4(f's_{c}')} same_org_{c}, {_R4(f'x_{c}')} cross_org_{c}, round(x_{c} - s_{c}, 4) cross_minus_same_{c}, {_R4(f'case when s_{c} <> 0 then x_{c} / s_{c} end')} cross_to_same_{c}" for c in CHANNELS
) + " from cm0)"


def _channel_sql(names) -> str:
    strong = " + ".join(f"(coalesce(cross_to_same_{c}, 0) >= 0.75)::int" for c in names)
    weak = " + ".join(f"(coalesce(cross_to_same_{c}, 0) >= 0.40)::int" for c in names)
    return f"case when {strong} = {len(names)} then 'transfer' when {strong} >= 1 or {weak} = {len(names)} then 'partial' else 'org_bound' end"


_TP = I.PROFILES + ",\n" + I.CANON + """,
cl as (select doc_id, canon.section, org, seg_no // 20 page_no, contains(text, '|') bar, """ + I._NORM.format("text") + """ n from segs join canon using (doc_id)),
cp as (select doc_id, section, org, page_no, count(*) filter (not bar and n <> '') texts, count(*) filter (bar) bars, count(*) filter (n = '') blank, sum(length(n)) chars, count(*) as lines from cl group by all),
sp as (select 'title_anchor' scope, * from cp where page_no = 0 union all select 'cover_zone', * from cp where page_no in (0, 1) union all select 'body', * from cp where page_no not in (0, 1)),
pr0 as (select scope, doc_id, section, org, count(*) pages, """ + ", ".join(f'sum("{c}")::double "{c}"' for c in COUNTS) + """ from sp group by all),
pro as (select scope, doc_id, section, org, pages, sha1(documents.text) content, """ + ", ".join(f'"{c}" / pages "r_{c}"' for c in COUNTS) + ", " + ", ".join(f'coalesce("{c}" / nullif(' + " + ".join(f'"{x}"' for x in COUNTS) + f', 0), 0) "s_{c}"' for c in COUNTS) + """ from pr0 join documents using (doc_id)),
zs1 as (select scope, doc_id, 'size:' || lines k, count(*) n from sp group by all),
zs2 as (select scope, doc_id, lines || '|' || bars || '|' || blank k, count(*) n from sp group by all),
zt as (select scope, doc_id, sum(n)::bigint t from zs1 group by all),
j1 as (select a.scope, a.doc_id x, b.doc_id y, sum(least(a.n, b.n))::bigint s from zs1 a join zs1 b on a.scope = b.scope and a.k = b.k and a.doc_id <> b.doc_id group by all),
j2 as (select a.scope, a.doc_id x, b.doc_id y, sum(least(a.n, b.n))::bigint s from zs2 a join zs2 b on a.scope = b.scope and a.k = b.k and a.doc_id <> b.doc_id group by all),
tp0 as (
  select l.scope, l.doc_id x, r.doc_id y, l.content xc, r.content yc, case when l.org = r.org then 'within_org' else 'cross_org' end pair_type, case when l.section = r.section then 'same_section' else 'different_section' end section_relation,
    """ + P.sql_ratio([f'l."r_{c}"' for c in COUNTS], [f'r."r_{c}"' for c in COUNTS]) + " ratio, " + P.sql_least([f'l."s_{c}"' for c in COUNTS], [f'r."s_{c}"' for c in COUNTS]) + """ composition,
    coalesce(j1.s, 0) / (a.t + b.t - coalesce(j1.s, 0)) page_size, coalesce(j2.s, 0) / (a.t + b.t - coalesce(j2.s, 0)) exact_page
  from pro l join pro r on l.scope = r.scope and l.doc_id <> r.doc_id join zt a on a.scope = l.scope and a.doc_id = l.doc_id join zt b on b.scope = r.scope and b.doc_id = r.doc_id
  left join j1 on j1.scope = l.scope and j1.x = l.doc_id and j1.y = r.doc_id left join j2 on j2.scope = l.scope and j2.x = l.doc_id and j2.y = r.doc_id),
tp as (select *, """ + f"{_R4('0.6::double * ratio + 0.3::double * composition + 0.1::double * page_size')} with_size, {_R4('(0.6::double * ratio + 0.3::double * composition) / (0.6::double + 0.3::double)')} no_size" + " from tp0)"
_NEAR = _TP + """,
nm as (select scope, 'with_size' metric, x, y, yc, pair_type, section_relation, with_size score from tp where xc <> yc union all select scope, 'no_size', x, y, yc, pair_type, section_relation, no_size from tp where xc <> yc),
nr as (select * from nm qualify row_number() over (partition by scope, metric, x order by score desc, yc, y) = 1)"""

ORACLES = {
    "org_similarity_summary": _W(_SC, f"select case when left_org = right_org then 'within' else 'cross' end pair_type, section, {_SUM} from sco group by all"),
    "separation_gap": _W(_SC, f"""select section, {_R4('w')} inside, {_R4('a')} across, {_R4('w - a')} gap from (select section, median("value") filter (left_org = right_org) w, median("value") filter (left_org <> right_org) a from sco group by 1) where w is not null and a is not null"""),
    "cross_neighbors": _W(_SC, """select query_doc, section, neighbor_doc, "value" score, text_segment_idf, text_word_shingle_idf, table_cell_text_idf, neighbor_rank from (select *, row_number() over (partition by query_doc order by "value" desc, neighbor_doc) neighbor_rank from (
  select left_doc query_doc, right_doc neighbor_doc, * from sco where left_org <> right_org union all select right_doc, left_doc, * from sco where left_org <> right_org)) where neighbor_rank <= 3"""),
    "top_pairs": _W(_SC, """select section, left_doc, right_doc, "value" score, place from (select *, row_number() over (partition by section order by "value" desc, left_doc, right_doc) place from sco where left_org <> right_org) where place <= 20"""),
    "section_percentile": _W(_SC, f"""select pair_id, {_R4('cume_dist() over (partition by section order by "value")')} percentile from sco"""),
    "clusters": "with recursive " + _CL + " select section, threshold, member, component_id from clu",
    "cluster_summary": "with recursive " + _CL + " select section, threshold, sum(n)::bigint documents, count(*) components, count(*) filter (n > 1) shared, max(n) largest from (select section, threshold, component_id, count(*) n from clu group by all) group by all",
    "cluster_medians": "with recursive " + _CL + f""" select component_id cluster_id, any_value(size) size, count(s."value") internal_pairs, {_R4('median(s."value")')} median_score, round(min(s."value"), 4) min_score, round(max(s."value"), 4) max_score,
  {_R4('median(s.text_segment_idf)')} median_segment, round(min(s.text_segment_idf), 4) min_segment, round(max(s.text_segment_idf), 4) max_segment, {_R4('median(s.page_signature_idf)')} median_page, round(min(s.page_signature_idf), 4) min_page, round(max(s.page_signature_idf), 4) max_page
from (select * from clu where threshold = {THRESHOLDS[-1]}) l join (select component_id, count(*) size from clu where threshold = {THRESHOLDS[-1]} group by 1) z using (component_id)
join (select * from clu where threshold = {THRESHOLDS[-1]}) r using (component_id) join sco s on s.left_doc = l.member and s.right_doc = r.member where size > 1 group by component_id""",
    "pair_explanations": _W(_SC, """select left_doc, right_doc, l.seg_no left_seg, r.seg_no right_seg, sha1(l.normalized) entity_hash from sco join norm l on l.doc_id = left_doc join norm r on r.doc_id = right_doc and l.normalized = r.normalized where "value" >= 0.3 and left_org <> right_org"""),
    "retention_medians": _W(_CO, "select * from se"),
    "cell_summary": _W(_CELLS, "select count(*) cells, sum(same_org_pairs)::bigint same_org_pairs, sum(cross_org_pairs)::bigint cross_org_pairs, " + ", ".join(f"{_R4(f'median({n}_{c})')} {n}_{c}" for c in CHANNELS for n in ("same_org", "cross_org", "cross_minus_same")) + " from cm where comparison_status = 'matched_same_and_cross'"),
    "temporal_handoff": "with " + _ACT + " select * from act",
    "org_matrix": _W(_MX, "select * from mx"),
    "typed_edges": _W(_MX, "select a, b, edge_type, case edge_type " + " ".join(f"when '{k}' then '{v}'" for k, v in D.BASIS.items()) + " end basis, a_objects, b_objects, large_orgs, template_risk, case when edge_type in ('rename_candidate', 'disclosed_subcontract_network') then 'core_identity_component' else 'separate_research_component' end policy from edg"),
    "typed_components": "with recursive " + _TC + " select edge_type, member, component_id from tcm",
    "core_attachments": "with recursive " + _TC + """,
cr as (select member, string_agg(edge_type || ':' || component_id, '|' order by edge_type || ':' || component_id) core from tcm where edge_type in ('rename_candidate', 'disclosed_subcontract_network') group by 1)
select a, b, edge_type, coalesce(l.core, '') a_core, coalesce(r.core, '') b_core, case when coalesce(l.core, '') <> '' and l.core = r.core then 'secondary_support_inside_core' else 'unvalidated_attachment_to_core' end attachment_status, template_risk
from edg left join cr l on l.member = a left join cr r on r.member = b where edge_type not in ('rename_candidate', 'disclosed_subcontract_network') and (l.core is not null or r.core is not null)""",
    "tail_edges": "with recursive " + _CO + """,
lm as (select cell, quantile_cont(style, 0.95) p95 from se where left_org <> right_org group by 1), te0 as (select left_org a, right_org b from se join lm using (cell) where left_org <> right_org and style >= p95), bo0 as (select a, b from te0 union select b, a from te0),
rc0(x, y) as (select a, a from bo0 union select r.x, bo0.b from rc0 r join bo0 on r.y = bo0.a) select x member, min(y) component_id from rc0 group by 1""",
    "evaluation_buckets": _W(_SC + ",\nln as (" + P._PF_ONLY + P._FP.split(I.CANON, 1)[1] + """,
sdv as (select stddev_pop(words) a, stddev_pop(text_ratio) b from cpf),
ds as (
  select pair_id, sco.section, "value", case when left_doc % 5 <> 0 then round(sqrt((pow((l.words - r.words) / case when a > 0 then a else 1 end, 2) + pow((l.text_ratio - r.text_ratio) / case when b > 0 then b else 1 end, 2)) / 2), 9) end distance,
    string_split(left_object, '/')[-1] = string_split(right_object, '/')[-1] same_address from sco join cpf l on l.doc_id = left_doc join cpf r on r.doc_id = right_doc, sdv),
dl as (select list_sort(list(distance))[count(distance) // 4 + 1] q1, list_sort(list(distance))[3 * count(distance) // 4 + 1] q3 from ds where not same_address and distance is not null)""",
        f"""select pair_id, {_R4('distance')} distance, same_address, case when same_address then 'same_address' when distance is null then 'tei_unknown' when distance <= q1 then 'near_tei_same_section' when distance >= q3 then 'far_tei_same_section' else 'mid_tei_same_section' end bucket,
  {_R4('cume_dist() over (partition by section order by "value")')} percentile from ds, dl"""),
    "title_profiles": _W(_TP, "select scope, doc_id, pages, " + ", ".join(f'{_R4(f"\"r_{c}\"")} "{c}"' for c in COUNTS) + ", signatures from pro join (select scope, doc_id, count(*) signatures from zs2 group by all) using (scope, doc_id)"),
    "title_score": _W(_TP, "select scope, x \"left\", y \"right\", pair_type, section_relation, " + ", ".join(f"{_R4(c)} {c}" for c in ("ratio", "composition", "page_size", "exact_page")) + ", with_size, no_size from tp where x < y"),
    "title_summary": _W(_TP, "select scope, pair_type, section_relation, count(*) pairs, " + ", ".join(f"{_R4(f'quantile_cont({m}, {q})')} {m}_{n}" for m in ("with_size", "no_size") for n, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))) + " from tp where x < y group by all"),
    "title_nearest": _W(_NEAR, "select scope, metric, x doc_id, y nearest, pair_type, section_relation, score from nr"),
    "nearest_counts": _W(_NEAR, "select scope, metric, pair_type, count(*) profiles from nr group by all"),
}
