"""Queries of page near-match: whole search in two modes, best pages inside document pairs, review, provenance and calibration.

A page's document is its host, its cohort its language; its segments are the texts between its tags.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import cells as L
from ..operators import ordered as O
from ..operators import pages as G
from ..operators import provenance as R
from ..operators import review as V
from ..storage import dealt_out, stored
from . import inputs as I

GROUPS = ["p", "li", "a", "br", "b", "h1"]
MODES = ("any", "cross_org")


def _pages(spark, d):
    rows = dealt_out(I.table(spark, d, "pages").select("page_id", "url", "html"), "page_id")
    rows = rows.select(
        "page_id", F.regexp_extract("url", "//([^/?#]+)", 1).alias("document"), F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("cohort"),
        G.group_counts(F.col("html"), GROUPS).alias("counts"), G.group_areas(F.col("html"), GROUPS).alias("areas"),
    )
    rows = rows.withColumn("elements", S.total(F.col("counts")))
    whole = lambda c: F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), "|")
    return rows.withColumn("signature", F.sha1(F.concat(whole("counts"), F.lit("#"), whole("areas")).cast("binary")))


def html_group_counts(spark, d):
    rows = _pages(spark, d)
    names = [*GROUPS, "other"]
    return rows.select("page_id", *[F.col("counts")[k].cast("bigint").alias(f"n_{g}") for k, g in enumerate(names)], *[F.col("areas")[k].cast("bigint").alias(f"area_{g}") for k, g in enumerate(GROUPS)], F.col("elements").cast("bigint").alias("elements"))


def page_signature(spark, d):
    return _pages(spark, d).select("page_id", "document", "cohort", "signature")


def _texts(spark, d):
    """page_id, hash of each distinct normalised text between tags of a page."""
    rows = dealt_out(I.table(spark, d, "pages").select("page_id", "html"), "page_id")
    parts = F.transform(F.regexp_extract_all("html", F.lit(">([^<]+)<"), F.lit(1)), T.normalize_text)
    return rows.select("page_id", F.explode(F.array_distinct(parts)).alias("t")).where("t <> ''").select("page_id", F.xxhash64("t").alias("hash"))


def _rare_texts(spark, d):
    """The texts of pages, and whether at most a quarter of all pages hold them."""
    rows = stored(_texts(spark, d), "page_texts")
    df = rows.groupBy("hash").agg(F.count("*").alias("df"))
    n = I.table(spark, d, "pages").select("page_id").agg(F.count("*").alias("all"))
    return rows.join(df, "hash").crossJoin(F.broadcast(n)).select("page_id", "hash", (F.col("df") <= 0.25 * F.col("all")).alias("rare"))


def _neighbors(spark, d, modes=MODES):
    pages = stored(_pages(spark, d), "pages")
    out = None
    for mode in modes:
        part = G.neighbors(pages, mode)
        out = part if out is None else out.unionByName(part)
    return out


def near_match_score(spark, d):
    """The 5 pages most like each page, in either mode, with the parts of the score."""
    parts = [F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("near_match_similarity", *G.NEAR_WEIGHTS)]
    return _neighbors(spark, d).select("mode", "query", "rank", "neighbor", "exact", *parts)


def _classed(spark, d, modes=MODES):
    rows = _neighbors(spark, d, modes)
    return rows.withColumn("class", G.near_match_class(F.col("score"), F.col("exact")))


def near_match_class(spark, d):
    """Neighbours by mode, rank and class."""
    return _classed(spark, d).groupBy("mode", "rank", "class").agg(F.count("*").alias("pairs"))


def _evidence(spark, d, classed):
    """The nearest of classed neighbours with what beside structure supports it."""
    rows = G.set_evidence(classed.where("rank = 1"), _rare_texts(spark, d))
    s, g, r, j = (F.col(c) for c in ("score", "shared", "rare", "jaccard"))
    zero = F.lit(0)
    return rows.select("query", "neighbor", "class", "shared", "rare", F.round(j + 1e-9, 4).alias("jaccard"), G.evidence_class(s, zero, g, r, j, zero).alias("evidence"), G.review_strength(s, zero, r, j).alias("strength"))


def near_match_evidence(spark, d):
    """The nearest page of another cohort with what beside structure supports it."""
    return _evidence(spark, d, _classed(spark, d, ("cross_org",)))


def _candidates(found):
    rows = found.where(f"not exact and score >= {G.STRONG}")
    pairs = G.canonical_pairs(rows.select("query", "neighbor", "score"), "query", "neighbor", "score")
    candidate = T.stable_id("pnmc_v0_", "page_near_match_candidate_v0", F.col("pair_low").cast("string"), F.col("pair_high").cast("string"))
    return pairs.select(candidate.alias("candidate_id"), "pair_low", "pair_high", F.round(F.col("score") + 1e-9, 4).alias("score"))


def review_candidates(spark, d):
    """Neighbours of other cohorts as unordered pairs: not exact, and strong."""
    return _candidates(_neighbors(spark, d, ("cross_org",)))


def review_queue(spark, d):
    """Nearest pages of other cohorts that are worth a look, as unordered pairs, in the order to be reviewed; labels of quality are reviews.

    The neighbours are searched once; the evidence and the candidates are both made of them.
    """
    found = stored(_classed(spark, d, ("cross_org",)).select("query", "neighbor", "rank", "score", "exact", "class"), "cross-neighbors")
    rows = _evidence(spark, d, found).where("strength is not null").join(_candidates(found).select("candidate_id", "pair_low", "pair_high", "score"), (F.least("query", "neighbor") == F.col("pair_low")) & (F.greatest("query", "neighbor") == F.col("pair_high")))
    one = stored(rows.groupBy("candidate_id", "pair_low", "pair_high", "score").agg(F.max("strength").alias("strength"), F.max("jaccard").alias("jaccard")), "review-pairs")
    labels = I.table(spark, d, "labels").where("quality is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, "accept").otherwise("reject")).alias("review_label"))
    labels = one.select("candidate_id", F.col("pair_low").alias("doc_id")).join(labels, "doc_id").select("candidate_id", "review_label")
    return V.queue(one, labels)


def top_neighbor_counts(spark, d):
    """Nearest pages by mode, class and exactness."""
    return _classed(spark, d).where("rank = 1").groupBy("mode", "class", "exact").agg(F.count("*").alias("n"))


def cross_org_unlock(spark, d):
    """How many nearest pages of other cohorts are at least moderately alike and not the same."""
    return _neighbors(spark, d, ("cross_org",)).where("rank = 1 and not exact and score >= 0.70").groupBy("query_cohort").agg(F.count("*").alias("pages"), F.countDistinct("query_document").alias("documents"))


def neighbor_summary(spark, d):
    """p10, median and p90 of the nearest pages' scores by mode and whether the cohort is the same."""
    kind = F.when(F.col("query_cohort") == F.col("neighbor_cohort"), "within_org").otherwise("cross_org")
    rows = stored(_neighbors(spark, d).where("rank = 1").select("mode", kind.alias("pair_type"), "score"), "nearest-pages")
    by, names = ["mode", "pair_type"], {"p10": 0.1, "median": 0.5, "p90": 0.9}
    found = O.quantiles(rows, by, "score", names).select(*by, *[F.round(F.col(n) + 1e-9, 4).alias(n) for n in names])
    return rows.groupBy(*by).agg(F.count("*").alias("pages")).join(found, by)


def _document_pairs(spark, d):
    """Pairs of hosts under one domain."""
    hosts = I.table(spark, d, "pages").select(F.regexp_extract("url", "//([^/?#]+)", 1).alias("document")).distinct().withColumn("domain", F.regexp_extract("document", r"(example\.\w+)$", 1))
    l, r = hosts.select("domain", F.col("document").alias("left_document")), hosts.select("domain", F.col("document").alias("right_document"))
    pairs = l.join(r, "domain").where("left_document < right_document")
    return pairs.withColumn("pair_id", F.concat_ws("__", "left_document", "right_document"))


def _pair_matches(spark, d):
    rows = dealt_out(I.table(spark, d, "pages").select("page_id", "html"), "page_id")
    parts = F.filter(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(">([^<]+)<"), F.lit(1)), T.normalize_text)), lambda t: t != "")
    shingles = F.array_distinct(F.flatten(F.transform(F.transform(parts, lambda t: T.tokens(t)), lambda w: T.word_shingles(w))))
    texts = rows.select("page_id", F.transform(parts, I.short_hash).alias("segments"), F.transform(shingles, I.short_hash).alias("shingles"))
    return G.best_in_pairs(_document_pairs(spark, d), stored(_pages(spark, d), "pages"), texts)


def page_best_match(spark, d):
    """The best page of the other document for each page, in both directions."""
    rounded = [F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("structural", "shingles", "segments")]
    return _pair_matches(spark, d).select("pair_id", "direction", "query", "neighbor", "exact", *rounded)


def page_pair_summary(spark, d):
    return G.match_summary(_pair_matches(spark, d))


def _matches(spark, d):
    """The nearest page of another cohort with a review label, made of its exactness and id."""
    rows = _neighbors(spark, d, ("cross_org",)).where("rank = 1")
    label = F.when(F.col("exact"), "normative_form").when(F.col("query") % 3 == 0, "estimate_boilerplate").when(F.col("query") % 3 == 1, "borrowing_candidate")
    return rows.select("query", "neighbor", F.round(F.col("score") + 1e-9, 4).alias("score"), F.round(F.col("count_ratio") + 1e-9, 4).alias("count"), F.round(F.col("area_ratio") + 1e-9, 4).alias("area"), "exact", F.col("query_cohort").alias("cohort"), label.alias("label"))


def stratified_sample(spark, d):
    """Two pages of each cohort and class nearest the target score 0.9."""
    rows = _matches(spark, d).withColumn("class", G.near_match_class(F.col("score"), F.col("exact")))
    return G.stratified(rows, ["cohort", "class"], "score", "query", 0.9, 2).select("cohort", "class", "query", "score", "place")


def provenance_assessment(spark, d):
    return R.assess(_matches(spark, d), "label").select("query", "neighbor", *R.FIELDS)


def provenance_counts(spark, d):
    return R.status_counts(R.assess(_matches(spark, d), "label"))


METRICS = ["score", "count", "area"]


def calibration_summary(spark, d):
    """Three measures of the first 30 labelled matches of each label."""
    out = R.calibrate(_matches(spark, d).where("label is not null"), ["label"], METRICS, [F.desc("score"), F.col("query")], 30)
    return out.select("label", "cases", *[F.round(F.col(f"{n}_{m}") + 1e-9, 4).alias(f"{n}_{m}") for m in METRICS for n in ("min", "median", "max")])


def provenance_residual(spark, d):
    """Matches by cohort, without those that reach all three minima of a third-party label's calibrated band."""
    rows = stored(_matches(spark, d), "matches")
    bands = rows.where("label in ('normative_form', 'estimate_boilerplate')").groupBy(F.col("cohort").alias("section"), "label").agg(*[F.min(m).alias(f"min_{m}") for m in METRICS])
    return R.residual(R.in_bands(rows, bands, "cohort", METRICS), ["cohort"], "score")


THIRD_PARTY = ["structural", "segments", "shingles"]
TRANSFER = {"style": "style", "near": "structural_mean", "shingles": "residual_shingles_mean", "strong": "residual_strong_share"}


def _residuals(spark, d):
    """Pairs of hosts under one domain (the cell), without the page matches that third parties explain.

    A host's first label is its organisation. Equal pages are a normative form, pages of mostly the same words shared
    technical content; every domain's bands are the minima of its labelled matches.
    """
    pairs = _document_pairs(spark, d)
    label = F.when(F.col("exact"), "normative_form").when(F.col("shingles") >= 0.5, "shared_technical_content")
    matches = stored(_pair_matches(spark, d).join(pairs.select("pair_id", "domain"), "pair_id").withColumn("label", label), "pair-matches")
    bands = matches.where("label is not null").groupBy(F.col("domain").alias("section"), "label").agg(*[F.min(m).alias(f"min_{m}") for m in THIRD_PARTY])
    org = lambda c: F.split(c, r"\.")[0]
    relation = F.when(org("left_document") == org("right_document"), "same_org").otherwise("cross_org")
    keys = pairs.select("pair_id", F.col("domain").alias("cell"), relation.alias("relation"), "left_document", "right_document")
    return keys.join(R.pair_residual(R.in_bands(matches, bands, "domain", THIRD_PARTY)), "pair_id")


def pair_residuals(spark, d):
    return _residuals(spark, d)


def residual_headlines(spark, d):
    """Medians by cell and relation before and after third parties' matches are taken out."""
    return R.relation_headlines(stored(_residuals(spark, d), "residuals"), ["cell", "relation"])


def cell_transfer(spark, d):
    """Domains by their pairs of hosts of one and of two organisations: what style and near pages, and what residual texts, speak for.

    Style is the likeness of the hosts' shares of tags.
    """
    tags = stored(_pages(spark, d), "pages").select("document", F.posexplode("counts").alias("k", "n")).groupBy("document", "k").agg(F.sum("n").alias("n"))
    tags = tags.groupBy("document").agg(S.shares(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: x["n"])).alias("tags"))
    rows = _residuals(spark, d)
    for side in ("left", "right"):
        rows = rows.join(tags.select(F.col("document").alias(f"{side}_document"), F.col("tags").alias(f"{side}_tags")), f"{side}_document")
    rows = rows.withColumn("style", F.round(S.composition_similarity(F.col("left_tags"), F.col("right_tags")) + 1e-9, 4))
    rows = rows.select("cell", "relation", *[F.col(c).alias(k) for k, c in TRANSFER.items()])
    return L.assess(L.cell_medians(rows, list(TRANSFER)), ["style", "near"], ["shingles", "strong"])


QUERIES = {f.__name__: f for f in (
    pair_residuals, residual_headlines, cell_transfer, html_group_counts, page_signature, near_match_score, near_match_class, near_match_evidence, review_candidates, review_queue, top_neighbor_counts, cross_org_unlock, neighbor_summary, page_best_match,
    page_pair_summary, stratified_sample, provenance_assessment, provenance_counts, calibration_summary, provenance_residual,
)}

_W = I.with_
_R4 = lambda x: f"round({x} + 1e-9::double, 4)"
_N = len(GROUPS) + 1
_PG = "pg as (select page_id, regexp_extract(url, '//([^/?#]+)', 1) document, regexp_extract(url, '/(en|fr|de|es)/', 1) cohort, [" + ", ".join(f"len(list_filter(t, lambda x: x = '{g}'))::double" for g in GROUPS) + ", len(list_filter(t, lambda x: not list_contains([" + ", ".join(f"'{g}'" for g in GROUPS) + "], x)))::double] c, [" + ", ".join(
    f"coalesce(list_sum(list_transform(regexp_extract_all(html, '<{g}(?:\\s[^>]*)?>([^<]*)', 1), lambda x: length(x))), 0)::double" for g in GROUPS
) + ", 0.0::double] a from (select *, regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1) t from pages)),\npa as (select *, list_sum(c) e, sha1(array_to_string(list_transform(c, lambda x: x::bigint::varchar), '|') || '#' || array_to_string(list_transform(a, lambda x: x::bigint::varchar), '|')) s from pg)"
_el = lambda v: [f"{v}[{k}]" for k in range(1, _N + 1)]


def _share(v: str) -> list[str]:
    return [f"coalesce({x} / nullif(list_sum({v}), 0), 0)" for x in _el(v)]


def _score_sql(l: str, r: str) -> dict[str, str]:
    from .pair_queries import sql_least, sql_ratio

    return {
        "count_ratio": sql_ratio(_el(f"{l}.c"), _el(f"{r}.c")), "count_composition": sql_least(_share(f"{l}.c"), _share(f"{r}.c")), "area_ratio": sql_ratio(_el(f"{l}.a"), _el(f"{r}.a")),
        "area_composition": sql_least(_share(f"{l}.a"), _share(f"{r}.a")), "element_ratio": f"case when greatest({l}.e, {r}.e) > 0 then least({l}.e, {r}.e) / greatest({l}.e, {r}.e) else 1.0 end",
    }


_PARTS = _score_sql("l", "r")
_TOTAL = " + ".join(f"{w}::double * {k}" for k, w in G.NEAR_WEIGHTS.items())
_VEC = _PG + ",\nrw as (select page_id, [" + ", ".join([f"ln(1 + {x})" for x in _el("c")] + _share("c") + [f"ln(1 + {x})" for x in _el("a")] + _share("a") + ["ln(1 + e)"]) + "] v from pa),\nmx as (select [" + ", ".join(f"greatest(max(v[{k}]), 1e-6)" for k in range(1, 4 * _N + 2)) + "] m from rw),\nun as (select page_id, list_transform(list_zip(v, m), lambda x: x[1] / x[2]) v from rw, mx)"
_NB = _VEC + f""",
ms(mode) as (values ('any'), ('cross_org')),
cand as (
  select mode, l.page_id "query", r.page_id neighbor, round(list_cosine_similarity(u.v, w.v), 6) sim, l.s = r.s exact, l.cohort query_cohort, r.cohort neighbor_cohort, l.document query_document, {', '.join(f'{e} {k}' for k, e in _PARTS.items())}
  from ms, pa l join pa r on l.document <> r.document join un u on u.page_id = l.page_id join un w on w.page_id = r.page_id where mode = 'any' or l.cohort <> r.cohort),
lst as (select *, row_number() over (partition by mode, "query" order by sim desc, neighbor) k from cand),
scd as (select *, {_TOTAL} near_match_similarity, round({_TOTAL}, 9) score from lst where k <= 40 or exact),
nb as (select *, row_number() over (partition by mode, "query" order by score desc, exact desc, neighbor) "rank" from scd qualify "rank" <= 5)"""
_CLASS = lambda s: f"case when exact then 'exact_match' when {s} >= 0.95 then 'near_exact' when {s} >= 0.85 then 'strong_near_match' when {s} >= 0.70 then 'moderate_near_match' else 'weak_match' end"
_TX = r"""tx as (select distinct page_id, t from (select page_id, """ + I._NORM.format("x") + """ t from (select page_id, unnest(regexp_extract_all(html, '>([^<]+)<', 1)) x from pages)) where t <> ''),
tf as (select t, count(*) df from tx group by 1),
tn as (select page_id, count(*) n from tx group by 1)"""
_TOPX = _NB + ",\n" + _TX + """,
sh as (select "query", neighbor, count(*) shared, count(*) filter (df <= 0.25 * (select count(*) from pages)) rare from nb join tx a on a.page_id = "query" join tx b on b.page_id = neighbor and a.t = b.t join tf on tf.t = a.t where mode = 'cross_org' and "rank" = 1 group by all),
ev as (
  select nb."query", nb.neighbor, score, exact, coalesce(shared, 0) shared, coalesce(rare, 0) rare, coalesce(coalesce(shared, 0) / nullif(coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(shared, 0), 0), 0) jaccard
  from nb left join sh on sh."query" = nb."query" and sh.neighbor = nb.neighbor left join tn x on x.page_id = nb."query" left join tn y on y.page_id = nb.neighbor where mode = 'cross_org' and "rank" = 1)"""
_MT = _NB + f""",
mt as (select "query", neighbor, {_R4('score')} score, {_R4('count_ratio')} "count", {_R4('area_ratio')} area, exact, query_cohort cohort, case when exact then 'normative_form' when "query" % 3 = 0 then 'estimate_boilerplate' when "query" % 3 = 1 then 'borrowing_candidate' end "label"
  from nb where mode = 'cross_org' and "rank" = 1)"""
_ASSESSED = _MT + """,
asd as (select "query", neighbor, """ + ", ".join("case \"label\" " + " ".join(f"when '{k}' then '{v[i]}'" for k, v in R.ASSESSMENT.items()) + f" else 'unassessed' end {c}" for i, c in enumerate(R.FIELDS)) + " from mt)"
_BEST = _PG + ",\n" + _TX + r""",
tw as (select page_id, list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) w from tx),
sx as (select distinct page_id, array_to_string(w[i:i + 4], ' ') h from (select *, unnest(range(1, len(w) - 3)) i from tw where len(w) >= 5)),
sn as (select page_id, count(*) n from sx group by 1),
hs as (select distinct document, regexp_extract(document, '(example\.\w+)$', 1) domain from pa),
dp as (select a.document || '__' || b.document pair_id, a.document ld, b.document rd from hs a join hs b on a.domain = b.domain and a.document < b.document),
dr as (select pair_id, 'left_to_right' direction, ld qd, rd nd from dp union all select pair_id, 'right_to_left', rd, ld from dp),
pp as (select pair_id, direction, l.page_id "query", r.page_id neighbor, l.s = r.s exact, """ + ", ".join(f"{e} {k}" for k, e in _PARTS.items()) + """ from dr join pa l on l.document = qd join pa r on r.document = nd),
st as (select pair_id, direction, "query", neighbor, exact, round(""" + _TOTAL + """, 9) structural from pp qualify structural = max(structural) over (partition by pair_id, direction, "query")),
ks as (select distinct "query", neighbor from st),
s1 as (select "query", neighbor, count(*) c from ks join tx a on a.page_id = "query" join tx b on b.page_id = neighbor and a.t = b.t group by all),
s2 as (select "query", neighbor, count(*) c from ks join sx a on a.page_id = "query" join sx b on b.page_id = neighbor and a.h = b.h group by all),
fu as (
  select st.*, round(coalesce(coalesce(s1.c, 0) / nullif(coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(s1.c, 0), 0), 0), 9) segments, round(coalesce(coalesce(s2.c, 0) / nullif(coalesce(z.n, 0) + coalesce(w.n, 0) - coalesce(s2.c, 0), 0), 0), 9) shingles
  from st left join s1 using ("query", neighbor) left join s2 using ("query", neighbor) left join tn x on x.page_id = "query" left join tn y on y.page_id = neighbor left join sn z on z.page_id = "query" left join sn w on w.page_id = neighbor),
bm as (select * from fu qualify row_number() over (partition by pair_id, direction, "query" order by shingles desc, segments desc, exact desc, neighbor) = 1)"""

_RES = _BEST + """,
bl as (select bm.*, regexp_extract(split_part(pair_id, '__', 1), '(example\\.\\w+)$', 1) cell, case when exact then 'normative_form' when shingles >= 0.5 then 'shared_technical_content' end "label" from bm),
bb as (select cell, "label" l, min(structural) m1, min(segments) m2, min(shingles) m3 from bl where "label" is not null group by 1, 2),
bx as (select bl.*, (select min(l) from bb where bb.cell = bl.cell and bl.structural >= m1 and bl.segments >= m2 and bl.shingles >= m3) band from bl),
bz as (select pair_id, string_agg(band || ':' || n, '|' order by band) excluded_labels from (select pair_id, band, count(*) n from bx where band is not null group by 1, 2) group by 1),
res as (
  select pair_id, any_value(cell) cell, case when split_part(split_part(pair_id, '__', 1), '.', 1) = split_part(split_part(pair_id, '__', 2), '.', 1) then 'same_org' else 'cross_org' end relation, split_part(pair_id, '__', 1) left_document, split_part(pair_id, '__', 2) right_document,
    count(*) matches, count(*) filter (band is not null) excluded, count(*) filter (band is null) residual_matches, """ + _R4("avg(structural)") + " structural_mean, " + ", ".join(
    f"{_R4(f'{f}({c}) filter (band is null)')} residual_{c}_{n}" for c in ("structural", "shingles", "segments") for n, f in (("mean", "avg"), ("median", "median"))
) + ", " + ", ".join(f"{_R4(f'avg(({c})::int::double) filter (band is null)')} residual_{n}_share" for n, c in (("exact", "exact"), ("strong", "structural >= 0.85"), ("moderate", "structural >= 0.70"))) + """,
    coalesce(any_value(excluded_labels), '') excluded_labels, """ + _R4("count(*) filter (band is not null) / count(*)") + """ excluded_share,
    case when count(*) filter (band is null) = 0 then 'all_excluded' when count(*) filter (band is not null) = 0 then 'measured_no_exclusions' else 'measured_exclusions_applied' end residual_status
  from bx left join bz using (pair_id) group by pair_id)"""


def _cell_sql() -> str:
    """Cells' medians by relation, as cm, and their channels, after res."""
    stats = ", ".join(f"median({c}) filter (relation = '{r}_org') {r}_{k}" for k, c in TRANSFER.items() for r in ("same", "cross"))
    shown = ", ".join(
        f"{_R4(f'same_{k}')} same_org_{k}, {_R4(f'cross_{k}')} cross_org_{k}, round(cross_{k} - same_{k}, 4) cross_minus_same_{k}, {_R4(f'case when same_{k} <> 0 then cross_{k} / same_{k} end')} cross_to_same_{k}" for k in TRANSFER
    )
    return f"""tg as (select document, list_transform(range(1, {_N + 1}), lambda k: list_sum(list_transform(cs, lambda c: c[k]))) t from (select document, list(c) cs from pa group by 1)),
th as (select document, list_transform(t, lambda x: coalesce(x / nullif(list_sum(t), 0), 0)) s from tg),
rt as (
  select res.*, {_R4('list_sum(list_transform(range(1, ' + str(_N + 1) + '), lambda k: least(l.s[k], r.s[k])))')} as "style"
  from res join th l on l.document = left_document join th r on r.document = right_document),
c0 as (select cell, count(*) filter (relation = 'same_org') same_org_pairs, count(*) filter (relation = 'cross_org') cross_org_pairs, {stats} from rt group by 1),
cm as (select cell, same_org_pairs, cross_org_pairs, 'matched_same_and_cross' comparison_status, {shown} from c0 where same_org_pairs > 0 and cross_org_pairs > 0)"""


def _channel(names: list[str]) -> str:
    known = [f"coalesce(cross_to_same_{k}, 0)" for k in names]
    return f"case when {' and '.join(f'{x} >= 0.75' for x in known)} then 'transfer' when {' or '.join(f'{x} >= 0.75' for x in known)} or ({' and '.join(f'{x} >= 0.40' for x in known)}) then 'partial' else 'org_bound' end"


ORACLES = {
    "pair_residuals": _W(_RES, "select * from res"),
    "residual_headlines": _W(_RES, "select cell, relation, count(*) pairs, count(*) filter (excluded > 0) affected, count(*) filter (residual_status = 'all_excluded') all_excluded, sum(excluded)::bigint excluded_matches, "
        + ", ".join(f"{_R4(f'median({c})')} {c}" for c in ("structural_mean", "residual_structural_mean", "residual_shingles_mean", "residual_strong_share")) + " from res group by 1, 2"),
    "cell_transfer": _W(_RES + ",\n" + _cell_sql(), f"""select *, case when not sufficient then 'insufficient' when structural_transfer = 'transfer' and content_transfer = 'transfer' then 'transfer_both' when structural_transfer = 'transfer' then 'structure_led'
  when content_transfer = 'transfer' then 'content_led' when structural_transfer = 'org_bound' and content_transfer = 'org_bound' then 'org_bound' else 'mixed_partial' end transfer from (
  select *, same_org_pairs >= 3 and cross_org_pairs >= 3 sufficient, {_channel(['style', 'near'])} structural_transfer, {_channel(['shingles', 'strong'])} content_transfer from cm)"""),
    "html_group_counts": _W(_PG, "select page_id, " + ", ".join(f"c[{k + 1}]::bigint n_{g}" for k, g in enumerate([*GROUPS, "other"])) + ", " + ", ".join(f"a[{k + 1}]::bigint area_{g}" for k, g in enumerate(GROUPS)) + ", e::bigint elements from pa"),
    "page_signature": _W(_PG, "select page_id, document, cohort, s signature from pa"),
    "near_match_score": _W(_NB, f'select mode, "query", "rank", neighbor, exact, {_R4("near_match_similarity")} near_match_similarity, ' + ", ".join(f"{_R4(k)} {k}" for k in G.NEAR_WEIGHTS) + " from nb"),
    "near_match_class": _W(_NB, f'select mode, "rank", {_CLASS("score")} "class", count(*) pairs from nb group by all'),
    "near_match_evidence": _W(_TOPX, f"""select "query", neighbor, {_CLASS('score')} "class", shared, rare, {_R4('jaccard')} jaccard,
  case when score < 0.85 then 'below_strong_structural' when rare > 0 and jaccard >= 0.2 then 'structure_rare_text_review' when jaccard >= 0.5 then 'structure_strong_text' when shared > 0 then 'structure_text_bridge' else 'structural_only' end evidence,
  case when score < 0.85 then null when rare > 0 and jaccard >= 0.5 then 'rare_text_high_overlap' when rare > 0 and jaccard >= 0.2 then 'rare_text_partial_overlap' end strength from ev"""),
    "review_candidates": _W(_NB, f"""select 'pnmc_v0_' || substr(sha1('page_near_match_candidate_v0|' || lo || '|' || hi), 1, 16) candidate_id, lo pair_low, hi pair_high, {_R4('score')} score from (
  select least("query", neighbor) lo, greatest("query", neighbor) hi, score, "query" q from nb where mode = 'cross_org' and not exact and score >= 0.85) qualify row_number() over (partition by lo, hi order by score desc, q) = 1"""),
    "review_queue": _W(_TOPX, f"""select candidate_id, lo pair_low, hi pair_high, score, strength, jaccard, coalesce(review_label, '') review_label, case when review_label is null then 'pending' else 'reviewed' end review_status,
  row_number() over (order by case when strength = 'rare_text_high_overlap' then 0 else 1 end, jaccard desc, score desc, candidate_id) review_rank from (
  select 'pnmc_v0_' || substr(sha1('page_near_match_candidate_v0|' || lo || '|' || hi), 1, 16) candidate_id, lo, hi, {_R4('max(best)')} score, max(strength) strength, max({_R4('jaccard')}) jaccard from (
    select least("query", neighbor) lo, greatest("query", neighbor) hi, jaccard, case when rare > 0 and jaccard >= 0.5 then 'rare_text_high_overlap' when rare > 0 and jaccard >= 0.2 then 'rare_text_partial_overlap' end strength from ev where score >= 0.85)
  join (select least("query", neighbor) lo, greatest("query", neighbor) hi, max(score) best from nb where mode = 'cross_org' and not exact and score >= 0.85 group by 1, 2) using (lo, hi) where strength is not null group by lo, hi)
  left join (select doc_id, max(case when quality = 1 then 'accept' else 'reject' end) review_label from labels where quality is not null group by 1) on doc_id = lo"""),
    "top_neighbor_counts": _W(_NB, f'select mode, {_CLASS("score")} "class", exact, count(*) n from nb where "rank" = 1 group by all'),
    "cross_org_unlock": _W(_NB, """select query_cohort, count(*) pages, count(distinct query_document) documents from nb where mode = 'cross_org' and "rank" = 1 and not exact and score >= 0.70 group by 1"""),
    "neighbor_summary": _W(_NB, f"""select mode, case when query_cohort = neighbor_cohort then 'within_org' else 'cross_org' end pair_type, count(*) pages, {_R4('quantile_cont(score, 0.1)')} p10, {_R4('quantile_cont(score, 0.5)')} median, {_R4('quantile_cont(score, 0.9)')} p90 from nb where "rank" = 1 group by all"""),
    "page_best_match": _W(_BEST, f'select pair_id, direction, "query", neighbor, exact, {_R4("structural")} structural, {_R4("shingles")} shingles, {_R4("segments")} segments from bm'),
    "page_pair_summary": _W(_BEST, f"""select pair_id, count(*) matches, {_R4('avg(structural)')} structural_mean, {_R4('median(structural)')} structural_median, {_R4('avg(shingles)')} shingle_mean, {_R4('avg(segments)')} segment_mean, {_R4('avg(exact::int)')} exact_share,
  {_R4('avg((structural >= 0.85)::int)')} strong_share, {_R4('avg((structural >= 0.70)::int)')} moderate_share from bm group by 1"""),
    "stratified_sample": _W(_MT, f"""select cohort, "class", "query", score, place from (
  select cohort, "class", "query", score, row_number() over (partition by cohort, "class" order by abs(score - 0.9::double), "query") place from (select *, {_CLASS('score')} "class" from mt)) where place <= 2"""),
    "provenance_assessment": _W(_ASSESSED, "select * from asd"),
    "provenance_counts": _W(_ASSESSED, " union all ".join(f"select '{c}' field, {c} status, count(*) n from asd group by all" for c in R.FIELDS)),
    "calibration_summary": _W(_MT, "select \"label\", count(*) cases, " + ", ".join(f"{_R4(f'{n}(\"{m}\")')} {n}_{m}" for m in METRICS for n in ("min", "median", "max")) + " from (select *, row_number() over (partition by \"label\" order by score desc, \"query\") k from mt where \"label\" is not null) where k <= 30 group by 1"),
    "provenance_residual": _W(_MT + """,
bd as (select cohort, "label", """ + ", ".join(f'min("{m}") m_{m}' for m in METRICS) + """ from mt where "label" in ('normative_form', 'estimate_boilerplate') group by all),
ex as (select *, exists (select 1 from bd where bd.cohort = mt.cohort and """ + " and ".join(f'mt."{m}" >= m_{m}' for m in METRICS) + """) gone from mt)""",
        """select cohort, count(*) matches, count(*) filter (gone) excluded, round(avg((score >= 0.85)::int::double), 4) strong_share, round(coalesce(avg((score >= 0.85)::int::double) filter (not gone), 0), 4) strong_residual,
  round(avg((score >= 0.70)::int::double), 4) moderate_share, round(coalesce(avg((score >= 0.70)::int::double) filter (not gone), 0), 4) moderate_residual from ex group by 1"""),
}
