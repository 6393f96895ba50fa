"""Queries of document pairs: entity overlaps, feature cosines, style, content and the weighted pair scores.

Pairs are those of canonical documents of different objects in a section.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..operators import entities as E
from ..operators import features as V
from ..operators import frequency as Q
from ..operators import neighbors as N
from ..operators import pages as G
from ..operators import pairs as P
from ..operators import scores as W
from ..storage import stored
from . import inputs as I

SHINGLED = ("text_segment", "document_word_shingle")


def same_section_pairs(spark, d):
    return I.pairs(spark, d).select("pair_id", "section", "left_doc", "right_doc", "left_object", "right_object")


def _compared(spark, d, hashed=I.short_hash):
    """The pairs by kind, every hash weighing 1."""
    return P.compare(I.pairs(spark, d), stored(I.entities_of(I.canonical(spark, d), hashed), "entities"))


def multiset_jaccard(spark, d):
    return _compared(spark, d).select("pair_id", "entity_kind", F.round(F.col("raw_value") + 1e-9, 4).alias("value"), "status")


def _weighed(spark, d, hashed=I.short_hash):
    rows, frequency = I.canonical_counted(spark, d, hashed)
    return I.pairs(spark, d), rows, frequency


def idf_jaccard(spark, d):
    out = P.compare(*_weighed(spark, d))
    rounded = [F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("idf_value", "raw_value", "shared_idf", "union_idf")]
    return out.select("pair_id", "entity_kind", "status", "left_total", "right_total", "left_unique", "right_unique", "shared_unique", *rounded)


def idf_pair_similarity(spark, d):
    return P.idf_pair_similarity(*_weighed(spark, d))


def top_shared(spark, d):
    """The 3 weightiest shared entities of each kind for pairs that are alike."""
    pairs, rows, frequency = _weighed(spark, d, E.text_hash)
    return P.top_shared(P.idf_pair_similarity(pairs, rows, frequency).where("idf_similarity >= 0.05"), rows, frequency, 3)


def set_jaccard(spark, d):
    """Of the sets of segments of each pair: similarity, both coverages, and what either side has alone."""
    rows = _compared(spark, d).where("entity_kind = 'text_segment'")
    ratio = lambda n: F.round(F.coalesce(F.try_divide(F.col("shared_unique"), n), F.lit(0.0)) + 1e-9, 4)
    l, r, s = F.col("left_unique"), F.col("right_unique"), F.col("shared_unique")
    return rows.select("pair_id", "shared_unique", (l - s).alias("left_only"), (r - s).alias("right_only"), ratio(l + r - s).alias("jaccard"), ratio(l).alias("left_coverage"), ratio(r).alias("right_coverage"))


def weighted_applicable(spark, d):
    """Of each customer with orders: the weighted mean of three shares over those that apply, and the weight that does."""
    o = I.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"), F.count_if(F.col("o_orderstatus") == "P").alias("p")
    )
    share = lambda c: F.col(c) / F.col("n")
    value, weight = S.weighted_applicable([(share("f"), F.col("n") > 0, 0.40), (share("u"), F.col("u") > 0, 0.35), (share("p"), F.col("p") > 0, 0.25)])
    return o.select("o_custkey", F.round(value, 4).alias("score"), F.round(weight, 4).alias("applicable_weight"))


def _feature_pairs(spark, d):
    rows = V.spectrum(stored(I.profiles(I.canonical(spark, d)), "profiles"), list(I.FEATURES))
    return V.sides(I.pairs(spark, d), rows, ["v", "z"])


def feature_cosine(spark, d):
    """Cosines of 18 features and of 6 subvectors of them."""
    places = {name: [I.FEATURES.index(c) for c in names] for name, names in I.SUBVECTORS.items()}
    out = V.cosines(_feature_pairs(spark, d), places)
    return out.select("pair_id", "feature_cosine", *[f"{n}_{k}" for n in places for k in ("cosine", "centered", "mean_delta", "max_delta")])


def subvector_diagnostics(spark, d):
    """The subvector figures of pairs in long form."""
    long = feature_cosine(spark, d).drop("feature_cosine").unpivot(["pair_id"], None, "metric", "value")
    name = F.regexp_extract("metric", "^(volume|density|text|tables|graphics|element_mix)_", 1)
    return long.select("pair_id", name.alias("subvector"), F.regexp_replace("metric", "^(volume|density|text|tables|graphics|element_mix)_", "").alias("kind"), "value")


def _styled(spark, d):
    rows = stored(I.profiles(I.canonical(spark, d)), "profiles")
    rows = rows.select("doc_id", F.array(*I.STYLE_RATIOS).alias("r"), F.array(*I.STYLE_SHARES).alias("s"))
    score, ratio, composition = V.style_score(F.col("left_r"), F.col("right_r"), F.col("left_s"), F.col("right_s"))
    return V.sides(I.pairs(spark, d), rows, ["r", "s"]).withColumns({"style": score, "style_ratio": ratio, "style_composition": composition})


def style_score(spark, d):
    """Of 11 ratio keys and 6 share keys."""
    return _styled(spark, d).select("pair_id", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("style", "style_ratio", "style_composition")])


BY = ["pair_id", "section", "left_object", "right_object", "left_doc", "right_doc", "left_org", "right_org"]


def axes(spark, d):
    """The pairs with raw values and presence of all kinds, and shingles of whole documents."""
    docs = I.canonical(spark, d)
    rows = stored(I.entities_of(docs, I.short_hash).unionByName(E.document_shingles(docs, I.short_hash)), "entities")
    kinds = (*P.KINDS, "document_word_shingle")
    return P.wide(P.compare(I.pairs(spark, d), rows, None, kinds), BY, kinds)


def content_score(spark, d):
    score, weight = P.scored(W.CONTENT)
    return axes(spark, d).select("pair_id", F.round(score + 1e-9, 4).alias("content"), F.round(weight, 4).alias("applicable_weight"))


def pair_score_fast(spark, d):
    """0.55 of the feature cosine, 0.20 of page signatures, 0.15 of table layouts, 0.10 of table contents."""
    cosine = S.log_cosine(F.col("left_v"), F.col("right_v"))
    rows = axes(spark, d).join(_feature_pairs(spark, d).select("pair_id", cosine.alias("cosine")), "pair_id")
    values = {"cosine": F.col("cosine"), "page": F.col("raw_page_signature"), "layout": F.col("raw_table_layout_signature"), "content": F.col("raw_table_content_signature")}
    return rows.select("pair_id", F.round(W.fixed(W.FAST, values) + 1e-9, 4).alias("score"))


_SIGNATURE = {"page_signature": W.SIGNATURE["page"], "table_layout_signature": W.SIGNATURE["layout"], "table_content_signature": W.SIGNATURE["content"]}
_TEXT = {"text_segment": W.TEXT["segment"], "document_word_shingle": W.TEXT["shingle"]}


def signature_score(spark, d):
    score, weight = P.scored(_SIGNATURE)
    return axes(spark, d).select("pair_id", F.round(score + 1e-9, 4).alias("score"), F.round(weight, 4).alias("applicable_weight"))


def text_score(spark, d):
    """Segments and shingles of whole documents over those that apply; and half of it with half of the signature score."""
    signature, _ = P.scored(_SIGNATURE)
    text, weight = P.scored(_TEXT)
    rows = axes(spark, d).withColumns({"signature": signature, "text": text, "weight": weight})
    combined, _ = S.weighted_applicable([(F.col("signature"), F.lit(True), W.COMBINED["signature"]), (F.col("text"), F.col("weight") > 0, W.COMBINED["text"])])
    status = P.status_of(F.col("text"), F.col("weight"), "not_applicable")
    return rows.select("pair_id", F.round(F.col("text") + 1e-9, 4).alias("score"), F.round("weight", 4).alias("applicable_weight"), status.alias("status"), F.round(combined + 1e-9, 4).alias("combined"))


def detailed_score(spark, d):
    """On Jaccards rounded to 4 already, which is part of the score."""
    cosine = S.log_cosine(F.col("left_v"), F.col("right_v"))
    rows = axes(spark, d).join(_feature_pairs(spark, d).select("pair_id", cosine.alias("cosine")), "pair_id")
    rounded = lambda k: F.round(F.col(f"raw_{k}") + 1e-9, 4)
    values = {"cosine": F.col("cosine"), "page": rounded("page_signature"), "layout": rounded("table_layout_signature"), "content": rounded("table_content_signature"), "text": rounded("text_segment")}
    return rows.select("pair_id", F.round(W.fixed(W.DETAILED, values) + 1e-9, 4).alias("score"))


def evidence_class(spark, d):
    """What supports a pair beside structure: shared tables, segments, rare segments (in a quarter of all documents at most)."""
    rows, frequency = I.canonical_counted(spark, d, I.short_hash)
    rare = rows.where("entity_kind = 'text_segment'").join(frequency.where("global_df_ratio <= 0.25").select("section", "entity_kind", "entity_hash"), ["section", "entity_kind", "entity_hash"], "left_semi")
    pairs = I.pairs(spark, d)
    few = P.compare(pairs, rare, None, ("text_segment",)).select("pair_id", F.col("shared_unique").alias("rare"))
    long = P.compare(pairs, rows, None, ("text_segment", "table_layout_signature", "table_content_signature"))
    of = lambda k, c: F.max(F.when(F.col("entity_kind") == k, F.col(c)))
    wide = long.withColumn("set_jaccard", F.coalesce(F.try_divide(F.col("shared_unique"), F.col("left_unique") + F.col("right_unique") - F.col("shared_unique")), F.lit(0.0)))
    wide = wide.groupBy("pair_id").agg(
        of("text_segment", "shared_unique").alias("segments"), of("text_segment", "set_jaccard").alias("jaccard"), of("table_layout_signature", "shared_unique").alias("layouts"), of("table_content_signature", "shared_unique").alias("tables")
    )
    out = wide.join(few, "pair_id").join(_styled(spark, d).select("pair_id", F.round("style_ratio", 9).alias("structural")), "pair_id")
    s, t, g, r, j, y = (F.col(c) for c in ("structural", "tables", "segments", "rare", "jaccard", "layouts"))
    return out.select("pair_id", F.round(s + 1e-9, 4).alias("structural"), "tables", "segments", "rare", F.round(j + 1e-9, 4).alias("jaccard"), "layouts", G.evidence_class(s, t, g, r, j, y).alias("class"), G.review_strength(s, t, r, j).alias("strength"))


def _knn(spark, d, cross):
    rows = I.table(spark, d, "embeddings")
    found = N.top_k(rows, rows.where("vec_id % 20 = 0"), 5, "vec_id", "embedding", "label", cross)
    return found.select("query", "neighbor", F.round("score", 4).alias("score"), "rank")


def topk_any(spark, d):
    return _knn(spark, d, False)


def topk_cross(spark, d):
    return _knn(spark, d, True)


QUERIES = {f.__name__: f for f in (
    same_section_pairs, multiset_jaccard, idf_jaccard, idf_pair_similarity, top_shared, set_jaccard, weighted_applicable, feature_cosine, subvector_diagnostics, style_score, content_score,
    pair_score_fast, signature_score, text_score, detailed_score, evidence_class, topk_any, topk_cross,
)}

_W = I.with_
R4 = lambda x: f"round({x} + 1e-9::double, 4)"


def sql_cosine(x: list[str], y: list[str]) -> str:
    dot = " + ".join(f"{a} * {b}" for a, b in zip(x, y, strict=True))
    length = [f"sqrt({' + '.join(f'{a} * {a}' for a in v)})" for v in (x, y)]
    return f"coalesce(({dot}) / nullif({length[0]} * {length[1]}, 0), 0.0)"


def sql_ratio(l: list[str], r: list[str]) -> str:
    parts = [f"case when {a} <> 0 or {b} <> 0 then least({a}, {b}) / greatest({a}, {b}) end" for a, b in zip(l, r, strict=True)]
    return "coalesce((" + " + ".join(f"coalesce({p}, 0)" for p in parts) + ") / nullif(" + " + ".join(f"({p} is not null)::int" for p in parts) + ", 0), 1.0)"


def sql_least(l: list[str], r: list[str]) -> str:
    return "(" + " + ".join(f"least({a}, {b})" for a, b in zip(l, r, strict=True)) + ")"


_at = lambda side, names: [f'{side}."{c}"' for c in names]
_logs = lambda cols: [f"ln(1 + greatest({c}, 0))" for c in cols]
_FP = I.PROFILES + ",\n" + I.CANON + """,
cpf as (select pf.* from pf join canon using (doc_id)),
mom as (select """ + ", ".join(f'avg("{c}") "m_{c}", stddev_pop("{c}") "s_{c}"' for c in I.FEATURES) + """ from cpf),
zs as (select cpf.*, """ + ", ".join(f'("{c}" - "m_{c}") / case when "s_{c}" > 0 then "s_{c}" else 1 end "z_{c}"' for c in I.FEATURES) + """ from cpf, mom)"""
_FJ = " from prs join zs l on l.doc_id = left_doc join zs r on r.doc_id = right_doc"
_DELTA = lambda c: f'abs(r."{c}" - l."{c}") / greatest(abs(l."{c}"), abs(r."{c}"), 1.0)'


def _subvector_sql(names) -> dict[str, str]:
    return {
        "cosine": R4(sql_cosine(_logs(_at("l", names)), _logs(_at("r", names)))), "centered": R4(sql_cosine(_at("l", [f"z_{c}" for c in names]), _at("r", [f"z_{c}" for c in names]))),
        "mean_delta": R4("(" + " + ".join(map(_DELTA, names)) + f") / {len(names)}"), "max_delta": R4("greatest(" + ", ".join(map(_DELTA, names)) + ")"),
    }


_SUBS = {n: _subvector_sql(names) for n, names in I.SUBVECTORS.items()}
COSINE = sql_cosine(_logs(_at("l", I.FEATURES)), _logs(_at("r", I.FEATURES)))
_STYLE = {"style_ratio": sql_ratio(_at("l", I.STYLE_RATIOS), _at("r", I.STYLE_RATIOS)), "style_composition": sql_least(_at("l", I.STYLE_SHARES), _at("r", I.STYLE_SHARES))}
STYLED = _FP + f""",
sty as (select pair_id, {_STYLE['style_ratio']} style_ratio, {_STYLE['style_composition']} style_composition{_FJ})"""
#: The columns of ``wide`` with the shingles of whole documents.
AXES = I.SIMS + r""",
dtok as (select doc_id, list_filter(regexp_extract_all(""" + I._NORM.format("text") + r""", '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) w from documents join canon using (doc_id)),
dsh as (select doc_id, h, count(*) n from (select doc_id, array_to_string(w[i:i + 4], ' ') h from (select *, unnest(range(1, len(w) - 3)) i from dtok where len(w) >= 5)) group by all),
dtt as (select doc_id, sum(n)::bigint t from dsh group by 1),
dss as (select p.pair_id, sum(least(a.n, b.n))::bigint s from prs p join dsh a on a.doc_id = left_doc join dsh b on b.doc_id = right_doc and a.h = b.h group by 1),
axs as (
  select wide.*, coalesce(coalesce(s, 0) / nullif(coalesce(l.t, 0) + coalesce(r.t, 0) - coalesce(s, 0), 0), 0.0) raw_document_word_shingle, coalesce(l.t, 0) + coalesce(r.t, 0) > 0 has_document_word_shingle
  from wide left join dss using (pair_id) left join dtt l on l.doc_id = left_doc left join dtt r on r.doc_id = right_doc)"""
# PROFILES holds SEGS and TABLES, which SIMS has too: what follows them can be appended
_PF_ONLY = _FP.split("ln as (", 1)[1].split(",\n" + I.CANON)[0]
_AXES_F = AXES + ",\nln as (" + _PF_ONLY + _FP.split(I.CANON, 1)[1]
_sig, _sig_w = I.weighted_sql(_SIGNATURE)
_txt, _txt_w = I.weighted_sql(_TEXT)
_con, _con_w = I.weighted_sql(W.CONTENT)
_idf, _idf_w = I.weighted_sql(P.IDF_WEIGHTS, "idf")
_SIMQ = I.SIMS + f""",
sims as (select wide.*, {_idf} score, {_idf_w} weight from wide)"""
_KNN = """with q as (select vec_id, embedding, label from embeddings where vec_id % 20 = 0),
s as (select q.vec_id "query", e.vec_id neighbor, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) score from q, embeddings e where q.vec_id <> e.vec_id{0}),
r as (select *, row_number() over (partition by "query" order by score desc, neighbor) rank from s)
select "query", neighbor, round(score, 4) score, rank from r where rank <= 5"""

ORACLES = {
    "same_section_pairs": _W(I.SEGS + ",\n" + I.CANON, "select pair_id, section, left_doc, right_doc, left_object, right_object from prs"),
    "multiset_jaccard": _W(I.JAC, f'select pair_id, entity_kind, {R4("raw_value")} "value", status from jac'),
    "idf_jaccard": _W(I.JAC, "select pair_id, entity_kind, status, left_total, right_total, left_unique, right_unique, shared_unique, " + ", ".join(f"{R4(c)} {c}" for c in ("idf_value", "raw_value", "shared_idf", "union_idf")) + " from jac"),
    "idf_pair_similarity": _W(_SIMQ, f"""select pair_id, section, left_object, right_object, left_doc, right_doc, left_org, right_org, {R4('score')} idf_similarity, case when weight = 0 then 'not_present' when score = 0 then 'measured_no_overlap' else 'measured' end idf_status,
  round(weight, 4) applicable_weight, """ + ", ".join(f"{R4(f'{p}_{k}')} {k}_{p}" for k in P.KINDS for p in ("idf", "raw")) + ", shared_unique from sims"),
    "top_shared": _W(_SIMQ, f"""select left_doc, right_doc, entity_kind, place, entity_hash, left_n, right_n, section_idf, shared_weight from (
  select *, row_number() over (partition by left_doc, right_doc, entity_kind order by shared_weight desc, entity_hash) place from (
    select left_doc, right_doc, a.entity_kind, a.entity_hash, a.n left_n, b.n right_n, a.idf section_idf, {R4('least(a.n, b.n) * a.idf')} shared_weight
    from sims join went a on a.doc_id = left_doc join went b on b.doc_id = right_doc and a.entity_kind = b.entity_kind and a.entity_hash = b.entity_hash where {R4('score')} >= 0.05)) where place <= 3"""),
    "set_jaccard": _W(I.JAC, f"""select pair_id, shared_unique, left_unique - shared_unique left_only, right_unique - shared_unique right_only, {R4('coalesce(shared_unique / nullif(left_unique + right_unique - shared_unique, 0), 0)')} jaccard,
  {R4('coalesce(shared_unique / nullif(left_unique, 0), 0)')} left_coverage, {R4('coalesce(shared_unique / nullif(right_unique, 0), 0)')} right_coverage from jac where entity_kind = 'text_segment'"""),
    "weighted_applicable": """with o as (select o_custkey, count(*) n, count(*) filter (o_orderstatus = 'F') f, count(*) filter (o_orderpriority = '1-URGENT') u, count(*) filter (o_orderstatus = 'P') p from orders group by 1),
w as (select *, 0.40::double + 0.35::double * (u > 0)::int + 0.25::double * (p > 0)::int weight from o)
select o_custkey, round((f / n * 0.40::double + u / n * 0.35::double + p / n * 0.25::double) / weight, 4) score, round(weight, 4) applicable_weight from w""",
    "feature_cosine": _W(_FP, f"select pair_id, {R4(COSINE)} feature_cosine, " + ", ".join(f"{e} {n}_{k}" for n, parts in _SUBS.items() for k, e in parts.items()) + _FJ),
    "subvector_diagnostics": _W(_FP, " union all ".join(f"select pair_id, '{n}' subvector, '{k}' kind, {e} \"value\"{_FJ}" for n, parts in _SUBS.items() for k, e in parts.items())),
    "style_score": _W(STYLED, f"select pair_id, {R4('0.7::double * style_ratio + 0.3::double * style_composition')} style, {R4('style_ratio')} style_ratio, {R4('style_composition')} style_composition from sty"),
    "content_score": _W(I.SIMS, f"select pair_id, {R4(_con)} content, round({_con_w}, 4) applicable_weight from wide"),
    "pair_score_fast": _W(_AXES_F, f"select axs.pair_id, {R4(f'0.55::double * {COSINE} + 0.20::double * raw_page_signature + 0.15::double * raw_table_layout_signature + 0.10::double * raw_table_content_signature')} score from axs join zs l on l.doc_id = left_doc join zs r on r.doc_id = right_doc"),
    "signature_score": _W(I.SIMS, f"select pair_id, {R4(_sig)} score, round({_sig_w}, 4) applicable_weight from wide"),
    "text_score": _W(AXES, f"""select pair_id, {R4('t')} score, round(w, 4) applicable_weight, case when w = 0 then 'not_applicable' when t = 0 then 'measured_no_overlap' else 'measured' end status,
  {R4('case when w > 0 then 0.5::double * s + 0.5::double * t else s end')} combined from (select pair_id, {_sig} s, {_txt} t, {_txt_w} w from axs)"""),
    "detailed_score": _W(_AXES_F, f"select axs.pair_id, {R4(f'0.35::double * {COSINE} + 0.20::double * {R4("raw_page_signature")} + 0.15::double * {R4("raw_table_layout_signature")} + 0.15::double * {R4("raw_table_content_signature")} + 0.15::double * {R4("raw_text_segment")}')} score from axs join zs l on l.doc_id = left_doc join zs r on r.doc_id = right_doc"),
    "evidence_class": _W(I.JAC + ",\nln as (" + _PF_ONLY + _FP.split(I.CANON, 1)[1] + f""",
sty as (select pair_id, round({_STYLE['style_ratio']}, 9) structural{_FJ}),
rr as (
  select a.doc_id left_doc, b.doc_id right_doc, count(*) rare from went a join went b on a.section = b.section and a.entity_kind = b.entity_kind and a.entity_hash = b.entity_hash and a.object_id < b.object_id
  join freq on freq.section = a.section and freq.entity_kind = a.entity_kind and freq.entity_hash = a.entity_hash where a.entity_kind = 'text_segment' and global_df_ratio <= 0.25 group by all),
ev as (
  select pair_id, left_doc, right_doc, max(shared_unique) filter (entity_kind = 'text_segment') segments, max(coalesce(shared_unique / nullif(left_unique + right_unique - shared_unique, 0), 0)) filter (entity_kind = 'text_segment') jaccard,
    max(shared_unique) filter (entity_kind = 'table_layout_signature') layouts, max(shared_unique) filter (entity_kind = 'table_content_signature') "tables" from jac group by all),
ef as (select ev.*, coalesce(rare, 0) rare, structural from ev left join rr using (left_doc, right_doc) join sty using (pair_id))""",
        f"""select pair_id, {R4('structural')} structural, "tables", segments, rare, {R4('jaccard')} jaccard, layouts,
  case when structural < 0.85 then 'below_strong_structural' when "tables" > 0 and segments > 0 then 'structure_text_table_content' when "tables" > 0 then 'structure_table_content' when rare > 0 and jaccard >= 0.2 then 'structure_rare_text_review'
    when jaccard >= 0.5 then 'structure_strong_text' when segments > 0 then 'structure_text_bridge' when layouts > 0 then 'structure_table_layout' else 'structural_only' end "class",
  case when structural < 0.85 then null when "tables" > 0 then 'table_content_overlap' when rare > 0 and jaccard >= 0.5 then 'rare_text_high_overlap' when rare > 0 and jaccard >= 0.2 then 'rare_text_partial_overlap' end strength from ef"""),
    "topk_any": _KNN.format(""),
    "topk_cross": _KNN.format(" and q.label <> e.label"),
}
