"""Queries of the text, entity and frequency operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities as E
from ..operators import frequency as Q
from . import inputs as I


def normalize_text(spark, d):
    return E.normalized_segments(I.segments(spark, d)).select("doc_id", F.col("seg_no").cast("bigint").alias("seg_no"), "normalized")


def text_tokens(spark, d):
    rows = E.normalized_segments(I.segments(spark, d)).select("doc_id", F.explode(T.tokens(F.col("normalized"))).alias("token"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.countDistinct("token").alias("distinct_tokens"), F.max(F.length("token")).cast("bigint").alias("longest"))


def word_shingles(spark, d):
    return I.entities(spark, d).where("entity_kind = 'text_word_shingle'").select("doc_id", "entity_hash", "n")


def segment_entities(spark, d):
    return I.entities(spark, d).select("doc_id", "section", "entity_kind", "entity_hash", "n")


def stable_ids(spark, d):
    rows = I.segment_entities(spark, d).select("section", "entity_kind", "entity_hash").distinct()
    return rows.select(T.stable_id("txt_", "text_candidate", F.col("section"), F.col("entity_kind"), F.col("entity_hash")).alias("candidate_id"), "entity_hash", "section")


def section_df_idf(spark, d):
    return I.frequency(spark, d, T.binary_hash).withColumn("entity_hash", T.hex_of(F.col("entity_hash")))


def global_df_idf(spark, d):
    """An entity's row of each section says the same of all; rows of an entity are in one place, so the first of them is taken there."""
    rows = I.frequency(spark, d, T.binary_hash).groupBy("entity_kind", "entity_hash").agg(*[F.max(c).alias(c) for c in ("global_df", "global_df_ratio", "global_idf")])
    return rows.withColumn("entity_hash", T.hex_of(F.col("entity_hash")))


def frequency_bucket(spark, d):
    return I.frequency(spark, d, I.short_hash).groupBy("section", "entity_kind", "frequency_bucket").agg(F.count("*").alias("entities"), F.sum("occurrence_count").alias("occurrences"))


def section_typicality(spark, d):
    return Q.typicality(*I.counted(spark, d, I.short_hash))


def repeated_signatures(spark, d):
    segs = E.normalized_segments(I.segments(spark, d))
    return E.repeated_signatures(segs.select(F.lit("segment").alias("signature_type"), T.text_hash(F.col("normalized")).alias("signature"), "doc_id", "object_id", "section"))


def coverage_matrix(spark, d):
    """Every object and section: how many documents, the canonical one, and a status."""
    docs = I.table_docs(spark, d)
    cells = docs.select("object_id").distinct().crossJoin(F.broadcast(docs.select("section").distinct()))
    found = docs.groupBy("object_id", "section").agg(F.count("*").alias("documents"), F.min("doc_id").alias("canonical_doc"))
    out = cells.join(found, ["object_id", "section"], "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    status = F.when(F.col("documents") == 0, "missing").when(F.col("documents") == 1, "ok").otherwise("duplicate")
    return out.select("object_id", "section", "documents", "canonical_doc", status.alias("status"))


def canonical_documents(spark, d):
    """The first document of each object and section: the longest, then the lowest id."""
    place = F.row_number().over(Window.partitionBy("object_id", "section").orderBy(F.desc(F.length("text")), "doc_id"))
    return I.table_docs(spark, d).withColumn("place", place).where("place = 1").select("object_id", "section", "doc_id")


def content_signatures(spark, d):
    """Each document as a table whose cells are the words of its lines: the hash of its cells in order."""
    texts = I.docs(spark, d).where("text is not null").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    cells = F.flatten(F.transform("texts", E.text_cells))  # made after the shuffle, which carries texts alone
    return texts.select("doc_id", E.cells_hash(cells).alias("content_sha1"))


def page_ranges(spark, d):
    """Page lists such as 1;3-5 (made of order and line numbers) as sorted distinct pages."""
    rows = I.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("", F.lit("1;"), F.col("l_linenumber"), F.lit("-"), F.col("l_linenumber") + 3, F.lit(";x")).alias("pages"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(T.page_ranges(F.col("pages")), ",").alias("page_list"))


def safe_numbers(spark, d):
    """Texts as numbers: a comma for a point, 0 for what is none, whole part towards zero."""
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.replace(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")))
    rows = I.table(spark, d, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", T.safe_double(F.col("raw")).alias("number"), T.safe_int(F.col("raw")).alias("whole"))


QUERIES = {f.__name__: f for f in (
    normalize_text, text_tokens, word_shingles, segment_entities, stable_ids, section_df_idf, global_df_idf, frequency_bucket,
    section_typicality, repeated_signatures, coverage_matrix, canonical_documents, content_signatures, page_ranges, safe_numbers,
)}

_W = I.with_
ORACLES = {
    "normalize_text": _W(I.SEGS, "select doc_id, seg_no, normalized from norm"),
    "text_tokens": _W(I.ENT, "select doc_id, count(*) tokens, count(distinct t) distinct_tokens, max(length(t))::bigint longest from (select doc_id, unnest(w) t from toks) group by 1"),
    "word_shingles": _W(I.ENT, "select doc_id, entity_hash, n from ent where entity_kind = 'text_word_shingle'"),
    "segment_entities": _W(I.ENT, "select doc_id, section, entity_kind, entity_hash, n from ent"),
    "stable_ids": _W(I.ENT, "select distinct 'txt_' || substr(sha1('text_candidate|' || section || '|' || entity_kind || '|' || entity_hash), 1, 16) candidate_id, entity_hash, section from ent where entity_kind = 'text_segment'"),
    "section_df_idf": _W(I.FREQ, "select * from freq"),
    "global_df_idf": _W(I.FREQ, "select distinct entity_kind, entity_hash, global_df, global_df_ratio, global_idf from freq"),
    "frequency_bucket": _W(I.FREQ, "select section, entity_kind, frequency_bucket, count(*) entities, sum(occurrence_count)::bigint occurrences from freq group by all"),
    "section_typicality": _W(I.FREQ, """select *, round(typical_count / occurrence_count, 4) typical_share, round(shared_rare_count / occurrence_count, 4) shared_rare_share,
  round(original_count / occurrence_count, 4) original_share, round(low_population_count / occurrence_count, 4) low_population_share from (
  select doc_id, section, entity_kind, sum(n)::bigint occurrence_count, count(*) unique_entity_count,
    coalesce(sum(n) filter (frequency_bucket = 'typical'), 0)::bigint typical_count, coalesce(sum(n) filter (frequency_bucket = 'shared_rare'), 0)::bigint shared_rare_count,
    coalesce(sum(n) filter (frequency_bucket = 'original'), 0)::bigint original_count, coalesce(sum(n) filter (frequency_bucket = 'low_population'), 0)::bigint low_population_count,
    round(sum(n * section_idf) / sum(n) + 1e-9::double, 4) mean_section_idf
  from ent join freq using (section, entity_kind, entity_hash) group by all)"""),
    "repeated_signatures": _W(I.SEGS, """select 'segment' signature_type, sha1(normalized) signature, count(*) occurrence_count, count(distinct doc_id) document_count,
  count(distinct object_id) object_count, string_agg(distinct section, '|' order by section) sections from norm group by all having count(*) >= 2"""),
    "coverage_matrix": """select o.source object_id, s.lang section, coalesce(documents, 0)::bigint documents, canonical_doc,
  case when documents is null then 'missing' when documents = 1 then 'ok' else 'duplicate' end status
from (select distinct source || '/' || (doc_id % 7) as source from documents) o cross join (select distinct lang from documents) s
left join (select source || '/' || (doc_id % 7) as source, lang, count(*) documents, min(doc_id) canonical_doc from documents group by all) f on f.source = o.source and f.lang = s.lang""",
    "canonical_documents": "select source || '/' || (doc_id % 7) object_id, lang section, doc_id from documents qualify row_number() over (partition by source, doc_id % 7, lang order by length(text) desc, doc_id) = 1",
    "content_signatures": """with segs as (select doc_id, unnest(range(len(ls))) r, unnest(ls) t from (select doc_id, string_split(text, chr(10)) ls from documents)),
cells as (select doc_id, r, unnest(range(len(ws))) c, unnest(ws) v from (select doc_id, r, string_split(t, ' ') ws from segs))
select doc_id, sha1(string_agg(r::varchar || ':' || c::varchar || ':' || lower(trim(v)), chr(10) order by r, c)) content_sha1 from cells group by 1""",
    "page_ranges": """select l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_concat([1], range(l_linenumber, l_linenumber + 4)))), ',') page_list from lineitem""",
    "safe_numbers": """select event_id, case when event_id % 5 = 0 then 0.0 else value::decimal(18,2)::double end number,
  case when event_id % 5 = 0 then 0 else trunc(value::decimal(18,2)::double)::bigint end whole from events""",
}
