"""The driver tables as the abstract inputs of the operators, in Spark and as SQL fragments of the same names.

A document's section is its language, its organisation its source; an organisation has OBJECTS objects, to which its
documents belong by id. A document's segments are its lines, its tables the runs of lines with a bar in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators import entities as E
from ..operators import frequency as Q
from ..operators import pairs as P
from ..storage import by_key, dealt_out, stored

OBJECTS = 7
#: Partitions of texts to each part that their files are read in.
PIECES = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, section, object_id, org, text, as they are read."""
    obj = F.concat("source", F.lit("/"), (F.col("doc_id") % OBJECTS).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("section"), obj.alias("object_id"), F.col("source").alias("org"), "text")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, in enough partitions for the heavy expressions on their texts."""
    return dealt_out(table_docs(spark, sf_dir), "doc_id")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.segments(docs(spark, sf_dir))


def whole_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out by id: the texts are shuffled, so that what is counted in a document, many times as much, is not.

    Their partitions follow the input, PIECES to a part of its files, whatever the number of shuffle partitions: what a
    task makes of its texts is many times their size and has to fit into its memory.
    """
    rows = table_docs(spark, sf_dir)
    return by_key(rows, "doc_id", least=pieces(rows))


def pieces(rows: DataFrame) -> int:
    return PIECES * rows.rdd.getNumPartitions()


def short_hash(text: Column) -> Column:
    """A 64-bit hash, for entities that don't leave the engine."""
    return F.xxhash64(text)


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stand for an object in a section: as many as there are objects and sections."""
    rows = table_docs(spark, sf_dir)
    chosen = stored(P.canonical_documents(rows).select("doc_id"), "canonical-ids")
    return by_key(rows.join(_sent(chosen), "doc_id", "left_semi"), "doc_id")


def entities(spark: SparkSession, sf_dir: str, hashed=E.text_hash) -> DataFrame:
    """All kinds of entities of all documents."""
    return entities_of(whole_docs(spark, sf_dir), hashed)


def entities_of(documents: DataFrame, hashed=E.text_hash, among=None) -> DataFrame:
    """All kinds of entities; ``among`` leaves out rows before they are counted."""
    segs = E.segments(documents)
    others = E.table_entities(segs, hashed).unionByName(E.page_entities(segs, hashed))
    return E.text_entities(segs, hashed, among).unionByName(among(others) if among else others)


def segment_entities(spark: SparkSession, sf_dir: str, hashed=E.text_hash) -> DataFrame:
    return E.text_entities(segments(spark, sf_dir), hashed).where("entity_kind = 'text_segment'")


def counted(spark: SparkSession, sf_dir: str, hashed=E.text_hash) -> tuple[DataFrame, DataFrame]:
    """Entities, stored once, and their frequency."""
    rows = stored(entities(spark, sf_dir, hashed), "entities")
    return rows, Q.document_frequency(rows, with_entities(spark, sf_dir))


def with_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section and doc_id of the documents that have entities: those with a text, if only a page of one blank line."""
    return table_docs(spark, sf_dir).where("text is not null").select("section", "doc_id")


def frequency(spark: SparkSession, sf_dir: str, hashed=E.text_hash) -> DataFrame:
    """The frequency of all entities, which are not stored."""
    return Q.document_frequency(entities(spark, sf_dir, hashed), with_entities(spark, sf_dir))


#: Rows of one number that are sent to all executors, at most.
SENT = 1 << 20


def _sent(rows: DataFrame) -> DataFrame:
    """Stored rows of one number as a side that is sent to all executors; merged where they are too many."""
    return F.broadcast(rows) if rows.count() <= SENT else rows.hint("merge")


def canonical_counted(spark: SparkSession, sf_dir: str, hashed=E.text_hash) -> tuple[DataFrame, DataFrame]:
    """Entities of the canonical documents, stored, and the frequency in all documents of these entities alone.

    Others are left out by one number of 64 bits before anything is counted or shuffled: the canonical documents' are as
    many as there are objects, not documents. So what is left of a task's texts is folded before it is shuffled.
    """
    rows = stored(entities_of(canonical(spark, sf_dir), hashed), "entities")
    code = F.xxhash64("entity_kind", "entity_hash")
    wanted = _sent(stored(rows.select(code.alias("code")).distinct(), "wanted-hashes"))
    among = lambda some: some.withColumn("code", code).join(wanted, "code", "left_semi").drop("code")
    found = entities_of(whole_docs(spark, sf_dir), hashed, among)
    return rows, Q.document_frequency(found, with_entities(spark, sf_dir), fold=True)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.comparison_pairs(P.canonical_documents(table_docs(spark, sf_dir)))


#: What the profile of a document is made of; see profiles().
FEATURES = (
    "pages", "lines", "words", "chars", "text_lines", "table_lines", "blank_lines", "image_lines", "tables", "cells", "segments_pp", "lines_pp", "tables_pp",
    "cells_pp", "text_ratio", "table_ratio", "blank_ratio", "image_ratio",
)
SUBVECTORS = {
    "volume": ("pages", "lines", "words", "chars"),
    "density": ("segments_pp", "lines_pp", "cells_pp"),
    "text": ("words", "chars", "text_lines", "text_ratio"),
    "tables": ("tables", "cells", "table_lines", "tables_pp", "cells_pp", "table_ratio"),
    "graphics": ("image_lines", "image_ratio", "blank_lines", "blank_ratio"),
    "element_mix": ("text_ratio", "table_ratio", "blank_ratio", "image_ratio"),
}
#: The 11 ratio keys and the 6 share keys of the style score.
STYLE_RATIOS = ("pages", "lines_pp", "text_pp", "table_lines_pp", "blank_pp", "image_pp", "tables_pp", "segments_pp", "table_rows", "table_cols", "table_cells")
STYLE_SHARES = ("text_share", "line_share", "frame_share", "image_share", "table_share", "other_share")


def profiles(documents: DataFrame) -> DataFrame:
    """doc_id and the numbers of each document: FEATURES and the style keys.

    A line is a text line, a table line (with a bar), a blank one or an image line (without a letter); lines with a
    symbol also count as other.
    """
    segs = E.segments(documents)
    n = normalize_text(F.col("text"))
    rows = segs.select("doc_id", "seg_no", n.alias("n"), F.contains("text", F.lit("|")).alias("bar"), F.col("text").rlike(r"\p{L}").alias("letter"), F.col("text").rlike(r"[#$%&*]").alias("symbol"))
    blank, table_line = F.col("n") == "", F.col("bar")
    image = ~table_line & ~blank & ~F.col("letter")
    text = ~table_line & ~blank & F.col("letter")
    words = F.when(blank, 0).otherwise(F.size(F.split("n", " ")))
    count = lambda c: F.count_if(c).cast("double")
    out = rows.groupBy("doc_id").agg(
        F.count("*").cast("double").alias("lines"), F.sum(words).cast("double").alias("words"), F.sum(F.length("n")).cast("double").alias("chars"), count(text).alias("text_lines"),
        count(table_line).alias("table_lines"), count(blank).alias("blank_lines"), count(image).alias("image_lines"), count(F.col("symbol")).alias("other_lines"),
    )
    tables = E.table_lines(segs).groupBy("doc_id", "table_no").agg(F.count("*").alias("r"), F.max(F.size("cells")).alias("c"), F.sum(F.size("cells")).alias("k"))
    tables = tables.groupBy("doc_id").agg(
        F.count("*").cast("double").alias("tables"), F.sum("k").cast("double").alias("cells"), F.avg("r").alias("table_rows"), F.avg("c").alias("table_cols"), F.avg("k").alias("table_cells")
    )
    out = out.join(tables, "doc_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("tables", "cells", "table_rows", "table_cols", "table_cells")})
    out = out.withColumn("pages", F.ceil(F.col("lines") / E.PAGE_LINES).cast("double"))
    pp = {"segments_pp": F.col("lines") - F.col("blank_lines"), "lines_pp": F.col("lines"), "text_pp": F.col("text_lines"), "table_lines_pp": F.col("table_lines"), "blank_pp": F.col("blank_lines"), "image_pp": F.col("image_lines"), "tables_pp": F.col("tables"), "cells_pp": F.col("cells")}
    parts = {"text": "text_lines", "line": "table_lines", "frame": "blank_lines", "image": "image_lines", "table": "tables", "other": "other_lines"}
    total = F.col("text_lines") + F.col("table_lines") + F.col("blank_lines") + F.col("image_lines") + F.col("tables") + F.col("other_lines")
    ratio = {"text_ratio": "text_lines", "table_ratio": "table_lines", "blank_ratio": "blank_lines", "image_ratio": "image_lines"}
    return out.withColumns(
        {
            **{k: c / F.col("pages") for k, c in pp.items()},
            **{f"{k}_share": F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) for k, c in parts.items()},
            **{k: F.col(c) / F.col("lines") for k, c in ratio.items()},
        }
    )


_NORM = r"trim(regexp_replace(replace(lower(translate({0}, 'ÐðÖöÞþ', 'РрЦцЮю')), 'ё', 'е'), '\s+', ' ', 'g'))"

#: Common table expressions, each naming those it needs before it.
SEGS = """docs as (select doc_id, lang section, source || '/' || (doc_id % """ + str(OBJECTS) + """)::varchar object_id, source org, text from documents),
segs as (select doc_id, section, object_id, unnest(range(len(ls))) seg_no, unnest(ls) as text from (select *, string_split(text, chr(10)) ls from docs)),
norm as (select doc_id, section, object_id, seg_no, n normalized from (select *, """ + _NORM.format("text") + """ n from segs) where n <> '')"""

TABLES = """tl as (
  select doc_id, section, object_id, seg_no, list_transform(string_split(text, '|'), lambda x: """ + _NORM.format("x") + """) cells, seg_no - row_number() over (partition by doc_id order by seg_no) table_no
  from segs where contains(text, '|')),
tr as (select *, row_number() over (partition by doc_id, table_no order by seg_no) - 1 r from tl)"""

ENT = SEGS + r""",
toks as (select *, list_filter(regexp_extract_all(lower(normalized), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) w from norm),
shing as (select doc_id, section, object_id, sha1(array_to_string(w[i:i + 4], ' ')) h from (select *, unnest(range(1, len(w) - 3)) i from toks where len(w) >= 5)),
""" + TABLES + """,
ent as (
  select doc_id, section, object_id, 'text_segment' entity_kind, sha1(normalized) entity_hash, count(*) n from norm group by all
  union all
  select doc_id, section, object_id, 'text_word_shingle' entity_kind, h entity_hash, count(*) n from shing group by all
  union all
  select doc_id, section, object_id, 'table_cell_text' entity_kind, sha1(v) entity_hash, count(*) n from (select *, unnest(cells) v from tl) where v <> '' group by all
  union all
  select doc_id, section, object_id, 'table_layout_signature' entity_kind, h entity_hash, count(*) n from (
    select doc_id, section, object_id, sha1('rows:' || count(*) || '|cols:' || max(len(cells)) || '|cells:' || sum(len(cells))) h from tl group by doc_id, section, object_id, table_no) group by all
  union all
  select doc_id, section, object_id, 'table_content_signature' entity_kind, h entity_hash, count(*) n from (
    select doc_id, section, object_id, sha1(string_agg(r || ':' || c || ':' || v, chr(10) order by r, c)) h from (select *, unnest(range(len(cells))) c, unnest(cells) v from tr) group by doc_id, section, object_id, table_no) group by all
  union all
  select doc_id, section, object_id, 'page_signature' entity_kind, h entity_hash, count(*) n from (
    select doc_id, section, object_id, sha1('lines:' || count(*) || '|tables:' || count(*) filter (contains(text, '|')) || '|blank:' || count(*) filter (""" + _NORM.format("text") + """ = '')) h from segs group by doc_id, section, object_id, seg_no // 20) group by all)"""

FREQ = ENT + """,
dcount as (select section, count(distinct doc_id) nd from ent group by 1),
gcount as (select sum(nd)::bigint gd from dcount),
ldf as (select section, entity_kind, entity_hash, count(*) section_df, sum(n)::bigint occurrence_count from ent group by all),
gdf as (select entity_kind, entity_hash, sum(section_df)::bigint global_df from ldf group by all),
freq as (
  select section, entity_kind, entity_hash, section_df, nd section_document_count, round(section_df / nd, 4) section_df_ratio,
    round(ln((nd + 1) / (section_df + 1)) + 1, 4) section_idf, global_df, round(global_df / gd, 4) global_df_ratio,
    round(ln((gd + 1) / (global_df + 1)) + 1, 4) global_idf, occurrence_count,
    case when nd < 2 then 'low_population' when section_df <= 1 then 'original' when section_df / nd >= 0.5 then 'typical' else 'shared_rare' end frequency_bucket
  from ldf join gdf using (entity_kind, entity_hash) join dcount using (section), gcount)"""

CANON = """canon as (select section, object_id, any_value(org) org, min(doc_id) doc_id from docs group by section, object_id),
prs as (
  select a.section, a.object_id left_object, b.object_id right_object, a.doc_id left_doc, b.doc_id right_doc, a.org left_org, b.org right_org, a.section || '__' || a.doc_id || '__' || b.doc_id pair_id
  from canon a join canon b on a.section = b.section and a.object_id < b.object_id)"""

_KINDS = ", ".join(f"('{k}')" for k in P.KINDS)
JAC = FREQ + ",\n" + CANON + f""",
kinds(entity_kind) as (values {_KINDS}),
went as (select ent.*, coalesce(section_idf, 1.0) idf from ent join canon using (doc_id) left join freq on freq.section = ent.section and freq.entity_kind = ent.entity_kind and freq.entity_hash = ent.entity_hash),
tot as (select doc_id, entity_kind, sum(n)::bigint total, sum(n * idf) total_idf, count(*) u, sum(idf) u_idf from went group by all),
shr as (
  select a.doc_id left_doc, b.doc_id right_doc, a.entity_kind, sum(least(a.n, b.n))::bigint shared, sum(least(a.n, b.n) * a.idf) shared_weight, count(*) shared_unique, sum(a.idf) shared_idf
  from went a join went b on a.section = b.section and a.entity_kind = b.entity_kind and a.entity_hash = b.entity_hash and a.object_id < b.object_id group by all),
jac as (
  select prs.*, kinds.entity_kind, coalesce(shared, 0) shared, coalesce(shared_unique, 0) shared_unique, coalesce(shared_idf, 0.0) shared_idf, coalesce(l.total, 0) left_total, coalesce(r.total, 0) right_total,
    coalesce(l.u, 0) left_unique, coalesce(r.u, 0) right_unique, coalesce(l.u_idf, 0) + coalesce(r.u_idf, 0) - coalesce(shared_idf, 0) union_idf,
    coalesce(coalesce(shared, 0) / nullif(coalesce(l.total, 0) + coalesce(r.total, 0) - coalesce(shared, 0), 0), 0.0) raw_value,
    coalesce(coalesce(shared_weight, 0) / nullif(coalesce(l.total_idf, 0) + coalesce(r.total_idf, 0) - coalesce(shared_weight, 0), 0), 0.0) idf_value,
    case when coalesce(l.total, 0) + coalesce(r.total, 0) = 0 then 'not_present' when coalesce(shared, 0) = 0 then 'measured_no_overlap' else 'measured' end status
  from prs cross join kinds left join shr using (left_doc, right_doc, entity_kind)
  left join tot l on l.doc_id = prs.left_doc and l.entity_kind = kinds.entity_kind left join tot r on r.doc_id = prs.right_doc and r.entity_kind = kinds.entity_kind)"""

_of = lambda k, c: f"max({c}) filter (entity_kind = '{k}')"
SIMS = JAC + """,
wide as (select pair_id, section, left_object, right_object, left_doc, right_doc, left_org, right_org, """ + ", ".join(
    f"{_of(k, 'raw_value')} raw_{k}, {_of(k, 'idf_value')} idf_{k}, bool_or(status <> 'not_present') filter (entity_kind = '{k}') has_{k}" for k in P.KINDS
) + """, sum(shared_unique)::bigint shared_unique from jac group by all)"""


def weighted_sql(weights: dict[str, float], prefix: str = "raw") -> tuple[str, str]:
    """The weighted mean over the kinds that a pair has, and their weight, over the columns of ``wide``."""
    weight = " + ".join(f"has_{k}::int * {w}::double" for k, w in weights.items())
    value = " + ".join(f"has_{k}::int * {prefix}_{k} * {w}::double" for k, w in weights.items())
    return f"coalesce(({value}) / nullif({weight}, 0), 0.0)", f"({weight})"


PROFILES = SEGS + ",\n" + TABLES + """,
ln as (select doc_id, """ + _NORM.format("text") + r""" n, contains(text, '|') bar, regexp_matches(text, '\p{L}') letter, regexp_matches(text, '[#$%&*]') symbol from segs),
lc as (
  select doc_id, count(*)::double as lines, sum(case when n = '' then 0 else len(string_split(n, ' ')) end)::double words, sum(length(n))::double chars, count(*) filter (not bar and n <> '' and letter)::double text_lines,
    count(*) filter (bar)::double table_lines, count(*) filter (n = '')::double blank_lines, count(*) filter (not bar and n <> '' and not letter)::double image_lines, count(*) filter (symbol)::double other_lines
  from ln group by 1),
tc as (select doc_id, count(*)::double "tables", sum(k)::double cells, avg(r) table_rows, avg(c) table_cols, avg(k) table_cells from (
  select doc_id, table_no, count(*) r, max(len(cells)) c, sum(len(cells)) k from tl group by all) group by 1),
pf0 as (select lc.*, ceil(lines / 20)::double pages, coalesce("tables", 0) "tables", coalesce(cells, 0) cells, coalesce(table_rows, 0) table_rows, coalesce(table_cols, 0) table_cols, coalesce(table_cells, 0) table_cells from lc left join tc using (doc_id)),
pf as (
  select *, (lines - blank_lines) / pages segments_pp, lines / pages lines_pp, text_lines / pages text_pp, table_lines / pages table_lines_pp, blank_lines / pages blank_pp, image_lines / pages image_pp, "tables" / pages tables_pp, cells / pages cells_pp,
    text_lines / lines text_ratio, table_lines / lines table_ratio, blank_lines / lines blank_ratio, image_lines / lines image_ratio,
    """ + ", ".join(f"coalesce({c} / nullif(text_lines + table_lines + blank_lines + image_lines + \"tables\" + other_lines, 0), 0) {k}_share" for k, c in (("text", "text_lines"), ("line", "table_lines"), ("frame", "blank_lines"), ("image", "image_lines"), ("table", '"tables"'), ("other", "other_lines"))) + """
  from pf0)"""


def with_(ctes: str, select: str) -> str:
    return f"with {ctes}\n{select}"
