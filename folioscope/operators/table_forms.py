"""The table-form library: layouts that recur over the objects of a section, with contents that stay or vary, and what they cover.

A form is a layout of a section. Counts go up in two levels: tables fold to documents, objects and organisations, and
apart from that to contents; a form that too few objects have is left out before anything of it is gathered. No list of
contents or tables is ever held: the dominant content is the largest of counted rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id, text_hash
from .frequency import idf
from .library import DISTINCTIVE

#: Objects of a form, cells of a meaningful one, dominant share of a mostly same content, listed hashes and ids.
LEAST_OBJECTS, LEAST_CELLS, MOSTLY_SAME, LISTED_HASHES, LISTED_IDS, TOP_IDS = 3, 6, 0.8, 50, 100, 50
ID_BASE, ID_PREFIX, KIND = "typical_element_candidate_v0", "tec_v0_", "table_layout_form"
FORM = ["section", "layout"]
_NO_ORG = ("", "UNKNOWN")


def from_cells(cells: DataFrame) -> DataFrame:
    """Tables of cells (doc_id, section, object_id, org, table_id, row, col, text): a row each, with rows, cols, cells, layout, content.

    A layout is the numbers of rows, columns and cells; a content the texts by place. Cells without text count as cells
    of the layout and say nothing in the content, which is null where no cell has a text.
    """
    by = ["doc_id", "section", "object_id", "org", "table_id"]
    said = F.collect_list(F.when(F.col("text") != "", F.struct("row", "col", "text")))
    out = cells.groupBy(*by).agg(F.countDistinct("row").alias("rows"), F.countDistinct("col").alias("cols"), F.count("*").alias("cells"), F.array_sort(said).alias("said"))
    return out.select(*by, "rows", "cols", "cells", *_signed())


def _signed() -> list[Column]:
    """layout and content of rows, cols, cells and said."""
    size = F.concat_ws("|", *[F.concat(F.lit(f"{c}:"), F.col(c)) for c in ("rows", "cols", "cells")])
    lines = F.array_join(F.transform("said", lambda x: F.concat_ws(":", x["row"], x["col"], x["text"])), "\n")
    return [text_hash(size).alias("layout"), F.when(F.size("said") > 0, text_hash(lines)).alias("content")]


def from_lines(tables: DataFrame) -> DataFrame:
    """from_cells() of tables that are whole in a row: the column lines has the texts of each line by column, null where there is
    no cell. The other columns stay; texts has the distinct texts."""
    keys = [c for c in tables.columns if c != "lines"]
    number = lambda k, t: F.struct((k + 1).alias("row"), t.alias("texts"))
    placed = F.transform(F.transform("lines", lambda t, k: number(k, t)), lambda x: F.transform(x["texts"], lambda t, c: F.struct(x["row"].alias("row"), c.alias("col"), t.alias("text"))))
    rows = tables.select(*keys, F.filter(F.flatten(placed), lambda x: x["text"].isNotNull()).alias("all")).where("size(all) > 0")
    many = lambda c: F.size(F.array_distinct(F.col("all")[c])).cast("bigint").alias(f"{c}s")
    rows = rows.select(*keys, many("row"), many("col"), F.size("all").cast("bigint").alias("cells"), F.filter("all", lambda x: x["text"] != "").alias("said"))
    return rows.select(*keys, "rows", "cols", "cells", *_signed(), F.array_distinct(F.col("said")["text"]).alias("texts"))


def _common(tables: DataFrame, name: str) -> DataFrame:
    """section, layout, name: a form's commonest value of a column, of equal ones that of the first table (by doc_id, table_id)."""
    counted = tables.groupBy(*FORM, name).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "table_id")).alias("first"))
    return counted.groupBy(*FORM).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", name))[name].alias(f"{name}_mode"))


def _variability(contents: Column, most: Column, objects: Column) -> Column:
    return (
        F.when(contents == 0, "unknown")
        .when(contents == 1, "same_content")
        .when(most / objects >= MOSTLY_SAME, "mostly_same_content")
        .otherwise("stable_form_variable_content")
    )


def candidates(tables: DataFrame, documents: DataFrame, least_objects: int = LEAST_OBJECTS, least_cells: int = LEAST_CELLS) -> DataFrame:
    """Forms that ``least_objects`` or more objects of a section have: their counts, organisations, contents, classes and status.

    tables: those of from_cells(); documents: doc_id, section, object_id, org of all documents, with tables or not. An
    organisation's ratio is the share of its objects in the section that have the form; the largest ratio dominates, on a
    tie the larger name. Forms of few cells or one dimension are kept as diagnostic_trivial. Documents and tables of the
    section UNKNOWN, and tables without a layout, are left out.
    """
    documents, tables = documents.where("section <> 'UNKNOWN'"), tables.where("section <> 'UNKNOWN' and layout <> ''")
    by_doc = tables.groupBy(*FORM, "org", "object_id", "doc_id").agg(F.count("*").alias("tables"))
    by_object = by_doc.groupBy(*FORM, "org", "object_id").agg(F.count("*").alias("docs"), F.sum("tables").alias("tables"))
    by_org = by_object.groupBy(*FORM, "org").agg(F.count("*").alias("objects"), F.sum("docs").alias("docs"), F.sum("tables").alias("tables"))
    forms = by_org.groupBy(*FORM).agg(F.sum("objects").alias("object_count"), F.sum("docs").alias("document_count"), F.sum("tables").alias("occurrence_count"), F.count("*").alias("org_count"))
    forms = forms.where(F.col("object_count") >= least_objects)

    kept = forms.select(*FORM)
    of_form = tables.join(kept, FORM, "left_semi")
    contents = of_form.where("content <> ''").groupBy(*FORM, "content").agg(F.count("*").alias("n"))
    contents = contents.groupBy(*FORM).agg(F.count("*").alias("content_count"), F.max("n").alias("most"))
    sizes = documents.groupBy("section", "org").agg(F.countDistinct("object_id").alias("org_objects"))
    sections = documents.groupBy("section").agg(F.countDistinct("object_id").alias("section_objects"), F.countDistinct("doc_id").alias("section_documents"))
    orgs = by_org.join(kept, FORM, "left_semi").join(sizes, ["section", "org"], "left")
    orgs = orgs.withColumn("ratio", F.col("objects") / F.greatest(F.lit(1), F.coalesce("org_objects", F.lit(0))))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("org", c))), lambda x: F.concat_ws(":", x["org"], x[c].cast("string"))), "|")
    orgs = orgs.groupBy(*FORM).agg(
        F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("ratio", "org", "objects")))), 1, 2).alias("lead"), listed("objects").alias("org_object_counts"), listed("tables").alias("org_occurrence_counts")
    )
    out = forms.join(orgs, FORM).join(contents, FORM, "left").na.fill(0, ["content_count", "most"]).join(sections, "section", "left").na.fill(0, ["section_objects", "section_documents"])
    for name in ("rows", "cols", "cells"):
        out = out.join(_common(of_form, name), FORM)

    first, second = F.col("lead")[0], F.coalesce(F.try_element_at("lead", F.lit(2))["ratio"], F.lit(0.0))
    delta = first["ratio"] - second
    several = F.col("org_count") > 1
    held = _variability(F.col("content_count"), F.col("most"), F.col("object_count"))
    reused = held.isin("same_content", "mostly_same_content")
    reason = F.array_join(F.array_compact(F.array(F.when(F.col("cells_mode") < least_cells, f"cell_count<{least_cells}"), F.when((F.col("rows_mode") <= 1) | (F.col("cols_mode") <= 1), "one_dimensional_table"))), "|")
    note = F.concat_ws(
        "; ", F.lit("table_layout_signature_exact"), F.lit("near_match_pending"), F.when(held == "stable_form_variable_content", held).when(reused, "content_reuse_check"), F.when(reason != "", "trivial_micro_form")
    )
    round4 = lambda c: F.round(c + 1e-9, 4)
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return out.select(
        stable_id(ID_PREFIX, ID_BASE, F.col("section"), F.lit(KIND), F.col("layout")).alias("candidate_id"), *FORM,
        F.when(several & reused, "borrowing_candidate").otherwise("typical_form").alias("candidate_class"), *[f"{c}_mode" for c in ("rows", "cols", "cells")],
        "object_count", "document_count", "occurrence_count", "section_objects", "section_documents",
        round4(share("object_count", "section_objects")).alias("object_ratio"), round4(share("document_count", "section_documents")).alias("document_ratio"),
        F.round(idf(F.col("document_count"), F.col("section_documents")), 4).alias("section_idf"), F.when(several, "cross_org").otherwise("single_org").alias("org_scope"),
        F.when(~several, "org_specific").when(delta >= DISTINCTIVE, "org_distinctive").otherwise("cross_org_common").alias("org_class"),
        first["org"].alias("dominant_org"), first["objects"].alias("dominant_objects"), round4(first["ratio"]).alias("dominant_ratio"), round4(second).alias("second_ratio"), round4(delta).alias("delta"),
        "org_object_counts", "org_occurrence_counts", held.alias("content_variability"), "content_count", round4(share("most", "occurrence_count")).alias("dominant_content_ratio"),
        F.when(reason != "", "trivial_micro_form").otherwise("meaningful_form").alias("triviality_status"), reason.alias("triviality_reason"),
        F.when(reason != "", "diagnostic_trivial").otherwise("candidate").alias("candidate_status"), note.alias("reliability_note"),
    )


def evidence(tables: DataFrame, cells: DataFrame | None, found: DataFrame) -> DataFrame:
    """Each table of a form, where it is and the distinct hashes of its texts: how many, and the first LISTED_HASHES in order.

    Without cells, the tables have their texts (from_lines).
    """
    rows = tables.join(found.select("candidate_id", *FORM), FORM)
    if cells is None:
        rows = rows.withColumn("hashes", F.array_sort(F.transform("texts", text_hash)))
    else:
        hashes = cells.where("text <> ''").groupBy("doc_id", "table_id").agg(F.array_sort(F.collect_set(text_hash(F.col("text")))).alias("hashes"))
        rows = rows.join(hashes, ["doc_id", "table_id"], "left")
    n = F.coalesce(F.size("hashes"), F.lit(0))
    return rows.select(
        "candidate_id", "section", "object_id", "doc_id", "org", "table_id", "layout", "content", "rows", "cols", "cells", n.alias("hash_count"),
        F.coalesce(F.array_join(F.slice("hashes", 1, LISTED_HASHES), "|"), F.lit("")).alias("cell_hashes"), (n > LISTED_HASHES).alias("hashes_truncated"),
        F.concat_ws(":", "object_id", F.col("doc_id").cast("string"), F.lit("table"), F.col("table_id").cast("string")).alias("location_key"),
    )


def coverage(documents: DataFrame, tables: DataFrame, found: DataFrame, statuses: Iterable[str] = ("candidate",)) -> DataFrame:
    """Per document: its tables, those that forms of ``statuses`` match, meaningful or trivial ones, expected and foreign ones.

    A match is expected where the form is common to organisations or led by the document's own, foreign where another
    leads it; a document of no known organisation expects nothing and has nothing foreign. The residual is what no
    meaningful form matches. Ratios over nothing are 0; a document without tables is no_tables.
    """
    used = found.where(F.col("candidate_status").isin(*statuses)).select(*FORM, "candidate_id", "candidate_class", "org_class", "dominant_org", "triviality_status", "candidate_status")
    # by document and form first: a document's tables of one form are one row from here on
    rows = tables.where("layout <> ''").groupBy("doc_id", *FORM).agg(F.count("*").alias("n")).join(used, FORM, "left")
    rows = rows.join(documents.select("doc_id", "org"), "doc_id")
    matched, known = F.col("candidate_id").isNotNull(), F.coalesce(~F.col("org").isin(*_NO_ORG), F.lit(False))
    common, own = F.col("org_class") == "cross_org_common", F.col("dominant_org") == F.col("org")
    meaningful = matched & (F.col("triviality_status") != "trivial_micro_form")
    tests = {
        "matched": matched, "meaningful": meaningful, "trivial": matched & ~meaningful, "expected": matched & known & (common | own), "foreign": matched & known & ~common & ~own,
        "borrowing": F.col("candidate_class") == "borrowing_candidate", "typical": F.col("candidate_class") == "typical_form", "common": common,
        "distinctive": F.col("org_class") == "org_distinctive", "specific": F.col("org_class") == "org_specific",
    }
    by_id = rows.where(matched).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("candidate_id")))
    by_id = by_id.withColumn("top", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "candidate_id")))
    named = lambda where, order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, F.struct(order, "candidate_id", "n")))), text), "|")
    ids = by_id.where(f"place <= {LISTED_IDS} or top <= {TOP_IDS}").groupBy("doc_id").agg(
        named(F.col("place") <= LISTED_IDS, "place", lambda x: x["candidate_id"]).alias("candidate_ids"),
        named(F.col("top") <= TOP_IDS, "top", lambda x: F.concat_ws(":", x["candidate_id"], x["n"].cast("string"))).alias("top_candidates"),
    )
    status = rows.where(matched).groupBy("doc_id", "candidate_status").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("candidate_status", "n"))), lambda x: F.concat_ws(":", x["candidate_status"], x["n"].cast("string"))), "|").alias("status_counts")
    )
    out = rows.groupBy("doc_id").agg(
        F.sum("n").alias("tables"), *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in tests.items()],
        F.count(F.when(matched, 1)).alias("forms"), F.count(F.when(meaningful, 1)).alias("meaningful_forms"),
    )
    out = documents.where("section <> 'UNKNOWN'").select("doc_id", "section", "object_id", "org").join(out, "doc_id", "left").na.fill(0, ["tables", *tests, "forms", "meaningful_forms"])
    out = out.join(ids, "doc_id", "left").join(status, "doc_id", "left").na.fill("", ["candidate_ids", "top_candidates", "status_counts"])
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, F.col(b)), F.lit(0.0)) + 1e-9, 4)
    residual = F.col("tables") - F.col("meaningful")
    return out.withColumns(
        {
            "coverage_ratio": ratio(F.col("meaningful"), "tables"), "residual": residual, "residual_ratio": ratio(residual, "tables"), "conformance_ratio": ratio(F.col("expected"), "matched"),
            "foreign_ratio": ratio(F.col("foreign"), "matched"), "ids_truncated": F.col("forms") > LISTED_IDS, "coverage_status": F.when(F.col("tables") == 0, "no_tables").otherwise("measured"),
        }
    )
