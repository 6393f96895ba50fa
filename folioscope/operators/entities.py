"""Entity multisets: documents as counted hashes of segments, shingles and signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalize_text, text_hash, tokens, word_shingles


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, section, object_id (and org, where there is one), seg_no, text: the lines of each document."""
    more = ["org"] if "org" in docs.columns else []
    return docs.select("doc_id", "section", "object_id", *more, F.posexplode(F.split("text", "\n")).alias("seg_no", "text"))


def normalized_segments(segs: DataFrame) -> DataFrame:
    """Segments with ``normalized`` in place of text, without empty ones."""
    # by the text itself: a condition on the normalized one would make it twice
    return segs.where(~is_blank(F.col("text"))).withColumn("normalized", normalize_text(F.col("text"))).drop("text")


#: Words of a shingle.
SHINGLE = 5


def text_places(segs: DataFrame) -> DataFrame:
    """The columns of segs with entity_kind, value and words: a row for each segment and for each place of a word shingle inside it.

    One explode of the places' numbers gives both kinds; a shingle is put together behind it, where the engine compiles it.
    """
    rows = normalized_segments(segs).withColumn("words", tokens(F.col("normalized")))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - SHINGLE, F.lit(-1)))))
    own = F.col("at") < 0
    kind = F.when(own, "text_segment").otherwise("text_word_shingle")
    value = F.when(own, F.col("normalized")).otherwise(F.concat_ws(" ", *[F.get("words", F.col("at") + k) for k in range(SHINGLE)]))
    return rows.withColumns({"entity_kind": kind, "value": value}).drop("at", "normalized")


def text_entities(segs: DataFrame, hashed: Callable[[Column], Column] = text_hash, among: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, section, object_id, entity_kind, entity_hash, n of segments and of the word shingles inside them.

    ``hashed`` is the hash that stands for a text: SHA-1 in hex, or a 64-bit one where it doesn't leave the engine.
    ``among`` leaves out rows (entity_kind, entity_hash and others) before they are counted.
    """
    rows = text_places(segs).select("doc_id", "section", "object_id", "entity_kind", hashed(F.col("value")).alias("entity_hash"))
    return _counted(among(rows) if among else rows)


def measured_entities(segs: DataFrame, hashed: Callable[[Column], Column] = text_hash) -> DataFrame:
    """text_entities() with org (a column of segs), tokens and chars: the words and the length of what the hash stands for."""
    who = ["doc_id", "section", "object_id", "org"]
    words = F.when(F.col("entity_kind") == "text_segment", F.size("words")).otherwise(SHINGLE)
    rows = text_places(segs).select(*who, "entity_kind", hashed(F.col("value")).alias("entity_hash"), words.alias("tokens"), F.length("value").alias("chars"))
    return rows.groupBy(*who, "entity_kind", "entity_hash").agg(F.count("*").alias("n"), F.max("tokens").alias("tokens"), F.max("chars").alias("chars"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "section", "object_id", "entity_kind", "entity_hash").agg(F.count("*").alias("n"))


def table_lines(segs: DataFrame) -> DataFrame:
    """The segments with a bar in them: doc_id, section, object_id, seg_no, table_no (consecutive ones are one table), cells."""
    lines = segs.where(F.contains("text", F.lit("|")))
    run = F.col("seg_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("seg_no"))
    return lines.withColumns({"table_no": run, "cells": F.transform(F.split("text", r"\|"), normalize_text)}).drop("text")


def table_entities(segs: DataFrame, hashed: Callable[[Column], Column] = text_hash) -> DataFrame:
    """Entities of the tables in a document's lines: the texts of cells, the layout and the content of each table."""
    lines = table_lines(segs)
    who = ["doc_id", "section", "object_id"]
    kind = lambda name: F.lit(name).alias("entity_kind")
    cells = lines.select(*who, F.explode("cells").alias("v")).where("v <> ''").select(*who, kind("table_cell_text"), hashed(F.col("v")).alias("entity_hash"))
    tables = lines.groupBy(*who, "table_no").agg(F.array_sort(F.collect_list(F.struct("seg_no", "cells")))["cells"].alias("rows"))
    wide = F.array_max(F.transform("rows", F.size))
    many = F.aggregate(F.transform("rows", F.size), F.lit(0), lambda a, x: a + x)
    layout = F.concat_ws("|", F.concat(F.lit("rows:"), F.size("rows")), F.concat(F.lit("cols:"), wide), F.concat(F.lit("cells:"), many))
    placed = F.flatten(F.transform("rows", lambda row, r: F.transform(row, lambda t, c: F.struct(r.alias("r"), c.alias("c"), t.alias("t")))))
    layouts = tables.select(*who, kind("table_layout_signature"), hashed(layout).alias("entity_hash"))
    contents = tables.select(*who, kind("table_content_signature"), hashed(cell_lines(placed)).alias("entity_hash"))
    return _counted(cells.unionByName(layouts).unionByName(contents))


#: Lines of a page, where a document has no pages of its own.
PAGE_LINES = 20


def page_entities(segs: DataFrame, hashed: Callable[[Column], Column] = text_hash) -> DataFrame:
    """The signature of each page of PAGE_LINES lines: how many lines, table lines and blank lines it has."""
    blank = is_blank(F.col("text"))
    pages = segs.groupBy("doc_id", "section", "object_id", F.floor(F.col("seg_no") / PAGE_LINES).alias("page")).agg(
        F.count("*").alias("lines"), F.count_if(F.contains("text", F.lit("|"))).alias("tables"), F.count_if(blank).alias("blank")
    )
    source = F.concat_ws("|", *[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in ("lines", "tables", "blank")])
    return _counted(pages.select("doc_id", "section", "object_id", F.lit("page_signature").alias("entity_kind"), hashed(source).alias("entity_hash")))


def document_shingles(docs: DataFrame, hashed: Callable[[Column], Column] = text_hash) -> DataFrame:
    """Entities of the word shingles of whole documents, across their lines."""
    # words are a column of their own: inside the shingles' lambda they would be made anew for each shingle
    rows = docs.select("doc_id", "section", "object_id", F.lit("document_word_shingle").alias("entity_kind"), tokens(normalize_text(F.col("text"))).alias("words"))
    rows = rows.select("doc_id", "section", "object_id", "entity_kind", F.explode(word_shingles(F.col("words"), SHINGLE)).alias("s"))
    return _counted(rows.select("doc_id", "section", "object_id", "entity_kind", hashed(F.col("s")).alias("entity_hash")))


def page_signature_source(width: Column, height: Column, rotation: Column, counts: dict[str, Column], groups: Column) -> Column:
    """The canonical text of a page: its size, its counts, and its groups (an array of group:count:area:... texts), sorted."""
    rounded = [F.round(c, 1).cast("decimal(18,1)").cast("string") for c in (width, height)]
    size = F.concat(F.lit("size:"), rounded[0], F.lit("x"), rounded[1], F.lit("r"), rotation.cast("string"))
    parts = [F.concat(F.lit(f"{k}:"), c.cast("string")) for k, c in counts.items()]
    return F.concat_ws("|", size, *parts, F.concat(F.lit("groups:"), F.array_join(F.array_sort(groups), ";")))


def content_signature(cells: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-1 of a table's cells as row:col:text lines in order (columns row_index, column_index, text_value)."""
    cell = F.struct(
        F.col("row_index").alias("r"), F.col("column_index").alias("c"), F.lower(F.trim(F.coalesce("text_value", F.lit("")))).alias("t")
    )
    return cells.groupBy(*keys).agg(cells_hash(F.collect_list(cell)).alias("content_sha1"))


def cell_lines(cells: Column) -> Column:
    """An array of cells (r, c, t) as row:col:text lines in order."""
    line = lambda x: F.concat_ws(":", x["r"].cast("string"), x["c"].cast("string"), x["t"])
    return F.array_join(F.transform(F.array_sort(cells), line), "\n")


def cells_hash(cells: Column) -> Column:
    """SHA-1 of an array of cells (r, c, t) as row:col:text lines in order."""
    return text_hash(cell_lines(cells))


def text_cells(text: Column) -> Column:
    """The words of a text's lines as an array of cells (r, c, t)."""
    cell = lambda r: lambda w, c: F.struct(r.alias("r"), c.alias("c"), F.lower(F.trim(w)).alias("t"))
    return F.flatten(F.transform(F.split(text, "\n"), lambda line, r: F.transform(F.split(line, " "), cell(r))))


def repeated_signatures(rows: DataFrame, least: int = 2) -> DataFrame:
    """Signatures that occur ``least`` times or more (columns signature_type, signature, doc_id, object_id, section)."""
    return (
        rows.groupBy("signature_type", "signature")
        .agg(
            F.count("*").alias("occurrence_count"),
            F.countDistinct("doc_id").alias("document_count"),
            F.countDistinct("object_id").alias("object_count"),
            F.array_join(F.array_sort(F.collect_set("section")), "|").alias("sections"),
        )
        .where(F.col("occurrence_count") >= least)
    )
