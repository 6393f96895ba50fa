"""Readers of export bundles: one directory <root>/<object_id>/<bundle_id>/ of CSV files, with declared schemas.

All files of a kind are one table with object_id and bundle_id from the path. Fields keep the declared type; numbers
that don't parse are null and it is up to the operator to take them for 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "document_id string, file_name string, file_path string, file_crc32 string, file_size_bytes bigint, page_count bigint, pdf_version string, has_native_layers string, has_text_layer string, has_images string, has_tables string, parse_status string, parsed_at string",
    "pages": "page_id string, page_number int, page_width double, page_height double, rotation int, element_count bigint, text_count bigint, line_count bigint, frame_count bigint, image_count bigint, table_count bigint",
    "elements": "group_id string, subtype_id string, encoding_status string, is_visible boolean",
    "group_summary": "page_id string, page_number int, group_id string, element_count bigint, bbox_area_total double, line_length_total double, table_count bigint, cell_count bigint, broken_encoding_count bigint",
    "tables": "table_id string, page_number int, row_count int, column_count int, cell_count int, text_element_count int, line_element_count int, frame_element_count int, width double, height double, bbox_area double",
    "table_cells": "table_id string, cell_id string, page_id string, page_number int, row_index int, column_index int, row_span int, column_span int, text_value string, encoding_status string, child_element_count int",
    "text_segments": "text_segment_id string, element_id string, page_id string, page_number int, text_value string, normalized_text string, char_count int, word_count int, language_code string, encoding_status string, x1 double, y1 double, x2 double, y2 double",
    "page_summary": "page_id string, element_count bigint, text_count bigint, line_count bigint, frame_count bigint, image_count bigint, other_vector_count bigint, table_count bigint, table_cell_count bigint",
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, in whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found is not None and len(found))


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", comment: str | None = None) -> DataFrame:
    """CSV files with headers: quoted newlines and doubled quotes are part of a field, a byte order mark is not.

    Columns go by name, file by file: files of a glob may have other columns, or the same in another order; what is
    absent is null. Files of one header are read together.
    """
    kinds = dict(part.split() for part in schema.split(","))
    options = {"header": True, "multiLine": True, "escape": '"', "sep": sep, "enforceSchema": False, "mode": "PERMISSIVE"}
    if comment:
        options |= {"comment": comment}
    out = None
    for header, files in _headers(spark, path, sep, comment).items():
        strings = ", ".join(f"`{n}` string" for n in header)
        rows = spark.read.options(**options).schema(strings).csv(files)
        typed = [(F.col(f"`{n}`").try_cast(kind) if n in header else F.lit(None).cast(kind)).alias(n) for n, kind in kinds.items()]
        part = rows.select(*typed, F.input_file_name().alias("_file"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema).withColumn("_file", F.lit(None).cast("string")) if out is None else out


def _headers(spark: SparkSession, path: str, sep: str, comment: str | None) -> dict[tuple[str, ...], list[str]]:
    """The files under a path by their header, a row a file; files without a line are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    lines = lines.where("trim(value) <> ''")
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    out: dict[tuple[str, ...], list[str]] = {}
    for row in lines.groupBy("file").agg(F.min_by("value", "place").alias("first")).orderBy("file").collect():
        names = tuple(n.strip().strip('"') for n in row["first"].lstrip("\ufeff").split(sep))
        out.setdefault(names, []).append(row["file"])
    return out


#: Characters that a separator is judged by.
SAMPLE = 4096


def sniffed(spark: SparkSession, path: str) -> str:
    """The separator of a CSV file: whichever of comma and semicolon splits the most of the lines of its first SAMPLE characters
    into the same number of fields, more than one; a comma where neither does."""
    sample = "\n".join(r["value"] for r in spark.read.text(path).limit(SAMPLE // 8).collect())[:SAMPLE]
    lines = [line for line in sample.split("\n") if line.strip()]
    first = lines[0] if lines else ""
    agree = {sep: sum(line.count(sep) == first.count(sep) for line in lines) * (first.count(sep) > 0) for sep in (",", ";")}
    return ";" if (agree[";"], first.count(";")) > (agree[","], first.count(",")) else ","


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_csv(), or an empty table of the schema where there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("_file", F.lit(None).cast("string"))
    return read_csv(spark, path, schema)


def read_bundles(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All bundles' files of a kind, with object_id and bundle_id; only bundles that hold documents.csv count."""
    rows = read_optional(spark, f"{root}/*/*/{kind}.csv", SCHEMAS[kind])
    path = lambda k: F.regexp_extract("_file", r"/([^/]+)/([^/]+)/[^/]+\.csv$", k)
    rows = rows.withColumns({"object_id": path(1), "bundle_id": path(2)})
    if kind != "documents":
        complete = read_optional(spark, f"{root}/*/*/documents.csv", SCHEMAS["documents"]).select(path(1).alias("object_id"), path(2).alias("bundle_id")).distinct()
        rows = rows.join(complete, ["object_id", "bundle_id"], "left_semi")
    return rows.drop("_file")


def read_first_root(spark: SparkSession, roots: list[str], kind: str) -> DataFrame:
    """Bundles of several roots; where two roots hold the same bundle, the first one's files."""
    parts = [read_bundles(spark, root, kind).withColumn("_root", F.lit(k)) for k, root in enumerate(roots)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    first = F.min("_root").over(Window.partitionBy("object_id", "bundle_id"))
    return rows.withColumn("_first", first).where("_root = _first").drop("_root", "_first")


def read_anywhere(spark: SparkSession, roots: list[str], kind: str) -> DataFrame:
    """read_first_root(), and bundles that lie deeper below a root where none holds them directly: the first root's, then the first path's."""
    direct = read_first_root(spark, roots, kind)
    deep = None
    for k, root in enumerate(roots):
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{kind}.csv").format("binaryFile").load(root).select("path")
        paths = [r["path"] for r in files.collect()]  # a row a file
        if paths:
            rows = read_csv(spark, paths, SCHEMAS[kind]).withColumn("_root", F.lit(k))
            deep = rows if deep is None else deep.unionByName(rows)
    if deep is None:
        return direct
    part = lambda k: F.regexp_extract("_file", r"/([^/]+)/([^/]+)/[^/]+\.csv$", k)
    deep = deep.withColumns({"object_id": part(1), "bundle_id": part(2), "_place": F.struct("_root", "_file")})
    deep = deep.join(direct.select("object_id", "bundle_id").distinct(), ["object_id", "bundle_id"], "left_anti")
    first = F.min("_place").over(Window.partitionBy("object_id", "bundle_id"))
    deep = deep.withColumn("_first", first).where("_place = _first")
    return direct.unionByName(deep.select(*direct.columns))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, one a file (pair details, anchors, plans), with the declared schema or the one they have."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def in_range(rows: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows whose name begins with a number between low and high."""
    number = F.regexp_extract(column, r"^(\d+)", 1).try_cast("int")
    return rows.where(number.between(low, high))


def require_single_cohort(objects: DataFrame) -> DataFrame:
    """object_id and cohort, failing when an object belongs to two cohorts."""
    counted = objects.groupBy("object_id").agg(F.min("cohort").alias("cohort"), F.countDistinct("cohort").alias("n"))
    return counted.where(F.assert_true(F.col("n") == 1, "an object belongs to two cohorts").isNull()).select("object_id", "cohort")


def bundle_entities(segments: DataFrame, cells: DataFrame, docs: DataFrame) -> DataFrame:
    """Entity multisets of bundles: segments, their word shingles, and table cells (docs: object_id, bundle_id, section)."""
    from ..functions.text import normalize_text, text_hash
    from ..operators.entities import text_entities

    key = [F.concat_ws("/", "object_id", "bundle_id").alias("doc_id")]
    text = F.coalesce(F.nullif(F.col("normalized_text"), F.lit("")), F.col("text_value"), F.lit(""))
    segs = segments.join(docs, ["object_id", "bundle_id"]).select(*key, "section", "object_id", F.lit(0).alias("seg_no"), text.alias("text"))
    own = cells.join(docs, ["object_id", "bundle_id"]).select(*key, "section", "object_id", normalize_text(F.coalesce("text_value", F.lit(""))).alias("v"))
    own = own.where("v <> ''").groupBy("doc_id", "section", "object_id", F.lit("table_cell_text").alias("entity_kind"), text_hash(F.col("v")).alias("entity_hash"))
    return text_entities(segs).unionByName(own.agg(F.count("*").alias("n")))
