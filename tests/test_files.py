"""Sources, sinks and streams over files made here."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from folioscope.sources import bundle as B
from folioscope.sources import office as O
from folioscope.sources import sinks as K
from folioscope.streaming import events as S


def bundle(root, obj, name, files):
    folder = root / obj / name
    folder.mkdir(parents=True)
    for kind, text in files.items():
        (folder / f"{kind}.csv").write_text(text, encoding="utf-8")


def test_bundles(spark, tmp_path):
    segs = '﻿text_segment_id,text_value,normalized_text,page_number,extra\ns1,"a ""b""\nc",,x,9\n'
    bundle(tmp_path, "0001_20", "doc_a", {"documents": "document_id,file_name\nd1,f.pdf\n", "text_segments": segs})
    bundle(tmp_path, "0002_20", "doc_b", {"text_segments": segs})
    rows = B.read_bundles(spark, str(tmp_path), "text_segments").collect()
    assert [(r["object_id"], r["bundle_id"], r["text_value"], r["page_number"], r["x1"]) for r in rows] == [("0001_20", "doc_a", 'a "b"\nc', None, None)]
    assert B.read_bundles(spark, str(tmp_path), "tables").count() == 0
    other = tmp_path / "second"
    bundle(other, "0001_20", "doc_a", {"documents": "document_id,file_name\nd1,other.pdf\n"})
    first = B.read_first_root(spark, [str(tmp_path), str(other)], "documents").select("file_name").collect()
    assert [r[0] for r in first] == ["f.pdf"]
    assert B.in_range(B.read_bundles(spark, str(tmp_path), "documents"), "object_id", 2, 9).count() == 0


def test_columns_go_by_name_in_every_file(spark, tmp_path):
    """Files of one glob with other columns, or the same in another order."""
    bundle(tmp_path, "0001_20", "a", {"documents": "document_id,page_count,file_name\nd1,3,f.pdf\n"})
    bundle(tmp_path, "0002_20", "b", {"documents": "file_name,document_id\ng.pdf,d2\n"})
    bundle(tmp_path, "0003_20", "c", {"documents": "page_count,document_id,file_name\n5,d3,h.pdf\n"})
    bundle(tmp_path, "0004_20", "d", {"documents": ""})
    rows = B.read_bundles(spark, str(tmp_path), "documents").select("object_id", "document_id", "file_name", "page_count").collect()
    assert sorted(map(tuple, rows)) == [("0001_20", "d1", "f.pdf", 3), ("0002_20", "d2", "g.pdf", None), ("0003_20", "d3", "h.pdf", 5)]


def test_bundles_below_a_root(spark, tmp_path):
    page = "page_id,page_number\n{},1\n"
    bundle(tmp_path / "r1", "o1", "a", {"documents": "document_id\nd\n", "pages": page.format("direct")})
    bundle(tmp_path / "r2" / "deep" / "er", "o2", "b", {"pages": page.format("deep")})
    bundle(tmp_path / "r2" / "deep", "o1", "a", {"pages": page.format("hidden")})
    rows = B.read_anywhere(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")], "pages").select("object_id", "page_id").collect()
    assert sorted(map(tuple, rows)) == [("o1", "direct"), ("o2", "deep")]


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "pair_id": "p",\n "axes": [{"k": 1}]\n}', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"pair_id": "q", "axes": []}', encoding="utf-8")
    rows = B.read_json(spark, str(tmp_path), "pair_id string, axes array<struct<k:int>>").collect()
    assert sorted((r["pair_id"], [x["k"] for x in r["axes"]]) for r in rows) == [("p", [1]), ("q", [])]


def test_separators_and_comments(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# note\na;b\n1;2,5\n\n# x\n3;y\n", encoding="utf-8")
    rows = B.read_csv(spark, str(tmp_path / "t.csv"), "a int, b string", ";", "#").select("a", "b").collect()
    assert [tuple(r) for r in rows] == [(1, "2,5"), (3, "y")]
    (tmp_path / "s.csv").write_text("a;b;c\n1,5;2;3\n", encoding="utf-8")
    assert B.sniffed(spark, str(tmp_path / "s.csv")) == ";"
    (tmp_path / "u.csv").write_text("a;b,c;d\n1;2;3\n4;5;6\n", encoding="utf-8")
    assert B.sniffed(spark, str(tmp_path / "u.csv")) == ";"


def test_spreadsheets(spark, tmp_path):
    df = spark.createDataFrame([("a & b", 1), (None, 2)], "x string, n int")
    O.write_spreadsheet(df, str(tmp_path / "t.xlsx"))
    spark.dataSource.register(O.SpreadsheetSource)
    rows = spark.read.format("folioscope_xlsx").option("path", str(tmp_path / "t.xlsx")).load()
    assert rows.columns == ["x", "n"] and sorted(map(tuple, rows.collect())) == [("", "2"), ("a & b", "1")]


def test_spreadsheets_under_a_folder(spark, tmp_path):
    O.write_spreadsheet(spark.createDataFrame([("note", "")], "a string, b string"), str(tmp_path / "a.xlsx"))
    O.write_spreadsheet(spark.createDataFrame([("  Number", "YEAR "), ("7", "2020"), ("8", "")], "title string, x string"), str(tmp_path / "b.xlsx"))
    (tmp_path / "c.xlsx").write_bytes(b"no archive")
    rows = O.with_header(O.read_spreadsheets(spark, str(tmp_path)), ["year", "number"]).orderBy("row_no").collect()
    assert [(r["number"], r["year"]) for r in rows] == [("7", "2020"), ("8", "")]
    assert [O._column(x) for x in ("A", "Z", "AA", "AZ", "BA", "ZZ", "AAA")] == [0, 25, 26, 51, 52, 701, 702]


def test_units(spark, tmp_path):
    unit = '<xs:enumeration value="{0}"><xs:annotation><xs:documentation id="Name">{1}</xs:documentation><xs:documentation xml:id="Symbol">{2}</xs:documentation></xs:annotation></xs:enumeration>'
    kind = lambda name, *units: f'<xs:simpleType name="{name}"><xs:restriction>{"".join(unit.format(*u) for u in units)}</xs:restriction></xs:simpleType>'
    body = kind("tUnit", ("006", "metre", "m"), ("055", "square metre", "m2")) + kind("other", ("1", "x", "x"))
    (tmp_path / "u.xsd").write_text(f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">{body}</xs:schema>', encoding="utf-8")
    assert sorted(map(tuple, O.read_units(spark, str(tmp_path / "u.xsd"), "tUnit").collect())) == [("006", "metre", "m"), ("055", "square metre", "m2")]


def test_text_document_tables(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    row = lambda *ts: "<w:tr>" + "".join(map(cell, ts)) + "</w:tr>"
    table = "<w:tbl>" + row("no", "Remark text") + row("1", "first") + row("2", "second") + row("3", "") + row("4") + "</w:tbl>"
    table += "<w:tbl>" + row("remark", "x") + row("only", "y") + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{table}</w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no archive")
    rows = O.read_table_columns(spark, str(tmp_path), "remark").orderBy("place").collect()
    assert [r["text"] for r in rows] == ["first", "second"]


def test_attributes_and_checksums(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><TEI><name>h</name><value>1.5</value></TEI><TEI><name>w</name></TEI></r>", encoding="utf-8")
    rows = O.read_attributes(spark, str(tmp_path / "a.xml"), "TEI", "name string, value double").collect()
    assert sorted((r["name"], r["value"]) for r in rows if r["name"] == "h") == [("h", 1.5)] and len(rows) == 2
    (tmp_path / "f.bin").write_bytes(b"123456789")
    assert [r["crc32"] for r in O.file_checksums(spark, str(tmp_path), "*.bin").collect()] == ["cbf43926"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("o", "b", ["x", "y"], {"k": 1}), ("p", "c", [], {})], "object_id string, bundle_id string, xs array<string>, m map<string,int>")
    K.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).where("object_id = 'o'").first()
    assert (back["xs"], back["m"]) == ("x|y", "k:1")
    K.write_object_view(df.select("object_id", "bundle_id", "xs"), str(tmp_path / "view"))
    assert (tmp_path / "view/object_id=o/bundle_id=b").is_dir()
    K.write_csv(df, str(tmp_path / "marked"), ["object_id"], mark=True)
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbfobject_id") for f in (tmp_path / "marked").glob("part-*.csv") if f.stat().st_size)
    axes = spark.createDataFrame([("p", "b", 0.5), ("p", "a", 0.25), ("q", "a", 1.0)], "pair_id string, entity_kind string, value double")
    K.write_details(axes, str(tmp_path / "details"), ["pair_id"])
    assert {r["pair_id"]: [x["entity_kind"] for x in r["axes"]] for r in spark.read.json(str(tmp_path / "details")).collect()} == {"p": ["a", "b"], "q": ["a"]}
    K.write_json_lines(df, str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 2
    assert K.write_summary(df.agg(F.count("*").alias("n")), str(tmp_path / "s.json")) == json.loads((tmp_path / "s.json").read_text()) == {"n": 2}


def test_stream_resumes(spark, tmp_path):
    rows = spark.sql("select id event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) ts, id % 2 user_id, 'x' event_type, 1.0D value, '{}' props from range(48)")
    rows.where("event_id < 24").write.parquet(str(tmp_path / "in"))
    args = str(tmp_path / "out"), str(tmp_path / "state")
    S.into_table(S.windowed_counts(S.read_events(spark, str(tmp_path / "in"))), *args).awaitTermination()
    rows.where("event_id >= 24").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    S.into_table(S.windowed_counts(S.read_events(spark, str(tmp_path / "in"))), *args).awaitTermination()
    assert [r["events"] for r in spark.read.parquet(args[0]).collect()] == [24]
