"""Workbooks as a source and a sink."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import excel, io

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, *sheets, strings="", since_1904=False, names=("First", "Second & last", "Third")):
    """Write a workbook as a spreadsheet program would: shared strings, styles, gaps."""
    listed = "".join(f'<sheet name="{n.replace("&", "&amp;")}" sheetId="{i + 7}" r:id="rId{i}"/>' for i, n in enumerate(names[: len(sheets)]))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook {MAIN} xmlns:r="{LINK}"><workbookPr date1904="{int(since_1904)}"/><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", f'{HEAD}<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="[$-409]d\\-mmm\\-yy;@"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/></numFmts>'
            '<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="21"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs></styleSheet>')  # fmt: skip
        if strings:
            z.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {MAIN}>{strings}</sst>")
        for i, rows in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f'{HEAD}<worksheet {MAIN}><dimension ref="A1"/><sheetData>{rows}</sheetData><mergeCells/></worksheet>')
    return str(path)


STRINGS = "<si><t>name</t></si><si><t>day</t></si><si><r><t>rich </t></r><r><rPr/><t xml:space='preserve'>text </t></r><rPh><t>reading</t></rPh></si><si><t>日本 &amp; co</t></si><si><t>NA</t></si><si><t>mixed</t></si><si/>"
ROWS = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>0</v></c><c r="D1"><v>2024</v></c><c r="F1" t="s"><v>5</v></c></row>
<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" s="1"><v>45292</v></c><c r="C2"><v>1</v></c><c r="D2"><v>0.5</v></c><c r="E2" t="b"><v>1</v></c><c r="F2" t="s"><v>3</v></c><c r="G2" s="3"><v>0.75</v></c></row>
<row r="4"><c r="A4" t="s"><v>3</v></c><c r="B4" s="2"><v>59.5</v></c><c r="C4"/><c r="D4" t="e"><v>#DIV/0!</v></c><c r="E4" t="b"><v>0</v></c><c r="F4"><v>7</v></c><c r="G4" s="3"><v>1.5</v></c></row>
<row r="5"><c t="inlineStr"><is><t>in line</t></is></c><c s="5"><v>60.25</v></c><c s="4"><v>-3</v></c><c t="str"><f>A1</f><v></v></c><c/><c t="b"><v>1</v></c></row>
<row r="6"><c r="A6" t="s"><v>4</v></c><c r="B6" t="d"><v>2001-02-03T04:05:06</v></c></row><row r="7"><c r="A7" s="1"/></row>"""


def test_a_workbook_reads_as_a_table(spark, tmp_path):
    path = workbook(tmp_path / "a.xlsx", ROWS, '<row r="3"><c r="B3" t="inlineStr"><is><t>x</t></is></c></row><row r="4"><c r="B4"><v>1e3</v></c></row>', strings=STRINGS)
    df = excel.read_excel(spark, path)
    assert dict(df.dtypes) == {"name": "string", "day": "timestamp", "name.1": "bigint", "2024": "double", "Unnamed: 4": "boolean", "mixed": "string", "Unnamed: 6": "string"}
    got = [tuple(r) for r in df.collect()]
    assert got == [
        ("rich text ", dt.datetime(2024, 1, 1), 1, 0.5, True, "日本 & co", "18:00:00"),
        (None,) * 7,
        ("日本 & co", dt.datetime(1900, 2, 28, 12), None, None, False, "7", "36:00:00"),
        ("in line", dt.datetime(1900, 2, 28, 6), -3, None, None, "True", None),
        (None, dt.datetime(2001, 2, 3, 4, 5, 6), None, None, None, None, None),
    ]
    second = excel.read_excel(spark, path, sheet="Second & last")
    assert second.columns == ["Unnamed: 0", "x"] and second.select("x").collect()[0][0] == 1000
    assert excel.read_excel(spark, path, sheet=1, header=False).columns == ["_c0", "_c1"]
    assert excel.read_excel(spark, path, sheet=2).columns == []


def test_days_since_1904(spark, tmp_path):
    path = workbook(tmp_path / "b.xlsx", '<row><c t="inlineStr"><is><t>d</t></is></c></row><row><c s="1"><v>1</v></c></row>', since_1904=True)
    assert excel.read_excel(spark, path).collect()[0][0] == dt.datetime(1904, 1, 2)


def test_a_folder_of_workbooks_is_one_table_with_a_partition_for_each_sheet(spark, tmp_path):
    rows = spark.range(0, 2500, 1, 3).select(
        "id", F.concat(F.lit("a<b>&\"' \r\n\t "), F.col("id").cast("string")).alias("text"), (F.col("id") / 7).alias("x"), (F.col("id") % 2 == 0).alias("even"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("some"), F.expr("date'2020-01-01' + cast(id as int)").alias("day"),
        F.expr("timestamp'2020-01-01 00:00:00.125' + make_interval(0, 0, 0, 0, 0, id)").alias("at"), F.array("id").alias("ids"), F.expr("cast(id as decimal(12, 2)) / 4").alias("price"),
    )
    path = str(tmp_path / "many.xlsx")
    assert io.export(rows, path, "xlsx") == 2500
    excel.write_excel(rows, path, sheet_rows=400)  # over the first ones
    raw = excel.register(spark).read.format(excel.FORMAT).load(path)
    assert raw.rdd.getNumPartitions() == 9 and len(excel.workbooks(path)) == 3
    back = excel.read_excel(spark, path, sheet=None)
    want = rows.withColumns({"some": F.col("some"), "day": F.col("day").cast("timestamp"), "ids": F.to_json("ids"), "price": F.col("price").cast("double")})
    assert dict(back.dtypes) == dict(want.dtypes)
    assert back.exceptAll(want.select(*back.columns)).count() == 0 and back.count() == 2500


def test_ingest_of_workbooks_and_what_is_none(spark, tmp_path):
    path = workbook(tmp_path / "c.xlsx", ROWS, strings=STRINGS)
    assert io.ingest(spark, path, str(tmp_path / "out")) == (5, 7)
    (tmp_path / "bad.xlsx").write_bytes(b"PK no")
    with pytest.raises(Exception, match="no .xlsx workbook"):
        excel.read_excel(spark, str(tmp_path / "bad.xlsx")).collect()
    with pytest.raises(io.IngestError, match="binary workbook"):
        io.ingest(spark, "old.xls", str(tmp_path / "out"))
    empty = spark.createDataFrame([], "a int, b string")
    excel.write_excel(empty, str(tmp_path / "empty.xlsx"))
    assert excel.read_excel(spark, str(tmp_path / "empty.xlsx")).columns == ["a", "b"]


def test_column_names_and_numbers():
    assert [excel.column_name(i) for i in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(excel.column_number(f"{excel.column_name(i)}12") == i for i in range(0, 16384, 37))


REGULAR = "".join(
    f'<row r="{i}" spans="1:4"><c r="A{i}" s="{i % 6}"><v>{i * 17 / 4}</v></c><c r="B{i}" t="inlineStr"><is><t xml:space="preserve">{"a &amp;&#13; é" if i % 3 else "NA"}</t></is></c>'
    f'<c r="D{i}" t="s"><v>{i % 6}</v></c><c r="AA{i}" t="b"><v>{i % 2}</v></c><c r="AB{i}" t="e"><v>#N/A</v></c><c r="AC{i}" t="str"><v>t{i}</v></c><c r="AD{i}" s="1"/></row>\n'
    for i in range(3, 300, 2)
)
ODD = """<row r="401"><c r="A401" t="inlineStr"><is><t><![CDATA[<row r="9"><c r="A9"/>]]></t></is></c><c r="C401"><f>1+1</f><v>2</v></c></row><!-- <row r="8"> &
--><row><c><v>5</v></c></row><row r="405"/><row r='410' ht="3"><c r='B410'><v>1e3</v></c></row><row><c t="inlineStr"><is><r><t>x</t></r><r><t>y\r\nz</t></r></is></c></row>"""


@pytest.mark.parametrize("rows", [REGULAR, ODD, REGULAR + ODD + REGULAR.replace("<row r=\"", "<row r=\"1"), "<row/><row><c><v>1</v></c></row>" * 40, ""])
def test_parts_of_a_sheet_are_the_sheet(tmp_path, monkeypatch, rows):
    path = workbook(tmp_path / "p.xlsx", rows, strings=STRINGS)
    (whole,) = excel.sheets(path)
    monkeypatch.setattr(excel, "_root", lambda head: None)  # all rows by the XML parser
    want = [r for b in excel.read_sheet(whole) for r in b.to_pylist()]
    monkeypatch.undo()
    assert [r for b in excel.read_sheet(whole) for r in b.to_pylist()] == want
    assert [r["top"] for r in want] == [True] * bool(want) + [False] * (len(want) - 1)
    for size in (150, 1000, 7000):
        monkeypatch.setattr(excel, "BLOCK_BYTES", max(size, 600))
        parts = [excel.replace(whole, start=k, end=k + size) for k in range(0, 200_000, size)]
        parts[-1] = excel.replace(parts[-1], end=None)
        assert [r for p in parts for b in excel.read_sheet(p) for r in b.to_pylist()] == want
        monkeypatch.undo()


def test_large_sheets_are_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 120_000, 1, 1).select("id", (F.col("id") / 7).alias("x"), F.concat(F.lit("<&>"), F.col("id") % 1000).alias("text"))
    path = str(tmp_path / "large.xlsx")
    io.export(rows, path, "xlsx")
    parts = excel.sheets(excel.workbooks(path)[0])
    monkeypatch.setattr(excel, "SPLIT_BYTES", 1 << 20)
    assert len(parts) == 1 and len(more := excel.sheets(excel.workbooks(path)[0])) == excel.SPLITS
    assert [r["row"] for p in more for b in excel.read_sheet(p) for r in b.select(["row"]).to_pylist()] == list(range(1, 120_002))
    back = excel.read_excel(spark, path)
    assert back.count() == 120_000 and back.exceptAll(rows).count() == 0
    with zipfile.ZipFile(tmp_path / "cut.xlsx", "w") as z, zipfile.ZipFile(excel.workbooks(path)[0]) as own:
        for name in own.namelist():
            z.writestr(name, own.read(name)[:-24] if "sheet1" in name else own.read(name))
    with pytest.raises(excel.WorkbookError, match="no end"):
        list(excel.read_sheet(excel.sheets(str(tmp_path / "cut.xlsx"))[-1]))


def test_whole_numbers_that_a_double_cant_hold_are_texts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1 << 53, None, -5), (None, 7, None, -(1 << 53) - 1), (-3, None, None, 2)], "a int, b bigint, c bigint, d bigint").coalesce(1)
    excel.write_excel(rows, str(tmp_path / "n.xlsx"))
    back = excel.read_excel(spark, str(tmp_path / "n.xlsx"))
    assert [tuple(r) for r in back.collect()] == [(1, str(1 << 53), None, "-5"), (None, "7", None, str(-(1 << 53) - 1)), (-3, None, None, "2")]


def test_rows_beyond_a_sheets_size_are_ingested_too(spark, tmp_path):
    path, out = str(tmp_path / "long.xlsx"), str(tmp_path / "out")
    rows = spark.range(0, 2500, 1, 3).select("id", F.concat(F.lit("t"), "id").alias("t"))
    excel.write_excel(rows, path, sheet_rows=400)
    assert io.ingest(spark, path, out) == (2500, 2)
    assert [r.id for r in excel.read_excel(spark, path).collect()] == list(range(2500))
    assert excel.read_excel(spark, path, sheet="Sheet3").count() == 35 + 35 + 36
