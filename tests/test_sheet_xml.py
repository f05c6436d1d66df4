"""Rows of sheets read many at a time: what they give is what the XML parser gives."""

import io
import xml.etree.ElementTree as ET

import pytest

from tallyspark.plans import fixtures as X
from tallyspark.sinks.workbooks import workbook_bytes
from tallyspark.sources import sheet_xml as SX
from tallyspark.sources import xlsx as XS

SHARED = ["共享", "b & c"]
HEAD = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:x14ac="u">'
        '<cols><col min="1" max="2"/></cols><sheetData>')
TAIL = '</sheetData><mergeCells><mergeCell ref="A1"/></mergeCells></worksheet>'
USUAL = ('<row r="3" spans="1:3" x14ac:dyDescent="0.25"><c r="A3" s="1" t="s"><v>0</v></c><c r="B3"/><c r="AB3" t="str"><f>A1+1</f><v>a&lt;b</v></c></row>',
         '<row r="4"><c r="B4" t="b"><v>1</v></c><c r="C4"><v>-2E-5</v></c><c r="D4"><v></v></c><c r="E4"><f>A1</f></c></row>', '<row r="5" ht="15"/>',
         '<row r="6"><c r="A6" t="inlineStr"><is><t xml:space="preserve"> é\n&amp;lt; </t></is></c><c r="A6" t="s"><v>1</v></c><c r="B6" t="e"><v>#REF!</v></c></row>')
OTHER = ('<row r="7"><c r="A7" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>', '<row r="8"><!-- </row> --><c r="B8"><v>1</v></c></row>',
         '<row r="9"><c r="B9" t="str"><v><![CDATA[x</row>y]]></v></c></row>', '<row r="10"><c r="B10" t="str"><v>a\rb&#65;</v></c></row>',
         '<row><c s="2" r="c11"><v>7</v></c></row>', '<row r="12"><c r="A12"><f t="shared" si="0"/><v>a>b</v></c></row>')
BROKEN = ('<row r="13"><c r="A13"><v>1</c></v></row>', '<row r="13"><c r="A13" r="A13"><v>1</v></c></row>', '<row r="13"><c r="A13"><v>&x;</v></c></row>',
          '<row r="13"><c r="A13" t="s"><v>9</v></c></row>', '<row r="13"><c r="A13"><v>\x01</v></c></row>', '<row r="13"><c r="A13"><v>1</v></c>')


def read(xml, first=1, last=None):
    return [(n, c) for nos, cells in SX.sheet_rows_of(lambda: io.BytesIO(xml.encode()), SHARED, first, last) for n, c in zip(nos.tolist(), cells.to_pylist())]


def parsed(xml, first=1, last=None):
    return [*SX._parsed_rows(io.BytesIO(xml.encode()), SHARED, first, last, [])]


def test_usual_rows_need_no_xml_parser(monkeypatch):
    wanted = parsed(HEAD + "".join(USUAL) + TAIL)
    assert wanted[-1] == (6, ["b & c", "#REF!"]) and wanted[0][1][0] == "共享" and wanted[0][1][27] == "a<b"
    book = workbook_bytes({s: [(i, [None, f"{s}&{i}", " <x>\n", ""]) for i in range(1, 500)] for s in ("1", "二")})

    def no(*a, **k):
        raise AssertionError("a row went through the XML parser")
    monkeypatch.setattr(ET, "iterparse", no)
    got = [*XS.parse_workbook(book)]
    assert got == [(s, k, i, [None, f"{s}&{i}", " <x>\n", ""]) for k, s in enumerate(("1", "二")) for i in range(1, 500)]
    assert read(HEAD + "".join(USUAL) + TAIL) == wanted


@pytest.mark.parametrize("chunk", [120, 300, 1 << 20])
def test_other_rows_and_errors_are_the_parsers(monkeypatch, chunk):
    monkeypatch.setattr(SX, "CHUNK_BYTES", max(chunk, len(HEAD) + 20))
    for other in ("", *OTHER, "".join(OTHER)):
        xml = HEAD + "".join(USUAL) + other + USUAL[1].replace('4"', '14"') + TAIL
        for first, last in ((1, None), (4, None), (1, 6), (5, 12)):
            assert read(xml, first, last) == parsed(xml, first, last)
    for bad in BROKEN:
        xml = HEAD + "".join(USUAL) + bad + TAIL
        errors = []
        for f in (read, parsed):
            with pytest.raises(Exception) as e:
                f(xml)
            errors.append(f"{type(e.value).__name__}: {e.value}")
        assert errors[0] == errors[1]
        assert read(xml, 4, 5) == parsed(xml, 4, 5)


def test_papers_of_all_sheets_take_one_join_for_their_rows(spark, scratch):
    n = spark.range(300)
    n.selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "CAST(id AS DOUBLE) AS o_totalprice", "'O' AS o_orderstatus", "IF(id % 9 = 0, NULL, 'p') AS o_orderpriority").write.parquet(
        f"{scratch}/orders.parquet")
    n.where("id < 9").selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "IF(id = 2, NULL, id % 3) AS c_nationkey", "CAST(id AS DOUBLE) AS c_acctbal").write.parquet(
        f"{scratch}/customer.parquet")
    papers, rows = X.counterparty_papers(spark, scratch), X.counterparty_rows(spark, scratch)
    assert papers.schema == rows.schema and papers.count() == rows.count() > 1800
    assert papers.exceptAll(rows).count() == 0
    assert papers._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2  # of the orders and of the banners' files
