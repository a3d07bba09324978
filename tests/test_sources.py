"""Uploaded tables, exports, snapshots, and the streamed change log."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from typegrove import schema
from typegrove.operators.commit import Model
from typegrove.sources import export, tables, templates
from typegrove.sources.snapshots import Snapshots
from typegrove.streaming.changes import commit_stream, read_changes

from .test_operators import graph, log  # noqa: F401


def sheet(rows):
    """A workbook with one sheet of inline strings, numbers and booleans."""
    out = []
    for n, row in enumerate(rows, 1):
        cells = []
        for i, v in enumerate(row):
            ref = f"{chr(65 + i)}{n}"
            if isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
        out.append(f'<row r="{n}">{"".join(cells)}</row>')
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>')
    return f.getvalue()


@pytest.mark.parametrize(
    "name,data,want",
    [
        ("a.csv", b"\xef\xbb\xbfk,n\r\n1,\"a,\"\"b\"\"\nc\"\r\n\r\n2,\r\n", (["k", "n"], [(2, ["1", 'a,"b"\nc']), (4, ["2", None])])),
        ("a.CSV", b"\n,x,\n1\n", (["Column 1", "x"], [(3, ["1", None])])),
        ("a.xlsx", sheet([["k", "n", "b"], [1, "x", True], [None, None, None], [2.5, None, False]]), (["k", "n", "b"], [(2, ["1", "x", "true"]), (4, ["2.5", None, "false"])])),
    ],
)
def test_parse(name, data, want):
    assert tables.parse(name, data) == want


@pytest.mark.parametrize("name,data", [("a.csv", b"k\n\x00"), ("a.csv", b"k\n\xff"), ("a.csv", b"k\n1,2\n"), ("a.csv", b"k,k\n1,2\n"), ("a.csv", b"k\n"), ("a.csv", b""), ("a.xls", b"x"), ("a.xlsx", b"x"), ("a.csv", b'k\n"1\n'), ("a.csv", b"k\n" + b"1\n" * 2001)])
def test_parse_refuses(name, data):
    with pytest.raises(tables.TableError):
        tables.parse(name, data)


def test_read_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"k,n\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_bytes(b"k\n1,2\n")
    rows = tables.read_tables(spark, str(tmp_path / "*.csv"))
    assert sorted((r["row_number"], r["key"]) for r in tables.columns_of(rows, {"k": "key"}).collect()) == [(2, "1"), (3, "2")]
    assert rows.where("error is not null").count() == 1
    assert [r["cells"] for r in tables.preview(rows, 1, 1).collect()] == [["1", "x"]]


def test_exports(graph, spark, tmp_path):  # noqa: F811
    assert export.edges_with_keys(graph).where("id = 'r1'").first()["subject_key"] == "alice"
    lines = export.json_lines(graph)
    assert export.content_digest(lines) == export.content_digest(lines.repartition(7))
    assert export.content_digest(lines) != export.content_digest(export.json_lines(graph.with_(objects=graph.objects.where("id <> 'p1'"))))
    rows = export.template_rows(graph, "app", ["status"])
    export.write_template(rows, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 3
    first = Snapshots(spark, str(tmp_path / "p")).publish(graph, 1)
    assert Snapshots(spark, str(tmp_path / "p")).publish(graph, 1, first[1]) == (2, first[1])
    with pytest.raises(ValueError, match="preview"):
        Snapshots(spark, str(tmp_path / "p")).publish(graph, 1, "other")
    assert export.export_name("My Módel!", 3) == "my-model-r3.json"


def test_payload_problems(spark):
    nodes = spark.createDataFrame([("a",), ("a",), ("",), ("b",)], "id string")
    edges = spark.createDataFrame([("e", "a", "b"), ("f", "a", "zz")], "id string, source_id string, target_id string")
    assert sorted(tuple(r) for r in export.payload_problems(nodes, edges).collect()) == [("bad_node_id", ""), ("bad_node_id", "a"), ("dangling_edge", "f")]


def test_stream_commits_batches(graph, spark, tmp_path):  # noqa: F811
    model = Model(spark, str(tmp_path / "model"))
    model.create(graph.with_(rules=graph.rules.where("id = 'm'"), relationships=graph.relationships.where("type_id = 'member'")))
    path = str(tmp_path / "log")
    for name, after in (("x", '{"field": "name", "value": "Streamed"}'), ("y", '{"field": "name", "value": ""}')):
        log(spark, dict(op="update", id="p1", after=after)).select(*[F.col(c) for c in schema.CHANGES.replace(",", "").split()[::2]]).write.mode("append").parquet(path)
        commit_stream(read_changes(spark, path), model, str(tmp_path / "checkpoint"), str(tmp_path / "rejected")).awaitTermination()
    assert model.revision() == 2 and model.read().objects.where("id = 'p1'").first()["name"] == "Streamed"
    assert [r["code"] for r in spark.read.parquet(str(tmp_path / "rejected")).collect()] == ["name_required"]


def _workbook(cells: str, styles: str, workbook: str = "") -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}>{workbook}</workbook>")
        z.writestr("xl/styles.xml", f"<styleSheet {ns}>{styles}</styleSheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return f.getvalue()


def test_workbook_dates():
    """A number under a date format is a date, under another format the number; days count from either of two years."""
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    row = '<row r="1"><c r="A1"><v>45292</v></c><c r="B1" s="1"><v>45292</v></c><c r="C1" s="2"><v>45292.75</v></c><c r="D1" s="3"><v>45292</v></c><c r="E1" s="1"><v>1</v></c></row>'
    assert tables.xlsx_rows(_workbook(row, styles)) == [["45292", "2024-01-01", "2024-01-01T18:00:00", "45292", "1900-01-01"]]
    assert tables.xlsx_rows(_workbook(row, styles, '<workbookPr date1904="1"/>'))[0][1] == "2028-01-02"


def test_workbook_choices():
    """Choices that the form can't hold give no list; quotes are doubled."""
    data = templates.xlsx_template(["a", "b", "c", "d"], [], {"a": ["red, dark", "x"], "b": ['5" pipe', "y & z"], "c": ["line\nend"], "d": ["w" * 300]})
    sheet = zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<dataValidation ") == 1 and 'count="1"' in sheet and '<formula1>"5"" pipe,y &amp; z"</formula1>' in sheet and 'sqref="B2:B2001"' in sheet
