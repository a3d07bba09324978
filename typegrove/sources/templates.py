"""Model templates: a nested document of types, attributes, rules and sample records as plan operations; workbooks to fill in."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from ..operators.change_plan import OPERATIONS


def operations(spark: SparkSession, template: dict) -> DataFrame:
    """Plan operations of a template. Keys within the document become tokens; all rows are creates.

    A template has object_types and relationship_types (key, name, attributes), the latter with rules (subject, object,
    and the bounds s_min, s_max, o_min, o_max), and may have objects and relationships.
    """
    rows: list[tuple] = []

    def add(kind: str, token: str, fields: dict, parent_kind: str | None = None, parent: str | None = None) -> None:
        text = {k: json.dumps(v) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in fields.items() if v is not None}
        rows.append((len(rows) + 1, "create", kind, "new", token, parent_kind, "new" if parent else None, parent, text))

    for kind in ("object_type", "relationship_type"):
        for n, t in enumerate(template.get(f"{kind}s", [])):
            add(kind, t["key"], {"name": t["name"], "key": t["key"], "description": t.get("description", ""), "sort_order": n})
            for m, a in enumerate(t.get("attributes", [])):
                add("attribute_definition", f"{t['key']}.{a['key']}", {"sort_order": m, **a}, kind, t["key"])
    for t in template.get("relationship_types", []):
        for r in t.get("rules", []):
            bounds = {k: r.get(k) for k in ("s_min", "s_max", "o_min", "o_max")}
            add("relationship_type_rule", f"{t['key']}:{r['subject']}:{r['object']}", {"subject_type_id": f"new:{r['subject']}", "object_type_id": f"new:{r['object']}", **bounds}, "relationship_type", t["key"])
    for o in template.get("objects", []):
        add("object", o["key"], {"name": o["name"], "key": o["key"], **{f"attributes.{k}": v for k, v in o.get("attributes", {}).items()}}, "object_type", o["type"])
    for n, e in enumerate(template.get("relationships", [])):
        add("relationship", f"edge-{n}", {"source": f"new:{e['source']}", "target": f"new:{e['target']}"}, "relationship_type", e["type"])
    return spark.createDataFrame(rows, OPERATIONS)


def registry(spark: SparkSession, path: str) -> dict[str, dict]:
    """The templates of a folder of JSON documents, by their ``key``: a handful of small files, read where Spark reads."""
    found = [json.loads(r["value"]) for r in spark.read.option("wholetext", True).text(path).collect()]
    return {t["key"]: t for t in sorted(found, key=lambda t: t["key"])}


def csv_template(headers: list[str], rows: list[list[str | None]]) -> bytes:
    """UTF-8 with a byte order mark and CRLF, as spreadsheets read it."""
    import csv

    f = io.StringIO(newline="")
    w = csv.writer(f, lineterminator="\r\n")
    w.writerow(headers)
    w.writerows([["" if c is None else c for c in row] for row in rows])
    return b"\xef\xbb\xbf" + f.getvalue().encode()


def _ref(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, r = divmod(column - 1, 26)
        out = chr(65 + r) + out
    return out


def _formula(choices: list[str]) -> str | None:
    """Choices as a formula's list of texts; None where the form can't hold them: a comma parts choices, 255 is the most."""
    if not choices or any("," in c or any(ord(ch) < 32 for ch in c) for c in choices):
        return None
    text = ",".join(choices)
    return None if len(text) > 255 else '"' + text.replace('"', '""') + '"'


def xlsx_template(headers: list[str], rows: list[list[str | None]], choices: dict[str, list[str]]) -> bytes:
    """A workbook of one sheet with the rows as text, and a list of choices to pick from under each column that has one."""
    body = []
    for n, row in enumerate([headers, *rows], 1):
        cells = "".join(f'<c r="{_ref(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for i, c in enumerate(row) if c is not None)
        body.append(f'<row r="{n}">{cells}</row>')
    lists = [(_ref(headers.index(h)), _formula(v)) for h, v in choices.items() if h in headers]
    lists = [(c, f) for c, f in lists if f]
    valid = "".join(f'<dataValidation type="list" allowBlank="1" sqref="{c}2:{c}2001"><formula1>{escape(f)}</formula1></dataValidation>' for c, f in lists)
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="Import" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{"".join(body)}</sheetData>' + (f'<dataValidations count="{len(lists)}">{valid}</dataValidations>' if valid else "") + "</worksheet>")
    return f.getvalue()


def zipped(files: dict[str, bytes]) -> bytes:
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(files.items()):
            z.writestr(name, data)
    return f.getvalue()
