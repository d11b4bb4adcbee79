"""Small office files made from table rows, for queries and tests of the office sources."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def xlsx(sheets: dict[str, list[list]], merged: tuple[str, ...] = (), hidden: tuple[str, ...] = ()) -> bytes:
    """A workbook with inline strings and numbers; `merged` ranges are those of every sheet."""
    parts = {}
    for n, rows in enumerate(sheets.values(), 1):
        cells = []
        for r, row in enumerate(rows, 1):
            made = [
                f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>'
                for c, v in enumerate(row)
                if v is not None
            ]
            cells.append(f'<row r="{r}">{"".join(made)}</row>')
        ranges = "".join(f'<mergeCell ref="{m}"/>' for m in merged)
        parts[f"xl/worksheets/sheet{n}.xml"] = f"<worksheet {_MAIN}><sheetData>{''.join(cells)}</sheetData>{f'<mergeCells>{ranges}</mergeCells>' if ranges else ''}</worksheet>"
    listed = "".join(f'<sheet name="{escape(s)}" sheetId="{n}" r:id="r{n}"{" state=" + chr(34) + "hidden" + chr(34) if s in hidden else ""}/>' for n, s in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="r{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
    parts["xl/workbook.xml"] = f"<workbook {_MAIN} {_REL}><sheets>{listed}</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{links}</Relationships>"
    return _zip(parts)


def docx(items: list[tuple[str, object]]) -> bytes:
    """A document of ("h1", text), ("p", text), ("li", text), ("toc", text) and ("table", rows) items."""
    styles = {"h1": "heading 1", "h2": "heading 2", "li": "List Bullet", "toc": "toc 1"}
    body = []
    for kind, value in items:
        if kind == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{escape(v)}</w:t></w:r></w:p></w:tc>" for v in row) + "</w:tr>" for row in value)
            body.append(f"<w:tbl>{rows}</w:tbl>")
        else:
            style = f'<w:pPr><w:pStyle w:val="{kind}"/></w:pPr>' if kind in styles else ""
            body.append(f"<w:p>{style}<w:r><w:t>{escape(value)}</w:t></w:r></w:p>")
    known = "".join(f'<w:style w:styleId="{k}"><w:name w:val="{v}"/></w:style>' for k, v in styles.items())
    return _zip({"word/document.xml": f"<w:document {_WORD}><w:body>{''.join(body)}</w:body></w:document>", "word/styles.xml": f"<w:styles {_WORD}>{known}</w:styles>"})


def office_files(docs: DataFrame, kind: str) -> DataFrame:
    """docs(doc_id, lang, source) -> (path, content), a small file of the kind for each row."""

    def run(ids: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.Array:
        out = []
        for i, lang, source in zip(ids.to_pylist(), langs.to_pylist(), sources.to_pylist()):
            if kind == "xlsx":
                out.append(xlsx({"Data": [["lang", "source", "id"], [lang, source, i]], "QA": [["a", "b"], ["c", "d"]]}))
            elif kind == "docx":
                out.append(docx([("toc", "left out"), ("h1", source), ("p", f"written in {lang}"), ("li", f"number {i}"), ("table", [["lang", "id"], [lang, str(i)]])]))
            else:
                out.append(f"lang,source,id\n{lang},{source},{i}\n".encode())
        return pa.array(out, pa.binary())

    run.__annotations__ = dict.fromkeys(("ids", "langs", "sources", "return"), pa.Array)
    path = F.concat(F.lit("/files/doc_"), F.col("doc_id").cast("string"), F.lit(f".{kind}"))
    return docs.select(path.alias("path"), F.arrow_udf(run, "binary")("doc_id", "lang", "source").alias("content"))
