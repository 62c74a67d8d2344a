"""Word documents as units of text, one symbol for each paragraph or table that has any; page formats are not read.

A document is one `document` symbol that holds its units. Offsets count characters of the text that was taken out, not
bytes of the container, so what cites them can be reproduced, but not compared byte by byte. There is no reader for PDF
here: such files fail with a diagnostic that says so.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from claimgraph.compiler.python_source import _ARROW, READ_SCHEMA
from claimgraph.compiler.structured import parse_xml

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAX_XML = 64 << 20


def _text(node: dict) -> str:
    """The text of a paragraph's runs; tabs and breaks as such."""
    tag = node["tag"].rpartition("}")[2]
    if tag == "t":
        return node["text"]
    return {"tab": "\t", "br": "\n", "cr": "\n"}.get(tag, "") + "".join(map(_text, node["children"]))


def units(content: bytes) -> list[tuple[str, int, str]]:
    """(unit, index, text) of a document's body: its paragraphs with their place among all paragraphs, and its tables, rows
    on lines and cells between tabs. Units without text are left out. ValueError if it is no such document."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            info = archive.getinfo("word/document.xml")
            if info.file_size > MAX_XML:
                raise ValueError("document.xml is too large")
            tree = parse_xml(archive.read(info))
    except (zipfile.BadZipFile, KeyError, ValueError, RuntimeError, NotImplementedError) as e:
        raise ValueError(f"{type(e).__name__}: {e}") from None
    body = next((c for c in tree["children"] if c["tag"] == f"{_W}body"), None)
    out, paragraphs, tables = [], 0, 0
    for child in body["children"] if body else []:
        if child["tag"] == f"{_W}p":
            if text := _text(child).strip():
                out.append(("paragraph", paragraphs, text))
            paragraphs += 1
        elif child["tag"] == f"{_W}tbl":
            rows = ["\t".join(" ".join(filter(None, (_text(p).strip() for p in cell["children"] if p["tag"] == f"{_W}p"))) for cell in row["children"] if cell["tag"] == f"{_W}tc") for row in child["children"] if row["tag"] == f"{_W}tr"]
            if text := "\n".join(rows).strip():
                out.append(("table", tables, text))
            tables += 1
    return out


def _rows(artifact: str, module: str, content: bytes) -> list[dict]:
    base = {"artifact_id": artifact, "module": module}
    try:
        found = units(content)
    except ValueError as e:
        return [{**base, "record": "diagnostic", "seq": 0, "severity": "ERROR", "code": "DOCX_UNREADABLE", "message": str(e)}]
    if not found:
        return [{**base, "record": "diagnostic", "seq": 0, "severity": "ERROR", "code": "TEXT_UNAVAILABLE", "message": "no paragraph or table has text"}]
    total = sum(len(t) for *_, t in found)
    rows = [{**base, "record": "symbol", "seq": 0, "kind": "document", "name": module.rsplit(".", 1)[-1], "qname": module, "byte_start": 0, "byte_end": total, "line_start": -1, "line_end": -1, "col_start": 0, "col_end": 0, "quote": ""}]
    at = 0
    for unit, index, text in found:
        rows.append({**base, "record": "symbol", "seq": len(rows), "kind": unit, "name": f"{unit}{index}", "qname": f"{module}.{unit}{index}", "parent": module, "byte_start": at, "byte_end": at + len(text), "line_start": index, "line_end": index, "col_start": 0, "col_end": 0, "quote": text})
        at += len(text)
    return rows


def read(docx: DataFrame, pdf: DataFrame) -> DataFrame:
    """READ_SCHEMA of (artifact_id, module, content) of either kind."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for artifact, module, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pylist(_rows(artifact, module, content), schema=_ARROW)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"record": "diagnostic", "artifact_id": a, "module": m, "seq": 0, "severity": "ERROR", "code": "ADAPTER_UNAVAILABLE", "message": "no reader for PDF"} for a, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], schema=_ARROW)

    columns = ["artifact_id", "module", "content"]
    return docx.select(columns).mapInArrow(words, READ_SCHEMA).unionByName(pdf.select(columns).mapInArrow(pages, READ_SCHEMA))
