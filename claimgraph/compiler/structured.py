"""Reading structured text without evaluating it: XML that declares nothing, JSON of bounded size, CSV; and their records."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the largest JSON text that is parsed.
MAX_JSON_BYTES = 4 * 1024 * 1024


def parse_xml(content: bytes) -> dict:
    """{"tag", "text", "tail", "attributes", "children"} of the root, namespaces as {uri}name. ValueError for XML that
    declares a document type or an entity, or is not well formed; nothing is resolved or fetched."""

    def refuse(*_: object) -> None:
        raise ValueError("document type and entity declarations are refused")

    parser = expat.ParserCreate(namespace_separator="}")
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = parser.UnparsedEntityDeclHandler = parser.ExternalEntityRefHandler = refuse
    top: dict = {"tag": "", "text": "", "tail": "", "attributes": {}, "children": []}
    stack, last = [top], [None]

    def named(tag: str) -> str:
        return f"{{{tag}" if "}" in tag else tag

    def start(tag: str, attributes: dict) -> None:
        node = {"tag": named(tag), "text": "", "tail": "", "attributes": attributes, "children": []}
        stack[-1]["children"].append(node)
        stack.append(node)
        last[0] = None

    def end(_: str) -> None:
        last[0] = stack.pop()

    def data(text: str) -> None:
        if last[0] is None:
            stack[-1]["text"] += text
        else:
            last[0]["tail"] += text

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        raise ValueError(f"XML is not well formed: {e}") from None
    return top["children"][0]


def all_text(node: dict) -> str:
    """All text inside a node, in order."""
    return node["text"] + "".join(all_text(c) + c["tail"] for c in node["children"])


def parse_json(content: bytes) -> object:
    if len(content) > MAX_JSON_BYTES:
        raise ValueError(f"JSON exceeds {MAX_JSON_BYTES} bytes")
    try:
        return json.loads(content.decode("utf-8"))
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
        raise ValueError(f"JSON cannot be read: {type(e).__name__}") from None


def _pointers(value: object) -> Iterator[tuple[str, object]]:
    """(pointer, scalar) of every leaf, in order."""
    waiting: list[tuple[str, object]] = [("", value)]
    while waiting:
        at, x = waiting.pop()
        if isinstance(x, (dict, list)):
            inner = x.items() if isinstance(x, dict) else enumerate(x)
            waiting += [(f"{at}/{k}", v) for k, v in reversed(list(inner))]
        else:
            yield at, x


def records(rel_path: str, text: str) -> list[tuple[str, str]]:
    """(locator, text) of a file's records by its suffix: JSON leaves as `pointer = value` and the whole document, CSV rows
    as `header=value, ...`, XML lines that are not blank, Markdown and plain text between blank lines, else the whole
    file. What cannot be parsed as its suffix says is one whole record."""
    end = rel_path.rpartition(".")[2].lower()
    if end == "json":
        try:
            return [(at or "/", f"{at or '/'} = {x}") for at, x in _pointers(parse_json(text.encode()))] + [("", text)]
        except ValueError:
            return [("", text)]
    if end == "csv":
        rows = list(csv.reader(io.StringIO(text)))
        return [(f"row {n}", ", ".join(f"{h}={v}" for h, v in zip(rows[0], row, strict=False))) for n, row in enumerate(rows[1:], 1) if row]
    if end == "xml":
        return [(f"line {n}", line.strip()) for n, line in enumerate(text.split("\n"), 1) if line.strip()]
    if end in ("md", "txt", "rst"):
        out, at = [], 0
        for block in text.split("\n\n"):
            if block.strip():
                out.append((f"{at}:{at + len(block)}", block.strip()))
            at += len(block) + 2
        return out
    return [("", text)]


def chunks(files: DataFrame) -> DataFrame:
    """(rel_path, seq, locator, body) of files (rel_path, content) that are text in UTF-8."""
    schema = pa.schema([("rel_path", pa.string()), ("seq", pa.int32()), ("locator", pa.string()), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"rel_path": path, "seq": n, "locator": at, "body": body} for n, (at, body) in enumerate(records(path, text))]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.where(F.is_valid_utf8("content")).select("rel_path", F.col("content").cast("string").alias("text")).mapInArrow(run, "rel_path string, seq int, locator string, body string")
