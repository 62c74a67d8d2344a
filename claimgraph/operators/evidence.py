"""Evidence that is derived again from the bytes it cites, by the kind of its locator.

A byte range must decode to the quotation; a node of a syntax tree, a JSON value and an XML element must stand where
the locator says; a unit of a document must be taken out with the same text. Nothing is repaired: what does not match
carries an error, and no strength. Kinds without a verifier are refused."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.compiler import documents, structured
from claimgraph.functions.ids import content_id

ENGINES = {"byte_range": "byte_compare/1", "ast_node": "ast_reparse/1", "json_pointer": "json_pointer/1", "xml_path": "xml_hardened/1", "docx_para": "docx_reextract/1"}


def make(cited: DataFrame) -> DataFrame:
    """(evidence_id, artifact_id, artifact_sha256, locator_kind, locator, quote), not verified yet, of (artifact_id, content,
    locator_kind, locator as canonical JSON, quote)."""
    sha = F.sha2("content", 256)
    return cited.select(content_id("evidence", F.col("artifact_id"), sha, F.col("locator_kind"), F.col("locator"), F.col("quote")).alias("evidence_id"), "artifact_id", sha.alias("artifact_sha256"), "locator_kind", "locator", "quote")


def _node(content: bytes, locator: dict, quote: str) -> str | None:
    try:
        node: ast.AST = ast.parse(content.decode("utf-8"))
    except (SyntaxError, ValueError) as e:
        return f"artifact no longer parses: {type(e).__name__}"
    for step in filter(None, locator["path"].split("/")):
        node = next((c for c in ast.iter_child_nodes(node) if f"{type(c).__name__}:{getattr(c, 'name', '')}" == step), None)
        if node is None:
            return f"AST path does not resolve (missing {step!r})"
    if type(node).__name__ != locator["node_type"]:
        return f"AST node type mismatch: expected {locator['node_type']}, found {type(node).__name__}"
    name = getattr(node, "name", None)
    return f"AST node name mismatch: {name!r}" if name is not None and quote and name != quote else None


def _value(content: bytes, locator: dict, quote: str) -> str | None:
    at = structured.parse_json(content)
    for step in filter(None, locator["pointer"].split("/")):
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(at, list):
            if not step.isdigit() or int(step) >= len(at):
                return f"JSON pointer index {step!r} out of range"
            at = at[int(step)]
        elif isinstance(at, dict):
            if step not in at:
                return f"JSON pointer key {step!r} not present"
            at = at[step]
        else:
            return f"JSON pointer descends into scalar at {step!r}"
    return None if str(at) == quote else "JSON value mismatch"


def _element(content: bytes, locator: dict, quote: str) -> str | None:
    node = structured.parse_xml(content)
    steps = [s for s in locator["path"].split("/") if s]
    for step in steps[1:] if steps and steps[0] == node["tag"] else steps:
        tag, _, place = step.partition("[")
        same = [c for c in node["children"] if c["tag"] == tag]
        k = int(place.rstrip("]")) - 1 if place else 0
        if not 0 <= k < len(same):
            return f"XML path step {step!r} does not resolve"
        node = same[k]
    return None if structured.all_text(node).strip() == quote.strip() else "XML text mismatch at path"


def _paragraph(content: bytes, locator: dict, quote: str) -> str | None:
    wanted = (locator.get("unit", "paragraph"), locator["para"])
    if wanted == ("document", -1):
        return None if quote == "" else "a whole document has no quotation"
    text = next((t for unit, k, t in documents.units(content) if (unit, k) == wanted), None)
    if text is None:
        return f"{wanted[0]} {wanted[1]} is no longer present in the document"
    return None if text == quote else f"re-extracted text for {wanted[0]} {wanted[1]} differs from the stored quotation"


VERIFIERS: dict[str, Callable[[bytes, dict, str], str | None]] = {"ast_node": _node, "json_pointer": _value, "xml_path": _element, "docx_para": _paragraph}


def verify(evidence: DataFrame, contents: DataFrame) -> DataFrame:
    """(evidence_id, strength, engine, error) of evidence (evidence_id, artifact_id, artifact_sha256, locator_kind, locator,
    quote) against contents (artifact_id, content). Byte ranges are compared inside the JVM, other kinds in Arrow batches."""
    # Each row of an artifact takes the content along, but a task holds a batch of them at a time.
    rows = evidence.join(contents.select("artifact_id", "content"), "artifact_id", "left")
    sha = F.sha2("content", 256)
    pinned = F.when(F.col("content").isNull(), "artifact has no content").when(sha != F.col("artifact_sha256"), F.concat(F.lit("artifact content drifted: evidence pinned "), F.substring("artifact_sha256", 1, 12), F.lit(", artifact is "), F.substring(sha, 1, 12)))
    pinned = F.when(F.col("content").isNull(), pinned).when(~F.col("locator_kind").isin(*ENGINES), F.coalesce(pinned, F.concat(F.lit("no verifier for locator kind "), "locator_kind", F.lit("; refusing to assert verification")))).otherwise(pinned)
    rows = rows.withColumn("pinned", pinned)
    begin, end = (F.get_json_object("locator", f"$.{k}").cast("long") for k in ("byte_start", "byte_end"))
    found = F.substring("content", (begin + 1).cast("int"), (end - begin).cast("int")).cast("binary")
    inside = (begin >= 0) & (begin <= end) & (end <= F.octet_length("content"))
    spoken = F.when(F.coalesce(~inside, F.lit(True)), "byte range outside artifact").when(~F.is_valid_utf8(found), "byte range does not decode as UTF-8").when(found != F.col("quote").cast("binary"), "quoted text does not match source")
    bytes_ = rows.where((F.col("locator_kind") == "byte_range") | F.col("pinned").isNotNull()).select("evidence_id", "locator_kind", F.coalesce("pinned", spoken).alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for kind, locator, quote, content in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                try:
                    errors.append(VERIFIERS[kind](content, json.loads(locator), quote or ""))
                except (ValueError, KeyError, TypeError) as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(errors, pa.string())], names=["evidence_id", "locator_kind", "error"])

    other = rows.where((F.col("locator_kind") != "byte_range") & F.col("pinned").isNull()).select("evidence_id", "locator_kind", "locator", "quote", "content").mapInArrow(run, "evidence_id string, locator_kind string, error string")
    both = bytes_.unionByName(other)
    good = F.col("error").isNull()
    engine = F.element_at(F.create_map(*(F.lit(x) for pair in ENGINES.items() for x in pair)), F.col("locator_kind"))
    return both.select("evidence_id", F.when(good, F.when(F.col("locator_kind") == "docx_para", "REPRODUCIBLE").otherwise("EXACT")).alias("strength"), F.when(good, engine).alias("engine"), "error")
