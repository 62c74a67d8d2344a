"""Reading Python modules: symbols, references, import bindings and diagnostics as rows of one table.

Each file is parsed on its own inside an Arrow batch; nothing but its own bytes is needed. A file that does not parse gives
one diagnostic and no other row. Spans are half-open ranges of bytes. Rows of `READ_SCHEMA` are told apart by `record`:

- symbol: kind, name, qname, parent (a qualified name), docstring and span;
- reference: predicate, owner (the qualified name of the definition that it stands in), target (the name as written, or
  the literal's source text), resolution and reason as far as the file alone tells, target_qname, span and quote;
- binding: an imported local `name` and its `target`, the last import of a name counting;
- definition: a `name` bound at module level;
- diagnostic: severity, code, message, line.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

FIELDS = {"record": "string", "artifact_id": "string", "module": "string", "seq": "int", "kind": "string", "name": "string", "qname": "string", "parent": "string", "docstring": "string", "predicate": "string", "owner": "string", "target": "string", "target_qname": "string", "resolution": "string", "reason": "string", "severity": "string", "code": "string", "message": "string", "line": "int", "byte_start": "long", "byte_end": "long", "line_start": "int", "line_end": "int", "col_start": "int", "col_end": "int", "quote": "string"}
READ_SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
_ARROW = pa.schema([(k, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[v]) for k, v in FIELDS.items()])
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
COMPUTED = "<computed>"


def dotted(node: ast.AST) -> str | None:
    """`a.b.c` of a chain of attributes on a name, None for any other expression."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def literal_refusal(node: ast.Assign | ast.AnnAssign) -> str | None:
    """Why a statement of a class body states no comparable value; None if it does."""
    if isinstance(node, ast.AnnAssign):
        return "annotated assignment"
    if len(node.targets) > 1:
        return "chained assignment to several targets"
    if not isinstance(node.targets[0], ast.Name):
        return f"{type(node.targets[0]).__name__} target is not a plain name"
    if not isinstance(node.value, ast.Constant):
        return f"value is a {type(node.value).__name__}, not a bare literal"
    # Bytes are left out: with their prefix dropped they would compare equal to text.
    if not isinstance(node.value.value, (bool, int, float, str, type(None))):
        return f"literal type {type(node.value.value).__name__!r} is not safely comparable"
    return None


@dataclass
class Place:
    """Where the walk is: the definition that owns what it finds, whether that is a class, and whether the node is a
    statement of a class body itself."""

    owner: str
    in_class: bool = False
    class_body: bool = False
    decorator: bool = False


@dataclass
class Module:
    """One file under way."""

    content: bytes
    name: str
    rows: list[dict] = field(default_factory=list)
    scope: dict[str, str] = field(default_factory=dict)
    imported: dict[str, str] = field(default_factory=dict)
    calls: list[tuple[ast.Call, Place]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.starts = [0]
        for line in self.content.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))

    def span(self, node: ast.AST) -> dict:
        first, last = getattr(node, "lineno", 1), getattr(node, "end_lineno", None) or getattr(node, "lineno", 1)
        at, to = getattr(node, "col_offset", 0), getattr(node, "end_col_offset", None) or 0
        begin, end = self.starts[first - 1] + at, min(self.starts[last - 1] + to, len(self.content))
        return {"byte_start": begin, "byte_end": end, "line_start": first, "line_end": last, "col_start": at, "col_end": to}

    def text(self, span: dict) -> str:
        return self.content[span["byte_start"] : span["byte_end"]].decode("utf-8")

    def add(self, record: str, **values: object) -> None:
        self.rows.append({"record": record, "module": self.name, "seq": len(self.rows), **values})

    def symbol(self, kind: str, name: str, place: Place, node: ast.AST) -> str:
        qname = f"{place.owner}.{name}"
        doc = ast.get_docstring(node) if isinstance(node, _DEFINITIONS) else None
        span = self.span(node)
        self.add("symbol", kind=kind, name=name, qname=qname, parent=place.owner, docstring=doc, quote=self.text(span), **span)
        if place.owner == self.name:
            self.scope[name] = qname
        return qname

    def reference(self, predicate: str, owner: str, target: str, node: ast.AST, resolution: str, reason: str, target_qname: str | None = None) -> None:
        span = self.span(node)
        self.add("reference", predicate=predicate, owner=owner, target=target, target_qname=target_qname, resolution=resolution, reason=reason, quote=self.text(span), **span)

    def say(self, severity: str, code: str, message: str, line: int | None) -> None:
        self.add("diagnostic", severity=severity, code=code, message=message, line=line)

    def known(self, name: str) -> tuple[str, str, str | None]:
        """(resolution, reason, qualified name) as far as this file's own bindings tell."""
        head = name.split(".")[0]
        if name in self.scope:
            return "DETERMINISTIC", "bound in module scope", self.scope[name]
        if head in self.scope:
            return "UNRESOLVED", "attribute access on a module-scope value", None
        if head in self.imported:
            return "HEURISTIC", f"imported name resolves to {self.imported[head]!r} in another artifact", None
        return "UNRESOLVED", "not bound in any statically known scope", None

    # What each kind of node gives; the value is the place for its children.

    def definition(self, node: ast.FunctionDef | ast.AsyncFunctionDef, place: Place) -> Place:
        return Place(self.symbol("method" if place.in_class else "function", node.name, place, node))

    def class_(self, node: ast.ClassDef, place: Place) -> Place:
        qname = self.symbol("class", node.name, place, node)
        for base in node.bases:
            if name := dotted(base):
                resolution, reason, target = self.known(name)
                self.reference("EXTENDS", qname, name, base, resolution, reason, target)
        return Place(qname, in_class=True, class_body=True)

    def import_(self, node: ast.Import, place: Place) -> None:
        for alias in node.names:
            self.imported[alias.asname or alias.name.split(".")[0]] = alias.name
            self.reference("IMPORTS", place.owner, alias.name, node, "HEURISTIC", "import target is in another artifact; binding known, definition not analysed")

    def import_from(self, node: ast.ImportFrom, place: Place) -> None:
        origin = node.module or "."
        if node.level:
            above = self.name.split(".")
            package = above[: -node.level] if node.level <= len(above) else []
            origin = ".".join([*package, *([node.module] if node.module else [])]) or node.module or "."
        for alias in node.names:
            if alias.name == "*":
                self.reference("IMPORTS", place.owner, f"{origin}.*", node, "UNRESOLVED", "star-import: bound names are not statically determinable")
                self.say("WARNING", "STAR_IMPORT", f"star-import from {origin} makes later names unresolvable", node.lineno)
            else:
                self.imported[alias.asname or alias.name] = f"{origin}.{alias.name}"
                self.reference("IMPORTS", place.owner, f"{origin}.{alias.name}", node, "HEURISTIC", "import target is in another artifact")

    def assignment(self, node: ast.Assign | ast.AnnAssign, place: Place) -> None:
        for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
            if isinstance(target, ast.Name):
                self.symbol("constant" if target.id.isupper() else "variable", target.id, place, node)
        if place.class_body:
            if reason := literal_refusal(node):
                self.say("INFO", "UNSUPPORTED_CLASS_LITERAL", f"class-body assignment in {place.owner} not extracted as a value: {reason}", node.lineno)
            else:
                self.reference("HAS_VALUE", f"{place.owner}.{node.targets[0].id}", self.text(self.span(node.value)), node, "DETERMINISTIC", "direct class-body assignment of a bare literal")

    def call(self, node: ast.Call, place: Place) -> None:
        """Calls wait for the end of the file, as a name may be bound after it is called."""
        name = dotted(node.func)
        if place.decorator:
            self.say("INFO", "UNSUPPORTED_DECORATOR_CALL", f"decorator expression {name or COMPUTED!r} on {place.owner} is evaluated when the definition is built, not called by it; no CALLS claim emitted", node.lineno)
        elif name is None:
            self.reference("CALLS", place.owner, COMPUTED, node, "UNRESOLVED", "call target is a computed expression")
        else:
            resolution, reason, target = self.known(name)
            self.reference("CALLS", place.owner, name, node, resolution, reason, target)
            if resolution == "UNRESOLVED":
                self.say("INFO", "UNRESOLVED_REFERENCE", f"call target {name!r} not statically resolvable", node.lineno)

    def read(self, tree: ast.Module) -> list[dict]:
        whole = {"byte_start": 0, "byte_end": len(self.content), "line_start": 1, "line_end": max(1, len(self.starts) - 1), "col_start": 0, "col_end": 0}
        self.add("symbol", kind="module", name=self.name, qname=self.name, docstring=ast.get_docstring(tree), quote=self.text(whole), **whole)
        waiting: list[tuple[ast.AST, Place]] = [(n, Place(self.name)) for n in reversed(list(ast.iter_child_nodes(tree)))]
        while waiting:  # in the order of the source, without recursion: code may nest deeply
            node, place = waiting.pop()
            below = Place(place.owner, place.in_class, False, place.decorator)
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                below = self.definition(node, place)
            elif isinstance(node, ast.ClassDef):
                below = self.class_(node, place)
            elif isinstance(node, ast.Import):
                self.import_(node, place)
            elif isinstance(node, ast.ImportFrom):
                self.import_from(node, place)
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                self.assignment(node, place)
            elif isinstance(node, ast.Call):
                self.calls.append((node, place))
            decorators = set(map(id, node.decorator_list)) if isinstance(node, _DEFINITIONS) else set()
            inner = [(n, Place(below.owner, below.in_class, below.class_body, place.decorator or id(n) in decorators)) for n in ast.iter_child_nodes(node)]
            waiting += reversed(inner)
        for node, place in self.calls:
            self.call(node, place)
        for name, origin in self.imported.items():
            self.add("binding", name=name, target=origin)
        for name, qname in self.scope.items():
            self.add("definition", name=name, qname=qname)
        return self.rows


def read_module(content: bytes, module: str) -> list[dict]:
    """All rows of a file, without its artifact's id."""
    found = Module(content, module)
    try:
        tree = ast.parse(content.decode("utf-8"))
    except SyntaxError as e:
        found.say("ERROR", "SYNTAX_ERROR", f"{type(e).__name__}: {e.msg} (line {e.lineno})", e.lineno)
        return found.rows
    except (ValueError, RecursionError, MemoryError) as e:
        found.say("ERROR", "PARSE_ERROR", f"{type(e).__name__}: {e}", None)
        return found.rows
    return found.read(tree)


def read(files: DataFrame) -> DataFrame:
    """READ_SCHEMA of (artifact_id, module, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for artifact, module, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [{"artifact_id": artifact, **r} for r in read_module(content, module)]
                for low in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist(rows[low : low + 2000], schema=_ARROW)

    return files.select("artifact_id", "module", "content").mapInArrow(run, READ_SCHEMA)


