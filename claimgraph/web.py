"""The reads of a store over HTTP, as JSON: python -m claimgraph serve --store DIR --root DIR.

GET /api/versions, /api/stats, /api/problems, /api/search?q=, /api/node/ID, /api/neighbourhood/ID?hops=&predicates=a,b,
/api/edge/ID, /api/evidence/ID; POST /api/ask {"question": ...}, /api/decide {"question": ...}, /api/upload?name= with an
archive or a file as body, which is unpacked below the root, compiled and committed. Unknown ids give 404, bad input 400."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.cli import ingest
from claimgraph.compiler import corpus
from claimgraph.compiler.compile import Graph
from claimgraph.operators import asking, decision, graph_reads
from claimgraph.sources import uploads
from claimgraph.store.snapshots import RuleBroken, Snapshots

MAX_QUESTION = 64 << 10


class NotThere(LookupError):
    """An id that nothing has."""


class Service:
    """What the routes answer, without HTTP."""

    def __init__(self, spark: SparkSession, store: Snapshots, root: str, provider: asking.Provider | None = None):
        self.spark, self.store, self.root, self.provider = spark, store, root, provider

    def graph(self) -> Graph:
        graph = self.store.read()
        if graph is None:
            raise NotThere("nothing has been committed")
        return graph

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def _one(self, df: DataFrame, what: str) -> dict:
        rows = self._rows(df.limit(1))
        if not rows:
            raise NotThere(what)
        return rows[0]

    def _ids(self, column: str, value: str) -> DataFrame:
        return self.spark.createDataFrame([(value,)], f"{column} string")

    def get(self, path: list[str], query: dict[str, str]) -> object:
        match path:
            case ["versions"]:
                return self.store.versions()
            case ["stats"]:
                return self._rows(graph_reads.statistics(self.graph()).orderBy("measure", "key"))
            case ["problems"]:
                return self._rows(graph_reads.problem_artifacts(self.graph()))
            case ["search"]:
                return self._rows(graph_reads.search_symbols(self.graph(), query.get("q", "")))
            case ["node", symbol]:
                return self._one(graph_reads.nodes(self.graph(), self._ids("symbol_id", symbol)), symbol)
            case ["neighbourhood", symbol]:
                graph = self.graph()
                self._one(graph.symbols.where(F.col("symbol_id") == symbol).select("symbol_id"), symbol)
                kinds = tuple(p for p in query.get("predicates", "").split(",") if p) or graph_reads.EDGES
                nodes, edges, truncated = graph_reads.neighbourhood(graph, symbol, int(query.get("hops", "1")), kinds)
                named = nodes.join(graph.symbols.select("symbol_id", "qname", "kind", "rel_path"), "symbol_id").orderBy("depth", "qname", "symbol_id")
                return {"nodes": self._rows(named), "edges": self._rows(edges.orderBy("depth", "predicate", "claim_id")), "truncated": truncated}
            case ["edge", claim]:
                return self._one(graph_reads.edges(self.graph(), self._ids("claim_id", claim)), claim)
            case ["evidence", one]:
                return self._one(graph_reads.evidence(self.graph()).where(F.col("evidence_id") == one), one)
        raise NotThere("/".join(path))

    def post(self, path: list[str], query: dict[str, str], body: bytes) -> object:
        if path == ["upload"]:
            name = query.get("name", "upload")
            reports = uploads.unpack(body, Path(self.root)) if name.lower().endswith(".zip") else [uploads.take_file(name, body, Path(self.root))]
            return {"files": [vars(r) for r in reports], "commit": ingest(self.spark, self.root, self.store)}
        if path not in (["ask"], ["decide"]):
            raise NotThere("/".join(path))
        question = json.loads(body or b"{}").get("question")
        if not isinstance(question, str) or not question.strip():
            raise ValueError("a question is needed")
        graph = self.graph()
        if path == ["decide"]:
            return self._rows(decision.decide(self.spark.createDataFrame([("q", question)], "qid string, question string"), graph))[0]
        files = corpus.read_folder(self.spark, self.root)
        contents = graph.artifacts.where("sha256 <> ''").select("artifact_id", "rel_path").join(files, "rel_path").select("artifact_id", "content")
        return vars(asking.ask(question, graph, contents, self.provider))


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body: bytes | None) -> None:
            url = urlsplit(self.path)
            parts = [unquote(p) for p in url.path.split("/") if p]
            query = {k: v[-1] for k, v in parse_qs(url.query).items()}
            try:
                if parts[:1] != ["api"]:
                    raise NotThere(url.path)
                code, said = 200, service.get(parts[1:], query) if body is None else service.post(parts[1:], query, body)
            except NotThere as e:
                code, said = 404, {"error": f"not found: {e}"}
            except (ValueError, AttributeError, RuleBroken) as e:
                code, said = 400, {"error": str(e)}
            text = json.dumps(said, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def do_GET(self) -> None:  # noqa: N802
            self._answer(None)

        def do_POST(self) -> None:  # noqa: N802
            n = int(self.headers.get("Content-Length") or 0)
            if n > (uploads.MAX_ARCHIVE if self.path.startswith("/api/upload") else MAX_QUESTION):
                self.send_error(413)
                return
            self._answer(self.rfile.read(n))

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(service: Service, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    """A server that is bound, to be run by its caller; reachable from this machine only, unless another host is given."""
    return ThreadingHTTPServer((host, port), handler(service))
