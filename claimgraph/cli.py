"""python -m claimgraph COMMAND: compile a folder into a store of snapshots, and read what it holds."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.compiler import corpus
from claimgraph.compiler.compile import Graph, compile_files
from claimgraph.operators import asking, decision, graph_reads
from claimgraph.store import audit, changes
from claimgraph.store.snapshots import Snapshots


def ingest(spark: SparkSession, root: str, store: Snapshots) -> dict:
    """Compile a folder and commit it; a folder whose contents are those of the last commit commits nothing."""
    files = corpus.read_folder(spark, root)
    found = corpus.artifacts(files, root)
    known = store.read()
    if known is not None and changes.same_rows(found.select("artifact_id"), known.artifacts.select("artifact_id")):
        return {"version": store.versions()[-1], "seen": known.artifacts.count(), "unchanged": True, "absent": []}
    version = store.commit(compile_files(files, root))
    graph = store.read(version)
    status = {r["status"]: r["count"] for r in graph.artifacts.groupBy("status").count().collect()}
    absent = [r["rel_path"] for r in changes.uncovered(files, graph.artifacts).orderBy("rel_path").collect()]
    return {"version": version, "seen": sum(status.values()), "status": status, "symbols": graph.symbols.count(), "claims": graph.claims.count(), "unchanged": False, "absent": absent}


def _lines(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def stats(graph: Graph, _: argparse.Namespace) -> int:
    rows = graph_reads.statistics(graph).orderBy("measure", "key").collect()
    out: dict = {}
    for r in rows:
        if r["key"] is None:
            out[r["measure"]] = r["n"]
        else:
            out.setdefault(r["measure"], {})[r["key"]] = r["n"]
    out["deterministic_coverage"] = graph_reads.coverage(graph).first()["ratio"]
    print(json.dumps(out, indent=2, sort_keys=True))
    return 0


def verify(graph: Graph, _: argparse.Namespace) -> int:
    broken = audit.audit(graph.tables()).where("n > 0").orderBy("rule").collect()
    for r in broken:
        print(f"VIOLATION: {r['n']} {r['rule']}", file=sys.stderr)
    if not broken:
        print("OK: all invariants hold")
    return 1 if broken else 0


def show(graph: Graph, args: argparse.Namespace) -> int:
    ids = graph.symbols.where(F.col("qname") == args.qualified_name).select("symbol_id", "kind", "qname")
    if not ids.limit(1).count():
        print(f"no symbol named {args.qualified_name!r}", file=sys.stderr)
        return 1
    claims = graph.claims.join(ids.select(F.col("symbol_id").alias("subject_id")), "subject_id", "left_semi").select("claim_id")
    _lines(graph_reads.edges(graph, claims).orderBy("predicate", "object", "object_literal", "claim_id"))
    return 0


def diagnostics(graph: Graph, args: argparse.Namespace) -> int:
    _lines(graph_reads.diagnostics(graph, args.code))
    return 0


def search(graph: Graph, args: argparse.Namespace) -> int:
    _lines(graph_reads.search_symbols(graph, args.term))
    return 0


def expand(graph: Graph, args: argparse.Namespace) -> int:
    _lines(graph_reads.expand(graph, graph.claims.sparkSession.createDataFrame([(args.qualified_name,)], "qname string")))
    return 0


def decide(graph: Graph, args: argparse.Namespace) -> int:
    _lines(decision.decide(graph.claims.sparkSession.createDataFrame([("q", args.question)], "qid string, question string"), graph))
    return 0


def ask(graph: Graph, args: argparse.Namespace) -> int:
    files = corpus.read_folder(graph.claims.sparkSession, args.root)
    contents = graph.artifacts.where("sha256 <> ''").select("artifact_id", "rel_path").join(files, "rel_path").select("artifact_id", "content")
    print(json.dumps(vars(asking.ask(args.question, graph, contents)), indent=2, ensure_ascii=False))
    return 0


COMMANDS: dict[str, tuple[Callable[[Graph, argparse.Namespace], int], list[str]]] = {"stats": (stats, []), "verify": (verify, []), "show": (show, ["qualified_name"]), "diagnostics": (diagnostics, []), "search": (search, ["term"]), "expand": (expand, ["qualified_name"]), "decide": (decide, ["question"]), "ask": (ask, ["question", "root"])}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimgraph", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest", help=ingest.__doc__)
    one.add_argument("root")
    one.add_argument("--store", required=True)
    for name, (_, positional) in COMMANDS.items():
        one = sub.add_parser(name)
        for p in positional:
            one.add_argument(p)
        one.add_argument("--store", required=True)
        one.add_argument("--version", type=int)
        if name == "diagnostics":
            one.add_argument("--code")
    one = sub.add_parser("serve", help="answer over HTTP")
    one.add_argument("--store", required=True)
    one.add_argument("--root", required=True)
    one.add_argument("--port", type=int, default=8765)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("claimgraph").getOrCreate()
    store = Snapshots(spark, args.store)
    if args.command == "ingest":
        report = ingest(spark, args.root, store)
        print(json.dumps(report, indent=2))
        for path in report["absent"]:
            print(f"COVERAGE: {path} was walked but has no artifact row", file=sys.stderr)
        return 1 if report["absent"] else 0
    if args.command == "serve":
        from claimgraph import web  # it builds on this module

        web.serve(web.Service(spark, store, args.root), port=args.port).serve_forever()
    graph = store.read(args.version)
    if graph is None:
        print("nothing has been committed to this store", file=sys.stderr)
        return 1
    return COMMANDS[args.command][0](graph, args)
