"""Reads of a compiled graph: counts, search, one node or edge, neighbourhoods, ranked expansion.

Whatever is cut by a limit says so (`truncated`, `total_reachable`), and is cut in a stated order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.compiler.compile import Graph
from claimgraph.functions.shared import written

# Predicates that are edges of a neighbourhood, its limit, and what damps an expansion.
EDGES = ("CONTAINS", "CALLS", "IMPORTS", "EXTENDS", "HAS_VALUE")
EXPANDED = ("CALLS", "CONTAINS", "IMPORTS")
MOST_NODES = 220
PER_HOP = 0.6


def location(kind: Column, locator: Column) -> Column:
    """An address for a reader, as far as the kind of locator has one: nothing is made up for kinds without lines or pages."""
    part = lambda k: F.get_json_object(locator, f"$.{k}")
    span = F.concat(F.lit("bytes "), F.coalesce(part("byte_start"), F.lit("None")), F.lit("–"), F.coalesce(part("byte_end"), F.lit("None")))
    line, page, para = part("line_start"), part("page"), part("para")
    return (
        F.when((kind == "byte_range") & line.isNotNull() & (line != "0"), F.concat(F.lit("line "), line, F.lit(", "), span))
        .when(kind == "byte_range", span)
        .when(kind == "pdf_box", F.when(page.isNotNull() & (page != "0"), F.concat(F.lit("page "), page)).otherwise("whole document"))
        .when(kind == "docx_para", F.when(para.isNull() | (para.cast("long") < 0), "whole document").otherwise(F.concat(F.coalesce(part("unit"), F.lit("paragraph")), F.lit(" "), para)))
        .otherwise(kind)
    )


def statistics(graph: Graph) -> DataFrame:
    """(measure, key, n): rows of each table, artifacts by status, claims by predicate, symbols by kind, references by
    resolution; `relationships` are claims other than CONTAINS."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), F.lit(None).cast("string").alias("key"), "n")
    by = lambda df, c, name: df.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "key", "n")
    parts = [one(df, name) for name, df in (("artifacts", graph.artifacts), ("symbols", graph.symbols), ("claims", graph.claims), ("evidence", graph.evidence), ("relationships", graph.claims.where("predicate <> 'CONTAINS'")), ("diagnostics", graph.diagnostics))]
    parts += [by(graph.artifacts, "status", "status"), by(graph.claims, "predicate", "predicate"), by(graph.symbols, "kind", "kind"), by(graph.references, "resolution", "resolution")]
    return reduce(DataFrame.unionByName, parts)


def coverage(graph: Graph) -> DataFrame:
    """(references, deterministic, ratio): the share of references with a target that is certain; 0 of none is 0."""
    sums = graph.references.agg(F.count(F.lit(1)).alias("references"), F.count_if(F.col("resolution") == "DETERMINISTIC").alias("deterministic"))
    return sums.select("references", "deterministic", F.round(F.col("deterministic") / F.greatest("references", F.lit(1)), 6).alias("ratio"))


def problem_artifacts(graph: Graph, limit: int = 100) -> DataFrame:
    """(rel_path, status, reason, size_bytes, sha256) of artifacts that are not OK, by status and path."""
    return graph.artifacts.where("status <> 'OK'").orderBy("status", "rel_path").limit(limit).select("rel_path", "status", "reason", "size_bytes", "sha256")


def diagnostics(graph: Graph, code: str | None = None, limit: int = 200) -> DataFrame:
    """(code, severity, rel_path, line, message) by code and path."""
    rows = graph.diagnostics if code is None else graph.diagnostics.where(F.col("code") == code)
    return rows.join(graph.artifacts.select("artifact_id", "rel_path"), "artifact_id", "left").select("code", "severity", "rel_path", "line", "message").orderBy("code", "rel_path", "line", "message").limit(limit)


def _placed(symbols: DataFrame) -> Column:
    return F.concat(F.when(F.col("line_start") > 0, F.concat(F.lit("line "), F.col("line_start").cast("string"), F.lit(", "))).otherwise(""), F.lit("bytes "), F.col("byte_start").cast("string"), F.lit("–"), F.col("byte_end").cast("string"))


def search_symbols(graph: Graph, term: str, limit: int = 40) -> DataFrame:
    """(symbol_id, qname, name, kind, rel_path, location) of symbols whose name or qualified name holds the term, ASCII letters in
    either case: names equal to it first, then short ones. Wildcards of the term stand for themselves; a blank term finds
    nothing."""
    wanted = term.strip()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in wanted)
    holds = lambda c: F.contains(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(low))
    rows = graph.symbols.where(F.lit(bool(wanted)) & (holds("qname") | holds("name")))
    ordered = rows.orderBy((F.col("name") == wanted).desc(), F.length("qname"), "qname", "symbol_id").limit(limit)
    return ordered.select("symbol_id", "qname", "name", "kind", "rel_path", _placed(graph.symbols).alias("location"))


def degrees(graph: Graph) -> DataFrame:
    """(symbol_id, predicate, n): claims of which a symbol is subject or object, those from it to itself once."""
    ends = F.array_distinct(F.array_compact(F.array("subject_id", "object_id")))
    return graph.claims.select(F.explode(ends).alias("symbol_id"), "predicate").groupBy("symbol_id", "predicate").agg(F.count(F.lit(1)).alias("n"))


def nodes(graph: Graph, ids: DataFrame) -> DataFrame:
    """Symbols (symbol_id) with their artifact's path and status, and their degree by predicate as a map."""
    chosen = ids.select("symbol_id").distinct()
    degree = degrees(graph).join(chosen, "symbol_id", "left_semi").groupBy("symbol_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "n")))).alias("neighbours"))
    rows = graph.symbols.join(chosen, "symbol_id", "left_semi").join(graph.artifacts.select("artifact_id", F.col("status").alias("parse_status")), "artifact_id")
    return rows.join(degree, "symbol_id", "left").select("symbol_id", "qname", "name", "kind", "docstring", "parent_id", "rel_path", "parse_status", "neighbours")


def children(graph: Graph, ids: DataFrame) -> DataFrame:
    """(parent_id, symbol_id, qname, name, kind): direct children by the parent's identity, never by a prefix of the name."""
    return graph.symbols.join(ids.select(F.col("symbol_id").alias("parent_id")).distinct(), "parent_id", "left_semi").select("parent_id", "symbol_id", "qname", "name", "kind")


def edges(graph: Graph, ids: DataFrame) -> DataFrame:
    """Claims (claim_id) with the names of their ends, how their target was resolved, and their evidence as an array."""
    names = graph.symbols.select("symbol_id", "qname")
    rows = graph.claims.join(ids.select("claim_id").distinct(), "claim_id", "left_semi")
    rows = rows.join(names.select(F.col("symbol_id").alias("subject_id"), F.col("qname").alias("subject")), "subject_id").join(names.select(F.col("symbol_id").alias("object_id"), F.col("qname").alias("object")), "object_id", "left")
    cited = graph.claim_evidence.join(rows.select("claim_id"), "claim_id", "left_semi").join(evidence(graph), "evidence_id").groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "rel_path", "location", "strength", "quote"))).alias("evidence"))
    return rows.join(cited, "claim_id", "left").join(graph.references, "claim_id", "left").select("claim_id", "predicate", "subject", "object", "object_literal", "establishment", "lifecycle", "to_name", "resolution", "reason", "evidence")


def evidence(graph: Graph) -> DataFrame:
    """Evidence with the path it lies in and an address for a reader."""
    return graph.evidence.join(graph.artifacts.select("artifact_id", "rel_path"), "artifact_id").withColumn("location", location(F.col("locator_kind"), F.col("locator")))


def facts(graph: Graph, ids: DataFrame, limit: int = 40) -> DataFrame:
    """(claim_id, predicate, subject, object, resolved): what symbols (symbol_id) are the subject of besides CONTAINS, by
    predicate and object; the object is a symbol's name or else the literal."""
    names = graph.symbols.select("symbol_id", "qname")
    rows = graph.claims.where("predicate <> 'CONTAINS'").join(ids.select(F.col("symbol_id").alias("subject_id")).distinct(), "subject_id", "left_semi")
    rows = rows.join(names.select(F.col("symbol_id").alias("subject_id"), F.col("qname").alias("subject")), "subject_id").join(names.select(F.col("symbol_id").alias("object_id"), F.col("qname").alias("named")), "object_id", "left")
    return rows.orderBy("predicate", F.col("named").asc_nulls_first(), "object_literal", "claim_id").limit(limit).select("claim_id", "predicate", "subject", F.coalesce("named", "object_literal", F.lit("")).alias("object"), F.col("named").isNotNull().alias("resolved"))


def callees(graph: Graph, ids: DataFrame, limit: int = 4) -> DataFrame:
    """(caller, symbol_id, qname, kind): functions, methods and classes that each symbol (symbol_id) calls, as far as the calls
    are resolved; the first `limit` names of each."""
    targets = graph.symbols.where("kind IN ('function', 'method', 'class')").select(F.col("symbol_id").alias("object_id"), "qname", "kind")
    calls = graph.claims.where("predicate = 'CALLS'").join(ids.select(F.col("symbol_id").alias("subject_id")).distinct(), "subject_id", "left_semi").join(targets, "object_id")
    first = calls.select("subject_id", "object_id", "qname", "kind").distinct().groupBy("subject_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("qname", F.col("object_id").alias("symbol_id"), "kind"))), 1, limit).alias("f"))
    return first.select(F.col("subject_id").alias("caller"), F.explode("f").alias("x")).select("caller", "x.symbol_id", "x.qname", "x.kind")


def own_span(graph: Graph, ids: DataFrame) -> DataFrame:
    """(symbol_id, evidence_id, quote, rel_path): the longest quotation of the claim that a symbol is contained somewhere, which
    is its whole definition; of equally long ones that of the least id."""
    claims = graph.claims.where("predicate = 'CONTAINS'").join(ids.select(F.col("symbol_id").alias("object_id")).distinct(), "object_id", "left_semi")
    rows = claims.select("claim_id", F.col("object_id").alias("symbol_id")).join(graph.claim_evidence, "claim_id").join(graph.evidence.select("evidence_id", "quote", "artifact_id"), "evidence_id")
    best = rows.groupBy("symbol_id").agg(F.min_by(F.struct("evidence_id", "quote", "artifact_id"), F.struct(-F.length("quote"), "evidence_id")).alias("b")).select("symbol_id", "b.*")
    return best.join(graph.artifacts.select("artifact_id", "rel_path"), "artifact_id").select("symbol_id", "evidence_id", "quote", "rel_path")


def _touching(claims: DataFrame, frontier: DataFrame) -> DataFrame:
    """Claims at one end of which stands a symbol of frontier (at, position), with the other end; once for each such end."""
    out = claims.join(frontier, F.col("subject_id") == F.col("at")).withColumn("other", F.col("object_id"))
    into = claims.where("object_id IS NULL OR object_id <> subject_id").join(frontier, F.col("object_id") == F.col("at")).withColumn("other", F.col("subject_id"))
    return out.unionByName(into)


def neighbourhood(graph: Graph, root: str, hops: int = 1, predicates: tuple[str, ...] = EDGES, limit: int = MOST_NODES) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes: symbol_id, depth; edges: claim_id, predicate, subject_id, object_id, object_literal, depth; whether the limit cut
    it) around a symbol, over edges in either direction, one or two hops. Predicates that are no edges are left out, all are meant
    if none is left. Edges are taken by their nearer end's place, predicate and claim id; once `limit` nodes are reached, no
    further edge is taken."""
    kinds = [p for p in predicates if p in EDGES] or list(EDGES)
    claims = graph.claims.where(F.col("predicate").isin(*kinds)).select("claim_id", "predicate", "subject_id", "object_id", "object_literal")
    spark = graph.claims.sparkSession
    known = graph.symbols.where(F.col("symbol_id") == root).select("symbol_id", F.lit(0).alias("depth"))
    found_nodes, found_edges, truncated = written(known, "nodes"), None, False
    frontier = found_nodes.select(F.col("symbol_id").alias("at"), F.lit(0).cast("long").alias("position"))
    for depth in range(1, max(1, min(hops, 2)) + 1):
        key = F.struct("position", "predicate", "claim_id")
        rows = _touching(claims, frontier).withColumn("key", key)
        if found_edges is not None:
            rows = rows.join(found_edges.select("claim_id"), "claim_id", "left_anti")
        once = rows.groupBy("claim_id").agg(F.min_by(F.struct(*rows.columns), "key").alias("r")).select("r.*")
        room = limit - found_nodes.count()
        new = once.where("other IS NOT NULL").join(found_nodes.select(F.col("symbol_id").alias("other")), "other", "left_anti").groupBy("other").agg(F.min("key").alias("key"))
        new = written(new.orderBy("key", "other").limit(max(room, 0)), "new")
        full = new.count() >= room
        if full:
            last = new.agg(F.max("key").alias("cut")) if room > 0 else spark.range(1).select(F.struct(F.lit(-1).cast("long").alias("position"), F.lit("").alias("predicate"), F.lit("").alias("claim_id")).alias("cut"))
            taken = once.crossJoin(F.broadcast(last))
            truncated = taken.where("key > cut").limit(1).count() > 0
            once = taken.where("key <= cut").drop("cut")
        layer = written(once.select("claim_id", "predicate", "subject_id", "object_id", "object_literal", F.lit(depth).alias("depth")), "edges")
        found_edges = layer if found_edges is None else found_edges.unionByName(layer)
        # At most `limit` rows: their order is the order in which they were reached.
        order = {r["other"]: i for i, r in enumerate(new.orderBy("key", "other").collect())}
        found_nodes = found_nodes.unionByName(new.select(F.col("other").alias("symbol_id"), F.lit(depth).alias("depth")))
        if truncated or not order:
            break
        frontier = spark.createDataFrame(list(order.items()), "at string, position long")
    return found_nodes, found_edges, truncated


def expand(graph: Graph, seeds: DataFrame, k: int = 10, kinds: tuple[str, ...] = EXPANDED, depth: int = 2) -> DataFrame:
    """(symbol_id, qname, rel_path, depth, score, total_reachable, truncated): the k best symbols that seeds (qname) reach within
    `depth` edges of the kinds, in either direction. A symbol scores 0.6 a hop, damped by how many claims point at it; seeds
    count where a walk comes back to them."""
    claims = graph.claims.where(F.col("predicate").isin(*kinds) & F.col("object_id").isNotNull()).select("subject_id", "object_id")
    both = written(claims.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")).union(claims.select("object_id", "subject_id")).distinct(), "both")
    layer = graph.symbols.join(seeds.select("qname").distinct(), "qname", "left_semi").select(F.col("symbol_id").alias("a"))
    layers = []
    for d in range(1, depth + 1):
        layer = written(layer.join(both, "a").select(F.col("b").alias("a")).distinct(), "layer")
        layers.append(layer.select(F.col("a").alias("symbol_id"), F.lit(d).alias("depth")))
    reach = reduce(DataFrame.unionByName, layers).groupBy("symbol_id").agg(F.min("depth").alias("depth"))
    into = graph.claims.where("object_id IS NOT NULL").groupBy(F.col("object_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("into"))
    rows = reach.join(into, "symbol_id", "left").join(graph.symbols.select("symbol_id", "qname", "rel_path"), "symbol_id")
    score = F.pow(F.lit(PER_HOP), F.col("depth")) / (1 + F.log1p(F.coalesce("into", F.lit(0)).cast("double")))
    rows = rows.withColumn("score", F.round(score, 9))
    total = rows.agg(F.count(F.lit(1)).alias("total_reachable"))
    return rows.orderBy(F.col("score").desc(), F.col("qname").desc(), F.col("rel_path").desc()).limit(k).crossJoin(F.broadcast(total)).select("symbol_id", "qname", "rel_path", "depth", "score", "total_reachable", (F.col("total_reachable") > k).alias("truncated"))
