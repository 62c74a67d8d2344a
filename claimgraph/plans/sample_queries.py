"""Queries over the compiled sample corpus, one for each group of operators, and what each must return.

Outcomes that stand beside the cases below (EVIDENCE_CASES, VALUE_CASES, QUESTIONS, STRUCTURAL_CASES, SCOPES, replies) were written
from the rules before the first run, but for q02 and q20, which a run showed to have been misread. All other expected rows
were recorded from a run after they had been looked through against the sample's source. `VALUES` lists make them SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.compiler import corpus, structured
from claimgraph.compiler.compile import Graph, compile_files
from claimgraph.functions.shared import written
from claimgraph.operators import answers, decision, evidence, graph_reads, identity, measures, questions, rankers, support, values
from claimgraph.sources import samples
from claimgraph.store import audit, changes

_GRAPHS: dict[str, Graph] = {}


def sample_graph(spark: SparkSession) -> Graph:
    """The compiled sample, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _GRAPHS:
        found = compile_files(samples.files(spark).where(corpus.walked(F.col("rel_path"))), "sample")
        _GRAPHS[app] = Graph(**{name: written(df, name) for name, df in found.tables().items()})
    return _GRAPHS[app]


def named_claims(graph: Graph) -> DataFrame:
    """Claims with the names of their ends and the resolution of their target."""
    names = graph.symbols.select("symbol_id", "qname")
    rows = graph.claims.join(names.select(F.col("symbol_id").alias("subject_id"), F.col("qname").alias("subject")), "subject_id").join(names.select(F.col("symbol_id").alias("object_id"), F.col("qname").alias("object")), "object_id", "left")
    return rows.join(graph.references, "claim_id", "left")


def _ids(graph: Graph, *qnames: str) -> DataFrame:
    return graph.symbols.where(F.col("qname").isin(*qnames)).select("symbol_id", "qname")


def compile_artifacts(spark: SparkSession, _: str) -> DataFrame:
    return sample_graph(spark).artifacts.select("rel_path", "language", "status")


def compile_symbols(spark: SparkSession, _: str) -> DataFrame:
    s = sample_graph(spark).symbols
    parents = s.select(F.col("symbol_id").alias("p"), F.col("qname").alias("parent"), F.col("line_start").alias("parent_line"))
    return s.join(parents, F.col("parent_id") == F.col("p"), "left").select("rel_path", "kind", "qname", "line_start", "parent", "parent_line")


def compile_calls(spark: SparkSession, _: str) -> DataFrame:
    return named_claims(sample_graph(spark)).where("predicate = 'CALLS'").groupBy("subject", "to_name", "object", "resolution").agg(F.count(F.lit(1)).alias("claims"))


def compile_imports(spark: SparkSession, _: str) -> DataFrame:
    return named_claims(sample_graph(spark)).where("predicate IN ('IMPORTS', 'EXTENDS')").groupBy("predicate", "subject", "to_name", "object", "resolution").agg(F.count(F.lit(1)).alias("claims"))


def compile_values(spark: SparkSession, _: str) -> DataFrame:
    graph = sample_graph(spark)
    cited = graph.claim_evidence.join(graph.evidence, "evidence_id").select("claim_id", "quote", "strength")
    return named_claims(graph).where("predicate = 'HAS_VALUE'").join(cited, "claim_id").select("subject", "object_literal", "quote", "strength")


def compile_diagnostics(spark: SparkSession, _: str) -> DataFrame:
    return graph_reads.diagnostics(sample_graph(spark)).groupBy("code", "severity", "rel_path").agg(F.count(F.lit(1)).alias("n"))


def module_names(spark: SparkSession, _: str) -> DataFrame:
    paths = ["top.py", "pkg/__init__.py", "pkg/sub/__init__.py", "pkg/sub/mod.py", "src/lib/__init__.py", "src/lib/a.py", "src/lib/deep/b.py", "tools/x.py", "a/b/c.py", "__init__.py"]
    return corpus.module_names(spark.createDataFrame([(p,) for p in paths], "rel_path string"))


def corpus_admission(spark: SparkSession, _: str) -> DataFrame:
    rows = [("a.py", b"x = 1\n"), ("../b.py", b"x"), ("/abs.py", b"x"), ("c.py", None), ("big.py", b"x" * (corpus.MAX_FILE_BYTES + 1)), ("edge.py", b"x" * corpus.MAX_FILE_BYTES), ("nul.py", b"a\0b"), ("late.py", b"x" * corpus.NUL_SCAN_BYTES + b"\0"), ("latin.py", b"\xe9"), ("doc.pdf", b"%PDF\0\xff"), ("e.TS", b""), ("no_suffix", b"x"), (".hidden", b"x")]
    files = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "rel_path string, content binary")
    return files.select("rel_path", F.coalesce(corpus.rejection(F.col("rel_path"), F.col("content")), F.lit("ADMITTED")).alias("code"), corpus.language(F.col("rel_path")).alias("language"), corpus.walked(F.col("rel_path")).alias("walked"))


EVIDENCE_CASES = [
    # name, artifact, locator kind, locator, quotation, expected strength or None
    ("range", "py", "byte_range", '{"byte_start":0,"byte_end":5}', "é = 1"[:4], "EXACT"),
    ("range text", "py", "byte_range", '{"byte_start":0,"byte_end":6}', "é = 2", None),
    ("range inside a character", "py", "byte_range", '{"byte_start":1,"byte_end":6}', "", None),
    ("range outside", "py", "byte_range", '{"byte_start":0,"byte_end":999}', "é", None),
    ("range without end", "py", "byte_range", '{"byte_start":0}', "é", None),
    ("node", "py", "ast_node", '{"path":"ClassDef:K/FunctionDef:f","node_type":"FunctionDef"}', "f", "EXACT"),
    ("node of another name", "py", "ast_node", '{"path":"ClassDef:K/FunctionDef:f","node_type":"FunctionDef"}', "g", None),
    ("node of another type", "py", "ast_node", '{"path":"ClassDef:K","node_type":"FunctionDef"}', "K", None),
    ("node that is not there", "py", "ast_node", '{"path":"ClassDef:L","node_type":"ClassDef"}', "L", None),
    ("pointer", "json", "json_pointer", '{"pointer":"/a/1/b~1c"}', "7", "EXACT"),
    ("pointer to another value", "json", "json_pointer", '{"pointer":"/a/0"}', "6", None),
    ("pointer out of range", "json", "json_pointer", '{"pointer":"/a/9"}', "5", None),
    ("pointer into a scalar", "json", "json_pointer", '{"pointer":"/a/0/x"}', "5", None),
    ("element", "xml", "xml_path", '{"path":"/r/item[2]"}', "two", "EXACT"),
    ("element that is not there", "xml", "xml_path", '{"path":"/r/item[3]"}', "two", None),
    ("element of hostile markup", "hostile", "xml_path", '{"path":"/r"}', "x", None),
    ("no verifier", "py", "image_box", "{}", "x", None),
    ("drifted", "drift", "byte_range", '{"byte_start":0,"byte_end":1}', "x", None),
    ("no artifact", "gone", "byte_range", '{"byte_start":0,"byte_end":1}', "x", None),
]
CONTENTS = {"py": "é = 1\nclass K:\n    def f(self):\n        pass\n".encode(), "json": b'{"a": [5, {"b/c": 7}]}', "xml": b"<r><item>one</item><item>t<b>w</b>o</item></r>", "hostile": b'<!DOCTYPE r [<!ENTITY e "x">]><r>&e;</r>', "drift": b"x"}


def evidence_kinds(spark: SparkSession, _: str) -> DataFrame:
    contents = spark.createDataFrame([(k, bytearray(v)) for k, v in CONTENTS.items()], "artifact_id string, content binary")
    rows = spark.createDataFrame([c[:5] for c in EVIDENCE_CASES], "evidence_id string, artifact_id string, locator_kind string, locator string, quote string")
    pinned = rows.join(contents, "artifact_id", "left").select("evidence_id", "artifact_id", F.when(F.col("artifact_id") == "drift", F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2("content", 256)).alias("artifact_sha256"), "locator_kind", "locator", "quote")
    return evidence.verify(pinned, contents).select(F.col("evidence_id").alias("case_name"), "strength", F.col("error").isNull().alias("verified"))


def graph_audit(spark: SparkSession, _: str) -> DataFrame:
    graph = sample_graph(spark)
    return audit.audit(graph.tables() | {"runs": spark.createDataFrame([("COMPLETE",), ("RUNNING",)], "status string")})


CLAIM_FIELDS = "claim_id string, predicate string, subject_id string, object_id string, object_literal string, lifecycle string, establishment string, model_id string, evidence_ids array<string>, rejected_reason string"
RULE_CASES = [
    ("fine", "CALLS", "s", "o", None, "ACTIVE", "DERIVED", None, ["exact"], None),
    ("no evidence", "CALLS", "s", "o", None, "ACTIVE", "DERIVED", None, [], None),
    ("missing evidence", "CALLS", "s", "o", None, "ACTIVE", "DERIVED", None, ["exact", "none"], None),
    ("structural only", "CALLS", "s", "o", None, "ACTIVE", "CONFIRMED", None, ["structural"], None),
    ("unverified proposal", "HAS_PURPOSE", "s", None, "p", "ACTIVE", "PROPOSED", "m", ["unverified"], None),
    ("proposal", "HAS_PURPOSE", "s", None, "p", "ACTIVE", "PROPOSED", "m", ["structural"], None),
    ("structural proposal", "CALLS", "s", "o", None, "ACTIVE", "PROPOSED", "m", ["exact"], None),
    ("derived by a model", "CALLS", "s", "o", None, "ACTIVE", "DERIVED", "m", ["exact"], None),
    ("value without a value", "HAS_VALUE", "s", None, "", "ACTIVE", "DERIVED", None, ["exact"], None),
    ("value that is a symbol", "HAS_VALUE", "s", "o", "3", "ACTIVE", "DERIVED", None, ["exact"], None),
    ("rejected", "CALLS", "s", "o", None, "REJECTED", "DERIVED", None, ["exact"], None),
]


def write_rules(spark: SparkSession, _: str) -> DataFrame:
    claims = spark.createDataFrame(RULE_CASES, CLAIM_FIELDS)
    strengths = spark.createDataFrame([("exact", "EXACT"), ("structural", "STRUCTURAL"), ("unverified", None)], "evidence_id string, strength string")
    return audit.violations(claims, strengths)


VALUE_CASES = [
    # left, right, verdict
    ("30", "30", "SAME"), ("30", "31", "DIFFERENT"), ("30 s", "30 seconds", "SAME"), ("1 min", "60 s", "SAME"), ("1500 ms", "1.5 s", "SAME"), ("2 h", "119 min", "DIFFERENT"), ("30", "30 s", "SAME"), ("30", "31 s", "UNRESOLVED"), ("5 bytes", "5 s", "UNRESOLVED"), ("5 bytes", "5 b", "SAME"), ("true", "True", "SAME"), ("true", "false", "DIFFERENT"), ("None", "null", "SAME"), ("none", "0", "DIFFERENT"), ("'a'", '"a"', "SAME"), ("'a'", "'b'", "DIFFERENT"), ("'30'", "30", "SAME"), ("'x y'", "30", "UNRESOLVED"), ("a.b.C", "C", "SAME"), ("C", "D", "DIFFERENT"), ("C", "'C'", "DIFFERENT"), ("3 to 4", "3", "UNRESOLVED"), ("5 apples", "5", "UNRESOLVED"), ("5 x", "5", "SAME"), ("", "5", "UNRESOLVED"), (None, None, "UNRESOLVED"), ("f(x)", "f(x)", "UNRESOLVED"), ("-1", "-1.0", "SAME"), (" 7 ", "7", "SAME"), ("v1", "v1", "SAME"),
]


def value_cases(spark: SparkSession, _: str) -> DataFrame:
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(VALUE_CASES)], "id int, a string, b string")
    return rows.select("id", values.compare(values.parse(F.col("a")), values.parse(F.col("b"))).alias("verdict"))


QUESTIONS = [
    # id, question, outcome, invariant
    ("q01", "what is the timeout of Cart", "EXPOSE", None),
    ("q02", "what is the mode of Signer in tools/twin.py", "EXPOSE_CONFLICTED", None),
    ("q20", "what is the mode of twin.Signer", "ABSTAIN_AMBIGUOUS", "INV-10_ambiguity"),
    ("q03", "what is the mode of Signer", "ABSTAIN_AMBIGUOUS", "INV-10_ambiguity"),
    ("q04", "what is the mode of Signer in tools/run.py", "EXPOSE", None),
    ("q05", "does shop.core.price call helper", "EXPOSE", None),
    ("q06", "does shop.core.price call clamp", "ABSTAIN", "INV-3_object"),
    ("q07", "what does Shop inherit from", "EXPOSE", None),
    ("q08", "which class does Base extend", "ABSTAIN", "INV-2_predicate"),
    ("q09", "what is the colour of Cart", "ABSTAIN", "INV-2_predicate"),
    ("q10", "what is the timeout of Nowhere", "ABSTAIN", "INV-1_subject"),
    ("q11", "how do I use Cart", "ABSTAIN", "INV-1_constraints"),
    ("q12", "hello there", "ABSTAIN", "INV-1_constraints"),
    ("q13", "Cart Basket", "ABSTAIN_AMBIGUOUS", "INV-10_ambiguity"),
    ("q14", "what is the timeout of Cart in nowhere.py", "ABSTAIN", "INV-4_scope"),
    ("q15", "what is the timeout of Cart '30'", "EXPOSE", None),
    ("q16", "what is the timeout of Cart '31'", "ABSTAIN", "INV-3_object"),
    ("q17", "shop.core.Base", "EXPOSE", None),
    ("q18", "does Signer call run in __init__.py", "ABSTAIN", "INV-1_subject"),
    ("q19", "what is the timeout of Cart in core.py", "EXPOSE", None),
]


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([q[:2] for q in QUESTIONS], "qid string, question string")


def question_constraints(spark: SparkSession, _: str) -> DataFrame:
    return questions.parse(_questions(spark)).select("qid", "status", "shape", "subject", "predicate", "property", "object", F.array_join("literals", ",").alias("literals"), "scope")


def decide_questions(spark: SparkSession, _: str) -> DataFrame:
    return decision.decide(_questions(spark), sample_graph(spark)).select("qid", "outcome", "invariant")


STRUCTURAL_CASES = [
    ("CALLS", "shop.core.price", "helper", "SUPPORTED"),
    ("CALLS", "shop.core.price", "clamp", "NOT_ESTABLISHED"),
    ("CONTAINS", "shop.core.Base", "x", "NOT_ESTABLISHED"),
    ("CONTAINS", "shop.core.Cart", "total", "SUPPORTED"),
    ("CONTAINS", "shop.core.Cart", "checkout", "EXPLICIT_CONTRADICTION"),
    ("EXTENDS", "Cart", "Base", "SUPPORTED"),
    ("EXTENDS", "shop.core.Cart", "dict", "EXPLICIT_CONTRADICTION"),
    ("WRITES", "shop.core.Cart", "x", "NOT_ESTABLISHED"),
]


def structural_verdicts(spark: SparkSession, _: str) -> DataFrame:
    return answers.structural(spark.createDataFrame([c[:3] for c in STRUCTURAL_CASES], "predicate string, subject string, object string"), sample_graph(spark))


def sample_contents(spark: SparkSession) -> DataFrame:
    files = samples.files(spark)
    return sample_graph(spark).artifacts.where("sha256 <> ''").select("artifact_id", "rel_path").join(files, "rel_path").select("artifact_id", "content")


def _replies(ids: dict[str, str]) -> list[tuple[str, str, str]]:
    """(id, reply, outcome); ids are of the evidence for the price function and for the Cart's timeout."""
    price, timeout = ids["shop.core.price"], ids["shop.core.Cart.TIMEOUT"]
    claim = lambda text, *cited, **more: {"text": text, "evidence_ids": list(cited)} | more
    import json

    body = lambda answer, *claims: json.dumps({"answer": answer, "claims": list(claims)})
    calls = lambda o: [{"predicate": "extends", "subject": "shop.core.Cart", "object": o}]
    return [
        ("r01", body("Price calls helper.", claim("price calls helper", price)), "ACCEPTED"),
        ("r02", "Sure:\n```json\n" + body("The timeout is 30.", claim("The timeout is 30", timeout, quote="TIMEOUT = 30")) + "\n```", "ACCEPTED"),
        ("r03", body("The timeout is 30.", claim("The timeout is 30", timeout, quote="TIMEOUT = 31")), "REJECTED"),
        ("r04", body("Price calls helper. It also encrypts files.", claim("price calls helper", price)), "REJECTED"),
        ("r05", body("Price calls helper.", claim("price calls helper", "f" * 32)), "REJECTED"),
        ("r06", body("Price calls helper.", claim("price calls helper")), "REJECTED"),
        ("r07", body("It cannot be established."), "REJECTED"),
        ("r08", "no idea", "REJECTED"),
        ("r09", body("Cart extends dict.", claim("Cart extends dict", timeout, structural_dependencies=calls("dict"))), "REJECTED"),
        ("r10", body("Cart extends Base.", claim("Cart extends Base", timeout, structural_dependencies=calls("Base"))), "ACCEPTED"),
        ("r11", body("Not retrieved.", claim("Not retrieved", ids["shop.core.helper"])), "REJECTED"),
        ("r12", '{"claims": []}', "REJECTED"),
    ]


def answers_validated(spark: SparkSession, _: str) -> DataFrame:
    graph = sample_graph(spark)
    spans = graph_reads.own_span(graph, _ids(graph, "shop.core.price", "shop.core.helper", "shop.core.Cart.TIMEOUT")).join(graph.symbols.select("symbol_id", "qname"), "symbol_id")
    ids = {r["qname"]: r["evidence_id"] for r in spans.collect()}  # three rows
    replies = _replies(ids)
    retrieved = spark.createDataFrame([(q, e) for q, *_ in replies for k, e in ids.items() if k != "shop.core.helper"], "qid string, evidence_id string")
    return answers.validate(spark.createDataFrame([r[:2] for r in replies], "qid string, body string"), retrieved, graph, sample_contents(spark)).select("qid", "outcome", "text")


def sample_statistics(spark: SparkSession, _: str) -> DataFrame:
    return graph_reads.statistics(sample_graph(spark)).where("measure IN ('artifacts', 'symbols', 'status', 'kind', 'predicate', 'resolution')")


def search_sample(spark: SparkSession, _: str) -> DataFrame:
    found = graph_reads.search_symbols(sample_graph(spark), "RUN")
    return found.select("qname", "kind", "rel_path", "location")


def sample_neighbourhood(spark: SparkSession, _: str) -> DataFrame:
    graph = sample_graph(spark)
    root = _ids(graph, "shop.core.price").first()["symbol_id"]
    found, _, truncated = graph_reads.neighbourhood(graph, root, 2, ("CALLS",))
    return found.join(graph.symbols.select("symbol_id", "qname"), "symbol_id").select("qname", "depth", F.lit(truncated).alias("truncated"))


def sample_expand(spark: SparkSession, _: str) -> DataFrame:
    return graph_reads.expand(sample_graph(spark), spark.createDataFrame([("shop.core.helper",)], "qname string"), 3, ("CALLS",)).select("qname", "depth", F.round("score", 6).alias("score"), "total_reachable", "truncated")


def sample_facts(spark: SparkSession, _: str) -> DataFrame:
    graph = sample_graph(spark)
    return graph_reads.facts(graph, _ids(graph, "shop.use.run")).select("predicate", "object", "resolved")


def sample_callees(spark: SparkSession, _: str) -> DataFrame:
    graph = sample_graph(spark)
    return graph_reads.callees(graph, _ids(graph, "shop.use.run"), 2).select("qname", "kind")


def purge_losses(spark: SparkSession, _: str) -> DataFrame:
    """What is left of each table, and what other files lose, once a file's graph is taken out."""
    graph = sample_graph(spark)
    left, lost = changes.purge(graph, graph.artifacts.where("rel_path = 'src/shop/core.py'"))
    audited = audit.audit(left.tables()).agg(F.sum("n").alias("n")).select(F.lit("broken rules").alias("what"), "n")
    kept = left.symbols.where("rel_path = 'src/shop/core.py'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("its symbols").alias("what"), "n")
    return lost.select(F.concat(F.lit("lost by "), "rel_path").alias("what"), F.col("lost").alias("n")).unionByName(audited).unionByName(kept)


def structured_records(spark: SparkSession, _: str) -> DataFrame:
    files = samples.files(spark).where(F.col("rel_path").rlike(r"\.(json|csv|xml|md)$"))
    return structured.chunks(files).where("locator <> ''").select("rel_path", "locator", "body")


SCOPES = [("core.py", "EXACT", "src/shop/core.py"), ("./src//shop/core.py", "EXACT", "src/shop/core.py"), ("src/core.py", "UNKNOWN", None), ("limits.json", "EXACT", "data/limits.json"), ("Core.py", "UNKNOWN", None), ("x/core.py", "UNKNOWN", None), ("same.py", "AMBIGUOUS", None), ("a/same.py", "EXACT", "a/same.py")]


def scope_resolution(spark: SparkSession, _: str) -> DataFrame:
    paths = [(p,) for p in samples.FILES] + [("a/same.py",), ("b/same.py",)]
    return identity.resolve_scopes(spark.createDataFrame([(s[0],) for s in SCOPES], "scope string"), spark.createDataFrame(paths, "rel_path string")).select("scope", "status", "path")


def sample_census(spark: SparkSession, _: str) -> DataFrame:
    return measures.literal_census(sample_graph(spark))


def sample_identity_audit(spark: SparkSession, _: str) -> DataFrame:
    return measures.identity_audit(sample_graph(spark))


def _chunks(spark: SparkSession) -> DataFrame:
    return written(rankers.symbol_chunks(sample_graph(spark), structured.chunks(samples.files(spark).where(~F.col("rel_path").endswith(".pyc")))), "chunks")


def rank_chunks(spark: SparkSession, _: str) -> DataFrame:
    """The first hits of every ranker for three questions; floats of a decomposition, so without an oracle in SQL."""
    asked = spark.createDataFrame([("a", "where is clamp called in Cart.total"), ("b", "default timeout seconds"), ("c", "zzz")], "qid string, question string")
    chunks, graph = _chunks(spark), sample_graph(spark)
    made = {"exact": rankers.exact(chunks, asked, 5), "lexical": rankers.lexical(chunks, asked, 5), "latent": rankers.latent(chunks, asked, 5, 16), "lexical and graph": rankers.lexical_and_graph(graph, chunks, asked, 5), "hybrid": rankers.hybrid(chunks, asked, 5), "spans": rankers.span_search(graph, asked, 5)}
    out = None
    for name, ranking in made.items():
        one = ranking.select(F.lit(name).alias("ranker"), "qid", "chunk_id", "rank", F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def support_gate(spark: SparkSession, _: str) -> DataFrame:
    chunks = spark.createDataFrame([("c1", "a.md", "the retry limit is 50 for payments"), ("c2", "b.md", "the retry limit is 70 for payments"), ("c3", "c.md", "fees are charged in the evening"), ("c4", "d.md", "routing of parcels"), ("c5", "e.md", "payments and parcels")], "chunk_id string, rel_path string, body string")
    asked = spark.createDataFrame([("g1", "what is the retry limit"), ("g2", "what are the fees '12'"), ("g3", "parcels of apac"), ("g4", "evening fees"), ("g5", "nothing at all")], "qid string, question string")
    hits = spark.createDataFrame([("g1", "c1", 1), ("g1", "c2", 2), ("g2", "c3", 1), ("g3", "c4", 1), ("g4", "c3", 1), ("g4", "c4", 2)], "qid string, chunk_id string, rank int")
    return support.gate(asked, hits, chunks, None, "G4").select("qid", "outcome", "failed", F.array_join("values", ",").alias("conflicting"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (compile_artifacts, compile_symbols, compile_calls, compile_imports, compile_values, compile_diagnostics, module_names, corpus_admission, evidence_kinds, graph_audit, write_rules, value_cases, question_constraints, decide_questions, structural_verdicts, answers_validated, sample_statistics, search_sample, sample_neighbourhood, sample_expand, sample_facts, sample_callees, purge_losses, structured_records, scope_resolution, sample_census, sample_identity_audit, rank_chunks, support_gate)}
