"""The compiler, its store and its readers on small corpora written here."""

import io
import json
import os
import threading
import urllib.error
import urllib.request
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from claimgraph import cli, web
from claimgraph.compiler import corpus, documents, python_source, structured
from claimgraph.compiler.compile import compile_files
from claimgraph.operators import answers, asking, evidence, graph_reads, measures, rankers, support, text, values, vectors
from claimgraph.plans import sample_queries
from claimgraph.sources import uploads
from claimgraph.store import audit, changes
from claimgraph.store.snapshots import RuleBroken, Snapshots
from claimgraph.streaming import ingest


@pytest.fixture(scope="module")
def graph(spark):
    return sample_queries.sample_graph(spark)


def make(spark, files):
    return spark.createDataFrame([(p, bytearray(t if isinstance(t, bytes) else t.encode())) for p, t in files.items()], "rel_path string, content binary")


def named(graph):
    return sample_queries.named_claims(graph)


def test_compiling_again_gives_the_same_rows(spark):
    files = make(spark, {"a.py": "class A:\n    X = 1\n", "b.py": "from a import A\nA()\n"})
    one, two = compile_files(files, "u").tables(), compile_files(files.orderBy(F.col("rel_path").desc()), "u").tables()
    assert all(changes.same_rows(one[k], two[k]) for k in one)
    assert [tuple(r) for r in changes.digest(one).collect()] == [tuple(r) for r in changes.digest(two).collect()]
    other = compile_files(make(spark, {"a.py": "class A:\n    X = 2\n", "b.py": "from a import A\nA()\n"}), "u")
    assert not changes.same_rows(one["claims"], other.claims)


def test_edge_files(spark):
    g = compile_files(make(spark, {"deep.py": "x = " + "(" * 60 + "1" + ")" * 60, "crlf.py": "def f():\r\n    return 1\r\n", "form.py": "a = 1\x0cb = 2\n", "bom.py": "\ufeffx = 1\n"}), "u")
    assert {r.rel_path: r.status for r in g.artifacts.collect()}["crlf.py"] == "OK"
    f = g.symbols.where("qname = 'crlf.f'").first()
    assert (f.byte_start, f.byte_end) == (0, 22)
    contents = g.artifacts.join(make(spark, {"deep.py": "x = " + "(" * 60 + "1" + ")" * 60, "crlf.py": "def f():\r\n    return 1\r\n", "form.py": "a = 1\x0cb = 2\n", "bom.py": "\ufeffx = 1\n"}), "rel_path").select("artifact_id", "content")
    assert evidence.verify(g.evidence, contents).where("error IS NOT NULL").count() == 0
    empty = compile_files(make(spark, {"x.py": ""}).limit(0), "u")
    assert all(df.count() == 0 for df in empty.tables().values())


def test_sample_evidence_is_verified_and_drift_is_seen(spark, graph):
    contents = sample_queries.sample_contents(spark)
    found = evidence.verify(graph.evidence, contents)
    assert found.where("strength = 'EXACT'").count() == graph.evidence.count()
    drifted = contents.select("artifact_id", F.concat(F.col("content"), F.lit(b" ")).alias("content"))
    assert evidence.verify(graph.evidence, drifted).where("error LIKE 'artifact content drifted%'").count() == graph.evidence.count()


def test_shadowing_and_deep_imports(spark):
    g = compile_files(make(spark, {"p/__init__.py": "", "p/q/__init__.py": "", "p/q/m.py": "from ..n import f\nfrom . import k\nimport p.n\n\n\ndef f():\n    return f(), k.g(), p.n.f()\n", "p/q/k.py": "def g():\n    pass\n", "p/n.py": "def f():\n    pass\n"}), "u")
    calls = {(r.to_name, r.object, r.resolution) for r in named(g).where("predicate = 'CALLS'").collect()}
    assert calls == {("f", "p.q.m.f", "DETERMINISTIC"), ("k.g", "p.q.k.g", "DETERMINISTIC"), ("p.n.f", "p.n.f", "DETERMINISTIC")}


def test_duplicates_never_get_an_arbitrary_owner(spark):
    g = compile_files(make(spark, {"d.py": "def outer():\n    def same():\n        return a()\n    def same():\n        return b()\n\n\nif 1:\n    def twin(): return c()\nelse:\n    def twin(): return d()\n\n\n@deco(twin())\ndef late(x=twin()):\n    pass\n"}), "u")
    owners = {(r.to_name, r.line_start) for r in named(g).where("predicate = 'CALLS'").join(g.symbols.select(F.col("symbol_id").alias("subject_id"), "line_start"), "subject_id").collect()}
    assert {("a", 2), ("b", 4), ("c", 9), ("d", 11)} <= owners
    assert {r.to_name: r.resolution for r in named(g).where("to_name = 'twin'").collect()} == {"twin": "UNRESOLVED"}
    assert audit.audit(g.tables()).where("n > 0").count() == 0


def docx(*paragraphs, table=None, extra=""):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    if table:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in table) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'{extra}<w:document {w}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_word_documents(spark):
    assert documents.units(docx("One", "", "Three &amp; more", table=[["a", "b"], ["c", "d"]])) == [("paragraph", 0, "One"), ("paragraph", 2, "Three & more"), ("table", 0, "a\tb\nc\td")]
    files = make(spark, {"d/report.docx": docx("Timeout is 30", "Second"), "bad.docx": b"no archive", "bomb.docx": docx("x", extra='<!DOCTYPE w [<!ENTITY e "x">]>'), "void.docx": docx(""), "p.pdf": b"%PDF"})
    g = compile_files(files, "u")
    assert {r.rel_path: r.status for r in g.artifacts.collect()} == {"d/report.docx": "OK", "bad.docx": "FAILED", "bomb.docx": "FAILED", "void.docx": "FAILED", "p.pdf": "FAILED"}
    assert {r.code for r in g.diagnostics.collect()} == {"DOCX_UNREADABLE", "TEXT_UNAVAILABLE", "ADAPTER_UNAVAILABLE"}
    contents = g.artifacts.join(files, "rel_path").select("artifact_id", "content")
    checked = evidence.verify(g.evidence, contents).collect()
    assert len(checked) == 2 and {r.strength for r in checked} == {"REPRODUCIBLE"}
    assert audit.audit(g.tables()).where("n > 0").count() == 0


def test_walk_and_links(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    for path, body in {"a.py": "x = 1\n", "pkg/__init__.py": "", "pkg/b.py": "y = 2\n", ".git/c.py": "", "node_modules/d.py": "", "e.pyc": "", "notes.md": "hi"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    outside.mkdir()
    (outside / "secret.py").write_text("z = 3\n")
    os.symlink(outside / "secret.py", root / "escape.py")
    os.symlink(outside, root / "linked")
    got = {r.rel_path: r.status for r in corpus.artifacts(corpus.read_folder(spark, str(root)), "u").collect()}
    assert got == {"a.py": None, "pkg/__init__.py": None, "pkg/b.py": None, "notes.md": "UNSUPPORTED", "../escape.py": "SKIPPED"}
    assert corpus.contained(root, "pkg/b.py").name == "b.py"
    for bad in ("../outside/secret.py", "escape.py", "/etc/passwd"):
        with pytest.raises(ValueError):
            corpus.contained(root, bad)


def broken(graph, spark):
    """The graph with one row against each rule."""
    c, s, a = graph.claims, graph.symbols, graph.artifacts
    some = c.where("predicate = 'CALLS' AND object_id IS NOT NULL").orderBy("claim_id")
    row = lambda **new: some.limit(1).select(*(F.lit(new[k]).cast(t).alias(k) if k in new else F.col(k) for k, t in c.dtypes))
    bad = [row(claim_id="none", evidence_ids=F.array()), row(claim_id="missing", evidence_ids=F.array(F.lit("nowhere"))), row(claim_id="proposed", establishment="PROPOSED"), row(claim_id="model", model_id="m"), row(claim_id="value", predicate="HAS_VALUE"), row(claim_id="subject", subject_id="nowhere"), row(claim_id="object", object_id="nowhere")]
    for b in bad:
        c = c.unionByName(b)
    failed = a.where("rel_path = 'src/shop/core.py'").select("artifact_id")
    outcome = failed.select("artifact_id", F.lit("FAILED").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(1).alias("at"))
    refs = graph.references.unionByName(spark.createDataFrame([("gone", "x", "DETERMINISTIC", "r")], graph.references.schema))
    flip = F.when(F.col("to_name") == "util.clamp", "UNRESOLVED").when(F.col("to_name") == "missing", "DETERMINISTIC").otherwise(F.col("resolution"))
    moved = s.withColumn("byte_end", F.when(F.col("qname") == "shop.use.Shop", F.lit(1).cast("long")).otherwise(F.col("byte_end")))
    loose = graph.evidence.limit(1).withColumn("evidence_id", F.lit("loose"))
    quiet = graph.diagnostics.join(failed, "artifact_id", "left_anti")
    return replace(graph, claims=c, artifacts=changes.set_status(a, outcome), references=refs.withColumn("resolution", flip), symbols=moved, evidence=graph.evidence.unionByName(loose), diagnostics=quiet)


def test_audit_sees_every_rule(spark, graph):
    found = {r.rule: r.n for r in audit.audit(broken(graph, spark).tables() | {"runs": spark.createDataFrame([("RUNNING",)], "status string")}).collect()}
    assert len(found) == 17 and all(n > 0 for n in found.values()), found


def test_purge_replace_and_queue(spark, graph):
    core = graph.artifacts.where("rel_path = 'src/shop/util.py'")
    left, lost = changes.purge(graph, core)
    assert {(r.rel_path, r.lost) for r in lost.collect()} == {("src/shop/core.py", 3)}
    assert audit.audit(left.tables()).where("n > 0").count() == 0
    again = changes.replace_claims(graph, core, graph)
    assert all(changes.same_rows(a, b) for a, b in zip(again.tables().values(), graph.tables().values(), strict=True))
    fewer = replace(graph, claims=graph.claims.where("predicate = 'CONTAINS'"))
    replaced = changes.replace_claims(graph, core, fewer)
    assert named(replaced).where("subject LIKE 'shop.util%' AND predicate <> 'CONTAINS'").count() == 0
    assert audit.audit(replaced.tables()).where("n > 0").count() == 0
    assert [r.rel_path for r in changes.uncovered(spark.createDataFrame([("a",), ("src/shop/core.py",)], "rel_path string"), graph.artifacts).collect()] == ["a"]
    runs = spark.createDataFrame([("r1", "COMPLETE", 3), ("r2", "RUNNING", 1), ("r3", "INTERRUPTED", 2)], "run_id string, status string, started_at int")
    assert [r.run_id for r in changes.resumable(runs).collect()] == ["r3"]


def test_snapshots_commit_whole_graphs_or_nothing(spark, graph, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    assert store.read() is None
    assert store.commit(graph) == 1 and store.commit(graph) == 2 and store.versions() == [1, 2]
    assert changes.same_rows(store.read(1).claims, graph.claims)
    with pytest.raises(RuleBroken, match="has no evidence"):
        store.commit(replace(graph, claims=graph.claims.withColumn("evidence_ids", F.array().cast("array<string>"))))
    assert store.versions() == [1, 2]


def test_command_line(spark, tmp_path, capsys):
    root, store = tmp_path / "src", str(tmp_path / "store")
    root.mkdir()
    (root / "m.py").write_text("class Abc:\n    LIMIT = 3\n\n\ndef f():\n    return Abc()\n")
    assert cli.main(["stats", "--store", store], spark) == 1
    assert cli.main(["ingest", str(root), "--store", store], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert (report["seen"], report["status"], report["unchanged"]) == (1, {"OK": 1}, False)
    assert cli.main(["ingest", str(root), "--store", store], spark) == 0 and json.loads(capsys.readouterr().out)["unchanged"]
    assert cli.main(["verify", "--store", store], spark) == 0 and "OK" in capsys.readouterr().out
    assert cli.main(["show", "m.f", "--store", store], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["object"] == "m.Abc"
    assert cli.main(["show", "m.g", "--store", store], spark) == 1
    assert cli.main(["decide", "what is the limit of Abc", "--store", store], spark) == 0
    assert '"outcome":"EXPOSE"' in capsys.readouterr().out
    for command in (["stats"], ["search", "lim"], ["expand", "m.f"], ["diagnostics"], ["ask", "what is the limit of Abc", str(root)]):
        assert cli.main([*command, "--store", store], spark) == 0
    (root / "n.py").write_text("import m\n")
    ingest.ingest_files(spark, str(root), s := Snapshots(spark, store), str(tmp_path / "offsets"))
    assert s.versions() == [1, 2] and s.read().artifacts.count() == 2
    ingest.ingest_files(spark, str(root), s, str(tmp_path / "offsets2"))
    assert s.versions() == [1, 2]


def test_asking(spark, graph):
    contents = sample_queries.sample_contents(spark)
    assert asking.ask("what does Signer do", graph, contents).status == "ABSTAIN_AMBIGUOUS"
    assert asking.ask("zzz qqq", graph, contents).reason.startswith("no source evidence")
    found = asking.ask("what is Cart.TIMEOUT", graph, contents)
    assert found.status == "ABSTAIN" and found.spans[0]["quote"] == "TIMEOUT = 30"
    cited = found.spans[0]["evidence_id"]
    good = json.dumps({"answer": "It is 30.", "claims": [{"text": "It is 30", "evidence_ids": [cited], "quote": "30"}]})
    model = asking.Scripted(["nonsense", good])
    answer = asking.ask("what is Cart.TIMEOUT", graph, contents, model)
    assert (answer.status, answer.text, answer.attempts) == ("ANSWER", "It is 30.", 2)
    assert "REJECTED" in model.seen[1][1]["content"] and "untrusted" in model.seen[0][1]["content"]
    assert asking.ask("what is Cart.TIMEOUT", graph, contents, asking.Scripted(["x", "y"])).status == "ABSTAIN"


def test_cache_asks_once(tmp_path):
    cached = asking.Cached(asking.Scripted(["one", "two"]), str(tmp_path))
    assert [cached.chat([{"role": "user", "content": c}]) for c in "aab"] == ["one", "one", "two"] and cached.hits == 1


def test_contract():
    assert answers.reply('x {"answer": "a", "claims": null} y') == {"answer": "a", "claims": []}
    for bad in ("", "{", "[]", '{"answer": 1}', '{"answer": "a", "claims": {}}', '{"answer": "a", "claims": [{}]}', '{"answer": "a", "claims": [{"text": "t", "evidence_ids": [1]}]}'):
        with pytest.raises(answers.ContractError):
            answers.reply(bad)


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"), ("triplicate", "triplic"), ("electrical", "electr"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll")])
def test_porter_stems_of_the_paper(word, stem):
    assert rankers.porter(word) == stem


def test_tokens_and_stems(spark):
    row = spark.range(1).select(text.tokens(F.lit("sendFromDirectory the MAX_SIZE of x 42")).alias("t"), F.transform(F.array(*map(F.lit, ["imports", "queries", "running", "as", "ones"])), text.stem).alias("s"), text.candidate_identifiers(F.lit("how does MapAdapter.build use URL and foo_bar or foo_bar")).alias("c"), text.overlap_tier(F.lit("imports fees"), F.lit("import of things")).alias("o")).first()
    assert row.t == ["sendfromdirectory", "send", "directory", "max_size", "max", "size", "42"]
    assert row.s == ["import", "query", "runn", "as", "one"] and row.c == ["MapAdapter.build", "foo_bar"] and row.o == "partial"


def test_structured_readers():
    for hostile in (b'<!DOCTYPE a><a/>', b'<!DOCTYPE a [<!ENTITY e SYSTEM "file:///etc/passwd">]><a>&e;</a>', b"<a>", b""):
        with pytest.raises((ValueError, IndexError)):
            structured.parse_xml(hostile)
    assert structured.all_text(structured.parse_xml(b"<a>x<b>y</b>z</a>")) == "xyz"
    with pytest.raises(ValueError):
        structured.parse_json(b" " * (structured.MAX_JSON_BYTES + 1))
    assert structured.records("x.json", "not json") == [("", "not json")]


def test_calibration_and_measures(spark):
    rows = [(50, 0.2, 0.5), (60, 0.3, 0.3), (70, 0.3, 0.2), (80, 0.3, 0.2)]
    schema = "theta int, false_support double, false_abstention double"
    assert support.calibrated(spark.createDataFrame(rows, schema)).first().theta == 70
    assert support.calibrated(spark.createDataFrame([(50, 0.2, 0.9), (60, 0.1, 0.8)], schema)).first().theta == 60
    decided = spark.createDataFrame([("negative", "EXPOSE", ["ABSTAIN"]), ("negative", "ABSTAIN", ["ABSTAIN"]), ("positive", "ABSTAIN", ["EXPOSE"]), ("positive", "EXPOSE", ["EXPOSE"])], "kind string, outcome string, expected array<string>")
    assert tuple(measures.abstention(decided).first()) == (2, 2, 0.5, 0.5, 0.5)
    assert measures.abstention(decided.limit(0)).first().false_support is None
    statements = spark.createDataFrame([("a", "SUPPORTED", True), ("a", "UNSUPPORTED", True), ("b", "UNSUPPORTED", False)], "qid string, verdict string, evidence_ok boolean")
    assert tuple(measures.grounded_but_wrong(statements, ("UNSUPPORTED",)).first()) == (1, 1)
    flags = spark.createDataFrame([("a", False, True, True, True, False), ("b", True, False, True, True, False), ("c", True, True, False, False, False), ("d", True, True, True, False, False), ("e", True, True, True, True, False), ("f", True, True, True, True, True)], "qid string, in_source boolean, file_hit boolean, chunk_holds boolean, chunk_retrieved boolean, evidence_hit boolean")
    assert {r.qid: r.category for r in measures.localisation(flags).collect()} == {"a": "GOLD_STRING_ISSUE", "b": "WRONG_FILE", "c": "CHUNK_TOO_NARROW", "d": "CHUNK_NOT_RETRIEVED", "e": "RIGHT_FILE_NO_CHUNK"}
    questions = spark.createDataFrame([("answerable", "PARSED", "EXPOSE", None, True, True), ("answerable", "UNPARSEABLE", "ABSTAIN", "INV-1_constraints", None, None), ("ambiguous", "PARSED", "EXPOSE", None, None, True), ("unsupported", "PARSED", "ABSTAIN", "INV-2_predicate", None, None)], "label string, parse_status string, outcome string, invariant string, answer_correct boolean, all_trusted boolean")
    got = {r.measure: r.value for r in measures.independent(questions, ("ambiguous", "unsupported")).collect()}
    assert (got["full_parse_rate"], got["parser_caused_abstention"], got["false_support"], got["unsafe_exposure"], got["useful_end_to_end"]) == (0.75, 0.5, 0.5, 0.0, 0.5)


def test_call_sites(spark, graph):
    gold = [("1", "shop.core.price", "helper", "DETERMINISTIC", ["shop.core.helper"], []), ("2", "shop.core.helper", "os.path.join", "UNRESOLVED", [], []), ("3", "shop.use.run", "price", "HEURISTIC", ["shop.core.price"], []), ("4", "shop.use.run", "Basket", "DETERMINISTIC", ["shop.core.Cart"], []), ("5", "shop.use.run", "c.price", "UNRESOLVED", [], []), ("6", "shop.use.run", "nothing", "UNRESOLVED", [], []), ("7", "shop.core.price", "helper", "DETERMINISTIC", [], ["shop.core.helper"])]
    got = measures.call_sites(graph, spark.createDataFrame(gold, "id string, owner string, call string, expected string, acceptable array<string>, forbidden array<string>"))
    assert {r.id: r.outcome for r in got.collect()} == {"1": "TP", "2": "TP", "3": "TP", "4": "UNDER", "5": "OVER", "6": "MISSING", "7": "WRONG_TARGET"}


def test_neighbourhood_says_what_it_cuts(spark, graph):
    root = graph.symbols.where("qname = 'shop.core.Cart'").first().symbol_id
    nodes, edges, truncated = graph_reads.neighbourhood(graph, root, 1)
    assert not truncated and nodes.count() == 16 and edges.count() == 16
    nodes, edges, truncated = graph_reads.neighbourhood(graph, root, 2, limit=5)
    assert truncated and nodes.count() == 5
    nodes, edges, truncated = graph_reads.neighbourhood(graph, root, 1, ("NO_EDGE",))
    assert nodes.count() == 16


def test_value_parsing_of_nothing(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",), ("a b c",), ("1 2",)], "t string").select(values.parse(F.col("t")).isNull().alias("n")).collect()
    assert all(r.n for r in rows)


def test_vectors_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(200, [0.0] * 8), (201, None), (202, [1.0] * 8), (203, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, two = (sorted(map(tuple, vectors.cosine_topk_all(df, df.where("vec_id % 20 = 0"), 5, block).collect())) for block in (1000, 3))
    assert one == two and len(one) == 50
    m = {i: np.array(v) for i, v in rows if v is not None and any(v)}
    for q in (0, 140):
        want = sorted(((-round(float(m[q] @ v / np.linalg.norm(m[q]) / np.linalg.norm(v)), 6), i) for i, v in m.items() if i != q))[:5]
        assert [(r[1], r[2]) for r in sorted((r for r in one if r[0] == q), key=lambda r: r[3])] == [(i, -c) for c, i in want]


def test_reading_is_linear_in_depth():
    nested = "".join(f"{' ' * i}def f{i}():\n" for i in range(60)) + " " * 60 + "pass\n"
    assert sum(r["record"] == "symbol" for r in python_source.read_module(nested.encode(), "m")) == 61


def archive(members, link=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
        if link:
            info = zipfile.ZipInfo(link)
            info.external_attr = 0o120777 << 16
            z.writestr(info, "/etc/passwd")
    return out.getvalue()


def test_uploads(tmp_path, monkeypatch):
    root = tmp_path / "root"
    monkeypatch.setattr(uploads, "MAX_MEMBER", 200)
    got = uploads.unpack(archive({"a/b.py": "x = 1", "notes.md": "hi", "../up.py": "", "/abs.py": "", "C:/d.py": "", "big.py": "y" * 300}, "link.py"), root)
    assert {r.path: r.status for r in got} == {"a/b.py": "ACCEPTED", "notes.md": "UNSUPPORTED", "../up.py": "REJECTED", "/abs.py": "REJECTED", "C:/d.py": "REJECTED", "big.py": "REJECTED", "link.py": "REJECTED"}
    assert sorted(p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file()) == ["a/b.py", "notes.md"]
    assert uploads.take_file("../../evil.py", b"x", root).path == "evil.py" and (root / "evil.py").exists()
    os.symlink(tmp_path, root / "out")
    with pytest.raises(uploads.Refused):
        uploads.destination(root, "out/x.py")
    for limit, value in (("MAX_FILES", 1), ("MAX_TOTAL", 3), ("MAX_ARCHIVE", 10)):
        with monkeypatch.context() as m:
            m.setattr(uploads, limit, value)
            with pytest.raises(uploads.Refused):
                uploads.unpack(archive({"a.py": "x = 1", "b.py": "y = 2"}), root)
    with pytest.raises(uploads.Refused):
        uploads.unpack(b"no archive", root)


def test_http(spark, tmp_path):
    root = tmp_path / "root"
    service = web.Service(spark, Snapshots(spark, str(tmp_path / "store")), str(root))
    server = web.serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}/api/"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data=body), timeout=300) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("stats")[0] == 404
        code, said = call("upload?name=code.zip", archive({"m.py": "class Abc:\n    LIMIT = 3\n\n\ndef f():\n    return Abc()\n", "../x.py": ""}))
        assert code == 200 and [f["status"] for f in said["files"]] == ["ACCEPTED", "REJECTED"] and said["commit"]["version"] == 1
        assert call("upload?name=bad.zip", b"nothing")[0] == 400
        found = call("search?q=abc")[1]
        assert found[0]["qname"] == "m.Abc"
        node = call(f"node/{found[0]['symbol_id']}")[1]
        assert node["neighbours"] == {"CALLS": 1, "CONTAINS": 2}
        near = call(f"neighbourhood/{found[0]['symbol_id']}?hops=1&predicates=CALLS")[1]
        assert [n["qname"] for n in near["nodes"]] == ["m.Abc", "m.f"]
        edge = call(f"edge/{near['edges'][0]['claim_id']}")[1]
        assert edge["object"] == "m.Abc" and call(f"evidence/{edge['evidence'][0]['evidence_id']}")[1]["quote"] == "Abc()"
        assert call("decide", b'{"question": "what is the limit of Abc"}')[1]["outcome"] == "EXPOSE"
        assert call("ask", b'{"question": "what is Abc.LIMIT"}')[1]["spans"][0]["quote"] == "LIMIT = 3"
        assert [call(p, b)[0] for p, b in (("node/none", None), ("nothing", None), ("ask", b"{}"), ("ask", b"["), ("nothing", b"{}"))] == [404, 404, 400, 400, 404]
    finally:
        server.shutdown()
        server.server_close()
