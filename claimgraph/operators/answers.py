"""Replies of a model against their contract and the graph: nothing is accepted that the sources do not bear out.

A reply is JSON with an answer and claims, each with the evidence it cites. It is accepted if every claim cites evidence
that exists, was retrieved for the question and still stands in the artifact, no asserted relation contradicts the
graph, and no sentence of the answer is missing among the claims. The text that is shown is composed of claims alone."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.compiler.compile import Graph
from claimgraph.functions import vocabulary
from claimgraph.functions.shared import written
from claimgraph.operators import evidence as evidence_op

_DEPENDENCY = pa.struct([("predicate", pa.string()), ("subject", pa.string()), ("object", pa.string())])
_CLAIM = pa.struct([("text", pa.string()), ("evidence_ids", pa.list_(pa.string())), ("quote", pa.string()), ("dependencies", pa.list_(_DEPENDENCY))])
REPLY = "qid string, error string, answer string, claims array<struct<text:string,evidence_ids:array<string>,quote:string,dependencies:array<struct<predicate:string,subject:string,object:string>>>>"
FENCE = "=" * 60


class ContractError(ValueError):
    """A reply that does not keep the contract."""


def json_object(body: str) -> dict:
    """The JSON object of a reply: the whole, without a code fence around it, or what stands between the outermost braces."""
    text = body.strip()
    if text.startswith("```"):
        text = re.sub(r"\n?```\s*$", "", re.sub(r"^```[a-zA-Z]*\n?", "", text))
    inside = re.search(r"\{.*\}", text, re.S)
    for candidate in (text, *([inside[0]] if inside else [])):
        try:
            return json.loads(candidate)
        except json.JSONDecodeError:
            continue
    raise ContractError("reply was not valid JSON" if inside else "reply contained no JSON object")


def reply(body: str) -> dict:
    """(answer, claims) of a reply. Relations that lack one of their three texts are left out; their predicate is
    upper-cased."""
    found = json_object(body)
    if not isinstance(found, dict) or not isinstance(found.get("answer"), str):
        raise ContractError("missing string field 'answer'")
    raw = found.get("claims")
    if raw is not None and not isinstance(raw, list):
        raise ContractError("'claims' must be a list")
    claims = []
    for i, c in enumerate(raw or []):
        if not isinstance(c, dict) or not isinstance(c.get("text"), str):
            raise ContractError(f"claim {i} has no 'text'")
        ids, relations = c.get("evidence_ids") or [], c.get("structural_dependencies") or []
        if not isinstance(ids, list) or not all(isinstance(x, str) for x in ids):
            raise ContractError(f"claim {i}: 'evidence_ids' must be a list of strings")
        if not isinstance(relations, list):
            raise ContractError(f"claim {i}: 'structural_dependencies' must be a list")
        fields = ("predicate", "subject", "object")
        whole = [r for r in relations if isinstance(r, dict) and all(isinstance(r.get(k), str) for k in fields)]
        quote = c.get("quote")
        claims.append({"text": c["text"], "evidence_ids": ids, "quote": quote if isinstance(quote, str) and quote else None, "dependencies": [{"predicate": r["predicate"].upper(), "subject": r["subject"], "object": r["object"]} for r in whole]})
    return {"answer": found["answer"], "claims": claims}


def parse(replies: DataFrame) -> DataFrame:
    """REPLY of (qid, body); error is null where the contract is kept."""
    schema = pa.schema([("qid", pa.string()), ("error", pa.string()), ("answer", pa.string()), ("claims", pa.list_(_CLAIM))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for qid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append({"qid": qid, "error": None, **reply(body or "")})
                except ContractError as e:
                    rows.append({"qid": qid, "error": str(e), "answer": None, "claims": []})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return replies.selectExpr("cast(qid as string) qid", "body").mapInArrow(run, REPLY)


def sentences(text: Column) -> Column:
    """What stands between ends of sentences, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def normalised(text: Column) -> Column:
    """Lower-cased words and digits of ASCII, one space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def uncovered(answer: Column, claim_texts: Column) -> Column:
    """Sentences of an answer that neither are, hold nor stand in the text of a claim."""
    claimed = F.filter(F.transform(claim_texts, lambda c: normalised(c)), lambda c: c != "")
    said = lambda n: F.exists(claimed, lambda c: (n == c) | F.contains(c, n) | F.contains(n, c))
    return F.filter(sentences(answer), lambda s: (normalised(s) != "") & ~said(normalised(s)))


def compose(claim_texts: Column) -> Column:
    """Claims as prose, each ended by a full stop if it has no end."""
    ended = F.transform(F.transform(claim_texts, lambda c: F.trim(c)), lambda c: F.when((c != "") & ~F.rlike(c, F.lit(r"[.!?]$")), F.concat(c, F.lit("."))).otherwise(c))
    return F.array_join(F.filter(ended, lambda c: c != ""), " ")


def structural(assertions: DataFrame, graph: Graph) -> DataFrame:
    """(predicate, subject, object, verdict) of assertions: SUPPORTED by a claim whose object it names, in full or by its last
    part; EXPLICIT_CONTRADICTION if the predicate is closed-world, claims of the subject exist, and all their artifacts were
    parsed without fault and without a symbol that lacks its parent; else NOT_ESTABLISHED."""
    wanted = assertions.select("predicate", "subject", "object").distinct().withColumn("last", F.substring_index("subject", ".", -1))
    unsure = graph.diagnostics.where("code = 'UNRESOLVED_PARENT_OCCURRENCE'").select("artifact_id").distinct().withColumn("unsure", F.lit(True))
    whole = graph.artifacts.join(unsure, "artifact_id", "left").select("artifact_id", ((F.col("status") == "OK") & F.col("unsure").isNull()).alias("whole"))
    subjects = graph.symbols.select(F.col("symbol_id").alias("subject_id"), F.col("qname").alias("sq"), F.col("name").alias("sn"), "artifact_id").join(whole, "artifact_id")
    objects = graph.symbols.select(F.col("symbol_id").alias("object_id"), F.col("qname").alias("oq"))
    claims = graph.claims.select(F.col("predicate").alias("p"), "subject_id", "object_id", "object_literal").join(subjects, "subject_id").join(objects, "object_id", "left").withColumn("named", F.coalesce("oq", "object_literal", F.lit("")))
    by_name = wanted.join(claims, (F.col("predicate") == F.col("p")) & (F.col("last") == F.col("sn")))
    by_qname = wanted.join(claims, (F.col("predicate") == F.col("p")) & (F.col("subject") == F.col("sq")) & (F.col("last") != F.col("sn")))
    end = lambda c: F.substring_index(c, ".", -1)
    meets = F.arrays_overlap(F.array("object", end("object")), F.array("named", end("named")))
    found = by_name.unionByName(by_qname).groupBy("predicate", "subject", "object").agg(F.bool_or(meets).alias("supported"), F.bool_and("whole").alias("whole"), F.count(F.lit(1)).alias("n"))
    closed = F.col("predicate").isin(*vocabulary.CLOSED_WORLD)
    verdict = F.when(F.col("supported"), "SUPPORTED").when(F.col("n").isNotNull() & closed & F.col("whole"), "EXPLICIT_CONTRADICTION").otherwise("NOT_ESTABLISHED")
    return wanted.drop("last").join(found, ["predicate", "subject", "object"], "left").select("predicate", "subject", "object", verdict.alias("verdict"))


def validate(replies: DataFrame, retrieved: DataFrame, graph: Graph, contents: DataFrame) -> DataFrame:
    """(qid, outcome, problems, text) of replies (qid, body): ACCEPTED with the composed text, or REJECTED with what is wrong,
    sorted. retrieved are (qid, evidence_id), contents (artifact_id, content)."""
    parsed = written(parse(replies), "replies")
    claims = parsed.select("qid", F.posexplode("claims").alias("k", "c")).select("qid", "k", "c.*")
    cited = claims.select("qid", "k", "quote", F.explode("evidence_ids").alias("evidence_id"))
    used = graph.evidence.join(cited.select("evidence_id").distinct(), "evidence_id", "left_semi")
    proofs = evidence_op.verify(used, contents).select("evidence_id", F.col("error").alias("fault"))
    stored = used.select("evidence_id", F.col("quote").alias("stored")).join(proofs, "evidence_id")
    got = retrieved.selectExpr("cast(qid as string) qid", "evidence_id", "true AS got").distinct()
    checked = cited.join(stored, "evidence_id", "left").join(got, ["qid", "evidence_id"], "left")
    why = (
        F.when(F.col("stored").isNull(), "no such evidence id in the store (fabricated citation)")
        .when(F.col("got").isNull(), "evidence exists but was not retrieved for this question")
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("quote").isNotNull() & ~F.contains("stored", F.trim("quote")), "quotation not found in cited bytes")
    )
    evidence = checked.groupBy("qid", "k").agg(F.bool_or(why.isNull()).alias("borne"), F.array_sort(F.collect_set(F.concat(F.lit("evidence "), F.substring("evidence_id", 1, 10), F.lit(": "), why))).alias("faults"))
    claimed = claims.join(evidence, ["qid", "k"], "left")
    unborne = claimed.select("qid", F.when(F.size("evidence_ids") == 0, "material statement with no evidence mapping").when(~F.col("borne"), F.array_join("faults", "; ")).alias("problem")).where("problem IS NOT NULL")
    asserted = claims.select("qid", F.explode("dependencies").alias("d")).select("qid", "d.*")
    denied = asserted.join(structural(asserted, graph).where("verdict = 'EXPLICIT_CONTRADICTION'"), ["predicate", "subject", "object"]).select("qid", F.concat(F.lit("structural assertion "), "predicate", F.lit("("), "subject", F.lit(", "), "object", F.lit(") is contradicted by the compiled graph")))
    loose = parsed.select("qid", F.explode(uncovered(F.col("answer"), F.col("claims.text"))).alias("s")).select("qid", F.concat(F.lit("the answer contains a statement that is not among the claims: "), F.substring("s", 1, 90)))
    empty = parsed.where("error IS NULL AND size(claims) = 0").select("qid", F.lit("the reply made no evidence-backed statement"))
    broken = parsed.where("error IS NOT NULL").select("qid", "error")
    problems = unborne.union(denied).union(loose).union(empty).union(broken).groupBy("qid").agg(F.array_sort(F.collect_set("problem")).alias("problems"))
    # A reply without claims is an honest "cannot tell"; its sentences are not held against it besides.
    rows = parsed.join(problems, "qid", "left").withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))
    rows = rows.withColumn("problems", F.when(F.col("error").isNull() & (F.size("claims") == 0), F.array(F.lit("the reply made no evidence-backed statement"))).otherwise(F.col("problems")))
    good = F.size("problems") == 0
    return rows.select("qid", F.when(good, "ACCEPTED").otherwise("REJECTED").alias("outcome"), "problems", F.when(good, compose(F.col("claims.text"))).alias("text"))


def rendered(spans: DataFrame) -> DataFrame:
    """(qid, evidence) of spans (qid, position, evidence_id, rel_path, symbol, how, quote): blocks in order, each fenced and
    labelled as data that is not trusted."""
    block = F.concat(F.lit(f"{FENCE}\nSOURCE EVIDENCE  id="), "evidence_id", F.lit("\nfile: "), "rel_path", F.lit("   symbol: "), F.coalesce("symbol", F.lit("")), F.lit("   found by: "), "how", F.lit("\n--- begin untrusted source content ---\n"), "quote", F.lit("\n--- end untrusted source content ---"))
    return spans.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", block.alias("block")))), lambda x: x["block"]), "\n").alias("evidence"))


def consensus(judgements: DataFrame, order: list[str]) -> DataFrame:
    """(item, label, unanimous) of judgements (item, judge, label): the common label, else the worse one, `order` being from the
    worst to the best; labels outside it are the best of all."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("label")), F.lit(0)), F.lit(len(order) + 1))
    return judgements.groupBy("item").agg(F.min_by("label", F.struct(rank, "label")).alias("label"), (F.count_distinct("label") == 1).alias("unanimous"))
