"""Figures of an evaluation: recall and rank, false support and abstention, outcomes by class, resolution of call sites.

Rates of nothing are null, so that none is mistaken for 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.compiler.compile import Graph

EXPOSED = ("EXPOSE", "EXPOSE_CONFLICTED")


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def retrieval(ranked: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (1, 5, 10), by: list[str] | None = None) -> DataFrame:
    """One row for each group of queries: their number, recall at each cut (share of queries with a relevant hit that early) and the
    mean reciprocal rank. ranked are (qid, item, rank), relevant (qid, item, groups...); a query that finds nothing counts 0."""
    queries = relevant.select("qid", *(by or [])).distinct()
    first = ranked.join(relevant.select("qid", "item").distinct(), ["qid", "item"], "left_semi").groupBy("qid").agg(F.min("rank").alias("rank"))
    rows = queries.join(first, "qid", "left")
    figures = [F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 4).alias(f"recall_{k}") for k in cuts), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr")]
    return rows.groupBy(*(by or [])).agg(*figures)


def gain(with_: DataFrame, without: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(qid, change): queries for which one ranking finds a relevant item among its first k and the other does not."""
    hit = lambda r: r.where(F.col("rank") <= k).join(relevant.select("qid", "item"), ["qid", "item"], "left_semi").select("qid").distinct()
    a, b = hit(with_).withColumn("a", F.lit(True)), hit(without).withColumn("b", F.lit(True))
    return a.join(b, "qid", "full").where("a IS NULL OR b IS NULL").select("qid", F.when(F.col("a").isNotNull(), "gained").otherwise("lost").alias("change"))


def abstention(decided: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of decisions (kind negative or positive, outcome, expected as an array, groups...): false support (negatives that were
    decided otherwise than expected), false abstention and acceptance of positives."""
    negative, positive = F.col("kind") == "negative", F.col("kind") == "positive"
    wrong = ~F.array_contains("expected", F.col("outcome"))
    n, p = F.count_if(negative), F.count_if(positive)
    return decided.groupBy(*(by or [])).agg(n.alias("negatives"), p.alias("positives"), rate(F.count_if(negative & wrong), n).alias("false_support"), rate(F.count_if(positive & (F.col("outcome") == "ABSTAIN")), p).alias("false_abstention"), rate(F.count_if(positive & (F.col("outcome") != "ABSTAIN")), p).alias("acceptance"))


def independent(decided: DataFrame, unsafe: tuple[str, ...]) -> DataFrame:
    """Of decisions (label, parse_status, outcome, invariant, answer_correct, all_trusted): parsing, safety and use of independent
    questions, as rows (measure, value)."""
    exposed, answerable = F.col("outcome").isin(*EXPOSED), F.col("label") == "answerable"
    bad, ambiguous = F.col("label").isin(*unsafe), F.col("label") == "ambiguous"
    n = F.count_if
    values = {
        "full_parse_rate": rate(n(F.col("parse_status") == "PARSED"), F.count(F.lit(1))),
        "full_parse_rate_answerable": rate(n(answerable & (F.col("parse_status") == "PARSED")), n(answerable)),
        "parser_caused_abstention": rate(n(answerable & (F.col("invariant") == "INV-1_constraints")), n(answerable)),
        "false_support": rate(n(bad & exposed), n(bad)),
        "unsafe_exposure": rate(n(bad & exposed & ~F.coalesce("all_trusted", F.lit(False))), n(bad)),
        "incorrect_resolution_on_ambiguous": rate(n(ambiguous & exposed), n(ambiguous)),
        "exposure_rate": rate(n(answerable & exposed), n(answerable)),
        "answer_correctness": rate(n(answerable & exposed & F.coalesce("answer_correct", F.lit(False))), n(answerable & exposed)),
        "useful_end_to_end": rate(n(answerable & exposed & F.coalesce("answer_correct", F.lit(False))), n(answerable)),
    }
    sums = decided.agg(*(v.alias(k) for k, v in values.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in values))).alias("x")).select("x.*")


def grounded_but_wrong(statements: DataFrame, wrong: tuple[str, ...]) -> DataFrame:
    """(answers, statements) that passed every check of their evidence and that judges found wrong all the same, of statements
    (qid, verdict, evidence_ok)."""
    answers = statements.groupBy("qid").agg(F.bool_and("evidence_ok").alias("ok"), F.count_if(F.col("verdict").isin(*wrong)).alias("wrong"))
    return answers.where("ok").agg(F.count_if(F.col("wrong") > 0).alias("answers"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("statements"))


def localisation(queries: DataFrame) -> DataFrame:
    """(qid, category) of answerable queries whose evidence was not found, from flags (qid, in_source, file_hit, chunk_holds,
    chunk_retrieved, evidence_hit)."""
    category = F.when(~F.col("in_source"), "GOLD_STRING_ISSUE").when(~F.col("file_hit"), "WRONG_FILE").when(~F.col("chunk_holds"), "CHUNK_TOO_NARROW").when(~F.col("chunk_retrieved"), "CHUNK_NOT_RETRIEVED").otherwise("RIGHT_FILE_NO_CHUNK")
    return queries.where(~F.col("evidence_hit")).select("qid", category.alias("category"))


def call_sites(graph: Graph, gold: DataFrame) -> DataFrame:
    """(id, outcome) of call sites (id, owner, call, expected, acceptable, forbidden): TP, WRONG_TARGET, UNDER (weaker than it could
    be), OVER (more than is warranted) or MISSING; of several calls of one text in one place the first by claim id counts."""
    names = graph.symbols.select("symbol_id", "qname")
    calls = graph.claims.where("predicate = 'CALLS'").join(names.select(F.col("symbol_id").alias("subject_id"), F.col("qname").alias("owner")), "subject_id").join(names.select(F.col("symbol_id").alias("object_id"), F.col("qname").alias("target")), "object_id", "left").join(graph.references, "claim_id")
    first = calls.groupBy("owner", F.col("to_name").alias("call")).agg(F.min_by(F.struct("resolution", "target"), "claim_id").alias("got"))
    rows = gold.join(first, ["owner", "call"], "left")
    got, target = F.col("got.resolution"), F.col("got.target")
    fine = F.coalesce(F.array_contains("acceptable", target), F.lit(False))
    outcome = (
        F.when(F.col("got").isNull(), "MISSING")
        .when(F.coalesce(F.array_contains("forbidden", target), F.lit(False)), "WRONG_TARGET")
        .when((F.col("expected") == "DETERMINISTIC") & (got == "DETERMINISTIC"), F.when(fine, "TP").otherwise("WRONG_TARGET"))
        .when((F.col("expected") == "UNRESOLVED") & (got == "UNRESOLVED"), "TP")
        .when((F.col("expected") == "HEURISTIC") & (got == "HEURISTIC"), "TP")
        .when((F.col("expected") == "HEURISTIC") & (got == "DETERMINISTIC"), F.when(fine, "TP").otherwise("WRONG_TARGET"))
        .when(F.col("expected") == "DETERMINISTIC", "UNDER")
        .otherwise("OVER")
    )
    return rows.select("id", outcome.alias("outcome"))


def literal_census(graph: Graph) -> DataFrame:
    """(measure, n): values stated by class bodies, how many of their evidence are verified, refusals, and symbols with several
    values."""
    stated = graph.claims.where("predicate = 'HAS_VALUE'")
    verified = stated.join(graph.claim_evidence, "claim_id").join(graph.evidence.where("strength IN ('EXACT', 'REPRODUCIBLE')"), "evidence_id").select("claim_id").distinct()
    several = stated.groupBy("subject_id").agg(F.count_distinct(F.coalesce("object_id", "object_literal")).alias("n")).where("n > 1")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")
    return reduce(DataFrame.unionByName, [one(stated, "stated"), one(verified, "verified"), one(graph.diagnostics.where("code = 'UNSUPPORTED_CLASS_LITERAL'"), "refused"), one(several, "symbols with several values")])


def identity_audit(graph: Graph) -> DataFrame:
    """(measure, n): names carried by several symbols of a file, parents that do not contain their children or whose name does
    not begin theirs, symbols without a parent, and claims whose evidence lies inside or outside their subject."""
    s = graph.symbols
    occurrences = s.groupBy("artifact_id", "qname").agg(F.count(F.lit(1)).alias("n"))
    p = s.select(F.col("symbol_id").alias("p"), F.col("artifact_id").alias("pa"), F.col("qname").alias("pq"), F.col("byte_start").alias("ps"), F.col("byte_end").alias("pe"))
    linked = s.join(p, F.col("parent_id") == F.col("p"))
    fine = (F.col("pa") == F.col("artifact_id")) & F.col("qname").startswith(F.concat("pq", F.lit("."))) & (F.col("ps") <= F.col("byte_start")) & (F.col("byte_end") <= F.col("pe"))
    subjects = s.join(occurrences, ["artifact_id", "qname"]).select(F.col("symbol_id").alias("subject_id"), F.col("byte_start").alias("b0"), F.col("byte_end").alias("b1"), "n")
    at = lambda k: F.get_json_object("locator", f"$.{k}").cast("long")
    cited = graph.claims.select("claim_id", "subject_id").join(subjects, "subject_id").join(graph.claim_evidence, "claim_id").join(graph.evidence.select("evidence_id", "locator"), "evidence_id")
    inside = (F.col("b0") <= at("byte_start")) & (at("byte_end") <= F.col("b1"))
    one = lambda df, **m: [df.agg(v.alias("n")).select(F.lit(k.replace("_", " ")).alias("measure"), F.coalesce("n", F.lit(0)).cast("long").alias("n")) for k, v in m.items()]
    parts = one(s, symbols=F.count(F.lit(1)), symbols_without_a_parent=F.count_if(F.col("parent_id").isNull() & (F.col("kind") != "module")))
    parts += one(occurrences, duplicate_names=F.count_if(F.col("n") > 1), symbols_sharing_a_name=F.sum(F.when(F.col("n") > 1, F.col("n"))))
    parts += one(linked, parents_that_do_not_contain=F.count_if(~fine))
    parts += one(cited, evidence_inside_the_subject=F.count_if(inside), evidence_outside_of_a_sole_name=F.count_if(~inside & (F.col("n") == 1)), evidence_outside_of_a_shared_name=F.count_if(~inside & (F.col("n") > 1)))
    return reduce(DataFrame.unionByName, parts)
