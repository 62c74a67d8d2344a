"""Whether a question may be answered from compiled claims, and if not, which rule forbids it.

The rules form a ladder; what passes one is tested by the next, and the first rung that nothing passes names the invariant.
All questions go down the ladder together: one row for each question and claim with a flag for each rung, then one
aggregate for each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.compiler.compile import Graph
from claimgraph.functions import vocabulary
from claimgraph.functions.shared import written
from claimgraph.operators import questions as q
from claimgraph.operators.identity import canonical, resolve_scopes, symbols_named
from claimgraph.operators.values import conflicts


def hits(graph: Graph) -> DataFrame:
    """Claims with the names of their ends and one piece of their evidence, that of the least id."""
    cited = graph.claim_evidence.join(graph.evidence.select("evidence_id", "artifact_id", "quote", "strength"), "evidence_id").join(graph.artifacts.select("artifact_id", "rel_path"), "artifact_id")
    first = cited.groupBy("claim_id").agg(F.min(F.struct("evidence_id", "quote", "strength", "rel_path")).alias("e")).select("claim_id", "e.*")
    names = graph.symbols.select("symbol_id", "qname")
    return graph.claims.join(first, "claim_id").join(names.select(F.col("symbol_id").alias("object_id"), F.col("qname").alias("object_name")), "object_id", "left")


def matches_property(name: Column, wanted: Column) -> Column:
    """Whether a child's name is the property word, holds it, or holds all of its parts of more than two characters."""
    low = F.lower(name)
    words = F.filter(F.split(wanted, "_"), lambda w: F.length(w) > 2)
    return (low == wanted) | F.contains(low, wanted) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(low, w)))


def _gathered(parsed: DataFrame, subjects: DataFrame, graph: Graph) -> DataFrame:
    """(qid, claim_id) that bear on a question: claims of its relation, of its property's symbols, or of the subject."""
    rows = parsed.select("qid", "shape", "predicate", "property").join(subjects.select("qid", "symbol_id"), "qid")
    relation = (F.col("shape") == "relation") & F.col("predicate").isNotNull()
    claims = graph.claims.select("claim_id", F.col("predicate").alias("p"), "subject_id", "object_id")
    as_subject = rows.where(relation).join(claims, (F.col("symbol_id") == F.col("subject_id")) & (F.col("predicate") == F.col("p"))).select("qid", "claim_id")
    of = graph.symbols.select(F.col("symbol_id").alias("child"), F.col("name").alias("child_name"), "parent_id")
    asked = rows.where(~relation & F.col("property").isNotNull()).join(of, F.col("symbol_id") == F.col("parent_id")).where(matches_property(F.col("child_name"), F.col("property"))).select("qid", F.col("child").alias("about"))
    about = asked.union(rows.where(~relation & F.col("property").isNull()).select("qid", "symbol_id"))
    own = about.join(claims, F.col("about") == F.col("subject_id")).select("qid", "claim_id")
    defining = about.join(claims.where("p = 'CONTAINS'"), F.col("about") == F.col("object_id")).select("qid", "claim_id")
    return as_subject.union(own).union(defining).distinct()


def decide(questions: DataFrame, graph: Graph) -> DataFrame:
    """(qid, outcome, invariant, claims, left_value, right_value) of questions (qid, question). claims are the ids that an
    answer may rest on, sorted, or those that failed the last rung."""
    parsed = written(q.parse(questions), "questions")
    scopes = resolve_scopes(parsed.where("scope IS NOT NULL").select("scope"), graph.artifacts)
    parsed = written(parsed.join(scopes.select("scope", F.col("status").alias("scope_status"), "path"), "scope", "left"), "scoped")
    named = symbols_named(parsed.where("subject IS NOT NULL").select(F.col("subject").alias("name")), graph.symbols)
    subjects = parsed.where("status = 'PARSED'").join(named, F.col("subject") == F.col("name")).where(F.col("path").isNull() | (canonical(F.col("rel_path")) == F.col("path")))
    subjects = written(subjects.select("qid", "symbol_id", "qname"), "subjects")
    known = subjects.groupBy("qid").agg(F.count_distinct("qname").alias("subjects"))

    rows = _gathered(parsed, subjects, graph).join(hits(graph).select("claim_id", F.col("predicate").alias("claim_predicate"), "object_name", "object_literal", "establishment", "lifecycle", "strength", "quote", "rel_path"), "claim_id")
    rows = rows.join(parsed.select("qid", "object", "literals", "path"), "qid")
    end = F.lower(F.regexp_replace(F.substring_index("object", ".", -1), r"[(),.?]+$", ""))
    meets = F.substring_index(F.lower(F.coalesce("object_name", "object_literal", F.lit(""))), ".", -1) == end
    word = lambda x: F.rlike(F.col("quote"), F.concat(F.lit(r"(?U)\b\Q"), x, F.lit(r"\E\b")))
    rungs = [
        ("object", F.col("object").isNull() | meets),
        ("scope", F.col("path").isNull() | (canonical(F.col("rel_path")) == F.col("path"))),
        ("trusted", vocabulary.trusted(F.col("claim_predicate"), F.col("establishment"))),
        ("presentable", F.col("lifecycle").isin(*vocabulary.PRESENTABLE)),
        ("verified", F.coalesce(F.col("strength").isin(*vocabulary.VERIFIABLE), F.lit(False))),
        ("literal", (F.size("literals") == 0) | F.forall("literals", word)),
    ]
    passed: Column = F.lit(True)
    for name, flag in rungs:
        passed = passed & F.coalesce(flag, F.lit(False))
        rows = rows.withColumn(f"to_{name}", passed)
    rows = written(rows, "ladder")
    height = sum((F.col(f"to_{name}").cast("int") for name, _ in rungs[1:]), F.col("to_object").cast("int"))
    per = rows.withColumn("height", height).groupBy("qid").agg(F.max("height").alias("height"), F.collect_list(F.struct("height", "claim_id")).alias("all"))
    per = per.select("qid", "height", F.array_sort(F.transform(F.filter("all", lambda x: x["height"] == F.col("height")), lambda x: x["claim_id"])).alias("claims"))
    value = F.coalesce(F.nullif(F.col("object_literal"), F.lit("")), F.col("object_name"), F.col("quote"))
    clash = conflicts(rows.where("to_literal").select("qid", "claim_id", F.col("claim_predicate").alias("predicate"), value.alias("value")), "qid")
    clash = clash.groupBy("qid").agg(F.min(F.struct("predicate", "left_value", "right_value")).alias("c")).select("qid", "c.left_value", "c.right_value")

    table = parsed.join(known, "qid", "left").join(per, "qid", "left").join(clash, "qid", "left")
    height = F.col("height")
    invariant = (
        F.when(F.col("status").isin("UNPARSEABLE", "PARTIAL"), "INV-1_constraints")
        .when((F.col("status") == "AMBIGUOUS") | (F.col("scope_status") == "AMBIGUOUS"), "INV-10_ambiguity")
        .when(F.col("scope_status") == "UNKNOWN", "INV-4_scope")
        .when(F.col("subjects").isNull(), "INV-1_subject")
        .when(F.col("subjects") > 1, "INV-10_ambiguity")
        .when(height.isNull(), "INV-2_predicate")
        .when(height == 0, "INV-3_object")
        .when(height == 1, "INV-4_scope")
        .when(height == 2, "INV-5_establishment")
        .when(height == 3, "INV-6_lifecycle")
        .when(height == 4, "INV-8_evidence")
        .when(height == 5, "INV-3_object")
    )
    outcome = F.when(F.col("invariant") == "INV-10_ambiguity", "ABSTAIN_AMBIGUOUS").when(F.col("invariant").isNotNull(), "ABSTAIN").when(F.col("left_value").isNotNull(), "EXPOSE_CONFLICTED").otherwise("EXPOSE")
    silent = F.col("invariant").isin("INV-1_constraints", "INV-10_ambiguity", "INV-1_subject", "INV-2_predicate", "INV-4_scope")
    nothing = F.array().cast("array<string>")
    return table.withColumn("invariant", invariant).select("qid", outcome.alias("outcome"), "invariant", F.when(silent, nothing).otherwise(F.coalesce("claims", nothing)).alias("claims"), "left_value", "right_value")
