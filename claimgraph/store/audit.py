"""What rows of the graph must keep: rules for a claim that is to be written, and an audit of all tables.

Both are joins and counts by key; an audit row has the rule and how many rows break it, 0 for rules that hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions import vocabulary


def _cited(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims with what their evidence is worth: how many ids they name, how many exist, are verified, are verified enough."""
    links = claims.select("claim_id", F.explode("evidence_ids").alias("e"))
    strength = F.col("strength")
    worth = links.join(evidence.select(F.col("evidence_id").alias("e"), F.lit(1).alias("there"), "strength"), "e", "left").groupBy("claim_id").agg(F.count(F.lit(1)).alias("named"), F.count("there").alias("exist"), F.count(strength).alias("verified"), F.count_if(strength.isin(*vocabulary.VERIFIABLE)).alias("verifiable"))
    return claims.join(worth, "claim_id", "left").fillna(0, ["named", "exist", "verified", "verifiable"])


def _empty(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def write_rules() -> dict[str, Column]:
    """What a new claim breaks, over the columns of `_cited`."""
    structural, literal = F.col("predicate").isin(*vocabulary.STRUCTURAL), F.col("predicate").isin(*vocabulary.LITERAL)
    level = F.col("establishment")
    return {
        "claim has no evidence": F.col("named") == 0,
        "claim references non-existent evidence": F.col("exist") < F.col("named"),
        "trusted claim lacks EXACT/REPRODUCIBLE evidence": level.isin(*vocabulary.TRUSTED) & (F.col("verifiable") == 0),
        "model claim has unverified evidence": level.isin("PROPOSED", "DISPUTED") & (F.col("verified") == 0),
        "structural predicate requires DERIVED/CONFIRMED": structural & ~level.isin(*vocabulary.TRUSTED),
        "CONFIRMED needs EXACT/REPRODUCIBLE evidence": (level == "CONFIRMED") & (F.col("verifiable") == 0),
        "DERIVED claim must not have model_id": (level == "DERIVED") & F.col("model_id").isNotNull(),
        "literal-valued claim needs object_literal and no object_id": literal & (_empty("object_literal") | F.col("object_id").isNotNull()),
        "REJECTED claim needs a reason": (F.col("lifecycle") == "REJECTED") & _empty("rejected_reason"),
    }


def violations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, rule) of every rule that a claim to be written breaks, given the evidence there will be."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(rule)) for rule, c in write_rules().items())))
    return _cited(claims, evidence).select("claim_id", F.explode(broken).alias("rule"))


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, n) of the seventeen rules over artifacts, symbols, references, evidence, claims, claim_evidence, diagnostics and
    runs (status), however the rows came there. Rules over one table share a pass."""
    a, s, r, e, c, links, d = (tables[k] for k in ("artifacts", "symbols", "references", "evidence", "claims", "claim_evidence", "diagnostics"))
    level = F.col("establishment")

    def counted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
        sums = df.agg(*(F.count_if(F.coalesce(x, F.lit(False))).alias(f"r{i}") for i, x in enumerate(rules.values())))
        return sums.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, name in enumerate(rules)))).alias("x")).select("x.rule", "x.n")

    subjects = s.select(F.col("symbol_id").alias("subject_id"), F.col("artifact_id").alias("of"), F.lit(True).alias("has_subject"))
    objects = s.select(F.col("symbol_id").alias("object_id"), F.lit(True).alias("has_object"))
    status = a.select(F.col("artifact_id").alias("of"), F.col("status").alias("of_status"))
    whole = _cited(c, e).join(subjects, "subject_id", "left").join(objects, "object_id", "left").join(status, "of", "left")
    claims = counted(
        whole,
        {
            "claims without evidence": F.col("named") == 0,
            "claims referencing missing evidence": F.col("exist") < F.col("named"),
            "trusted claims without verifiable evidence": level.isin(*vocabulary.TRUSTED) & (F.col("verifiable") == 0),
            "structural claims not deterministically established": F.col("predicate").isin(*vocabulary.STRUCTURAL) & ~level.isin(*vocabulary.TRUSTED),
            "DERIVED claims carrying model identity": (level == "DERIVED") & F.col("model_id").isNotNull(),
            "literal-valued claims without a value, or pointing at a symbol": F.col("predicate").isin(*vocabulary.LITERAL) & (_empty("object_literal") | F.col("object_id").isNotNull()),
            "claims belonging to a FAILED artifact": F.col("of_status") == "FAILED",
            "claims whose subject symbol does not exist": F.col("has_subject").isNull(),
            "claims whose object symbol does not exist": F.col("object_id").isNotNull() & F.col("has_object").isNull(),
        },
    )
    cited = links.select(F.col("evidence_id").alias("x")).distinct().withColumn("cited", F.lit(True))
    evidence = counted(e.join(cited, F.col("evidence_id") == F.col("x"), "left"), {"evidence not referenced by any claim": F.col("cited").isNull()})
    targets = c.select("claim_id", F.struct("object_id").alias("claim"))
    references = counted(
        r.join(targets, "claim_id", "left"),
        {
            "UNRESOLVED references with a resolved target": (F.col("resolution") == "UNRESOLVED") & F.col("claim.object_id").isNotNull(),
            "DETERMINISTIC references with no resolved target": (F.col("resolution") == "DETERMINISTIC") & F.col("claim").isNotNull() & F.col("claim.object_id").isNull(),
            "reference rows with no claim": F.col("claim").isNull(),
        },
    )
    said = d.select(F.col("artifact_id").alias("x")).distinct().withColumn("said", F.lit(True))
    artifacts = counted(
        a.join(said, F.col("artifact_id") == F.col("x"), "left"),
        {
            "failed artifacts with no recorded reason": F.col("status").isin("FAILED", "PARTIAL", "UNSUPPORTED", "SKIPPED") & _empty("reason"),
            "FAILED artifacts with no diagnostic": (F.col("status") == "FAILED") & F.col("said").isNull(),
        },
    )
    parent = s.select(F.col("symbol_id").alias("p"), F.col("artifact_id").alias("pa"), F.col("byte_start").alias("ps"), F.col("byte_end").alias("pe"))
    outside = (F.col("pa") != F.col("artifact_id")) | (F.col("ps") > F.col("byte_start")) | (F.col("pe") < F.col("byte_end"))
    symbols = counted(s.join(parent, F.col("parent_id") == F.col("p")), {"symbols whose parent does not contain them in source": outside})
    parts = [claims, evidence, references, artifacts, symbols]
    runs = tables.get("runs")
    parts.append(counted(runs if runs is not None else a.limit(0).select("status"), {"runs still marked RUNNING": F.col("status") == "RUNNING"}))
    return reduce(DataFrame.unionByName, parts)
