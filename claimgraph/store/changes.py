"""Changes of the graph's tables: each takes tables and gives tables, so that a change is a plan and not a cursor.

First writers win, upserts keep what the contract says, removals take along what would dangle. Sides to remove are joined by
key; Spark broadcasts them where their size allows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.compiler.compile import Graph


def insert_missing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows, and of the new ones those whose key is not there yet, one for each key."""
    fresh = new.select(existing.columns).dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh)


def enqueue(work: DataFrame, items: DataFrame) -> DataFrame:
    """work (item_id, run_id, stage, target, input_hash, state, attempts, error) with items (the first five columns) put in as
    PENDING; an item that was there before keeps its attempts and nothing else."""
    kept = work.join(items.select("item_id"), "item_id", "left_anti")
    before = work.select("item_id", F.col("attempts").alias("earlier"))
    added = items.dropDuplicates(["item_id"]).join(before, "item_id", "left").select("item_id", "run_id", "stage", "target", "input_hash", F.lit("PENDING").alias("state"), F.coalesce("earlier", F.lit(0)).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error"))
    return kept.unionByName(added.select(kept.columns))


def start(work: DataFrame, ids: DataFrame) -> DataFrame:
    """The named items RUNNING, one attempt more."""
    chosen = ids.select("item_id").distinct().withColumn("chosen", F.lit(True))
    rows = work.join(chosen, "item_id", "left")
    now = F.col("chosen").isNotNull()
    return rows.select(*(F.when(now, F.lit("RUNNING")).otherwise(F.col(c)).alias(c) if c == "state" else (F.col(c) + now.cast("int")).alias(c) if c == "attempts" else F.col(c) for c in work.columns))


def finish(work: DataFrame, results: DataFrame) -> DataFrame:
    """Items with their results (item_id, state, error); attempts start anew for those that are DONE."""
    rows = work.join(results.select("item_id", F.col("state").alias("to"), F.col("error").alias("why")).dropDuplicates(["item_id"]), "item_id", "left")
    ended = F.col("to").isNotNull()
    new = {"state": F.coalesce("to", "state"), "error": F.when(ended, F.col("why")).otherwise(F.col("error")), "attempts": F.when(F.col("to") == "DONE", 0).otherwise(F.col("attempts"))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in work.columns))


def requeue(work: DataFrame, run_id: str) -> DataFrame:
    """A run's RUNNING items PENDING again."""
    return work.withColumn("state", F.when((F.col("run_id") == run_id) & (F.col("state") == "RUNNING"), "PENDING").otherwise(F.col("state")))


def quarantined(work: DataFrame, most: int = 3) -> Column:
    """Whether an item has been tried so often that it is left alone."""
    return F.col("attempts") >= most


def resumable(runs: DataFrame) -> DataFrame:
    """The latest run (run_id, status, started_at) that has not ended, or no row."""
    return runs.where(F.col("status").isin("RUNNING", "INTERRUPTED")).orderBy(F.col("started_at").desc(), "run_id").limit(1)


def set_status(artifacts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Artifacts with the status and reason of the latest outcome (artifact_id, status, reason, at)."""
    last = outcomes.groupBy("artifact_id").agg(F.max_by(F.struct("status", "reason"), "at").alias("now"))
    rows = artifacts.join(last, "artifact_id", "left")
    new = {c: F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(c)) for c in ("status", "reason")}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in artifacts.columns))


def without_claims(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without claims (claim_id), their references and links, and the evidence that only they cited."""
    anti = lambda df: df.join(gone.select("claim_id"), "claim_id", "left_anti")
    links = anti(graph.claim_evidence)
    touched = graph.claim_evidence.join(gone.select("claim_id"), "claim_id", "left_semi").select("evidence_id").distinct()
    orphans = touched.join(links, "evidence_id", "left_anti")
    return replace(graph, claims=anti(graph.claims), references=anti(graph.references), claim_evidence=links, evidence=graph.evidence.join(orphans, "evidence_id", "left_anti"))


def purge(graph: Graph, artifacts: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph without what belongs to artifacts (artifact_id), whose own rows stay: their symbols, the claims from and to
    them, their evidence. And (artifact_id, rel_path, lost): claims that other artifacts lost by it."""
    gone = artifacts.select("artifact_id").distinct()
    mine = graph.symbols.join(gone, "artifact_id", "left_semi").select("symbol_id")
    own = graph.claims.join(mine, F.col("subject_id") == F.col("symbol_id"), "left_semi").select("claim_id", "subject_id")
    inbound = graph.claims.join(mine, F.col("object_id") == F.col("symbol_id"), "left_semi").select("claim_id", "subject_id").join(own.select("claim_id"), "claim_id", "left_anti")
    owners = graph.symbols.select(F.col("symbol_id").alias("subject_id"), "artifact_id")
    lost = inbound.join(owners, "subject_id").groupBy("artifact_id").agg(F.count(F.lit(1)).alias("lost")).join(graph.artifacts.select("artifact_id", "rel_path"), "artifact_id").select("artifact_id", "rel_path", "lost")
    left = without_claims(graph, own.union(inbound).select("claim_id"))
    return replace(left, symbols=left.symbols.join(gone, "artifact_id", "left_anti"), evidence=left.evidence.join(gone, "artifact_id", "left_anti")), lost


def replace_claims(graph: Graph, artifacts: DataFrame, fresh: Graph) -> Graph:
    """The graph in which the claims that artifacts (artifact_id) are the subject of are those of `fresh`."""
    chosen = artifacts.select("artifact_id").distinct()
    mine = lambda g: g.claims.join(graph.symbols.join(chosen, "artifact_id", "left_semi").select(F.col("symbol_id").alias("subject_id")), "subject_id", "left_semi")
    left, new = without_claims(graph, mine(graph)), mine(fresh).select(graph.claims.columns)
    semi = lambda df: df.join(new.select("claim_id"), "claim_id", "left_semi")
    links = semi(fresh.claim_evidence)
    cited = fresh.evidence.join(links.select("evidence_id"), "evidence_id", "left_semi")
    return replace(left, claims=insert_missing(left.claims, new, "claim_id"), references=insert_missing(left.references, semi(fresh.references), "claim_id"), claim_evidence=left.claim_evidence.unionByName(links).distinct(), evidence=insert_missing(left.evidence, cited, "evidence_id"))


def uncovered(walked: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(rel_path) of files that a walk came to and that no artifact stands for."""
    return walked.select("rel_path").distinct().join(artifacts.select("rel_path"), "rel_path", "left_anti")


def digest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, digest) of each table, alike for the same rows in any order: sums of two hashes of every row, which merge
    over tasks and hold no more than a row."""
    out = None
    for name, df in sorted(tables.items()):
        text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        half = lambda i: F.sum(F.conv(F.substring(F.sha2(text, 256), i, 15), 16, 10).cast("decimal(38,0)"))
        one = df.agg(F.count(F.lit(1)).alias("rows"), half(1).alias("a"), half(16).alias("b")).select(F.lit(name).alias("name"), "rows", F.sha2(F.concat_ws("\x1f", F.col("rows").cast("string"), F.coalesce(F.col("a"), F.lit(0)).cast("string"), F.coalesce(F.col("b"), F.lit(0)).cast("string")), 256).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, each as often."""
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        return False
    both = a.select(*columns, F.lit(1).alias("__side")).union(b.select(*columns, F.lit(-1).alias("__side")))
    return not both.groupBy(*columns).agg(F.sum("__side").alias("__left")).where("__left <> 0").limit(1).count()
