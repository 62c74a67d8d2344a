"""Which artifact or symbol a name means: one, or a refusal. Nothing is ranked here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(path: Column) -> Column:
    """A path with forward slashes, without empty and `.` parts."""
    return F.array_join(F.filter(F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".")), "/")


def resolve_scopes(scopes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(scope, status, path, matches) of the distinct scopes: EXACT if the canonical path is an artifact's, or a bare file name
    is that of one alone; AMBIGUOUS if several have the name; UNKNOWN otherwise. path is null unless EXACT."""
    wanted = scopes.select("scope").distinct().withColumn("want", canonical(F.col("scope")))
    known = artifacts.select(canonical(F.col("rel_path")).alias("path")).distinct()
    exact = wanted.join(known, F.col("want") == F.col("path")).select("scope", "path", F.lit(0).alias("by"))
    named = wanted.where(~F.contains("want", F.lit("/"))).join(known.withColumn("base", F.substring_index("path", "/", -1)), F.col("want") == F.col("base")).select("scope", "path", F.lit(1).alias("by"))
    found = exact.unionByName(named).groupBy("scope").agg(F.min(F.struct("by", "path")).alias("best"), F.count_distinct("path").alias("n"))
    sure = (F.col("best.by") == 0) | (F.col("n") == 1)
    return wanted.select("scope").join(found, "scope", "left").select("scope", F.when(F.col("n").isNull(), "UNKNOWN").when(sure, "EXACT").otherwise("AMBIGUOUS").alias("status"), F.when(sure, F.col("best.path")).alias("path"), F.coalesce(F.when(F.col("best.by") == 0, 1).otherwise(F.col("n")), F.lit(0)).cast("long").alias("matches"))


def symbols_named(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, symbol_id, qname, kind, rel_path, artifact_id) of all symbols that a name (name) may mean: its last part is the
    symbol's name, or it is the qualified name, or its end after a dot; upper and lower case differ. Joined by the
    last part, which all three share or imply."""
    bare = F.regexp_replace(F.substring_index("wanted", ".", -1), r"[(),.?]+$", "")
    wanted = names.select(F.col("name").alias("wanted")).distinct().withColumn("bare", bare).withColumn("last", F.substring_index("wanted", ".", -1))
    rows = symbols.select("symbol_id", "qname", F.col("name").alias("own"), "kind", "rel_path", "artifact_id", F.substring_index("qname", ".", -1).alias("tail"))
    by_name = wanted.join(rows, F.col("bare") == F.col("own"))
    by_tail = wanted.join(rows, F.col("last") == F.col("tail")).where((F.col("qname") == F.col("wanted")) | F.col("qname").endswith(F.concat(F.lit("."), "wanted")))
    columns = [F.col("wanted").alias("name"), "symbol_id", "qname", "kind", "rel_path", "artifact_id"]
    return by_name.select(*columns).union(by_tail.select(*columns)).distinct()


def resolve_names(questions: DataFrame, symbols: DataFrame, artifacts: DataFrame, candidates: Column, scope: Column) -> DataFrame:
    """(qid, name, candidates, resolved) for each name of a question (qid, ...) that some class, function, method or document
    has: the one qualified name, or the name itself if it is one of them, or the one in the question's file; else null."""
    named = questions.select("qid", F.explode(candidates).alias("name"), scope.alias("scope"))
    found = symbols_named(named.select("name"), symbols).where("kind IN ('class', 'function', 'method', 'document')")
    scopes = resolve_scopes(named.where("scope IS NOT NULL").select("scope"), artifacts).select("scope", "path")
    rows = named.join(found, "name").join(scopes, "scope", "left")
    here = F.when(canonical(F.col("rel_path")) == F.col("path"), F.col("qname"))
    each = rows.groupBy("qid", "name").agg(F.array_sort(F.collect_set("qname")).alias("candidates"), F.collect_set(here).alias("here"))
    return each.select("qid", "name", "candidates", F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))).when(F.array_contains("candidates", F.col("name")), F.col("name")).when(F.size("here") == 1, F.get("here", F.lit(0))).alias("resolved"))
