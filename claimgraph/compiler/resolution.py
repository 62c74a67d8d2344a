"""What references of one file mean in the whole corpus.

Imports (and bases, which are looked up like imports) reach a module of the corpus or none. A call's candidates are looked up
among the corpus' qualified names in this order: a definition of the file's own module (which shadows imports), the import
binding joined with the rest of the dotted name, the name as written, the import's origin, and what a package passes on under
the origin's name. All lookups are joins by name; a name that nothing defines keeps the reference unresolved, with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _before(name: Column) -> Column:
    """`a.b` of `a.b.c`; the name itself without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def _quoted(name: Column) -> Column:
    return F.concat(F.lit("'"), name, F.lit("'"))


def modules(symbols: DataFrame) -> DataFrame:
    """(module): names that have members or are modules. symbols are (kind, qname, parent_qname), the latter null without a
    known parent."""
    return symbols.where("kind = 'module'").select(F.col("qname").alias("module")).union(symbols.where("kind <> 'module' AND parent_qname IS NOT NULL").select("parent_qname")).distinct()


def members(symbols: DataFrame) -> DataFrame:
    """(member): qualified names that can be reached by a module's name and a local name."""
    return symbols.where("kind <> 'module' AND parent_qname IS NOT NULL").select(F.col("qname").alias("member")).distinct()


def passed_on(bindings: DataFrame) -> DataFrame:
    """(exposed, origin): what each module's imports make reachable under its own name; of several files of one module name the
    last by path counts."""
    return bindings.groupBy(F.concat_ws(".", "module", "name").alias("exposed")).agg(F.max_by("target", "rel_path").alias("origin"))


def resolved(references: DataFrame, symbols: DataFrame, bindings: DataFrame, definitions: DataFrame) -> DataFrame:
    """references (site, artifact_id, module, predicate, target, target_qname, resolution, reason, ...) with target_qname,
    resolution and reason as the corpus tells them."""
    names, homes = members(symbols), modules(symbols)
    calls = references.where("predicate = 'CALLS'")
    imports = references.where("predicate IN ('IMPORTS', 'EXTENDS')")
    rest = references.where("predicate NOT IN ('CALLS', 'IMPORTS', 'EXTENDS')")

    # Imports and bases: is the target, or what stands before its last dot, a module of the corpus?
    wanted = imports.select("site", F.explode(F.array_distinct(F.array("target", _before(F.col("target"))))).alias("module"))
    reached = wanted.join(homes, "module").select(F.col("site").alias("s")).distinct().withColumn("reached", F.lit(True))
    open_ = F.col("resolution") != "UNRESOLVED"
    hit = F.col("reached").isNotNull()
    imports = imports.join(reached, F.col("site") == F.col("s"), "left")
    imports = _with(imports, F.when(open_ & ~hit, "UNRESOLVED").when(open_, "HEURISTIC").otherwise(F.col("resolution")), F.when(open_ & hit, F.col("target_qname")).when(~open_, F.col("target_qname")), F.when(open_ & hit, "import target module is in the corpus").when(open_, F.concat(F.lit("import target "), _quoted(F.col("target")), F.lit(" is not in the analysed corpus"))).otherwise(F.col("reason")))

    # Calls: the file's own definitions and the binding of the name's head.
    head, more = F.substring_index("target", ".", 1), F.contains("target", F.lit("."))
    rows = calls.select("site", "artifact_id", F.col("module").alias("home"), "target", "target_qname", head.alias("head"), more.alias("dotted"), F.substring("target", F.length(head) + 2, F.length("target")).alias("attr"))
    own = definitions.select("artifact_id", F.col("name").alias("head"), F.lit(True).alias("own"))
    bound = bindings.select("artifact_id", F.col("name").alias("head"), F.col("target").alias("origin"))
    rows = rows.join(own, ["artifact_id", "head"], "left").join(bound, ["artifact_id", "head"], "left").withColumn("own", F.coalesce("own", F.lit(False)) & ~F.col("dotted"))
    onward = passed_on(bindings).select(F.col("exposed").alias("origin"), F.col("origin").alias("onward"))
    rows = rows.join(onward, "origin", "left")
    bare = ~F.col("own") & ~F.col("dotted") & F.contains("origin", F.lit("."))
    alias = ~F.col("own") & F.col("dotted") & F.col("origin").isNotNull()
    candidate = lambda when, rank, name: F.when(when, F.struct(F.lit(rank).alias("rank"), name.alias("member")))
    tried = F.array_compact(F.array(candidate(F.col("own"), 0, F.concat_ws(".", "home", "target")), candidate(alias, 1, F.concat_ws(".", "origin", "attr")), candidate(alias, 2, F.col("target")), candidate(bare, 3, F.col("origin")), candidate(bare, 4, F.col("onward"))))
    found = rows.select("site", F.explode(tried).alias("c")).select("site", "c.rank", "c.member").join(names, "member").groupBy("site").agg(F.min(F.struct("rank", "member")).alias("best"))
    # Only where nothing was found it matters whether the module is in the corpus at all.
    needed = F.when(alias, F.col("origin")).when(bare, _before(F.col("origin")))
    rows = rows.withColumn("needed", needed).join(homes.withColumn("there", F.lit(True)), F.col("needed") == F.col("module"), "left").drop("module").join(found, "site", "left")
    best, rank = F.col("best.member"), F.col("best.rank")
    in_module = F.concat(_before(best), F.lit("."), F.substring_index(best, ".", -1))
    reason = (
        F.when(rank == 0, "bound to a module-level definition (shadows any import)")
        .when(rank.isin(1, 2), F.concat(F.lit("qualified call resolved to "), in_module, F.lit(" in the corpus")))
        .when(rank == 3, F.concat(F.lit("from-import binding resolved to "), in_module))
        .when(rank == 4, F.concat(F.lit("resolved through a re-export in "), _before(F.col("origin"))))
        .when(F.col("own"), F.lit(None))
        .when(F.col("origin").isNull(), "not bound in any statically known scope")
        .when(F.col("needed").isNotNull() & F.col("there").isNull(), F.concat(F.lit("module "), _quoted(F.col("needed")), F.lit(" is not in the analysed corpus")))
        .when(F.col("dotted"), "qualified target not found in the corpus")
        .otherwise("imported name has no definition in the analysed corpus")
    )
    answer = rows.select(F.col("site").alias("s"), F.col("own").alias("own"), best.alias("best"), rank.alias("rank"), reason.alias("why"))
    calls = calls.join(answer, F.col("site") == F.col("s"))
    # A definition of the file's own that the corpus does not know keeps what the file alone told; a computed target too.
    kept = (F.col("own") & F.col("best").isNull()) | (F.col("target") == "<computed>")
    calls = _with(calls, F.when(kept, F.col("resolution")).when(F.col("rank") < 4, "DETERMINISTIC").when(F.col("rank") == 4, "HEURISTIC").otherwise("UNRESOLVED"), F.when(kept, F.col("target_qname")).otherwise(F.col("best")), F.when(kept & F.col("own"), F.col("reason")).otherwise(F.col("why")))
    columns = references.columns
    return calls.select(columns).unionByName(imports.select(columns)).unionByName(rest.select(columns))


def _with(df: DataFrame, resolution: Column, target: Column, reason: Column) -> DataFrame:
    """df with the three columns replaced, all from the old values."""
    return df.withColumns({"__r": resolution, "__t": target, "__w": reason}).drop("resolution", "target_qname", "reason").withColumnsRenamed({"__r": "resolution", "__t": "target_qname", "__w": "reason"})
