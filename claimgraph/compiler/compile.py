"""The whole compiler: files to artifacts, symbols, references, evidence, claims and diagnostics.

The graph is a function of the files alone: compiled again, it has the same rows and ids. What a file cannot support is left
out with a diagnostic, never guessed: a symbol without a single enclosing parent has none, a reference without a single
owner gives no claim, a target that several definitions share stays unresolved.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.compiler import corpus, documents, python_source, resolution
from claimgraph.compiler.occurrences import located, sole_names
from claimgraph.functions.ids import content_id
from claimgraph.functions.shared import written

EXTRACTOR, EXTRACTOR_VERSION, SCHEMA_VERSION = "python-ast", "1", "1"
#: Fixed value: predicates whose object is a literal.
LITERAL_PREDICATES = ("HAS_DEFAULT", "HAS_VALUE", "HAS_PURPOSE")
SPAN = ("byte_start", "byte_end", "col_end", "col_start", "line_end", "line_start")


@dataclass
class Graph:
    artifacts: DataFrame
    symbols: DataFrame
    references: DataFrame
    evidence: DataFrame
    claims: DataFrame
    claim_evidence: DataFrame
    diagnostics: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def locator_json(kind: Column) -> Column:
    """The canonical text of a span: keys in order, no white space."""
    byte = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), F.col(k).cast("string")) for k in sorted(SPAN))), F.lit("}"))
    page = F.concat(F.lit('{"byte_end":'), F.col("byte_end"), F.lit(',"byte_start":'), F.col("byte_start"), F.lit(',"page":'), F.col("line_start"), F.lit("}"))
    para = F.concat(F.lit('{"byte_end":'), F.col("byte_end"), F.lit(',"byte_start":'), F.col("byte_start"), F.lit(',"para":'), F.col("line_start"), F.lit(',"unit":"'), F.col("kind"), F.lit('"}'))
    return F.when(kind == "byte_range", byte).when(kind == "pdf_box", page).otherwise(para)


def compile_files(files: DataFrame, uri: str) -> Graph:
    """The graph of (rel_path, content)."""
    found = written(corpus.artifacts(files, uri), "artifacts")
    sources = found.where("content IS NOT NULL").join(corpus.module_names(files.select("rel_path")), "rel_path")
    code = python_source.read(sources.where(F.col("media_type") == corpus.MEDIA_TYPES[".py"]))
    texts = documents.read(sources.where(F.col("media_type") == corpus.MEDIA_TYPES[".docx"]), sources.where(F.col("media_type") == corpus.MEDIA_TYPES[".pdf"]))
    raw = written(code.unionByName(texts).join(found.select("artifact_id", F.col("sha256").alias("artifact_sha256"), "media_type", "rel_path"), "artifact_id"), "raw")

    symbols, sym_diagnostics = _symbols(raw.where("record = 'symbol'"))
    symbols = written(symbols, "symbols")
    bindings, definitions = raw.where("record = 'binding'"), raw.where("record = 'definition'")
    references = raw.where("record = 'reference'").withColumn("site", F.concat_ws(":", "artifact_id", F.col("seq").cast("string")))
    parents = symbols.select(F.col("symbol_id").alias("p"), F.col("qname").alias("parent_qname")).distinct()
    names = symbols.select("kind", "qname", "parent_id").join(parents, F.col("parent_id") == F.col("p"), "left").select("kind", "qname", "parent_qname")
    references = written(resolution.resolved(references, names, bindings, definitions), "references")
    claims, ref_diagnostics = _claims(symbols, references)
    claims = written(claims, "claims")

    evidence = claims.select("evidence_id", "artifact_id", "artifact_sha256", "locator_kind", "locator", "quote").dropDuplicates(["evidence_id"]).withColumn("strength", F.when(F.col("locator_kind") == "byte_range", "EXACT").otherwise("REPRODUCIBLE"))
    made = claims.dropDuplicates(["claim_id"])
    said = raw.where("record = 'diagnostic'").select("artifact_id", "severity", "code", "message", "line")
    skipped = found.where("status IS NOT NULL").select("artifact_id", F.when(F.col("status") == "UNSUPPORTED", "INFO").otherwise("WARNING"), F.when(F.col("status") == "UNSUPPORTED", "UNSUPPORTED_LANGUAGE").otherwise(F.col("reason")), F.when(F.col("status") == "UNSUPPORTED", F.concat("rel_path", F.lit(": "), F.concat(F.lit("language '"), "language", F.lit("' has no analyser")))).otherwise(F.col("reason")), F.lit(None).cast("int"))
    said = said.union(skipped).union(sym_diagnostics).union(ref_diagnostics)
    diagnostics = said.withColumn("diagnostic_id", content_id("diagnostic", F.col("artifact_id"), F.col("severity"), F.col("code"), F.col("message"), F.col("line"))).dropDuplicates(["diagnostic_id"])
    return Graph(
        artifacts=_with_status(found, raw),
        symbols=symbols.dropDuplicates(["symbol_id"]).drop("seq", "site"),
        references=made.where(~F.col("predicate").isin(*LITERAL_PREDICATES) & F.col("resolution").isNotNull()).select("claim_id", "to_name", "resolution", "reason"),
        evidence=evidence,
        claims=made.select("claim_id", "predicate", "subject_id", "object_id", "object_literal", F.lit("ACTIVE").alias("lifecycle"), F.lit("DERIVED").alias("establishment"), F.lit(EXTRACTOR).alias("extractor_id"), F.lit(None).cast("string").alias("model_id"), F.array("evidence_id").alias("evidence_ids"), F.lit(None).cast("string").alias("rejected_reason")),
        claim_evidence=made.select("claim_id", "evidence_id"),
        diagnostics=diagnostics,
    )


def _with_status(found: DataFrame, raw: DataFrame) -> DataFrame:
    """The artifacts, those that were parsed with what came of it."""
    failed = raw.where("record = 'diagnostic' AND severity = 'ERROR'").groupBy(F.col("artifact_id").alias("a")).agg(F.min_by("message", "seq").alias("error"))
    some = raw.where("record = 'diagnostic' AND code IN ('TEXT_UNAVAILABLE', 'PDF_PAGE_UNREADABLE')").groupBy(F.col("artifact_id").alias("b")).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" unit(s) without text")).alias("missing"))
    rows = found.drop("content").join(failed, F.col("artifact_id") == F.col("a"), "left").join(some, F.col("artifact_id") == F.col("b"), "left")
    status = F.coalesce("status", F.when(F.col("error").isNotNull(), "FAILED").when(F.col("missing").isNotNull(), "PARTIAL").otherwise("OK"))
    return rows.withColumn("reason", F.coalesce("reason", "error", "missing")).withColumn("status", status).drop("a", "b", "error", "missing")


def _symbols(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols with the occurrence that encloses them as parent, and diagnostics for those that lack it."""
    rows = raw.withColumn("symbol_id", content_id("symbol", F.col("artifact_id"), F.col("qname"), F.col("kind"), F.col("byte_start"), F.col("byte_end"))).withColumn("site", F.concat_ws(":", "artifact_id", F.col("seq").cast("string")))
    sites = rows.select("site", "artifact_id", F.col("parent").alias("qname"), "byte_start", "byte_end")
    parents = located(sites, rows).select(F.col("site").alias("s"), F.col("enclosing").alias("parent_id"))
    rows = rows.join(parents, F.col("site") == F.col("s"), "left").drop("s")
    orphans = rows.where("parent IS NOT NULL AND parent_id IS NULL")
    message = F.concat(F.lit("'"), "qname", F.lit("' names parent '"), "parent", F.lit("' but no single occurrence of it encloses this symbol; left unparented"))
    diagnostics = orphans.select("artifact_id", F.lit("WARNING"), F.lit("UNRESOLVED_PARENT_OCCURRENCE"), message, F.col("line_start"))
    return rows.select("symbol_id", "artifact_id", "artifact_sha256", "media_type", "rel_path", "parent_id", "kind", "name", "qname", "docstring", *SPAN, "quote", "seq", "site"), diagnostics


def _claims(symbols: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims with their evidence in the same row, and diagnostics for references without an owner."""
    kind = F.when(F.col("media_type") == corpus.MEDIA_TYPES[".pdf"], "pdf_box").when(F.col("media_type") == corpus.MEDIA_TYPES[".docx"], "docx_para").otherwise("byte_range")
    contains = symbols.where("parent_id IS NOT NULL").select(F.lit("CONTAINS").alias("predicate"), F.col("parent_id").alias("subject_id"), F.col("symbol_id").alias("object_id"), F.lit(None).cast("string").alias("object_literal"), F.lit(None).cast("string").alias("to_name"), F.lit(None).cast("string").alias("resolution"), F.lit(None).cast("string").alias("reason"), "artifact_id", "artifact_sha256", "media_type", "kind", *SPAN, "quote")

    sites = references.select("site", "artifact_id", F.col("owner").alias("qname"), "byte_start", "byte_end")
    owners = located(sites, symbols).select(F.col("site").alias("s"), F.coalesce("enclosing", "sole").alias("subject_id"), F.col("occurrences").alias("owners"))
    rows = references.join(owners, F.col("site") == F.col("s")).drop("s")
    lost = rows.where("subject_id IS NULL")
    message = F.concat("predicate", F.lit(" to '"), "target", F.lit("' is attributed to '"), "owner", F.lit("', which has "), F.col("owners").cast("string"), F.lit(" occurrences and none enclosing this site; edge dropped rather than misattributed"))
    diagnostics = lost.select("artifact_id", F.lit("WARNING"), F.lit("UNRESOLVED_REFERENCE_SUBJECT"), message, F.col("line_start"))

    # The target: the file's sole definition of the name, else the corpus' sole one.
    here = symbols.groupBy(F.col("artifact_id").alias("a"), F.col("qname").alias("q")).agg(F.count(F.lit(1)).alias("local"), F.min("symbol_id").alias("local_id"))
    every = sole_names(symbols.dropDuplicates(["symbol_id"])).select(F.col("qname").alias("g"), F.col("n").alias("anywhere"), "sole_id")
    wanted = F.when(F.col("resolution") != "UNRESOLVED", F.col("target_qname"))
    rows = rows.where("subject_id IS NOT NULL").withColumn("wanted", wanted)
    rows = rows.join(here, (F.col("artifact_id") == F.col("a")) & (F.col("wanted") == F.col("q")), "left").join(every, F.col("wanted") == F.col("g"), "left")
    target = F.when(F.col("local") == 1, F.col("local_id")).when(F.col("local").isNull(), F.col("sole_id"))
    several = F.col("wanted").isNotNull() & target.isNull() & ((F.col("local") > 1) | (F.col("local").isNull() & F.col("anywhere").isNotNull()))
    where = F.when(F.col("local") > 1, "this artifact").otherwise("the corpus")
    refs = rows.select("predicate", "subject_id", target.alias("object_id"), F.when(target.isNull(), F.col("target")).alias("object_literal"), F.col("target").alias("to_name"), F.when(several, "UNRESOLVED").otherwise(F.col("resolution")).alias("resolution"), F.when(several, F.concat(F.lit("'"), "wanted", F.lit("' has several definitions in "), where, F.lit("; which one is meant is not statically determinable"))).otherwise(F.col("reason")).alias("reason"), "artifact_id", "artifact_sha256", "media_type", "kind", *SPAN, "quote")

    both = contains.unionByName(refs).withColumn("locator_kind", kind)
    both = both.withColumn("locator", locator_json(F.col("locator_kind")))
    both = both.withColumn("evidence_id", content_id("evidence", F.col("artifact_id"), F.col("artifact_sha256"), F.col("locator_kind"), F.col("locator"), F.col("quote")))
    cited = F.concat(F.lit('["'), "evidence_id", F.lit('"]'))
    version = F.lit(EXTRACTOR_VERSION)
    both = both.withColumn("claim_id", content_id("claim", F.col("predicate"), F.col("subject_id"), F.col("object_id"), F.col("object_literal"), F.lit(EXTRACTOR), version, F.lit(""), F.lit(""), F.lit(SCHEMA_VERSION), cited))
    return both, diagnostics
