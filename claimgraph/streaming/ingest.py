"""Texts and source files taken in as they arrive, each content once, however often a batch is tried again.

A batch is keyed by content, not by its number: what a table holds is left out by an anti join before the batch is
appended, so a batch that was written before the checkpoint was, and comes again, adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimgraph.compiler import corpus
from claimgraph.compiler.compile import compile_files
from claimgraph.store.snapshots import Snapshots


def _held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the table does not exist before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ingest_texts(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str) -> None:
    """Append (sha, doc_id) of texts (doc_id, text) that stand below `source` and are not in `table` yet; of equal texts of a
    batch the least id counts. `source` is a folder or a pattern of paths. Takes what is there and ends."""
    fields = "sha string, doc_id long"

    def batch(df: DataFrame, _: int) -> None:
        new = df.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"))
        held = _held(df.sparkSession, table, fields)
        new.join(held.select("sha"), "sha", "left_anti").write.mode("append").parquet(table)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_files(spark: SparkSession, root: str, store: Snapshots, checkpoint: str) -> None:
    """Compile the files of a folder as they arrive. References may reach any file of the corpus, so a batch with new content
    compiles all files there are and commits one snapshot; a batch without any commits none."""

    def batch(df: DataFrame, _: int) -> None:
        session = df.sparkSession
        files = corpus.read_folder(session, root)
        known = store.read()
        fresh = corpus.artifacts(files, root).select("artifact_id")
        if known is None or fresh.join(known.artifacts, "artifact_id", "left_anti").limit(1).count() or known.artifacts.join(fresh, "artifact_id", "left_anti").limit(1).count():
            store.commit(compile_files(files, root))

    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root).select("path")
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
