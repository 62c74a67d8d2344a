"""Graphs kept as snapshots: all tables of a commit become visible together or not at all.

Tables are written below a folder of their own; the commit is the creation of a numbered manifest that names it, made by a
rename that fails if another writer has taken the number. A job that dies before leaves files that no manifest names.
Claims are checked by the rules for writing first, on what is about to be visible."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from claimgraph.compiler.compile import Graph
from claimgraph.store import audit


class RuleBroken(ValueError):
    """A claim that must not be written."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        """Numbers of the commits, in order."""
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.root}/manifests")) if s.getPath().getName().isdigit())

    def read(self, version: int | None = None) -> Graph | None:
        """The graph of a commit, the latest if none is named; None where there is none."""
        known = self.versions()
        if version is None and not known:
            return None
        chosen = known[-1] if version is None else version
        folder = self.spark.read.text(f"{self.root}/manifests/{chosen:08d}").first()["value"]
        names = Graph.__dataclass_fields__
        return Graph(**{name: self.spark.read.parquet(f"{self.root}/{folder}/{name}") for name in names})

    def commit(self, graph: Graph) -> int:
        """Write a graph as the next version, whose number is returned. RuleBroken if a claim breaks a rule."""
        folder = f"data-{uuid.uuid4().hex}"
        tables = {}
        for name, df in graph.tables().items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
            tables[name] = self.spark.read.parquet(f"{self.root}/{folder}/{name}")
        broken = audit.violations(tables["claims"], tables["evidence"]).orderBy("claim_id", "rule").limit(5).collect()
        if broken:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise RuleBroken("; ".join(f"{r['claim_id']}: {r['rule']}" for r in broken))
        number = (self.versions() or [0])[-1] + 1
        draft, final = self._path(f"{self.root}/manifests/.draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{number:08d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(f"{folder}\n".encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer committed version {number}")
        return number

