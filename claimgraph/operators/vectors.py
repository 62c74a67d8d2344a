"""Nearest vectors by exact cosine, for a set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are held at once, by the driver and by each task (8 bytes a dimension each).
BLOCK = 4096


def cosine_topk_all(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest rows of (vec_id, embedding) to each query (vec_id, embedding), itself left out,
    by the cosine rounded to six digits and the lesser id. Each batch of rows keeps its own k best of each query of a block,
    so that k rows a query and batch are all that is shuffled; blocks of queries are taken one after the other. A vector of
    length 0 or null is near to nothing."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64())])
    n = queries.count()
    blocks = max(1, -(-n // block))
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding").collect()  # one block
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        q = np.array([r["embedding"] for r in rows], np.float64) if rows else np.empty((0, 0))

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            length = np.sqrt((q * q).sum(1)) if len(q) else np.empty(0)
            for batch in batches:
                batch = batch.filter(pa.compute.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
                if not batch.num_rows or not len(q):
                    continue
                own = batch.column(0).to_numpy()
                m = np.array(batch.column(1).to_pylist(), np.float64)
                size = np.sqrt((m * m).sum(1))
                with np.errstate(invalid="ignore", divide="ignore"):
                    c = np.round(q @ m.T / (length[:, None] * size[None, :]), 6)
                c[(ids[:, None] == own[None, :]) | ~np.isfinite(c)] = -np.inf
                out = []
                for i in range(len(ids)):
                    best = np.lexsort((own, -c[i]))[:k] if c.shape[1] <= 8 * k else _best(c[i], own, k)
                    best = best[np.isfinite(c[i][best])]
                    out.append((np.full(len(best), ids[i]), own[best], c[i][best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)

        one = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "query_id long, vec_id long, cosine double")
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(c: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, of equal ones the lesser id."""
    least = np.partition(c, len(c) - k)[len(c) - k]
    some = np.flatnonzero(c >= least)
    return some[np.lexsort((own[some], -c[some]))[:k]]
