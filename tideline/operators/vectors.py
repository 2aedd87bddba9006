"""Nearest vectors of a query set against all rows, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows to a block; a task holds two blocks and their product.
BLOCK = 1024


def _blocks(rows: DataFrame, key: str, vector: str, name: str, block: int) -> tuple[DataFrame, int]:
    """(name, dim, name_rows): about ``block`` rows of one length together, dealt by a hash of the id; and how many numbers there are."""
    count = max(1, -(-rows.count() // block))
    number = F.pmod(F.xxhash64(key), F.lit(count)).alias(name)
    packed = rows.where(F.col(vector).isNotNull()).select(number, F.size(vector).alias("dim"), F.struct(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).alias("x"))
    return packed.groupBy(name, "dim").agg(F.collect_list("x").alias(f"{name}_rows")), count


def best_match(queries: DataFrame, rows: DataFrame, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(key, similarity): the highest cosine of each query with any other row of the same length; 0 where a norm is 0.

    Every query meets every row, but as matrix products of blocks: a block of rows is sent once
    for each block of queries, and only one number a query and product comes back.
    """
    q, count = _blocks(queries, key, vector, "qb", block)
    r, _ = _blocks(rows, key, vector, "rb", block)
    pairs = r.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(q, ["qb", "dim"]).select("qb_rows", "rb_rows")
    kind = queries.schema[key].dataType.simpleString()

    def unpack(x: pa.ListScalar) -> tuple[list, np.ndarray]:
        a = x.values
        v = a.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return a.field(0), v / np.where(n > 0, n, 1.0)

    def run(batches):
        for b in batches:
            for left, right in zip(b.column(0), b.column(1)):
                (ids, x), (others, y) = unpack(left), unpack(right)
                s = x @ y.T
                s[np.array(ids.to_pylist(), object)[:, None] == np.array(others.to_pylist(), object)[None, :]] = -np.inf
                best = s.max(1)
                ok = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), pa.array(best[ok])], names=[key, "similarity"])

    return pairs.mapInArrow(run, f"{key} {kind}, similarity double").groupBy(key).agg(F.max("similarity").alias("similarity"))
