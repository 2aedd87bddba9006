"""Shared plumbing: Arrow mapping over whole texts, scratch tables, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows handed to Python at once; texts are further cut into slices of SLICE_BYTES.
ARROW_ROWS = 1000
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(col: Column | str) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes each; a single long row stays whole."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, int(n * limit / max(1, batch.nbytes)))
    if step >= n:
        yield batch
        return
    for at in range(0, n, step):
        yield batch.slice(at, min(step, n - at))


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``make()`` builds the batch function once in each task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts; null counts as empty."""
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]


def records(names: list[str], columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)


# ---- scratch tables ---------------------------------------------------------------------


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; where none is set, a folder of our own in local mode only.

    On a cluster a machine's own folder is of no use: other machines don't see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = tempfile.mkdtemp(prefix="tideline-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables written to the shared checkpoint folder: they cut lineage and survive executors.

    ``save`` returns the table read back; ``drop`` deletes one that later steps no longer
    read. Whatever is left goes when the driver ends.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.count = spark, f"{checkpoint_root(spark)}/tideline-{name}-{uuid.uuid4().hex[:12]}", 0
        self.paths: dict[int, str] = {}
        if not Scratch._open:
            atexit.register(Scratch._close_all)
        Scratch._open.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    @classmethod
    def _close_all(cls) -> None:
        for s in cls._open:
            try:
                s._delete(s.base)
            except Exception:  # noqa: BLE001  the JVM may be gone already
                return


# ---- hot keys ---------------------------------------------------------------------------

SALTS = 8


def salted_join(big: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one row a key at most: a hot key's rows of ``big`` go to SALTS tasks.

    Rows of ``big`` are dealt by their column ``by``; ``small`` is sent SALTS times.
    """
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


# ---- a bounded filter of ids ------------------------------------------------------------

FILTER_BITS = 1 << 27


class IdFilter:
    """A bitmap of hashed ids: no id that was added is missed, few others pass.

    It only saves work ahead of an exact step. It has eight bits an id, FILTER_BITS (16 MB) at
    most; ``fits`` says whether that is enough for so many ids. It is built by one aggregation.
    """

    def __init__(self, ids: DataFrame, column: str, count: int):
        self.bits = bits = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (8 * count).bit_length()))
        bit = F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(bits))
        words = ids.select((bit / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(cast({column} as string)), 64) as int))").alias("b"))
        self.words = np.zeros(bits // 64, np.uint64)
        for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
            self.words[r["w"]] = r["b"] & 0xFFFFFFFFFFFFFFFF

    @staticmethod
    def fits(count: int) -> bool:
        return 8 * count <= FILTER_BITS

    @staticmethod
    def hashed(column: str) -> Column:
        """What ``passes`` is asked with."""
        return F.xxhash64(F.col(column).cast("string"))

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bit = np.mod(hashes, self.bits)
        return (self.words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


# ---- connected components ---------------------------------------------------------------


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find: (node, component) for every node of ``edges`` (a, b).

    Alternates large-star and small-star rounds until no edge changes; every round is two
    aggregations with map-side combining of minima and two joins with these minima. The joins are
    salted, so the links of a node that has very many go to SALTS tasks, which stream them.
    ``component`` is the smallest reachable id. The number of rounds grows with the logarithm of
    the longest chain.
    """

    def kept(df: DataFrame) -> tuple[DataFrame, dict]:
        # number and checksum of the edges come with the write
        seen = Observation()
        out = scratch.save(df.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
        return out, seen.get

    cur, before = kept(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = salted_join(both, low, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = scratch.save(large.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))))
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, low2, ["a"], "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        new, after = kept(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(low2.select("a", F.col("m").alias("b"))))
        scratch.drop(cur, large)
        cur, same, before = new, before == after, after
        if same:
            return cur.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components did not settle")
