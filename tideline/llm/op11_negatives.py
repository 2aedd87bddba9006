"""Hard negatives by a two-dimensional block matrix product (SUMMA's grid).

Vectors are quantised to integers, floor(256 * x), and a row's score is its inner product with
the anchor. Rows and anchors are sharded by hash into blocks of about ROWS and ANCHORS, and
their components into chunks; one cell (anchor block, row block, chunk) of the grid is one
group, which multiplies its two sub-matrices into a tile of partial scores. A shuffle brings
the partial tiles of a block pair together, where they are added as int64; the sum is reduced at
once to what the next step needs, so no tile is ever kept.

Two products are run. The first one has labels sharded too, so that only blocks with equal label
hashes meet: it gives each anchor's POSITIVES best other rows of its label. Each of them
sets a window of scores, LOW to HIGH percent of its own. The second product is that of all
anchors with all rows; of a finished tile it keeps, for each window, the NEGATIVES best rows of
another label that lie inside, and the tiles' lists are merged by a ranked window that Spark
limits before its shuffle. A hot label or a hot vector is spread like any other rows, since
blocks come from a hash of the whole row.

Tiles travel in the narrowest integers that hold their values and are int64 wherever they are
added. Products are taken in float64 where every partial sum is below 2**53, and in int64
otherwise; a score beyond 64 bits wraps.

Rows with a null id, label or vector and rows with a null or non-finite component take no part.
Repeated rows count once; rows that share an id but differ count each, and never as each other's
positive. Ties go to the smaller id. Shorter vectors count as padded with zeros. Fewer positives
or negatives than asked for are returned as they are; a positive without a negative in its window gives no
row. Empty tables give empty results. Only the three columns named are read. Ids and labels may be of any type
that can be ordered.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Rows and anchors of a block, components of a chunk, chunks at most and shards of labels at most.
ROWS, ANCHORS = 4096, 512
WIDTH, CHUNKS, SHARDS = 32, 8, 1024

_CELL = ["shard", "i", "j", "chunk"]
_TILE = ["shard", "i", "j"]


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _packed(x: np.ndarray) -> tuple[bytes, str]:
    small = narrow(x)
    return small.tobytes(), small.dtype.str


def _unpacked(data: bytes, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(shape).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, modulo 2**64."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    with np.errstate(over="ignore"):
        return a @ b.T


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), held within 64 bits."""
    q = np.floor(values.astype(np.float64) * SCALE)
    out = np.clip(q, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return out


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores s with LOW * p <= 100 * s <= HIGH * p, without overflow."""
    q, r = positive // 100, positive % 100
    return LOW * q + -(-LOW * r // 100), HIGH * q + HIGH * r // 100


def usable(rows: DataFrame, id_col: str, label: Column, vector: str) -> DataFrame:
    """(id, label, vec, key) of the rows that take part, each once; ``key`` tells rows of one id apart."""
    v = F.col(vector)
    fit = F.col(id_col).isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    d = rows.select(F.col(id_col), label.alias("label"), v).where(fit).select(F.col(id_col).alias("id"), "label", v.alias("vec")).distinct()
    return d.withColumn("key", F.xxhash64("id", "label", "vec"))


def _matrices(rows: DataFrame, chunks: int, width: int, more: dict[str, str]) -> DataFrame:
    """One record a (shard, block, chunk): the rows' sub-matrix and, with the first chunk, what the rows are."""
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("id", "label")}
    part = F.explode(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda k: F.struct(k.alias("chunk"), F.slice("vec", k * width + 1, width).alias("part"))))
    cut = rows.select("shard", "block", "id", "label", "key", *more, part.alias("x")).select("shard", "block", "id", "label", "key", *more, "x.*")

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = table.sort_by([("id", "ascending"), ("key", "ascending")]) if len(table) else table
        parts = order.column("part").combine_chunks()
        parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
        lengths, flat = np.diff(parts.offsets.to_numpy()), parts.flatten().to_numpy(zero_copy_only=False)
        m = np.zeros((len(order), width), np.int64)
        m[np.repeat(np.arange(len(order)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = quantised(flat)
        data, kind = _packed(m)
        first = key[2].as_py() == 0
        about = [[order.column(n).to_pylist() if first else None] for n in ("id", "label", "key", *more)]
        return pa.table([pa.array([key[n].as_py()], t) for n, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.int32()))] + [pa.array([len(order)], pa.int32()), pa.array([data], pa.binary()), pa.array([kind])] + [pa.array(v, pa.list_(order.schema.field(n).type)) for n, v in zip(("id", "label", "key", *more), about)], names=["shard", "block", "chunk", "n", "data", "kind", "ids", "labels", "keys", *[f"{n}s" for n in more]])

    listed = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, keys array<long>" + "".join(f", {n}s array<{t}>" for n, t in more.items())
    return cut.groupBy("shard", "block", "chunk").applyInArrow(build, f"shard int, block int, chunk int, n int, data binary, kind string, {listed}")


def _grid(anchors: DataFrame, rows: DataFrame, counts: DataFrame | tuple[int, int], chunks: int, width: int, more: dict[str, str]) -> DataFrame:
    """Partial tiles of every cell; ``counts`` has the blocks (na, nb) of each shard, or those of all rows in shard 0."""
    pick = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int").alias("block")

    def sized(d: DataFrame) -> DataFrame:
        if isinstance(counts, tuple):
            return d.withColumns({"na": F.lit(counts[0]), "nb": F.lit(counts[1])})
        return d.join(F.broadcast(counts), "shard")  # SHARDS rows at most

    a = _matrices(sized(anchors).select("shard", pick("na"), "id", "label", "key", "vec", *more), chunks, width, more)
    b = _matrices(sized(rows).select("shard", pick("nb"), "id", "label", "key", "vec"), chunks, width, {})
    side = lambda d, own, other, n: sized(d).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).withColumnRenamed("block", own).drop("na", "nb")
    kinds = {n: a.schema[n].dataType.simpleString() for n in ("ids", "labels")}
    a_more = [f"{n}s" for n in more]
    about = [("a_ids", "ids", 0), ("a_labels", "labels", 0), ("a_keys", "keys", 0), *[(f"a_{n}", n, 0) for n in a_more], ("b_ids", "ids", 1), ("b_labels", "labels", 1), ("b_keys", "keys", 1)]

    def cell(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in [*_CELL, "na", "nb", "data", "kind", *[x[0] for x in about]]}
        if len(left) and len(right):
            sides = [{n: t.column(n)[0] for n in t.column_names} for t in (left, right)]
            m = [_unpacked(s["data"].as_py(), s["kind"].as_py(), (s["n"].as_py(), width)) for s in sides]
            data, kind = _packed(product(*m))
            for n, v in zip([*_CELL, "na", "nb", "data", "kind"], [*(k.as_py() for k in key), len(m[0]), len(m[1]), data, kind]):
                out[n] = [v]
            for n, name, s in about:
                out[n] = [sides[s][name].as_py()]
        types = dict(zip([*_CELL, "na", "nb", "data", "kind"], [pa.int32()] * 6 + [pa.binary(), pa.string()])) | {n: (left, right)[s].schema.field(name).type for n, name, s in about}
        return pa.table([pa.array(v, types[n]) for n, v in out.items()], names=list(out))

    schema = f"shard int, i int, j int, chunk int, na int, nb int, data binary, kind string, a_ids {kinds['ids']}, a_labels {kinds['labels']}, a_keys array<long>" + "".join(f", a_{n}s array<{t}>" for n, t in more.items()) + f", b_ids {kinds['ids']}, b_labels {kinds['labels']}, b_keys array<long>"
    return side(a, "i", "j", "nb").groupBy(*_CELL).cogroup(side(b, "j", "i", "na").groupBy(*_CELL)).applyInArrow(cell, schema)


class Tile:
    """The sum of a block pair's partial tiles, with what its rows and columns are."""

    def __init__(self, table: pa.Table):
        first = next(r for r in range(len(table)) if table.column("chunk")[r].as_py() == 0)
        shape = (table.column("na")[first].as_py(), table.column("nb")[first].as_py())
        self.scores = np.zeros(shape, np.int64)
        with np.errstate(over="ignore"):
            for r in range(len(table)):
                self.scores += _unpacked(table.column("data")[r].as_py(), table.column("kind")[r].as_py(), shape)
        self.about = {n: table.column(n)[first].as_py() for n in table.column_names if n[:2] in ("a_", "b_")}
        known: dict = {}
        code = lambda values: np.array([known.setdefault(v, len(known)) for v in values])
        self.same = code(self.about["a_labels"])[:, None] == code(self.about["b_labels"])[None, :]
        seen: dict = {}
        ids = [np.array([seen.setdefault(v, len(seen)) for v in self.about[n]]) for n in ("a_ids", "b_ids")]
        self.other = ids[0][:, None] != ids[1][None, :]

    def ranked(self, mask: np.ndarray):
        """For each anchor, the columns that count, by falling score and rising id; columns are in the order of the ids."""
        for r in range(len(mask)):
            at = np.flatnonzero(mask[r])
            yield r, at[np.argsort(~self.scores[r, at], kind="stable")]


def _best_positives(parts: DataFrame, count: int) -> DataFrame:
    """Of each tile the anchors' ``count`` best other rows of the same label."""
    kind = parts.schema["b_ids"].dataType.elementType.simpleString()

    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = Tile(table)
        rows = [(r, c) for r, order in t.ranked(t.same & t.other) for c in order[:count]]
        a, b = t.about, {n: [t.about[n][c] for _, c in rows] for n in ("b_ids", "b_keys")}
        return pa.table([pa.array([a["a_ids"][r] for r, _ in rows], table.schema.field("a_ids").type.value_type), pa.array([a["a_keys"][r] for r, _ in rows], pa.int64()), pa.array(b["b_ids"], table.schema.field("b_ids").type.value_type), pa.array(b["b_keys"], pa.int64()), pa.array([int(t.scores[r, c]) for r, c in rows], pa.int64())], names=["anchor_id", "anchor_key", "id", "key", "score"])

    return parts.groupBy(*_TILE).applyInArrow(reduce, f"anchor_id {kind}, anchor_key long, id {kind}, key long, score long")


def _best_negatives(parts: DataFrame, count: int) -> DataFrame:
    """Of each tile, for each window of its anchors, the ``count`` best rows of another label inside."""
    kind = parts.schema["b_ids"].dataType.elementType.simpleString()

    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t, rows = Tile(table), []
        low, high = zip(*(window(np.array([p["score"] for p in ps], np.int64)) for ps in t.about["a_positivess"])) if t.about["a_positivess"] else ((), ())
        lowest = np.array([x.min() if len(x) else 1 for x in low])
        highest = np.array([x.max() if len(x) else 0 for x in high])
        inside = ~t.same & (t.scores >= lowest[:, None]) & (t.scores <= highest[:, None])
        for r, order in t.ranked(inside):
            s = ~t.scores[r, order]  # rising
            for p, (lo, hi) in enumerate(zip(low[r], high[r])):
                at = np.searchsorted(s, ~hi)
                rows += [(r, p, c) for c in order[at : min(at + count, np.searchsorted(s, ~lo, side="right"))]]
        a, b = t.about, t.about
        ps = [a["a_positivess"][r][p] for r, p, _ in rows]
        id_type = table.schema.field("b_ids").type.value_type
        columns = [([a["a_ids"][r] for r, _, _ in rows], id_type), ([a["a_keys"][r] for r, _, _ in rows], pa.int64()), ([p["id"] for p in ps], id_type), ([p["place"] for p in ps], pa.int32()), ([p["score"] for p in ps], pa.int64()), ([b["b_ids"][c] for _, _, c in rows], id_type), ([b["b_keys"][c] for _, _, c in rows], pa.int64()), ([int(t.scores[r, c]) for r, _, c in rows], pa.int64())]
        return pa.table([pa.array(v, k) for v, k in columns], names=["anchor_id", "anchor_key", "positive_id", "place", "positive_score", "id", "key", "score"])

    return parts.groupBy(*_TILE).applyInArrow(reduce, f"anchor_id {kind}, anchor_key long, positive_id {kind}, place int, positive_score long, id {kind}, key long, score long")


def _top(rows: DataFrame, count: int, place: str, *keys: str) -> DataFrame:
    """The ``count`` first of each group by falling score, id and key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "key")
    return rows.withColumn(place, F.row_number().over(w)).where(F.col(place) <= count)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | None = None, vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, block: tuple[int, int] = (ANCHORS, ROWS), width: int = WIDTH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``anchor`` (over ``id``) holds."""
    scratch = C.Scratch(rows.sparkSession, "negatives")
    data = scratch.save(usable(rows, id_col, F.col("label") if label is None else label, vector))
    size = data.agg(F.count("*").alias("n"), F.count_if(anchor).alias("a"), F.max(F.size("vec")).alias("d")).first()
    longest = max(1, size["d"] or 0)
    width = max(width, math.ceil(longest / CHUNKS))
    chunks = math.ceil(longest / width)
    # equal labels share a shard; a large shard has more blocks
    shards = min(SHARDS, max(1, size["n"] // block[1]))
    by_label = data.withColumn("shard", F.pmod(F.xxhash64("label"), F.lit(shards)).cast("int"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int").alias(n)
    counts = by_label.groupBy("shard").agg(F.count_if(anchor).alias("na"), F.count("*").alias("nb")).where("na > 0").select("shard", blocks("na", block[0]), blocks("nb", block[1]))
    counts = rows.sparkSession.createDataFrame(counts.collect(), counts.schema)
    parts = _grid(by_label.where(anchor), by_label, counts, chunks, width, {})
    best = _top(_best_positives(parts, positives), positives, "place", "anchor_id", "anchor_key")
    found = scratch.save(best.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives")))
    windows = data.where(anchor).withColumn("shard", F.lit(0)).join(found.select(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key"), "positives"), ["id", "key"])
    whole = (max(1, math.ceil(size["a"] / block[0])), max(1, math.ceil(size["n"] / block[1])))
    parts = _grid(windows, data.withColumn("shard", F.lit(0)), whole, chunks, width, {"positives": found.schema["positives"].dataType.simpleString()})
    ranked = _top(_best_negatives(parts, negatives), negatives, "rank", "anchor_id", "anchor_key", "place")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(C.read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


SQL = """WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY rank <= 10"""
