"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

Tokens are the white-space words of the text with A-Z lower-cased, then one end token. All
training documents are counted (map-side combined, then one aggregation), and every document
is scored: tokens among the TOP most frequent are looked up in a broadcast table of bounded
size, the others are joined with the counts by token. No token outside the table is frequent,
so that join has no hot key.

The model is a softmax factored by frequency classes, WIDE to a node: the 254 most frequent
words, the end and ``rare`` are two choices deep, P(class | features) times P(symbol | class,
features); below ``rare`` all other words of the table follow by rank, LEVELS more choices deep,
and one leaf there stands for the words outside the table. Each choice is a small softmax over
sums of hashed feature weights: the word before, the word before that (a skip), and both as an
n-gram for the first two choices, the word before and the skip in turn for the deeper ones;
biases come from the counts. A word outside the table has its add-one share of that leaf, so the
whole is a distribution over words. The number of hashed weights grows with the distinct
tokens, up to a bound that keeps them small enough to broadcast. Training is one pass over every
training document in ROUNDS rounds: each task starts from the broadcast weights, makes sparse
gradient steps with per-weight rates over its share, for all choices, and the changes are averaged by tokens in a tree of bounded fan-in.

Null and empty texts are just the end. Repeated rows are counted as often as they come and
scored alike. Without a training document every token has probability 1 in the base and the
model's tables are empty. Only ``doc_id`` and ``text`` are read; empty tables give empty
results; texts of any length are scored whole, in blocks of tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Children of a node, choices for frequent words, and choices below ``rare``.
WIDE = 16
SYMBOLS = WIDE * WIDE
LEVELS = 4
LEAVES = WIDE**LEVELS
END, RARE, UNLISTED = SYMBOLS - 2, SYMBOLS - 1, LEAVES - 1
#: Words of the table: frequent ones and all leaves but the last.
TOP = END + LEAVES - 1
#: Longer tokens are never in the table.
TOP_BYTES = 40
TEMPLATES = 3
#: Powers of two of hashed rows: of each template of the first two choices, and of all deeper ones.
FEATURE_BITS, DEEP_BITS = (8, 12), (12, 16)
UNSEEN = 4096
ROUNDS = 2
BLOCK = 65_536
RATE = 0.15
FAN_IN = 64
CHUNKS = 128
FLUSH = 400_000
#: First node of each level below ``rare``.
_FIRST = np.cumsum([0, *(WIDE**k for k in range(LEVELS))])[:LEVELS]
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def tokens(text: str) -> list[bytes]:
    """Words without the end; bytes.lower and bytes.split know just ASCII, as the rule does."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token binary, n) over all texts; the end is the empty token."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", C.ARROW_ROWS)

    def run(batches):
        counts: Counter = Counter()
        out = lambda: C.records(["token", "n"], [list(counts), list(counts.values())], [pa.binary(), pa.int64()])
        for batch in batches:
            for b in C.slices(batch):
                counts.update(chain.from_iterable(map(tokens, C.texts_of(b))))
                counts[b""] += b.num_rows
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _log_shares(counts: np.ndarray) -> np.ndarray:
    """Log of each child's share in its node (rows); children without a count are closed."""
    total = np.maximum(counts.sum(1, keepdims=True), 1e-300)
    return np.where(counts > 0, np.log(np.maximum(counts, 1e-300) / total), -1e9).astype(np.float32)


_ONES = np.ones(WIDE, np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    """Probabilities of rows of scores, in place; scores of trained weights stay far below the bound."""
    np.exp(np.minimum(z, 60, out=z), out=z)
    z /= (z @ _ONES)[:, None]
    return z


def _log10_of(z: np.ndarray, child: np.ndarray) -> np.ndarray:
    """log10 of one probability of each row of scores; changes z."""
    own = np.minimum(z[np.arange(len(z)), child], 60)
    return (own - np.log(np.exp(np.minimum(z, 60, out=z), out=z) @ _ONES)) * np.float32(1 / np.log(10))


def _add(w: np.ndarray, squares: np.ndarray, at: np.ndarray, g: np.ndarray, base: int = 0) -> None:
    """One gradient step on the rows ``at`` of w, with per-weight rates; squares gathers squared gradients."""
    # keys fit in 16 bits, for which numpy sorts by radix
    at = at.astype(np.uint16)
    order = np.argsort(at, kind="stable")
    keys = at[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(np.take(g, order, axis=0), first, axis=0)
    rows = keys[first].astype(np.intp) + base
    squares[rows] += total * total
    w[rows] -= RATE * total / np.sqrt(squares[rows] + 1)


class Events:
    """Tokens of a slice, ends included: symbols, hashed features, and of the rare ones their leaves and contexts."""

    def __init__(self, sym, features, starts, rare, leaf, contexts):
        self.sym, self.features, self.starts, self.rare, self.leaf, self.contexts = sym, features, starts, rare, leaf, contexts


class Table:
    """What every task needs: the frequent words with their counts, totals, and the model's weights."""

    def __init__(self, top: list[tuple[bytes, int]], total: int, distinct: int, ends: int):
        self.ids = {t: i for i, (t, _) in enumerate(top)}
        n = np.array([c for _, c in top], np.int64)
        self.log_count = np.log10(n + 1.0)
        self.total, self.distinct, self.ends = total, distinct, ends
        self.words = min(END, len(top))
        # tokens outside the table
        self.rest_total, self.rest_distinct = total - ends - int(n.sum()), max(0, distinct - len(top) - (ends > 0))
        grow = lambda bits, by: max(bits[0], min(bits[1], max(1, distinct // by).bit_length()))
        self.feature_bits, self.deep_bits = grow(FEATURE_BITS, 256), grow(DEEP_BITS, 8)
        counts = np.zeros(SYMBOLS)
        counts[: self.words] = n[: self.words] + 1
        counts[END], counts[RARE] = ends + 1, total - ends - n[: self.words].sum() + 1
        by_class = counts.reshape(WIDE, WIDE)
        self.b1, self.b2 = _log_shares(by_class.sum(1)[None])[0], _log_shares(by_class)
        leaves = np.zeros(LEAVES)
        leaves[: len(top) - self.words] = n[self.words :] + 1
        leaves[UNLISTED] = self.rest_total + self.rest_distinct + 1
        self.b3 = np.concatenate([_log_shares(leaves.reshape(WIDE ** (k + 1), -1).sum(1).reshape(-1, WIDE)) for k in range(LEVELS)])
        rows = TEMPLATES << self.feature_bits
        self.w1 = np.zeros((rows, WIDE), np.float32)
        self.w2 = np.zeros((rows * WIDE, WIDE), np.float32)
        self.w3 = np.zeros((1 << self.deep_bits, WIDE), np.float32)

    def encode(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """All words, their ids (-1: not in the table), and the number of words of each text."""
        words, sizes, get = [], [], self.ids.get
        for t in texts:
            w = tokens(t)
            words += w
            sizes.append(len(w))
        return words, np.fromiter((get(w, -1) for w in words), np.int64, len(words)), np.array(sizes, np.int64)

    def events(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> Events:
        """Events of all tokens, in order; a text's end comes after its words."""
        ctx = ids + 2
        unknown = np.flatnonzero(ids < 0)
        ctx[unknown] = np.fromiter((zlib.crc32(words[i]) for i in unknown.tolist()), np.int64, len(unknown)) % UNSEEN + len(self.ids) + 2
        sym = np.where((ids >= 0) & (ids < self.words), ids, RARE)
        leaf = np.where(ids >= 0, ids - self.words, UNLISTED)[sym == RARE]
        ends = np.cumsum(sizes)
        sym, ctx = np.insert(sym, ends, END), np.insert(ctx, ends, 1)
        starts = np.concatenate([[0], (ends + np.arange(1, len(sizes) + 1))[:-1]]).astype(np.int64)
        one, two = np.zeros(len(ctx), np.uint64), np.zeros(len(ctx), np.uint64)
        one[1:], two[2:] = ctx[:-1], ctx[:-2]
        one[starts] = 0
        two[starts] = 0
        two[np.minimum(starts + 1, len(two) - 1)] = 0
        shift = np.uint64(64 - self.feature_bits)
        f = np.stack([(one + np.uint64(7)) * _K[0] >> shift, (two + np.uint64(9)) * _K[1] >> shift, ((one * _K[1] ^ two) * _K[2] ^ (two * _K[0])) * _K[1] >> shift], axis=1).astype(np.intp)
        rare = np.flatnonzero(sym == RARE)
        return Events(sym, f + (np.arange(TEMPLATES) << self.feature_bits), starts, rare, leaf, ((one[rare] + np.uint64(7)) * _K[0], (two[rare] + np.uint64(9)) * _K[1]))

    def _forward(self, sym: np.ndarray, f: np.ndarray):
        """Classes and scores of the first two choices."""
        cls = sym // WIDE
        z1, z2 = np.repeat(self.b1[None], len(sym), 0), np.take(self.b2, cls, axis=0)
        for k in range(TEMPLATES):
            z1 += np.take(self.w1, f[:, k], axis=0)
            z2 += np.take(self.w2, f[:, k] * WIDE + cls, axis=0)
        return cls, z1, z2

    def _below(self, leaf: np.ndarray, contexts: tuple[np.ndarray, np.ndarray], level: int):
        """Child, hashed row and scores of the choice at a level below ``rare``."""
        node = _FIRST[level] + (leaf >> 4 * (LEVELS - level))
        row = ((contexts[level % 2] ^ (node.astype(np.uint64) * _K[2])) * _K[0] >> np.uint64(64 - self.deep_bits)).astype(np.intp)
        return leaf >> 4 * (LEVELS - 1 - level) & WIDE - 1, row, np.take(self.b3, node, axis=0) + np.take(self.w3, row, axis=0)

    def log10(self, e: Events) -> np.ndarray:
        """log10 of the probability of every event; a word outside the table counts as its leaf."""
        out = np.empty(len(e.sym))
        for at in range(0, len(e.sym), BLOCK):
            s = e.sym[at : at + BLOCK]
            cls, z1, z2 = self._forward(s, e.features[at : at + BLOCK])
            out[at : at + BLOCK] = _log10_of(z1, cls) + _log10_of(z2, s % WIDE)
        for at in range(0, len(e.rare), BLOCK):
            leaf, contexts = e.leaf[at : at + BLOCK], tuple(c[at : at + BLOCK] for c in e.contexts)
            for level in range(LEVELS):
                child, _, z = self._below(leaf, contexts, level)
                out[e.rare[at : at + BLOCK]] += _log10_of(z, child)
        return out

    def step(self, e: Events, squares: list[np.ndarray], levels: range = range(LEVELS)) -> None:
        """Gradient steps over the events, block by block, below ``rare`` at these levels; squares is as ``weights``."""
        for at in range(0, len(e.sym), BLOCK):
            sym, f = e.sym[at : at + BLOCK], e.features[at : at + BLOCK]
            cls, z1, z2 = self._forward(sym, f)
            p1, p2, n = _softmax(z1), _softmax(z2), np.arange(len(sym))
            p1[n, cls] -= 1
            p2[n, sym % WIDE] -= 1
            for k in range(TEMPLATES):
                first = k << self.feature_bits
                _add(self.w1, squares[0], f[:, k] - first, p1, first)
                _add(self.w2, squares[1], (f[:, k] - first) * WIDE + cls, p2, first * WIDE)
        for at in range(0, len(e.rare), BLOCK):
            leaf, contexts = e.leaf[at : at + BLOCK], tuple(c[at : at + BLOCK] for c in e.contexts)
            n = np.arange(len(leaf))
            for level in levels:
                child, row, z = self._below(leaf, contexts, level)
                p = _softmax(z)
                p[n, child] -= 1
                _add(self.w3, squares[2], row, p)

    def weights(self) -> list[np.ndarray]:
        return [self.w1, self.w2, self.w3]


def _train_round(train: DataFrame, table: Table, part: int) -> Table:
    """Every task makes gradient steps over its documents of this round; changes are averaged by tokens."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(table)
    mine = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == part).select("text", F.spark_partition_id().alias("pid"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", C.ARROW_ROWS)

    def run(batches):
        start = shared.value
        t = Table.__new__(Table)
        t.__dict__.update(start.__dict__)
        t.w1, t.w2, t.w3 = (w.copy() for w in start.weights())
        squares, seen, pid = [np.zeros_like(w) for w in t.weights()], 0, 0
        for batch in batches:
            for b in C.slices(batch):
                pid = b.column(1)[0].as_py()
                e = t.events(*t.encode(C.texts_of(b)))
                seen += len(e.sym)
                t.step(e, squares)
        if seen:
            flat = np.concatenate([(w - v).ravel() for w, v in zip(t.weights(), start.weights())])
            parts = np.array_split(flat, CHUNKS)
            yield C.records(["chunk", "grp", "seen", "delta"], [list(range(CHUNKS)), [pid] * CHUNKS, [float(seen)] * CHUNKS, [x.astype("<f2").tobytes() for x in parts]], [pa.int32(), pa.int64(), pa.float64(), pa.binary()])

    def add(pdf):
        # means weighted by tokens; half precision does for changes
        seen = pdf["seen"].sum()
        total = sum(np.frombuffer(x, "<f2").astype(np.float64) * n for x, n in zip(pdf["delta"], pdf["seen"]))
        return pdf.iloc[:1].assign(seen=seen, delta=(total / seen).astype("<f2").tobytes())

    level, parts = mine.mapInArrow(run, "chunk int, grp long, seen double, delta binary"), mine.rdd.getNumPartitions()
    while parts > 1:
        level = level.withColumn("grp", F.expr(f"grp div {FAN_IN}")).groupBy("chunk", "grp").applyInPandas(add, "chunk int, grp long, seen double, delta binary")
        parts = -(-parts // FAN_IN)
    got = sorted(level.collect(), key=lambda r: r["chunk"])
    if got:
        flat, at = np.concatenate([np.frombuffer(bytes(r["delta"]), "<f2") for r in got]).astype(np.float32), 0
        moved = []
        for w in table.weights():
            moved.append(w + flat[at : at + w.size].reshape(w.shape))
            at += w.size
        table.w1, table.w2, table.w3 = moved
    shared.unpersist()
    return table


def fit(train: DataFrame, counts: DataFrame) -> Table:
    """Model of the training documents; ``counts`` are their token counts."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.length("token") == 0, F.col("n"))), F.lit(0)).alias("ends")).first()
    # how many tokens have which count, in a bounded number of steps, tells from which count on there are TOP at most
    words = counts.where(F.length("token").between(1, TOP_BYTES)).withColumn("step", F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor((F.log2("n") - 10) * 64)))
    least, total = 1 << 62, 0
    for r in sorted(words.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > TOP:
            break
        least = r["step"]
    top = sorted(((bytes(r["token"]), r["n"]) for r in words.where(F.col("step") >= least).select("token", "n").collect()), key=lambda x: (-x[1], x[0]))
    table = Table(top, sums["n"], sums["v"], sums["ends"])
    for part in range(ROUNDS):
        table = _train_round(train, table, part)
    return table


def score(docs: DataFrame, table: Table, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "lm")
    shared = spark.sparkContext.broadcast(table)
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", C.ARROW_ROWS)
    names = ["doc_id", "rid", "n_tokens", "known", "log_sum", "model", "n_rest", "rest"]

    def run(batches):
        t, row = shared.value, 0
        end_log = np.log10(t.ends + 1.0)
        for batch in batches:
            for b in C.slices(batch):
                words, ids, sizes = t.encode(C.texts_of(b))
                e = t.events(words, ids, sizes)
                model = np.add.reduceat(t.log10(e), e.starts)
                logs = np.where(ids >= 0, t.log_count[ids] if len(t.log_count) else 0.0, 0.0)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                cum = [np.concatenate([[0], np.cumsum(x)]) for x in (ids >= 0, logs)]
                known, log_sum = (c[bounds[1:]] - c[bounds[:-1]] for c in cum)
                unknown = np.flatnonzero(ids < 0)
                cut = np.searchsorted(unknown, bounds)
                rest = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array([words[j] for j in unknown.tolist()], pa.binary()))
                base = row + (b.column(2)[0].as_py() << 40)
                row += len(sizes)
                yield C.records(names, [b.column(0), np.arange(base, base + len(sizes)), sizes + 1, known + (t.ends > 0), log_sum + end_log, model, sizes - known, rest], [None, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), None])

    src = docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("pid"))
    rows = scratch.save(src.mapInArrow(run, f"doc_id {kind}, rid long, n_tokens long, known long, log_sum double, model double, n_rest long, rest array<binary>"))
    rest = rows.select("rid", F.explode("rest").alias("token")).join(counts, "token")
    rest = rest.groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("log_more"))
    out = rows.drop("rest").join(rest, "rid", "left")
    log_more = F.coalesce("log_more", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(table.total).cast("long").alias("train_tokens"),
        (F.col("log_sum") + log_more - F.col("n_tokens") * float(np.log10(table.total + table.distinct + 1.0))).alias("base_score"),
        (F.col("model") + log_more - F.col("n_rest") * float(np.log10(table.rest_total + table.rest_distinct + 1.0))).alias("score"),
    )


def held_out():
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 2, F.lit(False))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    train = docs.where(~held_out())
    counts = C.Scratch(spark, "lm-counts").save(count_tokens(train))
    out = score(docs, fit(train, counts), counts)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
