"""Periodic runs of words: suffix array, longest previous factors, boundary extensions, copying.

A run is a stretch of words with smallest period q and a length of at least LEAST and TIMES * q
that no neighbouring word extends keeping q. Texts are split at the bytes 20 and 09 to 0D (hex), and runs
never cross texts. The texts of a slice are worked on together:

1. Suffix array by prefix doubling over (text, word); only suffixes that are not yet alone are sorted
   again. The ranks of each step are kept: equal ranks of step k mean 2**k equal words, so a common
   extension of two places, forward or backward, takes one comparison a step, for whole arrays of places.
2. Common prefixes of neighbours in the array, then the longest previous factor of each word: places leave
   the linked list of the sorted suffixes from the last to the first, and a place's two neighbours
   then are its best earlier ones.
3. Blocks of the LZ factorisation: a block is its first word's longest previous factor, or a new word.
4. Boundary extensions after Main. Of a run of four periods that touches a boundary b, two periods lie right of
   b or two lie left of it. For the last boundary it touches, two periods to the right fit into the block
   that follows, so q is at most half of it; else q is below the length of the block before, or the run
   ends at b and the boundary before b has it in one of these ways. So the candidates (b, q) are at most one
   and a half times the words; those with equal words at the distance q are kept, then those with a whole square, and what
   is left is extended to both sides.
5. Copying: any other run lies strictly inside one block, whose earlier occurrence has it too. Runs stand
   in buckets by start; places of a block take over, from left to right, what the bucket of their
   source holds.

The same stretch found with several periods keeps the smallest. Null texts count as empty, and texts
without words have no runs; repeated rows are treated alike, ids of any type and null ids come back as they are; empty
tables give empty results. A text is one row's work: its memory is 4 bytes a word and step, and there
are as many steps as the longest repeat has binary digits. ``collapse`` keeps all columns whatever their names;
``periodic`` reads ``doc_id``, ``text`` and the argument of ``rewrite``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LEAST, TIMES = 6, 4
#: Given a row's argument and its number of words: which word stands at each place; None leaves them.
Rewrite = Callable[[int, int], "np.ndarray | None"]


class Suffixes:
    """Sorted suffixes of several sequences; ``bounds`` has n + 1 places of their ends."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        n = self.n = len(words)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        end = bounds[1:][doc]
        span = int(words.max()) + 1 if n else 1
        order = np.argsort(doc * span + words, kind="stable")
        rank = self._dense((doc * span + words)[order], order, np.zeros(n, np.int64), np.arange(n))
        self.levels, step = [], 1
        while True:
            self.levels.append(np.append(rank, -1).astype(np.int32))
            size = np.bincount(rank, minlength=n) if n else np.zeros(0, np.int64)
            active = np.flatnonzero(size[rank] > 1)
            if not len(active):
                break
            ahead = active + step
            inside = ahead < end[active]
            second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
            key = rank[active] * (n + 1) + second
            by = np.argsort(key, kind="stable")
            rank = rank.copy()
            old = rank[active[by]]
            first = np.ones(len(by), bool)
            first[1:] = old[1:] != old[:-1]
            base = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
            new = np.ones(len(by), bool)
            new[1:] = np.diff(key[by]) != 0
            start = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            rank[active[by]] = old + start - base
            step *= 2
        self.rank = rank
        self.array = np.empty(n, np.int64)
        self.array[rank] = np.arange(n)

    @staticmethod
    def _dense(keys: np.ndarray, order: np.ndarray, out: np.ndarray, index: np.ndarray) -> np.ndarray:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        out[order] = np.maximum.accumulate(np.where(new, index, 0)) if len(keys) else index
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on, for i != j of one sequence."""
        long = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            r = self.levels[k]
            same = r[np.minimum(i + long, self.n)] == r[np.minimum(j + long, self.n)]
            long += same.astype(np.int64) << k
        return long

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before i and before j, for i < j of one sequence."""
        long = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            r = self.levels[k]
            p = i - long - (1 << k)
            same = (p >= 0) & (r[np.maximum(p, 0)] == r[np.maximum(j - long - (1 << k), 0)])
            long += same.astype(np.int64) << k
        return long

    def previous(self) -> tuple[list[int], list[int]]:
        """Longest previous factor of each place, and a place where it stands earlier."""
        n = self.n
        if not n:
            return [], []
        lcp = np.zeros(n + 1, np.int64)
        lcp[1:n] = self.ahead(self.array[:-1], self.array[1:])
        common, place, rank = lcp.tolist(), self.array.tolist(), self.rank.tolist()
        before, after = list(range(-1, n)), list(range(1, n + 2))
        factor, source = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            r = rank[i]
            a, b = common[r], common[after[r]]
            low, high = before[r], after[r]
            if a >= b:
                if a:
                    factor[i], source[i] = a, place[low]
                common[high] = b
            else:
                factor[i], source[i] = b, place[high]
                common[high] = a
            if low >= 0:
                after[low] = high
            before[high] = low
        return factor, source


def _blocks(factor: list[int], bounds: np.ndarray) -> np.ndarray:
    """Starts of the blocks of all sequences, and the end of the last."""
    out, ends = [], bounds[1:].tolist()
    at = 0
    for end in ends:
        while at < end:
            out.append(at)
            at += factor[at] or 1
    out.append(at)
    return np.array(out, np.int64)


def _fan(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, 1..count) of every one."""
    at = np.repeat(np.arange(len(count)), count)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + 1


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each sequence, by start, then period."""
    if times < 4:
        raise ValueError("two periods on one side of a boundary need four in all")
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    if not len(words):
        return out
    s = Suffixes(words, bounds)
    factor, source = s.previous()
    cut = _blocks(factor, bounds)
    size = np.diff(cut)
    low = bounds[np.searchsorted(bounds, cut[:-1], side="right") - 1]
    # squares right of a block's start; squares left of a block's end, or of the end of the text
    at, q = _fan(size // 2)
    b = cut[at]
    keep = words[b] == words[b + q]
    at2, q2 = _fan(size)
    e = cut[at2 + 1]
    fits = e - 2 * q2 >= low[at2]
    e, q2 = e[fits], q2[fits]
    keep2 = words[e - 1] == words[e - 1 - q2]
    e, q2 = e[keep2], q2[keep2]
    first, period = np.concatenate([b[keep], e - 2 * q2]), np.concatenate([q[keep], q2])
    right = s.ahead(first, first + period)
    square = right >= period
    first, period, right = first[square], period[square], right[square]
    start = first - s.behind(first, first + period)
    end = first + period + right
    long = (end - start >= least) & (end - start >= times * period)
    found: dict[tuple[int, int], int] = {}
    for x, y, p in zip(start[long].tolist(), end[long].tolist(), period[long].tolist()):
        if p < found.get((x, y), p + 1):
            found[x, y] = p
    if not found:
        return out
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (x, y), p in found.items():
        buckets.setdefault(x, []).append((y - x, p))
    starts = cut.tolist()
    touched = np.zeros(len(bounds) - 1, bool)
    touched[np.searchsorted(bounds, np.array(list(buckets)), side="right") - 1] = True
    where = (np.searchsorted(bounds, cut[:-1], side="right") - 1).tolist()
    for k in range(len(starts) - 1):
        b, c = starts[k], starts[k + 1]
        if c - b < least + 2 or not touched[where[k]]:
            continue
        back = b - source[b]
        for x in range(b + 1, c - least):
            for length, p in buckets.get(x - back, ()):
                if x + length < c:
                    buckets.setdefault(x, []).append((length, p))
    for x in sorted(buckets):
        d = int(np.searchsorted(bounds, x, side="right")) - 1
        out[d] += [(x - int(bounds[d]), length, p) for length, p in sorted(set(buckets[x]), key=lambda r: r[1])]
    return out


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    mark = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        mark[start + period] += 1
        mark[start + length] -= 1
    return np.cumsum(mark[:n]) > 0


def _worked(texts: list[str | None], arguments: list, rewrite: Rewrite | None) -> tuple[list[int], list[list[tuple[int, int, int]]], list[str | None]]:
    """Words, runs and collapsed text of each text; None where nothing changes."""
    code: dict[bytes, int] = {}
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    ids = [np.array([code.setdefault(w, len(code)) for w in ws], np.int64) for ws in split]
    orders = [rewrite(a, len(ws)) if rewrite and a is not None else None for a, ws in zip(arguments, split)]
    ids = [x if o is None else x[o] for x, o in zip(ids, orders)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    found = runs_of(np.concatenate(ids) if ids else np.zeros(0, np.int64), bounds)
    out: list[str | None] = []
    for ws, o, runs in zip(split, orders, found):
        at = np.arange(len(ws)) if o is None else o
        if runs:
            at = at[~dropped(len(at), runs)]
        out.append(b" ".join(ws if o is None and not runs else [ws[i] for i in at.tolist()]).decode("utf-8", "surrogatepass"))
    return [len(x) for x in ids], found, out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic(docs: DataFrame, rewrite: Rewrite | None = None, argument: Column | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs, and its words without what runs repeat, joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            n, runs, kept = _worked(b.column(1).to_pylist(), b.column(2).to_pylist(), rewrite)
            listed = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs]
            return C.records(["doc_id", "n_words", "runs", "collapsed"], [b.column(0), n, listed, kept], [None, pa.int64(), pa.list_(_RUN), pa.string()])

        return work

    rows = docs.select("doc_id", "text", (F.lit(None) if argument is None else argument).cast("long").alias("_argument"))
    return C.map_rows(rows, make, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def collapse(docs: DataFrame) -> DataFrame:
    """The rows, texts with runs in their collapsed form; other texts, null ones too, stay as they are."""
    at = docs.columns.index("text")

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(at).to_pylist()
            _, runs, kept = _worked(texts, [None] * len(texts), None)
            return b.set_column(at, b.schema.field(at), pa.array([k if r else t for t, r, k in zip(texts, runs, kept)], b.schema.field(at).type))

        return work

    return C.map_rows(docs, make, docs.schema)


def looped(g: int, n: int) -> np.ndarray | None:
    """From word g % n on, the words repeat with a period of a third to a tenth of the rest."""
    if not n:
        return None
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8"))
    d = periodic(C.read(spark, sf_dir, "documents"), looped, F.when(h % 10 == 0, F.floor(h / 10)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    d = d.withColumn("_best", best)
    length, period = F.col("_best.length"), -F.col("_best.period")
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.encode(lines, "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"))
