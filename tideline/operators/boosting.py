"""Gradient-boosted trees, many fits at once, and exact attributions to features.

Cross-validated calibration and leave-one-group-out validation fit the same rows again and again with some of them left
out. Here all fits grow level by level together: one pass over the rows adds up the gradient histograms of every fit's
nodes, so the number of jobs is that of a single fit. Of two siblings only the one with fewer rows is added up, the other
is what it leaves of their parent. Rows that have the same bins and take part in the same fits are one row that counts as
often. Rows are kept as blocks of binned features, a feature after the other, dealt over all cores; those of a block take
part in the same fits where there are enough of them, and a block has the margins of these fits only. Features with few bins
share a code, whose sums are taken apart once a task. Rows find their leaves by a comparison of a whole column with each
node's edge. The blocks are persisted with the margins of each round, so no round goes through the trees before it, and
written every SAVE rounds, so lineage does not grow with the trees. Up to WHOLE_ROWS different rows are few enough to be
broadcast: then each fit is a task of its own, and there is a single job.

Loss is the logistic one; splits take the largest reduction of squared residuals between the quantile edges of a
feature, leaves the Newton step times the rate. Ties go to the first feature and the lowest edge.

Attributions are Shapley values of the game in which features outside a coalition follow a split's branches
by the share of training rows ("path-dependent"). A tree's value is a sum over its leaves, and a leaf's game is a product over the few features on its
path, so each leaf's values come from a polynomial in the number of known features. They depend on which of these features
lead a row to the leaf, so each leaf has a table of them, made once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace

BINS = 64
BATCH_ROWS = 1 << 16
#: Rows of a block, and rows from which on a block may be of one set of fits.
BLOCK_ROWS, LEAST_ROWS = 1 << 15, 1 << 10
#: Rows that are worth a task of their own.
TASK_ROWS = 1 << 12
#: Different rows up to which a fit is a task.
WHOLE_ROWS = 1 << 18
#: Combined bins of the features that share a code.
CODES = 1 << 10
#: Rounds between two writes of the margins; tasks above which histograms meet in tasks before they meet in the driver.
SAVE, DIRECT = 25, 64


class Tree:
    """Nodes of a heap: children of i are 2i + 1 (edge not exceeded) and 2i + 2; ``feature`` is -1 in leaves."""

    def __init__(self, depth: int):
        n = (2 << depth) - 1
        self.feature, self.edge, self.value, self.cover = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n)

        self.depth = depth

    def ends(self) -> np.ndarray:
        """The node in which each path of ``depth`` turns ends."""
        path, node = np.arange(1 << self.depth), np.zeros(1 << self.depth, np.int64)
        for level in range(self.depth):
            node = np.where(self.feature[node] >= 0, 2 * node + 1 + (path >> (self.depth - 1 - level) & 1), node)
        return node

    def paths(self, b: np.ndarray) -> np.ndarray:
        """The path of each row, as the number of its turns read as bits, from (features, rows) bins; below a leaf all turns are left."""
        kind = np.uint8 if self.depth <= 8 else np.uint32

        def below(node: int, level: int) -> np.ndarray | None:
            if self.feature[node] < 0:
                return None
            # an edge of the bins' own type, so that they are compared as they are
            right = np.negative((b[self.feature[node]] > b.dtype.type(self.edge[node])).view(np.uint8).astype(kind, copy=False))
            low, high = below(2 * node + 1, level + 1), below(2 * node + 2, level + 1)
            out = right & kind(1 << self.depth - 1 - level)
            if high is not None:
                out |= high & right
            if low is not None:
                out |= low & np.invert(right, out=right)
            return out

        got = below(0, 0)
        return np.zeros(b.shape[1], kind) if got is None else got

    def values(self, b: np.ndarray) -> np.ndarray:
        """The value of each row's leaf."""
        return np.take(self.value[self.ends()], self.paths(b))


class Boosted:
    """Edges of the bins, the margin at the start and the trees of one fit."""

    def __init__(self, columns: list[str], edges: list[np.ndarray], start: float, trees: list[Tree]):
        self.columns, self.edges, self.start, self.trees = columns, edges, start, trees

    def columns_of(self, x: np.ndarray) -> np.ndarray:
        """(features, rows) bins."""
        out = np.empty((len(self.edges), len(x)), np.uint8)
        for j, e in enumerate(self.edges):
            out[j] = np.searchsorted(e, np.ascontiguousarray(x[:, j]), side="left")
        return out

    def bins(self, x: np.ndarray) -> np.ndarray:
        return self.columns_of(x).T

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.margin_of(self.columns_of(x))

    def margin_of(self, b: np.ndarray) -> np.ndarray:
        return self.start + sum((t.values(b) for t in self.trees), np.zeros(b.shape[1]))

    def attributions(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """(rows, features) Shapley values of the margin, and the value without any feature."""
        b = self.columns_of(x)
        if not hasattr(self, "games"):
            self.games = [_games(t) for t in self.trees]
        phi, base = np.zeros((len(self.edges), len(x))), self.start
        for mean, leaves in self.games:
            base += mean
            for on, tables in leaves:
                at = np.zeros(len(x), np.uint8 if len(on) <= 8 else np.uint32)
                for j, (f, low, high) in enumerate(on):
                    at |= ((b[f] > low) & (b[f] <= high) if low >= 0 else b[f] <= high).astype(at.dtype) << at.dtype.type(j)
                for (f, _, _), table in zip(on, tables):
                    phi[f] += np.take(table, at)
        return phi.T, base

    def gains(self) -> list[tuple[str, float]]:
        """Share of the training rows' splits by feature, the largest first."""
        total = np.zeros(len(self.columns))
        for t in self.trees:
            for i in np.flatnonzero(t.feature >= 0):
                total[t.feature[i]] += t.cover[i]
        return sorted(zip(self.columns, (total / max(1.0, total.sum())).tolist()), key=lambda p: -p[1])


def _games(t: Tree) -> tuple[float, list[tuple[list[tuple[int, int, int]], list[np.ndarray]]]]:
    """The tree's mean and, of each leaf, (feature, bins low < bin <= high) of its path and a table for each of these
    features: its Shapley values by the features that lead a row to the leaf, as bits."""
    mean, leaves = 0.0, []
    paths: list[tuple[int, dict[int, tuple[int, int, float]]]] = [(0, {})]
    while paths:
        i, on = paths.pop()
        f = int(t.feature[i])
        if f >= 0:
            low, high, left = on.get(f, (-1, 255, 1.0))
            edge = int(t.edge[i])
            for child, bounds in ((2 * i + 1, (low, min(high, edge))), (2 * i + 2, (max(low, edge), high))):
                paths.append((child, on | {f: (*bounds, left * t.cover[child] / t.cover[i])}))
            continue
        names, m = list(on), len(on)
        mean += t.value[i] * math.prod(on[n][2] for n in names)
        known = {n: (np.arange(1 << m) >> j & 1).astype(float) for j, n in enumerate(names)}
        tables = []
        for u in names:
            # coefficients by the number of known features among the others
            poly = [np.ones(1 << m)]
            for s in names:
                if s != u:
                    poly = [(poly[k] * on[s][2] if k < len(poly) else 0.0) + (poly[k - 1] * known[s] if k else 0.0) for k in range(len(poly) + 1)]
            weighed = sum(p * (math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m)) for k, p in enumerate(poly))
            tables.append(t.value[i] * (known[u] - on[u][2]) * weighed)
        if m:
            leaves.append(([(n, *on[n][:2]) for n in names], tables))
    return mean, leaves


# ---- training ---------------------------------------------------------------------------


def _edges(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    at = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(c, at, F.lit(10_000)).alias(c) for c in columns]).first()
    return [np.unique(np.array(got[c] if got[c] is not None else [], np.float64)) for c in columns]


def _sigmoid(m: np.ndarray) -> np.ndarray:
    p = np.negative(m)
    np.exp(p, out=p)
    p += 1
    return np.divide(1, p, out=p)


def _split(g: np.ndarray, n: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, edge) of the best split of (features, bins) sums."""
    left_g, left_n = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    all_g, all_n = g[0].sum(), n[0].sum()
    right_g, right_n = all_g - left_g, all_n - left_n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((left_n > 0) & (right_n > 0), left_g**2 / left_n + right_g**2 / right_n - all_g**2 / all_n, -1.0)
    gain = np.round(gain, 9)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


class Codes:
    """Features in groups of few combined bins: a row has one code a group, and sums by code give those by bin."""

    def __init__(self, widths: list[int]):
        self.widths, self.groups = widths, []
        for f in sorted(range(len(widths)), key=lambda f: (-widths[f], f)):
            group = next((g for g in self.groups if math.prod(widths[j] for j in g) * widths[f] <= CODES), None)
            if group is None:
                self.groups.append([f])
            else:
                group.append(f)
        sizes = [math.prod(widths[f] for f in g) for g in self.groups]
        self.spans = [(sum(sizes[:j]), size) for j, size in enumerate(sizes)]
        self.size = sum(sizes)
        self.inside = np.arange(max(widths)) < np.array(widths)[:, None]

    def of(self, x: np.ndarray) -> np.ndarray:
        """(groups, rows) codes of (features, rows) bins, as whole words to add by."""
        x, out = x.astype(np.uint16), np.zeros((len(self.groups), x.shape[1]), np.uint16)
        for j, g in enumerate(self.groups):
            for f in g:
                out[j] *= np.uint16(self.widths[f])
                out[j] += x[f]
        return out.astype(np.intp)

    def empty(self, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """For ``tally``: residuals and curvatures as the two parts of a number, and rows; of a group its codes, of a code the nodes."""
        return np.zeros(nodes * self.size, complex), np.zeros(nodes * self.size)

    def bins(self, tallied: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(3, nodes, bins) residuals, curvatures and rows by bin, a feature after the other."""
        both, n = tallied
        sums, nodes = np.stack([both.real, both.imag, n]), len(n) // self.size
        out = np.zeros((3, nodes, *self.inside.shape))
        for g, (first, size) in zip(self.groups, self.spans):
            cube = sums[:, nodes * first : nodes * (first + size)].reshape(3, *[self.widths[f] for f in g], nodes)
            for j, f in enumerate(g):
                out[:, :, f, : self.widths[f]] = cube.sum(axis=tuple(1 + i for i in range(len(g)) if i != j)).swapaxes(1, 2)
        return out[:, :, self.inside]

    def padded(self, sums: np.ndarray) -> np.ndarray:
        """The same sums as (features, bins) in the last axes."""
        out = np.zeros((*sums.shape[:-1], *self.inside.shape))
        out[..., self.inside] = sums
        return out

    def tally(self, out: tuple[np.ndarray, np.ndarray], tree: Tree, asked: list[int], counted: bool, x: np.ndarray, codes: np.ndarray, n: np.ndarray, s: np.ndarray, m: np.ndarray, on: np.ndarray | None) -> None:
        """Adds to ``out`` the residuals, the curvatures and, if they are to be ``counted``, the rows of the asked nodes.

        A row counts ``n`` times, ``s`` is the sum of its labels and ``m`` its margin; rows outside ``on`` take no part.
        ``codes`` are multiplied by the nodes that ``out`` has room for.
        """
        nodes = len(out[1]) // self.size
        if asked == [0] and on is None:
            rows = None
        else:
            slot = np.full(len(tree.feature), -1, np.int8)
            slot[asked] = np.arange(len(asked))
            at = np.take(slot[tree.ends()], tree.paths(x))
            rows = np.flatnonzero(at >= 0 if on is None else on & (at >= 0))
            if not len(rows):
                return
            n, s, m = n[rows], s[rows], m[rows]
            first = at[rows].astype(np.intp) if len(asked) > 1 else None
        p = _sigmoid(m)
        h = n * p
        both = np.empty(len(h), complex)
        both.real = s - h
        h *= np.subtract(1, p, out=p)
        both.imag = h
        for c, (start, size) in zip(codes, self.spans):
            cells, own = c, slice(nodes * start, nodes * (start + size))
            if rows is not None:
                cells = np.take(c, rows)
                if first is not None:
                    cells += first
            np.add.at(out[0][own], cells, both)
            if counted:
                out[1][own] += np.bincount(cells, n, nodes * size)


def _round(k: int, depth: int, rate: float, sums: Callable[[list[Tree], list[list[int]], bool], list[np.ndarray]], roots: dict[int, np.ndarray]) -> list[Tree]:
    """One more tree of each of ``k`` fits; ``sums`` are residuals, curvatures and rows by fit, of its asked nodes by (features, bins).

    ``roots`` holds the rows by fit of the first node, which are the same in every round.
    """
    current = [Tree(depth) for _ in range(k)]
    # of each fit the nodes of the level that may be split; of siblings, (the one that is added up, the other one)
    pairs: list[list[tuple[int, int | None]]] = [[(0, None)] for _ in range(k)]
    known: list[dict[int, np.ndarray]] = [{} for _ in range(k)]
    for level in range(depth):
        if not any(pairs):
            break
        total = sums(current, [[node for node, _ in p] for p in pairs], level > 0 or not roots)
        if level == 0:
            for i in range(k):
                total[i][2, 0] = roots.setdefault(i, total[i][2, 0].copy())
        for i in range(k):
            t, before = current[i], known[i]
            known[i], after = {}, []
            for j, (node, other) in enumerate(pairs[i]):
                known[i][node] = total[i][:, j]
                if other is not None:
                    known[i][other] = before[(node - 1) // 2] - total[i][:, j]
            for node, (g, h, n) in sorted(known[i].items()):
                if level == 0:
                    t.cover[0], t.value[0] = n[0].sum(), rate * g[0].sum() / max(1e-12, h[0].sum())
                if not n[0].sum():
                    continue
                gain, f, e = _split(g, n)
                if gain <= 1e-9:
                    continue
                t.feature[node], t.edge[node] = f, e
                low, high = 2 * node + 1, 2 * node + 2
                for child, part in ((low, slice(0, e + 1)), (high, slice(e + 1, None))):
                    t.cover[child], t.value[child] = n[f, part].sum(), rate * g[f, part].sum() / max(1e-12, h[f, part].sum())
                after.append((low, high) if t.cover[low] <= t.cover[high] else (high, low))
            pairs[i] = after
    return current


#: A block: the input rows it stands for, its different rows, the fits it takes part in, who of its rows does in which (empty: all), bins, how often each row counts, sums of labels, margins (empty: those at the start).
BLOCK = "n long, size int, fits binary, uses binary, x binary, count binary, label binary, m binary"


def fit(rows: DataFrame, columns: list[str], label: str, parts: list[Column], trees: int = 200, depth: int = 4, rate: float = 0.05, bins: int = BINS) -> list[Boosted]:
    """One fit for each of ``parts``: a condition that says which rows it learns from. Rows without a label take no part; null features count as 0."""
    spark, k, d = rows.sparkSession, len(parts), len(columns)
    if not k:
        return []
    data = rows.where(F.col(label).isNotNull()).select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns], F.col(label).cast("double").alias("_y"), *[F.coalesce(p, F.lit(False)).alias(f"_p{i}") for i, p in enumerate(parts)])
    work = Workspace(spark, "boosting")
    data = work.save(data)
    edges = _edges(data, columns, bins)
    sums = data.agg(*[F.sum(F.when(F.col(f"_p{i}"), F.col("_y"))).alias(f"s{i}") for i in range(k)], *[F.count_if(f"_p{i}").alias(f"n{i}") for i in range(k)], F.count("*").alias("rows")).first()
    starts = []
    for i in range(k):
        share = min(1 - 1e-6, max(1e-6, (sums[f"s{i}"] or 0.0) / max(1, sums[f"n{i}"])))
        starts.append(math.log(share / (1 - share)))
    joint = Codes([len(e) + 1 for e in edges])

    def texts(a: np.ndarray) -> pa.Array:
        """(rows, bytes) as one binary a row."""
        a = np.ascontiguousarray(a, np.uint8)
        return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, a.size + 1, a.shape[1], np.int32)), pa.py_buffer(a)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Boosted(columns, edges, 0.0, [])
        for b in batches:
            if b.num_rows:
                x = model.bins(np.column_stack([b.column(j).to_numpy() for j in range(d)]))
                uses = np.stack([b.column(d + 1 + i).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
                some = np.flatnonzero(uses.any(axis=1))
                yield pa.record_batch([texts(uses[some]), texts(x[some]), b.column(d).take(pa.array(some))], names=["uses", "x", "y"])

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            uses, x, count, labels = matrix(b.column(0)).astype(bool), matrix(b.column(1)), b.column(2).to_numpy().astype(float), b.column(3).to_numpy()
            start = 0
            for end in [*(np.flatnonzero((uses[1:] != uses[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]:
                if end - start < LEAST_ROWS and end < b.num_rows:
                    continue
                for at in range(start, end, BLOCK_ROWS):
                    own = slice(at, min(end, at + BLOCK_ROWS))
                    fits = np.flatnonzero(uses[own].any(axis=0))
                    on = uses[own][:, fits].T
                    row = (int(count[own].sum()), len(x[own]), fits.astype(np.int32).tobytes(), b"" if on.all() else on.tobytes(), x[own].T.tobytes(), count[own].tobytes(), labels[own].tobytes(), b"")
                    yield pa.record_batch([pa.array([row[0]]), pa.array([row[1]], pa.int32()), *[pa.array([v], pa.binary()) for v in row[2:]]], names=[c.split()[0] for c in BLOCK.split(", ")])
                start = end

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    try:
        spread = max(1, min(spark.sparkContext.defaultParallelism, sums["rows"] // TASK_ROWS))
        different = data.mapInArrow(binned, "uses binary, x binary, y double").groupBy("uses", "x").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
        held = work.save(different.repartition(spread).sortWithinPartitions("uses").mapInArrow(blocks, BLOCK))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)

    def opened(r) -> tuple:
        x = np.frombuffer(r["x"], np.uint8).reshape(d, r["size"])
        fits = np.frombuffer(r["fits"], np.int32)
        uses = np.frombuffer(r["uses"], bool).reshape(len(fits), -1) if r["uses"] else None
        m = np.frombuffer(r["m"]).reshape(len(fits), -1) if r["m"] else np.repeat(np.array(starts)[fits][:, None], r["size"], axis=1)
        return r["n"], fits, uses, x, np.frombuffer(r["count"]), np.frombuffer(r["label"]), m

    def closed(block: tuple) -> tuple:
        n, fits, uses, x, count, labels, m = block
        return n, x.shape[1], fits.tobytes(), b"" if uses is None else uses.tobytes(), x.tobytes(), count.tobytes(), labels.tobytes(), m.tobytes()

    grow = _whole if (held.agg(F.sum("size")).first()[0] or 0) <= WHOLE_ROWS else _dealt
    done = grow(work, held, opened, closed, joint, starts, trees, depth, rate)
    return [Boosted(columns, edges, starts[i], done[i]) for i in range(k)]


def _whole(work: Workspace, held: DataFrame, opened: Callable, closed: Callable, joint: Codes, starts: list[float], trees: int, depth: int, rate: float) -> list[list[Tree]]:
    """The trees by fit, where the blocks are small enough for a broadcast: a task a fit."""
    sc = work.spark.sparkContext
    shared = sc.broadcast([r.asDict() for r in held.collect()])

    def run(i: int) -> list[Tree]:
        own = []
        for _, fits, uses, x, count, labels, m in map(opened, shared.value):
            for j in np.flatnonzero(fits == i):
                on = slice(None) if uses is None else uses[j]
                own.append((x[:, on], joint.of(x[:, on]), count[on], labels[on], m[j, on]))
        if not own:
            return [Tree(depth) for _ in range(trees)]
        x, codes, count, labels, m = (np.concatenate(v, axis=-1) for v in zip(*own))
        cuts = [slice(at, at + BLOCK_ROWS) for at in range(0, len(m), BLOCK_ROWS)]

        def sums(current: list[Tree], asked: list[list[int]], counted: bool) -> list[np.ndarray]:
            out = joint.empty(len(asked[0]))
            for c in cuts:
                joint.tally(out, current[0], asked[0], counted, x[:, c], codes[:, c] * len(asked[0]), count[c], labels[c], m[c], None)
            return [joint.padded(joint.bins(out))]

        grown: list[Tree] = []
        roots: dict[int, np.ndarray] = {}
        for _ in range(trees):
            grown += _round(1, depth, rate, sums, roots)
            for c in cuts:
                m[c] += grown[-1].values(x[:, c])
        return grown

    k = len(starts)
    try:
        return sc.parallelize(range(k), k).map(run).collect()
    finally:
        shared.destroy()


def _dealt(work: Workspace, held: DataFrame, opened: Callable, closed: Callable, joint: Codes, starts: list[float], trees: int, depth: int, rate: float) -> list[list[Tree]]:
    """The trees by fit, with the blocks dealt over all cores: a job a level."""
    k = len(starts)

    def moved(last: list[Tree]) -> Callable:
        def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
            for *rest, m in blocks:
                fits, x = rest[1], rest[3]
                yield *rest, np.stack([m[j] + last[i].values(x) for j, i in enumerate(fits)]) if len(fits) else m

        return run

    def tallied(current: list[Tree], asked: list[list[int]], counted: bool) -> Callable:
        def run(blocks: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
            nodes = max(map(len, asked))
            out = {i: joint.empty(nodes) for i in range(k) if asked[i]}
            for _, fits, uses, x, count, labels, m in blocks:
                codes = joint.of(x) * nodes
                for j, i in enumerate(fits.tolist()):
                    if i in out:
                        joint.tally(out[i], current[i], asked[i], counted, x, codes, count, labels, m[j], None if uses is None else uses[j])
            return ((i, joint.bins(o)[:, : len(asked[i])]) for i, o in out.items())

        return run

    def kept(blocks: RDD) -> RDD:
        return blocks.persist(StorageLevel.MEMORY_AND_DISK_DESER)

    state = kept(held.rdd.map(opened))
    tasks = state.getNumPartitions()

    def sums(current: list[Tree], asked: list[list[int]], counted: bool) -> list[np.ndarray]:
        got = state.mapPartitions(tallied(current, asked, counted))
        if tasks > DIRECT:
            got = got.reduceByKey(np.add, min(k, tasks))
        total: list = [0.0] * k
        for i, o in got.collect():
            total[i] = total[i] + o
        return [joint.padded(t) if asked[i] else np.zeros(0) for i, t in enumerate(total)]

    done: list[list[Tree]] = [[] for _ in range(k)]
    roots: dict[int, np.ndarray] = {}
    for number in range(trees):
        before = state
        if number:
            now = before.mapPartitions(moved([t[-1] for t in done]))
            if number % SAVE == 0:
                now = work.save(work.spark.createDataFrame(now.map(closed), BLOCK, verifySchema=False)).rdd.map(opened)
            state = kept(now)
        for t, more in zip(done, _round(k, depth, rate, sums, roots)):
            t.append(more)
        if number:
            before.unpersist()
    state.unpersist()
    return done


# ---- scoring ----------------------------------------------------------------------------


def _matrix(b: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([np.nan_to_num(b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in columns])


def _joined(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``least`` rows or more, but for the last, so that work on columns outweighs the calls."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def margins(rows: DataFrame, models: dict[str, Boosted], only: dict[str, Column] | None = None) -> DataFrame:
    """The rows with a column of margins for each model; null where the model's condition in ``only`` does not hold."""
    shared, only = rows.sparkSession.sparkContext.broadcast(models), only or {}
    schema = T.StructType([*rows.schema.fields, *(T.StructField(name, T.DoubleType()) for name in models)])
    asked = {name: f"_only_{name}" for name in only}

    def run(batches):
        for b in _joined(batches, BATCH_ROWS):
            out, binned = b.drop_columns(list(asked.values())), {}
            for name, m in shared.value.items():
                # models of one call of fit share their edges
                x = binned.get(id(m.edges))
                if x is None:
                    x = binned[id(m.edges)] = m.columns_of(_matrix(b, m.columns))
                if name in asked:
                    on = b.column(asked[name]).to_numpy(zero_copy_only=False)
                    values = np.zeros(b.num_rows)
                    values[on] = m.margin_of(x[:, on])
                    out = out.append_column(name, pa.array(values, mask=~on))
                else:
                    out = out.append_column(name, pa.array(m.margin_of(x)))
            yield out

    return rows.withColumns({asked[name]: F.coalesce(c, F.lit(False)) for name, c in only.items()}).mapInArrow(run, schema)


def attributed(rows: DataFrame, model: Boosted, keep: list[str]) -> DataFrame:
    """(keep columns, margin, base, one column a feature): Shapley values, which add up to margin less base."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        m = shared.value
        for b in batches:
            x = _matrix(b, m.columns)
            phi, base = m.attributions(x)
            yield pa.record_batch([b.column(c) for c in keep] + [pa.array(m.margin(x)), pa.array(np.full(len(x), base))] + [pa.array(phi[:, j]) for j in range(len(m.columns))], names=[*keep, "margin", "base", *(f"phi_{c}" for c in m.columns)])

    return rows.select(*keep, *[c for c in model.columns if c not in keep]).mapInArrow(run, f"{kept}, margin double, base double, " + ", ".join(f"phi_{c} double" for c in model.columns))


def platt(rows: DataFrame, margin: str, label: str, steps: int = 30) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through margins and labels, by Newton steps; each is one small aggregation."""
    return platts(rows, [margin], label, steps)[0]


def platts(rows: DataFrame, margins: list[str], label: str, steps: int = 30) -> list[tuple[float, float]]:
    """(slope, shift) for each column of margins, over the rows where it is not null; a step is one aggregation for all."""
    curves, going = [(1.0, 0.0)] * len(margins), list(range(len(margins)))
    for _ in range(steps):
        if not going:
            break
        wanted = []
        for i in going:
            (a, b), x = curves[i], F.col(margins[i])
            p = 1 / (1 + F.exp(-(x * a + b)))
            e, w = F.col(label) - p, p * (1 - p)
            wanted += [F.sum(v).alias(f"{name}{i}") for name, v in (("ga", e * x), ("gb", e), ("aa", w * x * x), ("ab", w * x), ("bb", w))]
        r, more = rows.agg(*wanted).first(), []
        for i in going:
            ga, gb, aa, ab, bb = (r[f"{name}{i}"] for name in ("ga", "gb", "aa", "ab", "bb"))
            if bb is None:
                continue
            a, b = curves[i]
            # a little is added to the diagonal, since separated classes have no finite curve
            step = np.linalg.solve(np.array([[aa + 1e-3, ab], [ab, bb + 1e-3]]), np.array([ga - 1e-3 * a, gb - 1e-3 * b]))
            curves[i] = a + float(step[0]), b + float(step[1])
            if abs(step).max() >= 1e-9:
                more.append(i)
        going = more
    return curves
