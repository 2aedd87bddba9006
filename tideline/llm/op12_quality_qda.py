"""Quality scores by a regularised quadratic discriminant over document statistics.

Every whole text becomes STATISTICS numbers, counted over its bytes and words in numpy and transformed
towards a bell shape: logarithms of sizes, arcsines of square roots of shares. They are written once to
a scratch table, which training and scoring read; texts are read once.

Training takes all labelled rows. A first pass adds up count, sum and products of each class, task by
task; a second one adds up the fourth powers of the distances from the class's mean. Each class's
covariance, scaled by the classes' common deviations, is drawn towards the pooled one by the share that
Ledoit and Wolf's rule gives (the expected error of the entries over their distance from the target),
then RIDGE of the identity is mixed in. The Cholesky factors of the two covariances are computed once, and
their inverses go out to the tasks with the means: a text's score is the logistic function of
the difference of its log densities, half the difference of squared Mahalanobis distances and log
determinants, plus the log ratio of the classes' smoothed shares.

Null texts count as empty, and every row gets a score. Labels other than 0 and 1 and null ids have no
say; repeated labels of an id count once, and an id with both labels teaches nothing. Every row of a labelled id is
learned from, repeated rows too. With rows of one class only, all scores are that class's smoothed share;
without labels they are 0.5. Equal texts have equal scores. Empty tables give empty results. Only ``doc_id``
and ``text`` of the documents and ``doc_id`` and the label's column are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H
from .op10_language import held_out

#: Share of the identity that is mixed into every covariance.
RIDGE = 0.02

# classes of bytes
_KINDS = ("lower", "upper", "digit", "space", "newline", "symbol", "loud", "stop", "punct", "lead", "rest", "control")
_KIND = np.full(256, 11, np.int64)
_KIND[33:127] = 8
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\v\f\r", "\n", "#*$%&|<>", "!?", ".,;:")):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[192:], _KIND[128:192] = 9, 10
STATISTICS = 18


def _groups(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, count) of each distinct value of each document."""
    if not len(doc):
        return doc, doc
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return d[at], np.diff(np.append(at, len(d)))


def _angle(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.minimum(1.0, part / np.maximum(whole, 1))))


def statistics(batch: pa.RecordBatch, column: str = "text") -> np.ndarray:
    """(rows, STATISTICS) of a batch of texts."""
    raw, offsets = H.buffers(batch, column)
    n, size = batch.num_rows, np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n), size) * len(_KINDS) + _KIND[raw], minlength=n * len(_KINDS)).reshape(n, -1)
    k = {name: kinds[:, i].astype(np.float64) for i, name in enumerate(_KINDS)}
    chars = size - k["rest"]
    solid = chars - k["space"] - k["newline"]
    hashes, bounds = H.word_hashes(raw, offsets)
    words = np.diff(bounds).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    d, c = _groups(doc, hashes)
    distinct = np.bincount(d, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, d, c)
    spread = np.log(np.maximum(words, 1)) - np.bincount(d, c * np.log(np.maximum(c, 1)), minlength=n) / np.maximum(words, 1)
    three = H.mix(hashes[:-2] + hashes[1:-1] * H.BASE + hashes[2:] * H.BASE * H.BASE) if len(hashes) > 2 else hashes[:0]
    whole = doc[:-2] == doc[2:] if len(hashes) > 2 else np.zeros(0, bool)
    d3, c3 = _groups(doc[: len(three)][whole], three[whole])
    triples = np.maximum(0, words - 2)
    again = np.bincount(d3, c3 - 1, minlength=n)
    return np.column_stack([
        np.log1p(words), np.log1p(solid / np.maximum(words, 1)), _angle(k["upper"], k["lower"] + k["upper"] + k["lead"]), _angle(k["digit"], solid), _angle(k["symbol"], solid), _angle(k["loud"], solid),
        _angle(k["stop"], solid), _angle(k["punct"], solid), _angle(k["lead"], solid), _angle(k["control"], chars), _angle(k["lower"] + k["upper"] + k["lead"], solid), np.log1p(k["newline"]),
        np.log1p(words / (k["newline"] + 1)), _angle(distinct, words), _angle(most, words), _angle(again, triples), spread / np.log(np.maximum(words, 2)), _angle(k["space"] + k["newline"], chars),
    ])


class Discriminant:
    """Means, inverse Cholesky factors and constants of the classes 0 and 1; or a share where there is no such pair."""

    def __init__(self, share: float, scale: np.ndarray | None = None, means: list[np.ndarray] | None = None, covariances: list[np.ndarray] | None = None):
        self.share, self.scale = share, scale
        if means is not None:
            factors = [np.linalg.cholesky(c) for c in covariances]
            self.means, self.whiten = means, [np.linalg.inv(f) for f in factors]
            prior = np.log([1 - share, share])
            self.constant = [float(prior[i] - np.log(np.diag(f)).sum()) for i, f in enumerate(factors)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 with its share less that of class 0."""
        if self.scale is None:
            return np.full(len(x), np.log(self.share / (1 - self.share)))
        z = x / self.scale
        density = [c - 0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constant)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-self.margin(x), -700, 700)))


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            return C.records(["doc_id", "x"], [b.column(0), list(statistics(b))], [None, pa.list_(pa.float64())])

        return work

    return C.map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, x array<double>")


def labelled(described: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """(y, x) of the rows whose id has one label, 0 or 1."""
    one = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).alias("y"), F.max(column).alias("_other")).where("y = _other").select("doc_id", F.col("y").cast("int").alias("y"))
    return C.salted_join(described, one, ["doc_id"], "x").select("y", "x")


def _sums(rows: DataFrame, terms) -> dict[int, np.ndarray]:
    """The sum of ``terms(y, X)``, a vector, over the rows of each class; tasks add up theirs first."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            y = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(len(y), -1)
            for c in np.unique(y).tolist():
                v = terms(c, x[y == c])
                total[c] = total[c] + v if c in total else v
        for c, v in total.items():
            yield C.records(["y", "k", "v"], [np.full(len(v), c), np.arange(len(v)), v], [pa.int32(), pa.int32(), pa.float64()])

    out: dict[int, np.ndarray] = {}
    for c, k, v in rows.mapInArrow(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v")).collect():  # two classes of a fixed number of terms
        out.setdefault(c, {})[k] = v
    return {c: np.array([v[k] for k in range(len(v))]) for c, v in out.items()}


def fit(rows: DataFrame, ridge: float = RIDGE) -> Discriminant:
    """Train on (y, x)."""
    first = _sums(rows, lambda c, x: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]))
    count = {c: first[c][0] if c in first else 0.0 for c in (0, 1)}
    share = (count[1] + 1) / (count[0] + count[1] + 2)
    if not count[0] or not count[1]:
        return Discriminant(share)
    d = int((len(first[0]) - 1) ** 0.5)
    while 1 + d + d * d > len(first[0]):
        d -= 1
    mean = {c: first[c][1 : d + 1] / count[c] for c in (0, 1)}
    cov = {c: first[c][d + 1 :].reshape(d, d) / count[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
    pooled = (count[0] * cov[0] + count[1] * cov[1]) / (count[0] + count[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    cov, target = {c: v / np.outer(scale, scale) for c, v in cov.items()}, pooled / np.outer(scale, scale)
    fourth = _sums(rows, lambda c, x: np.array([(((x - mean[c]) / scale) ** 2).sum(axis=1) @ (((x - mean[c]) / scale) ** 2).sum(axis=1)]))
    shrunk = []
    for c in (0, 1):
        away = ((cov[c] - target) ** 2).sum()
        error = max(0.0, fourth[c][0] / count[c] - (cov[c] ** 2).sum()) / count[c]
        weight = min(1.0, error / away) if away > 0 else 1.0
        shrunk.append((1 - ridge) * ((1 - weight) * cov[c] + weight * target) + ridge * np.eye(d))
    return Discriminant(share, scale, [mean[c] / scale for c in (0, 1)], shrunk)


def score(described: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``describe``."""
    kind = described.schema["doc_id"].dataType.simpleString()
    shared = described.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            s = m.score(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
            return C.records(["doc_id", "score", "predicted"], [b.column(0), s, s >= 0.5], [None, pa.float64(), pa.bool_()])

        return work

    return C.map_rows(described, make, f"doc_id {kind}, score double, predicted boolean").withColumn("predicted", F.col("predicted").cast("int"))


def op12_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = C.Scratch(spark, "statistics").save(describe(C.read(spark, sf_dir, "documents")))
    learned = C.Scratch(spark, "labelled").save(labelled(x.where(~held_out(3, 1)), C.read(spark, sf_dir, "labels")))
    return score(x, fit(learned)).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
