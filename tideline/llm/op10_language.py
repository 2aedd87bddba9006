"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of characters that are no letters becomes one space, and the
1- to 3-grams are hashed into BUCKETS counts. Weights are log(1 + count) times the inverse
document frequency over *all* training documents, scaled to length 1. The classifier is
trained with follow-the-regularised-leader (per-coordinate rates, elastic net: L1 makes it
sparse, L2 keeps it small) on a bounded sample of the labelled rows, SAMPLE_PER_LANGUAGE at most
of each language, the lowest by a hash of id and text; every language that occurs is learned; a fifth of the sample is held back to fit one
temperature that calibrates the probabilities.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if no
labelled row has a letter. Null labels are not learned from. Repeated rows are scored alike; empty
tables give empty results. Ties between languages go to the first in alphabetical order. Only
``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 14
SAMPLE_PER_LANGUAGE = 500
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"

_LETTER = np.zeros(0x110000, bool)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        for c in range(0x110000):
            if chr(c).isalpha():
                _LETTER[c] = True
    return _LETTER


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts in BUCKETS of hashed n-grams; None without a letter."""
    if not text:
        return None
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[x]
    if not letter.any():
        return None
    x = np.where(letter, x, np.uint32(32))
    keep = np.ones(len(x), bool)
    keep[1:] = letter[1:] | letter[:-1]
    x = np.concatenate([[np.uint32(32)], x[keep], [np.uint32(32)]]).astype(np.uint64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    one = x * _MULT[0]
    two = (one[:-1] ^ (x[1:] + np.uint64(1 << 21))) * _MULT[1]
    three = (two[:-1] ^ (x[2:] + np.uint64(1 << 22))) * _MULT[2]
    return np.bincount(np.concatenate([one, two, three]) >> shift, minlength=BUCKETS)


class LanguageModel:
    """weights (BUCKETS, languages), bias, idf and temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float):
        self.languages, self.weights, self.bias, self.idf, self.temperature = languages, weights, bias, idf, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        at = np.flatnonzero(counts)
        p = _softmax((_weigh(counts[at], self.idf[at]) @ self.weights[at] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / max(1e-12, float(np.sqrt(v @ v)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray, epochs: int = EPOCHS) -> LanguageModel:
    """Fit on (buckets, counts, language index) rows; every fifth row is for the temperature."""
    if not rows:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), idf, 1.0)
    k = len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    data = [(np.append(at, BUCKETS), np.append(_weigh(c, idf[at]), 1.0), y) for at, c, y in rows]
    fit = [d for i, d in enumerate(data) if i % 5] or data
    held = data[::5]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(fit)):
            at, x, y = fit[i]
            w = weights(at)
            g = _softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    full = weights(np.arange(BUCKETS + 1))
    logits = np.array([x @ full[at] for at, x, _ in held])
    gold = np.array([y for _, _, y in held])
    tries = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(gold)), gold], 1e-12)).mean() for t in tries]
    return LanguageModel(languages, full[:-1].astype(np.float32), full[-1].astype(np.float32), idf, float(tries[int(np.argmin(loss))]))


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Train on (doc_id, text, lang); document frequencies cover every row given."""
    spark = labelled.sparkSession
    counts = labelled.where("lang is not null").groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), np.ones(BUCKETS), 1.0)

    def make_df():
        def run(batches):
            total, rows = np.zeros(BUCKETS, np.int64), 0
            for b in batches:
                for t in b.column(0).to_pylist():
                    c = ngram_counts(t)
                    if c is not None:
                        total += c > 0
                        rows += 1
            yield C.records(["bucket", "n"], [np.arange(-1, BUCKETS), np.concatenate([[rows], total])], [pa.int32(), pa.int64()])

        return run

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", C.ARROW_ROWS)
    freq = labelled.select("text").mapInArrow(make_df(), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1)
    for r in freq:
        df[r["bucket"] + 1] = r["n"]
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1
    # about twice the sample passes a threshold on the hash, so that few rows are ordered; then the lowest hashes are taken.
    # ``share`` has a row a language, as the model has; without the hint all texts of a language would meet in one task
    share = spark.createDataFrame([(r["lang"], min(1.0, 2 * per_language / r["count"])) for r in counts], "lang string, share double")
    h = F.xxhash64("doc_id", "text")
    few = labelled.select("doc_id", "text", "lang").join(F.broadcast(share), "lang").where((F.pmod(h, F.lit(1_000_003)) < F.col("share") * 1_000_003) | (F.col("share") == 1))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(h, F.lit(1_000_003)), h))
    sample = few.withColumn("_place", place).where(F.col("_place") <= per_language).select("doc_id", "text", "lang")

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
            out = [(i, lang, c) for i, t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()) if (c := ngram_counts(t)) is not None]
            if not out:
                return None
            i, lang, c = zip(*out)
            at = [np.flatnonzero(x) for x in c]
            return C.records(["doc_id", "lang", "at", "n"], [i, lang, at, [x[a] for x, a in zip(c, at)]], [b.schema.field(0).type, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())])

        return work

    kind = labelled.schema["doc_id"].dataType.simpleString()
    got = C.map_rows(sample, make, f"doc_id {kind}, lang string, at array<int>, n array<int>").toPandas()
    got = got.iloc[sorted(range(len(got)), key=lambda i: (str(got["doc_id"].iloc[i]), got["lang"].iloc[i], len(got["at"].iloc[i])))]
    index = {x: i for i, x in enumerate(languages)}
    return train([(np.asarray(a), np.asarray(n), index[x]) for a, n, x in zip(got["at"], got["n"], got["lang"])], languages, idf)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = zip(*map(m.predict, b.column(1).to_pylist()))
            return C.records(["doc_id", "lang_pred", "score"], [b.column(0), lang, score], [None, pa.string(), pa.float64()])

        return work

    return C.map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, lang_pred string, score double")


def held_out(mod: int, rest: int):
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % mod == rest, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(3, 1) & F.col("lang").isNotNull()))
    return predict(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
