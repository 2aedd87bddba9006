"""Exact substring dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte covered by a MIN_LENGTH-byte string that also starts elsewhere is removed; matches
never cross documents, and strings are judged on the input.

Blocks. Winnowing picks, for every window of MIN_LENGTH bytes, one anchor: the k-gram with the
smallest hash, the rightmost of equals. Equal windows pick their anchor at the same offset, so
windows can only repeat where anchors do. Anchors are counted over all documents; the windows
that one repeated anchor owns make a context, and contexts with the same anchor meet in one
task. Contexts are sent once per task and content, so copies in any number cost little.

Expansion. Within a block the contexts are sorted by what follows their anchor; the bytes
before the rows are the transform's column. Breadth first, every interval of rows is extended
backward by one byte: the stable partition by that byte is the LF mapping, rows keep their
order, and the common prefix of two rows is the minimum of the sorted rows' common prefixes
between them plus the number of steps. So common prefixes come by increasing value. Rows alone
in their interval drop out, as do rows whose prefix with both neighbours can't reach
MIN_LENGTH with the bytes left to extend by; at MIN_LENGTH a window is marked and the
expansion of that prefix stops.

An anchor with more than HOT different contexts would make a large block: at the edges of a very
common passage the outer bytes differ by document. Its contexts are cut by offset into parts of
WIDTH windows, keyed also by the bytes all these windows share; a part's key that still has more
than HOT different contents is cut into single windows, and then a block is one exact string.

Words. A passage can also be measured in words: each word becomes WORD_BYTES bytes of its
hash, and the same steps run over these; anchors are picked among whole words, so a text has one
k-gram a word there. White space between words doesn't count then. A window that is off the words' bounds repeats only if whole words do, so words that a span
covers in part are left out.

Null and empty texts have no bytes and no spans; texts shorter than MIN_LENGTH are kept.
Repeated rows are copies of each other like any others. A removal can cut a UTF-8 character,
so kept bytes are binary. A null ``doc_id`` is an id like any other. Only ``doc_id`` and ``text``
are read; empty tables give empty results. Texts are processed whole.
"""

from __future__ import annotations

import hashlib
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

MIN_LENGTH = 400
KGRAM = 128
#: Different contents of one key that are expanded in one block.
HOT = 20_000
WIDTH = 16
#: Words of a passage that counts as one, besides strings of MIN_LENGTH bytes.
PASSAGE = 51
#: Bytes of contexts that are expanded together; an anchor's contexts are never parted.
BLOCK_BYTES = 8 << 20
#: Bytes of texts whose anchors are looked for at once: the arrays stay near the cores.
ANCHOR_BYTES = 1 << 18
#: Contexts a task remembers having sent.
SEEN = 400_000
#: Bytes a word counts where words are the unit, and words of the k-gram.
WORD_BYTES = 6
WORD_KGRAM = 16
_PAIR = struct.Struct("<qq")


class Kind(NamedTuple):
    """What repeats are looked for: windows of ``length`` bytes by k-grams, of the text itself or of ``units`` of words."""

    length: int
    k: int
    words: bool


def units(b: pa.RecordBatch, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """What repeats are looked for in, and the texts' offsets in it: the bytes, or WORD_BYTES of each word's hash."""
    raw, offsets = H.buffers(b)
    if not words:
        return raw, offsets
    h, bounds = H.word_hashes(raw, offsets, lower=False)
    # 0xFF is the padding of rows
    return np.minimum(h.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES], 0xFE).ravel(), bounds * WORD_BYTES


def anchors(p: np.ndarray, offsets: np.ndarray, length: int = MIN_LENGTH, k: int = KGRAM) -> tuple[np.ndarray, ...]:
    """(hash, text, position in the text, first and last start of the windows it owns), in order, of symbols with prefix sums ``p``."""
    span = length - k + 1
    n = len(p) - length
    if n <= 0 or (np.diff(offsets) < length).all():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    _, down = H.Powers.get(len(p))
    grams = len(p) - k
    h = p[k:] - p[:grams]
    h *= down[:grams]
    rows = -(-grams // span)
    padded = np.full(rows * span, ~np.uint64(0))
    # 32 bits of hash order the k-grams, the place breaks ties to the right; both depend on content alone
    key = padded[:grams]
    np.multiply(h, np.uint64(0x9FB21C651E98DF25), out=key)
    key |= np.uint64(0xFFFFFFFF)
    key ^= np.arange(grams, dtype=np.uint64)
    padded = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (~np.minimum(back[:n], ahead[span - 1 : span - 1 + n])).astype(np.uint32)
    # windows that stay inside their text, and where the owner or the text changes
    ok, change = np.zeros(n, bool), np.ones(n + 1, bool)
    np.not_equal(at[1:], at[:-1], out=change[1:-1])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= length:
            ok[a : b - length + 1] = True
            change[a] = change[b - length + 1] = True
    first, last = np.flatnonzero(change[:-1] & ok), np.flatnonzero(change[1:] & ok)
    text = np.searchsorted(offsets, first, side="right") - 1
    base, at = offsets[text], at[first].astype(np.int64)
    return H.mix(h[at]), text, at - base, first - base, last - base


def anchors_of(b: pa.RecordBatch, kinds: list[Kind]) -> list[tuple[np.ndarray, ...]]:
    """The ``anchors`` of each kind, with places in its units; those of words are found among whole words."""
    raw, offsets = H.buffers(b)
    p, out = H.prefix_sums(raw), []
    for kind in kinds:
        if not kind.words:
            out.append(anchors(p, offsets, kind.length, kind.k))
            continue
        start, end, bounds = H.word_bounds(raw, offsets)
        h, text, *places = anchors(H.sums(H.span_hashes(p, start, end)), bounds, kind.length // WORD_BYTES, kind.k // WORD_BYTES)
        out.append((h, text, *(x * WORD_BYTES for x in places)))
    return out


class RangeMin:
    """Minimum of values[i:j] for arrays of bounds, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        size = 1
        while 2 * size <= len(values):
            v = self.levels[-1]
            self.levels.append(np.minimum(v[: len(v) - size], v[size:]))
            size *= 2
        width = max(len(v) for v in self.levels)
        self.table = np.zeros((len(self.levels), width), values.dtype)
        for row, v in zip(self.table, self.levels):
            row[: len(v)] = v
        self.levels = None

    def query(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k = np.frexp(j - i)[1] - 1
        return np.minimum(self.table[k, i], self.table[k, j - (1 << k)])


def expand(group: np.ndarray, data: np.ndarray, start: np.ndarray, left: np.ndarray, size: np.ndarray, length: int = MIN_LENGTH) -> np.ndarray:
    """Marks, over ``data``, of the starts of windows that repeat among contexts of one group.

    Context i is data[start:start + size] with its anchor ``left`` bytes in; every window of it
    contains the anchor's first byte. Contents within a group are distinct.
    """
    marks = np.zeros(len(data) + 1, bool)
    m = len(group)
    if m < 2:
        return marks
    right = size - left
    # rows: what follows the anchor, padded with a byte that no UTF-8 text has
    follow = np.full((m, length), 0xFF, np.uint8)
    column = np.arange(length)
    for at in range(0, m, 4096):
        r = slice(at, min(m, at + 4096))
        i = (start[r] + left[r])[:, None] + column
        inside = column < np.minimum(right[r], length)[:, None]
        follow[r] = np.where(inside, data[np.minimum(i, len(data) - 1)], 0xFF)
    order = np.lexsort((np.argsort(np.argsort(follow.view(f"S{length}").ravel(), kind="stable"), kind="stable"), group))
    group, start, left, follow = group[order], start[order], left[order], follow[order]
    common = np.zeros(m, np.int16)  # common[i]: bytes that rows i - 1 and i share
    for at in range(1, m, 4096):
        e = min(m, at + 4096)
        differ = follow[at:e] != follow[at - 1 : e - 1]
        common[at:e] = np.where(differ.any(1), differ.argmax(1), length)
    ends = right[order]
    common[1:] = np.minimum(common[1:], np.minimum(ends[1:], ends[:-1]))  # padding is no text
    common[1:][group[1:] != group[:-1]] = 0
    del follow
    lowest = RangeMin(common)
    rows, interval = np.arange(m), group
    anchor = start + left
    step = 0
    while len(rows) > 1:
        same = interval[1:] == interval[:-1]
        shared = np.zeros(len(rows) + 1, np.int64)
        pair = np.flatnonzero(same)
        shared[1:-1][pair] = lowest.query(rows[pair] + 1, rows[pair + 1] + 1)
        reach = np.maximum(shared[:-1], shared[1:])
        done = reach + step >= length
        marks[anchor[rows[done]] - step] = True
        # the next byte back: rows that have one and can still reach the length
        alive = (left[rows] > step) & (reach + left[rows] >= length)
        rows, interval = rows[alive], interval[alive]
        if len(rows) < 2:
            break
        before = data[anchor[rows] - step - 1]
        same = interval[1:] == interval[:-1]
        if (same & (before[1:] != before[:-1])).any():
            by = np.argsort(interval * 256 + before, kind="stable")
            rows, interval, before = rows[by], interval[by], before[by]
            same = interval[1:] == interval[:-1]
        edge = np.ones(len(rows) + 1, bool)
        edge[1:-1] = ~same | (before[1:] != before[:-1])
        interval = np.cumsum(edge[:-1])
        company = ~(edge[:-1] & edge[1:])
        rows, interval = rows[company], interval[company]
        step += 1
    return marks


def merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last), in order: the maximal runs of each row's overlapping or touching spans."""
    if not len(row):
        return row, first, last
    stride = int(last.max()) + 2
    order = np.lexsort((first, row))
    base = row[order] * stride
    first, end = first[order] + base, np.maximum.accumulate(last[order] + base)
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    at = np.flatnonzero(new)
    base = base[at]
    return row[order][at], first[at] - base, end[np.append(at[1:], len(first)) - 1] - base


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): th tells texts and null ids apart, doc_id is never null."""
    kind = docs.schema["doc_id"].dataType
    return docs.select(F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc_id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"), "text")


def _anchor_rows(src: DataFrame, kinds: list[Kind]) -> DataFrame:
    """(doc_id, th, kind, h, at, lo, hi) of all anchors of each kind."""
    id_type = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "th", "kind", "h", "at", "lo", "hi"]

    def make():
        def one(b: pa.RecordBatch, i: int, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            h, text, at, lo, hi = found
            pick = pa.array(text)
            return C.records(names, [b.column(0).take(pick), b.column(1).take(pick), np.full(len(h), i), H.mix(h + np.uint64(i)).view(np.int64), at, lo, hi], [None, None, *[pa.int64()] * 5])

        return lambda b: pa.Table.from_batches([one(b, i, found) for i, found in enumerate(anchors_of(b, kinds))]).combine_chunks().to_batches()

    def run(batches):
        work = make()
        for batch in batches:
            for part in C.slices(batch, ANCHOR_BYTES):
                yield from (x for x in work(part) if x.num_rows)

    src.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", C.ARROW_ROWS)
    return src.mapInArrow(run, f"doc_id {id_type}, th long, kind long, h long, at long, lo long, hi long")


def _ids(content: bytes, key: int, left: int) -> tuple[int, int]:
    """128 bits that stand for a content under its key, with its anchor ``left`` bytes in."""
    return _PAIR.unpack(hashlib.blake2b(_PAIR.pack(key, left) + content, digest_size=16).digest())


def _contexts(docs: DataFrame, kinds: list[Kind]) -> DataFrame:
    """(doc_id, th, kind, lo, h, hot, c1, c2, lft, sent, bytes): bytes only the first time a task sends the content, null the second."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "th", "kind", "lo", "h", "hot", "c1", "c2", "lft", "sent", "bytes"]

    def make():
        seen: dict[bytes, int] = {}

        def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
            owned = b.column(3)
            row = np.repeat(np.arange(b.num_rows), owned.value_lengths().to_numpy(zero_copy_only=False))
            kind, at, lo, hi, h, hot = (x.to_numpy(zero_copy_only=False) for x in owned.flatten().flatten())
            # repeated rows have the same anchors several times
            order = np.lexsort((lo, kind, row))
            row, kind, at, lo, hi, h, hot = (x[order] for x in (row, kind, at, lo, hi, h, hot))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1]) | (lo[1:] != lo[:-1])
            row, kind, at, lo, hi, h, hot = (x[new] for x in (row, kind, at, lo, hi, h, hot))
            contents: list[bytes | None] = [None] * len(row)
            ids, sent = [b""] * len(row), np.ones(len(row), bool)
            heads = np.stack([h, at - lo], axis=1).astype("<i8").tobytes()
            for i, k in enumerate(kinds):
                mine = np.flatnonzero(kind == i)
                if not len(mine):
                    continue
                raw, offsets = units(b, k.words)
                raw, base = raw.tobytes(), offsets[row[mine]]
                for j, first, last in zip(mine.tolist(), (base + lo[mine]).tolist(), (base + hi[mine] + k.length).tolist()):
                    content = raw[first:last]
                    ids[j] = cid = hashlib.blake2b(heads[16 * j : 16 * j + 16] + content, digest_size=16).digest()
                    times = seen.get(cid, 0)
                    if times == 2:
                        sent[j] = False
                        continue
                    if times == 0:
                        if len(seen) >= SEEN:
                            seen.clear()
                        contents[j] = content
                    seen[cid] = times + 1
            c = np.frombuffer(b"".join(ids), "<i8").reshape(-1, 2)
            pick = pa.array(row)
            cols = [b.column(0).take(pick), b.column(1).take(pick), kind, lo, h, hot.astype(bool), c[:, 0], c[:, 1], at - lo, sent, contents]
            return C.records(names, cols, [None, *[pa.int64()] * 4, pa.bool_(), *[pa.int64()] * 3, pa.bool_(), pa.binary()])

        return work

    return C.map_rows(docs, make, f"doc_id {id_type}, th long, kind long, lo long, h long, hot boolean, c1 long, c2 long, lft long, sent boolean, bytes binary")


def _offset_blocks(at: int, first: int, last: int, width: int) -> list[tuple[int, int]]:
    """The starts first..last, parted where (at - start) // width changes: equal windows lie in equal parts, as these are counted from the anchor."""
    out = []
    while first <= last:
        end = min(last, at - (at - first) // width * width)
        out.append((first, end))
        first = end + 1
    return out


def _parts(contents: DataFrame, length: int, width: int) -> DataFrame:
    """(p1, p2, at, h, c1, c2, lft, bytes): the parts of ``width`` windows of each content (c1, c2, h, lft, bytes)."""
    names = ["p1", "p2", "at", "h", "c1", "c2", "lft", "bytes"]

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in names]
            for h, p1, p2, at, content in zip(*(c.to_pylist() for c in b.columns)):
                for first, last in _offset_blocks(at, 0, len(content) - length, width):
                    block = (at - first) // width
                    # what all windows of the part share, also of a part that the context cuts short
                    core = content[max(0, at - block * width) : at - block * width - width + 1 + length]
                    key = _ids(core, h, block)[0]
                    part = content[first : last + length]
                    for c, v in zip(cols, (p1, p2, first, key, *_ids(part, key, at - first), at - first, part if width > 1 else None)):
                        c.append(v)
            return C.records(names, cols, [*[pa.int64()] * 7, pa.binary()])

        return work

    return C.map_rows(contents.select("h", "c1", "c2", "lft", "bytes"), make, ", ".join(f"{x} long" for x in names[:-1]) + ", bytes binary")


def _expand_rows(sent: DataFrame, length: int) -> DataFrame:
    """(c1, c2, spans array<struct<a, b>>) of the contents (h, c1, c2, lft, bytes, n) with a repeated window.

    Rows of one h are together and sorted; a content may come in several rows, its bytes in one at least.
    """

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]):
            by: dict[tuple, list] = {}
            for h, c1, c2, left, content, n in rows:
                x = by.setdefault((h, c1, c2), [0, left, None])
                x[0] += n
                if content is not None:
                    x[2] = content
            keys, (times, lefts, contents) = list(by), zip(*by.values())
            group = np.unique(np.array([k[0] for k in keys], np.int64), return_inverse=True)[1]
            data = np.frombuffer(b"".join(contents), np.uint8)
            sizes = np.array([len(c) for c in contents])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            place = np.flatnonzero(expand(group, data, bounds[:-1], np.array(lefts), sizes, length))
            whole = np.flatnonzero(np.array(times) > 1)
            # a content that came twice is a span as a whole, whatever is marked in it
            row = np.searchsorted(bounds, place, side="right") - 1
            single = ~np.isin(row, whole)
            row, place = row[single], place[single] - bounds[row[single]]
            row, first, last = merged(np.concatenate([row, whole]), np.concatenate([place, whole * 0]), np.concatenate([place + length, sizes[whole]]))
            if not len(row):
                return None
            found, count = np.unique(row, return_counts=True)
            ids = [keys[i] for i in found.tolist()]
            spans = pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["a", "b"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), spans)
            return C.records(["c1", "c2", "spans"], [[k[1] for k in ids], [k[2] for k in ids], lists], [pa.int64(), pa.int64(), None])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    if (out := flush(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) if row[4] is not None else 0
        if held and (out := flush(held)) is not None:
            yield out

    spark = sent.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", C.ARROW_ROWS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sent.select("h", "c1", "c2", "lft", "bytes", "n").repartition(parts, "h").sortWithinPartitions("h").mapInArrow(run, _SPANS)


_SPANS = "c1 long, c2 long, spans array<struct<a: bigint, b: bigint>>"


def _shifted(spans: str, by: str) -> F.Column:
    return F.transform(spans, lambda s: F.struct((s["a"] + F.col(by)).alias("a"), (s["b"] + F.col(by)).alias("b")))


def _distinct(contents: DataFrame) -> DataFrame:
    return contents.groupBy("h", "c1", "c2").agg(F.first("lft").alias("lft"), F.first("bytes", True).alias("bytes"), F.sum("n").alias("n"))


def _content_spans(scratch: C.Scratch, many: DataFrame, length: int, hot: int, few: DataFrame | None = None, widths: tuple[int, ...] = (WIDTH, 1)) -> DataFrame:
    """(c1, c2, spans) of distinct contents (h, c1, c2, lft, bytes, n), whose keys with more than ``hot`` contents are cut narrower.

    ``few`` are contents of further keys that have ``hot`` rows at most.
    """
    heavy = scratch.save(many.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("h"))
    light = many if heavy.isEmpty() else many.join(heavy, "h", "left_anti")
    done = scratch.save(_expand_rows(light if few is None else light.unionByName(few), length))
    if heavy.isEmpty():
        return done
    width = widths[0]
    many = scratch.save(many.join(heavy, "h", "left_semi"))
    parts = scratch.save(_parts(many, length, width))
    each = _distinct(parts.withColumn("n", F.lit(1).cast("long")))
    if width > 1:
        inner = _content_spans(scratch, scratch.save(each), length, hot, widths=widths[1:])
    else:  # a part is one window, so equal parts are all that repeats
        inner = each.where("n > 1").select("c1", "c2", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(length).cast("long").alias("b"))).alias("spans"))
    back = parts.select("p1", "p2", "at", "c1", "c2").join(inner, ["c1", "c2"]).select("p1", "p2", F.explode(_shifted("spans", "at")).alias("s"))
    # contents that occur twice or more are repeated as a whole
    whole = many.where("n > 1").select(F.col("c1").alias("p1"), F.col("c2").alias("p2"), F.struct(F.lit(0).cast("long").alias("a"), F.length("bytes").cast("long").alias("b")).alias("s"))
    narrow = back.unionByName(whole).groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.collect_set("s").alias("spans"))
    return scratch.save(done.unionByName(narrow))


def repeated_spans(docs: DataFrame, kinds: list[Kind], hot: int = HOT) -> DataFrame:
    """(doc_id, th, spans_0, ...) of the ``_keyed`` documents with anything repeated: spans of each kind in its units; they may overlap.

    All kinds go through one pass over the texts, which are joined with their anchors once.
    """
    scratch = C.Scratch(docs.sparkSession, "suffix")
    src = _keyed(docs)
    found = scratch.save(_anchor_rows(src, kinds))
    repeated = scratch.save(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h", (F.col("c") > hot).alias("hot")))
    owned = found.join(repeated, "h").groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "at", "lo", "hi", "h", "hot")).alias("owned"))
    contexts = scratch.save(_contexts(src.join(owned, ["doc_id", "th"]).select("doc_id", "th", "text", "owned"), kinds))
    scratch.drop(found, repeated)
    spans = None
    for i, kind in enumerate(kinds):
        # an anchor that is rare has few contexts; of the others the different ones are counted
        sent = contexts.where("sent").where(F.col("kind") == i).select("hot", "h", "c1", "c2", "lft", "bytes", F.lit(1).cast("long").alias("n"))
        part = _content_spans(scratch, scratch.save(_distinct(sent.where("hot"))), kind.length, hot, sent.where("not hot").drop("hot"))
        spans = part if spans is None else spans.unionByName(part)
    places = contexts.select("doc_id", "th", "kind", "lo", "c1", "c2").join(spans, ["c1", "c2"]).select("doc_id", "th", "kind", F.explode(_shifted("spans", "lo")).alias("s"))
    out = scratch.save(places.groupBy("doc_id", "th").agg(*[F.collect_set(F.when(F.col("kind") == i, F.col("s"))).alias(f"spans_{i}") for i in range(len(kinds))]))
    scratch.drop(contexts)
    return out


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _with_spans(docs: DataFrame, length: int, k: int, hot: int, words: int = 0) -> DataFrame:
    """The rows with one more column, ``_spans``; with ``words`` also ``_word_spans``, of passages of so many words."""
    kinds = [Kind(length, k, False)] + [Kind(words * WORD_BYTES, min(words, WORD_KGRAM) * WORD_BYTES, True)] * bool(words)
    spans = repeated_spans(docs, kinds, hot).withColumnsRenamed({"doc_id": "_id", "th": "_th", "spans_0": "_spans", "spans_1": "_word_spans"})
    id_type = docs.schema["doc_id"].dataType
    return docs.join(spans, (F.coalesce("doc_id", F.lit(0).cast(id_type)) == F.col("_id")) & (F.xxhash64("text", F.col("doc_id").isNull()) == F.col("_th")), "left").drop("_id", "_th")


def _spans(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b) of a column of spans."""
    row = np.repeat(np.arange(len(col)), pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))
    a, b = (x.to_numpy(zero_copy_only=False) for x in col.flatten().flatten())
    return row, a, b


def _runs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that repeat: (row, first, last)."""
    return merged(*_spans(b.column("_spans")))


def _word_runs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``units`` as bytes of the texts: from a word's start to the start of the first word that stays."""
    row, first, last = merged(*_spans(b.column("_word_spans")))
    if not len(row):
        return row, first, last
    some, at = np.unique(row, return_inverse=True)
    raw, offsets = H.buffers(b.select(["text"]).take(pa.array(some)))
    start, _, bounds = H.word_bounds(raw, offsets)
    first, last = bounds[at] - (-first // WORD_BYTES), bounds[at] + last // WORD_BYTES
    ends = np.where(last < bounds[at + 1], np.append(start, 0)[last], offsets[at + 1])
    return row, start[first] - offsets[at], ends - offsets[at]


def _totals(row: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, row, size)
    return out


def _cut(raw: bytes, offsets: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[int, bytes]:
    """What is left of the rows that have runs."""
    row, first, last = runs
    some, at = np.unique(row, return_index=True)
    spans = list(zip(first.tolist(), last.tolist()))
    bounds = [*at.tolist(), len(spans)]
    return {r: cut(raw[offsets[r] : offsets[r + 1]], spans[i:j]) for r, i, j in zip(some.tolist(), bounds[:-1], bounds[1:])}


def dedup(docs: DataFrame, length: int = MIN_LENGTH, k: int = KGRAM, hot: int = HOT, words: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, n_passages, n_passage_bytes) of every row: the text without its repeated bytes.

    With ``words``, the last two tell the runs of passages of so many words that also stand
    elsewhere, and their bytes; ``kept`` and the others don't depend on them. Else they are 0.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passages", "n_passage_bytes"]

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            n = b.num_rows
            raw, offsets = H.buffers(b)
            raw = raw.tobytes()
            runs = row, first, last = _runs(b)
            left = _cut(raw, offsets, runs)
            kept = [left[i] if i in left else raw[x:y] for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()))]
            of_words = _word_runs(b) if words else (row[:0], first[:0], last[:0])
            counts = [x for r, f, e in (runs, of_words) for x in (_totals(r, e - f, n), np.bincount(r, minlength=n))]
            cols = [b.column(0), np.diff(offsets), counts[0], counts[1], kept, counts[3], counts[2]]
            return C.records(names, cols, [None, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()])

        return work

    rows = _with_spans(docs.select("doc_id", "text"), length, k, hot, words).select("doc_id", "text", "_spans", *["_word_spans"] * bool(words))
    return C.map_rows(rows, make, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_passages long, n_passage_bytes long")


def clean(docs: DataFrame, length: int = MIN_LENGTH, k: int = KGRAM, hot: int = HOT, words: int = 0) -> DataFrame:
    """The rows with repeated bytes cut out of ``text``, and characters that a cut has parted; other columns as they are.

    With ``words``, passages of so many words that also stand elsewhere are cut out too, however few bytes they have.
    """

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            at = b.schema.get_field_index("text")
            runs = [of(b) for name, of in zip(added, (_runs, _word_runs)) if b.column(name).null_count < b.num_rows]
            if any(len(x[0]) for x in runs):
                raw, offsets = H.buffers(b)
                texts = b.column(at).to_pylist()
                for i, left in _cut(raw.tobytes(), offsets, merged(*map(np.concatenate, zip(*runs)))).items():
                    texts[i] = left.decode("utf-8", "ignore")
                b = b.set_column(at, "text", pa.array(texts, pa.string()))
            return b.drop_columns(added)

        return work

    added = ["_spans", "_word_spans"] if words else ["_spans"]
    return C.map_rows(_with_spans(docs, length, k, hot, words).select(*docs.columns, *added), make, docs.schema)


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the columns of 400-byte strings, passages of over 50 words that stand elsewhere too, which can be shorter."""
    out = dedup(C.read(spark, sf_dir, "documents"), words=PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_bytes")
