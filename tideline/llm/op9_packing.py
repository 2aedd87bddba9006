"""Bounded-space online packing of tokenised documents.

Every partition keeps ``open_windows`` windows. A document's ids are cut at the window size;
full pieces make sequences of their own, the rest goes to the open window it leaves least
room in (best fit). Where it fits none, the fullest window is topped up with the front of the
rest and emitted, so it carries no padding, and a new window takes its place. At its end a
partition emits the windows it still has as leftovers. These are merged: the leftovers of
MERGE_FAN_IN partitions are laid end to end and cut anew, what fills no window is passed on to
the next level, and the very last rest is cut into sequences of power-of-two sizes. So only
ids of a bounded number of windows a partition move, never text, and nothing is padded.

Null and empty texts are one piece that holds the end id. Repeated rows are packed like any
others. An empty table gives an empty result. Texts of any length are encoded whole. Only
``doc_id`` and ``text`` are read, so clashing names of other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 1024
OPEN_WINDOWS = 16
#: Partitions whose leftovers one task merges before all groups' leftovers meet.
MERGE_FAN_IN = 64
END_ID = 0
#: Texts of these characters alone go by the fast encoder: on others the two libraries' Unicode tables may differ.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*\Z")
SPECIAL = "<|endoftext|>"


def _bytes_of_characters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters are themselves, the rest follow from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevelEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    The vocabulary's merges are in id order, so the ids are also ranks: plain texts are encoded
    with them, any others by the vocabulary's own library. Both give the same ids.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        byte_of = _bytes_of_characters()
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = {bytes(map(byte_of.__getitem__, k)): v for k, v in self.library.get_vocab(with_added_tokens=True).items() if k not in special}
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if PLAIN.match(text) and SPECIAL not in text:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return b"".join([i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids])


_ENCODERS: dict[str, ByteLevelEncoder] = {}


def encoder(vocabulary: str) -> ByteLevelEncoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ByteLevelEncoder(vocabulary)
    return _ENCODERS[vocabulary]


class Packer:
    """Windows of one partition. ``add`` yields pieces (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.open_windows = window, open_windows
        self.fill: dict[int, int] = {}
        self.pieces: dict[int, list] = {}
        self.next_sequence = 0

    def _new(self) -> int:
        s = self.next_sequence
        self.next_sequence += 1
        return s

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            yield doc_id, start, ids[4 * start : 4 * (start + self.window)], total, self._new(), 0
            start += self.window
        while start < total:
            rest = total - start
            fit = [(f, s) for s, f in self.fill.items() if f + rest <= self.window]
            if fit:
                s, take = max(fit)[1], rest
            elif len(self.fill) < self.open_windows:
                s, take = self._new(), rest
                self.fill[s], self.pieces[s] = 0, []
            else:
                f, s = max((f, -s) for s, f in self.fill.items())
                s, take = -s, self.window - f
            self.pieces[s].append((doc_id, start, ids[4 * start : 4 * (start + take)], total, s, self.fill[s]))
            self.fill[s] += take
            start += take
            if self.fill[s] == self.window:
                del self.fill[s]
                yield from self.pieces.pop(s)

    def leftovers(self) -> Iterator[tuple]:
        for s in list(self.fill):
            yield from self.pieces[s]


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def _pack_partition(docs: DataFrame, vocabulary: str, window: int, open_windows: int, with_ids: bool) -> DataFrame:
    """Pieces of full windows, and of those left over with their ids (``raw``), which are few."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "left", "raw"]
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", C.ARROW_ROWS)

    def run(batches):
        enc, packer, part, id_type = encoder(vocabulary), Packer(window, open_windows), None, None

        def emit(rows: list[tuple], left: bool) -> pa.RecordBatch:
            doc, start, ids, total, seq, offset = zip(*rows)
            n = len(rows)
            long = lambda x: pa.array(x, pa.int64())
            cols = [pa.array(doc, id_type), long(start), long([len(x) // 4 for x in ids]), long(list(map(_crc, ids))), long(total), long([(part << 32) + s for s in seq]), long(offset), long([part] * n), pa.array([left] * n), pa.array(ids if left or with_ids else [None] * n, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            for b in C.slices(batch):
                part, id_type = b.column(2)[0].as_py(), b.schema.field(0).type
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), C.texts_of(b)):
                    rows.extend(packer.add(doc_id, enc.encode(text) + END_ID.to_bytes(4, "little")))
                if rows:
                    yield emit(rows, False)
        if packer.fill:
            yield emit(list(packer.leftovers()), True)

    src = docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    return src.mapInArrow(run, f"doc_id {kind}, {PIECE}, part long, left boolean, raw binary")


def recut(pieces: list[tuple], window: int, last: bool) -> list[tuple]:
    """Pieces (doc, start, ids, total) laid end to end and cut into windows: (doc, start, ids, total, window number, offset).

    The rest that fills no window comes last, as window -1; the very last rest is cut into
    windows whose sizes are powers of two, which need no padding.
    """
    total = sum(len(p[2]) // 4 for p in pieces)
    sizes = [window] * (total // window)
    rest = total % window
    if rest and last:
        sizes += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    elif rest:
        sizes.append(rest)
    out, w, at = [], 0, 0
    for doc, start, ids, tokens in pieces:
        while ids:
            if at == sizes[w]:
                w, at = w + 1, 0
            take = min(len(ids) // 4, sizes[w] - at)
            out.append((doc, start, ids[: 4 * take], tokens, -1 if rest and not last and w == len(sizes) - 1 else w, at))
            ids, start, at = ids[4 * take :], start + take, at + take
    return out


def _merge(left: DataFrame, level: int, last: bool, window: int, with_ids: bool) -> DataFrame:
    """Leftovers of groups of partitions, cut anew; a group passes on less than one window."""
    names = [f.name for f in left.schema.fields]

    def merge(table: pa.Table) -> pa.Table:
        t = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        grp = t["part"][0].as_py() // MERGE_FAN_IN
        rows = [
            (doc, start, len(ids) // 4, _crc(ids), total, -1 - ((level << 56) + (grp << 24) + w) if w >= 0 else 0, offset, grp, w < 0, ids if w < 0 or with_ids else None)
            for doc, start, ids, total, w, offset in recut(list(zip(*(t[n].to_pylist() for n in ("doc_id", "start", "raw", "doc_tokens")))), window, last)
        ]
        return pa.Table.from_arrays([pa.array(c, t.schema.field(n).type) for n, c in zip(names, zip(*rows))], names=names)

    return left.groupBy(F.expr(f"part div {MERGE_FAN_IN}")).applyInArrow(merge, left.schema)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of all documents."""
    scratch = C.Scratch(docs.sparkSession, "packing")
    # the packing is kept before anything reads it twice: a partition computed again must not be packed in another order
    packed = scratch.save(_pack_partition(docs, vocabulary, window, open_windows, with_ids))
    parts = 1 + (packed.agg(F.max("part")).first()[0] or 0)
    done, left, level = packed.where("not left"), packed.where("left"), 0
    last = parts <= MERGE_FAN_IN
    while True:
        merged = scratch.save(_merge(left, level, last, window, with_ids))
        done = done.unionByName(merged.where("not left"))
        if last:
            break
        left, level, parts = merged.where("left"), level + 1, -(-parts // MERGE_FAN_IN)
        last = parts <= MERGE_FAN_IN
    out = done.drop("part", "left")
    if not with_ids:
        return out.drop("raw")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            raw = b.column(7).to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            return C.records([*b.schema.names[:7], "ids"], [*b.columns[:7], ids], [None] * 8)

        return work

    return C.map_rows(out, make, f"doc_id {kind}, {PIECE}, ids array<int>")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
