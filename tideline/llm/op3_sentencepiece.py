"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

The text is escaped (space to U+2581, one in front) and cut where no piece can cross: before
a run of U+2581 and around characters without a piece. Each part is encoded by backtracking:
an Aho-Corasick automaton gives the longest piece at every position, a piece is accepted if
the re-merged pair with its left neighbour falls apart into the same two pieces, and a
bitfield marks positions from which no encoding goes on. Runs of several U+2581 are merged
with a heap instead, since their pieces share one score and pairwise checks need distinct
priorities. Characters without a piece become byte pieces.

Null and empty texts give just the end id; repeated rows give repeated results; other columns
of the input are not read, so clashing names don't matter. Texts of any length are encoded
whole; memory is a bounded cache of parts plus the text.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

SPACE_MARK = "▁"
PARTS = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")
#: Bounds of the caches: entries, and the length of a part that is kept.
CACHE_PARTS = 400_000
CACHE_PAIRS = 400_000
CACHE_CHARS = 40


class PieceModel:
    """Encoder and decoder for a merge-type model file with byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.eos = sp.eos_id()
        self.byte_id = {}
        self.piece: list[str] = []
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            self.piece.append(p)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p], self.score[p] = i, sp.get_score(i)
        self.byte_of = {v: k for k, v in self.byte_id.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        # a piece that its own merges do not rebuild can never appear in an encoding
        valid = [p for p in self.ids if SPACE_MARK * 2 not in p and self.merge(p) == [p]]
        self.valid = set(valid)
        self.auto = ahocorasick.Automaton()
        for p in valid:
            self.auto.add_word(p, len(p))
        self.auto.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.valid), None) for p in valid}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.id_text = {p: str(i) for p, i in self.ids.items()}
        self.encoded = _Cache(self._encode_part)
        self.chars = frozenset(p for p in self.ids if len(p) == 1)

    def merge(self, text: str) -> list[str]:
        """Pieces after merging the best-scored adjacent pair, leftmost first, until none is left."""
        sym: list[str | None] = list(text)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        score, heap = self.score, []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (s := score.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-s, i, j, len(sym[i]) + len(sym[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if sym[i] is None or sym[j] is None or nxt[i] != j or len(sym[i]) + len(sym[j]) != size:
                continue
            sym[i] += sym[j]
            sym[j] = None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(prv[i], i)
            offer(i, nxt[i])
        return [s for s in sym if s is not None]

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.merge(a + b) == [a, b]
            if len(self.pairs) < CACHE_PAIRS:
                self.pairs[key] = ok
        return ok

    def backtrack(self, part: str) -> list[str]:
        """Pieces of a part all of whose characters have pieces and priorities are distinct."""
        if part in self.valid:
            return [part]
        n = len(part)
        longest = [0] * (n + 1)
        for end, size in self.auto.iter(part):
            # matches come by rising end, so a later one with the same start is longer
            longest[end - size + 1] = size
        out: list[str] = []
        pairs, compatible, shorter = self.pairs, self.compatible, self.shorter
        open_at = bytearray(b"\xff" * (n // 8 + 1))
        pos, token = 0, part[: longest[0]]
        while token:
            last = out[-1] if out else None
            while True:
                end = pos + len(token)
                if open_at[end >> 3] >> (end & 7) & 1 and (last is None or ((ok := pairs.get((last, token))) is None and compatible(last, token)) or ok):
                    out.append(token)
                    pos = end
                    token = part[pos : pos + longest[pos]]
                    break
                token = shorter[token]
                if token is None:
                    open_at[pos >> 3] &= ~(1 << (pos & 7)) & 255
                    token = out.pop()
                    pos -= len(token)
                    break
        return out

    def part_ids(self, part: str) -> list[int]:
        known = self.ids
        if self.chars.issuperset(part) and SPACE_MARK * 2 not in part:
            return [known[p] for p in self.backtrack(part)]
        ids: list[int] = []
        for stretch, ch in _stretches(part, known):
            if stretch:
                pieces = self.merge(stretch) if SPACE_MARK * 2 in stretch else self.backtrack(stretch)
                ids.extend(map(known.__getitem__, pieces))
            if ch:
                ids.extend(self.byte_id[b] for b in ch.encode("utf-8"))
        return ids

    def _encode_part(self, part: str) -> tuple[str, str]:
        """The ids as text, and what they decode to."""
        if self.chars.issuperset(part) and SPACE_MARK * 2 not in part:
            pieces = self.backtrack(part)
            return " ".join(map(self.id_text.__getitem__, pieces)), "".join(pieces).replace(SPACE_MARK, " ")
        ids = self.part_ids(part)
        return " ".join(map(str, ids)), self.decode_raw(ids)

    @staticmethod
    def escape(text: str) -> str:
        return SPACE_MARK + text.replace(" ", SPACE_MARK) if text else ""

    def encode(self, text: str, end: bool = True) -> list[int]:
        ids = [int(x) for part in PARTS.findall(self.escape(text)) for x in self.encoded[part][0].split()]
        return ids + [self.eos] if end else ids

    def decode_raw(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i not in self.control:
                out.append(self.piece[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE_MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids`` without the space that encoding puts in front."""
        return self.decode_raw(ids).removeprefix(" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        parts = PARTS.findall(self.escape(text))
        done = list(map(self.encoded.__getitem__, parts))
        ids = " ".join([*[d[0] for d in done], str(self.eos)])
        back = "".join([d[1] for d in done]).removeprefix(" ")
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest()


class _Cache(dict):
    """Bounded: once full, what has not been asked for since the last time it was full goes."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, part: str) -> tuple[str, str]:
        out = self.old.get(part) or self.make(part)
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_PARTS:
                self.old = dict(self)
                self.clear()
            self[part] = out
        return out


def _stretches(part: str, known: dict[str, int]):
    """(stretch of characters with pieces, the character without one that ends it)."""
    start = 0
    for i, ch in enumerate(part):
        if ch not in known:
            yield part[start:i], ch
            start = i + 1
    if start < len(part):
        yield part[start:], ""


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_table(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row."""

    def make():
        m = model(model_file)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [m.encode(t) for t in C.texts_of(b)]
            return C.records(["id", "ids", "decoded"], [b.column(0), ids, [m.decode(x) for x in ids]], [None, pa.list_(pa.int32()), pa.string()])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return C.map_rows(docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text"), make, f"id {kind}, ids array<int>, decoded string")


def digest_table(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; ids of any type, null among them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        m = model(model_file)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [m.digest(t) for t in C.texts_of(b)]
            n, ids, back = zip(*rows)
            return C.records(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [b.column(0), n, ids, back], [None, pa.int64(), pa.string(), pa.string()])

        return work

    return C.map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_table(C.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
