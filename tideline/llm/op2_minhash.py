"""Near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find.

SuperMinHash gives every shingle a random permutation of the signature's cells, drawn step by
step: at step j it offers j plus a random fraction to the j-th cell of its permutation, and a
text stops as soon as no step can lower a cell any more. Signatures are cut into BANDS of ROWS
values; a pair at similarity 0.85 misses all bands with probability below 1e-6. For another
percentage ``bands_for`` gives the number of bands that keeps that bound.

Texts with equal sets collapse to their smallest id before banding, so exact copies of any
number cost one row each. Buckets are never expanded into pairs. Round by round, each bucket
that still spans several components names one member as centre, each member outside the
centre's component is verified against one such centre, and components are joined. The rest is
exact: the members of buckets that still span several components are joined on their rarest
shingles, which finds every pair of different components that can be similar, and what was not
tested yet is verified. Pairs move with their full sets and are confirmed by 100 * intersection >= 85 * union.

Null texts and texts without a word have an empty set, link with nothing and are kept. Repeated
ids with one text are one document twice. Ids may be of any type that can be ordered: where they aren't whole numbers,
or some are null, rows are written once with numbers of their own and linked by these. A component's id is then its
smallest id that isn't null; one without any has a null id and keeps its first row.
Ties are broken by the smaller id. Only ``doc_id``
and ``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import hashing as H

SHINGLE = 5
BANDS, ROWS = 24, 5
CELLS = BANDS * ROWS
#: Percent: the intersection over the union of linked sets.
SIMILARITY = 85
STAR_ROUNDS = 1
SPREAD = 500
MISS = 1e-6
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(percent: int) -> int:
    """Bands of ROWS values that a pair at this similarity misses with probability below MISS."""
    return 1 if percent >= 100 else math.floor(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS))) + 1


def signatures(sets: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """SuperMinHash signatures (texts, cells); a value is step * 2**40 plus a 40-bit fraction."""
    n = len(sets)
    sig = np.full((n, cells), _NEVER)
    flat = sig.ravel()
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(n), [len(s) for s in sets])
    swaps: list[np.ndarray] = []
    for j in range(cells):
        if not len(values):
            break
        z = H.mix(values + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((z & np.uint64(0xFFFFFF)) * np.uint64(cells - j) >> np.uint64(24)).astype(np.int64)
        # the cell at place k of a permutation that earlier swaps have touched
        cell = k
        for i in range(j - 1, -1, -1):
            cell = np.where(cell == swaps[i], i, cell)
        swaps.append(k)
        np.minimum.at(flat, text * cells + cell, (np.uint64(j) << np.uint64(40)) + (z >> np.uint64(24)))
        # no later step is below (j + 1) * 2**40: texts with all cells below that are done
        going = sig.max(axis=1) >= np.uint64(j + 1) << np.uint64(40)
        if not going.all():
            keep = going[text]
            if not keep.all():
                values, text = values[keep], text[keep]
                swaps = [s[keep] for s in swaps]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bands = sig.shape[1] // ROWS
    parts = sig.reshape(len(sig), bands, ROWS)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = H.mix(key + parts[:, :, r])
    return key.view(np.int64)


def sketch(docs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, key_hi, key_lo, bands array<long>) of every row; the keys identify the set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = H.shingle_sets(*H.word_hashes(*H.buffers(b)), SHINGLE)
            bands = band_keys(signatures(sets, n_bands * ROWS))
            n = np.array([len(s) for s in sets])
            hi = np.array([H.mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            lo = np.array([H.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(bands) * n_bands + 1, n_bands, dtype=np.int32), bands.ravel())
            return C.records(["doc_id", "n_shingles", "key_hi", "key_lo", "bands"], [b.column(0), n, hi, lo, lists], [None, pa.int64(), pa.int64(), pa.int64(), None])

        return work

    return C.map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_shingles long, key_hi long, key_lo long, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles binary) of the documents in ``wanted``, maybe of a few others: sorted distinct hashes as 64-bit values.

    A filter of bounded size picks the documents in their own tasks; more ids than it can hold are joined instead.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    count = wanted.count()
    shared = docs.sparkSession.sparkContext.broadcast(C.IdFilter(wanted, "doc_id", count)) if C.IdFilter.fits(count) else None

    def make():
        ids = shared.value if shared is not None else None

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            if ids is not None:
                b = b.filter(pa.array(ids.passes(b.column(2).to_numpy())))
            sets = H.shingle_sets(*H.word_hashes(*H.buffers(b)), SHINGLE)
            return C.records(["doc_id", "shingles"], [b.column(0), [s.tobytes() for s in sets]], [None, pa.binary()])

        return work

    picked = docs if shared is not None else docs.join(wanted, "doc_id", "left_semi")
    return C.map_rows(picked.select("doc_id", "text", C.IdFilter.hashed("doc_id").alias("hash")), make, f"doc_id {kind}, shingles binary")


def similar(a: bytes, b: bytes, percent: int = SIMILARITY) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int(np.count_nonzero(y[at] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()
    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            ok = [similar(x, y, percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            return b.select([0, 1]).filter(pa.array(ok))

        return work

    return C.map_rows(full.select("a", "b", "sa", "sb"), make, f"a {kind}, b {kind}")


def _rest(scratch: C.Scratch, docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (rep, centre) of different components that may be similar, of docs (rep, n, comp): an exact prefix join.

    Shingles are ordered by how many of these documents have them, the rarest first. Two sets
    that share enough have a common shingle so early in both that what is left from there on
    still can make up the intersection. A shingle that no other document has can't be common,
    so it counts for the places of the others and isn't joined. For each shingle, documents of
    its largest component are only met by documents of others.
    """
    flat = sets.join(docs.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    kind = sets.schema["doc_id"].dataType.simpleString()

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            raw = b.column(1).to_pylist()
            return C.records(["rep", "s"], [b.column(0).take(pa.array(np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw]))), np.frombuffer(b"".join(raw), np.int64)], [None, pa.int64()])

        return work

    # what is read several times is kept: that costs less than to plan and do it again
    tokens = scratch.save(C.map_rows(flat, make, f"rep {kind}, s long"))
    common = tokens.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    mine = C.salted_join(tokens, common, ["s"], "rep").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("t")).join(docs, "rep")
    mine = mine.withColumn("alone", F.col("n") - F.size("t"))
    # a partner's set is no smaller than percent of this one, so the intersection isn't either
    early = F.floor(F.col("n") * (100 - percent) / 100) + 1 - F.col("alone")
    place = mine.where(early > 0).select("rep", "n", "comp", "alone", F.posexplode(F.slice("t", F.lit(1), early.cast("int"))).alias("i", "x")).select("rep", "n", "comp", (F.col("alone") + F.col("i")).alias("pos"), "x.s")
    place = scratch.save(place)
    scratch.drop(tokens)
    largest = place.groupBy("s", "comp").agg(F.count("*").alias("c")).groupBy("s").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest"), F.sum("c").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").drop("lo", "hi")
    # a shingle of many documents is dealt out to a task for every SPREAD of them
    tasks = F.ceil(F.col("rows") / SPREAD).cast("int")
    place = scratch.save(C.salted_join(place, largest, ["s"], "rep").withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(1)), tasks).cast("int")))
    minor = place.where("comp <> largest").select("s", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt"), F.col("rep").alias("centre"), F.col("comp").alias("cc"), F.col("n").alias("cn"), F.col("pos").alias("cpos"))
    # intersection >= percent of union is intersection * (100 + percent) >= percent * (sum of sizes)
    need = (F.col("n") + F.col("cn")) * percent
    enough = ((F.col("n") - F.col("pos")) * (100 + percent) >= need) & ((F.col("cn") - F.col("cpos")) * (100 + percent) >= need)
    once = (F.col("comp") == F.col("largest")) | (F.col("rep") < F.col("centre"))
    return place.join(minor, ["s", "salt"]).where((F.col("comp") != F.col("cc")) & once & enough).select("rep", "centre")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct()


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows with ``comp``, the component of their ``rep``; a document without links is its own."""
    return rows.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _joined(scratch: C.Scratch, comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components by earlier links and new ones (a, b): the new ones join components, of which there are fewer than documents."""
    if comp is None:
        return scratch.save(C.components(scratch, links))
    ends = _labelled(_labelled(links.withColumnRenamed("a", "rep"), comp).drop("rep").withColumnsRenamed({"comp": "ca", "b": "rep"}), comp)
    edges = scratch.save(ends.select(F.col("ca").alias("a"), F.col("comp").alias("b")).where("a <> b").distinct())
    if edges.isEmpty():
        return comp
    over = scratch.save(C.components(scratch, edges))
    moved = comp.join(over.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    return scratch.save(moved.unionByName(over.join(comp.select("node"), "node", "left_anti")))


def _linked(docs: DataFrame, percent: int, star_rounds: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ids are whole numbers."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "minhash")
    sk = scratch.save(sketch(docs, bands_for(percent)))
    ids = ["n_shingles", "key_hi", "key_lo"]
    classes = scratch.save(sk.where("n_shingles > 0").groupBy(*ids).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    slots = classes.select("rep", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    shared = slots.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    members = scratch.save(C.salted_join(slots, shared, ["band", "key"], "rep"))
    sets = scratch.save(full_sets(docs, members.select(F.col("rep").alias("doc_id")).distinct()))
    # a member of many large buckets is close to what its group has in common: the best centre
    rank = C.salted_join(members, members.groupBy("band", "key").agg(F.count("*").alias("c")), ["band", "key"], "rep").groupBy("rep").agg(F.sum("c").alias("rank"))
    members = scratch.save(members.join(rank, "rep"))
    close = F.least("n", "cn") * 100 >= F.greatest("n", "cn") * percent
    tested = comp = None  # pairs that were verified; (node, component) by the links so far
    for r in range(star_rounds):
        live = members.withColumn("comp", F.col("rep")) if comp is None else _labelled(members, comp)
        # the best centre first, then one at random: from a group that doesn't hold together yet it soon is a new one
        order = F.struct(F.col("rank"), -F.col("rep")) if r == 0 else F.struct(F.xxhash64("rep", F.lit(r)), F.col("rep"))
        buckets = live.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by(F.struct("rep", "comp", "n"), order).alias("c")).where("lo <> hi").drop("lo", "hi")
        pairs = C.salted_join(live, buckets.select("band", "key", F.col("c.rep").alias("centre"), F.col("c.comp").alias("cc"), F.col("c.n").alias("cn")), ["band", "key"], "rep").where((F.col("comp") != F.col("cc")) & close)
        if tested is not None:
            pairs = pairs.withColumn("a", F.greatest("rep", "centre")).withColumn("b", F.least("rep", "centre")).join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(_ordered(pairs.groupBy("rep").agg(F.min_by("centre", F.xxhash64("centre")).alias("centre"))))
        if pairs.isEmpty():
            break
        comp = _joined(scratch, comp, verify(pairs, sets, percent))
        tested = pairs if tested is None else scratch.save(tested.unionByName(pairs))
    # the rest is among members of buckets that still span several components
    live = members.withColumn("comp", F.col("rep")) if comp is None else scratch.save(_labelled(members, comp))
    split = live.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "key")
    docs_left = scratch.save(C.salted_join(live, split, ["band", "key"], "rep").select("rep", "n", "comp").distinct())
    if not docs_left.isEmpty():
        pairs = _ordered(_rest(scratch, docs_left, sets, percent))
        pairs = scratch.save(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            comp = _joined(scratch, comp, verify(pairs, sets, percent))
    head = classes.select(*ids, "rep")
    head = head.withColumn("component_id", F.col("rep")) if comp is None else _labelled(head, comp).withColumnRenamed("comp", "component_id")
    head = scratch.save(head.drop("rep"))
    out = sk.drop("bands").join(head, ids, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _numbered(docs: DataFrame) -> bool:
    """Whether all ids are whole numbers."""
    return isinstance(docs.schema["doc_id"].dataType, T.IntegralType) and docs.where("doc_id is null").isEmpty()


def _by_row(rows: DataFrame, percent: int, star_rounds: int) -> DataFrame:
    """(_row, doc_id, n_shingles, component_id, kept) of rows with a number ``_row``, for ids of any type and null ids."""
    scratch = C.Scratch(rows.sparkSession, "rows")
    got = _linked(rows.select(F.col("_row").alias("doc_id"), "text"), percent, star_rounds)
    got = scratch.save(got.select(F.col("doc_id").alias("_row"), "n_shingles", F.col("component_id").alias("_comp")).join(rows.select("_row", "doc_id"), "_row"))
    # counted before the join, so a component of very many rows is one row here
    least = got.groupBy("_comp").agg(F.min("doc_id").alias("component_id"))
    out = C.salted_join(got, least, ["_comp"], "_row")
    kept = F.when(F.col("component_id").isNull(), F.col("_row") == F.col("_comp")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.select("_row", "doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _with_rows(docs: DataFrame) -> DataFrame:
    return C.Scratch(docs.sparkSession, "numbers").save(docs.withColumn("_row", F.monotonically_increasing_id()))


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    if _numbered(docs):
        return _linked(docs, percent, star_rounds)
    return _by_row(_with_rows(docs.select("doc_id", "text")), percent, star_rounds).drop("_row")


def keep_one(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns."""
    scratch = C.Scratch(docs.sparkSession, "copies")
    if _numbered(docs):
        gone = scratch.save(_linked(docs, percent, STAR_ROUNDS).where("not kept").select("doc_id"))
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    rows = _with_rows(docs)
    gone = scratch.save(_by_row(rows, percent, STAR_ROUNDS).where("not kept").select("_row"))
    return rows.join(gone, "_row", "left_anti").select(docs.columns)


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {SIMILARITY} * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "documents"))
