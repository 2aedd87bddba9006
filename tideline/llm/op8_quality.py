"""Quality rules with cross-document line frequency, in DataFrame functions alone.

Per document: word and symbol counts, repeated lines and words in repeated 3-word windows.
Across documents: lines are normalised (lower case, white space collapsed) and hashed, and
for every host (``source``) the distinct documents that hold a line are counted. Documents with
the same normalised lines in the same order are one document. A line is over the limits if more
than MAX_DOCS_PER_HOST distinct documents of the host hold it, and these are more than
MAX_HOST_PERCENT of the host's distinct documents: what many pages of a large host happen to
share, among them a group of near copies, is no boilerplate of the host. Lines over the limits
are removed (``clean`` returns the texts without them); a document of which less than
MIN_LEFT_PERCENT of the words is left is rejected as depleted.

Counting is aggregations with map-side combining; the removal joins on (host, line, salt) so
that neither a hot host nor a hot line meets in one task.

Null and empty texts have no words and fail the base rules. A null host is a host of its own
and a null id an id of its own. Repeated rows are judged alike. Columns of the input other than
``doc_id``, ``text`` and ``source`` are not read here. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCS_PER_HOST = 5
MAX_HOST_PERCENT = 10
MIN_LEFT_PERCENT = 30
SALTS = 32
SYMBOLS = "#*$%&|<>"
MEASURES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, C.SPACE, " ")))


def _id(column: str = "doc_id") -> Column:
    """Never null, and another value for a null id than for any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, host, base measures, content, lines array<struct<key, words>>) of every row.

    ``lines`` are the normalised lines that have a word, ``content`` stands for all of them in order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = text
    for ch in SYMBOLS:
        bare = F.replace(bare, F.lit(ch), F.lit(""))
    solid = text
    for ch in " \t\n\x0b\x0c\r":
        solid = F.replace(solid, F.lit(ch), F.lit(""))
    a = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), text.alias("text"))
    a = a.select("doc_id", "host", F.filter(F.split("text", C.SPACE), lambda w: w != "").alias("w"), F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("raw_lines"), F.length(solid).cast("long").alias("word_chars"), (F.length("text") - F.length(bare)).cast("long").alias("n_symbols"))
    size = F.size("w")
    a = a.select(
        "doc_id", "host", "word_chars", "n_symbols", size.cast("long").alias("n_words"), "raw_lines",
        (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("sort_array(if(size(w) >= 3, transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i)), cast(array() as array<struct<h: bigint, i: int>>)))").alias("tri"),
    )
    a = a.select("doc_id", "host", "word_chars", "n_symbols", "n_words", "n_dup_lines", "raw_lines", F.expr("sort_array(transform(filter(tri, (x, j) -> x.h = get(tri, j - 1).h or x.h = get(tri, j + 1).h), x -> x.i))").alias("twice"))
    a = a.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr("aggregate(twice, struct(0L as n, -3 as at), (s, i) -> struct(s.n + least(3, i - s.at) as n, i as at)).n").alias("n_repeat_words"),
        F.transform("raw_lines", _normal).alias("norm"),
    )
    one = F.transform("norm", lambda x: F.struct(F.md5(x).alias("key"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("words")))
    return a.withColumn("content", F.md5(F.array_join("norm", "\n"))).withColumn("lines", one).drop("norm")


def _over_limits(m: DataFrame, max_docs: int, max_percent: int) -> DataFrame:
    """(id, host, key, words) of the lines of ``measures`` that are over the limits, once for each id, host and line."""
    lines = m.select(_id().alias("id"), "host", "content", F.explode("lines").alias("l")).select("id", "host", "content", "l.key", "l.words")
    docs = lines.select("host", "key", "content").distinct().groupBy("host", "key").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs)
    hosts = m.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("all"))
    over = docs.join(hosts, "host").where(F.col("docs") * 100 > F.col("all") * max_percent)
    over = over.select("host", "key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mine = lines.groupBy("id", "host", "key").agg(F.sum("words").alias("words")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return mine.join(over, ["host", "key", "salt"]).select("id", "host", "key", "words")


def _verdict(m: DataFrame, lines: DataFrame, min_left: int) -> DataFrame:
    removed = lines.groupBy("id").agg(F.sum("words").alias("gone"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # removals are per id; rows that repeat an id have summed words, so the share is taken of the id's sum
    total = m.groupBy(_id().alias("id")).agg(F.sum("n_words").alias("all_words"))
    share = total.join(removed, "id").select("id", "gone", ((F.col("all_words") - F.col("gone")) * 100 < min_left * F.col("all_words")).alias("depleted"))
    out = m.drop("lines", "host", "content").withColumn("id", _id()).join(share, "id", "left")
    out = out.withColumn("n_boilerplate_words", F.coalesce("gone", F.lit(0)).cast("long")).withColumn("base_failed", base).withColumn("kept", ~base & ~F.coalesce("depleted", F.lit(False)))
    return out.select(*MEASURES, "n_boilerplate_words", "base_failed", "kept")


def judge(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, min_left: int = MIN_LEFT_PERCENT, max_percent: int = MAX_HOST_PERCENT) -> DataFrame:
    """(doc_id, measures, n_boilerplate_words, base_failed, kept) of every row; n_boilerplate_words is of all rows of the id."""
    m = C.Scratch(docs.sparkSession, "quality").save(measures(docs))
    return _verdict(m, _over_limits(m, max_docs, max_percent), min_left)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    rejected = C.Scratch(docs.sparkSession, "rejected").save(judge(docs).where("not kept").select(_id().alias("_id")))
    return docs.join(rejected, _id() == F.col("_id"), "left_anti").select(docs.columns)


def clean(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, min_left: int = MIN_LEFT_PERCENT, max_percent: int = MAX_HOST_PERCENT) -> DataFrame:
    """The rows of ``docs`` that pass, with the lines over the limits cut out of ``text``; other columns as they are."""
    scratch = C.Scratch(docs.sparkSession, "quality")
    m = scratch.save(measures(docs))
    lines = scratch.save(_over_limits(m, max_docs, max_percent))
    rejected = scratch.save(_verdict(m, lines, min_left).where("not kept").select(_id().alias("_id")))
    scratch.drop(m)
    cut = lines.groupBy(F.col("id").alias("_id"), F.col("host").alias("_host")).agg(F.collect_set("key").alias("_keys"))
    rows = docs.join(rejected, _id() == F.col("_id"), "left_anti").join(cut, (_id() == F.col("_id")) & (F.coalesce("source", F.lit("")) == F.col("_host")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_keys", F.md5(_normal(x)))), "\n")
    return rows.withColumn("text", F.when(F.col("_keys").isNull(), F.col("text")).otherwise(left)).select(docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.read(spark, sf_dir, "documents"))


SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
tri AS (
  SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
pages AS (
  SELECT doc_id, host, list_transform(l, lambda x: lower(trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g')))) AS page FROM w),
held AS (SELECT doc_id, host, page, unnest(page) AS line FROM pages),
common AS (
  SELECT host, line FROM held GROUP BY 1, 2
  HAVING count(DISTINCT page) > {MAX_DOCS_PER_HOST}
     AND count(DISTINCT page) * 100 > {MAX_HOST_PERCENT} * (SELECT count(DISTINCT p.page) FROM pages p WHERE p.host = held.host)),
gone AS (SELECT doc_id, sum(length(line) - length(replace(line, ' ', '')) + 1) AS gone FROM held JOIN common USING (host, line) GROUP BY 1),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.gone, 0) AS BIGINT) AS gone
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, gone AS n_boilerplate_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND NOT ((n_words - gone) * 100 < {MIN_LEFT_PERCENT} * n_words) AS kept
FROM m
"""
