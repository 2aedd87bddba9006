"""Snapshots of keyed rows: differences and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys only in one of two lists, tagged add or remove."""
    add = new.join(old, key, "left_anti").select(*key, F.lit("add").alias("change"))
    return add.unionByName(old.join(new, key, "left_anti").select(*key, F.lit("remove").alias("change")))


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``new`` that are not in ``old`` or differ there in a column; deletions don't count."""
    o = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return new.join(o, F.col(key) == F.col("_k"), "left").where(F.col("_k").isNull() | differs).select(key, F.col("_k").isNull().alias("is_new"))


def attributes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every key once; a new value wins where it is not null."""
    rest = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, key, "full_outer").select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest])


def close_and_insert(history: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Bitemporal upsert: open rows of updated keys end where the update begins, updates are appended."""
    ends = updates.groupBy(key).agg(F.min("valid_at").alias("_end"))
    closed = history.join(ends, key, "left").withColumn("invalid_at", F.coalesce("invalid_at", "_end")).drop("_end")
    return closed.unionByName(updates.withColumn("invalid_at", F.lit(None).cast(dict(history.dtypes)["invalid_at"])))


def edge_attributes(edges: DataFrame, nodes: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Edges (src_id, dst_id, type, columns) with the values of ``updates`` (src, dst, type, seq, columns) that are not null or empty.

    An update's ends may be names or ids of ``nodes`` (id, name). They are looked up as keys first, so the
    edges are met by an equal join; of several updates of an edge the last by ``seq`` counts, column by column. Edges are not made.
    """
    keys = nodes.select(F.col("id").alias("key"), "id").unionByName(nodes.select(F.col("name").alias("key"), "id")).where("key is not null").distinct()
    at = lambda end: keys.select(F.col("key").alias(end), F.col("id").alias(f"{end}_id"))
    found = updates.join(at("src"), "src").join(at("dst"), "dst")
    given = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    last = found.groupBy("src_id", "dst_id", "type").agg(*[F.max_by(F.when(given(c), F.col(c)), F.when(given(c), F.col("seq"))).alias(f"_{c}") for c in columns])
    out = edges.join(last, ["src_id", "dst_id", "type"], "left")
    return out.select("src_id", "dst_id", "type", *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def stamped(nodes: DataFrame, sources: DataFrame, methods: DataFrame) -> DataFrame:
    """Nodes (name, source, tier, as_of, notes) with where their facts come from: key, label and url.

    ``sources`` and ``methods`` are (key, label, url), a row a key; sources come first. A key in neither is its own
    label, a null label is the key, and an empty one of a method says that it is an estimate. Nodes without a name get no stamp.
    """
    s = sources.select(F.col("key").alias("_key"), F.struct(F.coalesce("label", "key").alias("label"), F.coalesce("url", F.lit("")).alias("url")).alias("_s"))
    named = F.coalesce(F.nullif(F.coalesce("label", "key"), F.lit("")), F.concat(F.lit("estimation method: "), "key"))
    m = methods.select(F.col("key").alias("_key"), F.struct(named.alias("label"), F.coalesce("url", F.lit("")).alias("url")).alias("_m"))
    trimmed = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    d = nodes.where(trimmed("name") != "").select(trimmed("name").alias("name"), trimmed("source").alias("_key"), trimmed("tier").alias("prov_tier"), F.coalesce(F.col("as_of").cast("string"), F.lit("")).alias("prov_as_of"), trimmed("notes").alias("prov_notes"))
    d = d.join(s, "_key", "left").join(m, "_key", "left")
    none = F.struct(F.col("_key").alias("label"), F.lit("").alias("url"))
    return d.withColumn("_p", F.coalesce("_s", "_m", none)).select("name", F.col("_key").alias("prov_source_key"), F.col("_p.label").alias("prov_source_label"), F.col("_p.url").alias("prov_source_url"), "prov_tier", "prov_as_of", "prov_notes")
