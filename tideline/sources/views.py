"""Adapters: the star schema and event tables as signals, flows, prices and ledgers.

Each adapter has a DataFrame form and, under the same name in ``CTE``, its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITIES = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SIGNAL = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("schema_version", "signal_id", "source", "priority_hint", "summary")]
    + [T.StructField("observed_at", T.TimestampType(), False), T.StructField("ingested_at", T.TimestampType(), False), T.StructField("force_synthesis", T.BooleanType(), False)]
    + [T.StructField("entity_refs", T.ArrayType(T.StringType()), False), T.StructField("h3_cells", T.ArrayType(T.StringType()), False), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]
    + [T.StructField("payload", T.MapType(T.StringType(), T.StringType()), False), T.StructField("source_url", T.StringType()), T.StructField("raw_ref", T.StringType())]
)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal for each event: source, entity and the payload fields the features read."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    source = F.when(F.col("event_type") == "view", "ais").when(F.col("event_type") == "click", "news").when(F.col("event_type") == "signup", "gdelt").when(F.col("event_type") == "purchase", "price").otherwise("sanctions")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value", k.alias("k"), (F.col("user_id") % ENTITIES).cast("int").alias("entity"), source.alias("source"),
        (F.col("value") / 20).alias("gap_hours"), F.least(F.lit(1.0), F.col("value") / 200).alias("anomaly"), (F.col("value") / 20 >= 4).alias("dark"), (k % 4 == 0).alias("monitored"), (k / 20).alias("vstd"),
        ((k - 50) / 5).alias("tone"), ((k - 50) / 10).alias("tone_delta"), (k / 100).alias("severity"),
        ((k - 50) / 5).alias("pct"), (k >= 90).alias("changepoint"), (k >= 70).alias("stressed"), (k / 100).alias("premium"),
        (k % 2 == 0).alias("added"), (k % 3 == 0).alias("is_vessel"), (k % 5 == 0).alias("is_state"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade volume (src, dst, volume) from the suppliers' nation to the customers' nation."""
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    by_pair = li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return by_pair.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("volume"))


def strong_edges(spark: SparkSession, sf_dir: str, share: float = 0.05) -> DataFrame:
    """Dependency edges (src, dst, share): flows that are at least ``share`` of what the destination gets."""
    f = flows(spark, sf_dir)
    total = f.groupBy(F.col("dst").alias("d")).agg(F.sum("volume").alias("total"))
    return f.join(total, F.col("dst") == F.col("d")).where(F.col("src") != F.col("dst")).select("src", "dst", F.round(F.col("volume") / F.col("total"), 9).alias("share")).where(F.col("share") >= share)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices (instrument, event_id, ts, price) of purchase events."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select((F.col("user_id") % 5).cast("int").alias("instrument"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))


CTE = {
    "sig": """sig AS (
  SELECT event_id, ts, user_id, value, k, CAST(user_id % 25 AS INTEGER) AS entity,
         CASE event_type WHEN 'view' THEN 'ais' WHEN 'click' THEN 'news' WHEN 'signup' THEN 'gdelt' WHEN 'purchase' THEN 'price' ELSE 'sanctions' END AS source,
         value / 20 AS gap_hours, least(1.0::DOUBLE, value / 200) AS anomaly, value / 20 >= 4 AS dark, k % 4 = 0 AS monitored, k / 20 AS vstd,
         (k - 50) / 5 AS tone, (k - 50) / 10 AS tone_delta, k / 100 AS severity, (k - 50) / 5 AS pct, k >= 90 AS changepoint, k >= 70 AS stressed, k / 100 AS premium,
         k % 2 = 0 AS added, k % 3 = 0 AS is_vessel, k % 5 = 0 AS is_state
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    "flow": """flow AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_quantity) AS volume
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)""",
    "edge": """edge AS (
  SELECT src, dst, share FROM (SELECT src, dst, round(volume / sum(volume) OVER (PARTITION BY dst), 9) AS share FROM flow) WHERE src <> dst AND share >= 0.05)""",
    "tick": """tick AS (SELECT CAST(user_id % 5 AS INTEGER) AS instrument, event_id, ts, value AS price FROM events WHERE event_type = 'purchase')""",
}


def with_(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(CTE[n] for n in names)
