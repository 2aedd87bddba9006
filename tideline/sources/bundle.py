"""Context bundles: a manifest in YAML and the CSV tables it names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = ["real", "derived", "estimated"]
#: Edge tables may name their ends either way; they are read under the first.
ENDS = {"source_id": "src_entity_id", "target_id": "dst_entity_id"}


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file


def manifest(spark: SparkSession, path: str) -> dict:
    import yaml

    return yaml.safe_load(_text(spark, f"{path}/manifest.yaml"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV as strings; lines without any value go, ends of edges get one name."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    for a, b in ENDS.items():
        if a in df.columns:
            df = df.withColumnRenamed(a, b)
    return df.dropna("all")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables by name, each also as the view ``ctx_<name>``. The manifest has {tables: {name: file}}."""
    out = {}
    for name, file in manifest(spark, path)["tables"].items():
        out[name] = read_table(spark, f"{path}/{file}")
        out[name].createOrReplaceTempView(f"ctx_{name}")
    return out


def params(df: DataFrame) -> DataFrame:
    """(key, value): the key is the parameter, with its country behind a bar where there is one; ALL stands for any."""
    country = F.trim(F.coalesce("country", F.lit(""))) if "country" in df.columns else F.lit("")
    key = F.when((country != "") & (country != "ALL"), F.concat_ws("|", "param", country)).otherwise(F.col("param"))
    return df.select(key.alias("key"), F.expr("try_cast(value as double)").alias("value"), F.monotonically_increasing_id().alias("_n")).groupBy("key").agg(F.max_by("value", "_n").alias("value"))


def problems(tables: dict[str, DataFrame], sources: DataFrame) -> DataFrame:
    """(table, id, problem) of rows whose tier or source is not a known one."""
    parts = []
    known = sources.select(F.col("source").alias("_s")).distinct()
    for name, df in tables.items():
        if "tier" not in df.columns:
            continue
        key = F.col(df.columns[0])
        parts.append(df.where(~F.coalesce(F.col("tier"), F.lit("")).isin(TIERS)).select(F.lit(name).alias("table"), key.alias("id"), F.lit("tier").alias("problem")))
        parts.append(df.join(known, df["source"] == F.col("_s"), "left_anti").select(F.lit(name).alias("table"), key.alias("id"), F.lit("source").alias("problem")))
    return reduce(DataFrame.unionByName, parts)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Markdown pages: the file's name is the entity, front matter and links apart from the body."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("entity_id"), "value")
    front = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("value", r"(?s)^---\n.*?\n---\n", "")
    return raw.select("entity_id", F.regexp_extract(front, r"(?m)^title:\s*(.+)$", 1).alias("title"), F.regexp_extract(front, r"(?m)^updated:\s*(.+)$", 1).alias("updated"), body.alias("body"), F.array_distinct(F.regexp_extract_all(body, F.lit(r"\[\[([^\]|]+)"), F.lit(1))).alias("links_out"))


def matrix(df: DataFrame, key: str) -> DataFrame:
    """A wide square table as (row, column, value)."""
    cols = [c for c in df.columns if c != key]
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([key], cols, "column", "value").withColumnRenamed(key, "row")


def settings(spark: SparkSession, *paths: str) -> DataFrame:
    """(key, value) of files of KEY=value lines; of a key in several files the first file's counts, within a file the last line's.

    Blank lines, comments and lines without "=" are skipped; a leading ``export`` and quotes around values go.
    """
    parts = []
    for i, path in enumerate(paths):
        line = F.trim("value")
        key = F.trim(F.regexp_replace(F.split_part(line, F.lit("="), F.lit(1)), r"^export ", ""))
        value = F.trim(F.trim(F.trim(F.regexp_replace(line, r"^[^=]*=", "")), F.lit('"')), F.lit("'"))
        rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).where((line != "") & ~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("=")))
        parts.append(rows.select(key.alias("key"), value.alias("value"), F.struct(F.lit(-i), "n").alias("at")))
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max_by("value", "at").alias("value"))
