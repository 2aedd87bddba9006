"""Readers of feeds: lists in XML and CSV, ticks and ledgers in JSON, a polled source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_ENTRY = "struct<uid: bigint, firstName: string, lastName: string, sdnType: string, program: string, remarks: string>"
_KIND = {"Vessel": "vessel", "Individual": "person", "Entity": "entity"}


def _entries(df: DataFrame) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("sdnType") == k, F.lit(v)) for k, v in _KIND.items()], F.lit("entity"))
    number = lambda label, n: F.nullif(F.regexp_extract(F.coalesce("remarks", F.lit("")), rf"{label}\s*:?\s*([0-9]{{{n}}})", 1), F.lit(""))
    return df.select("uid", F.concat_ws(" ", "firstName", "lastName").alias("name"), kind.alias("kind"), number("MMSI", 9).alias("mmsi"), number("IMO", 7).alias("imo"), "program")


def parse_sanctions(xml: DataFrame) -> DataFrame:
    """Entries of a list held as text in the column ``xml``."""
    got = xml.select(F.from_xml("xml", f"struct<sdnEntry: array<{_ENTRY}>>").alias("x"))
    return _entries(got.select(F.inline("x.sdnEntry")))


def read_sanctions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A list file: ``xml`` with sdnEntry rows, ``un`` with INDIVIDUAL and ENTITY rows, or ``csv``."""
    if kind == "xml":
        return _entries(spark.read.format("xml").option("rowTag", "sdnEntry").schema(T.StructType.fromDDL("uid bigint, firstName string, lastName string, sdnType string, program string, remarks string")).load(path))
    if kind == "un":
        schema = T.StructType.fromDDL("DATAID bigint, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, UN_LIST_TYPE string")
        read = lambda tag, name: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select(F.col("DATAID").alias("uid"), F.concat_ws(" ", "FIRST_NAME", "SECOND_NAME", "THIRD_NAME").alias("name"), F.lit(name).alias("kind"), F.col("UN_LIST_TYPE").alias("program"))
        return read("INDIVIDUAL", "person").unionByName(read("ENTITY", "entity"))
    if kind == "csv":
        return _csv_entries(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"'))
    raise ValueError(f"no reader for {kind}")


def _csv_entries(df: DataFrame) -> DataFrame:
    """Entries of a list with the columns id, schema, name, aliases, countries, addresses, identifiers, sanctions, program_ids; rows without a name go."""
    schema, text = F.lower(F.trim("schema")), lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda label, n: F.nullif(F.regexp_extract(text("identifiers"), rf"{label}\s*(\d{{{n}}})", 1), F.lit(""))
    remarks = F.array_join(F.filter(F.array(*[text(c) for c in ("aliases", "countries", "addresses", "sanctions")]), lambda x: x != ""), " ")
    rows = df.withColumn("name", F.trim(text("name"))).where("name <> ''")
    return rows.select(text("id").alias("uid"), "name", F.when(schema.isin("person", "vessel"), schema).otherwise("entity").alias("kind"), number("MMSI", 9).alias("mmsi"), number("IMO", 7).alias("imo"), text("program_ids").alias("program"), remarks.alias("remarks"))


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Labelled ticks from JSON arrays, features as columns."""
    return spark.read.json(path, multiLine=True).select("date", "crisis_name", "within_24h_of_crossing", "features.*")


LEDGER = "scenario_id string, entity string, predicted struct<gap_mbpd: double, price_impact_high: double, spr_depletion_days: double, gdp_proxy_impact_pct: double>, realized struct<gap_mbpd: double, price_impact_high: double, spr_depletion_days: double, gdp_proxy_impact_pct: double>, source string, predicted_at string, realized_at string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones become rows of nulls that are dropped."""
    return spark.read.schema(LEDGER).json(path).where("scenario_id is not null")


def read_gdelt(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Tab-separated event files by position: actors, goldstein scale, tone, url."""
    cols = ", ".join(f"_c{i} string" for i in range(58))
    reader = spark.readStream if stream else spark.read
    raw = reader.schema(cols).option("sep", "\t").csv(path)
    return raw.select(F.col("_c0").alias("id"), F.col("_c6").alias("actor1"), F.col("_c16").alias("actor2"), F.expr("try_cast(_c30 as double)").alias("goldstein"), F.expr("try_cast(_c34 as double)").alias("tone"), F.col("_c57").alias("url"))


class PolledSource(DataSource):
    """A source that asks a provider for pages: option ``provider`` names "module:function", ``keywords`` the queries.

    Each keyword is a partition, so keywords are asked in parallel; the function returns
    (id, title, body, published) tuples and must come from a module the executors have.
    """

    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> str:
        return "keyword string, id string, title string, body string, published timestamp"

    def reader(self, schema):
        return _PolledReader(self.options)


class _PolledReader(DataSourceReader):
    def __init__(self, options):
        self.provider, self.keywords = options["provider"], [k for k in options.get("keywords", "").split(",") if k]

    def partitions(self):
        return [InputPartition(k) for k in self.keywords]

    def read(self, partition):
        import importlib

        module, _, function = self.provider.partition(":")
        for row in getattr(importlib.import_module(module), function)(partition.value):
            yield (partition.value, *row)


class PolledStream(DataSource):
    """The polled source as a stream: an offset is the number of polls that are over.

    Poll p asks for ASKED keywords, from keyword ASKED * p on, round and round; each one is a partition. The option
    ``polls`` says how many are due; without it, one is due every ``interval`` seconds since ``since``. A poll is asked again, by
    the same number, if its batch is lost. The provider, "module:function", is called with keyword, poll and the
    options and yields (id, title, body, published) tuples; what it has shown before it may show again.
    """

    ASKED = 3

    @classmethod
    def name(cls) -> str:
        return "polled_stream"

    def schema(self) -> str:
        return "poll int, keyword string, id string, title string, body string, published timestamp"

    def streamReader(self, schema):
        return _PolledStreamReader(dict(self.options))


class _PolledStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.keywords = [k for k in options.get("keywords", "").split(",") if k]

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def latestOffset(self) -> dict:
        import time

        due = self.options.get("polls")
        return {"polls": int(due) if due is not None else max(0, int((time.time() - float(self.options["since"])) // float(self.options["interval"])))}

    def partitions(self, start: dict, end: dict):
        n = len(self.keywords)
        asked = min(n, PolledStream.ASKED)
        return [InputPartition((p, self.keywords[(asked * p + i) % n])) for p in range(start["polls"], end["polls"]) for i in range(asked)] or [InputPartition(None)]

    def read(self, partition):
        import importlib

        if partition.value is None:
            return
        poll, keyword = partition.value
        module, _, function = self.options["provider"].partition(":")
        for row in getattr(importlib.import_module(module), function)(keyword, poll, self.options):
            yield (poll, keyword, *row)

    def commit(self, end: dict) -> None:
        pass


#: Rows of a stored table that are held at once.
PAGE_ROWS = 256


def stored_pages(keyword: str, poll: int, options: dict):
    """A provider over a table of items (keyword, shown, id, title, body, published) under the option ``path``, in any file system: what is shown by that poll.

    One file is read at a time, PAGE_ROWS rows at a time and without reading ahead, so memory does not depend on the size of the files.
    The table may be in folders by keyword; then the others are not read.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(options["path"])
    items = ds.dataset(path, filesystem=store, format="parquet", partitioning=ds.partitioning(pa.schema([("keyword", pa.string())]), flavor="hive"))
    for file in items.get_fragments(filter=ds.field("keyword") == keyword):
        with store.open_input_file(file.path) as src:
            f = pq.ParquetFile(src, pre_buffer=False, buffer_size=1 << 20)
            held = "keyword" in f.schema_arrow.names
            for b in f.iter_batches(PAGE_ROWS, columns=["id", "title", "body", "published", "shown", *(["keyword"] if held else [])], use_threads=False):
                due = pc.less_equal(b["shown"], poll)
                b = b.filter(pc.and_(due, pc.equal(b["keyword"], keyword)) if held else due)
                yield from zip(*(b[c].to_pylist() for c in ("id", "title", "body")), b["published"].cast(pa.timestamp("us", "UTC"), safe=False).to_pylist())


def sample_pages(keyword: str) -> list[tuple]:
    """A provider that needs no network: three pages for each keyword."""
    import datetime

    return [(f"{keyword}-{i}", f"Title of {keyword}", f"Body {i}", datetime.datetime(2024, 1, 1 + i)) for i in range(3)]
