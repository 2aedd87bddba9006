"""Greedy rules over a key's ordered rows as parallel scans.

A rule remembers a label and the time it last fired. It can't be said as a window, since whether a row
fires depends on which rows before it did. But what a stretch of rows does to the memory is a map: for each
entry label, and for the entry time between a few bounds, it leaves a certain label and time. So

1. the rows of a key are cut into chunks of its order, and each chunk's map is made in a task of its own,
2. the maps are composed, FAN at a time, until one is left a key, and on the way back every chunk gets the
   memory it starts with,
3. the chunks are replayed from that memory.

No task holds more than a chunk of rows or FAN maps. A map is short: only rows within the rule's waiting
time of its first row can tell entry times apart.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fusion import numbered
from .signals import CHUNK

#: Maps that are composed in one task.
FAN = 4096

#: By entry label: (latest entry time or None for any, label after, time after or None for the entry time).
Map = dict[int, list[tuple[int | None, int, int | None]]]


class Rule:
    """``wait`` microseconds lie between two firings; ``labels`` are all that the memory may hold, the first one at the start."""

    labels: tuple[int, ...] = (0,)

    def __init__(self, wait_s: float):
        self.wait = round(wait_s * 1e6)

    def label(self, value: int) -> int:
        """What is remembered of a row that fired."""
        return 0

    def next(self, times: list[int], values: list[int], i: int, label: int, at: int | None) -> tuple[int | None, int]:
        """The first row from ``i`` on that fires, and the label held until then; None if none does."""
        j = i if at is None else bisect.bisect_left(times, at + self.wait, i)
        return (j if j < len(times) else None), label


class Cooldown(Rule):
    """Every row fires that comes ``wait`` or more after the last one that did."""


class Crossing(Rule):
    """A row fires whose value is ``high`` or more and above the remembered one; a value below ``low`` forgets it."""

    def __init__(self, wait_s: float, high: int = 3, low: int = 2, top: int = 4):
        super().__init__(wait_s)
        self.high, self.low, self.labels = high, low, (0, *range(high, top + 1))

    def label(self, value: int) -> int:
        return value

    def next(self, times, values, i, label, at):
        for j in range(i, len(times)):
            v = values[j]
            if v >= self.high:
                if v > label and (at is None or times[j] - at >= self.wait):
                    return j, label
            elif v < self.low:
                label = 0
        return None, label


def fired(rule: Rule, times: list[int], values: list[int], label: int, at: int | None) -> tuple[list[int], int, int | None]:
    """The rows that fire from this memory on, and the memory after the last row."""
    out, i = [], 0
    while True:
        j, label = rule.next(times, values, i, label, at)
        if j is None:
            return out, label, at
        out.append(j)
        label, at, i = rule.label(values[j]), times[j], j + 1


def summary(rule: Rule, times: list[int], values: list[int]) -> Map:
    """What the rows do to any memory that is not younger than the first of them."""
    known: dict[int, tuple[int, int]] = {}

    def after(j: int) -> tuple[int, int]:
        path = []
        while j not in known:
            path.append(j)
            k, label = rule.next(times, values, j + 1, rule.label(values[j]), times[j])
            if k is None:
                known[j] = (label, times[j])
            else:
                j = k
        return known.setdefault(path[0], known[j]) if path else known[j]

    out: Map = {}
    for start in rule.labels:
        pieces, i, label = out.setdefault(start, []), 0, start
        while True:
            j, label = rule.next(times, values, i, label, None)
            if j is None:
                pieces.append((None, label, None))
                break
            bound = times[j] - rule.wait
            if not pieces or bound > pieces[-1][0]:
                pieces.append((bound, *after(j)))
            if bound >= times[0]:
                break
            i = j + 1
    return out


def applied(m: Map, label: int, at: int | None) -> tuple[int, int | None]:
    for bound, to, then in m[label]:
        if bound is None or at is None or at <= bound:
            return to, (at if then is None else then)
    raise ValueError("the memory is younger than the rows")


def composed(first: Map, second: Map) -> Map:
    """The map of two stretches, one after the other."""
    out: Map = {}
    for label, pieces in first.items():
        low: int | None = None
        parts: list[tuple[int | None, int, int | None]] = []
        for bound, to, then in pieces:
            if then is not None:
                parts.append((bound, *applied(second, to, then)))
            else:
                for b, t, a in second[to]:
                    if b is not None and low is not None and b <= low:
                        continue
                    last = b is None or (bound is not None and b >= bound)
                    parts.append((bound if last else b, t, a))
                    if last:
                        break
            low = bound
        kept: list[tuple[int | None, int, int | None]] = []
        for p in parts:
            if kept and kept[-1][1:] == p[1:]:
                kept[-1] = p
            else:
                kept.append(p)
        out[label] = kept
    return out


# ---- on DataFrames ----------------------------------------------------------------------

_MAP = "label int, bound long, to int, then long"
_PLACES = [("label", pa.int32()), ("bound", pa.int64()), ("to", pa.int32()), ("then", pa.int64())]


def _table(key: tuple, key_types: list[tuple[str, pa.DataType]], columns: list[tuple[str, pa.DataType, list]]) -> pa.Table:
    n = len(columns[0][2])
    keys = [(name, pa.array([k.as_py()] * n, kind)) for (name, kind), k in zip(key_types, key)]
    return pa.table([a for _, a in keys] + [pa.array(v, kind) for _, kind, v in columns], names=[x for x, _ in keys] + [x for x, _, _ in columns])


def _rows_of(m: Map) -> list[tuple[str, pa.DataType, list]]:
    flat = [(label, *p) for label, pieces in m.items() for p in pieces]
    return [(name, kind, [r[i] for r in flat]) for i, (name, kind) in enumerate(_PLACES)]


def _maps_of(table: pa.Table) -> list[tuple[int, Map]]:
    """(chunk, map) by chunk."""
    out: dict[int, Map] = {}
    rows = table.select(["chunk", "label", "bound", "to", "then"]).to_pylist()
    for r in sorted(rows, key=lambda r: (r["chunk"], r["label"], r["bound"] is None, r["bound"] or 0)):
        out.setdefault(r["chunk"], {}).setdefault(r["label"], []).append((r["bound"], r["to"], r["then"]))
    return sorted(out.items())


def entries(maps: DataFrame, key: str, rule: Rule, fan: int = FAN) -> DataFrame:
    """(key, chunk, label, at): the memory each chunk starts with, from (key, chunk, label, bound, to, then)."""
    kind = maps.schema[key].dataType.simpleString()
    top = maps.agg(F.max("chunk")).first()[0] or 0
    upper = None
    grouped = maps.withColumn("part", F.floor(F.col("chunk") / fan).cast("long"))
    if top >= fan:

        def join(k: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            (_, m), *rest = _maps_of(table)
            for _, other in rest:
                m = composed(m, other)
            return _table(k, [(key, table.schema.field(key).type), ("chunk", pa.int64())], _rows_of(m))

        upper = entries(grouped.groupBy(key, "part").applyInArrow(join, f"{key} {kind}, chunk long, {_MAP}"), key, rule, fan)
        start = upper.select(key, F.col("chunk").alias("part"), F.col("label").alias("from_label"), F.col("at").alias("from_at"))
        grouped = grouped.join(start, [key, "part"])
    else:
        grouped = grouped.withColumn("from_label", F.lit(rule.labels[0])).withColumn("from_at", F.lit(None).cast("long"))

    def walk(k: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        label, at = table.column("from_label")[0].as_py(), table.column("from_at")[0].as_py()
        out = []
        for chunk, m in _maps_of(table):
            out.append((chunk, label, at))
            label, at = applied(m, label, at)
        return _table(k[:1], [(key, table.schema.field(key).type)], [("chunk", pa.int64(), [x[0] for x in out]), ("label", pa.int32(), [x[1] for x in out]), ("at", pa.int64(), [x[2] for x in out])])

    return grouped.groupBy(key, "part").applyInArrow(walk, f"{key} {kind}, chunk long, label int, at long")


def fold(rows: DataFrame, key: str, ts: str, tie: str, value: str, rule: Rule, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(key, n, tie, value, fired) of every row: its place in the key's order from 1, and whether the rule fires on it."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, tie)}
    d = numbered(rows.select(key, ts, tie, F.col(value).cast("int").alias("value")), key, ts, tie)
    d = d.select(key, F.floor((F.col("rn") - 1) / size).cast("long").alias("chunk"), F.col("rn").cast("long").alias("n"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), tie, "value")

    def ordered(table: pa.Table) -> tuple[pa.Table, list[int], list[int]]:
        table = table.sort_by("n")
        return table, table.column("t").to_pylist(), table.column("value").to_pylist()

    def summarise(k: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table, times, values = ordered(table)
        return _table(k, [(key, table.schema.field(key).type), ("chunk", pa.int64())], _rows_of(summary(rule, times, values)))

    def replay(k: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table, times, values = ordered(table)
        hits = set(fired(rule, times, values, table.column("from_label")[0].as_py(), table.column("from_at")[0].as_py())[0])
        return table.select([key, "n", tie, "value"]).append_column("fired", pa.array([i in hits for i in range(len(times))], pa.bool_()))

    maps = d.groupBy(key, "chunk").applyInArrow(summarise, f"{key} {kinds[key]}, chunk long, {_MAP}")
    start = entries(maps, key, rule, fan).select(key, "chunk", F.col("label").alias("from_label"), F.col("at").alias("from_at"))
    return d.join(start, [key, "chunk"]).groupBy(key, "chunk").applyInArrow(replay, f"{key} {kinds[key]}, n long, {tie} {kinds[tie]}, value int, fired boolean")
