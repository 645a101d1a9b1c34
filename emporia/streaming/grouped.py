"""Per-key processors run for many keys at once.

A call of ``transformWithState`` per key costs several round trips between the
Python runner and the JVM, about a millisecond whatever the key has to do. Here
the keys are dealt by hash into ``GROUPS`` groups and a group is the unit of
state: Spark hands its rows and its state over in Arrow batches
(``applyInPandasWithState``), the processor runs for each key on states held in
memory, and what the group keeps goes back as one value. State stays
partitioned by hash and grows with the keys only; a group's rows of one
micro-batch are in one task, as a key's are anyhow.

What a group keeps is one array per field: ``keys``; for every state variable
``<name>_at`` (positions of the keys that have it) and a column per field,
aligned; timers as ``timer_at`` and ``timer_ms``. Timestamps are kept and sent as
microseconds, integers never as floating point. A processor that takes all keys
of a group at once (``handleGroup``) has these arrays kept as one Arrow batch:
Spark hands other values over element by element, which costs more than the work.
"""

from __future__ import annotations

import datetime as dt
from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

GROUPS = 1_024     # fixed for the life of a checkpoint; more for key spaces of billions. A call costs some 20 ms whatever it holds

_EPOCH = dt.datetime(1970, 1, 1)
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampType, T.TimestampNTZType)


def _fields(ddl: str) -> list[T.StructField]:
    return list(T.StructType.fromDDL(ddl).fields)


class _Held:
    """State variables of one key while its processor runs."""

    def __init__(self):
        self.value, self.entries = None, {}

    # ValueState
    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = tuple(value)

    def clear(self):
        self.value, self.entries = None, {}

    # MapState
    def containsKey(self, key):
        return key in self.entries

    def getValue(self, key):
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.entries[tuple(key)] = tuple(value)

    def removeKey(self, key):
        self.entries.pop(key, None)


class _Handle:
    """What a processor's ``init`` asks for; the same variables serve one key
    after the other. ``parsed`` has the fields of the schemas, which only the
    driver can parse."""

    def __init__(self, parsed: dict[str, list[T.StructField]]):
        self.parsed, self.values, self.maps, self.timers, self.held = parsed, {}, {}, set(), {}

    def _fields(self, ddl: str) -> list[T.StructField]:
        if ddl not in self.parsed:
            self.parsed[ddl] = _fields(ddl)
        return self.parsed[ddl]

    def getValueState(self, name, schema):
        self.values[name] = self._fields(schema)
        return self.held.setdefault(name, _Held())

    def getMapState(self, name, key_schema, value_schema):
        self.maps[name] = (self._fields(key_schema), self._fields(value_schema))
        return self.held.setdefault(name, _Held())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def load(self, kept: dict) -> None:
        for name, h in self.held.items():
            value = kept.get(name)
            h.value, h.entries = (None, value or {}) if name in self.maps else (value, {})
        self.timers = kept.get(None, set())

    def save(self) -> dict:
        kept = {name: h.entries if name in self.maps else h.value for name, h in self.held.items()}
        return {n: v for n, v in [*kept.items(), (None, self.timers)] if v not in (None, {}, set())}


def _stored(kind: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(kind, _TIMES) else kind


def state_schema(h: _Handle, key: T.DataType) -> T.StructType:
    """The arrays that a group keeps for the processor that ``h`` has served."""
    out, array = [("keys", key)], lambda name, fields: [(f"{name}_{f.name}", _stored(f.dataType)) for f in fields]
    for name, fields in h.values.items():
        out += [(f"{name}_at", T.IntegerType()), *array(name, fields)]
    for name, (keys, values) in h.maps.items():
        out += [(f"{name}_at", T.IntegerType()), *array(name, keys + values)]
    out += [("timer_at", T.IntegerType()), ("timer_ms", T.LongType())]
    return T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in out])


def _micros(at: dt.datetime | None) -> int | None:
    return None if at is None else (at - _EPOCH) // dt.timedelta(microseconds=1)


def _time(micros: int | None) -> dt.datetime | None:
    return None if micros is None else _EPOCH + dt.timedelta(microseconds=micros)


def _columns(fields: list[T.StructField], rows: list[tuple], convert: Callable) -> list[list]:
    cols = [list(c) for c in zip(*rows)] if rows else [[] for _ in fields]
    return [[convert(x) for x in c] if isinstance(f.dataType, _TIMES) else c for f, c in zip(fields, cols)]


def _unpack(state: tuple, h: _Handle) -> dict:
    """{key: {variable: value}} of a group's arrays."""
    columns = iter(state)
    keys = next(columns)
    kept = {k: {} for k in keys}

    def rows(fields):
        cols = [[_time(x) for x in c] if isinstance(f.dataType, _TIMES) else c for f, c in zip(fields, columns)]
        return zip(*cols)

    for name, fields in h.values.items():
        for i, value in zip(next(columns), rows(fields)):
            kept[keys[i]][name] = value
    for name, (of, values) in h.maps.items():
        for i, entry in zip(next(columns), rows(of + values)):
            kept[keys[i]].setdefault(name, {})[entry[:len(of)]] = entry[len(of):]
    for i, ms in zip(next(columns), next(columns)):
        kept[keys[i]].setdefault(None, set()).add(ms)
    return kept


def _pack(kept: dict, h: _Handle) -> tuple:
    keys = list(kept)
    out = [keys]
    for name, fields in h.values.items():
        at = [i for i, k in enumerate(keys) if name in kept[k]]
        out += [at, *_columns(fields, [kept[keys[i]][name] for i in at], _micros)]
    for name, (of, values) in h.maps.items():
        rows = [(i, (*k, *v)) for i, key in enumerate(keys) for k, v in kept[key].get(name, {}).items()]
        out += [[i for i, _ in rows], *_columns(of + values, [r for _, r in rows], _micros)]
    timers = [(i, ms) for i, k in enumerate(keys) for ms in kept[k].get(None, ())]
    return (*out, [i for i, _ in timers], [ms for _, ms in timers])


def _to_batch(kept: list, schema: pa.Schema) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(kept, schema)], schema=schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _of_batch(data: bytes) -> list[list]:
    with pa.ipc.open_stream(data) as batches:
        return [c.values.to_pylist() for c in batches.read_next_batch().columns]


def _joined(kept: list, more: tuple, h: _Handle) -> list:
    """The arrays of two sets of keys as one: positions of keys move by the
    number of keys before them."""
    sizes = [len(f) for f in h.values.values()] + [len(k) + len(v) for k, v in h.maps.values()] + [1]
    positions = [False] + [first for n in sizes for first in [True] + [False] * n]
    return [[*a, *([x + len(kept[0]) for x in b] if at else b)] for a, b, at in zip(kept, more, positions)]


def _encoded(df: DataFrame, key: str, groups: int) -> tuple[DataFrame, list[T.StructField]]:
    """``df`` as it is sent: group, columns without nulls where pandas would turn
    numbers to floating point, and the nulls as bits."""
    sent, nulls, fields = [], [], []
    for f in df.schema.fields:
        if f.name == "event_time":      # of the watermark; no processor reads it
            continue
        col = F.col(f.name)
        if isinstance(f.dataType, _TIMES):
            number = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col.cast("timestamp_ntz"))
        elif isinstance(f.dataType, (*_INTEGERS, T.BooleanType)):
            number = col.cast("bigint")
        else:
            number = None
        if number is not None:
            nulls.append(F.when(col.isNull(), F.lit(1 << len(fields))).otherwise(F.lit(0)).cast("bigint"))
            col = F.coalesce(number, F.lit(0).cast("bigint")).alias(f.name)
        fields.append(f)
        sent.append(col)
    bits = sum(nulls[1:], nulls[0]) if nulls else F.lit(0).cast("bigint")
    group = F.pmod(F.xxhash64(F.col(key)), F.lit(groups)).cast("int").alias("_group")
    watermark = [F.col("event_time")] if "event_time" in df.columns else []
    return df.select(group, *sent, bits.alias("_nulls"), *watermark), fields


def _decoded(pdf: pd.DataFrame, fields: list[T.StructField]) -> list[list]:
    nulls = pdf["_nulls"].to_numpy()
    some, out = nulls.any(), []
    for i, f in enumerate(fields):
        if isinstance(f.dataType, (*_INTEGERS, *_TIMES, T.BooleanType)):
            values = pdf[f.name].to_numpy(dtype="int64")
            if isinstance(f.dataType, _TIMES):
                values = values.astype("datetime64[us]")
            elif isinstance(f.dataType, T.BooleanType):
                values = values.astype(bool)
            values = values.tolist()
            if some:
                for j in np.flatnonzero(nulls >> i & 1):
                    values[j] = None
        else:
            values = [None if x is None or x is pd.NA or x != x else x for x in pdf[f.name].tolist()]
        out.append(values)
    return out


class Rows:
    """The rows of a group in one micro-batch, column by column, for processors
    that take all keys at once (``handleKeys``)."""

    def __init__(self, pdf: pd.DataFrame, fields: list[T.StructField]):
        self.pdf, self.fields = pdf, fields

    def null(self, col: str) -> np.ndarray:
        return (self.pdf["_nulls"].to_numpy() >> [f.name for f in self.fields].index(col) & 1).astype(bool)

    def numbers(self, col: str) -> np.ndarray:
        return self.pdf[col].to_numpy(dtype="int64")

    def where(self, mask: np.ndarray) -> Rows:
        return Rows(self.pdf[mask], self.fields)

    def sorted(self, key: str, order: list[str]) -> tuple[Rows, np.ndarray, list]:
        """(rows by key and order, nulls first; where a key begins; the keys)."""
        code, keys = pd.factorize(self.pdf[key])
        by = [code]
        for c in order:
            by += [~self.null(c), self.numbers(c)]
        at = np.lexsort(by[::-1])
        code = code[at]
        first = np.append(True, code[1:] != code[:-1])
        return Rows(self.pdf.iloc[at], self.fields), first, [keys[c] for c in code[first]]

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.pdf.iloc[at], self.fields)

    def objects(self, col: str) -> np.ndarray:
        """A column of strings, None where null."""
        values = self.pdf[col].to_numpy(dtype=object)
        return np.where(pd.isna(values), None, values)

    def values(self, col: str) -> np.ndarray | list:
        """A column as it was before it was sent; an array where nothing is null."""
        i = [f.name for f in self.fields].index(col)
        f = self.fields[i]
        if isinstance(f.dataType, T.StringType):
            return self.objects(col)
        if self.null(col).any() or not isinstance(f.dataType, (*_INTEGERS, *_TIMES)):
            return _decoded(Rows(self.pdf[[col, "_nulls"]].assign(_nulls=self.null(col).astype("int64")), [f]).pdf, [f])[0]
        return self.numbers(col).astype("datetime64[us]") if isinstance(f.dataType, _TIMES) else self.numbers(col)


def codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number per value, the values numbered); null is a value like any other."""
    code, of = pd.factorize(values, use_na_sentinel=False)
    return code, np.where(pd.isna(of), None, of).astype(object)


def keyed(rows: Rows, key: str, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """(the row's position among the keys, the keys): those kept first, as they are."""
    code, keys = codes(np.concatenate([np.array(kept, dtype=object), rows.objects(key)]))
    return code[len(kept):], keys


def _cells(row, names: list[str]) -> tuple | list:
    of = row.__fields__ if isinstance(row, Row) else row._fields
    return row if list(of) == names else [getattr(row, n) for n in names]


def per_key(stream: DataFrame, key: str, processor: StatefulProcessor, out: str, mode: str = "Append",
            event_time: bool = False, groups: int = GROUPS) -> DataFrame:
    """``stream.groupBy(key).transformWithState(processor, out, mode, ...)``, with
    the state of a group of keys handed over at once. ``event_time``: the
    processor sets timers and the stream has a watermark on ``event_time``.

    A processor with ``handleGroup`` takes the rows of all keys and the arrays
    that the group keeps, and returns its output's columns, the arrays to keep,
    and rows that it leaves to ``handleInputRows`` of their keys, which then
    keep nothing in those arrays. A timer of such a group drops what
    ``stillKept`` does not keep."""
    sent, fields = _encoded(stream, key, groups)
    key_at = [f.name for f in fields].index(key)
    parsed = {}
    processor.init(declared := _Handle(parsed))
    kept_schema = state_schema(declared, fields[key_at].dataType)
    arrays = to_arrow_schema(kept_schema)
    if hasattr(processor, "handleGroup"):
        kept_schema = T.StructType().add("arrays", T.BinaryType())
    names = [f.name for f in _fields(out)]
    record = [f.name for f in fields]

    def grouped(pdfs: Iterator[pd.DataFrame], state, h: _Handle) -> Iterator[pd.DataFrame]:
        kept = _of_batch(state.get[0]) if state.exists else [[] for _ in arrays]
        if state.hasTimedOut:
            kept = processor.stillKept(kept, state.getCurrentWatermarkMs())
        else:
            columns, kept, rest = processor.handleGroup(Rows(pd.concat(list(pdfs), ignore_index=True), fields), kept)
            if len(columns[0]):
                yield pd.DataFrame({n: pd.Series(c, dtype=None if isinstance(c, np.ndarray) else object) for n, c in zip(names, columns)})
            if rest is not None and len(rest.pdf):
                row, mine, results, more = namedtuple("row", record)._make, {}, [], {}
                for r in map(row, zip(*_decoded(rest.pdf, fields))):
                    mine.setdefault(r[key_at], []).append(r)
                for k, of in mine.items():
                    h.load({})
                    results.extend(processor.handleInputRows((k,), iter(of), None))
                    if set(left := h.save()) - {None}:      # a timer with nothing to free is not kept
                        more[k] = left
                kept = _joined(kept, _pack(more, h), h)
                if results:
                    yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, zip(*[_cells(r, names) for r in results]))})
        if len(kept[0]):
            state.update((_to_batch(kept, arrays),))
            if event_time and len(kept[-1]):
                state.setTimeoutTimestamp(max(min(kept[-1]), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    def run(group, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        h, rows, results = _Handle(parsed), {}, []
        processor.init(h)
        if hasattr(processor, "handleGroup"):
            yield from grouped(pdfs, state, h)
            return
        kept = _unpack(state.get, h) if state.exists else {}

        def call(k, act) -> None:
            h.load(kept.pop(k, {}))
            results.extend(act())
            left = h.save()
            if left:
                kept[k] = left

        if state.hasTimedOut:
            passed = state.getCurrentWatermarkMs()
            for k in [k for k, v in kept.items() if any(ms < passed for ms in v.get(None, ()))]:
                for ms in sorted(ms for ms in kept[k][None] if ms < passed):
                    if k in kept:
                        kept[k].get(None, set()).discard(ms)
                        call(k, lambda: processor.handleExpiredTimer((k,), None, _Expired(ms)))
        elif hasattr(processor, "handleKeys"):
            whole = Rows(pd.concat(list(pdfs), ignore_index=True), fields)
            columns = processor.handleKeys(whole, kept)
            if columns and len(columns[0]):
                yield pd.DataFrame({n: pd.Series(c, dtype=None if isinstance(c, np.ndarray) else object) for n, c in zip(names, columns)})
        else:
            row = namedtuple("row", record)._make
            for pdf in pdfs:
                for r in map(row, zip(*_decoded(pdf, fields))):
                    rows.setdefault(r[key_at], []).append(r)
            for k, mine in rows.items():
                call(k, lambda: processor.handleInputRows((k,), iter(mine), None))
        if kept:
            state.update(_pack(kept, h))
            timers = [ms for v in kept.values() for ms in v.get(None, ())] if event_time else []
            if timers:
                state.setTimeoutTimestamp(max(min(timers), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if results:
            columns = zip(*[_cells(r, names) for r in results])
            yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, columns)})

    return sent.groupBy("_group").applyInPandasWithState(run, out, kept_schema, mode, "EventTimeTimeout" if event_time else "NoTimeout")


class _Expired:
    def __init__(self, ms: int):
        self.ms = ms

    def getExpiryTimeInMs(self) -> int:
        return self.ms
