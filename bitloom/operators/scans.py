"""Ordered folds of many rows by composition: a step is a function, functions compose, and composites of ranges are small.

A fold that is a chain of functions of one kind (x times a plus b; x plus a, clamped) need not see a key's rows in one
place: each range of a key becomes one composite, the composites are put together in order, and what comes out before
a range is all that its rows need. Arrow batches are composed by NumPy in doubling steps; no list of a key is made.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

State = list[np.ndarray]


class Steps(ABC):
    """A kind of functions of a whole number that composition does not leave; columns hold a function's parameters."""

    columns: list[str]

    @abstractmethod
    def of(self, values: np.ndarray) -> State:
        """The function of each row's value."""

    @abstractmethod
    def then(self, first: State, second: State) -> State:
        """second after first, element by element."""

    @abstractmethod
    def at(self, steps: State, x: np.ndarray) -> np.ndarray:
        """What the functions make of x."""


class Polynomial(Steps):
    """h -> h * base + v modulo 2^64, as signed numbers of 64 bits."""

    columns = ["factor", "term"]

    def __init__(self, base: int = 31):
        self.base = base

    def of(self, values: np.ndarray) -> State:
        return [np.full(len(values), self.base, dtype=np.int64), values.astype(np.int64)]

    def then(self, first: State, second: State) -> State:
        with np.errstate(over="ignore"):
            return [first[0] * second[0], first[1] * second[0] + second[1]]

    def at(self, steps: State, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return x * steps[0] + steps[1]


class Clamped(Steps):
    """x -> x + v, clamped to low and high."""

    columns = ["add", "low", "high"]

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high

    def of(self, values: np.ndarray) -> State:
        return [values.astype(np.int64), np.full(len(values), self.low, dtype=np.int64), np.full(len(values), self.high, dtype=np.int64)]

    def then(self, first: State, second: State) -> State:
        move = lambda x: np.clip(x + second[0], second[1], second[2])
        return [first[0] + second[0], move(first[1]), move(first[2])]

    def at(self, steps: State, x: np.ndarray) -> np.ndarray:
        return np.clip(x + steps[0], steps[1], steps[2])


def _scan(steps: Steps, state: State, opens: np.ndarray) -> State:
    """The composite of each row with all rows before it back to where its group opens."""
    n = len(opens)
    rank = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    reach = 1
    while reach <= rank.max(initial=0):
        far = np.flatnonzero(rank >= reach)
        joined = steps.then([s[far - reach] for s in state], [s[far] for s in state])
        state = [s.copy() for s in state]
        for s, j in zip(state, joined):
            s[far] = j
        reach *= 2
    return state


def _groups(batches: Iterator[pa.RecordBatch], steps: Steps, given: bool, last: bool) -> Iterator[tuple[pa.RecordBatch, State]]:
    """Sorted batches with composites from where each group (column __group) opens; with last, only each group's last row."""
    name, open_state, held = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
        group = np.array(column("__group").to_pylist(), dtype=object)
        opens = np.ones(len(group), dtype=bool)
        opens[1:] = group[1:] != group[:-1]
        state = [column(c).to_numpy(zero_copy_only=False).copy() for c in steps.columns] if given else steps.of(column("__value").to_numpy(zero_copy_only=False))
        if name == group[0]:
            for s, j in zip(state, steps.then(open_state, [s[:1] for s in state])):
                s[0] = j[0]
        elif held is not None:
            yield held
        state = _scan(steps, state, opens)
        name, open_state = group[-1], [s[-1:] for s in state]
        if not last:
            yield batch, state
            continue
        ends = np.flatnonzero(np.append(opens[1:], False))
        if len(ends):
            yield batch.take(pa.array(ends)), [s[ends] for s in state]
        held = batch.slice(batch.num_rows - 1), open_state
    if held is not None:
        yield held


def _name(keys: list[str]) -> Column:
    """Keys as one string; null is told apart."""
    return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys]))


def _sorted(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return rows.withColumn("__group", _name(keys)).repartition(*keys).sortWithinPartitions("__group", *order)


def _run(steps: Steps, names: list[str], given: bool, last: bool, value: Callable | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, state in _groups(batches, steps, given, last):
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in (value(batch, state) if value else state))], [*names, *(["value"] if value else steps.columns)])

    return run


def _schema(rows: DataFrame, names: list[str], more: list[str]) -> str:
    kinds = dict((f.name, f.dataType.simpleString()) for f in rows.schema)
    return ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"`{c}` long" for c in more])


def composites(rows: DataFrame, keys: list[str], order: list[str | Column], value: Column, steps: Steps) -> DataFrame:
    """(keys, a function's parameters): the composite of each key's rows by order; value is a whole number, null is 0.

    Keys include what cuts large ones into ranges. order has to settle every tie that matters.
    """
    valued = rows.withColumn("__value", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    return _sorted(valued, keys, order).mapInArrow(_run(steps, keys, False, True), _schema(rows, keys, steps.columns))


def fold(rows: DataFrame, keys: list[str], order: list[str | Column], value: Column, steps: Steps, start: int, block: Column) -> DataFrame:
    """(keys, value): what all of a key's rows by order make of start. block rises with order and cuts keys into ranges."""
    parts = composites(rows.withColumn("__block", block), [*keys, "__block"], order, value, steps)
    put = lambda batch, state: [steps.at(state, np.full(batch.num_rows, start, dtype=np.int64))]
    return _sorted(parts, keys, ["__block"]).mapInArrow(_run(steps, keys, True, True, put), _schema(rows, keys, ["value"]))


def running(rows: DataFrame, keys: list[str], order: list[str | Column], value: Column, steps: Steps, start: int, block: Column, keep: list[str]) -> DataFrame:
    """(keep, value): after every row, what a key's rows so far make of start. Ranges as in fold(); rows shuffle twice."""
    cut = rows.withColumn("__block", block)
    parts = composites(cut, [*keys, "__block"], order, value, steps)
    put = lambda batch, state: [steps.at(state, np.full(batch.num_rows, start, dtype=np.int64))]
    after = _sorted(parts, keys, ["__block"]).mapInArrow(_run(steps, [*keys, "__block"], True, False, put), _schema(parts, [*keys, "__block"], ["value"]))
    before = F.coalesce(F.lag("value").over(W.partitionBy(*keys).orderBy("__block")), F.lit(start))
    begins = after.select(*keys, "__block", before.alias("__begins"))
    same = [cut[k].eqNullSafe(begins[k]) for k in (*keys, "__block")]
    joined = cut.join(begins, same).select(*[cut[c] for c in cut.columns], "__begins").withColumn("__value", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    begin = lambda batch, state: [steps.at(state, batch.column(batch.schema.get_field_index("__begins")).to_numpy(zero_copy_only=False))]
    return _sorted(joined, [*keys, "__block"], order).mapInArrow(_run(steps, keep, False, False, begin), _schema(rows, keep, ["value"]))


def adapted_counts(rows: DataFrame, key: str, order: list[str | Column], symbol: Column, start: list[int]) -> DataFrame:
    """(key, p0 to pn, n): a key's adaptive cumulative counts after all of its symbols (whole numbers from 0), by order.

    Each count above the symbol moves up towards 2^15 and each other one down, by one 2^(5 + n / 16)-th, n being the
    number of symbols so far, 32 at most. The steps round, so they do not compose: a key's rows pass through one task,
    sorted, of which only the counts are held.
    """
    names = [f"p{k}" for k in range(len(start))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, p, n = None, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([at[0], *(pa.array([x], pa.int32()) for x in (*p, n))], [key, *names, "n"])

        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            for i, (group, s) in enumerate(zip(column("__group").to_pylist(), column("__symbol").to_pylist())):
                if at is None or group != at[1]:
                    if at is not None:
                        yield row()
                    at, p, n = (column(key).slice(i, 1), group), list(start), 0
                p = [v + ((32768 - v) >> 5 + (n >> 4)) if k < s else v - (v >> 5 + (n >> 4)) for k, v in enumerate(p)]
                n = min(32, n + 1)
        if at is not None:
            yield row()

    kinds = ", ".join(f"{c} int" for c in (*names, "n"))
    return _sorted(rows.withColumn("__symbol", symbol.cast("long")), [key], order).mapInArrow(run, f"{_schema(rows, [key], [])}, {kinds}")
