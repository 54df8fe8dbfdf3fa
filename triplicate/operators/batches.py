"""Arrow batches of sorted rows, as ``mapInArrow`` gets them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut anew where these columns, never null, change: all rows of a group are in one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, dtype=bool)
        for c in map(batch.column, columns):
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = bool(held) and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in columns)
        starts = np.flatnonzero(new)
        if len(starts):
            last = int(starts[-1])
            yield _joined([*held, batch.slice(0, last)])
            held = []
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(batches)


def packed(c: Column, kind: StructType, name: str) -> list[Column]:
    """A struct's values as one array for each of their types, and one that tells which structs are there.

    At each row Spark asks every column of its Arrow batch for its size, which takes long where these are many.
    """
    there: list[Column] = []
    arrays: dict[str, list[Column]] = {}
    _take_apart(c, kind, there, arrays)
    return [F.array(*there).alias(f"{name}_there"), *(F.array(*values).alias(f"{name}_{t}") for t, values in sorted(arrays.items()))]


def _take_apart(c: Column, kind: StructType, there: list[Column], arrays: dict[str, list[Column]]) -> None:
    there.append(c.isNotNull())
    for f in kind.fields:
        if isinstance(f.dataType, StructType):
            _take_apart(c[f.name], f.dataType, there, arrays)
        else:
            arrays.setdefault(f.dataType.simpleString(), []).append(c[f.name])


def unpacked(kind: StructType, name: str) -> Column:
    """The struct that :func:`packed` took apart; null where its arrays are."""
    at: dict[str, int] = {}

    def nth(key: str) -> Column:
        at[key] = at.get(key, -1) + 1
        return F.get(F.col(f"{name}_{key}"), F.lit(at[key]))

    def made(k: StructType) -> Column:
        there = nth("there")
        fields = [(made(f.dataType) if isinstance(f.dataType, StructType) else nth(f.dataType.simpleString())).alias(f.name) for f in k.fields]
        return F.when(there, F.struct(*fields))

    return made(kind)
