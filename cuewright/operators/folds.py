"""Folds along sorted rows: a task streams its partition and holds one state, whatever a group's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

Step = Callable[[list | None, tuple], tuple[object, list]]


def fold(rows: DataFrame, group: str, order: list[str], step: Step, result: str, kind: DataType, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``rows`` and ``result``: what ``step(state, row)`` says of each row of a group, in order.

    ``step`` gets the state (None at a group's first row) and the row's values (in the order of the
    columns of ``rows``), and gives what it says of the row and the next state. A group is streamed through
    one task, so that time grows with its rows and memory doesn't."""
    sorted_ = rows.repartition(group).sortWithinPartitions(group, *order)
    at = rows.columns.index(group)
    schema = StructType([*(rows.schema[k] for k in keep), StructField(result, kind)])
    kept = [rows.columns.index(k) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: object = run  # no group
        state = None
        for batch in batches:
            said = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[at] != of:
                    of, state = row[at], None
                value, state = step(state, row)
                said.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(said, to_arrow_type(kind))], names=[*keep, result])

    return sorted_.mapInArrow(run, schema)
