"""Folds along an order in each key: sorted by Spark, one pass over each task's rows, constant state.

A key's rows are in one task, in order, and nothing of them is gathered: what is held is the state alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veilspan import session


def fold(rows: DataFrame, key: str, order: list[str], inputs: list[str], start: Callable[[], dict], step: Callable[..., tuple], outputs: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """`rows` with the outputs (name: SQL type, Arrow type) appended that `step(state, *inputs)` returns. The state is
    `start()` at each key's first row; a null key is a key."""
    session.ship_package(rows.sparkSession)
    at, own = rows.columns.index(key), [rows.columns.index(c) for c in inputs]
    types = [t for _, t in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), {}
        for batch in batches:
            out = []
            for k, *values in zip(batch.column(at).to_pylist(), *(batch.column(i).to_pylist() for i in own), strict=True):
                if k != last:
                    last, state = k, start()
                out.append(step(state, *values))
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*batch.schema.names, *outputs])

    schema = rows.schema
    for name, (kind, _) in outputs.items():
        schema = schema.add(name, kind)
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
