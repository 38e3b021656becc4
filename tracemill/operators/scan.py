"""Folds over ordered groups that hold no group: one exchange and one sort, then a pass over each partition's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.sources.shipping import ship


def scan(df: DataFrame, by: list[str], order: list[str], inputs: list[str], begin: Callable[[], Callable], name: str, kind: str) -> DataFrame:
    """Adds a column: for each row, in its group's order, what the group's fold gives for the row's inputs. ``begin`` makes
    a new group's fold. A task keeps one batch and one fold, however long a group is. Rows are told apart by all columns
    of the order only; equal ones are folded as they come."""
    ship(df.sparkSession)
    shape = df.schema.add(name, kind) if name not in df.columns else df.schema
    places = [df.columns.index(c) for c in by], [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fold = None, None
        for b in batches:
            keys, values = (list(zip(*(b.column(k).to_pylist() for k in ks), strict=True)) for ks in places)
            out = []
            for key, value in zip(keys, values, strict=True):
                if fold is None or key != group:
                    group, fold = key, begin()
                out.append(fold(*value))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, _kinds[kind])], names=[*b.schema.names, name])

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, shape)


_kinds = {"long": pa.int64(), "boolean": pa.bool_()}
