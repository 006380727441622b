"""Folds over ordered rows, for rules that hang on all earlier rows of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """What ``fold`` gives for each key's rows in order.

    Rows are dealt by key and sorted within their partition, and a key's rows pass by one after another: a
    task holds what the fold keeps and a batch of rows, whatever the size of a key."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        every = (row for batch in batches for row in batch.to_pylist())
        made = (x for _, group in groupby(every, key=lambda r: tuple(r[k] for k in keys)) for x in fold(group))
        while part := list(islice(made, 5000)):
            yield pa.RecordBatch.from_pylist(part, schema=kinds)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
