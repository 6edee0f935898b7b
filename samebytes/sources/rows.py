"""Rows made in Python tasks, as Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def record_batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    """Integers stay exact next to NULLs, which data frames in memory do not promise."""
    target = to_arrow_schema(schema)
    columns = zip(*rows) if rows else [()] * len(target)
    arrays = [pa.array(values, field.type) for values, field in zip(columns, target)]
    return pa.RecordBatch.from_arrays(arrays, schema=target)
