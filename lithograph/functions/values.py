"""Python functions of one value as columns, over slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Values and bytes that are worked on at once: a task holds the results of one slice, however large its batches are.
SLICE_VALUES, SLICE_BYTES = 256, 1 << 22


def per_value(function: Callable, kind: str):
    """``function`` of one value as a column of type ``kind``.

    It counts as not deterministic, so that a filter over its result is not pushed below it, which would evaluate it again.
    """
    out = to_arrow_type(DataType.fromDDL(kind))

    def run(batches):
        for values in batches:
            held, size = [], 0
            for value in values:
                raw = value.as_py()
                held.append(function(raw))
                size += len(raw) if raw is not None else 0
                if len(held) == SLICE_VALUES or size >= SLICE_BYTES:
                    yield pa.array(held, out)
                    held, size = [], 0
            if held or not len(values):
                yield pa.array(held, out)

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
