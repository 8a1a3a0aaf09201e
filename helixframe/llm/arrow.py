"""Adding columns to a DataFrame with a function over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def trim() -> None:
    """Give memory that a finished task has freed back to the system: Python workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(items: list, size: int = 500) -> Iterator[list]:
    """Parts of a batch, for functions whose arrays are many times as large as their texts."""
    for at in range(0, len(items), size):
        yield items[at : at + size]


def add_columns(df: DataFrame, ddl: str, compute: Callable[..., Callable[[pa.RecordBatch], list]], *setup) -> DataFrame:
    """``df`` with the columns of ``ddl`` appended; columns of the same names (in any case) are replaced.

    ``compute(*setup)`` is called once per task and returns the function that maps a batch (with the input's own
    columns) to the lists or arrays of the new ones.
    """
    fields = T.StructType.fromDDL(ddl).fields
    names = {f.name.lower() for f in fields}
    width = len(df.columns)
    at = [i for i, c in enumerate(df.columns) if c.lower() not in names]
    kept = T.StructType([df.schema.fields[i] for i in at])
    schema = T.StructType([*kept.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = compute(*setup)
        types = [arrow_type(f.dataType) for f in fields]
        for batch in batches:
            assert batch.num_columns == width
            made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(function(batch), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *made], names=[*(batch.schema.names[i] for i in at), *(f.name for f in fields)])
        del function
        trim()

    return df.mapInArrow(run, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in t.fields])
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}
    return simple[type(t)]
