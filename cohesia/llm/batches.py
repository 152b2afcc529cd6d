"""Arrow-batch plumbing shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from cohesia.session import ship

#: Rows of one slice handed to an operator: bounds a worker's memory beside the texts themselves.
SLICE = 1024


def _mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: StructType) -> DataFrame:
    """``run`` over Arrow batches under any column names: Spark itself sees plain ones, whatever dots or spaces the names hold."""
    ship(df.sparkSession)
    names = df.columns
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(kind)])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=plain.names)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, plain).toDF(*kind.names)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | StructType) -> DataFrame:
    """Apply ``make()``'s function to Arrow slices; it returns columns by name.

    ``make`` runs once per task on the executor, so that models are loaded there.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = step(batch.slice(at, SLICE))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return _mapped(df, run, kind)


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows for which ``make()``'s function says true, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield part.filter(pa.array(step(part), type=pa.bool_()))

    return _mapped(df, run, df.schema)


def gather(df: DataFrame, key: list[str], values: dict[str, str]) -> DataFrame:
    """One row for each key (columns of long) with the values of its rows as arrays; values: column to SQL type.

    Rows are dealt by key, sorted, and cut where the key changes; a task holds one batch and one key's rows. For keys whose
    rows are bounded (those of one document).
    """
    ship(df.sparkSession)
    schema = ", ".join([*(f"{k} long" for k in key), *(f"{v} array<{t}>" for v, t in values.items())])
    kinds = [f.type for f in to_arrow_schema(_parse_datatype_string(schema))]
    names = [*key, *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def cut(columns: list[np.ndarray], heads: np.ndarray) -> pa.RecordBatch:
            offsets = pa.array(np.r_[heads, len(columns[0])].astype(np.int32))
            arrays = [pa.array(c[heads]) for c in columns[: len(key)]]
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(c, type=t.value_type)).cast(t) for c, t in zip(columns[len(key) :], kinds[len(key) :], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held:
                columns = [np.r_[a, b] for a, b in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            change = np.zeros(len(columns[0]), dtype=bool)
            change[0] = True
            for c in columns[: len(key)]:
                change[1:] |= c[1:] != c[:-1]
            heads = np.flatnonzero(change)
            end = heads[-1]
            if end:
                yield cut([c[:end] for c in columns], heads[:-1])
            held = [c[end:].copy() for c in columns]
        if held:
            yield cut(held, np.zeros(1, dtype=np.int64))

    return df.select(*names).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)
