"""Row-wise work on whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts turned into Python strings at a time.
TEXTS = 256


def map_texts(docs: DataFrame, text: str, columns: str, make: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """`docs` without `text`, with the columns that make() returns a function for.

    make() runs once per task; the function gets up to TEXTS strings or nulls and returns a
    list per column. Other columns pass through as Arrow data, untouched.
    """
    added = T._parse_datatype_string(columns)
    out = T.StructType([*(f for f in docs.schema if f.name != text), *added])
    types = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for whole in batches:
            for s in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(s, TEXTS)
                at = batch.schema.get_field_index(text)
                made = one(batch.column(at).to_pylist())
                rest = [i for i in range(batch.num_columns) if i != at]
                arrays = [batch.column(i) for i in rest] + [pa.array(v, t) for v, t in zip(made, types, strict=True)]
                names = [batch.schema.names[i] for i in rest] + added.names
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, out)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each value of `keys`, from batches that are sorted by them."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        at = batch[keys].to_numpy()
        edge = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
        cuts = [0, *edge.tolist(), len(batch)]
        if kept and (kept[0][keys].iloc[0].to_numpy() != at[0]).any():
            yield pd.concat(kept, ignore_index=True)
            kept = []
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            kept.append(batch.iloc[a:e])
            if e < len(batch):
                yield pd.concat(kept, ignore_index=True)
                kept = []
    if kept:
        yield pd.concat(kept, ignore_index=True)
