"""Filters of whole rows by a decision made on their texts, in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as K


def keep_where(docs: DataFrame, decide: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Rows of docs for whose text decide(bytes, offsets, batch) is true; columns stay as they are. A null text is empty."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(decide(*K.column_bytes(batch.column(at)), batch), pa.bool_()))
        K.settle()

    return docs.mapInArrow(run, docs.schema)
