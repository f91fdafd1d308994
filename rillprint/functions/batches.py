"""Arrow batches in bounded pieces, so that what a worker holds does not grow with a batch's rows, and steps that share a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES, SLICE_ROWS = 1 << 20, 1024


def slices(batch: pa.RecordBatch, column: str = "content") -> Iterator[pa.RecordBatch]:
    """A batch's rows in order, in runs of at most SLICE_ROWS whose column holds at most about SLICE_BYTES; a larger value comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, min(int(np.searchsorted(ends, before + SLICE_BYTES, side="right")), at + SLICE_ROWS))
        yield batch.slice(at, stop - at)
        at = stop


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class Steps:
    """Arrow functions one after another in one Python worker; each alone would keep a worker for every running task."""

    def __init__(self, *steps: Step):
        self.steps = steps

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in self.steps:
            batches = step(batches)
        return batches


def map_objects(objects: DataFrame, columns: tuple[str, ...], step: Step, ddl: str) -> DataFrame:
    """A step over object_id and the columns.  Rows that come straight from another step, and are not cached, are made in the same worker.

    A step finds columns by name, as it may get more than it asks for.
    """
    origin, before = (None, ()) if objects.is_cached else vars(objects).get("_steps", (None, ()))
    if origin is None:
        origin = objects.select(F.col("object_id").cast("string"), *columns)
    out = origin.mapInArrow(Steps(*before, step), ddl)
    out._steps = origin, (*before, step)
    return out
