"""Running a function over whole texts, a bounded piece of a column at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS, CHARS = 512, 2_000_000


def slices(batch: pa.RecordBatch, column: str, rows: int = ROWS, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of rows and, but for single long texts, of bytes."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float))
    start, held = 0, 0.0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= rows or held + size > chars):
            yield batch.slice(start, i - start)
            start, held = i, 0.0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def per_text(df: DataFrame, text: str, keep: tuple, ddl: str, make: Callable[[pa.Array], list[pa.Array]], chars: int = CHARS) -> DataFrame:
    """The columns `keep` of `df` with those of `ddl`, which `make` gives for a piece of the column `text`, as strings.

    Rows stay in place: no shuffle, and a lost task is simply run again. Other columns are not read. Where a name in
    `keep` is one that `ddl` adds, the added column has it."""
    added = StructType.fromDDL(ddl)
    kept = df.select(*(c for c in keep if c not in added.names), F.col(text).cast("string").alias("__text"))
    schema = StructType([*kept.schema.fields[:-1], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", chars=chars):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.column("__text"))], names=schema.names)

    return kept.mapInArrow(run, schema)
