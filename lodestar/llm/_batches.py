"""Arrow batches of text in pieces of bounded size, and a row-wise annotation over them."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text handled at once. One longer text makes a piece of its own.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes in column ``text``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size + 64)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def annotated(df: DataFrame, text: str, keep: list[str], make: Callable[[], Callable[[pa.Array], dict]], fields: str, most: int = PIECE_BYTES) -> DataFrame:
    """Columns ``keep`` of ``df`` and, for each row, the columns ``fields`` computed from column ``text``.

    ``make`` runs once a task and returns the function from a piece of texts (nulls included) to columns.
    A new column takes the place of a kept one of the same name.
    """
    new = T.StructType.fromDDL(fields)
    names = [f.name for f in new]
    low = {n.lower() for n in names}
    keep = [c for c in keep if c.lower() not in low]
    same = text in keep and df.schema[text].dataType == T.StringType()
    source = df.select(*[df[c] for c in keep], *[] if same else [df[text].cast("string").alias("__text")])
    body = text if same else "__text"
    schema = T.StructType([source.schema[c] for c in keep] + list(new))
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for piece in pieces(batches, body, most):
            got = fn(piece.column(body))
            columns = [piece.column(c) for c in keep]
            columns += [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], arrow.field(f.name).type) for f in new]
            yield pa.RecordBatch.from_arrays(columns, names=keep + names)
        release()

    return source.mapInArrow(run, schema)


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that allocators hold back to the system: Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end, and the offsets of each text; a null counts as empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]
