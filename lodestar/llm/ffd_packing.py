"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's tokens are cut at multiples of the capacity into pieces; what is left over is a shorter piece. Pieces are
dealt to groups of about ``group_rows`` by a hash of their place in the table, whatever they hold, so equal rows part,
and each group is packed alone: from the longest piece on, each goes
to the first sequence with room, which the tree (each node: the most room below it) finds in a logarithm of steps.
Groups are independent and of bounded size, so the work grows with the input and any group can be done again alone.

Null texts are empty; an empty text still has its end token. Repeated rows are packed each on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._batches import pieces, release
from .tree_bpe import encoder


def token_pieces(df: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, doc: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    rows = df.select(df[doc].alias("doc_id"), df[text].cast("string").alias("__text"))
    fields = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids)])
    kind = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, "no_space")
        for piece in pieces(batches, "__text"):
            texts = pc.fill_null(piece.column("__text"), "").to_pylist()
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for k, got in enumerate(own.encode_words(texts)):
                n = len(got) + 1
                full = np.append(got, np.uint32(end_id)).astype("<u4")
                for at in range(0, n, capacity):
                    part = full[at : at + capacity]
                    row.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(n)
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = [piece.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            if with_ids:
                columns.append(pa.array(ids, kind.field("ids").type))
            yield pa.RecordBatch.from_arrays(columns, names=kind.names)
        release()

    return rows.mapInArrow(run, fields)


def first_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size when they are taken in the order given."""
    leaves = 1 << max(len(sizes) - 1, 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def packed(df: DataFrame, size: str = "length", capacity: int = 4096, group_rows: int = 4000, ties: tuple[str, ...] = ("doc_id", "start", "ids_crc32")) -> DataFrame:
    """``df`` read from storage, with sequence_id and offset; rows need a size from 1 to ``capacity``. ``ties`` orders equal sizes."""
    groups = max(1, -(-df.count() // group_rows))
    dealt = df.withColumn("sequence_id", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint"))

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[(size, "descending"), *((c, "ascending") for c in ties)])
        table = table.take(order)
        bins, offsets = first_fit(table.column(size).to_numpy(), capacity)
        group = table.column("sequence_id")[0].as_py()
        at = {c: table.schema.get_field_index(c) for c in ("sequence_id", "offset")}
        table = table.set_column(at["sequence_id"], "sequence_id", pa.array((group << 32) + bins))
        return table.set_column(at["offset"], "offset", pa.array(offsets))

    return dealt.groupBy("sequence_id").applyInArrow(run, dealt.schema)
