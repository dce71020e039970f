"""Conversations as pieces: rows in order, at most so many to a piece, however long a conversation is."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of text after which a piece ends.
PIECE_ROWS, PIECE_BYTES = 512, 1 << 22
#: Characters of a text that take part in dealing rows to tasks; rows alike so far stay together.
KEY_CHARS = 64


def conversation_pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pieces of conversations: conv_id, part, piece, whole, rows.

    ``rows`` has conv_id, turn, role and text, and may have more columns, which
    stay in the array ``rows`` of structs, where ``again`` says that a row equals
    the one before it. A conversation's rows are ordered by turn (null first), then role
    and text by code point (null first), so reruns agree. A piece has at most
    ``piece_rows`` rows and ends after PIECE_BYTES of text. (part, piece) names a piece and
    orders a conversation's. ``whole`` is true for all but long conversations and
    the two at the ends of each range of rows, which may go on in the next one.
    The rows of one conversation are dealt over as many tasks as they need. A null conv_id is a
    conversation. An empty table gives no rows.
    """
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    ordered = rows.repartitionByRange(*key, F.substring("text", 1, KEY_CHARS).asc_nulls_first()).sortWithinPartitions(*key, F.col("text").asc_nulls_first())
    fields = [f for f in ordered.schema.fields if f.name != "conv_id"]
    struct = T.StructType([*fields, T.StructField("again", T.BooleanType())])
    out = T.StructType(
        [
            rows.schema["conv_id"],
            T.StructField("part", T.IntegerType()),
            T.StructField("piece", T.LongType()),
            T.StructField("whole", T.BooleanType()),
            T.StructField("rows", T.ArrayType(struct)),
        ]
    )
    names = [f.name for f in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[dict] = []  # the open piece
        size, piece, of, runs, last, cut_before = 0, 0, None, 0, None, False
        done: list[tuple] = []
        schema = None
        for batch in batches:
            if schema is None:
                schema = _arrow(batch.schema, names)
            ids = batch.column(batch.schema.get_field_index("conv_id")).to_pylist()
            for conv, row in zip(ids, batch.select(names).to_pylist(), strict=True):
                begins = not runs or conv != of
                if held and (begins or len(held) >= piece_rows or size >= PIECE_BYTES):
                    done.append((of, part, piece, begins and not cut_before and runs > 1, held))
                    held, size, piece, cut_before = [], 0, piece + 1, True
                if begins:
                    of, runs, last, cut_before = conv, runs + 1, None, False
                held.append({**row, "again": row == last})
                last = row
                size += len(row["text"] or "")
            if done:
                yield _batch(done, schema)
                done = []
        if held:
            yield _batch([(of, part, piece, False, held)], schema)

    return ordered.mapInArrow(cut, out)


def _arrow(schema: pa.Schema, names: list[str]) -> pa.Schema:
    struct = pa.struct([*(schema.field(n) for n in names), pa.field("again", pa.bool_())])
    return pa.schema([schema.field("conv_id"), ("part", pa.int32()), ("piece", pa.int64()), ("whole", pa.bool_()), ("rows", pa.list_(struct))])


def _batch(pieces: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, type) for column, type in zip(zip(*pieces, strict=True), schema.types, strict=True)], schema=schema)
