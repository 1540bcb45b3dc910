"""Deeply nested records as related flat tables.

A record is JSON text. A block of texts becomes an Arrow array of a declared nested type (the shape) by array operations
over its bytes (jsontape), which also settle naming styles and lone values. No record is gone through by itself: each list
level becomes a child table by list offsets and parent indices, and the keys and scalar fields of all levels above reach
the children by vectorised take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.operators.jsontape import decode_texts

#: Bytes of text decoded at a time inside a task (a longer text by itself), which bounds the arrays alive.
CHUNK_BYTES = 4_000_000


class Identifier:
    """A scalar of a shape that may also come as an object; names are the fields that hold it, the first present one counts."""

    def __init__(self, *names: str) -> None:
        self.names = names


#: A shape is a dict of fields by canonical name, a list of one shape, str, int or an Identifier.
Shape = Any


def canonical_name(name: str) -> str:
    """Letter case and underscores don't distinguish field names."""
    return name.replace("_", "").lower()


def arrow_type(shape: Shape) -> pa.DataType:
    if isinstance(shape, Mapping):
        return pa.struct([(name, arrow_type(inner)) for name, inner in shape.items()])
    if isinstance(shape, list):
        return pa.list_(arrow_type(shape[0]))
    return pa.int64() if shape is int else pa.string()


def decode(texts: pa.Array, shape: Mapping[str, Shape]) -> pa.Array:
    """The records in an array of texts, null where a text is null or breaks off; outer objects and text around it, in any
    depth, are taken off. What has no place in the shape is left out, what doesn't fit is null; whole numbers beyond 64 bits
    don't fit."""
    return decode_texts(texts, shape, canonical_name, Identifier)


def chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded text, at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def explode_list(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The elements of a list array, the index of the list each one is from, and its place there (from 0)."""
    parents = pc.list_parent_indices(lists)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    places = np.arange(len(parents), dtype=np.int64) - starts[parents.to_numpy(zero_copy_only=False)]
    return pc.list_flatten(lists), parents, pa.array(places)


def flatten(records: pa.Array, keys: Mapping[str, pa.Array]) -> dict[str, pa.Table]:
    """A table for each list in an Arrow array of nested records, by dotted path.

    A table has keys (of the records), and for each list level down to its own `<path>#` (the place in that list) and
    the scalar fields beside and under it, `<path>.<field>`; `<path>` itself where the elements are scalars. Null
    elements keep their places.
    """
    tables: dict[str, pa.Table] = {}

    def scalars(array: pa.Array, path: str, into: dict[str, pa.Array], lists: dict[str, pa.Array]) -> None:
        if pa.types.is_struct(array.type):
            for i in range(array.type.num_fields):
                name = array.type.field(i).name
                scalars(pc.struct_field(array, [i]), f"{path}.{name}" if path else name, into, lists)
        elif pa.types.is_list(array.type):
            lists[path] = array
        else:
            into[path] = array

    def descend(array: pa.Array, path: str, carried: dict[str, pa.Array]) -> None:
        own, lists = dict(carried), {}
        scalars(array, path, own, lists)
        if path:
            tables[path] = pa.table(own)
        for inner_path, inner in lists.items():
            items, parents, places = explode_list(inner)
            taken = {name: column.take(parents) for name, column in own.items()}
            descend(items, inner_path, taken | {f"{inner_path}#": places})

    descend(records, "", dict(keys))
    return tables


def nested_tables(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    shape: Mapping[str, Shape],
    schema: T.StructType | str,
    emit: Callable[[dict[str, pa.Table]], pa.Table],
) -> DataFrame:
    """The child tables of the JSON records in df[column], brought to rows of schema by emit, in one pass over df.

    Only keys and column are read, so other columns may have any names. A null, blank or broken text gives no row, nor do
    null and empty lists; repeated records are kept. The work is done block by block of the partition, without a shuffle.
    """
    kept = df.select(*[F.col(f"`{k}`").alias(f"key_{i}") for i, k in enumerate(keys)], F.col(f"`{column}`").cast("string").alias("json"))
    target, nested = arrow_type(shape), [f"key_{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, len(nested)):
                records = decode(part.column(len(nested)), shape).cast(target)
                own = {k: part.column(part.schema.get_field_index(n)) for k, n in zip(keys, nested, strict=True)}
                yield from emit(flatten(records, own)).combine_chunks().to_batches()

    return kept.mapInArrow(run, schema)


def child_table(df: DataFrame, keys: Sequence[str], column: str, shape: Mapping[str, Shape], path: str) -> DataFrame:
    """The child table of one list path: keys, the place in each list down to it, and the scalar fields of each level.

    Column names are the dotted paths with `_` for the dots and `_ord` for places.
    """
    key_type = pa.schema([])
    for k in keys:
        key_type = key_type.append(pa.field(k, _to_arrow(df.schema[k].dataType)))
    empty = flatten(pa.array([], type=arrow_type(shape)), {f.name: pa.array([], type=f.type) for f in key_type})
    if path not in empty:
        raise ValueError(f"{path} is no list of the shape; these are: {', '.join(empty)}")
    names = [c.replace("#", "_ord").replace(".", "_") for c in empty[path].column_names]
    kinds = {pa.int64(): "bigint", pa.int32(): "int"}
    ddl = ", ".join(
        f"`{n}` {df.schema[n].dataType.simpleString() if n in keys else kinds.get(t, 'string')}" for n, t in zip(names, empty[path].schema.types, strict=True)
    )
    return nested_tables(df, keys, column, shape, ddl, lambda tables: tables[path].rename_columns(names))


def _to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: The part of an execution report that is made relational.
REPORT_SHAPE: dict[str, Shape] = {
    "publications": [
        {
            "id": str,
            "status": str,
            "evidence": {"semantic": {"orderednodeids": [Identifier("id", "nodeid")], "orderedchapterids": [Identifier("id", "chapterid", "nodeid")]}},
            "packageprocessing": {
                "spine": [{"position": int, "disposition": str, "reason": str, "readingrole": str, "fallbackchain": [Identifier("itemid", "id")]}]
            },
        }
    ]
}
_NODES = "publications.evidence.semantic.orderednodeids"
_CHAPTERS = "publications.evidence.semantic.orderedchapterids"
_SPINE = "publications.packageprocessing.spine"
_FALLBACK = f"{_SPINE}.fallbackchain"
ITEM_SCHEMA = "record_id bigint, pub_ord int, list_name string, parent_pos int, item_ord int, item_id string"


def _report_items(tables: dict[str, pa.Table]) -> pa.Table:
    parts = []
    for name, path in (("node", _NODES), ("chapter", _CHAPTERS), ("fallback", _FALLBACK)):
        rows = tables[path]
        rows = rows.filter(pc.is_valid(rows[path]))
        if name == "fallback":  # a decision without a position, or one beyond 32 bits, is told by its place
            position = rows[f"{_SPINE}.position"]
            fits = pc.and_(pc.greater_equal(position, -(2**31)), pc.less(position, 2**31))
            above = pc.cast(pc.coalesce(pc.if_else(fits, position, None), rows[f"{_SPINE}#"]), pa.int32())
        else:
            above = pa.array(np.full(rows.num_rows, -1, dtype=np.int32))
        parts.append(
            pa.table(
                {
                    "record_id": rows["record_id"],
                    "pub_ord": pc.cast(rows["publications#"], pa.int32()),
                    "list_name": pa.array([name] * rows.num_rows, type=pa.string()),
                    "parent_pos": above,
                    "item_ord": pc.cast(rows[f"{path}#"], pa.int32()),
                    "item_id": rows[path],
                }
            )
        )
    return pa.concat_tables(parts)


def report_items(reports: DataFrame, key: str = "record_id", column: str = "payload") -> DataFrame:
    """One row per non-null element of the node, chapter and fallback lists of all execution reports."""
    renamed = reports.select(F.col(f"`{key}`").cast("bigint").alias("record_id"), F.col(f"`{column}`").alias("payload"))
    return nested_tables(renamed, ["record_id"], "payload", REPORT_SHAPE, ITEM_SCHEMA, _report_items)
