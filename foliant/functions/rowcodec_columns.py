"""The binary row form (see rowcodec) column by column: all rows' bytes of a field are placed, or read, at once with
NumPy, nested fields too.

Writing: every field knows the size of each of its values; sizes of lists are sums over their elements, by prefix sums at the
lists' offsets. From the sizes follow the places, outermost first. Reading: where a field begins follows from those
before it, in all rows at once; elements of lists that have no fixed size are read rank by rank, the first of every
list, then the second, and so on."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

WIDTHS = {T.BooleanType: ("?", 1), T.ByteType: (">i1", 1), T.ShortType: (">i2", 2), T.IntegerType: (">i4", 4), T.LongType: (">i8", 8), T.FloatType: (">f4", 4), T.DoubleType: (">f8", 8)}

#: The size of each value, and what writes them all when told the output and where each begins.
Plan = tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], None]]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of sizes[i] each, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, size of each), of values none of which is null."""
    c = column.cast(pa.large_binary()) if not pa.types.is_decimal(column.type) else column.cast(pa.string()).cast(pa.large_binary())
    if not len(c):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def _count(out: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
    out[at[:, None] + np.arange(4)] = n.astype(">i4").view(np.uint8).reshape(-1, 4)


def _plan(column: pa.Array, kind: T.DataType, nullable: bool = False, variant: bool = False) -> Plan:
    if nullable:
        there = np.asarray(column.is_valid())
        inner, write = _plan(column.filter(pa.array(there)) if not there.all() else column, kind, variant=variant)
        sizes = np.ones(len(column), np.int64)
        sizes[there] += inner

        def marked(out: np.ndarray, at: np.ndarray) -> None:
            out[at] = there
            write(out, at[there] + 1)

        return sizes, marked
    if column.null_count:
        raise ValueError("a null where the schema allows none")
    n = len(column)
    if type(kind) in WIDTHS:
        code, width = WIDTHS[type(kind)]
        raw = np.ascontiguousarray(np.asarray(column.to_numpy(zero_copy_only=False)).astype(code)).view(np.uint8).reshape(n, width)

        def fixed(out: np.ndarray, at: np.ndarray) -> None:
            out[at[:, None] + np.arange(width)] = raw

        return np.full(n, width, np.int64), fixed
    if isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType)):
        data, lengths = _raw(column)

        def counted(out: np.ndarray, at: np.ndarray) -> None:
            _count(out, at, lengths)
            out[_spread(at + 4, lengths)] = data

        return 4 + lengths, counted
    if isinstance(kind, (T.ArrayType, T.MapType)):
        lengths = np.asarray((pc.list_value_length(column) if isinstance(kind, T.ArrayType) else pc.list_value_length(_entries(column))).to_numpy(zero_copy_only=False)).astype(np.int64)
        if isinstance(kind, T.ArrayType):
            parts = [_plan(column.flatten(), kind.elementType, kind.containsNull)]
        else:
            held = _entries(column).flatten()
            parts = [_plan(held.field(0), kind.keyType), _plan(held.field(1), kind.valueType, kind.valueContainsNull)]
        each = np.sum([p[0] for p in parts], axis=0)
        upto = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

        def listed(out: np.ndarray, at: np.ndarray) -> None:
            _count(out, at, lengths)
            place = np.repeat(at + 4 - upto[offsets[:-1]], lengths) + upto[:-1]
            for sizes, write in parts:
                write(out, place)
                place = place + sizes

        return 4 + upto[offsets[1:]] - upto[offsets[:-1]], listed
    if isinstance(kind, T.StructType):
        fields = column.flatten()
        if variant:
            held = np.array([np.asarray(f.is_valid()) for f in fields]).reshape(len(fields), n)
            if not held.any(0).all():
                raise ValueError("a variant without a value")
            tag = held.argmax(0)
            chosen = [np.flatnonzero(tag == i) for i in range(len(fields))]
            plans = [_plan(f.take(pa.array(rows)), k.dataType) for f, k, rows in zip(fields, kind, chosen, strict=True)]
            sizes = np.ones(n, np.int64)
            for rows, (own, _) in zip(chosen, plans, strict=True):
                sizes[rows] += own

            def tagged(out: np.ndarray, at: np.ndarray) -> None:
                out[at] = tag
                for rows, (_, write) in zip(chosen, plans, strict=True):
                    write(out, at[rows] + 1)

            return sizes, tagged
        plans = [_plan(f, k.dataType, k.nullable, bool(k.metadata.get("variant"))) for f, k in zip(fields, kind, strict=True)]

        def rowed(out: np.ndarray, at: np.ndarray) -> None:
            for own, write in plans:
                write(out, at)
                at = at + own

        return np.sum([p[0] for p in plans], axis=0, initial=0) + np.zeros(n, np.int64), rowed
    raise TypeError(f"no binary form for {kind.simpleString()}")


def _entries(column: pa.Array) -> pa.Array:
    """A map as a list of its entries."""
    kind = column.type
    return column.cast(pa.list_(pa.struct([pa.field("key", kind.key_type, False), pa.field("value", kind.item_type)])))


def _binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(data)])


def encode(batch: pa.RecordBatch, schema: T.StructType) -> pa.Array:
    """One value of bytes for each row."""
    columns = [batch.column(f.name) for f in schema]
    plans = [_plan(c, f.dataType, f.nullable, bool(f.metadata.get("variant"))) for c, f in zip(columns, schema, strict=True)]
    sizes = np.sum([p[0] for p in plans], axis=0, initial=0) + np.zeros(batch.num_rows, np.int64)
    out = np.zeros(int(sizes.sum()), np.uint8)
    at = np.cumsum(sizes) - sizes
    for own, write in plans:
        write(out, at)
        at = at + own
    return _binaries(out, sizes).cast(pa.binary())


def _filled(values: pa.Array, there: np.ndarray) -> pa.Array:
    """values where there is one, else null."""
    return values if there.all() else values.take(pa.array(np.cumsum(there) - 1, pa.int64(), mask=~there))


def _width(kind: T.DataType, nullable: bool) -> int | None:
    return None if nullable else WIDTHS.get(type(kind), ("", None))[1]


def _read(data: np.ndarray, at: np.ndarray, kind: T.DataType, target: pa.DataType, nullable: bool = False, variant: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The values that begin at each place, and where each ends."""
    if nullable:
        there = data[at] == 1 if len(at) else np.zeros(0, bool)
        values, ends = _read(data, at[there] + 1, kind, target, variant=variant)
        out = at + 1
        out[there] = ends
        return _filled(values, there), out
    n = len(at)
    if type(kind) in WIDTHS:
        code, width = WIDTHS[type(kind)]
        values = data[at[:, None] + np.arange(width)].copy().view(code).reshape(-1).astype(np.dtype(code).newbyteorder("="))
        return pa.array(values, target), at + width
    lengths = np.zeros(0, np.int64) if isinstance(kind, T.StructType) else data[at[:, None] + np.arange(4)].copy().view(">i4").reshape(-1).astype(np.int64)
    if isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType)):
        values = _binaries(data[_spread(at + 4, lengths)], lengths)
        return (pc.cast(values.cast(pa.string()), target) if isinstance(kind, T.DecimalType) else values.cast(target)), at + 4 + lengths
    if isinstance(kind, (T.ArrayType, T.MapType)):
        parts = [(kind.elementType, target.value_type, kind.containsNull)] if isinstance(kind, T.ArrayType) else [(kind.keyType, target.key_type, False), (kind.valueType, target.item_type, kind.valueContainsNull)]
        columns, ends = _elements(data, at + 4, lengths, parts)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        made = pa.ListArray.from_arrays(offsets, columns[0], type=target) if isinstance(kind, T.ArrayType) else pa.MapArray.from_arrays(offsets, *columns, type=target)
        return made, ends
    if not isinstance(kind, T.StructType):
        raise TypeError(f"no binary form for {kind.simpleString()}")
    columns = []
    if variant:
        tag, at = (data[at] if n else np.zeros(0, np.uint8)), at + 1
        for i, (f, t) in enumerate(zip(kind, target, strict=True)):
            there = tag == i
            values, ends = _read(data, at[there], f.dataType, t.type)
            at[there] = ends
            columns.append(_filled(values, there))
    else:
        for f, t in zip(kind, target, strict=True):
            values, at = _read(data, at, f.dataType, t.type, f.nullable, bool(f.metadata.get("variant")))
            columns.append(values)
    return pa.StructArray.from_arrays(columns, fields=list(target)) if columns else pa.array([{}] * n, target), at


def _elements(data: np.ndarray, at: np.ndarray, lengths: np.ndarray, parts: list[tuple[T.DataType, pa.DataType, bool]]) -> tuple[list[pa.Array], np.ndarray]:
    """The elements of all lists, list by list, and where each list ends. parts: of an element."""
    widths = [_width(k, nullable) for k, _, nullable in parts]
    if None not in widths:
        each = sum(widths)
        place = np.repeat(at, lengths) + each * (np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        out = []
        for (k, t, _), w in zip(parts, widths, strict=True):
            out.append(_read(data, place, k, t)[0])
            place = place + w
        return out, at + each * lengths
    at = at.copy()
    met: list[list[pa.Array]] = [[] for _ in parts]
    order = np.argsort(-lengths, kind="stable")
    before = np.cumsum(lengths) - lengths
    places = []
    falling = -lengths[order]
    for rank in range(int(lengths.max(initial=0))):
        rows = order[: int(np.searchsorted(falling, -rank, side="left"))]  # lists of more than `rank` elements
        place = at[rows]
        for held, (k, t, nullable) in zip(met, parts, strict=True):
            values, place = _read(data, place, k, t, nullable)
            held.append(values)
        at[rows] = place
        places.append(before[rows] + rank)
    if not places:
        return [pa.array([], t) for _, t, _ in parts], at
    back = pa.array(np.argsort(np.concatenate(places), kind="stable"))
    return [pa.concat_arrays(held).take(back) for held in met], at


def decode(column: pa.Array, schema: T.StructType, target: pa.Schema) -> pa.RecordBatch:
    """The rows of such values. Null values give rows of nulls."""
    c = column.cast(pa.large_binary())
    n = len(c)
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(c.buffers()[2] or b"", np.uint8) if n else np.zeros(0, np.uint8)
    held = np.asarray(c.is_valid())
    at = offsets[:-1][held].copy()
    columns = []
    for f, field in zip(schema, target, strict=True):
        values, at = _read(data, at, f.dataType, field.type, f.nullable, bool(f.metadata.get("variant")))
        columns.append(_filled(values, held))
    return pa.RecordBatch.from_arrays(columns, schema=target)
