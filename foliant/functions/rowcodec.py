"""A compact binary form of rows, driven by their schema.

Big-endian fixed-width numbers; booleans one byte; text and bytes after a 32-bit count, as are arrays
and maps; structs field after field; a nullable field after a byte that is 1 if a value follows. A
variant is a struct of alternatives of which one is set: a byte tells which."""

from __future__ import annotations

import struct
from decimal import Decimal

from pyspark.sql import types as T

_FIXED = {T.ByteType: ">b", T.ShortType: ">h", T.IntegerType: ">i", T.LongType: ">q", T.FloatType: ">f", T.DoubleType: ">d"}


def encode(value: object, kind: T.DataType, nullable: bool = False, variant: bool = False) -> bytes:
    if nullable:
        return b"\0" if value is None else b"\1" + encode(value, kind, variant=variant)
    if type(kind) in _FIXED:
        return struct.pack(_FIXED[type(kind)], value)
    if isinstance(kind, T.BooleanType):
        return b"\1" if value else b"\0"
    if isinstance(kind, T.StringType):
        raw = value.encode("utf-8")
        return struct.pack(">i", len(raw)) + raw
    if isinstance(kind, T.BinaryType):
        return struct.pack(">i", len(value)) + bytes(value)
    if isinstance(kind, T.DecimalType):
        return encode(str(value), T.StringType())
    if isinstance(kind, T.ArrayType):
        return struct.pack(">i", len(value)) + b"".join(encode(v, kind.elementType, kind.containsNull) for v in value)
    if isinstance(kind, T.MapType):
        return struct.pack(">i", len(value)) + b"".join(encode(k, kind.keyType) + encode(v, kind.valueType, kind.valueContainsNull) for k, v in value.items())
    if isinstance(kind, T.StructType):
        get = value.get if isinstance(value, dict) else lambda name: value[name]
        if variant:
            tag, f = next((i, f) for i, f in enumerate(kind) if get(f.name) is not None)
            return bytes((tag,)) + encode(get(f.name), f.dataType)
        return b"".join(encode(get(f.name), f.dataType, f.nullable, bool(f.metadata.get("variant"))) for f in kind)
    raise TypeError(f"no binary form for {kind.simpleString()}")


def decode(data: bytes, kind: T.DataType, at: int = 0, nullable: bool = False, variant: bool = False) -> tuple[object, int]:
    """The value and where it ends."""
    if nullable:
        return (None, at + 1) if data[at] == 0 else decode(data, kind, at + 1, variant=variant)
    if type(kind) in _FIXED:
        f = _FIXED[type(kind)]
        return struct.unpack_from(f, data, at)[0], at + struct.calcsize(f)
    if isinstance(kind, T.BooleanType):
        return data[at] != 0, at + 1
    if isinstance(kind, (T.StringType, T.BinaryType)):
        n = struct.unpack_from(">i", data, at)[0]
        raw = data[at + 4 : at + 4 + n]
        return raw.decode("utf-8") if isinstance(kind, T.StringType) else raw, at + 4 + n
    if isinstance(kind, T.DecimalType):
        text, at = decode(data, T.StringType(), at)
        return Decimal(text), at
    if isinstance(kind, (T.ArrayType, T.MapType)):
        n, at = struct.unpack_from(">i", data, at)[0], at + 4
        items: list = []
        for _ in range(n):
            if isinstance(kind, T.ArrayType):
                v, at = decode(data, kind.elementType, at, kind.containsNull)
            else:
                k, at = decode(data, kind.keyType, at)
                v, at = decode(data, kind.valueType, at, kind.valueContainsNull)
                v = (k, v)
            items.append(v)
        return (items if isinstance(kind, T.ArrayType) else dict(items)), at
    if isinstance(kind, T.StructType):
        if variant:
            f = kind[data[at]]
            v, at = decode(data, f.dataType, at + 1)
            return {g.name: v if g.name == f.name else None for g in kind}, at
        out = {}
        for f in kind:
            out[f.name], at = decode(data, f.dataType, at, f.nullable, bool(f.metadata.get("variant")))
        return out, at
    raise TypeError(f"no binary form for {kind.simpleString()}")
