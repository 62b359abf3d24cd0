"""Avro records (binary encoding, one schema) to JSON text and back, over Arrow batches.

Messages carry five bytes in front: 0x00 and the number of the schema. Only the small coders of
single values are Python; Spark hands the messages over in Arrow batches and goes on with the text.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = 5


def _long(data: bytes, at: int) -> tuple[int, int]:
    """A zig-zag varint: seven bits a byte, the lowest first, at most ten bytes."""
    n = data[at]
    if n < 128:
        return (n >> 1) ^ -(n & 1), at + 1
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return (n >> 1) ^ -(n & 1), at
        shift += 7
        if shift > 63:
            raise ValueError("number too long")


def _raw(data: bytes, at: int) -> tuple[bytes, int]:
    n, at = _long(data, at)
    if n < 0 or at + n > len(data):
        raise ValueError("text beyond the end")
    return data[at : at + n], at + n


def _blocks(data: bytes, at: int, item: Callable) -> tuple[list, int]:
    """Items in blocks: a count (negative: followed by the block's bytes), the items, and 0 at the end."""
    out = []
    while True:
        n, at = _long(data, at)
        if n == 0:
            return out, at
        if n < 0:
            n, (_, at) = -n, _long(data, at)
        for _ in range(n):
            value, at = item(data, at)
            out.append(value)


def _fixed(code: str) -> Callable:
    size = struct.calcsize(code)
    return lambda data, at: (struct.unpack_from(code, data, at)[0], at + size)


def reader(schema) -> Callable[[bytes, int], tuple[object, int]]:
    """(data, position) -> (value, position behind it) for a parsed schema."""
    if isinstance(schema, list):
        options = [reader(s) for s in schema]

        def union(data, at):
            k, at = _long(data, at)
            if not 0 <= k < len(options):
                raise ValueError("no such branch")
            return options[k](data, at)

        return union
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return reader(kind)
    if kind == "record":
        fields = [(f["name"], reader(f["type"])) for f in schema["fields"]]

        def record(data, at):
            out = {}
            for name, read in fields:
                out[name], at = read(data, at)
            return out, at

        return record
    if kind == "map":
        value = reader(schema["values"])

        def entry(data, at):
            key, at = _raw(data, at)
            held, at = value(data, at)
            return (key.decode(), held), at

        def mapping(data, at):
            pairs, at = _blocks(data, at, entry)
            return dict(pairs), at

        return mapping
    if kind == "array":
        item = reader(schema["items"])
        return lambda data, at: _blocks(data, at, item)
    if kind in ("string", "bytes"):

        def text(data, at):
            raw, at = _raw(data, at)
            return raw.decode("utf-8" if kind == "string" else "latin-1"), at

        return text
    if kind == "enum":

        def symbol(data, at):
            k, at = _long(data, at)
            return schema["symbols"][k], at

        return symbol
    if kind == "boolean":
        return lambda data, at: (data[at] != 0, at + 1)
    plain = {"int": _long, "long": _long, "float": _fixed("<f"), "double": _fixed("<d"), "null": lambda data, at: (None, at)}
    return plain[kind]


def decode_text(data: bytes, read: Callable) -> str | None:
    """A framed message as JSON text; None when it is no record of the schema, to its last byte."""
    if data[:1] != b"\x00":
        return None
    try:
        value, end = read(data, HEADER)
        return json.dumps(value, ensure_ascii=False) if end == len(data) else None
    except (IndexError, ValueError, struct.error):
        return None


def from_framed(value: Column, schema: str) -> Column:
    """JSON text of framed Avro messages; null for all others and for broken ones."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = reader(json.loads(schema))
        for batch in batches:
            yield pa.array([None if m is None else decode_text(m, read) for m in batch.to_pylist()], pa.string())

    return run(value.cast("binary"))


# --- writing: what producers put on a topic --------------------------------------


def _varint(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def writer(schema) -> Callable[[object], bytes]:
    """value -> its binary encoding for a parsed schema; a union takes null or its first other branch."""
    if isinstance(schema, list):
        none = schema.index("null") if "null" in schema else None
        other = next((i for i, s in enumerate(schema) if s != "null"), None)
        heads = [_varint(i) for i in range(len(schema))]
        branches = [writer(s) for s in schema]

        def union(value):
            k = none if value is None else other
            return heads[k] + branches[k](value)

        return union
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return writer(kind)
    if kind == "record":
        fields = [(f["name"], writer(f["type"])) for f in schema["fields"]]
        return lambda value: b"".join([write(value[name]) for name, write in fields])
    if kind == "map":
        item = writer(schema["values"])

        def mapping(value):
            held = b"".join([text(k) + item(v) for k, v in value.items()])
            return (_varint(len(value)) + held if value else b"") + b"\x00"

        text = writer("string")
        return mapping
    if kind == "array":
        item = writer(schema["items"])
        return lambda value: (_varint(len(value)) + b"".join([item(v) for v in value]) if value else b"") + b"\x00"
    if kind in ("string", "bytes"):
        code = "utf-8" if kind == "string" else "latin-1"

        def raw(value):
            data = value.encode(code)
            return _varint(len(data)) + data

        return raw
    if kind == "enum":
        heads = {symbol: _varint(i) for i, symbol in enumerate(schema["symbols"])}
        return lambda value: heads[value]
    if kind in ("int", "long"):
        return lambda value: _varint(int(value))
    if kind == "null":
        return lambda value: b""
    pack = struct.Struct({"float": "<f", "double": "<d", "boolean": "?"}[kind]).pack
    return lambda value: pack(value)


def encode_value(value, schema) -> bytes:
    """One value in the binary encoding."""
    return writer(schema)(value)


def to_framed(text: Column, schema: str, number: int = 1) -> Column:
    """JSON objects as framed Avro messages."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        write, head = writer(json.loads(schema)), b"\x00" + number.to_bytes(4, "big")
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.array([None if t is None else head + write(json.loads(t)) for t in rows], pa.binary())

    return run(text)
