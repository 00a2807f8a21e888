"""The record encoding, as expressions: what checksums and Merkle leaves are taken over."""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def big_endian(value: Column, size: int) -> Column:
    """A whole number as `size` bytes, highest first."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("long")), F.lit(16), F.lit("0")), F.lit(2 * size)))


def record_body(key: str = "key", ts_ns: str = "ts_ns", tombstone: str = "tombstone", value: str = "value") -> Column:
    """What follows the checksum: time (8 bytes), tombstone (1), key and value length (4 each), key, value. A null value is empty."""
    k, v = F.col(key).cast("binary"), F.coalesce(F.col(value).cast("binary"), F.lit(b""))
    return F.concat(big_endian(F.col(ts_ns), 8), F.when(F.col(tombstone), F.lit(b"\x01")).otherwise(F.lit(b"\x00")), big_endian(F.octet_length(k), 4), big_endian(F.octet_length(v), 4), k, v)


def record_crc(**columns: str) -> Column:
    return F.crc32(record_body(**columns))


def record_bytes(**columns: str) -> Column:
    body = record_body(**columns)
    return F.concat(big_endian(F.crc32(body), 4), body)


class Record(NamedTuple):
    key: str
    ts_ns: int
    tombstone: bool
    value: bytes | None


def encode(r: Record) -> bytes:
    """The same in Python, for single records."""
    k, v = r.key.encode(), r.value or b""
    body = struct.pack(">qBII", r.ts_ns, r.tombstone, len(k), len(v)) + k + v
    return struct.pack(">I", zlib.crc32(body)) + body


def decode(data: bytes) -> Record:
    """ValueError where the checksum or the lengths don't hold."""
    if len(data) < 21:
        raise ValueError("a record has at least 21 bytes")
    crc, ts_ns, tombstone, nk, nv = struct.unpack(">IqBII", data[:21])
    if len(data) != 21 + nk + nv or zlib.crc32(data[4:]) != crc:
        raise ValueError("the record is corrupt")
    return Record(data[21 : 21 + nk].decode(), ts_ns, bool(tombstone), None if tombstone else data[21 + nk :])
