"""Log files as bytes: records cut in fragments of 32 KiB blocks, each with a checksum; a sink and a source for Spark.

A fragment is a masked CRC-32 of type and payload, the payload's length, its type (1 whole, 2 first, 3 middle, 4 last), and the payload. Less
than a header's room at a block's end is zeros. The payload of a record is a write batch (`functions/codec.py`).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.codec import BLOCK_BYTES, CRC_MASK_DELTA, HEADER_BYTES
from ..schema import Corruption

WHOLE, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def checksum(kind: int, payload: bytes) -> int:
    crc = zlib.crc32(payload, zlib.crc32(bytes([kind])))
    return ((crc >> 15 | crc << 17) + CRC_MASK_DELTA) & 0xFFFFFFFF


def frame(records: Iterator[bytes], at: int = 0) -> Iterator[bytes]:
    """The bytes of a log that already has `at`, in portions."""
    for record in records:
        first, rest = True, memoryview(record)
        while True:
            room = BLOCK_BYTES - at % BLOCK_BYTES
            if room < HEADER_BYTES:
                yield bytes(room)
                at += room
                room = BLOCK_BYTES
            part, rest = rest[: room - HEADER_BYTES], rest[room - HEADER_BYTES :]
            kind = (WHOLE if first else LAST) if not rest else FIRST if first else MIDDLE
            yield struct.pack("<IHB", checksum(kind, part), len(part), kind) + bytes(part)
            at += HEADER_BYTES + len(part)
            first = False
            if not rest:
                break


def unframe(data: bytes, strict: bool = False) -> Iterator[bytes]:
    """The whole records of a log. A damaged fragment (length, type, checksum, order) costs the rest of its block and the record it belongs to; reading goes on at
    the next block. A record that the log's end cuts off gives nothing, or with strict an error."""
    at, held = 0, None
    while at + HEADER_BYTES <= len(data):
        room = BLOCK_BYTES - at % BLOCK_BYTES
        if room < HEADER_BYTES:
            at += room
            continue
        crc, size, kind = struct.unpack_from("<IHB", data, at)
        payload = data[at + HEADER_BYTES : at + HEADER_BYTES + size]
        if kind in (WHOLE, FIRST, MIDDLE, LAST) and size <= room - HEADER_BYTES and len(payload) < size:
            held = held or []
            break
        if kind not in (WHOLE, FIRST, MIDDLE, LAST) or size > room - HEADER_BYTES or checksum(kind, payload) != crc:
            at, held = at + room, None
            continue
        at += HEADER_BYTES + size
        if kind in (WHOLE, FIRST):
            held = [payload]
        elif held is not None:
            held.append(payload)
        if kind in (WHOLE, LAST):
            if held is not None:
                yield b"".join(held)
            held = None
    if strict and held is not None:
        raise Corruption(f"the log ends inside a record, at byte {len(data)}")


def framed(records: DataFrame) -> DataFrame:
    """log, content (binary) of the log files that hold records (log, ordinal, record), in order of ordinal. A log file is as long as its writer lets it be; it is one row."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"log": [key[0]], "content": [b"".join(frame(rows.sort_values("ordinal")["record"]))]})

    return records.select(F.col("log").cast("long"), "ordinal", "record").groupBy("log").applyInPandas(run, "log long, content binary")


def unframed(logs: DataFrame, strict: bool = False) -> DataFrame:
    """log, ordinal, record of log files (log, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for log, content in zip(f["log"], f["content"]):
                records = list(unframe(bytes(content), strict))
                if records:
                    yield pd.DataFrame({"log": log, "ordinal": range(len(records)), "record": records})

    return logs.select(F.col("log").cast("long"), "content").mapInPandas(run, "log long, ordinal long, record binary")


def read_logs(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """log, ordinal, record of the files NNNNNN.log of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder)
    return unframed(files.select(F.regexp_extract("path", r"(\d+)\.log$", 1).cast("long").alias("log"), "content"), strict)


def entries(records: DataFrame) -> DataFrame:
    """The change log in records: cf, user_key, seq, op, value; records that are no whole batch give nothing."""
    return records.select(F.explode(codec.decoded_entries(F.col("record"))).alias("e")).select("e.cf", "e.user_key", "e.seq", "e.op", "e.value")
