"""Scalar codecs as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the record formats.
BATCH_TAG, PUT_TAG, DELETE_TAG = 1, 1, 2
BLOCK_BYTES, HEADER_BYTES = 32_768, 7
CRC_MASK_DELTA = 0xA282EAD8
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193


def key_tag(seq: Column, op: Column) -> Column:
    """The trailer of an internal key: the sequence number above one byte of operation."""
    return F.shiftleft(seq, 8).bitwiseOR(op.cast("long"))


def tag_seq(tag: Column) -> Column:
    return F.shiftrightunsigned(tag, 8)


def tag_op(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit(255)).cast("int")


def varint_length(v: Column) -> Column:
    """Bytes of a base-128 varint; a negative value is an unsigned one above 2^63."""
    out = F.when(v < 0, 10)
    for n in range(1, 9):
        out = out.when(v < F.lit(1 << (7 * n)), n)
    return out.otherwise(9)


def varint_hex(v: Column) -> Column:
    """The varint's bytes in hex."""
    step = lambda i: F.shiftrightunsigned(v, i * 7).bitwiseAND(F.lit(127))
    parts = [F.when(varint_length(v) > i, F.lpad(F.lower(F.hex(step(i) + F.when(varint_length(v) > i + 1, 128).otherwise(0))), 2, "0")).otherwise("") for i in range(10)]
    return F.concat(*parts)


def fixed_hex(v: Column, width: int) -> Column:
    """A little-endian fixed-width integer in hex."""
    full = F.lpad(F.lower(F.hex(v)), 16, "0")
    return F.concat(*(F.substring(full, 15 - 2 * i, 2) for i in range(width)))


def length_prefixed_bytes(s: Column) -> Column:
    """Bytes of a length-prefixed string."""
    n = F.octet_length(s)
    return varint_length(n.cast("long")) + n


def crc_mask(crc: Column) -> Column:
    """Rotate right by 15 bits and add a constant, modulo 2^32."""
    rotated = F.shiftrightunsigned(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(F.lit(0xFFFFFFFF))
    return (rotated + F.lit(CRC_MASK_DELTA)).bitwiseAND(F.lit(0xFFFFFFFF))


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a of an ASCII string, byte by byte."""
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), lambda h, c: ((h.bitwiseXOR(c)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def wal_fragments(size: Column) -> Column:
    """Fragments of a record that starts a block: each block holds 32,768 bytes less a 7-byte header."""
    room = BLOCK_BYTES - HEADER_BYTES
    return F.greatest(F.lit(1), F.ceil(size / room)).cast("long")


def bloom_bits(n: Column, bits_per_key: int) -> Column:
    """Bits of a filter for n keys, in whole bytes, 64 at least."""
    return F.ceil(F.greatest(n * bits_per_key, F.lit(64)) / 8).cast("long") * 8


def bloom_hashes(bits_per_key: int) -> int:
    return min(30, max(1, round(bits_per_key * 0.69)))


def file_name(n: Column, suffix: str) -> Column:
    return F.format_string(f"%06d.{suffix}", n)


def shared_bytes(a: Column, b: Column) -> Column:
    """Length in bytes of the longest common prefix of two strings or binaries."""
    x, y = a.cast("binary"), b.cast("binary")
    n = F.least(F.octet_length(x), F.octet_length(y))
    differs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))
    first = F.array_position(differs, F.lit(True)).cast("int")
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1)


# bytes, in hex: what is written, and read back ------------------------------------------------------------------------


def read_fixed(h: Column, at: Column | int, width: int) -> Column:
    """The little-endian integer of width bytes (up to 8, below 2^63) from byte `at` of a hex string."""
    at = F.lit(at) if isinstance(at, int) else at
    parts = [F.substring(h, 2 * (at + (width - 1 - i)) + 1, F.lit(2)) for i in range(width)]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def read_varint(h: Column, at: Column | int) -> Column:
    """(value, next): the varint from byte `at` of a hex string of values below 2^63, and where it ends; null if it does not."""
    at = F.lit(at) if isinstance(at, int) else at
    byte = lambda i: F.conv(F.substring(h, 2 * (at + i) + 1, F.lit(2)), 16, 10).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, i: Column) -> Column:
        b = byte(i)
        more = F.struct((acc["v"] + F.call_function("shiftleft", b.bitwiseAND(F.lit(127)), i * 7)).alias("v"), (acc["n"] + 1).alias("n"), (b < 128).alias("done"))
        return F.when(acc["done"], acc).otherwise(more)

    out = F.aggregate(F.sequence(F.lit(0), F.lit(8)), start, step)
    return F.when(out["done"], F.struct(out["v"].alias("value"), (at + out["n"]).alias("next")))


def read_prefixed(h: Column, at: Column | int) -> Column:
    """(value, next): the length-prefixed bytes, in hex, from byte `at` of a hex string; null if they are cut off."""
    n = read_varint(h, at)
    end = n["next"] + n["value"].cast("int")
    return F.when(2 * end <= F.length(h), F.struct(F.substring(h, 2 * n["next"] + 1, 2 * n["value"].cast("int")).alias("value"), end.alias("next")))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def encode_entry(cf: Column, op: Column, key: Column, value: Column) -> Column:
    """One entry of a write batch in hex: kind, family, length and bytes of the key, and for a put those of the value."""
    head = F.concat(F.when(op == 0, F.lit(f"{PUT_TAG:02x}")).otherwise(f"{DELETE_TAG:02x}"), fixed_hex(cf.cast("long"), 4), fixed_hex(F.octet_length(key).cast("long"), 4), _hex(key.cast("binary")))
    return F.when(op == 0, F.concat(head, fixed_hex(F.octet_length(value).cast("long"), 4), _hex(value.cast("binary")))).otherwise(head)


def encode_batch(base: Column, entries: Column) -> Column:
    """The bytes of a write batch: tag, first sequence number, number of entries, and the entries (an array of hex strings)."""
    return F.unhex(F.concat(F.lit(f"{BATCH_TAG:02x}"), fixed_hex(base, 8), fixed_hex(F.size(entries).cast("long"), 4), F.array_join(entries, "")))


def let(value: Column, of) -> Column:
    """An expression of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _part(data: Column, at: Column, size: Column | int) -> Column:
    return F.substring(data, at + 1, F.lit(size) if isinstance(size, int) else size)


def _fixed_at(data: Column, at: Column | int, width: int) -> Column:
    """The little-endian integer at a place of a binary; null beyond its end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(at + width <= F.octet_length(data), let(F.hex(_part(data, at, width)), lambda h: read_fixed(h, 0, width)))


def decode_batch(record: Column) -> Column:
    """(base, entries of (cf, op, user_key, value)) of the bytes of a write batch; null if its tag is another, an entry is cut off, unknown, or bytes are left over.

    Whole or not at all: a torn batch gives no entry.
    """
    entry = "array<struct<cf:int,op:int,user_key:binary,value:binary>>"
    begin = F.struct(F.lit(13).alias("at"), F.lit(True).alias("ok"), F.array().cast(entry).alias("out"))

    def step(acc: Column, data: Column, n: Column) -> Column:
        at = acc["at"]
        bad = F.struct(at.alias("at"), F.lit(False).alias("ok"), acc["out"].alias("out"))

        def with_key(x: Column) -> Column:
            put, after = x["kind"] == f"{PUT_TAG:02x}", at + 9 + x["size"]
            value_size = F.when(put, F.least(_fixed_at(data, after, 4), n + 1).cast("int")).otherwise(0)
            return let(F.struct(put.alias("put"), after.alias("after"), value_size.alias("size"), x["kind"].alias("kind"), x["size"].alias("key")), with_value)

        def with_value(y: Column) -> Column:
            end = y["after"] + F.when(y["put"], 4 + y["size"]).otherwise(0)
            one = F.struct(_fixed_at(data, at + 1, 4).cast("int").alias("cf"), F.when(y["put"], 0).otherwise(1).alias("op"), _part(data, at + 9, y["key"]).alias("user_key"), F.when(y["put"], _part(data, y["after"] + 4, y["size"])).alias("value"))
            good = F.struct(end.alias("at"), F.lit(True).alias("ok"), F.concat(acc["out"], F.array(one)).alias("out"))
            return F.when(F.coalesce(y["kind"].isin(f"{PUT_TAG:02x}", f"{DELETE_TAG:02x}") & (end <= n), F.lit(False)), good).otherwise(bad)

        head = F.struct(_hex(_part(data, at, 1)).alias("kind"), F.least(_fixed_at(data, at + 5, 4), n + 1).cast("int").alias("size"))
        return F.when(acc["ok"], let(head, with_key)).otherwise(acc)

    def decoded(r: Column) -> Column:
        data, n, count = r["data"], r["n"], r["count"]
        # an entry has 9 bytes at least: a count beyond that is torn, and is not walked
        places = F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))
        whole = F.aggregate(places, begin, lambda acc, _: step(acc, data, n))
        return let(whole, lambda done: F.when(done["ok"] & (done["at"] == n), F.struct(_fixed_at(data, 1, 8).alias("base"), done["out"].alias("entries"))))

    data = record.cast("binary")
    fits = F.startswith(data, F.lit(bytes([BATCH_TAG]))) & (_fixed_at(data, 9, 4) <= F.ceil(F.octet_length(data) / 9))
    return F.when(F.coalesce(fits, F.lit(False)), let(F.struct(data.alias("data"), F.octet_length(data).alias("n"), _fixed_at(data, 9, 4).alias("count")), decoded))


def decoded_entries(record: Column) -> Column:
    """The entries of a write batch with their sequence numbers: an array of (seq, cf, op, user_key, value), null for what is no whole batch."""
    numbered = lambda b: F.transform(b["entries"], lambda e, i: F.struct((b["base"] + i).alias("seq"), e["cf"].alias("cf"), e["op"].alias("op"), e["user_key"].alias("user_key"), e["value"].alias("value")))
    return let(decode_batch(record), numbered)
