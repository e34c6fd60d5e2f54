"""Schemas, operation codes and errors of the versioned key-value model."""

from __future__ import annotations

from pyspark.sql import types as T

PUT, DELETE = 0, 1
CF_USER, CF_SYSTEM = 0, 1
CF_NAMES = {CF_USER: "cf_user", CF_SYSTEM: "cf_system"}
LEVELS = 7

LOG = T.StructType([
    T.StructField("cf", T.IntegerType(), False),
    T.StructField("user_key", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.IntegerType(), False),
    T.StructField("value", T.BinaryType(), True),
])


class StoreError(Exception):
    """The base of all errors of the store."""


class StoreIOError(StoreError): ...


class ConfigError(StoreError): ...


class InvalidKeyOrder(StoreError): ...


class EmptyTable(StoreError): ...


class Corruption(StoreError): ...


class InvalidArgument(StoreError): ...


class UnknownColumnFamily(StoreError): ...


class NotFound(StoreError): ...


class InvalidColumnFamily(StoreError): ...


def cf_type(number: int) -> str:
    """The kind of family that a number names in a log entry: user or system."""
    if number not in CF_NAMES:
        raise InvalidColumnFamily(str(number))
    return CF_NAMES[number].removeprefix("cf_")
