"""Filters of keys: a policy says how a file's filter is built and asked; Bloom filters are the one that is built in.

A filter is a table of 64-bit words of its bit array, one row for each word that is not zero: it is built by one aggregation, of any size, and
filters of the same size merge by or.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec


class FilterPolicy(ABC):
    """What a filter implementation gives: a name, the filters of files, and which probes may be in which file."""

    name: str

    @abstractmethod
    def build(self, keys: DataFrame, by: list[str]) -> DataFrame:
        """Filters of the distinct user_key of each group."""

    @abstractmethod
    def may_match(self, probes: DataFrame, filters: DataFrame, by: list[str]) -> DataFrame:
        """The probes (by, user_key) that their group's filter lets through; never too few."""


class BloomFilter(FilterPolicy):
    """bits_per_key bits a key; positions by double hashing of FNV-1a."""

    name = "bloom"

    def __init__(self, bits_per_key: int = 10):
        self.bits_per_key, self.hashes = bits_per_key, codec.bloom_hashes(bits_per_key)

    def _places(self, bits: Column) -> Column:
        h = codec.fnv1a(F.col("user_key"))
        delta = F.shiftright(h, 17).bitwiseOR(F.shiftleft(h, 15).bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.array_distinct(F.array(*(F.pmod((h + i * delta).bitwiseAND(F.lit(0xFFFFFFFF)), bits) for i in range(self.hashes))))

    def build(self, keys: DataFrame, by: list[str]) -> DataFrame:
        own = keys.select(*by, "user_key").distinct()
        sized = own.join(own.groupBy(*by).agg(codec.bloom_bits(F.count("*"), self.bits_per_key).alias("bits")), by)
        each = sized.select(*by, "bits", F.explode(self._places(F.col("bits"))).alias("place"))
        return each.groupBy(*by, "bits", F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place % 64 AS INT))")).alias("set"))

    def may_match(self, probes: DataFrame, filters: DataFrame, by: list[str]) -> DataFrame:
        sizes = filters.select(*by, "bits").distinct()
        each = probes.select(*by, "user_key").distinct().join(sizes, by).select(*by, "user_key", F.explode(self._places(F.col("bits"))).alias("place"))
        asked = each.withColumn("word", F.floor(F.col("place") / 64))
        found = asked.join(filters.drop("bits"), [*by, "word"], "left").withColumn("hit", F.coalesce(F.expr("shiftright(set, CAST(place % 64 AS INT)) & 1 = 1"), F.lit(False)))
        return found.groupBy(*by, "user_key").agg(F.every("hit").alias("hit")).where("hit").drop("hit")


#: The policies a store's options can name.
POLICIES: dict[str, type[FilterPolicy]] = {"bloom": BloomFilter}
