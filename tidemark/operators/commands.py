"""Text commands PING, SET and GET, and any others, as one transform over an ordered command log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .visibility import asof


@dataclass(frozen=True)
class Command:
    """A command that needs no state: its verb, how many arguments it must have, and its reply from the array of them."""

    verb: str
    arguments: int
    reply: Callable[[Column], Column]
    usage: str = ""

    def answer(self, words: Column) -> Column:
        given = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
        return F.when(F.size(words) > self.arguments, self.reply(given)).otherwise(F.lit(f"-ERR {self.verb} needs {self.usage}\r\n"))


PING = Command("PING", 0, lambda _: F.lit("+PONG\r\n"))
SET = Command("SET", 2, lambda _: F.lit("+OK\r\n"), "key value")


def bulk(value: Column) -> Column:
    """A string as a reply of stated length; null is the missing value."""
    return F.when(value.isNull(), "$-1\r\n").otherwise(F.concat(F.lit("$"), F.octet_length(value).cast("string"), F.lit("\r\n"), value, F.lit("\r\n")))


def replies(commands: DataFrame, more: tuple[Command, ...] = ()) -> DataFrame:
    """n, command -> n, reply. A GET sees the last SET of its key before it: an as-of lookup, not a loop."""
    t = F.filter(F.split(F.trim("command"), r"\s+"), lambda x: x != "")
    parsed = commands.select("n", t.alias("t"), F.upper(F.try_element_at(t, F.lit(1))).alias("verb"), F.try_element_at(t, F.lit(2)).alias("key"), F.try_element_at(t, F.lit(3)).alias("arg"))
    sets = parsed.where("verb = 'SET' and arg is not null").select(F.lit(0).alias("cf"), F.col("key").alias("user_key"), F.col("n").alias("seq"), F.lit(0).alias("op"), F.col("arg").alias("value"))
    gets = parsed.where("verb = 'GET' and key is not null").select(F.col("n").alias("request_id"), F.lit(0).alias("cf"), F.col("key").alias("user_key"), F.col("n").alias("at_seq"))
    found = asof(gets, sets).select(F.col("request_id").alias("n"), bulk(F.when(F.col("found_seq").isNotNull(), F.col("value"))).alias("reply"))
    reply = F.when(F.col("verb").isNull(), "-ERR empty command\r\n").when(F.col("verb") == "GET", "-ERR GET needs key\r\n")
    for command in (PING, SET, *more):
        reply = reply.when(F.col("verb") == command.verb, command.answer(F.col("t")))
    rest = parsed.where("verb is null or verb != 'GET' or key is null").select("n", reply.otherwise("-ERR unknown command\r\n").alias("reply"))
    return found.unionByName(rest)
