"""Mixing sources to target weights (op8): Sainte-Laguë apportionment of equal-token blocks.

Documents are dealt by a hash of their id to shards of their source, laid end to end in a shard, and cut in
blocks of equal tokens. Sources get their blocks by highest quotients of their targets, then the shards of
a source by highest quotients of their sizes: integer quotas whose sums are exact. In a shard a seeded
permutation of the block numbers chooses which blocks are taken (once more for a quota above one pass).
Only sizes of sources and shards reach the driver, a row for each: shards are at most max_shards plus one
for each source. They are broadcast if there are at most most_broadcast sources, and joined by a shuffle if there are more.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stage, unused, words_of


def water_fill(sizes: list[float], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of total by weight; a share stops at most times its size and the excess is shared again."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest, weight = total - sum(out[i] for i in range(len(sizes)) if i not in free), sum(weights[i] for i in sorted(free))
        above = [i for i in sorted(free) if rest * weights[i] / weight > most * sizes[i]]
        if not above:
            for i in free:
                out[i] = rest * weights[i] / weight
            break
        for i in above:
            out[i] = float(most * sizes[i])
            free.discard(i)
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1), none above its cap; ties go to the earlier party."""
    seats = min(seats, sum(caps))
    total = sum(votes)
    if seats <= 0 or total <= 0:
        return [0] * len(votes)
    # no party has fewer than this by the divisor method, up to a seat or so: the rest go one by one
    got = [max(0, min(c, math.floor(v * seats / total) - 1)) for v, c in zip(votes, caps)]
    heap = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, got, caps)) if g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5, most: float = 2.0, shard_words: int = 1_000_000, max_shards: int = 8192, most_broadcast: int = 100_000, seed: int = 7, row_col: str | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken for each input row.

    Null text has size 0 and nothing is taken of it; a null source is a source of its own, the last. Rows that
    share an id are laid in one shard, side by side, and each is taken by the blocks it lies in. A null id is an
    id. Other columns are ignored; an empty table gives an empty result. With row_col, a column that tells rows
    apart, the result has that column, the source and the shard too.
    """
    spark, row = docs.sparkSession, [] if row_col is None else [row_col]
    sizes = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_of(text_col).alias("size"), *row), "op8")
    per = sorted(((r.source, r.n) for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    total = sum(n for _, n in per)
    targets = water_fill([n for _, n in per], [weights[i % len(weights)] for i in range(len(per))], share * total, most)
    least = min((t for t in targets if t > 0), default=0)
    block = int(min(1024, max(16, least // 200)))
    shards = [max(1, min(math.ceil(n / shard_words), max(1, max_shards * n // max(total, 1)))) for _, n in per]
    dealt = spark.createDataFrame([(s, n, t, k) for (s, n), t, k in zip(per, targets, shards)], "source string, source_size long, target double, shards int")
    small = len(per) <= most_broadcast
    deal = lambda left, right, on: left.join(F.broadcast(right) if small else right, on)
    s, d = sizes.alias("s"), dealt.alias("d")
    placed = deal(s, d, F.col("s.source").eqNullSafe(F.col("d.source"))).select(
        "doc_id", "s.source", "size", "source_size", "target", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards").cast("long")).cast("int").alias("shard"), *row
    )
    each = {(r.source, r.shard): r.n for r in placed.groupBy("source", "shard").agg(F.sum("size").alias("n")).collect()}
    by_source = {k: sainte_lague([t], round(t / block), [2 * -(-n // block)])[0] for (k, n), t in zip(per, targets)} if len(per) == 1 else {
        k: q for (k, _), q in zip(per, sainte_lague(targets, round(sum(targets) / block), [2 * -(-n // block) for _, n in per]))
    }
    quotas, members = [], {}
    for key, n in sorted(each.items(), key=lambda x: (x[0][0] is None, x[0][0] or "", x[0][1])):
        members.setdefault(key[0], []).append((key[1], n))
    for source, of in members.items():
        blocks = [-(-n // block) for _, n in of]
        for (shard, _), n, q in zip(of, blocks, sainte_lague([float(n) for _, n in of], by_source[source], [int(most) * b for b in blocks])):
            if n:
                step = next(a for a in range(int(0.618 * n) | 1, 2 * n + 3) if math.gcd(a, n) == 1)
                quotas.append((source, shard, n, q, step, hash((seed, shard)) % n))
    table = spark.createDataFrame(quotas, "source string, shard int, blocks long, quota long, step long, shift long")
    order = Window.partitionBy("source", "shard").orderBy("doc_id", "size", *row)
    laid = placed.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    p, q = laid.alias("p"), table.alias("q")
    joined = p.join(F.broadcast(q) if small else q, F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.shard") == F.col("q.shard")), "left")
    start, end = F.col("end") - F.col("size"), F.col("end")

    def of_block(j: "F.Column") -> "F.Column":
        times = F.expr("quota div blocks") + F.when(F.pmod(F.col("step") * j + F.col("shift"), F.col("blocks")) < F.col("quota") % F.col("blocks"), 1).otherwise(0)
        return (F.least(end, (j + 1) * block) - F.greatest(start, j * block)) * times

    taken = F.when(
        (F.col("size") > 0) & F.col("blocks").isNotNull(),
        F.aggregate(F.sequence(F.floor(start / block), F.floor((end - 1) / block)), F.lit(0).cast("long"), lambda acc, j: acc + of_block(j)),
    ).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *row, *(["p.source", "p.shard"] if row else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as its taken words come to, rounded up or down so that the words of a shard come to what the mix takes of it.

    It has the columns of docs, whatever their names. A document of no words (null or empty text) stays once. Rows that share an id, null or not, are documents
    of their own: each has its own plan. An empty table stays empty. A staged table numbers the rows, so that the plan meets its row again. What is left over
    of whole copies is rounded along each shard, in order of sizes, from a seeded start: systematic sampling, so a shard is off by about a document.
    """
    seed, key, times = options.get("seed", 7), unused(docs.columns, "row"), unused(docs.columns, "times")
    rows = stage(docs.withColumn(key, F.monotonically_increasing_id()), "op8-rows")
    plan = mix_sources(rows, row_col=key, **options)
    share = F.when(F.col("size") == 0, 1.0).otherwise(F.col("taken") / F.col("size"))
    order = Window.partitionBy("source", "shard").orderBy("size", F.xxhash64("doc_id", F.lit(seed)), key).rowsBetween(Window.unboundedPreceding, 0)
    whole = plan.select(key, "source", "shard", "size", "doc_id", F.floor(share).alias("whole"), (share - F.floor(share)).alias("rest"))
    start = F.pmod(F.xxhash64("source", "shard", F.lit(seed + 1)), F.lit(1 << 20)) / float(1 << 20)
    upto = F.sum("rest").over(order) + start
    rounded = F.floor(upto + 1e-9) - F.floor(upto - F.col("rest") + 1e-9)
    chosen = whole.select(key, (F.col("whole") + rounded).cast("int").alias(times)).where(F.col(times) > 0)
    return rows.join(chosen, key).withColumn(key, F.explode(F.sequence(F.lit(1), F.col(times)))).select([F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))
