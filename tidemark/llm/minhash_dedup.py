"""MinHash near-dedup (op10): circulant MinHash, banding, exact Jaccard verification.

A shingle's hash goes through one permutation sigma of 32-bit words; coordinate k of the signature is the minimum of
one further permutation pi at sigma(x) + k, that is, of pi shifted circularly by k: two permutations make all
coordinates. 24 bands of 4 coordinates miss a pair of similarity 0.85 with probability (1 - 0.85^4)^24 = 2e-8.

Rows with equal shingle sets are one class, and only class representatives go on. Buckets are never expanded into all
their pairs. Each bucket has a home pivot, the member that meets the most others, and a large one a second pivot; all
members are compared with the pivots on full sets (`_compared`): a member's set travels to its pivots, and a pivot's set once to each
64 members or so, so no task holds a whole bucket. Links to one pivot connect their members. Every other candidate
pair has a member that is not linked to the home pivot; such pairs are found by what sets the two apart from the pivot
(`_by_deltas`), which rules out nearly all pairs of a group that share a passage or a common origin but are not similar
enough, and compared on full sets too. So every candidate pair is compared, ruled out exactly, or already connected.
Components come from contracting forests in staged tables, in a number of rounds that grows with the logarithm of a path.
Worst case: members of one bucket that are alike in what sets them apart from the pivot, and yet not similar enough to
each other, are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Poly, discard, frugal, mix, pieces, read_table, spread_join, stage, texts, word_spans
from .repeats import identified
from .toxicity import FOLD

_LETTERS, _SHINGLES = Poly(41), Poly(42)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and where each text's begin."""
    folded = FOLD[buf]
    starts, ends, first = word_spans(folded, offsets)
    prefix = _SHINGLES.prefix(_LETTERS.spans(_LETTERS.of_bytes(folded), starts, ends))
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :]) if len(doc) >= width else np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < width))
    h = np.concatenate([_SHINGLES.spans(prefix, at, at + width), _SHINGLES.spans(prefix, first[few], first[few + 1]) ^ n[few].astype(np.uint64)])
    d = np.concatenate([doc[at], few])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.searchsorted(d[new], np.arange(len(n) + 1))


def _scramble(x: np.ndarray) -> np.ndarray:
    """pi: a bijection of 32-bit words (the finaliser of MurmurHash3)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(h: np.ndarray, begin: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of each set that is not empty, as rows."""
    sigma = (mix(h) >> np.uint64(32)).astype(np.uint32)
    cut = begin[:-1][np.diff(begin) > 0]
    out = np.empty((coordinates, len(cut)), np.uint32)
    for k in range(coordinates):
        out[k] = np.minimum.reduceat(_scramble(sigma + np.uint32(k)), cut)
    return out.T


def _sign(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts(batch.column(2))
            for i, j in pieces(offsets, 1 << 18):
                h, begin = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                n = np.diff(begin)
                total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[begin])
                s1, s2 = total(mix(h + np.uint64(1))), total(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                keys = np.zeros((0, bands), np.uint64)
                if len(h):
                    sig = signatures(h, begin, bands * rows).reshape(-1, bands, rows).astype(np.uint64)
                    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(sig), 0)
                    for r in range(rows):
                        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists], names=["doc", "doc_id", "n", "s1", "s2", "bands"])

    return run


_ASKED = "a long, salt int, kind int, home boolean, doc long, shingles array<long>"
_COMPARED = "a long, b long, an long, bn long, home boolean, link boolean, delta array<long>"


def _asked_sets(width: int):
    """The shingle set of each text, once for each comparison it is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts(batch.column(1))
            of, asks = np.asarray(batch.column(2).offsets).astype(np.int64), batch.column(2).values
            for i, j in pieces(offsets, 1 << 18):
                h, begin = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                row = np.repeat(np.arange(j - i), np.diff(of[i : j + 1]))
                size = np.diff(begin)[row]
                at = np.concatenate([[0], np.cumsum(size)])
                # a set that many ask for goes out in several batches
                cuts = np.unique(np.concatenate([[0], np.searchsorted(at, np.arange(0, at[-1], 1 << 18), "right") - 1, [len(row)]]))
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    flat = h[np.repeat(begin[row[lo:hi]] - at[lo:hi], size[lo:hi]) + np.arange(at[lo], at[hi])]
                    lists = pa.ListArray.from_arrays(pa.array((at[lo : hi + 1] - at[lo]).astype(np.int32)), pa.array(flat.view(np.int64)))
                    part = asks.slice(of[i] + lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([*(part.field(f) for f in ("a", "salt", "kind", "home")), batch.column(0)[i:j].take(pa.array(row[lo:hi])), lists], names=["a", "salt", "kind", "home", "doc", "shingles"])

    return run


def _against_pivots(percent: int):
    """Over rows sorted by pivot and salt, the pivot's set first: each member's set against it. Holds one pivot's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, salt, kind, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "salt", "kind", "doc"))
            home, lists = batch.column("home").to_numpy(zero_copy_only=False), batch.column("shingles")
            of, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            out, delta, size = [], [], [0]
            for r in range(len(a)):
                y = flat[of[r] : of[r + 1]]
                if kind[r] == 0:
                    pivot, x = (a[r], salt[r]), y
                    continue
                if pivot != (a[r], salt[r]):
                    raise ValueError("a pivot's set is missing")
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                hit = x[at] == y
                both = int(hit.sum())
                link = 100 * both >= percent * (len(x) + len(y) - both)
                if home[r]:
                    rest = np.ones(len(x), bool)
                    rest[at[hit]] = False
                    delta += [y[~hit], x[rest]]
                    size.append(len(x) + len(y) - 2 * both)
                else:
                    size.append(0)
                out.append((a[r], doc[r], len(x), len(y), bool(home[r]), link))
            if out:
                cols = [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))]
                rest = np.concatenate(delta) if delta else np.zeros(0, np.uint64)
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), pa.array(rest.view(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "an", "bn", "home", "link", "delta"])

    return run


def _compared(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """pairs (a, b, home, m: about how many b an a has) compared on full sets; where home, with the symmetric difference."""
    salt = F.pmod(F.xxhash64("b"), F.least(F.lit(8192), F.ceil(F.col("m") / 64)).cast("long")).cast("int").alias("salt")
    members = pairs.select(F.col("b").alias("doc"), F.struct("a", salt, F.lit(1).alias("kind"), "home").alias("ask"))
    pivots = pairs.select(F.col("a").alias("doc"), F.struct("a", salt, F.lit(0).alias("kind"), F.lit(False).alias("home")).alias("ask")).distinct()
    asks = members.unionAll(pivots).groupBy("doc").agg(F.collect_list("ask").alias("asks"))
    sets = docs.select("doc", "text").join(asks, "doc").mapInArrow(frugal(_asked_sets(width)), _ASKED)
    return sets.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind").mapInArrow(frugal(_against_pivots(percent)), _COMPARED)


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a graph that are not the smallest of their component, and that smallest node."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = inverse[: len(a)], inverse[len(a) :], np.arange(len(nodes))
    while True:
        lu, lv = label[u], label[v]
        least = np.minimum(lu, lv)
        if (lu == lv).all():
            break
        np.minimum.at(label, lu, least)
        np.minimum.at(label, lv, least)
        while (label[label] != label).any():
            label = label[label]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) contracted, about a hundred thousand at a time, to rows (child, root)."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        child, root = contracted(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], names=["child", "root"])

    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
        n += batch.num_rows
        if n >= 1 << 17:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp) for each doc that is connected (edges a, b) with a smaller one: comp is the smallest. A staged table.

    Every round contracts what meets in a task; then each child points to its smallest parent's parent, and its other
    parents point to the smallest. Nothing changes once each child has one parent, and that has none.
    """
    to_forest = lambda e: stage(e.mapInArrow(frugal(_forest), "child long, root long"), "op10-forest")
    forest = to_forest(edges.select(F.col("a").cast("long"), F.col("b").cast("long")))
    while True:
        low = forest.groupBy("child").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        up = low.select(F.col("child").alias("lo"), F.col("lo").alias("far"))
        ahead = low.join(up, "lo", "left").select("child", F.coalesce("far", "lo").alias("root"), F.col("far").isNotNull().alias("moved"))
        others = forest.join(low.where("lo != hi").select("child", "lo"), "child").where("root != lo").select(F.col("root").alias("child"), F.col("lo").alias("root"), F.lit(True).alias("moved"))
        new = stage(ahead.unionAll(others), "op10-labels")
        discard(forest)
        if not new.where("moved").limit(1).count():
            return new.select(F.col("child").alias("doc"), F.col("root").alias("comp"))
        forest = to_forest(new.select("child", "root"))
        discard(new)


def _by_deltas(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one pivot's members (pivot, doc, n, np, comp, out, delta) that may still be linked, by what sets them apart from the pivot.

    Let D be a member's symmetric difference with the pivot's set and t = 1 - percent / 100. Linked x and y differ in at
    most t / (1 - t) |x| shingles, and the symmetric difference of their D is their own. If x is not linked to the pivot
    (out), |D(x)| > t |pivot|, and D(x) and D(y) have at least o > 0 elements in common, o as below. So the
    rarest common element is among the |D| - o + 1 rarest of each: only members that meet there are paired. Where it is
    the i-th and j-th of the two, what comes after must still hold o - 1 common elements.
    """
    t = (100 - percent) / 100
    r, tiny = t / (1 - t), 1e-6
    members = stage(members, "op10-deltas")
    each = members.select("pivot", "doc", F.explode("delta").alias("s"))
    often = stage(each.groupBy("pivot", "s").agg(F.count("*").alias("df")).where("df > 1"), "op10-often")  # an element of one member alone joins nothing, but is the rarest
    shared = spread_join(each, often, ["pivot", "s"], "df")
    ranked = shared.groupBy("pivot", "doc").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("all"))
    d, alone = F.size("delta"), F.size("delta") - F.size("all")
    over = d - r * F.col("n") - tiny
    as_x = d - F.greatest(F.lit(1), F.ceil(over)) + 1
    as_y = d - F.greatest(F.lit(1), F.ceil(over), F.ceil((over + t * F.col("np")) / 2)) + 1
    placed = members.join(ranked, ["pivot", "doc"]).select("pivot", "doc", "n", "comp", "out", as_x.alias("kx"), as_y.alias("ky"), d.alias("d"), alone.alias("alone"), F.posexplode("all").alias("p", "e"))
    rare = stage(placed.withColumn("i", F.col("p") + F.col("alone")).where("i < greatest(kx, ky)").select("pivot", "doc", "n", "comp", "out", "i", "d", "kx", "ky", "e.s"), "op10-rare")
    discard(members, often)
    left = rare.where("out and i < kx").select("pivot", "s", F.col("doc").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("i").alias("ai"), F.col("d").alias("ad"))
    right = rare.where("i < ky").select("pivot", "s", F.col("doc").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"), F.col("i").alias("bi"), F.col("d").alias("bd"))
    enough = 2 * F.least(F.col("ad") - F.col("ai"), F.col("bd") - F.col("bi")) >= F.col("ad") + F.col("bd") - r * F.least("an", "bn") - tiny
    close = 100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")
    pairs = left.join(right, ["pivot", "s"]).where((F.col("ac") != F.col("bc")) & close & enough)
    out = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "op10-pairs")
    discard(rare)
    return out


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, bands: int = 24, rows: int = 4, width: int = 3, second_pivot: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each input row; shingles are of `width` words.

    Null text or a text without words has an empty set and is linked with nothing; its component is its own. Equal sets are
    linked. Rows that share an id are documents of their own for linking. Null ids come last, so such a row owns a
    component only where no other id does; component_id is then null. Buckets of more than second_pivot members have
    two pivots. Other columns are ignored; an empty table gives an empty result.
    """
    texts_of, same = identified(docs, id_col, text_col), ["n", "s1", "s2"]
    sig = stage(texts_of.mapInArrow(frugal(_sign(bands, rows, width)), "doc long, doc_id long, n long, s1 long, s2 long, bands array<long>"), "op10-signatures")
    first = sig.where("n > 0").groupBy(*same).agg(F.min(F.struct("doc", "doc_id", "bands")).alias("r"), F.count("*").alias("rows"))
    classes = stage(first.select(*same, "rows", "r.doc", "r.doc_id", "r.bands"), "op10-classes")
    reps = classes.select("doc", F.explode("bands").alias("key"))
    full = stage(reps.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "op10-full")
    # the member that meets the most others in all its buckets is the likeliest centre of a group of copies
    met = spread_join(reps, full, ["key"], "m").groupBy("doc").agg(F.sum("m").alias("met"), F.collect_list(F.struct("key", "m")).alias("of"))
    member = stage(met, "op10-members")
    placed = member.select("doc", "met", F.explode("of").alias("b")).select("doc", "met", "b.key", "b.m")
    best = lambda half: F.max(F.when(F.pmod(F.xxhash64("doc"), F.lit(2)) == half, F.struct("met", (-F.col("doc")).alias("early"))))
    top = placed.groupBy("key").agg(F.first("m").alias("rows"), best(0).alias("p"), best(1).alias("q"))
    pivots = stage(top.select("key", "rows", (-F.greatest("p", "q")["early"]).alias("home"), F.when(F.col("rows") > second_pivot, -F.least("p", "q")["early"]).alias("other")), "op10-pivots")
    met = spread_join(placed, pivots, ["key"], "rows")
    asked = met.select("doc", "m", F.explode(F.array(F.struct(F.col("home").alias("a"), F.lit(True).alias("home")), F.struct(F.col("other").alias("a"), F.lit(False).alias("home")))).alias("p")).where("p.a is not null and p.a != doc")
    pairs = asked.groupBy(F.col("p.a").alias("a"), F.col("doc").alias("b")).agg(F.max("p.home").alias("home"), F.max("m").alias("m"))
    star = stage(_compared(pairs, texts_of, percent, width), "op10-star")
    discard(full, member, pivots)
    comp = components(star.where("link"))
    # members of home pivots that are not linked to all of theirs
    own = star.where("home")
    apart = stage(own.groupBy("a").agg(F.count("*").alias("m"), F.sum((~F.col("link")).cast("long")).alias("far")).where("far > 0 and m > 1").drop("far"), "op10-apart")
    found = spread_join(own, apart, ["a"], "m").select(F.col("a").alias("pivot"), F.col("b").alias("doc"), F.col("bn").alias("n"), F.col("an").alias("np"), (~F.col("link")).alias("out"), "delta")
    more = _by_deltas(found.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc")), percent)
    if more.limit(1).count():
        links = stage(_compared(more.select("a", "b", F.lit(False).alias("home"), F.lit(4096).alias("m")), texts_of, percent, width).where("link").select("a", "b"), "op10-links")
        if links.limit(1).count():
            comp = components(comp.select(F.col("doc").alias("a"), F.col("comp").alias("b")).unionAll(links))
    size = comp.groupBy("comp").agg(F.count("*").alias("m"))
    owners = stage(classes.select(F.col("doc").alias("comp"), F.struct(F.col("doc_id").alias("id")).alias("owner")).join(size, "comp"), "op10-owners")
    child = spread_join(comp, owners, ["comp"], "m").select("doc", "owner")
    label = stage(classes.join(child, "doc", "left").select(*same, "rows", F.coalesce("owner", F.struct(F.col("doc_id").alias("id"))).alias("owner")), "op10-labels")
    discard(star, apart, more)
    out = spread_join(sig.where("n > 0").drop("bands"), label, same, "rows").select("doc_id", F.col("n").alias("n_shingles"), F.col("owner.id").alias("component_id"))
    out = out.unionAll(sig.where("n = 0").select("doc_id", "n", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(read_table(spark, sf_dir, "documents"))
