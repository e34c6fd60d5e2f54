"""Exact repeats of a fixed length, found by content-defined phrases; substring dedup and suffix-array dedup stand on it.

A text is a sequence of symbols (words or bytes). A rolling hash runs over all k-grams; in every window of
`win` symbols the leftmost smallest hash is its trigger. Consecutive windows with one trigger form a phrase (their
starts, and the symbols from the first start to the last end), so each window of a text lies in exactly one
phrase, and equal windows have equal triggers at equal places: to find repeats only phrases with equal triggers
need comparing. A phrase row is (g: hash of the trigger, c: independent hash of the phrase, document, start, n
windows); rows are combined in a task before any shuffle, so a phrase travels once for about 5 MB of text, however
often it occurs.

One exchange by trigger and one walk over its sorted rows (`_walk`) settles all phrases: one that is alone under its trigger
has no repeated window; equal phrases repeat all their windows; where a trigger has different phrases, one
occurrence of each is asked for, their symbols are brought together by trigger, and their windows put in suffix order (`window_ranks`):
by their symbols, not by hash. A trigger with many rows is salted in the exchange; one with more than MANY different
phrases has its windows told apart by an aggregation over rows instead of in one task's memory. The result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Poly, arrow_batches, discard, mix, pieces, spread_join, stage, texts, word_spans

#: A trigger with more different phrases is not held in one task's memory (a phrase is under 600 bytes).
MANY = 256
#: One phrase in SAMPLE tells which triggers have many rows: those that it meets HOT times.
SAMPLE, HOT = 64, 64
_LOW = np.uint64(0xFFFFFFFF)
_TRIGGER, _PHRASE, _LETTERS = Poly(31), Poly(32), Poly(33)


@dataclass(frozen=True)
class Unit:
    """What a symbol is, the length of a window and of a k-gram."""

    words: bool
    win: int
    k: int
    piece: int

    def symbols(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit code of each symbol, and where each document's symbols begin."""
        if not self.words:
            return _LETTERS.codes[buf], offsets
        starts, ends, first = word_spans(buf, offsets)
        return _LETTERS.spans(_LETTERS.of_bytes(buf), starts, ends), first


WORDS = Unit(True, 20, 6, 1 << 20)
BYTES = Unit(False, 200, 64, 1 << 19)


def _argmin(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the leftmost smallest of each w neighbours, judged by the hash's upper half."""
    n, m = len(h) - w + 1, -(-len(h) // w)
    key = np.full(m * w, np.iinfo(np.uint64).max, np.uint64)
    key[: len(h)] = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    rows = key.reshape(m, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & _LOW).astype(np.int64)


def phrases(codes: np.ndarray, bounds: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Document, start, n, g, c of the phrases of a piece."""
    n, win, k = len(codes), unit.win, unit.k
    if n < win:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix, at = _TRIGGER.prefix(codes), np.arange(n - k + 1)
    h = _TRIGGER.spans(prefix, at, at + k)
    trigger = _argmin(h, win - k + 1)
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    valid = np.flatnonzero(doc[: n - win + 1] == doc[win - 1 :])
    if not len(valid):
        return phrases(codes[:0], bounds, unit)
    tv, dv = trigger[valid], doc[valid]
    new = np.flatnonzero(np.concatenate([[True], (tv[1:] != tv[:-1]) | (dv[1:] != dv[:-1])]))
    start, count = valid[new], np.diff(np.append(new, len(valid)))
    t, d = tv[new], dv[new].astype(np.int64)
    c = _PHRASE.spans(_PHRASE.prefix(codes), start, start + count + win - 1)
    c = mix(c + (t - start).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64))
    return d, start - bounds[d], count, h[t], c


def _combine(keys: tuple[np.ndarray, ...], order_by: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with equal keys, the first by order_by, how many there are, and all the others."""
    order = np.lexsort((*order_by[::-1], *keys[::-1]))
    if not len(order):
        return order, order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order))), order[~new]


def _merge(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join ranges of a document that follow each other."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    if not len(doc):
        return doc, start, n
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + n[:-1])])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], start[last] + n[last] - start[at]


_ROW = "doc long, start int, n int, g long, c long, cnt int, old boolean"


def _rows(doc, start, n, g, c, cnt, old=None) -> pa.RecordBatch:
    signed = lambda x: pa.nulls(len(doc), pa.int64()) if x is None else pa.array(x.view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), signed(g), signed(c), pa.array(cnt.astype(np.int32)), pa.array(np.zeros(len(doc), bool) if old is None else old)],
        names=["doc", "start", "n", "g", "c", "cnt", "old"],
    )


def _phrase_rows(unit: Unit) -> Callable:
    """For each hundred thousand phrases or so of a task: a row for each different one (cnt: 2 if it has more), and ranges (g null) of the other occurrences."""

    def combined(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, start, n, g, c = (np.concatenate(x) for x in zip(*held))
        first, count, rest = _combine((g, c), (doc, start))
        yield _rows(doc[first], start[first], n[first], g[first], c[first], np.minimum(count, 2))
        if len(rest):
            doc, start, n = _merge(doc[rest], start[rest], n[rest])
            yield _rows(doc, start, n, None, None, np.ones(len(doc)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, offsets = texts(batch.column(1))
            for i, j in pieces(offsets, unit.piece):
                codes, bounds = unit.symbols(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                d, start, n, g, c = phrases(codes, bounds, unit)
                held.append((ids[i:j][d], start, n, g, c))
                size += len(d)
                if size >= 1 << 17:
                    yield from combined(held)
                    held, size = [], 0
        if size:
            yield from combined(held)

    return run


_WALKED = "kind int, doc long, start int, n int, g long, c long, cnt int, old boolean"
#: The rows of a walk: a range of repeats; a phrase whose windows must be compared; a phrase the index does not have.
RANGE, ASK, FRESH = 0, 1, 2


def _walk(keep_first: bool, fresh: bool, salted: bool = False, most: int = 1 << 17) -> Callable:
    """Over phrase rows sorted by g, c, old first, document, start: what becomes of each.

    Whole triggers are taken together. One with more than `most` rows is cut between its phrases and counts as having different ones,
    as all do if other tasks may hold more of them (salted): that costs comparisons but changes no result.
    """
    names = ["doc", "start", "n", "g", "c", "cnt", "old"]

    def settle(rows: list[np.ndarray], forced: int | None) -> Iterator[pa.RecordBatch]:
        doc, start, n, g, c, cnt, old = rows
        if not len(g):
            return
        newg = np.ones(len(g), bool)
        newg[1:] = g[1:] != g[:-1]
        newc = newg.copy()
        newc[1:] |= c[1:] != c[:-1]
        head = np.flatnonzero(newc)
        cls, of_g = np.cumsum(newc) - 1, (np.cumsum(newg) - 1)[head]
        total = np.add.reduceat(cnt.astype(np.int64), head)
        mixed = (np.bincount(of_g) > 1)[of_g] | salted
        if forced is not None:
            mixed |= g[head] == forced
        repeat = total[cls] >= 2
        if keep_first:
            repeat &= ~newc
        repeat &= ~old
        times = np.ones(len(head), np.int64) if keep_first else np.minimum(total, 2)
        parts = [(RANGE, np.flatnonzero(repeat), None), (ASK, head[mixed], times[mixed])]
        if fresh:
            parts.append((FRESH, head[~old[head]], None))
        at = np.concatenate([p for _, p, _ in parts])
        kind = np.repeat([k for k, _, _ in parts], [len(p) for _, p, _ in parts]).astype(np.int32)
        times = np.concatenate([np.ones(len(p), np.int64) if t is None else t for _, p, t in parts])
        cols = [kind, doc[at], start[at], n[at], g[at], c[at], times.astype(np.int32), old[at]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[f.split()[0] for f in _WALKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, forced = 0, None
        for batch in batches:
            held.append([batch.column(f).to_numpy(zero_copy_only=False) for f in names])
            held[-1][6] = held[-1][6].astype(bool)
            size += batch.num_rows
            if size < most:
                continue
            rows = [np.concatenate(x) for x in zip(*held)]
            g, c = rows[3], rows[4]
            change = np.flatnonzero(g[1:] != g[:-1])
            if len(change):
                cut = int(change[-1]) + 1
            else:
                change = np.flatnonzero(c[1:] != c[:-1])
                cut, forced = (int(change[-1]) + 1 if len(change) else 0), g[0]
            yield from settle([x[:cut] for x in rows], forced)
            held, size = [[x[cut:] for x in rows]], len(g) - cut
        if size:
            yield from settle([np.concatenate(x) for x in zip(*held)], forced)

    return run


_BODY = "doc long, start int, n int, g long, cnt int, old boolean, many boolean, body binary"


def _bodies(unit: Unit) -> Callable:
    """The asked phrases themselves: a word is its 64-bit code, a byte is itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, old = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            buf, offsets = texts(batch.column(2))
            of, fields = np.asarray(batch.column(3).offsets), batch.column(3).values
            start, n, g, cnt, many = (fields.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n", "g", "cnt", "many"))
            for i, j in pieces(offsets, unit.piece):
                part, cut = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                codes, bounds = unit.symbols(part, cut) if unit.words else (part, cut)
                lo, hi = of[i], of[j]
                d = np.repeat(np.arange(j - i), np.diff(of[i : j + 1]))
                size = n[lo:hi].astype(np.int64) + unit.win - 1
                at = np.concatenate([[0], np.cumsum(size)])
                flat = codes[np.repeat(bounds[d] + start[lo:hi] - at[:-1], size) + np.arange(at[-1])]
                body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((at * flat.itemsize).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][d]), pa.array(start[lo:hi]), pa.array(n[lo:hi]), pa.array(g[lo:hi]), pa.array(cnt[lo:hi]), pa.array(old[i:j][d].astype(bool)), pa.array(many[lo:hi].astype(bool)), body], names=[f.split()[0] for f in _BODY.split(", ")])

    return run


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows of one or two keys, from 0; equal rows have equal ranks."""
    out = np.unique(keys[0], return_inverse=True)[1]
    for k in keys[1:]:
        out = np.unique((out.astype(np.uint64) << np.uint64(32)) | np.unique(k, return_inverse=True)[1].astype(np.uint64), return_inverse=True)[1]
    return out


def window_ranks(codes: np.ndarray, win: int) -> np.ndarray:
    """For each place of a sequence of symbols (bytes, or 64-bit codes of words), the rank of the win symbols from there on: a suffix array cut at win, by prefix doubling."""
    n = len(codes)
    if n < win:
        return np.zeros(0, np.int64)
    if codes.dtype == np.uint8:
        k, rank = 8, np.zeros(n - 7, np.uint64)
        for i in range(8):
            rank = (rank << np.uint64(8)) | codes[i : n - 7 + i]
    else:
        k, rank = 1, codes
    while 2 * k <= win:
        rank = _dense(rank[:-k], rank[k:])
        k *= 2
    return _dense(rank) if k == win else _dense(rank[: n - win + 1], rank[win - k : n - k + 1])


def _windows(batch: pa.RecordBatch, unit: Unit, ranks: bool) -> tuple[np.ndarray, ...]:
    """Document, place, trigger, rank among the batch's windows (or hash), number of occurrences and age of each window of a batch of bodies."""
    buf, offsets = texts(batch.column("body"))
    codes, bounds = (buf.view(np.uint64), offsets // 8) if unit.words else (buf, offsets)
    doc, start, n, g, cnt, old = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "start", "n", "g", "cnt", "old"))
    size = n.astype(np.int64)
    row = np.repeat(np.arange(len(n)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    p = bounds[:-1][row] + at
    if ranks:
        c = window_ranks(codes, unit.win)[p] if len(p) else p
    else:
        c = _PHRASE.spans(_PHRASE.prefix(codes if unit.words else _LETTERS.codes[codes]), p, p + unit.win)
    return doc[row], start.astype(np.int64)[row] + at, g.view(np.uint64)[row], c, cnt[row].astype(np.int64), old[row].astype(bool)


def _within_triggers(unit: Unit, keep_first: bool, most: int = 1 << 22, step: int = 4096) -> Callable:
    """Over bodies sorted by trigger: the ranges of repeated windows. Whole triggers are taken together, up to `most` bytes or one trigger."""

    def ranges(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, at, g, c, cnt, old = _windows(batch, unit, True)
        if not len(doc):
            return
        order = np.lexsort((at, doc, old == 0, c, g))
        new = np.ones(len(order), bool)
        new[1:] = (g[order][1:] != g[order][:-1]) | (c[order][1:] != c[order][:-1])
        head = np.flatnonzero(new)
        total = np.add.reduceat(cnt[order], head)
        twice = np.repeat(total >= 2, np.diff(np.append(head, len(order))))
        found = order[twice & ~new] if keep_first else order[twice]
        found = found[~old[found]]
        d, s, n = _merge(doc[found], at[found], np.ones(len(found), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc", "start", "n"])

    def steps(held: pa.RecordBatch, g: np.ndarray, last: int) -> Iterator[pa.RecordBatch]:
        """The rows before `last` in small steps, cut between triggers; each begins where the one before ended."""
        i = 0
        while i < last:
            j = last if i + step >= last else int(np.searchsorted(g, g[i + step]))
            j = j if j > i else int(np.searchsorted(g, g[i], "right"))
            yield from ranges(held.slice(i, j - i))
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            held = table.to_batches()[0] if table.num_rows else None
            if held is None or held.nbytes < most:
                continue
            g = held.column("g").to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(g, g[-1]))  # the last trigger may go on in the next batch
            yield from steps(held, g, last)
            held = held.slice(last)
        if held is not None:
            g = held.column("g").to_numpy(zero_copy_only=False)
            yield from steps(held, g, len(g))

    return run


def _one_by_one(unit: Unit) -> Callable:
    """Every window of the bodies as a row, combined within the batch: for triggers with very many phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                doc, at, g, c, cnt, old = _windows(whole.slice(i, 1024), unit, False)
                first, count, rest = _combine((g, c), (~old, doc, at))
                if not len(first):
                    continue
                most = np.maximum.reduceat(cnt[np.lexsort((at, doc, ~old, c, g))], np.cumsum(count) - count)
                yield _rows(doc[first], at[first], np.ones(len(first)), g[first], c[first], np.minimum(np.maximum(count, most), 2), old[first])
                rest = rest[~old[rest]]
                if len(rest):
                    d, s, n = _merge(doc[rest], at[rest], np.ones(len(rest), np.int64))
                    yield _rows(d, s, n, None, None, np.ones(len(d)))

    return run


def phrase_table(docs: DataFrame, unit: Unit) -> DataFrame:
    """docs: doc (a unique long), text."""
    return docs.select("doc", "text").mapInArrow(_phrase_rows(unit), _ROW)


def repeated(rows: DataFrame, docs: DataFrame, unit: Unit, keep_first: bool, fresh: bool = False, many: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranges (doc, start, n) of the starts of repeated windows; with keep_first, a window's first occurrence is not one.

    rows is a staged phrase_table, with phrases of earlier documents marked old; docs has the texts (doc, old, text) of
    all documents that rows mention. Both results are staged tables; the second has the phrases that no old row has, if fresh.
    """
    many = MANY if many is None else many
    here = rows.where("g is not null")
    columns = ["doc", "start", "n", "g", "c", "cnt", "old"]
    settled = lambda part, salt: part.repartition("g", *salt).sortWithinPartitions("g", "c", F.desc("old"), "doc", "start").select(columns).mapInArrow(_walk(keep_first, fresh, bool(salt)), _WALKED)
    # a trigger with very many rows is dealt out by phrase too; a sample of all phrases tells which they are, as that decides nothing else
    total = here.count()
    hot = stage(here.where(F.pmod(F.col("c"), F.lit(SAMPLE)) == 0).groupBy("g").count().where(F.col("count") >= max(HOT, total // (10_000 * SAMPLE))).select("g"), "repeats-hot")
    if hot.limit(1).count():
        salt = F.pmod(F.shiftright("c", 7), F.lit(64)).alias("salt")
        parts = settled(here.join(F.broadcast(hot), "g", "left_anti"), []).unionAll(settled(here.join(F.broadcast(hot), "g", "left_semi").select(*columns, salt), ["salt"]))
    else:
        parts = settled(here, [])
    walked = stage(parts, "repeats-walked")
    asks = walked.where(F.col("kind") == ASK).select("doc", "start", "n", "g", "cnt")
    per = stage(asks.groupBy("g").agg(F.count("*").alias("m")), "repeats-triggers")
    flagged = spread_join(asks, per, ["g"], "m").select("doc", F.struct("start", "n", "g", "cnt", (F.col("m") > many).alias("many")).alias("one"))
    wanted = flagged.groupBy("doc").agg(F.collect_list("one").alias("asked"))
    bodies = stage(docs.join(wanted, "doc").select("doc", "old", "text", "asked").mapInArrow(_bodies(unit), _BODY), "repeats-bodies")
    few = bodies.where("not many").repartition("g").sortWithinPartitions(F.col("g")).mapInArrow(_within_triggers(unit, keep_first), "doc long, start int, n int")
    out = rows.where("g is null").select("doc", "start", "n").unionAll(walked.where(F.col("kind") == RANGE).select("doc", "start", "n")).unionAll(few)
    windows = None
    if per.where(F.col("m") > many).limit(1).count():
        windows = stage(bodies.where("many").mapInArrow(_one_by_one(unit), _ROW), "repeats-windows")
        single = windows.where("g is not null")
        first = F.struct((~F.col("old")).alias("new"), "doc", "start")
        same = stage(single.groupBy("g", "c").agg(F.sum("cnt").alias("total"), F.count("*").alias("rows"), F.min(first).alias("first")).where("total >= 2"), "repeats-same")
        met = spread_join(single.where("not old"), same, ["g", "c"], "rows")
        at_first = (F.col("first.doc") == F.col("doc")) & (F.col("first.start") == F.col("start"))
        out = out.unionAll(windows.where("g is null").select("doc", "start", "n")).unionAll((met.where(~at_first) if keep_first else met).select("doc", "start", "n"))
    out = stage(out, "repeats-ranges")
    discard(hot, per, bodies, *([windows] if windows is not None else []))
    new = walked.where(F.col("kind") == FRESH).select("doc", "start", "n", "g", "c")
    new.scratch_path = walked.scratch_path
    return out, new


def finish(docs: DataFrame, ranges: DataFrame, unit: Unit, kernel: Callable, schema: str) -> DataFrame:
    """Apply kernel to every document and its ranges, merged into a list by document."""
    per = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts(batch.column(1))
            lists = batch.column(2)
            size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            flat = lists.flatten()
            start, n = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "n"))
            at = np.concatenate([[0], np.cumsum(size)])
            for i, j in pieces(offsets, unit.piece):
                d = np.repeat(np.arange(j - i), size[i:j])
                yield kernel(batch.column(0)[i:j], buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], d, start[at[i] : at[j]], n[at[i] : at[j]])

    return docs.join(per, "doc", "left").select("doc_id", "text", "ranges").mapInArrow(run, schema)


def covered(total: int, bounds: np.ndarray, d: np.ndarray, start: np.ndarray, n: np.ndarray, win: int) -> np.ndarray:
    """Which symbols of a piece lie in a window that starts in one of the ranges."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, bounds[d] + start, 1)
    np.add.at(edge, bounds[d] + start + n + win - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (unique, in the order of documents), doc_id, text.

    Where ids are unique they are doc themselves. Else rows that share an id are documents of their own, in the order of
    their texts, and rows with a null id come last: they get numbers in that order in a staged table.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    repeats = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1)
    if not repeats.collect():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    keys = [F.asc_nulls_last("doc_id"), F.asc("text")]
    return stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("doc", F.monotonically_increasing_id()), "repeats-ids").select("doc", "doc_id", "text")
