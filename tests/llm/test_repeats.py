"""The walk over triggers held in memory, without Spark."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import repeats


def _body(rnd, doc, g, n):
    return {"doc": doc, "start": 0, "n": n, "g": g, "cnt": 1, "old": False, "many": False, "body": rnd.integers(0, 3, n + 1, np.uint64).tobytes()}


@pytest.mark.parametrize(("most", "step", "batch"), [(1, 4, 10), (1, 4, 7), (500, 4, 25), (1 << 22, 4, 10), (1, 4096, 10)])
@pytest.mark.parametrize("keep_first", [False, True])
def test_no_trigger_is_skipped(most, step, batch, keep_first):
    unit, rnd = repeats.Unit(True, 2, 1, 1 << 20), np.random.default_rng(5)
    rows = [_body(rnd, 100 * g + d, g, 4) for g in range(60) for d in range(1 + g % 3 if g % 7 else 11)]
    seen = Counter()
    first, want = set(), set()
    windows = [(r["g"], r["body"][8 * p : 8 * p + 16], r["doc"], p) for r in rows for p in range(4)]
    for g, w, _, _ in windows:
        seen[g, w] += 1
    for g, w, d, p in windows:
        if seen[g, w] > 1 and not (keep_first and (g, w) not in first):
            want.add((d, p))
        first.add((g, w))
    types = {"doc": pa.int64(), "start": pa.int32(), "n": pa.int32(), "g": pa.int64(), "cnt": pa.int32(), "old": pa.bool_(), "many": pa.bool_(), "body": pa.binary()}
    table = pa.Table.from_pylist(rows, pa.schema(types.items()))
    got = [r for b in repeats._within_triggers(unit, keep_first, most, step)(iter(table.to_batches(batch))) for r in b.to_pylist()]
    assert sorted((r["doc"], r["start"] + k) for r in got for k in range(r["n"])) == sorted(want)


@pytest.mark.parametrize("dtype", [np.uint8, np.uint64])
@pytest.mark.parametrize("win", [20, 200])
def test_window_ranks_are_a_plain_suffix_order(dtype, win):
    rnd = np.random.default_rng(win)
    codes = np.concatenate([rnd.integers(0, 2, 300), np.zeros(450), rnd.integers(0, 200, 40), np.zeros(450), rnd.integers(0, 2, 300), np.ones(5)]).astype(dtype)
    places = range(len(codes) - win + 1)
    got = repeats.window_ranks(codes, win)
    want = {w: i for i, w in enumerate(sorted({tuple(codes[p : p + win]) for p in places}))}
    assert got.tolist() == [want[tuple(codes[p : p + win])] for p in places]
    assert len(repeats.window_ranks(codes[: win - 1], win)) == 0


@pytest.mark.parametrize("most", [1, 5, 1 << 20])
@pytest.mark.parametrize(("keep_first", "salted"), [(True, False), (False, False), (True, True)])
def test_the_walk_settles_every_phrase(most, keep_first, salted):
    rnd = np.random.default_rng(2)
    rows = [{"doc": int(d), "start": 0, "n": 3, "g": int(rnd.integers(0, 25)), "c": int(rnd.integers(0, 3)), "cnt": int(rnd.integers(1, 3)), "old": bool(keep_first and d < 20)} for d in range(120)]
    rows.sort(key=lambda r: (r["g"], r["c"], not r["old"], r["doc"]))
    types = {"doc": pa.int64(), "start": pa.int32(), "n": pa.int32(), "g": pa.int64(), "c": pa.int64(), "cnt": pa.int32(), "old": pa.bool_()}
    table = pa.Table.from_pylist(rows, pa.schema(types.items()))
    got = [r for b in repeats._walk(keep_first, True, salted, most)(iter(table.to_batches(7))) for r in b.to_pylist()]
    heads, classes, total = {}, Counter(), Counter()
    for r in rows:
        heads.setdefault((r["g"], r["c"]), r)
        total[r["g"], r["c"]] += r["cnt"]
    for g, _ in heads:
        classes[g] += 1
    ranges = {r["doc"] for r in rows if not r["old"] and total[r["g"], r["c"]] > 1 and not (keep_first and heads[r["g"], r["c"]] is r)}
    assert sorted(r["doc"] for r in got if r["kind"] == repeats.RANGE) == sorted(ranges)
    asks = {(r["g"], r["c"]) for r in got if r["kind"] == repeats.ASK}
    must = {k for k in heads if classes[k[0]] > 1 or salted}
    assert must <= asks <= set(heads) and (most < 1 << 20 or asks == must)
    assert {(r["g"], r["c"]) for r in got if r["kind"] == repeats.FRESH} == {k for k, h in heads.items() if not h["old"]}
