"""Every registered query against its SQL, and the operators on rows of their own."""

import os

import duckdb
import pytest

from tidemark.functions import codec
from tidemark.functions.prefix import numbered, running
from tidemark.operators import cache, commands, compaction, files, filters, visibility
from tidemark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(rows):
    return sorted(tuple("NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert canon(rows) == canon([tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()])


LOG = "cf int, user_key string, seq long, op int, value double"


def test_snapshot_visibility(spark):
    log = spark.createDataFrame([(0, "7", 105, 0, 105.0), (0, "7", 103, 0, 103.0), (0, "7", 100, 0, 100.0)], LOG)
    see = lambda s: [r.value for r in visibility.live(log, s).collect()]
    assert (see(104), see(105), see(99), see(None)) == ([103.0], [105.0], [], [105.0])


def test_a_tombstone_is_judged_after_the_newest_version(spark):
    log = spark.createDataFrame([(0, "k", 1, 0, 1.0), (0, "k", 2, 1, None), (0, "k", 3, 0, 3.0)], LOG)
    assert [visibility.live(log, s).count() for s in (1, 2, 3)] == [1, 0, 1]


def test_asof_over_ranges(spark):
    log = spark.createDataFrame([(0, "k", s, int(s % 5 == 0), float(s)) for s in range(1, 40)], LOG)
    asked = spark.createDataFrame([(i, 0, "k", i) for i in range(45)] + [(99, 0, "none", 5)], "request_id long, cf int, user_key string, at_seq long")
    got = {r.request_id: r.found_seq for r in visibility.asof(asked, log, width=7).collect()}
    want = {i: None if min(i, 39) % 5 == 0 else min(i, 39) for i in range(45)} | {99: None}
    assert got == want


def test_compaction_keeps_live_snapshots(spark):
    rows = [(0, f"k{s * 7 % 5}", s, int(s % 3 == 0), None if s % 3 == 0 else float(s)) for s in range(1, 60)]
    log = spark.createDataFrame(rows, LOG)
    for bottom in (False, True):
        kept = compaction.compact(log, [20, 41], bottom)
        for s in (20, 41, None):
            assert sorted(map(tuple, visibility.live(kept, s).collect())) == sorted(map(tuple, visibility.live(log, s).collect()))
        assert kept.count() < 20


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_over_ranges(spark, how):
    rows = [(i % 2, i, (i * 37) % 11) for i in range(60)]
    got = {(r.g, r.i): r.out for r in running(spark.createDataFrame(rows, "g int, i long, v long"), ["g"], "i", "v", "out", how, width=7).collect()}
    for g, i, _ in rows:
        before = [v for h, j, v in rows if h == g and j <= i]
        assert got[g, i] == (sum(before) if how == "sum" else max(before))


def test_codecs(spark):
    values = [0, 1, 127, 128, 129, 16383, 16384, 1_000_000, 2**32 - 1, 2**63 - 1, -1]

    def varint(v):
        v, out = v % 2**64, []
        while v >= 128:
            out.append(v % 128 + 128)
            v //= 128
        return bytes([*out, v]).hex()

    from pyspark.sql import functions as F

    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", codec.varint_length(F.col("v")).alias("n"), codec.varint_hex(F.col("v")).alias("h"), codec.fixed_hex(F.col("v"), 8).alias("f")).collect()
    for r in got:
        assert (r.h, r.n) == (varint(r.v), len(varint(r.v)) // 2)
        assert r.f == (r.v % 2**64).to_bytes(8, "little").hex()
    one = spark.range(1).select(F.crc32(F.lit("123456789")).alias("crc"), codec.crc_mask(F.lit(0xCBF43926)).alias("m"), codec.fnv1a(F.lit("a")).alias("h")).first()
    assert one.crc == 0xCBF43926 and one.h == 0xE40C292C
    assert one.m == (((0xCBF43926 >> 15) | (0xCBF43926 << 17)) + codec.CRC_MASK_DELTA) % 2**32


def test_reading_what_was_encoded(spark):
    from pyspark.sql import functions as F

    values = [0, 1, 127, 128, 300, 16383, 16384, 2**32 - 1, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", F.concat(F.lit("ff"), codec.varint_hex(F.col("v")), F.lit("aa")).alias("h"), codec.fixed_hex(F.col("v"), 8).alias("f"))
    for r in df.select("v", codec.read_varint(F.col("h"), 1).alias("x"), codec.read_fixed(F.col("f"), 0, 8).alias("y"), F.length("h").alias("n")).collect():
        assert r.x.value == r.v == r.y and 2 * r.x.next + 2 == r.n
    cut = spark.range(1).select(codec.read_varint(F.lit("80"), 0).alias("a"), codec.read_prefixed(F.lit("0261"), 0).alias("b"), codec.read_prefixed(F.lit("026162ff"), 0).alias("c"), codec.read_prefixed(F.lit("00"), 0).alias("d")).first()
    assert cut.a is None and cut.b is None and (cut.c.value, cut.c.next) == ("6162", 3) and (cut.d.value, cut.d.next) == ("", 1)


def test_a_batch_is_decoded_whole_or_not_at_all(spark):
    import struct

    from pyspark.sql import functions as F

    entries = [(0, 0, b"key", b"value"), (7, 1, b"", None), (1, 0, b"k", b""), (0, 0, b"\xff\x00", bytes(range(256)))]
    data = struct.pack("<BQI", 1, 1 << 40, len(entries))
    for cf, op, key, value in entries:
        data += struct.pack("<BII", 1 + op, cf, len(key)) + key + (struct.pack("<I", len(value)) + value if op == 0 else b"")
    rows = [(0, data), (1, struct.pack("<BQI", 1, 5, 0)), (2, b"\x02" + data[1:]), (3, data + b"x"), (4, data[:13] + b"\x09" + data[14:]), (5, b""), (6, struct.pack("<BQI", 1, 5, 2**31))] + [(100 + i, data[:i]) for i in range(1, len(data), 7)] + [(9, None)]
    df = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in rows], "i int, d binary")
    got = {r.i: r.b for r in df.select("i", codec.decode_batch(F.col("d")).alias("b")).collect()}
    assert got[0].base == 1 << 40 and [(e.cf, e.op, bytes(e.user_key), None if e.value is None else bytes(e.value)) for e in got[0].entries] == entries
    assert got[1].base == 5 and got[1].entries == []
    assert all(b is None for i, b in got.items() if i > 1)
    built = spark.createDataFrame([(cf, op, bytearray(k), None if v is None else bytearray(v), i) for i, (cf, op, k, v) in enumerate(entries)], "cf int, op int, k binary, v binary, i int")
    one = built.orderBy("i").select(codec.encode_entry(F.col("cf"), F.col("op"), F.col("k"), F.col("v")).alias("e")).collect()
    record = spark.createDataFrame([([r.e for r in one],)], "e array<string>").select(codec.encode_batch(F.lit(1 << 40), F.col("e")).alias("r")).first().r
    assert bytes(record) == data


def test_log_files_lose_only_what_is_damaged(spark, tmp_path):
    from tidemark.schema import Corruption
    from tidemark.sources import wal

    rnd = __import__("random").Random(1)
    records = [rnd.randbytes(n) for n in (0, 1, 100, 32_754, 32_761, 7, 40_000, 100_000, 3)] + [rnd.randbytes(rnd.randint(0, 9000)) for _ in range(60)]
    data = b"".join(wal.frame(records))
    assert list(wal.unframe(data, strict=True)) == records
    again = data + b"".join(wal.frame([b"more"], at=len(data)))
    assert list(wal.unframe(again)) == [*records, b"more"]
    for cut in range(0, len(data), 9973):
        part = list(wal.unframe(data[:cut]))
        assert part == records[: len(part)]
    with pytest.raises(Corruption):
        list(wal.unframe(data[: 32_768 * 3 + 50], strict=True))
    for place in (3, 40_000, 150_000):
        bad = bytearray(data)
        bad[place] ^= 1
        got = list(wal.unframe(bytes(bad)))
        assert all(r in records for r in got) and len(records) - 40 < len(got) < len(records) and got[-1] == records[-1]
    (tmp_path / "000007.log").write_bytes(data)
    (tmp_path / "000008.log").write_bytes(b"")
    read = wal.read_logs(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [bytes(r.record) for r in read] == records and {r.log for r in read} == {7}


def test_prefixes_of_long_keys(spark):
    keys = ["a" * 20 + "x", "a" * 20 + "y", "a" * 20 + "yé", "a" * 20 + "yè", "", "a", "b" * 300, "b" * 300 + "c"]
    df = spark.createDataFrame([(0, k) for k in keys], "cf int, user_key string")
    for ranges in (1, 3, 128):
        got = {r.user_key: (r.entry, r.shared, r.non_shared) for r in files.shared_prefixes(df, ranges=ranges).collect()}
        order = sorted(keys, key=str.encode)
        for i, k in enumerate(order):
            a, b = k.encode(), order[i - 1].encode()
            n = 0 if i == 0 else next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert got[k] == (i, n, len(a) - n)
    assert got["a" * 20 + "y"][1] == 20 and got["a" * 20 + "yé"][1] == 22


def test_candidates_by_broadcast_and_by_ranges(spark):
    files_ = spark.createDataFrame([(i % 2, i, f"{i * 3:04d}", f"{i * 3 + 10:04d}") for i in range(60)] + [(0, 99, "0000", "9999")], "cf int, file_no long, smallest_key string, largest_key string")
    probes = spark.createDataFrame([(i % 3, f"{i:04d}") for i in range(0, 250)], "cf int, user_key string")
    rows = lambda df: sorted(map(tuple, df.select("cf", "user_key", "file_no").collect()))
    want = sorted((p.cf, p.user_key, f.file_no) for p in probes.collect() for f in files_.collect() if p.cf == f.cf and f.smallest_key <= p.user_key <= f.largest_key)
    assert rows(files.candidates(probes, files_)) == rows(files.candidates(probes, files_, most=5, ranges=9)) == want


def test_numbered_over_ranges(spark):
    rows = [(i % 2, f"k{i * 37 % 101:03d}") for i in range(101)]
    for ranges in (1, 6):
        got = {(r.g, r.k): (r.n, r.b) for r in numbered(spark.createDataFrame(rows, "g int, k string"), ["g"], "k", "n", "b", ranges).collect()}
        for g in (0, 1):
            own = sorted(k for h, k in rows if h == g)
            assert all(got[g, k] == (i, own[i - 1] if i else None) for i, k in enumerate(own))


def test_a_file_with_falling_keys_is_refused(spark):
    from tidemark.schema import InvalidKeyOrder

    log = spark.createDataFrame([(0, 1, "a", 1), (0, 1, "b", 2), (0, 2, "a", 3)], "cf int, file_no long, user_key string, seq long")
    assert files.check_sorted(log).count() == 3
    with pytest.raises(InvalidKeyOrder):
        files.check_sorted(log.unionAll(spark.createDataFrame([(0, 1, "b", 4)], log.schema)))


def test_merging_values(spark):
    from pyspark.sql import functions as F

    log = spark.createDataFrame([(0, "k", s, int(s % 11 == 0), None if s % 11 == 0 else f"v{s}") for s in range(1, 40)] + [(0, "j", 50, 0, "only")], "cf int, user_key string, seq long, op int, value string")
    join = lambda a, b: F.concat(a, F.lit("+"), b)
    merge = compaction.MergeOperator("plus", join, join=join)
    want = {"k": "+".join(f"v{s}" for s in range(34, 40)), "j": "only"}
    assert {r.user_key: r.value for r in compaction.merged(log, merge).collect()} == want
    assert {r.user_key: r.merged for r in compaction._folded(compaction.operands(log), visibility.KEY, merge, width=2).collect()} == want
    for snapshots in ([], [15, 30]):
        for bottom in (False, True):
            kept = compaction.compact(log, snapshots, bottom, merge)
            for s in [*snapshots, None]:
                assert sorted(map(str, compaction.merged(kept, merge, s).collect())) == sorted(map(str, compaction.merged(log, merge, s).collect()))
    first = compaction.MergeOperator("first", lambda a, v: a)
    assert {r.user_key: r.value for r in compaction.merged(log, first).collect()} == {"k": "v34", "j": "only"}


def test_bloom_filters_miss_nothing(spark):
    keys = spark.createDataFrame([(i % 3, f"key{i}") for i in range(900)], "file int, user_key string")
    bloom = filters.POLICIES["bloom"](10)
    built = bloom.build(keys, ["file"])
    assert sorted(map(tuple, bloom.may_match(keys, built, ["file"]).collect())) == sorted(map(tuple, keys.collect()))
    others = spark.createDataFrame([(i % 3, f"other{i}") for i in range(900)], "file int, user_key string")
    assert 0 < bloom.may_match(others, built, ["file"]).count() < 45
    assert bloom.may_match(others, built.limit(0), ["file"]).count() == 0


def test_cache_is_least_recently_used(spark):
    from collections import OrderedDict

    rnd = __import__("random").Random(2)
    accesses = [(t, rnd.randrange(40), rnd.randrange(6) * 4096) for t in range(3000)]
    got = {r.shard: (r.accesses, r.hits, r.evictions) for r in cache.simulate(spark.createDataFrame(accesses, "at long, file_no long, offset long").repartition(5), 7).collect()}
    want, held = {}, {}
    for _, f, o in accesses:
        shard = (f ^ (o << 17)) & 15
        lru, n = held.setdefault(shard, OrderedDict()), want.setdefault(shard, [0, 0, 0])
        n[0] += 1
        if (f, o) in lru:
            n[1] += 1
            lru.move_to_end((f, o))
        else:
            n[2] += len(lru) >= 7
            if len(lru) >= 7:
                lru.popitem(last=False)
            lru[f, o] = 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_catalog_fold(spark):
    schema = "edit_id long, cf int, kind string, level int, file_number long, smallest_key string, largest_key string, file_size long, cf_name string, next_file_number long, last_sequence long"
    none = (None,) * 3
    edits = spark.createDataFrame(
        [(1, 0, "add_file", 0, 5, "a", "c", 1, *none), (2, 0, "delete_file", 0, 5, None, None, None, *none), (2, 0, "add_file", 1, 5, "a", "c", 1, *none), (3, 0, "delete_file", 1, 5, None, None, None, *none), (3, 0, "add_file", 1, 5, "a", "d", 2, *none)],
        schema,
    )
    assert [tuple(r) for r in files.live_files(edits).collect()] == [(0, 1, 5, "a", "d", 2)]


def test_commands(spark):
    lines = ["ping", "GET a", "SET a 1 extra", "get a", "SET a é", "GET a", "", "  ", "SET a", "GET", "FLY", "GET b"]
    got = {r.n: r.reply for r in commands.replies(spark.createDataFrame(list(enumerate(lines)), "n long, command string")).collect()}
    want = ["+PONG", "$-1", "+OK", "$1\r\n1", "+OK", "$2\r\né", "-ERR empty command", "-ERR empty command", "-ERR SET needs key value", "-ERR GET needs key", "-ERR unknown command", "$-1"]
    assert [got[i] for i in range(len(lines))] == [w + "\r\n" for w in want]


def test_commands_can_be_added(spark):
    from pyspark.sql import functions as F

    echo = commands.Command("ECHO", 1, lambda a: commands.bulk(F.array_join(a, " ")), "text")
    got = {r.n: r.reply for r in commands.replies(spark.createDataFrame([(0, "echo a  bé"), (1, "ECHO"), (2, "set a 1"), (3, "get a")], "n long, command string"), (echo,)).collect()}
    assert got == {0: "$5\r\na bé\r\n", 1: "-ERR ECHO needs text\r\n", 2: "+OK\r\n", 3: "$1\r\n1\r\n"}


def test_range_and_latest_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(0, "k", 1, 0, 1.0)], LOG).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = visibility.live(log.where("user_key >= 'a' and user_key < 'm'"), 5)._jdf.queryExecution().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line][-1]
    assert "GreaterThanOrEqual(user_key,a)" in pushed and "LessThanOrEqual(seq,5)" in pushed and "(op" not in pushed


def test_streaming_equals_batch(spark, tmp_path):
    from tidemark.schema import LOG as SCHEMA
    from tidemark.streaming import live

    rows = [(0, bytearray(b"k%d" % (s % 4)), s, int(s % 6 == 0), None if s % 6 == 0 else bytearray(b"%d" % s)) for s in range(1, 30)]
    for i in range(3):  # later sequence numbers may come first
        spark.createDataFrame(rows[2 - i :: 3], SCHEMA).write.parquet(str(tmp_path / f"log/{i}"))
    query = live.live_table(live.read_log(spark, str(tmp_path / "log"), 1)).writeStream.outputMode("complete").format("memory").queryName("live_now").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = visibility.live(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(str, spark.table("live_now").collect())) == sorted(map(str, batch.collect()))
    done = live.upsert_into(live.read_log(spark, str(tmp_path / "log"), 1), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    changed = spark.read.parquet(str(tmp_path / "out")).drop("trigger")
    assert sorted(map(str, visibility.live(changed).collect())) == sorted(map(str, batch.collect()))
