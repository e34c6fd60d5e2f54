"""The store against a plain model: reads never change by flush, compaction or reopening."""

import random

import pytest

from tidemark.operators.compaction import APPEND, MergeOperator
from tidemark.plans.background import BackgroundWorker
from tidemark.plans.store import Store, WriteBatch
from tidemark.schema import ConfigError, EmptyTable, InvalidArgument, InvalidColumnFamily, NotFound, StoreIOError, UnknownColumnFamily, cf_type
from tidemark.sources.config import FamilyOptions, Options, load_options


def rows(df):
    return [(bytes(r.user_key), bytes(r.value)) for r in df.collect()]


def model_at(history, seq, cf=0):
    out = {}
    for s, c, k, v in history:
        if s <= seq and c == cf:
            out[k] = v
    return sorted((k, v) for k, v in out.items() if v is not None)


def test_random_operations_keep_every_live_snapshot(spark, tmp_path):
    rnd, history, seq = random.Random(5), [], 0
    store = Store(spark, str(tmp_path / "db"), Options(level0_file_num_compaction_trigger=2))
    snapshots = []
    for step in range(14):
        batch = WriteBatch()
        for _ in range(rnd.randint(1, 12)):
            key, cf = bytes([rnd.randint(97, 106)]) * rnd.randint(1, 2), rnd.choice([0, 0, 1])
            seq += 1
            if rnd.random() < 0.3:
                batch.delete(cf, key)
                history.append((seq, cf, key, None))
            else:
                value = b"v%d" % seq if rnd.random() < 0.9 else b""
                batch.put(cf, key, value)
                history.append((seq, cf, key, value))
        assert store.write(batch) == seq
        if step % 4 == 1:
            snapshots.append(store.snapshot())
        if step % 3 == 2:
            store.flush()
        if step == 8:
            store.compact_range(0, b"b", b"f")
        if step == 9:
            store = Store(spark, str(tmp_path / "db"))
            assert store.snapshots == snapshots
        if step == 11:
            store.auto_compact()
            store.vacuum()
        if step in (5, 8, 11, 13):
            for s in [*snapshots, seq]:
                for cf in (0, 1):
                    assert rows(store.scan(cf, snapshot=s)) == model_at(history, s, cf), (step, s, cf)
    want = dict(model_at(history, seq))
    for key in (b"a", b"bb", b"jj", b"zz"):
        assert store.get(key) == want.get(key)
    assert rows(store.scan(begin=b"c", end=b"g")) == [(k, v) for k, v in model_at(history, seq) if b"c" <= k < b"g"]
    assert rows(store.scan(reverse=True, limit=3)) == model_at(history, seq)[::-1][:3]
    store.release_snapshot(snapshots[0])


def test_cursor_moves_both_ways(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.write_frame(spark.createDataFrame([(0, b"k%02d" % i, 0, b"%d" % i, i) for i in range(7)], "cf int, user_key binary, op int, value binary, ordinal int"))
    cursor = store.cursor(page=3)
    cursor.seek_to_first()
    seen = []
    while cursor.valid():
        seen.append(cursor.key())
        cursor.next()
    assert seen == [b"k%02d" % i for i in range(7)]
    cursor.seek_to_last()
    back = []
    while cursor.valid():
        back.append(cursor.value())
        cursor.prev()
    assert back == [b"%d" % i for i in range(6, -1, -1)]
    cursor.seek(b"k03x")
    assert cursor.key() == b"k04"
    cursor.seek(b"z")
    assert not cursor.valid()
    with pytest.raises(InvalidArgument):
        cursor.key()


def test_errors_and_families(spark, tmp_path):
    with pytest.raises(InvalidArgument):
        Store(spark, str(tmp_path / "none"), Options(create_if_missing=False))
    store = Store(spark, str(tmp_path / "db"))
    assert store.families() == {0: "cf_user", 1: "cf_system"}
    with pytest.raises(UnknownColumnFamily):
        store.put(b"k", b"v", cf=7)
    with pytest.raises(NotFound):
        store.get(b"k", cf=7)
    assert store.scan(7).count() == 0
    store.create_family(7, "more")
    store.put(b"k", b"v", cf=7)
    assert store.get(b"k", cf=7) == b"v"
    store.drop_family(7)
    assert store.scan(7).count() == 0
    assert store.flush() == [] or store.get(b"k") is None
    assert store.write(WriteBatch()) == 1
    batch = WriteBatch().put(1, b"a", b"").delete(0, b"b").put(1, b"c", b"x")
    assert (len(batch), batch.involved_cfs(), batch.is_empty()) == (3, [1, 0], False)
    with pytest.raises(InvalidArgument):
        store.compact_range(level=6)
    with pytest.raises(InvalidArgument):
        store.write_frame(spark.createDataFrame([(0, b"a", 0, b"", 3)], "cf int, user_key binary, op int, value binary, ordinal int"))
    with pytest.raises(EmptyTable):
        store._write_files(store.log(0).limit(0), 0, 0, 0)
    for number in (0, -1, 1 << 31):
        with pytest.raises(InvalidColumnFamily):
            store.create_family(number, "again")
    assert (cf_type(0), cf_type(1)) == ("user", "system")
    with pytest.raises(InvalidColumnFamily):
        cf_type(9)


def test_a_tombstone_hides_deeper_values(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.put(b"k", b"old")
    store.flush()
    store.compact_range(level=0)
    store.compact_range(level=1)
    store.delete(b"k")
    store.flush()
    assert store.get(b"k") is None
    new = store.compact_range(level=0)
    assert new and new[0]["num_deletes"] == 1  # level 2 still has the key
    assert store.get(b"k") is None
    store.compact_range(level=1)
    assert store.get(b"k") is None and not store.state["files"]


def test_a_dropped_family_stays_empty_when_made_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.create_family(5, "five")
    store.put(b"a", b"flushed", cf=5)
    store.flush()
    store.put(b"k", b"old", cf=5)
    store.drop_family(5)
    store.create_family(5, "five again")
    assert store.get(b"k", cf=5) is None and store.scan(5).count() == 0
    store.put(b"k", b"new", cf=5)
    store.flush()
    store = Store(spark, str(tmp_path / "db"))
    assert rows(store.scan(5)) == [(b"k", b"new")]


def test_unsynced_batches_share_a_segment(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), Options(write_sync=False))
    for i in range(5):
        assert store.put(b"k%d" % i, b"v%d" % i) == i + 1
    assert store.get(b"k3") == b"v3" and not store.state["segments"]
    assert Store(spark, str(tmp_path / "db")).scan().count() == 0
    assert store.sync() == 5 and len(store.state["segments"]) == 1
    store.put(b"k5", b"v5")
    store.put(b"k6", b"v6", sync=True)
    assert len(store.state["segments"]) == 2
    assert Store(spark, str(tmp_path / "db")).scan().count() == 7
    store.put(b"k7", b"v7")
    store.close()
    assert Store(spark, str(tmp_path / "db")).scan().count() == 8


def test_the_worker_flushes_and_compacts_in_order(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), Options(write_buffer_size=40, level0_file_num_compaction_trigger=2, background=True))
    history = []
    for i in range(12):
        key = b"k%d" % (i % 5)
        store.put(key, b"value %d" % i)
        history.append((i + 1, 0, key, b"value %d" % i))
    assert rows(store.scan()) == model_at(history, 99)
    store.worker.drain()
    assert any(f["level"] == 1 for f in store.state["files"].values())
    store.close()
    assert rows(Store(spark, str(tmp_path / "db")).scan()) == model_at(history, 99)
    done, worker = [], BackgroundWorker()
    for i in range(20):
        worker.schedule(lambda i=i: done.append(i))
    worker.schedule(lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        worker.shutdown()
    assert done == list(range(20))


def test_merged_values_survive_flush_compaction_and_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), merges={0: APPEND})
    store.put(b"k", b"a")
    store.put(b"k", b"b")
    store.flush()
    at = store.snapshot()
    store.delete(b"k")
    store.put(b"k", b"c")
    store.put(b"j", b"x")
    store.flush()
    for _ in range(3):
        assert store.get(b"k") == b"c" and store.get(b"k", snapshot=at) == b"ab" and rows(store.scan()) == [(b"j", b"x"), (b"k", b"c")]
        store.compact_range(level=0)
        store.put(b"j", b"")
        store.compact_range(level=1)
    store.release_snapshot(at)
    store.flush()
    store.compact_range(level=0)
    assert store.get(b"k") == b"c" and store.get(b"j") == b"x"
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "db"), merges={0: MergeOperator("last", lambda a, v: v)})
        from tidemark.operators.compaction import compact

        compact(store.log(0), merge=MergeOperator("last", lambda a, v: v))


def test_directories_and_filters_of_families(spark, tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf/store.json").write_text(f'{{"wal_dir": "{tmp_path}/w", "sst_dir": "{tmp_path}/s", "manifest_dir": "{tmp_path}/m", "options": {{"write_buffer_size": 100000, "compression": "zstd"}}, "user_cf": {{"filter_policy": "bloom"}}, "write": {{"sync": true}}}}')
    store = Store(spark, str(tmp_path / "db"), str(tmp_path / "conf"))
    store.write_frame(spark.range(2000).selectExpr("CAST(id % 2 AS INT) AS cf", "CAST(printf('k%06d', id) AS BINARY) AS user_key", "0 AS op", "CAST('v' AS BINARY) AS value", "id AS ordinal"))
    store.flush()
    assert {p.name for p in tmp_path.iterdir()} == {"conf", "w", "s", "m"}
    jvm = spark._jvm
    for f in store.state["files"].values():
        at = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f["path"]), spark._jsc.hadoopConfiguration())
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
        block = reader.getFooter().getBlocks().get(0)
        key = [c for c in block.getColumns() if c.getPath().toDotString() == "user_key"][0]
        assert (key.getBloomFilterOffset() > 0) == (f["cf"] == 0)  # stored for user families alone
        if f["cf"] == 0:
            filters = reader.getBloomFilterDataReader(block)
            bloom = filters.readBloomFilter(key)
            asked = lambda k: bloom.findHash(bloom.hash(jvm.org.apache.parquet.io.api.Binary.fromString(k)))
            assert asked("k000010") and sum(asked(f"none{i}") for i in range(300)) < 30
        reader.close()
    assert store.get(b"k000010") == b"v" and store.get(b"k000011") is None and store.get(b"k000011", cf=1) == b"v"
    keys = spark.createDataFrame([(0, b"k000010"), (1, b"k000011"), (0, b"none"), (9, b"k")], "cf int, user_key binary")
    assert sorted((r.cf, bytes(r.user_key)) for r in store.multi_get(keys).collect()) == [(0, b"k000010"), (1, b"k000011")]


def test_two_writers_cannot_both_commit(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "db")), Store(spark, str(tmp_path / "db"))
    one.put(b"a", b"1")
    with pytest.raises(StoreIOError):
        two.put(b"a", b"2")
    assert Store(spark, str(tmp_path / "db")).get(b"a") == b"1"


def test_the_manifest_opens_from_current_and_without_it(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), Options(checkpoint_edits=3))
    for i in range(8):
        store.put(b"k%d" % i, b"v")
    current = tmp_path / "db/manifest/CURRENT"
    assert int(current.read_text()) % 3 == 0
    whole = Store(spark, str(tmp_path / "db")).state
    for text in (None, "nonsense", "999"):
        if text is None:
            current.unlink()
        else:
            current.write_text(text)
        assert Store(spark, str(tmp_path / "db")).state == whole == store.state


def test_options_files(tmp_path):
    assert load_options(str(tmp_path)) == Options()
    (tmp_path / "store.ini").write_text("[store]\nwrite_buffer_size = 1024\ncompression = zstd\n")
    assert load_options(str(tmp_path)).write_buffer_size == 1024
    (tmp_path / "store.json").write_text('{"user_cf": {"filter_policy": "bloom"}, "options": {"compression": "zstd", "write_sync": true}, "write": {"sync": false}}')
    got = load_options(str(tmp_path))
    assert got.of_family(0) == got.of_family(7) == FamilyOptions(filter_policy="bloom", compression="zstd") and got.of_family(1) == FamilyOptions(compression="zstd") and not got.write_sync
    (tmp_path / "store.ini").write_text("[store]\nwal_dir = /W\n[options]\nwrite_buffer_size = 7\n[user_cf]\nblock_size = 9\n")
    (tmp_path / "store.json").unlink()
    got = load_options(str(tmp_path))
    assert (got.wal_dir, got.write_buffer_size, got.user_cf.block_size) == ("/W", 7, 9)
    for bad in ('{"compression": "bz2"}', '{"user_cf": {"filter_policy": "x"}}', '{"user_cf": {"nothing": 1}}', '{"user_cf": 3}', '{"write": {"x": 1}}', '{"write_buffer_size": 0}', '{"nothing": 1}', "{"):
        (tmp_path / "store.json").write_text(bad)
        with pytest.raises(ConfigError):
            load_options(str(tmp_path))
