"""A versioned key-value store on Parquet: the public interface.

Writes are batches: rows get consecutive sequence numbers and become one log segment by one manifest commit; batches that are not synced wait
in the driver's memory and share the next one's segment. Segments that fill the write buffer are frozen, a flush
turns frozen segments into sorted files of level 0, a compaction merges files into the next level; either swaps its inputs
for its outputs in one commit, so every row is visible exactly once. Reads pin a manifest version, prune files by
key range and sequence numbers, and resolve versions with one mergeable aggregate. Old files stay until vacuum().
With the option background, a worker thread flushes and compacts; otherwise a write that fills the buffers does.
"""

from __future__ import annotations

import threading
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, visibility
from ..operators.compaction import MergeOperator
from ..schema import CF_NAMES, CF_USER, DELETE, LEVELS, LOG, PUT, EmptyTable, InvalidArgument, InvalidColumnFamily, NotFound, UnknownColumnFamily
from ..sources.config import CODECS, Options, load_options
from ..sources.manifest import EMPTY, Manifest
from .background import BackgroundWorker, CompactionCommand, FlushCommand

_COLUMNS = ["cf", "user_key", "seq", "op", "value"]


class WriteBatch:
    """An ordered list of puts and deletes that becomes visible as one."""

    def __init__(self):
        self.entries: list[tuple[int, bytes, int, bytes | None]] = []

    def put(self, cf: int, key: bytes, value: bytes) -> WriteBatch:
        self.entries.append((cf, bytes(key), PUT, bytes(value)))
        return self

    def delete(self, cf: int, key: bytes) -> WriteBatch:
        self.entries.append((cf, bytes(key), DELETE, None))
        return self

    def __len__(self) -> int:
        return len(self.entries)

    def is_empty(self) -> bool:
        return not self.entries

    def involved_cfs(self) -> list[int]:
        return list(dict.fromkeys(cf for cf, *_ in self.entries))


class Store:
    """options: the settings, or a driver-local folder with an options file. merges: families whose values are merged, and how."""

    def __init__(self, spark: SparkSession, root: str, options: Options | str | None = None, merges: dict[int, MergeOperator] | None = None):
        self.spark, self.root, self.merges = spark, root.rstrip("/"), merges or {}
        self.options = load_options(options) if isinstance(options, str) else options or Options()
        own = self.options
        self.wal_dir, self.sst_dir, manifest_dir = (d.rstrip("/") or f"{self.root}/{name}" for d, name in ((own.wal_dir, "log"), (own.sst_dir, "sst"), (own.manifest_dir, "manifest")))
        self.lock, self.busy, self._pending = threading.RLock(), threading.RLock(), []
        self.manifest = Manifest(spark, manifest_dir, own.checkpoint_edits)
        if self.manifest.exists():
            if own.error_if_exists:
                raise InvalidArgument(f"{root} has a store")
            self.state = self.manifest.load()
        else:
            if not own.create_if_missing:
                raise InvalidArgument(f"{root} has no store")
            self.state = {k: type(v)(v) for k, v in EMPTY.items()}
            self._commit({"add_families": {str(k): v for k, v in CF_NAMES.items()}})
        self.sequence, self._next_file = self.state["last_sequence"], self.state["next_file"]
        self.worker = BackgroundWorker() if own.background else None

    def close(self) -> None:
        """Sync what waits, and finish what runs in the background."""
        self.sync()
        if self.worker is not None:
            self.worker.shutdown()
            self.worker = None

    def _commit(self, edit: dict) -> None:
        with self.lock:
            self.state = self.manifest.commit(self.state, edit)

    def _numbers(self, n: int = 1) -> int:
        """The first of n new file numbers."""
        with self.lock:
            self._next_file += n
            return self._next_file - n

    # families -----------------------------------------------------------------------------------------------------------

    def families(self) -> dict[int, str]:
        return {int(k): v for k, v in self.state["families"].items()}

    def create_family(self, cf: int, name: str) -> None:
        if cf < 0 or cf >= 1 << 31 or cf in self.families():
            raise InvalidColumnFamily(str(cf))
        self._commit({"add_families": {str(cf): name}})

    def drop_family(self, cf: int) -> None:
        """What was written to the family until now is gone, even if a family with its number is made again."""
        if cf not in self.families():
            raise UnknownColumnFamily(str(cf))
        self.sync()
        self._commit({"drop_families": [cf]})

    # writes -------------------------------------------------------------------------------------------------------------

    def put(self, key: bytes, value: bytes, cf: int = CF_USER, sync: bool | None = None) -> int:
        return self.write(WriteBatch().put(cf, key, value), sync)

    def delete(self, key: bytes, cf: int = CF_USER, sync: bool | None = None) -> int:
        return self.write(WriteBatch().delete(cf, key), sync)

    def write(self, batch: WriteBatch, sync: bool | None = None) -> int:
        """Apply a batch; gives the last sequence number. An empty batch changes nothing.

        Without sync (None: as the option write_sync says) the batch is seen by this store's reads at once, and durable with the next
        synced write, sync(), or when the waiting batches fill the write buffer.
        """
        unknown = [cf for cf in batch.involved_cfs() if cf not in self.families()]
        if unknown:
            raise UnknownColumnFamily(str(unknown))
        if batch.is_empty():
            return self.sequence
        with self.lock:
            base = self.sequence + 1
            self._pending += [(cf, bytearray(k), base + i, op, None if v is None else bytearray(v)) for i, (cf, k, op, v) in enumerate(batch.entries)]
            last = self.sequence = base + len(batch) - 1
        if (self.options.write_sync if sync is None else sync) or sum(len(r[1]) + len(r[4] or b"") for r in self._pending) >= self.options.write_buffer_size:
            self.sync()
        return last

    def sync(self) -> int:
        """Make all batches durable, by one segment; gives the durable sequence number."""
        with self.lock:
            if self._pending:
                rows = self._pending
                self._append(self.spark.createDataFrame(rows, LOG), rows[0][2], len(rows), sum(len(r[1]) + len(r[4] or b"") for r in rows))
                self._pending = []
        self._make_room()
        return self.state["last_sequence"]

    def write_frame(self, batch: DataFrame) -> int:
        """Apply a batch of any size: cf, user_key, op, value, and ordinal, which numbers the rows from 0."""
        n, high, least, low, size = batch.agg(F.count("*"), F.max("ordinal"), F.countDistinct("ordinal"), F.min("ordinal"), F.sum(F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)))).first()
        if not n:
            return self.sequence
        if low != 0 or high != n - 1 or least != n:
            raise InvalidArgument("ordinals must number the rows from 0")
        known = self.spark.createDataFrame([(k,) for k in self.families()], "cf int")
        if batch.join(F.broadcast(known), "cf", "left_anti").limit(1).count():
            raise UnknownColumnFamily("the batch names an unknown family")
        self.sync()
        with self.lock:
            base = self.sequence + 1
            op = F.col("op").cast("int")
            rows = batch.select(F.col("cf").cast("int"), F.col("user_key").cast("binary"), (F.col("ordinal").cast("long") + base).alias("seq"), op.alias("op"), F.when(op == PUT, F.col("value").cast("binary")).alias("value"))
            last = self.sequence = base + n - 1
            self._append(rows, base, n, size or 0)
        self._make_room()
        return last

    def _append(self, rows: DataFrame, base: int, n: int, size: int) -> None:
        number = self._numbers()
        path = f"{self.wal_dir}/{number:06d}-{uuid.uuid4().hex}"  # of two writers of one number, none touches the other's
        rows.write.mode("overwrite").option("compression", CODECS[self.options.compression]).parquet(path)
        self._commit({"add_segments": [{"segment": number, "path": path, "min_seq": base, "max_seq": base + n - 1, "bytes": int(size)}], "next_file": self._next_file, "last_sequence": base + n - 1})

    def _make_room(self) -> None:
        """Freeze segments that fill the write buffer; flush, and compact what has reached its trigger."""
        active = [s for s in self.state["segments"].values() if "frozen" not in s]
        if sum(s["bytes"] for s in active) < self.options.write_buffer_size:
            return
        self.freeze_active()
        me = weakref.ref(self)
        if self.worker is not None:
            self.worker.schedule(FlushCommand(me))
            self.worker.schedule(CompactionCommand(me))
            if len({s["frozen"] for s in self.state["segments"].values() if "frozen" in s}) > self.options.max_write_buffer_number:
                self.worker.drain()  # writers wait while too many buffers do
        else:
            self.flush()

    def freeze_active(self) -> list[int]:
        """Freeze the active segments: later writes go to new ones, and the next flush takes these."""
        with self.lock:
            active = [s["segment"] for s in self.state["segments"].values() if "frozen" not in s]
            if active:
                self._commit({"freeze": active})
        return active

    # snapshots ----------------------------------------------------------------------------------------------------------

    @property
    def snapshots(self) -> list[int]:
        """The live snapshots; they are in the manifest, so a store that is opened again keeps them."""
        return list(self.state["snapshots"])

    def snapshot(self) -> int:
        self.sync()
        self._commit({"add_snapshots": [self.sequence]})
        return self.sequence

    def release_snapshot(self, snapshot: int) -> None:
        if snapshot in self.state["snapshots"]:
            self._commit({"drop_snapshots": [snapshot]})

    # reads --------------------------------------------------------------------------------------------------------------

    @staticmethod
    def _files(state: dict, cf: int | None = None, begin: bytes | None = None, end: bytes | None = None, snapshot: int | None = None) -> list[dict]:
        return [
            f for f in state["files"].values()
            if (cf is None or f["cf"] == cf) and (begin is None or bytes.fromhex(f["largest_key"]) >= begin) and (end is None or bytes.fromhex(f["smallest_key"]) < end) and (snapshot is None or f["min_seq"] <= snapshot)
        ]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def _log_rows(self, state: dict, segments: list[dict]) -> DataFrame:
        """The rows of log segments, without those of families that were dropped after they were written."""
        out = self._read([s["path"] for s in segments])
        for cf, seq in state["dropped"].items():
            out = out.where((F.col("cf") != int(cf)) | (F.col("seq") > seq))
        return out

    def log(self, cf: int | None = None, begin: bytes | None = None, end: bytes | None = None, snapshot: int | None = None) -> DataFrame:
        """All stored versions that may matter to a key range [begin, end) at a snapshot."""
        with self.lock:
            state, pending = self.state, list(self._pending)
        out = self._log_rows(state, [s for s in state["segments"].values() if snapshot is None or s["min_seq"] <= snapshot])
        found = [f["path"] for f in self._files(state, cf, begin, end, snapshot)]
        if found:
            out = out.unionAll(self._read(found))
        if pending:
            out = out.unionAll(self.spark.createDataFrame(pending, LOG))
        out = out if cf is None else out.where(F.col("cf") == cf)
        out = out if begin is None else out.where(F.col("user_key") >= F.lit(bytearray(begin)))
        out = out if end is None else out.where(F.col("user_key") < F.lit(bytearray(end)))
        return visibility.at_snapshot(out, snapshot)

    def _live(self, log: DataFrame, cf: int) -> DataFrame:
        return compaction.merged(log, self.merges[cf]) if cf in self.merges else visibility.live(log)

    def get(self, key: bytes, cf: int = CF_USER, snapshot: int | None = None) -> bytes | None:
        if cf not in self.families():
            raise NotFound(f"family {cf}")
        found = self._live(self.log(cf, key, key + b"\x00", snapshot), cf).select("value").collect()
        return bytes(found[0].value) if found else None

    def multi_get(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        """The live rows of keys (cf, user_key); files outside the keys' bounds in their family are not read."""
        wanted = keys.select(F.col("cf").cast("int"), F.col("user_key").cast("binary")).distinct()
        out = None
        for r in wanted.groupBy("cf").agg(F.min("user_key").alias("low"), F.max("user_key").alias("high")).collect():
            if r.cf not in self.families():
                continue
            log = self.log(r.cf, bytes(r.low), bytes(r.high) + b"\x00", snapshot).join(wanted.where(F.col("cf") == r.cf), visibility.KEY, "left_semi")
            part = self._live(log, r.cf)
            out = part if out is None else out.unionAll(part)
        return self.spark.createDataFrame([], "cf int, user_key binary, seq bigint, value binary") if out is None else out

    def scan(self, cf: int = CF_USER, begin: bytes | None = None, end: bytes | None = None, snapshot: int | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
        """Live rows in key order; an unknown family is empty."""
        if cf not in self.families():
            return self.spark.createDataFrame([], "cf int, user_key binary, seq bigint, value binary")
        out = self._live(self.log(cf, begin, end, snapshot), cf).orderBy(F.desc("user_key") if reverse else F.asc("user_key"))
        return out if limit is None else out.limit(limit)

    def cursor(self, cf: int = CF_USER, snapshot: int | None = None, page: int = 1000) -> Cursor:
        return Cursor(self, cf, self.sequence if snapshot is None else snapshot, page)

    # background work --------------------------------------------------------------------------------------------------------

    def _write_files(self, rows: DataFrame, cf: int, level: int, count: int) -> list[dict]:
        """Write sorted files of one family with disjoint key ranges, and read their statistics back."""
        if not count:
            raise EmptyTable("a file needs an entry")
        own = self.options.of_family(cf)
        path = f"{self.sst_dir}/level={level}/file={self._numbers():06d}-{uuid.uuid4().hex}"
        parts = max(1, -(-count // own.target_file_rows))
        placed = rows.select(_COLUMNS).repartitionByRange(parts, "cf", "user_key").sortWithinPartitions("cf", "user_key", F.desc("seq"))
        writer = placed.write.mode("overwrite").option("compression", CODECS[own.compression])
        if own.filter_policy == "bloom":
            # a chunk that is a dictionary as a whole gets no filter
            writer = writer.option("parquet.bloom.filter.enabled#user_key", "true").option("parquet.bloom.filter.expected.ndv#user_key", str(max(1, min(count, own.target_file_rows)))).option("parquet.enable.dictionary#user_key", "false")
        writer.parquet(path)
        by = self._read([path]).withColumn("path", F.col("_metadata.file_path"))
        stats = by.groupBy("path", "cf").agg(F.count("*").alias("n"), F.sum((F.col("op") == DELETE).cast("long")).alias("d"), F.hex(F.min("user_key")).alias("lo"), F.hex(F.max("user_key")).alias("hi"), F.min("seq").alias("s0"), F.max("seq").alias("s1"))
        found = sorted(stats.collect(), key=lambda r: (r.cf, r.lo))
        number = self._numbers(len(found))
        return [{"file_number": number + i, "path": r.path, "cf": r.cf, "level": level, "num_entries": r.n, "num_deletes": r.d, "smallest_key": r.lo, "largest_key": r.hi, "min_seq": r.s0, "max_seq": r.s1} for i, r in enumerate(found)]

    def flush(self) -> list[dict]:
        """Turn the log segments, as far as they reach now, into files of level 0; without segments nothing happens."""
        with self.busy:  # one flush or compaction at a time; writes go on
            self.freeze_active()
            state = self.state
            segments = [s for s in state["segments"].values() if "frozen" in s]
            if not segments:
                return []
            rows, files = self._log_rows(state, segments), []
            sizes = {r.cf: r.n for r in rows.groupBy("cf").agg(F.count("*").alias("n")).collect()}
            for cf in sorted(set(sizes) & set(self.families())):  # a file belongs to one family
                files += self._write_files(rows.where(F.col("cf") == cf), cf, 0, sizes[cf])
            with self.lock:  # a family may have been dropped meanwhile
                alive = [f for f in files if f["cf"] in self.families() and f["min_seq"] > self.state["dropped"].get(str(f["cf"]), 0)]
                self._commit({"add_files": alive, "delete_segments": [s["segment"] for s in segments], "next_file": self._next_file})
        return alive

    def compact_range(self, cf: int = CF_USER, begin: bytes | None = None, end: bytes | None = None, level: int = 0) -> list[dict]:
        """Merge a level's files that meet [begin, end) with what they overlap in the next level, into that level."""
        if not 0 <= level < LEVELS - 1:
            raise InvalidArgument(f"level {level} has no next level")
        with self.busy:
            state = self.state
            here = [f for f in self._files(state, cf, begin, end) if f["level"] == level]
            if not here:
                return []
            while True:  # files of level 0 overlap each other: take in what the range has grown to
                low, high = min(f["smallest_key"] for f in here), max(f["largest_key"] for f in here)
                grown = [f for f in self._files(state, cf) if f["level"] == level and f["largest_key"] >= low and f["smallest_key"] <= high]
                if len(grown) == len(here):
                    break
                here = grown
            below = [f for f in self._files(state, cf) if f["level"] == level + 1 and f["largest_key"] >= low and f["smallest_key"] <= high]
            inputs = here + below
            low, high = min(f["smallest_key"] for f in inputs), max(f["largest_key"] for f in inputs)
            chosen, newest = {f["file_number"] for f in inputs}, max(f["max_seq"] for f in inputs)
            bottom = not any(f["file_number"] not in chosen and f["largest_key"] >= low and f["smallest_key"] <= high and f["min_seq"] < newest for f in self._files(state, cf))
            merge = self.merges.get(cf)
            rows = self._read([f["path"] for f in inputs]).where(F.col("cf") == cf)
            if merge is None or merge.join is not None:
                rows = compaction.compact(rows, self.snapshots, bottom, merge)
            path = f"{self.wal_dir}/compaction-{uuid.uuid4().hex}"
            rows.write.mode("overwrite").parquet(path)  # once, so that the rows are counted and dealt out without merging again
            kept = self._read([path])
            count = kept.count()
            files = self._write_files(kept, cf, level + 1, count) if count else []
            with self.lock:
                alive = files if cf in self.families() and all(str(n) in self.state["files"] for n in chosen) else []
                self._commit({"add_files": alive, "delete_files": sorted(chosen), "next_file": self._next_file})
            self.manifest.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        return alive

    def auto_compact(self) -> int:
        """Compact each family's levels that have as many files as the trigger; gives how many levels were compacted."""
        done = 0
        for cf in self.families():
            for level in range(LEVELS - 1):
                if sum(f["level"] == level for f in self._files(self.state, cf)) >= self.options.level0_file_num_compaction_trigger:
                    done += bool(self.compact_range(cf, level=level))
        return done

    def vacuum(self) -> int:
        """Delete files that the current state does not mention. No reader may still use an older state."""
        plain = lambda p: p.split(":", 1)[-1].lstrip("/")
        with self.busy:
            live = {plain(f["path"]) for f in [*self.state["files"].values(), *self.state["segments"].values()]}
            path, gone = self.spark._jvm.org.apache.hadoop.fs.Path, 0
            for folder in (self.wal_dir, self.sst_dir):
                base = path(folder)
                fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
                if not fs.exists(base):
                    continue
                found, names = fs.listFiles(base, True), []
                while found.hasNext():
                    names.append(found.next().getPath().toString())
                for name in names:
                    at = plain(name)
                    if at not in live and at.rsplit("/", 1)[0] not in live:
                        gone += bool(fs.delete(path(name), False))
        return gone

    def levels(self) -> DataFrame:
        """cf, level, files, entries, tombstones of the current state."""
        rows = [(f["cf"], f["level"], f["num_entries"], f["num_deletes"]) for f in self.state["files"].values()]
        df = self.spark.createDataFrame(rows, "cf int, level int, n long, d long")
        return df.groupBy("cf", "level").agg(F.count("*").alias("num_files"), F.sum("n").alias("num_entries"), F.sum("d").alias("num_deletes"))


class Cursor:
    """A position in the live rows of a family at a snapshot; it fetches one page of rows at a time."""

    def __init__(self, store: Store, cf: int, snapshot: int, page: int):
        self.store, self.cf, self.at, self.page = store, cf, snapshot, page
        self.rows: list = []
        self.place = 0

    def _load(self, begin: bytes | None, end: bytes | None, reverse: bool) -> None:
        self.rows = self.store.scan(self.cf, begin, end, self.at, reverse, self.page).collect()
        if reverse:
            self.rows.reverse()
        self.place = len(self.rows) - 1 if reverse else 0

    def valid(self) -> bool:
        return 0 <= self.place < len(self.rows)

    def seek_to_first(self) -> None:
        self._load(None, None, False)

    def seek_to_last(self) -> None:
        self._load(None, None, True)

    def seek(self, key: bytes) -> None:
        self._load(key, None, False)

    def next(self) -> None:
        if self.valid():
            last = self.key()
            self.place += 1
            if self.place == len(self.rows):
                self._load(last + b"\x00", None, False)

    def prev(self) -> None:
        if self.valid():
            first = self.key()
            self.place -= 1
            if self.place < 0:
                self._load(None, first, True)

    def key(self) -> bytes:
        if not self.valid():
            raise InvalidArgument("the cursor is at no row")
        return bytes(self.rows[self.place].user_key)

    def value(self) -> bytes:
        if not self.valid():
            raise InvalidArgument("the cursor is at no row")
        return bytes(self.rows[self.place].value)
